import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import base, substring


def expected(docs, window=50):
    """Brute force: (doc_id, n_words, n_removed, sha256 of the kept words) of each row."""
    rows = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in rows:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, extra=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "text AS key", "doc_id AS mark", "1 AS start", "'x' AS spans")
    return sorted((tuple(r) for r in substring.digests(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def words(seed, n, vocabulary=1000):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, vocabulary, n)]


def corpus():
    a, b, passage = words(1, 400), words(2, 300), words(3, 70)
    docs = [
        (5, " ".join(a)), (9, " ".join(a)), (7, " ".join(a[:200] + ["edited"] + a[200:])), (11, " ".join(b[:100] + passage + b[100:])), (3, "\n".join(passage[:55])),
        (4, " ".join(passage[10:65])), (20, " ".join(words(4, 30) + passage + words(5, 30))), (2, " ".join(passage[:49])), (30, " ".join(["same"] * 300)), (31, " ".join(["same"] * 52)), (32, " ".join(["x", *["same"] * 60, "y"])),
        (40, ""), (41, None), (42, "  \n\t "), (None, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (50, " ".join(["p", "q"] * 80)), (51, "\t".join(["q", "p"] * 40)), (60, "a b " * 60), (61, "a b " * 70),
    ]
    return docs + [(100 + k, " ".join(words(6, 120))) for k in range(30)]


def test_equals_brute_force(spark):
    assert got(spark, corpus()) == expected(corpus())


def test_extra_columns_and_empty_tables(spark):
    assert got(spark, corpus(), extra=True) == expected(corpus())
    assert got(spark, []) == []
    assert got(spark, [(1, "short")]) == expected([(1, "short")])


def test_very_long_text(spark):
    long = words(7, 300_000)
    docs = [(1, " ".join(long)), (2, " ".join(long[1000:200_000])), (3, "z" * 3_000_000)]
    assert got(spark, docs) == expected(docs)


@pytest.mark.parametrize("seed", range(4))
def test_random_copies(spark, seed):
    r = np.random.default_rng(seed)
    pool = [words(100 + seed + k, 200, 3 if k == 0 else 500) for k in range(4)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(int(r.integers(1, 4))):
            p = pool[int(r.integers(4))]
            a = int(r.integers(0, 120))
            parts += p[a : a + int(r.integers(20, 120))]
        docs.append((i, " ".join(parts)))
    assert got(spark, docs) == expected(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=60, max_size=140), st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), max_size=40))
def test_equal_windows_share_their_symbol(core, before, after):
    """Whatever stands around a repeat, each of its windows is filed under the same symbol."""
    rows = [" ".join(map(str, x)).encode() for x in (core, before + core + after)]
    x = substring.stretches(rows)
    filed = {}
    split = [r.split() for r in rows]
    for row, key, start, n in zip(x["row"], x["key"], x["start"], x["n"], strict=True):
        for k in range(start, start + n):
            filed.setdefault(tuple(split[row][k : k + 50]), set()).add(int(key))
    assert all(len(v) == 1 for v in filed.values())
    assert len(filed) == len({tuple(w[k : k + 50]) for w in split for k in range(len(w) - 49)})


def test_symbols_never_cross_rows():
    buf, s, e, first = base.word_spans([b"a a a", b"a a b", b"", b"c"])
    at, end, _ = substring.recompress(base.word_hashes(buf, s, e), first[:-1][np.diff(first) > 0])
    assert {0, 3, 6} <= set(at.tolist()) and end[-1] == 7


def test_text_keeps_what_is_kept(spark):
    passage = " ".join(words(3, 60))
    docs = spark.createDataFrame([(1, f"Head.\n{passage} tail", "en", 3), (2, f"Other  one:\n{passage}\nend\tof it", "en", 9), (3, passage, "en", 1), (4, None, None, None)], "doc_id int, text string, lang string, n_chars long")
    rows = {r.doc_id: r for r in substring.deduplicated(docs).collect()}
    assert substring.deduplicated(docs).columns == docs.columns
    assert rows[1].text.startswith("Head.") and rows[2].text == "Other  one:\nend\tof it" and rows[2].n_chars == len(rows[2].text)
    assert rows[3].text == "" and rows[3].n_chars == 0 and rows[4].text is None


def test_symbols_are_tall():
    rows = [" ".join(words(k, 2000)).encode() for k in range(4)]
    buf, s, e, first = base.word_spans(rows)
    at, end, name = substring.recompress(base.word_hashes(buf, s, e), first[:-1])
    assert (end - at).max() == 6 and len(at) < 0.5 * len(s)
    spelled = {}
    for a, z, n in zip(at.tolist(), end.tolist(), name.tolist(), strict=True):
        spelled.setdefault(n, set()).add(bytes(buf[s[a] : e[z - 1]]))
    assert all(len(v) == 1 for v in spelled.values())


def test_copies_of_a_row_cost_their_number(spark, monkeypatch):
    """Rows that repeat with their id: as many windows for each as for one."""
    made = {}
    plain = base.written

    def counted(df, name, *rest):
        out = plain(df, name, *rest)
        made[name] = out.count()
        return out

    monkeypatch.setattr(base, "written", counted)
    a, b = words(1, 400), words(2, 100)
    docs = [(1, " ".join(a[:300] + b)), (2, " ".join(a))]
    for copies in (1, 40):
        rows = docs + [docs[1]] * (copies - 1)
        assert got(spark, rows) == expected(rows)
        made[copies] = made["windows"]
    assert 0 < made[40] <= 40 * made[1]
