import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import numpy as np
from test_neardup import groups
from test_text_operators import brute_contaminated
from tokenizers import Tokenizer

from lodestone.llm import base, queries

SF = "/root/testdata/sf0.001"


def test_queries_are_named_by_operator(spark):
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_keep_columns_and_take_effect(spark):
    docs = queries.table(spark, SF, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[2] < seen[1] and seen[4] < seen[3]
    kept = {r.doc_id: r for r in docs.collect()}
    assert len(kept) == seen[-1] and all(r.n_chars == len(r.text) and r.text.split() for r in kept.values())
    # no window of 50 words is left in two documents, and no benchmark item is
    windows = defaultdict(set)
    for r in kept.values():
        w = r.text.split()
        for k in range(len(w) - 49):
            windows[" ".join(w[k : k + 50])].add(r.doc_id)
    # windows that cutting has put together may repeat; those of untouched documents don't
    assert np.mean([len(v) > 1 for v in windows.values()] or [0]) < 0.001
    items = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    assert not any(i in r.text for i in items for r in kept.values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start)
    assert [(r.doc_id, r.start, r.length, r.ids_crc32) for r in sorted(rows, key=key)] == [(r.doc_id, r.start, r.length, r.ids_crc32) for r in sorted(again, key=key)]


def cut(text, gone):
    """The text without the words marked in ``gone``; what is left on either side of a cut is joined by a line feed."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    if not any(gone):
        return text
    runs, k = [], 0
    while k < len(spans):
        if gone[k]:
            k += 1
            continue
        a = k
        while k < len(spans) and not gone[k]:
            k += 1
        runs.append(text[spans[a][0] : spans[k - 1][1]])
    return "\n".join(runs)


def plain_languages(rows):
    """(language, share) of each (doc_id, text, lang) by its own counts of trigrams and its own EM."""
    most, held = 1 << 64, {}

    def bucket(gram):
        x = 0
        for c, k in zip(gram, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
            x ^= c * k % most
        for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * k % most
        return (x ^ x >> 31) >> 48

    def counts(text):
        codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        out = Counter()
        for k, n in Counter(g for g in zip(codes, codes[1:], codes[2:], strict=False) if g[1]).items():
            if k not in held:
                held[k] = bucket(k)
            out[held[k]] += n
        return out

    grams = {i: counts(t or "") for i, t, _ in rows}
    langs = sorted({lang for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2})
    n = np.zeros((1 << 16, len(langs)))
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for g, c in grams[i].items():
                n[g, langs.index(lang)] += c
    common = (n.sum(axis=1) + 1) / (n.sum() + len(n))
    p = (n + 0.2 * len(n) * common[:, None]) / (n.sum(axis=0) + 0.2 * len(n))

    def em(q, c):
        share = np.full(q.shape[1], 1 / q.shape[1])
        for _ in range(12):
            part = share * q
            share = (part / part.sum(axis=1, keepdims=True) * c[:, None]).sum(axis=0) / c.sum()
        return share

    out = {}
    for i in grams:
        if not grams[i]:
            out[i] = ("und", 0.0)
            continue
        q, c = p[list(grams[i])], np.array(list(grams[i].values()), float)
        fit = lambda chosen, share: (np.log(q[:, chosen] @ share) * c).sum()  # noqa: B023, E731
        single = [fit([k], np.ones(1)) for k in range(len(langs))]
        chosen, share, best = [int(np.argmax(single))], np.ones(1), max(single)
        full, cost = em(q, c), 4.0 * np.log(max(2, c.sum()))
        for k in np.argsort(-full, kind="stable").tolist() if fit(list(range(len(langs))), full) - best > cost else []:
            if k not in chosen:
                new = sorted([*chosen, k])
                s = em(q[:, new], c)
                if fit(new, s) - best <= cost:
                    break
                chosen, share, best = new, s, fit(new, s)
        out[i] = (langs[chosen[int(share.argmax())]], float(share.max()))
    return out


def test_run_equals_brute_force(spark):
    """Every stage by plain Python, without the engine's functions."""
    rows = [(r.doc_id, r.text, r.lang) for r in queries.table(spark, SF, "documents").collect()]
    known = plain_languages(rows)
    texts = {i: t for i, t, _ in rows if known[i][0] != "und" and known[i][1] >= 0.4}
    order = sorted(texts)
    group, seen = groups([texts[i] for i in order]), set()
    texts = {i: texts[i] for i, g in zip(order, group, strict=True) if not (g in seen or seen.add(g))}
    words = {i: t.split() for i, t in texts.items()}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            least.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        texts[i] = cut(texts[i], gone)
    texts = {i: t for i, t in texts.items() if t.split()}
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = {i for i, *_ in brute_contaminated(list(texts.items()), items)}
    clean = {i: t for i, t in texts.items() if i not in bad}
    assert 0 < len(bad) < len(texts) < len(rows)
    tokenizer = Tokenizer.from_file(queries.tokenizer())
    streams = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in clean.items()}
    at, places = defaultdict(int), defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        stream = streams[r.doc_id]
        assert (r.start, r.doc_tokens) == (at[r.doc_id], len(stream)) and r.ids_crc32 == zlib.crc32(stream[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert dict(at) == {i: len(s) for i, s in streams.items()}
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([(1001, None, None, None, None), (1002, "", "en", "s", 0), (None, "the of and that is", "en", "s", 3), (1004, "123", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    full = queries.table(spark, SF, "documents").limit(30)
    both = docs.unionByName(full)
    out = base.written(corpus_pipeline.STAGES[0][1](spark, both, SF), "language")
    ids = {r.doc_id for r in out.collect()}
    assert not ids & {1001, 1002, 1004} and None in ids
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = base.written(stage(spark, out, SF), "stage")
    assert out.count() > 0
    none = full.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = base.written(stage(spark, none, SF), "stage")
    assert none.count() == 0
