import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import base, neardup, queries, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """The component of each text over pairs of a similarity of at least 0.8, by comparing all."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    return [root(k) for k in range(len(texts))]


def edited():
    r = np.random.default_rng(3)
    out = []
    for n in (1, 4, 5, 6, 12, 40, 150, 700):
        for _ in range(5):
            w = [f"w{x}" for x in r.integers(0, 3000, n)]
            out.append(" ".join(w))
            for share in (0.0, 0.01, 0.02, 0.025, 0.03, 0.05):
                out.append(" ".join(f"e{r.integers(0, 10**6)}" if r.random() < share else x for x in w))
    center = [f"c{x}" for x in r.integers(0, 3000, 200)]
    out += [" ".join([*center[:k], f"x{i}", *center[k + 1 :]]) for i, k in enumerate(r.integers(0, 200, 120).tolist())]
    return [*out, "", None, " \n", "A b", "a  B"]


@pytest.mark.parametrize("sample", [neardup.SAMPLE, 0])
def test_equals_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(neardup, "SAMPLE", sample)
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in neardup.representatives(docs).collect())
    want = groups(texts)
    assert kept == sorted({g: k for k, g in reversed(list(enumerate(want)))}.values())


def test_pipeline_stage_finds_all_similar_pairs(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    want = groups([rows[i] for i in ids])
    kept = {r.doc_id for r in base.written(corpus_pipeline.near_duplicates(spark, docs, ""), "kept").collect()}
    assert kept == {i for k, i in enumerate(ids) if k == min(j for j in range(len(ids)) if want[j] == want[k])}


@pytest.mark.parametrize("module", [neardup, simhash])
def test_repeated_and_null_ids_lose_no_group(spark, module):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (7, b), (5, a), (None, c), (None, c), (None, d), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, module.representatives(docs).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (None, c), (9, d)], key=str)


def test_maps_bound_what_sets_share():
    r = np.random.default_rng(1)
    sets = [r.choice(3000, int(r.integers(1, 900)), replace=False) for _ in range(30)]
    hashes = [np.sort(base.mix(x.astype(np.uint64))) for x in sets]
    row = np.repeat(np.arange(30), [len(x) for x in sets])
    bits = neardup.bitmaps(row, np.concatenate(hashes), 30)
    i, j = np.triu_indices(30, 1)
    n = np.array([len(x) for x in sets])
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (neardup.most_common(n, bits, i, j) >= common).all()
    wide = neardup.wide_maps(np.concatenate(hashes), n)
    assert {len(w) for w in wide} > {32} and neardup.wide_maps(np.zeros(0, np.uint64), np.array([0])) == [bytes(32)]
    for s in (0.05, 0.1, 0.2, 0.3):
        for a, b, both in zip(i.tolist(), j.tolist(), common.tolist(), strict=True):
            assert both < s * (n[a] + n[b] - both) or neardup.may_be_similar(wide[a], wide[b], int(n[a]), int(n[b]), s)
    unlike = [neardup.may_be_similar(wide[a], wide[b], int(n[a]), int(n[b]), 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert sum(unlike) < 0.05 * len(unlike)


def test_fingerprints_equal_brute_force():
    r = np.random.default_rng(2)
    sizes = [0, 1, 2, 254, 255, 256, 700, 0, 3]
    grams = r.integers(0, 1 << 63, sum(sizes)).astype(np.uint64) * np.uint64(2)
    at = np.cumsum([0, *sizes])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in grams[a:z]) > z - a) for a, z in zip(at[:-1], at[1:], strict=True)]
    assert neardup.fingerprints(grams, np.array(sizes)).tolist() == want


def test_large_group_of_near_copies(spark):
    """Copies of one text, each with words of its own changed: pairs are compared, but only few are given out."""
    r = np.random.default_rng(9)
    center = [f"c{k}" for k in range(60)]
    texts = [" ".join(f"x{i}" if k in edits else w for k, w in enumerate(center)) for i in range(250) for edits in [set(r.integers(0, 60, int(r.integers(0, 4))).tolist())]]
    texts += [" ".join(f"y{r.integers(0, 10**6)}" if r.random() < 0.3 else w for w in center) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = groups(texts)
    kept = sorted(x.doc_id for x in neardup.representatives(docs).collect())
    assert kept == sorted({g: k for k, g in reversed(list(enumerate(want)))}.values())


def test_rounds_give_out_few_pairs_and_lose_none():
    """Between two components a task gives out one pair and one that tells of more; the rounds after it reach all others."""
    r = np.random.default_rng(4)
    n = 60
    key, cls, root = np.zeros(n, np.int64), np.arange(1, n + 1), np.where(np.arange(n) < n // 2, 1, 2)
    bits = neardup.bitmaps(np.repeat(np.arange(n), 100), np.tile(base.mix(r.integers(0, 1 << 62, 100).astype(np.uint64)), n), n)
    batch = pa.RecordBatch.from_pydict({"key": key, "cls": cls, "n": np.full(n, 100), "pos": np.zeros(n, np.int64), "root": root, "bits": [b.tobytes() for b in bits]})
    across = {(a, b) for a in range(1, 31) for b in range(31, 61)}
    for most in (1, 8, 64, 4096):
        out = pa.Table.from_batches(neardup._rest_kernel(0.8, most)(iter([batch]))).to_pydict()
        pairs = set(zip(out["a"], out["b"], strict=True))
        assert len(pairs) == len(out["a"]) == min(most + 1, len(across)) and pairs <= across
        assert sum(out["more"]) == (most < len(across))


def test_pairs_that_do_not_hold_hide_none_that_does(spark, monkeypatch):
    """Two groups that meet in many pairs, of which one alone is similar: the last round finds it."""
    plain, rounds = neardup._rest_kernel, []
    monkeypatch.setattr(neardup, "_rest_kernel", lambda similarity, most: rounds.append(most) or plain(similarity, most))
    # bounds that rule nothing out, so that candidates are of all kinds
    monkeypatch.setattr(neardup, "most_common", lambda n, bits, i, j: np.minimum(n[i], n[j]))
    monkeypatch.setattr(neardup, "may_be_similar", lambda *x: True)
    texts = edited()
    r = np.random.default_rng(5)
    center = [f"c{k}" for k in range(80)]
    texts += [" ".join(f"z{r.integers(0, 10**6)}" if r.random() < share else w for w in center) for share in (0.01, 0.03, 0.05, 0.08) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = groups(texts)
    kept = sorted(x.doc_id for x in neardup.representatives(docs).collect())
    assert kept == sorted({g: k for k, g in reversed(list(enumerate(want)))}.values()) and len(rounds) > 1
