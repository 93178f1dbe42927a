import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """fps: (id, fingerprint); the smallest id reachable over links of three bits."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(fps))]


def texts():
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 5000, 900)]
    docs = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1 :])) for i, k in enumerate(r.integers(0, 900, 25).tolist())]
    docs += [(100 + i, " ".join(f"v{x}" for x in r.integers(0, 5000, 60))) for i in range(40)]
    docs += [(200, ""), (201, None), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "One\tTwo"), (207, "One two three"), (208, "É é"), (209, "é é"), (3, "again with an id"), (3, "again with an id"), (None, docs[0][1]), (None, "quite alone")]
    return docs


@pytest.mark.parametrize("limit", [4096, 2])
def test_equals_brute_force(spark, limit):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "'x' AS rep", "2 AS component_id")
    found = simhash.shown(simhash.near_duplicates(df, limit=limit)).collect()
    fps = [(i, fingerprint(t)) for i, t in docs]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, components(fps), strict=True)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 7919}" for k in range(200_000))
    assert simhash.fingerprint(long.encode()) == fingerprint(long)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_of_random_fingerprints(spark, limit):
    r = np.random.default_rng(1)
    center = int(r.integers(0, 1 << 63))
    fps = sorted({center ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 6)), replace=False)) for _ in range(300)} | {int(x) for x in r.integers(0, 1 << 63, 100)})
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    known = {x.node: x.component for x in simhash.components(simhash.links(df, limit=limit)).collect()}
    want = components([(k, f % (1 << 64)) for k, f in enumerate(signed)])
    assert [known.get(f, f) for f in signed] == [signed[k] for k in want]


def test_golay_code():
    v = np.arange(1 << 23, dtype=np.int64)[::97]
    index = simhash.codeword(v)
    words = np.array([m << 11 | simhash._remainder(m << 11) for m in range(4096)])
    assert (np.bitwise_count(words[index] ^ v) <= 3).all()
    assert min(int(w).bit_count() for w in words[1:]) == 7


@pytest.mark.parametrize("keys", [simhash.golay_keys, simhash.nibble_keys])
def test_keys_of_linked_fingerprints_meet(keys):
    r = np.random.default_rng(2)
    for _ in range(60):
        a = int(r.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in r.choice(64, 3, replace=False))
        of, key, role = keys(np.array([a, b], np.uint64))
        left = {int(k) for k, o, x in zip(key, of, role, strict=True) if o == 0 and x & 1}
        right = {int(k) for k, o, x in zip(key, of, role, strict=True) if o == 1 and x & 2}
        assert left & right


def test_quarters_of_a_key():
    import pyarrow as pa

    r = np.random.default_rng(4)
    for _ in range(60):
        a = int(r.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in r.choice(64, 3, replace=False))
        rows = pa.RecordBatch.from_arrays([pa.array([9, 9]), pa.array(np.array([a, b], np.uint64).view(np.int64)), pa.array([1, 2], pa.int8())], ["key", "fp", "role"])
        again = [x for batch in simhash._quarter_kernel([rows]) for x in batch.to_pylist()]
        keys = [{x["key"] for x in again if x["role"] == role} for role in (1, 2)]
        assert keys[0] & keys[1] and len(again) == 8


def test_large_keys_go_through_all_levels(spark):
    """A crowd of fingerprints within a few bits of one: over any limit under Golay keys and under their quarters."""
    r = np.random.default_rng(6)
    center = int(r.integers(0, 1 << 62))
    fps = sorted({center ^ sum(1 << int(b) for b in r.choice(62, int(r.integers(0, 4)), replace=False)) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = components([(k, f) for k, f in enumerate(fps)])
    for limit in (2, 8, 50):
        known = {x.node: x.component for x in simhash.components(simhash.links(df, limit=limit)).collect()}
        assert [known.get(f, f) for f in fps] == [fps[k] for k in want]


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in simhash.components(edges).collect()} == {1}
    assert simhash.components(edges.where("a < 0")).count() == 0


def test_representatives(spark):
    df = spark.createDataFrame([(2, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 2), (9, "something else entirely here", 3)], "doc_id long, text string, rank_ int")
    rows = simhash.representatives(df)
    assert rows.columns == df.columns and sorted(map(tuple, rows.collect())) == [(1, "a b c d", 2), (9, "something else entirely here", 3)]
