"""Packing, media and token stores."""

import array
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import base, encode, media, packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = [
    (3, "The quick, brown fox's don't!! <|endoftext|> É İstanbul ǅ ΑΣ ²½ 中文"), (1, ""), (2, None), (5, "word " * 30_000), (4, "a b c"), (4, "a b c"), (4, "other"), (7, "\x00\x1c\x85 x"), (6, "zq" * 9000), (8, "same " * 4095), (9, "tail. tail, TAIL; tail"),
]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def table(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "2 AS doc", "3 AS part", "4 AS media")


# --- encoding ---------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["don't", "x's,", "a.b.", "ABC!", "é,", "<|endoftext|>", "…", "12,5", "ǅ.", "ﬁ!"])), max_size=8))
def test_encoding_equals_the_library(parts):
    text = " ".join(parts)
    got = encode.encoder(PATH).ids(text.encode("utf-8", "replace"))
    assert np.frombuffer(got, "<u4").tolist() == ids(text.encode("utf-8", "replace").decode())


def test_small_caches_change_nothing(spark):
    rows = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    small = encode.Encoder(PATH, slots=1 << 6, pool=1 << 8)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.many(rows)] == [ids(r.decode()) for r in rows]
    other = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words and np.frombuffer(other.ids(b"a  b"), "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a  b", add_special_tokens=False).ids


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packing(rows, docs):
    want = sorted((i, zlib.crc32(array.array("I", ids(t) + [2]).tobytes()), len(ids(t)) + 1) for i, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    streams = defaultdict(list)
    for i, t in docs:
        streams[i].append(ids(t) + [2])
    assert set(by_doc) == set(streams)
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, streams[i]))
        for p in pieces:
            assert any(len(s) == p.doc_tokens and zlib.crc32(array.array("I", s[p.start : p.start + p.length]).tobytes()) == p.ids_crc32 for s in streams[i])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
    return len(want)


def test_packing(spark):
    rows = packing.pack(table(spark), PATH).collect()
    check_packing(rows, TEXTS)
    rows = packing.pack(table(spark).coalesce(1), PATH, hold=500).collect()
    check_packing(rows, TEXTS)
    assert packing.pack(table(spark).where("false"), PATH).count() == 0


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    windows = len({r.sequence_id for r in rows})
    assert 1 - sum(r.length for r in rows) / (4096 * windows) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4095), min_size=1, max_size=60))
def test_windows_hold_everything_once(sizes):
    found = packing.windows(np.array(sizes))
    assert all(sum(n for *_, n in w) <= 4096 for w in found)
    seen = defaultdict(list)
    for w in found:
        for item, start, n in w:
            seen[item].append((start, n))
    for item, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[item]):
            assert start == at
            at += n
        assert at == size


@pytest.mark.parametrize("seed", range(3))
def test_count_rises_until_nothing_is_over(seed):
    r = np.random.default_rng(seed)
    sizes = np.minimum(4095, r.lognormal(6.3, 0.9, 1500).astype(np.int64) + 1)
    of, k = packing.balanced(sizes)
    assert np.bincount(of, sizes, k).max() <= 4096 and k >= -(-sizes.sum() // 4096)
    whole = packing.windows(sizes, spare=1.0)  # nothing is taken apart
    assert len(whole) == k and sum(map(len, whole)) == len(sizes)
    found = packing.windows(sizes)
    assert 4096 * len(found) / sizes.sum() - 1 < 0.01 and max(sum(n for *_, n in w) for w in found) <= 4096
    pieces = np.bincount([item for w in found for item, *_ in w])
    assert (pieces > 1).sum() < 0.03 * len(sizes)  # few documents are cut
    over = packing.windows(np.full(50, 2049))
    assert len(over) < 50 and all(sum(n for *_, n in w) <= 4096 for w in over) and packing.balanced(np.full(50, 2049))[1] == 50


def test_differencing_balances():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 4000, 500)
    loads = np.bincount(packing.differencing(sizes, 40), sizes, 40)
    assert loads.max() - loads.min() < 0.01 * loads.mean()
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 1, 0, 1], [1, 0, 0, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])
    assert packing.windows(np.zeros(0, np.int64)) == []


# --- media ------------------------------------------------------------------------------------------------------------


def test_media(spark):
    rows = media.digests(table(spark)).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in rows) == sorted((i, len((t or "").encode())) for i, t in TEXTS)
    want = defaultdict(set)
    for i, t in TEXTS:
        body = media.padded((t or "").encode())
        assert len(body) % 192 == 0 and body
        want[i].add((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])))
    for r in rows:
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    same = [(r.media_sha256, r.feature, r.media_bytes) for r in rows if r.doc_id == 4]
    assert len(set(same)) == 2
    assert media.digests(table(spark).where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 16, 192 * 32, 192 * 33, 100_000])
def test_media_round_trip(n):
    body = media.padded(bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8)))
    data = media.mux(body)
    (track,) = media.tracks(data)
    assert media.payload(data, track) == body and (track.codec, track.handler) == ("raw ", "soun")
    keys = media.keyframes(track)
    assert len(keys) == -(-len(body) // (192 * 16)) and all(data[a:z] == body[k * 192 * 16 :][:192] for k, (a, z) in enumerate(keys))


def test_wide_boxes_and_tables():
    free = b"\0\0\0\1free" + (24).to_bytes(8, "big") + b"x" * 8
    data = free + media.mux(b"y" * 384)
    shifted = data.replace(b"stco" + bytes(7) + b"\1", b"stco" + bytes(7) + b"\1")
    assert [b.kind for b in media.walk(shifted)][:3] == [b"free", b"ftyp", b"moov"]
    tail = media.box(b"ftyp", b"isom") + b"\0\0\0\0mdat" + b"z" * 100
    assert [(b.kind, b.end - b.start) for b in media.walk(tail)] == [(b"ftyp", 4), (b"mdat", 100)]
    stz2 = media.full(b"stz2", 0, 0, (4).to_bytes(4, "big"), (3).to_bytes(4, "big"), bytes([0x12, 0x30]))
    boxes = {b.kind: b for b in media.walk(stz2 + media.full(b"stco", 0, 0, (1).to_bytes(4, "big"), (0).to_bytes(4, "big")) + media.full(b"stsc", 0, 0, (1).to_bytes(4, "big"), *(x.to_bytes(4, "big") for x in (1, 3, 1))))}
    data = stz2 + media.full(b"stco", 0, 0, (1).to_bytes(4, "big"), (0).to_bytes(4, "big")) + media.full(b"stsc", 0, 0, (1).to_bytes(4, "big"), *(x.to_bytes(4, "big") for x in (1, 3, 1)))
    starts, sizes, keys = media._samples(data, boxes)
    assert starts.tolist() == [0, 1, 3] and sizes.tolist() == [1, 2, 3] and keys.tolist() == [0, 1, 2]


def test_damaged_media(spark):
    data = media.mux(media.padded(b"q" * 7000))
    for k in range(0, len(data) - 1, 13):
        with pytest.raises(ValueError):
            media.tracks(data[:k])
    df = spark.createDataFrame([(1, bytearray(data), "x"), (2, bytearray(data[:300]), "y"), (3, None, "z"), (4, bytearray(b""), None)], "id int, media binary, error string")
    rows = {r.id: r for r in media.describe(df).collect()}
    assert rows[1].error is None and rows[1].tracks[0].codec == "raw " and rows[1].tracks[0].duration_s == pytest.approx(7104 / 8000)
    assert rows[2].tracks is None and rows[2].error and rows[3].tracks is None and rows[3].error is None and rows[4].error


def test_lying_headers(spark):
    data = media.mux(media.padded(b"q" * 1900))
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    at = data.index(b"stsz")
    cases = [deep, *(data[: at + 12] + n.to_bytes(4, "big") + data[at + 16 :] for n in (1 << 26, (1 << 32) - 1)), data[:at] + b"stz2" + bytes(8) + (10).to_bytes(4, "big") + data[at + 16 :]]
    for case in cases:
        with pytest.raises(ValueError, match="deep|fit|bits"):
            media.tracks(case)
    rows = media.describe(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(cases)], "id int, media binary")).collect()
    assert all(r.tracks is None and r.error for r in rows) and len(rows) == len(cases)


def test_damaged_bytes_never_break_a_job():
    data, r = media.mux(media.padded(b"q" * 1900)), np.random.default_rng(0)
    for _ in range(3000):
        bad = bytearray(data)
        for at in r.integers(0, 700, int(r.integers(1, 6))):
            bad[at] = r.integers(256)
        try:
            for t in media.tracks(bytes(bad)):
                assert all(0 <= a <= z <= len(data) for a, z in media.keyframes(t))
        except ValueError:
            pass


def word(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def fragmented(runs, flags=0x20000, end=b""):
    """A file whose samples are in fragments; and the range of each fragment's first sample."""
    entry = media.full(b"stsd", 0, 0, word(1), media.box(b"raw ", bytes(28)))
    table = media.box(b"stbl", entry, media.full(b"stsc", 0, 0, word(0)), media.full(b"stsz", 0, 0, word(0, 0)), media.full(b"stco", 0, 0, word(0)))
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, 0, word(0, 0, 1000, 0, 0)), media.full(b"hdlr", 0, 0, word(0), b"vide", bytes(13)), media.box(b"minf", table))
    track = media.box(b"trak", media.full(b"tkhd", 0, 7, word(0, 0, 7, 0, 0)), mdia)
    out = media.box(b"ftyp", b"isom") + media.box(b"moov", track, media.box(b"mvex", media.full(b"trex", 0, 0, word(7, 1, 40, 5, 0x10000))))
    keys = []
    for sizes in runs:
        make = lambda shift: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, flags, word(7)), media.full(b"trun", 0, 0x205, word(len(sizes), shift, 0, *sizes))))  # noqa: B023, E731
        at = len(out) + len(make(0)) + 8
        keys.append((at, at + sizes[0]))
        out += make(len(make(0)) + 8) + media.box(b"mdat", bytes(sum(sizes)))
    return out + end, keys


def test_fragments():
    data, keys = fragmented([[3, 4, 5], [9], [2, 2]])
    (track,) = media.tracks(data)
    assert media.keyframes(track) == keys and track.duration == 6 * 40 and track.sizes.tolist() == [3, 4, 5, 9, 2, 2]
    for bad in (data[:-3], data.replace(b"tfhd" + word(0x20000, 7), b"tfhd" + word(0x20000, 8)), data.replace(word(0x205, 3), word(0x205, 1 << 30))):
        with pytest.raises(ValueError):
            media.tracks(bad)


# --- token store ------------------------------------------------------------------------------------------------------


def expected_tokens(docs):
    out, at = [], 0
    for i, t in sorted(docs, key=lambda d: d[0]):
        stream = ids(t) + [1]
        out.append((i, at, len(stream), zlib.crc32(array.array("I", stream).tobytes())))
        at += len(stream)
    return out


def test_store(spark, tmp_path):
    docs = [d for d in TEXTS if d != (4, "other")]
    rows = sorted(map(tuple, tokens.digests(table(spark, docs), PATH).collect()))
    assert rows == sorted(expected_tokens(docs))
    path = str(tmp_path / "store")
    tokens.write(table(spark, docs), path, PATH)
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.restore(spark, path).collect())
    assert got == sorted((i, tuple(ids(t) + [1])) for i, t in docs)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert tokens.digests(table(spark).where("false"), PATH).count() == 0


def test_repeated_ids_share_a_range(spark):
    docs = [(4, "a b c"), (4, "a b c"), (4, "other thing"), (None, "no id"), (5, "z")]
    rows = tokens.digests(table(spark, docs), PATH).collect()
    assert sorted(r.start for r in rows) == list(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1])
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 4, 4, 4, 5]


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    tokens.write(table(spark, [(1, "a b c d"), (2, "e f g")]), path, PATH)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    for what, rows in (("changed", [(r.digest, bytes(r.data[:-1]) + b"\x07") for r in chunks]), ("lost", [(r.digest, bytes(r.data)) for r in chunks[1:]])):
        bad = str(tmp_path / what)
        for part in ("recipes", "manifest"):
            spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
        spark.createDataFrame(rows, "digest binary, data binary").write.parquet(f"{bad}/chunks")
        with pytest.raises(Exception, match="damaged|missing"):
            tokens.read(spark, bad).collect()
    with pytest.raises(ValueError, match="differ"):
        other = str(tmp_path / "other")
        spark.read.parquet(f"{path}/recipes").where("doc_id = 1").write.parquet(f"{other}/recipes")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
        tokens.read(spark, other)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=3000), st.integers(0, 49407))
def test_chunks_cover_a_stream_and_are_local(stream, first):
    a, b = np.array(stream, np.uint32), np.array([first, *stream], np.uint32)
    ends = tokens.cuts(tokens.marks(a).tolist(), 0, len(a))
    assert (ends[-1] if ends else 0) == len(a) and all(0 < y - x <= tokens.MOST for x, y in zip([0, *ends], ends, strict=False))
    assert set(tokens.marks(a) + 1) <= set(tokens.marks(b))


def test_crc_of_parts():
    data = bytes(np.random.default_rng(0).integers(0, 256, 5000, np.uint8))
    for cut in ([], [1], [100, 101, 4999], list(range(7, 4900, 333))):
        edges = [0, *cut, len(data)]
        parts = [data[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        behind = np.array([len(data) - y for y in edges[1:]])
        shifted = tokens.crc_shifted(np.array([zlib.crc32(p) for p in parts]), behind)
        assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(data)


def test_merkle():
    a, b, c = (tokens.digest(x) for x in (b"a", b"b", b"c"))
    assert len({tokens.merkle(x) for x in ([], [a], [a, b], [b, a], [a, b, c], [a, b, c, c])}) == 6


def test_slices_keep_every_row(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 10, None, "y" * 5_000_000, "", *["z" * 1000] * 5000]})
    parts = list(base.slices(iter([batch])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 4
