"""Hashes of words and stretches, scratch tables, and session settings."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import base, encode, substring


def thue_morse(n):
    """Two words of n bytes whose difference cancels out in polynomials modulo a power of two."""
    turn = [bin(k).count("1") & 1 for k in range(n)]
    return bytes(97 + t for t in turn), bytes(98 - t for t in turn)


def hashes(rows):
    buf, s, e, _ = base.word_spans(rows)
    return base.word_hashes(buf, s, e).tolist()


@pytest.mark.parametrize("n", [64, 512, 1024, 4096, 1 << 16])
def test_structured_words_differ(n):
    assert len(set(hashes(thue_morse(n)))) == 2


@pytest.mark.parametrize("n", [512, 1024, 4096])
@pytest.mark.parametrize("which", [0, 1])
def test_structured_stretches_differ(n, which):
    a, b = (np.frombuffer(x, np.uint8).astype(np.uint64) for x in thue_morse(n))
    for f in (lambda x: x, base.mix, lambda x: x << np.uint64(55)):
        assert len({int(base.Sequence(f(x)).span(np.array([0]), np.array([n]), which)[0]) for x in (a, b)}) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12))
def test_equal_words_have_equal_hashes(rows):
    words = [w for r in rows for w in r.split()]
    got = hashes(rows)
    assert len(got) == len(words) and len(set(got)) == len(set(words))
    assert all(h == hashes([w])[0] for w, h in zip(words, got, strict=True))
    buf, s, e, _ = base.word_spans(rows)
    if len(s):
        order = np.arange(len(s))[::-1]
        assert base.same_words(buf, s, e, buf, s[order], e[order]).tolist() == [a == b for a, b in zip(words, words[::-1], strict=True)]


@pytest.mark.parametrize("which", [0, 1])
def test_stretches_are_polynomials(which):
    x = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seq, b = base.Sequence(x), base._BASES[which]
    for a, z in ((0, 1), (0, 300), (17, 90), (299, 300), (5, 5)):
        want = sum(int(v) * pow(b, k, base.PRIME) for k, v in enumerate(x[a:z])) % base.PRIME
        assert seq.span(np.array([a]), np.array([z]), which)[0] == base.mix(np.array([want], np.uint64))[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, base.PRIME - 1), st.integers(0, base.PRIME - 1))
def test_products(a, b):
    assert int(base.times(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == a * b % base.PRIME


def test_ids_of_structured_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    a, b = thue_morse(4096)
    enc = encode.Encoder(path)
    for rows in ([a], [b], [a + b" " + b], [b, a]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.many(rows)] == [library.encode(r.decode(), add_special_tokens=False).ids for r in rows]


def test_bytes_decide_where_hashes_collide(monkeypatch):
    """Words of up to eight bytes and one length never collide; here all longer ones of a length do."""
    plain = base.word_hashes
    monkeypatch.setattr(base, "word_hashes", lambda buf, s, e: np.where(e - s <= 8, plain(buf, s, e), (e - s).astype(np.uint64)))
    path = public_tokenizers.path("word_bpe_49k.json")
    library, enc = Tokenizer.from_file(path), encode.Encoder(path)
    for row in (b"abcdefghij", b"zyxwvutsrq", b"other words; some more", b"abcdefgh bcdefghi", b"abcdefghij zyxwvutsrq abcdefghij"):
        assert np.frombuffer(enc.ids(row), "<u4").tolist() == library.encode(row.decode(), add_special_tokens=False).ids


def test_substrings_of_structured_words(spark):
    a, b = (x.decode() for x in thue_morse(1024))
    tail = " ".join(f"w{k}" for k in range(49))
    rows = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digests(rows).collect()} == {1: 0, 2: 0, 3: 50}


def test_settings_of_the_session_stay(spark):
    before = spark.conf.get(base.BATCH_ROWS, None)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    table = base.written(base.mapped(docs, lambda batches: batches, docs.schema), "rows")
    assert spark.conf.get(base.BATCH_ROWS, None) == before and table.count() == 1
    base.dropped(spark, table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(table._scratch).collect()


def test_tables_in_a_local_folder_start_few_processes(spark):
    """Each of a file's own checksums is one more file, with a process that sets its permissions and counts as much memory as the executor."""
    table = base.written(spark.range(0, 100, 1, 5).toDF("id"), "few")
    path, files = base.folder(spark, table._scratch)
    raw = spark.sparkContext._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
    raw.initialize(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in raw.listStatus(path)]
    assert table.count() == 100 and sum(n.endswith(".parquet") for n in names) == 5 and not [n for n in names if n.endswith(".crc")]
    base.dropped(spark, table)


def test_repeats_writes_each_table_once(spark, monkeypatch):
    """Whether a symbol stands in several stretches is known from the first pass over them; it took three more tables and a join."""
    tables = []
    monkeypatch.setattr(base, "written", lambda df, name, *a, f=base.written: (tables.append(name), f(df, name, *a))[1])
    same, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = spark.createDataFrame([(1, same), (2, same), (3, f"{same} {other}"), (4, other)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digests(rows).collect()} == {1: 0, 2: 60, 3: 60, 4: 60}
    assert sorted(tables) == ["first", "judged", "keys", "least", "shared", "stretches", "windows"]


def test_plain_words_go_to_the_model(monkeypatch):
    """Normalising and splitting what is plain already took two fifths of the time of new words; the ids are the library's own."""
    enc = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plain words, and-more (of them) 'tis it's don't ''' !!! end.", "été, naïve; İ K x1 12 a.b <", "<|endoftext|> ABC Def <|x abc,", "", "a", "?!", "你好, ́e fiﬁ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.many([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    other = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    other.tokenizer = None  # plain words don't ask it
    assert other.many([b"Plain words, only!"])[0] == enc.many([b"plain words, only!"])[0]
