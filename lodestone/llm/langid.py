"""Language identification as inference of a mixture of languages.

Letters are lower-cased, all else is white space, and every letter with its neighbours is a trigram, hashed to 2**16 buckets.
A language is a smoothed distribution over buckets. For each document, expectation-maximisation finds the share of
each language in its trigrams. The set of languages is chosen by penalised likelihood: from the best single language, the
one with the largest share joins as long as the log-likelihood gains more than ``penalty`` x log(trigrams). The
prediction is the language with the largest share in the chosen mixture, the score its share.

Training uses about ``per_language`` documents of each language, taken by a hash of their id, and learns the ``languages`` with the
most documents, the first by name on ties: documented bounds.

Null text or no letter: ``und``, score 0; so for every document if nothing was learned. Ties go to the name that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

BUCKETS, PER_LANGUAGE, LANGUAGES, PENALTY, ROUNDS, SMOOTH = 1 << 16, 2000, 200, 4.0, 12, 0.2
NONE = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def trigrams(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count), sorted: the trigrams of each row."""
    texts = [(r or b"").decode("utf-8", "replace").lower() for r in rows]
    code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), "<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    row = np.concatenate(([0], row))  # each text with the space behind it
    ink = _letters()[code]
    at = np.flatnonzero(ink)
    x = np.where(ink, code, 0).astype(np.uint64)
    gram = (x[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[at + 1] * np.uint64(0x165667B19E3779F9))
    bucket = (base.mix(gram) >> np.uint64(48)).astype(np.int64)
    key, count = np.unique(row[at] << 16 | bucket, return_counts=True)
    return key >> 16, key & (BUCKETS - 1), count


def fold(ids: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(ids).cast("string").cast("binary")), F.lit(folds))


def _count_kernel(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        rows, langs = base.byte_rows(batch, "text"), np.array(batch.column("lang").to_pylist(), object)
        for a, b in base.chunks(rows):
            row, bucket, count = trigrams(rows[a:b])
            for lang in set(langs[a:b]):
                own = (langs[a:b] == lang)[row]
                total[lang] = total.get(lang, 0) + np.bincount(bucket[own], count[own], BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp  # logp: buckets x languages


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, smooth: float = SMOOTH, folds: int = 4, held_out: int = 2) -> Model:
    """What goes to the driver is one count per language and bucket."""
    rows = base.columns_only(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(fold("doc_id", folds) != held_out)
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    some = rows.join(F.broadcast(known), "lang")  # at most ``languages`` rows
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(per_language) / F.col("n")) * (1 << 20)).select("text", "lang")
    counts = base.mapped(some, _count_kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts.lang))
    n = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        n[own.bucket.to_numpy(), k] = own.n.to_numpy()
    if not langs:
        return Model([], n)
    # a bucket that no language has is of no weight; one that some language lacks gets a share of what all have
    common = (n.sum(axis=1, keepdims=True) + 1) / (n.sum() + BUCKETS)
    p = (n + smooth * BUCKETS * common) / (n.sum(axis=0) + smooth * BUCKETS)
    return Model(langs, np.log(p))


def _shares(p: np.ndarray, count: np.ndarray, begin: np.ndarray, of: np.ndarray, rounds: int) -> np.ndarray:
    """EM over all rows at once: the share of each language; p holds each trigram's likelihoods, begin each row's first trigram."""
    n = np.add.reduceat(count, begin)[:, None]
    share = np.full((len(begin), p.shape[1]), 1 / p.shape[1], np.float32)
    for _ in range(rounds):
        part = share[of] * p
        part *= (count / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, begin) / n
    return share


def infer(model: Model, rows: list[bytes | None], penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Of each row the language, its share, and the shares of the chosen set."""
    lang, score, sets = [NONE] * len(rows), np.zeros(len(rows)), [{} for _ in rows]
    row, bucket, count = trigrams(rows)
    if not len(row) or not model.langs:
        return lang, score, sets
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(row))))
    logp = model.logp[bucket].astype(np.float32)
    top = logp.max(axis=1, keepdims=True)
    p, count = np.exp(logp - top), count.astype(np.float32)
    single = np.add.reduceat(logp * count[:, None], begin)
    share = _shares(p, count, begin, of, rounds)
    whole = np.add.reduceat((np.log((share[of] * p).sum(axis=1)) + top[:, 0]) * count, begin)
    n = np.add.reduceat(count, begin)
    cost = penalty * np.log(np.maximum(n, 2))
    mixed = whole - single.max(axis=1) > cost
    for k in range(len(begin)):
        chosen = [int(single[k].argmax())]
        own = np.ones(1)
        if mixed[k]:
            a, z = begin[k], begin[k + 1] if k + 1 < len(begin) else len(row)
            best, order = single[k, chosen[0]], np.argsort(-share[k], kind="stable").tolist()
            for more in [x for x in order if x != chosen[0]]:
                new = sorted([*chosen, more])
                s = _shares(p[a:z][:, new], count[a:z], np.zeros(1, np.int64), np.zeros(z - a, np.int64), rounds)[0]
                value = float(((np.log((p[a:z][:, new] * s).sum(axis=1)) + top[a:z, 0]) * count[a:z]).sum())
                if value - best <= cost[k]:
                    break
                chosen, own, best = new, s, value
        sets[row[begin[k]]] = {model.langs[c]: float(x) for c, x in zip(chosen, own, strict=True)}
        at = int(np.argmax(own))
        lang[row[begin[k]]], score[row[begin[k]]] = model.langs[chosen[at]], min(1.0, float(own[at]))
    return lang, score, sets


def _infer_kernel(shared, penalty, rounds):
    def kernel(batches):
        for batch in batches:
            rows, langs, scores = base.byte_rows(batch, "text"), [], []
            for a, b in base.chunks(rows):
                lang, score, _ = infer(shared.value, rows[a:b], penalty, rounds)
                langs += lang
                scores += score.tolist()
            yield batch.drop_columns(["text"]).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    return kernel


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lang_pred, score). The model goes out as a broadcast: 2**16 numbers a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.mapped(base.columns_only(docs, {"doc_id": "long", "text": "string"}), _infer_kernel(shared, penalty, rounds), "doc_id long, lang_pred string, score double")


def confident(docs: DataFrame, model: Model, least: float = 0.4, penalty: float = PENALTY, rounds: int = ROUNDS) -> DataFrame:
    """The documents, all their columns, with a known language of at least that share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        for batch in batches:
            rows, stays = base.byte_rows(batch, "text"), []
            for a, b in base.chunks(rows):
                lang, score, _ = infer(shared.value, rows[a:b], penalty, rounds)
                stays += [x != NONE and s >= least for x, s in zip(lang, score.tolist(), strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return base.mapped(docs, kernel, docs.schema)
