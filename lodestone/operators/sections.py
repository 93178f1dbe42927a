"""Sections, chunks and their ranking, within a row: no document leaves its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.scoring import density
from ..functions.text import clean_lines, let, pieces, section_of, squash, strip, text_of


def sections(text: Column, lines: Column | None = None) -> Column:
    """Array of (section, body): what stands under each heading; before the first it is the header; empty ones are left out."""

    def split(ls: Column) -> Column:
        marks = F.filter(F.transform(ls, lambda l, i: F.struct((i + 1).alias("at"), section_of(l).alias("section"))), lambda m: m["section"].isNotNull() & (m["section"] != "other"))

        def cut(ms: Column) -> Column:
            heads = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("header").alias("section"))), ms)
            ends = F.concat(ms["at"], F.array(F.size(ls) + 1))
            both = F.arrays_zip(heads.alias("h"), ends.alias("end"))
            return F.transform(both, lambda x: F.struct(x["h"]["section"].alias("section"), F.array_join(F.slice(ls, x["h"]["at"] + 1, F.greatest(x["end"] - x["h"]["at"] - 1, F.lit(0))), "\n").alias("body")))

        return F.filter(let(marks, cut), lambda s: s["body"] != "")

    return let(clean_lines(text) if lines is None else lines, split)


def with_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_lines", clean_lines(F.col(text))).withColumn("sections", sections(F.col(text), F.col("_lines"))).drop("_lines")


def chunks(parts: Column, text: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """Array of (index, section, text); if all are too short, windows of the whole text, of any length."""
    found = F.flatten(F.transform(parts, lambda s: F.transform(pieces(s["body"], cfg.size, cfg.overlap), lambda p: F.struct(s["section"].alias("section"), strip(p).alias("text")))))
    found = F.filter(found, lambda c: F.length(c["text"]) >= cfg.least)
    raw = F.transform(pieces(strip(text_of(text)), cfg.size, cfg.overlap), lambda p: F.struct(F.lit("body").alias("section"), p.alias("text")))
    return F.transform(let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(raw)), lambda c, i: F.struct(i.alias("index"), c["section"].alias("section"), c["text"].alias("text")))


def ranked_chunks(every: Column, keywords: list[str], cfg: ChunkConfig = ChunkConfig()) -> Column:
    """Chunks with hits and relevance."""
    known = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")

    def judged(c):
        hits = let(squash(c["text"]), lambda sq: F.size(F.filter(known, lambda k: F.contains(sq, k))))
        return F.struct(c["index"].alias("index"), c["section"].alias("section"), c["text"].alias("text"), hits.alias("keyword_hits"))

    return F.transform(F.transform(every, judged), lambda c: F.struct(*[c[n].alias(n) for n in ("index", "section", "text", "keyword_hits")], density(c["keyword_hits"], F.length(c["text"]), c["section"]).alias("rel_score")))


def kept_chunks(ranked: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """The most relevant, the first of equals, in reading order."""
    best = F.slice(F.sort_array(F.transform(ranked, lambda c: F.struct((-c["rel_score"]).alias("r"), c["index"].alias("index")))), 1, cfg.keep)
    return let(F.transform(best, lambda b: b["index"]), lambda chosen: F.filter(ranked, lambda c: F.array_contains(chosen, c["index"])))


def with_chunks(docs: DataFrame, keywords: list[str], cfg: ChunkConfig = ChunkConfig(), text: str = "text") -> DataFrame:
    """``docs`` with sections, n_chunks, the kept chunks, and whether some were left out."""
    out = docs if "sections" in docs.columns else with_sections(docs, text)
    out = out.withColumn("_all", chunks(F.col("sections"), F.col(text), cfg)).withColumn("_ranked", ranked_chunks(F.col("_all"), keywords, cfg))
    out = out.withColumn("n_chunks", F.size("_all")).withColumn("chunks", kept_chunks(F.col("_ranked"), cfg))
    return out.withColumn("truncated", F.size("chunks") < F.col("n_chunks")).drop("_all", "_ranked")


def running_sections(lines: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """For a table of lines: the heading each stands under and the number of its run; headings are null where there is none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("header"))).withColumn("run_id", F.count(heading).over(w))
