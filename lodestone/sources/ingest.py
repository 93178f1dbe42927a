"""Documents from files, with an injectable extractor and a content-hash cache."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cleanup
from ..operators.ranking import cache_misses, ranked, top
from ..session import importable
from . import ocr

#: bytes -> page texts; raises for a file that can't be opened, PermissionError for an encrypted one.
Extractor = Callable[[bytes], list[tuple[str, bool]]]


def discover(spark: SparkSession, folder: str, glob: str = "*.pdf", limit: int = 0) -> DataFrame:
    """Files below a folder with their SHA-1, numbered by length and then letters of their stem; ``limit`` takes the first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    # numbering looks at names only; contents stay where they are and are read after the limit
    names, order = named.select("path", "stem"), (F.length("stem").asc(), F.asc("stem"), F.asc("path"))
    names = top(names, limit, *order) if limit else ranked(names, *order)
    return named.join(names.select("path", F.col("rank").cast("int").alias("input_pos")), "path").select("file", "path", "input_pos", F.sha1("content").alias("sha1"), "content")


def plain_text(content: bytes) -> list[tuple[str, bool]]:
    """An extractor for text files: a form feed ends a page; no page needs OCR."""
    return [(page, False) for page in content.decode("utf-8", "replace").split("\f")]


def pdf_text(content: bytes, read: ocr.Reader | None = None, least: int = 120, memory_gb: float = 8.0, always: bool = False) -> list[tuple[str, bool]]:
    """An extractor for PDFs, where the library is installed: a page's text layer, or OCR where it is sparse (or ``always``).

    ``read`` turns a page's image into text; by default the first OCR library that is installed. Without any, a sparse page is empty.
    """
    import pymupdf

    read = read or ocr.reader()
    pages = []
    with pymupdf.open(stream=content, filetype="pdf") as doc:
        if doc.needs_pass:
            raise PermissionError("encrypted")
        for page in doc:
            try:
                text = "" if always else page.get_text()
                if not always and sum(map(str.isalpha, text)) >= least:
                    pages.append((text, False))
                elif read is None:
                    pages.append(("", False))
                else:
                    dpi = ocr.render_dpi(max(page.rect.width, page.rect.height), ocr.render_side(memory_gb))
                    pages.append((read(page.get_pixmap(dpi=dpi).tobytes("png")), True))
            except Exception:  # a bad page is an empty page
                pages.append(("", False))
    return pages


def extracted(files: DataFrame, extractor: Extractor = plain_text) -> DataFrame:
    """Files as documents; what goes wrong with one is in its ``error``."""

    def run(batches):
        for rows in batches:
            out = []
            for content in rows.content:
                try:
                    pages = extractor(bytes(content))
                    out.append((len(pages), "\n".join(t for t, _ in pages), any(o for _, o in pages), None))
                except Exception as e:
                    out.append((0, "", False, str(e) or type(e).__name__))
            pages, texts, ocr, errors = zip(*out, strict=True) if out else ((), (), (), ())
            yield rows[["file", "path", "input_pos", "sha1"]].assign(pages=pd.array(pages, "Int32"), text=list(texts), ocr_used=list(ocr), error=list(errors))

    importable(files.sparkSession)
    rows = files.select("file", "path", "input_pos", "sha1", "content").mapInPandas(run, "file string, path string, input_pos int, sha1 string, pages int, text string, ocr_used boolean, error string")
    return rows.withColumn("text", cleanup(F.col("text"))).withColumn("cached", F.lit(False))


CACHE_SCHEMA = "sha1 string, file string, path string, pages int, text string, ocr_used boolean, error string"


def with_cache(files: DataFrame, cache: DataFrame, extractor: Extractor = plain_text) -> DataFrame:
    """Documents, cached ones taken from the cache under their present name, others extracted."""
    known = cache.where(F.coalesce("text", F.lit("")) != "").select("sha1", "pages", "text", "ocr_used", "error", F.col("path").alias("stored")).dropDuplicates(["sha1"])
    hit = files.drop("content").join(known, "sha1").withColumn("path", F.coalesce("stored", "path")).drop("stored").withColumn("cached", F.lit(True))
    return hit.unionByName(extracted(cache_misses(files, cache), extractor))


def to_cache(docs: DataFrame, path: str) -> None:
    """Appends what was extracted anew and has a text."""
    new = docs.where(~F.col("cached") & (F.coalesce("text", F.lit("")) != "")).dropDuplicates(["sha1"])
    new.select("sha1", "file", "path", "pages", "text", "ocr_used", "error").write.mode("append").parquet(path)


def audit(docs: DataFrame, least: int = 200) -> DataFrame:
    """Of each document its letters, words and kind: text, scan or empty. ``pages`` and ``images`` count as 1 and 0 where absent."""
    from ..functions.text import letters, strip, word_count

    pages = F.col("pages") if "pages" in docs.columns else F.lit(1)
    images = F.col("images") if "images" in docs.columns else F.lit(0)
    alpha = letters(F.col("text"))
    kind = F.when((strip(F.coalesce("text", F.lit(""))) == "") & (images == 0), "empty").when(alpha >= least * F.greatest(F.lit(1), pages), "text").otherwise("scan")
    return docs.withColumn("n_text", F.length(F.coalesce("text", F.lit("")))).withColumn("words", word_count(F.col("text"))).withColumn("alpha", alpha).withColumn("kind", kind)
