"""Sinks: ranked CSV and JSON by Spark's writers, and a small HTML page of the first rows."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the ranked table and their titles.
COLUMNS = [
    ("rank", "Rank"), ("file", "File"), ("name", "Candidate"), ("email", "Email"), ("phone", "Phone"), ("linkedin", "LinkedIn"), ("github", "GitHub"), ("location", "Location"),
    ("final_score", "Final Score"), ("keyword_score", "Keyword Score"), ("judge_score", "LLM Score"), ("recommendation", "Recommendation"), ("years_experience", "Years Exp"),
    ("education_level", "Education"), ("education_fields", "Fields"), ("seniority", "Seniority"), ("must_have_met", "Must-Have Met"), ("must_have_missing", "Must-Have Missing"),
    ("matched", "Top Matched Skills"), ("missing", "Missing Skills"), ("strengths", "LLM Strengths"), ("gaps", "LLM Gaps"), ("reasoning", "Reasoning"), ("evidence", "Keyword Evidence"),
    ("ocr_used", "OCR Used"), ("parse_status", "Parse Status"), ("warnings", "Warnings"),
]
_JOINED = {"matched": ("; ", 18), "missing": ("; ", 12), "evidence": (" | ", 6), "strengths": (" | ", 0), "gaps": (" | ", 0)}


def _cell(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("array"):
        sep, most = _JOINED.get(name, ("; ", 0))
        return F.array_join(F.slice(c, 1, most) if most else c, sep)
    if name.endswith("_score"):
        return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))
    if kind == "boolean":
        return F.when(c, "yes").otherwise("no")
    return F.coalesce(c.cast("string"), F.lit(""))


def rows(ranked: DataFrame) -> DataFrame:
    """The ranked table as text, under its titles."""
    kinds = dict(ranked.dtypes)
    return ranked.select([(_cell(n, kinds[n]) if n in kinds else F.lit("")).alias(title) for n, title in COLUMNS])


def write_csv(ranked: DataFrame, path: str, top: int = 0) -> None:
    """A folder of CSV files in rank order; with ``top``, those of at most that rank."""
    some = ranked.where(F.col("rank") <= top) if top else ranked
    ordered = some.repartitionByRange("rank").sortWithinPartitions("rank")
    rows(ordered).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def write_csv_file(ranked: DataFrame, path: str, top: int) -> None:
    """One local file with a byte-order mark, of a bounded number of rows."""
    some = rows(ranked.where(F.col("rank") <= top).orderBy("rank")).limit(top).toPandas()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    some.to_csv(path, index=False, encoding="utf-8-sig")


def write_json(ranked: DataFrame, path: str) -> None:
    ranked.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _bar(score: float) -> str:
    pct = min(100.0, max(0.0, score))
    shade = "good" if pct >= 75 else "fair" if pct >= 58 else "poor"
    return f'<div class="{shade}" style="width:{pct:.0f}%">{score:.1f}</div>'


def html_page(ranked: DataFrame, top: int, title: str = "Ranking", total: int | None = None) -> str:
    """The first ``top`` rows as a page without outside resources; every value is escaped."""
    first = ranked.where(F.col("rank") <= top).orderBy("rank").limit(top).collect()
    esc = lambda x: html.escape("" if x is None else str(x))
    body = []
    for r in first:
        d = r.asDict()
        body.append(
            f"<tr><td>{r.rank}</td><td>{esc(d.get('name') or '(unknown)')}<br>{esc(d.get('email') or 'no email')} {esc(d.get('phone') or 'no phone')}<br>{esc(d.get('file'))} {esc(d.get('location'))}</td>"
            f"<td>{_bar(r.final_score)}{esc(d.get('recommendation'))}</td><td>{esc(d.get('years_experience') or 0)}y {esc(d.get('education_level'))}</td>"
            f"<td>{', '.join(map(esc, (d.get('matched') or [])[:10]))}</td><td>{', '.join(map(esc, (d.get('missing') or [])[:6]))}</td><td>{esc(d.get('reasoning'))}</td></tr>"
        )
    style = ".good{background:#8d8}.fair{background:#fd8}.poor{background:#f99}td,th{text-align:left;vertical-align:top;padding:4px}"
    head = "<tr><th>#</th><th>Who</th><th>Score</th><th>Experience</th><th>Matched</th><th>Missing</th><th>Reasoning</th></tr>"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{esc(title)}</title><style>{style}</style></head><body><h1>{esc(title)}</h1><p>{len(first)} of {esc(total if total is not None else len(first))}</p><table>{head}{"".join(body)}</table></body></html>'


def console(ranked: DataFrame, top: int = 10) -> str:
    """The first rows as text, with counts of OCR and problems over all."""
    stats = ranked.agg(F.count("*").alias("n"), F.count_if("ocr_used").alias("ocr"), F.count_if(F.col("parse_status") != "ok").alias("bad")).first()
    lines = [f"{r.rank:>4} {r.final_score:6.2f} {r.recommendation:<13} {r.file}" for r in ranked.where(F.col("rank") <= top).orderBy("rank").limit(top).collect()]
    return "\n".join([*lines, f"{stats.n} documents, {stats.ocr} by OCR, {stats.bad} with problems"])
