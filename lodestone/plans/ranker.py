"""The whole plan: documents, contacts, rubric, chunks, judge, blend, duplicates and rank.

What is costly is written once and read as often as it is needed: the rows without a judge, its replies, and the order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import contacts, scoring, timeline
from ..functions.text import strip, text_of, word_count
from ..operators import judge as judges
from ..operators import matching, ranking, sections
from ..operators.rubric import Rubric
from ..session import written

#: Documents come with these; what is absent gets a default.
DEFAULTS = {"file": ("doc_id", "string"), "path": ("file", "string"), "pages": (None, "int"), "ocr_used": (False, "boolean"), "cached": (False, "boolean"), "error": (None, "string"), "sha1": (None, "string"), "input_pos": ("doc_id", "long")}


def documents(docs: DataFrame) -> DataFrame:
    """The columns of an extracted document; the hash is that of the text if none is known."""
    for name, (default, kind) in DEFAULTS.items():
        if name not in docs.columns:
            value = F.sha1(text_of(F.col("text"))) if name == "sha1" else F.col(default) if isinstance(default, str) else F.lit(default)
            docs = docs.withColumn(name, value.cast(kind))
    return docs


def status(text: Column, error: Column) -> Column:
    return F.when(strip(text_of(text)) == "", "empty").when(error.isNotNull(), "error").otherwise("ok")


def parsed(docs: DataFrame, rubric: Rubric, cfg: Config = Config(), names: list[str] = contacts.GIVEN_NAMES) -> DataFrame:
    """All that needs no judge, computed where a document lies: nothing is shuffled. Blank texts keep their row, with a score of zero."""
    out = contacts.with_contacts(documents(docs), "text", "file", names)
    out = sections.with_chunks(out, rubric.keywords(), cfg.chunk)
    out = matching.coverage(out, rubric)
    out = out.withColumn("evidence", matching.evidence(text_of(F.col("text")), F.col("hits"), F.col("categories"))).drop("hits")
    blank = strip(text_of(F.col("text"))) == ""
    work = timeline.work_text(F.col("text"), F.col("sections"))
    fields = timeline.education_fields(F.col("text"))
    none = F.array().cast("array<string>")
    out = out.withColumn("years_experience", timeline.years(work, cfg.as_of_year)).withColumn("education_level", timeline.education_level(F.col("text"))).withColumn("fields", fields)
    out = out.withColumn("education_fields", F.slice("fields", 1, 4)).withColumn("field_relevant", timeline.relevant(F.col("fields"), rubric.fields))
    out = out.withColumn("must_have_met", matching.must_haves(F.col("categories"), True)).withColumn("must_have_missing", F.when(blank, none).otherwise(matching.must_haves(F.col("categories"), False)))
    out = out.withColumn("matched", matching.skills(F.col("categories"), "matched")).withColumn("missing", F.when(blank, none).otherwise(matching.skills(F.col("categories"), "missing")))
    out = out.withColumn("category_scores", matching.points_map(F.col("categories"))).withColumn("word_count", word_count(F.col("text")))
    keyword = scoring.calibrated(scoring.rounded(F.col("base")), F.col("years_experience"), F.size("must_have_missing"), F.col("education_level"), F.col("field_relevant"), cfg.score)
    out = out.withColumn("keyword_exact", keyword).withColumn("keyword_score", scoring.rounded(F.col("keyword_exact"))).withColumn("notes", scoring.notes(F.col("years_experience"), F.col("must_have_missing"), F.col("education_level"), F.col("field_relevant"), cfg.score))
    warnings = F.concat(
        F.array_compact(F.array(F.when(F.col("error").isNotNull(), F.concat(F.lit("extract:"), "error")), F.when(blank, F.lit("no-text-extracted")))),
        F.when(blank, none).otherwise(F.col("contact_warnings")),
        F.when(~blank & F.col("contact.email_is_placeholder"), F.array(F.lit("placeholder-email(template)"))).otherwise(none),
        F.when(~blank & F.col("truncated"), F.array(F.format_string("long-resume:%dchunks->%dsent", "n_chunks", F.size("chunks")))).otherwise(none),
    )
    return out.withColumn("warnings", warnings).withColumn("blank", blank).withColumn("parse_status", status(F.col("text"), F.col("error"))).drop("fields", "contact_warnings")


def blended(out: DataFrame, judged: DataFrame | None, cfg: Config = Config(), key: str = "doc_id") -> DataFrame:
    """Scores with the judge's opinion where there is one; ``judged`` has (key, judge, calls, seconds)."""
    if judged is None:
        empty = "struct<score:double,confidence:double,years_relevant:double,seniority:string,strengths:array<string>,gaps:array<string>,reasoning:string,recommendation:string,error:string>"
        out = out.withColumn("judge", F.lit(None).cast(empty)).withColumn("calls", F.lit(0)).withColumn("seconds", F.lit(0.0))
    else:
        out = out.join(judged, key, "left")
    j, s = "judge.score", cfg.score
    own = F.col("years_experience")
    final = scoring.rounded(scoring.blended(F.col("keyword_exact"), F.col(j), s))
    shown = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    more = F.array_compact(
        F.array(
            F.when(scoring.years_disagree(own, F.col("judge.years_relevant"), s), F.format_string("years-disagreement(det %s vs llm %s)", shown(own), shown(F.col("judge.years_relevant")))),
            F.when(F.col("judge.error").isNotNull(), F.concat(F.lit("llm:"), F.left("judge.error", F.lit(80)))).when(scoring.disagree(F.col(j), F.col("keyword_exact"), s), F.format_string("scorer-disagreement(det %.0f vs llm %.0f)", "keyword_exact", j)),
        )
    )
    bits = F.concat(
        F.array_compact(F.array(F.when(F.size("must_have_met") > 0, F.concat(F.lit("Meets: "), F.array_join("must_have_met", ", "))), F.when(F.size("must_have_missing") > 0, F.concat(F.lit("Missing: "), F.array_join("must_have_missing", ", "))))),
        F.col("notes"), F.array_compact(F.array(F.when(F.col(j).isNotNull() & (F.col("judge.reasoning") != ""), F.col("judge.reasoning")))),
    )
    return (
        out.withColumn("warnings", F.concat("warnings", more)).withColumn("reasoning", F.array_join(bits, " | ")).withColumn("final_score", final).withColumn("blend", scoring.blend_name(F.col("keyword_exact"), F.col(j), s))
        .withColumn("recommendation", scoring.tier(F.col("final_score"), s)).withColumn("parse_status", F.when(F.col("judge.error").isNotNull(), "llm-failed").otherwise(F.col("parse_status")))
        .withColumn("years_experience", scoring.years_or(own, F.col("judge.years_relevant"))).withColumn("judge_score", scoring.rounded(F.col(j)))
        .withColumn("seniority", F.coalesce("judge.seniority", F.lit(""))).withColumn("strengths", F.col("judge.strengths")).withColumn("gaps", F.col("judge.gaps"))
    )


def rank(docs: DataFrame, rubric: Rubric, role: str = "", cfg: Config = Config(), ask: judges.Judge | None = None, names: list[str] = contacts.GIVEN_NAMES, key: str = "doc_id", health: Callable[[], str] | None = None) -> DataFrame:
    """Every document with its fields, scores, warnings and rank.

    ``health`` is asked once before: without a reachable judge documents are ranked by keywords alone, without its model nothing is.
    """
    ask = judges.routed(ask, health)
    # a number of its own tells rows of one key apart; it is that of the written row, so all that reads it agrees
    row = next(c for c in ("row_", "row__", "row___") if c not in docs.columns)
    base = written(parsed(docs, rubric, cfg, names).drop("text", "sections").withColumn(row, F.monotonically_increasing_id()), "parsed")
    judged = None
    if ask:
        asked = base.where(~F.col("blank") & F.col("error").isNull()).select(row, "chunks", "matched", "missing")
        judged = written(judges.judge(asked, row, rubric, role, ask, cfg.judge, cfg.chunk.single_pass), "judged")
    out = blended(base, judged, cfg, row)
    order = [F.desc("final_score"), F.desc("keyword_score"), F.asc("file"), F.asc("input_pos")]
    ranks = ranking.ranked(out.select(row, "final_score", "keyword_score", "file", "input_pos"), *order, F.asc(row)).select(row, "rank")
    out = ranking.first_seen(out, "sha1", "input_pos", "file", base)
    out = out.withColumn("warnings", F.when(F.col("duplicate_of").isNotNull(), F.array_append("warnings", F.concat(F.lit("duplicate-of:"), "duplicate_of"))).otherwise(F.col("warnings")))
    out = out.select("*", "contact.*").drop("contact", "judge", "categories", "blank")
    return out.join(ranks, row).drop(row)
