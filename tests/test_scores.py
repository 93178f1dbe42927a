import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.config import ScoreConfig
from lodestone.functions import scoring, timeline
from lodestone.operators import matching, ranking, sections
from lodestone.operators.rubric import Rubric
from lodestone.session import spread

TINY = Rubric(
    {
        "categories": [
            {"name": "A", "weight": 60, "must_have": True, "skills": [{"name": "alpha tool", "aliases": ["alpha tool", "AlphaTool"]}, {"name": "zq", "aliases": ["zq"]}]},
            {"name": "B", "weight": 40, "skills": [{"name": "beta", "aliases": ["betagamma"]}]},
        ]
    }
)


def scores(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in matching.coverage(docs, TINY).orderBy("doc_id").collect()]


def test_coverage(spark):
    a, b, none, empty = scores(spark, "Alpha-Tool expert", "beta gamma", "nothing", None)
    assert a.base == pytest.approx(60 * (1 - math.exp(-1.5)))
    assert b.base == pytest.approx(40 * (1 - math.exp(-3)))
    assert none.base == 0 and empty.base == 0
    assert a.categories[0].matched == ["alpha tool"] and a.categories[0].missing == ["zq"]


def test_short_aliases_are_words(spark):
    hit = [bool(r.hits) for r in scores(spark, "two zqs here", "bezque", "ZQ&X", "zq", "azq", "zqes.")]
    assert hit == [True, False, True, True, False, True]


def test_words_and_patterns_agree(spark):
    """Short aliases as members of the set of words, against their patterns."""
    rubric = Rubric({"categories": [{"name": "c", "skills": ["le", "R", "C++", "c#", ".net", "VaR", "aé", "x1", "K"]}]})
    texts = ["les LES lees le", "r&d R.", "C++ and c#", "a .NET shop", "var vars vares varss", "aé AÉ", "x1 X1s ax1", "\u212a and k\u00e9", "Kk", "", None, "one-le\nles"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.matched_alias) for r in matching.alias_hits(docs, rubric).collect()}
    plain = lambda a: re.compile(rf"(?<![A-Za-z0-9]){re.escape(a)}(?:s|es)?(?![A-Za-z0-9])", re.I | re.A)
    assert got == {(k, a.alias) for k, t in enumerate(texts) for a in rubric.aliases if a.short and plain(a.alias).search(t or "")}


def test_small_inputs_are_dealt_out(spark):
    df = spark.range(100, numPartitions=1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df, per_core=1).rdd.getNumPartitions() == 1
    assert sorted(r.id for r in spread(df).collect()) == list(range(100))


def test_common_short_aliases_do_not_fire_inside_words(spark):
    rubric = Rubric({"categories": [{"name": "c", "skills": ["R", "CTE", "ARCH", "dash", "VaR", "SQL", "git"]}]})
    docs = spark.createDataFrame([(1, "impacted architecture searches dashboard variable digital nosqlish error")], "doc_id long, text string")
    assert matching.alias_hits(docs, rubric).count() == 0
    docs = spark.createDataFrame([(1, "R&D, a CTE; VaR")], "doc_id long, text string")
    assert {r.skill for r in matching.alias_hits(docs, rubric).collect()} == {"R", "CTE", "VaR"}


def test_longest_alias_wins_then_the_first(spark):
    rubric = Rubric({"categories": [{"name": "c", "skills": [{"name": "s", "aliases": ["abc", "abcde", "edcba", "abcdefg"]}]}]})
    docs = spark.createDataFrame([(1, "abc abcde edcba"), (2, "abcdefg"), (3, "abc")], "doc_id long, text string")
    assert [r.matched_alias for r in matching.best_hits(docs, rubric).orderBy("doc_id").collect()] == ["abcde", "abcdefg", "abc"]


def test_adding_an_alias_never_lowers_the_score(spark):
    one, two = scores(spark, "alpha tool", "alpha tool zq")
    assert two.base > one.base


def test_bare_skills_and_synonyms():
    rubric = Rubric({"synonyms": {"x": ["yy"]}, "categories": [{"name": "c", "skills": ["x", {"name": "--", "aliases": []}]}]})
    assert [(a.alias, a.alias_pos) for a in rubric.aliases] == [("x", 0), ("x", 1), ("yy", 2)]
    assert rubric.categories[0][1] == 1.0


def test_blend_and_tiers(spark):
    cases = [(40.0, 80.0, 0.4, 0.6, 64.0, "moderate_fit"), (75.0, None, 0.4, 0.6, 75.0, "strong_fit"), (50.0, 90.0, 1.0, 0.0, 50.0, "weak_fit"), (50.0, 90.0, 0.0, 1.0, 90.0, "strong_fit")]
    for keyword, judge, wk, wj, want, tier in cases:
        cfg = ScoreConfig(weight_keyword=wk, weight_judge=wj)
        row = spark.range(1).select(scoring.blended(F.lit(keyword), F.lit(judge).cast("double"), cfg).alias("s")).select("s", scoring.tier(F.col("s")).alias("t")).first()
        assert row.s == pytest.approx(want) and row.t == tier


def test_rounding_is_by_the_binary_value(spark):
    r = random.Random(7)
    cases = [0.125, 0.375, 1.115, 2.675, 1.005, 0.285, 0.005, 0.015, 99.995, 100.0, 0.0, 64.5, 57.995, 12.345, 0.045, 1e-9, 33.335, 5e-3]
    cases += [k / 8 for k in range(0, 801, 7)] + [k / 1000 for k in range(5, 100_000, 977)] + [r.uniform(0, 100) for _ in range(300)] + [r.randrange(100_000) / 1000 for _ in range(300)]
    rows = spark.createDataFrame([(float(x),) for x in cases], "x double").select("x", scoring.rounded(F.col("x")).alias("two"), scoring.rounded(F.col("x"), 1).alias("one")).collect()
    assert [(q.x, q.two, q.one) for q in rows if (q.two, q.one) != (round(q.x, 2), round(q.x, 1))] == []


def test_clamp_keeps_null(spark):
    assert spark.range(1).select(scoring.rounded(F.lit(None).cast("double")).alias("x")).first().x is None

    assert spark.range(1).select(scoring.clamp(F.lit(None).cast("double")).alias("x")).first().x is None


def test_calibration(spark):
    row = spark.range(1).select(scoring.calibrated(F.lit(40.0), F.lit(10.0), F.lit(1), F.lit("Masters"), F.lit(False)).alias("x")).first()
    assert row.x == pytest.approx(40 * 1.7 + 8 * 1.2 - 6 - 5)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x 2010-2012 y 2013-2015", 5), ("x 2010 - 2012, 2014 to 2015", 3), ("2019 – present", 5), ("7+ years of experience", 7), ("Bachelor thing 2006-2010", 0),
        ("1950 - 2010", 45), ("2015-2010", 0), ("3 years", 3), ("2015 years", 15), ("", 0), (None, 0), ("until 2001 until 2003 now", 2),
    ],
)
def test_years(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(timeline.years(F.coalesce("t", F.lit("")), 2024).alias("y")).first()
    assert row.y == want


def test_spans_merge_in_any_order(spark):
    for spans in ([(2010, 2012), (2013, 2015), (2018, 2019)], [(2018, 2019), (2013, 2015), (2010, 2012)]):
        df = spark.createDataFrame([(1, spans)], "k int, s array<struct<a:int,b:int>>")
        assert df.select(timeline.merged_years(F.col("s")).alias("y")).first().y == 6
        rows = ranking.merged_spans(df.select("k", F.explode("s").alias("x")).select("k", "x.*"), "k").orderBy("a").collect()
        assert [(r.a, r.b) for r in rows] == [(2010, 2015), (2018, 2019)]


def test_education(spark):
    cases = {"I'm a cook": "Masters", "achelor of arts": "Bachelors", "ScienceBachelor": "Bachelors", "Ph.D., MSc": "PhD", "nothing": "Unknown", "HSC 2001": "Diploma"}
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(timeline.education_level(F.col("t")).alias("x")).first().x == want


def test_sections_and_work_text(spark):
    raw = "me\nExperience\njob 2010-2012\nEducation\nschool\nExperience\n\nSkills\na"
    row = sections.with_sections(spark.createDataFrame([(1, raw)], "doc_id long, text string")).select("sections", timeline.work_text(F.col("text"), F.col("sections")).alias("w")).first()
    assert [(s.section, s.body) for s in row.sections] == [("header", "me"), ("experience", "job 2010-2012"), ("education", "school"), ("skills", "a")]
    assert row.w == "me\njob 2010-2012\na"


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "tiny"), (2, "Skills\n" + "word " * 1000), (3, ""), (4, "\n".join(["x" * 2300] * 9))], "doc_id long, text string")
    found = {r.doc_id: r for r in sections.with_chunks(docs, ["word"]).collect()}
    assert [(c.section, c.text) for c in found[1].chunks] == [("body", "tiny")]
    assert [c.section for c in found[2].chunks] == ["skills"] * 3 and found[2].chunks[0].keyword_hits == 1
    assert found[4].n_chunks > 6 and len(found[4].chunks) == 6 and found[4].truncated
    order = [c["index"] for c in found[4].chunks]
    assert order == sorted(order)


def test_rank_is_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("score"))
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = ranking.ranked(df, F.desc("score"), F.asc("id")).collect()
        assert sorted(r["rank"] for r in rows) == list(range(1, 1001))
        assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_is_that_of_the_rows_whatever_is_read(spark):
    """Ranges drawn from two samples, one for the numbers and one for the sizes, would leave gaps where one of them reads more columns."""
    df = spark.range(60000).select("id", F.xxhash64("id").alias("score"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows = ranking.ranked(df, F.desc("score"), F.asc("id")).select("rank", "id", "score", "text").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 60001))
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == [r.id for r in sorted(rows, key=lambda r: (-r.score, r.id))]


def test_first_seen(spark):
    df = spark.createDataFrame([("a", 1, "f1"), ("a", 2, "f2"), ("", 3, "f3"), ("", 4, "f4"), (None, 5, "f5"), ("a", 6, "f6")], "sha1 string, pos int, file string")
    rows = {r.file: r.duplicate_of for r in ranking.first_seen(df, "sha1", "pos", "file").collect()}
    assert rows == {"f1": None, "f2": "f1", "f3": None, "f4": None, "f5": None, "f6": "f1"}


def test_plans(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("alpha tool").alias("text"))
    plan = matching.coverage(docs, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    top = ranking.top_of_each(docs.withColumn("g", F.col("doc_id") % 7), 2, ["g"], F.asc("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top
    assert "TakeOrderedAndProject" in ranking.top(docs, 5, F.asc("doc_id"))._jdf.queryExecution().executedPlan().toString()
