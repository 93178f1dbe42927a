from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_squash(spark):
    assert one(spark, "Power-BI, Power BI", text.squash) == "powerbipowerbi"
    assert one(spark, None, text.squash) == ""
    assert one(spark, "naïve 中", text.squash) == "nave"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_squash_twice_is_squash(spark, value):
    once = one(spark, value, text.squash)
    assert one(spark, once, text.squash) == once


def test_white_space_is_unicode(spark):
    assert one(spark, "  a b\x1c ", text.squash_spaces) == "a b"
    assert one(spark, "a\x0bb\x1cc d\r\n\n e ", text.clean_lines) == ["a", "b", "c", "d", "e"]
    assert one(spark, None, text.clean_lines) == []


def test_cleanup_and_lookalikes(spark):
    assert one(spark, " aﬁb \tc\n\n\n\nd ", text.cleanup) == "afib c\n\nd"
    assert one(spark, "a–b “q” •ﬂ", text.normalised) == 'a-b "q" -fl'


def test_word_count(spark):
    assert [one(spark, v, text.word_count) for v in (None, "", "  ", "a b\nc")] == [0, 0, 0, 3]


def test_sections(spark):
    found = {v: one(spark, v, text.section_of) for v in ("Work Experience", "EDUCATION:", "Tech Stack", "Research Analyst, 2019", "HOBBIES", "WHAT ELSE", "Nothing here", "about me", "x" * 61, "")}
    assert found["Work Experience"] == "experience" and found["EDUCATION:"] == "education" and found["Tech Stack"] == "skills"
    assert found["Research Analyst, 2019"] == "publications"
    assert found["HOBBIES"] == "interests" and found["WHAT ELSE"] == "other" and found["about me"] == "summary"
    assert found["Nothing here"] is None and found["x" * 61] is None and found[""] is None


def test_snippet(spark):
    raw = "a" * 50 + " match\nhere " + "b" * 60
    row = spark.createDataFrame([(raw,)], "t string").select(text.snippet(F.col("t"), F.lit(51), F.lit(56)).alias("x")).first()
    assert row.x == "…" + "a" * 44 + " match here " + "b" * 39 + "…"
    assert one(spark, "short", lambda c: text.snippet(c, F.lit(0), F.lit(2))) == "short"


def test_pieces_follow_the_formula(spark):
    for n, want in ((10, 1), (2400, 1), (2401, 2), (4550, 2), (4551, 3), (9000, 5)):
        assert len(one(spark, "x" * n, lambda c: text.pieces(c, 2400, 250))) == want
    assert one(spark, "ab   cd", lambda c: text.pieces(c, 3, 1)) == ["ab", "cd"]
