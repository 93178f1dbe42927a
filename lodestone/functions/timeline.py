"""Years of experience and education, as column expressions. The year that "present" means is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squash, text_of

# Patterns of year ranges, of stated experience, and of academic contexts.
YEAR_RANGE = r"(?i)(?:19|20)\d{2}\s*(?:-|–|—|to|until)\s*(?:(?:19|20)\d{2}|present|current|now|date)"
STATED = r"(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s*(?:of)?\s*(?:professional\s+|relevant\s+|industry\s+|hands[\s\-]?on\s+)?(?:experience|exp\b|work)"
STATED_LOOSELY = r"(?i)(\d{1,2})\s*\+?\s*years?"
ACADEMIC = r"(?i)(college|bachelor|master|b\.?\s?s\b|b\.?\s?a\b|mba|gpa|degree|school|institut|academ|diploma|graduat|coursework|major)"

# Degrees from the highest, then fields in the order they are listed.
DEGREES = [
    ("PhD", r"(?i)\b(ph\.?\s?d|doctor(ate|al)|d\.phil)\b"),
    ("Masters", r"(?i)\b(m\.?\s?(sc|tech|eng|a|com|ba|fin|s\.c)|m?aster'?s?\b|mba|msc|mtech|meng|mca|mstat|mfin|mfe)\b"),
    ("Bachelors", r"(?i)\b(b\.?\s?(sc|tech|eng|a|com|ba|s\.c)|b?achelor'?s?\b|bsc|btech|beng|bca|bba|bcom|undergraduate)\b"),
    ("Diploma", r"(?i)\b(diploma|associate'?s?\s+degree|higher\s+secondary|hsc|12th|intermediate)\b"),
]
GLUED_DEGREES = [("PhD", ["doctorate"]), ("Masters", ["masters", "masterof"]), ("Bachelors", ["achelor"])]
FIELDS = [
    ("Quant Finance", r"(?i)quant(itativ)?e?\s+fin|financial\s+engineer|computational\s+finance"),
    ("Finance", r"(?i)\bfinanc(e|ial)\b"),
    ("Economics", r"(?i)\beconomic(s|ist)?\b"),
    ("Statistics", r"(?i)\bstatistic(s|al)\b|\bbiostatistic"),
    ("Mathematics", r"(?i)\bmath(ematics|ematical|s)?\b|\bapplied\s+math"),
    ("Computer Science", r"(?i)computer\s+science|\bcs\b|\bsoftware\s+eng|\bcomput(er|ational)\b"),
    ("Data/Analytics", r"(?i)data\s+science|analytics|\bml\b|machine\s+learning"),
    ("Engineering", r"(?i)\bengineer(ing)?\b"),
    ("Business", r"(?i)\bbusiness\s+(admin|management)|\bbba\b|commerce"),
]
STUDY_SECTIONS = ["education", "certifications", "publications", "awards"]


def work_text(text: Column, sections: Column) -> Column:
    """The text without academic sections, where there are any; the whole text if nothing else is left."""
    study = F.exists(sections, lambda s: s["section"].isin(STUDY_SECTIONS))
    kept = F.array_join(F.transform(F.filter(sections, lambda s: ~s["section"].isin([*STUDY_SECTIONS, "interests"])), lambda s: s["body"]), "\n")
    return let(kept, lambda k: F.when(study & (k != ""), k).otherwise(text_of(text)))


def year_spans(work: Column, as_of: int) -> Column:
    """Array of (a, b): ranges of years that no academic word precedes within 60 characters."""

    def spans(w: Column) -> Column:
        found, gaps = F.regexp_extract_all(w, F.lit(YEAR_RANGE), F.lit(0)), F.split(w, YEAR_RANGE, -1)
        both = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.concat(z["g"], F.coalesce(z["m"], F.lit(""))))
        return F.struct(found.alias("found"), gaps.alias("gaps"), both.alias("both"))

    def judged(x: Column) -> Column:
        every = F.transform(
            x["found"],
            lambda m, i: F.struct(
                F.left(m, F.lit(4)).cast("int").alias("a"),
                F.when(F.regexp_extract(m, r"((?:19|20)\d{2})$", 1) != "", F.right(m, F.lit(4)).cast("int")).otherwise(F.lit(as_of)).alias("b"),
                F.right(F.concat(F.array_join(F.slice(x["both"], 1, i), ""), F.get(x["gaps"], i)), F.lit(60)).alias("before"),
            ),
        )
        fine = F.filter(every, lambda s: (s["a"] >= 1950) & (s["a"] <= s["b"]) & (s["b"] <= as_of + 1) & ~s["before"].rlike(ACADEMIC))
        return F.transform(fine, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))

    return let(work, lambda w: let(spans(w), judged))


def merged_years(spans: Column) -> Column:
    """Years in the union of spans, where a span that begins a year after another's end still joins it."""
    start = F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0).alias("total"))

    def step(acc, s):
        joins = acc["b"].isNotNull() & (s["a"] <= acc["b"] + 1)
        done = acc["total"] + F.coalesce(acc["b"] - acc["a"], F.lit(0))
        return F.struct(
            F.when(joins, acc["a"]).otherwise(s["a"]).alias("a"),
            F.when(joins, F.greatest(acc["b"], s["b"])).otherwise(s["b"]).alias("b"),
            F.when(joins, acc["total"]).otherwise(done).alias("total"),
        )

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["total"] + F.coalesce(acc["b"] - acc["a"], F.lit(0)))


def stated_years(work: Column) -> Column:
    """Years that the text states, of experience if it says so, else any number of years up to 45."""
    plain = F.regexp_extract(work, STATED, 1).try_cast("double")
    loose = F.regexp_extract(work, STATED_LOOSELY, 1).try_cast("double")
    return F.when(plain > 0, plain).otherwise(F.when((loose > 0) & (loose <= 45), loose).otherwise(0.0))


def years(work: Column, as_of: int) -> Column:
    return let(work, lambda w: F.round(F.least(F.greatest(stated_years(w), merged_years(year_spans(w, as_of)).cast("double")), F.lit(45.0)), 1))


def education_level(text: Column) -> Column:
    t, sq = text_of(text), squash(text)
    level = F.when(F.lit(False), F.lit(""))
    for name, pattern in DEGREES:
        level = level.when(t.rlike(pattern), F.lit(name))
    for name, parts in GLUED_DEGREES:
        for part in parts:
            level = level.when(F.contains(sq, F.lit(part)), F.lit(name))
    return level.otherwise("Unknown")


def education_fields(text: Column) -> Column:
    """All fields the text names, in order."""
    t = text_of(text)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in FIELDS]))


def relevant(fields: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(fields, F.lower), F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>"))
