"""Alias matching and rubric scores, without a shuffle: a rubric is a bounded set of literals, so a document is scored where it lies.

Containment of long aliases is tested on squashed text, short aliases are looked for as words in raw text: those of letters and
digits alone in the set of the text's words, which is made once, others by a pattern each. The tests are one array of literal
expressions, compiled once; no row is multiplied by the number of aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import saturation
from ..functions.text import alias_pattern, let, snippet, squash, text_of
from .rubric import Alias, Rubric

#: Rubrics are written by hand; beyond so many aliases literals would no longer be the right form.
MOST_ALIASES = 5000


def _forms(a: Alias) -> list[str]:
    """How a short alias of letters and digits alone may stand in a text, as a word in lower case; none for others."""
    return [a.alias.lower() + end for end in ("", "s", "es")] if a.short and a.alias.isascii() and a.alias.isalnum() else []


def known_words(raw: Column, rubric: Rubric) -> Column:
    """Those words of a text that are short aliases, each once."""
    forms = sorted({f for a in rubric.aliases for f in _forms(a)})
    if not forms:
        return F.array().cast("array<string>")
    # splitting at all but ASCII letters and digits leaves words whose case is ASCII's
    return F.array_distinct(F.filter(F.transform(F.split(raw, "[^A-Za-z0-9]+"), F.lower), lambda w: w.isin(forms)))


def _matches(raw: Column, sq: Column, words: Column, a: Alias) -> Column:
    if forms := _forms(a):
        return F.arrays_overlap(words, F.array(*[F.lit(f) for f in forms]))
    return raw.rlike(alias_pattern(a.alias, True)) if a.short else F.contains(sq, F.lit(a.squashed))


def hits(raw: Column, sq: Column, rubric: Rubric) -> Column:
    """Array of every alias that the text has, in the rubric's order."""
    if len(rubric.aliases) > MOST_ALIASES:
        raise ValueError(f"a rubric of over {MOST_ALIASES} aliases")

    def one(words: Column, a: Alias) -> Column:
        return F.when(
            _matches(raw, sq, words, a),
            F.struct(
                F.lit(a.category_pos).alias("category_pos"), F.lit(a.skill_pos).alias("skill_pos"), F.lit(a.specificity).alias("specificity"), F.lit(-a.alias_pos).alias("order"),
                F.lit(a.category).alias("category"), F.lit(a.skill).alias("skill"), F.lit(a.alias if a.short else a.squashed).alias("matched_alias"), F.lit(a.short).alias("is_short"),
                F.lit(alias_pattern(a.alias, a.short)).alias("pattern"),
            ),
        )

    return let(known_words(raw, rubric), lambda words: F.array_compact(F.array(*[one(words, a) for a in rubric.aliases])))


def with_hits(docs: DataFrame, rubric: Rubric, text: str = "text") -> DataFrame:
    """``docs`` with the array ``hits``; the text is squashed once."""
    return docs.withColumn("_sq", squash(F.col(text))).withColumn("hits", hits(text_of(F.col(text)), F.col("_sq"), rubric)).drop("_sq")


def alias_hits(docs: DataFrame, rubric: Rubric, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and alias that it has."""
    rows = with_hits(docs.select(key, text), rubric, text).select(key, F.explode_outer("hits").alias("h")).where("h is not null")
    return rows.select(key, "h.category", "h.skill", "h.matched_alias", "h.specificity", "h.is_short", (-F.col("h.order")).alias("alias_pos"))


def _best(found: Column) -> Column:
    """Of each category and skill the longest alias, the first listed of equals: structs compare by specificity, then order."""
    return let(found, _most_specific)


def _most_specific(found: Column) -> Column:
    return F.filter(
        found,
        lambda h: ~F.exists(found, lambda o: (o["category_pos"] == h["category_pos"]) & (o["skill_pos"] == h["skill_pos"]) & ((o["specificity"] > h["specificity"]) | ((o["specificity"] == h["specificity"]) & (o["order"] > h["order"])))),
    )


def _evidence(raw: Column, h: Column) -> Column:
    """What stands around the first place where a hit's alias is found; that place is looked for once."""

    def around(match: Column) -> Column:
        # a short alias may also stand inside a word before its match, so its place is where the text before the match ends
        start = F.when(h["is_short"], F.length(F.get(F.split(raw, h["pattern"], 2), F.lit(0)))).otherwise(F.instr(raw, match) - 1)
        return let(F.struct(start.alias("a"), F.length(match).alias("n")), lambda x: snippet(raw, x["a"], x["a"] + x["n"]))

    return let(F.regexp_substr(raw, h["pattern"]), around)


def best_hits(docs: DataFrame, rubric: Rubric, key: str = "doc_id", text: str = "text", evidence: bool = False) -> DataFrame:
    """A row per document, category and skill: the most specific alias found, with what stands around it if asked."""
    found = with_hits(docs.select(key, text), rubric, text).withColumn("hits", _best(F.col("hits")))
    # an inner explode would have the hits found once more, for a filter on their number
    rows = found.select(key, text, F.explode_outer("hits").alias("h")).where("h is not null")
    out = [key, "h.category_pos", "h.category", "h.skill_pos", "h.skill", "h.matched_alias"]
    return rows.select(*out, _evidence(text_of(F.col(text)), F.col("h")).alias("evidence")) if evidence else rows.select(*out)


def coverage(docs: DataFrame, rubric: Rubric, text: str = "text") -> DataFrame:
    """``docs`` with the array ``categories``, one struct per category of the rubric, and the score ``base``, 0 to 100."""
    out = with_hits(docs, rubric, text)

    def category(at: int) -> Column:
        name, weight, must, skills = rubric.categories[at]
        own = F.filter(F.col("hits"), lambda h: h["category_pos"] == at)
        matched = F.sort_array(F.array_distinct(F.transform(own, lambda h: h["skill"])))
        ratio = F.size(matched) / F.lit(max(1, len(skills)))
        return F.struct(
            F.lit(name).alias("category"), F.lit(weight).alias("weight"), F.lit(must).alias("must_have"), matched.alias("matched"),
            F.array_except(F.array(*[F.lit(s) for s in sorted(set(skills))]).cast("array<string>"), matched).alias("missing"), ratio.alias("ratio"), (F.lit(weight) * saturation(ratio)).alias("points"),
        )

    kind = "array<struct<category:string,weight:double,must_have:boolean,matched:array<string>,missing:array<string>,ratio:double,points:double>>"
    out = out.withColumn("categories", F.array(*[category(k) for k in range(len(rubric.categories))]).cast(kind))
    base = 100.0 * F.aggregate("categories", F.lit(0.0), lambda acc, c: acc + c["points"]) / F.lit(rubric.total_weight)
    return out.withColumn("base", base)


def category_scores(docs: DataFrame, rubric: Rubric, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and category, categories without a hit included."""
    rows = coverage(docs.select(key, text), rubric, text).select(key, F.explode_outer("categories").alias("c"))
    return rows.select(key, "c.category", "c.weight", "c.must_have", F.size("c.matched").alias("n_matched"), "c.ratio", "c.points")


def must_haves(categories: Column, met: bool) -> Column:
    """Names of must-have categories with a skill found, or without."""
    return F.transform(F.filter(categories, lambda c: c["must_have"] & ((F.size(c["matched"]) > 0) if met else (F.size(c["matched"]) == 0))), lambda c: c["category"])


def skills(categories: Column, part: str) -> Column:
    """All matched or missing skills, sorted, each once."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(categories, lambda c: c[part]))))


def points_map(categories: Column) -> Column:
    return F.map_from_entries(F.transform(categories, lambda c: F.struct(c["category"], c["points"])))


def evidence(raw: Column, found: Column, categories: Column, a_category: int = 3, in_all: int = 8) -> Column:
    """Lines of proof from a text's hits, the categories with most points first, a bounded number of each and in all."""

    def ordered(best: Column, points_of: Column) -> Column:
        points = lambda h: F.round(F.get(points_of, h["category_pos"]), 3)
        names = ("category_pos", "skill", "category", "pattern", "is_short")
        return F.sort_array(F.transform(best, lambda h: F.struct((-points(h)).alias("p"), *(h[n].alias(n) for n in names))))

    def chosen(every: Column) -> Column:
        kept = F.filter(every, lambda x, i: F.size(F.filter(F.slice(every, 1, i), lambda o: o["category_pos"] == x["category_pos"])) < a_category)
        return F.transform(F.slice(kept, 1, in_all), lambda x: F.concat(x["category"], F.lit(": "), x["skill"], F.lit(" — “"), _evidence(raw, x), F.lit("”")))

    # bound before the lambdas, or categories would be worked out again for each hit
    points = F.transform(categories, lambda c: c["points"])
    return let(let(points, lambda p: let(_best(found), lambda best: ordered(best, p))), chosen)


def evidence_lines(docs: DataFrame, rubric: Rubric, key: str = "doc_id", text: str = "text", a_category: int = 3, in_all: int = 8) -> DataFrame:
    """(key, evidence) of every document with a hit; computed where the document lies."""
    rows = coverage(docs.select(key, text), rubric, text)
    lines = evidence(text_of(F.col(text)), F.col("hits"), F.col("categories"), a_category, in_all)
    # a filter on a plain column would have all of it worked out again below
    return rows.select(key, F.explode_outer(F.array(lines)).alias("evidence")).where(F.size("evidence") > 0)
