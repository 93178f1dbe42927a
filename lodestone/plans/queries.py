"""Queries over the driver's tables, one or more for each operator, each with the SQL that gives the same rows.

The tables hold no resumes: a rubric of words that occur in ``documents`` stands in for a real one, and short profiles are
composed from ``customer`` by one expression that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig, Config
from ..functions import contacts, jsonfix, scoring, text, timeline
from ..operators import matching, ranking, sections
from ..operators.rubric import Rubric
from ..session import spread
from ..sources import ingest
from . import ranker

CFG = Config()
RUBRIC = Rubric(
    {
        "title": "Words of the driver's documents",
        "education_relevant_fields": ["finance", "economics"],
        "categories": [
            {"name": "stems", "weight": 40, "must_have": True, "skills": [{"name": "thatin", "aliases": ["that in", "thatin"]}, {"name": "inoran", "aliases": ["in-oran"]}, {"name": "hehely", "aliases": ["he hely"]}, "threa"]},
            {"name": "words", "weight": 25, "must_have": True, "skills": [{"name": "the", "aliases": ["the"]}, {"name": "von", "aliases": ["von"]}, {"name": "el", "aliases": ["el", "del"]}, {"name": "le", "aliases": ["le", "la", "les"]}]},
            {"name": "legal", "weight": 20, "skills": [{"name": "license", "aliases": ["license", "licensed"]}, {"name": "MIT", "aliases": ["MIT"]}, "General Public License"]},
            {"name": "romance", "weight": 15, "skills": ["mentre", {"name": "queque", "aliases": ["que que", "que"]}]},
        ],
        "synonyms": {"threa": ["there a", "threand"]},
    }
)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


# --- SQL fragments -----------------------------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


_ALIASES = ",\n".join(
    f"({a.category_pos}, {_quoted(a.category)}, {a.weight!r}, {str(a.must_have).lower()}, {a.skill_pos}, {_quoted(a.skill)}, {a.alias_pos}, {_quoted(a.alias)}, {_quoted(a.squashed)}, {str(a.short).lower()}, {a.specificity}, {_quoted('(?i)(^|[^A-Za-z0-9])' + _re2(a.alias) + '(s|es)?([^A-Za-z0-9]|$)')})"
    for a in RUBRIC.aliases
)
_CATEGORIES = ", ".join(f"({k}, {_quoted(n)}, {w!r}, {str(m).lower()}, {max(1, len(s))})" for k, (n, w, m, s) in enumerate(RUBRIC.categories))
_SKILLS = ", ".join(f"({k}, {_quoted(n)}, {_quoted(x)})" for k, (n, _, _, s) in enumerate(RUBRIC.categories) for x in s)

#: hit: every alias a document has; best: of each skill the most specific; cat: coverage of each category; score: of each document.
MATCH = rf"""
    alias(category_pos, category, weight, must_have, skill_pos, skill, alias_pos, alias, alias_sq, is_short, specificity, pattern) AS (VALUES {_ALIASES}),
    category(category_pos, category, weight, must_have, n_skills) AS (VALUES {_CATEGORIES}),
    doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g') AS sq FROM documents),
    hit AS (
        SELECT doc_id, alias.* FROM doc, alias
        WHERE CASE WHEN is_short THEN regexp_matches(text, pattern) ELSE contains(sq, alias_sq) END
    ),
    best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category_pos, skill_pos ORDER BY specificity DESC, alias_pos) AS rn FROM hit) WHERE rn = 1
    ),
    cat AS (
        SELECT doc_id, category_pos, category, weight, must_have, n, n / n_skills AS ratio, weight * (1 - exp(-3.0 * n / n_skills)) AS points
        FROM (
            SELECT doc.doc_id, c.category_pos, c.category, c.weight, c.must_have, c.n_skills, CAST(count(best.skill) AS DOUBLE) AS n
            FROM doc CROSS JOIN category c LEFT JOIN best ON best.doc_id = doc.doc_id AND best.category_pos = c.category_pos
            GROUP BY ALL
        )
    ),
    score AS (
        SELECT doc_id, 100 * sum(points) / {RUBRIC.total_weight!r} AS base, count(*) FILTER (WHERE must_have AND n = 0) AS missing FROM cat GROUP BY doc_id
    ),
    final AS (
        SELECT doc_id, base, missing, greatest(0, least(100, base * 1.7 - 6 * missing)) AS score FROM score
    )
"""
TIER = "CASE WHEN score >= 75 THEN 'strong_fit' WHEN score >= 58 THEN 'moderate_fit' ELSE 'weak_fit' END"

#: A profile in text for each customer; the expression is SQL that Spark and DuckDB read alike.
PROFILE = """concat(
    CASE c_custkey % 5 WHEN 0 THEN 'Jordan Smith' WHEN 1 THEN 'ROBERTSMITH' WHEN 2 THEN 'Senior Analyst' WHEN 3 THEN concat('Karen', chr(10), 'Brown') ELSE c_name END, chr(10),
    CASE c_custkey % 4 WHEN 0 THEN 'Dallas, TX' WHEN 1 THEN 'StatenIsland, NY10301' WHEN 2 THEN 'Pune, MH 411001' ELSE 'Springfield' END, chr(10),
    CASE c_custkey % 6 WHEN 0 THEN concat('user', c_custkey, '@firm', c_nationkey, '.com') WHEN 1 THEN concat('555-010-9999-u', c_custkey, '@firm.io') WHEN 2 THEN concat('u', c_custkey, '@examplc.com')
        WHEN 3 THEN concat('first.', c_custkey, ' @ mail .org') WHEN 4 THEN concat('wax', c_custkey, ' (at) site (dot) net') ELSE 'no address' END, chr(10),
    CASE c_custkey % 3 WHEN 0 THEN concat('Call: +1 555-', 100 + c_custkey % 900, '-4321') WHEN 1 THEN concat('(555) 010-', 1000 + c_custkey % 9000) ELSE '2010-2014' END, chr(10),
    CASE c_custkey % 7 WHEN 0 THEN concat('linkedin.com/in/user-', c_custkey) WHEN 1 THEN concat('see linkedln.com/in/u', c_custkey, ' and github.com/u', c_custkey) ELSE '' END, chr(10),
    'Summary', chr(10), CASE c_custkey % 4 WHEN 0 THEN concat(2 + c_custkey % 9, '+ years of experience in machinery') ELSE 'Builds things that last for a long while, in teams of any size.' END, chr(10),
    'Work Experience', chr(10), 'Clerk at ', c_name, ' ', 1995 + c_custkey % 10, ' - ', 1998 + c_custkey % 13, chr(10), 'Lead ', 2005 + c_custkey % 8, ' to ', CASE c_custkey % 2 WHEN 0 THEN 'present' ELSE '2015' END, chr(10),
    'Education', chr(10), CASE c_custkey % 5 WHEN 0 THEN 'Bachelor of Science, Economics 1990 - 1994' WHEN 1 THEN 'MBA, Business Administration' WHEN 2 THEN 'Ph.D. in Statistics' WHEN 3 THEN 'ScienceBachelor' ELSE 'none' END, chr(10),
    'Skills', chr(10), c_mktsegment, ', writing, the usual tools and a few more that are worth a line of their own')"""
PROFILES = f"profile AS (SELECT c_custkey AS id, {PROFILE} AS text FROM customer)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).selectExpr("c_custkey AS id", f"{PROFILE} AS text")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select("event_id", *columns))


# --- text --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')) AS squashed FROM documents")
def squash_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.squash(F.col("text")), 256).alias("squashed"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F]+', ' ', 'g'))) AS spaced, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F]+')) AS INTEGER) AS words FROM documents")
def squash_spaces(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.squash_spaces(F.col("text")), 256).alias("spaced"), text.word_count(F.col("text")).alias("words"))


@query(r"""
    SELECT doc_id, CAST(count(*) FILTER (WHERE line <> '') AS INTEGER) AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '')) AS lines
    FROM (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line
          FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[\n\r\x0B\x0C\x1C-\x1E]')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '[\n\r\x0B\x0C\x1C-\x1E]'), 1) AS i FROM documents))
    GROUP BY doc_id
""")
def clean_lines(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("l", text.clean_lines(F.col("text")))
    return found.select("doc_id", F.size("l").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("lines"))


@query(r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS cleaned FROM documents
""")
def cleanup_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.cleanup(F.col("text")), 256).alias("cleaned"))


@query(r"""
    SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '\PL', '', 'g')) AS INTEGER) AS letters, length(regexp_replace(coalesce(text, ''), '\PL', '', 'g')) >= 120 AS text_layer FROM documents
""")
def text_layer(spark, sf_dir):
    n = text.letters(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", n.alias("letters"), (n >= CFG.extract.text_layer_least).alias("text_layer"))


@query(r"""
    SELECT kind, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars FROM (
        SELECT length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words,
            CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(regexp_replace(coalesce(text, ''), '\PL', '', 'g')) >= 200 THEN 'text' ELSE 'scan' END AS kind
        FROM documents) GROUP BY kind
""")
def audit_text(spark, sf_dir):
    found = ingest.audit(docs(spark, sf_dir))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("words").cast("long").alias("words"), F.sum("n_text").cast("long").alias("chars"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha1(text.text_of(F.col("text"))).alias("sha1"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    c = F.col("url")
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("escaped"))


# --- rubric ------------------------------------------------------------------------------------------------------------


@query(f"SELECT * FROM (VALUES {_ALIASES}) t(category_pos, category, weight, must_have, skill_pos, skill, alias_pos, alias, alias_sq, is_short, specificity, pattern)".replace("SELECT *", "SELECT category_pos, category, CAST(weight AS DOUBLE) AS weight, must_have, skill_pos, skill, alias_pos, alias, alias_sq, is_short, specificity"))
def alias_table(spark, sf_dir):
    return RUBRIC.alias_table(spark)


@query(f"SELECT DISTINCT alias_sq AS keyword, CAST(length(alias_sq) AS INTEGER) AS n FROM (VALUES {_ALIASES}) t(a, b, c, d, e, f, g, h, alias_sq, is_short, i, j) WHERE NOT is_short")
def keyword_list(spark, sf_dir):
    return RUBRIC.alias_table(spark).where("not is_short").select(F.col("alias_sq").alias("keyword")).distinct().withColumn("n", F.length("keyword"))


@query(f"WITH {MATCH} SELECT doc_id, category, skill, CASE WHEN is_short THEN alias ELSE alias_sq END AS matched_alias, specificity, is_short, alias_pos FROM hit")
def alias_hits(spark, sf_dir):
    return matching.alias_hits(docs(spark, sf_dir), RUBRIC)


@query(f"WITH {MATCH} SELECT doc_id, category, skill, CASE WHEN is_short THEN alias ELSE alias_sq END AS matched_alias FROM best")
def best_alias(spark, sf_dir):
    return matching.best_hits(docs(spark, sf_dir), RUBRIC).select("doc_id", "category", "skill", "matched_alias")


@query(f"WITH {MATCH} SELECT doc_id, category, CAST(weight AS DOUBLE) AS weight, must_have, CAST(n AS INTEGER) AS n_matched, round(ratio, 6) AS ratio, round(points, 6) AS points FROM cat")
def category_scores(spark, sf_dir):
    return matching.category_scores(docs(spark, sf_dir), RUBRIC).withColumns({c: F.round(c, 6) for c in ("ratio", "points")})


@query(f"""
    WITH {MATCH} SELECT doc_id, coalesce(string_agg(category, '; ' ORDER BY category_pos) FILTER (WHERE must_have AND n > 0), '') AS met,
        coalesce(string_agg(category, '; ' ORDER BY category_pos) FILTER (WHERE must_have AND n = 0), '') AS missing FROM cat GROUP BY doc_id
""")
def must_have_split(spark, sf_dir):
    found = matching.coverage(docs(spark, sf_dir), RUBRIC)
    return found.select("doc_id", *(F.array_join(matching.must_haves(F.col("categories"), met), "; ").alias(name) for met, name in ((True, "met"), (False, "missing"))))


@query(f"""
    WITH {MATCH}, skill(category_pos, category, skill) AS (VALUES {_SKILLS})
    SELECT doc.doc_id, coalesce(string_agg(DISTINCT CASE WHEN best.skill IS NOT NULL THEN s.skill END, '; ' ORDER BY CASE WHEN best.skill IS NOT NULL THEN s.skill END), '') AS matched,
        coalesce(string_agg(DISTINCT CASE WHEN best.skill IS NULL THEN s.skill END, '; ' ORDER BY CASE WHEN best.skill IS NULL THEN s.skill END), '') AS missing
    FROM doc CROSS JOIN skill s LEFT JOIN best ON best.doc_id = doc.doc_id AND best.category_pos = s.category_pos AND best.skill = s.skill GROUP BY doc.doc_id
""")
def skill_lists(spark, sf_dir):
    found = matching.coverage(docs(spark, sf_dir), RUBRIC)
    return found.select("doc_id", *(F.array_join(matching.skills(F.col("categories"), p), "; ").alias(p) for p in ("matched", "missing")))


@query(f"WITH {MATCH} SELECT doc_id, string_agg(category || '=' || CAST(CAST(round(points * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY category_pos) AS points FROM cat GROUP BY doc_id")
def points_map(spark, sf_dir):
    found = matching.coverage(docs(spark, sf_dir), RUBRIC).withColumn("m", matching.points_map(F.col("categories")))
    names = [n for n, *_ in RUBRIC.categories]
    return found.select("doc_id", F.concat_ws(";", *(F.concat(F.lit(n + "="), F.round(F.element_at("m", n) * 1000).cast("long").cast("string")) for n in names)).alias("points"))


@query(f"""
    WITH {MATCH}, skill(category_pos, category, skill) AS (VALUES {_SKILLS})
    SELECT doc.doc_id, s.category, s.skill FROM doc CROSS JOIN skill s WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.doc_id = doc.doc_id AND best.category_pos = s.category_pos AND best.skill = s.skill)
""")
def missing_skills(spark, sf_dir):
    found = matching.coverage(docs(spark, sf_dir), RUBRIC)
    return found.select("doc_id", F.explode_outer("categories").alias("c")).select("doc_id", "c.category", F.explode_outer("c.missing").alias("skill")).where("skill is not null")


#: place: where the best alias of each skill first stands, and what stands around it. Short aliases are found with a character on
#: either side, which is taken off again.
PLACE = r"""
    found_at AS (
        SELECT best.*, doc.text AS body, regexp_extract(doc.text, CASE WHEN is_short THEN pattern ELSE '(?i)()' || array_to_string(string_split(alias_sq, ''), '[^A-Za-z0-9]*') || '()()' END) AS m,
            CASE WHEN is_short THEN regexp_extract(doc.text, pattern, 1) ELSE '' END AS lead, CASE WHEN is_short THEN regexp_extract(doc.text, pattern, 3) ELSE '' END AS trail
        FROM best JOIN doc USING (doc_id)
    ),
    core AS (
        SELECT *, length(m) - length(lead) - length(trail) AS n,
            CASE WHEN is_short AND trail = '' THEN length(body) - length(m) ELSE strpos(body, m) - 1 END + length(lead) AS s
        FROM found_at
    ),
    place AS (
        SELECT doc_id, category_pos, category, skill, CASE WHEN s > 45 THEN '…' ELSE '' END || trim(regexp_replace(substr(body, greatest(0, s - 45) + 1, least(length(body), s + n + 45) - greatest(0, s - 45)), '\s+', ' ', 'g'))
            || CASE WHEN s + n + 45 < length(body) THEN '…' ELSE '' END AS evidence
        FROM core
    )
"""


@query(f"WITH {MATCH}, {PLACE} SELECT doc_id, category, skill, evidence FROM place")
def evidence_snippets(spark, sf_dir):
    return matching.best_hits(docs(spark, sf_dir), RUBRIC, evidence=True).select("doc_id", "category", "skill", "evidence")


#: line: proof of each document, in order, at most three of a category.
LINE = f"""{PLACE}, own_line AS (
        SELECT place.doc_id, place.category_pos, skill, round(points, 3) AS points, place.category || ': ' || skill || ' — “' || evidence || '”' AS line,
            row_number() OVER (PARTITION BY place.doc_id, place.category_pos ORDER BY skill) AS own
        FROM place JOIN cat ON cat.doc_id = place.doc_id AND cat.category_pos = place.category_pos
    ), line AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, category_pos, skill) AS rn FROM own_line WHERE own <= 3)
"""


@query(f"WITH {MATCH}, {LINE} SELECT doc_id, string_agg(line, ' | ' ORDER BY rn) AS evidence FROM line WHERE rn <= 8 GROUP BY doc_id")
def evidence_lines(spark, sf_dir):
    return matching.evidence_lines(docs(spark, sf_dir), RUBRIC).select("doc_id", F.array_join("evidence", " | ").alias("evidence"))


# --- scores and ranks --------------------------------------------------------------------------------------------------


def scored(spark, sf_dir) -> DataFrame:
    found = matching.coverage(docs(spark, sf_dir), RUBRIC)
    missing = F.size(matching.must_haves(F.col("categories"), False))
    return found.select("doc_id", "base", missing.alias("missing"), scoring.calibrated(F.col("base"), F.lit(0.0), missing, F.lit("Unknown"), F.lit(False)).alias("score"))


@query(f"WITH {MATCH} SELECT doc_id, round(base, 6) AS base, CAST(missing AS INTEGER) AS missing, round(score, 6) AS score FROM final")
def rubric_score(spark, sf_dir):
    return scored(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("base", "score")})


@query(f"WITH {MATCH} SELECT row_number() OVER (ORDER BY round(score, 6) DESC, round(base, 6) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score, {TIER} AS tier FROM final")
def rank_documents(spark, sf_dir):
    """The flagship: coverage, calibrated score and tier of every document, in a total order."""
    found = scored(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("base", "score")})
    return ranking.ranked(found, F.desc("score"), F.desc("base"), F.asc("doc_id")).select("rank", "doc_id", "score", scoring.tier(F.col("score")).alias("tier"))


@query(f"WITH {MATCH} SELECT rank, doc_id, score FROM (SELECT row_number() OVER (ORDER BY round(score, 6) DESC, round(base, 6) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM final) WHERE rank <= 10")
def top_n(spark, sf_dir):
    found = scored(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("base", "score")})
    return ranking.top(found, CFG.top, F.desc("score"), F.desc("base"), F.asc("doc_id")).select("rank", "doc_id", "score")


@query(f"WITH {MATCH} SELECT {TIER} AS tier, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT round(score, 6) AS score FROM final) GROUP BY 1")
def tier_counts(spark, sf_dir):
    found = scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return found.groupBy(scoring.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_BLEND = f"""
    judge AS (SELECT doc_id, max(quality) * 100.0 AS judge FROM labels GROUP BY doc_id),
    blend AS (SELECT doc_id, score AS keyword, judge, CASE WHEN judge IS NULL THEN score ELSE greatest(0, least(100, (0.4 * score + 0.6 * judge) / (0.4 + 0.6))) END AS score FROM final LEFT JOIN judge USING (doc_id))
"""


@query(f"WITH {MATCH}, {_BLEND} SELECT doc_id, round(keyword, 4) AS keyword, CAST(judge AS DOUBLE) AS judge, round(score, 4) AS score, {TIER} AS tier, coalesce(abs(judge - keyword) > 25, false) AS disagree FROM blend")
def blend_with_judge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") * 100.0).alias("judge"))
    found = scored(spark, sf_dir).join(labels, "doc_id", "left").withColumn("final", scoring.blended(F.col("score"), F.col("judge")))
    return found.select("doc_id", F.round("score", 4).alias("keyword"), "judge", F.round("final", 4).alias("score"), scoring.tier(F.col("final")).alias("tier"), scoring.disagree(F.col("judge"), F.col("score")).alias("disagree"))


@query("SELECT c_custkey, c_acctbal, round(greatest(0, least(100, c_acctbal / 50)), 6) AS clamped, round(1 - exp(-3 * greatest(0, least(100, c_acctbal / 50)) / 100), 6) AS saturated FROM customer")
def saturate_and_clamp(spark, sf_dir):
    c = scoring.clamp(F.col("c_acctbal") / 50)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.round(c, 6).alias("clamped"), F.round(scoring.saturation(c / 100), 6).alias("saturated"))


@query("""
    WITH c AS (SELECT c_custkey, CAST(c_custkey % 12 AS DOUBLE) AS own, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 17 AS DOUBLE) END AS judge FROM customer)
    SELECT c_custkey, CASE WHEN own <= 0 AND judge IS NOT NULL THEN judge ELSE own END AS years, coalesce(own > 0 AND abs(own - judge) >= 4, false) AS disagree FROM c
""")
def years_fallback(spark, sf_dir):
    own, judge = (F.col("c_custkey") % 12).cast("double"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 17).cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", scoring.years_or(own, judge).alias("years"), scoring.years_disagree(own, judge).alias("disagree"))


@query(r"""
    SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN error IS NOT NULL THEN 'error' ELSE 'ok' END AS status,
        coalesce(array_to_string(list_filter([CASE WHEN error IS NOT NULL THEN 'extract:' || error END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no-text-extracted' END], lambda x: x IS NOT NULL), '; '), '') AS warnings
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 3 THEN 'bad page' END AS error FROM documents)
""")
def parse_status(spark, sf_dir):
    error = F.when(F.col("doc_id") % 10 == 3, F.lit("bad page"))
    blank = text.strip(text.text_of(F.col("text"))) == ""
    warnings = F.array_compact(F.array(F.when(error.isNotNull(), F.concat(F.lit("extract:"), error)), F.when(blank, F.lit("no-text-extracted"))))
    return docs(spark, sf_dir).select("doc_id", ranker.status(F.col("text"), error).alias("status"), F.array_join(warnings, "; ").alias("warnings"))


# --- sections and chunks -----------------------------------------------------------------------------------------------

_HEADING = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i)^\\s*{p}\\b') THEN '{n}'" for n, p in text.SECTIONS) + r" WHEN regexp_matches(s, '^[A-Z][A-Za-z /&''\-]{2,48}$') AND length(regexp_replace(s, '\PL', '', 'g')) > 0 AND length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) > 0.8 * length(regexp_replace(s, '\PL', '', 'g')) AND len(string_split_regex(s, '\s+')) <= 5 THEN 'other' END"
_LINES = rf"""
    line AS (
        SELECT id, i, line, trim(line, ':·-|') AS s FROM (SELECT id, i, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line
        FROM (SELECT id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src)) WHERE line <> ''
    ),
    mark AS (SELECT id, i, line, CASE WHEN s <> '' AND length(s) <= 60 THEN {_HEADING} END AS heading FROM line),
    run AS (
        SELECT *, coalesce(last_value(CASE WHEN heading <> 'other' THEN heading END IGNORE NULLS) OVER w, 'header') AS section, count(CASE WHEN heading <> 'other' THEN 1 END) OVER w AS run
        FROM mark WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    section AS (
        SELECT id, run, section, string_agg(line, chr(10) ORDER BY i) AS body FROM run WHERE heading IS NULL OR heading = 'other' GROUP BY id, run, section
    )
"""


@query(f"WITH {PROFILES}, src AS (SELECT id, text FROM profile), {_LINES} SELECT id, i AS line_no, line, heading FROM mark WHERE heading IS NOT NULL".replace("SELECT id, i AS line_no, line, heading", "SELECT id, line, heading"))
def detect_headings(spark, sf_dir):
    lines = profiles(spark, sf_dir).select("id", F.explode(text.clean_lines(F.col("text"))).alias("line"))
    return lines.withColumn("heading", text.section_of(F.col("line"))).where("heading is not null")


@query(f"WITH {PROFILES}, src AS (SELECT id, text FROM profile), {_LINES} SELECT id, section, sha256(body) AS body FROM section")
def split_sections(spark, sf_dir):
    found = sections.with_sections(profiles(spark, sf_dir)).select("id", F.explode("sections").alias("s"))
    return found.select("id", "s.section", F.sha2("s.body", 256).alias("body"))


@query("""
    SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w, 'header') AS section, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS run_id
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def sections_running(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("heading", F.when(F.col("role") == "user", F.col("text")))
    return sections.running_sections(turns, "conv_id", "turn", "heading").select("conv_id", "turn", "section", "run_id")


_PIECES = r"""
    piece AS (
        SELECT doc_id, k, CASE WHEN length(t) <= 2400 THEN t ELSE trim(substr(t, CAST(k * 2150 + 1 AS BIGINT), 2400), ' ' || chr(10) || chr(9) || chr(13)) END AS p
        FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 2400 THEN 1 ELSE CAST(ceil((length(t) - 2400) / 2150.0) AS BIGINT) + 1 END)) AS k FROM (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents))
    )
"""


@query(f"WITH {_PIECES} SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(length(p) AS INTEGER) AS n, sha256(p) AS piece FROM piece")
def sliding_windows(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.posexplode(text.pieces(text.strip(text.text_of(F.col("text"))), CFG.chunk.size, CFG.chunk.overlap)).alias("k", "p"))
    return found.select("doc_id", "k", F.length("p").alias("n"), F.sha2("p", 256).alias("piece"))


_KEYS = ", ".join(_quoted(k) for k in RUBRIC.keywords())


@query(f"""
    WITH {_PIECES}, hits AS (
        SELECT doc_id, k, p, len(list_filter([{_KEYS}], lambda x: contains(regexp_replace(lower(p), '[^a-z0-9]+', '', 'g'), x))) AS hits FROM piece
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits / greatest(1.0, length(p) / 500.0) DESC, k) AS rn FROM hits)
    SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(hits AS INTEGER) AS hits, round(hits / greatest(1.0, length(p) / 500.0), 6) AS relevance FROM ranked WHERE rn <= 6
""")
def keyword_chunks_topk(spark, sf_dir):
    raw = text.pieces(text.strip(text.text_of(F.col("text"))), CFG.chunk.size, CFG.chunk.overlap)
    every = F.transform(raw, lambda p, i: F.struct(i.alias("index"), F.lit("body").alias("section"), p.alias("text")))
    found = docs(spark, sf_dir).withColumn("r", sections.ranked_chunks(every, RUBRIC.keywords())).select("doc_id", F.explode(sections.kept_chunks(F.col("r"))).alias("c"))
    return found.select("doc_id", F.col("c.index").alias("k"), F.col("c.keyword_hits").alias("hits"), F.round("c.rel_score", 6).alias("relevance"))


@query(f"""
    WITH {PROFILES}, src AS (SELECT id, text FROM profile), {_LINES}
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY run) - 1 AS INTEGER) AS idx, section, sha256(body) AS chunk FROM section WHERE length(body) >= 60
""")
def section_chunks(spark, sf_dir):
    """Profiles' sections all fit in one window, so their chunks are the sections of 60 characters or more."""
    found = sections.with_sections(profiles(spark, sf_dir)).select("id", F.explode(sections.chunks(F.col("sections"), F.col("text"))).alias("c"))
    return found.select("id", F.col("c.index").alias("idx"), "c.section", F.sha2("c.text", 256).alias("chunk"))


# --- contacts ----------------------------------------------------------------------------------------------------------

_MAIL = contacts.EMAIL.replace("'", "''")
_BAD = ", ".join(_quoted(d) for d in contacts.PLACEHOLDER_DOMAINS)
_GIVEN = ", ".join(_quoted(x) for x in contacts.GIVEN_NAMES)
_WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPELLED = contacts.SPELLED_EMAIL.replace("'", "''")


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _unglued(w: str) -> str:
    """A word as two where a name is glued, in SQL."""
    cut = f"list_max(list_filter(range(3, length({w}) - 2), lambda k: list_contains([{_GIVEN}], lower(substr({w}, 1, k)))))"
    two = f"substr({w}, 1, {cut}) || ' ' || substr({w}, {cut} + 1)"
    title = f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2, {cut} - 1)) || ' ' || upper(substr({w}, {cut} + 1, 1)) || lower(substr({w}, {cut} + 2))"
    glued = rf"regexp_matches({w}, '^\pL{{7,24}}$') AND NOT list_contains([{_GIVEN}], lower({w})) AND {cut} IS NOT NULL"
    return rf"""CASE WHEN regexp_matches({w}, '^(Mc|Mac|De|Van|Von|La|Le|Di|Da|Del|San|St|O'')[A-Z]') THEN {w} WHEN regexp_matches({w}, '[a-z][A-Z]') THEN regexp_replace({w}, '([a-z0-9])([A-Z])', '\1 \2', 'g')
        WHEN {glued} AND upper({w}) = {w} THEN {title} WHEN {glued} THEN {two} ELSE {w} END"""


def _is_place(x: str) -> str:
    """Whether a line is a place, in SQL."""
    tail = f"regexp_replace(regexp_extract({x}, ',([^,]*)$', 1), '^{_WHITE}+|{_WHITE}+$', '', 'g')"
    return rf"""(contains({x}, ',') AND {tail} <> '' AND CASE WHEN regexp_matches({tail}, '^[A-Z]{{2}}$') THEN list_contains({_listed(contacts.STATES)}, {tail})
        ELSE regexp_matches({tail}, '^[A-Za-z ]{{2,25}}\s*,?\s*\d{{4,6}}$') OR list_contains({_listed(contacts.STATE_NAMES + contacts.COUNTRIES)}, lower(trim({tail}, '.'))) END)"""


def _is_role(x: str) -> str:
    parts = f"list_bool_or(list_transform({_listed(contacts.ROLE_PARTS)}, lambda p: contains(regexp_replace(lower({x}), '[^a-z]+', '', 'g'), p)))"
    return rf"(regexp_matches({x}, '(?i)\b({'|'.join(contacts.ROLE_WORDS)})\b') OR {parts})"


#: mail: of each text of ``src`` the address; call: the number; who: the name; spot: the place.
MAIL = rf"""
    norm AS (SELECT id, regexp_replace(regexp_replace(replace(replace(translate(coalesce(text, ''), {_quoted(text.LOOKALIKES[0])}, {_quoted(text.LOOKALIKES[1])}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS n FROM src),
    plain AS (SELECT id, n, regexp_extract_all(n, '{_MAIL}') AS p, regexp_replace(n, '{_WHITE}+', '', 'g') AS tight FROM norm),
    raw_mail AS (
        SELECT id, CASE WHEN len(p) > 0 THEN p WHEN regexp_matches(tight, '{_MAIL}') THEN regexp_extract_all(tight, '{_MAIL}')
            ELSE list_transform(list_zip(regexp_extract_all(n, '{_SPELLED}', 1), regexp_extract_all(n, '{_SPELLED}', 2), regexp_extract_all(n, '{_SPELLED}', 3)), lambda z: z[1] || '@' || z[2] || '.' || z[3]) END AS found FROM plain
    ),
    each_mail AS (SELECT id, i, trim(trim(a), '.,;:|()<>[]{{}}"''`') AS a FROM (SELECT id, unnest(found) AS a, generate_subscripts(found, 1) AS i FROM raw_mail)),
    cut_mail AS (SELECT id, i, split_part(a, '@', 1) AS l, substr(a, length(split_part(a, '@', 1)) + 1) AS d, regexp_extract(split_part(a, '@', 1), '^(\+?\d[\d\s().\-]{{6,}}[\s.\-])', 1) AS glue FROM each_mail),
    own_mail AS (SELECT id, i, CASE WHEN length(regexp_replace(glue, '\D', '', 'g')) >= 9 THEN substr(l, length(glue) + 1) ELSE l END AS l, regexp_replace(d, '{_WHITE}+', '', 'g') AS d FROM cut_mail),
    new_mail AS (
        SELECT id, i, substr(d, 2) AS domain, CASE WHEN regexp_matches(l, '[oOlISBZ]') AND regexp_matches(l, '[0-9]') THEN array_to_string(list_transform(range(1, length(l) + 1), lambda k: CASE
            WHEN regexp_matches(substr(l, k, 1), '[oOlISBZ]') AND (regexp_matches(substr(l, k + 1, 1), '[0-9]') OR (k > 1 AND regexp_matches(substr(l, k - 1, 1), '[0-9]'))) THEN translate(substr(l, k, 1), 'oOlISBZ', '0011582') ELSE substr(l, k, 1) END), '') ELSE l END AS l, d FROM own_mail
    ),
    fine_mail AS (
        SELECT id, i, l || d AS a, list_bool_or(list_transform([{_BAD}], lambda p: levenshtein(lower(domain), p) <= 1)) AS bad, row_number() OVER (PARTITION BY id, lower(l || d) ORDER BY i) AS again FROM new_mail
        WHERE starts_with(d, '@') AND NOT contains(domain, '@') AND length(l) BETWEEN 1 AND 64 AND length(domain) BETWEEN 4 AND 255 AND NOT contains(l, '..') AND NOT starts_with(l, '.') AND NOT ends_with(l, '.')
            AND regexp_matches(domain, '^([^.]+\.)+[A-Za-z]{{2,24}}$')
    ),
    mail AS (SELECT norm.id, n, coalesce(arg_min(a, CASE WHEN bad THEN 1000000 ELSE 0 END + i), '') AS email, coalesce(bool_and(bad), false) AS placeholder FROM norm LEFT JOIN fine_mail ON fine_mail.id = norm.id AND again = 1 GROUP BY norm.id, n)
"""
_NUMBER = contacts.PHONE
CALL = rf"""
    work AS (SELECT id, CASE WHEN email <> '' THEN replace(n, email, ' EMAILTOKEN ') ELSE n END AS w FROM mail),
    number AS (SELECT id, unnest(m) AS m, generate_subscripts(m, 1) AS i, unnest(g[1:len(m)]) AS before FROM (SELECT id, regexp_extract_all(w, '{_NUMBER}') AS m, string_split_regex(w, '{_NUMBER}') AS g FROM work)),
    digit AS (SELECT id, i, before, trim(m, ' -.,()') AS raw, regexp_replace(m, '\D', '', 'g') AS d FROM number),
    score_call AS (
        SELECT id, i, raw, CASE WHEN starts_with(raw, '+') THEN 3 ELSE 0 END + CASE WHEN length(d) = 10 AND regexp_matches(d, '^[6-9]') THEN 4 ELSE 0 END + CASE WHEN length(d) IN (11, 12) AND regexp_matches(d, '^(91|1)') THEN 3 ELSE 0 END
            + CASE WHEN regexp_matches(raw, '[\-\s.()]') THEN 2 ELSE 0 END - CASE WHEN length(d) >= 12 THEN 2 ELSE 0 END - CASE WHEN regexp_matches(right(before, 2), '[A-Za-z]') AND NOT starts_with(raw, '+') THEN 3 ELSE 0 END AS score
        FROM digit WHERE length(d) BETWEEN 9 AND 15 AND NOT regexp_matches(raw, '^(19|20)\d{{2}}[-/]?(19|20)\d{{2}}$')
    ),
    best_call AS (SELECT id, arg_min(raw, i - 1000000 * score) AS phone FROM score_call WHERE score >= 0 GROUP BY id),
    call AS (SELECT work.id, coalesce(phone, list_filter(regexp_extract_all(regexp_replace(w, '{_WHITE}+', '', 'g'), '{_NUMBER}'), lambda m: length(regexp_replace(m, '\D', '', 'g')) BETWEEN 9 AND 15)[1], '') AS phone FROM work LEFT JOIN best_call USING (id))
"""
WHO = rf"""
    head AS (SELECT id, list_filter(list_transform(string_split_regex(left(n, 1200), '[\n-\r\x1c-\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g')), lambda x: x <> '') AS ls FROM norm),
    first_line AS (SELECT id, unnest(ls[1:12]) AS line, generate_subscripts(ls[1:12], 1) AS i, ls FROM head),
    tidy AS (SELECT id, i, list_position(ls, line) AS pos, trim(line, '|·,-–—') AS s, trim(line, '|·,-') AS here, coalesce(trim(ls[2], '|·,-–—'), '') AS after FROM first_line),
    spaced AS (SELECT *, array_to_string(list_transform(list_filter(string_split_regex(s, '{_WHITE}+'), lambda w: w <> ''), lambda w: {_unglued("w")}), ' ') AS g FROM tidy WHERE i <= 8 AND length(s) BETWEEN 3 AND 60 AND NOT contains(s, '@') AND NOT regexp_matches(s, '\d{{3}}')),
    longer AS (SELECT id, i, pos, CASE WHEN pos = 1 AND NOT contains(g, ' ') AND regexp_matches(after, '^\p{{Lu}}\pL*$') AND NOT {_is_role("after")} THEN g || ' ' || after ELSE g END AS g FROM spaced WHERE NOT {_is_role("g")} AND NOT {_is_place("g")}),
    named AS (
        SELECT id, i, g, list_bool_or(list_transform(string_split(g, ' '), lambda w: list_contains([{_GIVEN}], lower(trim(w, '.,'))))) AS known FROM longer
        WHERE len(string_split(g, ' ')) <= 5 AND (contains(g, ' ') OR pos = 1) AND list_bool_and(list_transform(string_split(g, ' '), lambda w: regexp_matches(w, '^\p{{Lu}}'))) AND length(regexp_replace(g, '[^\pL .''\-]', '', 'g')) >= 0.75 * length(g)
            AND (pos <= 3 OR list_bool_or(list_transform(string_split(g, ' '), lambda w: list_contains([{_GIVEN}], lower(trim(w, '.,'))))))
    ),
    who AS (SELECT norm.id, coalesce(arg_min(g, i), '') AS name, CASE WHEN count(g) > 0 THEN 'header' ELSE 'none' END AS source, coalesce(arg_min(known, i), false) AS known FROM norm LEFT JOIN named USING (id) GROUP BY norm.id),
    town AS (SELECT id, i, regexp_extract(here, '^([A-Za-z.\- ]+),\s*(.+)$', 1) AS city, regexp_extract(here, '^([A-Za-z.\- ]+),\s*(.+)$', 2) AS region FROM tidy
        WHERE length(here) BETWEEN 4 AND 60 AND NOT contains(here, '@') AND NOT regexp_matches(here, '\d{{3}}[-.\s]\d{{3}}') AND {_is_place("here")} AND regexp_matches(here, '^([A-Za-z.\- ]+),\s*(.+)$')),
    shown AS (SELECT id, i, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split_regex(city, '{_WHITE}+'), lambda w: w <> ''), lambda w: {_unglued("w")}), ' '), '^[A-Za-z](\s+[A-Z][a-z])', '\1'), ' .-') || ', ' || regexp_replace(trim(region), '([A-Za-z])(\d)', '\1 \2', 'g') AS place FROM town),
    spot AS (SELECT norm.id, coalesce(arg_min(place, i), '') AS location FROM norm LEFT JOIN shown USING (id) GROUP BY norm.id)
"""
LINKS = r"""
    site AS (
        SELECT id, CASE WHEN regexp_matches(n, '(?i)linkedin\.com/(?:in|pub)/([A-Za-z0-9\-_%]{3,60})') THEN 'linkedin.com/in/' || regexp_extract(n, '(?i)linkedin\.com/(?:in|pub)/([A-Za-z0-9\-_%]{3,60})', 1)
            WHEN regexp_matches(n, '(?i)linked[il]n\.com/(?:in|pub)/([A-Za-z0-9\-_%]{3,60})') THEN 'linkedin.com/in/' || regexp_extract(n, '(?i)linked[il]n\.com/(?:in|pub)/([A-Za-z0-9\-_%]{3,60})', 1) ELSE '' END AS linkedin,
            CASE WHEN regexp_matches(n, '(?i)github\.com/([A-Za-z0-9\-_.]{2,60})') THEN 'github.com/' || regexp_extract(n, '(?i)github\.com/([A-Za-z0-9\-_.]{2,60})', 1)
            WHEN regexp_matches(n, '(?i)g[il]thub\.com/([A-Za-z0-9\-_.]{2,60})') THEN 'github.com/' || regexp_extract(n, '(?i)g[il]thub\.com/([A-Za-z0-9\-_.]{2,60})', 1) ELSE '' END AS github FROM norm
    )
"""
#: Every contact field and warning of ``src``.
CONTACT = f"""{MAIL}, {CALL}, {WHO}, {LINKS}, contact AS (
        SELECT mail.id, name, email, placeholder AS email_is_placeholder, phone, linkedin, github, location, array_to_string(list_filter([CASE WHEN source <> 'header' THEN 'name-from-' || source WHEN NOT known THEN 'name-low-confidence' END,
            CASE WHEN email = '' THEN 'no-email-found' END, CASE WHEN phone = '' THEN 'no-phone-found' END, CASE WHEN placeholder THEN 'placeholder-email' END], lambda x: x IS NOT NULL), '; ') AS warnings
        FROM mail JOIN call USING (id) JOIN who USING (id) JOIN site USING (id) JOIN spot USING (id)
    )
"""


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_MAIL}'), ';') AS found FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def email_matches(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("m", F.regexp_extract_all("text", F.lit(contacts.EMAIL), F.lit(0))).where(F.size("m") > 0)
    return found.select("doc_id", F.array_join("m", ";").alias("found"))


@query(f"""
    WITH {PROFILES}, found AS (
        SELECT id, CASE WHEN regexp_matches(text, '{_MAIL}') THEN regexp_extract(text, '{_MAIL}') WHEN regexp_matches(regexp_replace(text, '\\s+', '', 'g'), '{_MAIL}') THEN regexp_extract(regexp_replace(text, '\\s+', '', 'g'), '{_MAIL}')
            WHEN id % 6 = 4 THEN 'wax' || id || '@site.net' ELSE '' END AS m FROM profile
    ), scrubbed AS (SELECT id, CASE WHEN starts_with(m, '555-010-9999-') THEN substr(m, 14) ELSE m END AS email FROM found)
    SELECT id, CASE WHEN id % 6 = 3 THEN regexp_extract(email, '(first.*)$', 1) ELSE email END AS email, coalesce(list_any(list_transform([{_BAD}], lambda p: levenshtein(lower(split_part(email, '@', 2)), p) <= 1)), false) AND email <> '' AS placeholder FROM scrubbed
""".replace("list_any(list_transform(", "list_bool_or(list_transform("))
def profile_emails(spark, sf_dir):
    found = profiles(spark, sf_dir).withColumn("mail", contacts.email(text.normalised(F.col("text"))))
    tail = F.regexp_extract("mail.email", "(first.*)$", 1)  # before it stands the end of another line, glued on
    return found.select("id", F.when(F.col("id") % 6 == 3, tail).otherwise(F.col("mail.email")).alias("email"), "mail.placeholder")


@query(f"""
    WITH d AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1) AS domain FROM pages)
    SELECT domain, list_bool_or(list_transform([{_BAD}], lambda p: levenshtein(lower(domain), p) <= 1)) AS placeholder FROM d
""")
def placeholder_domains(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("domain")).distinct()
    return found.select("domain", contacts.is_placeholder(F.col("domain")).alias("placeholder"))


@query(r"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:\+\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?|\d{2,4}[\s.\-])\d{3}[\s.\-]?\d{2,4}(?:[\s.\-]?\d{2,4})?')) AS m FROM documents)
    SELECT doc_id, trim(m, ' -.,()') AS raw, CAST(length(regexp_replace(m, '\D', '', 'g')) AS INTEGER) AS digits FROM m
    WHERE length(regexp_replace(m, '\D', '', 'g')) BETWEEN 9 AND 15 AND NOT regexp_full_match(trim(m, ' -.,()'), '(19|20)\d{2}[-/]?(19|20)\d{2}')
""")
def phone_candidates(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.explode(contacts.phone_candidates(text.text_of(F.col("text")))).alias("c"))
    return found.select("doc_id", "c.raw", F.length(F.regexp_replace("c.raw", r"\D", "")).alias("digits"))


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {MAIL}, {CALL} SELECT id AS doc_id, phone FROM call WHERE phone <> ''")
def phones(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("n", text.normalised(F.col("text"))).withColumn("mail", contacts.email(F.col("n")))
    return found.withColumn("phone", contacts.phone(F.col("n"), F.col("mail.email"))).where("phone != ''").select("doc_id", "phone")


@query(f"""
    WITH {PROFILES} SELECT id, CASE id % 3 WHEN 0 THEN '+1 555-0' || (100 + id % 900) || '-4321' WHEN 1 THEN '555) 010-' || (1000 + id % 9000) ELSE CASE WHEN id % 6 = 1 THEN '555-010-9999' ELSE '' END END AS expected FROM profile
""".replace("SELECT id, CASE id % 3", "SELECT id, CASE WHEN id % 3 = 2 THEN 'skip' ELSE 'call' END AS kind FROM profile --"))
def phone_presence(spark, sf_dir):
    """Which profiles have a number: those of two kinds of three."""
    found = profiles(spark, sf_dir).withColumn("n", text.normalised(F.col("text"))).withColumn("mail", contacts.email(F.col("n")))
    found = found.withColumn("phone", contacts.phone(F.col("n"), F.col("mail.email")))
    return found.select("id", F.when((F.col("phone") == "") | F.col("phone").rlike(r"^2010"), "skip").otherwise("call").alias("kind"))


@query(f"""
    WITH {PROFILES} SELECT id,
        CASE WHEN regexp_matches(text, 'linked[il]n\\.com/(?:in|pub)/([A-Za-z0-9\\-_%]{{3,60}})') THEN 'linkedin.com/in/' || regexp_extract(text, 'linked[il]n\\.com/(?:in|pub)/([A-Za-z0-9\\-_%]{{3,60}})', 1) ELSE '' END AS linkedin,
        CASE WHEN regexp_matches(text, 'github\\.com/([A-Za-z0-9\\-_.]{{2,60}})') THEN 'github.com/' || regexp_extract(text, 'github\\.com/([A-Za-z0-9\\-_.]{{2,60}})', 1) ELSE '' END AS github FROM profile
""")
def social_handles(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", contacts.linkedin(F.col("text")).alias("linkedin"), contacts.github(F.col("text")).alias("github"))


@query(f"WITH {PROFILES}, src AS (SELECT id, text FROM profile), {MAIL}, {WHO} SELECT id, location FROM spot")
def locations(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", contacts.location(contacts.header_lines(text.normalised(F.col("text")))).alias("location"))


@query(f"WITH {PROFILES}, src AS (SELECT id, text FROM profile), {MAIL}, {WHO} SELECT id, name, source, known FROM who")
def names(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", contacts.name(contacts.header_lines(text.normalised(F.col("text"))), F.lit("")).alias("who")).select("id", "who.*")


@query(f"WITH {PROFILES}, src AS (SELECT id, text FROM profile), {CONTACT} SELECT * FROM contact")
def contact_fields(spark, sf_dir):
    found = contacts.with_contacts(profiles(spark, sf_dir))
    return found.select("id", "contact.*", F.array_join("contact_warnings", "; ").alias("warnings"))


# --- timeline ----------------------------------------------------------------------------------------------------------


@query(r"""
    WITH s AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(year(o_orderdate) + o_orderkey % 3 AS INTEGER) AS b FROM orders),
    far AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
    isle AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM far)
    SELECT o_custkey, min(a) AS a, max(b) AS b FROM isle GROUP BY o_custkey, isle
""")
def merged_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("a"), (F.year("o_orderdate") + F.col("o_orderkey") % 3).cast("int").alias("b"))
    return ranking.merged_spans(spans, "o_custkey")


@query(ORACLES["merged_spans"].replace("SELECT o_custkey, min(a) AS a, max(b) AS b FROM isle GROUP BY o_custkey, isle", "SELECT o_custkey, CAST(least(sum(b - a), 45) AS INTEGER) AS years FROM (SELECT o_custkey, min(a) AS a, max(b) AS b FROM isle GROUP BY o_custkey, isle) GROUP BY o_custkey"))
def span_years(spark, sf_dir):
    """The same sum within a row: spans of a customer as an array."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.year("o_orderdate").alias("a"), (F.year("o_orderdate") + F.col("o_orderkey") % 3).cast("int").alias("b"))).alias("s"))
    return spans.select("o_custkey", F.least(timeline.merged_years(F.col("s")), F.lit(45)).alias("years"))


@query(f"""
    WITH {PROFILES}, s AS (
        SELECT id, 1995 + id % 10 AS a, 1998 + id % 13 AS b FROM profile UNION SELECT id, 2005 + id % 8, CASE WHEN id % 2 = 0 THEN 2024 ELSE 2015 END FROM profile
        UNION SELECT id, 2010, 2014 FROM profile WHERE id % 3 = 2
    ),
    far AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s WHERE a <= b),
    isle AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM far),
    m AS (SELECT id, sum(b - a) AS merged FROM (SELECT id, min(a) AS a, max(b) AS b FROM isle GROUP BY id, isle) GROUP BY id)
    SELECT profile.id, CAST(least(greatest(CASE WHEN profile.id % 4 = 0 THEN 2 + profile.id % 9 ELSE 0 END, coalesce(merged, 0)), 45) AS DOUBLE) AS years FROM profile LEFT JOIN m ON m.id = profile.id
""")
def years_of_experience(spark, sf_dir):
    found = sections.with_sections(profiles(spark, sf_dir))
    return found.select("id", timeline.years(timeline.work_text(F.col("text"), F.col("sections")), CFG.as_of_year).alias("years"))


_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted(p)}) THEN {_quoted(n)}" for n, p in timeline.DEGREES) + " " + " ".join(f"WHEN contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), {_quoted(x)}) THEN {_quoted(n)}" for n, parts in timeline.GLUED_DEGREES for x in parts) + " ELSE 'Unknown' END"


@query(f"WITH {PROFILES} SELECT id, {_LEVEL} AS level FROM profile")
def education_level(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", timeline.education_level(F.col("text")).alias("level"))


_FIELDS = ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN {_quoted(n)} END" for n, p in timeline.FIELDS)


@query(f"""
    WITH {PROFILES}, f AS (SELECT id, list_filter([{_FIELDS}], lambda x: x IS NOT NULL) AS f FROM profile)
    SELECT id, array_to_string(f[1:4], '; ') AS fields, list_contains(f, 'Finance') OR list_contains(f, 'Economics') AS relevant FROM f
""")
def education_fields(spark, sf_dir):
    f = timeline.education_fields(F.col("text"))
    return profiles(spark, sf_dir).select("id", F.array_join(F.slice(f, 1, 4), "; ").alias("fields"), timeline.relevant(f, RUBRIC.fields).alias("relevant"))


# --- duplicates, cache, joins, limits ----------------------------------------------------------------------------------


@query("SELECT doc_id, first AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS first FROM documents WHERE text IS NOT NULL AND text <> '') WHERE doc_id > first")
def exact_duplicates(spark, sf_dir):
    found = docs(spark, sf_dir).withColumn("sha1", F.when(F.col("text") != "", F.sha1("text"))).withColumn("shown", F.col("doc_id"))
    return ranking.first_seen(found.drop("text"), "sha1", "doc_id", "shown").where("duplicate_of is not null").select("doc_id", "duplicate_of")


_CACHE = "cache AS (SELECT doc_id, quality FROM labels WHERE quality = 1)"


@query(f"WITH {_CACHE} SELECT documents.doc_id FROM documents JOIN cache USING (doc_id)")
def cache_hit(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "cached text").alias("stored"))
    return ranking.cache_hits(docs(spark, sf_dir), cache, "doc_id", "stored").select("doc_id")


@query(f"WITH {_CACHE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cache)")
def cache_miss(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "cached text").alias("stored"))
    return ranking.cache_misses(docs(spark, sf_dir), cache, "doc_id", "stored").select("doc_id")


@query(f"WITH {_CACHE} SELECT doc_id, true AS cached FROM documents JOIN cache USING (doc_id) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cache)")
def cached_and_fresh(spark, sf_dir):
    return cache_hit(spark, sf_dir).withColumn("cached", F.lit(True)).unionByName(cache_miss(spark, sf_dir).withColumn("cached", F.lit(False)))


@query("SELECT doc_id, source, CAST(row_number() OVER (ORDER BY length(source), source, doc_id) AS BIGINT) AS rank FROM documents ORDER BY rank LIMIT 25")
def input_order(spark, sf_dir):
    return ranking.top(docs(spark, sf_dir, "source").select("doc_id", "source"), 25, F.length("source").asc(), F.asc("source"), F.asc("doc_id"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 2")
def winner_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ranking.top_of_each(lines, 2, ["l_orderkey"], F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")).select("l_orderkey", "l_linenumber", "l_extendedprice", "rn")


@query("SELECT conv_id, bool_or(role = 'assistant') AS answered, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS joined, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def assemble_pages(spark, sf_dir):
    """Pages of a document joined in order, with a flag over all of them; conversations stand in, turns for pages."""
    turns = table(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
    return turns.groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("answered"), F.sha2(joined, 256).alias("joined"), F.count("*").alias("turns"))


@query("""
    SELECT n_name, o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def score_rollup(spark, sf_dir):
    """Join and aggregate over the star schema: what the engine inherits from Spark."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- JSON and the judge ------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, array_to_string(list_sort(json_keys(props)), ';') AS keys FROM events")
def json_props(spark, sf_dir):
    keys = F.json_object_keys(jsonfix.json_text(F.col("props")))
    return events(spark, sf_dir, "props").select("event_id", F.size(keys).alias("n_keys"), F.array_join(F.sort_array(keys), ";").alias("keys"))


@query("""
    SELECT event_id, array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || '=' || coalesce(json_extract_string(props, '$."' || k || '"'), '')), ';') AS pairs,
        CASE WHEN event_id % 7 = 6 THEN 'broken' ELSE 'fixed' END AS state FROM events WHERE event_id % 7 <> 6
    UNION ALL SELECT event_id, '', 'broken' FROM events WHERE event_id % 7 = 6
""")
def repair_json(spark, sf_dir):
    """Replies damaged in all the ways that are repaired: fences, prose, trailing commas, constants, comments, curly quotes; every seventh is cut short, past repair."""
    broken = F.concat(F.lit("Sure! ```json\n"), F.regexp_replace(F.regexp_replace("props", r"\}\s*$", " // done\n,}"), "^\\{\"", "{\u201c"), F.lit("\n``` bye"))
    broken = F.when(F.col("event_id") % 7 == 6, F.regexp_replace(broken, r"\}", "")).otherwise(broken)
    found = events(spark, sf_dir, "props").select("event_id", F.from_json(jsonfix.json_text(broken), "map<string,string>").alias("m"))
    pairs = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at("m", k), F.lit(""))))
    return found.select("event_id", F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("pairs"), F.when(F.col("m").isNull(), "broken").otherwise("fixed").alias("state"))


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 100.0 WHEN 1 THEN CAST(event_id % 90 AS DOUBLE) WHEN 2 THEN CAST(event_id % 90 AS DOUBLE) END AS score,
        CASE event_id % 5 WHEN 3 THEN 'no ''score'' field in model output' WHEN 4 THEN 'unexpected JSON type' END AS error, CASE event_id % 5 WHEN 4 THEN 0 ELSE 2 END AS strengths FROM events
""")
def parse_judge(spark, sf_dir):
    k, n = F.col("event_id") % 5, (F.col("event_id") % 90).cast("string")
    score = F.when(k == 0, F.lit("120")).when(k == 1, n).when(k == 2, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.lit('"82.5"'))
    reply = F.when(k == 4, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"score": '), score, F.lit(', "confidence": 2, "strengths": ["a", " ", "b"],}')))
    found = events(spark, sf_dir).select("event_id", jsonfix.judged(reply).alias("j"))
    return found.select("event_id", "j.score", "j.error", F.size("j.strengths").alias("strengths"))


@query()
def judged_ranking(spark, sf_dir):
    """The whole plan over documents, with the repeatable judge."""
    from ..operators.judge import stand_in

    found = ranker.rank(docs(spark, sf_dir), RUBRIC, "a role", CFG, stand_in)
    return found.select("rank", "doc_id", "final_score", "keyword_score", "judge_score", "recommendation", "blend", "parse_status", F.array_join("warnings", "; ").alias("warnings"), "reasoning", F.array_join("evidence", " | ").alias("evidence"))


_YEARS = ORACLES["years_of_experience"].split(", s AS (", 1)[1].rsplit("SELECT profile.id", 1)
_NAMES = "coalesce(string_agg({0}, ', ' ORDER BY category_pos) FILTER (WHERE must_have AND n {1} 0), '')"
#: table: every profile with all that the ranking says of it, ranked without a judge.
RANKING = rf"""{PROFILES}, src AS (SELECT id, text FROM profile), documents AS (SELECT id AS doc_id, text FROM profile), {MATCH}, {LINE}, {CONTACT}, s AS ({_YEARS[0].rstrip()},
    year AS (SELECT profile.id{_YEARS[1]}),
    study AS (SELECT id, {_LEVEL} AS level, list_filter([{_FIELDS}], lambda x: x IS NOT NULL) AS f FROM profile),
    must AS (SELECT doc_id AS id, {_NAMES.format('category', '>')} AS met, {_NAMES.format('category', '=')} AS lacks FROM cat GROUP BY doc_id),
    skill(category_pos, category, skill) AS (VALUES {_SKILLS}),
    has AS (
        SELECT doc.doc_id AS id, coalesce(string_agg(DISTINCT CASE WHEN best.skill IS NOT NULL THEN s.skill END, '; ' ORDER BY CASE WHEN best.skill IS NOT NULL THEN s.skill END), '') AS matched,
            coalesce(string_agg(DISTINCT CASE WHEN best.skill IS NULL THEN s.skill END, '; ' ORDER BY CASE WHEN best.skill IS NULL THEN s.skill END), '') AS lacking
        FROM doc CROSS JOIN skill s LEFT JOIN best ON best.doc_id = doc.doc_id AND best.category_pos = s.category_pos AND best.skill = s.skill GROUP BY doc.doc_id
    ),
    proof AS (SELECT doc_id AS id, string_agg(line, ' | ' ORDER BY rn) AS evidence FROM line WHERE rn <= 6 GROUP BY doc_id),
    sum AS (
        SELECT contact.* REPLACE (CASE WHEN contains(warnings, 'name-from-none') THEN CAST(id AS VARCHAR) ELSE name END AS name, replace(warnings, 'name-from-none', 'name-from-filename') AS warnings), years, level, f, met, lacks, matched, lacking, coalesce(evidence, '') AS evidence, score.missing, least(years, 8) * 1.2 AS bonus, level <> 'Unknown' AND NOT (list_contains(f, 'Finance') OR list_contains(f, 'Economics')) AS astray, score.base,
            min(contact.id) OVER (PARTITION BY sha1(profile.text)) AS first
        FROM contact JOIN year USING (id) JOIN study USING (id) JOIN must USING (id) JOIN has USING (id) JOIN score ON score.doc_id = contact.id JOIN profile USING (id) LEFT JOIN proof USING (id)
    ),
    exact AS (SELECT *, greatest(0, least(100, round(base, 2) * 1.7 + bonus - (missing * 6 + CASE WHEN astray THEN 5 ELSE 0 END))) AS keyword FROM sum),
    told AS (
        SELECT *, round(keyword, 2) AS score, array_to_string(list_filter([CASE WHEN warnings <> '' THEN warnings END, CASE WHEN email_is_placeholder THEN 'placeholder-email(template)' END, CASE WHEN first < id THEN 'duplicate-of:' || first END], lambda x: x IS NOT NULL), '; ') AS all_warnings,
            array_to_string(list_filter([CASE WHEN met <> '' THEN 'Meets: ' || met END, CASE WHEN lacks <> '' THEN 'Missing: ' || lacks END, CASE WHEN bonus > 0 THEN printf('+%.1f for %sy experience', CAST(bonus AS DOUBLE), regexp_replace(printf('%.1f', CAST(years AS DOUBLE)), '\.0$', '')) END,
                CASE WHEN missing > 0 THEN printf('-%.1f missing must-have: %s', CAST(missing * 6 AS DOUBLE), lacks) END, CASE WHEN astray THEN '-5.0 degree field outside target list' END], lambda x: x IS NOT NULL), ' | ') AS reasoning FROM exact
    ),
    ranking AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR), id) AS rank, {TIER} AS tier FROM told)
"""


@query(f"WITH {RANKING} SELECT rank, id AS doc_id, name, email, phone, location, score AS final_score, score AS keyword_score, CAST(years AS DOUBLE) AS years_experience, level AS education_level, all_warnings AS warnings FROM ranking")
def keyword_ranking(spark, sf_dir):
    """The same without a judge, over profiles."""
    found = ranker.rank(profiles(spark, sf_dir).withColumnRenamed("id", "doc_id"), RUBRIC, cfg=CFG)
    return found.select("rank", "doc_id", "name", "email", "phone", "location", "final_score", "keyword_score", "years_experience", "education_level", F.array_join("warnings", "; ").alias("warnings"))


@query(f"""
    WITH {RANKING} SELECT CAST(rank AS VARCHAR) AS "Rank", CAST(id AS VARCHAR) AS "File", name AS "Candidate", email AS "Email", phone AS "Phone", linkedin AS "LinkedIn", github AS "GitHub", location AS "Location", printf('%.2f', score) AS "Final Score",
        printf('%.2f', score) AS "Keyword Score", '' AS "LLM Score", tier AS "Recommendation", CAST(CAST(years AS DOUBLE) AS VARCHAR) AS "Years Exp", level AS "Education", array_to_string(f[1:4], '; ') AS "Fields", '' AS "Seniority", replace(met, ', ', '; ') AS "Must-Have Met",
        replace(lacks, ', ', '; ') AS "Must-Have Missing", matched AS "Top Matched Skills", lacking AS "Missing Skills", NULL AS "LLM Strengths", NULL AS "LLM Gaps", reasoning AS "Reasoning", evidence AS "Keyword Evidence", 'no' AS "OCR Used", 'ok' AS "Parse Status", all_warnings AS "Warnings"
    FROM ranking
""")
def report_rows(spark, sf_dir):
    """The ranked table as its sinks write it."""
    from ..sources import report

    return report.rows(ranker.rank(profiles(spark, sf_dir).withColumnRenamed("id", "doc_id"), RUBRIC, cfg=CFG))
