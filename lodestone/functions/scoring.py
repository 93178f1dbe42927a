"""Scores as column expressions; nothing is rounded unless it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoreConfig
from .text import let


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Within bounds; null stays null, which greatest and least alone would not do."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def rounded(c: Column, digits: int = 2) -> Column:
    """A number below 2**10 rounded to the nearest by its exact binary value, ties to even: 0.125 to 0.12, and 1.115, which is a little less, to 1.11.

    Spark rounds a number's decimal spelling, so only where that is a tie the binary value has to decide.
    """
    step = 10**digits

    def nearest(x: Column) -> Column:
        spelled = x.cast("string").cast("decimal(20,12)")
        low = F.floor(spelled * step)
        tie = spelled * step - low == F.lit(0.5).cast("decimal(2,1)")
        # exact: powers of two times a number of 53 bits, as integers
        small = F.abs(x) < 1
        exact = F.when(small, (x * 2.0**60).cast("long")).otherwise((x * 2.0**52).cast("long")).cast("decimal(38,12)")
        said = F.when(small, spelled.cast("decimal(13,12)") * F.lit(2**60).cast("decimal(19,0)")).otherwise(spelled.cast("decimal(16,12)") * F.lit(2**52).cast("decimal(16,0)"))
        up = F.when(exact > said, 1).when(exact < said, 0).otherwise(F.pmod(low, F.lit(2)))
        return F.when(tie, ((low + up) / step).cast("double")).otherwise(F.round(x, digits))

    return let(c.cast("double"), nearest)


def saturation(ratio: Column) -> Column:
    """The first skills of a category count most."""
    return 1 - F.exp(-3.0 * ratio)


def calibrated(base: Column, years: Column, missing: Column, level: Column, relevant: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Coverage with a gain, a bonus for years, and penalties for missing must-haves and a degree in another field."""
    bonus = F.least(years, F.lit(cfg.bonus_years)) * cfg.bonus_per_year
    return clamp(base * cfg.gain + bonus - _penalty(missing, level, relevant, cfg), 0.0, cfg.cap)


def _penalty(missing: Column, level: Column, relevant: Column, cfg: ScoreConfig) -> Column:
    return missing * cfg.must_have_penalty + F.when((level != "Unknown") & ~relevant, cfg.degree_penalty).otherwise(0.0)


def blended(keyword: Column, judge: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    if cfg.weight_judge <= 0:
        return keyword
    if cfg.weight_keyword <= 0:
        return F.coalesce(judge, keyword)
    both = (cfg.weight_keyword * keyword + cfg.weight_judge * judge) / (cfg.weight_keyword + cfg.weight_judge)
    return F.when(judge.isNull(), keyword).otherwise(clamp(both))


def blend_name(keyword: Column, judge: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    if cfg.weight_judge <= 0:
        return F.lit("deterministic-only")
    if cfg.weight_keyword <= 0:
        return F.when(judge.isNull(), "deterministic-only").otherwise("llm-only")
    text = F.format_string(f"blend {cfg.weight_keyword:g}*%.1f + {cfg.weight_judge:g}*%.1f", keyword, judge)
    return F.when(judge.isNull(), "deterministic-only").otherwise(text)


def tier(score: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    return F.when(score >= cfg.strong, "strong_fit").when(score >= cfg.moderate, "moderate_fit").otherwise("weak_fit")


def disagree(judge: Column, keyword: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Whether judge and keywords are far apart; unknown is no disagreement."""
    return F.coalesce(F.abs(judge - keyword) > cfg.disagreement, F.lit(False))


def years_disagree(own: Column, judge: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    return F.coalesce((own > 0) & (F.abs(own - judge) >= cfg.years_disagreement), F.lit(False))


def years_or(own: Column, judge: Column) -> Column:
    """The judge's years only where none were found."""
    return F.when((F.coalesce(own, F.lit(0.0)) <= 0) & judge.isNotNull(), rounded(judge, 1)).otherwise(F.coalesce(own, F.lit(0.0)))


def density(hits: Column, length: Column, section: Column) -> Column:
    """Keyword hits for 500 characters, with a boost for telling sections."""
    boost = F.when(section.isin("skills", "header", "summary"), 1.25).when(section == "projects", 1.1).otherwise(1.0)
    return hits / F.greatest(F.lit(1.0), length / 500.0) * boost


def notes(years: Column, missing: Column, level: Column, relevant: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Why a calibrated score differs from coverage; ``missing`` is the array of missing must-haves."""
    bonus = F.least(years, F.lit(cfg.bonus_years)) * cfg.bonus_per_year
    shown = F.regexp_replace(F.format_string("%.1f", years), r"\.0$", "")
    return F.array_compact(
        F.array(
            F.when(bonus > 0, F.format_string("+%.1f for %sy experience", bonus, shown)),
            F.when(F.size(missing) > 0, F.format_string("-%.1f missing must-have: %s", F.size(missing) * cfg.must_have_penalty, F.array_join(missing, ", "))),
            F.when((level != "Unknown") & ~relevant, F.format_string("-%.1f degree field outside target list", F.lit(cfg.degree_penalty))),
        )
    )
