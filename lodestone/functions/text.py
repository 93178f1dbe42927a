"""Text helpers as column expressions. White space and line ends are those of Unicode, as Python sees them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, and what ends a line.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"[\n-\r\x1c-\x1e\x85\u2028\u2029]"

#: Section headings by name, in the order they are tried; a heading begins its line.
SECTIONS = [
    ("summary", r"(professional\s+)?(summary|objective|profile|about( me)?)"),
    ("experience", r"(work\s+|professional\s+|employment\s+|relevant\s+)?(experience|history|employment)"),
    ("education", r"(education|academics?|academic\s+(background|qualifications?))"),
    ("skills", r"(technical\s+|core\s+)?(skills|competencies|technologies|tools?|tech\s+stack|proficiencies)"),
    ("projects", r"(projects?|portfolio|key\s+projects?|personal\s+projects?)"),
    ("certifications", r"(certifications?|licenses?|credentials?|professional\s+development|training)"),
    ("publications", r"(publications?|research|papers?|patents?)"),
    ("awards", r"(awards?|honors?|achievements?|accomplishments?)"),
    ("interests", r"(interests?|hobbies|activities|extracurricular)"),
]
#: Look-alikes and what they stand for, one for one, then ligatures.
LOOKALIKES = ("\u2013\u2014\u2212\u2018\u2019\u201c\u201d\u2022\u00b7\u25cf\u00a0", "---''\"\"--- ")
LIGATURES = [("\ufb01", "fi"), ("\ufb02", "fl")]


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column, of: str = WHITE) -> Column:
    """Without leading and trailing characters of a class."""
    return F.regexp_replace(c, f"^{of}+|{of}+$", "")


def squash(c: Column) -> Column:
    """Lower case, letters a-z and digits only: what containment is tested on."""
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "")


def squash_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(text_of(c)), f"{WHITE}+", " ")


def clean_lines(c: Column) -> Column:
    """Lines that aren't blank, each with single spaces."""
    return F.filter(F.transform(F.split(text_of(c), LINE_END, -1), squash_spaces), lambda x: x != "")


def cleanup(c: Column) -> Column:
    """Page text as extracted: ligatures, runs of blanks and of line feeds."""
    out = F.replace(text_of(c), F.lit("\u00a0"), F.lit(" "))
    for bad, good in LIGATURES:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def normalised(c: Column) -> Column:
    """Look-alikes of dashes, quotes and bullets made plain."""
    out = F.translate(text_of(c), *LOOKALIKES)
    for bad, good in LIGATURES:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def word_count(c: Column) -> Column:
    s = strip(text_of(c))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, f"{WHITE}+"))).cast("int")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(text_of(c), r"\P{L}", ""))


def section_of(line: Column) -> Column:
    """The section a line opens, "other" for a heading of no known section, null for none."""

    def named(s: Column) -> Column:
        found = F.when((s == "") | (F.length(s) > 60), None)
        for name, pattern in SECTIONS:
            found = found.when(s.rlike(rf"(?i)^\s*{pattern}\b"), F.lit(name))
        inked = F.regexp_replace(s, r"\P{L}", "")
        shout = F.length(F.regexp_replace(inked, r"\P{Lu}", "")) > 0.8 * F.length(inked)
        return found.when(s.rlike(r"^[A-Z][A-Za-z /&'\-]{2,48}$") & (inked != "") & shout & (word_count(s) <= 5), F.lit("other"))

    return let(strip(strip(line), r"[:·\-|]"), named)


def snippet(c: Column, start: Column, end: Column, pad: int = 45) -> Column:
    """What stands around characters start (from 0) to end, with an ellipsis on each side that is cut."""
    lo = F.greatest(F.lit(0), start - pad)
    hi = F.least(F.length(c), end + pad)
    return F.concat(F.when(lo > 0, "…").otherwise(""), squash_spaces(F.substring(c, lo + 1, hi - lo)), F.when(hi < F.length(c), "…").otherwise(""))


def alias_pattern(alias: str, short: bool) -> str:
    """A regex that finds an alias in raw text: short ones as words, long ones with anything but letters and digits between."""
    if short:
        return rf"(?i)(?<![A-Za-z0-9]){java_quote(alias)}(?:s|es)?(?![A-Za-z0-9])"
    return "(?i)" + "[^A-Za-z0-9]*".join(re.sub("[^a-z0-9]", "", alias.lower()))


def java_quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s) if s.isascii() else "\\Q" + s + "\\E"


def pieces(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that overlap, stripped, without blank ones; a text that fits is a window as it is."""
    step = max(1, size - overlap)
    more = F.ceil((F.length(c) - size) / step).cast("int")
    many = F.transform(F.sequence(F.lit(0), more), lambda k: strip(F.substring(c, k * step + 1, F.lit(size))))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.filter(many, lambda p: p != ""))
