"""Spans of a canonical title that speak of another product, blanked out in place.

A title is cut into tokens (phrases, brackets, clause marks, words, single signs) and folded from left to
right with the depth of brackets as running sums: the depth of the whole text, and the depth inside the
span that is open. What is blanked becomes as many spaces, so that offsets stay those of the title, and
brackets may be nested to any depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# Phrases after which another product is named; words that do so at the very beginning only, and what
# may not follow them there.
REFERENCES = ("comparable to", "compatible with", "replacement for", "equivalent to", "equiv to", "alternative to", "substitute for", "replaces")
DRIVE_REFERENCES = (*REFERENCES, "fit for", "suitable for")
PROCESSOR_REFERENCES = (*REFERENCES, "oem version of")
LOCK_REFERENCES = (*REFERENCES, "works with", "work with", "for use with", "for use in")
ANY_REFERENCES = (*DRIVE_REFERENCES, "oem version of", "works with", "work with", "for use with", "for use in")
FOR_PARTS = r"(?:parts|spares?|repairs?)"
LEADING = rf"^(?:for\b(?!\s+(?:sale|{FOR_PARTS})\b)|compatible\b)"


def phrase_pattern(phrases: tuple[str, ...], leading: str | None = None) -> str:
    found = rf"\b(?:{'|'.join(phrases)})\b"
    return f"{leading}|{found}" if leading else found


def masked(title: Column, phrases: tuple[str, ...] = REFERENCES, leading: str | None = None) -> Column:
    """``title`` with spaces in place of what it cites; its length is unchanged, and so is a title that cites nothing.

    A span begins at a phrase (with ``leading``, a pattern, at the title's first word, too) and ends before the next
    clause mark outside of brackets that it opened itself, before the bracket that closes the group it began in, or
    with the title. A bracket that it opens and nobody closes keeps it open.
    """
    opens = phrase_pattern(phrases, leading)
    return let(title, lambda t: F.when(t.rlike(opens), _folded(t, opens, phrases, t.rlike(leading) if leading else F.lit(False))).otherwise(t))


def _folded(title: Column, opens: str, phrases: tuple[str, ...], leads: Column) -> Column:
    tokens = F.regexp_extract_all(title, F.lit(rf"(?s)(?:{opens})|[()]| - |[,;|]|\w+|."), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(-1).alias("span"), F.lit(False).alias("inside"))

    def step(s: Column, t: Column) -> Column:
        left, right, clause = t == "(", t == ")", t.isin(" - ", ",", ";", "|")
        ends = (s["span"] == 0) & (clause | (right & s["inside"]))
        stays = (s["span"] >= 0) & ~ends
        begins = (s["span"] < 0) & (t.isin(*phrases) | ((s["out"] == "") & leads))
        now = F.struct(stays.alias("stays"), begins.alias("begins"), F.when(left, 1).when(right, -1).otherwise(0).alias("by"))

        def moved(n: Column) -> Column:
            span = F.when(n["stays"], F.greatest(s["span"] + n["by"], F.lit(0))).when(n["begins"], 0).otherwise(-1)
            said = F.when(n["stays"] | n["begins"], F.repeat(F.lit(" "), F.length(t))).otherwise(t)
            inside = F.when(n["begins"], s["depth"] > 0).otherwise(s["inside"])
            return F.struct(F.concat(s["out"], said).alias("out"), F.greatest(s["depth"] + n["by"], F.lit(0)).alias("depth"), span.alias("span"), inside.alias("inside"))

        return let(now, moved)

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def unclosed(title: Column) -> Column:
    """How many brackets a title leaves open."""
    return F.aggregate(F.regexp_extract_all(title, F.lit("[()]"), F.lit(0)), F.lit(0), lambda d, t: F.when(t == "(", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def _without(pattern: str) -> Callable[[Column], Column]:
    def blank(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"(?:{pattern})"), F.lit(0))
        gaps = F.transform(found, lambda x: F.repeat(F.lit(" "), F.length(x)))
        # what stands between, and the gaps, in turn
        pieces = F.zip_with(F.split(t, f"(?:{pattern})", -1), gaps, lambda x, gap: F.concat(x, F.coalesce(gap, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return blank


def blanked(text: Column, *patterns: str) -> Column:
    """``text`` with as many spaces in place of what any of the patterns finds, one pattern after the other."""
    for p in patterns:
        text = let(text, _without(p))
    return text
