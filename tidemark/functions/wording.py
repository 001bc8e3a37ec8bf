"""What a text asserts and what it denies: one rule of negation for lock wording and conditions alike.

Assertions are found by patterns, in order, and replaced by one sign each; then the words are folded from
left to right. A word of negation reaches the assertions that follow within WINDOW words. Qualifiers and
articles don't count as words, and neither do punctuation and hyphens. An earlier assertion ends the
reach, and so does a phrase whose negation is its own meaning ("no warranty").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of negation, words that the reach passes over, phrases that own their negation.
NEGATORS = ("not", "no", "never", "non", "without", "isn", "isnt", "aren", "arent", "ain", "aint")
QUALIFIERS = ("vendor", "psb", "dell", "lenovo", "hp", "hpe", "cisco", "factory", "manufacturer", "a", "an", "the", "cpu")
WINDOW = 3
CONTRACTED = r"\b(?:isn|aren|ain) ?'?t\b"
LOCK_OEMS = r"(?:dell|lenovo|hpe?|cisco)"
NEGATED_LOCK = (
    r"\bno[-\s]+(?:(?:vendor|psb)[-\s]+)?lock(?:ed)?\b"
    rf"|\b(?:not|isn\s?t)[-\s]+(?:(?:vendor|psb|{LOCK_OEMS})[-\s]+)?locked\b"
    r"|\bnon[-\s]?(?:(?:vendor|psb)[-\s]+)?locked\b"
)
NOT_WORKING = r"(?:non[-\s]?|not[-\s]+)(?:working|functional)"
OWN_NEGATION = rf"\b(?:no[-\s]+warranty|no[-\s]+reserve|no[-\s]+returns?|not[-\s]+tested|{NOT_WORKING}|no[-\s]+trays?|no[-\s]+cadd(?:y|ies)|no[-\s]+os|no[-\s]+cables?)\b"

#: Signs that stand for assertions and for barriers: private code points, no letters of any pattern.
_FIRST, _BARRIER = 0xE000, "\uf8ff"
_SIGN = "[\ue000-\uf8ff]"


def assertions(text: Column, patterns: list[str]) -> Column:
    """array<struct<kind, denied>> of what a text asserts, in its order; ``kind`` is the pattern's place in the list.

    Patterns that come first take their words with them: a later one doesn't find them again.
    """
    for k, p in enumerate(patterns):
        text = F.regexp_replace(text, p, f" {chr(_FIRST + k)} ")
    text = F.regexp_replace(text, f"{OWN_NEGATION}|{NEGATED_LOCK}", f" {_BARRIER} ")
    words = F.regexp_extract_all(text, F.lit(rf"{_SIGN}|{CONTRACTED}|[a-z0-9]+"), F.lit(0))
    start = F.struct(F.lit(-1).alias("since"), F.array().cast("array<struct<kind:int,denied:boolean>>").alias("found"))

    def step(s: Column, w: Column) -> Column:
        sign, word = w.rlike(_SIGN), F.translate(w, " '", "")
        since = F.when(sign, -1).when(word.isin(*NEGATORS), 0).when(word.isin(*QUALIFIERS) | (s["since"] < 0), s["since"]).otherwise(s["since"] + 1)
        one = F.array(F.struct((F.ascii(w) - _FIRST).cast("int").alias("kind"), s["since"].between(0, WINDOW - 1).alias("denied")))
        return F.struct(since.alias("since"), F.when(sign & (w != _BARRIER), F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    return F.aggregate(words, start, step, lambda s: s["found"])


def says(found: Column, kinds: tuple[int, ...], denied: bool) -> Column:
    """Whether one of the kinds is asserted (or denied)."""
    return F.exists(found, lambda a: a["kind"].isin(*kinds) & (a["denied"] == F.lit(denied)))
