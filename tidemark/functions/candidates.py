"""Part-number candidates of a listing: what its title and its structured field may be looked up by.

Rules find tokens; whatever they find is merged into one candidate a key, the most certain first and the
first of equals. A category is a list of rules: makers' shapes, other sellers' numbers with a word that must
stand somewhere in the title (its gate), a source's house numbers, names, and whatever else looks like a code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import alias_key_ascii
from .let import let
from .title import without_citations

# Shapes of makers' part numbers inside a canonical title, numbers of resellers (token in a group) with
# the words that must be near, and what looks like a code without being one.
SHAPES = (
    ("seagate", r"\bst\d{3,6}[a-z]{2}\d{3}[a-z0-9]?\b"),
    ("western_digital", r"\bwd\d{2,4}[a-z]{4}\b"),
    ("western_digital", r"\b(?:wuh|wus|huh|hus|hdn)\d{6}[a-z0-9]{4,8}\b"),
    ("toshiba", r"\b(?:mg|mn)\d{2}[a-z]{3}\d{1,3}t?[a-z]{0,3}\b"),
    ("samsung", r"\bmz-?[a-z0-9]{6,9}(?:/[a-z0-9]{2,4})?\b"),
)
RESELLERS = (
    ("dell_emc", r"\b(00[45]\d{6})\b", r"\b(?:emc|dell)\b"),
    ("dell_emc", r"\bdp/?n[: ]*0?([0-9a-z]{5})\b", None),
    ("hpe", r"\b(\d{6}-[a-z0-9]{3})\b", r"\b(?:hpe|hp|hewlett|proliant)\b"),
    ("netapp", r"\b(x\d{3,4}[a-z]?(?:-r\d)?)\b", r"\bnetapp\b"),
    ("lenovo_ibm", r"\bfru[: ]*([0-9a-z]{7})\b", None),
)
RETAIL = r"\b0f\d{5}\b"
CODE, TWO_LETTERS, TWO_DIGITS = r"\b[a-z0-9][a-z0-9./-]{5,23}\b", r"[a-z].*[a-z]", r"\d.*\d"
TAILS = r"(?:\d(?:\.\d+)?(?:tb|gb|mb|rpm)|gb/s|512e|512n|4kn|inch)$"
RAM_SHAPES = (
    ("micron", r"\bmt[ac]\d{1,2}[a-z]{1,4}\d{1,2}g\d{2}[a-z0-9]{1,6}(?:-[a-z0-9]{2,8})?\b"),
    ("micron", r"\bmtc\d{2}[a-z]\d{4}[a-z0-9]{4,10}\b"),
    ("micron", r"\bct\d{1,3}g\d[a-z0-9]{3,12}\b"),
    ("samsung", r"\bm[34]\d{2}[a-z]\d[a-z0-9]{4,8}-[a-z0-9]{3,4}\b"),
    ("sk_hynix", r"\bhm[a-z]{1,2}\d[a-z0-9]{6,10}-[a-z0-9]{2,3}\b"),
    ("kingston", r"\bk(?:sm|vr|th)\d{2}[a-z0-9]{2,6}/\d{1,3}[a-z0-9]{0,6}\b"),
)
RAM_RESELLERS = (("hpe", r"\b(p?\d{5,6}-[a-z0-9]{3})\b", r"\bhpe?\b|\bhewlett\b"), ("dell", r"\b(snp[a-z0-9]{5,6}/\d{1,3}g)\b", None), ("dell", r"\b(a\d{7})\b", r"\bdell\b"))
RAM_TAILS = r"(?:\d(?:gb|mb|mhz)|mt/s|pc[345]l?-\d+[a-z]{0,3}(?:-[a-z])?|ddr[345]l?-\d+|\drx\d+)$"
GPU_NAMES = (
    ("nvidia", r"\b(?:geforce\s+)?((?:rtx|gtx)\s?\d{4}(?:\s?(?:ti|super))?)\b"),
    ("nvidia", r"\b(?:quadro\s+)?(rtx\s?(?:a\d{4}|\d{4}\s?ada))\b"),
    ("nvidia", r"\bquadro\s+((?:rtx\s?)?[a-z]?\d{4})\b"),
    ("nvidia", r"\b(?:tesla\s+)?([abhlptv]\d{1,3}s?)\b"),
    ("amd", r"\b(?:instinct\s+)?(mi\d{2,3}[a-z]?)\b"),
    ("amd", r"\bradeon\s+(?:pro\s+)?((?:rx\s?)?\d{4}(?:\s?xtx?)?|w\d{4})\b"),
    ("intel", r"\barc\s+([ab]\d{3}m?)\b"),
)
GPU_QUALIFIER = r"\s*,?\s*\(?(?:\d{1,3}\s?gb(?!/s)|pci-?e|sxm\d?)\)?(?![a-z0-9])"
GPU_NUMBER = r"\b(?:699|900)-[0-9a-z]{5}-[0-9a-z]{4}-[0-9a-z]{3}\b"
GPU_TAILS = r"(?:\d(?:gb|mb|tb|w)|gb/s|pcie\d?)$"
BASIC_TAILS = r"(?:\d(?:gb|tb|mb|w)|gb/s|gbe)$"
MAKER, RESELLER, HOUSE, UNKNOWN = "manufacturer_mpn", "oem", "house_sku", "unknown_code"


def found(tokens: Column, kind: str | Column, vendor: str | Column, sure: float, structured: bool = False, review_only: bool = False) -> Column:
    """Candidates of tokens: array<struct<norm, kind, vendor, confidence, structured, review_only>>."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.transform(
        tokens,
        lambda t: F.struct(alias_key_ascii(t).alias("norm"), col(kind).alias("kind"), col(vendor).alias("vendor"), F.lit(sure).alias("confidence"), F.lit(structured).alias("structured"), F.lit(review_only).alias("review_only")),
    )


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def none() -> Column:
    return F.array().cast("array<string>")


def merged(hits: Column) -> Column:
    """One candidate a key: the most certain, the first of equals; the more certain first, else in the rules' order.

    ``title_kind`` of a structured one is what the title itself says of that key: a maker's number if any rule says so,
    else the last that knows it. A code that nobody knows says nothing, and counts only where no rule knows the key.
    """
    ranked = F.transform(F.filter(hits, lambda c: c["norm"] != ""), lambda c, i: F.struct((-c["confidence"]).alias("less"), i.alias("at"), c.alias("c")))

    def first(some: Column) -> Column:
        norms = F.transform(some, lambda o: o["c"]["norm"])
        best = F.filter(some, lambda o, i: F.array_position(norms, o["c"]["norm"]) == i + 1)

        def told(o: Column) -> Column:
            of_title = F.filter(some, lambda x: (x["c"]["norm"] == o["c"]["norm"]) & ~x["c"]["structured"] & (x["c"]["kind"] != UNKNOWN))
            kinds = F.transform(F.array_sort(F.transform(of_title, lambda x: F.struct(x["at"], x["c"]["kind"].alias("k")))), lambda x: x["k"])
            kind = F.when(F.array_contains(kinds, MAKER), MAKER).when(F.size(kinds) > 0, F.element_at(kinds, -1))
            return F.struct(*[o["c"][f].alias(f) for f in ("norm", "kind", "vendor", "confidence", "structured", "review_only")], F.when(o["c"]["structured"], kind).alias("title_kind"))

        return F.transform(best, told)

    return let(F.array_sort(ranked), first)


def _shaped(shapes: tuple, token: Column) -> tuple[Column, Column]:
    """Kind and vendor of a token that is, as a whole, of a maker's shape."""
    vendor = F.coalesce(*[F.when(token.rlike(rf"\A(?:{p})\z"), v) for v, p in shapes])
    return F.when(vendor.isNotNull(), MAKER).otherwise(UNKNOWN), F.coalesce(vendor, F.lit(""))


def _structured(field: Column | None, shapes: tuple) -> list[Column]:
    if field is None:
        return []
    token = F.lower(F.trim(field))
    kind, vendor = _shaped(shapes, token)
    return [found(F.when(token != "", F.array(token)).otherwise(none()), kind, vendor, 0.98, structured=True)]


def _codes(text: Column, tails: str) -> Column:
    return F.filter(every(text, CODE), lambda t: t.rlike(TWO_LETTERS) & t.rlike(TWO_DIGITS) & ~t.rlike(tails))


def _house(text: Column, prefixes: tuple[str, ...]) -> list[Column]:
    begins = lambda t: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p))
    return [found(F.filter(every(text, CODE), begins), HOUSE, "", 0.7)] if prefixes else []


def _resellers(text: Column, rules: tuple) -> list[Column]:
    return [found(every(text, p, 1) if gate is None else F.when(text.rlike(gate), every(text, p, 1)).otherwise(none()), RESELLER, v, 0.8) for v, p, gate in rules]


def candidates(title: Column, structured: Column | None = None, house: tuple[str, ...] = ()) -> Column:
    """Of a drive: makers' shapes and resellers' numbers outside of citations, house numbers by prefix, codes, and
    retail numbers that may only send a listing to review; the structured field first."""

    def read(text: Column) -> Column:
        hits = [*_structured(structured, SHAPES), *[found(every(text, p), MAKER, v, 0.9) for v, p in SHAPES], *_resellers(text, RESELLERS), *_house(text, house)]
        hits += [found(_codes(text, TAILS), UNKNOWN, "", 0.3), found(every(text, RETAIL), UNKNOWN, "", 0.3, review_only=True)]
        return merged(F.concat(*hits))

    return let(without_citations(title), read)


def ram_candidates(title: Column, structured: Column | None = None, house: tuple[str, ...] = ()) -> Column:
    def read(text: Column) -> Column:
        hits = [*_structured(structured, RAM_SHAPES), *[found(every(text, p), MAKER, v, 0.9) for v, p in RAM_SHAPES], *_resellers(text, RAM_RESELLERS), *_house(text, house)]
        return merged(F.concat(*hits, found(_codes(text, RAM_TAILS), UNKNOWN, "", 0.3)))

    return let(title, read)


def gpu_candidates(title: Column, vendor: Column, structured: Column | None = None, house: tuple[str, ...] = ()) -> Column:
    """Names of the one maker that a title names (``vendor``): with and without the line's and the maker's word before
    them, and with up to two qualifiers that follow at once."""

    def spelled(text: Column, maker: str, pattern: str) -> Column:
        whole = rf"(\b{maker}\s)?{pattern}((?:{GPU_QUALIFIER}){{0,2}})"
        parts = F.arrays_zip(every(text, whole, 0).alias("all"), every(text, whole, 1).alias("maker"), every(text, whole, 2).alias("name"), every(text, whole, 3).alias("after"))

        def spellings(p: Column) -> Column:
            full = F.substring(p["all"], F.length(p["maker"]) + 1, F.length(p["all"]) - F.length(p["maker"]) - F.length(p["after"]))
            starts = F.array(full, p["name"], F.concat(p["maker"], full))
            ends = F.array(F.lit(""), F.regexp_extract(p["after"], rf"\A{GPU_QUALIFIER}", 0), p["after"])
            return let(ends, lambda e: F.flatten(F.transform(e, lambda x: F.transform(starts, lambda s: F.concat(s, x)))))

        return F.flatten(F.transform(parts, spellings))

    def read(text: Column) -> Column:
        field = [] if structured is None else [found(F.when(F.trim(structured) != "", F.array(F.lower(F.trim(structured)))).otherwise(none()), MAKER, F.coalesce(vendor, F.lit("")), 0.98, structured=True)]
        names = [found(F.when(vendor == v, spelled(text, v, p)).otherwise(none()), MAKER, v, 0.8) for v, p in GPU_NAMES]
        return merged(F.concat(*field, found(every(text, GPU_NUMBER), MAKER, "nvidia", 0.9), *names, *_house(text, house), found(_codes(text, GPU_TAILS), UNKNOWN, "", 0.3)))

    return let(title, read)


def basic_candidates(title: Column, structured: Column | None = None, house: tuple[str, ...] = ()) -> Column:
    def read(text: Column) -> Column:
        return merged(F.concat(*_structured(structured, (("", r"(?!)"),)), *_house(text, house), found(_codes(text, BASIC_TAILS), UNKNOWN, "", 0.3)))

    return let(title, read)


def mpns(hits: Column) -> Column:
    """The makers' numbers that a title itself names, sorted."""
    own = F.filter(hits, lambda c: F.when(c["structured"], c["title_kind"]).otherwise(c["kind"]) == MAKER)
    return F.array_sort(F.array_distinct(F.transform(own, lambda c: c["norm"])))


def distinct_mpns(hits: Column) -> Column:
    """How many makers' numbers a title names."""
    return F.size(mpns(hits))
