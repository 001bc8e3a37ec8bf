"""Listing titles: one canonical form, cited products blanked out, and typed attributes as columns.

Only folding needs Python (one vectorised function, ``keys.folded``); everything after it sees lower-case ASCII
and is a JVM expression. What a title doesn't say is null, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import folded
from .let import let
from .spans import ANY_REFERENCES, DRIVE_REFERENCES, FOR_PARTS, LEADING, masked, phrase_pattern, unclosed
from .wording import NOT_WORKING, assertions

# Word lists and patterns that decide how a title is read. All of them must be just these for titles
# to be read alike.
BOILERPLATE = r"\b(?:l@@k|wow|free\s+(?:fast\s+)?shipping|fast\s+ship(?:ping)?|ships?\s+(?:fast|free|today|same\s+day)|best\s+offer|top\s+seller|us\s+seller|hot\s+deal)\b"
FOLDS = {"适用于": " suitable for "}
INTERFACES = ("nvme", "sas", "sata", "scsi", "usb")
SECURITY = ("sed", "fips", "ise")
SECTORS = ("512n", "512e", "4kn")
BRANDS = (
    ("western digital", "western_digital"),
    ("sandisk", "western_digital"),
    ("wd", "western_digital"),
    ("hgst", "hgst"),
    ("hitachi", "hgst"),
    ("seagate", "seagate"),
    ("toshiba", "toshiba"),
    ("samsung", "samsung"),
    ("solidigm", "solidigm"),
    ("intel", "intel"),
    ("micron", "micron"),
    ("crucial", "micron"),
    ("kingston", "kingston"),
    ("kioxia", "kioxia"),
)
CONDITIONS = (
    (rf"\bparts only\b|\bas[- ]is\b|\b{NOT_WORKING}\b|\bspares?(?: or | and | ?/ ?| )repairs?\b|\bfor {FOR_PARTS}\b", "for_parts", None, 0.95),
    (r"\b(?:factory|manufacturer) recert(?:ified)?\b", "recertified", "factory", 0.95),
    (r"\brecert(?:ified)?\b", "recertified", None, 0.85),
    (r"\bseller refurb(?:ished)?\b", "refurbished", "seller", 0.95),
    (r"\brefurb(?:ished)?\b|\brenewed\b", "refurbished", None, 0.85),
    (r"\bopen box\b", "open_box", None, 0.9),
    (r"\bserver pull\b|\bpull(?:ed)?\b|\bused\b", "used", None, 0.8),
    (r"\bfactory sealed\b|(?<!like )(?<!like-)(?<!%)(?<!% )\bnew\b(?![- ]pull)(?! ?\d{1,3}(?:\.\d+)? ?%)", "new", None, 0.8),
)
PACKAGING = ((r"\bretail(?:\s+box(?:ed)?)?\b", "retail"), (r"\boem\b|\bbulk\b|\bbare drive\b|\bbrown box\b", "bulk"))
WARRANTY = ((r"\bno warranty\b", "none"), (r"\bmanufacturer warranty\b", "manufacturer"), (r"\bseller warranty\b", "seller"))
FAMILIES = {
    "seagate": ("ironwolf pro", "ironwolf", "exos", "skyhawk ai", "skyhawk", "barracuda pro", "barracuda", "firecuda", "nytro"),
    "western_digital": ("ultrastar", "deskstar", "red plus", "red pro", "purple pro"),
}
WD_NAMES = ("wd", "western digital")
WD_COLOURS = ("red plus", "red pro", "red", "gold", "purple pro", "purple", "blue", "black", "green")
QUANTITIES = ((r"\blot of (\d{1,3})x?\b", 0.95), (r"\blot (\d{1,3})x?\b", 0.9), (r"\b(\d{1,3})[- ]pack\b", 0.9), (r"\bqty:? ?(\d{1,3})\b", 0.9), (r"\b(\d{1,3}) ?pcs?\b", 0.9), (r"\b(\d{1,3})\s?x\b", 0.7))
AUCTION_LOT = r"\bauction lot (?:#|no\.? ?)?\d+|\blot (?:#|no\.? ?)\d+"

def canonical_title(text: Column) -> Column:
    """Folded, dashes alike, without boilerplate and noise. Where a product is cited, clause marks become " - ",
    so that the end of the citation stays visible. Applied again it changes nothing."""
    t = folded(text)
    for phrase, plain in FOLDS.items():
        t = F.replace(t, F.lit(phrase), F.lit(plain))
    t = F.regexp_replace(F.regexp_replace(t, "[‐-―−]", "-"), BOILERPLATE, " ")

    def bare(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(x, r'[^a-z0-9 .\-/()"+%#]', " "), r"\s+", " "))

    return let(t, lambda x: F.when(bare(x).rlike(phrase_pattern(ANY_REFERENCES, LEADING)), bare(F.regexp_replace(x, r"[;|]|(?<!\d),|,(?!\d)", " - "))).otherwise(bare(x)))


def listing_text(title: Column, label: Column, canonical: Column) -> Column:
    """The raw text of a title and the seller's word on its condition (``label``), to be made canonical.

    The label stands behind a clause mark, so that it is never part of a cited product; brackets that such a title
    leaves open (as its ``canonical`` form shows) are closed before it.
    """
    said = F.trim(F.coalesce(label, F.lit(""))) != ""
    closed = F.when(said & canonical.rlike(phrase_pattern(ANY_REFERENCES, LEADING)), F.concat(title, F.repeat(F.lit(")"), unclosed(canonical)))).otherwise(title)
    return F.concat_ws(" | ", F.when(F.trim(title) != "", closed), F.when(said, label))


def without_citations(title: Column) -> Column:
    """A canonical title with spaces in place of the products it compares itself to; of unchanged length. Rather too
    much goes than too little."""
    return masked(title, DRIVE_REFERENCES, LEADING)


def first_of(title: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Value of the first pattern of a table that is found."""
    return F.coalesce(*[F.when(title.rlike(p), F.lit(v)) for p, v in table])


def _number(title: Column, pattern: str, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(title, pattern, 1), F.lit("")).cast(kind)


#: A number and the unit that gives it a meaning; link speeds come before capacities of the same letters.
_UNITS = ("tb", "gb/s", "gbs", "gb", "mb cache", "mb buffer", "k rpm", "krpm", "rpm", "yr warranty", "yrs warranty", "year warranty", "years warranty")
_MEASURE = r"\b(\d+(?:\.\d+)?)(?: |-(?=y))?(" + "|".join(_UNITS) + r")\b(?!/s)"


def measures(title: Column) -> Column:
    """array<struct<number, unit>> of all numbers that a title gives a unit, in its order."""
    both = F.regexp_extract_all(title, F.lit(_MEASURE), F.lit(0))
    return F.transform(both, lambda m: F.struct(F.regexp_extract(m, _MEASURE, 1).alias("number"), F.regexp_extract(m, _MEASURE, 2).alias("unit")))


def _first(title: Column, units: tuple[str, ...], digits: str, kind: str) -> Column:
    """The first number with one of the units, if its digits are such as the unit goes with."""
    fit = F.filter(measures(title), lambda m: m["unit"].isin(*units) & m["number"].rlike(f"^(?:{digits})$"))
    return F.get(fit, F.lit(0))["number"].cast(kind)


def capacity(title: Column) -> Column:
    """struct<bytes, confidence>: the first capacity; several different ones make it doubtful. Link speeds are none."""
    said = F.filter(measures(title), lambda m: m["unit"].isin("tb", "gb"))
    values = F.transform(said, lambda m: (m["number"].cast("decimal(20,6)") * F.when(m["unit"] == "tb", 1_000_000_000_000).otherwise(1_000_000_000)).cast("long"))
    return F.when(F.size(said) > 0, F.struct(F.get(values, F.lit(0)).alias("bytes"), F.when(F.size(F.array_distinct(values)) == 1, 0.9).otherwise(0.5).alias("confidence")))


def form_factor(title: Column) -> Column:
    """Inches with or without their mark, the larger first; then the card size."""
    inches = F.regexp_extract_all(title, F.lit(r"(?<![\d.])(\d)\.5"), F.lit(1))
    return F.when(F.array_contains(inches, "3"), "3.5").when(F.array_contains(inches, "2"), "2.5").when(F.arrays_overlap(F.regexp_extract_all(title, F.lit(r"[a-z0-9.]+"), F.lit(0)), F.array(F.lit("m2"), F.lit("m.2"))), "m.2")


def rpm(title: Column) -> Column:
    thousands = _first(title, ("k rpm", "krpm"), r"\d{1,2}(?:\.\d)?", "double") * 1000
    return F.coalesce(_first(title, ("rpm",), r"\d{4,5}", "int"), thousands.cast("int"))


def _of_brand(brand: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(f"{brand}/"), x))


def families(masked: Column) -> Column:
    """Sorted array of brand/family texts of the lines that a title names, longer names first."""
    found = []
    for brand, names in FAMILIES.items():
        pattern = r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b"
        found.append(_of_brand(brand, F.regexp_extract_all(masked, F.lit(pattern), F.lit(1))))
    colours = F.regexp_extract_all(masked, F.lit(rf"\b(?:{'|'.join(WD_NAMES)}) ({'|'.join(WD_COLOURS)})\b"), F.lit(1))
    found.append(_of_brand("western_digital", colours))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def offer_terms(masked: Column) -> Column:
    """What a title says of the condition: struct<condition: struct<value, confidence>, channel, conflict, denied, denied_channels>.

    Of what it asserts the first of the table counts. ``conflict``: all conditions it asserts, if they are several;
    ``denied``: conditions it denies and nowhere asserts, and ``denied_channels`` likewise; null where there are none.
    """
    entries = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(ch).cast("string").alias("channel"), F.lit(c).alias("confidence")) for _, v, ch, c in CONDITIONS])

    def of(found: Column, denied: bool, field: str) -> Column:
        kinds = F.array_sort(F.transform(F.filter(found, lambda a: a["denied"] == F.lit(denied)), lambda a: a["kind"]))
        return F.array_distinct(F.array_compact(F.transform(kinds, lambda k: F.get(entries, k)[field])))

    def some(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    def read(found: Column) -> Column:
        best = F.get(entries, F.array_min(F.transform(F.filter(found, lambda a: ~a["denied"]), lambda a: a["kind"])))
        asserted = of(found, False, "value")
        return F.struct(
            F.when(best.isNotNull(), F.struct(best["value"].alias("value"), best["confidence"].alias("confidence"))).alias("condition"),
            best["channel"].alias("channel"),
            F.when(F.size(asserted) > 1, asserted).alias("conflict"),
            some(F.array_except(of(found, True, "value"), asserted)).alias("denied"),
            some(F.array_except(of(found, True, "channel"), of(found, False, "channel"))).alias("denied_channels"),
        )

    return let(assertions(masked, [p for p, *_ in CONDITIONS]), read)


def with_declared(terms: Column, condition: Column, channel: Column, sure: float = 0.95) -> Column:
    """struct<condition, channel, conflict>: offer terms with those that a source declares for all it sells (null: none).

    A title that asserts the declared condition and another has neither (``conflict`` says so, for review). What a
    title says otherwise stands, without the declared channel; and a title that denies a condition and asserts none,
    or denies the channel, is not filled in.
    """
    own, told, chan = terms["condition"], terms["condition"]["value"], terms["channel"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    conflict = yes(F.array_contains(terms["conflict"], condition))
    as_it_is = (
        condition.isNull()
        | yes(F.array_contains(terms["denied_channels"], channel))
        | (told.isNull() & terms["denied"].isNotNull())
        | yes(told != condition)
        | yes(chan != channel)
    )
    filled = F.coalesce(own, F.struct(condition.alias("value"), F.lit(sure).alias("confidence")))
    return F.struct(
        F.when(~conflict, F.when(as_it_is, own).otherwise(filled)).alias("condition"),
        F.when(~conflict, F.when(as_it_is, chan).otherwise(F.coalesce(chan, channel))).alias("channel"),
        F.when(conflict, terms["conflict"]).alias("conflict"),
    )


def condition(masked: Column) -> Column:
    """struct<value, confidence> of the first condition of the table that a title asserts."""
    return offer_terms(masked)["condition"]


def quantities(title: Column) -> Column:
    """array<struct<n, confidence>> of the counts that a title states, in the order of the table."""
    plain = F.regexp_replace(title, AUCTION_LOT, " ")
    return F.array_compact(F.array(*[F.when(plain.rlike(p), F.struct(_number(plain, p).alias("n"), F.lit(c).alias("confidence"))) for p, c in QUANTITIES]))


def lot_size(title: Column) -> Column:
    """struct<n, confidence> for identity: of counts that disagree the largest, for then no single unit is proven."""
    sure = F.filter(quantities(title), lambda q: q["confidence"] >= 0.9)
    distinct = F.array_distinct(F.transform(sure, lambda q: q["n"]))
    return F.when(F.size(distinct) > 1, F.struct(F.array_max(distinct).alias("n"), F.lit(0.9).alias("confidence"))).otherwise(F.get(quantities(title), F.lit(0)))


def offer_quantity(title: Column) -> Column:
    """struct<n, confidence> for prices: counts that disagree never divide one."""
    sure = F.filter(quantities(title), lambda q: q["confidence"] >= 0.9)
    distinct = F.array_distinct(F.transform(sure, lambda q: q["n"]))
    return F.when(F.size(distinct) > 1, F.struct(F.array_max(distinct).alias("n"), F.lit(0.5).alias("confidence"))).otherwise(F.get(quantities(title), F.lit(0)))


def attributes(title: Column) -> dict[str, Column]:
    """Attributes of a drive's canonical title. Brand, condition and family are read without citations, the rest from all of it."""
    masked = without_citations(title)
    word = lambda names: first_of(title, tuple((rf"\b{n}\b", n) for n in names))
    years = ("yr warranty", "yrs warranty", "year warranty", "years warranty")
    return {
        "capacity": capacity(title),
        "interface": word(INTERFACES),
        "form_factor": form_factor(title),
        "rpm": rpm(title),
        "cache_mb": _first(title, ("mb cache", "mb buffer"), r"\d{1,4}", "int"),
        "sector_format": F.get(F.filter(F.split(title, "[^a-z0-9]+"), lambda w: w.isin(*SECTORS)), F.lit(0)),
        "recording": word(("cmr", "smr")),
        "security": word(SECURITY),
        "link_gbps": _first(title, ("gb/s", "gbs"), r"\d+(?:\.\d+)?", "double"),
        "warranty_years": _first(title, years, r"\d{1,2}", "int"),
        "brand": first_of(masked, tuple((rf"\b{w}\b", b) for w, b in BRANDS)),
        "families": families(masked),
        "condition": condition(masked),
        "packaging": first_of(masked, PACKAGING),
        "warranty_channel": first_of(masked, WARRANTY),
        "quantity": lot_size(title),
    }


def brands_agree(a: Column, b: Column, same: tuple[str, ...] = ("western_digital", "hgst", "sandisk")) -> Column:
    """Equal, of one group, or not both known."""
    return F.coalesce((a == b) | (a.isin(*same) & b.isin(*same)), F.lit(True))


def family_fits(stated: Column, target: Column) -> Column:
    """A stated family describes a target of the same name or of one that goes on after it."""
    return (stated == target) | F.startswith(target, F.concat(stated, F.lit(" ")))
