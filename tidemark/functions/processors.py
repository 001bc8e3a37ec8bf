"""Processors: attributes, models, markers and vendor lock of a canonical title, part-number candidates, vetoes.

Identity (maker, models, markers, candidates) is read where other products that the title cites are blanked
out; physical attributes are read from all of it. A title that names two values of a field names none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .candidates import CODE, MAKER, TWO_DIGITS, TWO_LETTERS, UNKNOWN, every, found, merged, none
from .categories import sole
from .let import let
from .spans import LOCK_REFERENCES, PROCESSOR_REFERENCES, blanked, masked
from .wording import LOCK_OEMS, NEGATED_LOCK, assertions, says

# makers' words, sockets, shapes of model names and ordering codes, and markers of what isn't a bare
# retail processor.
BRANDS = ((r"\bintel\b|\bxeon\b|\bcore\s+(?:i[3579]|ultra)\b", "intel"), (r"\bamd\b|\bepyc\b|\bryzen\b|\bthreadripper\b", "amd"))
SOCKETS = (r"\b(?:fc)?lga\s?-?\d{3,4}\b", r"\b(?:socket\s+)?(?:am[2-5]\+?|sp[3-6]|s?trx4|str5|swrx8|fm2\+?)\b")
CORES = r"\b(\d{1,3})[- ]?cores?\b|\b(\d{1,3})c/\d{1,3}t\b"
WATTS = r"\b(\d{2,3})\s?w\b"
EPYC_NAME = r"\bepyc\s+((?:(?:naples|rome|milan(?:-x)?|genoa(?:-x)?|bergamo|siena|turin|sp[3-6]|zen\s?[1-6]c?)\s+){1,3})?(\d{4}[a-z]{0,2})\b"
LINES = (
    ("intel", r"\bxeon\s+(?:platinum|gold|silver|bronze)\s+(\d{4}[a-z]{0,2}\+?)(?![a-z0-9])"),
    ("intel", r"\bxeon\s+((?:e[357]|w|d)-?\s?\d{4,5}[a-z]{0,2}(?:\s+v\d)?)\b"),
    ("intel", r"\bcore\s+(i[3579]-?\s?\d{4,5}[a-z]{0,3})\b"),
    ("intel", r"\bcore\s+ultra\s+[3579]\s+(\d{3}[a-z]{0,2})\b"),
    ("amd", r"\bryzen\s+(?:threadripper\s+)?(?:pro\s+)?(?:[3579]\s+)?(\d{4}[a-z0-9]{0,3})\b"),
    ("amd", r"\bthreadripper\s+(?:pro\s+)?(\d{4}[a-z]{0,2})\b"),
)
EPYC_MODEL = r"\b(?![3-9]00\d)[3-9][0-9a-z]{2}[1-5](?:px|hs|p|f|x|s)?\b(?!\s?(?:ghz|mhz|mt/s|gb|mb|tb|w\b))"
TIER_MODEL = r"\b(?:platinum|gold|silver|bronze)\s+\d{4}[a-z]{0,2}\+?(?![a-z0-9])"
NEXT_MODEL = r"(?:\s*/\s*|\s+-\s+|\s*[,&]\s*|\s+(?:or|and)\s+|\s+)\d{4}(?!\s?(?:ghz|mhz|mt/s|gb|mb|tb|w)(?![a-z]))[a-z]{0,2}\+?(?![a-z0-9])"
E_MODEL = r"\b(e[357]-?\s?\d{4}[a-z]{0,2}(?:\s*v\d)?)\b"
PIN_COUNT = r"\b\d{3,4}[-\s]?pins?\b|\b(?:socket\s+)?(?:sp[3-6]|s?trx4|tr4|swrx8|str5|am[45])[-\s]*\(?(?:1331|1718|4094|4844|6096)\b\)?"
ORDERING = (
    ("intel", r"\b(?:bx|bxc|bv|cm|cd|pk)\d{6,}[a-z0-9]*\b"),
    ("amd", r"\b100-\d{9}(?:\b(?!-\w)|(?=(?:open(?:box)?|new|used)\b(?!-\w)))"),
)
SSPEC = r"\bsr[a-z0-9]{3}\b"
SAMPLE = rf"(?<![a-z0-9])(?:es[12]?|qs|samples?|pre-?production|pre\s+production|100-\d{{9}}-(?!{LOCK_OEMS}(?![a-z0-9]))[a-z0-9]+)(?![a-z0-9])"
BUNDLE = r"(?<![a-z0-9])(?:mother[-\s]?boards?|main[-\s]?boards?|mobo|barebones?|combos?|bundles?|kits?|(?:with|w/|incl|including|plus|\+)\s*[2-9]\s?x|[2-9]\s?x\s+(?:cpus?|processors?|amd|intel|epyc|xeon))(?![a-z0-9])"
UNLOCKED, UNLOCK, LOCKED = r"\bun-?locked\b", r"\bun-?lock\b", rf"\blocked\b|\b(?:vendor|psb|{LOCK_OEMS})[-\s]lock\b|\b{LOCK_OEMS}\s+only\b"
TAILS = r"(?:\d(?:ghz|mhz|mb|gb|w)|lga\d+|\dc/\d+t|\d-?cores?)$"


def _marker(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def socket_key(name: Column) -> Column:
    """What sockets are compared by: without blanks and hyphens, the word socket and the maker's package prefix."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9+]", ""), "^(?:socket)?(?:fc)?", "")


def brand(title: Column) -> Column:
    """The only maker that a title names."""
    return sole(F.array(*[F.when(title.rlike(p), F.lit(b)) for p, b in BRANDS]))


def _server_models(identity: Column) -> Column:
    """Model numbers of the line whose titles give them without the line's name."""
    return F.when(identity.rlike(r"\bepyc\b"), every(blanked(identity, PIN_COUNT, *SOCKETS), EPYC_MODEL)).otherwise(none())


def models(identity: Column) -> Column:
    """Sorted array of the different models that a title names, hyphens and blanks left out."""

    def others(bare: Column) -> Column:
        runs = every(bare, f"{TIER_MODEL}(?:{NEXT_MODEL})*")
        tiers = F.flatten(F.transform(runs, lambda r: every(r, r"\b\d{4}[a-z]{0,2}\+?(?![a-z0-9])")))
        xeon = F.when(bare.rlike(r"\bxeon\b"), F.concat(tiers, every(bare, E_MODEL, 1))).otherwise(none())
        return F.transform(F.concat(*[every(bare, p, 1) for _, p in LINES], xeon), lambda m: F.regexp_replace(m, r"[\s-]", ""))

    return let(identity, lambda t: F.array_sort(F.array_distinct(F.concat(_server_models(t), let(blanked(t, PIN_COUNT), others)))))


def vendor_lock(title: Column) -> Column:
    """locked, unlocked, or null where a title says neither or both.

    Read outside of cited products; what is said inside of them can only speak against a reading. A denied unlock
    proves no lock and a denied lock no unlock. On other makers' parts the word means the multiplier.
    """
    kinds = [NEGATED_LOCK, UNLOCKED, UNLOCK, LOCKED]

    def wording(text: Column) -> Column:
        return let(
            assertions(text, kinds),
            lambda a: F.struct(says(a, (0, 1), False).alias("un"), says(a, (3,), False).alias("lock"), says(a, (0, 1, 2), True).alias("not_un"), says(a, (3,), True).alias("not_lock")),
        )

    def read(w: Column) -> Column:
        own, whole = w["own"], w["whole"]
        free = own["un"] & ~own["lock"] & ~own["not_un"] & ~own["not_lock"]
        tied = own["lock"] & ~own["un"] & ~own["not_lock"]
        return F.when(free, F.when(~whole["not_un"] & ~whole["lock"] & ~whole["not_lock"], "unlocked")).when(tied, F.when(~whole["un"] & ~whole["not_lock"], "locked"))

    def of(t: Column) -> Column:
        both = F.struct(wording(masked(t, LOCK_REFERENCES)).alias("own"), wording(t).alias("whole"))
        return F.when(t.rlike("lock|only") & (brand(t) == "amd"), let(both, read))

    return let(title, of)


def identity_text(title: Column) -> Column:
    return masked(title, PROCESSOR_REFERENCES)


def attributes(title: Column, structured: Column | None = None) -> Column:
    """struct<brand, socket, cores, tdp_w, sample, bundle, model, multi_model, vendor_lock>. A sample marking in the
    merchant's own part number (``structured``, canonical) counts, too."""

    def read(t: Column) -> Column:
        cores = F.concat(every(t, CORES, 1), every(t, CORES, 2))
        sockets = F.concat(*[every(t, p) for p in SOCKETS])
        return F.struct(
            sole(F.transform(sockets, socket_key)).alias("socket"),
            sole(F.transform(F.filter(cores, lambda c: c != ""), lambda c: c.cast("int"))).alias("cores"),
            sole(F.transform(every(t, WATTS, 1), lambda w: w.cast("int"))).alias("tdp_w"),
            vendor_lock(t).alias("vendor_lock"),
            identity_text(t).alias("own"),
        )

    def identity(r: Column) -> Column:
        sample = _marker(r["own"], SAMPLE)
        told = sample if structured is None else F.coalesce(sample, _marker(F.coalesce(structured, F.lit("")), SAMPLE))
        return let(
            models(r["own"]),
            lambda m: F.struct(
                brand(r["own"]).alias("brand"),
                *[r[k].alias(k) for k in ("socket", "cores", "tdp_w", "vendor_lock")],
                told.alias("sample"),
                _marker(r["own"], BUNDLE).alias("bundle"),
                F.when(F.size(m) == 1, F.get(m, F.lit(0))).alias("model"),
                F.when(F.size(m) > 1, F.array_join(m, " ")).alias("multi_model"),
            ),
        )

    return let(let(title, read), identity)


def model_key(model_number: Column) -> Column:
    """A catalog's model (canonical) by the same reading; null where it isn't exactly one."""
    return let(models(model_number), lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0))))


def candidates(title: Column, structured: Column | None = None) -> Column:
    """Ordering codes, names with and without their line, and codes; of a title that names several of the server line
    only the merchant's own number counts."""

    def read(x: Column) -> Column:
        own, maker = x["own"], x["maker"]
        hits = []
        if structured is not None:
            hits.append(found(F.when(F.trim(structured) != "", F.array(F.lower(F.trim(structured)))).otherwise(none()), MAKER, F.coalesce(maker, F.lit("")), 0.98, structured=True))
        hits += [found(every(own, p), MAKER, vendor, 0.9) for vendor, p in ORDERING]
        hits.append(found(F.when(maker == "intel", every(own, SSPEC)).otherwise(none()), MAKER, "intel", 0.85))
        epyc = every(own, EPYC_NAME, 2)
        names = [("amd", F.transform(epyc, lambda n: F.concat(F.lit("epyc "), n)), epyc), *((v, every(own, p), every(own, p, 1)) for v, p in LINES)]
        for vendor, whole, number in names:
            hits += [found(whole, MAKER, vendor, 0.85), found(number, MAKER, vendor, 0.75)]
        codes = F.filter(every(own, CODE), lambda t: t.rlike(TWO_LETTERS) & t.rlike(TWO_DIGITS) & ~t.rlike(TAILS))
        return merged(F.concat(*hits, found(codes, UNKNOWN, "", 0.3)))

    def guarded(own: Column) -> Column:
        several = F.size(F.array_distinct(_server_models(own))) > 1
        return let(F.struct(F.when(several, F.lit("")).otherwise(own).alias("own"), brand(own).alias("maker")), read)

    return let(identity_text(title), guarded)


def vetoes(said: Column, socket: Column, cores: Column, model: Column) -> Column:
    """Names of what speaks against a catalog processor: markers of their own, others where both sides know and differ."""
    marks = [F.when(said[k].isNotNull(), F.lit(k)) for k in ("sample", "bundle", "multi_model")]
    known = [F.when(said[k] != v, F.lit(k)) for k, v in (("socket", socket), ("cores", cores), ("model", model))]
    return F.array_compact(F.array(*marks, *known))
