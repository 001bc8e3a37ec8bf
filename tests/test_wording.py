"""Masked citations, negation at every distance, processors and offer terms."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import processors, spans, title, wording

BASE = "AMD EPYC 7763 64-Core SP3 CPU"


def canonical(table, texts):
    return table("i int, t string", list(enumerate(texts))).select("i", title.canonical_title(F.col("t")).alias("t"))


def read(table, texts, column):
    return [r.x for r in canonical(table, texts).select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_masks_are_those_of_a_walk(table):
    """Character by character, with the brackets open so far counted anew."""

    def walk(text, phrases):
        out, at = "", 0
        while at < len(text):
            hit = next((p for p in phrases if text.startswith(p, at) and not text[at - 1 : at].isalnum() and not text[at + len(p) : at + len(p) + 1].isalnum()), None)
            if hit is None:
                out, at = out + text[at], at + 1
                continue
            depth = 0
            for c in text[:at]:
                depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            own, end = 0, at + len(hit)
            while end < len(text):
                c = text[end]
                if c == "(":
                    own += 1
                elif c == ")":
                    if own == 0 and depth:
                        break
                    own = max(0, own - 1)
                elif own == 0 and (c in ",;|" or text.startswith(" - ", end)):
                    break
                end += 1
            out, at = out + " " * (end - at), end
        return out

    rng = random.Random(3)
    bits = ["(", "(", ")", ")", " - ", ", ", " replaces ", " comparable to ", "wd", " gold", " ", "-", "x1", "; "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(600)] + ["", None, "((((replaces (((x))) y))) z", "🙂 replaces é, w"]
    rows = table("i int, t string", list(enumerate(texts))).select("i", "t", spans.masked(F.col("t"), ("replaces", "comparable to")).alias("m")).collect()
    for r in rows:
        assert r.m == (None if r.t is None else walk(r.t, ("replaces", "comparable to"))), r.t


def test_leading_words_and_labels(table):
    got = read(table, ["For Seagate ST1 x", "for sale: Seagate ST1", "Drive for Dell", "compatible WD, Seagate"], title.without_citations)
    assert [x.split() for x in got] == [[], ["for", "sale", "seagate", "st1"], ["drive", "for", "dell"], ["-", "seagate"]]
    rows = table("t string, label string", [("Drive comparable to (WD, gold", "Used"), ("Drive (x", "Used"), ("a", ""), ("", "Used"), ("a", None)])
    rows = rows.withColumn("c", title.canonical_title(F.col("t")))
    assert [r[0] for r in rows.select(title.listing_text(F.col("t"), F.col("label"), F.col("c"))).collect()] == ["Drive comparable to (WD, gold) | Used", "Drive (x | Used", "a", "Used", "a"]


def test_blanked_keeps_its_length(table):
    df = table("t string", [("ab 12 cd 345 6",), ("12",), ("none",), ("",)])
    assert [r[0] for r in df.select(spans.blanked(F.col("t"), r"\d{2,}", "c")).collect()] == ["ab     d     6", "  ", "none", ""]


LOCKS = [
    ("no longer unlocked", None), ("not a Dell PSB-unlocked CPU", None), ("NOT VENDOR-UNLOCKED", None), ("never unlocked", None), ("without unlock", None), ("isn't a vendor unlocked part", None), ("not un-locked", None), ("not a no-vendor-lock CPU", None),
    ("Unlocked - no longer vendor-unlocked", None), ("no longer unlocked, Dell locked", "locked"), ("never locked", None), ("without vendor lock", None), ("Dell Locked, not a Dell locked CPU", None), ("not used 2 years Unlocked", "unlocked"), ("NO VENDOR LOCK", "unlocked"),
    ("not vendor locked", "unlocked"), ("non-locked", "unlocked"), ("NO VENDOR LOCK Unlocked", "unlocked"), ("(No lock)", "unlocked"), ("PSB-unlocked", "unlocked"), ("vendor-locked", "locked"), ("Unlocked Dell Lock", None), ("Lenovo Lock", "locked"), ("LENOVO ONLY", "locked"), ("No Dell Lock", None),
    ("Unlocked No Warranty Dell Locked", None), ("unlock code included", None), ("Unlocked, unlock code included", "unlocked"), ("Unlocked works with Dell R7525 NOT UNLOCKED", None), ("replacement for an unlocked processor", None), ("Unlocked, compatible with Dell locked servers", None),
    ("OEM Version of EPYC 7763 unlocked", "unlocked"), ("Unlocked No Heatsink Dell Locked", None), ("No Tray Unlocked", "unlocked"), ("", None),
]


def test_vendor_locks(table):
    got = read(table, [f"{BASE} {t}" for t, _ in LOCKS], processors.vendor_lock)
    assert dict(zip([t for t, _ in LOCKS], got, strict=True)) == dict(LOCKS)
    assert read(table, ["Intel Core i7-12700K unlocked", "AMD and Intel unlocked", "unlocked"], processors.vendor_lock) == [None, None, None]


def test_reach_of_a_negation(table):
    """Against a walk backwards from each assertion."""
    rng = random.Random(8)
    bits = ["not", "no", "never", "dell", "a", "x", "y2", "used", "new", "-", "no warranty", "isn't"]
    texts = [" ".join(rng.choice(bits) for _ in range(9)) for _ in range(300)]
    rows = table("i int, t string", list(enumerate(texts))).select("t", wording.assertions(F.col("t"), [r"\bused\b", r"\bnew\b"]).alias("a")).collect()
    for r in rows:
        words, want = r.t.replace("no warranty", "#").replace("isn't", "isnt").replace("-", " ").split(), []
        for at, w in enumerate(words):
            if w not in ("used", "new"):
                continue
            counted, denied = 0, False
            for b in reversed(words[:at]):
                if b in ("used", "new", "#") or counted == 3:
                    break
                if b in ("not", "no", "never", "isnt"):
                    denied = True
                    break
                counted += b not in ("dell", "a")
            want.append((("used", "new").index(w), denied))
        assert [tuple(a) for a in r.a] == want, r.t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Xeon Gold 6338 / Platinum 8358", {"brand": "intel", "multi_model": "6338 8358"}),
        ("Xeon Gold 6338, 6348 & 8358", {"brand": "intel", "multi_model": "6338 6348 8358"}),
        ("Xeon Gold 63380", {"brand": "intel"}),
        ("Xeon Platinum 8480+ LGA-4677", {"brand": "intel", "model": "8480+", "socket": "lga4677"}),
        ("E5-2680 v4 / E5-2690 v4 Xeon", {"brand": "intel", "multi_model": "e52680v4 e52690v4"}),
        ("Xeon Gold 6248 2666 MHz FCLGA 3647", {"brand": "intel", "socket": "lga3647", "model": "6248"}),
        ("AMD EPYC GENOA SP5 ZEN4 9354P 32c/64t 3.25GHz 280W", {"brand": "amd", "socket": "sp5", "cores": 32, "tdp_w": 280, "model": "9354p"}),
        ("AMD EPYC 7763 SP3 4094-pin", {"brand": "amd", "socket": "sp3", "model": "7763"}),
        ("EPYC 7003 series 7713", {"brand": "amd", "model": "7713"}),
        ("AMD 100-000000314-04 EPYC 7763", {"brand": "amd", "sample": "100-000000314-04", "model": "7763"}),
        ("AMD EPYC 9354P 100-000000805-DELL", {"brand": "amd", "model": "9354p"}),
        ("EPYC 7763 tested in ESXi series", {"brand": "amd", "model": "7763"}),
        ("Supermicro H12 Mother Board With 2x AMD EPYC 7763", {"brand": "amd", "bundle": "mother board", "model": "7763"}),
        ("Server CPU EPYC 7763 32x 3.25GHz", {"brand": "amd", "model": "7763"}),
        ("AMD EPYC 7763 replacement for engineering sample", {"brand": "amd", "model": "7763"}),
        ("Intel EPYC", {}),
        ("", {}),
    ],
)
def test_processors(table, text, want):
    (got,) = read(table, [text], processors.attributes)
    assert {k: v for k, v in got.asDict().items() if v is not None} == want


def test_processor_candidates(table):
    (one, two, intel, cited) = read(table, ["AMD EPYC Genoa 9354P 100-000000798Open", "EPYC 7742/7702 ABC-12345", "Intel Core Ultra 7 265K SRMGD BX8071513900K", "drive replaces EPYC 7763"], processors.candidates)
    assert [(c.norm, c.kind, c.vendor, c.confidence) for c in one] == [("100000000798", "manufacturer_mpn", "amd", 0.9), ("epyc9354p", "manufacturer_mpn", "amd", 0.85), ("9354p", "manufacturer_mpn", "amd", 0.75), ("100000000798open", "unknown_code", "", 0.3)]
    assert two == [] and cited == []
    assert [c.norm for c in intel] == ["bx8071513900k", "srmgd", "coreultra7265k", "265k"]
    rows = table("t string, m string", [("amd epyc 7763", "100-000000314-04"), ("epyc 7742/7702", "EPYC 7742")])
    got = rows.select(processors.candidates(F.col("t"), F.col("m")).alias("c"), processors.attributes(F.col("t"), F.lower("m")).alias("a")).collect()
    assert (got[0].c[0].norm, got[0].c[0].kind, got[0].a["sample"]) == ("10000000031404", "manufacturer_mpn", "100-000000314-04")
    assert [c.norm for c in got[1].c] == ["epyc7742"]


def test_offer_terms_and_declarations(table):
    texts = ["used not new", "recertified not factory recertified", "no screws used", "recertified used", "factory recertified", "", "not recertified", "seller refurbished"]
    rows = canonical(table, texts).select("i", title.offer_terms(F.col("t")).alias("o"))
    got = rows.select("i", "o", title.with_declared(F.col("o"), F.lit("recertified"), F.lit("factory")).alias("d"), title.with_declared(F.col("o"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n")).orderBy("i").collect()
    value = lambda x: x and x.value
    assert [(value(r.o.condition), r.o.channel, r.o.conflict, r.o.denied, r.o.denied_channels) for r in got] == [
        ("used", None, None, ["new"], None), ("recertified", None, None, None, ["factory"]), (None, None, None, ["used"], None), ("recertified", None, ["recertified", "used"], None, None),
        ("recertified", "factory", None, None, None), (None, None, None, None, None), (None, None, None, ["recertified"], None), ("refurbished", "seller", None, None, None),
    ]
    assert [(value(r.d.condition), r.d.channel, r.d.conflict) for r in got] == [("used", None, None), ("recertified", None, None), (None, None, None), (None, None, ["recertified", "used"]), ("recertified", "factory", None), ("recertified", "factory", None), (None, None, None), ("refurbished", "seller", None)]
    assert [(value(r.n.condition), r.n.channel) for r in got] == [(value(r.o.condition), r.o.channel) for r in got]
