"""A collection run from parsed listings to the shortlist."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import candidates
from tidemark.operators import eligibility
from tidemark.plans import market

T = dt.datetime(2024, 1, 10)
PARSED = "site int, source_listing_key string, observed_at timestamp, title string, price decimal(10,2), currency string, shipping_price decimal(10,2), stock_status string, ships_from_country string, condition_label string, mpn string, category_hint string"


def row(key, title, price, at=0, currency="USD", ship="0", stock="in_stock", country="US", label="", mpn=None):
    return (1, key, T + dt.timedelta(hours=at), title, Decimal(str(price)), currency, None if ship is None else Decimal(ship), stock, country, label, mpn, None)


def kept(df, path):
    """As a run keeps its steps: written, and read again by the next."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_run(table, tmp_path):
    parsed = table(PARSED, [
        row("a", "Seagate Exos ST16000NM001G 16TB SATA used", 150),
        row("a", "Seagate Exos ST16000NM001G 16TB SATA used", 90, at=-5),  # older, arrives later
        row("b", "Seagate ST16000NM001G 16TB SATA new", 120, currency="EUR"),
        row("c", "Seagate ST16000NM001G 16TB SATA used", 100, ship=None),
        row("d", "Toshiba ST16000NM001G 16TB used", 100),
        row("e", "Dell tray for ST16000NM001G used", 10),
        row("f", "16TB drive used", 100, mpn="ST16000NM001G"),
        row("g", "Seagate ST16000NM001G 4TB used", 100),
        row("h", "Seagate ST16000NM001G lot of 2 used", 300),
        row("i", "anything", 100, currency="JPY"),
        row("j", "Seagate ST8000VN004 8TB SATA used", 100),
        row("k", "Seagate ST16000NM001G 16TB SATA used", 500, stock="weird"),
    ])
    rates = table("base string, rate_date date, rate decimal(12,6), source string", [("EUR", dt.date(2024, 1, 8), Decimal("1.1"), "s")])
    normal = market.normalize(parsed, rates)
    assert [r.source_listing_key for r in normal.where("reject is not null").collect()] == ["i"]
    offers = kept(market.read_titles(market.current_offers(normal)), tmp_path / "offers")
    aliases = table("norm string, alias_type string, site int, model_id int, family_id int, brand string", [("st16000nm001g", "mpn", None, 16, 1, "seagate")])
    decisions = kept(market.resolved(offers, aliases), tmp_path / "decisions")
    names = {r.listing_id: r.source_listing_key for r in offers.collect()}
    assert {names[r.listing_id]: (r.outcome, r.reason) for r in decisions.collect()} == {
        **{k: ("accept", "exact_alias") for k in "abcfgk"},
        "d": ("review", "brand_contradicts_exact_alias"),
        "e": ("accept", "exact_alias"),  # "for" cites only at the start of a title
        "h": ("review", "lot"),
        "j": ("accept", "mpn_decode"),
    }
    specs = table("model_id int, capacity_bytes long, interface string", [(16, 16 * 10**12, "sata")])
    watches = table("watch_id int, category string, min_capacity_bytes long, interfaces array<string>, conditions array<string>, max_unit_usd decimal(10,2), require_in_stock boolean, allow_international boolean", [(1, "drive", 12 * 10**12, ["sata"], ["used", "new"], Decimal("200"), True, False), (2, "gpu", None, None, None, None, False, True)])
    out = market.verdicts(offers, decisions, specs, watches)
    got = {names[r.listing_id]: r.verdict for r in out.collect()}
    assert got == {"a": "match", "b": "match", "c": "unknown", "d": "unknown", "e": "match", "f": "match", "g": "unknown", "h": "unknown", "j": "no_match", "k": "no_match"}
    best = eligibility.shortlist(out, "usd", "listing_id").collect()
    assert [(names[r.listing_id], float(r.usd)) for r in best] == [("e", 10.0), ("f", 100.0), ("b", 132.0), ("a", 150.0)]


def test_candidates(table):
    df = table("t string, m string", [("seagate st16000nm001g st16000nm001g wd120efbx replaces mg08aca16te", "ST-1"), ("nothing", ""), (None, None)])
    got = df.select(candidates.candidates(F.col("t"), F.col("m")).alias("c")).select("c", candidates.distinct_mpns(F.col("c")).alias("n")).collect()
    assert [[(x.norm, x.kind) for x in r.c] if r.c else r.c for r in got][:2] == [[("st1", "unknown_code"), ("st16000nm001g", "manufacturer_mpn"), ("wd120efbx", "manufacturer_mpn")], []]
    assert got[0].n == 2


def test_drive_candidates_by_rule(table):
    cases = [
        ("seagate st16000nm001g dell dp/n 0abc12 005049070", None, [("st16000nm001g", "manufacturer_mpn", "seagate"), ("005049070", "oem", "dell_emc"), ("abc12", "oem", "dell_emc"), ("0abc12", "unknown_code", "")]),
        ("005049070 drive", None, []),
        ("hp 123456-b21 fru: 00ab123 netapp x477a-r6", None, [("123456b21", "oem", "hpe"), ("x477ar6", "oem", "netapp"), ("00ab123", "oem", "lenovo_ibm")]),
        ("123456-b21 compatible with hp x477a", None, []),
        ("wuh721818ale6l4 0f38353 qx-77zz9", None, [("wuh721818ale6l4", "manufacturer_mpn", "western_digital"), ("qx77zz9", "unknown_code", ""), ("0f38353", "unknown_code", "")]),
        ("wd40efrx 7200rpm 12.5tb 100gb/s", "WD40EFRX", [("wd40efrx", "manufacturer_mpn", "western_digital")]),
        ("acme-12345 thing", "acme-12345", [("acme12345", "unknown_code", "")]),
        (None, None, None),
    ]
    df = table("i int, t string, m string", [(i, t, m) for i, (t, m, _) in enumerate(cases)])
    got = df.select("i", candidates.candidates(F.col("t"), F.col("m"), ("acme",)).alias("c")).withColumn("n", candidates.mpns(F.col("c"))).orderBy("i").collect()
    assert [r.c and [(c.norm, c.kind, c.vendor) for c in r.c] for r in got] == [w for *_, w in cases]
    flags = {c.norm: (c.structured, c.review_only, c.title_kind) for r in got if r.c for c in r.c}
    assert flags["0f38353"] == (False, True, None) and flags["wd40efrx"] == (True, False, "manufacturer_mpn") and flags["acme12345"] == (True, False, "house_sku")
    assert [r.n for r in got] == [["st16000nm001g"], [], [], [], ["wuh721818ale6l4"], ["wd40efrx"], [], None]


def test_candidates_of_cards_and_memory(table):
    names = lambda text, vendor: [c.norm for c in table("t string, v string", [(text, vendor)]).select(candidates.gpu_candidates(F.col("t"), F.col("v")).alias("c")).first().c]
    assert names("nvidia geforce rtx 4090 24gb pcie", "nvidia") == ["geforcertx4090", "rtx4090", "nvidiageforcertx4090", "geforcertx409024gb", "rtx409024gb", "nvidiageforcertx409024gb", "geforcertx409024gbpcie", "rtx409024gbpcie", "nvidiageforcertx409024gbpcie"]
    assert names("nvidia a100, (80gb) 12gb/s", "nvidia") == ["a100", "nvidiaa100", "a10080gb", "nvidiaa10080gb"]
    assert names("radeon pro w6800 900-12345-1234-000", "amd") == ["90012345" + "1234000", "radeonprow6800", "w6800"]
    assert names("rtx 4090", None) == [] and names("", "amd") == []
    rows = table("t string, m string", [("samsung m393a8g40ab2-cwe hpe p12345-b21 pc4-25600", None), ("kingston ksm32rd4/64 2rx4", "KSM32RD4/64"), ("dell a1234567 snpabcde1/16g", "x")])
    got = [[(c.norm, c.kind) for c in r.c] for r in rows.select(candidates.ram_candidates(F.col("t"), F.col("m")).alias("c")).collect()]
    assert got == [[("m393a8g40ab2cwe", "manufacturer_mpn"), ("p12345b21", "oem")], [("ksm32rd464", "manufacturer_mpn")], [("x", "unknown_code"), ("snpabcde116g", "oem"), ("a1234567", "oem")]]
    basic = table("t string, m string", [("intel x710-da2 card 10gbe", "X710DA2")]).select(candidates.basic_candidates(F.col("t"), F.col("m")).alias("c")).first().c
    assert [(c.norm, c.structured) for c in basic] == [("x710da2", True)]
