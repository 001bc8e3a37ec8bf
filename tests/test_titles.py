"""How titles and part numbers are read."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import mpn, title


def read(table, texts):
    rows = table("n int, t string", list(enumerate(texts))).select("n", title.canonical_title(F.col("t")).alias("t"))
    a = title.attributes(F.col("t"))
    return rows.select("t", *[c.alias(k) for k, c in a.items()]).orderBy("n").collect()


def test_canonical_form_is_idempotent(table):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "Z", "é", "ß", "—", "‐", "①", " ", ",", ";", "|", "(", ")", "9", ".", "replaces", " for ", "\n", "™"]) for _ in range(30)) for _ in range(200)]
    once = table("n int, t string", list(enumerate(texts))).select("n", title.canonical_title(F.col("t")).alias("t"))
    twice = once.select("n", title.canonical_title(F.col("t")).alias("t"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_canonical_examples(table):
    got = [r.t for r in read(table, ["WOW!! Seagate  Exos – 16TB, FREE SHIPPING", "Dell tray, replaces HP 16TB; new", None, ""])]
    assert got == ["seagate exos - 16tb", "dell tray - replaces hp 16tb - new", None, ""]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Seagate Exos, comparable to WD Gold", "seagate"),
        ("Drive (compatible with Dell R740 Toshiba) Seagate", "seagate"),
        ("tray replaces (WD Gold) and Toshiba", None),
        ("Compatible WD Red drive", None),
        ("for sale WD Red", "western_digital"),
    ],
)
def test_cited_brands_are_not_read(table, text, want):
    assert read(table, [text])[0].brand == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("not used", None), ("no warranty used", "used"), ("not factory recertified", None), ("like new", None), ("new pull", "used"), ("98% new", None), ("factory recertified", "recertified"), ("for parts not working", "for_parts"), ("used, not new", "used"), ("brand new sealed", "new"), ("never been opened or used", "used"), ("open box new", "open_box")],
)
def test_conditions(table, text, want):
    got = read(table, [text])[0].condition
    assert (got and got.value) == want


def test_attributes(table):
    r, s = read(table, ['WD Red Plus 12TB SATA 6Gb/s 3.5" 7200 RPM 256MB cache CMR 512e SED 5yr warranty lot of 4', "Seagate IronWolf Pro 8tb 12tb 7.2k rpm 2 pcs 10-pack auction lot #7"])
    assert (r.capacity.bytes, r.capacity.confidence, r.interface, r.form_factor, r.rpm, r.cache_mb, r.recording, r.sector_format, r.security, r.link_gbps, r.warranty_years) == (12 * 10**12, 0.9, "sata", "3.5", 7200, 256, "cmr", "512e", "sed", 6.0, 5)
    assert (r.brand, r.families, r.quantity.n) == ("western_digital", ["western_digital/red plus"], 4)
    assert (s.capacity.confidence, s.rpm, s.families, s.quantity.n) == (0.5, 7200, ["seagate/ironwolf pro"], 10)


def test_quantities_for_prices(table):
    df = table("t string", [("lot of 2 drive 1 pcs",), ("3 x drive",), ("drive",)]).select(title.offer_quantity(F.col("t")).alias("q"))
    assert [r.q and (r.q.n, r.q.confidence) for r in df.collect()] == [(2, 0.5), (3, 0.7), None]


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("wd20ezaz", ("western_digital", "blue", 2 * 10**12)),
        ("wd120efbx", ("western_digital", "red plus", 12 * 10**12)),
        ("wd201kfgx", ("western_digital", "red pro", 20 * 10**12)),
        ("wd4005fryz", ("western_digital", "gold", None)),
        ("wd1003abcd", None),
        ("wuh721816ale6l4", ("western_digital", "ultrastar", None)),
        ("hdn724040ale640", ("hgst", "deskstar nas", None)),
        ("mg08aca16te", ("toshiba", "mg enterprise capacity", 16 * 10**12)),
        ("mg04aca400e", ("toshiba", "mg enterprise capacity", 4 * 10**12)),
        ("x", None),
    ],
)
def test_part_numbers(table, token, want):
    d = table("t string", [(token,)]).select(mpn.decode(F.col("t")).alias("d")).first().d
    assert (d and (d.vendor, d.family, d.capacity_bytes)) == want


@pytest.mark.parametrize("name", ["q_processor_titles", "q_title_attributes", "q_offer_terms", "q_citation_spans", "q_number_candidates"])
def test_titles_of_one_file_are_read_by_all_tasks(spark, name):
    from tidemark.plans import queries

    out = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_processor_candidates_are_not_broadcast(spark, capsys):
    """The catalog of three rows goes around, not what grows with the parts."""
    from tidemark.plans.title_queries import q_processor_resolution

    q_processor_resolution(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastHashJoin") == plan.count("BuildRight") == 2 and "BuildLeft" not in plan
