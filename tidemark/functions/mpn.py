"""Decoding of manufacturer part numbers by shape: vendor, capacity, family, as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GB = 1_000_000_000
TB = 1_000_000_000_000
# Shapes of the makers' numbers and the families that their letters name.
SEAGATE = r"^st(\d{3,6})([a-z]{2})(\d{3})([a-z0-9]?)$"
SEAGATE_FAMILIES = {"ne": "ironwolf pro", "vn": "ironwolf", "vx": "skyhawk", "dm": "barracuda"}
WD = r"^wd(\d{2,4})([a-z]{4})$"
WD_FAMILIES = {"kf": "red pro", "kr": "gold", "fr": "gold", "pu": "purple", "ez": "blue"}
WD_RED_PLUS = ("efpx", "efzx", "efzz", "efgx", "efbx")
HGST = r"^(wuh|wus|huh|hus|hdn)(\d{6})([a-z0-9]{4,8})$"
HGST_FAMILIES = {"wuh": "ultrastar", "wus": "ultrastar", "huh": "ultrastar", "hus": "ultrastar", "hdn": "deskstar nas"}
TOSHIBA = r"^(mg|mn)(\d{2})([a-z]{3})(?:(\d{1,2})t|(\d)00)([a-z]{0,3})$"
TOSHIBA_FAMILIES = {"mg": "mg enterprise capacity", "mn": "n300"}


def _look_up(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def _said(vendor: Column, family: Column, capacity: Column, generation: Column, source: Column, rule: Column) -> Column:
    return F.struct(vendor.alias("vendor"), family.alias("family"), capacity.cast("long").alias("capacity_bytes"), generation.alias("generation"), source.alias("provenance"), rule.alias("rule"))


def _digits(token: Column, shape: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(token, shape, group), F.lit("")).cast("long")


def decode_seagate(token: Column) -> Column:
    """struct<vendor, family, capacity_bytes, generation, provenance, rule> of a normalized token; null if it has another shape."""
    part = lambda i: F.regexp_extract(token, SEAGATE, i)
    family = _look_up(SEAGATE_FAMILIES, part(2))
    source = F.when(family.isNotNull(), "corroborated_community").otherwise("vendor_official")
    return F.when(token.rlike(SEAGATE), _said(F.lit("seagate"), family, _digits(token, SEAGATE, 1) * GB, F.nullif(part(4), F.lit("")), source, F.concat(F.lit("st:"), part(2))))


def decode_wd(token: Column) -> Column:
    """Two digits are tenths of a TB, of three the first two are TB, four are not guessed. Neither family nor capacity: null."""
    digits, suffix = F.regexp_extract(token, WD, 1), F.regexp_extract(token, WD, 2)
    family = F.coalesce(_look_up(WD_FAMILIES, F.substring(suffix, 1, 2)), F.when(suffix.isin(*WD_RED_PLUS), "red plus"))
    tenths = F.when(F.length(digits) == 2, _digits(token, WD, 1)).when(F.length(digits) == 3, F.floor(_digits(token, WD, 1) / 10) * 10)
    source = F.when(tenths.isNull(), "inferred").otherwise("corroborated_community")
    return F.when(token.rlike(WD) & (family.isNotNull() | tenths.isNotNull()), _said(F.lit("western_digital"), family, tenths * (TB // 10), F.lit(None).cast("string"), source, F.concat(F.lit("wd:"), F.substring(suffix, 1, 2))))


def decode_hgst(token: Column) -> Column:
    """The capacity digits mean different things in different lines and are not read."""
    line = F.regexp_extract(token, HGST, 1)
    vendor = F.when(F.startswith(line, F.lit("w")), "western_digital").otherwise("hgst")
    nothing = F.lit(None).cast("string")
    return F.when(token.rlike(HGST), _said(vendor, _look_up(HGST_FAMILIES, line), F.lit(None), nothing, F.lit("corroborated_community"), F.concat(F.lit("hgst:"), line)))


def decode_toshiba(token: Column) -> Column:
    line = F.regexp_extract(token, TOSHIBA, 1)
    size = F.coalesce(_digits(token, TOSHIBA, 4), _digits(token, TOSHIBA, 5)) * TB
    return F.when(token.rlike(TOSHIBA), _said(F.lit("toshiba"), _look_up(TOSHIBA_FAMILIES, line), size, F.regexp_extract(token, TOSHIBA, 2), F.lit("vendor_official"), F.concat(F.lit("toshiba:"), line)))


def decode(token: Column) -> Column:
    """What the first maker's grammar that fits says."""
    return F.coalesce(decode_seagate(token), decode_wd(token), decode_hgst(token), decode_toshiba(token))
