"""Join keys, hashes and fingerprints of text and records."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form and full case folding, which the JVM functions don't have."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def alias_key_ascii(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def alias_key(text: Column) -> Column:
    """The one key on which titles and catalog names meet: folded letters and digits of ASCII.
    For texts that are known to be ASCII, alias_key_ascii is the same without leaving the JVM."""
    return F.regexp_replace(folded(text), "[^a-z0-9]", "")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_hash(text: Column, json: Column) -> Column:
    return sha(F.coalesce(text, json))


def reading_fingerprint(*parts: Column) -> Column:
    """Of an availability reading: its parts as text, absent ones as None."""
    return sha(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def plain_decimal(x: Column) -> Column:
    """A decimal as text without trailing zeros."""
    s = x.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def record_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of a record as canonical JSON: keys in order, absent values as null, no blanks."""

    def said(c: Column) -> Column:
        escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
        return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}":'), said(fields[k].cast("string"))) for k in sorted(fields)]
    return sha(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def stock_status(raw: Column) -> Column:
    """A stock status of the closed vocabulary; anything else is unknown."""
    return F.when(raw.isin(*STOCK), raw).otherwise("unknown")


#: The closed vocabulary of stock states.
STOCK = ("in_stock", "out_of_stock", "preorder", "unknown")
