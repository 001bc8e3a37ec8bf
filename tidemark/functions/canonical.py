"""One text for one record, whatever wrote it: JSON with sorted keys and no blanks, built from a column's type.

Texts are escaped to ASCII (short escapes where JSON has them, else four lower-case hexadecimal digits, pairs of them
beyond the first plane). Decimals are texts without trailing zeros, so that 18.000 and 18 are one value; whole numbers
and booleans are plain; dates and times are ISO texts in UTC; an absent value is null. Floats have no such form and are
refused, like binary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .let import let

# JSON's short escapes.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def quoted(text: Column) -> Column:
    """A JSON string, in ASCII."""

    def escaped(c: Column) -> Column:
        out = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[c]
        n = F.ascii(c).cast("long")
        pair = F.concat(_unit(F.shiftright(n - 0x10000, 10) + 0xD800), _unit((n - 0x10000) % 0x400 + 0xDC00))
        return F.coalesce(out, F.when(n.between(32, 126), c).when(n < 0x10000, _unit(n)).otherwise(pair))

    def whole(t: Column) -> Column:
        odd = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), escaped), "")
        return F.concat(F.lit('"'), F.when(t.rlike(r'^[ !#-\[\]-~]*\z'), t).otherwise(odd), F.lit('"'))

    return let(text, whole)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The text of a value of type ``kind``; of null, ``null``."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of a record are texts")
        # sorted by the keys themselves, as struct fields are
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        plain = value.cast("string")
        out = F.concat(F.lit('"'), F.when(value == 0, "0").when(F.lit(kind.scale > 0), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain), F.lit('"'))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        micro = F.date_format(value, "SSSSSS")
        zone = "+00:00" if isinstance(kind, T.TimestampType) else ""
        at = F.to_utc_timestamp(value, F.current_timezone()) if zone else value
        out = F.concat(F.lit('"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit(f'{zone}"'))
    elif isinstance(kind, T.StringType):
        out = quoted(value)
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical text")
    return F.when(value.isNull(), null).otherwise(out)


def canonical_hash(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical(value, kind).cast("binary"), 256)
