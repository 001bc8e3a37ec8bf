"""Registered queries of the ledger: orders are its rows, what was shipped its charges, months its cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .common import table
from .registry import query


@query("""WITH s AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'reconciled' END AS status, o_orderdate AS a, greatest(o_orderdate, coalesce(s.last, o_orderdate)) AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
x AS (SELECT kind, 'outstanding' AS line, a - INTERVAL 90 SECOND AS f, TIMESTAMP '2100-01-01' AS t, cents + 100 AS cents FROM o WHERE status = 'open'
UNION ALL SELECT kind, 'settled', a - INTERVAL 90 SECOND, b + INTERVAL 90 SECOND, cents FROM o WHERE status = 'reconciled'
UNION ALL SELECT kind, 'monitoring', b - INTERVAL 90 SECOND, CASE WHEN cents % 7 = 0 THEN TIMESTAMP '2100-01-01' ELSE b + INTERVAL 20 DAY + INTERVAL 90 SECOND END, 100 FROM o WHERE status = 'reconciled'),
c AS (SELECT x AS cycle_start, x + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS cycle_end FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH) t(x))
SELECT cycle_start, cycle_end, kind, line, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM x JOIN c ON f <= cycle_end AND t >= cycle_start GROUP BY 1, 2, 3, 4""")
def q_ledger_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, settled and monitoring charges placed on every month they may touch, widened by a guard of 90 seconds."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    until = F.greatest("o_orderdate", F.coalesce("last", "o_orderdate"))
    rows = o.select(
        F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "reconciled").otherwise("void").alias("status"),
        F.col("o_orderdate").alias("reserved_at"),
        until.alias("last_charge_at"),
        until.alias("reconciled_at"),
        (until + F.expr("interval 20 days")).alias("monitoring_last_at"),
        (cents % 7 == 0).alias("monitoring_open"),
        cents.alias("estimate"),
        cents.alias("actual"),
        F.lit(100).alias("monitoring"),
    )
    month = F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int"))
    ends = F.timestamp_micros(F.unix_micros(F.add_months(month, 1).cast("timestamp")) - 1000)
    cycles = spark.range(84).select(month.cast("timestamp").alias("cycle_start"), ends.alias("cycle_end"))
    out = ledger.placed(rows, cycles, ["kind"], 90.0)
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(plain("cycle_start"), plain("cycle_end"), "kind", "line", "n", F.col("amount").cast("long").alias("cents"))
