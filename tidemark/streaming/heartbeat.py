"""Heartbeat streams: change decisions with state per key, day counts under a watermark, replay-safe history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.latest import absent_rows

_OUT = "key long, ts timestamp, price double, stock string, decision string"


def change_stream(readings: DataFrame, least_drop: float = 0.0, ttl_ms: int | None = None) -> DataFrame:
    """``ttl_ms``: a key that is silent for so long is forgotten, and its next reading is a first sighting; only for
    streams that run on, as one with timeouts never comes to an end. ``readings`` (streaming): key long, ts timestamp, price double, stock string, and fingerprint string where there
    is one. Adds ``decision``, by the rule of ``runs.change_decisions``; rows older than the last are marked late,
    not dropped. Of a key, the rows of one trigger are in memory at once (bound them by the source's files per trigger).
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        last = state.get if state.exists else None
        late = at < last[0] if last else np.zeros(len(rows), bool)
        works = rows["stock"].notna().to_numpy() & ~late
        # every working reading beside the one before it, the state being the first
        seen = rows.loc[works, ["price", "stock", "fingerprint"]]
        old = pd.DataFrame([last[1:]], columns=["price", "stock", "fingerprint"]) if last else None
        chain = pd.concat([old, seen], ignore_index=True) if last else seen.reset_index(drop=True)
        was = chain.shift(1).iloc[1 if last else 0 :].reset_index(drop=True)
        now = seen.reset_index(drop=True)
        first = np.arange(len(now)) == 0 if not last else np.zeros(len(now), bool)
        fell = ((now["price"] < was["price"]) & ((was["price"] - now["price"]) / was["price"] >= least_drop)).fillna(False).to_numpy(bool)
        alike = ((now["fingerprint"] == was["fingerprint"]) & now["fingerprint"].notna()).to_numpy(bool)
        moved = (now["stock"] != was["stock"]).to_numpy(bool) | fell
        said = np.select([(now["stock"] == "unknown").to_numpy(bool), first, alike, moved], ["ambiguous", "transition_detected", "unchanged", "transition_detected"], "unchanged")
        out = np.where(late, "late", "failed").astype(object)
        out[works] = said
        if len(now):
            end = now.iloc[-1]
            state.update((int(at[works][-1]), None if pd.isna(end["price"]) else float(end["price"]), str(end["stock"]), None if pd.isna(end["fingerprint"]) else str(end["fingerprint"])))
        if ttl_ms is not None and (state.exists or len(now)):
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "price": rows["price"], "stock": rows["stock"], "decision": out})

    mark = F.col("fingerprint") if "fingerprint" in readings.columns else F.lit(None).cast("string")
    rows = readings.select("key", "ts", "price", "stock", mark.alias("fingerprint"))
    return rows.groupBy("key").applyInPandasWithState(decide, _OUT, "at long, price double, stock string, fingerprint string", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def daily_stream(rows: DataFrame, at: str, by: list[str], late: str = "3 days") -> DataFrame:
    """Counts by day and ``by``; a day is final once the watermark has passed it."""
    counts = rows.withWatermark(at, late).groupBy(F.window(at, "1 day"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), *by, "n")


def new_only(rows: DataFrame, keys: list[str], at: str, late: str = "3 days") -> DataFrame:
    """Replayed rows of a key within the watermark are dropped, and so are rows that come after it: for counts and
    alerts, not for history."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_history(rows: DataFrame, keys: list[str], at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows whose key the history under ``path`` lacks, however late they are; started, and run to the
    end of what is there. A batch that is played again finds its own rows and adds none.

    The history is kept by day of ``at`` (column ``day``), and a batch reads the days that it holds rows of; a row that
    comes again has the same time.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("day", F.to_date(at))
    spark.createDataFrame([], dated.schema).write.mode("append").partitionBy("day").parquet(path)

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        days = [r["day"] for r in new.select("day").distinct().collect()]  # as many as a batch has days
        there = spark.read.schema(dated.schema).parquet(path).where(F.col("day").isin(days) | (F.col("day").isNull() & F.lit(None in days)))
        absent_rows(new, there, keys).write.mode("append").partitionBy("day").parquet(path)

    return dated.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
