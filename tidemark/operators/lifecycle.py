"""Lifecycle of a source from its log of events, as running maxima instead of a fold: what holds now follows from
which of a few kinds of event came last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events and states of the closed vocabulary.
EVENTS = ("success", "transient_failure", "parser_rot", "anti_bot", "unknown_failure", "degradation", "probe_success", "probe_failure", "manual_skip", "manual_reactivate")
STREAK = ("success", "probe_success", "transient_failure", "anti_bot", "parser_rot", "unknown_failure")
ACTIVE, BACKING_OFF, PAUSED, SKIP = "active", "backing_off", "paused_pending_fix", "skip"


def lifecycle(log: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """``log`` with ``state`` after each event.

    A skip lasts until it is reactivated by hand. A pause (anti-bot, an unknown failure, a second parser failure
    in a row) lasts until a probe succeeds or it is reactivated. Else the last success or failure decides. A row of
    parser failures ends with a success or with another failure, not by hand.
    """
    own = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("_n", F.row_number().over(own))
    e = F.col(event)
    ordinary = e.isin(*STREAK)
    # the event before, of those that count for a streak
    before = F.last(F.when(ordinary, e), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_hold", e.isin("anti_bot", "unknown_failure") | ((e == "parser_rot") & F.coalesce(before == "parser_rot", F.lit(False))))

    def last(which: Column) -> Column:
        return F.coalesce(F.max(F.when(which, F.col("_n"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))

    by_hand, released = last(e == "manual_reactivate"), last(e.isin("manual_reactivate", "probe_success"))
    went_well, went_wrong = last(e.isin("success", "probe_success", "manual_reactivate")), last(e.isin("transient_failure", "parser_rot"))
    state = F.when(last(e == "manual_skip") > by_hand, SKIP).when(last(F.col("_hold")) > released, PAUSED).when(went_wrong > went_well, BACKING_OFF).otherwise(ACTIVE)
    return rows.withColumn("state", state).drop("_n", "_hold")
