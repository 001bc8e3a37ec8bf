"""Whether a run saw everything: sweep verdicts, remote run classes, what may then be concluded about absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds, in their order; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks])


def sweep_verdicts(pages: DataFrame, by: list[str], page_limit: int, page_cap: int, sweeps: DataFrame | None = None) -> DataFrame:
    """Per sweep ``verdict``: null if its pages prove that they hold all results, else the first reason against.

    ``pages``: by, page_no (from 0), parsed boolean, offset, total, items, distinct_ids array, has_next, dropped.
    Of several bad pages the first counts, by the first check that it fails. Several pages never prove a sweep, as
    rows can move between them. ``sweeps`` (by): those that must have a verdict, so that one without pages is empty.
    """
    bad = first_reason([
        ("unparseable_page", ~F.coalesce("parsed", F.lit(False))),
        ("offset_gap", ~F.coalesce(F.col("offset") == F.col("page_no") * page_limit, F.lit(False))),
        ("silent_window_end", (F.col("items") == 0) & (F.col("page_no") > 0)),
        ("total_missing", F.col("total").isNull()),
    ])
    rows = pages.withColumn("_bad", bad)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("_dropped"),
        F.min(F.when(F.col("_bad").isNotNull(), F.struct("page_no", "_bad"))).alias("_first"),
        F.max_by(F.coalesce("has_next", F.lit(False)), "page_no").alias("_next"),
        F.count_distinct("total").alias("_totals"),
        F.max("total").alias("_total"),
    )
    ids = rows.select(*by, F.explode("distinct_ids").alias("_id")).groupBy(*by).agg(F.count_distinct("_id").alias("n_ids"))
    met = lambda a, b: [a[k].eqNullSafe(b[k]) for k in by]
    out = out.join(ids, met(out, ids), "left").select(*[out[c] for c in out.columns], F.coalesce("n_ids", F.lit(0)).cast("int").alias("n_ids"))
    if sweeps is not None:
        asked = sweeps.select(*by).distinct()
        out = asked.join(out, met(asked, out), "left").select(*[asked[k] for k in by], *[F.coalesce(c, F.lit(0)).alias(c) if c in ("n_pages", "n_ids") else c for c in out.columns if c not in by])
    verdict = F.coalesce(
        first_reason([("empty", F.col("n_pages") == 0), ("parse_drop", F.col("_dropped") > 0)]),
        F.col("_first._bad"),
        first_reason([
            ("page_cap", F.col("_next") & (F.col("n_pages") >= page_cap)),
            ("next_present", F.col("_next")),
            ("total_unstable", F.col("_totals") != 1),
            ("total_exceeds_seen", F.col("_total") > F.col("n_ids")),
            ("multi_page_unprovable", F.col("n_pages") > 1),
        ]),
    )
    return out.select(*by, "n_pages", "n_ids", verdict.alias("verdict"))


#: Limits in the order in which they name a truncation.
LIMITS = ("time", "bytes", "requests", "pages", "items")


def contradictions(status: Column, report: Column, counted: Column) -> Column:
    """Where a report disagrees with itself, with its run or with its dataset: names in a fixed order."""
    whole, hit = report["complete"], F.size(report["limits"]) > 0
    emitted, said_items, got_pages, said_pages = (report[c] for c in ("items_emitted", "items_declared", "pages_fetched", "pages_declared"))
    miscounted = ~emitted.eqNullSafe(counted)
    named = [
        ("complete_with_limit_hit", whole & hit),
        ("complete_and_truncated", whole & report["truncated"]),
        ("truncated_without_limit_hit", report["truncated"] & ~hit & (status != "TIMED-OUT")),
        ("status_mismatch", (status == "SUCCEEDED") & ~report["succeeded"]),
        ("count_mismatch", miscounted),
        ("complete_with_items_declared_mismatch", ~miscounted & whole & (emitted != said_items)),
        ("pages_fetched_exceed_declared", got_pages > said_pages),
        ("complete_with_pages_unfetched", whole & (got_pages < said_pages)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named]))


def run_class(status: Column, report: Column, counted: Column, usable: Column) -> Column:
    """struct<completeness, reason, limit> of a remote run that has ended.

    status: SUCCEEDED, FAILED, ABORTED or TIMED-OUT; counted, usable: rows of the dataset, and those that pass the
    contract; report: what the run says of itself, null without a report: struct<schema_ok, valid, scope_ok,
    complete, truncated, succeeded boolean, limits array, items_emitted, items_declared, pages_fetched,
    pages_declared, errors array>. Doubt about the report comes first, then failed work, then what cut it short,
    then what it leaves unexplained; ``limit`` names the cut.
    """

    def kind(completeness: str, reason: str | Column, limit: Column | None = None) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(completeness).alias("completeness"), reason.alias("reason"), (F.lit(None).cast("string") if limit is None else limit).alias("limit"))

    no = F.lit(False)
    against = contradictions(status, report, counted)
    broke = status.isin("FAILED", "ABORTED")
    late = status == "TIMED-OUT"
    hit = F.filter(F.array(*[F.lit(x) for x in LIMITS]), lambda x: F.array_contains(report["limits"], x) | (late & (x == "time")))
    empty = report["complete"] & (report["pages_fetched"] >= 1) & (report["items_declared"] == 0) & (report["items_emitted"] == 0)
    return (
        F.when(report.isNull(), kind("failed", "missing_output"))
        .when(~report["schema_ok"], kind("failed", "unknown_schema_version"))
        .when(~report["valid"], kind("failed", "invalid_output"))
        .when(~report["scope_ok"], kind("failed", "scope_mismatch"))
        .when(F.size(against) > 0, kind("failed", F.concat(F.lit("contradictory_report: "), F.array_join(against, ", "))))
        .when((counted > 0) & (usable == 0), kind("failed", "no_usable_items"))
        .when(broke & (counted > 0), kind("partial_failure", "remote_failed_with_items"))
        .when(broke, kind("failed", "remote_failed_empty"))
        .when(F.size(report["errors"]) > 0, kind("partial_failure", F.concat(F.lit("errors_reported: "), F.array_join(F.array_sort(F.array_distinct(report["errors"])), ", "))))
        .when(F.size(hit) > 0, kind("truncated", F.concat(F.lit("truncated: "), F.array_join(hit, ", ")), F.get(hit, F.lit(0))))
        .when((counted == 0) & F.coalesce(empty, no), kind("complete", "complete_empty"))
        .when(counted == 0, kind("failed", "ambiguous_empty"))
        .when(~F.coalesce(report["complete"], no), kind("failed", "unexplained_incomplete"))
        .when(usable < counted, kind("partial_failure", "unusable_items"))
        .otherwise(kind("complete", "complete"))
    )


def admitted(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Requests (source, category) that the matrix (source, category, status) admits; Spark broadcasts the matrix under its threshold."""
    good = matrix.where("status = 'admitted'").select(F.col("source").alias("_source"), F.col("category").alias("_category")).distinct()
    return requests.join(good, (F.col("source") == F.col("_source")) & (F.col("category") == F.col("_category")), "left_semi")


def start_denied(enabled: Column, state: Column, probe: Column, backoff_until: Column, now: Column, tokens: Column) -> Column:
    """Why a run may not start now; null if it may. Probes may start from a pause."""
    return first_reason([
        ("disabled", ~enabled),
        ("skipped", state == "skip"),
        ("paused", (state == "paused_pending_fix") & ~probe),
        ("backing_off", backoff_until > now),
        ("no_tokens", tokens < 1),
    ])


def freshness(observed: Column, cadence_s: Column, now: Column, paused: Column) -> Column:
    """Fresh within two cadences; no observation and no known cadence can't vouch for a price, so they are stale. A
    source whose budget is used up is paused, not stale."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))) / 1_000_000
    return F.when(F.coalesce(paused, F.lit(False)), "budget_paused").when(F.coalesce(age > 2 * cadence_s, F.lit(True)), "stale").otherwise("fresh")


def matched_one_to_one(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of either side without exactly one partner: key, n_predictions, n_labels."""
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n_predictions"))
    q = labels.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n_labels"))
    both = p.join(q, F.col(key).eqNullSafe(F.col("_key")), "full")
    out = both.select(F.coalesce(key, "_key").alias(key), F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"))
    return out.where("n_predictions <> 1 or n_labels <> 1")
