"""Outcome and provenance columns of runs, snapshots and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider(endpoint: Column, remote_prefix: str) -> Column:
    """Who collected a snapshot, from where its payload came."""
    return F.when(endpoint.isNull(), "not_recorded").when(F.startswith(endpoint, F.lit(remote_prefix)), "remote").otherwise("local")


def category(hint: Column, evidence: Column) -> Column:
    """The hint if there is one, else what the resolution's evidence (JSON) names."""
    return F.coalesce(F.nullif(hint, F.lit("")), F.nullif(F.get_json_object(evidence, "$.category"), F.lit("")))


def dispatch_category(hint: Column, default: str = "drive") -> Column:
    """struct<category, reject>: a hint that is no slug is a reject, none is the default."""
    good = hint.rlike("^[a-z0-9]+(?:[-_][a-z0-9]+)*$") & (F.length(hint) <= 50)
    return F.struct(F.when(hint.isNull(), default).when(good, hint).alias("category"), F.when(hint.isNotNull() & ~good, "bad_category").alias("reject"))


def edge_outcome(evidence: Column, grain: Column) -> Column:
    """What a resolution edge says: an error, a recorded outcome, else accept for any grain but none."""
    told = F.get_json_object(evidence, "$.outcome")
    return F.when(F.get_json_object(evidence, "$.error").isNotNull(), "error").when(told.isin("accept", "review", "none"), told).when(grain != "none", "accept").otherwise("none")


def run_outcome(status: Column, completeness: Column, failure: Column) -> Column:
    """One of six: running, failed, empty, truncated, partial, complete."""
    return (
        F.when(status == "running", "running")
        .when((status == "failed") | failure.isNotNull(), "failed")
        .when(completeness == "complete_empty", "empty")
        .when(completeness.isin("truncated", "partial"), completeness)
        .otherwise("complete")
    )


def token_of(text: Column, tokens: tuple[str, ...]) -> Column:
    """The first of the tokens that a free text holds."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(t)), F.lit(t)) for t in tokens])


def kit_total(modules: Column, size: Column) -> Column:
    """Of memory; unknown where either is."""
    return modules * size


def selected_stats(stats: Column, names: tuple[str, ...], prefix: str) -> Column:
    """Entries of a string map by name or prefix."""
    return F.map_filter(stats, lambda k, _: k.isin(*names) | F.startswith(k, F.lit(prefix)))
