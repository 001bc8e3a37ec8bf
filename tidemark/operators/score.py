"""Deal score (a design, not a feature in use): price rank in a cohort of decayed observations, seller trust, fitness, stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the parts, the least a part counts, and what caps the whole.
WEIGHTS = {"price": 0.50, "fit": 0.25, "seller": 0.15, "stock": 0.10}
FLOOR, CAP_RECORDING, CAP_RETURNS, CAP_SELLER = 0.02, 0.35, 0.60, 0.60


def decay(age_days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def cohort_rank(observations: DataFrame, cohort: str, value: str, weight: Column, full_at: float = 30.0) -> DataFrame:
    """Per observation: q, the weighted share of the cohort below it with ties counted half; n_eff, the cohort's
    effective size; s_price, cheap is high, pulled to 0.5 while the cohort is small.

    Weights are summed per (cohort, value) first, so the running sum goes over distinct values, not observations."""
    rows = observations.withColumn("_w", weight)
    values = rows.groupBy(cohort, value).agg(F.sum("_w").alias("_wv"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"))
    whole = Window.partitionBy(cohort)
    below = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_wv").over(whole)
    ranked = values.select(
        F.col(cohort).alias("_c"),
        F.col(value).alias("_v"),
        ((F.coalesce(F.sum("_wv").over(below), F.lit(0.0)) + 0.5 * F.col("_wv")) / total).alias("q"),
        (total * total / F.sum("_w2").over(whole)).alias("n_eff"),
    )
    out = rows.join(ranked, (F.col(cohort) == F.col("_c")) & (F.col(value) == F.col("_v"))).drop("_c", "_v", "_w")
    trust = F.least(F.lit(1.0), F.col("n_eff") / full_at)
    return out.withColumn("s_price", trust * (1 - F.col("q")) + (1 - trust) * 0.5).withColumn("provisional", F.col("n_eff") < full_at)


def seller_trust(positive: Column, n: Column, unrated: float = 0.60) -> Column:
    """0.6 of a Beta(19, 1) posterior mean and 0.4 of a Wilson lower bound at 80 %."""
    z = 1.2816
    p, m = positive.cast("double"), n.cast("double")
    mean = (19.0 + p * m) / (20.0 + m)
    low = (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m)
    return F.when(n.isNull() | (n == 0), F.lit(unrated)).otherwise(0.6 * mean + 0.4 * low)


def fitness(suit: Column, warranty: Column, condition: Column) -> Column:
    return 0.5 * suit + 0.3 * warranty + 0.2 * condition


def total_score(price: Column, fit: Column, seller: Column, stock: Column, wrong_recording: Column, no_returns: Column) -> Column:
    """0 to 100: weighted geometric mean of the parts under the caps, half rounded up."""
    parts = {"price": price, "fit": fit, "seller": seller, "stock": stock}
    logs = [F.log(F.greatest(parts[k], F.lit(FLOOR))) * w for k, w in WEIGHTS.items()]
    base = F.exp(logs[0] + logs[1] + logs[2] + logs[3])
    cap = F.least(F.when(wrong_recording, CAP_RECORDING).otherwise(1.0), F.when(no_returns, CAP_RETURNS).otherwise(1.0), F.when(seller < 0.5, CAP_SELLER).otherwise(1.0))
    return F.round(100 * F.least(base, cap)).cast("int")


def price_events(history: DataFrame, key: str, at: str, tie: str, price: str) -> DataFrame:
    """Rows at which the price differs from the one before: the first of each run of equal prices."""
    own = Window.partitionBy(key).orderBy(at, tie)
    was = F.lag(F.struct(price)).over(own)
    return history.withColumn("_was", was).where(F.col("_was").isNull() | ~F.col(f"_was.{price}").eqNullSafe(F.col(price))).drop("_was")
