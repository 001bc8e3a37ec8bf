"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of a text (lengths, shares of letter kinds, repetition, line shape) are Spark columns.
2. A forest of shallow trees is fitted to the labelled texts' statistics; every path from a root to a
   node becomes a rule, a conjunction of bounds on statistics. Rules that say the same are one rule.
3. A lasso logistic regression on the rules' truth values keeps few of them and weighs them.
4. The rules kept are compiled into one Spark column expression, so scoring is a projection.

Labels are learnt from at most about FIT_ROWS labelled rows, taken by a hash of the id; all other work
covers all rows. The statistics see the text alone.

Cases: a null text is an empty text, and the empty text has statistics like any other. Labels that are
null count as absent; of several labels of an id the mean decides, a tie is 1. Rows that share an id
share its label. Without labels every score is 0.5; with labels of one class only every score is that
class's share, smoothed (Laplace). An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, written

#: Labelled rows that are fitted to, about.
FIT_ROWS = 20_000
TREES, DEPTH = 12, 3
LASSO = 1e-3

Rule = tuple[tuple[int, str, float], ...]


def statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Name and column of each statistic of a text that isn't null, its words and its lines; none is null."""
    length, n = F.length(t), F.size(words)

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    def share(pattern: str) -> Column:
        """Characters of a class, as a share of all."""
        return rate(length - F.length(F.regexp_replace(t, pattern, "")), length)

    again = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    return {
        "chars": length.cast("double"),
        "words": n.cast("double"),
        "word_chars": rate(length, n),
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "blanks": share(r"\s+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"!?()\-]+"),
        "shouts": share("[!?]+"),
        "sentence_ends": rate(F.regexp_count(t, F.lit(r"[.!?](?=\s|$)")), n),
        "distinct_words": rate(F.size(F.array_distinct(words)), n),
        "repeats": rate(again, n),
        "distinct_lines": rate(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_chars": rate(length, F.size(lines)),
    }


def with_statistics(df: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    """``df`` with one column for each statistic, and their names."""
    # texts are cut once, in a step of its own: inside the lambdas below it would be done for every word
    t = F.coalesce(text, F.lit(""))
    cut = df.select("*", t.alias("_text"), F.array_remove(F.split(t, r"\s+"), "").alias("_words"), F.split(t, "\n").alias("_lines"))
    stats = {f"_stat_{k}": c for k, c in statistics(F.col("_text"), F.col("_words"), F.col("_lines")).items()}
    return cut.select(*df.columns, *[c.alias(k) for k, c in stats.items()]), list(stats)


def tree_rules(forest: str) -> list[Rule]:
    """Rules of a forest's printed form: the conjunction of conditions on every path, each bound once."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in forest.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            path = [] if "Tree" in line else path
            continue
        while path and path[-1][0] >= len(m[1]):
            path.pop()
        path.append((len(m[1]), (int(m[2]), m[3], float(m[4]))))
        bounds: dict[tuple[int, str], float] = {}
        for _, (f, op, at) in path:
            tighter = min if op == "<=" else max
            bounds[f, op] = tighter(bounds.get((f, op), at), at)
        found[tuple(sorted((f, op, at) for (f, op), at in bounds.items()))] = None
    return list(found)


def rule_column(rule: Rule, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(names[f]) <= at if op == "<=" else F.col(names[f]) > at for f, op, at in rule])


class RuleEnsemble:
    """What was learnt: an intercept and weighted rules over statistics."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]], names: list[str]) -> None:
        self.intercept, self.rules, self.names = intercept, rules, names

    def score(self) -> Column:
        """0 to 1, from the columns that ``names`` lists."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule, self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, fit_rows: int) -> DataFrame:
    """(label, text) of about ``fit_rows`` labelled rows at most."""
    kept = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{label_id}`").isNotNull())
    kept = kept.groupBy(F.col(f"`{label_id}`").alias("lid")).agg((F.avg(F.col(f"`{label_col}`")) >= 0.5).cast("double").alias("label"))
    kept = written(kept, "labels")
    share = min(1.0, fit_rows / max(1, kept.count()))
    some = kept.where(F.pmod(F.xxhash64(F.lit("fit"), "lid"), F.lit(1 << 20)) < round(share * (1 << 20)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the sample is bounded by fit_rows
    return rows.join(F.broadcast(some), F.col("id") == F.col("lid")).select("label", "text")


def fit_rules(rows: DataFrame) -> RuleEnsemble:
    """The ensemble for ``rows`` (label, text)."""
    stats, names = with_statistics(rows, F.col("text"))
    # a handful of partitions: the sample is small, and every round of the fit visits all of them
    table = written(stats.select("label", *names).repartition(8), "fit")
    sizes = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    n, ones = sum(sizes.values()), sizes.get(1.0, 0)
    if len(sizes) < 2:
        share = (ones + 1) / (n + 2)
        return RuleEnsemble(log(share / (1 - share)), [], names)
    data = VectorAssembler(inputCols=names, outputCol="stats").transform(table)
    forest = RandomForestClassifier(featuresCol="stats", numTrees=TREES, maxDepth=DEPTH, maxBins=144, bootstrap=False, featureSubsetStrategy="onethird", seed=7)
    rules = tree_rules(forest.fit(data).toDebugString)
    flags = [f"rule{i}" for i in range(len(rules))]
    truth = table.select("label", *[rule_column(r, names).cast("double").alias(f) for r, f in zip(rules, flags, strict=True)])
    truth = VectorAssembler(inputCols=flags, outputCol="rules").transform(truth).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(truth)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(float(lasso.intercept), weights, names)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    return fit_rules(labelled(docs, labels, id_col, text_col, label_id, label_col, fit_rows))


def scored(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, which wins a name clash."""
    rows, _ = with_statistics(docs.select(packed(docs)), F.col(f"rec.`{text_col}`"))
    kept = [F.col(f"rec.`{c}`").alias(c) for c in docs.columns if c != score_col]
    return rows.select(*kept, model.score().alias(score_col))


def quality_filter(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more; columns as they were."""
    rows, _ = with_statistics(docs.select(packed(docs)), F.col(f"rec.`{text_col}`"))
    # exploded, not filtered: a filter would be pushed below the statistics, with a copy of them for every rule
    return rows.select(F.explode(F.when(model.score() >= least, F.array("rec"))).alias("rec")).select("rec.*")
