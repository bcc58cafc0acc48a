"""How stable scores are when the same records are scored again by further runs.

Runs are never paired. The outcomes of a record and pillar fold to one vector of counts, how many runs gave each
score, and all measures are sums over vectors: a vector with counts ``n_c`` of ``m`` ratings adds
``n_c * (n_k - [c = k])`` ordered pairs of ratings, which weigh ``1 / (m - 1)`` each. Vectors are added up as whole
numbers by ``(pillar, m)``, so a report comes from a table with a few rows for each number of runs,
and does not depend on partitioning. Both folds combine map-side: a record with a third of all outcomes
sends one row per task and run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgespark.operators.crosstab import quoted
from judgespark.schema import OVERALL, PILLARS, SCORES

_COUNTS = [f"n{s}" for s in SCORES]
_CELLS = [(c, k) for c in SCORES for k in SCORES if c <= k]


def run_scores(outcomes: DataFrame, pillars: Sequence[str] | None = None) -> DataFrame:
    """``(record_id, pillar, run_id, score)``: the last outcome of each run, ``score`` null where it failed.

    Scores beyond the scale count at its nearest end.
    """
    low, high = SCORES[0], SCORES[-1]
    score = F.greatest(F.lit(low), F.least(F.lit(high), F.col("result.score")))
    score = F.when(F.col("result.score").isNotNull(), score)  # greatest and least skip nulls
    active = outcomes.where(F.col("pillar").isin(list(PILLARS if pillars is None else pillars)))
    # Of several outcomes with one index that with the highest score, so that the choice is always the same.
    last = F.max(F.struct("outcome_index", score.alias("score"))).alias("_last")
    return active.groupBy("record_id", "pillar", "run_id").agg(last).select("record_id", "pillar", "run_id", "_last.score")


def score_vectors(runs: DataFrame) -> DataFrame:
    """One row per record and pillar of :func:`run_scores`: ``n1 .. n5``, ratings ``m``, and ``failed`` runs."""
    counts = [F.count_if(F.col("score") == s).alias(n) for s, n in zip(SCORES, _COUNTS)]
    more = [F.count("score").alias("m"), F.count_if(F.col("score").isNull()).alias("failed")]
    return runs.groupBy("record_id", "pillar").agg(*counts, *more)


def _sum(power: int) -> str:
    return "(" + " + ".join(f"{s**power} * n{s}" for s in SCORES) + ")"


_MODAL = f"greatest({', '.join(_COUNTS)})"


def record_stability(vectors: DataFrame) -> DataFrame:
    """Spread of the ratings of each record and pillar; measures of spread are null below two ratings."""
    lowest = "CASE " + " ".join(f"WHEN n{s} > 0 THEN {s}" for s in SCORES) + " END"
    highest = "CASE " + " ".join(f"WHEN n{s} > 0 THEN {s}" for s in reversed(SCORES)) + " END"
    mode = "CASE " + " ".join(f"WHEN m > 0 AND n{s} = {_MODAL} THEN {s}" for s in SCORES) + " END"
    return vectors.selectExpr(
        "record_id",
        "pillar",
        "m AS ratings",
        "failed AS failed_runs",
        f"{lowest} AS lowest_score",
        f"{highest} AS highest_score",
        f"{mode} AS modal_score",
        f"try_divide(double({_sum(1)}), double(m)) AS mean_score",
        f"CASE WHEN m > 1 THEN double(m * {_sum(2)} - {_sum(1)} * {_sum(1)}) / double(m * (m - 1)) END AS score_variance",
        f"CASE WHEN m > 1 THEN {_MODAL} = m END AS unanimous",
    )


def folded(vectors: DataFrame) -> DataFrame:
    """Sums of vectors by ``(pillar, m)``, as whole numbers."""
    wide = lambda x: f"CAST({x} AS DECIMAL(18, 0))"  # noqa: E731 - products of counts leave the BIGINT range
    cells = [
        f"sum({wide(f'n{c}')} * {wide(f'(n{k} - 1)' if c == k else f'n{k}')}) AS p{c}{k}" for c, k in _CELLS
    ]
    return vectors.groupBy("pillar", "m").agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("failed").alias("failed"),
        F.expr(f"count_if({_MODAL} = m) AS unanimous"),
        F.expr(f"sum({_MODAL}) AS modal"),
        F.expr(f"sum({wide('m')} * {wide(_sum(2))} - {wide(_sum(1))} * {wide(_sum(1))}) AS spread"),
        *[F.expr(c) for c in cells],
    )


def alpha() -> str:
    """Krippendorff's alpha for ordinal scores over coincidences ``o<c><k>`` and their marginals ``t<c>``.

    NULL where all ratings are alike, so that no disagreement can be expected.
    """

    def apart(c: int, k: int) -> str:
        between = " + ".join(f"t{g}" for g in range(c, k + 1))
        return f"(({between}) - (t{c} + t{k}) / 2D)"

    unequal = [(c, k) for c, k in _CELLS if c != k]
    observed = " + ".join(f"o{c}{k} * {apart(c, k)} * {apart(c, k)}" for c, k in unequal)
    expected = " + ".join(f"t{c} * t{k} * {apart(c, k)} * {apart(c, k)}" for c, k in unequal)
    return f"1D - try_divide((double(ratings) - 1D) * ({observed}), {expected})"


def stability_report(
    vectors: DataFrame, pillars: Sequence[str] | None = None, include_overall: bool = True
) -> DataFrame:
    """Per pillar, and over all, from :func:`score_vectors`:

    ``records`` rated twice or more and their ``ratings``, ``single_records`` rated at most once, ``failed_runs``,
    ``unanimous_share``, ``modal_share`` (the mean share of a record's ratings that give its most frequent
    score), ``mean_variance`` of a record's ratings, and Krippendorff's ``alpha``. Pillars without
    repeated ratings have zero counts and null measures.
    """
    names = list(PILLARS if pillars is None else pillars)
    folds = folded(vectors.where(F.col("pillar").isin(names)))
    if include_overall:
        folds = folds.withColumn("pillar", F.explode(F.array(F.col("pillar"), F.lit(OVERALL))))
    again = "m > 1"
    sums = [
        f"coalesce(sum(CASE WHEN {again} THEN units END), 0L) AS records",
        f"coalesce(sum(CASE WHEN {again} THEN units * m END), 0L) AS ratings",
        f"coalesce(sum(CASE WHEN NOT {again} THEN units END), 0L) AS single_records",
        "coalesce(sum(failed), 0L) AS failed_runs",
        f"sum(CASE WHEN {again} THEN unanimous END) AS unanimous",
        f"sum(CASE WHEN {again} THEN double(modal) / double(m) END) AS modal",
        f"sum(CASE WHEN {again} THEN double(spread) / double(m * (m - 1)) END) AS variance",
    ]
    sums += [f"sum(CASE WHEN {again} THEN double(p{c}{k}) / double(m - 1) END) AS o{c}{k}" for c, k in _CELLS]
    marginals = [" + ".join(f"o{min(c, k)}{max(c, k)}" for k in SCORES) + f" AS t{c}" for c in SCORES]
    labels = [*names, OVERALL] if include_overall else names
    grid = vectors.sparkSession.range(1).selectExpr(f"explode(array({', '.join(map(quoted, labels))})) AS pillar")
    # At most one row per label and number of runs meets one row per label.
    dense = F.broadcast(grid).join(folds, "pillar", "left").groupBy("pillar").agg(*[F.expr(s) for s in sums])
    share = lambda x: f"try_divide(double({x}), double(records))"
    return dense.selectExpr("*", *marginals).selectExpr(
        "pillar",
        "records",
        "ratings",
        "single_records",
        "failed_runs",
        f"{share('unanimous')} AS unanimous_share",
        f"{share('modal')} AS modal_share",
        f"{share('variance')} AS mean_variance",
        f"{alpha()} AS alpha",
    )
