"""Residual and regression diagnostics, score distributions and drift against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.operators.crosstab import agreement_report
from judgespark.schema import PILLARS, SCORES

JS_EPS = 1e-12
PSI_EPS = 1e-6


def pmf(side: str) -> str:
    """Probability per score 1..5 over a report row; uniform when empty.

    Scores outside the scale count in the denominator but in no bin.
    """
    bins = [
        f"coalesce(try_divide(double({side[0]}{s}), double(support)), {1 / len(SCORES)}D)" for s in SCORES
    ]
    return f"array({', '.join(bins)})"


def js_divergence(p: str, q: str) -> str:
    """Jensen-Shannon divergence (natural log) of two probability arrays."""
    bins = range(len(SCORES))
    ps = [f"greatest({p}[{i}], {JS_EPS}D)" for i in bins]
    qs = [f"greatest({q}[{i}], {JS_EPS}D)" for i in bins]
    mixed = [f"(({a} + {b}) * 0.5D)" for a, b in zip(ps, qs)]
    mass = " + ".join(mixed)

    def divergence(xs: Sequence[str]) -> str:
        terms = [f"{x} * ln({x} / greatest({m} / ({mass}), {JS_EPS}D))" for x, m in zip(xs, mixed)]
        return f"({' + '.join(terms)})"

    return f"{divergence(ps)} * 0.5D + {divergence(qs)} * 0.5D"


def psi(expected: str, actual: str) -> str:
    """Population stability index of two probability arrays."""
    terms = []
    for i in range(len(SCORES)):
        e, a = f"greatest({expected}[{i}], {PSI_EPS}D)", f"greatest({actual}[{i}], {PSI_EPS}D)"
        terms.append(f"({a} - {e}) * ln({a} / {e})")
    return " + ".join(terms)


def _spread(a: str, b: str) -> str:
    """Sum over cells of count times two deviations, each from judge (j) or human (h) mean."""
    deviation = {"j": lambda j, h: f"({j}D - _mj)", "h": lambda j, h: f"({h}D - _mh)"}
    terms = [
        f"double(c{j}{h}) * {deviation[a](j, h)} * {deviation[b](j, h)}" for j in SCORES for h in SCORES
    ]
    return " + ".join(terms)


def _constant(side: str) -> str:
    """One marginal holds every item: exact, unlike a test on a float moment."""
    return "(" + " OR ".join(f"{side}{s} = support" for s in SCORES) + ")"


def pillar_diagnostics(
    ct: DataFrame,
    pillars: Sequence[str] = PILLARS,
    keys: Sequence[str] = (),
    include_overall: bool = False,
) -> DataFrame:
    """Diagnostics per pillar from the crosstab, dense over ``pillars``.

    The regression of human on judge is NULL below two items or for a constant judge; a constant
    human gives slope 0 and R squared 1.
    """
    report = agreement_report(ct, keys, pillars, include_overall)
    moments = report.selectExpr(
        "*",
        "try_divide(double(judge_sum), double(support)) AS _mj",
        "try_divide(double(human_sum), double(support)) AS _mh",
    ).selectExpr(
        "*", f"{_spread('j', 'j')} AS _sjj", f"{_spread('j', 'h')} AS _sjh", f"{_spread('h', 'h')} AS _shh"
    )
    undefined = f"support < 2 OR {_constant('j')}"
    fitted = moments.selectExpr(
        "*",
        f"CASE WHEN {undefined} THEN NULL WHEN {_constant('h')} THEN 0D ELSE try_divide(_sjh, _sjj) END"
        " AS ols_slope",
        f"CASE WHEN {undefined} THEN NULL WHEN {_constant('h')} THEN 1D"
        " ELSE greatest(0D, least(1D, try_divide(_sjh * _sjh, _sjj * _shh))) END AS ols_r2",
    )
    return fitted.selectExpr(
        *keys,
        "pillar",
        "support",
        f"{pmf('judge')} AS judge_pmf",
        f"{pmf('human')} AS human_pmf",
        "coalesce(try_divide(double(judge_sum - human_sum), double(support)), 0D) AS mean_residual",
        "coalesce(try_divide(double(judge_above), double(support)), 0D) AS pct_positive_residual",
        "ols_slope",
        "_mh - ols_slope * _mj AS ols_intercept",
        "ols_r2",
    )


def pmf_rows(diagnostics: DataFrame, keys: Sequence[str] = ("pillar",)) -> DataFrame:
    """Long rows ``(keys, score, source, p)`` of the judge and human distributions."""
    entries = ", ".join(
        f"struct({s} AS score, '{side}' AS source, {side}_pmf[{i}] AS p)"
        for i, s in enumerate(SCORES)
        for side in ("judge", "human")
    )
    return diagnostics.selectExpr(*keys, f"inline(array({entries}))")


def baseline_snapshot(
    ct: DataFrame, fingerprint: str | Column, pillars: Sequence[str] = PILLARS, run_id: str | None = None
) -> DataFrame:
    """Pinned judge distribution as ``(run_id, dataset_fingerprint, pillar, score, p)``."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    rows = pmf_rows(pillar_diagnostics(ct, pillars)).where(F.col("source") == "judge")
    return rows.select(
        F.lit(run_id).cast("string").alias("run_id"),
        mark.alias("dataset_fingerprint"),
        "pillar",
        "score",
        "p",
    )


def _baseline_arrays(snapshot: DataFrame) -> DataFrame:
    """One row per pillar with the baseline distribution as an array."""
    bins = ", ".join(f"coalesce(max(CASE WHEN score = {s} THEN p END), 0D)" for s in SCORES)
    return snapshot.groupBy("pillar").agg(
        F.expr(f"array({bins}) AS baseline_pmf"),
        F.max("run_id").alias("baseline_run_id"),
        F.max("dataset_fingerprint").alias("baseline_fingerprint"),
    )


def run_diagnostics(
    ct: DataFrame,
    fingerprint: str | Column,
    snapshot: DataFrame,
    pillars: Sequence[str] = PILLARS,
) -> DataFrame:
    """Pillar diagnostics plus drift against ``snapshot``.

    Drift is filled only if the fingerprints are equal and the baseline covers every pillar, and
    only for pillars with items.
    """
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    base = _baseline_arrays(snapshot)
    covers = F.size(F.array_except(F.array(*[F.lit(p) for p in pillars]), F.collect_set("pillar"))) == 0
    flag = base.agg(
        F.struct(
            F.max("baseline_run_id").alias("run_id"),
            F.max("baseline_fingerprint").alias("fingerprint"),
            covers.alias("covers"),
        )
    ).scalar()
    current = pillar_diagnostics(ct, pillars)
    joined = (
        current.join(base.select("pillar", "baseline_pmf"), "pillar", "left")
        .withColumn("_flag", flag)
        .withColumns(
            {
                "baseline_run_id": F.col("_flag.run_id"),
                "baseline_fingerprint": F.col("_flag.fingerprint"),
                "baseline_compatible": F.coalesce(
                    (F.col("_flag.fingerprint") == mark) & F.col("_flag.covers"), F.lit(False)
                ),
            }
        )
    )
    usable = F.col("baseline_compatible") & (F.col("support") > 0) & F.col("baseline_pmf").isNotNull()
    return joined.select(
        *current.columns,
        F.when(usable, F.expr(js_divergence("judge_pmf", "baseline_pmf"))).alias("js_vs_baseline"),
        F.when(usable, F.expr(psi("baseline_pmf", "judge_pmf"))).alias("psi_vs_baseline"),
        "baseline_run_id",
        "baseline_fingerprint",
        "baseline_compatible",
        F.when(F.col("baseline_compatible"), F.col("baseline_pmf")).alias("baseline_pmf"),
    )


def drift_rows(diagnostics: DataFrame) -> DataFrame:
    """Current and baseline judge distribution side by side, one row per (pillar, score)."""
    entries = [
        F.struct(
            F.lit(s).alias("score"),
            F.element_at("judge_pmf", i).alias("current_p"),
            F.element_at("baseline_pmf", i).alias("baseline_p"),
        )
        for i, s in enumerate(SCORES, start=1)
    ]
    return diagnostics.select("pillar", F.inline(F.array(*entries))).where(
        F.col("baseline_p").isNotNull()
    )


def diagnostics_json(diagnostics: DataFrame, fingerprint: str | Column) -> DataFrame:
    """All diagnostics of a run as one JSON document (one entry per pillar)."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint

    def by_score(name: str) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(str(s)) for s in SCORES]), F.col(name))

    ols = F.when(
        F.col("ols_slope").isNotNull(),
        F.struct(
            F.col("ols_slope").alias("slope"),
            F.col("ols_intercept").alias("intercept"),
            F.col("ols_r2").alias("r_squared"),
        ),
    )
    body = F.struct(
        "support",
        by_score("judge_pmf").alias("judge_pmf"),
        by_score("human_pmf").alias("human_pmf"),
        F.col("mean_residual").alias("mean_residual_judge_minus_human"),
        "pct_positive_residual",
        ols.alias("ols_human_on_judge"),
        "js_vs_baseline",
        "psi_vs_baseline",
    )
    # Maps are not orderable, so the list is sorted by pillar alone.
    entries = F.array_sort(
        F.collect_list(F.struct(F.col("pillar"), F.to_json(body, {"ignoreNullFields": "false"}).alias("j")))
    )
    pillars = F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit('"'), e["pillar"], F.lit('":'), e["j"])), ","
    )
    head = F.to_json(
        F.struct(
            F.max(mark).alias("dataset_fingerprint"),
            F.max("baseline_run_id").alias("baseline_run_id"),
            F.max("baseline_fingerprint").alias("baseline_fingerprint"),
            F.coalesce(F.bool_or("baseline_compatible"), F.lit(False)).alias("baseline_compatible"),
        ),
        {"ignoreNullFields": "false"},
    )
    text = F.concat(F.regexp_replace(head, "\\}$", ""), F.lit(',"pillars":{'), pillars, F.lit("}}"))
    return diagnostics.agg(text.alias("diagnostics"))
