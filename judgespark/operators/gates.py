"""Pass / warn / fail gates on agreement metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.functions.numeric import with_fixed
from judgespark.schema import GATE_DEFAULTS, GATE_OVERRIDES, GATE_VERSION

# Gates in report order, and whether a higher value is better.
GATES = {
    "within_1_rate": True,
    "weighted_kappa": True,
    "mean_absolute_error": False,
    "severity_aware_alignment": True,
    "large_miss_rate": False,
}
STATUS_CODES = {"pass": 2.0, "warn": 1.0, "fail": 0.0, "skip": -1.0}
_SEVERITY = {"skip": 0, "pass": 1, "warn": 2, "fail": 3}

# Fixed texts of the suggested actions per breached gate.
ACTIONS = {
    "within_1_rate": "Tighten rubric anchors or prompt for finer ordinal discrimination.",
    "weighted_kappa": "Review systematic off-by-one patterns; consider SME calibration session.",
    "mean_absolute_error": "Reduce judge temperature or add few-shot exemplars at score boundaries.",
    "severity_aware_alignment": "Focus on large-miss cases in Disagreements; adjust failure-tag guidance.",
    "large_miss_rate": "High severe errors: check grounding/context requirements for this pillar.",
}
NO_ACTION = "No gate breaches - monitor drift on the next run."

Bounds = Mapping[str, tuple[float, float]]
Overrides = Mapping[tuple[str, str], tuple[float, float]]


def bounds_table(
    spark: SparkSession, defaults: Bounds = GATE_DEFAULTS, overrides: Overrides = GATE_OVERRIDES
) -> DataFrame:
    """Configured bounds as ``(pillar, metric, target, warn)``; NULL pillar = default."""
    entries = [(None, m, t, w) for m, (t, w) in defaults.items()]
    entries += [(p, m, t, w) for (p, m), (t, w) in overrides.items()]
    structs = [
        F.struct(
            F.lit(p).cast("string").alias("pillar"),
            F.lit(m).alias("metric"),
            F.lit(float(t)).alias("target"),
            F.lit(float(w)).alias("warn"),
        )
        for p, m, t, w in entries
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def pillar_bounds(pillars: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds that apply to each pillar: the default per metric unless the pillar overrides it."""
    applicable = pillars.select("pillar").distinct().join(
        F.broadcast(
            bounds.select(F.col("pillar").alias("only"), "metric", F.struct("target", "warn").alias("bound"))
        ),
        F.col("only").isNull() | (F.col("only") == F.col("pillar")),
    )
    specific = F.max(F.when(F.col("only").isNotNull(), F.col("bound")))
    general = F.max(F.when(F.col("only").isNull(), F.col("bound")))
    return (
        applicable.groupBy("pillar", "metric")
        .agg(F.coalesce(specific, general).alias("bound"))
        .select("pillar", "metric", "bound.target", "bound.warn")
    )


def _status(value: Column, target: Column, warn: Column, higher: Column) -> Column:
    good = F.when(higher, value >= target).otherwise(value <= target)
    fair = F.when(higher, value >= warn).otherwise(value <= warn)
    return F.when(value.isNull(), "skip").when(good, "pass").when(fair, "warn").otherwise("fail")


def _detail() -> Column:
    value, target, warn = (F.col(f"_{c}") for c in ("value", "target", "warn"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    up = (
        F.when(F.col("status") == "pass", text("value ", value, " >= target ", target))
        .when(
            F.col("status") == "warn",
            text("value ", value, " in [warn, target) = [", warn, ", ", target, ")"),
        )
        .otherwise(text("value ", value, " < warn ", warn))
    )
    down = (
        F.when(F.col("status") == "pass", text("value ", value, " <= target ", target))
        .when(
            F.col("status") == "warn",
            text("value ", value, " in (target, warn] = (", target, ", ", warn, "]"),
        )
        .otherwise(text("value ", value, " > warn ", warn))
    )
    skipped = F.concat(F.col("metric"), F.lit(" undefined for this sample"))
    return F.when(F.col("status") == "skip", skipped).when(F.col("higher"), up).otherwise(down)


def gate_results(report: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row per (pillar, bounded metric): status, value, detail and gate order."""
    values = {
        "large_miss_rate": F.col("off_by_2_rate") + F.col("off_by_3_plus_rate"),
    }
    entries = [
        F.struct(
            F.lit(i).alias("gate_order"),
            F.lit(metric).alias("metric"),
            F.lit(higher).alias("higher"),
            values.get(metric, F.col(metric)).alias("value"),
        )
        for i, (metric, higher) in enumerate(GATES.items())
    ]
    long = report.select("pillar", F.inline(F.array(*entries)))
    joined = long.join(pillar_bounds(report, bounds), ["pillar", "metric"])
    status = _status(F.col("value"), F.col("target"), F.col("warn"), F.col("higher"))
    shown = with_fixed(joined.withColumn("status", status), {f"_{c}": (c, 4) for c in ("value", "target", "warn")})
    return shown.select(
        "pillar", "metric", "status", "value", _detail().alias("detail"), "target", "warn", "gate_order"
    )


def _rank(status: Column) -> Column:
    result = F.lit(0)
    for name, rank in _SEVERITY.items():
        result = F.when(status == name, F.lit(rank)).otherwise(result)
    return result


def _label(rank: Column) -> Column:
    result = F.lit("skip")
    for name, code in _SEVERITY.items():
        result = F.when(rank == code, F.lit(name)).otherwise(result)
    return result


def pillar_status(report: DataFrame, gates: DataFrame) -> DataFrame:
    """Worst gate per pillar; skipped gates do not count, and no gate at all is a skip."""
    worst = gates.groupBy("pillar").agg(F.max(_rank(F.col("status"))).alias("rank"))
    return (
        report.select("pillar")
        .join(worst, "pillar", "left")
        .select("pillar", _label(F.coalesce("rank", F.lit(0))).alias("overall"))
    )


def worst_status(statuses: DataFrame) -> DataFrame:
    """Worst status over all pillars, one row."""
    return statuses.agg(
        _label(F.coalesce(F.max(_rank(F.col("overall"))), F.lit(0))).alias("worst_status")
    )


def gate_json(report: DataFrame, gates: DataFrame, version: str = GATE_VERSION) -> DataFrame:
    """The gate report as one JSON document per run (pillars and gates are few by nature)."""
    per_pillar = gates.groupBy("pillar").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("gate_order", "metric", "status", "value", "detail"))),
            lambda g: F.struct(
                g["metric"].alias("metric"),
                g["status"].alias("status"),
                g["value"].alias("value"),
                g["detail"].alias("detail"),
            ),
        ).alias("gates")
    )
    statuses = pillar_status(report, gates)
    body = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("pillar", F.struct("overall", "gates"))))
    )
    merged = statuses.join(per_pillar, "pillar", "left").withColumn(
        "gates", F.coalesce("gates", F.array().cast(per_pillar.schema["gates"].dataType))
    )
    worst = _label(F.coalesce(F.max(_rank(F.col("overall"))), F.lit(0)))
    return merged.agg(
        F.to_json(
            F.struct(
                F.lit(version).alias("version"), worst.alias("worst_status"), body.alias("pillars")
            ),
            {"ignoreNullFields": "false"},
        ).alias("gate_report")
    )


def suggested_actions(report: DataFrame, gates: DataFrame) -> DataFrame:
    """Hints for the breached gates of each pillar, in gate order."""
    hint = F.lit(None).cast("string")
    for metric, text in ACTIONS.items():
        hint = F.when(F.col("metric") == metric, F.lit(text)).otherwise(hint)
    breached = gates.where(F.col("status").isin("warn", "fail"))
    hints = breached.groupBy("pillar").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("gate_order", hint.alias("hint")))),
                lambda x: x["hint"],
            ),
            "; ",
        ).alias("hints")
    )
    return (
        report.select("pillar")
        .join(hints, "pillar", "left")
        .select("pillar", F.coalesce("hints", F.lit(NO_ACTION)).alias("suggested_actions"))
    )
