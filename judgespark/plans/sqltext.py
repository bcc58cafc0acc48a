"""SQL building blocks for the counterparts of the registered queries.

Each block is a common table expression over the sample tables, written at row level so that it
shares no intermediate table with the Spark plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from judgespark.schema import (
    DISTANCE_WEIGHTS,
    GATE_DEFAULTS,
    GATE_OVERRIDES,
    OVERALL,
    PILLARS,
    RUBRIC_TAGS,
    SCORES,
    UNKNOWN_SLICE,
)

LABELS = ", ".join(f"label_{p}" for p in PILLARS)


def _pillar_case(column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PILLARS, start=1))
    return f"CASE {column} {cases} ELSE 'tone' END"


def pillar_values(pillars: Sequence[str] = PILLARS) -> str:
    return "(VALUES " + ", ".join(f"('{p}', {k})" for k, p in enumerate(pillars)) + ") AS p(pillar, k)"


def first_tag() -> str:
    return "CASE pillar " + " ".join(f"WHEN '{p}' THEN '{t[0]}'" for p, t in RUBRIC_TAGS.items()) + " END"


_EVAL_ROWS = (
    """SELECT o_orderkey AS row_index,
  CAST(CASE WHEN o_orderkey % 40 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS record_id,
  'Where is order ' || o_orderkey || ' of customer ' || o_custkey || '?' AS user_input,
  'Order ' || o_orderkey || ' has status ' || o_orderstatus || '.' AS agent_output,
  o_orderpriority AS category,
  CASE WHEN o_custkey % 4 <> 0 THEN 'rev-' || (o_custkey % 12) END AS reviewer_name,
  CASE WHEN o_custkey % 8 <> 0 THEN 'id-' || (o_custkey % 12) END AS reviewer_id,
  CASE WHEN o_custkey % 7 <> 0 THEN 'intent_' || (o_custkey % 7) END AS intent,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS topic,
  'conv-' || o_custkey AS conversation_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN 'model-' || (o_orderkey % 3) END AS model_name,
  """
    + ",\n  ".join(
        f"CAST(CASE WHEN (o_orderkey + {k}) % 11 <> 0 THEN 1 + (o_orderkey * 7 + {k * 3} + o_custkey % 2) % 5 END"
        f" AS INTEGER) AS label_{p}"
        for k, p in enumerate(PILLARS, start=1)
    )
    + " FROM orders"
)

_OUTCOMES = f"""SELECT l_orderkey * 8 + l_linenumber AS outcome_index,
  CASE WHEN l_orderkey % 997 = 0 THEN 'ghost-' || l_orderkey
       WHEN l_orderkey % 80 = 1 THEN CAST(l_orderkey - 1 AS VARCHAR)
       ELSE CAST(l_orderkey AS VARCHAR) END AS record_id,
  {_pillar_case('l_linenumber')} AS pillar,
  l_extendedprice / 100 AS latency_ms,
  CAST(1 + l_suppkey % 3 AS INTEGER) AS attempts,
  CASE WHEN l_linenumber % 5 <> 0 THEN CAST(floor(l_quantity) AS BIGINT) * 10 END AS input_tokens,
  l_partkey % 300 AS output_tokens,
  'model-' || (l_suppkey % 3) AS model_name,
  l_suppkey % 13 = 0 AS failed,
  CASE WHEN l_suppkey % 13 <> 0 THEN CAST(1 + (l_orderkey * 7 + l_linenumber * 3 + l_partkey % 4) % 5 AS INTEGER) END
    AS judge_score,
  l_discount * 10 AS confidence
  FROM lineitem"""

_ACTIVE = ", ".join(f"'{p}'" for p in PILLARS)

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "eval_rows": ((), _EVAL_ROWS),
    "outcomes": ((), _OUTCOMES),
    "latest": (
        ("eval_rows",),
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY row_index DESC) AS rn"
        " FROM eval_rows) WHERE rn = 1",
    ),
    "labels_long": (
        ("latest",),
        " UNION ALL ".join(
            f"SELECT record_id, '{p}' AS pillar, label_{p} AS human_score FROM latest" for p in PILLARS
        ),
    ),
    "items": (
        ("outcomes", "latest", "labels_long"),
        "SELECT o.outcome_index, o.record_id, o.pillar, o.judge_score, l.human_score, r.category, r.reviewer_name,"
        " r.reviewer_id, r.intent, r.topic, r.conversation_id, r.model_name,"
        " coalesce(nullif(r.reviewer_name, ''), r.reviewer_id) AS reviewer,"
        " abs(o.judge_score - l.human_score) AS distance"
        " FROM outcomes o JOIN latest r ON r.record_id = o.record_id"
        " JOIN labels_long l ON l.record_id = o.record_id AND l.pillar = o.pillar"
        f" WHERE NOT o.failed AND l.human_score IS NOT NULL AND o.pillar IN ({_ACTIVE})",
    ),
    "dims": (
        ("items",),
        " UNION ALL ".join(
            f"SELECT '{name}' AS dimension, coalesce(nullif({col}, ''), '{UNKNOWN_SLICE}') AS slice, pillar,"
            " judge_score, human_score FROM items"
            for name, col in (
                ("category", "category"),
                ("reviewer", "reviewer"),
                ("intent", "intent"),
                ("topic", "topic"),
                ("model", "model_name"),
            )
        ),
    ),
    "bounds": (
        (),
        "SELECT pl.pillar, d.metric, coalesce(o.target, d.target) AS target, coalesce(o.warn, d.warn) AS warn FROM "
        + pillar_values().replace(" AS p(pillar, k)", " AS pl(pillar, k)")
        + " CROSS JOIN (VALUES "
        + ", ".join(f"('{m}', {t}::DOUBLE, {w}::DOUBLE)" for m, (t, w) in GATE_DEFAULTS.items())
        + ") AS d(metric, target, warn) LEFT JOIN (VALUES "
        + ", ".join(f"('{p}', '{m}', {t}::DOUBLE, {w}::DOUBLE)" for (p, m), (t, w) in GATE_OVERRIDES.items())
        + ") AS o(pillar, metric, target, warn) ON o.pillar = pl.pillar AND o.metric = d.metric",
    ),
}


def define(name: str, deps: Sequence[str], sql: str) -> None:
    """Add a block other modules can refer to."""
    _CTES[name] = (tuple(deps), sql)


def with_ctes(final: str, *names: str) -> str:
    """``final`` preceded by the named blocks and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    blocks = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in ordered)
    return f"WITH {blocks}\n{final}" if ordered else final


def round_half_even(x: str, digits: int) -> str:
    """The library's rounding rule over a column reference or a cheap expression."""
    scale = f"{10**digits}::DOUBLE"
    product = f"(abs({x}) * {scale})"
    high = f"(abs({x}) * 134217729::DOUBLE - (abs({x}) * 134217729::DOUBLE - abs({x})))"
    error = f"(({high} * {scale} - {product}) + (abs({x}) - {high}) * {scale})"
    whole = f"floor({product})"
    part = f"({product} - {whole})"
    up = f"({part} > 0.5 OR ({part} = 0.5 AND ({error} > 0 OR ({error} = 0 AND {whole} % 2 = 1))))"
    rounded = f"(({whole} + CASE WHEN {up} THEN 1 ELSE 0 END) / {scale})"
    return f"CASE WHEN {x} < 0 THEN -{rounded} ELSE {rounded} END"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {round_half_even(x, digits)})"


def _counts(judge: str = "judge_score", human: str = "human_score") -> str:
    """Aggregates of one group of items: support, buckets, sums, marginals, cells."""
    parts = ["count(*) AS support"]
    parts += [f"count(*) FILTER (WHERE abs({judge} - {human}) = {d}) AS d{d}" for d in range(5)]
    parts += [
        f"count(*) FILTER (WHERE abs({judge} - {human}) >= 3) AS d3_plus",
        f"CAST(coalesce(sum(abs({judge} - {human})), 0) AS BIGINT) AS abs_sum",
        f"CAST(coalesce(sum({judge}), 0) AS BIGINT) AS judge_sum",
        f"CAST(coalesce(sum({human}), 0) AS BIGINT) AS human_sum",
        f"count(*) FILTER (WHERE {judge} > {human}) AS judge_above",
    ]
    parts += [f"count(*) FILTER (WHERE {judge} = {s}) AS j{s}" for s in SCORES]
    parts += [f"count(*) FILTER (WHERE {human} = {s}) AS h{s}" for s in SCORES]
    parts += [
        f"count(*) FILTER (WHERE {judge} = {j} AND {human} = {h}) AS c{j}{h}" for j in SCORES for h in SCORES
    ]
    return ", ".join(parts)


COUNT_NAMES = (
    ["support"]
    + [f"d{d}" for d in range(5)]
    + ["d3_plus", "abs_sum", "judge_sum", "human_sum", "judge_above"]
    + [f"j{s}" for s in SCORES]
    + [f"h{s}" for s in SCORES]
    + [f"c{j}{h}" for j in SCORES for h in SCORES]
)


def _rate(numerator: str) -> str:
    return f"CASE WHEN support = 0 THEN 0::DOUBLE ELSE ({numerator})::DOUBLE / support::DOUBLE END"


def kappa(power: int = 2) -> str:
    pairs = [(j, h) for j in SCORES for h in SCORES if j != h]
    observed = " + ".join(f"c{j}{h} * {abs(j - h) ** power}" for j, h in pairs)
    expected = " + ".join(
        f"j{j}::DOUBLE * h{h}::DOUBLE * {abs(j - h) ** power}::DOUBLE" for j, h in pairs
    )
    return (
        f"CASE WHEN support >= 2 AND ({expected}) <> 0"
        f" THEN 1::DOUBLE - (({observed})::DOUBLE * support::DOUBLE) / ({expected}) END"
    )


def _rank(side: str, s: int) -> str:
    below = " + ".join(["0"] + [f"{side}{v}" for v in SCORES if v < s])
    above = " + ".join(["0"] + [f"{side}{v}" for v in SCORES if v > s])
    return f"(({below}) - ({above}))::DOUBLE"


def spearman() -> str:
    product = " + ".join(
        f"c{j}{h}::DOUBLE * {_rank('j', j)} * {_rank('h', h)}" for j in SCORES for h in SCORES
    )
    judge = " + ".join(f"j{s}::DOUBLE * {_rank('j', s)} * {_rank('j', s)}" for s in SCORES)
    human = " + ".join(f"h{s}::DOUBLE * {_rank('h', s)} * {_rank('h', s)}" for s in SCORES)
    spread = f"sqrt(({judge}) * ({human}))"
    return f"CASE WHEN support >= 2 AND {spread} <> 0 THEN ({product}) / {spread} END"


def alignment(weights=DISTANCE_WEIGHTS) -> str:
    terms = " + ".join(f"d{d}::DOUBLE * {w}::DOUBLE" for d, w in sorted(weights.items()))
    return f"CASE WHEN support = 0 THEN 0::DOUBLE ELSE ({terms}) / support::DOUBLE END"


METRICS = {
    "exact_match_rate": _rate("d0"),
    "within_1_rate": _rate("d0 + d1"),
    "off_by_2_rate": _rate("d2"),
    "off_by_3_plus_rate": _rate("d3_plus"),
    "mean_absolute_error": _rate("abs_sum"),
    "severity_aware_alignment": alignment(),
    "weighted_kappa": kappa(),
    "spearman_correlation": spearman(),
    "avg_judge_score": _rate("judge_sum"),
    "avg_human_score": _rate("human_sum"),
}
METRIC_LIST = ", ".join(f"{e} AS {n}" for n, e in METRICS.items())


def report(
    items: str,
    keys: Sequence[str] = (),
    pillars: Sequence[str] = PILLARS,
    include_overall: bool = True,
) -> str:
    """Dense agreement report over an items relation, with counts and metrics."""
    key_list = "".join(f"{k}, " for k in keys)
    groups = f"SELECT DISTINCT {', '.join(keys)} FROM {items}" if keys else "SELECT 1 AS one"
    wanted = list(pillars) + ([OVERALL] if include_overall else [])
    labelled = [f"SELECT {key_list}pillar AS label, judge_score, human_score FROM {items}"]
    if include_overall:
        labelled.append(f"SELECT {key_list}'{OVERALL}' AS label, judge_score, human_score FROM {items}")
    on = " AND ".join([f"c.{k} IS NOT DISTINCT FROM g.{k}" for k in keys] + ["c.label = p.pillar"])
    dense = ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in COUNT_NAMES)
    group_by = f"GROUP BY {key_list}label"
    return (
        f"SELECT *, {METRIC_LIST} FROM (SELECT {''.join(f'g.{k}, ' for k in keys)}p.pillar, {dense}"
        f" FROM ({groups}) g CROSS JOIN {pillar_values(wanted)}"
        f" LEFT JOIN (SELECT {key_list}label, {_counts()} FROM ({' UNION ALL '.join(labelled)}) {group_by}) c"
        f" ON {on})"
    )


define("report", ["items"], report("items"))
define("sliced", ["dims"], report("dims", ["dimension", "slice"]))
define("slice_sizes", ["dims"], "SELECT dimension, slice, count(*) AS slice_total_items FROM dims GROUP BY ALL")
define("reviewed", ["items"], "SELECT * FROM items WHERE reviewer IS NOT NULL")
define("by_reviewer", ["reviewed"], report("reviewed", ["reviewer"]))
