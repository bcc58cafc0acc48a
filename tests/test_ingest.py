"""Normalization rules cell by cell, readers, and order-dependent helpers."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgespark.functions import numeric, text
from judgespark.operators import ingest, ordinal
from judgespark.sources import readers

BASE = {"record_id": "id", "user_input": "u", "agent_output": "o", "category": "c"}


def stage(spark, rows, extra, schema=None):
    """Rows as dicts of extra cells; required cells are filled in."""
    full = [{"pos": i, "id": f"r{i}", "u": "x", "o": "y", "c": "z", **r} for i, r in enumerate(rows)]
    names = list(full[0])
    types = {"pos": "long", **(schema or {})}
    ddl = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], ddl)
    return ingest.stage_rows(df, {**BASE, **extra}, "pos")


def test_integer_cells(spark):
    cases = [
        ("3", 3, None), (" 4\n", 4, None), ("5.0", 5, None), ("1e0", 1, None), ("+2", 2, None), ("1_0", 10, None),
        (None, None, None), ("", None, None), (" N/A ", None, None), ("nan", None, None),
        ("3.5", None, "not_an_integer"), ("inf", None, "not_an_integer"), ("abc", None, "not_a_number"),
        ("5d", None, "not_a_number"), ("1__0", None, "not_a_number"), ("True", None, "not_a_number"),
        (".5", None, "not_an_integer"), ("5.", 5, None), ("-7", -7, None),
    ]
    staged = stage(spark, [{"t": c} for c, _, _ in cases], {"turn_index": "t"})
    for (cell, value, code), row in zip(cases, staged.orderBy("row_index").collect()):
        assert (row.turn_index, row.errors.get("turn_index")) == (value, code), cell


def test_typed_integer_cells(spark):
    doubles = stage(spark, [{"t": 5.0}, {"t": 3.5}, {"t": float("nan")}, {"t": None}], {"turn_index": "t"}, {"t": "double"})
    assert [(r.turn_index, r.errors) for r in doubles.orderBy("row_index").collect()] == [
        (5, {}), (None, {"turn_index": "not_an_integer"}), (None, {}), (None, {}),
    ]
    booleans = stage(spark, [{"t": True}, {"t": None}], {"turn_index": "t"}, {"t": "boolean"})
    assert [r.errors for r in booleans.orderBy("row_index").collect()] == [{"turn_index": "boolean"}, {}]


def test_labels_must_be_on_the_scale(spark):
    staged = stage(spark, [{"l": "5"}, {"l": "0"}, {"l": "6.0"}, {"l": "none"}], {"label_toxicity": "l"})
    rows = staged.orderBy("row_index").collect()
    assert [r.label_toxicity for r in rows] == [5, None, None, None]
    assert [r.errors.get("label_toxicity") for r in rows] == [None, "out_of_range", "out_of_range", None]


@pytest.mark.parametrize("literals", [True])
def test_context_cells(spark, literals):
    cases = [
        (None, None), (" null ", None), ("[]", None), ('["n/a", null]', None),
        ("free text, not JSON", [("text", "free text, not JSON")]),
        ('["a", "", "b"]', [("text", "a"), ("text", "b")]),
        ('{"k": {"z": 1, "a": 2}}', [("json", '{"k":{"a":2,"z":1}}')]),
        ('"quoted"', [("text", "quoted")]), ("12", [("text", "12")]), ("1.50", [("text", "1.5")]),
        ("[1, true, {\"x\": 2}]", [("text", "1"), ("text", "True"), ("json", '{"x":2}')]),
        ("['a', None, 'b']", [("text", "a"), ("text", "b")]),
        ("{'doc': 1, 'ok': True}", [("json", '{"doc":1,"ok":true}')]),
        ("[unclosed", [("text", "[unclosed")]),
    ]
    staged = stage(spark, [{"x": c} for c, _ in cases], {"retrieved_context": "x"})
    for (cell, chunks), row in zip(cases, staged.orderBy("row_index").collect()):
        found = None if row.retrieved_context is None else [tuple(c) for c in row.retrieved_context]
        assert found == chunks, cell
        assert row.errors == {}


def test_history_cells(spark):
    ok = '{"role": "user", "content": "hi"}'
    cases = [
        (None, None, None), ("[]", [], None), (f"[{ok}]", [("user", "hi")], None),
        ("[{'role': 'tool', 'content': ''}]", [("tool", "")], None),
        (ok, None, "not_a_list"), ("nonsense", None, "not_parseable"), ('["x"]', None, "invalid_turn"),
        ('[{"role": "user"}]', None, "invalid_turn"), ('[{"role": "boss", "content": "x"}]', None, "invalid_turn"),
        ('[{"role": "user", "content": "x", "extra": 1}]', None, "invalid_turn"),
        ("[{'role': 'user', 'content': None}]", None, "invalid_turn"),
        ('[{"role": "user", "content": 3}]', None, "invalid_turn"),
    ]
    staged = stage(spark, [{"h": c} for c, _, _ in cases], {"chat_history": "h"})
    for (cell, turns, code), row in zip(cases, staged.orderBy("row_index").collect()):
        found = None if row.chat_history is None else [tuple(t) for t in row.chat_history]
        assert (found, row.errors.get("chat_history")) == (turns, code), cell


def test_metadata_cells(spark):
    cases = [
        ("", None, None), ("null", None, None), ('{"b": 1, "a": [2]}', '{"a":[2],"b":1}', None),
        ("{'x': None}", '{"x":null}', None), ("[1]", None, "not_an_object"), ("5", None, "not_an_object"),
        ("{broken", None, "not_parseable"),
    ]
    staged = stage(spark, [{"m": c} for c, _, _ in cases], {"metadata": "m"})
    for (cell, value, code), row in zip(cases, staged.orderBy("row_index").collect()):
        assert (row.metadata, row.errors.get("metadata")) == (value, code), cell


def test_failures_and_reasons(spark):
    rows = [{"l": "3"}, {"l": "abc"}, {"id": " n/a ", "l": "abc"}, {"id": " r3 ", "l": "9"}, {"c": "", "l": "1"}]
    staged = stage(spark, rows, {"label_relevance": "l"})
    failed = {r.row_index: r for r in ingest.failures(staged).collect()}
    assert set(failed) == {1, 2, 3, 4}
    assert (failed[1].reason, failed[1].record_id) == (ingest.REASON_PARSE, "r1")
    assert (failed[2].reason, failed[2].record_id) == (ingest.REASON_CONSTRAINT, None)
    assert failed[2].details == {"record_id": "missing", "label_relevance": "not_a_number"}
    assert (failed[3].reason, failed[3].record_id) == (ingest.REASON_CONSTRAINT, " r3 ")
    rollup = [(r.column, r.failed_rows) for r in ingest.failure_rollup(ingest.failures(staged)).collect()]
    assert rollup == [("label_relevance", 3), ("category", 1), ("record_id", 1)]
    summary = ingest.normalization_summary(staged).first()
    assert (summary.success_count, summary.failure_count, summary.success_rate) == (1, 4, 0.2)
    assert ingest.normalization_summary(staged.where("false")).first().success_rate == 0.0
    good = ingest.good_rows(staged).first()
    assert good.has_labels and not good.has_reviewer and not good.has_context
    assert json.loads(good.source_extras) == {"id": "r0", "u": "x", "o": "y", "c": "z", "l": "3"}


def test_typed_containers(spark):
    rows = [{"x": ["a", None, "n/a"], "h": [("user", "hi")], "m": {"k": "v"}}]
    staged = stage(
        spark, rows, {"retrieved_context": "x", "chat_history": "h", "metadata": "m"},
        {"x": "array<string>", "h": "array<struct<role:string,content:string>>", "m": "map<string,string>"},
    )
    row = staged.first()
    assert [tuple(c) for c in row.retrieved_context] == [("text", "a")]
    assert [tuple(t) for t in row.chat_history] == [("user", "hi")] and row.metadata == '{"k":"v"}'


def test_mapping_checks():
    with pytest.raises(ValueError, match="unknown"):
        ingest.check_mapping({"nope": "x"})
    with pytest.raises(ValueError, match="blank"):
        ingest.check_mapping({"record_id": "  "})
    with pytest.raises(ValueError, match="both"):
        ingest.check_mapping({"record_id": "x", "category": "x"})
    issues = ingest.mapping_issues({"record_id": "id", "topic": "gone"}, ["id"])
    assert [(c, i) for c, i, _ in issues] == [
        ("user_input", "missing_required_mapping"), ("agent_output", "missing_required_mapping"),
        ("category", "missing_required_mapping"), ("topic", "unknown_source_column"),
    ]


# --- text and number rules ----------------------------------------------------


def test_strip_and_indent_follow_python(spark):
    samples = ["  a b 　\x1c", "", "one\ntwo\r\nthree\n", "\n", "a\x85b c", "x\n\n", "\t\x0b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    rows = df.select("i", text.strip(F.col("s")).alias("t"), text.indent(F.col("s")).alias("d")).orderBy("i").collect()
    for s, r in zip(samples, rows):
        assert r.t == s.strip()
        assert r.d == ("\n".join("  " + line for line in s.splitlines()) or "  (empty)")


def test_ascii_json_follows_python(spark):
    samples = ['{"a":"plain"}', '{"a":"é漢😀"}']
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    found = [r[0] for r in df.select(text.ascii_json(F.col("s"))).collect()]
    assert found == [json.dumps(json.loads(s), separators=(",", ":")) for s in samples]


def test_rounding_follows_python(spark):
    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 1.005, -2.5, 0.0, 1e300, 33.335, 12.345] + [rng.uniform(-100, 100) for _ in range(300)]
    values += [rng.randrange(1, 4000) / 1000 + 0.0005 for _ in range(300)] + [k / 32 for k in range(64)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (2, 3, 4):
        rows = numeric.with_rounded(df, {"r": ("v", digits)}).orderBy("i").collect()
        assert [r.r for r in rows] == [round(v, digits) for v in values]
        shown = numeric.with_fixed(df.where("v < 1e9"), {"r": ("v", digits)}).orderBy("i").collect()
        assert [r.r.replace("-0." + "0" * digits, "0." + "0" * digits) for r in shown] == [
            f"{r.v:.{digits}f}".replace("-0." + "0" * digits, "0." + "0" * digits) for r in shown
        ]


def test_redaction(spark):
    df = spark.createDataFrame([("abcdef",)], "s string")
    shown = df.select(
        text.redact_or_truncate(F.col("s"), True).alias("r"), text.redact_or_truncate(F.col("s"), False, 4).alias("t")
    ).first()
    assert tuple(shown) == ("<redacted len=6>", "abcd... <truncated 2 chars>")


# --- order-dependent helpers --------------------------------------------------


def test_fingerprint_of_small_data_is_plain_sha256(spark):
    rows = [(i, f"r{i}", "in", "out\té", "cat") for i in range(50)]
    df = spark.createDataFrame(rows, "row_index long, record_id string, user_input string, agent_output string, category string")
    blob = "\n".join("\t".join(r[1:]) for r in rows)
    expected = "sha256:" + hashlib.sha256(blob.encode()).hexdigest()[:16]
    assert ingest.dataset_fingerprint(df.repartition(7)).first()[0] == expected
    empty = ingest.dataset_fingerprint(df.where("false")).first()[0]
    assert empty == "sha256:" + hashlib.sha256(b"").hexdigest()[:16]
    tree = ingest.dataset_fingerprint(df, fanout=8).first()[0]
    assert tree == ingest.dataset_fingerprint(df.repartition(3), fanout=8).first()[0] != expected
    swapped = df.withColumn("row_index", F.when(F.col("row_index") < 2, 1 - F.col("row_index")).otherwise(F.col("row_index")))
    assert ingest.dataset_fingerprint(swapped, fanout=8).first()[0] != tree


@pytest.mark.parametrize("size", [0, 1, 2, 101])
def test_exact_percentiles(spark, size):
    rng = random.Random(size)
    values = [round(rng.expovariate(0.01), 1) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ordinal.exact_percentiles(df, F.col("v"), {"p50": 0.5, "p95": 0.95}).first()
    expected = np.percentile(values, [50, 95]) if values else [0.0, 0.0]
    assert tuple(row) == pytest.approx(tuple(expected))


def test_percentiles_with_outliers_and_ties(spark):
    values = [1.0] * 500 + [1.0 + k * 1e-12 for k in range(100)] + [1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ordinal.exact_percentiles(df, F.col("v"), {"a": 0.5, "b": 0.9, "c": 0.999}).first()
    ordered = sorted(values)

    def interpolated(f):
        position = f * (len(ordered) - 1)
        low, high = ordered[int(position)], ordered[-int(-position // 1)]
        return low + (high - low) * (position - int(position))

    assert tuple(row) == tuple(interpolated(f) for f in (0.5, 0.9, 0.999))


def test_fingerprint_needs_no_dense_positions(spark):
    rows = [(i, f"r{i}", "u", "a", "c") for i in range(20)]
    schema = "row_index long, record_id string, user_input string, agent_output string, category string"
    df = spark.createDataFrame(rows, schema)
    prints = {
        ingest.dataset_fingerprint(df.withColumn("row_index", F.col("row_index") * step + at), fanout=6).first()[0]
        for step, at in ((1, 0), (200, 3), (1, 10**15), (10**17, 10**15 + 5))
    }
    assert len(prints) == 1
    for i in range(20):
        far = df.withColumn("row_index", F.when(F.col("row_index") == i, F.lit(10**18 + i)).otherwise(F.col("row_index")))
        changed = far.withColumn("user_input", F.when(F.col("row_index") == 10**18 + i, "x").otherwise(F.col("user_input")))
        prints.add(ingest.dataset_fingerprint(changed, fanout=6).first()[0])
        if i == 3:
            break
    assert len(prints) == 5


@pytest.mark.parametrize("scales", [(1e300, 1e200, 1e100, 1.0), (1e-300, -5.0, -1e250, 0.0)])
def test_percentiles_at_several_scales(spark, scales):
    rng = random.Random(4)
    values = [s * (1 + rng.random() * 1e-9) for s in scales for _ in range(150)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ordinal.exact_percentiles(df, F.col("v"), {"a": 0.1, "b": 0.4, "c": 0.6, "d": 0.99}).first()
    ordered = sorted(values)

    def interpolated(f):
        position = f * (len(ordered) - 1)
        low, high = ordered[int(position)], ordered[-int(-position // 1)]
        return low + (high - low) * (position - int(position))

    assert tuple(row) == pytest.approx(tuple(interpolated(f) for f in (0.1, 0.4, 0.6, 0.99)), rel=1e-15)


def test_percentiles_read_three_times(spark):
    df = spark.range(10).selectExpr("CAST(id AS DOUBLE) AS v")
    df.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/percentiles")
    df = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/percentiles")
    out = ordinal.exact_percentiles(df, F.col("v"), {"p50": 0.5, "p95": 0.95})
    assert tuple(out.first()) == pytest.approx((4.5, 8.55))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_dense_ordinal(spark):
    keys = [3_000_000, 5, 1_048_576, 7, 9_999_999_999]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = {r.k: r.o for r in ordinal.dense_ordinal(df, ["k"], "o").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}
    many = spark.range(9000).selectExpr("id * id AS k", "id AS i").union(spark.sql("SELECT -(1L << 62), -1L"))
    ranked = ordinal.dense_ordinal(many.repartition(5), ["k"], "o").collect()
    assert all(r.o == r.i + 1 for r in ranked) and len(ranked) == 9001
    assert ordinal.dense_ordinal(df.where("false"), ["k"], "o").count() == 0


# --- readers ------------------------------------------------------------------


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_csv_and_tsv(spark, tmp_path):
    csv = write(tmp_path / "a.csv", 'id,text,n\n1,"two\nlines, and ""quotes""",null\n2,,3\n')
    rows = readers.load_dataset(spark, csv).collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, and "quotes"', "null"), ("2", None, "3")]
    tsv = write(tmp_path / "a.tsv", "id\ttext\n1\ta,b\n")
    assert [tuple(r) for r in readers.load_dataset(spark, tsv).collect()] == [("1", "a,b")]


@pytest.mark.parametrize(
    "name, content, expected",
    [
        ("array", '[{"a": 1, "b": "x"},\n {"b": "y"}]', [(1, "x"), (None, "y")]),
        ("rows", '{"rows": [{"a": 1, "b": "x"}], "note": 1}', [(1, "x")]),
        ("data", '{\n"data": [{"a": 2, "b": "z"}]\n}', [(2, "z")]),
        ("object", '{"a": 3, "b": "w"}', [(3, "w")]),
        ("lines", '{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n', [(1, "x"), (2, "y")]),
    ],
)
def test_json_layouts(spark, tmp_path, name, content, expected):
    path = write(tmp_path / f"{name}.json", content)
    assert sorted(map(tuple, readers.load_dataset(spark, path).select("a", "b").collect()), key=str) == sorted(expected, key=str)


def test_json_scalar_and_unknown_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.load_dataset(spark, write(tmp_path / "s.json", "12"))
    with pytest.raises(ValueError):
        readers.detect_format("x.xml")


def test_row_index_is_dense(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000, numPartitions=5).write.parquet(path)
    rows = readers.with_row_index(spark.read.parquet(path)).collect()
    assert sorted(r.row_index for r in rows) == list(range(1000))


def test_kb_directory(spark, tmp_path):
    entry = {
        "question_or_utterance_pattern": "p", "topic_list": ["t"], "intent": "i", "example_agent_response": "e",
        "completeness_notes": "n",
    }
    for name in ("b", "a"):
        write(tmp_path / f"{name}.json", json.dumps({"kb_id": f"kb_{name}", **entry}))
    kb, version = readers.load_kb_dir(spark, str(tmp_path))
    rows = kb.orderBy("entry_index").collect()
    assert [r.kb_id for r in rows] == ["kb_a", "kb_b"] and version == "dir.v1"
    assert rows[0].version == "1.0" and rows[0].required_elements == []
    write(tmp_path / "_meta.json", '{"version": "team.v2"}')
    assert readers.load_kb_dir(spark, str(tmp_path))[1] == "team.v2"


def test_many_mappings_at_once(spark):
    one = {"record_id": "id", "user_input": "q", "category": "q", "mood": "id", "topic": " "}
    rows = [("a", i, t, s) for i, (t, s) in enumerate(one.items())] + [("b", i, f, f) for i, f in enumerate(ingest.REQUIRED_FIELDS)]
    mappings = spark.createDataFrame(rows, "dataset string, position int, target string, source string")
    columns = spark.createDataFrame([("a", "id"), ("a", " "), *[("b", f) for f in ingest.REQUIRED_FIELDS]], "dataset string, column string")
    issues = {tuple(r) for r in ingest.mapping_table_issues(mappings, columns).collect()}
    assert issues == {("a", c, i) for c, i, _ in ingest.mapping_issues(one, ["id", " "])}
    errors = {tuple(r) for r in ingest.mapping_table_errors(mappings).collect()}
    assert errors == {("a", *r) for r in ingest.mapping_errors(spark, one).collect()}
    assert ingest.mapping_table_issues(mappings.limit(0), columns).count() == 0


def test_positions_by_blocks_cut_at_samples(spark, monkeypatch):
    from judgespark.operators import ordinal

    monkeypatch.setattr(ordinal, "_BLOCK_ROWS", 50)
    values = [("part-%05d" % (i * 7919 % 1000), i % 3) for i in range(1000)] + [(None, 5), ("part-", 1), ("part-", 1)]
    df = spark.createDataFrame(values, "name string, x int").repartition(5)
    got = [(r.name, r.x) for r in sorted(ordinal.dense_ordinal(df, ["name", "x"], "at").collect(), key=lambda r: r.at)]
    assert got == sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
    assert sorted(r.at for r in ordinal.dense_ordinal(df, ["name", "x"], "at").collect()) == list(range(1003))
    lines = df.selectExpr("coalesce(name, '') AS line", "CAST(x AS STRING) AS y")
    numbered = ordinal.dense_ordinal(lines, ["line", "y"], "at")
    assert ordinal.tree_digest(numbered, "at", "line", 10, 1003).first() == ordinal.tree_digest(numbered, "at", "line", 10).first()
