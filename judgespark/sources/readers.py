"""Reading evaluation data: CSV, TSV, JSON, NDJSON, Parquet, and knowledge-bank files."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgespark.operators.ordinal import dense_ordinal
from judgespark.schema import KB_ENTRY

# File extension -> reader.
EXTENSIONS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "ndjson",
    ".ndjson": "ndjson",
    ".parquet": "parquet",
    ".pq": "parquet",
}
DEFAULT_KB_VERSION = "dir.v1"


def detect_format(path: str) -> str:
    extension = PurePosixPath(path).suffix.lower()
    if extension not in EXTENSIONS:
        raise ValueError(f"unsupported file extension {extension!r}, supported: {sorted(EXTENSIONS)}")
    return EXTENSIONS[extension]


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """All columns as text, so that the null policy decides what is empty.

    Cells may span lines by default, which makes a file one split; pass ``multi_line=False`` for
    large files without embedded line breaks.
    """
    return spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"'
    )


def read_ndjson(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One object per line; columns are the union of all keys."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def _unwrap(df: DataFrame) -> DataFrame:
    """Rows of a ``{"rows": [...]}`` or ``{"data": [...]}`` document; other objects are one row."""
    for name in ("rows", "data"):
        if name in df.columns:
            dtype = df.schema[name].dataType
            if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
                return df.select(F.inline(F.col(name)))
            if isinstance(dtype, T.ArrayType):
                # Arrays that are all empty are read as arrays of text.
                if df.where(F.size(name) > 0).isEmpty():
                    return _no_rows(df.sparkSession)
                raise ValueError("JSON rows must be objects")
    return df


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str], list[str]]:
    """Files of one array, of one other document, and of one object per line.

    A file's first line tells: several lines that start with a whole object are objects per line.
    Per file, only its name, one character and two flags reach the driver.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.ltrim("value").alias("value")
    )
    first = F.min_by(
        F.struct(
            F.substring("value", 1, 1).alias("sign"),
            (F.substring("value", 1, 1).eqNullSafe("{") & F.get_json_object("value", "$").isNotNull()).alias("whole"),
        ),
        "id",
    )
    files = lines.where("value <> ''").groupBy("file").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).collect()
    if any(f["first"]["sign"] not in ("[", "{") for f in files):
        raise ValueError("the top-level JSON value must be an array or object")
    arrays = [f["file"] for f in files if f["first"]["sign"] == "["]
    per_line = [f["file"] for f in files if f["first"]["whole"] and f["n"] > 1]
    return arrays, [f["file"] for f in files if f["file"] not in {*arrays, *per_line}], per_line


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, layout: str | None = None
) -> DataFrame:
    """JSON documents (array of objects, envelope or single object), or files with one object per line.

    The layout is told file by file, which reads the text once; ``layout`` ("array", "document" or
    "lines") states it for all files instead.
    """
    if layout not in (None, "array", "document", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout is None:
        arrays, documents, per_line = _json_files(spark, path)
    else:
        arrays, documents, per_line = ([path] if layout == kind else [] for kind in ("array", "document", "lines"))
    parts = []
    if arrays:
        parts.append(spark.read.json(arrays, schema=schema, multiLine=True, mode="FAILFAST"))
    if documents:
        parts.append(_unwrap(spark.read.json(documents, schema=schema, multiLine=True, mode="FAILFAST")))
    if per_line:
        parts.append(read_ndjson(spark, per_line, schema))
    return union_ragged(*parts) if parts else _no_rows(spark)


def scrub_nans(df: DataFrame) -> DataFrame:
    """NaN to NULL in float columns and in arrays of floats."""
    floats = (T.DoubleType, T.FloatType)
    columns = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, floats):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, floats):
            c = F.transform(c, lambda x: F.when(~F.isnan(x), x))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def load_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = True,
    layout: str | None = None,
) -> DataFrame:
    """Read ``path`` by its extension. ``multi_line=False`` lets a CSV or TSV file be split over tasks,
    ``layout`` states how JSON files are laid out."""
    readers = {
        "csv": lambda: read_csv(spark, path, multi_line=multi_line),
        "tsv": lambda: read_csv(spark, path, sep="\t", multi_line=multi_line),
        "json": lambda: read_json(spark, path, schema, layout),
        "ndjson": lambda: read_ndjson(spark, path, schema),
        "parquet": lambda: spark.read.parquet(path),
    }
    return scrub_nans(readers[detect_format(path)]())


def union_ragged(*parts: DataFrame) -> DataFrame:
    """Rows of several sources over the union of their columns; absent cells are NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 0-based position of each row of a file scan.

    Rows are numbered inside their partition; the partition offsets come from a running sum over
    one count per partition. ``df`` must be a scan without shuffle, so both passes see the same
    partitions.
    """
    base = df.withColumn("_id", F.monotonically_increasing_id())
    marked = base.withColumns(
        {
            "_part": F.shiftright("_id", 33),
            "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    counts = marked.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        marked.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_id", "_part", "_pos", "_offset")
    )


# --- knowledge bank -----------------------------------------------------------


def _with_defaults(entries: DataFrame) -> DataFrame:
    lists = [f.name for f in KB_ENTRY.fields if isinstance(f.dataType, T.ArrayType)]
    columns = {name: F.coalesce(name, F.array().cast("array<string>")) for name in lists}
    return entries.withColumns({**columns, "version": F.coalesce("version", F.lit("1.0"))})


def load_kb(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Entries and version of one JSON file ``{"version": ..., "entries": [...]}``.

    ``entry_index`` is the position in the file.
    """
    schema = T.StructType(
        [T.StructField("version", T.StringType()), T.StructField("entries", T.ArrayType(KB_ENTRY))]
    )
    document = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    version = document.select("version").first()
    if version is None or not version[0]:
        raise ValueError(f"{path} must provide a non-empty version")
    entries = document.select(F.posexplode("entries").alias("entry_index", "entry"))
    return _with_defaults(entries.select(F.col("entry_index").cast("long"), "entry.*")), version[0]


def load_kb_dir(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Entries of a directory with one JSON entry per file, in file-name order.

    ``_meta.json`` may give the version; files starting with ``_`` or ``.`` are not entries.
    """
    entries = spark.read.schema(KB_ENTRY).json(path, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json")
    named = entries.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"))
    ordered = dense_ordinal(named, ["file_name"], "entry_index")
    return _with_defaults(ordered), _meta_version(spark, path)


def _meta_version(spark: SparkSession, path: str) -> str:
    """Version in ``_meta.json``; read through the Hadoop API because scans skip ``_`` files."""
    jvm = spark.sparkContext._jvm
    meta = jvm.org.apache.hadoop.fs.Path(path, "_meta.json")
    fs = meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(meta):
        return DEFAULT_KB_VERSION
    stream = fs.open(meta)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    version = json.loads(text).get("version")
    if not isinstance(version, str) or not version:
        raise ValueError(f"{path}/_meta.json must provide a non-empty version")
    return version
