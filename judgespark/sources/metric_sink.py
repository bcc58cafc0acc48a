"""A sink of metric rows with a commit, as a data source: ``format("judge_metrics")``.

A write belongs to a run, a section of it (agreement, slices, ...) and an attempt. Tasks write part files to a
folder of that write alone; the commit then names the files in one manifest, put in place whole under
``(run, section, attempt)``. What no manifest names is never read, so a failed or repeated task leaves
nothing behind, an attempt written again replaces itself, and of several attempts the highest counts.

Options: ``path``, ``run_id``, and optionally ``section`` (default ``metrics``) and ``attempt`` (default 1);
for reading ``path`` alone, or with ``run_id`` and ``section`` for one of them. Paths are local or shared folders,
or addresses that pyarrow's file systems know. Rows without a value are not metrics and are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.taskcontext import TaskContext

FORMAT = "judge_metrics"
ROW = "run_id string, section string, attempt int, key string, value double"
_FILE = pa.schema([("key", pa.string()), ("value", pa.float64())])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return found, base.rstrip("/")


def _option(options: dict, name: str, default: str | None = None) -> str:
    value = options.get(name, default)
    if not value:
        raise ValueError(f"option {name!r} is required")
    return value


@dataclass
class PartMessage(WriterCommitMessage):
    file: str | None
    rows: int


class MetricWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = _option(options, "path")
        self.run_id = _option(options, "run_id")
        self.section = _option(options, "section", "metrics")
        self.attempt = int(options.get("attempt", 1))
        if self.attempt < 1:
            raise ValueError("attempts are numbered from 1")
        self.write_id = uuid.uuid4().hex

    def _parts(self, base: str) -> str:
        return f"{base}/parts/{self.write_id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartMessage:
        files, base = _place(self.path)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        target, rows = f"{self._parts(base)}/{name}", 0
        writer = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                columns = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in _FILE]
                if any(c.null_count for c in columns):
                    raise ValueError("metric rows need a key and a value")
                if writer is None:
                    files.create_dir(self._parts(base), recursive=True)
                    writer = pq.ParquetWriter(target, _FILE, filesystem=files)
                writer.write_batch(pa.record_batch(columns, schema=_FILE))
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return PartMessage(name if rows else None, rows)

    def commit(self, messages: list[PartMessage | None]) -> None:
        files, base = _place(self.path)
        done = [m for m in messages if m is not None and m.file is not None]
        manifest = {
            "run_id": self.run_id,
            "section": self.section,
            "attempt": self.attempt,
            "write_id": self.write_id,
            "files": sorted(m.file for m in done),
            "rows": sum(m.rows for m in done),
        }
        folder = f"{base}/manifests/{quote(self.run_id, safe='')}/{quote(self.section, safe='')}"
        files.create_dir(folder, recursive=True)
        draft, target = f"{base}/parts/{self.write_id}.json", f"{folder}/{self.attempt:09d}.json"
        files.create_dir(f"{base}/parts", recursive=True)
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        files.move(draft, target)

    def abort(self, messages: list[PartMessage | None]) -> None:
        files, base = _place(self.path)
        folder = self._parts(base)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


@dataclass
class PartFile(InputPartition):
    run_id: str
    section: str
    attempt: int
    file: str


def manifests(path: str, run_id: str | None = None, section: str | None = None) -> list[dict]:
    """The manifests that count: the highest attempt of each run and section asked for."""
    files, base = _place(path)
    folder = f"{base}/manifests" + (f"/{quote(run_id, safe='')}" if run_id else "")
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    newest: dict[str, str] = {}
    for info in found:
        if info.type == fs.FileType.File and info.extension == "json":
            owner = info.path.rsplit("/", 1)[0]
            newest[owner] = max(newest.get(owner, ""), info.path)
    if section:
        newest = {owner: p for owner, p in newest.items() if owner.endswith("/" + quote(section, safe=""))}
    out = []
    for path_ in sorted(newest.values()):
        with files.open_input_stream(path_) as stream:
            out.append(json.loads(stream.read()))
    return out


class MetricReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _option(options, "path")
        self.run_id, self.section = options.get("run_id"), options.get("section")

    def partitions(self) -> list[PartFile]:
        return [
            PartFile(m["run_id"], m["section"], m["attempt"], f"{m['write_id']}/{name}")
            for m in manifests(self.path, self.run_id, self.section)
            for name in m["files"]
        ] or [PartFile("", "", 0, "")]

    def read(self, partition: PartFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:  # nothing is committed
            return
        files, base = _place(self.path)
        with files.open_input_file(f"{base}/parts/{partition.file}") as stream:
            for batch in pq.ParquetFile(stream).iter_batches():
                n = batch.num_rows
                owner = [pa.array([v] * n, t) for v, t in zip(
                    (partition.run_id, partition.section, partition.attempt), (pa.string(), pa.string(), pa.int32())
                )]
                yield pa.RecordBatch.from_arrays(
                    [*owner, *batch.columns], names=["run_id", "section", "attempt", "key", "value"]
                )


class MetricSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> MetricReader:
        return MetricReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MetricWriter:
        missing = [f.name for f in _FILE if f.name not in schema.names]
        if missing:
            raise ValueError(f"metric rows lack columns {missing}")
        return MetricWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricSource)


def write_metrics(
    metrics: DataFrame, path: str, run_id: str, section: str = "metrics", attempt: int = 1
) -> None:
    """Writes the ``(key, value)`` of ``metrics`` as one attempt of a section of ``run_id``."""
    register(metrics.sparkSession)
    options = {"path": path, "run_id": run_id, "section": section, "attempt": str(attempt)}
    metrics.select("key", "value").write.format(FORMAT).options(**options).mode("append").save()


def read_metrics(spark: SparkSession, path: str, run_id: str | None = None, section: str | None = None) -> DataFrame:
    """``(run_id, section, attempt, key, value)`` of the attempts that count."""
    register(spark)
    options = {k: v for k, v in {"path": path, "run_id": run_id, "section": section}.items() if v}
    return spark.read.format(FORMAT).options(**options).load()
