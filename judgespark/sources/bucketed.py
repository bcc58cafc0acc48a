"""A Parquet table bucketed and sorted by a key, written in named parts, below a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "base"
STAGED = "_staged"
# What is shuffled for a write is not needed after it, and would else stay until the driver collects garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session while something is run."""
    before = {s: spark.conf.get(s) for s in values}
    try:
        for s, value in values.items():
            spark.conf.set(s, value)
        yield
    finally:
        for s, value in before.items():
            spark.conf.set(s, value)


class BucketedTable:
    """Parts are replaced as a whole when they are written again, so a write that is repeated changes nothing.

    Joins on the key read bucket by bucket, without a shuffle of the table. ``buckets`` and ``columns`` are fixed when the
    table is made; open it with the same. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int):
        self._spark, self._path, self._columns, self._key, self._buckets = spark, path.rstrip("/"), columns, key, buckets
        self._open()

    def _open(self) -> None:
        """Register the newest version; a version counts once its mark is written."""
        folder = self._folder()
        self._version = max((int(n[1:]) for n in folder if n[0] == "v" and f"_DONE-{n}" in folder), default=0)
        self.name = self._register(f"v{self._version}")

    def _register(self, folder: str) -> str:
        path, fs = self._hadoop()
        fs.mkdirs(path(f"{self._path}/{folder}"))
        name = f"kept_{uuid.uuid4().hex}"
        # Keys are digests in hex: half of them is lost on a codec that only looks for repeats.
        self._spark.sql(
            f"CREATE TABLE {name} ({self._columns}, part STRING) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (part)"
            f" CLUSTERED BY ({self._key}) SORTED BY ({self._key}) INTO {self._buckets} BUCKETS LOCATION '{self._path}/{folder}'"
        )
        self._spark.catalog.recoverPartitions(name)
        return name

    def _hadoop(self):
        jvm = self._spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self._path)
        return jvm.org.apache.hadoop.fs.Path, base.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self) -> set[str]:
        path, fs = self._hadoop()
        return {s.getPath().getName() for s in fs.listStatus(path(self._path))} if fs.exists(path(self._path)) else set()

    def read(self) -> DataFrame:
        """All rows with their ``part``."""
        return self._spark.table(self.name)

    def files(self) -> int:
        return self.read().select(F.input_file_name().alias("f")).distinct().count()

    def close(self) -> None:
        """Forget the table; its files stay."""
        self._spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def remove(self) -> None:
        """Forget the table and delete its files."""
        self.close()
        path, fs = self._hadoop()
        fs.delete(path(self._path), True)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` laid as the buckets are, so that they meet the table, and are written, without another shuffle."""
        return rows.repartition(self._buckets, self._key)

    def write(self, rows: DataFrame | Iterable[DataFrame], part: str) -> None:
        """``rows`` as the part, one file a bucket; an empty part leaves what is there.

        ``rows`` may come in pieces, each with a file a bucket. They are run one after another, so that disk holds the shuffle
        files of one, and lie aside until the last is written: only then the part is replaced.
        """
        path, fs = self._hadoop()
        fs.delete(path(f"{self._path}/{STAGED}"), True)  # of a write that died
        staged = self._register(STAGED)
        try:
            names = [c for c in self.read().columns if c != "part"]
            for piece in [rows] if isinstance(rows, DataFrame) else rows:
                piece = piece.select(*names, F.lit(part).alias("part"))
                self._insert(self.dealt(piece).sortWithinPartitions(self._key), staged)
            for made in fs.listStatus(path(f"{self._path}/{STAGED}")):
                if made.getPath().getName().startswith("part="):
                    place = path(f"{self._path}/v{self._version}/{made.getPath().getName()}")
                    fs.delete(place, True)
                    if not fs.rename(made.getPath(), place):
                        raise OSError(f"cannot put {place.toString()} in place")
        finally:
            self._spark.sql(f"DROP TABLE {staged}")
            fs.delete(path(f"{self._path}/{STAGED}"), True)
            self._spark.catalog.recoverPartitions(self.name)
            self._spark.catalog.refreshTable(self.name)

    def _insert(self, rows: DataFrame, name: str, more: Mapping[str, str] | None = None) -> None:
        with settings(self._spark, {**CLEANUP, **(more or {})}):
            rows.write.insertInto(name)

    def compact(self, rows: DataFrame | None = None) -> None:
        """All parts, or ``rows`` of them, as one part with one sorted file a bucket.

        ``rows`` must still lie in the table's buckets. The new version is written beside the old one and
        counts from its mark on, so a compaction that dies halfway changes nothing.
        """
        path, fs = self._hadoop()
        old, done = self.name, self._version
        fs.delete(path(f"{self._path}/v{done + 1}"), True)  # of a compaction that died
        rows = self.read() if rows is None else rows
        name = self._register(f"v{done + 1}")
        names = [c for c in self._spark.table(name).columns if c != "part"]
        # A task reads one bucket of all parts and writes it as one file.
        rows = rows.select(*names, F.lit(BASE).alias("part")).sortWithinPartitions(self._key)
        self._insert(rows, name, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})
        fs.create(path(f"{self._path}/_DONE-v{done + 1}")).close()
        self._spark.sql(f"DROP TABLE {old}")
        self._spark.sql(f"DROP TABLE {name}")
        self._open()
        fs.delete(path(f"{self._path}/v{done}"), True)
        fs.delete(path(f"{self._path}/_DONE-v{done}"), True)
