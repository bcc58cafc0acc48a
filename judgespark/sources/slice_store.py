"""Agreement reports kept up to date from changes.

Two tables are kept. The ledger has a row for each record: its last row's attributes and labels, and the counts of its
outcomes, bucketed by record. The crosstab has the counts of all slices. A change, new rows and new outcomes,
folds to one row per record; the ledger rows of just these records are looked up, their cells are taken
back from the crosstab, and the cells of what they have become are added. So a report after any
number of changes is that of all rows and outcomes at once, number for number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgespark.operators.scored import ledger_crosstab, record_ledger
from judgespark.operators.slices import DIMENSION_ATTRIBUTES, DIMENSIONS, sliced_items, sliced_report
from judgespark.schema import PILLARS, SCORES
from judgespark.sources.bucketed import BucketedTable

_CROSSTAB = "dimension string, slice string, pillar string, judge int, human int, n long"
_KEYS = ["dimension", "slice", "pillar", "judge", "human"]


class SliceStore:
    """Slices over ``names`` dimensions and ``pillars``, below ``path``, a folder that all executors share.

    Changes have ascending numbers from 1; a change that is made again, as after a failure, gives the same state. Rows are
    last-wins by ``row_index`` over all changes, also where an earlier row arrives later; outcomes add up.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        names: Sequence[str] = tuple(DIMENSION_ATTRIBUTES),
        pillars: Sequence[str] = PILLARS,
        buckets: int = 64,
    ):
        self._spark, self._path, self._names, self._pillars = spark, path.rstrip("/"), list(names), list(pillars)
        self._attributes = [a for name in self._names for a in DIMENSION_ATTRIBUTES[name]]
        numbers = range(len(self._pillars))
        self._labels = [f"label_{k}" for k in numbers]
        self._counts = [c for k in numbers for c in (f"failed_{k}", *[f"ok_{k}_{s}" for s in SCORES])]
        columns = ["record_id string", "change long", "row_index long"]
        columns += [f"{a} string" for a in self._attributes] + [f"{c} int" for c in self._labels] + [f"{c} bigint" for c in self._counts]
        self._ledger = BucketedTable(spark, f"{self._path}/ledger", ", ".join(columns), "record_id", buckets)

    def close(self) -> None:
        self._ledger.close()

    def _crosstab_path(self, change: int) -> str:
        return f"{self._path}/crosstab/change={change}"

    def _before(self, change: int) -> DataFrame:
        """The ledger before a change: of each record the row of the last change."""
        rows = self._ledger.read().drop("part").where(F.col("change") < change)
        names = [c for c in rows.columns if c != "record_id"]
        last = F.max_by(F.struct(*names), "change").alias("_last")
        return rows.groupBy("record_id").agg(last).select("record_id", "_last.*").drop("change")

    def _cells(self, ledger: DataFrame) -> DataFrame:
        """The counts that ledger rows add to the crosstab; records without a row yet add none."""
        known = ledger.where(F.col("row_index").isNotNull())
        spread = sliced_items(known, {name: DIMENSIONS[name] for name in self._names})
        return ledger_crosstab(spread, self._pillars, ["dimension", "slice"])

    def apply(self, change: int, rows: DataFrame, outcomes: DataFrame) -> None:
        """Add the rows and outcomes of a change."""
        if change < 1:
            raise ValueError("changes are numbered from 1")
        # A row's index goes with its attributes, so the last row of the change can be held against the one before.
        new = record_ledger(rows, outcomes, self._pillars, ["row_index", *self._attributes], how="full")
        before = self._before(change)
        old = before.select("record_id", F.struct(*[c for c in before.columns if c != "record_id"]).alias("_old"))
        both = new.hint("merge").join(old.hint("merge"), "record_id", "left")
        later = "_old.row_index IS NULL OR row_index >= _old.row_index"
        from_row = ["row_index", *self._attributes, *self._labels]
        pick = [f"CASE WHEN row_index IS NOT NULL AND ({later}) THEN {c} ELSE _old.{c} END AS {c}" for c in from_row]
        add = [f"{c} + coalesce(_old.{c}, 0L) AS {c}" for c in self._counts]
        changed = both.selectExpr("record_id", f"{change}L AS change", *pick, *add, "_old")
        stored = f"{self._path}/changed-{change}"
        changed.write.mode("overwrite").parquet(stored)
        changed = self._spark.read.parquet(stored)
        self._ledger.write(changed.drop("_old"), f"change-{change}")
        minus = self._cells(changed.where("_old IS NOT NULL").select("record_id", "_old.*")).withColumn("n", -F.col("n"))
        counts = self._cells(changed).unionByName(minus)
        if change > 1:
            counts = counts.unionByName(self._crosstab(change - 1))
        counts = counts.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where("n <> 0")
        counts.write.mode("overwrite").parquet(self._crosstab_path(change))
        path, fs = self._ledger._hadoop()
        fs.delete(path(stored), True)
        fs.delete(path(self._crosstab_path(change - 2)), True)  # one before stays, for a change that is made again

    def _crosstab(self, change: int) -> DataFrame:
        return self._spark.read.schema(_CROSSTAB).parquet(self._crosstab_path(change))

    def crosstab(self, change: int) -> DataFrame:
        """Counts per dimension, slice and pillar after the last change, or the one before it."""
        return self._crosstab(change)

    def report(self, change: int) -> DataFrame:
        """The slice report after a change."""
        return sliced_report(self._crosstab(change), self._pillars)

    def compact(self) -> None:
        """Keep only the last ledger row of each record, in one file a bucket. Earlier changes cannot be made again then."""
        rows = self._ledger.read().drop("part")
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "record_id"]), "change").alias("_last")
        self._ledger.compact(rows.groupBy("record_id").agg(last).select("record_id", "_last.*"))

