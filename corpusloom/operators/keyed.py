"""Tables of keyed rows in a folder: an append log whose latest version of each key counts.

Every write is a batch of its own, and a commit written last says that it counts; what failed before is not read.  Reading merges:
of each key the row of the highest version, of equal ones that of the later commit.  Compaction writes what counts as a base that
supersedes the batches before it, and replaces whole partitions of rows at once (``replaced``) without touching others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch string, kind string, number long, scope string"


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    version: str
    schema: str

    def commits(self) -> list:
        """The batches that count, oldest first: a base supersedes what came before it.  One row a batch since the last compaction."""
        try:
            rows = sorted(self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect(), key=lambda r: r["number"])
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        bases = [i for i, r in enumerate(rows) if r["kind"] == "base"]
        return rows[bases[-1] :] if bases else rows

    def _write(self, rows: DataFrame, kind: str, scope: str | None = None) -> None:
        batch, number = uuid.uuid4().hex, 1 + max([0, *(r["number"] for r in self.commits())])
        rows.write.parquet(f"{self.path}/rows/batch={batch}")
        self.spark.createDataFrame([(batch, kind, number, scope)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def append(self, rows: DataFrame) -> None:
        """Rows of the table's columns, and of ``_deleted`` where they have it: a key whose latest row is deleted is gone.  One writer at a time."""
        deleted = F.col("_deleted") if "_deleted" in rows.columns else F.lit(False)
        names = [f.split()[0] for f in self.schema.split(",")]
        self._write(rows.select(*names, deleted.alias("_deleted")), "rows")

    def log(self) -> DataFrame:
        """All rows that count for reading, with ``_number``, the commit they came by."""
        commits = self.commits()
        data = [r for r in commits if r["kind"] in ("rows", "base")]
        kinds = f"{self.schema}, _deleted boolean"
        if not data:
            return self.spark.createDataFrame([], f"{kinds}, _number long")
        read = self.spark.read.schema(f"{kinds}, batch string").option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={r['batch']}" for r in data])
        numbers = F.create_map(*[F.lit(x) for r in data for x in (r["batch"], r["number"])])
        return read.withColumn("_number", numbers[F.col("batch")]).drop("batch")

    def latest(self) -> DataFrame:
        """Of each key the row that counts."""
        rows = self.log()
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(self.version, "_number", F.xxhash64(*rows.columns))).alias("_r"))
        return best.where(~F.col("_r._deleted")).select("_r.*").drop("_deleted", "_number")

    def compact(self) -> None:
        """A base of what counts.  Deletions go, so an older version of a deleted key that is appended later counts anew."""
        self._write(self.latest().withColumn("_deleted", F.lit(False)), "base")

    def replaced(self, rows: DataFrame, partition: str) -> None:
        """The partitions that ``rows`` have hold these rows alone; others stay.  Their keys of before are deleted at the version of the new rows' highest."""
        names = rows.select(partition).distinct()
        top = rows.agg(F.max(self.version)).first()[0]
        old = self.latest().join(names, partition, "left_semi").join(rows.select(self.key), self.key, "left_anti")
        gone = old.withColumn(self.version, F.greatest(F.col(self.version), F.lit(top))).withColumn("_deleted", F.lit(True))
        self.append(rows.withColumn("_deleted", F.lit(False)).unionByName(gone.select(*rows.columns, "_deleted")))
