"""Tables that changes are written to: only partitions with a change are rewritten, and one small file makes a commit visible."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .storage import stored

_COMMIT = "number long, token string, part string, folder string"


class VersionedTable:
    """Rows in Parquet folders by partition, and a list of the live folders for each commit.

    A commit first stages new folders for the partitions that change, beside the
    old ones, and then publishes the new list as one file, which Spark's writer
    moves into place by a rename. A reader takes the newest list, so it sees all
    of a commit or nothing, and goes on reading old folders while a new commit is
    made. The list has one row a partition. Folders that no list names (of a run
    that stopped before its commit) are never read. There is one writer at a time;
    if two have committed the same number, reading raises.

    `parts` are SQL expressions over key columns whose values partition the
    table; null is a value too.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, parts: list[str]):
        self.spark, self.path, self.schema, self.parts = spark, path.rstrip("/"), schema, parts

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self) -> tuple[int, DataFrame | None]:
        commits = self._commits()
        number = None if commits is None else commits.agg(F.max("number")).first()[0]
        if number is None:
            return -1, None
        newest = commits.where(F.col("number") == number)
        if newest.select("token").distinct().count() > 1:
            raise RuntimeError(f"two writers have made commit {number} of {self.path}")
        return number, newest

    def _named(self, rows: DataFrame) -> DataFrame:
        """Rows with `_part`, the name of their partition's folder."""
        each = [F.coalesce(F.hex(F.expr(c).cast("string").cast("binary")), F.lit("null")) for c in self.parts]
        return rows.withColumn("_part", F.concat_ws("-", *each))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as of the newest commit."""
        _, newest = self._newest()
        return self._rows(sorted(r["folder"] for r in newest.where("folder is not null").collect()) if newest is not None else [])

    def commit(self, changes: DataFrame, keys: list[str], token: str) -> bool:
        """Write `changes` (the table's columns, and change: insert, update or delete); True if they were not there yet.

        `token` names this set of changes: a run that is repeated with it, after a
        crash anywhere, writes what is missing, and nothing once it has been
        committed. Keys are compared null-safely and are unique in the table and
        in the changes. The changes are stored once before anything is staged.
        """
        if not re.fullmatch(r"[\w.-]+", token):
            raise ValueError("a token is made of letters, digits, dots and hyphens, as it names folders")
        number, newest = self._newest()
        commits = self._commits()
        if commits is not None and not commits.where(F.col("token") == token).isEmpty():
            return False
        staged = f"{self.path}/data/{number + 1}-{token}"
        names = [f.name for f in self.schema]
        changes = stored(self._named(changes.select(*names, "change")), "changes")
        live = {} if newest is None else {r["part"]: r["folder"] for r in newest.where("folder is not null").collect()}
        touched = {r["_part"] for r in changes.select("_part").distinct().collect()}
        old = self._named(self._rows([live[p] for p in sorted(touched) if p in live]))
        gone = changes.select(*[F.col(k).alias(f"_{k}") for k in keys])
        kept = old.join(gone, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        made = kept.unionByName(changes.where("change <> 'delete'").drop("change"))
        made.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(staged)
        found = self.spark.read.schema(StructType([*self.schema, StructField("_part", StringType())])).parquet(staged)
        written = {r["_part"] for r in found.select("_part").distinct().collect()}
        folders = {p: f for p, f in live.items() if p not in touched} | {p: f"{staged}/_part={p}" for p in written}
        self._publish(number + 1, token, folders)
        return True

    def _publish(self, number: int, token: str, folders: dict[str, str]) -> None:
        rows = [(number, token, p, f) for p, f in sorted(folders.items())] or [(number, token, None, None)]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number:012d}-{token}")
