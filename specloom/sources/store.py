"""Snapshots of the state: Parquet folders and a pointer that names those of each table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..schemas import TABLES, empty_state


class SnapshotStore:
    """A knowledge base under ``root`` on any file system Spark can write to.

    ``save`` writes the folders that a change makes and then one small pointer
    folder, numbered one higher, that names the folders of each table; those of
    unchanged tables are named again, not written.  Readers take the highest
    complete number, so they see the old or the new state and never a part.
    One writer at a time.

    Rows of a stored folder are deleted by naming them: a folder of deletions
    holds the file and row index of each, and a read leaves those rows out.  So
    neither a delete nor a new status writes a folder of rows again, and older
    versions stay readable.  ``compact`` writes a table without them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/pointer")
        if not fs.exists(p):
            return []
        done = lambda s: self._fs(f"{s.getPath().toString()}/_SUCCESS")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if (x := done(s))[0].exists(x[1]))

    def _pointer(self, version: int | None = None) -> dict:
        have = self.versions()
        if version is None and not have:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/pointer/{have[-1] if version is None else version}").first()[0])

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """Names of the folders of each table in the current state, or in ``version``; none in a new store."""
        return {t: names for t, names in self._pointer(version).items() if t in TABLES}

    def deletions(self, version: int | None = None) -> dict[str, list[str]]:
        """Names of the folders that name deleted rows, by table."""
        return self._pointer(version).get("deleted", {})

    def _rows(self, table: str, folders: list[str], deleted: list[str]) -> DataFrame:
        """Rows with _file and _index, without deleted ones."""
        rows = self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/data/{name}/{table}" for name in folders])
        placed = rows.select("*", F.regexp_extract("_metadata.file_path", "/data/([^/]+/[^/]+/[^/]+)$", 1).alias("_file"), F.col("_metadata.row_index").alias("_index"))
        if not deleted:
            return placed
        gone = self.spark.read.schema("_file string, _index long").parquet(*[f"{self.root}/data/{name}/{table}" for name in deleted])
        return placed.join(gone, ["_file", "_index"], "left_anti")

    def read(self, table: str, folders: list[str], deleted: list[str] | None = None) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        if not deleted:
            return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/data/{name}/{table}" for name in folders])
        return self._rows(table, folders, deleted).drop("_file", "_index")

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """The current state, or that of ``version``; an empty one in a new store."""
        have, deleted = self.folders(version), self.deletions(version)
        return {t: self.read(t, have[t], deleted.get(t)) for t in TABLES} if have else empty_state(self.spark)

    def find(self, table: str, column: str, values: DataFrame) -> DataFrame:
        """Current rows of ``table`` whose ``column`` is one of ``values`` (its one column), with _file and _index, for ``save``'s ``delete``."""
        have = self.folders().get(table, [])
        if not have:
            return self.spark.createDataFrame([], f"{TABLES[table]}, _file string, _index long")
        wanted = values.select(F.col(values.columns[0]).alias(column))
        rows = self._rows(table, have, self.deletions().get(table, []))
        return rows.join(wanted, column, "left_semi")

    def changes(self, table: str, old: int, new: int | None = None) -> DataFrame:
        """Rows of ``table`` that version ``old`` has and ``new`` (the current one) has not, and the reverse, with ``change``: removed or added.

        Rows are compared as wholes and as often as they are there, so a row
        that was written anew without a change is in neither.  A folder that
        both versions name is read only if deletions that one of them lacks name
        rows of it.
        """
        have, gone = [self.folders(v).get(table, []) for v in (old, new)], [self.deletions(v).get(table, []) for v in (old, new)]
        plain = lambda df: df.select(*[F.array_sort(F.map_entries(c)).alias(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in self.spark.createDataFrame([], TABLES[table]).columns])

        def only(mine: int) -> DataFrame:
            """Rows of one version that are not in the other by folder or deletion."""
            parts = [plain(self.read(table, [f for f in have[mine] if f not in have[1 - mine]], gone[mine]))]
            more = [f for f in gone[1 - mine] if f not in gone[mine]]
            if more:
                named = self.spark.read.schema("_file string, _index long").parquet(*[f"{self.root}/data/{name}/{table}" for name in more])
                # folder names, of which the pointer holds the whole list anyway
                touched = {r[0] for r in named.select(F.substring_index("_file", "/", 1)).distinct().collect()}
                both = [f for f in have[mine] if f in have[1 - mine] and f in touched]
                if both:
                    parts.append(plain(self._rows(table, both, gone[mine]).join(named, ["_file", "_index"], "left_semi")))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

        before, after = only(0), only(1)
        out = before.exceptAll(after).withColumn("change", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))
        maps = [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema if isinstance(f.dataType, MapType)]
        return out.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else out

    def save(self, replace: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None) -> int:
        """A new version: tables of ``replace`` anew, rows of ``append`` in more folders, the rows of ``delete`` (_file, _index) gone."""
        version, now = (self.versions() or [0])[-1] + 1, self.folders()
        deleted = self.deletions()
        if not now:  # a new store starts with all tables
            now, replace = {}, empty_state(self.spark) | replace

        def put(df: DataFrame, t: str) -> str:
            name = uuid.uuid4().hex
            df.write.parquet(f"{self.root}/data/{name}/{t}")
            return name

        for t, df in replace.items():
            now[t], deleted[t] = [put(df, t)], []
        for t, df in (append or {}).items():
            now[t] = [*now[t], put(df, t)]
        for t, df in (delete or {}).items():
            deleted[t] = [*deleted.get(t, []), put(df.select("_file", "_index"), t)]
        pointer = now | {"deleted": {t: names for t, names in deleted.items() if names}}
        self.spark.createDataFrame([(json.dumps(pointer),)], "value string").coalesce(1).write.text(f"{self.root}/pointer/{version}")
        return version

    def compact(self, table: str) -> int:
        """A new version in which ``table`` is one folder again, without deleted rows."""
        return self.save({table: self.load()[table]})
