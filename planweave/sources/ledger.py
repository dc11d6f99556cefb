"""Parquet tables with atomic commits: idempotent appends, numbering, and updates that rewrite the partitions they touch."""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"


class Conflict(Exception):
    """Other writers won every attempt."""


class Ledger:
    """A table of which each version is a small file that names the folders of its rows.

    Rows are written aside first, where no reader sees them. A commit then creates the next version's file, whole and only if there is none
    of that number yet; who comes too late looks at what the others committed and tries again. So writers in a race lose no rows and
    repeat none, readers see one version throughout, and a failed job leaves nothing but unnamed folders (``vacuum``).

    On HDFS and other stores whose rename doesn't replace files the version's file is renamed into place; on local and
    mounted disks it is linked there.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), attempts: int = 20) -> None:
        self.spark, self.path, self.partition_by, self.attempts = spark, path.rstrip("/"), partition_by, attempts

    # versions

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 for a table that has none."""
        folder, files = self._files(f"{self.path}/versions")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _state(self, version: int) -> dict:
        if version == 0:
            return {"schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0])

    def _commit(self, version: int, state: dict) -> bool:
        """Creates the version's file; False if another writer did."""
        folder, files = self._files(f"{self.path}/versions")
        files.mkdirs(folder)
        aside, _ = self._files(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        place, _ = self._files(f"{self.path}/versions/{version:012d}.json")
        if files.getUri().getScheme() != "file":
            done = not files.exists(place) and files.rename(aside, place)
        else:
            try:
                os.link(aside.toUri().getPath(), place.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        files.delete(aside, False)
        return done

    # reads

    def read(self, version: int | None = None, parts: set[str] | None = None) -> DataFrame | None:
        """The rows of a version (the newest), or of some of its partitions; null for a table that was never written."""
        state = self._state(self.version() if version is None else version)
        return None if state["schema"] is None else self._rows(state, state["folders"], parts)

    def _rows(self, state: dict, folders: dict[str, str], parts: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        wanted = [f"{self.path}/{f}" for f, part in sorted(folders.items()) if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    # writes

    def _part(self) -> Column:
        named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__null"))) for c in self.partition_by]
        return F.concat_ws("/", *named) if named else F.lit("all")

    def _aside(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows to a folder of their own; its folders, one a partition, and which one."""
        name = f"rows/{uuid.uuid4().hex}"
        dealt = rows.withColumn(PART, self._part())
        if self.partition_by:
            dealt = dealt.repartition(PART)
        dealt.write.partitionBy(PART).parquet(f"{self.path}/{name}")
        folder, files = self._files(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
        return {f"{name}/{f}": urllib.parse.unquote(f.removeprefix(f"{PART}=")) for f in found}

    def _write(self, change: Callable[[int, dict], tuple[DataFrame, set[str]] | None]) -> tuple[int, set[str]]:
        """Commits what ``change`` makes of the newest version: rows to add, and partitions that they replace. Made anew after a lost race."""
        for _ in range(self.attempts):
            version = self.version()
            state = self._state(version)
            made = change(version, state)
            if made is None:
                return version, set()
            rows, replaced = made
            new = self._aside(rows)
            if not new and not replaced:
                return version, set()
            kept = {f: part for f, part in state["folders"].items() if part not in replaced}
            if self._commit(version + 1, {"schema": state["schema"] or json.loads(rows.schema.json()), "folders": kept | new}):
                return version + 1, set(new.values()) | replaced
            for f in new:
                folder, files = self._files(f"{self.path}/{f}")
                files.delete(folder, True)
        raise Conflict(f"{self.path}: {self.attempts} attempts lost")

    def append(self, rows: DataFrame, keys: list[str]) -> int:
        """Adds the rows whose keys the table doesn't have, of rows that repeat a key one; the version that has them. Run again, it adds nothing."""

        def change(version: int, state: dict) -> tuple[DataFrame, set[str]]:
            fresh = rows.dropDuplicates(keys)
            if state["schema"] is None:
                return fresh, set()
            return new_rows(self._rows(state, state["folders"]), fresh, keys), set()

        return self._write(change)[0]

    def append_numbered(self, rows: DataFrame, keys: list[str], group: list[str], order: list[str], number: str = "sequence_no") -> int:
        """``append`` that numbers a group's new rows in their order, on from its largest number: no number comes twice or is left out."""

        def change(version: int, state: dict) -> tuple[DataFrame, set[str]]:
            fresh = rows.dropDuplicates(keys)
            place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
            if state["schema"] is None:
                return fresh.withColumn(number, place), set()
            here = self._rows(state, state["folders"])
            last = here.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.max(number).alias("__last"))
            same = F.lit(True)
            for c in group:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            numbered = new_rows(here, fresh, keys).withColumn(number, place).join(last, same, "left")
            return numbered.withColumn(number, F.col(number) + F.coalesce("__last", F.lit(0))).select(*here.columns), set()

        return self._write(change)[0]

    def update(self, changes: DataFrame, keys: list[str], insert: bool = True) -> int:
        """Writes changed rows back: rows of the table with the keys of ``changes`` take its other columns, and rows of new keys are added (or left
        out). Only partitions that the keys name are read and written again; returns how many.

        Keys are one row each in ``changes`` and name the partition: the table's partition columns are among them.
        """
        missing = set(self.partition_by) - set(keys)
        if missing:
            raise ValueError(f"partition columns that are no keys: {sorted(missing)}")

        def change(version: int, state: dict) -> tuple[DataFrame, set[str]] | None:
            parts = {r[0] for r in changes.select(self._part()).distinct().collect()}  # as many as the version's file names
            if state["schema"] is None:
                return (changes, set()) if insert else None
            here = self._rows(state, state["folders"], parts)
            names, others = here.columns, [c for c in changes.columns if c not in keys]
            new = changes.select(*[F.col(c).alias(f"__{c}") for c in keys], *[F.col(c).alias(f"__{c}") for c in others], F.lit(True).alias("__given"))
            same = F.lit(True)
            for c in keys:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            joined = here.withColumn("__here", F.lit(True)).join(new, same, "full" if insert else "left")
            value = lambda c: F.when(F.col("__here").isNull(), F.col(f"__{c}")).otherwise(F.col(c)) if c in keys else (F.when(F.col("__given"), F.col(f"__{c}")).otherwise(F.col(c)) if c in others else F.col(c))
            merged = joined.select(*[value(c).alias(c) for c in names])
            return merged, parts & set(state["folders"].values())

        _, touched = self._write(change)
        return len(touched)

    def compact(self) -> int:
        """Writes each partition of several folders as one; returns how many."""

        def change(version: int, state: dict) -> tuple[DataFrame, set[str]] | None:
            parts = list(state["folders"].values())
            several = {p for p in parts if parts.count(p) > 1}
            return (self._rows(state, state["folders"], several), several) if several else None

        return len(self._write(change)[1])

    def vacuum(self) -> int:
        """Deletes folders that the newest version doesn't name, such as those of failed writers; returns how many. Not to be run beside writers."""
        named = {f.split("/")[1] for f in self._state(self.version())["folders"]}
        folder, files = self._files(f"{self.path}/rows")
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in named] if files.exists(folder) else []
        for path in gone:
            files.delete(path, True)
        return len(gone)


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys (nulls equal nulls) the target does not have yet."""
    there = target.select(*[F.col(c).alias(f"__{c}") for c in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(there, same, "left_anti")
