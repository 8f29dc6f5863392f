"""A table of stored changes: rows are never rewritten in place, a manifest says which folders of rows make up a version.

A change writes its rows (tombstones for deletions) to a folder of its own and then a manifest of the next number, which
lists the folders in order; that file is created exclusively, so of two writers of one version one fails, and whatever a
failed write has left is in no manifest. Reading takes the last row of each key. Compaction writes one folder for all of
them. The first version stays named in every manifest and can always be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has stored this version."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder, list(keys)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._path(f"{self.folder}/manifest/{number:012d}.json")

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifest")
        names = [f.getPath().getName() for f in self._store.listStatus(at)] if self._store.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of ``version``; one that a lost writer has left unfinished is passed over."""
        for number in reversed(self._numbers()):
            if version is None or number <= version:
                lines = self.spark.read.text(self._name(number).toString()).collect()  # one short line
                if len(lines) == 1 and lines[0].value.endswith("}"):
                    return json.loads(lines[0].value)
        return None

    def _store_rows(self, rows: DataFrame, seen: dict | None, keep: Sequence[str]) -> int:
        """Writes ``rows`` (with ``_gone``) after the folders in ``keep`` and commits them as the next version."""
        number = max([*self._numbers(), -1]) + 1
        name = f"{number:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_version", F.lit(number).cast("long")).write.parquet(f"{self.folder}/rows/{name}")
        manifest = {"version": number, "folders": [*keep, name], "first": seen["first"] if seen else name}
        now = self._manifest()
        if (now and now["version"]) != (seen and seen["version"]):
            raise Conflict(f"version {now['version']} was stored meanwhile")
        try:
            out = self._store.create(self._name(number), False)
        except Exception as e:
            raise Conflict(f"version {number} was stored meanwhile") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return number

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        every = self.spark.read.parquet(*[f"{self.folder}/rows/{f}" for f in folders])
        if len(folders) == 1:
            return every
        rest = [c for c in every.columns if c not in self.keys]
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row"))
        return last.select(*self.keys, "_row.*")

    @property
    def version(self) -> int | None:
        found = self._manifest()
        return found and found["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of ``version``."""
        found = self._manifest(version)
        if found is None:
            raise FileNotFoundError(self.folder)
        return self._rows(found["folders"]).where("not _gone").drop("_gone", "_version")

    def first(self) -> DataFrame:
        """The rows as they were first stored."""
        return self._rows([self._manifest()["first"]]).where("not _gone").drop("_gone", "_version")

    def create(self, rows: DataFrame) -> int:
        """Rows of new keys; raises if one of them is there already."""
        seen = self._manifest()
        if seen and not self.read().join(rows.select(*self.keys), self.keys, "left_semi").isEmpty():
            raise ValueError("a key is stored already")
        return self._store_rows(rows.withColumn("_gone", F.lit(False)), seen, seen["folders"] if seen else [])

    def update(self, changes: DataFrame) -> int:
        """Columns of ``changes`` replace those of rows with the same keys; keys that aren't stored change nothing."""
        seen, now = self._manifest(), self.read()
        new = [c for c in changes.columns if c not in self.keys]
        rows = now.drop(*new).join(changes, self.keys).select(*now.columns)
        return self._store_rows(rows.withColumn("_gone", F.lit(False)), seen, seen["folders"])

    def delete(self, keys: DataFrame) -> int:
        seen = self._manifest()
        rows = self.read().join(keys.select(*self.keys), self.keys, "left_semi")
        return self._store_rows(rows.withColumn("_gone", F.lit(True)), seen, seen["folders"])

    def compact(self) -> int:
        """One folder for all that is stored, which later reads take without an aggregate."""
        seen = self._manifest()
        return self._store_rows(self.read().withColumn("_gone", F.lit(False)), seen, [])


def corrected_once(table: Versions, column: str, correct) -> int | None:
    """Stores ``correct`` of a text column for the rows that it changes; None if it changes none. The first version stays."""
    rows = table.read().withColumn("_new", correct(F.col(column))).where(~F.col("_new").eqNullSafe(F.col(column)))
    rows = rows.select(*table.keys, F.col("_new").alias(column))
    return None if rows.isEmpty() else table.update(rows)
