"""Stored datasets whose readers always see a whole state.

Rows lie in folders that are never changed. What a dataset consists of is said
by its newest state, a small file; a new state is written under another name
and then renamed, which either happens or does not. A writer that dies leaves
at most folders that no state names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made a new state meanwhile; try again."""


class StoredDataset:
    """A dataset at a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("states").getFileSystem(spark._jsc.hadoopConfiguration())

    def _number(self) -> int:
        if not self._fs.exists(self._at("states")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("states"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=0)

    def state(self, number: int | None = None) -> dict:
        """``folders`` and ``batches`` of the newest state, or of an earlier one."""
        number = self._number() if number is None else number
        if not number:
            return {"folders": [], "batches": []}
        stream = self._fs.open(self._at(f"states/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _become(self, number: int, state: dict) -> None:
        held = self._at(f"states/_{uuid.uuid4().hex}")
        stream = self._fs.create(held, False)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        to = self._at(f"states/{number}.json")
        if self._fs.exists(to) or not self._fs.rename(held, to):
            self._fs.delete(held, False)
            raise Conflict(f"{self.path} has state {number} already")

    def _write(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def create(self, rows: DataFrame, batch: str = "first") -> None:
        """Replace all that is stored; earlier states can still be read."""
        number = self._number()
        self._become(number + 1, {"folders": [self._write(rows)], "batches": [batch]})

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add the rows, unless a batch of that name was added before: a job that runs again changes nothing. Says whether it did."""
        number = self._number()
        state = self.state(number)
        if batch in state["batches"]:
            return False
        self._become(number + 1, {"folders": [*state["folders"], self._write(rows)], "batches": [*state["batches"], batch]})
        return True

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the newest state, or of an earlier one; columns by name, null where a batch has none."""
        folders = self.state(number)["folders"]
        if not folders:
            raise ValueError(f"nothing is stored at {self.path}")
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders))

    def numbers(self) -> range:
        """Numbers of the states so far."""
        return range(1, self._number() + 1)

    def clean(self) -> int:
        """Remove folders that no state names, as dead writers leave them; gives their number. Not while anyone writes."""
        named = {f for n in self.numbers() for f in self.state(n)["folders"]}
        found = [f.getPath() for f in self._fs.listStatus(self._at("")) if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in named]
        return sum(bool(self._fs.delete(p, True)) for p in found)
