"""Tables that are merged when they are read.

A change does not rewrite the table: it adds a delta with the new rows of the changed keys and a list of
those keys (with no rows for a deleted one). A snapshot is the list of deltas in order; one pointer
names the current one and moves in a single step, so a reader sees one snapshot from start to end. A row
counts unless a later delta lists its key. A key may have several rows (the chunks of a document): a
change replaces all of them.

Reading therefore costs the rows plus a join with the keys of the later deltas. `compact` joins the last
deltas, or all of them, into one; sizes grow in tiers, so a row is rewritten about log(table) times in
all, not once for each batch. Deltas that no kept snapshot names are removed by `vacuum`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import small_side
from tidemark.sources.versions import _fs, current_path, point

#: Deltas of about one size that are joined into one.
FANOUT = 4


@dataclass
class Delta:
    """One change: folder, number, rows, keys, and the batch that made it (if it was one of a stream)."""

    name: str
    number: int
    rows: int
    keys: int
    batch: str | None = None


class DeltaTable:
    """A table below `path` with the key columns `keys`; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    # -- snapshots ----------------------------------------------------------------------------

    def snapshot(self) -> dict:
        """The current snapshot: schema of the rows and the deltas in order."""
        at = current_path(self.spark, self.path)
        return self.load(at) if at else {"schema": None, "deltas": [], "next": 0, "name": None}

    def load(self, name: str) -> dict:
        found = json.loads(self.spark.read.text(name, wholetext=True).first()[0])
        return found | {"deltas": [Delta(**d) for d in found["deltas"]], "name": name}

    def _publish(self, schema: str, deltas: list[Delta], following: int) -> None:
        name = f"{self.path}/snapshots/{following:09d}-{uuid4().hex}.json"
        fs, jvm = _fs(self.spark, name)
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(name), True)
        stream.write(bytearray(json.dumps({"schema": schema, "deltas": [asdict(d) for d in deltas], "next": following}).encode()))
        stream.close()
        point(self.spark, self.path, name)

    # -- reading ------------------------------------------------------------------------------

    def _rows(self, deltas: list[Delta], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/data/{d.name}/rows").withColumn("__n", F.lit(d.number)) for d in deltas if d.rows]
        none = self.spark.createDataFrame([], kind).withColumn("__n", F.lit(0))
        return reduce(DataFrame.unionByName, parts) if parts else none

    def _keys(self, deltas: list[Delta]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/data/{d.name}/keys").withColumn("__last", F.lit(d.number)) for d in deltas if d.keys]
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.max("__last").alias("__last")) if parts else None

    def _live(self, deltas: list[Delta], schema: str, among: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        rows, later = self._rows(deltas, schema), self._keys(deltas[1:])
        rows = among(rows) if among else rows
        if later is not None:
            later = small_side(later.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], "__last"))
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys])
            rows = rows.join(later, same & (F.col("__last") > F.col("__n")), "left_anti")
        return rows.drop("__n")

    def read(self, snapshot: str | None = None, among: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows of the current snapshot, or of the named one; `among` filters rows before they are held against later changes."""
        found = self.load(snapshot) if snapshot else self.snapshot()
        if found["schema"] is None:
            raise FileNotFoundError(self.path)
        return self._live(found["deltas"], found["schema"], among)

    def exists(self) -> bool:
        return current_path(self.spark, self.path) is not None

    # -- writing ------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, keys: DataFrame | None, number: int, batch: str | None = None) -> Delta:
        name = f"d{number:09d}-{uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{name}/rows")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}/rows").count()
        n_keys = 0
        if keys is not None:
            keys.write.parquet(f"{self.path}/data/{name}/keys")
            n_keys = self.spark.read.schema(keys.schema).parquet(f"{self.path}/data/{name}/keys").count()
        return Delta(name, number, n, n_keys, batch)

    def change(self, rows: DataFrame, deleted: DataFrame | None = None, batch: str | None = None, compacting: bool = True) -> None:
        """Replace all rows of the keys in `rows` by these, and drop those of the keys in `deleted`.

        A `batch` that is in the table already is not applied again.
        """
        found = self.snapshot()
        if batch is not None and any(d.batch == batch for d in found["deltas"]):
            return
        schema = found["schema"] or rows.schema.json()
        rows = rows.select(*[f["name"] for f in json.loads(schema)["fields"]])
        keys = rows.select(*self.keys)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(*self.keys))
        made = self._write(rows, keys.distinct(), found["next"], batch)
        self._publish(schema, [*found["deltas"], made], found["next"] + 1)
        if compacting:
            self.compact()

    def compact(self, whole: bool = False, fanout: int = FANOUT) -> None:
        """Join the last `fanout` or more deltas of one tier into one, as long as there are such; or all deltas.

        The tier of a delta is the number of times its rows and keys can be divided by `fanout`.
        """
        found = self.snapshot()
        deltas = found["deltas"]
        tier = lambda d: 0 if d.rows + d.keys < fanout else len(_digits(d.rows + d.keys, fanout)) - 1
        while True:
            n = len(deltas) if whole else next((k for k in range(fanout, len(deltas) + 1) if len({tier(d) for d in deltas[-k:]}) == 1 and (k == len(deltas) or tier(deltas[-k - 1]) != tier(deltas[-1]))), 0)
            if n < 2:
                break
            old, last = deltas[:-n], deltas[-n:]
            listed = [self.spark.read.parquet(f"{self.path}/data/{d.name}/keys") for d in last if d.keys]
            keys = reduce(DataFrame.unionByName, listed).distinct() if old and listed else None  # the first delta needs none
            made = self._write(self._live(last, found["schema"]), keys, last[-1].number, last[-1].batch)
            deltas = [*old, made]
            if whole:
                break
        if len(deltas) < len(found["deltas"]):
            self._publish(found["schema"], deltas, found["next"])

    def vacuum(self) -> int:
        """Remove deltas that the current snapshot does not name; how many."""
        fs, jvm = _fs(self.spark, self.path)
        Path = jvm.org.apache.hadoop.fs.Path
        used = {d.name for d in self.snapshot()["deltas"]}
        gone = [f.getPath() for f in fs.listStatus(Path(f"{self.path}/data")) if f.getPath().getName() not in used] if fs.exists(Path(f"{self.path}/data")) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, digit = divmod(n, base)
        out.append(digit)
    return out
