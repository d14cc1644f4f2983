"""Generations of a corpus: immutable layers of tables behind one manifest, which a single atomic put makes current.

A folder holds ``manifest-<number>.json`` and the layers that they name. A layer of a table has rows and, per key
column, the keys that it withdraws: a row of an earlier layer counts no more once a later layer withdraws one of
its keys. So an update writes what has changed, never the texts that stay. A writer puts the next manifest by a
rename that fails where the file is there already: of two writers one is refused, and a run that fails
leaves layers that no manifest names. A reader takes the latest manifest once and reads only what it names; it can't
meet a half-written state, nor tables of two generations.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Layers of a table beyond which it is written anew as one.
MOST_LAYERS = 8


def scratch(spark: SparkSession, what: str) -> str:
    """A new address under spark.checkpoint.dir; a temporary folder only where that isn't set and the master is local."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def plain_unions(spark: SparkSession) -> Iterator[None]:
    """Within it Spark takes no union for partitioned as its parts are.

    Spark 4.1 plans a join without an exchange above a union whose parts are partitioned alike, and when it plans again at
    run time the union may have the partitions of all parts instead: the join can't zip them, and the job fails.
    """
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass
class Generation:
    """Tables by name; each a list of layers {rows: folder, schema: DDL, withdrawn: {column: folder}}, the oldest first."""

    spark: SparkSession
    path: str
    number: int = 0
    tables: dict[str, list[dict]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The rows that no later layer withdraws."""
        layers, read = self.tables[name], self.spark.read
        out = None
        for i, layer in enumerate(layers):
            rows = self.spark.read.schema(layer["schema"]).parquet(f"{self.path}/{layer['rows']}")
            for column in sorted({c for later in layers[i + 1 :] for c in later["withdrawn"]}):
                folders = [f"{self.path}/{later['withdrawn'][column]}" for later in layers[i + 1 :] if column in later["withdrawn"]]
                gone = read.schema("key string").parquet(*folders).distinct()
                rows = rows.join(gone.withColumnRenamed("key", column), column, "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return out


class Generations:
    """The generations in a folder, which need not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._fs.Path(self.path).getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """Of all manifests, rising."""
        folder = self._fs.Path(self.path)
        names = [s.getPath().getName() for s in self._system.listStatus(folder)] if self._system.exists(folder) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, number: int) -> Generation:
        text = self.spark.read.text(self._manifest(number), wholetext=True).first()[0]
        given = json.loads(text)
        return Generation(self.spark, self.path, number, given["tables"], given["counts"])

    def current(self) -> Generation | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest-{number:010d}.json"

    def write(self, draft: Generation, name: str, rows: DataFrame, withdrawn: dict[str, DataFrame] | None = None) -> DataFrame:
        """Adds a layer to a table of the draft and reads the table; past MOST_LAYERS, or where all before goes, one layer takes the place of all."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        layer = {"rows": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "withdrawn": {}}
        for column, keys in (withdrawn or {}).items():
            layer["withdrawn"][column] = f"{folder}-{column}"
            keys.toDF("key").distinct().write.parquet(f"{self.path}/{layer['withdrawn'][column]}")
        draft.tables[name] = [*draft.tables.get(name, []), layer] if withdrawn is not None else [layer]
        if len(draft.tables[name]) > MOST_LAYERS:
            return self.write(draft, name, draft.table(name))
        return draft.table(name)

    def draft(self) -> Generation:
        """The generation after the current one, with its layers."""
        now = self.current()
        if now is None:
            return Generation(self.spark, self.path, 1)
        return Generation(self.spark, self.path, now.number + 1, {k: list(v) for k, v in now.tables.items()})

    def publish(self, draft: Generation) -> Generation:
        """Puts the draft's manifest; FileExistsError if another writer has published that number."""
        target, beside = self._fs.Path(self._manifest(draft.number)), self._fs.Path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._system.create(beside, False)
        out.write(json.dumps({"tables": draft.tables, "counts": draft.counts}).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(target.toUri(), self._conf).rename(beside, target, options)
        except Exception as e:
            self._system.delete(beside, False)
            if self._system.exists(target):
                raise FileExistsError(f"generation {draft.number} is there already") from e
            raise
        return draft

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all manifests but the last ``keep`` and every layer that none of these names; how many folders went. Not beside a writer."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._system.delete(self._fs.Path(self._manifest(n)), False)
        used = set()
        for n in numbers[-keep:]:
            for layers in self.read(n).tables.values():
                used |= {f for layer in layers for f in (layer["rows"], *layer["withdrawn"].values())}
        folder, gone = self._fs.Path(f"{self.path}/data"), 0
        for status in self._system.listStatus(folder) if self._system.exists(folder) else []:
            if f"data/{status.getPath().getName()}" not in used:
                gone += self._system.delete(status.getPath(), True)
        return gone

