"""What the operators of this subpackage share: tables, the shared folder, materialised steps."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where the session has no such setting (tests, a local master) is a temporary folder used.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{_local_base()}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_base: list[str] = []


def _local_base() -> str:
    if not _base:
        _base.append(tempfile.mkdtemp(prefix="corpusloom-"))
    return _base[0]


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder as Parquet and reads them again."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        of, path = _written.pop(id(df), (lambda: None, ""))
        if of() is df:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def filesystem(uri: str):
    """pyarrow's filesystem and path of a folder's address, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def make_folder(uri: str) -> None:
    filesystem_, path = filesystem(uri)
    filesystem_.create_dir(path, recursive=True)


#: Rows of a part that ``numbered`` sorts, about.
PART_ROWS = 4_000_000


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, few: bool = False) -> DataFrame:
    """The rows with their place (from 0) among the rows of equal ``by``, in ``order``, nulls first; rows equal in all that in any order.

    The rows are dealt by ranges of (by, order, row), so a group of any size is spread over as many parts as it
    needs: a row's place is that in its part plus the rows of its group in earlier parts. ``few`` says that the
    groups are few by construction; their (group, part) rows, at most groups + parts, are then broadcast.
    """
    row, at, part, first, n = (f"corpusloom_{x}" for x in ("row", "at", "part", "first", "n"))
    spark, keys = df.sparkSession, [*by, *order, row]
    given = materialise(df.withColumn(row, F.monotonically_increasing_id()), "given")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // PART_ROWS))
    rows = materialise(given.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(row).withColumn(at, F.monotonically_increasing_id()), "numbered")
    discard(given)
    rows = rows.withColumn(part, F.shiftright(at, 33))
    heads = rows.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*(F.col(c).alias(f"corpusloom_by{i}") for i, c in enumerate(by)), F.col(part).alias(f"{part}_"), first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n))
    same = F.col(part) == F.col(f"{part}_")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"corpusloom_by{i}"))
    heads = F.broadcast(heads) if few else heads.hint("merge")
    return rows.join(heads, same).select(*df.columns, (F.col(at) - F.col(first) + F.col(n)).alias(name))
