"""Helpers that the operators share: working folders, row keys, files in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The name of the column that marks a row while an operator runs.
ROW = "__recordloom_row"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local master (tests on one machine) gets a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    _folders.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


#: The folders that this driver has named, in order.
_folders: list[str] = []


def release(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete the folders named after the first `since` ones, but not those that the kept tables read.

    DataFrames that read the others can't be run again.
    """
    kept = {path.rsplit("/", 1)[0].rsplit("/", 1)[-1] for table in keep for path in table.inputFiles()}
    for uri in _folders[since:]:
        if uri.rsplit("/", 1)[-1] not in kept:
            remove(spark, uri)
            _folders.remove(uri)


def folders() -> int:
    return len(_folders)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: later plans start from files, which survive lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


def counted(df: DataFrame, name: str, *more) -> tuple[DataFrame, tuple]:
    """materialize(), with the number of rows and further aggregates, which the write itself observes: no job of their own."""
    from pyspark.sql import Observation

    seen = Observation()
    wanted = [F.count(F.lit(1)), *more]
    written = materialize(df.observe(seen, *(x.alias(f"x{i}") for i, x in enumerate(wanted))), name)
    found = seen.get
    return written, tuple(found[f"x{i}"] for i in range(len(wanted)))


#: Rows of a narrow table that a task writes.
WRITTEN = 200_000


def few_tasks(df: DataFrame, rows: int, each: int = WRITTEN) -> DataFrame:
    """`df` in no more tasks than so many narrow rows need: small tables aren't written as hundreds of files."""
    return df.coalesce(max(1, -(-rows // each)))


#: Most rows in an Arrow batch, and the bytes at which it ends: documents, pages and packed rows are long, and a task
#: holds several batches at once, in the JVM and in Python.
BATCH, BATCH_BYTES = 500, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most BATCH rows to Python at a time, and no more once they have BATCH_BYTES; a row is whole."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH:
        spark.conf.set(rows, BATCH)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Describe plans briefly, and once: a large literal is in the driver's memory as often as its plan is described, which adaptive execution does after each stage."""
    wanted = {"spark.sql.maxPlanStringLength": "10000", "spark.sql.ui.explainMode": "simple", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Seeds tried for distinct hashes of the file names at a number of bits.
_SEEDS = 32


def _nodes(plan) -> list[str]:
    """The names of a logical plan's nodes."""
    children = plan.children()
    return [plan.nodeName()] + [name for i in range(children.size()) for name in _nodes(children.apply(i))]


def file_numbers(names: list[str]) -> tuple[int, int]:
    """A seed and the bits of XXH64 that tell the names apart, so that a file's number needs no table."""
    import xxhash

    names = list(set(names))
    for bits in range(max(1, 2 * (len(names) - 1).bit_length() - 2), 64):
        for seed in range(_SEEDS):
            if len({xxhash.xxh64_intdigest(f"{seed} {name}", seed=42) & (1 << bits) - 1 for name in names}) == len(names):
                return seed, bits
    raise ValueError("the file names can't be told apart")


def with_row(df: DataFrame) -> DataFrame:
    """Add ROW, a key for each row, if `df` lacks it.

    Rows that a filter or projection takes from Parquet files are known by their file and place in it, which no other
    split of the scan, lost executor or other number of cores changes. Rows of any other plan are numbered once and
    written to the shared folder.
    """
    spark = df.sparkSession
    small_batches(spark)
    if ROW in df.columns:
        return df
    plan = df._jdf.queryExecution().analyzed()
    nodes = _nodes(plan)
    if nodes[-1] != "LogicalRelation" or not set(nodes[:-1]) <= {"Project", "Filter", "SubqueryAlias", "View"} or not plan.toString().rstrip().endswith(" parquet"):
        return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    seed, bits = file_numbers([re.sub(":/+", ":/", name, count=1) for name in df.inputFiles()])
    source = df.metadataColumn("_metadata")
    name = F.concat(F.lit(f"{seed} "), F.regexp_replace(source["file_path"], "^([^:/]*):/+", "$1:/"))
    number, place = F.xxhash64(name).bitwiseAND(F.lit((1 << bits) - 1)), source["row_index"]
    return df.withColumn(ROW, F.when(place < F.lit(1 << 63 - bits), F.shiftleft(number, 63 - bits).bitwiseOR(place)).otherwise(F.raise_error(F.lit("a file has too many rows"))).cast("long"))


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder in any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it. Executors use it for files that no Spark format writes."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column's rows; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["ROW", "counted", "documents", "few_tasks", "filesystem", "folders", "materialize", "release", "plain_plans", "remove", "small_batches", "text_bytes", "with_row", "work_dir"]
