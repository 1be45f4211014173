"""What runs leave and need: settings, snapshots, journals, exports, previews, samples, progress and cancelling."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.filters import project
from recordloom.sources import records as files

#: The setting that names the folder of an application's state.
DATA_DIR = "spark.recordloom.data.dir"


def data_file(spark: SparkSession, name: str) -> str:
    """A file's place in the state folder; without the setting it is in the user's own."""
    base = spark.conf.get(DATA_DIR, None) or os.path.join(os.path.expanduser("~"), ".recordloom")
    return f"{base.rstrip('/')}/{name}"


def load_settings(path: str) -> dict:
    """A JSON object's file; empty if there is none or it can't be read as one."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save_settings(path: str, changes: dict) -> dict:
    """Change some of the settings and keep the others; a reader sees the old file or the new one."""
    merged = load_settings(path) | changes
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as file:
        json.dump(merged, file, ensure_ascii=False, indent=2)
    os.replace(temporary, path)
    return merged


def read_journal(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Entries of a file of JSON lines; lines that a broken write left are passed over."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = spark.read.text(path).select(F.from_json("value", T.StructType([*wanted.fields, T.StructField("__bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("e"))
    return parsed.where("e IS NOT NULL AND e.__bad IS NULL").select(*(F.col("e")[f.name].alias(f.name) for f in wanted.fields))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace a Parquet folder as a whole: the new one is written beside it and takes its name when it is complete.

    `df` may read the folder that it replaces. After a failure the old folder is there, or else its copy `<path>.old`.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, new, old = hadoop(path), hadoop(f"{path}.new-{uuid.uuid4().hex}"), hadoop(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.parquet(new.toString())
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(new, target):
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


def convert(df: DataFrame, path: str, fmt: str, columns: list[str], conditions=(), mode: str = "AND") -> tuple[int, list[str]]:
    """Filter, project and write in one format; the number of rows, and the columns that the format itself has."""
    from recordloom.sources import formats

    if fmt not in ("csv", "excel", "ris", "bibtex", "csl_json"):
        raise ValueError(f"unsupported format: {fmt}")
    chosen = project(df, columns, conditions, mode)
    carried = formats.carried_for(columns, fmt) if fmt in ("ris", "bibtex") else []
    if files.ROW in df.columns and files.ROW not in columns:
        chosen = project(df, [*columns, files.ROW], conditions, mode)
    files.write_records(chosen, path, fmt, carried)
    return chosen.count(), [c for c in columns if c not in carried]


def export(df: DataFrame, source: str, path: str, carried: list[str] = ()) -> str:
    """Write a changed table in its source's format: a RIS file is patched if a patch can express the changes, else rewritten; which of both."""
    if source.lower().endswith(".ris"):
        try:
            patched = files.patch_ris(df.sparkSession, source, df, carried)
            files.write_patched(patched, path)
            return "patched"
        except ValueError:
            pass
    endings = {".xlsx": "excel", ".ris": "ris", ".bib": "bibtex", ".bibtex": "bibtex", ".json": "csl_json"}
    files.write_records(df, path, endings.get(os.path.splitext(source)[1].lower(), "csv"), list(carried))
    return "rewritten"


def preview(df: DataFrame, most: int = 250) -> DataFrame:
    """The first rows for a look; exports are complete."""
    return df.limit(most)


def sampled(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A share of the rows, the same ones for a key and a seed wherever they lie."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))


def select_fields(df: DataFrame, fields: list[str], chosen: list[str] | None = None, always: tuple[str, ...] = ("title",), default: tuple[str, ...] = ("title", "author", "publisher", "item_type")) -> DataFrame:
    """Blank the cells of fields that a verification doesn't use."""
    used = {*(default if chosen is None else chosen), *always}
    return df.withColumns({f: F.lit("") for f in fields if f not in used and f in df.columns})


def duration(seconds: float) -> str:
    whole = max(0, round(seconds))
    return f"{whole // 3600}:{whole // 60 % 60:02d}:{whole % 60:02d}"


@dataclass
class Progress:
    """Finished work of a known amount, its rate and the time that is left."""

    total: int
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    tell: Callable[[str], None] = field(default=lambda text: None)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def add(self, n: int = 1) -> str:
        self.done += n
        spent = self.clock() - self.began
        left = spent / self.done * (self.total - self.done) if self.done else 0.0
        text = f"{self.done} of {self.total}, {self.done / spent:.1f} a second, {duration(left)} left" if spent else f"{self.done} of {self.total}"
        self.tell(text)
        return text


def listen(spark: SparkSession, progress: Progress):
    """Have a progress count the rows of streaming queries' batches; the listener, for removeListener()."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Rows(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:  # noqa: N802
            pass

        def onQueryProgress(self, event) -> None:  # noqa: N802
            progress.add(event.progress.numInputRows)

        def onQueryTerminated(self, event) -> None:  # noqa: N802
            pass

    listener = Rows()
    spark.streams.addListener(listener)
    return listener


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside have the tag, by which spark.interruptTag() ends them; what earlier stages wrote stays."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancelled(work: DataFrame, finished: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Finished rows as they are, and the rest of the work with the status `cancelled`."""
    rest = work.join(finished.select(key).distinct(), key, "left_anti").withColumn(status, F.lit("cancelled"))
    return finished.unionByName(rest, allowMissingColumns=True)
