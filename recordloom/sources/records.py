"""Reading and writing record tables with Spark: CSV, JSON and CSL JSON, RIS, BibTeX."""

from __future__ import annotations

import collections
import csv
import functools
import itertools
import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.sources import formats, recordfiles, sheets

#: The column that keeps a record's place.
ROW = "_row_id"
#: Most rows of a workbook that is written (the format has 1,048,576).
SHEET_ROWS = 100_000


def read_fields(spark: SparkSession, path: str, prefix: str = formats.CARRIED, lines: bool | str = False, part: int = recordfiles.PART) -> DataFrame:
    """path, start, place, encoding and fields (a map; or lines, of RIS) of each record of RIS, BibTeX or JSON files.

    With "count" for lines a part of RIS files has one row, whose place is the number of its records.

    Files of records that begin with a line of their own are read in parts of so many bytes; a JSON file is read whole.
    """
    ending = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ending not in recordfiles.ENDINGS:
        raise ValueError(f"unsupported file format: {ending}")
    recordfiles.register(spark)
    return spark.read.format("recordloom").options(format=recordfiles.ENDINGS[ending], prefix=prefix, lines=lines, partBytes=part).load(path)


def numbered(records: DataFrame) -> DataFrame:
    """ROW for path, start and place: it counts through all files in the order of their names.

    The parts' first numbers are sent along; there is one for each part of a file, whatever its records.
    """
    return _numbered(records, records.groupBy("path", "start").agg(F.count(F.lit(1))).collect())


def _numbered(records: DataFrame, sizes: list) -> DataFrame:
    """numbered() with the parts' numbers of records."""
    sizes = sorted(map(tuple, sizes))
    firsts = list(zip((x[:2] for x in sizes), itertools.accumulate((n for *_, n in sizes), initial=0), strict=False))
    if len(firsts) < 2:
        return records.withColumn(ROW, F.col("place"))
    table = records.sparkSession.createDataFrame([(*key, first) for key, first in firsts], "path string, start long, __first long")
    return records.join(table, ["path", "start"]).withColumn(ROW, F.col("place") + F.col("__first")).drop("__first")


def spread(fields: DataFrame) -> DataFrame:
    """ROW and a column for each key of `fields`, in the order of first appearance. Names are few, whatever the rows."""
    # names and numbers by one pass over the files: rows for each part and name
    seen = fields.select("path", "start", "place", F.posexplode_outer(F.map_keys("fields")).alias("at", "key"))
    found = seen.groupBy("path", "start", "key").agg(F.min(F.struct("place", "at")).alias("first"), F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("n")).collect()
    sizes, first = collections.Counter(), {}
    for r in found:
        sizes[r.path, r.start] += r.n
        if r.key is not None:
            place = (r.path, r.start, *r["first"])
            first[r.key] = min(first.get(r.key, place), place)
    table = _numbered(fields, [(*part, n) for part, n in sizes.items()])
    return table.select(ROW, *(F.col("fields").getItem(key).alias(key) for key in sorted(first, key=first.get)))


#: Bytes of a file from whose lines its separator is told.
SNIFFED = 1 << 16


def _told(batches: Iterator) -> Iterator:
    """Of each part of a file: whether its lines are UTF-8, whether one has an odd number of quotes, and its start."""
    import pyarrow as pa

    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        for path, start, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = seen.setdefault((path, start), [True, False, b""])
            if not line.isascii() and found[0]:
                try:
                    line.decode()
                except UnicodeDecodeError:
                    found[0] = False
            found[1] |= bool(line.count(b'"') % 2)
            if not start and len(found[2]) < SNIFFED:
                found[2] += line[:SNIFFED] + b"\n"
    columns = [[p for p, _ in seen], [s for _, s in seen], *([x[i] for x in seen.values()] for i in range(3))]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "start", "utf8", "odd", "head"])


def _dialect(utf8: bool, odd: bool, head: bytes) -> tuple[str, str, bool]:
    """Encoding, separator and whether cells have line ends."""
    marked = head[:2] in (b"\xff\xfe", b"\xfe\xff")
    encoding = "utf-16" if marked else "utf-8-sig" if utf8 else formats.decode(head)[1]
    try:
        sign = csv.Sniffer().sniff(head.removesuffix(b"\n").decode(encoding, "replace"), delimiters=",;\t|").delimiter
    except csv.Error:
        sign = ","
    return ("cp1252" if encoding == "utf-8-sig" and not utf8 else encoding), sign, odd or marked


def _read_csv(spark: SparkSession, paths: list[str], dialect: tuple[str, str, bool], as_text: bool) -> DataFrame:
    encoding, sign, many_lines = dialect
    name = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}[encoding]
    df = spark.read.options(header=True, sep=sign, encoding=name, multiLine=many_lines, escape='"', inferSchema=not as_text).csv(paths)
    if encoding == "cp1252":  # Spark reads its sister; these characters differ
        high = {chr(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}
        changed = [F.translate(f"`{c}`", "".join(high), "".join(high.values())).alias(c.translate(str.maketrans(high))) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
        df = df.select(*changed)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def read_csv(spark: SparkSession, path: str, as_text: bool = True) -> DataFrame:
    """CSV files, each with the separator that its start and the encoding that all its bytes tell.

    Lines are looked at where they lie, so files of any size are split; only those with line ends in cells are read
    whole by a task. Columns that a file lacks are empty in its rows.
    """
    if not path.rstrip("/*").lower().endswith(".csv"):
        raise ValueError(f"unsupported file format: {path}")
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    parts = lines.mapInArrow(_told, "path string, start long, utf8 boolean, odd boolean, head binary")
    files = parts.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("odd"), F.min_by("head", "start").alias("head")).collect()
    dialects: dict[tuple[str, str, bool], list[str]] = {}
    for file in sorted(files, key=lambda r: r.path):
        dialects.setdefault(_dialect(file.utf8, file.odd, bytes(file.head)), []).append(unquote(file.path))
    if not dialects:
        dialects[("utf-8-sig", ",", False)] = [path]
    tables = [_read_csv(spark, paths, dialect, as_text) for dialect, paths in dialects.items()]
    df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return (df.na.fill("") if as_text else df).withColumn(ROW, F.monotonically_increasing_id())


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = [(path, 0, i, "", r) for i, r in enumerate(sheets.read_table(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "start", "place", "encoding", "fields"])


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of .xlsx workbooks; a task reads whole files, which the format bounds."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return spread(files.mapInPandas(_sheet_rows, recordfiles.FIELDS)).na.fill("")


def write_excel(df: DataFrame, path: str) -> None:
    """A folder of .xlsx workbooks, one for each range of SHEET_ROWS rows in the records' order; it must not exist yet."""
    names = [c for c in df.columns if c != ROW]
    place = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    cells = F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names))
    rows = df.select(place.alias("place"), cells.alias("cells"))

    def workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []
        for batch in batches:
            for place_, row in zip(batch["place"], batch["cells"], strict=True):
                waiting.append((place_, list(row)))
                if len(waiting) == SHEET_ROWS:
                    yield pd.DataFrame([(waiting[0][0], sheets.write_table(names, (r for _, r in waiting)))], columns=["place", "book"])
                    waiting = []
        if waiting:
            yield pd.DataFrame([(waiting[0][0], sheets.write_table(names, (r for _, r in waiting)))], columns=["place", "book"])

    spark = df.sparkSession
    books = rows.repartitionByRange("place").sortWithinPartitions("place").mapInPandas(workbooks, "place long, book binary")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.exists(target):
        raise ValueError(f"{path} exists already")
    for number, row in enumerate(books.orderBy("place").toLocalIterator()):  # a workbook at a time
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-{number:05d}.xlsx"))
        out.write(row.book)
        out.close()


def read_records(spark: SparkSession, path: str, as_text: bool = True, prefix: str = formats.CARRIED) -> DataFrame:
    """A record table by its file's ending; cells are text, ROW keeps the order."""
    if path.rstrip("/*").lower().endswith(".xlsx"):
        return read_excel(spark, path)
    if path.rstrip("/*").lower().endswith(".csv"):
        return read_csv(spark, path, as_text)
    return spread(read_fields(spark, path, prefix))


def _blocks(fmt: str, carried: list[str], prefix: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                place, suffix = int(row.pop("__place")), row.pop("__suffix")
                if fmt == "ris":
                    text = formats.write_ris(row, carried, prefix)
                elif fmt == "bibtex":
                    text = formats.write_bibtex(row, formats.bibtex_key(row, place) + ("" if suffix == 1 else str(suffix)), carried, prefix)
                else:
                    text = json.dumps(formats.to_csl(row, place), ensure_ascii=False)
                out.append((place, text))
            yield pd.DataFrame(out, columns=["place", "block"])

    return run


def blocks(df: DataFrame, fmt: str, carried: list[str] | None = None, prefix: str = formats.CARRIED, ordered: bool = False) -> DataFrame:
    """place and block, a record's text in the format (ris, bibtex, csl_json), in the order of place if it is asked for; repeated BibTeX keys get numbers."""
    if fmt not in ("ris", "bibtex", "csl_json"):
        raise ValueError(f"unsupported format: {fmt}")
    names = [c for c in df.columns if c != ROW]
    carried = formats.carried_for(names, fmt) if carried is None else carried
    text = df.select(F.col(ROW).alias("__place") if ROW in df.columns else F.monotonically_increasing_id().alias("__place"), *(F.col(f"`{c}`").cast("string") for c in names))
    suffix = F.lit(1)
    if fmt == "bibtex" and "Key" in names:
        bare = F.regexp_replace(F.coalesce("Key", F.lit("")), "[^A-Za-z0-9:_-]", "")
        suffix = F.when(bare == "", 1).otherwise(F.row_number().over(Window.partitionBy(bare).orderBy("__place")))
    rows = text.withColumn("__suffix", suffix.cast("int"))
    if ordered:  # before the texts are made: finding the ranges reads all rows once more
        rows = rows.repartitionByRange("__place").sortWithinPartitions("__place")
    return rows.mapInPandas(_blocks(fmt, list(carried), prefix), "place long, block string")


def write_records(df: DataFrame, path: str, fmt: str, carried: list[str] | None = None, prefix: str = formats.CARRIED) -> None:
    """Write a folder of part files in the records' order; it must not exist yet. CSV and Excel have a header in each file."""
    if fmt == "excel":
        return write_excel(df, path)
    if fmt == "csv":
        out = df.withColumn("Url", F.col("Link")) if "Link" in df.columns else df
        order = [ROW] if ROW in df.columns else []
        (out.repartitionByRange(*order).sortWithinPartitions(*order) if order else out).drop(ROW).write.options(header=True, escape='"').csv(path)
        return
    write_blocks(blocks(df, fmt, carried, prefix, ordered=True), path, fmt, ordered=True)


def write_blocks(texts: DataFrame, path: str, fmt: str, ordered: bool = False) -> None:
    """Write place and block as a folder of files in the order of place (in which they may be already), which appear together at the end; it must not exist yet."""
    spark = texts.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise ValueError(f"{path} exists already")
    recordfiles.register(spark)
    block = F.col("block") if fmt != "csl_json" else F.concat("block", F.lit("\n"))
    rows = texts if ordered else texts.repartitionByRange("place").sortWithinPartitions("place")
    rows.select(block.alias("block")).write.format("recordloom").option("format", fmt).mode("append").save(path)


def patch_ris(spark: SparkSession, source: str, new: DataFrame, carried: list[str] = (), prefix: str = formats.CARRIED, part: int = recordfiles.PART) -> DataFrame:
    """path, place (ROW) and block of each record of RIS files with only the lines of changed columns rewritten.

    `new` is the files' table (ROW) with changed cells. A changed number of rows, a ROW that is repeated or isn't the
    files', or a change in a column that can't be patched, is an error.
    """
    lines, sizes = (read_fields(spark, source, prefix, lines=x, part=part) for x in (True, "count"))
    raw = _numbered(lines, sizes.select("path", "start", "place").where("place > 0").collect()).select("path", F.col(ROW).alias("place"), F.array_join("lines", "\n").alias("lines"))
    names = [c for c in new.columns if c != ROW]
    cells = F.array(*(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in names))
    both = raw.join(new.select(F.col(ROW).alias("place"), cells.alias("new")), "place", "full").select("path", "place", "lines", "new")

    def patch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for path, place, text, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if text is None or values is None:  # no such record, or none that is left
                    out.append((path, place, None, True, False))
                    continue
                cells_ = dict(zip(names, values, strict=True))
                old = {k: v.strip(" ") for k, v in next(iter(formats.read_ris(text, prefix))).items()}
                moved = any(cells_[c] != old.get(c, "") for c in cells_ if c not in formats.PATCHED and c not in carried)
                out.append((path, place, "\n".join(formats.patch_ris_block(text.split("\n"), old, cells_, carried, prefix)).rstrip("\n") + "\n\n", False, moved))
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)], names=["path", "place", "block", "alone", "moved"])

    patched = both.mapInArrow(patch, "path string, place long, block string, alone boolean, moved boolean")
    if base := spark.conf.get("spark.checkpoint.dir", None):  # made once, and kept from a lost executor
        folder = f"{base.rstrip('/')}/patched-{uuid.uuid4().hex}"
        patched.write.parquet(folder)
        patched = spark.read.schema(patched.schema).parquet(folder)
    # what a patch can't express
    found = patched.agg(F.count(F.when(F.col("alone"), 1)).alias("n_alone"), F.count(F.when(F.col("moved"), 1)).alias("n_moved"), F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("places")).first()
    if found.n_alone or found.places != found.n:
        raise ValueError("the number of records has changed")
    if found.n_moved:
        raise ValueError("a column has changed that a patch can't express")
    return patched.select("path", "place", "block")


def write_patched(patched: DataFrame, path: str) -> None:
    """Write what patch_ris() gives as a folder of RIS files in the records' order."""
    write_blocks(patched.select("place", "block"), path, "ris")
