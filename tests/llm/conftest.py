import pytest

#: Nulls in every column, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, "The Same text, twice. You idiot!", "en", "b", 30),
    (2, "the same TEXT, twice. you IDIOT!", "en", "a", 30),
    (2, "the same TEXT, twice. you IDIOT!", "en", "a", 30),
    (None, "the same TEXT, twice. you IDIOT!", None, None, None),
    (3, None, "en", "a", None),
    (4, "", "fr", None, 0),
    (5, " \t\r\n\x0b\x0c ", "de", "c", 6),
    (6, "été É ß İ 中文 \x00\x1f\x7f under the MIT license; Apache License, Version 2", "fr", "c", 10),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "a" * 20_000, "en", "b", 20_000),
    (9, "one two", "en", "b", 7),
    (-10, "one  two", "en", "b", 8),
    (11, "under the mit license cc by nc under the mit license", "en", "d", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
EXTRA = {c: 1 for c in ("id", "size", "key", "fingerprint", "sha", "keep_id", "h", "p", "block", "tokens", "part", "half", "score", "count", "n", "node", "root", "copies", "target", "source_size", "word", "shard", "raw", "first", "kind", "host", "wrapper")}


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """DataFrames that scan files: the rows above, the same with extra columns, and none."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("tables")
    out = {}
    for name, df in {
        "plain": spark.createDataFrame(ROWS, SCHEMA).repartition(3),
        "extra": spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).coalesce(1),
        "empty": spark.createDataFrame([], SCHEMA),
    }.items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out
