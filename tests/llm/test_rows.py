"""Row keys: the same for every split of a scan, also in the operators that read their rows twice."""

import random
from collections import Counter

import pytest
from recordloom.llm import bpe, common, exact_dedup, mixing, near_copies, simhash

OPERATORS = {
    "exact": lambda docs: exact_dedup.drop_exact_duplicates(docs),
    "simhash": lambda docs: simhash.drop_near_duplicates(docs),
    "near": lambda docs: near_copies.drop_near_copies(docs),
    "mix": lambda docs: mixing.apply_mix(docs),
    "bpe": lambda docs: bpe.decode(bpe.encode(docs, chars=2000)).withColumnRenamed("id", "doc_id"),
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))), f"s{i % 4}") for i in range(600)]
    rows += [(1000 + i, rng.choice(rows)[1], "s0") for i in range(300)]
    folder = f"{tmp_path_factory.mktemp('rows')}/a b%20é"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8).write.parquet(folder)
    return folder


def split(spark, small):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if small else "128m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k" if small else "4m")
    spark.conf.set("spark.sql.files.minPartitionNum", "7" if small else "2")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_another_split_between_passes_changes_nothing(spark, docs, monkeypatch, name):
    split(spark, False)
    kept = lambda: Counter((r.doc_id, r.text) for r in OPERATORS[name](spark.read.parquet(docs)).collect())
    want, calls, plain = kept(), [], common.materialize

    def other(df, *args):
        out = plain(df, *args)
        calls.append(1)
        split(spark, len(calls) % 2)
        return out

    for module in (bpe, exact_dedup, mixing, near_copies, simhash):
        monkeypatch.setattr(module, "materialize", other)
    try:
        assert kept() == want and calls
    finally:
        split(spark, False)


def test_keys_of_files_and_other_plans(spark, docs):
    scan = spark.read.parquet(docs)
    split(spark, False)
    first = {(r.doc_id, r[common.ROW]) for r in common.with_row(scan).collect()}
    split(spark, True)
    assert {(r.doc_id, r[common.ROW]) for r in common.with_row(scan.where("doc_id >= 0").select("text", "doc_id")).collect()} == first
    split(spark, False)
    assert len({k for _, k in first}) == 900
    for other in (scan.union(scan), scan.selectExpr("explode(array(1, 2)) AS x"), scan.join(scan.select("doc_id"), "doc_id"), spark.range(5).toDF("doc_id")):
        keyed = common.with_row(other)
        rows = [r[common.ROW] for r in keyed.collect()]
        assert len(set(rows)) == len(rows) == other.count() and rows == [r[common.ROW] for r in keyed.collect()]
    assert common.with_row(keyed) is keyed


def test_file_numbers_differ():
    names = [f"file:/a/part-{i}" for i in range(3000)]
    seed, bits = common.file_numbers(names)
    import xxhash

    assert bits < 30 and len({xxhash.xxh64_intdigest(f"{seed} {n}", seed=42) & (1 << bits) - 1 for n in names}) == 3000
    assert common.file_numbers([])[1] == common.file_numbers(["x", "x"])[1] == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.work_dir(Cluster(), "x")


def test_batches_end_at_some_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])

    common.small_batches(spark)
    texts = spark.range(0, 60, 1, 1).select(F.expr("repeat('x', 200000)").alias("text"))
    found = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 60 and max(r.size for r in found) < common.BATCH_BYTES + 500_000
    assert spark.createDataFrame([("x" * 3 * common.BATCH_BYTES,)], "text string").mapInArrow(sizes, "rows long, size long").first().size > 3 * common.BATCH_BYTES  # a row is whole
