import io
import json
import random

import pytest
from pyspark.sql import functions as F

from recordloom.sources import formats, recordfiles, records
from tests.test_sources import RIS

BIB = '% head @article{h1, title={In a comment}}\n@article{k1,\n title = {A {Big} one},\n abstract = {mail@x.org\n\n  and more},\n year = 2001\n}\n\n  @book{k2, booktitle={B}}\n@misc{k3, title={é},}\n'
JSONL = '{"id": 1, "title": "é", "issued": {"date-parts": [[2001]]}}\n\n{"id": 2, "title": "b", "author": []}\n'


def cut(fmt, data, size):
    """The records of a file that is read in parts of `size` bytes."""
    out = []
    for at in range(0, len(data), size):
        for text, last in recordfiles.segments(io.BytesIO(data), recordfiles.BEGINS.get(fmt), at, min(len(data), at + size)):
            out += recordfiles.parsed(fmt, formats.decode(text)[0], last, formats.CARRIED)
    return out


@pytest.mark.parametrize("fmt, text", [("ris", RIS), ("ris", RIS.replace("\n", "\r\n")), ("ris", "﻿TY  - JOUR\nTI  - a\nER  - \n" + RIS), ("ris", "no records"), ("bibtex", BIB), ("jsonl", JSONL), ("ris", "TY  - A\nTY  - B\n ty - C\nER -\n\n\nTY  - D")])
@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_a_file_cut_at_every_byte_reads_the_same(monkeypatch, fmt, text, chunk):
    monkeypatch.setattr(recordfiles, "CHUNK", chunk)
    data = text.encode()
    want = cut(fmt, data, len(data))
    for size in [*range(1, 60), len(data) // 2, len(data) - 1]:
        assert cut(fmt, data, max(1, size)) == want
    if fmt == "ris":
        assert want == list(formats.read_ris(text.removeprefix("﻿")))


def test_bibtex_and_lines_of_json():
    assert [r["Key"] for r in cut("bibtex", BIB.encode(), 7)] == ["h1", "k1", "k2", "k3"]
    assert [r["Title"] for r in cut("jsonl", JSONL.encode(), 5)] == ["é", "b"]
    for encoding in ("utf-16", "cp1252"):
        assert cut("ris", RIS.replace("things", "Übung").encode(encoding), 10)[0]["Title"] == "A study of Übung"


def write_folder(tmp_path, n=3):
    for i in range(n):
        (tmp_path / f"f{i}.ris").write_text("".join(f"TY  - JOUR\nTI  - {i}-{k}\nXX  - kept {i} {k}\nKW  - a\nER  - \n\n" for k in range(4)))
    (tmp_path / "_hidden.ris").write_text("TY  - JOUR\nTI  - hidden\nER  - \n")


@pytest.mark.parametrize("part", [17, 64, recordfiles.PART])
def test_a_folder_is_read_and_patched_in_parts(spark, tmp_path, part):
    write_folder(tmp_path)
    table = records.spread(records.read_fields(spark, f"{tmp_path}/*.ris", part=part))
    assert sorted((r._row_id, r.Title) for r in table.collect()) == [(4 * i + k, f"{i}-{k}") for i in range(3) for k in range(4)]
    new = table.withColumn("Title", F.concat(F.lit("new "), "Title"))
    patched = records.patch_ris(spark, f"{tmp_path}/*.ris", new, part=part)
    rows = sorted((r.place, r.path.rsplit("/", 1)[1], r.block) for r in patched.collect())
    assert [r[0] for r in rows] == list(range(12)) and [r[1] for r in rows] == [f"f{i}.ris" for i in range(3) for _ in range(4)]
    assert all(f"TI  - new {i // 4}-{i % 4}\nXX  - kept {i // 4} {i % 4}\nKW  - a\n" in r[2] for i, r in enumerate(rows))
    for broken in (new.where("_row_id <> 5"), new.union(new.limit(1)), new.withColumn("_row_id", F.col("_row_id") + 1), new.withColumn("_row_id", F.greatest("_row_id", F.lit(1)))):
        with pytest.raises(ValueError, match="number of records"):
            records.patch_ris(spark, f"{tmp_path}/*.ris", broken, part=part)
    records.write_patched(patched, f"{tmp_path}/out")
    again = records.read_records(spark, f"{tmp_path}/out/*.ris")
    assert sorted((r._row_id, r.Title) for r in again.collect()) == [(4 * i + k, f"new {i}-{k}") for i in range(3) for k in range(4)]


def test_written_files_appear_together_or_not_at_all(spark, tmp_path):
    df = spark.range(0, 100, numPartitions=5).select(F.col("id").alias("_row_id"), F.concat(F.lit("T"), "id").alias("Title"))
    records.write_records(df, f"{tmp_path}/out", "bibtex")
    manifest = json.loads(next((tmp_path / "out").glob("_manifest*")).read_text())
    names = sorted(p.name for p in (tmp_path / "out").glob("part-*"))
    assert sorted(f["name"] for f in manifest["files"]) == names and sum(f["records"] for f in manifest["files"]) == 100
    assert [r.Title for r in records.read_records(spark, f"{tmp_path}/out/*.bib").orderBy("_row_id").collect()] == [f"T{i}" for i in range(100)]
    assert not list((tmp_path / "out").glob("_temporary*"))
    with pytest.raises(ValueError, match="exists already"):
        records.write_records(df, f"{tmp_path}/out", "bibtex")
    recordfiles.register(spark)
    broken = df.select(F.when(F.col("_row_id") == 99, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("block"))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("recordloom").option("format", "ris").mode("append").save(f"{tmp_path}/broken")
    assert not (tmp_path / "broken").exists() or not list((tmp_path / "broken").iterdir())
    df.select(F.lit("TY  - A\nER  - \n").alias("block")).coalesce(1).write.format("recordloom").option("format", "ris").mode("overwrite").save(f"{tmp_path}/out")
    assert [p.suffix for p in (tmp_path / "out").glob("part-*")] == [".ris"] and records.read_records(spark, f"{tmp_path}/out/*.ris").count() == 100


@pytest.mark.parametrize("fmt, ending", [("ris", "ris"), ("bibtex", "bib"), ("csl_json", "jsonl")])
def test_round_trips_of_random_records(spark, tmp_path, fmt, ending):
    rng = random.Random(fmt)
    text = lambda: "".join(rng.choices("abc é;{}\\@\"-,= 中", k=rng.randrange(1, 20))).strip(" ;") or "x"
    rows = [(i, f"t {text()} t", f"n{text()}n", "" if fmt == "csl_json" else f"o{text()}o") for i in range(200)]
    records.write_records(spark.createDataFrame(rows, "_row_id long, Title string, Notes string, Own string").repartition(3), f"{tmp_path}/o", fmt)
    found = records.spread(records.read_fields(spark, f"{tmp_path}/o/*.{ending}", part=300)).na.fill("")
    got = sorted((r._row_id, " ".join(r.Title.split()), r.Notes, r.Own if fmt != "csl_json" else "") for r in found.collect())
    assert got == [(i, " ".join(t.split()), n, o) for i, t, n, o in rows]


def test_odd_paths(spark, tmp_path):
    (tmp_path / "e.ris").write_text("")
    assert records.read_fields(spark, f"{tmp_path}/e.ris").count() == 0
    for call in (lambda: records.read_fields(spark, f"{tmp_path}/x.txt"), lambda: spark.read.format("recordloom").load(f"{tmp_path}/e.txt").count()):
        with pytest.raises(Exception, match="unsupported"):
            call()
    with pytest.raises(Exception, match="none.ris"):
        records.read_fields(spark, f"{tmp_path}/none.ris").count()


def test_records_are_counted_without_lines_and_ordered_before_they_are_written(spark, tmp_path):
    (tmp_path / "a.ris").write_text("".join(f"TY  - JOUR\nTI  - T{i}\nER  - \n\n" for i in range(40)))
    found = records.read_fields(spark, f"{tmp_path}/*.ris", lines="count", part=200).collect()
    assert len(found) > 3 and sum(r.place for r in found) == 40 and not any(r.lines for r in found)
    made = records.blocks(records.spread(records.read_fields(spark, f"{tmp_path}/*.ris", part=200)), "ris", ordered=True)
    plan = made._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.index("MapInPandas") < plan.index("rangepartitioning"), "texts are made once, after the ranges are known"
    assert [r.block.split("\n")[1] for r in made.collect()] == [f"TI  - T{i}" for i in range(40)]
