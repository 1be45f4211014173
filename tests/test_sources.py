import json

import pytest

from recordloom.sources import formats, records

RIS = """TY  - JOUR
TI  - A study of things
AU  - Doe, Jane
AU  - Roe, Max and Poe, Ann
AU  - Center for Social Research and Data
PY  - 2019/03
DA  - 2019/03/01
JO  - Journal of Things
SN  - 1234-5678
SP  - 12
EP  - 34
KW  - one
KW  - two
N1  - first note
N1  - recordloom field: Score = "9\\n8"
LA  - en
ER  -
TY  - BOOK
TI  - Unclosed
TY  - BOOK
T1  - Last
SN  - 9781234567897
"""


def test_ris_reads_records():
    first, last = formats.read_ris(RIS)
    assert first["Author"] == "Doe, Jane; Roe, Max and Poe, Ann; Center for Social Research and Data"
    assert (first["Publication Year"], first["Pages"], first["ISSN"], first["Keywords"]) == ("2019", "12-34", "1234-5678", "one; two")
    assert (first["Notes"], first["Score"], first["RIS LA"], first["RIS DA"]) == ("first note", "9\n8", "en", "2019/03/01")
    assert last == {"Item Type": "BOOK", "Title": "Last", "ISBN": "9781234567897"}


def test_authors_keep_organisations():
    assert formats.split_authors("Roe, Max and Poe, Ann; Center for Social Research and Data") == ["Roe, Max", "Poe, Ann", "Center for Social Research and Data"]


def test_bibtex_fields_and_escapes():
    text = '@article{k1,\n title = {A {Big} \\{brace\\} \\\\ end},\n author = "Doe, Jane and Roe, Max",\n year = 2001,\n pages = {1--9},\n keywords = {{{One}, {Two, x}}}\n}\n\n@book{k2, booktitle={B}}'
    first, second = formats.read_bibtex(text)
    assert (first["Title"], first["Author"], first["Publication Year"], first["Pages"]) == ("A {Big} {brace} \\ end", "Doe, Jane; Roe, Max", "2001", "1-9")
    assert second["Publication Title"] == "B" and second["Key"] == "k2"


RECORD = {"Key": "k1", "Item Type": "article-journal", "Title": "A {b} \\ title", "Author": "Doe, Jane; Roe, Max", "Publication Year": "1999", "Publication Title": "J", "Volume": "1", "Pages": "1-9", "DOI": "10.1234/x", "Url": "http://x.org/a", "Keywords": "one; two", "Notes": "n1\nn2", "Score": "a\n{b} \\ \"c\""}


@pytest.mark.parametrize("fmt", ["ris", "bibtex", "csl_json"])
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([{**RECORD, "_row_id": 0}, {**RECORD, "Title": "Other", "_row_id": 1}])
    path = f"{tmp_path}/out"
    records.write_records(df, path, fmt)
    ending = {"ris": "ris", "bibtex": "bib", "csl_json": "json"}[fmt]
    text = "\n\n".join(open(p).read() for p in sorted(map(str, (tmp_path / "out").glob("part-*"))))
    (tmp_path / f"in.{ending}").write_text(text if fmt != "csl_json" else json.dumps([json.loads(x) for x in text.split("\n") if x.strip()]))
    rows = records.read_records(spark, f"{tmp_path}/in.{ending}").orderBy("_row_id").collect()
    assert [r.Title for r in rows] == [RECORD["Title"], "Other"]
    for column in ["Author", "DOI", "Url", "Notes"] + ["Score"] * (fmt != "csl_json"):
        assert rows[0][column] == RECORD[column], column
    if fmt == "bibtex":
        assert [r.Key for r in rows] == ["k1", "k12"]


def test_patch_keeps_other_lines(spark, tmp_path):
    path = tmp_path / "in.ris"
    path.write_text(RIS)
    table = records.read_records(spark, str(path))
    from pyspark.sql import functions as F

    new = table.withColumn("DOI", F.when(F.col("_row_id") == 0, "10.1/new").otherwise("")).withColumn("Keywords", F.when(F.col("_row_id") == 0, "three").otherwise(""))
    blocks = [r.block for r in records.patch_ris(spark, str(path), new, ["Score"]).orderBy("place").collect()]
    lines = blocks[0].split("\n")
    assert "KW  - three" in lines and "KW  - one" not in lines and lines.index("DO  - 10.1/new") < lines.index("ER  -")
    assert "AU  - Doe, Jane" in lines and sum("recordloom field: Score" in x for x in lines) == 1
    with pytest.raises(ValueError):
        records.patch_ris(spark, str(path), table.withColumn("Volume", F.lit("1")).withColumn("Item Type", F.lit("X")))
    with pytest.raises(ValueError):
        records.patch_ris(spark, str(path), table.limit(1))


@pytest.mark.parametrize("sign", [",", ";", "\t"])
def test_csv_sniffing(spark, tmp_path, sign):
    path = tmp_path / "t.csv"
    path.write_bytes(f"Title{sign}Year\n\"A “x”{sign} – y\"{sign}012\nB{sign}\n".encode("cp1252"))
    rows = records.read_records(spark, str(path)).orderBy("_row_id").collect()
    assert [(r.Title, r.Year) for r in rows] == [(f"A “x”{sign} – y", "012"), ("B", "")]


def test_csl_and_unknown_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": 1, "title": "T", "author": [{"family": "Doe", "given": "J"}, {"literal": "WHO"}], "issued": {"date-parts": [[2001, 2]]}, "tags": [{"tag": "x"}, "y"]}]}))
    row = records.read_records(spark, f"{tmp_path}/a.json").first()
    assert (row.Author, row["Publication Year"], row.Keywords) == ("Doe, J; WHO", "2001", "x; y")
    with pytest.raises(ValueError):
        records.read_records(spark, f"{tmp_path}/a.tsv")


def test_carried_columns():
    assert formats.carried_for(["Title", "Matched Title", "Score", "RIS LA", "Key"], "ris") == ["Matched Title", "Score", "Key"]
    assert formats.carried_for(["Title", "Key"], "bibtex") == []
    assert formats.carried_columns('x\nN1  - recordloom field: A b = "1"\nrecordloom field: C = 2') == ["A b", "C"]
    assert formats.export_label("x.BIB") == "BibTeX (.bib)"


def test_csv_files_of_many_dialects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    files = {"a b.csv": "Title;Year\nÄ;1\nB;2\n".encode(), "b.csv": "Title,Year\n".encode() + b"caf\xe9 \x96,3\n", "c.csv": 'Title,Note\n"two\nlines, here",n\n'.encode(), "d.csv": "Title\tYear\nÉ\t5\n".encode("utf-16"), "e.csv": "\ufeffTitle,Year\nE,6\n".encode()}
    for name, data in files.items():
        (tmp_path / "d" / name).write_bytes(data)
    df = records.read_csv(spark, f"{tmp_path}/d/*.csv")
    got = {(r.Title, r.Year, r.Note) for r in df.collect()}
    assert got == {("Ä", "1", ""), ("B", "2", ""), ("café –", "3", ""), ("two\nlines, here", "", "n"), ("É", "5", ""), ("E", "6", "")}
    assert df.select(records.ROW).distinct().count() == 6


def test_rows_count_through_all_files(spark, tmp_path):
    for i, n in enumerate((2, 3, 1)):
        (tmp_path / f"f{i}.ris").write_text("".join(f"TY  - JOUR\nTI  - {i}-{k}\nER  - \n\n" for k in range(n)))
    df = records.read_records(spark, f"{tmp_path}/*.ris")
    assert sorted((r[records.ROW], r.Title) for r in df.collect()) == list(enumerate(["0-0", "0-1", "1-0", "1-1", "1-2", "2-0"]))
