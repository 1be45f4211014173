import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordloom.operators import search


def brute(records, entries, k):
    entries = [(i, set(filter(None, w or []))) for i, w in entries]
    entries = [(i, w) for i, w in entries if w]
    df = Counter(x for _, w in entries for x in w)
    weight = {x: math.floor(1000 * math.log((1 + len(entries)) / n)) for x, n in df.items()}
    out = []
    for key, words in records:
        found = sorted((-s, i) for i, w in entries if (s := sum(weight[x] for x in set(words or []) & w)) > 0)[:k]
        out += [(key, p, i, -s) for p, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_search_equals_comparing_all_pairs(spark, k):
    rng = random.Random(k)
    common, rare = ["the", "of", "a", "in"], [f"w{i}" for i in range(60)]
    title = lambda: [*rng.choices(common, k=rng.randrange(0, 4)), *rng.choices(rare, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 4))]
    entries = [(i, title()) for i in range(400)] + [(i, ["the", "same"]) for i in range(400, 460)] + [(500, None), (501, []), (502, ["", "the", None])]
    records = [(i, title() + ["unknown"] * (i % 3)) for i in range(80)] + [(100, None), (101, ["unknown"]), (102, ["same", "the"]), (103, common)]
    index = search.catalogue(spark.createDataFrame(entries, "e int, words array<string>").repartition(5), "e", F.col("words"), k)
    found = search.nearest(spark.createDataFrame(records, "r int, words array<string>"), "r", F.col("words"), index)
    assert "Cartesian" not in found._jdf.queryExecution().toString()
    assert sorted((r.r, r.place, r.entry, r.shared) for r in found.collect()) == brute(records, entries, k)


def test_light_words_meet_no_postings(spark):
    entries = [(i, ["the", f"r{i // 10}"]) for i in range(1000)]
    index = search.catalogue(spark.createDataFrame(entries, "e int, words array<string>"), "e", F.col("words"), 5)
    records = spark.createDataFrame([(1, ["the", "r7"])], "r int, words array<string>")
    found = search.nearest(records, "r", F.col("words"), index)
    assert sorted(r.entry for r in found.collect()) == [70, 71, 72, 73, 74]


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "LISTED", 7)
    monkeypatch.setattr(search, "MET", 500)
    entries = [(i, ["the", f"a{i % 3}", f"b{i % 50}"]) for i in range(600)]
    records = [(i, ["the", f"a{i % 3}", "other"]) for i in range(10)] + [(11, ["the"]), (12, ["b7", "a1", "b8"])]
    index = search.catalogue(spark.createDataFrame(entries, "e int, words array<string>"), "e", F.col("words"), 3)
    found = search.nearest(spark.createDataFrame(records, "r int, words array<string>"), "r", F.col("words"), index)
    dealt = [line for line in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines() if "REPARTITION_BY_NUM" in line]
    assert any("key" in line and "class" in line for line in dealt), "pairs of a frequent word and a record's pairs go to several tasks"
    assert sorted((r.r, r.place, r.entry, r.shared) for r in found.collect()) == brute(records, entries, 3)


def test_found_entries_are_scored(spark):
    schema = "i int, title string, names array<string>, year string"
    entries = spark.createDataFrame([(1, "A study of things", ["Doe"], "2001"), (2, "Things of a study", ["Roe"], "1950"), (3, "Other words", ["Doe"], "2001")], schema)
    words = F.split(F.lower("title"), " ")
    rows = search.run_search(spark.createDataFrame([(7, "A study of things", ["Doe"], "2001"), (8, "nothing shared", [], None), (None, "Other", None, None)], schema), "i", words, search.catalogue(entries, "i", words), entries, "i").collect()
    assert [(r.i, r.entry, r.rank, r.total) for r in sorted(rows, key=lambda r: (r.i, r.rank))] == [(7, 1, 1, 100.0), (7, 2, 2, 75.0)]
    assert search.nearest(entries.limit(0), "i", words, search.catalogue(entries, "i", words)).count() == 0
    assert search.nearest(entries, "i", words, search.catalogue(entries.limit(0), "i", words)).count() == 0
