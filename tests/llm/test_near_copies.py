import random
from collections import defaultdict

import corpus_pipeline
import pytest
from recordloom.llm import near_copies
from tests.llm.test_dedup import A, by_components


def grams(text, words=5):
    parts = (text or "").translate(A).split()
    return frozenset(" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def stay(rows):
    sets = {i: grams(t) for i, t in rows}
    near = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = by_components(list(sets), near)
    least = defaultdict(lambda: 1 << 60)
    for i, r in roots.items():
        least[r] = min(least[r], i)
    return sorted(least.values())


def test_the_stage_drops_all_pairs_of_similarity_0_8(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*")
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == stay([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("pairs", [2, 1000])
def test_large_groups_and_common_lines(spark, tmp_path, pairs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    line = [rng.choice(words) for _ in range(20)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \t", "one two", "ONE  two", "one two three"]
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(copy))
        own = [rng.choice(words) for _ in range(rng.choice([2, 4, 8, 40]))]
        texts.append(" ".join(own + line if i % 2 else line + own))
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    found = near_copies.near_copies(docs, pairs=pairs).collect()
    least = defaultdict(list)
    for r in found:
        least[r.root].append(r.id)
    gone = {i for group in least.values() for i in group if i != min(group)}
    assert sorted({i for i, _ in rows} - gone) == stay(rows)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == stay(rows)


def test_pairs_without_sketches_in_their_lists(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    line = [rng.choice(words) for _ in range(30)]
    rows = list(enumerate(" ".join([rng.choice(words) for _ in range(3 * i)] + line) for i in range(16)))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(near_copies, "LISTED", 0)
    kept = near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r.doc_id for r in kept.collect()) == stay(rows)


@pytest.mark.parametrize("before", [4, 500])
def test_a_pair_is_listed_about_once(spark, tmp_path, monkeypatch, before):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(300), 8):
            copy[at] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    listed, rest = [], near_copies._rest
    monkeypatch.setattr(near_copies, "_rest", lambda *args: listed.extend((r.a, r.b) for r in rest(*args).collect()) or rest(*args))
    monkeypatch.setattr(near_copies, "LISTED", 0)
    monkeypatch.setattr(near_copies, "COMMON", 1000)
    monkeypatch.setattr(near_copies, "BEFORE", before, raising=False)
    kept = near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r.doc_id for r in kept.collect()) == stay(rows)
    pairs = {frozenset(x) for x in listed}
    assert len(pairs) >= 100
    assert len(listed) <= 1.5 * len(pairs) if before == 4 else len(listed) == len(pairs)


def test_buckets_that_repeat_the_one_before_go(spark):
    # rows 1 and 2 share 10, 20 and 30 one after the other; 3 comes in at 40, from 15
    places = {1: [10, 20, 30, 40], 2: [10, 20, 30, 40], 3: [15, 40], 4: [15]}
    met = spark.createDataFrame([(node, 100, i, gram) for node, grams in places.items() for i, gram in enumerate(grams)], "node long, n int, pos int, gram long")
    found = near_copies._first_met(met).collect()
    assert sorted((r.gram, r.node) for r in found) == [(10, 1), (10, 2), (15, 3), (15, 4), (40, 1), (40, 2), (40, 3)]
    assert {r.node: r.before for r in found if r.gram == 40} == {1: [30, 20, 10, None], 2: [30, 20, 10, None], 3: [15, None, None, None]}


def written(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_shingles_of_one_row_move_packed(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(204))) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " and more") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/d")
    before = written(spark)
    kept = near_copies.drop_near_copies(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    # 403 prefixes of 41 shingles or so
    assert sum(n for stage, n in written(spark).items() if stage not in before) < 403 * 41


@pytest.mark.parametrize("parts", [1, 7])
def test_packed_shingles_meet_as_they_are(spark, monkeypatch, parts):
    rng = random.Random(11)
    held = [(rng.choice([i, (5 << 40) + i]), rng.sample(range(-40, 60), rng.randrange(12))) for i in range(300)] + [(1 << 62, list(range(1000, 1300)))]
    place = lambda gram: gram * 0x9E3779B97F4A7C15 % (1 << 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(node, len(own) + 70_000 * (node % 2), [signed(place(g)) for g in own]) for node, own in held]
    monkeypatch.setattr(near_copies, "_PACKED", 200)
    table = spark.createDataFrame(rows, f"{near_copies.ROW} long, n int, prefix array<long>").repartition(3)
    found = table.mapInArrow(near_copies._dealt(parts), near_copies._DEALT).groupBy("part").applyInArrow(near_copies._shared, "node long, n int, pos int, gram long").collect()
    key = {g: (place(g) >> 32) % parts << 32 | place(g) & 0xFFFFFFFF for _, own in held for g in own}
    assert len(set(key.values())) == len(key)
    several = {g for g in key if sum(g in own for _, own in held) > 1}
    assert sorted((r.node, r.n, r.pos, r.gram) for r in found) == sorted((node, n, i, key[g]) for (node, own), (_, n, _) in zip(held, rows, strict=True) for i, g in enumerate(own) if g in several)
