import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import components, exact_dedup, simhash
from recordloom.llm.exact_dedup import CountingQuotientFilter
from tests.llm.conftest import ROWS

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("p, q", [(64, None), (64, 3), (54, 10), (20, 9), (12, 11), (9, 2)])
def test_quotient_filters_merge_without_loss(p, q):
    rng = np.random.default_rng(p)
    pool = rng.integers(0, min(1 << p, 1 << 63), 120, dtype=np.uint64)
    counts, merged = {}, CountingQuotientFilter.build([], p=p)
    for size in (0, 1, 300, 40, 700):
        part = rng.choice(pool, size)
        weights = rng.choice([1, 1, 2, 3, 300, 70_000], size)
        for x, n in zip(part.tolist(), weights.tolist(), strict=True):
            counts[x] = counts.get(x, 0) + n
        merged = merged.merge(CountingQuotientFilter.loads(CountingQuotientFilter.build(part, weights, p, q).dumps()))
    for filter_ in (merged, CountingQuotientFilter.build(list(counts), list(counts.values()), p, q)):
        values, found = filter_.items()
        assert values.tolist() == sorted(counts) and dict(zip(values.tolist(), found.tolist(), strict=True)) == counts
        assert all(filter_.count(x) == counts.get(x, 0) for x in [*counts, *rng.integers(0, min(1 << p, 1 << 63), 50).tolist()])
    assert len(merged.slots) < 40 * len(counts) and merged.q < p
    with pytest.raises(ValueError):
        merged.merge(CountingQuotientFilter.build([1], p=p - 1))


@pytest.mark.parametrize("size", [1, 4, 1 << 20])
def test_ranges_keep_the_groups(tables, monkeypatch, size):
    want = sorted((str(r.id), r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(tables["plain"]).collect())
    bits = exact_dedup.range_bits
    monkeypatch.setattr(exact_dedup, "range_bits", lambda rows: bits(rows, size))
    assert (bits(13, 1), bits(13, 4), bits(13), bits(0)) == (4, 2, 0, 0)
    assert sorted((str(r.id), r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(tables["plain"]).collect()) == want


@pytest.mark.parametrize("name", ["plain", "extra"])
def test_exact_duplicates_against_groups(tables, name):
    groups = defaultdict(list)
    for id_, text, *_ in ROWS:
        groups[(text or "").translate(A)].append(id_)
    want = sorted((i if i is not None else -99, max((x for x in g if x is not None), default=-99), len(g)) for g in groups.values() for i in g)
    rows = exact_dedup.exact_duplicates(tables[name]).collect()
    assert sorted((r.id if r.id is not None else -99, r.keep_id if r.keep_id is not None else -99, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.id == r.keep_id for r in rows if r.kept)
    kept = exact_dedup.drop_exact_duplicates(tables[name])
    assert kept.columns == tables[name].columns and kept.count() == len(groups)


def test_empty_tables(tables):
    assert exact_dedup.exact_duplicates(tables["empty"]).count() == 0
    assert simhash.near_duplicates(tables["empty"]).count() == 0
    assert simhash.drop_near_duplicates(tables["empty"]).count() == 0


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["plain", "extra"])
def test_near_duplicates_against_brute_force(tables, name):
    prints = [(id_, plain_fingerprint(text)) for id_, text, *_ in ROWS]
    roots = by_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: 1 << 60)
    for id_, p in prints:
        if id_ is not None:
            least[roots[p]] = min(least[roots[p]], id_)
    want = sorted((str(i), p, least[roots[p]]) for i, p in prints)
    rows = simhash.near_duplicates(tables[name]).collect()
    assert sorted((str(r.id), r.fingerprint & (1 << 64) - 1, r.component_id) for r in rows) == want
    kept = simhash.drop_near_duplicates(tables[name])
    assert kept.columns == tables[name].columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_masks_cover_all_pairs_within_the_radius():
    for radius in (1, 2):
        kept = simhash.masks(radius)
        for i in range(64):
            for j in range(i if radius == 1 else 0, i + 1):
                assert any(not m >> i & 1 and not m >> j & 1 for m in kept)


@pytest.mark.parametrize("pairs", [0, 4, 1000])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_keep_the_components(spark, pairs, radius):
    rng = random.Random(radius)
    nodes = [rng.getrandbits(64)]
    for _ in range(250):
        x = rng.choice(nodes)
        for _ in range(rng.choice([1, 1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        nodes.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(nodes)], "node long")
    found = {r.node: r.root for r in components.connected_components(simhash.links(df, radius, pairs)).collect()}
    want = by_components(set(nodes), lambda a, b: (a ^ b).bit_count() <= radius)
    groups, wanted = defaultdict(set), defaultdict(set)
    for x in set(nodes):
        groups[found.get(signed(x), signed(x))].add(x)
        wanted[want[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_large_bucket_stays_linear(spark):
    """A third of the rows in one bucket: hubs grow with the nodes, not with their pairs."""
    base = 0x0123456789ABCDEF
    free = [i for i in range(64) if not simhash.masks(2)[0] >> i & 1]
    rng = random.Random(5)
    nodes = {base ^ sum(1 << i for i in rng.sample(free, rng.randrange(4))) for _ in range(1500)}
    df = spark.createDataFrame([(x,) for x in nodes], "node long")
    assert simhash.links(df).count() < 7 * 30 * len(nodes)


def test_long_chains_are_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components.connected_components(edges).collect()
    assert len(rows) == 300 and {r.root for r in rows} == {0}
