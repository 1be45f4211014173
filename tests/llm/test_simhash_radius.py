import random

import pytest
from recordloom.llm import components, simhash
from tests.llm.test_dedup import by_components


@pytest.mark.parametrize("pairs", [0, 4, 1000])
def test_larger_radii_keep_the_components(spark, pairs):
    rng = random.Random(4)
    nodes = [rng.getrandbits(63)]
    for _ in range(150):
        nodes.append(rng.choice(nodes) ^ sum(1 << i for i in rng.sample(range(63), rng.choice([2, 3, 4, 5, 9]))))
    df = spark.createDataFrame([(x,) for x in set(nodes)], "node long")
    found = {r.node: r.root for r in components.connected_components(simhash.links(df, 4, pairs)).collect()}
    want = by_components(set(nodes), lambda a, b: (a ^ b).bit_count() <= 4)
    assert {x: found.get(x, x) for x in set(nodes)} == want


def test_dropping_takes_words_and_radius(spark, tmp_path):
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {x}") for i, x in enumerate(["u v w x", "u v w y", "z z z z z z z z z z"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    prints = {i: simhash.fingerprint(t.encode(), 2) for i, t in rows}
    for radius in (1, 5):
        roots = by_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= radius)
        want = sorted({min(i for i, q in prints.items() if roots[q] == roots[p]) for p in prints.values()})
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/d"), words=2, radius=radius).collect()) == want
