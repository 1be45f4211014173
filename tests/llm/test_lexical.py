import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import lexical
from tests.llm.conftest import ROWS

key = lambda rows: sorted(rows, key=str)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(d, c, sum(c.values())) for d, t in docs if (c := Counter(words(t)))]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def rows_of(found):
    return key((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect())


@pytest.mark.parametrize("name", ["plain", "extra", "empty"])
@pytest.mark.parametrize("block", [1, 200_000, lexical.BLOCK])
def test_rows(spark, tables, name, block):
    items = [(1, "The same text"), (1, "one two one two"), (None, "mit license word ÉTÉ été"), (2, None), (3, ""), (4, "absent"), (5, "a word " * 50)]
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS row", "2 AS rank")
    found = lexical.search(lexical.build_index(tables[name], block=block), queries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == key(brute([(r[0], r[1]) for r in ROWS] if name != "empty" else [], items))


def test_ties_and_many_blocks(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([3, 3, 3, 9])))) for i in range(600)] + [(i, "a b c") for i in range(600, 1500)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices("abcdefghi", k=rng.randrange(1, 8)))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (500, 100_000):
        found = lexical.search(lexical.build_index(frame, block=block), spark.createDataFrame(items, "item_id long, text string"))
        assert rows_of(found) == key(brute(docs, items))


def test_slices_of_queries(spark, monkeypatch):
    docs, items = [(i, f"w{i % 7} w{i % 5} x") for i in range(100)], [(i, f"w{i % 7} x") for i in range(40)]
    monkeypatch.setattr(lexical, "SLICE", 20)
    found = lexical.search(lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == key(brute(docs, items))


def treaps(n, rng, equal=False):
    lists = {t: np.flatnonzero(rng.random(n) < share) for t, share in {"a": 0.9, "b": 0.4, "c": 0.05, "d": 0.002}.items()}
    lists = {t: x for t, x in lists.items() if len(x)}
    tfs = {t: np.ones(len(x), int) if equal else rng.geometric(0.3, len(x)) for t, x in lists.items()}
    lengths = np.full(n, 40) if equal else rng.integers(10, 500, n)
    return lexical.Treaps(list(lists), np.cumsum([len(x) for x in lists.values()]), np.concatenate(list(lists.values())), np.concatenate(list(tfs.values())), lengths, n, int(lengths.sum())), lists


def test_treaps_are_in_both_orders_and_shallow():
    for equal in (False, True):
        found, lists = treaps(20_000, np.random.default_rng(1), equal)
        for term, docs in lists.items():
            inorder, stack, node, depth = [], [], (found.roots[term], 1), 0
            while stack or node[0] >= 0:
                while node[0] >= 0:
                    stack.append(node)
                    depth = max(depth, node[1])
                    for child in (found.left[node[0]], found.right[node[0]]):
                        assert child < 0 or found.impacts[child] <= found.impacts[node[0]]
                    node = (found.left[node[0]], node[1] + 1)
                node = stack.pop()
                inorder.append(found.docs[node[0]])
                node = (found.right[node[0]], node[1] + 1)
            assert inorder == docs.tolist() and depth < 80


def test_search_prunes_and_loses_nothing():
    found, lists = treaps(20_000, np.random.default_rng(2))
    terms = {"a": 20, "b": 700, "c": 3000, "d": 6000}
    total, begin = np.zeros(20_000, np.int64), 0
    for term, docs in lists.items():
        total[docs] += terms[term] * found.impacts[begin : begin + len(docs)]
        begin += len(docs)
    want = np.lexsort((np.arange(20_000), -total))[:10]
    best, scores, seen = found.search(terms, 10)
    assert best.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert seen < 4_000
