import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import embedding

TEXTS = ["the cat sat", "the dog", "Été à Paris, l'été", "", None, "12", "the the the cat"]


def brute(features, texts):
    """Vectors of texts by their definition, with dictionaries."""

    def buckets(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if features == "letters":
            return [(ord(p[i - 1]) * 961 + ord(p[i]) * 31 + ord(p[i + 1])) % 4096 for w in words for p in [f" {w} "] for i in range(1, len(w) + 1)]
        out = []
        for w in words:
            h = ord(w[0])
            for c in w[1:]:
                h = (h * 31 + ord(c)) % 1_000_003
            out.append(h % 4096)
        return out

    df = Counter(b for t in texts for b in set(buckets(t)))
    vectors = []
    for text in texts:
        v = [sum(n * (math.log((1 + len(texts)) / (1 + df[b])) + 1) * (-1 if (b * 2654435761 % 2**32 * (2 * j + 1) % 2**32) >> 31 else 1) for b, n in Counter(buckets(text)).items()) for j in range(64)]
        norm = math.sqrt(sum(x * x for x in v))
        vectors.append([x / norm if norm else 0.0 for x in v])
    return vectors


@pytest.mark.parametrize("features", ["letters", "words"])
def test_vectors_equal_brute_force(spark, features):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(3)
    rows = {r.i: r.v for r in df.select("i", embedding.embed(F.col("text"), embedding.fit(df, features=features)).alias("v")).collect()}
    assert np.allclose([rows[i] for i in range(len(TEXTS))], brute(features, TEXTS))
    empty = embedding.fit(df.limit(0), features=features)
    assert len(df.select(embedding.embed(F.col("text"), empty).alias("v")).collect()) == len(TEXTS)
    with pytest.raises(ValueError):
        embedding.fit(df, features="none")


def test_projection_keeps_cosines():
    rng = np.random.default_rng(1)
    rows = embedding.signs()
    a = rng.random(embedding.BUCKETS) * (rng.random(embedding.BUCKETS) < 0.05)
    b = np.where(rng.random(embedding.BUCKETS) < 0.5, a, 0.0)
    cosine = lambda x, y: x @ y / math.sqrt((x @ x) * (y @ y))
    assert abs(cosine(a @ rows, b @ rows) - cosine(a, b)) < 0.25 and abs(cosine(a @ rows, rng.permutation(a) @ rows)) < 0.5


def test_both_embedders_find_the_topic(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.model: r for r in embedding.compare_embedders(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "text", "lang").collect()}
    assert set(found) == {"letters", "words"} and all(r.top1 > 0.9 and r.top3 >= r.top1 for r in found.values())


def test_texts_are_read_once_for_each_step_whatever_is_compared(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    text = F.udf(lambda x: (read.add(1), x)[1]).asNondeterministic()(F.col("text"))
    rows = [(i, "xyz"[i % 3], f"{'abc'[i % 3] * 3} word{'rst'[i % 3]} {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "i int, lang string, text string").withColumn("text", text)
    found = embedding.compare_embedders(docs.where("i % 5 <> 0"), docs.where("i % 5 = 0"), "text", "lang").collect()
    assert {(r.model, r.n, r.top1) for r in found} == {("letters", 6, 1.0), ("words", 6, 1.0)}
    assert read.value == 3 * 30  # the weights, the known ones, the judged ones; each draws all rows, as the column is above the filter


def test_buckets_of_words_equal_a_sum_by_letters():
    for text in ("a", "ß é ÀB", "x" * 3000 + " ab", "日本語 a1b2", None, "1 2", "\U0002a6b2z"):
        want = []
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            value = 0
            for c in word:
                value = (value * 31 + ord(c)) % 1_000_003
            want.append(value % 4096)
        assert embedding.word_buckets(text).tolist() == want
