import math
import random
from collections import Counter

from pyspark.sql import functions as F

from recordloom.operators import languages

TEXTS = [("en", "the cat and the hat with a bat on the mat"), ("de", "der Hund und die Katze für das Haus"), ("fr", "le chat et la maison avec l'été"), (None, "unlabelled words"), ("en", None), ("de", "")] * 3
SCHEMA = "lang string, text string"


def brute_slots(text):
    out, low = [], f" {text} ".lower()
    for i in range(1, len(low) - 1):
        a, b, c = (ord(x) if x.isalpha() else 32 for x in low[i - 1 : i + 2])
        if low[i].isalpha():
            out.append((a * 961 + b * 31 + c) % languages.SLOTS)
    return out


def test_slots_equal_brute_force():
    rng = random.Random(1)
    for text in ["", "a", "Été 3x", "ß–ﬁ 中文", "\x00a\n", *("".join(rng.choices("aBé ,1中\n", k=30)) for _ in range(200))]:
        assert languages.slots(text).tolist() == brute_slots(text)
    assert languages.slots(None).tolist() == []


def test_model_and_scores_equal_brute_force(spark):
    model = languages.fit(spark.createDataFrame(TEXTS, SCHEMA).repartition(4))
    counts = {name: Counter(s for lang, text in TEXTS if lang == name for s in brute_slots(text or "")) for name in ("de", "en", "fr")}
    assert model.names == ["de", "en", "fr"]
    p = lambda name, s: math.log((counts[name][s] + 0.5) / (sum(counts[name].values()) + 0.5 * languages.SLOTS))
    assert all(math.isclose(model.table[s][i], p(name, s)) for s in range(languages.SLOTS) for i, name in enumerate(model.names))
    rows = spark.createDataFrame([(1, "und die Katze"), (2, "the mat"), (3, "le chat"), (4, None), (5, "12 !"), (6, "x" * 100_000)], "i int, text string").select("i", languages.identify(F.col("text"), model, least=4, margin=0.01).alias("l")).collect()
    assert {r.i: r.l.language for r in rows if r.i < 6} == {1: "de", 2: "en", 3: "fr", 4: None, 5: None}
    for r, text in ((r, t) for r in rows for i, t in [(1, "und die Katze"), (2, "the mat")] if r.i == i):
        scores = sorted((sum(p(name, s) for s in brute_slots(text)) for name in model.names), reverse=True)
        assert r.l.n == len(brute_slots(text)) and math.isclose(r.l.margin, (scores[0] - scores[1]) / r.l.n, abs_tol=1e-8)


def test_abstention_and_small_models(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    rows = lambda model, **more: {r.t: r.l.language for r in spark.createDataFrame([("the",), ("the mat and the hat",)], "t string").select("t", languages.identify(F.col("t"), model, **more).alias("l")).collect()}
    model = languages.fit(docs)
    assert rows(model) == {"the": None, "the mat and the hat": "en"}
    assert rows(model, margin=50.0) == {"the": None, "the mat and the hat": None}
    assert rows(languages.fit(docs.where("lang = 'de'"))) == {"the": None, "the mat and the hat": "de"}
    assert rows(languages.fit(docs.limit(0))) == {"the": None, "the mat and the hat": None}
    assert {r.label: (r.records, r.decided, r.right) for r in languages.accuracy(docs, model).collect()} == {"en": (6, 3, 3), "de": (6, 3, 3), "fr": (3, 3, 3)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = languages.accuracy(docs.where("doc_id % 3 = 0"), languages.fit(docs.where("doc_id % 3 <> 0"))).collect()
    assert sum(r.right for r in found) >= 0.97 * sum(r.records for r in found) and sum(r.right for r in found) >= 0.98 * sum(r.decided for r in found)
