"""Queries of what is told from texts: languages, topics, terms; each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import embedding, languages, search, tagging
from recordloom.plans.file_queries import shared_folder
from recordloom.plans.record_queries import _t
from recordloom.plans.registry import query

_TRIGRAMS = r"""
         w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w FROM documents),
         g AS (SELECT doc_id, lang, ' ' || w || ' ' AS p, unnest(range(1, len(w) + 1)) AS i FROM w),
         s AS (SELECT doc_id, lang, (unicode(substr(p, i::INT, 1))::BIGINT * 961 + unicode(substr(p, i::INT + 1, 1)) * 31 + unicode(substr(p, i::INT + 2, 1))) % 4096 AS s, count(*) AS n FROM g GROUP BY ALL),
         c AS (SELECT lang, s, sum(n) AS n FROM s WHERE doc_id % 3 <> 0 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
         m AS (SELECT t.lang, r.s, ln((coalesce(c.n, 0) + 0.5) / (t.n + 0.5 * 4096)) AS p FROM t CROSS JOIN (SELECT unnest(range(4096)) AS s) r LEFT JOIN c ON c.lang = t.lang AND c.s = r.s),
         z AS (SELECT doc_id, m.lang AS found, sum(n * p) AS score, sum(n) AS n FROM s JOIN m USING (s) GROUP BY ALL),
         o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, found) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, found) AS second FROM z),
         b AS (SELECT doc_id, n::BIGINT AS n, CASE WHEN n >= 8 AND (score - second) / n >= 0.05 THEN found END AS language FROM o WHERE r = 1)"""


@query(f"WITH {_TRIGRAMS} SELECT d.doc_id, d.doc_id % 3 = 0 AS held_out, b.language, coalesce(b.n, 0) AS n FROM documents d LEFT JOIN b USING (doc_id)")
def trigram_languages(spark, sf):
    """Languages by a model of two thirds of the labelled documents, for all of them."""
    docs = _t(spark, sf, "documents")
    model = languages.fit(docs.where("doc_id % 3 <> 0"))
    return docs.select("doc_id", (F.col("doc_id") % 3 == 0).alias("held_out"), languages.identify(F.col("text"), model).alias("l")).select("doc_id", "held_out", "l.language", "l.n")


@query(f"WITH {_TRIGRAMS} SELECT d.lang AS label, count(*) AS records, count(b.language) AS decided, count(*) FILTER (b.language = d.lang) AS \"right\" FROM documents d LEFT JOIN b USING (doc_id) WHERE d.doc_id % 3 = 0 AND d.lang IS NOT NULL GROUP BY ALL")
def language_accuracy(spark, sf):
    """Of the documents that the model hasn't seen, how many of each language are decided, and rightly."""
    docs = _t(spark, sf, "documents")
    return languages.accuracy(docs.where("doc_id % 3 = 0"), languages.fit(docs.where("doc_id % 3 <> 0")))


_EMBEDDED = r"""
         w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w FROM documents),
         u AS (SELECT w, len(w) AS k, (list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT), lambda a, b: (a * 31 + b) % 1000003) % 4096)::BIGINT AS b FROM (SELECT DISTINCT w FROM w)),
         l AS (SELECT w, ' ' || w || ' ' AS p, unnest(range(1, k + 1)) AS i FROM u),
         f AS (SELECT 'words' AS model, doc_id, b, count(*) AS tf FROM w JOIN u USING (w) GROUP BY ALL UNION ALL
               SELECT 'letters', doc_id, (unicode(substr(p, i::INT, 1))::BIGINT * 961 + unicode(substr(p, i::INT + 1, 1)) * 31 + unicode(substr(p, i::INT + 2, 1))) % 4096 AS b, count(*) FROM w JOIN l USING (w) GROUP BY ALL),
         i AS (SELECT model, b, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0)) / (1 + count(*) FILTER (doc_id % 3 <> 0))) + 1 AS idf FROM f GROUP BY ALL),
         v AS (SELECT model, doc_id, j, sum(tf * idf * (1 - 2 * ((((b * 2654435761) % 4294967296) * (2 * j + 1)) % 4294967296 >> 31))) AS x FROM f JOIN i USING (model, b) CROSS JOIN (SELECT unnest(range(64)) AS j) GROUP BY ALL),
         n AS (SELECT model, doc_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY model, doc_id)) AS x FROM v),
         a AS (SELECT model, lang AS topic, j, sum(x) AS x FROM n JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0 AND lang IS NOT NULL GROUP BY ALL),
         c AS (SELECT model, topic, j, x / sqrt(sum(x * x) OVER (PARTITION BY model, topic)) AS x FROM a),
         s AS (SELECT model, d.doc_id, d.lang, topic, coalesce(sum(n.x * c.x), 0) AS s FROM (SELECT * FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL) d CROSS JOIN c LEFT JOIN n USING (model, doc_id, j) GROUP BY ALL),
         o AS (SELECT *, row_number() OVER q AS r, s - lead(s) OVER q AS gap FROM s WINDOW q AS (PARTITION BY model, doc_id ORDER BY s DESC, topic))"""


@query(f"""WITH {_EMBEDDED}
    SELECT model, count(*) FILTER (r = 1) AS n, avg((topic = lang)::INT) FILTER (r = 1) AS top1, sum((topic = lang AND r <= 3)::INT) / count(*) FILTER (r = 1) AS top3, avg((s >= 0.35 AND gap >= 0.05)::INT) FILTER (r = 1) AS coverage FROM o GROUP BY ALL""")
def embedder_comparison(spark, sf):
    """Two embedders of documents, by letters and by words, with languages as topics: centroids of two thirds, ranked for the rest."""
    docs = _t(spark, sf, "documents")
    return embedding.compare_embedders(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "text", "lang").select("model", "n", "top1", "top3", "coverage")


@query(r"""
    WITH e AS (SELECT page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+')) AS w FROM pages), n AS (SELECT count(*) AS n FROM e WHERE len(w) > 0),
         p AS (SELECT page_id, unnest(w) AS word FROM e), i AS (SELECT word, floor(1000 * ln((1 + n) / count(*)))::BIGINT AS weight FROM p, n GROUP BY word, n),
         q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS word FROM benchmark),
         s AS (SELECT item_id, page_id AS entry, sum(weight)::BIGINT AS shared FROM q JOIN p USING (word) JOIN i USING (word) GROUP BY ALL HAVING sum(weight) > 0),
         r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, entry)::INT AS place, entry, shared FROM s)
    SELECT * FROM r WHERE place <= 5""")
def catalogue_search(spark, sf):
    """The pages whose titles share the weightiest words with each benchmark passage, by an index of the titles."""
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    index = search.catalogue(_t(spark, sf, "pages"), "page_id", words(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return search.nearest(_t(spark, sf, "benchmark"), "item_id", words(F.col("text")), search.stored(index, shared_folder(spark, "catalogue")))


@query(r"""
    WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[a-z]{8,}')) AS name FROM benchmark),
         w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS name FROM documents),
         f AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM w JOIN v USING (name) GROUP BY ALL)
    SELECT doc_id, coalesce(n, 0) AS n, coalesce(names, '') AS names FROM documents LEFT JOIN f USING (doc_id)""")
def named_terms(spark, sf):
    """The long words of all benchmark passages as a vocabulary of names, found as whole words in every document by one automaton."""
    long = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{8,}"), F.lit(0)))
    names = [r.name for r in _t(spark, sf, "benchmark").select(F.explode(long).alias("name")).distinct().orderBy("name").collect()]  # a vocabulary is a parameter
    out = tagging.tag_records(_t(spark, sf, "documents"), {"Text": F.col("text")}, {"Text"}, tagging.Vocabulary(names={n: n for n in names}))
    return out.select("doc_id", F.size("evidence.tags").cast("long").alias("n"), F.array_join(F.array_sort("evidence.tags"), ",").alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang = 'de' THEN 'DE' WHEN doc_id % 2 = 0 AND lang = 'fr' THEN 'FR' ELSE '' END AS tags FROM documents")
def dataset_topics(spark, sf):
    """Each document cites a dataset; titles, which half of the datasets have, name their language."""
    docs = _t(spark, sf, "documents")
    doi = F.concat(F.lit("10.4232/1."), F.col("doc_id").cast("string"))
    titles = docs.where("doc_id % 2 = 0").select(doi.alias("doi"), F.concat(F.lit("Survey: "), F.when(F.col("lang") == "de", "German").when(F.col("lang") == "fr", "French").otherwise("Other"), F.lit(" speakers")).alias("title"))
    cited = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nsee "), doi).alias("text"))
    out = tagging.tag_records(cited, {"Text": F.col("text")}, {"Text"}, tagging.Vocabulary(phrases={"german": "DE", "french": "FR"}), titles=titles, key="doc_id")
    return out.select("doc_id", F.array_join("evidence.tags", ",").alias("tags"))
