"""Queries of the record operators over the driver tables, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import cells, identifiers, similarity
from recordloom.operators import compare, evaluate, filters, notes, profile, resolve, schema, semantic, state, tagging, verify
from recordloom.plans.registry import query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.concat_ws("; ", "p_brand", "p_type", F.split("p_name", " ")[0]))


_TAGS = "concat_ws('; ', p_brand, p_type, split_part(p_name, ' ', 1))"
_PARTS = f"unnest(list_filter(list_transform(string_split({_TAGS}, ';'), lambda x: trim(x)), lambda x: x <> ''))"


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return profile.value_counts(_t(spark, sf, "orders"), "o_orderstatus")


@query(f"SELECT value, count(*) AS n FROM (SELECT {_PARTS} AS value FROM part) GROUP BY 1")
def tag_counts(spark, sf):
    return profile.value_counts(_tags(_t(spark, sf, "part")), "tags")


@query("SELECT value, n, n / sum(n) OVER () AS share FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)")
def share_of_total(spark, sf):
    return profile.with_share(profile.value_counts(_t(spark, sf, "events"), "event_type", "categorical"))


@query("""
    WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
    SELECT CASE WHEN k <= 8 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def top_and_other(spark, sf):
    return profile.top_and_other(profile.value_counts(_t(spark, sf, "part"), "p_brand", "categorical"))


@query("SELECT o_orderstatus AS row_value, o_orderpriority AS col_value, count(*) AS n FROM orders GROUP BY 1, 2")
def cross_table(spark, sf):
    return profile.cross_table(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"SELECT row_value, col_value, count(*) AS n FROM (SELECT {_PARTS} AS row_value, p_size::VARCHAR AS col_value FROM part) GROUP BY 1, 2")
def tag_cross_table(spark, sf):
    return profile.cross_table(_tags(_t(spark, sf, "part")), "tags", "p_size")


@query("""
    WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
         c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20))::INT + 1, 20) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
    SELECT i::INT AS bin, lo + (i - 1) * ((hi - lo) / 20) AS lower, lo + i * ((hi - lo) / 20) AS upper, coalesce(n, 0)::BIGINT AS n
    FROM range(1, 21) g(i) CROSS JOIN b LEFT JOIN c ON bin = i""")
def histogram(spark, sf):
    return profile.histogram(_t(spark, sf, "orders"), "o_totalprice")


_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim({c}::VARCHAR) AS v FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query(f"""
    WITH v AS (SELECT * FROM ({_KINDS}) WHERE v <> ''),
         s AS (SELECT "column", count(*) AS n, count(DISTINCT v) AS d, avg((v LIKE '%;%' OR v LIKE '%,%')::INT) AS tagged, avg((try_cast(v AS DOUBLE) IS NOT NULL)::INT) AS num,
                      avg((try_cast(v AS DOUBLE) BETWEEN 1900 AND 2100)::INT) AS yr, avg((try_cast(v AS DOUBLE) % 1 = 0)::INT) AS whole FROM v GROUP BY 1)
    SELECT "column", CASE WHEN tagged >= 0.1 THEN 'multi_tag' WHEN num >= 0.9 AND yr >= 0.9 AND whole >= 0.9 THEN 'year' WHEN num >= 0.9 THEN 'numeric'
                          WHEN d <= 50 AND d <= 0.5 * n THEN 'categorical' ELSE 'text' END AS kind,
           n AS non_empty, n / (SELECT count(*) FROM customer) AS non_empty_pct, d AS unique_values FROM s""")
def summarize(spark, sf):
    return profile.summarize(_t(spark, sf, "customer"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_totalprice BETWEEN 100000 AND 250000 AND o_orderstatus <> 'F'")
def filter_all(spark, sf):
    conditions = [("o_orderpriority", "contains", " URGENT ", ""), ("o_totalprice", "between", "100000", "250000"), ("o_orderstatus", "not equals", "f", "")]
    return filters.project(_t(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"], conditions)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def filter_any(spark, sf):
    return filters.project(_t(spark, sf, "customer"), ["c_custkey", "c_acctbal"], [("c_acctbal", "<", "0", ""), ("c_mktsegment", "equals", "building", "")], "OR")


@query("SELECT avg((try_cast(c_acctbal::VARCHAR AS DOUBLE) IS NOT NULL)::INT) AS acctbal, avg((try_cast(c_name AS DOUBLE) IS NOT NULL)::INT) AS name FROM customer")
def numeric_shares(spark, sf):
    return _t(spark, sf, "customer").agg(filters.numeric_share(F.col("c_acctbal")).alias("acctbal"), filters.numeric_share(F.col("c_name")).alias("name"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 25 OFFSET 25")
def second_page(spark, sf):
    return filters.page(_t(spark, sf, "supplier").select("s_suppkey", "s_name"), [F.col("s_name"), F.col("s_suppkey")], 2, 25)


@query("""
    SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title_key, split_part(p_name, ' ', 1) AS surname,
           '10.' || (1000 + p_size) || '/' || p_partkey AS doi, 'https://doi.org/10.' || (1000 + p_size) || '/' || p_partkey AS link,
           'doi:10.' || (1000 + p_size) || '/' || p_partkey AS match_value, 1950 + p_size AS year FROM part""")
def identifiers_of_parts(spark, sf):
    raw = F.concat(F.lit("https://dx.doi.org/10."), (F.lit(1000) + F.col("p_size")).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."))
    own = identifiers.doi(raw)
    return _t(spark, sf, "part").select(
        "p_partkey",
        cells.title_key(F.col("p_name")).alias("title_key"),
        cells.first_surname(F.concat(F.split("p_name", " ")[0], F.lit(", X.; Other, Y."))).alias("surname"),
        own.alias("doi"),
        identifiers.record_link(F.lit(" "), own).alias("link"),
        identifiers.match_value(raw).alias("match_value"),
        cells.first_year(F.concat(F.lit("in "), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(" (print)"))).alias("year"),
    )


@query(r"""
    SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical FROM pages""")
def canonical_urls(spark, sf):
    return _t(spark, sf, "pages").select("page_id", identifiers.canonical_url(F.col("url")).alias("canonical"))


_B = "SELECT p_partkey AS row, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' II' ELSE p_name END AS title, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN p_type || '; NEW' ELSE p_type END AS type, p_partkey::VARCHAR AS year FROM part WHERE p_partkey % 11 <> 0"
_A = "SELECT p_partkey AS row, p_name AS title, p_brand AS brand, p_type AS type, p_partkey::VARCHAR AS year FROM part WHERE p_partkey % 13 <> 0"


def _versions(spark, sf):
    part = _t(spark, sf, "part")
    base = part.select(F.col("p_partkey").alias("row"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("year"))
    changed = base.withColumn("title", F.when(F.col("row") % 7 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))).withColumn("type", F.when(F.col("row") % 5 == 0, F.concat("type", F.lit("; NEW"))).otherwise(F.col("type")))
    return base.where("row % 13 <> 0"), changed.where("row % 11 <> 0")


_KEY = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
    WITH a AS (SELECT *, {_KEY} AS k FROM ({_A})), b AS (SELECT *, {_KEY} AS k FROM ({_B})),
         j AS (SELECT a.k AS ak, b.k AS bk, a.title AS ta, b.title AS tb, a.brand AS ab, b.brand AS bb, a.type AS aty, b.type AS bty FROM a FULL JOIN b ON a.k = b.k AND a.year = b.year)
    SELECT coalesce(ak, bk) AS key, ta AS title, 'Removed' AS status, '(removed record)' AS field, ta AS old_value, '' AS new_value FROM j WHERE bk IS NULL
    UNION ALL SELECT bk, tb, 'Added', '(new record)', '', tb FROM j WHERE ak IS NULL
    UNION ALL SELECT ak, ta, 'Changed', 'brand', ab, bb FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND ab <> bb
    UNION ALL SELECT ak, ta, 'Changed', 'type', aty, bty FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND list_sort(string_split(aty, '; ')) <> list_sort(string_split(bty, '; '))""")
def keyed_diff(spark, sf):
    a, b = _versions(spark, sf)
    # all the columns' tags are in the order in which a sorted display has them
    return compare.keyed_diff(a, b, ["brand", "type"], None, "title", "year", kinds=["categorical", "text"])


@query(f"""
    WITH a AS (SELECT *, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY row) AS n FROM ({_A})), b AS (SELECT *, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY row) AS n FROM ({_B}))
    SELECT a.row AS row_a, b.row AS row_b, coalesce(a.title, b.title) AS title, CASE WHEN a.row IS NULL THEN 'Only in B' WHEN b.row IS NULL THEN 'Only in A' WHEN a.brand <> b.brand OR a.type <> b.type THEN 'Different' ELSE 'Same' END AS status,
           CASE WHEN a.row IS NULL OR b.row IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN a.brand <> b.brand THEN 'brand' END, CASE WHEN a.type <> b.type THEN 'type' END) END AS differences
    FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n""")
def pair_diff(spark, sf):
    a, b = _versions(spark, sf)
    diff = compare.pair_diff(a, b, "row", ("title", "title"), [("brand", "brand"), ("type", "type")], kinds=["categorical", "text"])
    return diff.select("row_a", "row_b", "title", "status", F.array_join("differences", "; ").alias("differences"))


@query(f"""
    WITH a AS (SELECT *, {_KEY} AS k FROM ({_A})), b AS (SELECT *, {_KEY} AS k FROM ({_B}))
    SELECT a.row AS row_a, b.row AS row_b, 'title + 1 of 1 extra key(s)' AS note FROM a JOIN b ON a.k = b.k AND a.year = b.year""")
def greedy_pairs(spark, sf):
    a, b = _versions(spark, sf)
    return compare.match_pairs(a, b, "row", ("title", "title"), [("year", "year")])


#: Length of a longest common subsequence of x and y in SQL: rows of the table folded over x's characters.
_LCS = """list_reduce(list_transform(string_split(x, ''), lambda c: [ord(c)]), lambda r, c: list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j]),
    lambda acc, j: list_append(acc, CASE WHEN ord(substr(y, j[1], 1)) = c[1] THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[j[1]]) END), [0::BIGINT]), list_transform(range(0, length(y) + 1), lambda z: 0::BIGINT))[length(y) + 1]"""


@query(f"""
    WITH p AS (SELECT n_nationkey, r_regionkey, array_to_string(list_sort(string_split(lower(n_name), ' ')), ' ') AS x, array_to_string(list_sort(string_split(lower(r_name), ' ')), ' ') AS y FROM nation, region)
    SELECT n_nationkey, r_regionkey, 100.0::DOUBLE * 2 * {_LCS} / (length(x) + length(y)) AS ratio FROM p""")
def title_ratios(spark, sf):
    # both are dimension tables of a fixed size
    pairs = _t(spark, sf, "nation").crossJoin(F.broadcast(_t(spark, sf, "region")))
    return pairs.select("n_nationkey", "r_regionkey", similarity.title_ratio(F.col("n_name"), F.col("r_name")).alias("ratio"))


_CAND = "SELECT l_partkey AS record, (l_suppkey % 5)::INT AS source_rank, l_orderkey * 10 + l_linenumber AS cand_pos, round(l_quantity * 2, 2) AS score, l_returnflag = 'R' AS reference_only, 'src' || (l_suppkey % 5) AS source, 'Title ' || l_suppkey AS title, '10.1/' || l_suppkey AS doi, '' AS url FROM lineitem"


def _candidates(spark, sf):
    n = lambda c: F.col(c).cast("string")
    rank = F.col("l_suppkey") % 5
    return _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("record"), rank.cast("int").alias("source_rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_pos"), F.round(F.col("l_quantity") * 2, 2).alias("score"), (F.col("l_returnflag") == "R").alias("reference_only"),
        F.concat(F.lit("src"), rank.cast("string")).alias("source"), F.concat(F.lit("Title "), n("l_suppkey")).alias("title"), F.concat(F.lit("10.1/"), n("l_suppkey")).alias("doi"), F.lit("").alias("url"),
    )


@query(f"""
    WITH c AS ({_CAND}), r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY score DESC, source_rank, cand_pos) AS unused FROM c),
         s AS (SELECT DISTINCT record, source_rank FROM c),
         b AS (SELECT s.record, s.source_rank AS upto, arg_max({{'score': score, 'ref': reference_only}}, score * 1000000000000 - c.source_rank * 10000000000 - cand_pos) AS best FROM s JOIN c ON c.record = s.record AND c.source_rank <= s.source_rank GROUP BY 1, 2),
         cut AS (SELECT record, min(upto) AS cutoff FROM b WHERE best.score >= 92 AND NOT best.ref GROUP BY 1),
         f AS (SELECT c.*, row_number() OVER (PARTITION BY c.record ORDER BY score DESC, source_rank, cand_pos) AS k FROM c LEFT JOIN cut USING (record) WHERE cutoff IS NULL OR source_rank <= cutoff)
    SELECT p_partkey, CASE WHEN k IS NULL THEN 'not_found' WHEN score < 75 THEN 'low_confidence' WHEN reference_only THEN 'matched_no_link' WHEN score >= 92 THEN 'auto_accepted' ELSE 'needs_review' END AS status,
           coalesce(source, '') AS source, CASE WHEN score >= 75 AND NOT reference_only THEN doi ELSE '' END AS doi,
           CASE WHEN k IS NULL THEN '' WHEN score < 75 THEN '(not accepted, for reference only) ' || title ELSE title END AS matched_title, coalesce(score, 0.0)::DOUBLE AS match_score
    FROM part LEFT JOIN f ON record = p_partkey AND k = 1""")
def resolve_records(spark, sf):
    records = _t(spark, sf, "part").select(F.col("p_partkey").alias("record"))
    found = resolve.results(records, "record", _candidates(spark, sf))
    return found.select(F.col("record").alias("p_partkey"), "status", "source", "doi", "matched_title", "match_score")


@query("""
    WITH s AS (SELECT * FROM (VALUES ('crossref', 0, NULL), ('hal', 1, 'fr'), ('dnb', 2, 'de'), ('openalex', 3, NULL)) t(source, base, lng))
    SELECT doc_id, source_ AS source, ((CASE WHEN lng IS NULL THEN 1000 ELSE 0 END) + base)::INT AS source_rank FROM (SELECT doc_id, lang, s.source AS source_, base, lng FROM documents, s) WHERE lng IS NULL OR lng = lang""")
def routes(spark, sf):
    table = resolve.source_table(spark, ("crossref", "hal", "dnb", "openalex"))
    return resolve.route(_t(spark, sf, "documents"), "doc_id", F.col("lang"), F.lit(""), table)


@query("""
    WITH c AS (SELECT l_partkey AS record, (l_suppkey % 7)::INT AS source_rank, l_orderkey * 10 + l_linenumber AS cand_pos, 'f' || (l_suppkey % 7 // 2) AS family, 's' || (l_suppkey % 7) AS source, l_quantity * 2 AS total FROM lineitem WHERE l_quantity * 2 >= 75 AND 100 - l_tax * 200 >= 80 + 5),
         r AS (SELECT DISTINCT record, source_rank FROM c),
         n AS (SELECT r.record, r.source_rank, count(DISTINCT family) AS k FROM r JOIN c ON c.record = r.record AND c.source_rank <= r.source_rank GROUP BY 1, 2),
         cut AS (SELECT record, min(source_rank) AS cutoff FROM n WHERE k >= 2 GROUP BY 1),
         f AS (SELECT c.*, row_number() OVER (PARTITION BY c.record ORDER BY total DESC, c.source_rank, cand_pos) AS k FROM c LEFT JOIN cut USING (record) WHERE cutoff IS NULL OR source_rank <= cutoff)
    SELECT record, any_value(source) FILTER (k = 1) AS source, max(total) AS total, count(DISTINCT family)::INT AS families, count(DISTINCT family) >= 2 AS confirmed FROM f GROUP BY 1""")
def confirm_sources(spark, sf):
    rank = F.col("l_suppkey") % 7
    rows = _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("record"), rank.cast("int").alias("source_rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_pos"), F.concat(F.lit("f"), F.floor(rank / 2).cast("string")).alias("family"),
        F.concat(F.lit("s"), rank.cast("string")).alias("source"), (F.col("l_quantity") * 2).alias("total"), (F.lit(100) - F.col("l_tax") * 200 - 5).alias("title_score"),
    )
    return resolve.confirmations(rows, "record", 2).withColumn("families", F.col("families").cast("int"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND o IS NOT NULL THEN 'url_enriched' ELSE 'not_found' END AS status, CASE WHEN c_custkey % 3 = 0 AND o IS NOT NULL THEN 'unpaywall' ELSE '' END AS source,
           CASE WHEN c_custkey % 3 = 0 AND o IS NOT NULL THEN 'http://x/' || o ELSE '' END AS url
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey::VARCHAR) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def enrich_urls(spark, sf):
    own = F.concat(F.lit("10.5/"), F.col("c_custkey").cast("string"))
    found = _t(spark, sf, "customer").select("c_custkey", F.lit("not_found").alias("status"), F.lit("").alias("source"), F.lit("").alias("doi"), F.lit("").alias("url"), F.when(F.col("c_custkey") % 3 == 0, own).alias("old"))
    places = _t(spark, sf, "orders").select(F.concat(F.lit("https://doi.org/10.5/"), F.col("o_custkey").cast("string")).alias("doi"), F.concat(F.lit("http://x/"), F.col("o_orderkey").cast("string")).alias("url"))
    return resolve.enrich_urls(found, F.col("old"), places).select("c_custkey", "status", "source", "url")


_GP = """SELECT p_partkey, list_distinct([p_brand, p_type]) AS g, list_distinct(CASE WHEN p_size % 3 = 0 THEN [p_brand] WHEN p_size % 3 = 1 THEN [p_type, 'X'] ELSE [p_brand, p_type] END) AS p FROM part"""


def _gold(spark, sf):
    x = F.col("p_size") % 3
    return _t(spark, sf, "part").select("p_partkey", F.array("p_brand", "p_type").alias("g"), F.when(x == 0, F.array("p_brand")).when(x == 1, F.array(F.col("p_type"), F.lit("X"))).otherwise(F.array("p_brand", "p_type")).alias("p"))


@query(f"""
    WITH x AS (SELECT *, len(list_intersect(g, p)) AS b FROM ({_GP})), s AS (SELECT count(*) AS records, sum(b)::BIGINT AS tp, sum(len(p) - b)::BIGINT AS fp, sum(len(g) - b)::BIGINT AS fn, sum((b = len(g) AND b = len(p))::INT)::BIGINT AS exact, sum((b > 0)::INT)::BIGINT AS any_hit FROM x),
         r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM s)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r""")
def score_sets(spark, sf):
    return evaluate.score_sets(_gold(spark, sf), "g", "p")


@query(f"""
    WITH t AS (SELECT unnest(list_distinct(list_concat(g, p))) AS tag, g, p FROM ({_GP})),
         c AS (SELECT tag, sum((list_contains(g, tag) AND list_contains(p, tag))::INT)::BIGINT AS tp, sum((NOT list_contains(g, tag))::INT)::BIGINT AS fp, sum((NOT list_contains(p, tag))::INT)::BIGINT AS fn FROM t GROUP BY 1),
         r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
    SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def scores_by_tag(spark, sf):
    return evaluate.by_tag(_gold(spark, sf), "g", "p")


@query(f"SELECT tag, count(*) AS records, avg((top = tag)::INT) AS recall FROM (SELECT unnest(g) AS tag, CASE WHEN p_size % 3 = 1 THEN p_type ELSE p_brand END AS top FROM part JOIN ({_GP}) USING (p_partkey)) GROUP BY 1")
def recall_by_gold(spark, sf):
    return evaluate.recall_by_gold(_gold(spark, sf).withColumn("top", F.col("p")[0]), "g", "top")


@query(f"""
    SELECT p_partkey, CASE WHEN b = len(g) AND b = len(p) THEN 'exact' WHEN b > 0 THEN 'partly right' WHEN len(p) = 0 THEN 'missed' ELSE 'wrong' END AS outcome FROM (SELECT *, len(list_intersect(g, p)) AS b FROM ({_GP}))""")
def outcomes(spark, sf):
    return _gold(spark, sf).select("p_partkey", evaluate.outcome(F.col("g"), F.col("p")).alias("outcome"))


@query("""
    WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
         m AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY 1, 2), c AS (SELECT label AS topic, list(x ORDER BY i) AS w FROM m GROUP BY 1),
         s AS (SELECT vec_id, topic, list_inner_product(v, w) / sqrt(list_inner_product(w, w)) AS sim FROM u, c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC) AS n FROM s)
    SELECT vec_id, max(topic) FILTER (n = 1) AS topic, round(max(sim) FILTER (n = 1), 6) AS similarity, round(max(sim) FILTER (n = 1) - max(sim) FILTER (n = 2), 6) AS margin FROM k GROUP BY 1""")
def nearest_topics(spark, sf):
    df = _t(spark, sf, "embeddings")
    found = semantic.nearest_topics(df, "embedding", semantic.centroids(df, "embedding", "label"))
    return found.select("vec_id", "topic", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, event_id, event_type FROM r WHERE k = 1 AND epoch((SELECT max(ts) FROM events)) - epoch(ts) <= CASE WHEN event_type = 'click' THEN 3600 WHEN event_type = 'view' THEN 604800 ELSE 2592000 END""")
def live_entries(spark, sf):
    events = _t(spark, sf, "events")
    last = state.latest(events, "user_id", "ts", "event_id")
    kinds = last.withColumn("status", F.when(F.col("event_type") == "click", "unavailable").when(F.col("event_type") == "view", "unverified").otherwise("other")).withColumn("saved", F.col("ts").cast("timestamp").cast("double"))
    newest = events.agg(F.max("ts").cast("timestamp").cast("double").alias("now"))
    return state.alive(kinds.crossJoin(F.broadcast(newest)), "verification", "saved", "status", F.col("now")).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def work_left(spark, sf):
    done = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.missing(_t(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""
    SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'already_target' WHEN r.r_name IS NOT NULL AND n_nationkey % 2 = 0 THEN 'translated' ELSE 'missing' END AS n_name_status,
           CASE WHEN n_regionkey <> 0 AND n_nationkey % 2 = 0 THEN n_name || ' [' || r.r_name || ']' ELSE n_name END AS n_name FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey""")
def translations(spark, sf):
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    memory = nation.where("n_nationkey % 2 = 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("text"), F.col("r_name").alias("translated"))
    language = F.when(F.col("n_regionkey") == 0, "en-GB").otherwise("fr")
    return state.translate_cells(nation, "n_name", memory, language, "en").select("n_nationkey", "n_name", "n_name_status")


@query("""
    SELECT doc_id, coalesce(len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is'))) / nullif(len(w), 0) >= 0.12, false) AS english FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)""")
def english_texts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", cells.language_is_english(F.col("text"), ("the", "of", "and", "to", "in", "is")).alias("english"))


_WORDS = {"A": ("the", "of"), "B": ("que", "de"), "C": ("der", "und", "zu")}


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN (t LIKE '%the%')::INT + (t LIKE '%of%')::INT >= 2 THEN 'A' END, CASE WHEN (t LIKE '%que%')::INT + (t LIKE '%de%')::INT >= 2 THEN 'B' END,
           CASE WHEN (t LIKE '%der%')::INT + (t LIKE '%und%')::INT + (t LIKE '%zu%')::INT >= 2 THEN 'C' END], lambda x: x IS NOT NULL), '; ') AS tags FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def keyword_tags(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(tagging.keyword_counts(F.col("text"), _WORDS), "; ").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '; ' || p_type ELSE p_brand END AS tags FROM part")
def appended_values(spark, sf):
    source = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_type"), F.lit(" ;\n"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    return _t(spark, sf, "part").select("p_partkey", cells.append_missing(F.col("p_brand"), source).alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_type = upper(p_type) THEN p_type || '; ' ELSE '' END || 'X' AS kept, p_name || '; 12' AS removed FROM part")
def kept_tags(spark, sf):
    kept, removed = cells.keep_tags(cells.split_auto(F.concat_ws(";", "p_type", "p_name", F.lit("X"), F.lit("12"))), cells.is_uppercase)
    return _t(spark, sf, "part").select("p_partkey", F.array_join(kept, "; ").alias("kept"), F.array_join(removed, "; ").alias("removed"))


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'http://x.org/' || s_suppkey ELSE 'http://own.org' END AS url, s_suppkey % 2 = 0 AS link_added,
           CASE WHEN s_suppkey % 2 = 0 THEN 'see and ok' ELSE 'see http://x.org/' || s_suppkey || ' and ok' END AS note FROM supplier""")
def recovered_links(spark, sf):
    note = F.concat(F.lit("see http://x.org/"), F.col("s_suppkey").cast("string"), F.lit(" and ok"))
    rows = _t(spark, sf, "supplier").select("s_suppkey", note.alias("note"), F.when(F.col("s_suppkey") % 2 == 1, "http://own.org").alias("url"), F.lit(None).cast("string").alias("doi"))
    return notes.recover_links(rows, "note", "url", "doi", remove=True).select("s_suppkey", "url", "link_added", "note")


@query("""
    SELECT count(*) AS records, count(*) FILTER (s_suppkey % 3 = 0) AS with_link, count(*) FILTER (s_suppkey % 2 = 0) AS with_note, count(*) FILTER (s_suppkey % 6 = 0) AS with_both,
           count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0) AS note_without_link, count(*) FILTER (s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0) AS url_in_note_only FROM supplier""")
def link_counters(spark, sf):
    k = F.col("s_suppkey")
    rows = _t(spark, sf, "supplier").select(F.when(k % 4 == 0, "at https://x.org/a.").when(k % 2 == 0, "text").alias("note"), F.lit("").alias("url"), F.when(k % 3 == 0, "10.1/x").alias("doi"))
    return notes.link_counters(rows, "note", "url", "doi")


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'invalid' WHEN p_partkey % 5 = 1 THEN 'invalid' WHEN p_partkey % 5 = 2 THEN 'mismatch' WHEN p_partkey % 5 = 3 THEN 'verified_with_warning' ELSE 'verified' END AS status,
           CASE WHEN p_partkey % 5 = 0 THEN 'no_identifier' WHEN p_partkey % 5 = 1 THEN 'doi_format' WHEN p_partkey % 5 = 2 THEN 'doi_differs_from_url' ELSE 'registry' END AS rule, CASE WHEN p_partkey % 5 = 3 THEN 'publisher' ELSE '' END AS conflicts FROM part""")
def verified_records(spark, sf):
    part, k = _t(spark, sf, "part"), F.col("p_partkey") % 5
    own = F.concat(F.lit("10.1234/"), F.col("p_partkey").cast("string"))
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    records = part.select(
        "p_partkey", F.array("p_name").alias("titles"), F.lit("Doe, J").alias("author"), F.lit("2001").alias("year"), F.when(k == 0, "").when(k == 1, "11.x").otherwise(own).alias("doi"), F.when(k == 2, "https://doi.org/10.1234/other").otherwise("").alias("url"),
        F.lit("article").alias("item_type"), F.col("p_brand").alias("publisher"), *blank("journal", "volume", "issue", "pages", "isbn", "issn"),
    )
    registry = part.select(
        own.alias("doi"), F.col("p_name").alias("title"), F.col("p_name").alias("main_title"), F.lit("").alias("subtitle"), F.array(F.lit("Doe")).alias("authors"), F.array(F.lit(2002)).alias("years"),
        F.lit("article").alias("item_family"), F.when(k == 3, "Zzz").otherwise(F.col("p_brand")).alias("publisher"), *blank("journal", "volume", "issue", "pages", "isbn", "issn"),
    )
    return verify.verify_primary(records, "p_partkey", registry).select("p_partkey", "status", "rule", F.array_join("conflicts", "; ").alias("conflicts"))


@query("SELECT o_custkey AS record, o_orderkey AS cand_pos, round(o_totalprice / 5000, 2) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 5000, 2) DESC, o_orderkey)::INT AS place FROM orders")
def ranked_candidates(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("cand_pos"), F.round(F.col("o_totalprice") / 5000, 2).alias("score"), F.lit(0).alias("source_rank"))
    return resolve.ranked(rows, "record").select("record", "cand_pos", "score", "place")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 3 = 1 THEN 'not_accepted' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'Approved' WHEN o_orderkey % 3 = 1 THEN 'Rejected' END AS decision FROM orders")
def reviewed_records(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    k = F.col("o_orderkey") % 3
    reviews = _t(spark, sf, "orders").where(k < 2).select("o_orderkey", F.when(k == 0, "Accepted").otherwise("Not accepted").alias("choice"))
    return schema.overlay_reviews(orders, "o_orderkey", reviews)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FILTER (o_orderstatus IN ('F', 'O')) FROM orders")
def status_totals(spark, sf):
    return schema.status_counts(_t(spark, sf, "orders"), "o_orderstatus", ("F", "O"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS shown FROM customer")
def first_filled_cells(spark, sf):
    df = _t(spark, sf, "customer").withColumn("Segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  "))
    return df.select("c_custkey", schema.value_of(df, "segment", "c_name").alias("shown"))


@query("SELECT count(*) FILTER (c_acctbal >= 0) AS to_look_up, count(*) FILTER (c_acctbal < 0) AS complete FROM customer")
def lookup_scope(spark, sf):
    df = _t(spark, sf, "customer")
    todo, done = resolve.scope(df, F.when(F.col("c_acctbal") < 0, "10.1/x"), F.when(F.col("c_acctbal") < 0, "http://x"), "missing_only")
    return todo.agg(F.count(F.lit(1)).alias("to_look_up")).crossJoin(done.agg(F.count(F.lit(1)).alias("complete")))


@query("""
    WITH n AS (SELECT n_regionkey, n_name FROM nation), t AS (SELECT n_regionkey, n_name, length(n_name) AS l FROM n)
    SELECT n_regionkey AS tag, max(k) AS records, max(CASE WHEN m = 'a' THEN r END) AS a, max(CASE WHEN m = 'b' THEN r END) AS b
    FROM (SELECT n_regionkey, 'a' AS m, count(*) AS k, avg(l) AS r FROM t GROUP BY 1 UNION ALL SELECT n_regionkey, 'b', count(*), max(l)::DOUBLE FROM t GROUP BY 1) GROUP BY 1""")
def recall_pivot(spark, sf):
    t = _t(spark, sf, "nation").select(F.col("n_regionkey").alias("tag"), F.length("n_name").alias("l"))
    a = t.groupBy("tag").agg(F.count(F.lit(1)).alias("records"), F.avg("l").alias("recall")).withColumn("model", F.lit("a"))
    b = t.groupBy("tag").agg(F.count(F.lit(1)).alias("records"), F.max("l").cast("double").alias("recall")).withColumn("model", F.lit("b"))
    return evaluate.recall_pivot(a.unionByName(b), ["a", "b"])
