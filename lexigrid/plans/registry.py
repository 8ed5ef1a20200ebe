"""Registered queries of the dictionary-search engine and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import metrics, search, trie
from ..operators.index import WordIndex, index_of
from ..sources import words as sources
from . import analytics

#: The misspelt queries that the registered searches answer: (query_id, query, n).
QUERY = [(0, "alforuhm", 10)]
BATCH = [(0, "alforuhm", 10), (1, "onhere", 25), (2, "Eterbe", 5), (3, "zz", 3)]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.words_of(_docs(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> WordIndex:
    """The stored index of the documents' words, built once per application."""
    return index_of(dictionary(spark, sf_dir), sf_dir)


def _search(queries, **options):
    return lambda spark, sf_dir: index(spark, sf_dir).search(queries, **options)


def _over_words(operator):
    return lambda spark, sf_dir: operator(dictionary(spark, sf_dir))


def _over_nodes(operator):
    return lambda spark, sf_dir: operator(index(spark, sf_dir).nodes())


def _report(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
        return spark.sql(analytics.report_sql(name))

    return run


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = costs.key_distances()
    rows = [(chr(97 + a), chr(97 + b), int(far[a, b])) for a in range(26) for b in range(26)]
    return spark.createDataFrame(rows, "from_ch string, to_ch string, dist int")


def _scaled(value: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _keys(spark, sf_dir).withColumn("dist", F.greatest("dist", F.lit(1))).withColumn("v", F.expr(value))
        mean = rows.agg(F.avg("v").alias("mean"))
        return rows.crossJoin(F.broadcast(mean)).select("from_ch", "to_ch", F.round(F.col("v") / F.col("mean"), 6).alias("weight"))

    return run


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.cumulative_parts(dictionary(spark, sf_dir)).groupBy("part").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


def _query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.hold_out(dictionary(spark, sf_dir))[0]


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.hold_out(dictionary(spark, sf_dir))[1]


def _table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The misspelt queries as a table, with ids beyond 32 bits."""
    queries = spark.createDataFrame([(q + 2**40, query, n) for q, query, n in BATCH], "query_id long, query string, n int")
    return search.fuzzy_join(index(spark, sf_dir).words, queries)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = index(spark, sf_dir)
    return search.compare_ranked(own.search(BATCH, plan="brute"), own.search(BATCH))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = index(spark, sf_dir).nodes().where("is_word").select(F.col("prefix").alias("word"))
    probes = known.unionByName(known.select(F.concat("word", F.lit("zq")).alias("word"))).distinct()
    found = probes.join(known.withColumn("hit", F.lit(True)), "word", "left").select(F.coalesce("hit", F.lit(False)).alias("found"))
    return found.groupBy("found").agg(F.count("*").alias("n_words"))


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir).select(F.levenshtein("word", F.lit("alforuhm")).alias("distance"), "word").orderBy("distance", "word").limit(10)


QUERIES = {
    "fuzzy_topk": _search(QUERY, plan="brute"),
    "fuzzy_topk_trie": _search(QUERY),
    "fuzzy_topk_trie_noprune": _search(QUERY, prune=False),
    "fuzzy_topk_batch": _search(BATCH),
    "fuzzy_topk_german": _search(QUERY, model="german"),
    "fuzzy_topk_german_compat": _search(QUERY, model="german_compat"),
    "fuzzy_topk_simple_cost": _search(QUERY, model="simple"),
    "unit_levenshtein_topk": _unit,
    "word_costs": _over_words(search.word_costs),
    "dictionary_distinct": dictionary,
    "dictionary_partitions": _parts,
    "query_sets": _query_sets,
    "random_queries": lambda spark, sf_dir: sources.random_queries(spark, 25),
    "fuzzy_topk_table": _table_search,
    "result_comparison": _compared,
    "search_counts": lambda spark, sf_dir: index(spark, sf_dir).search_counts(BATCH),
    "dictionary_without_erased": _held_out,
    "trie_nodes": _over_nodes(lambda n: n.select("node_id", "prefix", "depth", "ch", "parent", "is_word")),
    "trie_parents": _over_nodes(lambda n: n.select("node_id", "parent_id")),
    "trie_node_count": _over_nodes(lambda n: n.agg(F.count("*").alias("n_nodes"))),
    "trie_depth_histogram": _over_nodes(lambda n: n.groupBy("depth").agg(F.count("*").alias("n_nodes"))),
    "trie_childless": _over_nodes(lambda n: n.join(n.select(F.col("parent_id").alias("node_id")).where("node_id is not null"), "node_id", "left_anti").select("node_id", "prefix")),
    "trie_child_ranges": lambda spark, sf_dir: index(spark, sf_dir).child_ranges(),
    "trie_descendants": lambda spark, sf_dir: index(spark, sf_dir).descendants(),
    "trie_words": _over_nodes(lambda n: n.where("is_word").select(F.col("prefix").alias("word"))),
    "trie_prefixes_by_shuffle": _over_words(lambda w: trie.nodes(w).select("prefix", "is_word")),
    "trie_membership": _membership,
    "dictionary_sorted": lambda spark, sf_dir: index(spark, sf_dir).words.orderBy("word"),
    "document_bytes": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")),
    "keyboard_distances": _keys,
    "keyboard_histogram": lambda spark, sf_dir: _keys(spark, sf_dir).groupBy("dist").agg(F.count("*").alias("n_pairs")),
    "keyboard_average": lambda spark, sf_dir: _keys(spark, sf_dir).agg(F.round(F.avg("dist"), 6).alias("mean_dist"), F.max("dist").alias("most")),
    "keyboard_linear": _scaled("2 - 2 * dist / 9"),
    "keyboard_neighbors": _scaled("CASE WHEN dist = 1 THEN 2.0D ELSE 1.0D END"),
    "run_matrix": lambda spark, sf_dir: analytics.run_matrix(spark),
    "bench_lowess": lambda spark, sf_dir: metrics.lowess(_report("bench_two_metrics")(spark, sf_dir).where("total is not null"), "impl", "query_size", "total").select("impl", "x", F.round("smooth", 6).alias("smooth")),
    **{name: _report(name) for name in analytics.REPORTS},
}

_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)"
_NODES = f"{_WORDS}, s AS (SELECT word, unnest(range(0, length(word) + 1)) AS depth FROM w), t AS (SELECT left(word, depth) AS prefix, bool_or(depth = length(word)) AS is_word FROM s GROUP BY 1)"
_NUMBERED = f"{_NODES}, g AS (SELECT CAST(row_number() OVER (ORDER BY length(prefix), prefix) - 1 AS BIGINT) AS node_id, prefix, CAST(length(prefix) AS INT) AS depth, right(prefix, 1) AS ch, CASE WHEN length(prefix) > 0 THEN left(prefix, length(prefix) - 1) END AS parent, is_word FROM t)"


def _search_sql(queries, model: str = "english") -> str:
    """Recursion over word positions with the distance row as a list; one branch per query."""
    costs_ = costs.preset(model)
    letters = [*range(65, 91), *range(97, 123)]
    parts, ctes = [], []
    for q, query, n in queries:
        modify, run = costs_.for_query(query)
        listed = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in map(float, xs)) + "]"
        table = ", ".join(f"('{chr(c)}', {float(costs_.insert[c])!r}::DOUBLE, {listed(modify[c])})" for c in letters)
        m = len(query)
        low = "list_transform(range(1, {m} + 2), lambda j: CASE WHEN j = 1 THEN d[1] + ins ELSE least(d[j] + ins, d[j - 1] + mods[j - 1]) END - {run}[j])".format(m=m, run=listed(run))
        ctes.append(f"c{q}(ch, ins, mods) AS (VALUES {table})")
        ctes.append(
            f"r{q}(word, i, d) AS (SELECT word, 0, {listed(run)} FROM w UNION ALL SELECT word, i + 1, list_transform(range(1, {m} + 2), lambda k: list_min(b[1:k]) + {listed(run)}[k]) FROM (SELECT r.word, r.i, {low} AS b FROM r{q} r JOIN c{q} c ON c.ch = substr(r.word, r.i + 1, 1)) x)"
        )
        parts.append(f"SELECT * FROM (SELECT CAST({q} AS BIGINT) AS query_id, CAST(row_number() OVER (ORDER BY round(d[{m + 1}], 6), word) AS INT) AS rank, round(d[{m + 1}], 6) AS distance, word FROM r{q} WHERE i = length(word)) y WHERE rank <= {n}")
    return f"WITH RECURSIVE {_WORDS}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def _costs_sql() -> str:
    model = costs.preset("english")
    table = ", ".join(f"('{chr(c)}', {float(model.insert[c])!r}::DOUBLE, {float(model.remove[c])!r}::DOUBLE)" for c in [*range(65, 91), *range(97, 123)])
    return f"WITH {_WORDS}, c(ch, i, r) AS (VALUES {table}), l AS (SELECT word, unnest(string_split(word, '')) AS ch FROM w) SELECT word, round(sum(i), 6) AS insert_cost, round(sum(r), 6) AS remove_cost FROM l JOIN c USING (ch) GROUP BY word"


def _keys_sql(select: str) -> str:
    edges = ", ".join(f"('{a}', '{b}')" for a, b in costs.key_edges())
    return f"WITH RECURSIVE e(a, b) AS (VALUES {edges}), p(a, b, d) AS (SELECT DISTINCT a, a, 0 FROM e UNION SELECT p.a, e.b, p.d + 1 FROM p JOIN e ON p.b = e.a WHERE p.d < 9), k AS (SELECT a AS from_ch, b AS to_ch, CAST(min(d) AS INT) AS dist FROM p GROUP BY 1, 2) {select}"


_SCALED = "SELECT from_ch, to_ch, round(v / avg(v) OVER (), 6) AS weight FROM (SELECT from_ch, to_ch, {v} AS v FROM k) x"
_SETS = "r AS (SELECT word, row_number() OVER (ORDER BY md5(word) DESC, word DESC) AS place FROM w)"
_RANDOM = "SELECT query_id, string_agg(chr(CAST(97 + (ascii(substr(h, 1, 1)) * 7 + ascii(substr(h, 2, 1)) * 3 + ascii(substr(h, 3, 1))) % 26 AS INT)), '' ORDER BY i) AS query FROM (SELECT query_id, i, md5('1:' || query_id || ':' || i) AS h FROM (SELECT query_id, unnest(range(1, (query_id + 1) * 4 + 1)) AS i FROM (SELECT unnest(range(0, 25)) AS query_id) a) b) c GROUP BY query_id"
_LOWESS = f"""WITH t AS ({analytics.report_sql("bench_two_metrics")}), p AS (SELECT impl, CAST(query_size AS DOUBLE) AS x, avg(total) AS y FROM t WHERE total IS NOT NULL GROUP BY 1, 2),
  q AS (SELECT a.impl, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d FROM p a JOIN p b ON a.impl = b.impl),
  k AS (SELECT impl, x0, list_sort(list(d))[CAST(greatest(2, least(count(*), ceil(count(*) * (2::DOUBLE / 3)))) AS INT)] AS far FROM q GROUP BY impl, x0),
  w AS (SELECT q.*, pow(greatest(1 - pow(d / greatest(far, 1e-12), 3), 0), 3) + 1e-12 AS w FROM q JOIN k ON k.impl = q.impl AND k.x0 = q.x0),
  c AS (SELECT impl, x0, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY impl, x0),
  s AS (SELECT w.impl, w.x0, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w) AS xy, sum(w * (x - mx) * (x - mx)) / sum(w) AS xx FROM w JOIN c ON c.impl = w.impl AND c.x0 = w.x0 GROUP BY w.impl, w.x0)
  SELECT impl, x0 AS x, round(my + xy / greatest(xx, 1e-12) * (x0 - mx), 6) AS smooth FROM s"""
_ENGLISH = _search_sql(QUERY)
ORACLE_SQL = {
    "fuzzy_topk": _ENGLISH,
    "fuzzy_topk_trie": _ENGLISH,
    "fuzzy_topk_trie_noprune": _ENGLISH,
    "fuzzy_topk_batch": _search_sql(BATCH),
    "fuzzy_topk_german": _search_sql(QUERY, "german"),
    "fuzzy_topk_german_compat": _search_sql(QUERY, "german_compat"),
    "fuzzy_topk_simple_cost": _search_sql(QUERY, "simple"),
    "unit_levenshtein_topk": f"WITH {_WORDS} SELECT CAST(levenshtein(word, 'alforuhm') AS INT) AS distance, word FROM w ORDER BY 1, 2 LIMIT 10",
    "word_costs": _costs_sql(),
    "dictionary_distinct": f"WITH {_WORDS} SELECT word FROM w",
    "dictionary_partitions": f"WITH {_WORDS}, r AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS place, count(*) OVER () AS total FROM w) SELECT CAST(floor(place / ceil(total / 8)) AS INT) AS part, count(*) AS n_words, min(word) AS first_word, max(word) AS last_word FROM r GROUP BY 1",
    "query_sets": f"WITH {_WORDS}, {_SETS} SELECT word, CASE WHEN place <= 25 THEN 'erased' ELSE 'existing' END AS query_type FROM r WHERE place <= 50",
    "dictionary_without_erased": f"WITH {_WORDS}, {_SETS} SELECT word FROM r WHERE place > 25",
    "fuzzy_topk_table": f"SELECT query_id + 1099511627776 AS query_id, rank, distance, word FROM ({_search_sql(BATCH)}) b",
    "result_comparison": f"SELECT query_id, rank, true AS same_word, true AS same_distance FROM ({_search_sql(BATCH)}) b",
    "run_matrix": analytics.RUN_MATRIX_SQL,
    "bench_lowess": _LOWESS,
    "random_queries": _RANDOM,
    "trie_parents": f"WITH {_NUMBERED} SELECT c.node_id, p.node_id AS parent_id FROM g c LEFT JOIN g p ON c.parent = p.prefix",
    "trie_childless": f"WITH {_NUMBERED} SELECT node_id, prefix FROM g WHERE prefix NOT IN (SELECT parent FROM g WHERE parent IS NOT NULL)",
    "trie_prefixes_by_shuffle": f"WITH {_NODES} SELECT prefix, is_word FROM t",
    "dictionary_sorted": f"WITH {_WORDS} SELECT word FROM w ORDER BY word",
    "document_bytes": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents",
    "trie_nodes": f"WITH {_NUMBERED} SELECT node_id, prefix, depth, ch, parent, is_word FROM g",
    "trie_node_count": f"WITH {_NODES} SELECT count(*) AS n_nodes FROM t",
    "trie_depth_histogram": f"WITH {_NODES} SELECT CAST(length(prefix) AS INT) AS depth, count(*) AS n_nodes FROM t GROUP BY 1",
    "trie_child_ranges": f"WITH {_NUMBERED} SELECT p.node_id, min(c.node_id) AS child_begin, max(c.node_id) + 1 AS child_end FROM g p JOIN g c ON c.parent = p.prefix GROUP BY 1",
    "trie_descendants": f"WITH {_NODES}, u AS (SELECT prefix AS below, unnest(range(0, length(prefix) + 1)) AS d FROM t) SELECT left(below, d) AS prefix, CAST(count(*) - 1 AS BIGINT) AS n_descendants FROM u GROUP BY 1",
    "trie_words": f"WITH {_WORDS} SELECT word FROM w",
    "trie_membership": f"WITH {_WORDS}, p AS (SELECT word FROM w UNION SELECT word || 'zq' FROM w) SELECT found, count(*) AS n_words FROM (SELECT p.word IN (SELECT word FROM w) AS found FROM p) x GROUP BY 1",
    "keyboard_distances": _keys_sql("SELECT from_ch, to_ch, dist FROM k"),
    "keyboard_histogram": _keys_sql("SELECT dist, count(*) AS n_pairs FROM k GROUP BY 1"),
    "keyboard_average": _keys_sql("SELECT round(avg(dist), 6) AS mean_dist, max(dist) AS most FROM k"),
    "keyboard_linear": _keys_sql(_SCALED.format(v="2 - 2 * greatest(dist, 1) / 9")),
    "keyboard_neighbors": _keys_sql(_SCALED.format(v="CASE WHEN greatest(dist, 1) = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")),
    **{name: analytics.report_sql(name) for name in analytics.REPORTS},
}


def measured(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Run queries to their counts under the timer and return the measurement rows."""
    m = metrics.Metrics()
    for name in names:
        with m.measure(name):
            m.add(f"{name}/rows", QUERIES[name](spark, sf_dir).count())
    return m.rows(spark)


