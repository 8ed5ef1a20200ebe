"""Reports over measurement logs, as SQL on a view ``measurements``."""

from __future__ import annotations

#: A deterministic log derived from the event table, for both engines.
MEASUREMENTS = """
SELECT event_id AS idx,
  CASE WHEN event_id % 2 = 0 THEN 'dic_de' ELSE 'dic_en' END AS dataset,
  CAST(1000 * (1 + event_id % 8) AS BIGINT) AS words,
  CAST(event_id % 5 AS INT) AS iteration,
  CAST(CASE WHEN user_id % 6 IN (0, 2) THEN 1 WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 2 WHEN event_id % 4 = 2 THEN 4 ELSE 8 END AS INT) AS threads,
  CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 100 END AS INT) AS n,
  CAST(4 * (1 + user_id % 25) AS INT) AS query_size,
  CASE event_id % 3 WHEN 0 THEN 'erased' WHEN 1 THEN 'existing' ELSE 'random' END AS query_type,
  CAST(event_id % 75 AS INT) AS query_idx,
  CASE user_id % 6 WHEN 0 THEN 'naive_sequential' WHEN 1 THEN 'naive_parallel' WHEN 2 THEN 'accelerated_seq_vt' WHEN 3 THEN 'accelerated_vt' WHEN 4 THEN 'accelerated_st' ELSE 'accelerated_pt' END AS impl,
  CASE event_id % 4 WHEN 0 THEN 't_insert' WHEN 1 THEN 't_bfs' WHEN 2 THEN 't_count_children' ELSE 'l_precompute' END AS test,
  CASE WHEN event_id % 7 < 4 THEN 'time' ELSE 'statistic' END AS type,
  CASE event_id % 7 WHEN 0 THEN 'total' WHEN 1 THEN 'insert' WHEN 2 THEN 'insert/build' WHEN 3 THEN 'insert/compress' WHEN 4 THEN 'num_nodes' WHEN 5 THEN 'skipped_nodes' ELSE 'collisions' END AS metric,
  value
FROM events WHERE value IS NOT NULL
"""

_SEQUENTIAL = "('naive_sequential', 'accelerated_seq_vt')"

REPORTS = {
    "bench_mean": "SELECT dataset, threads, impl, test, metric, words, round(avg(value), 6) AS mean_value FROM m GROUP BY dataset, threads, impl, test, metric, words",
    "bench_mean_by_type": "SELECT dataset, threads, impl, test, type, metric, words, round(avg(value), 6) AS mean_value FROM m GROUP BY dataset, threads, impl, test, type, metric, words",
    "bench_mean_by_n": "SELECT dataset, words, threads, n, impl, type, metric, round(avg(value), 6) AS mean_value FROM m GROUP BY dataset, words, threads, n, impl, type, metric",
    "bench_labels": "SELECT DISTINCT dataset, impl, threads, concat(impl, ' on ', dataset, ', ', CAST(threads AS VARCHAR(10)), CASE WHEN threads = 1 THEN ' thread' ELSE ' threads' END) AS label FROM m",
    "bench_next_powers": "SELECT DISTINCT query_size, CAST(CASE WHEN query_size <= 1 THEN 1 ELSE pow(2, length(bin(query_size - 1))) END AS BIGINT) AS next_power FROM m",
    "bench_repeats": "SELECT impl, count(DISTINCT iteration) AS n_runs, round(avg(run_mean), 6) AS mean_value FROM (SELECT impl, iteration, avg(value) AS run_mean FROM m WHERE metric = 'total' GROUP BY impl, iteration) r GROUP BY impl",
    "bench_sorted_words": "SELECT dataset, words, CAST(row_number() OVER (PARTITION BY dataset ORDER BY words) AS INT) AS place FROM (SELECT DISTINCT dataset, words FROM m) d ORDER BY dataset, words",
    "bench_std": "SELECT dataset, words, threads, n, impl, query_idx, query_type, metric, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value FROM m GROUP BY dataset, words, threads, n, impl, query_idx, query_type, metric",
    "bench_speedup": """SELECT a.dataset, a.threads, a.impl, round(b.base / a.mean_value, 6) AS speedup
        FROM (SELECT dataset, threads, impl, avg(value) AS mean_value FROM m WHERE metric = 'total' GROUP BY dataset, threads, impl) a
        JOIN (SELECT dataset, avg(value) AS base FROM m WHERE metric = 'total' AND impl = 'naive_sequential' GROUP BY dataset) b ON a.dataset = b.dataset
        WHERE a.mean_value <> 0""",
    "bench_efficiency": f"""SELECT a.dataset, a.threads, a.impl, round(b.base / a.mean_value / a.threads, 6) AS efficiency
        FROM (SELECT dataset, threads, impl, avg(value) AS mean_value FROM m WHERE metric = 'total' AND impl NOT IN {_SEQUENTIAL} GROUP BY dataset, threads, impl) a
        JOIN (SELECT dataset, avg(value) AS base FROM m WHERE metric = 'total' AND impl = 'naive_sequential' GROUP BY dataset) b ON a.dataset = b.dataset
        WHERE a.mean_value <> 0""",
    "bench_parts_pivot": """SELECT impl, coalesce(round(avg(CASE WHEN metric = 'insert' THEN value END), 6), 0) AS insert_ms,
        coalesce(round(avg(CASE WHEN metric = 'insert/build' THEN value END), 6), 0) AS build_ms,
        coalesce(round(avg(CASE WHEN metric = 'insert/compress' THEN value END), 6), 0) AS compress_ms
        FROM m WHERE type = 'time' GROUP BY impl""",
    "bench_ci": "SELECT dataset, words, impl, round(avg(value), 6) AS mean_value, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM m WHERE metric = 'total' GROUP BY dataset, words, impl",
    "bench_seq_replicated": f"""SELECT dataset, impl, threads, count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM (
        SELECT dataset, impl, threads, value FROM m UNION ALL
        SELECT s.dataset, s.impl, t.threads, s.value FROM m s CROSS JOIN (SELECT DISTINCT threads FROM m WHERE threads > 1) t WHERE s.impl IN {_SEQUENTIAL}
        ) u GROUP BY dataset, impl, threads""",
    "bench_compound_filter": f"SELECT idx, impl, threads, value FROM m WHERE (threads = (SELECT max(threads) FROM m) OR (threads = 1 AND impl IN {_SEQUENTIAL})) AND query_type <> 'random' AND impl LIKE '%accelerated%' AND test NOT IN ('t_insert', 't_count_children')",
    "bench_argmax_words": "SELECT m.dataset, m.impl, m.idx, m.value FROM m JOIN (SELECT dataset, max(words) AS most FROM m GROUP BY dataset) x ON m.dataset = x.dataset AND m.words = x.most",
    "bench_distinct_words": "SELECT DISTINCT dataset, words FROM m",
    "bench_counts": "SELECT CAST(max(iteration) + 1 AS INT) AS iterations, CAST(max(query_idx) + 1 AS INT) AS queries, max(n) AS most_n FROM m",
    "bench_two_metrics": """SELECT dataset, impl, query_size, round(avg(CASE WHEN metric = 'total' THEN value END), 6) AS total, round(avg(CASE WHEN metric = 'skipped_nodes' THEN value END), 6) AS skipped_nodes
        FROM m WHERE metric IN ('total', 'skipped_nodes') GROUP BY dataset, impl, query_size""",
    "bench_num_nodes": "SELECT dataset, words, round(avg(value), 6) AS num_nodes FROM m WHERE metric = 'num_nodes' GROUP BY dataset, words",
    "bench_error_bars": "SELECT impl, query_size, round(avg(value), 6) AS mean_value, round(avg(value) - stddev_pop(value), 6) AS low, round(avg(value) + stddev_pop(value), 6) AS high FROM m WHERE metric = 'total' GROUP BY impl, query_size",
    "bench_counter_sums": "SELECT metric, round(sum(value), 4) AS total FROM m WHERE type = 'statistic' GROUP BY metric",
    "bench_run_matrix": "SELECT d.dataset, p.words, i.iteration, t.threads FROM (SELECT DISTINCT dataset FROM m) d CROSS JOIN (SELECT DISTINCT words FROM m) p CROSS JOIN (SELECT DISTINCT iteration FROM m) i CROSS JOIN (SELECT DISTINCT threads FROM m) t WHERE p.words = 8000 OR t.threads = 8",
    "timer_paths": "SELECT metric, CAST(length(metric) - length(replace(metric, '/', '')) + 1 AS INT) AS depth, round(sum(value), 4) AS total_ms, count(*) AS n_rows FROM m WHERE type = 'time' GROUP BY metric",
}


def report_sql(name: str) -> str:
    return f"WITH m AS ({MEASUREMENTS}) {REPORTS[name]}"

#: Fixed values of a benchmark: results asked for, the usual one, slices of the dictionary.
NS, USUAL_N, SLICES = (1, 2, 3, 5, 10, 20, 50, 100, 1000), 10, 8


def run_matrix(spark, cores: int = 8):
    """slice, threads, n of the runs that are worth making: all numbers of threads only with the whole dictionary,
    odd ones only up to half the cores, other n than the usual one only with the whole dictionary."""
    from pyspark.sql import functions as F

    runs = spark.range(SLICES).select(F.col("id").cast("int").alias("slice"))
    runs = runs.select("slice", F.explode(F.sequence(F.lit(1), F.lit(cores))).alias("threads"))
    runs = runs.select("*", F.explode(F.array(*map(F.lit, NS))).alias("n"))
    whole = F.col("slice") == SLICES - 1
    return runs.where((whole | (F.col("threads") == cores)) & ((F.col("threads") <= cores / 2) | (F.col("threads") % 2 == 0)) & (whole | (F.col("n") == USUAL_N)))


RUN_MATRIX_SQL = f"""SELECT CAST(s AS INT) AS slice, CAST(t AS INT) AS threads, n FROM (SELECT unnest(range(0, {SLICES})) AS s) a
  CROSS JOIN (SELECT unnest(range(1, 9)) AS t) b CROSS JOIN (SELECT unnest([{', '.join(map(str, NS))}]) AS n) c
  WHERE (s = {SLICES - 1} OR (t = 8 AND n = {USUAL_N})) AND (t <= 4 OR t % 2 = 0)"""
