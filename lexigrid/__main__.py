"""``python -m lexigrid WORDS QUERY``: the nearest words of a word list, or ``--report DIR`` for all reports."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

#: Cost models by language.
LANGUAGES = {"de": "german", "en": "english"}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lexigrid")
    parser.add_argument("source", help="text files of words, or a folder of tables with --report")
    parser.add_argument("query", nargs="?", help="the word to look for")
    parser.add_argument("-n", type=int, default=10, help="how many words")
    parser.add_argument("--lang", default="de", help="de or en")
    parser.add_argument("--plan", choices=("trie", "brute"), default="trie")
    parser.add_argument("--repeat", type=int, default=1, help="runs whose time is averaged")
    parser.add_argument("--report", metavar="DIR", help="write every report below DIR")
    found = parser.parse_args(argv)
    if found.lang not in LANGUAGES:
        parser.error(f"unknown lang: {found.lang}")
    if not found.report and found.query is None:
        parser.error("a query is needed")
    return found


def main(argv: list[str] | None = None) -> int:
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    from .operators.index import WordIndex
    from .operators.metrics import Metrics
    from .plans.runs import write_reports
    from .sources.words import console_rows, read_word_list

    wanted = arguments(argv)
    spark = SparkSession.builder.appName("lexigrid").getOrCreate()
    if wanted.report:
        path, failed = write_reports(spark, wanted.source, wanted.report)
        print(path, *failed, sep="\n")
        return int(bool(failed))
    metrics = Metrics()
    index = WordIndex.build(read_word_list(spark, wanted.source), metrics=metrics)
    for _ in range(max(1, wanted.repeat)):
        with metrics.measure("query"):
            rows = console_rows(index.search([(0, wanted.query, wanted.n)], LANGUAGES[wanted.lang], wanted.plan)).collect()
    print(*(r.value for r in rows), sep="\n")
    for r in metrics.rows(spark).groupBy("type", "key").avg("value").orderBy("key").collect():
        print(f"{r.key}: {r['avg(value)']:.1f} ms")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
