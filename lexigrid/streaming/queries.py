"""A stream of queries against a fixed dictionary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import fuzzy_join


def answer_stream(queries: DataFrame, words: DataFrame, sink: Callable[[DataFrame, int], None], model: str = "english", most: int = 1000, **writer) -> StreamingQuery:
    """Answer every micro-batch of (query_id, query, n) with one call of the sink; queries go to the tasks in blocks of about ``most``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(fuzzy_join(words, batch, model, most=most), number)

    stream = queries.writeStream.foreachBatch(each)
    for key, value in writer.items():
        stream = stream.option(key, value)
    return stream.start()
