"""Dictionaries, queries, weight files and measurement logs as DataFrames, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct runs of ASCII letters."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")).distinct()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated tokens of text files: word."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''")


read_queries = read_word_list


def read_weights(spark: SparkSession, path: str) -> tuple[list[float], DataFrame]:
    """(letter frequencies, (from_ch, to_ch, dist)) of a weight file: a line of numbers, then 676 lines of pairs."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    head = parts.where(F.size("p") > 3).select("p").head()
    body = parts.where(F.size("p") == 3).select(F.col("p")[0].alias("from_ch"), F.col("p")[1].alias("to_ch"), F.col("p")[2].cast("double").alias("dist"))
    return [float(x) for x in head.p] if head else [], body


def random_queries(spark: SparkSession, count: int, length_step: int = 4, seed: int = 1) -> DataFrame:
    """query_id, query: lower-case strings of length step, 2 * step, ... from hashes of (seed, id, place)."""
    ids = spark.range(count).withColumnRenamed("id", "query_id")

    def letter(i):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), i.cast("string")))
        return F.chr(F.lit(97) + (F.ascii(F.substring(h, 1, 1)) * 7 + F.ascii(F.substring(h, 2, 1)) * 3 + F.ascii(F.substring(h, 3, 1))) % 26)

    return ids.withColumn("query", F.concat_ws("", F.transform(F.sequence(F.lit(1), (F.col("query_id") + 1) * length_step), letter)))


def hold_out(words: DataFrame, erased: int = 25, existing: int = 25) -> tuple[DataFrame, DataFrame]:
    """(word, query_type of the query words; the words without the erased ones): the last words in hash order are
    erased from the dictionary, those before them stay in it."""
    from pyspark.sql import Window as W

    last = words.select("word", F.md5("word").alias("h")).orderBy(F.desc("h"), F.desc("word")).limit(erased + existing)
    place = F.row_number().over(W.orderBy(F.desc("h"), F.desc("word")))
    chosen = last.select("word", F.when(place <= erased, "erased").otherwise("existing").alias("query_type"))
    return chosen, words.join(F.broadcast(chosen.where("query_type = 'erased'")), "word", "left_anti")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header line and columns separated by blanks; all columns as strings but value."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r" +").alias("p"))
    names = lines.head().p
    rows = lines.where(F.col("p") != F.array(*map(F.lit, names)))
    return rows.select(*(F.col("p")[i].cast("double" if n == "value" else "string").alias("iteration" if n == "#it" else n) for i, n in enumerate(names)))


def union_logs(*logs: DataFrame) -> DataFrame:
    """One log of several; a column that one lacks is null there."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def tee(df: DataFrame, path: str, show: int = 20) -> DataFrame:
    """Write df as text lines to path, print the first ones, and return df."""
    write_fixed_width(df, path)
    print(*(r.value for r in df.sparkSession.read.text(path).limit(show).collect()), sep="\n")
    return df


def write_weights(distances: DataFrame, frequencies: list[float], path: str) -> None:
    """A weight file that ``read_weights`` reads: the frequencies, then a line of each pair (26 by 26, one task)."""
    spark = distances.sparkSession
    head = spark.createDataFrame([(0, " ".join(map(str, frequencies)))], "place int, value string")
    body = distances.orderBy("from_ch", "to_ch").select(F.lit(1).alias("place"), F.concat_ws(" ", "from_ch", "to_ch", F.col("dist").cast("string")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("place", "value").select("value").write.text(path)


def write_fixed_width(df: DataFrame, path: str, width: int = 20) -> None:
    """One line of left-padded columns per row."""
    df.select(F.concat_ws(" ", *(F.lpad(F.col(c).cast("string"), width, " ") for c in df.columns)).alias("value")).write.text(path)


def console_rows(matches: DataFrame) -> DataFrame:
    """``distance word`` lines with three decimals."""
    return matches.orderBy("rank").select(F.format_string("%.3f %s", "distance", "word").alias("value"))


def cumulative_parts(words: DataFrame, parts: int = 8) -> DataFrame:
    """word, part: the first part that holds the word, of equal slices in hash order; part i is the union up to i."""
    from pyspark.sql import Window as W

    total = words.count()
    size = -(-total // parts) or 1
    # a rank inside 256 hash prefixes plus the prefixes' sizes keeps the numbering distributed
    keyed = words.withColumn("__h", F.md5("word")).withColumn("__p", F.substring("__h", 1, 2))
    before = keyed.groupBy("__p").count().withColumn("__before", F.sum("count").over(W.orderBy("__p")) - F.col("count"))
    place = F.row_number().over(W.partitionBy("__p").orderBy("__h", "word")) - 1
    return keyed.withColumn("__r", place).join(F.broadcast(before), "__p").select("word", F.floor((F.col("__r") + F.col("__before")) / size).cast("int").alias("part"))
