"""Scans, sinks, timers and the stream of queries."""

import random

from lexigrid.operators.metrics import Metrics
from lexigrid.operators import trie
from lexigrid.operators.index import WordIndex
from lexigrid.sources import words as sources
from lexigrid.streaming.queries import answer_stream


def test_word_list_and_weights(spark, tmp_path):
    (tmp_path / "w.txt").write_text("one two\n\n  three\tfour \n")
    assert sorted(r.word for r in sources.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["four", "one", "three", "two"]
    (tmp_path / "k.txt").write_text(" ".join(["0.5"] * 26) + "\na a 0\na b 5\n")
    head, body = sources.read_weights(spark, str(tmp_path / "k.txt"))
    assert len(head) == 26 and {(r.from_ch, r.to_ch, r.dist) for r in body.collect()} == {("a", "a", 0.0), ("a", "b", 5.0)}


def test_measurement_log(spark, tmp_path):
    (tmp_path / "m.txt").write_text("index dataset #it key value\n  0  dic_de   1  total  2.5\n  1 dic_en 0 total 3\n")
    log = sources.read_measurements(spark, str(tmp_path / "m.txt"))
    assert log.columns == ["index", "dataset", "iteration", "key", "value"] and sum(r.value for r in log.collect()) == 5.5
    sources.write_fixed_width(log, str(tmp_path / "out"), 8)
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_parts_cover_the_words(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(21)], "word string")
    sizes = [r["count"] for r in sources.cumulative_parts(words).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [3] * 7


def test_trie_properties(spark):
    words = spark.createDataFrame([("ab",), ("abc",), ("b",), ("",), (None,), ("ab",)], "word string")
    index = WordIndex.build(words)
    nodes = index.nodes().orderBy("node_id").collect()
    assert [(n.prefix, n.parent_id, n.is_word) for n in nodes] == [("", None, True), ("a", 0, False), ("b", 0, True), ("ab", 1, True), ("abc", 3, True)]
    assert {r.prefix: r.n_descendants for r in index.descendants().collect()} == {"": 4, "a": 2, "ab": 1, "abc": 0, "b": 0}
    assert {(r.node_id, r.child_begin, r.child_end) for r in index.child_ranges().collect()} == {(0, 1, 3), (1, 3, 4), (3, 4, 5)}
    assert {r.prefix: r.is_word for r in trie.nodes(words).collect()} == {n.prefix: n.is_word for n in nodes}
    nothing = WordIndex.build(words.where("word is null"))
    assert nothing.nodes().count() == 0 and nothing.search([(0, "a", 3)]).count() == 0


def test_trie_over_many_ranges(spark):
    r = random.Random(3)
    for alphabet in ("ab", "aé漢z"):
        words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(400)})
        index = WordIndex.build(spark.createDataFrame([(w,) for w in words], "word string").repartition(7))
        known = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(known)}
        got = index.nodes().collect()
        assert {(n.prefix, n.node_id, n.parent_id, n.is_word) for n in got} == {(p, i, number[p[:-1]] if p else None, p in words) for p, i in number.items()} and len(got) == len(known)
        assert sorted(x.word for x in index.words.collect()) == words


def test_hold_out_and_logs(spark, tmp_path, capsys):
    words = spark.createDataFrame([(f"w{i}",) for i in range(60)], "word string")
    chosen, rest = sources.hold_out(words)
    kinds = {r.word: r.query_type for r in chosen.collect()}
    left = {r.word for r in rest.collect()}
    assert len(left) == 35 and all((w in left) == (kinds.get(w) != "erased") for w in (f"w{i}" for i in range(60))) and len(kinds) == 50
    a, b = spark.createDataFrame([(1, 2.0)], "idx int, value double"), spark.createDataFrame([(2, 3.0, "x")], "idx int, value double, query_type string")
    assert {(r.idx, r.query_type) for r in sources.tee(sources.union_logs(a, b), str(tmp_path / "log")).collect()} == {(1, None), (2, "x")}
    assert "3.0" in capsys.readouterr().out
    far = spark.createDataFrame([("a", "b", 5), ("a", "a", 0)], "from_ch string, to_ch string, dist int")
    sources.write_weights(far, [0.25] * 26, str(tmp_path / "weights"))
    head, body = sources.read_weights(spark, str(tmp_path / "weights"))
    assert head == [0.25] * 26 and {(r.from_ch, r.to_ch, r.dist) for r in body.collect()} == {("a", "b", 5.0), ("a", "a", 0.0)}


def test_timers_nest(spark):
    m = Metrics()
    with m.measure("outer"):
        with m.measure("inner"):
            m.add("nodes", 3)
    assert [r.key for r in m.rows(spark).collect()] == ["outer", "outer/inner", "nodes"]


def test_stream(spark, tmp_path):
    words = spark.createDataFrame([("house",), ("mouse",)], "word string")
    spark.createDataFrame([(1, "hause", 1)], "query_id long, query string, n int").write.json(str(tmp_path / "in"))
    got = []
    stream = answer_stream(spark.readStream.schema("query_id long, query string, n int").json(str(tmp_path / "in")), words, lambda df, _: got.extend(r.word for r in df.collect()))
    stream.processAllAvailable()
    stream.stop()
    assert got == ["house"]
