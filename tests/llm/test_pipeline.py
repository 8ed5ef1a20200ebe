"""The pipeline's stages on a small folder of tables, each against brute force on its own input."""

import corpus_pipeline
from lexigrid.llm import secrets, toxicity

from test_operators import PASSAGE, TEXTS, components, encode, prose, shingle_set


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in TEXTS.items()] + [(None, prose(90, 55), "en", "s", 1)]
    labels = []
    for k in range(100, 400):
        bad = k % 2
        text = prose(40, k) + " grobnik vilegrob grobnar" * bad
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, bad))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before)
            assert all(r.doc_tokens == len(encode(before[r.doc_id])) + 1 for r in pieces)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            scored = toxicity.score_toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), toxicity.trained(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))))
            assert set(after) == {r.doc_id for r in scored.collect() if not r.predicted}
            assert sum(k in after for k in range(101, 400, 2)) < 15 and sum(k in after for k in range(100, 400, 2)) > 135
        elif name == "near_duplicates":
            group = components({k: shingle_set(t) for k, t in before.items() if k is not None})
            assert set(after) == {None} | {k for k, c in group.items() if k == c}
        elif name == "decontamination":
            assert set(after) == {k for k, t in before.items() if PASSAGE not in (t or "")}
        else:
            assert set(after) == set(before)
            assert all((after[k] == t) == (not secrets.scan((t or "").encode())) for k, t in before.items())


def test_run(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}


def test_a_repeated_id_keeps_the_smallest_row(spark, tmp_path):
    rows = [(1, "b", "en"), (1, "a", "fr"), (1, "a", "en"), (2, None, "en"), (2, "x", "en"), (None, "n", "en"), (None, "n", "en")]
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string")
        out = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "en"), (2, None, "en"), (None, "n", "en"), (None, "n", "en")], key=str)
