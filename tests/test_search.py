"""Golden distances, agreement of the plans, properties of the distance, and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.functions.costs import key_distances, preset
from lexigrid.functions.distance import distances
from lexigrid.operators.index import WordIndex
from lexigrid.operators.search import compare_ranked, fuzzy_join, fuzzy_search, prefix_distances

#: Published distances to "alforuhm" under the English model.
GOLDEN = {"algorithm": 0.567, "algorism": 0.817, "aurorium": 0.867, "algorithms": 0.952, "alburnum": 0.978, "allodium": 1.089, "aphorism": 1.089, "deltidium": 1.128, "alsifilm": 1.139, "ealdormen": 1.139}
WORD = st.text(alphabet="abzAB-é", max_size=7)


def plain(word, query, model):
    """The textbook table, cell by cell."""
    code = lambda c: min(ord(c), 127)
    row = [0.0]
    for c in query:
        row.append(row[-1] + model.remove[code(c)])
    for w in word:
        new = [row[0] + model.insert[code(w)]]
        for j, c in enumerate(query, 1):
            change = 1.0 if max(ord(w), ord(c)) > 126 else model.modify[code(w), code(c)]
            new.append(min(row[j] + model.insert[code(w)], new[-1] + model.remove[code(c)], row[j - 1] + change))
        row = new
    return row[-1]


def test_golden():
    found = distances(list(GOLDEN), "alforuhm", preset("english"))
    assert dict(zip(GOLDEN, np.round(found, 3).tolist())) == pytest.approx(GOLDEN, abs=1e-9)


@pytest.mark.parametrize("name", ["english", "german", "german_compat", "simple"])
@given(words=st.lists(st.text(alphabet="abzAB-", max_size=7), min_size=1, max_size=8), query=st.text(alphabet="abzB-", max_size=6))
@settings(max_examples=40, deadline=None)
def test_plans_agree_with_the_table(name, words, query):
    model = preset(name)
    want = [plain(w, query, model) for w in words]
    assert np.allclose(distances(words, query, model), want)
    found, far, visited, total = prefix_distances(words, query, model)
    assert sorted(zip(found, np.round(far, 9))) == sorted(zip(words, np.round(want, 9)))
    assert visited == total == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_identity_and_symmetry():
    model = preset("english")
    assert distances(["same"], "same", model)[0] == 0
    assert (key_distances() == key_distances().T).all() and key_distances().max() == 9
    assert distances(["ab"], "abc", model)[0] != distances(["abc"], "ab", model)[0]


def test_search_edge_cases(spark):
    words = spark.createDataFrame([("a",), ("b",), ("ab",), ("ab",), ("",), (None,), ("éa",)], "word string").distinct()
    for plan in ("brute", "trie"):
        assert fuzzy_search(words, [(0, "ab", 0)], plan=plan).count() == 0
        rows = fuzzy_search(words, [(0, "ab", 100), (7, "b", 1)], plan=plan).collect()
        assert [r.word for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 0][0] == "ab"
        assert sum(r.query_id == 0 for r in rows) == 5
        assert [r.word for r in rows if r.query_id == 7] == ["b"]
    assert fuzzy_search(words.limit(0), [(0, "a", 3)]).count() == 0


def test_table_of_queries_and_comparison(spark):
    words = spark.createDataFrame([("house",), ("mouse",), ("moose",)], "word string")
    queries = spark.createDataFrame([(2**40, "hause", 2), (1, "mose", 1), (3, None, 1), (4, "x", 0), (5, "q", None)], "query_id long, query string, n int")
    rows = fuzzy_join(words, queries, most=1)
    got = {(r.query_id, r.rank, r.word) for r in rows.collect()}
    assert {(q, n) for q, n, _ in got} == {(2**40, 1), (2**40, 2), (1, 1)} and (2**40, 1, "house") in got
    compared = {(r.query_id, r.rank): (r.same_word, r.same_distance) for r in compare_ranked(rows, rows.where("rank = 1").replace("house", "mouse", "word")).collect()}
    assert compared == {(2**40, 1): (False, True), (2**40, 2): (False, False), (1, 1): (True, True)}


def test_index_prunes_and_agrees(spark):
    import random

    r = random.Random(4)
    words = spark.createDataFrame([("".join(r.choice("abcde") for _ in range(r.randint(1, 8))),) for _ in range(3000)], "word string").distinct()
    index, queries = WordIndex.build(words), [(0, "abcde", 5), (1, "eeaab", 40)]
    want = sorted(fuzzy_search(words, queries, plan="brute").collect())
    assert sorted(index.search(queries).collect()) == want == sorted(index.search(queries, prune=False).collect())
    few, every = (sum(x.visited_nodes for x in index.search_counts(queries, prune=p).collect()) for p in (True, False))
    assert few < every / 2


def test_unknown_model():
    with pytest.raises(ValueError):
        preset("klingon")
