"""Each corpus operator against brute force on a small table with the awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexigrid.llm import automaton, decontaminate, labelled, media, near_dups, packing, pii, quality, repeats, secrets, token_shards, toxicity
from lexigrid.llm.tokens import PieceEncoder, default_path

RND = random.Random(4)
VOCAB = ["the", "of", "and", *("".join(RND.choice("abdeilnorstu") for _ in range(RND.randint(2, 8))) for _ in range(300))]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
TEXTS = {
    1: BASE,
    2: BASE,
    3: BASE.replace(" of ", " OF ", 1).replace("the", "teh", 2),
    4: prose(200, 3) + PASSAGE + prose(50, 4),
    5: prose(10, 5) + PASSAGE,
    6: "",
    7: None,
    8: "word",
    9: "abc " * 400,
    10: "mail a.b@c.org, +1 (555) 123-4567, 10.0.0.1 and 4539 5787 6362 1486; call (555) 123-4567. é password = 'hunter22' AKIA" + "A1B2C3D4" * 2,
    11: "token:" + "0123456789abcdef" * 2 + " ünïcode " + "x" * 1500,
    12: prose(3000, 6),
    13: " \n\t ",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1, [1]) for k, t in TEXTS.items()] + [(None, prose(80, 7), "x", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n long, bands array<int>")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == len(TEXTS) + 1
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_library():
    r = random.Random(9)
    parts = list("ab'stredvm1½ \n\té.,!?<|>日𝔘\u0085\x1c") + ["'s", "'ll", " '", "  ", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(500)]
    ids, at = PieceEncoder(default_path())(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encode(t) for t in texts]


def test_token_shards(docs, empty):
    got, start = by_id(token_shards.token_digest(docs)), 0
    start = len(encode(prose(80, 7))) + 1  # the null id sorts first
    for k in sorted(TEXTS):
        ids = np.array([*encode(TEXTS[k]), 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_shards.token_digest(empty).count() == 0


def test_repair_round_trip_and_ranges():
    r = np.random.default_rng(1)
    ids = np.concatenate([np.tile([5, 6, 7, 8, 5, 6], 200), r.integers(0, 50, 3000), np.full(500, 9)]).astype(np.uint32)
    cut = np.array([0, 0, 1200, 1201, 4200, 4700])
    for first in (60, 70_000):
        shard = token_shards.Shard(token_shards.pack_shard(ids, cut, [1, None, 3, 4, 5], first))
        assert len(shard.rules) and len(shard.symbols) < len(ids)
        assert (shard.all_ids() == ids).all() and shard.doc_ids[1] is None
        for d in range(5):
            whole = ids[cut[d] : cut[d + 1]]
            for a, n in ((0, 3), (1, 10), (len(whole) - 2, 9)):
                assert (shard.ids(d, max(a, 0), n) == whole[max(a, 0) : max(a, 0) + n]).all()


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    windows, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array([*encode(TEXTS.get(r.doc_id, prose(80, 7))), 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        windows[r.sequence_id].append((r.offset, r.length))
        places[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    for own in places.values():
        at = 0
        for start, length, _ in sorted(own):
            assert start == at
            at += length
        assert at == own[0][2]
    assert sum(sum(n for _, n in own) < 1024 for own in windows.values()) <= 1
    assert sorted(windows) == list(range(len(windows))) and packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("low, high", [(1, 99), (60, 99), (51, 52), (70, 70)])
def test_window_plan_uses_all_lengths(low, high):
    r = random.Random(2)
    counts = Counter(r.randint(low, high) for _ in range(500))
    plan = packing.plan_windows(dict(counts), 100)
    rests = np.array(sorted(counts.elements()))
    ranks = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
    index, start, length, window, offset = packing.Places(dict(counts), plan, 7).pieces(rests, ranks)
    inside, across = defaultdict(list), defaultdict(list)
    for i, a, n, w, o in zip(*(x.tolist() for x in (index, start, length, window, offset))):
        inside[i].append((a, n))
        across[w].append((o, n))

    def gapless(parts):
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and min(n for _, n in parts) > 0
        return ends[-1]

    assert [gapless(inside[i]) for i in range(len(rests))] == rests.tolist()
    assert sorted(across) == list(range(7, 7 + sum(step.times for step in plan)))
    sums = [gapless(across[w]) for w in sorted(across)]
    assert max(sums) <= 100 and sorted(sums)[1:] == [100] * (len(sums) - 1)


def test_fill_is_closest_to_capacity():
    r = random.Random(3)
    for _ in range(200):
        counts, capacity = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}, r.randint(20, 90)
        sums = {sum(k * n for k, n in zip(counts, take)) for take in itertools.product(*(range(n + 1) for n in counts.values()))}
        chosen = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(x for x in sums if x <= capacity)
    assert packing.fill({60: 1, 45: 2, 10: 1}, 100) == {45: 2, 10: 1}


ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base_secrets(x):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(rb"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(rb"[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def digest(text, spans, names):
    points = [(len(text[:a].decode()), len(text[:b].decode()), k) for a, b, k in spans]
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, b, k in points).encode()).hexdigest()


def test_secrets(docs, empty):
    r = random.Random(5)
    parts = [b"password", b"PassWd", b"secret", b"token", b"api_key", b'"', b"'", b" ", b"=", b":", b"abc", b"AKIA", b"A1B2C3D4", b"0123456789ab", b"f", b"\xc3\xa9", b"secretoken", b".", b"ghp_" + b"a1" * 20]
    for _ in range(3000):
        x = b"".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert [s for s in secrets.scan(x) if s[2] < 3] == base_secrets(x)
    got = by_id(secrets.secrets_digest(docs))
    for k, t in TEXTS.items():
        x = (t or "").encode()
        assert got[k].base_sha256 == digest(x, base_secrets(x), ("assign", "access", "hex"))
    assert (got[10].n_assign, got[10].n_access, got[11].n_hex, got[11].n_assign) == (1, 1, 1, 1)
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert clean[7] is None and clean[1] == BASE and "hunter22" not in clean[10] and clean[10].count("[SECRET]") == 2
    assert secrets.secrets_digest(empty).count() == 0 and secrets.redact_secrets(empty).columns == docs.columns


def test_every_rule_against_re():
    r = random.Random(15)
    parts = [b"ghp_", b"a1B2" * 9, b"xoxb-", b"0-9" * 4, b"AIza", b"_-x" * 12, b"sk_live_", b"eyJ", b"eyJhbGciOi", b".", b"-----BEGIN RSA PRIVATE KEY-----", b"-----END RSA PRIVATE KEY-----", b"\r\n", b"\n", b"MIIE/+=", b" ", b"BEGIN "]
    own = [re.compile(rule.pattern.encode()) for rule in secrets.RULES]
    for _ in range(3000):
        x = b"".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        want = [(m.start(), m.end(), k) for k, rule in enumerate(secrets.RULES) for m in own[k].finditer(x) if rule.holds(m[0])]
        assert secrets.scan(x) == sorted(want, key=lambda s: (s[0], s[2]))
    key = b"a\n-----BEGIN PRIVATE KEY-----\nMIIEvQ\nab+/==\n-----END PRIVATE KEY-----\nb"
    assert secrets.scan(key) == [(2, len(key) - 2, 8)]


@pytest.mark.parametrize("x", [b"eyJA" * 250_000, b"eyJa.eyJb.eyJc." + b"x" * 1_000_000, b"ab" * 500_000, b"1" * 1_000_000, b"a.b@c.org 10.0.0.1 " * 50_000, b"password=" * 110_000, b"@+1.(" * 200_000, b"x" * 1_000_000])
def test_scans_of_long_texts_are_linear(x):
    import time

    began = time.process_time()
    secrets.scan(x)
    pii.added_spans(x, pii.base_spans(x), pii.trained())
    assert time.process_time() - began < 60


@pytest.mark.parametrize("pattern", ["a(b|cd)*e?", "[a-c]{2,3}x", "(?i:ab)+", "a.?b".replace(".", "c"), "\\x61{2,}b"])
def test_automata_match_like_re(pattern):
    own = re.compile(pattern.encode())
    r = random.Random(6)
    for _ in range(300):
        x = bytes(r.choice(b"abcdexAB") for _ in range(8))
        dfa = automaton.anchored(pattern)
        ends = [e for e in range(9) if own.fullmatch(x, 0, e)]
        assert automaton.longest(dfa, x.translate(dfa.classes), 0) == (max(ends) if ends else -1)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_near_duplicates(spark, docs, empty):
    got, sets = by_id(near_dups.near_duplicates(docs)), {k: shingle_set(t) for k, t in TEXTS.items()}
    want = components(sets)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    assert want[3] == 1
    # a family of edited copies: links at the threshold, chains and open buckets
    r, words = random.Random(8), prose(120, 9).split()
    family = {}
    for k in range(60):
        w = list(words if k % 3 or k < 3 else family[k - 3].split())
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"q{r.randrange(40)}"
        family[k] = " ".join(w)
    rows = near_dups.near_duplicates(spark.createDataFrame(list(family.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == components({k: shingle_set(t) for k, t in family.items()})
    assert near_dups.near_duplicates(empty).count() == 0


def test_near_duplicates_ends_where_nothing_is_left_to_link(spark, monkeypatch):
    passes, write = [], near_dups.materialize

    def counted(df, name):
        passes.append(name)
        assert passes.count("near-linkable") < 8, "the passes do not end"
        return write(df, name)

    monkeypatch.setattr(near_dups, "materialize", counted)
    lone = {1: prose(40, 61), 2: prose(40, 62), 3: None}
    copies = {1: prose(40, 63), 2: prose(40, 63), 3: prose(40, 63) + " end", 4: prose(40, 64)}
    for texts, want in (({}, {}), (lone, {1: 1, 2: 2, 3: 3}), (copies, {1: 1, 2: 1, 3: 1, 4: 4})):
        passes.clear()
        rows = near_dups.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in rows} == want


def test_near_duplicates_in_many_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    monkeypatch.setattr(near_dups, "LIKELIEST", 1)
    r, words = random.Random(18), prose(60, 19).split()
    texts = {}
    for k in range(90):  # far from the first one, some of them near one another
        w = list(words if k % 4 or not k else texts[max(0, k - 12)].split())
        for _ in range(r.randint(0, 4) if k else 0):
            w[r.randrange(len(w))] = f"q{r.randrange(9)}"
        texts[k] = " ".join(w)
    rows = near_dups.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == components({k: shingle_set(t) for k, t in texts.items()})


def test_near_duplicates_of_shared_ids(spark):
    a, b, c = prose(40, 71), prose(40, 72), prose(40, 73)
    rows = near_dups.near_duplicates(spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (9, c), (12, c), (20, prose(40, 74)), (20, prose(40, 75)), (3, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(1, 1, True), (5, 1, False), (9, 1, False), (12, 1, False), (20, 20, True), (3, 3, True)}


def test_whole_groups_keep_keys_together():
    import pyarrow as pa

    from lexigrid.llm.textkit import whole_groups

    keys = np.repeat(np.arange(9), [1, 5, 2, 30, 1, 1, 4, 9, 2])
    for size in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(keys[a : a + size])}) for a in range(0, len(keys), size)]
        for rows in (1, 4, 50):
            parts = [t["key"].to_pylist() for t in whole_groups(batches, "key", rows)]
            assert sum(parts, []) == keys.tolist() and all(len(p) >= rows for p in parts[:-1])
            assert all(p[-1] != q[0] for p, q in zip(parts, parts[1:]))


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 1 << 62, 100).astype(np.uint64)])
    tiny = a[:2]
    s = near_dups.sketch(np.concatenate([a, b, tiny]), np.repeat([0, 1, 2], [400, 400, 2]), 4)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.15
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, prose(40, 10)), (3, "too short"), (4, None), (None, PASSAGE)], "item_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    short = {k for k, t in TEXTS.items() if "too short" in (t or "")}
    assert {(r.doc_id, r.item_id) for r in found} == {(4, 1), (5, 1), (4, None), (5, None)} | {(k, 3) for k in short} and all(r.distance <= 1 for r in found)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {None, *TEXTS} - {4, 5}
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    # recall on edited passages, and the distance against the full table
    r, texts = random.Random(11), []
    words = PASSAGE.split()
    for k in range(60):
        w = list(words)
        for _ in range(r.randint(0, 10)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append((k, prose(30, 100 + k) + " " + " ".join(w) + " " + prose(20, 200 + k)))
    got = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), items.limit(1)).collect()
    assert len({r.doc_id for r in got}) >= 57
    item, part = np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 3, 4, 9], np.uint64)
    assert decontaminate.best_match(item, part)[0] == 1 and decontaminate.best_match(item, part[:0])[0] == 4


def test_leaks_in_texts_shorter_than_the_item(spark):
    r, item = random.Random(12), "".join(f" {w}{i}" for i, w in enumerate(prose(40, 65).split()))[1:].replace(".", "").replace(",", "")
    texts = []
    for k in range(61):
        w = item.split()
        for _ in range(k % 8 + 1 if k < 60 else 9):  # the last one has more than the allowed edits
            del w[r.randrange(len(w))]
        texts.append((k, " ".join(w)))
    assert len(item.split()) == 40
    items = spark.createDataFrame([(1, item), (2, prose(40, 67))], "item_id long, text string")
    docs = spark.createDataFrame([*texts, (61, prose(33, 66)), (62, ""), (63, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == set(range(60)) and {r.item_id for r in got.values()} == {1}
    assert all((got[k].distance, got[k].start, got[k].end) == (k % 8 + 1, 0, len(t)) for k, t in texts[:60])
    # alone in its chunk
    block, data = decontaminate.Items([1], [item], 0.2, 8), np.frombuffer(texts[7][1].encode(), np.uint8)
    symbols, _, _, bounds = decontaminate.words(data, np.array([0, len(data)]))
    assert [found[:3] for found in block.search(symbols, bounds)] == [(0, 0, 8)]


def plain_distance(item, text):
    """Smallest number of word edits between item and any stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


@pytest.mark.parametrize("length", [8, 10, 15, 20, 40])
def test_leaks_against_the_whole_table(length):
    r = random.Random(length)
    items = [[r.choice(VOCAB) for _ in range(length)] for _ in range(30)]
    texts = []
    for k in range(240):
        w = list(items[k % 30])
        for _ in range(r.randint(0, length // 4 + 1)):
            kind, at = (k // 30) % 3, r.randrange(len(w))
            w[at : at + (kind != 1)] = [r.choice(VOCAB)] * (kind != 2)
        around = [[r.choice(VOCAB) for _ in range(r.randrange(1, 40))] for _ in range(2)] if k % 2 else [[], []]
        texts.append(around[0] + w + around[1])
    data = np.frombuffer("".join(" ".join(t) for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(" ".join(t).encode()) for t in texts])])
    block = decontaminate.Items(list(range(30)), [" ".join(i) for i in items], 0.2, 8)
    symbols, _, _, bounds = decontaminate.words(data, offsets)
    got = {(t, i): d for t, i, d, *_ in block.search(symbols, bounds)}
    want = {(k, i): d for k, t in enumerate(texts) for i in range(30) if (d := plain_distance(items[i], t)) <= length // 5}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[p] >= want[p] for p in got)
    assert {p for p in want if p[0] % 2 == 0} <= set(got)


def test_leaks_of_short_items_and_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "One, two"), (2, "漢字仮名交文章試験問題例文"), (3, "---"), (4, "x")], "item_id long, text string")
    rows = [(1, "a one two b"), (2, "two one"), (3, "前文漢字仮名交文章試験問題例文後"), (4, "漢字仮名交文章試験問題文後"), (5, "two"), (None, "x one two"), (7, None)]
    got = {(r.doc_id, r.item_id): (r.distance, r.start, r.end) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): (0, 2, 9), (3, 2): (0, 2, 15), (4, 2): (1, 0, 12), (None, 1): (0, 2, 9), (None, 4): (0, 0, 1)}


EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base_personal(x):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(x)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split(b"."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(rb"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(d := re.sub(rb"\D", b"", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), m.end(), 3) for m in re.finditer(rb"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(rb"\D", b"", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_personal_data(docs, empty):
    r = random.Random(5)
    parts = [b"@", b"a", b"b.c", b"x-", b".", b" ", b"1", b"25", b"+", b"4539578763621486", b"-", b"(", b")", b"192.168.0.1", b"999", b"\xc3\xa9", b"%"]
    for _ in range(3000):
        x = b"".join(r.choice(parts) for _ in range(r.randrange(1, 16)))
        assert pii.base_spans(x) == base_personal(x)
    got = by_id(pii.personal_data_digest(docs))
    for k, t in TEXTS.items():
        x = (t or "").encode()
        assert got[k].base_sha256 == digest(x, base_personal(x), pii.KINDS)
    assert (got[10].n_email, got[10].n_ip, got[10].n_card, got[10].n_phone) == (1, 1, 1, 1) and "crf_phone" in got[10].spans
    assert pii.personal_data_digest(empty).count() == 0
    model, unseen = pii.trained(), pii.sentences(150, 77)
    assert sum(model.decode(tokens) == gold for tokens, gold in unseen) > 140


def test_personal_data_in_long_tokens_and_stretches():
    model = pii.trained()
    assert [pii.octets(x) for x in (b"000000000001.2.3.4", b"1.2.3.256", b"0000.0.0.00", b"1.2.3.1000")] == [True, False, True, False]
    spans = lambda x: [x[a:b] for a, b, _ in pii.added_spans(x, pii.base_spans(x), model)]
    # behind the first 256 bytes of a token, and between characters of another script
    assert b"555-123-4567" in spans(b'"x":"y",' * 60 + b'"tel":"555-123-4567"')
    assert spans("電話".encode() * 50 + b"555-123-4567" + "番号".encode() * 50) == [b"555-123-4567"]
    # a number wherever a part of a long stretch ends
    for n in range(55, 75):
        x = b" ".join([b"7"] * n + [b"tel", b"(555)", b"123-4567", b"and"] + [b"word"] * 9)
        assert b"(555) 123-4567" in spans(x), n


def test_semi_markov_decoding_is_optimal():
    model, tokens = pii.trained(), [b"tel", b"+1", b"(555)", b"123-4567", b"a@b.org"]
    spans, best = model.scores(tokens), None

    def extend(at, label, total, path):
        nonlocal best
        if at == len(tokens):
            best = max(best or (-np.inf, []), (total, path))
            return
        for b in range(at + 1, min(len(tokens), at + pii.LONGEST) + 1):
            for y in range(len(pii.LABELS)):
                if np.isfinite(spans[at, b][1][y]):
                    extend(b, y, total + spans[at, b][1][y] + (model.step[label, y] if at else 0), [*path, (at, b, y)])

    extend(0, 0, 0.0, [])
    assert model.decode(tokens) == best[1]


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = by_id(repeats.remove_repeats(docs))
    raw = {**{k: (t or "").encode() for k, t in TEXTS.items()}, None: prose(80, 7).encode()}
    seen = Counter(x[i : i + 200] for x in raw.values() for i in range(len(x) - 199))
    for k in TEXTS:
        x = raw[k]
        cover = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert got[9].n_removed and repeats.remove_repeats(empty).count() == 0


def test_repeats_of_shared_and_null_ids(spark):
    a, b = prose(80, 91), prose(80, 92)
    rows = repeats.remove_repeats(spark.createDataFrame([(None, a), (None, a), (None, b), (None, None), (1, a + b), (1, prose(80, 93)), (1, "")], "doc_id long, text string")).collect()
    got = sorted((r.doc_id is not None, r.n_bytes, r.n_removed, r.n_spans) for r in rows)
    # the stretch where a ends and b begins is in no other text
    want = [(False, len(a), len(a), 1), (False, len(a), len(a), 1), (False, len(b), len(b), 1), (False, 0, 0, 0), (True, len(a + b), len(a + b), 1), (True, len(prose(80, 93)), 0, 0), (True, 0, 0, 0)]
    assert got == sorted(want)


def test_media(docs, empty):
    stored = media.encode_media(docs)
    got = by_id(media.media_digest(stored))
    for k, t in TEXTS.items():
        p = media.payload((t or "").encode())
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1].media_sha256 == got[2].media_sha256 and media.media_digest(media.encode_media(empty)).count() == 0
    blocks = [r for r in media.pcm_blocks(stored).collect() if r.doc_id == 12]
    pcm = b"".join(b.pcm for b in sorted(blocks, key=lambda b: b.sample_offset))
    assert (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() == media.payload(TEXTS[12].encode())


def test_flac_streams():
    r = random.Random(1)
    raw = [b"", b"a" * 512, bytes(r.randrange(256) for _ in range(3000)), bytes([0, 255] * 700), b"\0" * 1000 + b"\xff" * 1000, b"x" * 100_000]
    payloads = [media.payload(x) for x in raw]
    streams = media.encode_payloads(payloads)
    for p, s, (samples, blocks) in zip(payloads, streams, media.decode_streams(streams)):
        assert (samples + 128).astype(np.uint8).tobytes() == p and sum(n for _, n in blocks) == len(p)
        assert s[:4] == b"fLaC" and media.read_metadata(s)[0]["samples"] == len(p)
    broken = bytearray(streams[2])
    broken[-40] ^= 4
    with pytest.raises(ValueError):
        media.decode_streams([bytes(broken)])


def plain_crc(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c


def plain_flac(frames, bits, samples):
    """A stream of hand-made subframes, as strings of 0 and 1, with (block size, subframe) for each frame."""
    pcm = b"".join(int(x).to_bytes(bits // 8, "little", signed=True) for x in samples)
    packed = (8000 << 44 | 0 << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big")
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + (256).to_bytes(2, "big") * 2 + bytes(6) + packed + hashlib.md5(pcm).digest()
    for number, (size, subframe) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0]) + bytes([number]) + (size - 1).to_bytes(2, "big")
        head += bytes([plain_crc(head, 8, 0x07)])
        subframe += "0" * (-len(subframe) % 8)
        frame = head + int(subframe, 2).to_bytes(len(subframe) // 8, "big")
        out += frame + plain_crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def signed_bits(x, n):
    return format(x & ((1 << n) - 1), f"0{n}b") if n else ""


def plain_subframe(samples, bits, kind, order, coefficients, shift, precision, parameter_bits, partition_order, parameters, waste=0):
    """Subframe of a predictor whose partitions have Rice parameters, or None and a width for an escape."""
    samples, bits = [x >> waste for x in samples], bits - waste
    out = "0" + format(kind, "06b") + ("1" + "0" * (waste - 1) + "1" if waste else "0")
    out += "".join(signed_bits(x, bits) for x in samples[:order])
    if kind >= 32:
        out += format(precision - 1, "04b") + signed_bits(shift, 5) + "".join(signed_bits(c, precision) for c in coefficients)
    out += format(parameter_bits - 4, "02b") + format(partition_order, "04b")
    residual = [x - (sum(c * samples[t - 1 - i] for i, c in enumerate(coefficients)) >> shift) for t, x in enumerate(samples) if t >= order]
    each, at = len(samples) >> partition_order, 0
    for part, (k, width) in enumerate(parameters):
        n = each - (order if part == 0 else 0)
        if k is None:
            out += "1" * parameter_bits + format(width, "05b") + "".join(signed_bits(x, width) for x in residual[at : at + n])
        else:
            out += format(k, f"0{parameter_bits}b")
            for x in residual[at : at + n]:
                u = 2 * x if x >= 0 else -2 * x - 1
                out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
        at += n
    return out


FIXED_PREDICTORS = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_flac_decoder_on_hand_made_streams(bits):
    r = random.Random(bits)
    top = 1 << (bits - 1)

    def wave(n):
        return [max(-top, min(top - 1, int(top / 4 * np.sin(i / 9)) + r.randint(-3, 3))) for i in range(n)]

    frames, samples = [], []

    def add(own, subframe):
        frames.append((len(own), subframe))
        samples.extend(own)

    for order, own in ((o, wave(64)) for o in range(5)):
        add(own, plain_subframe(own, bits, 8 + order, order, FIXED_PREDICTORS[order], 0, 0, 4, 0, [(min(bits - 7, 14), 0)]))
        add(own, plain_subframe(own, bits, 8 + order, order, FIXED_PREDICTORS[order], 0, 0, 5, 2, [(bits - 3, 0), (None, bits + 5), (bits - 5, 0), (None, bits + 4)]))
    for order in (1, 2, 5, 12, 32):
        own, coefficients = wave(128), [r.randint(-200, 200) for _ in range(order)]
        add(own, plain_subframe(own, bits, 31 + order, order, coefficients, 9, 9, 5, 1, [(bits - 1, 0), (bits - 2, 0)]))
    add([0] * 64, plain_subframe([0] * 64, bits, 8, 0, (), 0, 0, 4, 1, [(None, 0), (0, 0)]))
    own = [x // 4 * 4 for x in wave(40)]
    add(own, plain_subframe(own, bits, 9, 1, (1,), 0, 0, 5, 0, [(bits - 4, 0)], waste=2))
    own = wave(17)
    add(own, "0" + "000001" + "0" + "".join(signed_bits(x, bits) for x in own))
    add([-top] * 33, "0" + "000000" + "0" + signed_bits(-top, bits))
    stream = plain_flac(frames, bits, samples)
    (got, blocks), (again, _) = media.decode_streams([stream, stream])
    assert got.tolist() == samples and again.tolist() == samples
    assert [n for _, n in blocks] == [n for n, _ in frames] and [a for a, _ in blocks] == [0, *np.cumsum([n for n, _ in frames]).tolist()[:-1]]


def test_toxicity_and_quality(spark, docs, empty):
    r, rows, labels = random.Random(12), [], []
    for k in range(600):
        bad = k % 3 == 0
        words = prose(r.randint(20, 120), 1000 + k).split()
        for _ in range(6 * bad):
            words.insert(r.randrange(len(words)), r.choice(["grobnik", "grobnar", "vilegrob"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 2), int(bad)))
    rows = [(k, t.upper().replace(" ", "!! ") if not labels[k][1] else t) for k, t in rows]
    data = spark.createDataFrame([*rows, (None, "x"), (700, None), (701, "")], "doc_id long, text string")
    truth = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for operator, label, folds, fold in ((toxicity.toxicity, 2, 3, 1), (quality.quality, 1, 5, 0)):
        got = {r.doc_id: r for r in operator(data, truth).collect()}
        assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
        held = [k for k in range(600) if zlib.crc32(str(k).encode()) % folds == fold]
        assert {k for k in range(600) if got[k].held_out} == set(held)
        assert np.mean([got[k].predicted == labels[k][label] for k in held]) > 0.9
        assert operator(empty, truth).count() == 0
        assert len({r.score for r in operator(docs, truth.limit(0)).collect()}) == 1


def test_network_gradients():
    net = toxicity.Network(3)
    data = np.frombuffer(b"one two three four one five", np.uint8)
    which, buckets, grams, sizes, bounds = toxicity.inputs(data, np.array([0, 14, len(data)]))
    _, start, length = toxicity.window_starts(bounds)
    index, mask = net.frame(which, len(buckets), start, length)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = net.embed(buckets, grams, sizes).astype(np.float64)
    loss = lambda: float((net.logits(vectors, index, mask)[0] * [1.0, -2.0]).sum())
    logit, cache = net.logits(vectors, index, mask, keep=True)
    grad, d_vectors = net.gradients(vectors, index, mask, cache, np.array([1.0, -2.0]))
    for name in ("uf", "xb", "cf", "att_w", "att_v", "out"):
        flat = net.p[name].reshape(-1)
        at = len(flat) // 2
        flat[at] += 1e-2
        up = loss()
        flat[at] -= 2e-2
        down = loss()
        flat[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(np.asarray(grad[name]).reshape(-1)[at], rel=0.05, abs=1e-3)


def test_calibration_orders_and_bounds():
    x = np.concatenate([np.linspace(-2, 0, 50), np.linspace(-0.5, 2, 50)])
    slope, offset = labelled.calibrate(x, np.repeat([0, 1], 50))
    p = labelled.sigmoid(slope * x + offset)
    assert slope > 0 and p[0] < 0.1 < 0.9 < p[-1]
    assert labelled.calibrate(x, np.ones(100, int))[0] == 0
