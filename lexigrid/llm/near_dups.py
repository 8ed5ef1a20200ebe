"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct five-word shingles.  Its sketch has ``ROWS * BANDS``
coordinates, filled by rounds of hashed bin placement: in round i every element goes to one
hashed bin with the value (i, hash), and after as many rounds as there are bins, round
``bins + j`` puts every element into bin j, so every coordinate fills.  Documents that agree
on a band share a bucket.

Documents with equal sets form a class first, so exact copies meet only once.  In every bucket
the classes are compared with its first member, and what is linked becomes one component.
Then documents leave that share too few shingles with the documents of all other components
together to be similar to any of them (texts that have a template in common leave here, in
linear time).  The rest of a bucket that still holds several components is dealt into blocks of
about ``BLOCK`` rows; every pair of blocks meets in one task, the largest component's blocks only
with others.  There a pair goes further unless the sets' sizes, shared shingles or parity
bitmaps prove that it is no link; all three bounds are exact.  Of each document the likeliest
pairs of a meeting are confirmed on full sets first, and those that it is still apart from in
further rounds of more pairs each, until no pair is left over: no cap, no dropped pair.  With
four rows and 32 bands a pair of similarity 0.75 shares no bucket with a probability of 5e-6.

Defined results: a null, empty or blank text has an empty set and is its own component;
rows that share an id count as one document, linked with whatever one of its texts is linked
with; a row with a null id has a null component and is not kept; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, discard, map_batches, materialize, mix, ragged, shingles, whole_groups, word_hashes, word_spans

ROWS, BANDS = 4, 32
WIDTH = 5
PERCENT = 75
PARITY_BITS = 2048
#: Rows of a block, and pairs of a document that a meeting of two blocks reports in the first round.
BLOCK, LIKELIEST = 1024, 4


def sketch(values: np.ndarray, owner: np.ndarray, n: int, bins: int = ROWS * BANDS) -> np.ndarray:
    """Sketches (n x bins) of n sets, given their elements' hashes and owners; empty sets keep all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, np.uint64)
    live, whose = values, owner
    for i in range(2 * bins):
        if not len(live):
            break
        h = mix(live + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))
        bin_ = (mix(h) % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(live), i - bins)
        at = whose * bins + bin_
        free = out[at] >= np.uint64(i) << np.uint64(54)
        np.minimum.at(out, at[free], value[free])
        open_ = (out.reshape(n, bins) == empty).any(axis=1)
        keep = open_[whose]
        live, whose = live[keep], whose[keep]
    return out.reshape(n, bins)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket per band."""
    n, bins = sketches.shape
    part = sketches.reshape(n, bins // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, bins // rows + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ part[:, :, r]) + np.uint64(r)
    return key.astype(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n, a, b (the set's size and two sums that identify it), bands."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            starts, ends, bounds = word_spans(data, offsets)
            values, owner = shingles(word_hashes(data, starts, ends), bounds, WIDTH)
            n = len(offsets) - 1
            cut = np.searchsorted(owner, np.arange(n + 1))
            size = np.diff(cut)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            a, b = (((s[cut[1:]] - s[cut[:-1]])).astype(np.int64) for s in sums)
            keys = bands(sketch(values, owner, n))
            offsets_ = np.concatenate([[0], np.cumsum(np.where(size > 0, keys.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(offsets_), pa.array(keys[size > 0].ravel()))], ["doc_id", "n", "a", "b", "bands"])

    return map_batches(docs, run, "doc_id long, n long, a long, b long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """rep, shingles array<long> of each row."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            starts, ends, bounds = word_spans(data, offsets)
            values, owner = shingles(word_hashes(data, starts, ends), bounds, WIDTH)
            cut = np.searchsorted(owner, np.arange(len(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(values.astype(np.int64)))], ["rep", "shingles"])

    return map_batches(docs, run, "rep long, shingles array<long>")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, of every node with an edge; edges are (u, v).

    Alternates the large-star and small-star operations on an edge table in the shared
    folder until it no longer changes.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.distinct(), name)
        discard(old, large)
    # every remaining edge leads to a component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))
    # the many different u first, then the fewer v
    both = pairs.select("u", "v").distinct().join(left, "u").join(right, "v").where(F.least(F.size("su"), F.size("sv")) * 100 >= F.greatest(F.size("su"), F.size("sv")) * percent)
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", shared.alias("i"), (F.size("su") + F.size("sv")).alias("t")).where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("u", "v").distinct()


def _open(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with their component and of their
    bucket: the smallest set size, the number of rows, the largest component and its rows."""
    marked = rest.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    marked = materialize(marked, "near-marked")
    parts = marked.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    several = parts.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("least").alias("least"), F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("lead")).where("kinds > 1")
    several = several.select("bucket", "least", "size", F.col("lead.c").alias("lead_size"), F.col("lead.component").alias("lead"))
    return marked.join(several, "bucket").select(*marked.columns, "least", "size", "lead_size", (F.col("component") == F.col("lead")).alias("leads"))


def _linkable(rest: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """bucket, rep, n, k of the rows that can still have a link to another component.

    k counts a document's shingles that an open document of another component has as well:
    no intersection with such a document is larger.  A link between sets of n and m shingles
    needs ``i * (100 + percent) >= percent * (n + m)``, and m is at least the bucket's
    smallest size and ``n * percent / 100``, so rows whose k is below that leave.  Others lose
    shared shingles by it, so passes repeat while each drops a third of the rows or more.
    """
    while True:
        open_ = materialize(_open(rest.select("bucket", "rep", "n"), labels), "near-open")
        shingle = sets.join(open_.select("rep", "component").distinct(), "rep").select("rep", "component", F.explode("shingles").alias("s"))
        common = shingle.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("s")
        k = shingle.join(common, "s", "left_semi").groupBy("rep").agg(F.count("*").alias("k"))
        partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
        able = open_.join(k, "rep").where(F.col("k") * (100 + percent) >= (F.col("n") + partner) * percent)
        rest = materialize(able.select("bucket", "rep", "n", "k"), "near-linkable")
        before, left = open_.count(), rest.count()
        discard(open_)
        if left == 0 or left * 3 >= before * 2:
            return rest


def _parities(sets: DataFrame) -> DataFrame:
    """rep, n, bits: for each of ``PARITY_BITS`` hash values, whether an odd number of the set's shingles has it."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            bit = mix(lists.flatten().to_numpy().astype(np.uint64) ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(PARITY_BITS)
            words = np.zeros(len(size) * (PARITY_BITS // 64), np.uint64)
            np.bitwise_xor.at(words, owner * (PARITY_BITS // 64) + (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << bit % np.uint64(64))
            bits = pa.array([w.tobytes() for w in words.reshape(len(size), -1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), bits], ["rep", "n", "bits"])

    return map_batches(sets.select("rep", "shingles"), run, "rep long, n long, bits binary").distinct()


def _meetings(open_: DataFrame) -> DataFrame:
    """A row for each meeting of two blocks that an open row takes part in: cell, side (whether it is of the
    second block), same (whether both blocks are one)."""
    small = F.col("size") <= BLOCK
    others = F.ceil((F.col("size") - F.col("lead_size")) / BLOCK)
    leads = F.ceil(F.col("lead_size") / BLOCK)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("leads"), leads).otherwise(others))
    cell = lambda a, b, side: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), side.alias("side"))
    # blocks of the largest component are numbered -1, -2, ...
    with_leads = F.transform(F.sequence(F.lit(1), leads), lambda x: cell(own, -x, F.lit(False)))
    with_others = F.transform(F.sequence(F.lit(0), others - 1), lambda x: cell(F.least(own, x), F.greatest(own, x), own > x))
    as_lead = F.transform(F.sequence(F.lit(0), others - 1), lambda x: cell(x, -1 - own, F.lit(True)))
    cells = F.when(small, F.array(cell(F.lit(0), F.lit(0), F.lit(False)))).when(F.col("leads"), as_lead).otherwise(F.concat(with_others, with_leads))
    met = open_.withColumn("at", F.explode(cells))
    return met.select(F.xxhash64("bucket", "at.a", "at.b").alias("cell"), F.col("at.side").alias("side"), (F.col("at.a") == F.col("at.b")).alias("same"), "component", "rep", "n", "k", "bits")


def _meet(table: pa.Table, percent: int, most: int):
    """(u, v, more) of whole cells: pairs of different components that may be links, for either document its
    likeliest ones; more tells whether one of the two has others besides."""
    column = {name: table.column(name).combine_chunks() for name in table.column_names}
    cell, component, rep, n, k = (column[c].to_numpy() for c in ("cell", "component", "rep", "n", "k"))
    side, same = (column[c].to_numpy(zero_copy_only=False) for c in ("side", "same"))
    bits = np.frombuffer(b"".join(column["bits"].to_pylist()), np.uint64).reshape(len(cell), -1)
    at, d, found = np.arange(len(cell) - 1), 0, []
    while len(at):
        d += 1
        at = at[at + d < len(cell)]
        at = at[cell[at + d] == cell[at]]
        able = (component[at] != component[at + d]) & (same[at] | (side[at] != side[at + d]))
        total = n[at] + n[at + d]
        able &= (np.minimum(k[at], k[at + d]) * (100 + percent) >= total * percent) & (np.minimum(n[at], n[at + d]) * 100 >= np.maximum(n[at], n[at + d]) * percent)
        a, total = at[able], total[able]
        # sets differ in at least as many shingles as their parities in bits
        differ = np.bitwise_count(bits[a] ^ bits[a + d]).sum(axis=1, dtype=np.int64)
        near = differ * (100 + percent) <= total * (100 - percent)
        found.append(np.stack([a[near], a[near] + d, (differ[near] << 20) // total[near]]))
    u, v, far = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    wanted, more = np.zeros(len(u), bool), np.zeros(len(u), bool)
    for end in (u, v):
        order = np.lexsort((far, end))
        group = end[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        size = np.diff(np.append(first, len(group)))
        place = ragged(size)
        wanted[order[place < most]] = True
        more[order[np.repeat(size > most, size)]] = True
    return pa.RecordBatch.from_arrays([pa.array(rep[u[wanted]]), pa.array(rep[v[wanted]]), pa.array(more[wanted])], ["u", "v", "more"])


def _likely(open_: DataFrame, percent: int, most: int) -> DataFrame:
    """(u, v, more) of all buckets."""
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _meetings(open_).repartition(parts, "cell").sortWithinPartitions("cell")

    def run(batches):
        for table in whole_groups(batches, "cell", 4 * BLOCK):
            yield _meet(table, percent, most)

    return map_batches(dealt, run, "u long, v long, more boolean").where("u <> v")


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of each id that has several different texts."""
    of_id = known.join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"]).groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v <> last").select("doc_id", "v")
    return known.join(of_id, "doc_id").join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"]).select(F.col("rep").alias("u"), "v")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialize(_sketched(docs), "near-sketches")
    known = sketched.where("doc_id is not null and n > 0")
    classes = materialize(known.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-classes")
    placed = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1").select("bucket", "hub"), "near-buckets")
    members = materialize(placed.join(shared, "bucket"), "near-members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(_sets(docs.join(needed, "doc_id", "left_semi").select("doc_id", "text")).where(F.size("shingles") > 0), "near-sets")
    first = members.where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    labels = connected_components(_confirmed(first, sets, percent).unionByName(_shared_ids(known, classes)))
    rest = _linkable(members.where("rep <> hub").select("bucket", "rep", "n"), labels, sets, percent)
    discard(shared, members)
    parities = materialize(_parities(sets.join(rest.select("rep").distinct(), "rep", "left_semi")), "near-parities")
    most, tried = LIKELIEST, None
    while True:
        open_ = _open(rest, labels).join(parities, ["rep", "n"])
        pairs = materialize(_likely(open_, percent, most), "near-pairs")
        fresh = pairs.join(tried, ["u", "v"], "left_anti") if tried else pairs
        found = materialize(_confirmed(fresh, sets, percent), "near-links")
        if not found.isEmpty():
            labels = connected_components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        if pairs.where("more").isEmpty():
            break
        # pairs of a later round hold those of this one that are still apart
        tried, most = pairs.select("u", "v").distinct(), most * 8
    discard(sets, parities, rest)
    joined = sketched.drop("bands").join(classes.select("n", "a", "b", "rep"), ["n", "a", "b"], "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
