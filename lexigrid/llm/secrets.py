"""Secret scans with one combined automaton.

The patterns of all rules are compiled together, whole, by subset construction and
minimisation into one transition array.  One pass over a text's bytes, from the last to the
first, tells for every rule where its matches start; from the first start behind a rule's last
match its own array runs to the longest end.  Matches of a rule are leftmost and do not
overlap, and those that fail the rule's condition are dropped.  The time is linear in the text.

Defined results: a null text counts as empty and has no spans; repeated rows give equal
rows; a null id keeps its row; an empty table gives no rows; other columns are not read by
``find_secrets`` and are kept by ``redact_secrets``.  Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import anchored, longest, starting
from .textkit import chunks, map_batches


_SEPARATED = re.compile(rb"""[^:=]*[:=]\x20*["']?""")


def value_length(match: bytes) -> int:
    """Length of an assignment's value: what follows the first ``:`` or ``=``, blanks and a quote."""
    return len(match) - _SEPARATED.match(match).end()


class Rule(NamedTuple):
    kind: str
    pattern: str
    holds: Callable[[bytes], bool] = bool
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", lambda m: value_length(m) >= 6, True),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m) >= 20, True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 15),
    Rule("google", "AIza[0-9A-Za-z_-]+", lambda m: len(m) >= 39),
    Rule("stripe", "sk_(live|test)_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: min(map(len, m.split(b"."))) >= 8),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(\x0D?\x0A[A-Za-z0-9+/=]+)*(\x0D?\x0A-----END [A-Z ]*PRIVATE KEY-----)?"),
)


def scan(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule) byte spans by start, then rule."""
    dfa = starting(tuple(r.pattern for r in rules))
    move, accept, state = dfa.next, dfa.accept, dfa.start
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(text[::-1].translate(dfa.classes), 1):
        state = move[state + c]
        if state >= accept:
            for k in dfa.rules[state // dfa.n_classes]:
                starts.setdefault(k, []).append(len(text) - i)
    found = []
    for k, places in starts.items():
        ahead, end = anchored(rules[k].pattern), 0
        for start in reversed(places):
            if start >= end:
                end = longest(ahead, _Classes(text, ahead.classes), start)
                if rules[k].holds(text[start:end]):
                    found.append((start, end, k))
    return sorted(found, key=lambda s: (s[0], s[2]))


class _Classes:
    """A text's byte classes, looked up as they are asked for."""

    __slots__ = ("table", "text")

    def __init__(self, text: bytes, table: bytes):
        self.text, self.table = text, table

    def __len__(self) -> int:
        return len(self.text)

    def __getitem__(self, i: int) -> int:
        return self.table[self.text[i]]


def to_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), int(lead[b]), k) for a, b, k in spans]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            spans = []
            for a, b in zip(at, at[1:]):
                text = raw[a:b]
                spans.append([{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, e, k in to_code_points(text, scan(text, rules))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by base kind, the hash of base spans and the text of all spans."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with every found span replaced by mark (overlapping spans by one); null texts stay null."""
    schema = df.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        for rows, data, offsets in chunks(batches, text_col):
            raw, cut = data.tobytes(), offsets.tolist()
            out = []
            for a, b, known in zip(cut, cut[1:], rows.column(at).is_valid().to_pylist()):
                text, pieces, last = raw[a:b], [], 0
                for s, e, _ in scan(text, rules):
                    if s >= last:
                        pieces += [text[last:s], mark.encode()]
                    last = max(last, e)
                out.append(b"".join([*pieces, text[last:]]).decode("utf-8") if known else None)
            columns = list(rows.columns)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return map_batches(df, run, schema)


def secrets_digest(df: DataFrame) -> DataFrame:
    return span_digest(find_secrets(df), tuple(r.kind for r in RULES if r.base))

