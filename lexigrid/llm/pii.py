"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The base kinds follow fixed patterns.  Around places that hold a digit, an ``@`` or a written-out
"(at)", a semi-Markov model scores whole candidate spans of up to ``LONGEST`` tokens by features of the span
as a whole (digits, checksums, separators, neighbours) and of the step between
types; dynamic programming over spans chooses boundaries and types together, over long stretches in
overlapping parts.  Tokens are runs without white space; long ones are cut at punctuation and where
a script begins or ends.  Spans that do not touch a base span are added.  The model is trained here, on sentences generated from a
seed, by the exact gradient of the likelihood of their segmentations.

Defined results: a null text counts as empty and has no spans; repeated rows give equal
rows; a null id keeps its row; an empty table gives no rows; other columns are not read.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import span_digest, to_code_points
from .textkit import chunks, map_batches

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"crf_{k}" for k in KINDS)
LABELS = ("other", *KINDS)
#: Tokens of an entity at most.
LONGEST = 6
#: Tokens of context on both sides of a place that may hold personal data, and of a part of a long stretch.
AROUND, PART = 3, 64
#: Bytes from which on a token is cut, and of spans whose features are kept for the next time.
LONG_TOKEN, LONG_SPAN = 64, 512
SENTENCES, EPOCHS, RATE = 500, 4, 0.4

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_HINT = re.compile(rb"[0-9@]|[\[(]at[\])]|[\[( ]dot[\]) ]", re.I)
_TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")
_PIECE = re.compile(rb"""[\x80-\xff]+|[^\x80-\xff,;"'<>{}|&=?/\\]+|.""", re.S)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(part: bytes) -> bytes:
    return part.translate(None, _NOT_DIGIT)


def octets(part: bytes) -> bool:
    return all(len(x) <= 3 and int(x or b"0") <= 255 for x in (y.lstrip(b"0") for y in part.split(b".")))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind, without failing ones."""
    out, floor, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            floor = m.end()
            out.append((start, floor, 0))
        at = text.find(b"@", max(at + 1, floor))
    if _HINT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if octets(m[0])]
        out += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _size(n: int, *steps: int) -> int:
    return sum(n >= s for s in steps)


def span_features(span: tuple[bytes, ...], before: bytes, after: bytes) -> tuple[str, ...]:
    """Names of the features of a whole candidate span."""
    of = _known_features if sum(map(len, span)) + len(before) + len(after) <= LONG_SPAN else _features
    return of(span, before, after)


def _features(span: tuple[bytes, ...], before: bytes, after: bytes) -> tuple[str, ...]:
    joined = b" ".join(span)
    low = joined.lower()
    digits = only_digits(joined)
    shape = re.sub(rb"[A-Za-z\x80-\xff]+", b"a", re.sub(rb"[0-9]+", b"0", low))[:24].decode("latin-1")
    out = [
        f"tokens{len(span)}",
        f"digits{_size(len(digits), 1, 4, 7, 9, 10, 12, 13, 16, 17, 20)}",
        f"letters{_size(sum(c >= 128 or 97 <= c <= 122 for c in low), 1, 4, 8)}",
        f"at{min(2, joined.count(b'@'))}",
        f"dots{min(4, joined.count(b'.'))}",
        f"dash{min(3, joined.count(b'-'))}",
        f"shape {shape}",
        f"first {shape[:2]}",
        f"last {shape[-2:]}",
        "before " + before.lower().strip(b".,:;#")[:8].decode("latin-1"),
        "after " + after.lower().strip(b".,:;")[:8].decode("latin-1"),
    ]
    for name, is_ in (
        ("plus", low.startswith(b"+")),
        ("round", b"(" in low),
        ("luhn", 12 <= len(digits) <= 19 and luhn(digits) and not re.search(rb"[a-z]", low)),
        ("octets", bool(_IP.fullmatch(joined.strip(b".,;:"))) and octets(joined.strip(b".,;:"))),
        ("written", bool(re.search(rb"[\[( ]at[\]) ]", low)) and bool(re.search(rb"[\[( ]dot[\]) ]|\.", low))),
        ("numeric", not re.search(rb"[a-z\x80-\xff@=_/$%]", low)),
        ("assigned", b"=" in low or b":" in low[:-1]),
        ("domain", bool(re.search(rb"(\.|dot[\])]? ?)[a-z]{2,6}[.,;]?$", low))),
    ):
        if is_:
            out.append(name)
    return tuple(out)


_known_features = lru_cache(maxsize=200_000)(_features)


class SemiCrf:
    """Weights by feature and label, and between labels of neighbouring segments."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(LABELS)))
        self.step = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, tokens: list[bytes], grow: bool = False) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Per span (start, end) its feature rows and label scores; only single tokens may be ``other``."""
        out = {}
        for a in range(len(tokens)):
            for b in range(a + 1, min(len(tokens), a + LONGEST) + 1):
                names = span_features(tuple(tokens[a:b]), tokens[a - 1] if a else b"<", tokens[b] if b < len(tokens) else b">")
                if grow:
                    for name in names:
                        self.index.setdefault(name, len(self.index))
                    if len(self.index) > len(self.w):
                        self.w = np.vstack([self.w, np.zeros((len(self.index) - len(self.w) + 512, len(LABELS)))])
                rows = np.array([self.index[n] for n in names if n in self.index], np.int64)
                score = self.w[rows].sum(axis=0)
                if b - a > 1:
                    score[0] = -np.inf
                out[a, b] = rows, score
        return out

    def decode(self, tokens: list[bytes]) -> list[tuple[int, int, int]]:
        """The best segmentation: (start, end, label)."""
        spans, n = self.scores(tokens), len(tokens)
        best = np.full((n + 1, len(LABELS)), -np.inf)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        best[0] = 0
        for b in range(1, n + 1):
            for a in range(max(0, b - LONGEST), b):
                before = best[a][:, None] + self.step if a else np.zeros((1, len(LABELS)))
                total = before.max(axis=0) + spans[a, b][1]
                for y in np.flatnonzero(total > best[b]).tolist():
                    best[b, y] = total[y]
                    back[b, y] = a, int(before[:, y].argmax())
        out, b, y = [], n, int(best[n].argmax())
        while b:
            a, previous = back[b, y]
            out.append((a, b, y))
            b, y = a, previous
        return out[::-1]

    def learn(self, tokens: list[bytes], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One step along the gradient of log p(gold | tokens), by forward and backward sums over segmentations."""
        spans, n, k = self.scores(tokens, grow=True), len(tokens), len(LABELS)
        ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        for b in range(1, n + 1):
            parts = [(np.logaddexp.reduce(ahead[a][:, None] + self.step, axis=0) if a else np.zeros(k)) + spans[a, b][1] for a in range(max(0, b - LONGEST), b)]
            ahead[b] = np.logaddexp.reduce(parts, axis=0)
        behind[n] = 0
        for a in range(n - 1, 0, -1):
            ends = [np.logaddexp.reduce(self.step + (spans[a, b][1] + behind[b])[None, :], axis=1) for b in range(a + 1, min(n, a + LONGEST) + 1)]
            behind[a] = np.logaddexp.reduce(ends, axis=0)
        total = np.logaddexp.reduce(ahead[n])
        d_step = np.zeros_like(self.step)
        for (a, b), (rows, score) in spans.items():
            enter = ahead[a][:, None] + self.step if a else np.zeros((1, k))
            pair = np.exp(enter + (score + behind[b])[None, :] - total)
            if a:
                d_step += pair
            self.w[rows] -= rate * pair.sum(axis=0)
        for i, (a, b, y) in enumerate(gold):
            self.w[spans[a, b][0], y] += rate
            if i:
                self.step[gold[i - 1][2], y] += rate
        self.step -= rate * d_step


def sentences(n: int, seed: int = 3) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Generated token sequences with their segmentation: personal data in many writings, and look-alikes."""
    r = random.Random(seed)
    syllables = "an ber co del en fi gor ha in ka lo mir no or pa que re sti ton ur ve zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        for c in "0123456789":
            if luhn((body + c).encode()):
                full = body + c
        s = r.choice(["", " ", "-", "."])
        return s.join(full[i : i + 4] for i in range(0, len(full), 4))

    def email() -> str:
        name, host, top = word() + r.choice(["", "." + word(), digits(2)]), word(), r.choice(["com", "org", "net", "de", "fr"])
        return r.choice([f"{name}@{host}.{top}", f"{name}@{host}.example.{top}", f"{name} [at] {host} [dot] {top}", f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}.{top}", f"{name} @ {host}.{top}"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b}{digits(2)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"tel:{a}-{b}-{c}"])

    address = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", f":{r.randint(80, 9000)}"])
    odd = [lambda: digits(r.randint(1, 6)), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{digits(2)}.{digits(1)}"]
    odd += [lambda: f"password={r.getrandbits(72):x}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{r.getrandbits(160):x}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"@{word()}", lambda: f"#{digits(5)}", lambda: digits(r.randint(20, 30)), lambda: "4" + digits(14), lambda: f"{word()}{digits(3)}"]
    odd += [lambda: f"{word().upper()} {word()[:2].upper()}-{word()[:2].upper()} {digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)} v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()}-{digits(1)}.{digits(1)}"]
    out = []
    for _ in range(n):
        tokens: list[bytes] = []
        gold: list[tuple[int, int, int]] = []

        def add(text: str, label: int, tokens=tokens, gold=gold) -> None:
            parts = text.encode().split()
            if label:
                gold.append((len(tokens), len(tokens) + len(parts), label))
            else:
                gold.extend((len(tokens) + i, len(tokens) + i + 1, 0) for i in range(len(parts)))
            tokens.extend(parts)

        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(1, 3)):
                add(r.choice([word(), word(), word() + r.choice([",", "."]), "at", "the"]), 0)
            kind = r.choice([0, 0, 1, 2, 3, 4])
            text = (r.choice(odd), email, address, card, phone)[kind]()
            add(text + r.choice(["", "", "", ".", ","]), kind)
        for _ in range(r.randint(0, 2)):
            add(word(), 0)
        out.append((tokens, gold))
    return out


@lru_cache(maxsize=2)
def trained(n: int = SENTENCES, epochs: int = EPOCHS, seed: int = 3) -> SemiCrf:
    model, data = SemiCrf(), sentences(n, seed)
    for epoch in range(epochs):
        for tokens, gold in data:
            model.learn(tokens, gold, RATE / (1 + epoch))
    return model


class Spans:
    """Sorted spans, asked whether any of them overlaps a stretch."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = sorted(a for a, _, _ in spans)
        self.ends = np.maximum.accumulate([b for _, b, _ in sorted(spans)]).tolist() if spans else []

    def overlap(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


def tokens_of(text: bytes) -> list[tuple[int, int]]:
    """Start and end of the tokens."""
    out = []
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() <= LONG_TOKEN:
            out.append(m.span())
        else:
            out += [p.span() for p in _PIECE.finditer(text, *m.span())]
    return out


def added_spans(text: bytes, base: list[tuple[int, int, int]], model: SemiCrf) -> list[tuple[int, int, int]]:
    """Spans of the model that touch no base span; kinds are numbered behind the base kinds."""
    known = Spans(base)
    hints = [m.start() for m in _HINT.finditer(text) if not base or not known.overlap(m.start(), m.start() + 1)]
    if not hints:
        return []
    tokens = tokens_of(text)
    # a written-out word may begin with the blank in front of its token
    hit = np.unique(np.clip(np.searchsorted([b for _, b in tokens], hints, side="right"), 0, len(tokens) - 1)).tolist()
    out, k, margin = [], 0, LONGEST + AROUND
    while k < len(hit):
        a = max(0, hit[k] - AROUND)
        while k + 1 < len(hit) and hit[k + 1] - hit[k] <= 2 * AROUND:
            k += 1
        b = min(len(tokens), hit[k] + AROUND + 1)
        k += 1
        done = a
        for core in range(a, b, PART):
            low, stop = max(a, core - margin), core + PART if b > core + PART else b
            for s, e, y in model.decode([text[i:j] for i, j in tokens[low : min(b, stop + margin)]]):
                s, e = low + s, low + e
                if y and max(core, done) <= s < stop:
                    done = e
                    i, j = tokens[s][0], tokens[e - 1][1]
                    while j > i + 1 and text[j - 1] in b""".,;:!?"'<>{}|&=/\\""":
                        j -= 1
                    while i < j - 1 and text[i] in b""",;:"'<>{}|&=?/\\""":
                        i += 1
                    if not known.overlap(i, j):
                        out.append((i, j, len(KINDS) + y - 1))
    return sorted({s for s in out}, key=lambda s: (s[0], s[2]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> of every row."""
    model = model or trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = KINDS + ADDED

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            spans = []
            for a, b in zip(at, at[1:]):
                text = raw[a:b]
                base = base_spans(text)
                every = sorted(base + added_spans(text, base, model), key=lambda s: (s[0], s[2]))
                spans.append([{"kind": names[k], "start": s, "end": e, "base": k < len(KINDS)} for s, e, k in to_code_points(text, every)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def personal_data_digest(df: DataFrame) -> DataFrame:
    return span_digest(find_personal_data(df), KINDS)
