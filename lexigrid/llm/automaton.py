"""Regular expressions over bytes, compiled to minimal deterministic automata.

The supported syntax is what secret rules need: literals, ``\\xHH`` and escaped characters,
classes with ranges, groups, ``(?i:...)`` groups, alternation, and ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class _Parser:
    """Builds a syntax tree: ('set', frozenset), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def more(self, stop: str = "") -> bool:
        return self.i < len(self.p) and self.p[self.i] not in stop

    def alternatives(self):
        out = [self.sequence()]
        while self.more() and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", *out)

    def sequence(self):
        out = []
        while self.more("|)"):
            out.append(self.repeated())
        return ("cat", *out)

    def repeated(self):
        node = self.atom()
        while self.more() and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i + 1 : end].partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
                self.i = end
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            self.i += 1
        return node

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            before = self.fold
            if self.p.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            self.fold = before
            self.i += 1
            return node
        if c == "[":
            return self.klass()
        return self.chars({self.one()})

    def one(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def klass(self):
        self.i += 1
        found: set[int] = set()
        while self.p[self.i] != "]":
            low = self.one()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self.one() + 1))
            else:
                found.add(low)
        self.i += 1
        return self.chars(found)

    def chars(self, found: set[int]):
        if self.fold:
            letters = {b for b in found if chr(b).isalpha() and b < 128}
            found = found | {b ^ 32 for b in letters}
        return ("set", frozenset(found))


def parse(pattern: str):
    return _Parser(pattern).alternatives()


def reverse(node):
    """The tree of the reversed language."""
    kind = node[0]
    if kind == "cat":
        return ("cat", *map(reverse, node[:0:-1]))
    if kind == "alt":
        return ("alt", *map(reverse, node[1:]))
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1:]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in node[1:]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(part, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """Transition arrays: ``next[state * n_classes + class]`` is the next state times n_classes.

    State 0 is the start; states from ``accept`` on (also times n_classes) accept, and
    ``rules`` tells which of the compiled trees do; ``dead`` is the state without a way to
    acceptance, or -1.
    """

    def __init__(self, trees: list, search: bool):
        nfa = _Nfa()
        start = nfa.state()
        finals = {}
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            finals[nfa.add(tree, begin)] = k
        if search:
            nfa.moves[start].append((frozenset(range(256)), start))
        sets = list({s for moves in nfa.moves for s, _ in moves})
        member = np.array([[b in s for s in sets] for b in range(256)])
        _, byte_class = np.unique(member, axis=0, return_inverse=True)
        byte_class = byte_class.ravel()
        n = int(byte_class.max()) + 1
        sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(n)]

        def closed(states) -> frozenset:
            stack, seen = list(states), set(states)
            while stack:
                for t in nfa.empty[stack.pop()]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            return frozenset(s for s in seen if nfa.moves[s] or s in finals)

        first = closed([start])
        index, table, queue = {first: 0}, [], [first]
        for subset in queue:
            row = []
            for byte in sample:
                target = closed({t for s in subset for chars, t in nfa.moves[s] if byte in chars})
                if target not in index:
                    index[target] = len(queue)
                    queue.append(target)
                row.append(index[target])
            table.append(row)
        accepts = np.array([sum(1 << finals[s] for s in subset if s in finals) for subset in queue], np.int64)
        self._minimise(np.array(table), accepts, byte_class.astype(np.uint8), n)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray, byte_class: np.ndarray, n: int) -> None:
        label = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:
            signature = np.column_stack([label, label[table]])
            refined = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
            if refined.max() == label.max():
                break
            label = refined
        count = int(label.max()) + 1
        pick = np.zeros(count, np.int64)
        pick[label[::-1]] = np.arange(len(label) - 1, -1, -1)
        order = np.lexsort((np.arange(count) != label[0], accepts[pick] > 0))
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count)
        small = rank[label[table[pick[order]]]]
        masks = accepts[pick[order]]
        # the start stays in front even if it accepts
        self.start = int(rank[label[0]]) * n
        self.n_classes, self.n_states = n, count
        self.classes = byte_class.tobytes()
        self.next = (small * n).ravel().tolist()
        self.accept = int((masks == 0).sum()) * n
        self.rules = [[k for k in range(64) if m >> k & 1] for m in masks.tolist()]
        stuck = np.flatnonzero((small == np.arange(count)[:, None]).all(axis=1) & (masks == 0))
        self.dead = int(stuck[0]) * n if len(stuck) else -1


@lru_cache(maxsize=256)
def anchored(pattern: str) -> Dfa:
    return Dfa([parse(pattern)], search=False)


@lru_cache(maxsize=16)
def starting(patterns: tuple[str, ...]) -> Dfa:
    """One automaton that, reading a text from its end, tells after each byte which patterns have a match that starts there."""
    return Dfa([reverse(parse(p)) for p in patterns], search=True)


def longest(dfa: Dfa, classes: bytes, start: int) -> int:
    """End of the longest match that begins at start, or -1."""
    move, accept, dead, state = dfa.next, dfa.accept, dfa.dead, dfa.start
    best = start if state >= accept else -1
    for i in range(start, len(classes)):
        state = move[state + classes[i]]
        if state >= accept:
            best = i + 1
        elif state == dead:
            break
    return best

