"""Regular expressions over bytes compiled into one minimal deterministic automaton, as transition arrays.

Syntax: literals, escapes (\\d \\w \\s \\t \\n \\xNN and quoted signs), classes, groups, ``|``, ``* + ? {m} {m,} {m,n}``, and a leading
``(?i)``. A match begins where the byte before is none of GUARD's and ends where the byte after is none, so within a run
of such bytes at most one attempt is under way and the subsets stay few.
"""

from __future__ import annotations

import numpy as np

GUARD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_ALL = frozenset(range(256))
_SETS = {"d": frozenset(b"0123456789"), "w": GUARD - {ord("-")}, "s": frozenset(b" \t\n\r\f\v")}
_PLAIN = {"t": 9, "n": 10, "r": 13}


class Nfa:
    """Thompson's construction. step[s]: (bytes, state) pairs; free[s]: states reached without a byte."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return frozenset(t for s in states for on, t in self.step[s] if byte in on)


class _Parser:
    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.p, self.i = pattern[4:] if self.fold else pattern, 0

    def parse(self):
        tree = self._either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _either(self):
        options = [self._row()]
        while self._peek() == "|":
            self.i += 1
            options.append(self._row())
        return ("or", options) if len(options) > 1 else options[0]

    def _row(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            part = self._one()
            while self._peek() in ("*", "+", "?", "{"):
                part = ("repeat", part, *self._times())
            parts.append(part)
        return ("row", parts)

    def _times(self) -> tuple[int, int | None]:
        c = self._peek()
        self.i += 1
        if c != "{":
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _bytes(self, on: frozenset[int]):
        if self.fold:
            on = on | {ord(chr(b).swapcase()) for b in on if chr(b).isascii() and chr(b).isalpha()}
        return ("on", frozenset(on))

    def _escape(self) -> frozenset[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _SETS.get(c) or frozenset([_PLAIN.get(c, ord(c))])

    def _one(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self._either()
            if self._peek() != ")":
                raise ValueError(f"open group in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return self._bytes(self._class())
        if c == ".":
            return ("on", _ALL - {10})
        if c == "\\":
            return self._bytes(self._escape())
        return ("row", [self._bytes(frozenset([b])) for b in c.encode()]) if ord(c) > 127 else self._bytes(frozenset([ord(c)]))

    def _class(self) -> frozenset[int]:
        out: set[int] = set()
        without = self._peek() == "^"
        self.i += without
        while self._peek() != "]":
            c = self.p[self.i]
            self.i += 1
            low = self._escape() if c == "\\" else frozenset([ord(c)])
            if self._peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]" and len(low) == 1:
                self.i += 1
                d = self.p[self.i]
                self.i += 1
                high = self._escape() if d == "\\" else frozenset([ord(d)])
                low = frozenset(range(min(low), max(high) + 1))
            out |= low
        self.i += 1
        return _ALL - out if without else frozenset(out)


def _build(n: Nfa, tree, start: int, back: bool) -> int:
    """Adds the tree from start; gives its last state. back: for the words reversed."""
    kind = tree[0]
    if kind == "on":
        end = n.state()
        n.step[start].append((tree[1], end))
        return end
    if kind == "row":
        for part in reversed(tree[1]) if back else tree[1]:
            start = _build(n, part, start, back)
        return start
    if kind == "or":
        end = n.state()
        for option in tree[1]:
            first = n.state()
            n.free[start].append(first)
            n.free[_build(n, option, first, back)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = _build(n, part, start, back)
    if high is None:
        loop, end = n.state(), n.state()
        n.free[start] += [loop, end]
        last = _build(n, part, loop, back)
        n.free[last] += [loop, end]
        return end
    end = n.state()
    n.free[start].append(end)
    for _ in range(high - low):
        start = _build(n, part, start, back)
        n.free[start].append(end)
    return end


def _classes(n: Nfa) -> np.ndarray:
    """A class for each byte; bytes of a class are alike to every transition and to the guard."""
    marks: dict[tuple, int] = {}
    sets = list({on for step in n.step for on, _ in step})
    out = np.zeros(256, np.int32)
    for b in range(256):
        out[b] = marks.setdefault((b in GUARD, b == 10, *(b in on for on in sets)), len(marks))
    return out


def _minimal(table: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moore's partition refinement. Gives table and mark of the classes, and the class of each state."""
    _, part = np.unique(mark, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, first = np.unique(finer, return_index=True)
    return finer[table[first]].astype(np.int32), mark[first], finer


class Combined:
    """All rules in one automaton. next[state, class[byte]]: the state; mark[state]: bits of the rules of which a match ends before the byte just read. States with marks come last. start: after a byte that isn't GUARD's."""

    def __init__(self, patterns: list[str], limit: int = 200_000):
        n = Nfa()
        starts, ends = [], {}
        for k, pattern in enumerate(patterns):
            s = n.state()
            starts.append(s)
            ends[_build(n, _Parser(pattern).parse(), s, False)] = k
        self.byte_class = _classes(n)
        kinds = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(self.byte_class.max() + 1)]
        first = n.closure(frozenset(starts))
        if any(e in first for e in ends):
            raise ValueError("a rule matches the empty text")
        begin = (frozenset(), False, 0)
        index, todo, rows = {begin: 0}, [begin], []
        while todo:
            nodes, after_guard, _ = todo.pop()
            row = []
            done = sum(1 << ends[s] for s in nodes if s in ends)
            for b in kinds:
                new = n.closure(n.move(nodes if after_guard else nodes | first, b))
                key = (new, b in GUARD, 0 if b in GUARD else done)
                if key not in index:
                    if len(index) >= limit:
                        raise ValueError(f"the rules need more than {limit} states")
                    index[key] = len(index)
                    todo.append(key)
                row.append(index[key])
            rows.append((index[(nodes, after_guard, _)], row))
        table = np.array([r for _, r in sorted(rows)], np.int32)
        mark = np.array([m for _, _, m in index], np.int64)
        table, mark, part = _minimal(table, mark)
        order = np.argsort(mark != 0, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.next, self.mark, self.start = place[table[order]].astype(np.int32), mark[order], int(place[part[0]])
        self.accept = int((self.mark == 0).sum())
        after = self.next[:, self.byte_class[10]]
        #: A line break leads from anywhere to where the text begins, so lines can be read side by side.
        self.by_line = bool((self.next[after] == self.next[self.start]).all())
        self.backward = [Backward(p) for p in patterns]

    def read(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, rules) of each byte of texts data[off[i]:off[i+1]] before which matches end. Each text ends with a line break."""
        width = self.next.shape[1]
        flat = self.next.ravel() * np.int32(width)
        kinds = self.byte_class[data]
        if self.by_line:
            cut = np.flatnonzero(data == 10) + 1
            start = np.concatenate([[0], cut])
            start = np.union1d(start[start < len(data)], off[:-1][off[:-1] < len(data)])
        else:
            start = np.unique(off[:-1][np.diff(off) > 0])
        size = np.diff(np.append(start, len(data)))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state = np.full(len(start), self.start * width, np.int32)
        live = len(start)
        places, marks = [], []
        bound = self.accept * width
        at = 0
        while live:
            while live and size[live - 1] <= at:
                live -= 1
            if live < 16:
                break
            now = flat[state[:live] + kinds[start[:live] + at]]
            state[:live] = now
            hit = np.flatnonzero(now >= bound)
            if len(hit):
                places.append(start[hit] + at)
                marks.append(self.mark[now[hit] // width])
            at += 1
        for k in range(live):  # the few longest: byte by byte
            s, steps, first = int(state[k]), flat.tolist() if k == 0 else steps, int(start[k] + at)  # noqa: F821
            found = []
            for i, c in enumerate(kinds[first : int(start[k] + size[k])].tolist()):
                s = steps[s + c]
                if s >= bound:
                    found.append((first + i, int(self.mark[s // width])))
            if found:
                x, y = zip(*found, strict=True)
                places.append(np.array(x))
                marks.append(np.array(y))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p, m = np.concatenate(places), np.concatenate(marks)
        order = np.argsort(p, kind="stable")
        return p[order], m[order]


class Backward:
    """One rule's automaton for words reversed: where a match that ends here may begin."""

    def __init__(self, pattern: str):
        n = Nfa()
        s = n.state()
        end = _build(n, _Parser(pattern).parse(), s, True)
        self.n, self.end, self.first = n, end, n.closure(frozenset([s]))
        self.known: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def begin(self, data: bytes, low: int, end: int) -> int:
        """The smallest start >= low of a match that ends at ``end``, with no GUARD byte before it; -1 for none."""
        nodes, best, i = self.first, -1, end
        while i > low and nodes:
            i -= 1
            key = (nodes, data[i])
            new = self.known.get(key)
            if new is None:
                new = self.known[key] = self.n.closure(self.n.move(nodes, data[i]))
            nodes = new
            if self.end in nodes and (i == low or data[i - 1] not in GUARD):
                best = i
        return best
