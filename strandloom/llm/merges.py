"""What the two encoders share: tokens matched at every place of many words at once, and which tokens can stand side by side.

The words of a batch are laid one after another in one array with a gap after each, so one numpy call takes a step in all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
CHILD = 24  # bits of a slot that hold the node


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * ODD) >> np.uint64(64 - bits)).astype(np.int64)


class Trie:
    """Tokens (sequences of numbers from 1 on) by first symbols; 0 is the gap and stands in no token."""

    def __init__(self, tokens: Sequence[Sequence[int]], symbols: int):
        children: dict[int, int] = {}
        shorter, ends = [-1], []
        self.symbols = symbols + 1
        for t in tokens:
            node = 0
            for s in t:
                node = children.setdefault(node * self.symbols + s, len(children) + 1)
            ends.append(node)
        if len(children) + 1 >> CHILD:
            raise ValueError("too many tokens")
        token = [-1] * (len(children) + 1)
        for i, node in enumerate(ends):
            token[node] = i
        parent = dict(zip(children.values(), (k // self.symbols for k in children), strict=True))
        for node in range(1, len(token)):  # a parent comes before its children
            shorter.append(token[parent[node]] if token[parent[node]] >= 0 else shorter[parent[node]])
        self.token = np.array(token, np.int32)
        self.shorter = np.array([shorter[node] for node in ends], np.int32)  # by token, the longest token that it begins with
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.bits = max(4, (4 * len(children)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        keys, nodes = np.fromiter(children.keys(), np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children))
        at = _slots(keys, self.bits)
        while keys.size:
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[place] = keys[put] << CHILD | nodes[put]
            rest = np.ones(keys.size, bool)
            rest[put] = False
            keys, nodes, at = keys[rest], nodes[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.first = self._step(np.zeros(self.symbols, np.int64), np.arange(self.symbols))

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node under `node` at `symbol`, -1 if there is none."""
        key = node * self.symbols + symbol
        at = _slots(key, self.bits)
        found = self.slots[at]
        other = np.flatnonzero((found >> CHILD != key) & (found >= 0))
        while other.size:
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            found[other] = again = self.slots[at[other]]
            other = other[(again >> CHILD != key[other]) & (again >= 0)]
        return np.where(found < 0, -1, found & ((1 << CHILD) - 1))

    def matches(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: places where a token of that length begins, and the tokens. `symbols` ends with a gap."""
        node = self.first[symbols]
        at, length = np.flatnonzero(node >= 0), 1
        node = node[at]
        while at.size:
            token = self.token[node]
            hit = token >= 0
            yield at[hit], token[hit]
            node = self._step(node, symbols[at + length])
            on = node >= 0
            at, node, length = at[on], node[on], length + 1


class Merges:
    """Merges of neighbours whose union is a token, the least rank first, the leftmost of equals."""

    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        self.trees: dict[str, tuple[tuple[str, ...], tuple[str, ...]] | None] = {}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The parts of a short text when nothing merges any more, or as soon as there are `until`."""
        rank, parts = self.rank.get, list(text)
        while len(parts) > until:
            best, at, left = None, 0, ""
            for i, right in enumerate(parts):
                value = rank(left + right) if left else None
                if value is not None and (best is None or value < best):
                    best, at = value, i
                left = right
            if not at:
                break
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
        return parts

    def edges(self, token: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
        """The parts that stand at the token's left and right end while it grows from its characters; None if the merges
        don't give it, or if one of its parts has no lower rank than what it becomes part of."""
        if token not in self.trees:
            found = None
            if len(token) == 1:
                found = (token,), (token,)
            elif len(parts := self.merged(token, 2)) == 2 and token in self.rank:
                left, right = map(self.edges, parts)
                if left and right and all(len(p) == 1 or self.rank[p] < self.rank[token] for p in parts):
                    found = (*left[0], token), (*right[1], token)
            self.trees[token] = found
        return self.trees[token]

    def beside(self, a: str, b: str) -> bool:
        """Whether the merges of a and b together give just these two ("" stands for nothing).

        As long as nothing merges across the border each side grows as it does alone, in the order of the ranks. So the parts that meet
        at the border are followed from the characters up; what they would merge to mustn't come before either becomes part of more.
        """
        one, two = self.edges(a) if a else None, self.edges(b)
        if not a and two:
            return True
        if not one or not two:
            return self.merged(a + b) == [x for x in (a, b) if x]
        rank, x, y, i, j = self.rank, one[1], two[0], 1, 1
        while True:
            across = rank.get(x[i - 1] + y[j - 1])
            left = rank[x[i]] if i < len(x) else None
            right = rank[y[j]] if j < len(y) else None
            if across is not None and (left is None or across < left) and (right is None or across <= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left <= right):
                i += 1
            else:
                j += 1


class Pairs:
    """Answers to `ask(a, b)` for arrays of token numbers (a may be -1), kept in a table of fixed size; pairs it lacks are asked one by one."""

    def __init__(self, ask: Callable[[int, int], bool], tokens: int, bits: int = 20):
        self.ask, self.tokens, self.bits = ask, tokens, bits
        self.slots = np.full(1 << bits, -1, np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) + 1) * self.tokens + b
        found = self.slots[_slots(key, self.bits)]
        lacking = np.flatnonzero(found >> 1 != key)
        if lacking.size:
            new, which = np.unique(key[lacking], return_inverse=True)
            new = new << 1 | np.array([self.ask(k // self.tokens - 1, k % self.tokens) for k in new.tolist()], np.int64)
            self.slots[_slots(new >> 1, self.bits)] = new
            found[lacking] = new[which]
        return (found & 1).astype(bool)


class Kept(dict):
    """A table of what `make` gives for keys, filled for many at once. Beyond `most` entries those not among the keys asked for go."""

    def __init__(self, make: Callable[[list[str]], Sequence], most: int):
        super().__init__()
        self.make, self.most = make, most

    def fill(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.most:
            stay = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(stay)
        self.update(zip(new, self.make(new), strict=True))

    def empty(self) -> None:
        self.clear()


def laid_out(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words laid one after another with a gap after each, and by place its distance from its word's start."""
    n = np.asarray(lengths, np.int64)
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    return starts, ends, np.arange(int(ends[-1]) + 1 if n.size else 0) - np.repeat(starts, n + 1)


def portions(texts: Sequence[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts of about `most` characters together, one text at least."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
