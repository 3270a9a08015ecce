"""A compact trie of sorted words in flat arrays, and the words of it at edit distance one from others, depth first.

Nodes below which only one word is left are leaves: the rest of that word is compared where it lies, so a trie has fewer
than two nodes a word however long words are. Children of a node are neighbours in the arrays, in the order of their letters;
a node says by a bit set which it has.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

#: Letters by code: a-z, then U+00C0 to U+00FF; the order of codes is that of code points.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[LETTERS] = np.arange(len(LETTERS))


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in one array, and the offset of each."""
    start = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=start[1:])
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)], start


@dataclass
class Trie:
    low: np.ndarray  # bit set of the children's codes below 64
    high: np.ndarray  # and of the others
    first: np.ndarray  # first child
    label: np.ndarray  # code that leads to the node
    leaf: np.ndarray  # the only word below, or -1
    end: np.ndarray  # the word that ends at an inner node, or -1
    depth: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Trie:
        with np.load(io.BytesIO(data)) as x:
            return Trie(**{k: x[k] for k in x.files})

    def words(self, at: np.ndarray) -> list[str]:
        text = LETTERS[self.codes].tobytes()
        return [text[a:b].decode("latin-1") for a, b in zip(self.start[at].tolist(), self.start[at + 1].tolist())]


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def build(words: list[str], count: np.ndarray) -> Trie:
    """words: sorted by code point, distinct."""
    codes, start = encode(words)
    length = np.diff(start)
    lo, hi = np.array([0]), np.array([len(words)])  # words below the nodes of a level
    levels, made, depth = [], 1, 0
    label = np.zeros(1, np.uint8)
    while len(lo):
        inner = hi - lo > 1
        leaf = np.where(hi - lo == 1, lo, -1)
        ends = np.zeros(len(lo), bool)
        ends[inner] = length[lo[inner]] == depth  # the first of a node, as it is the shortest
        end = np.where(ends, lo, -1)
        lo, hi = (lo + ends)[inner], hi[inner]
        size = hi - lo
        row = np.repeat(lo, size) + _ranges(size)
        of = np.repeat(np.arange(len(lo)), size)
        code = codes[start[row] + depth]
        new = np.ones(len(row), bool)
        new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        bit = np.uint64(1) << (code[at] & np.uint8(63)).astype(np.uint64)
        low, high, first = np.zeros(len(leaf), np.uint64), np.zeros(len(leaf), np.uint64), np.zeros(len(leaf), np.int32)
        if len(at):
            heads = np.flatnonzero(np.diff(of[at], prepend=-1))
            low[inner] = np.bitwise_or.reduceat(np.where(code[at] < 64, bit, np.uint64(0)), heads)
            high[inner] = np.bitwise_or.reduceat(np.where(code[at] < 64, np.uint64(0), bit), heads)
            first[inner] = made + heads
        levels.append((low, high, first, label, leaf.astype(np.int32), end.astype(np.int32), np.full(len(leaf), depth, np.int32)))
        made, depth, label = made + len(at), depth + 1, code[at]
        lo, hi = row[at], np.append(row[at[1:] - 1], row[-1:])[: len(at)] + 1
    return Trie(*[np.concatenate(x) for x in zip(*levels)], codes, start, np.asarray(count, np.int64))


def _child(t: Trie, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether nodes have a child of this code, and which."""
    bit = np.uint64(1) << (code & np.uint8(63)).astype(np.uint64)
    low, high, small = t.low[node], t.high[node], code < 64
    has = np.where(small, low, high) & bit != 0
    before = np.where(small, np.bitwise_count(low & (bit - np.uint64(1))), np.bitwise_count(low) + np.bitwise_count(high & (bit - np.uint64(1))))
    return has, t.first[node] + before


def _same_rest(t: Trie, word: np.ndarray, depth: np.ndarray, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether what follows `depth` in words of the trie equals codes[at:end]."""
    a, b = t.start[word] + depth, t.start[word + 1]
    ok = b - a == end - at
    live = np.flatnonzero(ok & (at < end))
    a, c, e = a[live], at[live].copy(), end[live]
    while len(live):
        same = t.codes[a] == codes[c]
        ok[live[~same]] = False
        a, c = a + 1, c + 1
        go = same & (c < e)
        live, a, c, e = live[go], a[go], c[go], e[go]
    return ok


def _one_apart(t: Trie, word: np.ndarray, depth: np.ndarray, codes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether what follows `depth` in words of the trie is one edit from codes[at:end]."""
    a, b = t.start[word] + depth, t.start[word + 1]
    more = (b - a) - (end - at)
    ok = np.zeros(len(word), bool)
    live = np.flatnonzero(np.abs(more) <= 1)
    x, y = a[live].copy(), at[live].copy()
    go = np.ones(len(live), bool)
    while go.any():  # to the first difference
        go = go & (x < b[live]) & (y < end[live])
        go[go] = t.codes[x[go]] == codes[y[go]]
        x, y = x + go, y + go
    differ = (x < b[live]) | (y < end[live])
    live, x, y, m = live[differ], x[differ], y[differ], more[live][differ]
    ok[live] = _same_rest(t, word[live], x + (m >= 0) - t.start[word[live]], codes, y + (m <= 0), end[live])
    return ok


def neighbours(t: Trie, codes: np.ndarray, start: np.ndarray, at_once: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(row, word of the trie) of every word at edit distance one, each once; rows are the words codes[start[i]:start[i + 1]].

    States (row, node, place in the row) of the automaton lie on a stack, the deepest on top, and are taken some at a time.
    An edit has one place: a letter is inserted after those equal to it, and deleted as the last of those equal to it.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(start) - 1)
    stack = [(False, rows[k : k + 1024], np.zeros(len(rows[k : k + 1024]), np.int64), start[k : min(k + 1024, len(rows))]) for k in range(0, len(rows), 1024)] if len(t.count) else []
    while stack:
        edited, row, node, at = stack.pop()
        if len(row) > at_once:
            stack.append((edited, row[at_once:], node[at_once:], at[at_once:]))
            row, node, at = row[:at_once], node[:at_once], at[:at_once]
        end = start[row + 1]
        leaf = t.leaf[node]
        single = np.flatnonzero(leaf >= 0)
        if len(single):
            same = _same_rest if edited else _one_apart
            hit = single[same(t, leaf[single], t.depth[node[single]], codes, at[single], end[single])]
            found.append((row[hit], leaf[hit]))
            rest = leaf < 0
            row, node, at, end = row[rest], node[rest], at[rest], end[rest]
        over = at == end
        if edited:
            hit = np.flatnonzero(over & (t.end[node] >= 0))
            found.append((row[hit], t.end[node[hit]]))
        here = np.flatnonzero(~over)
        code = np.full(len(row), 255, np.uint8)
        code[here] = codes[at[here]]
        has, child = _child(t, node[here], code[here])
        go = here[has]
        step = (edited, row[go], child[has].astype(np.int64), at[go] + 1)
        if len(go):
            stack.append(step)
        if edited or not len(row):
            continue
        last = np.ones(len(here), bool)
        more = at[here] + 1 < end[here]
        last[more] = codes[at[here[more]] + 1] != code[here[more]]
        gone = here[last]
        children = (np.bitwise_count(t.low[node]) + np.bitwise_count(t.high[node])).astype(np.int64)
        of = np.repeat(np.arange(len(row)), children)
        child = t.first[node[of]] + _ranges(children)
        other = t.label[child] != code[of]
        of, child = of[other], child[other]
        put = ~over[of]
        stack.append((True, np.concatenate([row[gone], row[of], row[of[put]]]), np.concatenate([node[gone], child, child[put]]), np.concatenate([at[gone] + 1, at[of], at[of[put]] + 1])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
