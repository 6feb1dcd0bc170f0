"""Approximate search of short patterns in many windows at once: Myers' bit-parallel recurrence, numpy over the rows.

Patterns may have any length: beyond 64 letters a column takes several words. Many patterns that begin with the text, such as barcodes,
are searched together in a trie.

Two modes: `infix`, where the pattern may lie anywhere in the text, and `prefix`, where it begins with the text. Distances over the
bound are misses. All ends that reach the least distance are reported, ascending; an infix start is the least that gives it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ampliflow.functions.dna import IUPAC

FAR = 1 << 28


def same_letters(letter: str, ambiguous: bool = True) -> set[str]:
    """The letters that equal a letter. Ambiguity works both ways: of pattern and text."""
    if not ambiguous:
        return {letter}
    return {letter} | set(IUPAC.get(letter, "")) | {code for code, bases in IUPAC.items() if letter in bases}


def equalities(pattern: str, ambiguous: bool = True) -> np.ndarray:
    """For each byte, the bits of the pattern's letters that equal it, 64 letters to a word."""
    out = np.zeros((256, -(-max(1, len(pattern)) // 64)), np.uint64)
    for i, p in enumerate(pattern):
        for c in same_letters(p, ambiguous):
            if ord(c) < 256:
                out[ord(c), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    return out


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of a matrix, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def end_scores(rows: np.ndarray, size: np.ndarray, equal: np.ndarray, length: int | np.ndarray, prefix: bool, pattern: np.ndarray | None = None) -> np.ndarray:
    """Least edits of the pattern for each row and end position; FAR beyond a row's text. equal: equalities of the pattern, and length
    its letters. With pattern, each row has its own one: a place in equal (patterns x 256 x words), and length is an array of the rows.

    A column of the matrix is one or more words of vertical differences; what leaves a word at its top (one more, or one less) enters
    the next one. Only rows whose patterns end in a word read their score there."""
    n, width = rows.shape
    lengths = np.broadcast_to(np.asarray(length), (n,))
    words, one, zero = equal.shape[-1], np.uint64(1), np.uint64(0)
    top, last = one << ((lengths - 1) % 64).astype(np.uint64), (lengths - 1) // 64
    plus, minus = [np.full(n, np.uint64(2**64 - 1)) for _ in range(words)], [np.zeros(n, np.uint64) for _ in range(words)]
    score, out = lengths.astype(np.int32), np.full((n, width), FAR, np.int32)
    ends = [True] if words == 1 else [last == w for w in range(words)]
    high = np.uint64(63)
    for j in range(width):
        eq = equal[rows[:, j]] if pattern is None else equal[pattern, rows[:, j]]
        grown, shrunk = np.uint64(prefix), zero  # what enters the first word
        for w in range(words):
            x = eq[:, w] | minus[w] | shrunk
            d = (((x & plus[w]) + plus[w]) ^ plus[w]) | x
            h_plus, h_minus = minus[w] | ~(d | plus[w]), plus[w] & d
            if words == 1:
                score = score + ((h_plus & top) != 0) - ((h_minus & top) != 0)
            elif ends[w].any():
                score = score + ends[w] * (((h_plus & top) != 0).astype(np.int32) - ((h_minus & top) != 0))
            up, down = h_plus >> high, h_minus >> high
            h_plus, h_minus = (h_plus << one) | grown, (h_minus << one) | shrunk
            plus[w], minus[w] = h_minus | ~(d | h_plus), h_plus & d
            grown, shrunk = up, down
        out[:, j] = score
    out[np.arange(width) >= size[:, None]] = FAR
    return out


def search(rows: np.ndarray, size: np.ndarray, pattern: str, bound: int, prefix: bool = False, ambiguous: bool = True, starts: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For each row the least distance (-1 over the bound) and the locations (start, end), ends inclusive and ascending."""
    n, length = len(rows), len(pattern)
    distance, places = np.full(n, -1, np.int64), [[] for _ in range(n)]
    if not n or not rows.shape[1] or not length:
        return distance, places
    scores = end_scores(rows, size, equalities(pattern, ambiguous), length, prefix)
    least = scores.min(1)
    hit = least <= bound
    distance[hit] = least[hit]
    at, ends = np.nonzero((scores == least[:, None]) & hit[:, None])
    begin = np.zeros(len(at), np.int64)
    if not prefix and starts and len(at):
        # From each end backwards: the longest reversed prefix with the least distance.
        reach = length + bound
        back = ends[:, None] - np.arange(reach)
        own = np.where(back >= 0, rows[at[:, None], np.maximum(back, 0)], 0).astype(np.uint8)
        again = end_scores(own, np.minimum(reach, ends + 1), equalities(pattern[::-1], ambiguous), length, True)
        good = again == least[at][:, None]
        begin = ends - (reach - 1 - good[:, ::-1].argmax(1))
    for i, s, e in zip(at.tolist(), begin.tolist(), ends.tolist(), strict=True):
        places[i].append((s, e))
    return distance, places


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _coded(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of places in letters, -1 after their ends, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(size.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.searchsorted(letters, _codes("".join(texts)))
    return out, size


def distance_counts(own: list[str], others: list[str], cells: int = 1 << 17) -> np.ndarray:
    """How many pairs of a word of own and one of others have each edit distance: counts by distance. cells: of a column held at a time,
    about.

    Words of others are read letter by letter in the order of the alphabet, so that what begins alike is read once: a level holds a
    column of vertical differences for each beginning and each word of own, from which the next level's are made."""
    if not own or not others:
        return np.zeros(1, np.int64)
    others, letters = sorted(others), np.unique(_codes("".join(own) + "".join(others)))
    rows, lengths = _coded(own, letters)
    columns, size = _coded(others, letters)
    longest, depth = rows.shape[1], columns.shape[1]
    counts = np.zeros(max(longest, depth) + 1, np.int64)
    kind = np.dtype(np.uint16 if longest <= 16 else np.uint32 if longest <= 32 else np.uint64)
    bits, words, one = 8 * kind.itemsize, -(-max(1, longest) // 64), kind.type(1)
    equal, mask = np.zeros((words, len(letters), len(own)), kind), np.zeros((words, len(own)), kind)
    for i in range(longest):
        bit = one << kind.type(i % bits)
        mask[i // bits] |= (lengths > i) * bit
        for n in range(len(letters)):
            equal[i // bits, n] |= (rows[:, i] == n) * bit
    shared = np.zeros(len(others), np.int64)
    shared[1:] = np.logical_and.accumulate(columns[1:] == columns[:-1], 1).sum(1)
    levels, node = [], np.zeros(len(others), np.int64)
    for d in range(1, depth + 1):
        there = np.flatnonzero(size >= d)
        new = (shared[there] < d) | (there == 0)
        first, at = there[new], np.cumsum(new) - 1
        levels.append((node[first], columns[first, d - 1], at[size[there] == d]))
        node[there] = at
    counts += (size == 0).sum() * np.bincount(lengths, minlength=len(counts))
    step = max(1, cells // len(others))
    for k in range(0, len(own), step):
        eq_of, masks = equal[:, :, k : k + step], mask[:, k : k + step]
        plus = [np.full((1, eq_of.shape[2]), ~kind.type(0)) for _ in range(words)]
        minus = [np.zeros((1, eq_of.shape[2]), kind) for _ in range(words)]
        for d, (parent, letter, ends) in enumerate(levels, 1):
            grown, shrunk = one, kind.type(0)  # what enters the first word
            for w in range(words):
                p, m, eq = (np.take(a, at, 0, mode="clip") for a, at in ((plus[w], parent), (minus[w], parent), (eq_of[w], letter)))
                eq |= m
                eq |= shrunk
                t = eq & p
                t += p
                t ^= p
                t |= eq
                h_plus = t | p
                np.invert(h_plus, h_plus)
                h_plus |= m
                p &= t
                up, down = (h_plus >> kind.type(bits - 1), p >> kind.type(bits - 1)) if w + 1 < words else (grown, shrunk)
                h_plus <<= one
                h_plus |= grown
                p <<= one
                p |= shrunk
                np.bitwise_and(h_plus, t, m)
                t |= h_plus
                np.invert(t, t)
                p |= t
                plus[w], minus[w], grown, shrunk = p, m, up, down
            if len(ends):
                total = np.full((len(ends), masks.shape[1]), d, np.uint8 if len(counts) < 256 else np.int64)
                for w in range(words):
                    total += np.bitwise_count(plus[w][ends] & masks[w])
                    total -= np.bitwise_count(minus[w][ends] & masks[w])
                if len(counts) <= 40:
                    counts += [np.count_nonzero(total == n) for n in range(len(counts))]
                else:
                    counts += np.bincount(total.ravel(), minlength=len(counts))
    return counts


class Trie:
    """Patterns as paths of letters from one root. Nodes lie level by level; a node's children lie together."""

    def __init__(self, patterns: list[str] | pa.Array, ambiguous: bool = True):
        words = np.unique(np.asarray(patterns, str)) if len(patterns) else np.zeros(0, "U1")
        self.words = pa.array(words, pa.string())
        n, size = len(words), np.char.str_len(words).astype(np.int32)
        codes = words.view(np.uint32).reshape(n, -1) if n else np.zeros((0, 1), np.uint32)
        self.depth = int(size.max(initial=0))
        kinds = np.unique(codes[codes > 0])
        self.equal = np.zeros((len(kinds), 256), bool)
        for i, code in enumerate(kinds.tolist()):
            self.equal[i, [ord(c) for c in same_letters(chr(code), ambiguous) if ord(c) < 256]] = True
        shared = np.zeros(n, np.int32)  # letters that a pattern begins with as the one before it
        shared[1:] = (codes[1:] != codes[:-1]).argmax(1)
        kind = np.int8 if len(kinds) < 128 else np.int32
        levels, node, letter = [], np.zeros(n, np.int32), np.zeros(1, kind)
        for d in range(self.depth + 1):
            final, ends = np.full(len(letter), -1, np.int32), np.flatnonzero(size == d)
            final[node[ends]] = ends
            there = np.flatnonzero(size > d)
            new = shared[there] <= d
            levels.append((np.bincount(node[there[new]], minlength=len(letter)).astype(kind), letter, final))
            letter = np.searchsorted(kinds, codes[there[new], d]).astype(kind) if len(there) else letter[:0]
            node[there] = np.cumsum(new) - 1
        self.count, self.letter, self.final = (np.concatenate(c) for c in zip(*levels, strict=True))
        self.first = self._first()

    def _first(self) -> np.ndarray:
        return 1 + np.cumsum(self.count, dtype=np.int64) - self.count

    @property
    def patterns(self) -> np.ndarray:
        return np.asarray(self.words, str)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("words", "first")}  # tasks need the places of patterns only

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.first = self._first()

    def search(self, rows: np.ndarray, size: np.ndarray, bound: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """All patterns that begin a row within the bound: row, pattern (a place in self.patterns), least distance, and the ends that
        reach it, ascending. By row, then pattern. cells: of the distance matrix held at a time, about."""
        step = max(1, cells // (2 * bound + 1))
        parts = [self._search(rows[i : i + step], size[i : i + step], bound, i, step) for i in range(0, len(rows), step)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        return *(np.concatenate([p[k] for p in parts]) for k in range(3)), [e for p in parts for e in p[3]]

    def _search(self, rows: np.ndarray, size: np.ndarray, bound: int, shift: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        # A state is a node and a row, with the distances of the node's path to the row's first d - bound .. d + bound letters (a band
        # round the diagonal: what lies beyond it is over the bound). A state whose distances are all over the bound is left, with all
        # patterns below its node.
        n, band = len(rows), np.arange(-bound, bound + 1)
        far, width = bound + 1, rows.shape[1]
        node, row = np.zeros(n, np.int64), np.arange(n)
        dist = np.where((band >= 0) & (band <= size[:, None]), np.minimum(band, far), far).astype(np.int16)
        steps = np.arange(len(band), dtype=np.int16)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        # Where a level would have more than so many states, a half of those above goes first: what is held is bounded by the depth.
        waiting = [(1, node, row, dist)]
        while waiting:
            d, node, row, dist = waiting.pop()
            many = self.count[node]
            if len(node) > 1 and many.sum() > most:
                half = len(node) // 2
                waiting += [(d, node[half:], row[half:], dist[half:]), (d, node[:half], row[:half], dist[:half])]
                continue
            of = np.repeat(np.arange(len(node)), many)
            node = self.first[node][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            row, dist = row[of], dist[of]
            place = d + band
            text = rows[row[:, None], np.clip(place - 1, 0, max(0, width - 1))] if width else np.zeros((len(row), len(band)), np.uint8)
            new = dist + ~self.equal[self.letter[node][:, None], text]
            new[:, :-1] = np.minimum(new[:, :-1], dist[:, 1:] + 1)
            beyond = (place < 0) | (place > size[row][:, None])
            new[beyond] = far
            new = np.minimum.accumulate(new - steps, 1) + steps
            new[beyond] = far
            dist = np.minimum(new, far).astype(np.int16)
            alive = (dist <= bound).any(1)
            node, row, dist = node[alive], row[alive], dist[alive]
            whole = np.flatnonzero(self.final[node] >= 0)
            if len(whole):
                own = np.where(place >= 1, dist[whole], far)
                least = own.min(1)
                hit = least <= bound
                found.append((row[whole][hit], self.final[node[whole][hit]], least[hit].astype(np.int64), np.where(own[hit] == least[hit][:, None], place - 1, -1)))
            if len(node) and d < self.depth:
                waiting.append((d + 1, node, row, dist))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        row, pattern, least = (np.concatenate([f[k] for f in found]) for k in range(3))
        ends = [[x for x in e if x >= 0] for f in found for e in f[3].tolist()]
        order = np.lexsort((pattern, row))
        return row[order] + shift, pattern[order], least[order], [ends[k] for k in order.tolist()]
