"""Search for pairs of texts whose common subsequence reaches a threshold, all letters of many pairs at a time.

Texts are ordered so that neighbours hold nearly the same letters. Tiles of neighbours whose letters must differ too much
are left out as a whole, then pairs whose letters differ too much; what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Letters fall into this many classes; bits tell whether a class has 1, 2, ... of them up to this number.
_CLASSES, _TIMES = 64, 4
#: Texts per tile, and pairs looked at or compared at once.
_TILE, _SEEN, _COMPARED = 64, 1 << 18, 1 << 14
#: Longer texts are compared one pair at a time.
_MOST = 256


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per letter of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Texts:
    """Texts with their sizes and, after laid_out, in an order of tiles with the letters of each as words of bits."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.size = np.array([*map(len, texts)], np.int64)
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")

    def _rows(self) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(self.texts)), self.size)
        return row, np.arange(len(self.flat)) - (np.cumsum(self.size) - self.size)[row]

    def letter_bits(self) -> np.ndarray:
        n = len(self.texts)
        counts = np.bincount(self._rows()[0] * _CLASSES + self.flat % _CLASSES, minlength=n * _CLASSES).reshape(n, _CLASSES)
        return np.concatenate([counts > k for k in range(_TIMES)], axis=1)

    def laid_out(self, bits: np.ndarray) -> Texts:
        words = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
        order, starts = _order(bits)
        out = Texts([self.texts[k] for k in order])
        out.words, out.starts = words[order], starts
        out.any = np.bitwise_or.reduceat(out.words, starts)
        out.all = np.bitwise_and.reduceat(out.words, starts)
        out.longest = np.maximum.reduceat(out.size, starts)
        out.tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(out.texts))))
        return out

    def coded(self, alphabet: np.ndarray) -> None:
        """Letters as numbers of the alphabet; what lies behind the end of a text, or in no text of the alphabet, has the last number."""
        kind = np.uint8 if len(alphabet) < 256 else np.uint32
        row, at = self._rows()
        letter = np.minimum(np.searchsorted(alphabet, self.flat), max(len(alphabet) - 1, 0))
        known = (at < _MOST) & (alphabet[letter] == self.flat) if len(alphabet) else np.zeros(len(row), bool)
        self.codes = np.full((len(self.texts), min(_MOST, int(self.size.max(initial=0)))), len(alphabet), kind)
        self.codes[row[known], at[known]] = letter[known]


def _order(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in tiles, halved again and again by the bit that divides them most evenly; and where the tiles start."""
    parts, stack = [], [np.arange(len(bits))]
    while stack:
        rows = stack.pop()
        if len(rows) > _TILE:
            ones = bits[rows].sum(0, dtype=np.int64)
            k = int(np.abs(2 * ones - len(rows)).argmin())
            if 0 < ones[k] < len(rows):
                has = bits[rows, k]
                stack += [rows[has], rows[~has]]
                continue
        parts += [rows[x : x + _TILE] for x in range(0, len(rows), _TILE)]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def _masks(left: Texts, low: int, high: int, letters: int, words: int) -> np.ndarray:
    """Of each text low..high, of each letter and 64 places: the places where the letter stands."""
    out = np.zeros((words, (high - low) * (letters + 1)), np.uint64)
    codes = left.codes[low:high, : 64 * words]
    row, at = np.nonzero(codes < letters)
    np.bitwise_or.at(out, (at // 64, row * (letters + 1) + codes[row, at]), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def _common(masks: np.ndarray, letters: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of common subsequences of the texts q of the masks with the texts of codes, one row each."""
    columns = np.ascontiguousarray(codes.T)
    base = (q * (letters + 1)).astype(np.int32)
    rows = [np.full(len(q), 2**64 - 1, np.uint64) for _ in masks]
    at, hit, up = np.empty(len(q), np.int32), np.empty(len(q), np.uint64), np.empty(len(q), np.uint64)
    for column in columns:
        np.add(base, column, out=at, casting="unsafe")
        carry = None
        for k, row in enumerate(rows):
            np.take(masks[k], at, out=hit, mode="clip")
            hit &= row
            np.add(row, hit, out=up)
            if len(rows) > 1:
                over = up < row
                if carry is not None:
                    up += carry
                    over |= up < carry
                carry = over.astype(np.uint64)
            row ^= hit
            row |= up
    return sum(64 - np.bitwise_count(row).astype(np.int64) for row in rows)


def _scores(left: Texts, right: Texts, letters: int, low: int, high: int, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs of text q of left, all within low..high, and text c of right."""
    common = np.zeros(len(q), np.int64)
    wide = np.maximum(left.size[q], right.size[c]) > _MOST
    for k in np.flatnonzero(wide):
        common[k] = common_subsequence(left.texts[q[k]], right.texts[c[k]])
    words = (left.size[q] + 63) // 64
    for w in np.unique(words[~wide]):
        of = np.flatnonzero(~wide & (words == w))
        masks = _masks(left, low, high, letters, max(int(w), 1))
        of = of[np.argsort(right.size[c[of]], kind="stable")]
        for x in range(0, len(of), _COMPARED):
            part = of[x : x + _COMPARED]
            common[part] = _common(masks, letters, q[part] - low, right.codes[c[part], : right.size[c[part[-1]]]])
    return 200.0 * common / np.maximum(left.size[q] + right.size[c], 1)


def scores(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of a[k] and b[k] for all k, two empty texts being equal."""
    left, right = Texts(a), Texts(b)
    alphabet = np.unique(left.flat)
    for side in (left, right):
        side.coded(alphabet)
    out = np.where(left.size + right.size > 0, 0.0, 100.0)
    for low in range(0, len(a), _TILE):
        k = np.arange(low, min(low + _TILE, len(a)))
        k = k[out[k] == 0]
        out[k] = _scores(left, right, len(alphabet), low, min(low + _TILE, len(a)), k, k)
    return out


def _met(left: Texts, right: Texts, slack: float, t: int, low: int, high: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the texts of tile t with texts of right whose letters do not differ too much."""
    apart = np.bitwise_count(left.all[t] & ~right.any).sum(1, dtype=np.int64) + np.bitwise_count(right.all & ~left.any[t]).sum(1, dtype=np.int64)
    kept = apart <= slack * (left.longest[t] + right.longest) + 1e-9
    if same:
        kept[:t] = False
    cand = np.flatnonzero(kept[right.tile])
    # A first look by few words and a bound that is the sum of one for each side.
    most = [np.ceil(slack * x + 1e-9) for x in (left.size[low:high], right.size)]
    kind = np.uint8 if max(m.max() for m in most) < 128 else np.uint32
    most = [m.astype(kind) for m in most]
    words = left.words.shape[1]
    step = max(1, _SEEN // (high - low))
    for x in range(0, len(cand), step):
        part = cand[x : x + step]
        bound = most[0][:, None] + most[1][part]
        apart = np.bitwise_count(left.words[low:high, :1] ^ right.words[part, 0])
        seen = 1
        while seen < min(words, 3) and 8 * np.count_nonzero(apart <= bound) > apart.size:
            apart += np.bitwise_count(left.words[low:high, seen, None] ^ right.words[part, seen])
            seen += 1
        at = np.flatnonzero(apart <= bound)
        q, c = np.divmod(at, len(part))
        n, q, c = apart.ravel()[at].astype(np.int64), q + low, part[c]
        for k in range(seen, words):
            n += np.bitwise_count(left.words[q, k] ^ right.words[c, k])
        a, b = left.size[q], right.size[c]
        near = np.maximum(n, np.abs(a - b)) <= np.floor(slack * (a + b) + 1e-9)
        if same:
            near &= q < c
        yield q[near], c[near]


def near_pairs(one: list[str], other: list[str] | None, threshold: float) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """Pairs of a text of one and a text of other (none: of two texts of one) that reach the threshold, and their scores."""
    if not one or other is not None and not other:
        return
    slack = 1 - threshold / 100
    sides = [Texts(x) for x in (one, other) if x is not None]
    bits = [s.letter_bits() for s in sides]
    # The bits that divide the texts most evenly come first; those that are the same in all are left out.
    share = np.concatenate(bits).mean(0)
    varied = np.argsort(np.abs(share - 0.5), kind="stable")
    varied = varied[: max(64, -64 * (-int(np.count_nonzero((share > 0) & (share < 1))) // 64))]
    left, *more = [s.laid_out(np.ascontiguousarray(b[:, varied])) for s, b in zip(sides, bits)]
    right = more[0] if more else left
    alphabet = np.unique(left.flat)
    for side in (left, *more):
        side.coded(alphabet)
    bounds = [*left.starts.tolist(), len(one)]
    for t, (low, high) in enumerate(zip(bounds, bounds[1:])):
        found = list(_met(left, right, slack, t, low, high, other is None))
        q, c = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if not len(q):
            continue
        score = _scores(left, right, len(alphabet), low, high, q, c)
        hit = np.flatnonzero(score >= threshold)
        if len(hit):
            yield [left.texts[k] for k in q[hit]], [right.texts[k] for k in c[hit]], score[hit]
