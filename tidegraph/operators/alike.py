"""Blocks of names compared pair by pair as bits, without leaving a pair out.

A name's trigrams and letters are sets of bits. The bits that two names share
bound from above what they can have in common: no measure can be higher than a
pair with that many common trigrams or letters allows, so a pair below the bound
is settled by a few machine words. What passes is bounded again by wider sets of
bits; edit distance, Jaro and the longest common subsequence of what is left are
computed for many pairs at once, one machine word per name. Names of more than
64 letters take the plain computations instead.

If only the best few of each name are wanted (``Best``), a name's bar is its last
of these so far. A pair that reaches it shares so many kinds of trigrams that one
of the name's rarest is among them, so only names that have one of these are
compared, as bits and then exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np

from tidegraph.functions.text import jaro_winkler

#: Letters of a machine word, pairs that are computed at once, cells of their table of letters.
WORD, BATCH, CELLS = 64, 65_536, 4_000_000
SLACK = 1e-6
_ALL = np.array([(1 << k) - 1 for k in range(WORD + 1)], np.uint64)
_ONE = np.uint64(1)


def grams_of(s: str) -> dict[str, int]:
    return Counter(s[j : j + 3] for j in range(len(s) - 2))


def cosine_of(x: dict[str, int], y: dict[str, int]) -> float:
    """Cosine of two names' trigram counts; 0 if one has none."""
    if not x or not y:
        return 0.0
    norm = lambda v: sum(n * n for n in v.values()) ** 0.5
    return sum(n * y.get(g, 0) for g, n in x.items()) / (norm(x) * norm(y))


def edits_of(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def subsequence_of(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Rule:
    """A pair is wanted if one of the measures named reaches its threshold; ``weight`` is that of edits in the hybrid."""

    edits: float | None = None
    cosine: float | None = None
    hybrid: float | None = None
    fuzzy: float | None = None  #: the greater of difflib's ratio and Jaro-Winkler
    weight: float = 0.6
    slack: float = 1e-9  #: how far edits, cosine and hybrid may fall short, for engines that round otherwise


def _runs(rows: np.ndarray) -> np.ndarray:
    """How many times the value of each cell stands before it in its row; rows are sorted."""
    at = np.arange(rows.shape[1])
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return at - np.maximum.accumulate(np.where(first, at, 0), axis=1)


def _bits(where: np.ndarray, valid: np.ndarray, words: int) -> np.ndarray:
    bit = np.where(valid, _ONE << (where & np.uint64(63)), np.uint64(0))
    word = (where >> np.uint64(6)).astype(np.int8)
    return np.stack([np.bitwise_or.reduce(np.where(word == w, bit, np.uint64(0)), axis=1) for w in range(words)])


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=0, dtype=np.int32)


_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _gram_places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum((grams * _K1) >> np.uint64(56), np.uint64(254)), (grams * _K2) >> np.uint64(55)


def _letter_places(letters: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The first four of each small Latin letter have places of their own among 128, so they can't be taken for others."""
    latin = (letters >= 98) & (letters < 124) & (nth < 4)  # codes are one higher than letters
    other = ((letters * _K1 + nth * _K3) * _K2) >> np.uint64(57)
    return np.where(latin, (letters - np.uint64(98)) * np.uint64(4) + nth, other)


class Block:
    """Names by length: letters as codes, bits of trigrams (narrow and wide) and letters, what the bits don't tell apart."""

    def __init__(self, names: list[str]):
        self.names = names = sorted(names, key=len)
        n = len(names)
        self.size = np.array([len(s) for s in names], np.int64)
        width = int(max(3, min(WORD, self.size.max(initial=0))))
        codes = np.array([s[:width] for s in names], f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64) + _ONE
        inside = np.arange(width) < self.size[:, None]
        self.codes = np.where(inside, codes, np.uint64(0))
        self.types, self.square = np.zeros(n, np.int64), np.zeros(n, np.int64)
        shift = np.uint64(21)
        grams = (self.codes[:, :-2] << (shift + shift)) | (self.codes[:, 1:-1] << shift) | self.codes[:, 2:]
        grams = np.sort(np.where(inside[:, 2:], grams, np.uint64(0)), axis=1)
        self.trigrams = grams[:, ::-1]  # behind the last trigram: 0
        valid, nth = grams > 0, _runs(grams)
        self.types, self.square = (valid & (nth == 0)).sum(axis=1), np.where(valid, 2 * nth + 1, 0).sum(axis=1)
        narrow, wide = _gram_places(grams)
        self.narrow, self.wide = _bits(narrow, valid, 4), _bits(wide, valid, 8)
        letters = np.sort(self.codes, axis=1)
        self.letters = _bits(_letter_places(letters, _runs(letters).astype(np.uint64)), letters > 0, 2)
        for i in np.flatnonzero(self.size > width):
            self._long(i, names[i])
        self.narrow_rest, self.wide_rest, self.letters_rest = self.types - _count(self.narrow), self.types - _count(self.wide), self.size - _count(self.letters)
        self.first = self.codes[:, :4]

    def _long(self, i: int, s: str) -> None:
        counts = grams_of(s)
        self.types[i], self.square[i] = len(counts), sum(k * k for k in counts.values())
        code = [ord(x) + 1 for x in s]
        grams = np.array([[code[j] << 42 | code[j + 1] << 21 | code[j + 2] for j in range(len(s) - 2)]], np.uint64)
        narrow, wide = _gram_places(grams)
        self.narrow[:, i], self.wide[:, i] = _bits(narrow, grams > 0, 4)[:, 0], _bits(wide, grams > 0, 8)[:, 0]
        letters = np.sort(np.array([code], np.uint64), axis=1)
        self.letters[:, i] = _bits(_letter_places(letters, _runs(letters).astype(np.uint64)), letters > 0, 2)[:, 0]


def _bounds(grams, letters, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of edit similarity and trigram cosine of names (size, types, square) that have so many kinds of trigrams and letters in common.

    An edit spoils at most three kinds of trigrams. The counts of common kinds can't
    be more than what the others leave of each name's squares.
    """
    (la, ta, wa), (lb, tb, wb) = x, y
    longer = np.maximum(la, lb)
    d = np.maximum(longer - letters, -(-(np.maximum(ta, tb) - grams) // 3))
    share = lambda t, w: np.clip(1 - (t - grams) / np.maximum(w, 1), 0, 1) * (w > 0)
    return 1 - np.maximum(d, 0) / longer, np.sqrt(share(ta, wa) * share(tb, wb))


def _may(rule: Rule, edits: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Whether edits, cosine or hybrid may reach the threshold."""
    out = np.zeros(np.broadcast(edits, cosine).shape, bool)
    if rule.edits is not None:
        out |= edits >= rule.edits - SLACK
    if rule.cosine is not None:
        out |= cosine >= rule.cosine - SLACK
    if rule.hybrid is not None:
        out |= rule.weight * edits + (1 - rule.weight) * cosine >= rule.hybrid - SLACK
    return out


def _least(most: np.ndarray, possible) -> np.ndarray:
    """The least number up to ``most`` at which a pair is possible, ``most + 1`` where none is."""
    low, high = np.zeros_like(most), most + 1
    while (low < high).any():
        mid = (low + high) // 2
        ok = possible(mid) | (mid > most)
        low, high = np.where(ok, low, np.minimum(mid + 1, high)), np.where(ok, mid, high)
    return low


def _passing(x: Block, y: Block, same: bool, rule: Rule, label: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that the narrow bits let pass, in batches; only pairs of two labels if there are any."""
    kinds, of = np.unique(np.stack([y.size, y.types, y.square]), axis=1, return_inverse=True)
    of = of.ravel()
    shared, n = np.empty(len(y.names), np.uint64), len(x.names)
    count, total = np.empty(len(y.names), np.uint8), np.empty(len(y.names), np.uint8)
    seen, held, held_i, held_j = {}, 0, [], []

    def needed(i: int):
        """By place in y, the bits in common that are needed, and the range of places where that many are possible."""
        me = (x.size[i], x.types[i], x.square[i])
        most = np.minimum(x.types[i], kinds[1])
        least = _least(most, lambda s: _may(rule, *_bounds(s, np.minimum(x.size[i], kinds[0]), me, kinds)))
        fits = np.flatnonzero((least <= most)[of])
        need = np.clip(np.where(least <= most, least, 999)[of] - y.narrow_rest, 0, None)
        out = [np.where(need > 254, np.where(need > 900, 255, 254), need).astype(np.uint8), *((fits[0], fits[-1] + 1) if len(fits) else (0, 0))]
        return out

    def lettered(i: int, prefix: int):
        most = np.minimum(x.size[i], kinds[0])

        def possible(c: np.ndarray) -> np.ndarray:
            jaro = (c / x.size[i] + c / kinds[0] + 1) / 3 * (c > 0)
            return (jaro + 0.1 * prefix * (1 - jaro) >= rule.fuzzy - SLACK) | (2 * c / (x.size[i] + kinds[0]) >= rule.fuzzy - SLACK)

        least = _least(most, possible)
        return np.where((least <= most)[of], np.clip(least[of] - y.letters_rest, 0, 254), 255).astype(np.uint8)

    def common(bits_x: np.ndarray, bits_y: np.ndarray, i: int, lo: int, hi: int) -> np.ndarray:
        t, c, s = total[lo:hi], count[lo:hi], shared[lo:hi]
        for w in range(len(bits_x)):
            np.bitwise_and(bits_y[w, lo:hi], bits_x[w, i], out=s)
            np.bitwise_count(s, out=c if w else t)
            if w:
                t += c
        return t

    for i in range(n):
        me = (x.size[i], x.types[i], x.square[i])
        if me not in seen:
            seen[me] = needed(i)
        need, lo, hi = seen[me]
        lo = max(lo, i + 1) if same else lo
        js = lo + np.flatnonzero(common(x.narrow, y.narrow, i, lo, hi) >= need[lo:hi]) if lo < hi else np.empty(0, np.int64)
        if rule.fuzzy is not None:
            for prefix in (0, 4):
                if (*me, prefix) not in seen:
                    seen[*me, prefix] = lettered(i, prefix)
            lo = i + 1 if same else 0
            t = common(x.letters, y.letters, i, lo, len(y.names))
            hit = (t >= seen[*me, 0][lo:]) | ((t >= seen[*me, 4][lo:]) & (y.first[lo:, 0] == x.first[i, 0]))
            if label is not None:
                hit &= label[len(x.names) * (not same) + lo :][: len(hit)] != label[i]
            js = np.union1d(js, lo + np.flatnonzero(hit))
        if label is not None and len(js):
            js = js[label[len(x.names) * (not same) + js] != label[i]]
        if len(js):
            held += len(js)
            held_i.append(np.full(len(js), i))
            held_j.append(js)
        if held >= BATCH or held and i == n - 1:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held, held_i, held_j = 0, [], []
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)


class _Pairs:
    """Exact measures of many pairs (i, j) of two blocks."""

    def __init__(self, x: Block, y: Block):
        self.x, self.y = x, y
        self.alphabet = np.unique(np.concatenate([np.unique(x.codes), np.unique(y.codes)]))
        self.cx = np.searchsorted(self.alphabet, x.codes).astype(np.int32)
        self.cy = np.searchsorted(self.alphabet, y.codes).astype(np.int32)

    @cached_property
    def vocabulary(self) -> np.ndarray:
        v = np.unique(np.concatenate([[np.uint64(0)], self.x.trigrams.ravel(), self.y.trigrams.ravel()]))
        self.gx, self.gy = np.searchsorted(v, self.x.trigrams).astype(np.int32), np.searchsorted(v, self.y.trigrams).astype(np.int32)
        return v

    def _by_word(self, i, j, fast, plain, dtype, step=None, by=None):
        """``fast`` for names of a word's length, by ``by`` or the length of i, so many at a time; ``plain`` for others."""
        out = np.empty(len(i), dtype)
        long = (self.x.size[i] > WORD) | (self.y.size[j] > WORD)
        for k in np.flatnonzero(long):
            out[k] = plain(self.x.names[i[k]], self.y.names[j[k]])
        rest = np.flatnonzero(~long)
        rest = rest[np.lexsort((j[rest], self.x.size[i[rest]]))] if by is None else rest[np.argsort(by[rest], kind="stable")]
        step = step or max(1, min(BATCH, CELLS // len(self.alphabet)))
        for at in range(0, len(rest), step):
            k = rest[at : at + step]
            out[k] = fast(i[k], j[k])
        return out

    def _masks(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of masks by letter for each different name of the second block, and the rows of the pairs."""
        names, row = np.unique(j, return_inverse=True)
        table = np.zeros((len(names), len(self.alphabet)), np.uint64)
        at = np.arange(len(names))
        for k in range(self.cy.shape[1]):
            table[at, self.cy[names, k]] |= _ONE << np.uint64(k)
        if self.alphabet[0] == 0:
            table[:, 0] = 0
        return table, row.ravel()

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._by_word(i, j, self._edits, edits_of, np.int64)

    def _edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:  # by length of i
        (table, row), la, lb = self._masks(j), self.x.size[i], self.y.size[j]
        pv, mv, score = _ALL[lb].copy(), np.zeros(len(i), np.uint64), lb.copy()
        last = _ONE << (lb - 1).astype(np.uint64)
        for t in range(int(la.max(initial=0))):
            s = slice(np.searchsorted(la, t, "right"), None)
            eq, p, m = table[row[s], self.cx[i[s], t]], pv[s], mv[s]
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            score[s] += ((ph & last[s]) != 0).astype(np.int64) - ((mh & last[s]) != 0)
            ph, mh = (ph << _ONE) | _ONE, mh << _ONE
            pv[s], mv[s] = mh | ~((eq | m) | ph), ph & (eq | m)
        return score

    def subsequence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._by_word(i, j, self._subsequence, subsequence_of, np.int64)

    def _subsequence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (table, row), la, lb = self._masks(j), self.x.size[i], self.y.size[j]
        v = np.full(len(i), _ALL[WORD])
        for t in range(int(la.max(initial=0))):
            s = slice(np.searchsorted(la, t, "right"), None)
            u = v[s] & table[row[s], self.cx[i[s], t]]
            v[s] = (v[s] + u) | (v[s] - u)
        return np.bitwise_count(~v & _ALL[lb]).astype(np.int64)

    def jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._by_word(i, j, self._jaro_winkler, jaro_winkler, np.float64)

    def _jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (table, row), la, lb = self._masks(j), self.x.size[i], self.y.size[j]
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        taken, mine = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        for t in range(int(la.max(initial=0))):
            s = slice(np.searchsorted(la, t, "right"), None)
            near = _ALL[np.minimum(lb[s], t + reach[s] + 1)] & ~_ALL[np.minimum(WORD, np.maximum(0, t - reach[s]))]
            free = table[row[s], self.cx[i[s], t]] & near & ~taken[s]
            taken[s] |= free & (~free + _ONE)
            mine[s] |= (free != 0).astype(np.uint64) << np.uint64(t)
        m, other, left = np.bitwise_count(taken).astype(np.int64), np.zeros(len(i), np.int64), taken
        width = self.cy.shape[1] - 1
        for t in range(int(la.max(initial=0))):
            s = slice(np.searchsorted(la, t, "right"), None)
            low = left[s] & (~left[s] + _ONE)
            got = (mine[s] >> np.uint64(t)) & _ONE != 0
            place = np.minimum(np.bitwise_count(low - _ONE), width)
            other[s] += got & (self.cy[j[s], place] != self.cx[i[s], t])
            left[s] ^= np.where(got, low, np.uint64(0))
        some, half = np.maximum(m, 1), other / 2
        jaro = np.where(m > 0, (m / la + m / lb + (m - half) / some) / 3, 0.0)
        alike = np.logical_and.accumulate((self.x.first[i] == self.y.first[j]) & (self.x.first[i] > 0), axis=1).sum(axis=1)
        return jaro + alike * 0.1 * (1 - jaro)

    def cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        plain = lambda a, b: cosine_of(grams_of(a), grams_of(b))
        return self._by_word(i, j, self._cosine, plain, np.float64, max(1, 8 * CELLS // len(self.vocabulary)), j)

    def _cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        names, row = np.unique(j, return_inverse=True)
        at, dot = np.arange(len(names)), np.zeros(len(i), np.int64)
        table = np.zeros((len(names), len(self.vocabulary)), np.uint8)
        for k in range(self.gy.shape[1]):
            table[at, self.gy[names, k]] += 1
        table[:, 0] = 0  # cells behind the last trigram
        row = row.ravel()
        for k in range(int(self.x.size[i].max(initial=2)) - 2):
            dot += table[row, self.gx[i, k]]
        wx, wy = self.x.square[i], self.y.square[j]
        return np.where(dot > 0, dot / np.maximum(np.sqrt(wx) * np.sqrt(wy), 1), 0.0)

    def ratio(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """difflib's ratio, which depends on the order of the two."""
        pairs = [sorted((self.x.names[a], self.y.names[b])) for a, b in zip(i.tolist(), j.tolist())]
        return np.array([SequenceMatcher(None, *p).ratio() for p in pairs], np.float64)


def wanted(x: Block, y: Block, same: bool, rule: Rule, linked: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (i, j, score) of all pairs of the two blocks (or within one) that the rule wants.

    The score is that of the first measure that wants the pair, in the order of the
    rule. With ``linked`` only pairs that no other pairs link: enough for the groups.
    """
    exact, nx = _Pairs(x, y), len(x.names)
    label = np.arange(nx if same else nx + len(y.names)) if linked else None
    for i, j in _passing(x, y, same, rule, label):
        for at in range(0, len(i), BATCH):
            a, b = i[at : at + BATCH], j[at : at + BATCH]
            if label is not None:
                a, b = (v[label[a] != label[b + (0 if same else nx)]] for v in (a, b))
            got = _decided(x, y, exact, rule, a, b)
            if label is not None:
                got = _spanning(label, got, 0 if same else nx)
            if len(got[0]):
                yield got


class _Linking:
    """Pairs of two blocks that may reach the threshold of difflib or Jaro-Winkler, or of edits and trigrams, and have two labels.

    A pair that is left out by the bits is settled by a few machine words. What is left
    is bounded by the longest common subsequence: letters that Jaro matches but no
    common subsequence holds stand at other places in the two, and count as transposed.
    """

    def __init__(self, x: Block, y: Block, rule: Rule):
        self.x, self.y, self.rule = x, y, rule
        self.alphabet = np.unique(np.concatenate([np.unique(x.codes), np.unique(y.codes)]))
        self.cx = np.searchsorted(self.alphabet, x.codes).astype(np.int64)
        self.cy = np.ascontiguousarray(np.searchsorted(self.alphabet, y.codes).astype(np.int64).T)
        self.blank = int(self.alphabet[0] == 0)  # the code behind a name's end
        (mine, x_kind), (others, y_kind) = (np.unique(np.stack([v.size, v.types, v.square]), axis=1, return_inverse=True) for v in (x, y))
        self.x_kind, self.y_kind = x_kind.ravel(), y_kind.ravel()
        step = max(1, CELLS // 8 // max(1, others.shape[1]))
        self.grams_least = np.concatenate([self._grams_least(mine[:, at : at + step, None], others[:, None]) for at in range(0, mine.shape[1], step)] or [np.zeros((0, 0), np.int64)])
        (sizes, x_size), (other, y_size) = (np.unique(v.size, return_inverse=True) for v in (x, y))
        self.x_size, self.y_size = x_size.ravel(), y_size.ravel()
        la, lb, prefix = sizes[:, None, None], other[None, None], np.arange(5)[None, :, None]
        most = np.minimum(la, lb) + 0 * prefix
        least = _least(most, lambda c: _by_letters(c, c, la, lb, prefix, rule.fuzzy))
        self.letters_least = np.where(least <= most, least, 999)
        order = np.argsort(y.first[:, 0], kind="stable")
        letters, at = np.unique(y.first[order, 0], return_index=True)
        self.beginning = {x: (k, y.first[k]) for x, k in zip(letters.tolist(), np.split(order, at[1:]))}
        self.grams_needed: dict[int, tuple] = {}
        self.letters_needed: dict[tuple, tuple] = {}
        n = len(y.names)
        self.shared, self.count, self.total = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint8)

    def _common(self, bits_x: np.ndarray, bits_y: np.ndarray, i: int, lo: int, hi: int) -> np.ndarray:
        t, c, s = self.total[lo:hi], self.count[lo:hi], self.shared[lo:hi]
        for w in range(len(bits_x)):
            np.bitwise_and(bits_y[w, lo:hi], bits_x[w, i], out=s)
            np.bitwise_count(s, out=c if w else t)
            if w:
                t += c
        return t

    def _grams_least(self, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The least number of common kinds of trigrams of names (size, types, square), 999 where none suffices."""
        most = np.minimum(mine[1], others[1])
        least = _least(most, lambda s: _may(self.rule, *_bounds(s, np.minimum(mine[0], others[0]), mine, others)))
        return np.where(least <= most, least, 999)

    @staticmethod
    def _needed(least: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, int, int]:
        """By place in y the common bits that are needed, and the places where so many are possible."""
        fits = np.flatnonzero((least if least.ndim == 1 else least[-1]) < 999)
        need = np.where(least == 999, 255, np.clip(least - lost, 0, 254)).astype(np.uint8)
        return (need, int(fits[0]), int(fits[-1]) + 1) if len(fits) else (need, 0, 0)

    def _grams(self, i: int) -> tuple[np.ndarray, int, int]:
        kind = int(self.x_kind[i])
        if kind not in self.grams_needed:
            self.grams_needed[kind] = self._needed(self.grams_least[kind][self.y_kind], self.y.narrow_rest)
        return self.grams_needed[kind]

    def _letters(self, i: int) -> tuple[np.ndarray, int, int]:
        """By the number of equal first letters and place in y."""
        size, rest = int(self.x_size[i]), int(self.x.letters_rest[i])
        if (size, rest) not in self.letters_needed:
            self.letters_needed[size, rest] = self._needed(self.letters_least[size][:, self.y_size], np.minimum(rest, self.y.letters_rest))
        return self.letters_needed[size, rest]

    def _row(self, i: int, lo: int, other: np.ndarray) -> np.ndarray:
        """Places in y, from ``lo`` on, that may match name i; ``other``: whether the label is another."""
        x, y = self.x, self.y
        hit = np.zeros(len(y.names), bool)
        need, a, b = self._grams(i)
        a = max(a, lo)
        if a < b:
            np.greater_equal(self._common(x.narrow, y.narrow, i, a, b), need[a:b], out=hit[a:b])
        need, a, b = self._letters(i)
        a = max(a, lo)
        if a < b:
            t = self._common(x.letters, y.letters, i, a, b)
            hit[a:b] |= t >= need[0, a:b]
            near, first = self.beginning.get(int(x.first[i, 0]), (None, None))
            if near is not None:
                at, to = np.searchsorted(near, (a, b))
                near, f = near[at:to], first[at:to] == x.first[i]
                f &= x.first[i] > 0
                for k in (1, 2, 3):
                    f[:, k] &= f[:, k - 1]
                hit[near] |= t[near - a] >= need[f.sum(axis=1), near]
        hit &= other
        return np.flatnonzero(hit)

    def batches(self, same: bool, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Labels may change between batches, which begin small, so that names linked early are compared no more."""
        shift, n = 0 if same else len(self.x.names), len(self.x.names)
        held, held_i, held_j, most = 0, [], [], BATCH // 32
        for i in range(n):
            js = self._row(i, i + 1 if same else 0, label[shift:] != label[i])
            if len(js):
                held += len(js)
                held_i.append(np.full(len(js), i))
                held_j.append(js)
            if held >= most or held and i == n - 1:
                i_, j_ = np.concatenate(held_i), np.concatenate(held_j)
                held, held_i, held_j, most = 0, [], [], min(BATCH, 2 * most)
                for at in range(0, len(i_), BATCH):
                    a, b = i_[at : at + BATCH], j_[at : at + BATCH]
                    keep = label[a] != label[b + shift]
                    yield self._near(a[keep], b[keep])

    def _near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose longest common subsequence allows a match; names longer than a word are kept."""
        x, y = self.x, self.y
        short = (x.size[i] <= WORD) & (y.size[j] <= WORD)
        keep, k = ~short, np.flatnonzero(short)
        if len(k):
            k = k[np.argsort(y.size[j[k]].astype(np.uint8), kind="stable")]
            a, b = i[k], j[k]
            la, lb = x.size[a], y.size[b]
            common = self._subsequence(a, b)
            letters = np.minimum(_count(x.letters[:, a] & y.letters[:, b]) + np.minimum(x.letters_rest[a], y.letters_rest[b]), np.minimum(la, lb))
            prefix = np.logical_and.accumulate((x.first[a] == y.first[b]) & (x.first[a] > 0), axis=1).sum(axis=1)
            ok = _by_letters(letters, common, la, lb, prefix, self.rule.fuzzy)
            grams = np.minimum(_count(x.wide[:, a] & y.wide[:, b]) + np.minimum(x.wide_rest[a], y.wide_rest[b]), np.minimum(x.types[a], y.types[b]))
            edits, cosine = _bounds(grams, common, (la, x.types[a], x.square[a]), (lb, y.types[b], y.square[b]))
            keep[k] = ok | _may(self.rule, edits, cosine)
        return i[keep], j[keep]

    def _subsequence(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:  # by length of j
        names, row = np.unique(i, return_inverse=True)
        table = np.zeros((len(names), len(self.alphabet)), np.uint64)
        at = np.arange(len(names))
        for k in range(self.cx.shape[1]):
            table[at, self.cx[names, k]] |= _ONE << np.uint64(k)
        if self.blank:
            table[:, 0] = 0
        table, start, lb = table.ravel(), row.ravel() * len(self.alphabet), self.y.size[j]
        v = np.full(len(i), _ALL[WORD])
        for t in range(int(lb[-1])):
            s = slice(int(np.searchsorted(lb, t, "right")), None)
            w = v[s]
            u = w & table[start[s] + self.cy[t][j[s]]]
            v[s] = (w + u) | (w - u)
        return np.bitwise_count(~v & _ALL[self.x.size[i]]).astype(np.int64)


def _by_letters(letters, common, la, lb, prefix, least: float) -> np.ndarray:
    """Whether difflib's ratio or Jaro-Winkler may reach ``least``, with at most so many common letters and so long a common subsequence.

    Of m letters that Jaro matches, those at the same place in both orders are a common
    subsequence, so at least m less its length are not. The sum is convex in m: the
    greatest is at one of the ends.
    """
    jaro = lambda m: np.where(m > 0, (m / la + m / lb + 1 - np.maximum(m - common, 0) / 2 / np.maximum(m, 1)) / 3, 0.0)
    most = np.maximum(jaro(letters), jaro(np.minimum(letters, common)))
    return (most + 0.1 * prefix * (1 - most) >= least - SLACK) | (2 * common / (la + lb) >= least - SLACK)


def linking(x: Block, y: Block, same: bool, rule: Rule, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (i, j) of pairs that the rule wants and that link all labels which any such pair of the two blocks links.

    ``label`` has those of x and then, unless it is the same block, of y; it is changed.
    """
    exact, search, shift = _Pairs(x, y), _Linking(x, y, rule), 0 if same else len(x.names)
    for i, j in search.batches(same, label):
        if len(i):
            got = _spanning(label, _decided(x, y, exact, rule, i, j), shift)
            if len(got[0]):
                yield got[:2]


def _spanning(label: np.ndarray, got: tuple, shift: int) -> tuple:
    """The pairs that link two labels, which become one."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while v in up:
            up[v] = v = up.get(up[v], up[v])
        return v

    keep = []
    for k, (p, q) in enumerate(zip(label[got[0]].tolist(), label[got[1] + shift].tolist())):
        p, q = root(p), root(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            keep.append(k)
    if keep:
        now = np.arange(len(label))
        for v in list(up):
            now[v] = root(v)
        label[:] = now[label]
    return tuple(v[keep] for v in got)


def _decided(x: Block, y: Block, exact: _Pairs, rule: Rule, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = np.minimum(_count(x.wide[:, i] & y.wide[:, j]) + np.minimum(x.wide_rest[i], y.wide_rest[j]), _count(x.narrow[:, i] & y.narrow[:, j]) + np.minimum(x.narrow_rest[i], y.narrow_rest[j]))
    grams = np.minimum(grams, np.minimum(x.types[i], y.types[j]))
    la, lb = x.size[i], y.size[j]
    letters = np.minimum(_count(x.letters[:, i] & y.letters[:, j]) + np.minimum(x.letters_rest[i], y.letters_rest[j]), np.minimum(la, lb))
    edits, cosine = _bounds(grams, letters, (la, x.types[i], x.square[i]), (lb, y.types[j], y.square[j]))
    score = np.full(len(i), np.nan)
    open_ = _may(rule, edits, cosine)
    if rule.edits is not None or rule.hybrid is not None:
        k = np.flatnonzero(_may(Rule(rule.edits, None, rule.hybrid, weight=rule.weight), edits, cosine))
        edits[k] = 1 - exact.edits(i[k], j[k]) / np.maximum(la[k], lb[k])
        if rule.edits is not None:
            score[k] = np.where(edits[k] >= rule.edits - rule.slack, edits[k], np.nan)
        open_[k] = np.isnan(score[k]) & _may(rule, edits[k], cosine[k])
    if rule.cosine is not None or rule.hybrid is not None:
        k = np.flatnonzero(open_)
        cosine[k] = exact.cosine(i[k], j[k])
        if rule.hybrid is not None:
            both = rule.weight * edits[k] + (1 - rule.weight) * cosine[k]
            score[k] = np.where(both >= rule.hybrid - rule.slack, both, np.nan)
        if rule.cosine is not None:
            score[k] = np.where(np.isnan(score[k]) & (cosine[k] >= rule.cosine - rule.slack), cosine[k], score[k])
    if rule.fuzzy is not None:
        k = np.flatnonzero(np.isnan(score))
        near = exact.jaro_winkler(i[k], j[k])
        score[k] = np.where(near >= rule.fuzzy, near, np.nan)
        k = k[np.isnan(score[k])]
        k = k[2 * letters[k] / (la[k] + lb[k]) >= rule.fuzzy - SLACK]
        k = k[2 * exact.subsequence(i[k], j[k]) / (la[k] + lb[k]) >= rule.fuzzy - SLACK]
        ratio = exact.ratio(i[k], j[k])
        score[k] = np.where(ratio >= rule.fuzzy, ratio, np.nan)
    got = ~np.isnan(score)
    return i[got], j[got], score[got]


#: Pairs that are bounded at a time, pairs whose edits are counted at a time, and pairs of a name that make its first bar.
LOOKED, EDITED, TRIED = 200_000, 8192, 8
#: Frequent trigrams of a block that are bits, and trigrams of a name that are looked up beyond those of which one is in common.
HOT, MORE = 256, 3
#: Scores are counted in millionths; the bounds know bars to so many of them.
MILLION, LEVEL = 1_000_000, 5000


def _cells(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, trigram) of all trigrams of each name, and whether it is the first of its kind there; of one name in a row, sorted."""
    at, k = np.nonzero((b.trigrams > 0) & (b.size <= WORD)[:, None])
    grams, shift = b.trigrams[at, k], np.uint64(21)
    for i in np.flatnonzero(b.size > WORD):
        code = np.array([ord(x) + 1 for x in b.names[i]], np.uint64)
        more = np.sort((code[:-2] << (shift + shift)) | (code[1:-1] << shift) | code[2:])
        at, grams = np.concatenate([at, np.full(len(more), i)]), np.concatenate([grams, more])
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (grams[1:] != grams[:-1])
    return at, grams, first


def _kinds(b: Block) -> tuple[np.ndarray, np.ndarray]:
    kinds, of = np.unique(np.stack([b.size, b.types, b.square]), axis=1, return_inverse=True)
    return kinds, of.ravel()


class _Known(_Pairs):
    """A block of names with the places of each trigram, and exact measures of pairs (its name, asked name)."""

    def __init__(self, known: Block, asked: Block):
        self.x, self.y = known, asked
        seen = np.zeros(int(max(known.codes.max(initial=0), asked.codes.max(initial=0))) + 1, bool)
        seen[known.codes], seen[0] = True, True
        place = np.where(seen, np.cumsum(seen, dtype=np.int32) - 1, np.count_nonzero(seen)).astype(np.int32)
        self.alphabet = np.append(np.flatnonzero(seen), len(seen))  # letters that no known name has are one
        self.cx, self.cy = place[known.codes], place[asked.codes]
        at, grams, first = _cells(known)
        self.grams, of = np.unique(grams, return_inverse=True)
        self.n = len(known.names)
        self.keys = np.sort(of.ravel()[first] * self.n + at[first])  # by trigram, then place
        self.start = np.searchsorted(self.keys, np.arange(len(self.grams) + 1) * self.n)
        self.places = self.keys % max(self.n, 1)
        self.kinds, self.kind = _kinds(known)
        self.of = of.ravel()
        # the most frequent trigrams as bits
        often = np.diff(self.start)
        hot = np.argsort(-often, kind="stable")[:HOT]
        self.bit = np.full(len(self.grams), -1)
        self.bit[hot] = np.arange(len(hot))
        self.bits = np.zeros((self.n, HOT // WORD), np.uint64)
        for b, g in enumerate(hot.tolist()):
            self.bits[self.places[self.start[g] : self.start[g + 1]], b // WORD] |= _ONE << np.uint64(b % WORD)

    @cached_property
    def vocabulary(self) -> np.ndarray:
        """Trigrams of the known names; others of the asked names count as a cell behind the last."""
        self.gx = np.zeros(self.x.trigrams.shape, np.int32)
        self.gx[(self.x.trigrams > 0) & (self.x.size <= WORD)[:, None]] = self.of[: np.count_nonzero(self.x.trigrams[self.x.size <= WORD])] + 1
        self.gy = np.zeros(self.y.trigrams.shape, np.int32)
        self.gy[self.y.trigrams > 0] = self.number(self.y.trigrams[self.y.trigrams > 0]) + 1
        return np.arange(len(self.grams) + 1)

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._by_word(i, j, self._edits, edits_of, np.int64, max(1, min(EDITED, CELLS // len(self.alphabet))))

    def _edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:  # by length of i
        (table, row), la, lb = self._masks(j), self.x.size[i], self.y.size[j]
        table, cell, codes = table.ravel(), row * len(self.alphabet), np.ascontiguousarray(self.cx[i].T)
        pv, mv, score = _ALL[lb], np.zeros(len(i), np.uint64), lb.copy()
        last = (lb - 1).astype(np.uint64)
        ends = np.searchsorted(la, np.arange(int(la.max(initial=0))), "right").tolist()
        for t, at in enumerate(ends):
            eq, p, m, end = table.take(cell[at:] + codes[t, at:]), pv[at:], mv[at:], last[at:]
            xh = eq & p
            xh += p
            xh ^= p
            xh |= eq
            ph = xh | p
            np.invert(ph, out=ph)
            ph |= m
            mh = p & xh
            score[at:] += ((ph >> end) & _ONE).astype(np.int64)
            score[at:] -= ((mh >> end) & _ONE).astype(np.int64)
            ph <<= _ONE
            ph |= _ONE
            mh <<= _ONE
            eq |= m
            np.bitwise_and(ph, eq, out=m)
            eq |= ph
            np.invert(eq, out=eq)
            np.bitwise_or(mh, eq, out=p)
        return score

    def number(self, grams: np.ndarray) -> np.ndarray:
        """The numbers of trigrams, -1 for those that no known name has."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        k = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[k] == grams, k, -1)


class Best:
    """The ``most`` best by the hybrid measure that each name finds among known names, which come block by block.

    Scores are rounded to millionths; of equal ones the name whose ``mark`` comes first is better.
    """

    def __init__(self, names: list[str], most: int, least: float, weight: float = 0.6):
        if least <= max(weight, 1 - weight):
            raise ValueError("a pair without a common trigram may reach this score")
        self.asked, self.most, self.weight = Block(names), most, weight
        at, grams, first = _cells(self.asked)
        self.at, self.grams = at[first], grams[first]
        self.kinds, self.kind = _kinds(self.asked)
        self.bar = np.full(len(names), int(np.ceil(least * MILLION - 1e-3)))
        self.untried = True
        self.i, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.name, self.mark = np.empty(0, object), np.empty(0, object)

    def meet(self, names: list[str], marks: list[str]) -> None:
        """Compare with a block of known names that haven't come before."""
        order = sorted(range(len(names)), key=lambda k: len(names[k]))
        names, marks = [names[k] for k in order], [marks[k] for k in order]
        y = _Known(Block(names), self.asked)
        number = y.number(self.grams)
        here = number >= 0
        if self.untried:  # bars from some pairs, which are found again below
            i, score = self._looked(y, number, here, True)[::2]
            self._raise(np.concatenate([self.i, i]), np.concatenate([self.score, score]))
            self.untried = False
        i, j, score = self._looked(y, number, here, False)
        equal = {s: k for k, s in enumerate(names) if len(s) < 3}
        short = [(k, equal[s]) for k, s in enumerate(self.asked.names) if s in equal]
        if short:
            i, j = (np.concatenate([v, np.array(w)]) for v, w in zip((i, j), zip(*short)))
            score = np.concatenate([score, np.full(len(short), MILLION)])
        self.i, self.score = np.concatenate([self.i, i]), np.concatenate([self.score, score])
        self.name = np.concatenate([self.name, np.array(names, object)[j]])
        self.mark = np.concatenate([self.mark, np.array(marks, object)[j]])
        self._keep()

    def result(self) -> tuple[list[str], list[str], np.ndarray]:
        """Asked names, known names and scores."""
        return [self.asked.names[k] for k in self.i.tolist()], self.name.tolist(), self.score / MILLION

    def _raise(self, i: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set the bars; the order by name and score, and each one's place among its name's."""
        order = np.lexsort((-score, i))
        i, score = i[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        last = nth == self.most - 1
        self.bar[i[last]] = np.maximum(self.bar[i[last]], score[last])
        return order, nth

    def _keep(self) -> None:
        order, nth = self._raise(self.i, self.score)
        order = order[self.score[order] >= self.bar[self.i[order]]]
        i = self.i[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        end = np.append(begin[1:], len(i))
        keep = np.ones(len(i), bool)
        for a, b in zip(begin[end - begin > self.most].tolist(), end[end - begin > self.most].tolist()):
            own = order[a:b].tolist()
            best = set(sorted(own, key=lambda k: (-self.score[k], self.mark[k]))[: self.most])
            keep[a:b] = [k in best for k in own]
        order = order[keep]
        self.i, self.score, self.name, self.mark = (v[order] for v in (self.i, self.score, self.name, self.mark))

    def _needs(self, y: _Known) -> tuple[np.ndarray, np.ndarray]:
        """For each kind of asked name with its bar, by kind of known name, how many common kinds of trigrams are needed (255: none suffices); which one each name has."""
        own, of = np.unique(np.stack([self.kind, self.bar // LEVEL]), axis=1, return_inverse=True)
        need = np.empty((own.shape[1], y.kinds.shape[1]), np.uint8)
        step = max(1, CELLS // 16 // max(1, y.kinds.shape[1]))
        for at in range(0, len(need), step):
            mine, level = self.kinds[:, own[0, at : at + step]][:, :, None], own[1, at : at + step, None] * (LEVEL / MILLION) - SLACK
            most = np.minimum(mine[1], y.kinds[1])

            def may(s: np.ndarray) -> np.ndarray:
                edits, cosine = _bounds(s, np.minimum(mine[0], y.kinds[0]), mine, y.kinds)
                return self.weight * edits + (1 - self.weight) * cosine >= level

            least = _least(most, may)
            need[at : at + step] = np.where(least <= most, np.clip(least, 1, 254), 255)
        return need, of.ravel()

    def _looked(self, y: _Known, number: np.ndarray, here: np.ndarray, some: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score) of all pairs that reach their name's bar, or of some that may be among the best."""
        x = self.asked
        if not len(y.grams) or not here.any():
            return (np.empty(0, np.int64),) * 3
        need, of = self._needs(y)
        least = need.min(axis=1, initial=255).astype(np.int64)
        size, fits = y.kinds[0], need < 255
        low = np.searchsorted(y.x.size, np.where(fits, size, 1 << 40).min(axis=1))
        high = np.searchsorted(y.x.size, np.where(fits, size, -1).max(axis=1), "right")
        missing = np.bincount(self.at[~here], minlength=len(x.names))
        rarest = np.where(least[of] < 255, x.types - least[of] + 1, 0) - missing  # a trigram that no known name has is the rarest
        at, number = self.at[here], number[here]
        often = y.start[number + 1] - y.start[number]
        order = np.lexsort((often, at))
        at, number = at[order], number[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        fits = rarest[at] > 0
        keep = fits & (some | (nth < (rarest + MORE)[at]) | (y.bit[number] < 0))
        bit, mask = y.bit[number[fits & ~keep]], np.zeros(len(x.names) * y.bits.shape[1], np.uint64)
        np.add.at(mask, at[fits & ~keep] * y.bits.shape[1] + bit // WORD, _ONE << (bit % WORD).astype(np.uint64))
        mask = mask.reshape(len(x.names), -1)
        at, number = at[keep], number[keep]
        left = x.types - missing - np.bincount(at, minlength=len(x.names))  # trigrams that aren't looked up
        enough = np.maximum(least[of] - left, 1)
        a = np.searchsorted(y.keys, number * y.n + low[of[at]])
        b = np.searchsorted(y.keys, number * y.n + high[of[at]])
        fits = a < b
        at, a, b = at[fits], a[fits], b[fits]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        out, held, i, j, c = [], 0, [], [], []
        a, b, places, low, enough = a.tolist(), b.tolist(), y.places, low[of].tolist(), enough.tolist()
        for name, p, q in zip(at[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)]):
            if q - p < enough[name]:
                continue
            found = np.concatenate([places[a[k] : b[k]] for k in range(p, q)])
            found -= low[name]
            common = np.bincount(found)
            (got,) = (common >= enough[name]).nonzero()
            if some and len(got) > 4 * TRIED:
                got = got[np.argpartition(common[got], -4 * TRIED)[-4 * TRIED :]]
            if len(got):
                i.append(np.full(len(got), name))
                j.append(got + low[name])
                c.append(common[got])
                held += len(got)
            if held > LOOKED:
                out.append(self._few(y, np.concatenate(i), np.concatenate(j), np.concatenate(c), need, of, mask, some))
                held, i, j, c = 0, [], [], []
        if held:
            out.append(self._few(y, np.concatenate(i), np.concatenate(j), np.concatenate(c), need, of, mask, some))
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def _few(self, y: _Known, i: np.ndarray, j: np.ndarray, grams: np.ndarray, need: np.ndarray, of: np.ndarray, mask: np.ndarray, some: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.asked
        both = np.bitwise_count(mask.take(i, axis=0) & y.bits.take(j, axis=0))
        for w in range(both.shape[1]):
            grams += both[:, w]
        k = np.flatnonzero(grams >= need[of[i], y.kind[j]])
        i, j, grams = i[k], j[k], grams[k]
        if some:
            k = np.lexsort((-grams / np.maximum(x.types[i], y.x.types[j]), i))
            k = k[np.arange(len(k)) - np.searchsorted(i[k], i[k]) < TRIED]
            i, j, grams = i[k], j[k], grams[k]
        return self._scored(y, i, j, grams)

    def _scored(self, y: _Known, i: np.ndarray, j: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that reach the bar, with scores."""
        x, v, w = self.asked, y.x, self.weight
        least = (self.bar[i] - 0.5) / MILLION - SLACK
        la, lb = x.size[i], v.size[j]
        letters = np.minimum(_count(x.letters[:, i] & v.letters[:, j]) + np.minimum(x.letters_rest[i], v.letters_rest[j]), np.minimum(la, lb))
        edits, cosine = _bounds(grams, letters, (la, x.types[i], x.square[i]), (lb, v.types[j], v.square[j]))
        k = np.flatnonzero(w * edits + (1 - w) * cosine >= least)
        i, j, least, cosine, longer = i[k], j[k], least[k], cosine[k], np.maximum(la[k], lb[k])
        edits = 1 - y.edits(j, i) / longer
        k = np.flatnonzero(w * edits + (1 - w) * cosine >= least)
        i, j, edits = i[k], j[k], edits[k]
        score = np.floor((w * edits + (1 - w) * y.cosine(j, i)) * MILLION + 0.5).astype(np.int64)
        score[edits == 1] = MILLION
        k = np.flatnonzero(score >= self.bar[i])
        return i[k], j[k], score[k]
