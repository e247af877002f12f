"""Names of persons and things as people type them: folding, symmetric deletes, token alignment."""

from __future__ import annotations

import heapq
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Letters that Unicode does not decompose (fixed values).
PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i", "'": None, "’": None, "`": None, "´": None})
#: Words that join the parts of a name without telling persons apart (fixed values).
PARTICLES = frozenset("de del della da do dos das di du van von der den la le el al y e c".split())
_WORD = re.compile(r"[a-z]+")


def fold(text: str | None) -> str:
    """Lower case, without accents and apostrophes; text that was decoded wrongly is decoded again."""
    if not text:
        return ""
    if "Ã" in text or "Å" in text or "Ä" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            try:
                text = text.encode("latin-1").decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    folded = unicodedata.normalize("NFKD", text.lower()).translate(PLAIN)
    return "".join(c for c in folded if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def tokens(text: str | None) -> tuple[str, ...]:
    """Words of a name in their order, without figures, particles and a count in brackets."""
    words = _WORD.findall(re.sub(r"\([^)]*\)", " ", fold(text)))
    kept = tuple(w for w in words if w not in PARTICLES)
    return kept or tuple(words)


def deletes(token: str) -> set[str]:
    """The token and what is left of it without any one letter: two tokens one edit apart share one."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))} if len(token) > 3 else {token}


def neighbour_keys(token: str) -> frozenset[str]:
    """What is left of a token without any letters up to the edits :func:`token_similarity` accepts for it, and its beginnings.

    Two tokens that it finds alike by edits share a rest, two of which one begins the other share a beginning
    (marked, since a beginning and a rest are different keys).
    """
    # the other token may be the longer one, with more edits allowed, but never more than a third of the shorter
    most = min(3, len(token) // 3)
    rests = layer = {token}
    for _ in range(most):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        rests = rests | layer
    return frozenset(rests | {f"{token[:n]}*" for n in range(3, len(token) + 1)})


@lru_cache(maxsize=500_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits (insertion, deletion, replacement, swap of neighbours) between two tokens, ``most`` + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=200_000)
def letter_set(token: str) -> int:
    """The letters of a token as bits: an edit changes two of them at most."""
    bits = 0
    for c in token:
        bits |= 1 << (ord(c) & 31)
    return bits


@lru_cache(maxsize=500_000)
def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, less for edits, abbreviations and initials, 0 for different tokens."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.55 if long.startswith(short) else 0.0
    if len(short) == 2 and long.startswith(short):
        return 0.6
    # edits are only counted where their bound can hold: first letters, lengths and letters say most
    allowed = min(1 if len(long) <= 5 or short[0] != long[0] else 2 if len(long) <= 9 else 3, len(short) // 3)
    if allowed and len(long) - len(short) <= allowed and (letter_set(a) ^ letter_set(b)).bit_count() <= 2 * allowed:
        edits = distance(a, b, allowed)
        if edits <= allowed:
            return 1.0 - 0.12 * edits
    if len(short) >= 3 and long.startswith(short):
        return 0.75
    if len(short) == 3 and len(long) > 4 and short[0] == long[0] and distance(short, long[:3], 1) <= 1:
        return 0.45
    return 0.0


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a small matrix of at most 8 rows, each used once, with the greatest total."""
    rows, columns = len(weights), len(weights[0]) if weights else 0
    best: dict[int, tuple[float, tuple[tuple[int, int], ...]]] = {0: (0.0, ())}
    for i in range(rows):
        step = dict(best)
        for used, (total, pairs) in best.items():
            for j in range(columns):
                w = weights[i][j]
                if w > 0 and not used >> j & 1:
                    key = used | 1 << j
                    if key not in step or step[key][0] < total + w:
                        step[key] = (total + w, (*pairs, (i, j)))
        best = step
    return list(max(best.values(), key=lambda x: x[0])[1])


def sparse_assignment(weights: dict[int, dict[int, float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a sparse matrix of any size, each used once, with the greatest total; absent and non-positive weights pair nothing.

    Rows enter one by one along the shortest path of reduced costs to a free column, or to a row that
    is better left alone (the Hungarian method): at most rows x entries x log(entries) steps.
    """
    of_row: dict[int, int] = {}
    of_column: dict[int, int] = {}
    u: dict[int, float] = {}
    v: dict[int, float] = {}
    for start in weights:
        u[start] = min([0.0, *(-w - v.get(j, 0.0) for j, w in weights[start].items() if w > 0)])
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, bool, int]] = []  # of equally near columns a free one comes first
        row, base = start, 0.0
        alone, alone_row = -u[start], start
        while True:
            for j, w in weights[row].items():
                if w > 0 and j not in done:
                    d = base - w - v.get(j, 0.0) - u[row]
                    if d < best.get(j, float("inf")) and d < alone:
                        best[j], came[j] = d, row
                        heapq.heappush(heap, (d, j in of_column, j))
            while heap and (heap[0][2] in done or heap[0][0] > best[heap[0][2]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                length, end = alone, None
                break
            length, _, end = heapq.heappop(heap)
            if end not in of_column:
                break
            done[end] = length
            row, base = of_column[end], length
            if base - u[row] < alone:
                alone, alone_row = base - u[row], row
        for j, d in done.items():
            v[j] = v.get(j, 0.0) + d - length
            u[of_column[j]] += length - d
        u[start] += length
        # along the path every row takes the column it was reached from; its end is a free column or a row left alone
        if end is None:
            if alone_row == start:
                continue
            end = of_row.pop(alone_row)
        while True:
            row = came[end]
            before = of_row.get(row)
            of_row[row], of_column[end] = end, row
            if row == start:
                break
            end = before
    return list(of_row.items())


def signatures(names: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(first letters, letter sets) of the words of three letters or more of every name, zeros behind them."""
    words = [[t for t in name if len(t) > 2] for name in names]
    wide = max(map(len, words), default=0)
    first, letters = np.zeros((len(names), wide), dtype=np.uint8), np.zeros((len(names), wide), dtype=np.uint32)
    for i, own in enumerate(words):
        for k, t in enumerate(own):
            first[i, k], letters[i, k] = ord(t[0]) & 255, letter_set(t)
    return first, letters


def may_share_a_word(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """False only where :meth:`Matcher.level` of two names is 0, nicknames aside, from their :func:`signatures`; leading axes broadcast.

    Words that :func:`token_similarity` finds alike by three edits differ in six letters at most, by more
    than one edit or as a beginning only with the same first letter; a beginning has no letters of its own.
    """
    out = np.zeros(np.broadcast_shapes(a[0].shape[:-1], b[0].shape[:-1]), dtype=bool)
    for k in range(a[0].shape[-1]):
        for l in range(b[0].shape[-1]):  # noqa: E741
            x, y, p, q = a[1][..., k], b[1][..., l], a[0][..., k], b[0][..., l]
            apart = np.bitwise_count(x ^ y)
            out |= (p > 0) & (q > 0) & ((apart <= 2) | ((p == q) & ((apart <= 6) | (x & ~y == 0) | (y & ~x == 0))))
    return out


def nickname_bits(names: list[tuple[str, ...]], nicknames: frozenset[tuple[str, str]]) -> np.ndarray:
    """Two columns of bits for every name: the pairs of nicknames whose first, and whose second, word it holds (pairs share 64 bits)."""
    of: dict[str, list[int]] = {}
    for k, (a, b) in enumerate(sorted(nicknames)):
        of.setdefault(a, [0, 0])[0] |= 1 << k % 64
        of.setdefault(b, [0, 0])[1] |= 1 << k % 64
    out = np.zeros((len(names), 2), dtype=np.uint64)
    for i, name in enumerate(names):
        for t in name:
            if t in of:
                out[i] |= np.array(of[t], dtype=np.uint64)
    return out


def may_be_nicknames(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False only where no word of one name is a nickname of a word of the other, from their :func:`nickname_bits`."""
    return ((a[..., 0] & b[..., 1]) | (a[..., 1] & b[..., 0])) != 0


class Matcher:
    """Compares names token by token, knowing the given names and nicknames that a corpus uses."""

    def __init__(self, given: frozenset[str] = frozenset(), nicknames: frozenset[tuple[str, str]] = frozenset()) -> None:
        self.given, self.nicknames = given, nicknames
        self._given_memo: dict[str, bool] = {}
        self._memo: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {}

    def is_given(self, token: str) -> bool:
        """Whether a token is a given name, or stands for one with a typing error or cut short."""
        known = self._given_memo.get(token)
        if known is None:
            known = token in self.given or len(token) < 3
            if not known and len(token) >= 3:
                own = letter_set(token)
                known = any(g.startswith(token) for g in self.given) if len(token) <= 4 else any((own ^ letter_set(g)).bit_count() <= 2 and distance(token, g, 1) <= 1 for g in self.given)
            self._given_memo[token] = known
        return known

    def similarity(self, a: str, b: str) -> float:
        s = token_similarity(a, b)
        if s < 0.9 and ((a, b) in self.nicknames or (b, a) in self.nicknames):
            return 0.9
        return s

    def level(self, a: tuple[str, ...], b: tuple[str, ...]) -> int:
        """3 the same name, 2 the same but for an initial, 1 the same family name alone, 0 nothing in common, -1 different persons of one family name."""
        if a == b:
            return 3 if len(a) > 1 and not all(len(t) == 1 for t in a[:-1] + a[1:]) else 1
        if (a, b) not in self._memo:
            self._memo[a, b] = self._level(a, b)
        return self._memo[a, b]

    def _level(self, a: tuple[str, ...], b: tuple[str, ...]) -> int:
        sims = [[self.similarity(x, y) for y in b] for x in a]
        if not any(s >= 0.64 and len(x) >= 3 and len(y) >= 3 for x, row in zip(a, sims) for y, s in zip(b, row)):
            return 0
        few = max(len(a), len(b)) <= 8
        pairs = assignment(sims) if few else sparse_assignment({i: dict(enumerate(row)) for i, row in enumerate(sims)})
        anchors = [(i, j) for i, j in pairs if sims[i][j] >= 0.64 and min(len(a[i]), len(b[j])) >= 3 and not (self.is_given(a[i]) and self.is_given(b[j]))]
        if not anchors:
            return 0
        others = [(i, j) for i, j in pairs if (i, j) not in anchors]
        free_a = [t for i, t in enumerate(a) if i not in {p[0] for p in pairs}]
        free_b = [t for j, t in enumerate(b) if j not in {p[1] for p in pairs}]
        if free_a and free_b:
            if len(anchors) >= 2 or any(sims[i][j] >= 0.7 for i, j in others):
                return 2
            return -1
        if len(anchors) >= 2 or any(sims[i][j] > 0.6 for i, j in others):
            return 3
        return 2 if others else 1


@lru_cache(maxsize=8)
def matcher_for(given: frozenset[str], nicknames: frozenset[tuple[str, str]]) -> Matcher:
    """One matcher per word lists and worker, so that what it learned serves every block."""
    return Matcher(given, nicknames)
