"""Evaluation passages inside documents: latent semantic search, then subsequence, alignment and answer checks."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.runtime import cut

#: Hashed word features, latent dimensions kept, dimensions beyond them that the range finder takes, and its seed.
FEATURES, LATENT, OVERSAMPLE, SEED = 1 << 15, 128, 16, 11
#: Words of a block; a passage is two neighbouring blocks, so every quotation of 14 words lies whole inside some
#: passage. Words of a query passage and the step between their starts.
BLOCK, QUERY_WORDS, QUERY_STEP = 14, 16, 4
#: Passages of the sample, drawn by hash over the whole corpus, on which the basis is fitted (about; the query
#: passages join them). Counts and search cover all passages.
FIT_PASSAGES = 60_000
#: Cosine from which a passage is a candidate. Features weigh idf squared, so that names and figures count most;
#: on the test tables every true passage then lies above 0.75 and one passage in forty has a candidate item.
CANDIDATE_COSINE = 0.5
#: A leak repeats so many words, with at most one error in so many.
LEAK_WORDS, ERROR_EVERY = 14, 6
#: Errors of a run that are followed: a run with more holds a shorter one of :data:`LEAK_WORDS` that has fewer.
RUN_ERRORS = 5
#: Words of text a Python batch searches at once, and groups of rows in which the basis' parts are summed.
BATCH_WORDS, CHUNKS = 60_000, 16

#: Letters that Unicode does not decompose (fixed values).
_LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"}
#: Signs that stand inside a word without dividing it (fixed values).
_JOINED = "'’ʼ`´­​"
_TAG = re.compile(r"<[!/]?[A-Za-z-][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")


def _table() -> dict[int, str | None]:
    """What each letter below U+2190 folds to: plain lower case, a blank for a sign, nothing inside a word."""
    out: dict[int, str | None] = {}
    for code in range(0x2190):
        letter = chr(code)
        low = letter.lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", "".join(_LETTERS.get(c, c) for c in low)) if not unicodedata.combining(c))
        if letter in _JOINED or unicodedata.combining(letter):
            out[code] = None
        elif any(c.isalnum() for c in plain):
            out[code] = "".join(c if c.isalnum() else " " for c in plain)
        else:
            out[code] = " "
    return out


_FOLD = _table()


def folded(text: str | None) -> bytes:
    """The words of a text without case, accents, punctuation, spacing and markup, divided by blanks."""
    if not text:
        return b""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    plain = text.translate(_FOLD)
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain.lower()) if not unicodedata.combining(c))
        plain = " ".join(_WORD.findall(plain))
    return plain.encode("utf-8", "ignore")


def words_of(text: str | None) -> list[str]:
    return folded(text).decode().split()


_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True
_PRIME = 0x9E3779B97F4A7C15


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, words per text): a 32-bit code of every word of folded texts, from one pass of array operations.

    A word's code is its letters' polynomial modulo 2^64, taken from prefix sums over the whole batch; what
    stands before the word is divided out by the inverse of the odd base.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter]).view(np.int8)))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    begin, end = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, bounds)]))
    if not len(begin):
        return np.zeros(0, dtype=np.uint32), counts
    base = np.uint64(_PRIME)
    inverse = np.uint64(pow(_PRIME, -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), inverse)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        value = (total[end] - total[begin]) * back[begin]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(32)).astype(np.uint32), counts


def _codes(text: str | None) -> np.ndarray:
    return word_hashes([folded(text)])[0].view(np.int32)


def _answers(text: str) -> tuple[np.ndarray, list[bool]]:
    """Codes of a passage's words and which of them say what it is about: figures, and names inside a sentence."""
    words, flags, fresh = [], [], True
    for token in text.split():
        own = words_of(token)
        name = not fresh and next((c for c in token if c.isalnum()), "").isupper()
        words += own
        flags += [name or any(c.isdigit() for c in w) for w in own]
        fresh = token.endswith((".", "?", "!", ":")) or not own and fresh
    return _codes(" ".join(words)), flags


def passages_of(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item_id, word codes, answer flags) of the test passages, without an instruction that several items begin with."""
    firsts: dict[str, int] = {}
    split = []
    for item_id, text in items:
        head, _, rest = (text or "").partition(". ")
        split.append((item_id, text or "", head, rest))
        firsts[head] = firsts.get(head, 0) + 1
    out = []
    for item_id, text, head, rest in split:
        codes, flags = _answers(rest if rest and firsts[head] > 1 else text)
        out.append((item_id, codes, np.array(flags, dtype=bool)))
    return out


def _features(codes: np.ndarray) -> np.ndarray:
    return codes & np.int32(FEATURES - 1)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    ids, texts, size = [], [], 0
    for frame in frames:
        for doc_id, words in zip(frame["doc_id"], frame["words"]):
            ids.append(doc_id)
            texts.append(np.asarray(words, dtype=np.int32))
            size += len(texts[-1])
            if size >= BATCH_WORDS:
                yield np.array(ids), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids), texts


def blocks_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in rows of :data:`BLOCK`, which of them are words, text number of every row): texts padded to whole blocks."""
    lengths = np.array([len(t) for t in texts])
    rows = -(-lengths // BLOCK)
    codes = np.zeros(int(rows.sum()) * BLOCK, dtype=np.int32)
    used = np.zeros(len(codes), dtype=bool)
    first = (np.cumsum(rows) - rows) * BLOCK
    at = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    if len(at):
        codes[at] = np.concatenate(texts)
        used[at] = True
    return codes.reshape(-1, BLOCK), used.reshape(-1, BLOCK), np.repeat(np.arange(len(texts)), rows)


def _pairs_of_blocks(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) block of every passage: each block with the next of its text; the last block of a longer text starts none."""
    if not len(number):
        return number, number
    same = np.concatenate([number[1:] == number[:-1], [False]])
    single = ~same & np.concatenate([[True], number[1:] != number[:-1]])
    first = np.flatnonzero(same | single)
    return first, first + same[first]


def word_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the codes of every word of every text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            texts = [folded(t) for t in frame["text"]]
            step = 0
            while step < len(texts):
                size, stop = 0, step
                while stop < len(texts) and (size < 4 * BATCH_WORDS or stop == step):
                    size += len(texts[stop])
                    stop += 1
                codes, counts = word_hashes(texts[step:stop])
                out += np.split(codes.view(np.int32), np.cumsum(counts)[:-1])
                step = stop
            yield pd.DataFrame({"doc_id": frame["doc_id"], "words": out})

    return docs.mapInPandas(run, "doc_id long, words array<int>")


def block_frequencies(words: DataFrame) -> np.ndarray:
    """Blocks that hold each feature, over all documents, and last the number of passages: a vector of :data:`FEATURES` + 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(FEATURES + 1, dtype=np.int64)
        for _, texts in _batches(frames):
            codes, used, number = blocks_of(texts)
            held = np.where(used, _features(codes), -1)
            held.sort(axis=1)
            fresh = np.concatenate([held[:, :1] >= 0, (held[:, 1:] != held[:, :-1]) & (held[:, 1:] >= 0)], axis=1)
            counts[:FEATURES] += np.bincount(held[fresh], minlength=FEATURES)
            counts[FEATURES] += len(_pairs_of_blocks(number)[0])
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"feature": used, "n": counts[used]})

    rows = words.mapInPandas(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1, dtype=np.int64)
    counts[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return counts


def fit_sample(words: DataFrame, passages: int) -> DataFrame:
    """(features) of about :data:`FIT_PASSAGES` of all passages, drawn by a hash of the document and the passage's place.

    Two blocks of features a row; :data:`FEATURES` stands where there is no word.
    """
    limit = np.uint64(min(1.0, FIT_PASSAGES / max(1, passages)) * float(1 << 32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _batches(frames):
            codes, used, number = blocks_of(texts)
            first, last = _pairs_of_blocks(number)
            with np.errstate(over="ignore"):
                lot = (ids[number[first]].astype(np.uint64) * np.uint64(_PRIME) + first.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
            features = np.where(used, _features(codes), FEATURES)
            drawn = first[lot < limit], last[lot < limit]
            both = np.concatenate([features[drawn[0]], np.where((drawn[1] > drawn[0])[:, None], features[drawn[1]], FEATURES)], axis=1)
            # a batch of blank texts, or of a large corpus, may draw none; without a dtype an empty column would be one of floats
            yield pd.DataFrame({"features": pd.Series(list(both.astype(np.int32)), dtype=object)})

    return words.mapInPandas(run, "features array<int>")


def _image(features: np.ndarray, idf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows of A · ``table`` for passages with their features in a row each: A has idf over the passage's norm."""
    weighted = np.concatenate([idf[:, None] * table, np.zeros((1, table.shape[1]), dtype=np.float32)]).astype(np.float32)
    rows = np.zeros((len(features), table.shape[1]), dtype=np.float32)
    for k in range(features.shape[1]):
        rows += weighted[features[:, k]]
    return rows / _norms(features, idf)[:, None]


def _norms(features: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((np.append(idf, np.float32(0))[features] ** 2).sum(axis=1)), 1e-9).astype(np.float32)


def _back(features: np.ndarray, idf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, rows) of A' · ``rows``, where only the features that occur have a row."""
    flat = features.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] < FEATURES]
    held, first = np.unique(flat[order], return_index=True)
    if not len(held):
        return held, np.zeros((0, rows.shape[1]), dtype=np.float32)
    scaled = (rows / _norms(features, idf)[:, None])[order // features.shape[1]]
    return held, np.add.reduceat(scaled, first, axis=0) * idf[held][:, None]


def _matrix(parts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(parts), width), FEATURES, dtype=np.int64)
    for i, part in enumerate(parts):
        out[i, : len(part)] = part
    return out


def latent_basis(sample: DataFrame, queries: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """FEATURES x LATENT basis: a distributed randomised SVD of the tf-idf passages of the sample and the queries.

    First job: every task multiplies its passages A with a random matrix and back, A'(A R), one power
    iteration of the range finder; the parts are summed over the tasks in groups of rows. Second job:
    the small Gram matrix of A Q, whose eigenvectors turn the orthonormal Q into the leading right
    singular vectors; the :data:`OVERSAMPLE` weakest directions are dropped. To the driver come only
    sums of fixed size.
    """
    width = LATENT + OVERSAMPLE
    random = np.random.default_rng(SEED).standard_normal((FEATURES, width)).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(idf)
    size = FEATURES // CHUNKS

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.random.default_rng(SEED).standard_normal((FEATURES, width)).astype(np.float32)
        product = np.zeros((FEATURES, width), dtype=np.float32)
        for frame in frames:
            if len(frame):
                features = np.stack(frame["features"].to_numpy())
                held, rows = _back(features, shared.value, _image(features, shared.value, own))
                product[held] += rows
        yield pd.DataFrame({"chunk": range(CHUNKS), "part": [product[c * size : (c + 1) * size].tobytes() for c in range(CHUNKS)]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, dtype=np.float32).reshape(size, width) for p in frame["part"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"chunk": frame["chunk"][:1], "part": [total.astype(np.float32).tobytes()]})

    parts = sample.mapInPandas(spread, "chunk int, part binary").repartition(CHUNKS, "chunk").groupBy("chunk").applyInPandas(summed, "chunk int, part binary").collect()
    product = np.zeros((FEATURES, width))
    for r in parts:
        product[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["part"], dtype=np.float32).reshape(size, width)
    asked = _matrix(queries, QUERY_WORDS)
    held, rows = _back(asked, idf, _image(asked, idf, random))
    product[held] += rows
    q = np.linalg.qr(product + 1e-9 * random)[0].astype(np.float32)
    base = sample.sparkSession.sparkContext.broadcast(q)

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                image = _image(np.stack(frame["features"].to_numpy()), shared.value, base.value)
                total += image.T @ image
        yield pd.DataFrame({"part": [total.tobytes()]})

    square = np.zeros((width, width))
    for r in sample.mapInPandas(gram, "part binary").toLocalIterator():
        square += np.frombuffer(r["part"]).reshape(width, width)
    image = _image(asked, idf, q)
    square += image.T @ image
    return (q @ np.linalg.eigh(square)[1][:, ::-1][:, :LATENT]).astype(np.float32)


def common_subsequence(docs: np.ndarray, used: np.ndarray, masks: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of every pair of a document region and an item, bit-parallel.

    ``docs`` holds the regions' words as numbers of ``masks[item, number]``, the places of a word in an item,
    64 to a machine word, low places first. One step of all pairs costs a few array operations a word.
    """
    wide = masks.shape[2]
    v = np.full((len(docs), wide), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for step in range(docs.shape[1]):
            own = masks[items, docs[:, step]] * used[:, step, None].astype(np.uint64)
            carry = np.zeros(len(docs), dtype=np.uint64)
            for w in range(wide):
                u = v[:, w] & own[:, w]
                first = v[:, w] + u
                second = first + carry
                carry = ((first < u) | (second < carry)).astype(np.uint64)
                v[:, w] = second | (v[:, w] & ~own[:, w])
    return np.bitwise_count(~v).sum(axis=1).astype(np.int64)


def aligned_runs(docs: list[np.ndarray], items: list[np.ndarray], errors: int = RUN_ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """(words, end in item) of the longest run of item words that each document region repeats, or zeros.

    A run is in order and unbroken but for at most one word in :data:`ERROR_EVERY` replaced in or added
    to the document, ``errors`` at most. ``best[e, j, p]`` is the longest run of pair p that ends at item
    word j with e errors, below 0 where there is none; all pairs move on by one document word at a time.
    """
    rows, m, n = len(docs), max(map(len, items), default=0), max(map(len, docs), default=0)
    item = np.full((m, rows), -1, dtype=np.int64)
    doc = np.full((n, rows), -2, dtype=np.int64)
    for p in range(rows):
        item[: len(items[p]), p] = items[p]
        doc[: len(docs[p]), p] = docs[p]
    kind = np.int16 if m < 1 << 13 else np.int32
    none = kind(np.iinfo(kind).min // 2)
    best = np.full((errors + 1, m + 1, rows), none, dtype=kind)
    fresh, moved = best.copy(), np.empty((errors, m, rows), dtype=kind)
    longest, ends = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    least = ERROR_EVERY * np.arange(errors + 1)[:, None]
    for step in range(n):
        same = item == doc[step]
        np.maximum(best[:, :-1], 0, out=fresh[:, 1:])
        fresh[:, 1:] += np.where(same, kind(1), none)
        # replaced: both sides move on; added: the document alone does; a run starts and ends with a match
        np.add(best[:-1, :-1], 1, out=moved)
        np.maximum(fresh[1:, 1:], moved, out=fresh[1:, 1:])
        np.maximum(fresh[1:], best[:-1], out=fresh[1:])
        best, fresh = fresh, best
        at, pair = np.nonzero(same)
        hit = best[:, at + 1, pair].astype(np.int64)
        hit = np.where(hit >= least, hit, 0).max(axis=0)
        better = np.flatnonzero(hit > longest[pair])
        if len(better):
            better = better[np.lexsort((at[better], -hit[better], pair[better]))]
            own, first = np.unique(pair[better], return_index=True)
            longest[own], ends[own] = hit[better[first]], at[better[first]] + 1
    return longest, ends


def same_answers(doc: np.ndarray, item: np.ndarray, answers: np.ndarray, begin: int, end: int) -> bool:
    """Whether a run is about the item's own names and figures, not a sentence of the same build about others."""
    asked = item[max(0, begin) : end][answers[max(0, begin) : end]]
    return not len(asked) or 2 * int(np.isin(asked, doc).sum()) > len(asked)


def answers_needed(answers: np.ndarray) -> int:
    """Names and figures of an item that must be near, for any run of it to pass :func:`same_answers`."""
    if len(answers) < LEAK_WORDS:
        return 0
    total = np.concatenate([[0], np.cumsum(answers)])
    least = int((total[LEAK_WORDS:] - total[:-LEAK_WORDS]).min())
    return least // 2 + 1 if least else 0


class Index:
    """What a task needs of the items: their words by number, the places of each, and their latent passages."""

    def __init__(self, wanted: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, basis: np.ndarray) -> None:
        self.wanted = wanted
        self.table = np.concatenate([idf[:, None] * basis, np.zeros((1, LATENT), dtype=np.float32)]).astype(np.float32)
        self.words = np.unique(np.concatenate([c for _, c, _ in wanted] or [np.zeros(0, dtype=np.int32)]))
        wide = max(1, -(-max((len(c) for _, c, _ in wanted), default=1) // 64))
        self.masks = np.zeros((max(1, len(wanted)), len(self.words) + 1, wide), dtype=np.uint64)
        self.answers = np.zeros((max(1, len(wanted)), wide), dtype=np.uint64)
        self.asked = np.array([answers_needed(a) for _, _, a in wanted] or [0])
        queries, owner = [], []
        for k, (_, codes, _) in enumerate(wanted):
            for j, w in enumerate(np.searchsorted(self.words, codes)):
                self.masks[k, w + 1, j // 64] |= np.uint64(1) << np.uint64(j % 64)
            for j in np.flatnonzero(wanted[k][2]).tolist():
                self.answers[k, j // 64] |= np.uint64(1) << np.uint64(j % 64)
            for s in range(0, max(1, len(codes) - QUERY_WORDS + QUERY_STEP), QUERY_STEP):
                part = codes[s : s + QUERY_WORDS]
                if len(part):
                    queries.append(self.table[_features(part)].sum(axis=0))
                    owner.append(k)
        self.query = np.array(queries, dtype=np.float32).reshape(-1, LATENT)
        self.query /= np.maximum(np.linalg.norm(self.query, axis=1, keepdims=True), 1e-9)
        self.owner = np.array(owner, dtype=np.int64)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Number of every word among the items' words, from 1; 0 for other words."""
        if not len(self.words):
            return np.zeros(codes.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, at + 1, 0)

    def candidates(self, codes: np.ndarray, used: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first block, item, cosine) of the passages whose cosine with a passage of the item is :data:`CANDIDATE_COSINE` or more."""
        features = np.where(used, _features(codes), FEATURES)
        rows = np.zeros((len(codes), LATENT), dtype=np.float32)
        for k in range(BLOCK):
            rows += self.table[features[:, k]]
        first, last = _pairs_of_blocks(number)
        latent = rows[first] + np.where((last > first)[:, None], rows[last], 0)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        at, items, values = [], [], []
        for s in range(0, len(latent), 4096):
            cosine = latent[s : s + 4096] @ self.query.T
            rows_near = np.flatnonzero(cosine.max(axis=1) >= CANDIDATE_COSINE)
            if len(rows_near):
                near, which = np.nonzero(cosine[rows_near] >= CANDIDATE_COSINE)
                near = rows_near[near]
                key, back = np.unique(near * len(self.wanted) + self.owner[which], return_inverse=True)
                top = np.zeros(len(key), dtype=np.float32)
                np.maximum.at(top, back, cosine[near, which])
                at.append(first[s + key // len(self.wanted)])
                items.append(key % len(self.wanted))
                values.append(top)
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        return np.concatenate(at), np.concatenate(items), np.concatenate(values)


def search(ids: np.ndarray, texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, float]]:
    """(doc, item, repeated words, cosine) of the texts of one batch: candidates by cosine, then subsequence, run and answers."""
    codes, used, number = blocks_of(texts)
    if not len(codes) or not len(index.query):
        return []
    at, items, cosine = index.candidates(codes, used, number)
    if not len(at):
        return []
    needed = LEAK_WORDS - LEAK_WORDS // ERROR_EVERY
    # the passage's blocks and one on either side, as far as they are of its text
    around = at[:, None] + np.arange(-1, 3)[None, :]
    inside = (around >= 0) & (around < len(number))
    around = np.clip(around, 0, len(number) - 1)
    inside &= number[around] == number[at][:, None]
    own = index.numbers(codes[around].reshape(len(at), -1))
    live = (used[around] & inside[:, :, None]).reshape(len(at), -1)
    places = index.masks[items[:, None], own] * live[:, :, None].astype(np.uint64)
    named = np.bitwise_count(np.bitwise_or.reduce(places, axis=1) & index.answers[items]).sum(axis=1)
    kept = np.flatnonzero(((places != 0).any(axis=2).sum(axis=1) >= needed) & (named >= index.asked[items]))
    kept = kept[common_subsequence(own[kept], live[kept], index.masks, items[kept]) >= needed]
    spans: dict[tuple[int, int], list[list[int]]] = {}
    best: dict[tuple[int, int], float] = {}
    for k in kept.tolist():
        key = (int(number[at[k]]), int(items[k]))
        low, high = int(around[k][inside[k]].min()), int(around[k][inside[k]].max()) + 1
        own_spans = spans.setdefault(key, [])
        if own_spans and low <= own_spans[-1][1]:
            own_spans[-1][1] = max(high, own_spans[-1][1])
        else:
            own_spans.append([low, high])
        best[key] = max(best.get(key, 0.0), float(cosine[k]))
    regions = [(key, codes[a:b][used[a:b]]) for key, own_spans in spans.items() for a, b in own_spans]
    out: dict[tuple[int, int], tuple[int, int, int, float]] = {}
    regions.sort(key=lambda r: len(r[1]))
    for s in range(0, len(regions), 256):
        part = regions[s : s + 256]
        runs, ends = aligned_runs([r for _, r in part], [index.wanted[key[1]][1] for key, _ in part])
        for (key, region), n, j in zip(part, runs.tolist(), ends.tolist()):
            item_id, item, answers = index.wanted[key[1]]
            if n >= LEAK_WORDS and same_answers(region, item, answers, j - n, j) and (key not in out or out[key][2] < n):
                out[key] = (int(ids[key[0]]), item_id, n, best[key])
    return list(out.values())


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, cosine) of documents that repeat a passage of an item.

    Candidates: passages of all documents whose cosine with a passage of an item, in the latent space of
    :func:`latent_basis`, is :data:`CANDIDATE_COSINE` or more. Checks: the surroundings of a candidate
    share a common subsequence with the item that a leak needs (:func:`common_subsequence`); word by word
    at least :data:`LEAK_WORDS` words repeat in a run (:func:`aligned_runs`), among them most of the names
    and figures of that run (:func:`same_answers`). ``words`` is the longest run with at most
    :data:`RUN_ERRORS` errors. ``items`` is the fixed list of test passages and is taken to the driver; of the
    documents only sums of fixed size are. Texts are read whole and stay in their task, no document
    is shuffled; NULL ids, NULL and empty texts hold nothing; every copy of a text comes out; repeated rows
    come out once; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    wanted = passages_of([(int(r[0]), r[1]) for r in items.select("item_id", "item_text").where("item_id is not null").distinct().collect()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    words = cut(word_codes(rows))
    counts = block_frequencies(words)
    passages = max(1, int(counts[FEATURES]))
    idf = (np.log((passages + 1) / (counts[:FEATURES] + 0.5)).clip(min=0) ** 2).astype(np.float32)
    queries = [_features(codes[s : s + QUERY_WORDS]) for _, codes, _ in wanted for s in range(0, max(1, len(codes) - QUERY_WORDS + QUERY_STEP), QUERY_STEP)]
    basis = latent_basis(cut(fit_sample(words, passages)), queries, idf)
    shared = spark.sparkContext.broadcast((wanted, idf, basis))  # about 17 MB, whatever the corpus

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for ids, texts in _batches(frames):
            yield pd.DataFrame(search(ids, texts, index), columns=["doc_id", "item_id", "words", "cosine"])

    return words.mapInPandas(run, "doc_id long, item_id long, words int, cosine double").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("cosine").alias("cosine"))
