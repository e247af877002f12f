"""Texts into containers of fixed token capacity: vector best-fit under several constraints."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.runtime import cut

#: Tokens and documents a container may hold.
CAPACITY, MAX_DOCS = 4096, 64
#: Attention cost (sum of squared lengths) a container of several pieces may hold, as a share of the squared
#: capacity: below 1 it binds where tokens and places would still fit.
COST_SHARE = 0.5
#: Pieces that are packed together; many shards pack side by side.
SHARD = 8_000
#: Containers below this fill are opened again and their pieces packed across shards.
REFILL = 0.97
#: Folder of the tokenizer files; the environment's own where the parameter is not given.
TOKENIZERS = os.environ.get("PITCHGRID_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"


def token_lengths(docs: DataFrame, tokenizers: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text in tokens of a public tokenizer; whole texts, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own only contend
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(tokenizers, name))
        tokenizer.encode_special_tokens = True
        for frame in frames:
            tokens: list[int] = []
            texts = frame["text"].tolist()
            for s in range(0, len(texts), 256):
                tokens += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[s : s + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "tokens": tokens})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, tokens int")


def cost_limit(capacity: int = CAPACITY) -> int:
    return int(COST_SHARE * capacity * capacity)


def pack(tokens: np.ndarray, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None) -> np.ndarray:
    """Container number of every piece, by vector best-fit in order of falling length.

    A container's residual vector is its free tokens, places and attention cost, each as a share of the
    whole. A piece goes to the container in which all three fit and the weighted residual norm left
    over is least; tokens weigh most. ``max_cost`` is :func:`cost_limit` by default. A piece that alone
    costs more than ``max_cost`` cannot be divided and gets a container of its own, so that every
    container of several pieces keeps all three bounds. A container that no remaining piece fits is closed.
    """
    max_cost = cost_limit(capacity) if max_cost is None else max_cost
    weights = np.array([1.0, 0.05, 0.05])
    number = np.full(len(tokens), -1, dtype=np.int64)
    order = np.argsort(-tokens, kind="stable")
    smallest = int(tokens.min()) if len(tokens) else 0
    free = np.zeros((3, 64))
    label = np.zeros(64, dtype=np.int64)
    size = opened = 0
    whole = np.array([capacity, max_docs, max_cost], dtype=float)
    for at in order:
        t = int(tokens[at])
        need = np.array([t, 1, float(t) * t])
        slot = -1
        if size:
            left = free[:, :size] - need[:, None]
            fits = (left >= 0).all(axis=0)
            if fits.any():
                norm = (weights[:, None] * (left / whole[:, None]) ** 2).sum(axis=0)
                norm[~fits] = np.inf
                slot = int(norm.argmin())
        if slot < 0:
            if size == free.shape[1]:
                free = np.concatenate([free, np.zeros_like(free)], axis=1)
                label = np.concatenate([label, np.zeros_like(label)])
            slot, size = size, size + 1
            free[:, slot] = whole
            label[slot] = opened
            opened += 1
        free[:, slot] -= need
        number[at] = label[slot]
        if free[0, slot] < smallest or free[1, slot] < 1 or free[2, slot] < float(smallest) * smallest:
            size -= 1
            free[:, slot], label[slot] = free[:, size], label[size]
    return number


def _round(pieces: DataFrame, shards: int, capacity: int, max_docs: int, max_cost: int, step: str) -> DataFrame:
    """Pack the pieces shard by shard: adds ``container`` (text, unique over shards) and its fill."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        number = pack(frame["tokens"].to_numpy(), capacity, max_docs, max_cost)
        fill = np.bincount(number, weights=frame["tokens"].to_numpy())[number] / capacity
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "piece": frame["piece"], "tokens": frame["tokens"],
            "container": [f"{step}-{s}-{n}" for s, n in zip(frame["shard"], number)], "fill": fill,
        })

    # packing costs far more than a shard's bytes suggest, so no two shards are coalesced into one task
    return pieces.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "doc_id long, piece int, tokens int, container string, fill double")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, shard: int = SHARD, max_cost: int | None = None, **tokenizer: str) -> DataFrame:
    """(doc_id, piece, tokens, container): every text in containers of ``capacity`` tokens.

    A text is one piece unless it alone exceeds the capacity; then its full pieces fill containers of
    their own and the rest is packed as a piece. Pieces are spread over shards by hash, so that each
    shard sees the whole mix of lengths and no task more than about ``shard`` pieces, and packed by
    :func:`pack`; the containers that stay below :data:`REFILL` are opened and packed once more, over
    fewer shards. No container of several pieces exceeds the tokens, places or attention cost
    (``max_cost``, :func:`cost_limit` by default); a piece that alone costs more has a container to itself.
    Each doc_id is packed once, with its longest text; NULL and empty texts have no tokens and get no
    container. Only ids and lengths are shuffled, never texts.
    """
    max_cost = cost_limit(capacity) if max_cost is None else max_cost
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    sized = token_lengths(rows, **tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").cast("int").alias("tokens"))
    cap = F.lit(capacity)
    full = F.floor(F.col("tokens") / cap).cast("int")
    last = F.struct(full.alias("piece"), (F.col("tokens") % cap).cast("int").alias("tokens"))
    heads = F.transform(F.sequence(F.lit(0), full - 1), lambda p: F.struct(p.cast("int").alias("piece"), cap.cast("int").alias("tokens")))
    pieces = F.when(full == 0, F.array(last)).when(F.col("tokens") % cap == 0, heads).otherwise(F.concat(heads, F.array(last)))
    pieces = cut(sized.select("doc_id", F.inline(pieces)))
    number = pieces.count()
    shards = max(1, -(-number // shard))
    first = cut(_round(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))), shards, capacity, max_docs, max_cost, "a"))
    loose = first.where(F.col("fill") < REFILL)
    again = loose.count()
    shards = max(1, -(-again // shard))
    second = _round(loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(shards))), shards, capacity, max_docs, max_cost, "b")
    return first.where(F.col("fill") >= REFILL).unionByName(second).select("doc_id", "piece", "tokens", "container")


def packing_report(packed: DataFrame, capacity: int = CAPACITY, max_cost: int | None = None) -> DataFrame:
    """Containers, pieces, the share of room left over and how far the attention cost is used.

    ``cost_bound`` counts the containers of several pieces that the cost closed: another piece like
    the least of theirs would still fit by tokens but not by cost.
    """
    max_cost = cost_limit(capacity) if max_cost is None else max_cost
    square = F.col("tokens").cast("long") * F.col("tokens")
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(square).alias("cost"), F.min("tokens").alias("least"))
    small = F.col("least").cast("long")
    bound = (F.col("tokens") + small <= capacity) & (F.col("cost") + small * small > max_cost)
    return per.agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.lit(capacity)), 6).alias("unused"),
        F.max(F.when(F.col("pieces") > 1, F.col("cost"))).alias("dearest"), F.round(F.avg("cost") / F.lit(max_cost), 6).alias("cost_used"), F.count(F.when(bound, 1)).alias("cost_bound"),
    )
