"""Documents into fixed-capacity training sequences, along a space-filling curve.

1. Every text is sized in tokens of a public tokenizer, and its hashed token counts are projected to
   ``DIMENSIONS`` numbers (a fixed random projection of the normalised hashed vector).
2. Each number is replaced by its rank among all documents (``2**BITS`` equal parts, each divided evenly into
   ``2**FINE_BITS``), and the ranks give the document's place on a Hilbert curve, so that documents with like
   wording lie near each other.
3. The curve is cut into stretches of about ``STRETCH`` tokens: the token counts of its ``2**CELL_BITS``
   cells are summed first, so the cuts depend on the data alone. A cell of more tokens is cut by its own cells in the same
   way, and so on, as many levels as the place has bits for; only documents of one and the same place, such as a hot group of
   copies, are divided by the hash of ``doc_id``.
4. Each stretch is packed in the order of the curve: in blocks of ``NEIGHBOURS`` documents the longest
   first, into the fullest open sequence that has room, or a new one.

A document of at most the capacity is never split. A longer one fills sequences of its own, and its rest is
packed like a document. Null and empty texts are left out; texts of white space have tokens and are packed.
Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import sys
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.hashing import mix
from tallyforge.session import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HASHED, DIMENSIONS, BITS, FINE_BITS, CELL_BITS = 256, 4, 6, 6, 12
STRETCH, NEIGHBOURS = 4_000_000, 2048
#: Cells up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_MOST = 1_000_000


def vocabulary(folder: str = TOKENIZERS) -> bytes:
    """The vocabulary's file, about a megabyte. Only the driver reads it; the executors are sent it."""
    return Path(f"{folder}/{VOCABULARY}").read_bytes()


def tokenizer(file: bytes):
    """The byte-level vocabulary's encoder, made once in each process."""
    held = sys.__dict__.setdefault("_tallyforge_tokenizers", {})
    name = xxhash.xxh64_hexdigest(file)
    if name not in held:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        held[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[name]


def projection(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token, and where the buckets are projected to."""
    ids = mix(np.arange(size, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    matrix = np.random.default_rng(11).normal(0, 1, (HASHED, DIMENSIONS)).astype(np.float32)
    return (ids % np.uint64(HASHED)).astype(np.int64), np.where(ids >> np.uint64(63), 1.0, -1.0).astype(np.float32), matrix


def _sized(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(file.value)
        bucket, sign, matrix = projection(coder.n_vocab)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.array(coder.encode_ordinary(t), np.int64) for t in part.column("text").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(ids)), sizes)
                counts = np.bincount(row * HASHED + bucket[flat], sign[flat], minlength=len(ids) * HASHED).reshape(len(ids), HASHED)
                damped = np.sign(counts) * np.log1p(np.abs(counts))
                norm = np.linalg.norm(damped, axis=1, keepdims=True)
                at = (damped / np.maximum(norm, 1e-9)) @ matrix
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *[pa.array(at[:, k].astype(np.float32)) for k in range(DIMENSIONS)]], names=["doc_id", "n_tokens", *[f"x{k}" for k in range(DIMENSIONS)]])

    return run


def sized(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_tokens`` and the projected vector of every non-empty text, written once."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL AND text <> ''")
    schema = "doc_id bigint, n_tokens bigint, " + ", ".join(f"x{k} float" for k in range(DIMENSIONS))
    return materialize(docs.mapInArrow(_sized(docs.sparkSession.sparkContext.broadcast(vocabulary(folder))), schema), "sized")


def hilbert(ranks: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), coordinates below ``2**bits``.

    Each level's step turns and mirrors the rest of the point (Gray code of the level's bits); the bits of
    all levels, interleaved, are the place.
    """
    x = ranks.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            up = (x[k] & q) != 0
            swap = (x[0] ^ x[k]) & low
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = np.where(up, x[k], x[k] ^ swap)
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            place = place << 1 | (x[k] >> b & 1)
    return place


def _placed(cuts: list[list[float]]):
    """``cuts`` has for each number its least value, the borders of the equal parts, and its greatest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.array(c, np.float32) for c in cuts]
        for batch in batches:
            ranks = []
            for k, own in enumerate(edges):
                x = batch.column(f"x{k}").to_numpy(zero_copy_only=False)
                part = np.searchsorted(own[1:-1], x, side="right")
                low, high = own[part], own[part + 1]
                within = np.where(high > low, (x - low) / np.where(high > low, high - low, 1), 0)
                ranks.append(part << FINE_BITS | np.clip(within * (1 << FINE_BITS), 0, (1 << FINE_BITS) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(hilbert(np.stack(ranks, 1), BITS + FINE_BITS))], names=["doc_id", "n_tokens", "place"])

    return run


def stretches(sizes: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, place, stretch``: where each document lies on the curve, and its stretch's name."""
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    numbers = range(DIMENSIONS)
    row = sizes.agg(*[F.percentile_approx(f"x{k}", shares, 10_000).alias(f"x{k}") for k in numbers], *[f(f"x{k}").alias(f"{n}{k}") for k in numbers for n, f in (("low", F.min), ("high", F.max))]).collect()[0]
    cuts = [[row[f"low{k}"], *row[f"x{k}"], row[f"high{k}"]] if row[f"x{k}"] else [0.0, 0.0] for k in numbers]
    rest = materialize(sizes.mapInArrow(_placed(cuts), "doc_id bigint, n_tokens bigint, place bigint"), "placed").withColumn("parent", F.lit(0).cast("bigint"))
    bits, out = DIMENSIONS * (BITS + FINE_BITS), []
    for level in range(1, bits // CELL_BITS + 1):
        rows = rest.withColumn("cell", F.shiftright("place", bits - level * CELL_BITS))
        tokens = rows.groupBy("parent", "cell").agg(F.sum("n_tokens").alias("tokens"))
        # a parent has at most 2**CELL_BITS cells, so its window is small
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = materialize(tokens.select("parent", "cell", "tokens", F.floor(before / STRETCH).alias("nth")), "cells")
        size, hot = cells.agg(F.count("*"), F.count_if(F.col("tokens") > STRETCH)).collect()[0]
        held = rows.drop("tokens").join(F.broadcast(cells) if size <= BROADCAST_MOST else cells, ["parent", "cell"])
        out.append(held.where(F.col("tokens") <= STRETCH).select("doc_id", "n_tokens", "place", F.concat_ws("-", F.lit(level), "parent", "nth").alias("stretch")))
        rest = held.where(F.col("tokens") > STRETCH).select("doc_id", "n_tokens", "place", F.col("cell").alias("parent"), "tokens")
        if not hot:
            break
    else:
        part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("tokens") / STRETCH))
        out.append(rest.select("doc_id", "n_tokens", "place", F.concat_ws("-", F.lit("same"), "place", part).alias("stretch")))
    return reduce(DataFrame.unionByName, out)


def pack(ids: np.ndarray, tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, tokens, sequence, offset) of the pieces of items given in the order of the curve."""
    item, piece, size, sequence, offset = [], [], [], [], []
    room: list[tuple[int, int]] = []  # (tokens free, sequence), sorted
    filled: list[int] = []
    for lo in range(0, len(ids), NEIGHBOURS):
        block = []
        for k in range(lo, min(lo + NEIGHBOURS, len(ids))):
            rest, number = int(tokens[k]), 0
            while rest > capacity:
                item.append(k)
                piece.append(number)
                size.append(capacity)
                sequence.append(len(filled))
                offset.append(0)
                filled.append(capacity)
                rest -= capacity
                number += 1
            block.append((rest, k, number))
        block.sort(key=lambda x: (-x[0], x[1]))
        for own, k, number in block:
            at = bisect.bisect_left(room, (own, -1))
            if at < len(room):
                free, s = room.pop(at)
            else:
                free, s = capacity, len(filled)
                filled.append(0)
            item.append(k)
            piece.append(number)
            size.append(own)
            sequence.append(s)
            offset.append(filled[s])
            filled[s] += own
            if free > own:
                bisect.insort(room, (free - own, s))
    return np.array(item, np.int64), np.array(piece, np.int32), np.array(size, np.int64), np.array(sequence, np.int64), np.array(offset, np.int64)


def sequences(placed: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, n_tokens, sequence_id, start``: the sequence of every piece of every document, and where in it it starts."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id"], kind="stable")
        ids, name = rows["doc_id"].to_numpy(), rows["stretch"].iloc[0]
        item, piece, size, sequence, offset = pack(ids, rows["n_tokens"].to_numpy(), capacity)
        return pd.DataFrame({"doc_id": ids[item], "piece": piece, "n_tokens": size, "sequence_id": [f"{name}-{k}" for k in sequence.tolist()], "start": offset})

    return placed.groupBy("stretch").applyInPandas(packed, "doc_id bigint, piece int, n_tokens bigint, sequence_id string, start bigint")


def unused(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: how many sequences there are, their tokens, and the share of their room that is unused."""
    # every sequence has one piece at its start, every document one first piece
    total = packed.agg(F.count_if(F.col("start") == 0).alias("n_sequences"), F.count_if(F.col("piece") == 0).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return total.select(F.lit(capacity).alias("capacity"), "n_docs", "n_sequences", "n_tokens", F.coalesce(1 - F.try_divide(F.col("n_tokens"), F.col("n_sequences") * capacity), F.lit(0.0)).alias("unused_share"))
