"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (sum of squared lengths). A piece takes
(length, 1, length^2). Pieces of one length are interchangeable, so the packing is worked out on the
histogram of lengths (at most `max_tokens` rows, whatever the corpus): from the longest length down, each
lot of equal pieces goes to the bins with the best score among those where every capacity holds: the
largest weighted dot product of demand and residual, or the least weighted residual norm. Bins with equal
content are one entry with a count; one length adds at most a few entries. The plan says, for the r-th
piece of a length, which bin and offset it has. Pieces get their r from two-level counts, so a length that
holds a third of all pieces is no hot key."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import tokens as T
from ledgerlake.llm.common import cut, table

MAX_TOKENS, MAX_DOCS = 1024, 1024
PART_ROWS = 16_384  # pieces of a length that are ranked together


def pieces_of(docs: DataFrame, id_col: str, text_col: str, max_tokens: int, path: str, end_id: int = T.END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of a text and the end id; only longer ones are cut,
    the first piece takes what is left over."""
    end = end_id.to_bytes(4, "little")

    def cut_up(batches):
        enc = T.encoder(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % max_tokens + 1, n + 1, max_tokens)]
                out += [(doc, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], max_tokens: int, max_docs: int, max_cost: int,
             weights=(1.0, 0.05, 0.05), rule: str = "norm") -> list[tuple]:
    """Runs (length, first rank, per bin, bins, first bin, offset): from the first rank on, each of
    `bins` bins takes `per bin` pieces of the length, at offset, offset + length ..."""
    cap = np.array([max_tokens, max_docs, max_cost], float)
    w = np.array(weights)
    room: list[list[int]] = []  # residuals of an entry
    bins: list[list[tuple[int, int]]] = []  # its bins, as ranges (first, number)
    runs, opened = [], 0

    def put(length, rank, per, entry, number):
        """Takes `number` bins out of an entry and gives each `per` pieces."""
        taken, left = [], number
        while left:
            first, k = bins[entry].pop()
            use = min(k, left)
            taken.append((first, use))
            if use < k:
                bins[entry].append((first + use, k - use))
            left -= use
        offset = max_tokens - room[entry][0]
        for first, k in taken:
            runs.append((length, rank, per, k, first, offset))
            rank += per * k
        rest = [room[entry][0] - per * length, room[entry][1] - per, room[entry][2] - per * length * length]
        if not bins[entry]:
            room[entry], bins[entry] = rest, taken
        elif rest in room:
            bins[room.index(rest)] += taken
        else:
            room.append(rest)
            bins.append(taken)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        need = np.array([length, 1, length * length], float)
        while left:
            r = np.array(room, float).reshape(-1, 3)
            fits = (r >= need).all(1)
            if not fits.any():
                per = min(max_tokens // length, max_docs, max_cost // (length * length))
                number = max(1, left // per)
                room.append([max_tokens, max_docs, max_cost])
                bins.append([(opened, number)])
                opened += number
                entry = len(room) - 1
            else:
                score = (w * (need / cap) * (r / cap)).sum(1) if rule == "dot" else -(w * ((r - need) / cap) ** 2).sum(1)
                entry = int(np.argmax(np.where(fits, score, -np.inf)))
            t, d, c = room[entry]
            per = min(t // length, d, c // (length * length))
            have = sum(k for _, k in bins[entry])
            if left >= per:
                number = min(have, left // per)
            else:
                per, number = left, 1
            put(length, rank, per, entry, number)
            rank, left = rank + per * number, left - per * number
            if len(room) > 4 * max_tokens:  # drop full entries
                keep = [i for i, x in enumerate(room) if min(x) > 0]
                room[:], bins[:] = [room[i] for i in keep], [bins[i] for i in keep]
    return runs


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds r, the rank (from 0) of a piece among those of its length. counts: pieces of each length; a length
    is ranked in as many parts as its number of pieces asks for."""
    parts = pieces.sparkSession.createDataFrame([(n, -(-k // PART_ROWS)) for n, k in counts.items()], "length long, parts long")
    part = (pieces.join(F.broadcast(parts), "length")  # at most max_tokens rows
            .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts"))).drop("parts"))
    counts = part.groupBy("length", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    return part.join(base, ["length", "part"]).withColumn("r", F.col("base") + F.row_number().over(w) - 1).drop("part", "base")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
         max_docs: int = MAX_DOCS, max_cost: int | None = None, rule: str = "norm", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    Null and empty texts are one end id. Rows that repeat an id are packed each. max_cost defaults to
    max_tokens^2, which a bin within max_tokens cannot exceed; with a smaller one pieces are cut at its square
    root, so that each fits in an empty bin. Limits below 1 are a ValueError. Other columns are not read; an empty table gives an empty result."""
    max_cost = max_tokens * max_tokens if max_cost is None else max_cost
    if min(max_tokens, max_docs, max_cost) < 1:
        raise ValueError("one token must fit in an empty bin")
    longest = min(max_tokens, math.isqrt(max_cost))
    pieces = cut(pieces_of(docs, id_col, text_col, longest, path or T.default_path()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    runs = best_fit(counts, max_tokens, max_docs, max_cost, rule=rule)
    by_length: dict[int, np.ndarray] = {}
    for run in sorted(runs):
        by_length.setdefault(run[0], []).append(run[1:])
    plan = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def place(batches):
        for batch in batches:
            length, r = (batch.column(c).to_numpy() for c in ("length", "r"))
            seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, per, _, start, offset = plan.value[int(n)].T
                i = np.searchsorted(first, r[at], "right") - 1
                k = r[at] - first[i]
                seq[at], off[at] = start[i] + k // per[i], offset[i] + k % per[i] * n
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "r").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
