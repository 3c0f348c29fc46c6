"""Exact integer scores of query rounds against a table of vectors, and the best of them per query."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).min
CHUNK = 512  # queries scored at a time


@dataclass
class Rows:
    """Vectors of one length with what belongs to them; at[i] is the place of row i in its round."""

    vec: np.ndarray
    id: np.ndarray
    label: np.ndarray
    row: np.ndarray
    at: np.ndarray


def rows_by_length(t: pa.Table | pa.RecordBatch) -> dict[int, Rows]:
    """Columns row, vec_id, q and perhaps label -> Rows by number of components, in id order."""
    if not t.num_rows:
        return {}
    t = pa.table(t.to_pydict(), schema=t.schema) if isinstance(t, pa.RecordBatch) else t.combine_chunks()
    row, ids = (t.column(c).to_numpy() for c in ("row", "vec_id"))
    label = t.column("label").to_numpy() if "label" in t.column_names else row
    q = t.column("q").combine_chunks() if t.column("q").num_chunks != 1 else t.column("q").chunk(0)
    size = np.diff(q.offsets.to_numpy())
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        at = at[np.lexsort((row[at], ids[at]))]
        vec = q.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
        out[int(d)] = Rows(vec, ids[at], label[at], row[at], at)
    return out


def query_rounds(queries: DataFrame, most: int):
    """The rows of a written table (with a column row that tells them apart) in rounds of about `most`
    rows each, dealt out by hash: the only queries that the driver ever holds."""
    n = queries.count()
    rounds = -(-n // most)
    for i in range(rounds):
        yield queries.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == i).toArrow()


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """No sum of products of the rows of two integer matrices leaves the exact range of doubles."""
    bound = [np.sqrt(np.square(x.astype(np.float64)).sum(1)).max() for x in (a, b)]
    return bound[0] * bound[1] < 2.0 ** 52


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can leave their exact range."""
    if exact_in_doubles(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_pairs(q, score, ids, k: int):
    """The k best rows of each query; ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    stays = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[stays], score[stays], ids[stays]


def score_blocks(batches, queries: dict[int, Rows]):
    """(scores, queries, slice of them, rows of the batch) for every batch, length and chunk of queries."""
    for batch in batches:
        for d, b in rows_by_length(batch).items():
            if d in queries:
                a = queries[d]
                for i in range(0, len(a.id), CHUNK):
                    part = slice(i, i + CHUNK)
                    yield products(a.vec[part], b.vec), a, part, b


class Best:
    """The k best rows of each of `n` queries so far: highest score first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, rows: Rows, allowed: np.ndarray) -> None:
        """scores[i, j]: of query at[i] and row j; rows stand in id order."""
        if not len(at) or not scores.shape[1]:
            return
        width = scores.shape[1]
        bits = width.bit_length()
        if int(np.abs(scores).max()) < 1 << (62 - bits):  # score and place in one number: no ties
            key = np.where(allowed, (scores << bits) | ((1 << bits) - 1 - np.arange(width)), NONE)
            if width > self.k:
                key = np.partition(key, width - self.k, axis=1)[:, width - self.k:]
            col = np.where(key == NONE, 0, (1 << bits) - 1 - (key & ((1 << bits) - 1)))
            new = np.where(key == NONE, NONE, key >> bits)
        else:
            masked = np.where(allowed, scores, NONE)
            col = np.lexsort((np.broadcast_to(np.arange(width), masked.shape), ~masked), axis=-1)[:, :self.k]
            new = np.take_along_axis(masked, col, 1)
        score = np.hstack([self.score[at], new])
        ids, row = np.hstack([self.id[at], rows.id[col]]), np.hstack([self.row[at], rows.row[col]])
        order = np.lexsort((row, ids, ~score), axis=-1)[:, :self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, 1) for x in (score, ids, row))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, row) of all that is held."""
        q, j = np.nonzero(self.score != NONE)
        return q, self.score[q, j], self.id[q, j], self.row[q, j]
