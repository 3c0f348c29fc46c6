"""Hard negatives by a secondary-sort shuffle.

Anchors go to the table in rounds of bounded size; each task scores a round against its own rows, exactly,
and keeps per anchor only what the result can need: its first positives, and, once the windows of all
positives are known, the first negatives of each window. What is kept is packed into keys

    anchor | descending score | positive before negative | id     (25 bytes, in byte order)

dealt out by anchor and sorted by key inside the partitions (repartitionAndSortWithinPartitions in its
DataFrame form, so that the sort can spill). An iterator reads the keys in order: a positive opens its
window, a negative is emitted to every open window that it falls into. It holds the windows of one anchor
and no list of rows; a negative of a window never stands before the positive that opens it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import cut, received, sent, table, union_all
from ledgerlake.llm.topk import quantised
from ledgerlake.llm.vectors import Best, query_rounds, rows_by_length, score_blocks

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
LEAST, MOST = 50, 95  # percent of a positive's score
ROUND = 16_384  # anchors a round
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PAIR = "anchor long, score long, id long"
SIGN = np.uint64(1 << 63)


def windows(scores: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): integers s with least * p <= 100 * s <= most * p. Empty (low > high) below zero."""
    return -((-least * scores) // 100), (most * scores) // 100


def packed(anchor, score, negative, ids) -> pa.Array:
    """Keys whose byte order is the order of the shuffle."""
    key = np.empty((len(anchor), 25), np.uint8)
    key[:, :8] = (anchor.view(np.uint64) ^ SIGN).astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:16] = (~(score.view(np.uint64) ^ SIGN)).astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 16] = negative
    key[:, 17:] = (ids.view(np.uint64) ^ SIGN).astype(">u8").view(np.uint8).reshape(-1, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())


def unpacked(keys: pa.Array):
    """(anchor, score, negative, id) columns."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 25)
    def part(i):
        return np.ascontiguousarray(raw[:, i:i + 8]).view(">u8").ravel().astype(np.uint64)
    return ((part(0) ^ SIGN).view(np.int64), (~part(8) ^ SIGN).view(np.int64), raw[:, 16], (part(17) ^ SIGN).view(np.int64))


def _pairs(anchor, score, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, score, ids)], ["anchor", "score", "id"])


def first_positives(rows: DataFrame, anchors, k: int) -> DataFrame:
    """(anchor, score, id): per task the first k rows of each anchor's label."""
    def task(batches):
        asked = received(anchors)
        held = {d: Best(len(a.id), k) for d, a in asked.items()}
        for scores, a, part, b in score_blocks(batches, asked):
            free = (a.label[part][:, None] == b.label[None, :]) & (a.id[part][:, None] != b.id[None, :])
            held[a.vec.shape[1]].add(np.arange(len(a.id))[part], scores, b, free)
        for d, best in held.items():
            q, score, ids, _ = best.found()
            if len(q):
                yield _pairs(asked[d].row[q], score, ids)

    return rows.mapInArrow(task, PAIR)


def window_negatives(rows: DataFrame, anchors, bounds, k: int) -> DataFrame:
    """(anchor, score, id): per task the first k rows of another label in each window of each anchor.
    bounds: by length, low and high ends (anchors x windows)."""
    def task(batches):
        asked, ends = received(anchors), received(bounds)
        held = {d: [Best(len(lo), k) for _ in range(lo.shape[1])] for d, (lo, _) in ends.items()}
        for scores, a, part, b in score_blocks(batches, asked):
            d = a.vec.shape[1]
            other = a.label[part][:, None] != b.label[None, :]
            for w, best in enumerate(held[d]):
                low, high = (x[part, w][:, None] for x in ends[d])
                inside = other & (scores >= low) & (scores <= high)
                some = np.flatnonzero(inside.any(1))
                best.add(some + part.start, scores[some], b, inside[some])
        for d, each in held.items():
            one = np.unique(np.concatenate([np.stack(best.found(), 1) for best in each]), axis=0)  # a row may fit several windows
            if len(one):
                yield _pairs(asked[d].row[one[:, 0]], one[:, 1], one[:, 2])

    return rows.mapInArrow(task, PAIR)


def keyed(pairs: DataFrame, negative: int) -> DataFrame:
    def task(batches):
        for b in batches:
            if b.num_rows:
                a, s, i = (b.column(c).to_numpy() for c in ("anchor", "score", "id"))
                yield pa.RecordBatch.from_arrays([b.column("anchor"), packed(a, s, negative, i)], ["anchor", "key"])

    return pairs.select("anchor", "score", "id").mapInArrow(task, "anchor long, key binary")


def emitted(keys: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The windows read off the sorted keys; anchor in the place of its id."""
    def stream(batches):
        now, seen, open_ = None, 0, []  # of the anchor at hand: positives read, windows still to fill
        for batch in batches:
            out = []
            for anchor, score, negative, i in zip(*(x.tolist() for x in unpacked(batch.column("key"))), strict=True):
                if anchor != now:
                    now, seen, open_ = anchor, 0, []
                if not negative:
                    if seen < positives:
                        low, high = windows(score, least, most)
                        open_.append([i, score, low, high, 0])
                        seen += 1
                    continue
                for w in open_:
                    if w[2] <= score <= w[3] and w[4] < negatives:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], i, w[1], score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n == 2 else pa.int64()) for n, c in enumerate(zip(*out, strict=True))],
                    [f.split()[0] for f in OUT.split(", ")])

    return keys.repartition("anchor").sortWithinPartitions("key").select("key").mapInArrow(stream, OUT)


def hard_negatives(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST, round_rows: int = ROUND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row of `anchors`
    (same columns) against all of `rows`.

    A row without id, label or vector, or with an empty vector or a null or non-finite entry, takes no part;
    an anchor meets rows of its own number of entries only. Its positives are the first rows of its label,
    those that bear its id left out; rows that repeat an id are rows of their own on both sides. Ties go to
    the smaller id. A positive below zero has an empty window, one of zero the score zero only. Scores must
    fit into 64 bits. Empty tables give an empty result; other columns are not read."""
    spark = rows.sparkSession

    def of(df):
        lab = df.withColumn(vec_col, F.when(F.col(label_col).isNotNull(), F.col(vec_col)))
        return quantised(lab, id_col, vec_col, scale, F.col(label_col).cast("long").alias("label")).select(
            F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q")

    base, asked = cut(of(rows), "negatives_rows"), cut(of(anchors), "negatives_anchors")
    kept = []
    for table_ in query_rounds(asked, round_rows):
        by_length = rows_by_length(table_)
        shown = sent(spark, by_length)  # at most about round_rows vectors
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        top = cut(first_positives(base, shown, positives).withColumn("k", F.row_number().over(first))
                  .filter(F.col("k") <= positives).drop("k"), "positives")
        found = top.toArrow()
        anchor, score = (found.column(c).to_numpy() for c in ("anchor", "score"))
        bounds = {}
        for d, a in by_length.items():
            low, high = np.ones((len(a.row), positives), np.int64), np.zeros((len(a.row), positives), np.int64)
            order = np.argsort(a.row)
            at = np.searchsorted(a.row, anchor, sorter=order)
            hit = at < len(order)
            hit[hit] = a.row[order[at[hit]]] == anchor[hit]
            at, own = order[at[hit]], score[hit]
            by = np.argsort(at, kind="stable")
            at, own = at[by], own[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            low[at, place], high[at, place] = windows(own, least, most)
            bounds[d] = low, high
        ends = sent(spark, bounds)
        kept.append(cut(keyed(top, 0).unionByName(keyed(window_negatives(base, shown, ends, negatives), 1)), "pair_keys"))
        shown.unpersist()
        ends.unpersist()
    if not kept:
        return spark.createDataFrame([], OUT)
    out = emitted(union_all(kept), positives, negatives, least, most)
    name = asked.select(F.col("row").alias("anchor_id"), "vec_id")
    return out.join(name, "anchor_id").select(F.col("vec_id").alias("anchor_id"), *[f.split()[0] for f in OUT.split(", ")[1:]])


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
 id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""


def op12_hard_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(e, e.filter("vec_id % 50 = 0"))
