"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are quantised to integers. The index is one row per shard of vectors: for every impact band and
dimension a posting segment, the places of the vectors whose component has that magnitude, with the values.
Queries come to the index in rounds of bounded size; each round is one pass over it and nothing of it moves.
In a shard the bands come in descending order of impact. Each segment is added to the scores of its own
vectors, for a chunk of queries at once. After each band the rest of a vector is bounded by the norms of what
is left of it and of the query (Cauchy-Schwarz). When few members are possible, or nothing is left, the
loop stops: every vector whose upper bound reaches the k-th largest lower bound is scored anew with exact
integers. Nothing that could be a member is left out, so the result is exact for any data whose scores fit
into 64 bits; where sums could leave the exact range of doubles, a shard is scored in integers outright."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import cut, received, sent, table, union_all
from ledgerlake.llm.ngram_join import _grouped
from ledgerlake.llm.vectors import best_pairs, exact_in_doubles, products, query_rounds, rows_by_length

K, SCALE, SHARD, ROUND, CHUNK = 5, 256, 8192, 16_384, 256
BANDS = (64, 32, 16, 8, 4, 0)  # least magnitudes; zero impacts have no posting
FEW = 16  # possible members for each place of the result at which the bands stop
INDEX = "shard int, d int, ids binary, vecs binary, ends array<binary>, slots array<binary>, impacts array<binary>"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *more) -> DataFrame:
    """(vec_id, q array<long>, more); vectors that are null, empty or hold null or non-finite parts go."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
            .filter(~bad & (F.size(v) > 0))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("q"), *more))


def posting_segments(vecs: np.ndarray):
    """For each band (ends of the dimensions' segments, slots, impacts), the largest impacts first."""
    high = np.iinfo(np.int64).max
    for low, above in zip(BANDS, (high, *BANDS[:-1]), strict=True):
        size = np.abs(vecs)
        dim, slot = np.nonzero(((size >= max(low, 1)) & (size < above)).T)
        yield np.searchsorted(dim, np.arange(vecs.shape[1]), "right"), slot.astype(np.int32), vecs[slot, dim]


def stored_index(base: DataFrame) -> DataFrame:
    """One row per shard and vector length."""
    def pack(batches):
        for t in _grouped(batches, "shard"):
            shard = t.column("shard").to_numpy()
            for s in np.unique(shard):
                part = t.filter(pa.array(shard == s)).append_column("row", pa.array(np.arange((shard == s).sum())))
                for d, rows in rows_by_length(part).items():
                    ends, slots, impacts = zip(*posting_segments(rows.vec), strict=True)
                    packed = [[[x.astype(kind).tobytes() for x in xs]] for xs, kind in ((ends, np.int64), (slots, np.int32), (impacts, np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([d], pa.int32()), pa.array([rows.id.tobytes()], pa.binary()),
                         pa.array([rows.vec.tobytes()], pa.binary()), *(pa.array(x, pa.list_(pa.binary())) for x in packed)],
                        [f.split()[0] for f in INDEX.split(", ")])

    return base.repartition("shard").sortWithinPartitions("shard").select("shard", "vec_id", "q").mapInArrow(pack, INDEX)


def possible_members(bands, vecs: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int):
    """Pairs (query, slot) that may be among the k best of a shard; all integers, scores exact in doubles."""
    other = ids[:, None] != query_ids[None, :]  # rows with the query's id take no part
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    score = np.zeros((len(ids), len(q)))
    left = np.square(vecs.astype(np.float64)).sum(1)  # of each vector, what no segment so far has brought
    norm = np.sqrt(np.square(q.astype(np.float64)).sum(1))
    weights = q.T.astype(np.float64)
    kk, keep = min(k, len(ids)), other
    for ends, slots, impacts in bands:
        at = 0
        for dim, end in enumerate(ends):
            if end > at:
                score[slots[at:end]] += impacts[at:end, None] * weights[dim][None, :]
            at = end
        np.subtract.at(left, slots, np.square(impacts.astype(np.float64)))
        slack = np.sqrt(np.maximum(left, 0))[:, None] * norm[None, :] * (1 + 1e-9)
        low = np.where(other, score - slack, -np.inf)
        least = np.partition(low, len(ids) - kk, axis=0)[len(ids) - kk]
        keep = other & (score + slack >= least[None, :])
        if keep.sum() <= FEW * kk * len(q):
            break
    slot, query = np.nonzero(keep)
    return query, slot


def search(index: DataFrame, asked, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of every shard for every query of a round."""
    def task(batches):
        queries = received(asked)
        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                if d not in queries:
                    continue
                ids, vecs = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.int64).reshape(-1, d)
                bands = [tuple(np.frombuffer(row[c][i], t) for c, t in (("ends", np.int64), ("slots", np.int32), ("impacts", np.int64)))
                         for i in range(len(BANDS))]
                a = queries[d]
                for x in range(0, len(a.id), CHUNK):
                    q, own = a.vec[x:x + CHUNK], a.id[x:x + CHUNK]
                    if exact_in_doubles(q, vecs):
                        i, j = possible_members(bands, vecs, ids, q, own, k)
                        score = np.einsum("ij,ij->i", q[i], vecs[j])
                    else:
                        i, j = np.nonzero(own[:, None] != ids[None, :])
                        score = products(q, vecs)[i, j]
                    i, score, found = best_pairs(i, score, ids[j], k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(task, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = K, scale: int = SCALE, shard_rows: int = SHARD, block_rows: int = ROUND) -> DataFrame:
    """query_id, rank, vec_id, score for each row of `queries` (same columns) against all of `vectors`.

    Ties go to the smaller id. Vectors with null or non-finite parts take no part; a query meets only
    vectors of its own number of components. Rows of `vectors` that repeat an id are candidates each, except
    for queries of that id; rows of `queries` that repeat an id share its k places. An empty table gives an
    empty result."""
    spark = vectors.sparkSession
    base = cut(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = cut(quantised(queries, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()), "queries")
    shards = max(1, -(-base.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")  # equal rows are spread as well
    index = cut(stored_index(base.withColumn("shard", shard)), "index")
    found = [cut(search(index, sent(spark, rows_by_length(t)), k), "found")  # about block_rows queries
             for t in query_rounds(asked, block_rows)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return union_all(found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.filter("vec_id % 50 = 0"))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""
