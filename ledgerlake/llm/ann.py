"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

A bounded sample gives, per vector length, a random rotation, the centres of the lists (spherical k-means)
and the number of lists to probe: the least for which the true neighbours of sampled queries lie in probed
lists at the target rate. All vectors go into the list of their nearest centre; a list is cut into shards
of bounded size. A shard holds its rotated unit vectors in column blocks. A query's distance to a row is
summed block by block; after d of D dimensions the row is abandoned when the partial squared distance
exceeds t * d/D * (1 + e/sqrt(d))^2, t being the squared distance of the k-th best so far: the test, at level
e, of the hypothesis that the whole distance is below t. What stays is scored on the original vectors.

Two passes over the lists: the nearest list of each query gives its first threshold, the others follow.
Of equal vectors only the k + 1 smallest ids are searched; no other can be among k nearest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import cut, received, sent, table
from ledgerlake.llm.vectors import best_pairs

K, SAMPLE, MOST_LISTS, TARGET = 5, 32_768, 1024, 0.97
LEVEL, BLOCK = 2.1, 16  # level of the tests; dimensions a column block
SHARD, QUERIES, ROWS = 8192, 256, 2048  # rows of a shard; queries and rows scanned at a time
CALIBRATE, ITERATIONS, CELLS = 512, 10, 4_000_000
SLACK = 1e-9  # covers the rounding of partial distances


@dataclass
class Model:
    """Of one vector length: rotation, centres (unit, in columns), number of lists to probe."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int


def unit_rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, unit vectors) in doubles. Each vector is first scaled by a power of two, which
    changes no cosine and keeps its squares in range."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v, norm, v / norm[:, None]


def trained(units: np.ndarray, lists: int, k: int, target: float, seed: int) -> Model:
    """Fits the model of one length to a sample of unit vectors."""
    n, d = units.shape
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    centres = units[rng.choice(n, min(lists, n), replace=False)]
    for _ in range(ITERATIONS):
        own = nearest_list(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    own = nearest_list(units, centres)
    needed = []
    for part in np.array_split(rng.choice(n, min(CALIBRATE, n), replace=False), 8):
        near = units[part] @ units.T
        near[np.arange(len(part)), part] = -np.inf
        some = min(k, n - 1)
        top = np.argpartition(-near, some - 1, axis=1)[:, :some] if some else np.empty((len(part), 0), int)
        at = np.argsort(np.argsort(-(units[part] @ centres.T), axis=1), axis=1)
        needed.append(np.take_along_axis(at, own[top], 1).ravel() + 1)
    needed = np.concatenate(needed)
    probes = int(np.quantile(needed, target, method="higher")) if len(needed) else 1
    return Model(rotation, centres.T.copy(), probes)


def nearest_list(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(p @ centres.T).argmax(1) for p in np.array_split(units, len(units) // 4096 + 1)])


def by_length(batch):
    """(d, places, vectors column) for each vector length in a batch."""
    vec = batch.column("vec")
    size = np.diff(vec.offsets.to_numpy())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, vec.take(pa.array(at))


def in_lists(rows: DataFrame, models) -> DataFrame:
    """(d, list, vec_id, vec): each row with the list of its nearest centre."""
    def task(batches):
        known = received(models)
        for batch in batches:
            for d, at, vec in by_length(batch):
                m = known.get(d)
                own = (unit_rows(vec, d)[2] @ m.centres).argmax(1) if m else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), d), pa.int32()), pa.array(own, pa.int32()), batch.column("vec_id").take(pa.array(at)), vec],
                    ["d", "list", "vec_id", "vec"])

    return rows.mapInArrow(task, f"d int, list int, vec_id long, vec {rows.schema['vec'].dataType.simpleString()}")


def probed(asked: DataFrame, models, first: bool) -> DataFrame:
    """(d, list, row, vec_id, vec, t) for the nearest list of each query, or for the others it probes."""
    def task(batches):
        known = received(models)
        for batch in batches:
            for d, at, vec in by_length(batch):
                m = known.get(d)
                if not m and not first:
                    continue
                if m:
                    order = np.argsort(-(unit_rows(vec, d)[2] @ m.centres), axis=1, kind="stable")
                    order = order[:, :1] if first else order[:, 1:m.probes]
                else:
                    order = np.zeros((len(at), 1), np.int64)
                each = pa.array(np.repeat(np.arange(len(at)), order.shape[1]))
                own = batch.take(pa.array(at)).take(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(each), d), pa.int32()), pa.array(order.ravel(), pa.int32()), *(own.column(c) for c in ("row", "vec_id", "vec", "t"))],
                    ["d", "list", "row", "vec_id", "vec", "t"])

    return asked.select("row", "vec_id", "vec", "t").mapInArrow(
        task, f"d int, list int, row long, vec_id long, vec {asked.schema['vec'].dataType.simpleString()}, t double")


def pair_sums(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, of) -> np.ndarray:
    """Row sums of of(a[i], b[j]), in pieces of bounded size."""
    step = max(1, CELLS // max(1, a.shape[1]))
    return np.concatenate([of(a[i[x:x + step]], b[j[x:x + step]]) for x in range(0, len(i), step)] or [np.empty(0)])


def scanned(rows, queries, t: np.ndarray, d: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test abandons. rows, queries: column blocks of rotated unit vectors; t: squared
    distance per query that a row may not exceed."""
    partial, seen, at = 0.0, 0, None
    for x, q in zip(rows, queries, strict=True):
        seen += x.shape[1]
        bound = t * (seen / d * (1 + level / np.sqrt(seen)) ** 2 if seen < d else 1) + SLACK
        if at is None:
            partial = partial + (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
            stays = partial <= bound[:, None]
            if seen == d or stays.mean() < 0.25:  # few are left: from here on pair by pair
                at = np.nonzero(stays)
                partial = partial[at]
        else:
            partial = partial + pair_sums(q, at[0], x, at[1], lambda a, b: np.square(a - b).sum(1))
            stays = partial <= bound[at[0]]
            at, partial = (at[0][stays], at[1][stays]), partial[stays]
    return at


def scan(index: DataFrame, probes: DataFrame, shards: DataFrame, models, k: int, level: float) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of every shard for every query sent to it. A partition is
    read once, shard after shard: its rows first, then its queries as they come."""
    vec = index.schema["vec"].dataType.simpleString()
    keys = ["d", "list", "shard"]
    lists = F.broadcast(shards)  # one row a list, at most MOST_LISTS for each vector length of the sample
    none = F.lit(None)
    one = index.join(lists, ["d", "list"]).select(
        "d", "list", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"),
        none.cast("long").alias("row"), "vec_id", "vec", none.cast("double").alias("t"))
    two = probes.join(lists, ["d", "list"]).select(
        "d", "list", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard"), F.lit(1).alias("kind"),
        "row", "vec_id", "vec", "t")

    def answers(held, batch, d, model):
        cut_at = range(0, d, BLOCK)
        rot = model.rotation if model else np.eye(d)
        if "x" not in held:
            parts = [unit_rows(c, d) for c in held["vec"]]
            v, norm, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
            held["x"] = v, norm, [np.ascontiguousarray((unit @ rot)[:, c:c + BLOCK]) for c in cut_at], np.concatenate(held["id"])
        v, norm, blocks, ids = held["x"]
        for s in range(0, batch.num_rows, QUERIES):
            b = batch.slice(s, QUERIES)
            w, wnorm, unit = unit_rows(b.column("vec"), d)
            own = b.column("vec_id").to_numpy()
            t = b.column("t").fill_null(np.inf).to_numpy().copy()
            turned = unit @ rot
            turned = [np.ascontiguousarray(turned[:, c:c + BLOCK]) for c in cut_at]
            q, score, found = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            start = 0
            while start < len(ids):  # a short first run gives a threshold
                stop = min(len(ids), start + (ROWS if start else QUERIES))
                i, j = scanned([x[start:stop] for x in blocks], turned, t, d, level)
                j = j + start
                other = own[i] != ids[j]
                i, j = i[other], j[other]
                dot = pair_sums(w, i, v, j, lambda a, b: np.einsum("ij,ij->i", a, b))
                q, score, found = best_pairs(np.r_[q, i], np.r_[score, dot / (wnorm[i] * norm[j])], np.r_[found, ids[j]], k)
                full = np.flatnonzero(np.bincount(q, minlength=len(t)) == k)
                t[full] = np.minimum(t[full], 2 - 2 * score[np.searchsorted(q, full, "right") - 1])
                start = stop
            if len(q):
                row = b.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row[q]), pa.array(own[q]), pa.array(found), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    def task(batches):
        known, now, held = received(models), None, {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (*keys, "kind")], 1)
            edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for x, y in zip(edges, edges[1:], strict=False):
                if y > x:
                    *at, kind = key[x].tolist()
                    part = batch.slice(x, y - x)
                    if at != now:
                        now, held = at, {"vec": [], "id": []}
                    if kind == 0:
                        held["vec"].append(part.column("vec"))
                        held["id"].append(part.column("vec_id").to_numpy())
                    elif held["vec"]:
                        yield from answers(held, part, at[0], known.get(at[0]))

    return (one.unionByName(two).repartition(*keys).sortWithinPartitions(*keys, "kind")
            .select(*keys, "kind", "row", "vec_id", F.col("vec").cast(vec).alias("vec"), "t")
            .mapInArrow(task, "row long, query_id long, vec_id long, score double"))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): rows with an id and a finite vector other than zero."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            sample: int = SAMPLE, most_lists: int = MOST_LISTS, target: float = TARGET, level: float = LEVEL,
            shard_rows: int = SHARD, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score (cosine, in doubles on the original vectors) of the k nearest found, for
    each row of `queries` (same columns) against all of `vectors`.

    Ties go to the smaller id. A row without id or vector, or whose vector is zero, empty or holds a null or
    non-finite component, takes no part; a query meets only vectors of its own length and of another id.
    Rows that repeat id and vector are one candidate; repeated queries are answered each. The model is fitted
    on about `sample` rows chosen by hash; a length that the sample misses is one list, scanned whole. Empty
    tables give an empty result; other columns are not read."""
    spark = vectors.sparkSession
    same = Window.partitionBy("h", "vec").orderBy("vec_id")
    base = cut(usable(vectors, id_col, vec_col).distinct().withColumn("h", F.xxhash64("vec"))
               .withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy"), "ann_rows")
    asked = cut(usable(queries, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
                .withColumn("t", F.lit(None).cast("double")), "ann_queries")
    sizes = {r["d"]: r["count"] for r in base.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count")).limit(64).collect()}
    n = sum(sizes.values())
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = 1 << 30
    chosen = base.filter(F.pmod(F.xxhash64("h", "vec_id"), F.lit(fine)) < -(-fine * min(sample, n) // n)).select("vec").toArrow()
    models = {}
    for d, _, vec in by_length(chosen.combine_chunks().to_batches()[0]) if chosen.num_rows else ():
        lists = int(np.clip(round(np.sqrt(sizes.get(d, 1)) / 2), 1, most_lists))
        models[d] = trained(unit_rows(vec, d)[2], lists, k, target, seed)
    fitted = sent(spark, models)  # at most most_lists centres for each length of the sample
    index = cut(in_lists(base, fitted), "ann_lists")
    shards = cut(index.groupBy("d", "list").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")), "ann_shards")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def top(found):
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    first = cut(top(scan(index, probed(asked, fitted, True), shards, fitted, k, level)), "ann_first")
    reach = first.filter(F.col("rank") == k).select("row", (2 - 2 * F.col("score")).alias("t"))
    rest = scan(index, probed(asked.drop("t").join(reach, "row", "left"), fitted, False), shards, fitted, k, level)
    return top(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.filter("vec_id % 50 = 0"))
