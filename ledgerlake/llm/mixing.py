"""Temperature mixing of sources to target weights.

A source's weight is its share of all tokens to a power. The power is bisected (sixteen parts at a time, each pass one
aggregation over the source totals that brings a few numbers to the driver) until the weights have a wanted
entropy, or until no source is repeated more often than allowed. The weights and a token budget say how
often each source is passed. A pass is a block: the source's documents in a pseudo-random order of their
own; whole blocks are taken entirely, the last one up to the budget. Orders and running sums go over
buckets of the order first, so a source with a third of all rows is spread over many tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import cut, table, wrapped

REPEATS, PARTS, PASSES, BUCKET_ROWS = 1.25, 16, 7, 2000


def words_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _try(totals: DataFrame, powers: list[float], top: float) -> list[tuple[float, float]]:
    """(entropy, greatest repetition at a budget of 1) at each power, in one aggregation."""
    x = F.log("tokens") - top
    row = totals.agg(*(c for i, a in enumerate(powers) for c in (
        F.sum(F.exp(x * a)).alias(f"z{i}"), F.sum(x * a * F.exp(x * a)).alias(f"s{i}"), F.max(F.exp(x * (a - 1))).alias(f"m{i}")))).first()
    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"] / math.exp(top)) for i in range(len(powers))]


def find_power(totals: DataFrame, budget: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The power in [0, 64] whose weights have the target entropy (nearest, if out of reach), or the least one
    in [0, 1] with no source beyond the repetition limit (1 if none). totals: rows with tokens > 0."""
    top = totals.agg(F.max(F.log("tokens"))).first()[0]
    if top is None:
        return 1.0

    def low_enough(power_result) -> bool:
        h, m = power_result
        return h <= entropy if entropy is not None else m * budget <= repeats

    lo, hi = 0.0, 1.0 if entropy is None else 64.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / PARTS for i in range(PARTS + 1)]
        good = [i for i, r in enumerate(_try(totals, grid, top)) if low_enough(r)]
        if not good:
            return hi
        if good[0] == 0:
            return lo
        lo, hi = grid[good[0] - 1], grid[good[0]]
    return hi


def source_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", budget: int | None = None,
                   entropy: float | None = None, repeats: float | None = None) -> DataFrame:
    """source, docs, tokens, weight, passes (budget share over tokens), power: one row per source.

    A null source is a source. Sources without tokens have weight 0. budget defaults to all tokens; with a
    repetition limit it is at most limit x tokens."""
    repeats = REPEATS if entropy is None and repeats is None else repeats
    totals = cut(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(words_of(F.col(text_col))).alias("tokens")), "sources")
    every = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(every if budget is None else budget)
    if repeats is not None:
        budget = min(budget, repeats * every)
    some = totals.filter("tokens > 0")
    power = find_power(some, budget, entropy, repeats)
    top = some.agg(F.max(F.log("tokens"))).first()[0] or 0.0
    share = F.when(F.col("tokens") > 0, F.exp((F.log("tokens") - top) * power)).otherwise(0.0)
    z = some.agg(F.sum(share)).first()[0] or 1.0
    weight = share / z
    return totals.select("source", "docs", "tokens", weight.alias("weight"),
                         F.when(F.col("tokens") > 0, weight * budget / F.col("tokens")).otherwise(0.0).alias("passes"),
                         F.lit(power).alias("power"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None,
        entropy: float | None = None, repeats: float | None = None, seed: int = 11) -> DataFrame:
    """doc_id, row (hash of the text), source, block, position, n_tokens, weight: one row per copy taken.

    block counts the passes of a source from 0, position the place (from 0) in that block's order. In the
    last block the documents whose running total stays within the rest of the budget are taken. Null text
    has no tokens. Repeated rows are taken each. Other columns are not read; no rows give no rows."""
    weights = cut(source_weights(docs, source_col, text_col, budget, entropy, repeats), "weights")
    n = weights.agg(F.sum("docs")).first()[0] or 0
    buckets = min(1 << 20, max(16, n // BUCKET_ROWS))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(source_col).alias("source"),
                           words_of(F.col(text_col)).alias("n_tokens")), "skinny")
    w = weights.filter("passes > 0").select(F.col("source").alias("_s"), "weight", "passes", "tokens")
    taken = (rows.join(w, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.floor("passes").cast("int"))))
             .withColumn("rest", F.when(F.col("block") == F.floor("passes"),
                                        F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens") + 1e-6)))
             .drop("passes", "tokens")
             .withColumn("key", F.xxhash64(F.lit(seed), "block", "doc_id", "row"))
             .withColumn("bucket", F.floor((F.col("key") / 2.0 ** 64 + 0.5) * buckets).cast("long")))
    keys = ["source", "block", "bucket"]
    sums = taken.groupBy(*keys).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("bucket").alias("_k"),
                       F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    base = cut(base, "bucket_sums")
    inner = Window.partitionBy(*keys).orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    return (taken.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("bucket") == F.col("_k")))
            .withColumn("upto", F.col("t0") + F.sum("n_tokens").over(inner))
            .withColumn("position", F.col("k0") + F.count(F.lit(1)).over(inner) - 1)
            .filter(F.col("rest").isNull() | (F.col("upto") <= F.col("rest")))
            .select("doc_id", "row", "source", "block", "position", "n_tokens", "weight"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` as often as they are taken, with all columns."""
    copies = mix(docs, **kw).groupBy("doc_id", "row").agg(F.count(F.lit(1)).cast("int").alias("_n")) \
        .select(F.col("doc_id").alias("taken_id"), F.col("row").alias("taken_text"), "_n")
    one = wrapped(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text")).dropDuplicates(["id", "text_hash"])
    return (one.join(copies, F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("text_hash") == F.col("taken_text")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy")).select("row.*"))


def op6_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("row")
