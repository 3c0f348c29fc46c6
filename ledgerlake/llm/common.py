"""Helpers shared by the operators: tables, stage files, words, components."""

from __future__ import annotations

import gc
import pickle
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = 1 << 24  # bits of a set of marks, 2 MB however many ids
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN, LINK = 1_000_000, "a long, b long"  # links that a local contraction holds at a time; their schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local master without a setting."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    return (set_dir or "/tmp/checkpoints").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage to the shared folder and reads it back: lineage ends there, so a lost executor
    costs a re-read, and values drawn once (row numbers) stay what they are. Shuffle files of stages that are
    written and of no more use go now: Spark removes them when the driver happens to collect its garbage."""
    spark = df.sparkSession
    gc.collect()
    spark._jvm.System.gc()
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*stages: DataFrame) -> None:
    """Removes the files of stages that nothing will read again, also not to make good a lost executor: only
    once all that was worked out of them is written."""
    for df in stages:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _mark(col) -> tuple:
    at = F.pmod(F.xxhash64(col), F.lit(MARKS))
    return F.floor(at / 64).cast("int"), (at % 64).cast("int")


def marks(ids: DataFrame) -> DataFrame:
    """(word, bits): a bit for every id of the one column, at its hash; of bounded size, and cut."""
    word, bit = _mark(F.col(f"`{ids.columns[0]}`"))
    spots = ids.select(word.alias("word"), bit.alias("bit"))
    return cut(spots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "marks")


def marked(df: DataFrame, col, marks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that may have one of the marked ids, none of them missing, without a shuffle; with left_anti the rows that
    have none of them for sure."""
    word, bit = _mark(col)
    m = F.broadcast(marks.toDF("_word", "_bits"))
    return df.join(m, (word == F.col("_word")) & (F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0), how)


def sent(spark: SparkSession, value) -> Broadcast:
    """A broadcast of objects of this subpackage, whose classes travel along. The caller knows its bound."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    return pickle.loads(broadcast.value)


def ascii_lower(text):
    """Lower-cases A-Z only. `lower` does just that on texts of one byte a character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(col, modulus: int):
    """crc32 of the decimal text of an id, modulo; fixes folds."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


class WordNames(dict):
    """64-bit names of words, worked out once per distinct word; bounded."""

    def __missing__(self, word: bytes) -> int:
        self[word] = name = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit names."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(names: np.ndarray, k: int) -> np.ndarray:
    """64-bit names of all runs of k consecutive words."""
    n = len(names) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + names[i:i + n]
    return mixed(acc)


def _forest(batches):
    """Links (a, b) -> links (member, least member), each run of RUN links on its own. What is connected
    stays connected, and every id still occurs; an id that is only linked with itself gives (id, id)."""
    def find(root, x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def flush(root):
        pairs = [(x, find(root, x)) for x in root]
        held = {r for x, r in pairs if x != r}
        pairs = [(x, r) for x, r in pairs if x != r or x not in held]
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    root, size = {}, 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root, root.setdefault(a, a)), find(root, root.setdefault(b, b))
            if x != y:
                root[max(x, y)] = min(x, y)
        size += batch.num_rows
        if size >= RUN:
            yield flush(root)
            root, size = {}, 0
    if root:
        yield flush(root)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (id, component) for every id that occurs; components are named by one
    of their members. Links are first contracted within runs of bounded length. Each round then merges
    every node into its neighbour (or itself) that comes first: by id in even rounds, which ends stars
    about their first member at once, and by a random priority in odd ones, which shrinks long chains by
    a constant factor. Only links between different nodes go on."""
    maps, n = [], 0
    edges = cut(edges.select("a", "b").mapInArrow(_forest, LINK).distinct(), "links")
    while not n or not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("id", "to")
        by = (lambda c: F.xxhash64(c, F.lit(n))) if n % 2 else (lambda c: c)
        pri = F.struct(by(F.col("to")).alias("p"), "to")
        own = F.struct(by(F.col("id")).alias("p"), F.col("id").alias("to"))
        step = cut(both.groupBy("id").agg(F.min(pri).alias("m"))
                   .select("id", F.least("m", own)["to"].alias("parent")), f"parents{n}")
        maps.append(step)
        edges = cut(edges.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b")
                    .filter("pa <> pb").select("pa", "pb").mapInArrow(_forest, LINK).distinct(), f"links{n + 1}")
        n += 1
    out = maps[0].select("id", F.col("parent").alias("component"))
    for m in maps[1:]:
        out = out.join(m.toDF("component", "next"), "component", "left") \
            .select("id", F.coalesce("next", "component").alias("component"))
    return out


def wrapped(docs: DataFrame, **own) -> DataFrame:
    """The rows of a table as one column `row`, beside columns of our own: no name of the table can clash."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
