"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name: blocks are bucketed by a
64-bit hash, sorted by (hash, bytes) and numbered, so a name stands for bytes and not for a hash.
Adjacent names are paired, pairs are sorted and numbered again, until every document has one name.
Two documents are equal when they end on the same level with the same name; nothing can collide.

All of it is DataFrame code. Only distinct blocks are shuffled as text, after map-side merging; later
steps move integers. A block that fills a third of the table is one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ascii_lower, cut, table, union_all, wrapped

BLOCK_BYTES = 4096


def _blocks(b, size: int):
    last = F.greatest(F.floor((F.length(b) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size)))


def _bound(value, fn):
    """fn(value) with value worked out once per row."""
    return F.transform(F.array(value), fn)[0]


def block_names(data, size: int) -> DataFrame:
    """Distinct blocks as (h, name, block); block is kept only where two blocks share a hash."""
    return (data.select(F.explode(_bound(F.col("bytes"), lambda b: _blocks(b, size))).alias("block"))
            .groupBy(F.xxhash64("block").alias("h")).agg(F.array_sort(F.collect_set("block")).alias("bs"))
            .sortWithinPartitions("h")
            .select("h", (F.size("bs") > 1).alias("shared"), F.explode("bs").alias("block"))
            .select("h", F.monotonically_increasing_id().alias("name"), F.when(F.col("shared"), F.col("block")).alias("block")))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, names): rows (rid, doc_id, text_sha256), names (rid, doc_id, level, name)."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    data = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("bytes"))
    names = cut(block_names(data, block_bytes), "block_names")
    collide = not names.filter("block IS NOT NULL").isEmpty()
    kept_block = (lambda b: b) if collide else (lambda b: F.lit(None).cast("binary"))
    rows = cut(data.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        _bound(F.col("bytes"), lambda b: F.struct(
            F.sha2(b, 256).alias("sha"),
            F.transform(_blocks(b, block_bytes),
                        lambda x: F.struct(F.xxhash64(x).alias("h"), kept_block(x).alias("own"))).alias("hs"))).alias("s"))
        .select("rid", "doc_id", F.col("s.sha").alias("text_sha256"), F.col("s.hs").alias("hs")), "rows")
    seg = (rows.select("rid", "doc_id", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "e"))
           .select("rid", "doc_id", "n", "pos", "e.h", "e.own"))
    match = seg.h == names.h
    if collide:
        match = match & (names.block.isNull() | (names.block == seg.own))
    level, cur = 0, cut(seg.join(names, match).select("rid", "doc_id", "n", "pos", "name"), "level0")
    most = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    done = []
    while True:
        done.append(cur.filter("n = 1").select("rid", "doc_id", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = (cur.filter("n > 1").groupBy("rid", half.alias("pos"))
                 .agg(F.max("doc_id").alias("doc_id"), F.max(F.ceil(F.col("n") / 2).cast("int")).alias("n"),
                      F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")))
        named = (pairs.select("l", "r").distinct().sortWithinPartitions("l", "r")
                 .withColumn("name", F.monotonically_increasing_id()))
        level, most = level + 1, -(-most // 2)
        cur = cut(pairs.join(named, ["l", "r"]).select("rid", "doc_id", "n", "pos", "name"), f"level{level}")
    return rows, union_all(done)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are one group. Of equal texts the row with the largest id
    stays; of rows that repeat an id and a text, one stays. A null id is below every other id. Other
    columns of the input are not read. An empty table gives an empty result."""
    rows, names = name_documents(docs, id_col, text_col, block_bytes)
    names = cut(names, "identities")
    groups = (names.groupBy("level", "name")
              .agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")))
    out = names.join(groups, ["level", "name"]).select(
        "rid", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.rid") == F.col("rid")).alias("kept"))
    return rows.select("rid", "doc_id", "text_sha256").join(out, "rid").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all columns."""
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    stay = (exact_duplicates(docs).filter("kept")
            .select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")))
    return (wrapped(docs, id=F.col("doc_id"), sha=sha)
            .join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi")
            .dropDuplicates(["id", "sha"]).select("row.*"))


SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
FROM documents) SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


def op3_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))
