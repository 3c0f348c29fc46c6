"""Repeated passages by groups of suffixes that fit in memory, ranked at the depth of a window.

This is not the dealt method of prefix-partitioned suffix trees: groups go by the least gram anywhere inside a
window, which is no prefix of it, and suffixes are ranked at one depth, without inner nodes (see the README).

1. Short names. A run of window starts that share their least k-word gram goes by the name of that
   gram; equal windows have equal names. A name that occurs in one document only holds no repeat across
   documents, and its suffixes are done. Only names, no texts, are shuffled here.
2. Names whose runs are within `group_rows` and `group_words`: the words of the runs are brought together, and several names
   fill one memory-sized tree, built by sorting suffixes (doubling the compared depth up to the window).
   Runs of one depth-`window` prefix are the leaves of a deep node; its least document is the origin.
3. Names with more: the prefix is extended to the whole window. A group then is one deep node, for
   which only the least document matters: an aggregation, merged before the shuffle.

Words covered by a leaf that is not of the least document go.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import WordNames, cut, grams, table
from ledgerlake.llm.ngram_join import _grouped

WINDOW, GRAM = 50, 16
GROUP_ROWS, GROUP_WORDS = 20_000, 1_500_000  # runs, and words of runs, that one name may bring together
TREE_WORDS = 1_500_000
OUT_ROWS = 2000


def prefix_runs(names: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window start, number of windows) of the runs of windows with one least gram."""
    n = len(names) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 3
    least, span, width = grams(names, k), 1, window - k + 1
    while span < width:  # least of a growing stretch of grams
        step = min(span, width - span)
        least = np.minimum(least[:len(least) - step], least[step:])
        span += step
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.diff(np.r_[first, n])


def runs_of(data: DataFrame, window: int, k: int) -> DataFrame:
    def runs(batches):
        names = WordNames()
        for batch in batches:
            held = []
            for doc, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = text.as_py().split()
                if len(words) >= window:
                    h, s, m = prefix_runs(names.of(words), window, k)
                    held.append((h, np.full(len(h), doc.as_py()), np.full(len(h), row.as_py()), s, m))
            if held:
                h, d, r, s, m = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(d), pa.array(r), pa.array(s.astype(np.int32)),
                     pa.array(m.astype(np.int32))], ["h", "doc", "row", "start", "m"])

    return data.filter("doc IS NOT NULL").mapInArrow(runs, "h long, doc long, row long, start int, m int")


def _cost(t: pa.Table, window: int, group_rows: int, group_words: int) -> np.ndarray:
    """Parts of what one name may bring together, by row: more than 1 in all is too much."""
    return np.maximum(1 / group_rows, (t.column("m").to_numpy() + window - 1.0) / group_words)


def shared_runs(runs: DataFrame, window: int, group_rows: int, group_words: int) -> DataFrame:
    """Runs whose name occurs in two documents or more; wide marks names that bring too much together."""
    def cost(t):
        return _cost(t, window, group_rows, group_words)

    def keep(batches):
        for t in _whole(batches, cost):
            h, d = t.column("h").to_numpy(), t.column("doc").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            ok = d[first] != d[first + size - 1]  # sorted by document
            wide = np.add.reduceat(cost(t), first) > 1
            t = t.append_column("wide", pa.array(np.repeat(wide, size))).filter(pa.array(np.repeat(ok | wide, size)))
            yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    return (runs.repartition("h").sortWithinPartitions("h", "doc")
            .mapInArrow(keep, "h long, doc long, row long, start int, m int, wide boolean"))


def _whole(batches, cost):
    """Whole groups of h, but groups that cost more than 1 in parts that do so themselves."""
    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
        if not t.num_rows:
            continue
        h = t.column("h").to_numpy()
        start = int(np.searchsorted(h, h[-1])) if h[0] != h[-1] else 0
        if start:
            yield t.slice(0, start)
        carry = t.slice(start)
        behind = np.cumsum(cost(carry)[::-1])[::-1]  # what each row and those after it cost
        split = int(np.count_nonzero(behind > 1)) - 1  # the last place from which on the rest costs too much
        if split > 0 and behind[0] - behind[split] > 1:
            yield carry.slice(0, split)
            carry = carry.slice(split)
    if carry is not None and carry.num_rows:
        yield carry


def deep_nodes(words: list[list[bytes]], starts: list[int], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each piece, which of its window starts hang below a node at depth `window` that also has a
    leaf of a smaller document. starts: number of window starts of each piece."""
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for w in chain.from_iterable(words)), np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(length) - length
    rank, depth = flat, 1
    while depth < window:  # names of all suffixes by their first `depth` words; a piece's last ones run over
        step = min(depth, window - depth)
        n = len(rank) - step
        pair = rank[:n] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        depth += step
    m = np.asarray(starts, np.int64)
    pos = np.repeat(at - (np.cumsum(m) - m), m) + np.arange(m.sum())
    leaf, owner = rank[pos], np.repeat(docs, m)
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, leaf, owner)
    return np.split(owner > least[leaf], np.cumsum(m)[:-1])


def _intervals(flags: np.ndarray, start: int, window: int):
    """Word ranges covered by flagged window starts."""
    at = np.flatnonzero(flags)
    if len(at):
        breaks = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]], strict=True):
            yield start + int(a), start + int(b) + window


RANGES = "doc long, row long, lo int, hi int"


def _ranges(rows):
    d, r, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(a, pa.int32()),
                                       pa.array(b, pa.int32())], ["doc", "row", "lo", "hi"])


def subtree_repeats(pieces: DataFrame, window: int, tree_words: int) -> DataFrame:
    """pieces (h, doc, row, start, m, piece) -> covered ranges."""
    def build(batches):
        held, size = [], 0

        def tree(rows):
            first: dict[bytes, int] = {}
            known, owner = [], []
            which = []
            for _, doc, _, _, m, piece in rows:
                i = first.setdefault(piece, len(known))
                if i == len(known):
                    known.append((piece.split(), m))
                    owner.append(doc)
                owner[i] = min(owner[i], doc)
                which.append(i)
            flags = deep_nodes([w for w, _ in known], [m for _, m in known], np.array(owner), window)
            out = []
            for (_, doc, row, start, m, _), i in zip(rows, which, strict=True):
                own = flags[i] if doc == owner[i] else np.ones(m, bool)
                out += [(doc, row, a, b) for a, b in _intervals(own, start, window)]
            for i in range(0, len(out), 50_000):
                yield _ranges(out[i:i + 50_000])

        for t in _grouped(batches):
            rows = list(zip(*(t.column(i).to_pylist() for i in range(6)), strict=True))
            last = None
            for r in rows:
                if size >= tree_words and r[0] != last:
                    yield from tree(held)
                    held, size = [], 0
                held.append(r)
                size += r[4] + window
                last = r[0]
        if held:
            yield from tree(held)

    return (pieces.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(build, RANGES))


def repeated_ranges(data: DataFrame, window: int, gram: int, group_rows: int, group_words: int, tree_words: int) -> DataFrame:
    """(doc, row, lo, hi): words [lo, hi) that windows of smaller documents repeat."""
    shared = cut(shared_runs(runs_of(data, window, gram), window, group_rows, group_words), "shared_runs")
    per_row = shared.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "m", "h", "wide")).alias("runs"))
    rows = data.join(per_row, ["doc", "row"]).select("doc", "row", "bytes", "runs")

    def pieces(batches):
        for batch in batches:
            out = []
            for doc, row, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, row, words = doc.as_py(), row.as_py(), text.as_py().split()
                for r in runs.as_py():
                    if not r["wide"]:
                        s, m = r["start"], r["m"]
                        out.append((r["h"], doc, row, s, m, b" ".join(words[s:s + m + window - 1])))
                if len(out) >= OUT_ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        h, d, r, s, m, p = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int32()),
             pa.array(m, pa.int32()), pa.array(p, pa.binary())], ["h", "doc", "row", "start", "m", "piece"])

    def windows(batches):
        for batch in batches:
            for doc, row, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                wide = [r for r in runs.as_py() if r["wide"]]
                if wide:
                    words = text.as_py().split()
                    at = [s for r in wide for s in range(r["start"], r["start"] + r["m"])]
                    names = [hashlib.blake2b(b" ".join(words[s:s + window]), digest_size=16).digest() for s in at]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.binary()), pa.array([doc.as_py()] * n, pa.int64()),
                         pa.array([row.as_py()] * n, pa.int64()), pa.array(at, pa.int32())], ["name", "doc", "row", "start"])

    out = subtree_repeats(rows.mapInArrow(pieces, "h long, doc long, row long, start int, m int, piece binary"),
                          window, tree_words)
    if not shared.filter("wide").isEmpty():
        leaves = cut(rows.mapInArrow(windows, "name binary, doc long, row long, start int"), "wide_windows")
        least = cut(leaves.groupBy("name").agg(F.min("doc").alias("least")), "wide_nodes")
        out = out.unionByName(leaves.join(least, "name").filter("doc > least").select(
            "doc", "row", F.col("start").alias("lo"), (F.col("start") + window).alias("hi")))
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, group_rows: int = GROUP_ROWS, group_words: int = GROUP_WORDS,
                    tree_words: int = TREE_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, with with_text), a row per input row.

    Words are split at ASCII white space. A null or blank text has no words and the digest of an empty
    text. A repeat inside one document, or between rows with one id, stays. A row with a null id is
    neither cut nor an origin. Other columns are not read; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    data = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), text.alias("bytes"))
    ranges = (repeated_ranges(data, window, gram, group_rows, group_words, tree_words)
              .groupBy("doc", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))

    def apply(batches):
        for batch in batches:
            out = []
            for doc, text, ranges in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, ranges = text.as_py().split(), ranges.as_py()
                n = len(words)
                if ranges:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [r["lo"] for r in ranges], 1)
                    np.add.at(edge, [r["hi"] for r in ranges], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                kept = b" ".join(words)
                out.append((doc.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                d, n, m, sha, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()),
                     pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = data.join(ranges, ["doc", "row"], "left").select("doc", "bytes", "ranges") \
        .mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))
