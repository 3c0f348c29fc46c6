"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word shingles; shingles are 64-bit names. All names stand in one global
order of three tiers: names of few documents, then names that many leading parts hold, then names that
already single runs of rows hold often; by hash within a tier. The middle tier comes from a count over the
leading parts of a first order; each set keeps twice its leading part, so that no text is read again. The same count tells which
names no other set can have there; these are never shuffled.

1. Documents with equal sets are one class; one class needs one look. Classes are named by a digest, so that
   what is stored of a set needs no shuffle to get its class.
2. Candidates share a name in the leading part of their ordered sets (similar sets must), subject to
   size. A name held by few classes gives all its pairs, and the number of names that a pair shares
   must leave room for the overlap it needs. A name held by many gives pairs
   with its first class, then with the next fifteen, then with all others, and each time only between
   classes that no verified link has joined so far. Every pair is either tested or already connected.
   The last step goes in blocks and makes no rows for pairs: what lies outside the largest component
   of a cluster of names is dealt out in blocks, and each member passes each block once.
3. The order is cut into fragments. The leading parts are the first: names missing there on either
   side already rule out most pairs, exactly. For the others the overlap is counted in each fragment of
   the whole sets separately and summed over the fragments; the sum decides the link.
4. Links are closed to components.

Which shingles count as frequent only steers the order; any choice gives the same links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import (WordNames, connected_components, cut, discard, grams, marked, marks, received, sent, table, union_all,
                                   wrapped)

SHINGLE, PERCENT = 5, 80
FRAGMENTS = 4
SMALL = 128  # a name held by so many classes gives all its pairs at once
LOCAL_ROWS, LOCAL_COUNT = 4_000_000, 3
HOT_LEAST, HOT_MOST = 17, 4_000_000
TURNS = ((0, 1), (1, 16))  # first holders of a name that meet its other holders
BLOCK = 128
PREFIX, SPOTS, RANGE_NAMES = 24, 28, 1 << 20  # low bits left out of a prefix; bits of the table of shared names, at most, as a power; names a range


def shingle_set(data: bytes | None, k: int, names: WordNames) -> np.ndarray:
    """Sorted names of the distinct shingles of a text; fewer words than k are one shingle."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(grams(names.of(words), min(k, len(words))))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch, column: int = 1):
    for x in batch.column(column):
        yield x.as_py()


def first_pass(data: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, key) of the sets of all documents, and beside them (h, c) of shingles seen often within runs
    of rows, and their number (total); one kind has nulls in the columns of the other."""
    fields = "doc_id long, n int, key binary, h long, c long, total long"
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.split()[0]], k) if f.split()[0] in columns else pa.nulls(size, k)
                                           for f, k in zip(fields.split(", "), kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    def count(batches):
        names, held, size, total = WordNames(), [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return rows(h=h[c >= LOCAL_COUNT].view(np.int64), c=c[c >= LOCAL_COUNT])

        for batch in batches:
            members = []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                s = shingle_set(text, k, names)
                members.append((doc, len(s), set_key(s)))
                held.append(s)
                size, total = size + len(s), total + len(s)
                if size >= LOCAL_ROWS:
                    yield flush()
                    held, size = [], 0
            if members:
                doc, n, key = zip(*members, strict=True)
                yield rows(doc_id=doc, n=n, key=key)
        if size:
            yield flush()
        yield rows(total=[total])

    return cut(data.mapInArrow(count, fields), "first_pass")


def frequent_names(first: DataFrame) -> tuple[np.ndarray, int]:
    """Shingles seen often, by adding up what is frequent within runs of rows. The result is bounded:
    a name must make up one in HOT_MOST of all shingles."""
    total = first.agg(F.sum("total")).first()[0] or 0
    counts = first.filter("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c"))
    hot = counts.filter(F.col("c") >= max(HOT_LEAST, -(-total // HOT_MOST))).select("h")
    return np.sort(hot.toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)), total


def part_size(n: int, percent: int) -> int:
    """Of so many of its first names a similar set must share one."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def stored_part(s: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Twice the leading part, names of `hot` last; and how many names of the set are not in `hot`."""
    n = rare = len(s)
    if n and len(hot):
        late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        rare = n - int(late.sum())
        s = np.concatenate([s[~late], s[late]])
    return s[:2 * part_size(n, percent)], rare


def held_in(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of x occur in sorted names."""
    return names[np.minimum(np.searchsorted(names, x), len(names) - 1)] == x if len(names) else np.zeros(len(x), bool)


def prefix(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(PREFIX)


def leading_part(stored: np.ndarray, rare: int, mid: np.ndarray, size: int) -> tuple[np.ndarray, int, int] | None:
    """The first `size` names of the order with the tiers rare, mid (given by prefixes), hot, and how many of
    the first two there are; None where the stored names do not tell."""
    few, late = stored[:rare], stored[rare:]
    in_mid = held_in(prefix(few), mid)
    first = few[~in_mid]
    if len(first) >= size:
        return first[:size], size, 0
    if rare > len(stored):
        return None
    part = np.concatenate([first, few[in_mid], late])[:size]
    return part, len(first), min(int(in_mid.sum()), len(part) - len(first))


def packed(x: np.ndarray, base: np.uint64) -> bytes:
    """Sorted numbers from `base` on as their differences, byte by byte, without the bytes that all of them leave zero."""
    d = np.diff(x, prepend=base).astype("<u8")
    width = max(1, -(-int(d.max(initial=0)).bit_length() // 8))
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, base: np.uint64) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :data[0]] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64) + base


class Spots:
    """A bit for each run of prefixes that start alike."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(64 - PREFIX - bits), table

    def hold(self, names: np.ndarray) -> np.ndarray:
        at = prefix(names) >> self.shift
        return self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def name_counts(parts: DataFrame, percent: int) -> tuple[DataFrame, Spots]:
    """((h, count) of prefixes that many leading parts hold, marks of all that two stored parts hold).

    Prefixes go to ranges, packed; a range counts its own. Names of one class only need not be shuffled later."""
    lead = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    size = parts.agg(F.sum(2 * lead)).first()[0] or 0
    bits = min(SPOTS, max(16, int(2 * size).bit_length()))
    split = min(bits - 3, max(0, int(size // RANGE_NAMES).bit_length()))  # ranges, as a power
    low, at = np.uint64(64 - PREFIX - split), np.uint64(64 - PREFIX - bits)

    def pack(batches):
        held, size = [[], []], 0

        def flush():
            first, more = (np.sort(np.concatenate(x)) for x in held)
            edges = np.arange((1 << split) + 1, dtype=np.uint64) << low
            x, y = np.searchsorted(first, edges), np.searchsorted(more, edges)
            for r in range(0, 1 << split, 256):
                some = [i for i in range(r, min(r + 256, 1 << split)) if x[i] < x[i + 1] or y[i] < y[i + 1]]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(first[x[i]:x[i + 1]], edges[i]) for i in some], pa.binary()),
                                                      pa.array([packed(more[y[i]:y[i + 1]], edges[i]) for i in some], pa.binary())], ["r", "lead", "more"])

        for batch in batches:
            for n, rare, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = stored.values.to_numpy().view(np.uint64)
                end = min(rare, part_size(n, percent))
                held[0].append(prefix(x[:end]))
                held[1].append(prefix(x[end:]))
                size += len(x)
                if size >= RANGE_NAMES:
                    yield from flush()
                    held, size = [[], []], 0
        if size:
            yield from flush()

    def count(batches):
        for t in _grouped(batches, "r"):
            key = t.column("r").to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            for a, b in zip(edge, edge[1:], strict=False):
                first, more = (np.concatenate([unpacked(x.as_py(), np.uint64(key[a]) << low) for x in t.column(c).slice(a, b - a)]) for c in ("lead", "more"))
                h, n = np.unique(first, return_counts=True)
                every, twice = np.unique(np.concatenate([first, more]), return_counts=True)
                spots = np.unique(every[twice > 1] >> at) - (np.uint64(key[a]) << np.uint64(bits - split))
                table = np.zeros(1 << (bits - split - 3), np.uint8)
                np.bitwise_or.at(table, spots >> np.uint64(3), np.uint8(1) << (spots & np.uint64(7)).astype(np.uint8))
                h, n = h[n >= HOT_LEAST], n[n >= HOT_LEAST]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())],
                                                 ["h", "count", "r", "spots"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key[a]], pa.int32()), pa.array([table.tobytes()], pa.binary())],
                                                 ["h", "count", "r", "spots"])

    found = cut(parts.select("n", "rare", "stored").mapInArrow(pack, "r int, lead binary, more binary").repartition("r")
                .sortWithinPartitions("r").mapInArrow(count, "h long, count long, r int, spots binary"), "name_counts")
    table = np.zeros((1 << split, 1 << (bits - split - 3)), np.uint8)  # 32 MB at most
    for r in found.filter("r IS NOT NULL").select("r", "spots").collect():
        table[r["r"]] = np.frombuffer(r["spots"], np.uint8)
    return found.filter("h IS NOT NULL").select("h", "count"), Spots(bits, table.ravel())


def middle_names(parts: DataFrame, counts: DataFrame, percent: int) -> np.ndarray:
    """Prefixes of names that many leading parts hold, fewer than HOT_MOST. Names that a set cannot do without, because
    what it has stored behind them is too short, are left out; that brings no other set into this state."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    mid = counts.filter(F.col("count") >= max(HOT_LEAST, -(-total // HOT_MOST))).select("h")
    mid = np.sort(mid.toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))
    if not len(mid):
        return mid
    spark = parts.sparkSession
    mid_at = spark.sparkContext.broadcast(mid)

    def needed(batches):
        for batch in batches:
            out = []
            for n, rare, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = stored.values.to_numpy().view(np.uint64)
                if leading_part(x, rare, mid_at.value, part_size(n, percent)) is None:
                    few = prefix(x[:rare])
                    out.append(few[held_in(few, mid_at.value)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], ["h"])

    keep = parts.select("n", "rare", "stored").mapInArrow(needed, "h long").distinct().toArrow().column("h").to_numpy()
    return np.setdiff1d(mid, keep.astype(np.int64).view(np.uint64))


def leading_parts(parts: DataFrame, mid, percent: int) -> DataFrame:
    """(cid, n, rare, mid, part): the leading parts under the final order; the first `rare` names are of the
    first tier, the next `mid` of the second."""
    def order(batches):
        for batch in batches:
            rows = []
            for n, rare, stored in zip(batch.column("n").to_pylist(), batch.column("rare").to_pylist(), batch.column("stored"), strict=True):
                part, few, some = leading_part(stored.values.to_numpy().view(np.uint64), rare, mid.value, part_size(n, percent))
                rows.append((few, some, part.view(np.int64)))
            if rows:
                few, some, part = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid"), batch.column("n"), pa.array(few, pa.int32()), pa.array(some, pa.int32()), pa.array(part, pa.list_(pa.int64()))],
                    ["cid", "n", "rare", "mid", "part"])

    return parts.select("cid", "n", "rare", "stored").mapInArrow(order, "cid long, n int, rare int, mid int, part array<long>")


def _grouped(batches, column: str = "h"):
    """Rows sorted by a column -> lists of record batches, each list a whole number of groups."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        key = t.column(column).to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield t.slice(0, last)
        carry = t.slice(last).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry


def shared_names(parts: DataFrame, spots) -> DataFrame:
    """Rows (h, cid, n, pos) of the names in leading parts held by at least two classes, with the number g of holders.
    `spots`: broadcast marks; names that are not marked have one holder and stay where they are."""
    def tokens(batches):
        marked_ = received(spots)
        for batch in batches:
            part = batch.column("part")
            h, size = part.flatten().to_numpy(), np.diff(part.offsets.to_numpy())
            some = np.flatnonzero(marked_.hold(h.view(np.uint64)))
            at = np.repeat(np.arange(len(size)), size)[some]
            pos = some - np.repeat(np.cumsum(size) - size, size)[some]
            cid, n = (batch.column(c).to_numpy()[at] for c in ("cid", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(cid), pa.array(n), pa.array(pos.astype(np.int32))], ["h", "cid", "n", "pos"])

    def keep(batches):
        for t in _grouped(batches):
            h, cid = t.column("h").to_numpy(), t.column("cid").to_numpy()
            t = t.filter(pa.array(np.r_[True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1])]))  # copies of a set
            h = t.column("h").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            g = np.repeat(np.diff(np.r_[first, len(h)]), np.diff(np.r_[first, len(h)]))
            t = t.append_column("g", pa.array(g.astype(np.int32))).filter(pa.array(g > 1))
            yield from t.combine_chunks().to_batches()

    return (parts.select("cid", "n", "part").mapInArrow(tokens, "h long, cid long, n int, pos int")
            .repartition("h").sortWithinPartitions("h", "cid")
            .mapInArrow(keep, "h long, cid long, n int, pos int, g int"))


def candidate_pairs(shared: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of one turn. shared: h, cid, n, pos, g, comp.

    A similar pair misses at most n - alpha names on either side, alpha being the overlap it needs, so the
    set whose leading part ends first has at least (part - (n - alpha)) of its names in the other part. Where
    all names of either part have few holders, every shared one has been counted."""
    lo, hi = TURNS[turn]

    def pairs(batches):
        for t in _grouped(batches):
            h, cid, n, pos, comp = (t.column(c).to_numpy() for c in ("h", "cid", "n", "pos", "comp"))
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            rank = np.arange(len(h)) - np.repeat(first, size)
            end = np.repeat(first + size, size)
            small = np.repeat(size <= SMALL, size)
            # row i meets the rows behind it in its group
            lead = np.flatnonzero((small & (turn == 0)) | (~small & (rank >= lo) & (rank < hi)))
            for part in np.array_split(lead, max(1, int((end[lead] - lead).sum() // 2_000_000))):
                m = end[part] - part - 1
                i = np.repeat(part, m)
                j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + i + 1
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (comp[i] != comp[j]) & (100 * low >= percent * high)
                # a name of many holders says nothing on how many names the pair shares
                ok &= small[i] | ((100 + percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j]))
                i, j = i[ok], j[ok]
                if len(i):
                    key, at, c = np.unique(np.stack([cid[i], cid[j]], 1), axis=0, return_index=True, return_counts=True)
                    i, j = i[at], j[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (key[:, 0], key[:, 1], n[i], n[j], c)], ["a", "b", "na", "nb", "c"])

    found = (shared.repartition("h").sortWithinPartitions("h", "cid")
             .mapInArrow(pairs, "a long, b long, na int, nb int, c long")
             .groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")))
    if turn:
        return found.select("a", "b")
    alpha = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    part = {x: F.col(x) - F.ceil(percent * F.col(x) / 100) + 1 for x in ("na", "nb")}
    least = F.least(*(part[x] - (F.col(x) - alpha) for x in ("na", "nb")))
    wide = cut(shared.filter(F.col("g") > SMALL).select("cid").distinct(), "wide")
    wa, wb = (wide.select(F.col("cid").alias(x), F.lit(True).alias(f"w{x}")) for x in "ab")
    return (found.join(wa, "a", "left").join(wb, "b", "left")
            .filter((F.col("wa") & F.col("wb")) | (F.col("c") >= least)).select("a", "b"))


def known_whole(x: np.ndarray, cuts: tuple[int, int], y: np.ndarray, cuts_y: tuple[int, int]):
    """Tier by tier, the names of two leading parts up to the nearer of their ends: so far both sets are known."""
    tiers = [(x[:cuts[0]], y[:cuts_y[0]]), (x[cuts[0]:cuts[1]], y[cuts_y[0]:cuts_y[1]]), (x[cuts[1]:], y[cuts_y[1]:])]
    last = [max(i for i in range(3) if len(tiers[i][side])) for side in (0, 1)]
    stop = min(last)
    end = min(tiers[stop][side][-1] for side in (0, 1) if last[side] == stop)
    for v, w in tiers[:stop]:
        yield v, w
    yield tuple(z[:np.searchsorted(z, end, "right")] for z in tiers[stop])


def first_fragment(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Drops pairs that differ too much in their leading parts. Up to the nearer end of the two parts
    both sets are known whole, so what differs there differs for good. Parts of no pair stay where they are."""
    def test(batches):
        for batch in batches:
            a, b, na, nb, ra, rb, ma, mb = (batch.column(i).to_numpy() for i in range(8))
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(8), batch.column(9), strict=True)):
                x, y = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                differ = sum(len(v) + len(w) - 2 * len(np.intersect1d(v, w, assume_unique=True))
                             for v, w in known_whole(x, (ra[i], ra[i] + ma[i]), y, (rb[i], rb[i] + mb[i])))
                total = na[i] + nb[i]
                ok[i] = differ <= total - 2 * -(-percent * total // (100 + percent))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    near = marked(parts, F.col("cid"), marks(pairs.select(F.explode(F.array("a", "b"))))).dropDuplicates(["cid"])
    x, y = (near.select(F.col("cid").alias(i), F.col("n").alias(f"n{i}"), F.col("rare").alias(f"r{i}"),
                         F.col("mid").alias(f"m{i}"), F.col("part").alias(f"p{i}")) for i in "ab")
    return (pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb", "ma", "mb", "pa", "pb")
            .mapInArrow(test, "a long, b long"))


def fragments_of(data: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, f, names): the sets of the wanted classes, cut by the leading bits of the names. Texts of other classes
    stay where they are."""
    def cut_sets(batches):
        names, bits = WordNames(), np.uint64(64 - FRAGMENTS.bit_length() + 1)
        for batch in batches:
            out = []
            for text, key, cid in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                s = shingle_set(text, k, names)
                if set_key(s) == key:
                    edge = np.searchsorted(s >> bits, np.arange(FRAGMENTS + 1).astype(np.uint64))
                    out += [(cid, f, s[x:y].view(np.int64)) for f, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if y > x]
            for i in range(0, len(out), 4000):
                c, f, s = zip(*out[i:i + 4000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(s, pa.list_(pa.int64()))], ["cid", "f", "names"])

    chosen = cut(classes.join(wanted, "cid").select("doc_id", "key", "cid"), "chosen")
    return (marked(data, F.col("doc_id"), marks(chosen.select("doc_id"))).join(chosen.hint("merge"), data.doc_id.eqNullSafe(chosen.doc_id)).select("bytes", "key", "cid")
            .mapInArrow(cut_sets, "cid long, f int, names array<long>")
            .groupBy("cid", "f").agg(F.first("names").alias("names")))


def links(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap, summed over the fragments, is large enough. Fragments of no pair stay where they are."""
    segments = marked(segments, F.col("cid"), marks(pairs.select(F.explode(F.array("a", "b")))))
    each = pairs.withColumn("f", F.explode(F.array(*(F.lit(i) for i in range(FRAGMENTS)))))
    a = segments.select(F.col("cid").alias("a"), "f", F.col("names").alias("x"))
    b = segments.select(F.col("cid").alias("b"), "f", F.col("names").alias("y"))
    overlap = (each.join(a, ["a", "f"]).join(b, ["b", "f"])
               .select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"))
               .groupBy("a", "b").agg(F.sum("c").alias("c")))
    na, nb = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    return (overlap.join(na, "a").join(nb, "b")
            .filter(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
            .select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard")))


def rest_in_blocks(many: DataFrame, label: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, jaccard) between classes of one cluster (classes that large names connect) and of
    different components; links that an earlier one of the same block makes needless are left out."""
    first = many.groupBy("h").agg(F.min("cid").alias("a"))
    cluster = connected_components(many.join(first, "h").select("a", F.col("cid").alias("b")))
    node = cut(cluster.toDF("cid", "cluster").join(label.toDF("cid", "comp"), "cid", "left")
               .withColumn("comp", F.coalesce("comp", "cid")), "cluster_members")
    main = (node.groupBy("cluster", "comp").count().groupBy("cluster")
            .agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"),
                 F.sum("count").alias("held"), F.max("count").alias("most")).filter("comps > 1")
            .select("cluster", "main", F.ceil((F.col("held") - F.col("most")) / BLOCK).cast("int").alias("blocks")))
    needed = cut(node.join(main, "cluster").join(sizes, "cid"), "cluster_needs")
    sets = marked(segments, F.col("cid"), marks(needed.select("cid"))).groupBy("cid").agg(F.array_sort(F.flatten(F.collect_list("names"))).alias("names"))
    full = cut(needed.join(sets, "cid"), "cluster_sets")
    cols = ["cluster", "block", "role", "cid", "comp", "n", "names"]
    lead = full.filter("comp <> main").withColumn("role", F.lit(0)) \
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).select(cols)
    pass_by = full.withColumn("role", F.lit(1)) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cols)

    def test(batches):
        at, root, comp, names, owner, n = None, {}, [], None, None, None

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        held: list = []
        for batch in batches:
            out = []
            for cl, block, role, cid, own, size, s in zip(*(batch.column(i) for i in range(7)), strict=True):
                key, cid, own, size = (cl.as_py(), block.as_py()), cid.as_py(), own.as_py(), size.as_py()
                s = s.values.to_numpy()
                if key != at:
                    at, root, held, names = key, {}, [], None
                if role.as_py() == 0:
                    held.append((cid, own, size, s))
                    continue
                if names is None:
                    ids, comp, n = [x[0] for x in held], [x[1] for x in held], np.array([x[2] for x in held])
                    names = np.concatenate([x[3] for x in held]) if held else np.empty(0, np.int64)
                    order = np.argsort(names, kind="stable")
                    owner = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])[order] if held else None
                    names = names[order]
                if not held:
                    continue
                lo, hi = np.searchsorted(names, s, "left"), np.searchsorted(names, s, "right")
                m = hi - lo
                hit = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
                c = np.bincount(owner[hit], minlength=len(held))
                for i in np.flatnonzero(100 * c >= percent * (n + size - c)):
                    x, y = find(comp[i]), find(own)
                    if x != y:
                        root[x] = y
                        out.append((ids[i], cid, float(c[i] / (n[i] + size - c[i]))))
            if out:
                a, b, j = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j)], ["a", "b", "jaccard"])

    return (lead.unionByName(pass_by).repartition("cluster", "block")
            .sortWithinPartitions("cluster", "block", "role", "cid").mapInArrow(test, "a long, b long, jaccard double"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, class_sizes, links).

    members: doc_id, key, n_shingles, cid (class of equal sets; null for an empty set), one row per
    input row. class_sizes: cid, n. links: a, b, jaccard between classes; pairs within a class, and
    pairs between classes that other links join already, are not listed.

    Null and blank texts have the empty set and no links. Equal sets are linked at any size. Rows that
    repeat an id are separate rows. Only the id and the text are read, whatever other columns there are."""
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"))
    first = first_pass(data, k)
    hot, _ = frequent_names(first)
    hot_at = spark.sparkContext.broadcast(hot)  # at most HOT_MOST names
    kept = first.filter("key IS NOT NULL").select("doc_id", "n", "key")
    groups = cut(kept.filter("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("doc_id")), "groups")
    salt = 0  # 64 bits of the digest name a class, of another digest if two would have one name
    while not groups.groupBy(F.xxhash64("key", F.lit(salt))).count().filter("count > 1").isEmpty():
        salt += 1
    cid = F.xxhash64("key", F.lit(salt)).alias("cid")
    classes = groups.select("key", "n", "doc_id", cid)

    def sets(batches):
        names, seen = WordNames(), set()
        for batch in batches:
            rows = []
            for text in _texts(batch, 0):
                s = shingle_set(text, k, names)
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) > 400_000:
                    seen.clear()
                seen.add(key)
                stored, rare = stored_part(s, hot_at.value, percent)
                rows.append((len(s), key, stored.view(np.int64), rare))
            if rows:
                n, key, p, rare = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(p, pa.list_(pa.int64())), pa.array(rare, pa.int32())],
                    ["n", "key", "stored", "rare"])

    # a class may have several equal rows here and in `parts`, where documents lie far from each other
    leaders = marked(data, F.col("doc_id"), marks(groups.select("doc_id"))).select("bytes")
    known = cut(leaders.mapInArrow(sets, "n int, key binary, stored array<long>, rare int").select(cid, "n", "rare", "stored"), "stored_parts")
    counts, spots = name_counts(known, percent)
    mid_at = spark.sparkContext.broadcast(middle_names(known, counts, percent))  # at most HOT_MOST names
    parts = cut(leading_parts(known, mid_at, percent), "parts")
    discard(known)
    shared = cut(shared_names(parts, sent(spark, spots)), "shared")
    sizes = classes.select("cid", "n")
    found, segments = [], None
    most = shared.agg(F.max("g")).first()[0] or 0
    label = classes.select(F.col("cid").alias("id"), F.col("cid").alias("component"))
    many = shared.filter(F.col("g") > SMALL)
    for turn in range(len(TURNS)):
        if turn and most <= SMALL:
            break
        rows = shared.withColumn("comp", F.col("cid")) if turn == 0 else \
            many.join(label.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        pairs = cut(first_fragment(cut(candidate_pairs(rows, turn, percent), f"candidates{turn}"), parts, percent), f"pairs{turn}")
        if turn == 0:
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(many.select("cid")).distinct()
            segments = cut(fragments_of(data, classes, wanted, k), "segments")
        if not pairs.isEmpty():
            new = cut(links(pairs, segments, sizes, percent), f"verified{turn}")
            if not new.isEmpty():
                found.append(new)
                label = cut(connected_components(union_all(found).select("a", "b")), f"components{turn}")
    if most > SMALL:
        rest = cut(rest_in_blocks(many, label, segments, sizes, percent), "rest")
        if not rest.isEmpty():
            found.append(rest)
            label = cut(connected_components(union_all(found).select("a", "b")), "components")
    out = union_all(found) if found else spark.createDataFrame([], "a long, b long, jaccard double")
    discard(parts, shared, *([segments] if segments is not None else []))
    members = kept.join(classes.select("key", "cid"), "key", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "cid")
    return members, label.join(classes, label.id == classes.cid, "right").select(
        "cid", "n", "doc_id", F.coalesce("component", "cid").alias("component")), out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), one row per input row."""
    members, classes, _ = ngram_jaccard_join(docs, id_col, text_col, k, percent)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = cut(classes.join(least, "component").select("cid", "least"), "component_ids")
    return members.join(named, "cid", "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose id names their component: one document of each group stays. Rows that may have to go
    meet the ids that stay; the others are let through."""
    named = cut(near_duplicates(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")), "stay")
    goes, rows = marks(named.filter("NOT stays").select("doc_id")), wrapped(docs, id=F.col("doc_id"))
    unsure = marked(rows, F.col("id"), goes).join(named.filter("stays"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return marked(rows, F.col("id"), goes, "left_anti").unionByName(unsure).select("row.*")


def op10_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
