"""Clashing column names, long hosts, folders and sizes that follow the data."""

import os

import pytest

import numpy as np
from pyspark.sql import functions as F

pytest.importorskip("ledgerlake.llm")
from ledgerlake.llm import common, exact_dedup, mixing, ngram_join, packing, substring_dedup, url_filter  # noqa: E402


def test_stages_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, _id long, _r long, _sha string, row string, id string, sha int, `a.b` int, taken_id int, stay_id int"
    rows = [(i, f"text number {i // 2} with words that go on", "en", "s", i + 5, i + 7, "x", "r", "i", 1, 2, 3, 4) for i in range(8)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (exact_dedup.keep_one, ngram_join.keep_one_of_each, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = {tuple(r) for r in out.collect()}
        assert kept and kept <= set(rows)
    assert {r.doc_id for r in exact_dedup.keep_one(docs).collect()} == {1, 3, 5, 7}


def test_long_hosts_are_linear(spark):
    host = ".".join(["a"] * 100_000) + ".org"
    rows = [(1, f"http://{host}/x"), (2, f"http://x.{host}.com/de/"), (3, "http://org/"), (4, "http://.org/"), (5, "http://example.org./es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert got == {1: ("org/", "allow"), 2: ("com/de/", "block"), 3: ("org/", "allow"), 4: ("org/", "allow"), 5: (None, "allow")}


@pytest.mark.parametrize("kw", [{}, {"group_words": 400}, {"group_words": 60}])
def test_one_long_repeated_line_in_many_documents(spark, kw):
    """Groups are bounded in words: a line that fills documents is one run of any length."""
    line = "all rights reserved by the author "
    texts = [line * (5 + 7 * i) + f"end of {i} " + " ".join(f"own{i}x{j}" for j in range(30)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        want[i] = len({k for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < i for k in range(j, j + 50)})
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, **kw).collect()}
    assert got == want and max(want.values()) > 1000


class Session:
    def __init__(self, master, folder=None):
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: folder)})()
        self.sparkContext = type("S", (), {"master": master, "getConf": staticmethod(lambda: conf)})()
        self.conf = conf


def test_shared_folder_needs_a_setting_off_local():
    assert common.shared_folder(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(Session("local[2]"))
    with pytest.raises(ValueError):
        common.shared_folder(Session("spark://host:7077"))


def test_parts_of_a_length_follow_its_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(99, "x")], "doc_id long, text string")
    pieces = packing.pack(docs, max_tokens=16).collect()
    assert len(pieces) == 41
    seen = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    for (s, o, n), (s2, o2, _) in zip(seen, seen[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0)


def test_marks_miss_no_id(spark, monkeypatch):
    """A bounded set of marks lets through what is marked, NULL and hash neighbours included, and drops most others."""
    ids, some = spark.range(3000).selectExpr("id AS doc_id"), [(i * 7,) for i in range(100)] + [(None,)]
    for bits in (1 << 24, 64):
        monkeypatch.setattr(common, "MARKS", bits)
        m = common.marks(spark.createDataFrame(some, "doc_id long"))
        every = ids.unionByName(spark.createDataFrame([(None,)], "doc_id long"))
        kept = {r[0] for r in common.marked(every, F.col("doc_id"), m).collect()}
        rest = {r[0] for r in common.marked(every, F.col("doc_id"), m, "left_anti").collect()}
        assert {i for i, in some} <= kept and not kept & rest and len(kept) + len(rest) == 3001
        assert bits == 64 or kept == {i for i, in some}


def test_names_of_one_set_are_not_shuffled(spark, monkeypatch):
    """Names that two sets have stored are marked, hardly any others; names of many leading parts are counted by prefix."""
    rng = np.random.default_rng(5)
    own, common_ = rng.integers(0, 2**63, (60, 40), np.uint64) * np.uint64(2), rng.integers(0, 2**63, 8, np.uint64)
    rows = []
    for i, x in enumerate(own):
        stored = np.sort(np.r_[x, common_[i % 8], common_[:1]][:42]) if i < 40 else np.sort(x)
        rows.append((i, 105, len(stored), np.unique(stored).view(np.int64).tolist()))
    parts = spark.createDataFrame(rows, "cid long, n int, rare int, stored array<long>").repartition(6)
    parts = parts.withColumn("rare", F.size("stored"))
    for names in (1 << 20, 100):  # one range, many ranges
        monkeypatch.setattr(ngram_join, "RANGE_NAMES", names)
        counts, spots = ngram_join.name_counts(parts, 20)
        assert spots.hold(common_).all() and spots.hold(own.ravel()).mean() < 0.02
        want = np.unique(np.concatenate([np.array(r[3]).view(np.uint64)[:85] for r in rows]), return_counts=True)
        assert {(r["h"], r["count"]) for r in counts.collect()} == {(int(h) >> 24, int(c)) for h, c in zip(*want, strict=True) if c >= 17}


def test_texts_that_meet_no_other_stay_where_they_are(spark, monkeypatch):
    """Fragments are cut of texts in candidate pairs only; of the copies of a set one has them."""
    rows = list(enumerate([" ".join(f"w{i}x{j}" for j in range(200)) for i in range(30)]))
    rows += [(30 + i, t + " end") for i, t in rows[:3]] + [(33, rows[7][1])]
    seen = {}
    monkeypatch.setattr(ngram_join, "cut", lambda df, name, cut=common.cut: seen.setdefault(name, cut(df, name)))
    monkeypatch.setattr(ngram_join, "discard", lambda *stages: None)
    got = dict(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "component_id").collect())
    assert got == {i: i - 30 if 30 <= i < 33 else 7 if i == 33 else i for i, _ in rows}
    assert sorted(r["doc_id"] for r in seen["chosen"].collect()) == [0, 1, 2, 30, 31, 32]


def test_one_of_each_group_stays_without_moving_the_others(spark):
    base = " ".join(f"v{j}" for j in range(60))
    rows = [(5, base), (3, base + " x"), (9, "other words here"), (None, None), (9, base), (3, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, ngram_join.keep_one_of_each(docs).collect())) == sorted(
        f"Row(doc_id={i!r}, text={t!r})" for i, t in rows if i != 5)


def test_pipeline_keeps_the_texts_of_one_stage(spark, monkeypatch):
    """Texts that a stage has read go once its own are written."""
    import corpus_pipeline

    written = []
    monkeypatch.setattr(common, "cut", lambda df, name, cut=common.cut: written.append(cut(df, name)) or written[-1])
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    names = [n.replace(" ", "_") for n, _ in corpus_pipeline.STAGES[:-1]]
    left = [df.stage_path for df in written if any(f"/{n}-" in df.stage_path for n in names) and os.path.isdir(df.stage_path)]
    assert rows > 0 and len(left) == 1 and f"/{names[-1]}-" in left[0]
