"""Operators for training data against brute force, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")
from pyspark.sql import functions as F  # noqa: E402

from ledgerlake.llm import (common, exact_dedup, language_id, mixing, ngram_join, packing, quality,  # noqa: E402
                            substring_dedup, token_counts, tokens, topk, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid long, h string, row int, name string, bytes string"
RNG = np.random.default_rng(3)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def edited(text, k, seed):
    w, r = text.split(), np.random.default_rng(seed)
    for i in r.integers(0, len(w), k):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


PASSAGE, BASE = prose(60, 900), prose(200, 901)
LINE = "All rights reserved by the author of this page and of every other page here since then"
TEXTS = ([None, "", "   \n", "A", "a", "Ä", "ä", "one two three four", "ONE two three four", "äöü ÄÖÜ", PASSAGE]
         + [prose(120, i) + " " + PASSAGE + "\n" + prose(40, 100 + i) for i in range(25)]
         + [edited(BASE, 1 + i % 9, i) for i in range(45)] + [BASE, BASE.upper(), BASE]
         + [LINE + " " + prose(12, 300 + i) for i in range(30)] + [prose(4000, 77), prose(4000, 77) + " end"]
         + ["x" * 20000, "same same " * 300, "two  blanks\t tab\n\nline \u00a0 nbsp\x1c end "])
ROWS = [(i * 3 % 1009, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], None, 1, "x", 2, "n", "b") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[20], (ROWS[21][0], "another text with a repeated id", "en", "s1", 1, 1, "x", 2, "n", "b"),
         (None, BASE, "en", "s2", 1, 1, "x", 2, "n", "b"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.LOWER))


def words(t):
    return (t or "").encode().split()


def least(ids):
    some = [i for i in ids if i is not None]
    return min(some) if some else None


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True)):
            want[(i, top, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    for size in (4096, 16):  # 16: many levels of names
        assert Counter(map(tuple, exact_dedup.exact_duplicates(docs, block_bytes=size).collect())) == want
    assert Counter(lower(r.text) for r in exact_dedup.keep_one(docs).collect()) == Counter(set(groups))
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_dedup_survives_equal_hashes(spark, docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(3)))
    assert sorted(map(str, exact_dedup.exact_duplicates(docs, block_bytes=64).collect())) == want


@pytest.mark.parametrize("small", [ngram_join.SMALL, 8])  # 8: names of many holders, all steps run
def test_ngram_join(docs, empty, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)

    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [shingles(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(ROWS):
        groups[find(i)].append(r[0])
    want = Counter((r[0], len(s), least(groups[find(i)])) for i, (r, s) in enumerate(zip(ROWS, sets, strict=True)))
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == want
    assert max(map(len, groups.values())) > 8
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("kw", [{}, {"group_rows": 2, "tree_words": 100}])
def test_substring_dedup(docs, empty, kw):
    first = {}
    for r in ROWS:
        w = words(r[1])
        for j in range(len(w) - 49):
            if r[0] is not None:
                first[tuple(w[j:j + 50])] = min(first.get(tuple(w[j:j + 50]), r[0]), r[0])
    want = Counter()
    for r in ROWS:
        w = words(r[1])
        gone = {k for j in range(len(w) - 49) if r[0] is not None and first[tuple(w[j:j + 50])] < r[0] for k in range(j, j + 50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs, **kw).collect())) == want
    assert substring_dedup.substring_dedup(empty, **kw).count() == 0


def ids_of(text):
    return tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["a  b", " a", "a ", "\n\na\n b", "a\n", "\ta b", "it's <|endoftext|> ok", "a\u2003b c", "é è\nê  ", "x\x1cy z", "1 2\n3", "\r\n a", "", " ", "\n"]


def test_word_encoder():
    enc = tokens.encoder(tokens.default_path())
    for t in [*ODD, *(x or "" for x in TEXTS)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids_of(t), t


def test_special_strings_are_ordinary_text():
    own = tokens.Tokenizer.from_file(tokens.default_path())
    own.encode_special_tokens = True  # as the README of public_tokenizers has it
    enc = tokens.encoder(tokens.default_path())
    for t in ODD + ["<|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|> y"]:
        got = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert got == own.encode(t, add_special_tokens=False).ids and 50256 not in got


@pytest.mark.parametrize("kw", [{}, {"max_docs": 3}, {"rule": "dot"}])
def test_packing(docs, empty, kw):
    got = packing.pack(docs, **kw).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows[:-1])]))
        assert sum(r.length for r in rows) <= 1024 and len(rows) <= kw.get("max_docs", 1024)
    want = Counter()
    for r in ROWS:
        ids = [*ids_of(r[1]), 2]
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    if not kw:
        room = []  # plain best fit, longest first
        for n in sorted((r.length for r in got), reverse=True):
            fit = min((x for x in room if x >= n), default=None)
            if fit is not None:
                room.remove(fit)
            room.append((1024 if fit is None else fit) - n)
        assert len(bins) <= len(room)
    assert packing.pack(empty, **kw).count() == 0


def test_best_fit_counts_every_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, 1025), 300, replace=False)}
    runs = packing.best_fit(counts, 1024, 1024, 1024 * 1024)
    for length, n in counts.items():
        mine = sorted(r for r in runs if r[0] == length)
        assert mine[0][1] == 0 and sum(r[2] * r[3] for r in mine) == n
        assert all(b[1] == a[1] + a[2] * a[3] for a, b in zip(mine, mine[1:], strict=False))
    assert len(runs) < 20_000


def test_token_counts(docs, empty):
    n = np.array([len(ids_of(r[1])) for r in ROWS])
    hist = token_counts.length_histogram(token_counts.token_lengths(docs))
    for r in hist.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.truncated_tokens) == (
            (n == k).sum(), (n >= k).sum(), n[n >= k].sum(), np.minimum(n, k).sum())
        assert r.share_le == pytest.approx((n <= k).mean())
    assert tuple(token_counts.truncated_total(hist, 37).first()) == (len(n), np.minimum(n, 37).sum())
    assert token_counts.length_quantile(hist, 0.5).first()[0] == np.sort(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.length_histogram(token_counts.token_lengths(empty)).count() == 0


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://a.Example.org/es/x?y#z", "https://example.org/en/1234", "x://org/",
        "http://b.example.org/en/2", "http://notexample.org/es/1", "http://q.com/fr/", "http://q.com/de/#a/fr/", "http://xcom/de/", "http://com/de/",
        "http://u@h.com:80/de/", "http://a..org//", "http://org?/x", "http://é.org/ü", "http://" + "a." * 200 + "org/" + "p" * 3000]


def test_url_filter(spark):
    rows = [(i, u, "<p>", "r") for i, u in enumerate(URLS)] + [(1, URLS[5], None, None), (None, URLS[6], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    want = Counter()
    for i, u, *_ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = rest.split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(str.maketrans(common.UPPER, common.LOWER)), slash + path
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        want[(i, host, path, best[1], best[2])] += 1
    assert Counter(map(tuple, url_filter.judge_urls(pages, url_filter.rules_frame(spark)).collect())) == want
    none = url_filter.rules_frame(spark).filter("host = 'none'")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(0, 0.2, (400, 8)).round(3)
    vecs[100:180] = vecs[100]
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(vecs)]
    rows += [(500, None, 0), (501, [1.0, None] * 4, 0), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0), (504, [0.0] * 8, 0), (510, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    q = {r[0]: np.floor(np.array(r[1]) * 256).astype(int) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()}
    want = []
    for i in (k for k in q if k % 50 == 0 or k == 504):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    asked = df.filter("vec_id % 50 = 0 OR vec_id = 504")
    for kw in ({}, {"shard_rows": 50, "block_rows": 3}):
        assert sorted(map(tuple, topk.top_k(df, asked, **kw).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), asked.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


def test_mixing(docs, empty):
    for kw in ({}, {"entropy": 0.9}, {"repeats": 3.0, "budget": 20000}):
        w = {r.source: r for r in mixing.source_weights(docs, **kw).collect()}
        assert sum(r.weight for r in w.values()) == pytest.approx(1)
        if "entropy" in kw:
            assert -sum(r.weight * math.log(r.weight) for r in w.values() if r.weight) == pytest.approx(0.9, abs=1e-3)
        else:
            assert max(r.passes for r in w.values()) <= kw.get("repeats", mixing.REPEATS) + 1e-6
        blocks = defaultdict(list)
        for r in mixing.mix(docs, **kw).collect():
            blocks[r.source, r.block].append(r)
        for (s, b), rows in blocks.items():
            assert sorted(r.position for r in rows) == list(range(len(rows)))
            whole = b < math.floor(w[s].passes)
            assert len(rows) == w[s].docs if whole else sum(r.n_tokens for r in rows) <= (w[s].passes - b) * w[s].tokens + 1
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_language_id(spark, empty):
    alpha = {"aa": "abcd e", "bb": "wxyz v"}
    text = lambda k, n, s: "".join(np.random.default_rng(s).choice(list(alpha[k]), n))
    rows = [(i, text(k, 300, i), k, 1) for i, k in enumerate(["aa", "bb"] * 30)]
    rows += [(90, text("aa", 200, 1) + " " + text("bb", 100, 2), None, 1), (91, None, "aa", 1), (92, "", "aa", 1), (93, "12 !?", "bb", 1),
             (94, text("bb", 70_000, 3), None, 1), (None, text("aa", 99, 4), None, 1), (90, "b", None, 1)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    by = {r.doc_id: r for r in got[:-1]}
    assert len(got) == len(rows) and all(by[i].lang_pred == r[2] for i, r in enumerate(rows[:60]))
    assert by[90].languages == ["aa", "bb"] and by[90].score == pytest.approx(2 / 3, abs=0.05)
    assert [by[i].lang_pred for i in (91, 92, 93, 94)] == ["und"] * 3 + ["bb"] and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, x int"), F.lit(False)).collect()} == {"und"}


def test_quality(spark, docs, empty):
    rows = [(i, prose(40, i) if i % 2 else prose(40, i).replace(" ", "### "), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (None, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(5, None, 1), (7000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(d, lab).collect()}
    assert len(got) == len(rows) and all(got[i].predicted == i % 2 for i in range(300, 400)) and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality.score_quality(d, lab.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, lab).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (203, 201)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = defaultdict(set)
    for r in got:
        parts[r.component].add(r.id)
    assert sorted(map(sorted, parts.values())) == [list(range(61)), [100], [200, 201, 203]]
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(docs, empty):
    import corpus_pipeline as cp
    x = docs.drop("cid", "h", "row", "name", "bytes")
    for name, stage in cp.STAGES:
        x = common.cut(stage(docs.sparkSession, x, None), "test")
        assert x.count() > 0, name
    y = empty
    for _, stage in cp.STAGES:
        y = stage(docs.sparkSession, y, None)
    assert y.count() == 0


def test_sql_is_text():
    from ledgerlake.llm import registry
    assert all(isinstance(x, str) for x in registry.SQL.values())


def plain_mix(docs, weights):
    """(doc_id, text, source, block, position) of every copy: the keys come from Spark, the rest is a loop."""
    most = max((math.floor(w.passes) for w in weights.values()), default=0)
    d = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("b"))
    parts = defaultdict(list)
    for r in d.withColumn("key", F.xxhash64(F.lit(11), "b", "doc_id", "row")).collect():
        parts[r.source, r.b].append((r.key, r.doc_id, r.text))
    out = Counter()
    for (s, b), rows in parts.items():
        w = weights[s]
        whole, total = math.floor(w.passes), 0
        if not w.passes or b > whole:
            continue
        rest = math.floor((w.passes - whole) * w.tokens + 1e-6)
        for place, (_, i, t) in enumerate(sorted(rows, key=lambda x: x[0])):
            total += len((t or "").split())
            if b < whole or total <= rest:
                out[(i, t, s, b, place)] += 1
    return out


PLAIN = [r for r in ROWS if r[1] is None or r[1].isascii() and "\x1c" not in r[1]]  # one meaning of white space


@pytest.mark.parametrize("kw", [{}, {"entropy": 0.9}, {"repeats": 3.0, "budget": 20000}])
def test_mixing_against_loop(spark, kw):
    docs = spark.createDataFrame(PLAIN, SCHEMA).repartition(5)
    want = plain_mix(docs, {r.source: r for r in mixing.source_weights(docs, **kw).collect()})
    names = {r.row: r.text for r in docs.select("text", F.xxhash64("text").alias("row")).collect()}
    got = mixing.mix(docs, **kw).collect()
    assert Counter((r.doc_id, names[r.row], r.source, r.block, r.position) for r in got) == want
    assert all(r.n_tokens == len((names[r.row] or "").split()) for r in got)


def shingle_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets, name = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]) and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    return name


def test_pipeline_stages_against_loops(spark):
    import corpus_pipeline as cp
    rows = [r[:5] for r in PLAIN]
    x = common.cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "test")
    stages = dict(cp.STAGES)

    def run(name):
        y = common.cut(stages[name](spark, x, None), "test")
        return y, list(map(tuple, y.collect()))

    model = language_id.Identifier(*language_id.learn(x, "text", "lang", F.lit(True)))
    good = []
    for r in rows:
        lang, share = model.predict(r[1])[:2]
        good += [r] if lang != "und" and share >= language_id.LEAST_SHARE else []
    x, got = run("language ID")
    assert Counter(got) == Counter(good) and len(good) > 50
    before = Counter(got)
    x, got = run("exact dedup")
    assert Counter(lower(r[1]) for r in got) == Counter({lower(r[1]) for r in before}) and not Counter(got) - before
    before, texts = Counter(got), [r[1] for r in got]
    parts = dict(zip(texts, shingle_components(texts), strict=True))
    x, got = run("n-gram Jaccard join")
    assert Counter(parts[r[1]] for r in got) == Counter(set(parts.values())) and not Counter(got) - before
    want = plain_mix(x, {r.source: r for r in mixing.source_weights(x).collect()})
    taken = Counter()
    for (i, t, s, *_), n in want.items():
        taken[i, t, s] += n
    x, got = run("source mixing")
    assert Counter((r[0], r[1], r[3]) for r in got) == taken
    want = Counter()
    for r in got:
        ids = [*ids_of(r[1]), 2]
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((r[0], k, a, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    _, got = run("best-fit packing")
    assert Counter(r[:4] for r in got) == want


def test_top_k_keeps_repeated_ids(spark):
    vecs = np.random.default_rng(8).normal(0, 0.2, (60, 4)).round(3)
    rows = [(i % 20, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(7, [2.0] * 4)] * 3 + [(0, [3.0] * 4)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows]
    want = []
    for i in (0, 7):
        best = sorted((-int(a @ b), j) for k, a in q for j, b in q if k == i and j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    for kw in ({}, {"shard_rows": 10, "block_rows": 1}):
        assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id IN (0, 7)"), **kw).collect())) == sorted(want)


def test_languages_without_a_teacher(docs):
    got = language_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert Counter(r.text for r in got) == Counter(r[1] for r in ROWS if any(map(str.isalpha, r[1] or "")))


def test_packing_within_a_cost(docs):
    most, bins = 300 * 300 + 7, defaultdict(list)
    for r in packing.pack(docs, max_cost=most).collect():
        bins[r.sequence_id].append(r.length)
    assert all(sum(n * n for n in b) <= most and sum(b) <= 1024 for b in bins.values())
    assert max(map(max, bins.values())) == 300  # longer ones are cut
    assert sum(map(sum, bins.values())) == sum(len(ids_of(r[1])) + 1 for r in ROWS)
    lengths, full = [n for b in bins.values() for n in b], max(sum(b) for b in bins.values())
    assert full < 1024 or len(bins) > -(-sum(lengths) // 1024)  # the cost binds, not the tokens alone
    with pytest.raises(ValueError):
        packing.pack(docs, max_cost=0)
