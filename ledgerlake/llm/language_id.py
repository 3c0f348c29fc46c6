"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

Each language is a distribution over character trigrams, hashed into a fixed number of buckets; counts
come from all labelled documents, added up per task and then per (language, bucket). A document's
trigrams are drawn from a mixture of the languages; EM estimates the proportions. Languages then enter
in order of their proportion as long as the penalised likelihood gains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import bucket_of, table

BUCKETS, STEPS, PENALTY, SMOOTH = 1 << 16, 12, 3.0, 0.5
LEAST_SHARE = 1 / 3
UNKNOWN = "und"


def trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)


def learn(docs: DataFrame, text_col: str, lang_col: str, chosen) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood [bucket, language]) from all chosen rows with text and language."""
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                seen[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.filter(chosen & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    got = (rows.mapInArrow(count, "lang string, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # at most BUCKETS rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    n = np.zeros((BUCKETS, len(langs)))
    if langs:
        col = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist()))
        n[got.column("bucket").to_numpy(), col] = got.column("n").to_numpy()
    n += SMOOTH
    return langs, np.log(n / n.sum(0)) if langs else n


def mixture(text: str, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of all languages, proportions of the selected ones, others zero)."""
    at = trigrams(text)
    weight = None
    if len(at) > BUCKETS:  # long texts: one row per bucket
        n = np.bincount(at, minlength=BUCKETS)
        at = np.flatnonzero(n)
        weight = n[at].astype(float)
    lp = logp[at]
    top = lp.max(1)
    p = np.exp(lp - top[:, None])
    total = float(weight.sum() if weight is not None else len(at))

    def em(cols: np.ndarray) -> tuple[np.ndarray, float]:
        q, share = p[:, cols], np.full(len(cols), 1 / len(cols))
        for _ in range(STEPS):
            r = q @ share
            new = share * (q.T @ ((weight if weight is not None else 1.0) / r)) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        like = np.log(q @ share) + top
        return share, float(like @ weight if weight is not None else like.sum())

    share, _ = em(np.arange(p.shape[1]))
    order = np.argsort(-share, kind="stable")
    best, chosen, found = -np.inf, None, None
    for s in range(1, len(order) + 1):
        cols = order[:s]
        own, like = em(cols)
        like -= PENALTY * s * np.log(total + 1)
        if like <= best:
            break
        best, chosen, found = like, cols, own
        if share[order[s:]].sum() < 0.02:
            break
    selected = np.zeros(len(share))
    selected[chosen] = found
    return share, selected


class Identifier:
    """A learned model; predict(text) gives (language, share, selected languages, their shares)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    def predict(self, text: str | None):
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, [], []
        share, selected = mixture(text, self.logp)
        at = [int(i) for i in np.argsort(-selected, kind="stable") if selected[i] > 0]
        return self.langs[at[0]], float(min(1.0, max(0.0, share[at[0]]))), [self.langs[i] for i in at], [float(selected[i]) for i in at]


def identify(docs: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, languages, shares; one row per input row.

    learn_from: condition on rows that may teach. Null texts and texts without a letter are `und` with
    score 0, as is every text when nothing teaches. The score is the share of the predicted language in
    the whole mixture. Ids are carried through, null or repeated; other columns are not read."""
    langs, logp = learn(docs, text_col, lang_col, F.lit(True) if learn_from is None else learn_from)
    model = docs.sparkSession.sparkContext.broadcast(Identifier(langs, logp))

    def run(batches):
        for batch in batches:
            got = [model.value.predict(t.as_py()) for t in batch.column(1)]
            lang, score, langs, shares = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "languages", "shares"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_identified(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of `docs` mostly in one learned language, with all columns; `und` goes. Where nothing teaches
    (no row has both text and lang), every row whose text holds a letter stays."""
    langs, logp = learn(docs, "text", "lang", F.lit(True))
    model, schema = docs.sparkSession.sparkContext.broadcast(Identifier(langs, logp)), docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            if model.value.langs:
                stay = [lang != UNKNOWN and share >= least_share for lang, share, *_ in map(model.value.predict, texts)]
            else:
                stay = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(bucket_of(F.col("doc_id"), 4), F.lit(0))
    out = identify(docs, learn_from=fold != 2)
    return out.select("doc_id", (F.coalesce(bucket_of(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"),
                      "lang_pred", "score", "languages", "shares")
