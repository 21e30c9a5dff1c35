"""Language identification by nearest clustered centroid.

A text is the bag of its letter trigrams (lower-cased; a non-letter is a blank; a trigram has a letter in the middle),
hashed into DIM buckets, weighted by TF-IDF and normalised. Each language has K centroids, fitted by spherical k-means on
a sample of at most SAMPLE labelled documents (those with the smallest hash of their id, one row for each id, so the sample
depends neither on partitioning nor on repeated rows); centroids that mostly draw texts labelled otherwise are dropped. A
text takes the language of the centroid of largest cosine; that cosine is the score.

Rejection is by distance. A text of fewer than FULL distinct trigrams can't have a large cosine, so cosines are compared
after a division by the root of that share. The sample is cut into FOLDS; centroids of the others judge each fold, which gives
every language the cosines of documents that its centroids have not seen. Its limit is MARGIN times their PERCENTILE-th
percentile (that of all languages together for a language of fewer than FEW such documents): under nearly every text of the
language, and over texts of other languages and of random letters. Texts under the limit of their language, and texts without
a letter (und), are flagged `rejected`.

Cases: null text or one without letters: und, score 0, rejected; ties go to the language first in alphabetical order, then
to its first centroid; repeated rows give repeated rows; no labelled document at all: every text is und and rejected; an
empty table gives an empty table; only doc_id, text and lang are read; labelled rows of one id that differ count once (the
smallest by hash of the text, then by language); rows without an id are never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import chunks, code_points, letters, remainder, table, tidy

DIM = 4096
SAMPLE = 1500
K = 4
FOLDS, MARGIN, PERCENTILE, FEW = 3, 0.6, 0.5, 20
FULL = 100


def count_grams(texts: list[str], dim: int = DIM):
    """A vector of trigram counts for each text, and whether it has a letter; a generator, so that few are held at once."""
    for start, end in chunks(texts, 1_000_000):
        cps, at = code_points(texts[start:end])
        c = np.concatenate((np.zeros(1, np.uint32), letters()[cps]))
        mid = c[1:-1] > 0
        h = c[:-2] * np.uint32(0x9E3779B1)
        h ^= c[1:-1] * np.uint32(0x85EBCA77)
        h = (h << np.uint32(7)) | (h >> np.uint32(25))
        h += c[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(12)
        h &= np.uint32(dim - 1)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            # grams whose middle lies in the text, which has a blank before it and one after it
            lo, hi = a, b - 1
            yield np.bincount(h[lo:hi][mid[lo:hi]], minlength=dim), bool(mid[lo:hi].any())


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = np.sqrt((v * v).sum(-1, keepdims=True))
    return v / np.where(n > 0, n, 1)


class LanguageModel:
    """languages (one for each centroid), centroids (unit rows), idf, limits (one for each centroid)."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, limits: np.ndarray):
        self.languages, self.centroids, self.idf, self.limits = languages, centroids, idf, limits

    def predict(self, texts: list[str]):
        for counts, has in count_grams(texts, len(self.idf)):
            if not has or not len(self.centroids):
                yield "und", 0.0, True
                continue
            cos = self.centroids @ _weigh(counts, self.idf)
            best = int(cos.argmax())
            score = float(min(1.0, max(0.0, cos[best])))
            yield self.languages[best], score, score < self.limits[best] * fullness(np.count_nonzero(counts))


def fullness(grams):
    return np.minimum(1.0, np.sqrt(np.asarray(grams) / FULL))


def kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from those chosen before."""
    chosen = [0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        sums = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def centroids_of(v: np.ndarray, langs: np.ndarray, k: int) -> tuple[list[str], np.ndarray]:
    """Languages and centroids; those that mostly draw texts of other languages (they were made of mislabelled ones) left out."""
    names, parts = [], []
    for lang in sorted(set(langs)):
        c = kmeans(v[langs == lang], k)
        names += [lang] * len(c)
        parts.append(c)
    c = np.concatenate(parts) if parts else np.zeros((0, v.shape[1]))
    if len(c):
        own = (v @ c.T).argmax(1)
        pure = np.array([np.mean(langs[own == i] == names[i]) >= 0.5 if (own == i).any() else False for i in range(len(names))])
        c, names = c[pure], [n for n, p in zip(names, pure, strict=True) if p]
    return names, c


def limits_of(v: np.ndarray, grams: np.ndarray, langs: np.ndarray, names: list[str], k: int) -> np.ndarray:
    """The rejection limit of each of the named centroids, from cosines of folds that centroids have not seen."""
    told: dict[str, list[float]] = {}
    for fold in range(FOLDS):
        out = np.arange(len(v)) % FOLDS == fold
        own_names, c = centroids_of(v[~out], langs[~out], k)
        if len(c):
            cos = v[out] @ c.T
            for i, x in zip(cos.argmax(1), cos.max(1) / fullness(grams[out]), strict=True):
                told.setdefault(own_names[i], []).append(float(x))
    every = [x for xs in told.values() for x in xs]
    limit = lambda xs: MARGIN * float(np.percentile(xs, PERCENTILE)) if xs else 1.0
    return np.array([limit(told[n] if len(told.get(n, ())) >= FEW else every) for n in names])


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = K, dim: int = DIM) -> LanguageModel:
    """docs: the labelled rows to learn from. Counts are made on the executors; at most `sample` vectors reach the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    key = F.struct(F.xxhash64("text").alias("h"), "lang")
    chosen = labelled.groupBy("doc_id").agg(F.min(key).alias("_key")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = labelled.join(F.broadcast(chosen), "doc_id").where(key == F.col("_key")).select("lang", "text", "doc_id")

    def run(batches):
        for batch in batches:
            langs, ids, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for lang, i, (counts, has) in zip(langs, ids, count_grams(batch.column(1).to_pylist(), dim), strict=True):
                if has:
                    at = np.flatnonzero(counts)
                    out.append((str(i), lang, at.astype("<u2").tobytes(), np.minimum(counts[at], 65535).astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.binary()))], ["id", "lang", "at", "n"])

    once = rows.mapInArrow(run, "id string, lang string, at binary, n binary").groupBy("id").agg(F.min("lang").alias("lang"), F.min("at").alias("at"), F.min("n").alias("n"))
    got = sorted(once.select("lang", "at", "n").collect())
    counts = np.zeros((len(got), dim), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u2")
    # an order that has nothing to do with the texts, for the folds
    counts, langs = (x[np.random.default_rng(0).permutation(len(got))] for x in (counts, np.array([r["lang"] for r in got], object)))
    idf = np.log((1 + len(got)) / (1 + (counts > 0).sum(0))) + 1
    v = _weigh(counts, idf)
    names, centroids = centroids_of(v, langs, k)
    return LanguageModel(names, centroids, idf, limits_of(v, (counts > 0).sum(1), langs, names, k))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each whole text. The model (a few hundred kB) goes with the tasks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = list(held.value.predict([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def filtered(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with their own columns, that aren't rejected; any extra columns and types stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [not rejected for _, _, rejected in held.value.predict([t or "" for t in batch.column(at).to_pylist()])]
            yield batch.filter(pa.array(keep, pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def learn_from(docs: DataFrame) -> DataFrame:
    """The rows that models may learn from."""
    return docs.where(remainder("doc_id", 4) != 2)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(learn_from(docs)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
