"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words and of their byte n-grams, each
hashed into a fixed number of rows; a linear layer and a softmax give the language.
Embeddings and layer are trained together by stochastic gradient descent in numpy.
Scores are made honest by a temperature and a rejection limit, both fitted on
training rows that the descent has not seen.

Null or blank texts and texts without a letter are ``und`` with score 0. With no
training row every text is. Rows are kept as they are, repeated ones too; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import filled, held_out, slices, subwords, words

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    #: One row of class weights per bucket: embeddings times the linear layer.
    table: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...] = (2, 3, 4)
    temperature: float = 1.0
    limit: float = 0.0
    notes: dict = field(default_factory=dict)

    def logits(self, texts: pa.Array) -> np.ndarray:
        split = words(texts, lower=True)
        owner, bucket = subwords(split.distinct, self.sizes, len(self.table)) if len(split.distinct) else (np.zeros(0, int),) * 2
        size = np.bincount(owner, minlength=len(split.distinct))
        out = np.zeros((len(texts), len(self.languages)))
        if len(bucket):
            first = np.zeros(len(size), np.int64)
            np.cumsum(size[:-1], out=first[1:])
            total = np.bincount(split.owner, size[split.codes], minlength=len(texts))
            for k in range(len(self.languages)):
                by_word = np.add.reduceat(self.table[:, k][bucket], first)
                out[:, k] = np.bincount(split.owner, by_word[split.codes], minlength=len(texts))
            out /= np.maximum(total, 1)[:, None]
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scaled = self.logits(texts) / self.temperature
        scaled -= scaled.max(axis=1, keepdims=True)
        shares = np.exp(scaled)
        shares /= shares.sum(axis=1, keepdims=True)
        return shares.argmax(axis=1), shares.max(axis=1)


def _features(texts: list[str], sizes: tuple[int, ...], buckets: int, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its buckets) for each run of ``window`` words."""
    split = words(pa.array(texts, pa.string()), lower=True)
    owner, bucket = subwords(split.distinct, sizes, buckets)
    first = np.searchsorted(owner, np.arange(len(split.distinct) + 1))
    for i in range(len(texts)):
        codes = split.codes[split.starts[i] : split.starts[i + 1]]
        for at in range(0, len(codes), window):
            yield i, np.concatenate([bucket[first[c] : first[c + 1]] for c in codes[at : at + window]])


def fit(texts: list[str], langs: list[str], buckets: int = 1 << 15, width: int = 12, window: int = 40,
        epochs: int = 3, rate: float = 2.0, precision: float = 0.99, seed: int = 3) -> LanguageModel | None:
    """Train on labelled texts; a fifth of them is kept aside to calibrate."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    aside = rng.random(len(texts)) < 0.2 if len(texts) >= 50 else np.zeros(len(texts), bool)
    sizes = (2, 3, 4)
    seen = label[~aside]
    kept = [t for t, a in zip(texts, aside, strict=True) if not a]
    rows = [(seen[i], f) for i, f in _features(kept, sizes, buckets, window)]
    vectors = rng.normal(0, 0.1, (buckets, width))
    layer = np.zeros((width, len(names)))
    bias = np.zeros(len(names))
    steps = max(1, epochs * -(-len(rows) // 32))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            pace = rate * (1 - step / steps)
            step += 1
            picked = [rows[i] for i in order[at : at + 32]]
            flat = np.concatenate([f for _, f in picked])
            counts = np.array([len(f) for _, f in picked])
            starts = np.cumsum(counts) - counts
            mean = np.add.reduceat(vectors[flat], starts) / counts[:, None]
            logit = mean @ layer + bias
            share = np.exp(logit - logit.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(picked)), [y for y, _ in picked]] -= 1
            share /= len(picked)
            back = share @ layer.T / counts[:, None]
            layer -= pace * (mean.T @ share)
            bias -= pace * 0.1 * share.sum(axis=0)
            np.subtract.at(vectors, flat, pace * len(picked) * np.repeat(back, counts, axis=0))
    model = LanguageModel(names, (vectors @ layer).astype(np.float32), bias, sizes)
    if aside.any():
        _calibrate(model, [t for t, a in zip(texts, aside, strict=True) if a], label[aside], precision)
    return model


def _calibrate(model: LanguageModel, texts: list[str], label: np.ndarray, precision: float) -> None:
    """The temperature of least log loss, and the lowest score from which ``precision`` holds."""
    logit = model.logits(pa.array(texts, pa.string()))

    def loss(t: float) -> float:
        z = logit / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]))

    model.temperature = min((2.0 ** (k / 4) for k in range(-16, 17)), key=loss)
    pick, score = model.predict(pa.array(texts, pa.string()))
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(pick[order] == label[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    model.limit = float(score[order[good[-1]]]) if len(good) else 1.0
    model.notes = {"aside": len(texts), "right": float(np.mean(pick == label))}


def training_sample(docs: DataFrame, rows: int = 1_200, chars: int = 4_000) -> DataFrame:
    """At most ``rows`` labelled texts (times their labels) of at most ``chars`` characters, picked by a hash of the text."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.filter(F.length("text") <= chars).select("text", "lang", F.xxhash64("text").alias("hash"))
    # Only hashes are compared to pick; the picked ones are ``rows`` at most, so they may be sent to every task.
    picked = hashed.select("hash").distinct().orderBy("hash").limit(rows)
    return hashed.join(F.broadcast(picked), "hash").select("text", "lang").distinct()


def detect(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with lang_pred, score and whether the score passes the limit."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, accepted boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = filled(batch, "text")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            pick, share = model.predict(texts) if model else (np.zeros(len(texts), int), np.zeros(len(texts)))
            known = lettered & bool(model)
            names = np.array([*(model.languages if model else []), UNDETERMINED], object)
            share = np.where(known, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(known, pick, len(names) - 1)], pa.string()),
                 pa.array(share), pa.array(known & (share >= (model.limit if model else 1.0)))],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(score, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out("doc_id", 5, 0))
    rows = sorted(training_sample(docs.filter(~F.col("held_out"))).collect())
    return detect(docs, fit([r.text for r in rows], [r.lang for r in rows]))
