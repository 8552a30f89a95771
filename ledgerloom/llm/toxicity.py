"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is seen twice: as a hashed word embedding and as the mean of the embeddings
of its byte n-grams. Windows of ``SPAN`` words, one starting every ``STRIDE`` words,
run through a gated recurrent layer in both directions; attention pools the states
of a window and a linear layer scores it. A text scores as its highest window, put
on a probability scale by a logistic fit. Everything is trained in numpy on a bounded
sample of labelled rows; a label holds for a text, so after the first
pass only the window that the network itself finds most toxic teaches for a toxic text.

Null and blank texts get the score of a window without words. A doc_id with several
labels counts as toxic if one of them is. With no labelled row of both kinds every
score is the share of toxic labels, 0 without any. Rows are kept as they are, repeated
ones too; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import Words, filled, hashes, held_out, slices, subwords, words

SPAN, STRIDE = 32, 24
NGRAMS = (3, 4, 5)
WORD_ROWS, CHAR_ROWS, WIDTH, STATE = 1 << 14, 1 << 16, 8, 8


def windows(split: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of every window (one past the last code where there is no word) and the text it is from.

    Windows overlap by a quarter and cover every word; a text without words has one empty window.
    """
    counts = split.counts
    per = np.maximum(1, -(-(counts - SPAN) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = (split.starts[:-1][owner] + nth * STRIDE)[:, None] + np.arange(SPAN)
    inside = at < split.starts[1:][owner][:, None]
    codes = np.append(split.codes, 0)[np.where(inside, at, len(split.codes))]
    return np.where(inside, codes, len(split.distinct)).astype(np.int32), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Lexicon:
    """Where each distinct word reads its embeddings; the word past the last is no word."""

    word: np.ndarray
    first: np.ndarray
    chars: np.ndarray

    @classmethod
    def of(cls, distinct: pa.Array) -> Lexicon:
        if not len(distinct):
            return cls(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        owner, bucket = subwords(distinct, NGRAMS, CHAR_ROWS)
        word = (hashes(distinct) % np.uint64(WORD_ROWS)).astype(np.int64)
        return cls(word, np.searchsorted(owner, np.arange(len(distinct) + 1)), bucket)

    def take(self, picks: np.ndarray) -> Lexicon:
        sizes = (self.first[1:] - self.first[:-1])[picks]
        first = np.zeros(len(picks) + 1, np.int64)
        np.cumsum(sizes, out=first[1:])
        flat = np.repeat(self.first[:-1][picks] - first[:-1], sizes) + np.arange(first[-1])
        return Lexicon(self.word[picks], first, self.chars[flat])


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    notes: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def near_zero(*shape: int, scale: float = 0.3) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        weights = {"words": near_zero(WORD_ROWS, WIDTH, scale=0.1), "chars": near_zero(CHAR_ROWS, WIDTH, scale=0.1)}
        for way in "fb":
            weights |= {f"in_{way}": near_zero(2 * WIDTH, 3 * STATE), f"state_{way}": near_zero(STATE, 3 * STATE),
                        f"bias_{way}": np.zeros(3 * STATE, np.float32)}
        return cls(weights | {"look": near_zero(2 * STATE), "out": near_zero(2 * STATE), "base": np.zeros(1, np.float32)})

    def inputs(self, lexicon: Lexicon) -> np.ndarray:
        """The input vector of each word, and zeros for no word."""
        out = np.zeros((len(lexicon.word) + 1, 2 * WIDTH), np.float32)
        if len(lexicon.word):
            out[:-1, :WIDTH] = self.weights["words"][lexicon.word]
            sizes = np.diff(lexicon.first)[:, None]
            for k in range(WIDTH):
                out[:-1, WIDTH + k] = np.add.reduceat(self.weights["chars"][:, k][lexicon.chars], lexicon.first[:-1])
            out[:-1, WIDTH:] /= sizes
        return out

    def given(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, for either direction, units first."""
        return {way: np.ascontiguousarray((inputs @ self.weights[f"in_{way}"] + self.weights[f"bias_{way}"]).T) for way in "fb"}

    def run(self, given: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; with ``keep`` also what the backward pass needs.

        Arrays have the units first and the windows last, which keeps every operation on contiguous rows.
        """
        w, n = self.weights, len(codes)
        steps = np.ascontiguousarray(codes.T)
        there = steps != given["f"].shape[1] - 1
        full = bool(there.all())
        states = np.zeros((SPAN, 2 * STATE, n), np.float32)
        tape: dict = {"there": there, "states": states, "steps": steps}
        for way, order, side in (("f", range(SPAN), slice(0, STATE)), ("b", range(SPAN - 1, -1, -1), slice(STATE, 2 * STATE))):
            kernel = np.ascontiguousarray(w[f"state_{way}"].T)
            h = np.zeros((STATE, n), np.float32)
            for t in order:
                x = np.take(given[way], steps[t], axis=1)
                from_state = kernel @ h
                gates = x[: 2 * STATE]
                gates += from_state[: 2 * STATE]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                update, reset = gates[:STATE], gates[STATE:]
                fresh = np.tanh(x[2 * STATE :] + reset * from_state[2 * STATE :])
                if keep:
                    tape[way, t] = (h, update, reset, fresh, from_state[2 * STATE :])
                h = fresh + update * (h - fresh)
                if not full:
                    h = h * there[t]
                states[t, side] = h
        look = np.where(there, np.einsum("tkn,k->tn", states, w["look"]), -1e9)
        share = np.exp(look - look.max(axis=0)) * there
        share = (share / np.maximum(share.sum(axis=0), 1e-9)).astype(np.float32)
        pooled = np.einsum("tn,tkn->kn", share, states)
        tape |= {"share": share, "pooled": pooled}
        return w["out"] @ pooled + w["base"][0], tape

    def logits(self, texts: pa.Array, batch: int = 2048) -> np.ndarray:
        """The highest window logit of each text."""
        split = words(texts, lower=True)
        given = self.given(self.inputs(Lexicon.of(split.distinct)))
        codes, owner = windows(split)
        found = np.concatenate([self.run(given, codes[i : i + batch])[0] for i in range(0, len(codes), batch)])
        return np.maximum.reduceat(found, np.searchsorted(owner, np.arange(len(texts))))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.slope * self.logits(texts).astype(np.float64) + self.shift)

    def gradients(self, inputs: np.ndarray, lexicon: Lexicon, error: np.ndarray, tape: dict) -> dict[str, np.ndarray]:
        """Gradients for logit errors ``error``, by going back through both directions."""
        w, states, share, there, codes = self.weights, tape["states"], tape["share"], tape["there"], tape["steps"]
        out = {"base": error.sum(keepdims=True), "out": tape["pooled"] @ error}
        d_pooled = w["out"][:, None] * error
        d_share = np.einsum("tkn,kn->tn", states, d_pooled)
        d_look = share * (d_share - (share * d_share).sum(axis=0))
        out["look"] = np.einsum("tn,tkn->k", d_look, states)
        d_states = share[:, None, :] * d_pooled + d_look[:, None, :] * w["look"][:, None]
        d_inputs = np.zeros_like(inputs)
        for way, order, side in (("f", range(SPAN - 1, -1, -1), slice(0, STATE)), ("b", range(SPAN), slice(STATE, 2 * STATE))):
            kernel = w[f"state_{way}"]
            d_kernel, d_x = np.zeros_like(kernel), np.zeros((SPAN, 3 * STATE, len(error)), np.float32)
            d_h = np.zeros((STATE, len(error)), np.float32)
            for t in order:
                h, update, reset, fresh, candidate = tape[way, t]
                d_h = (d_h + d_states[t, side]) * there[t]
                d_fresh = d_h * (1 - update) * (1 - fresh * fresh)
                d_x[t, :STATE] = d_h * (h - fresh) * update * (1 - update)
                d_x[t, STATE : 2 * STATE] = d_fresh * candidate * reset * (1 - reset)
                d_x[t, 2 * STATE :] = d_fresh
                d_from = np.concatenate([d_x[t, : 2 * STATE], d_fresh * reset])
                d_kernel += h @ d_from.T
                d_h = d_h * update + kernel @ d_from
            d_given = np.stack([np.bincount(codes.ravel(), d_x[:, k].ravel(), minlength=len(inputs)) for k in range(3 * STATE)], axis=1)
            out |= {f"state_{way}": d_kernel, f"bias_{way}": d_given.sum(axis=0), f"in_{way}": inputs.T @ d_given}
            d_inputs += (d_given @ w[f"in_{way}"].T).astype(np.float32)
        out["words"], out["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
        if len(lexicon.word):
            sizes = np.diff(lexicon.first)
            each = d_inputs[:-1, WIDTH:] / sizes[:, None]
            for k in range(WIDTH):
                out["words"][:, k] = np.bincount(lexicon.word, d_inputs[:-1, k], minlength=WORD_ROWS)
                out["chars"][:, k] = np.bincount(lexicon.chars, np.repeat(each[:, k], sizes), minlength=CHAR_ROWS)
        return out


def _seen_often(rows: np.ndarray, text: np.ndarray, table: int, least: int) -> np.ndarray:
    """Which embedding rows are used by at least ``least`` texts."""
    pairs = np.unique(text.astype(np.int64) * table + rows)
    return np.bincount(pairs % table, minlength=table) >= least


def fit(texts: list[str], labels: list[int], prior: float, epochs: int = 6, batch: int = 128, rate: float = 0.01,
        least: int = 4, shrink: float = 0.5, seed: int = 5) -> Network:
    """Train on labelled texts; ``prior`` is the share of toxic texts among all labelled ones."""
    label = np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    aside = rng.random(len(texts)) < 0.2
    if min((label[aside] == k).sum() for k in (0, 1)) < 10:
        aside[:] = False
    split = words(pa.array(texts, pa.string()), lower=True)
    lexicon = Lexicon.of(split.distinct)
    codes, owner = windows(split)
    learn = np.flatnonzero(~aside[owner])
    # An embedding that few texts use would only learn those texts; it stays at zero.
    # A word counts once for each text, so pairs are made distinct before their n-grams are listed.
    picks = np.unique((split.owner * len(lexicon.word) + split.codes)[np.repeat(~aside, split.counts)])
    texts_of, picks = np.divmod(picks, max(len(lexicon.word), 1))
    used = lexicon.take(picks)
    often = {"words": _seen_often(used.word, texts_of, WORD_ROWS, least),
             "chars": _seen_often(used.chars, np.repeat(texts_of, np.diff(used.first)), CHAR_ROWS, least)}
    for name, rows in often.items():
        net.weights[name] *= rows[:, None]
    target = label[owner]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        # At first every window has the label of its text; later a toxic text teaches its highest window only.
        rows = learn
        if epoch:
            rows = learn[(target[learn] == 0) | _highest_windows(net, lexicon, codes, owner, len(texts))[learn]]
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            present, local = np.unique(codes[rows], return_inverse=True)
            present = present[present < len(lexicon.word)]
            part = lexicon.take(present)
            inputs = net.inputs(part)
            near = local.reshape(len(rows), SPAN).astype(np.int32)
            logit, tape = net.run(net.given(inputs), near, keep=True)
            error = ((_sigmoid(logit) - target[rows]) / len(rows)).astype(np.float32)
            step += 1
            pace = rate * (1 - step / (1 + epochs * -(-len(learn) // batch)))
            for name, grad in net.gradients(inputs, part, error, tape).items():
                if name in often:
                    grad = grad * often[name][:, None]
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad * grad - second[name])
                size = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                if name in often:
                    net.weights[name] *= 1 - pace * shrink
                net.weights[name] -= (pace * first[name] / (1 - 0.9**step) / size).astype(np.float32)
    judged = np.flatnonzero(aside) if aside.any() else np.arange(len(texts))
    top = net.logits(pa.array([texts[i] for i in judged], pa.string()))
    net.slope, net.shift = _logistic(top, label[judged], prior)
    return net


def _highest_windows(net: Network, lexicon: Lexicon, codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Whether a window has the highest score of its text."""
    given = net.given(net.inputs(lexicon))
    logit = np.concatenate([net.run(given, codes[i : i + 2048])[0] for i in range(0, len(codes), 2048)])
    top = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(texts)))
    return logit == top[owner]


def _logistic(x: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, classes weighted to their true shares."""
    x = x.astype(np.float64)
    n1, n0 = max(1, int((label > 0).sum())), max(1, int((label == 0).sum()))
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label > 0, prior / n1, (1 - prior) / n0)
    middle, spread = x.mean(), max(x.std(), 1e-6)
    u = (x - middle) / spread
    slope, shift = 1.0, 0.0

    def loss(a: float, c: float) -> float:
        z = a * u + c
        return float(np.sum(weight * (np.logaddexp(0, z) - goal * z)))

    for _ in range(200):
        p = _sigmoid(slope * u + shift)
        g, c = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[np.sum(c * u * u) + 1e-9, np.sum(c * u)], [np.sum(c * u), np.sum(c) + 1e-9]])
        move, size = np.linalg.solve(hess, [np.sum(g * u), np.sum(g)]), 1.0
        while size > 1e-6 and loss(slope - size * move[0], shift - size * move[1]) > loss(slope, shift):
            size /= 2
        slope, shift = slope - size * move[0], shift - size * move[1]
    slope, shift = slope / spread, shift - slope * middle / spread
    return (float(slope), float(shift)) if slope > 0 else (1.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = 1_200, chars: int = 2_500) -> tuple[DataFrame, float]:
    """At most ``rows`` labelled texts of each kind of at most ``chars`` characters, picked by a hash of the id,
    and the share of toxic ones among all labelled rows."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.select("doc_id", F.length("text").alias("size")).join(marks, "doc_id")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    usable = known.filter(F.col("size") <= chars)
    picked = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    # The sample holds 2 * rows ids at most, so it may be sent to every task.
    few = F.broadcast(picked[0].union(picked[1]).select("doc_id", "toxic"))
    return docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "toxic"), share


def fit_from(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network, or the constant score where the labels are not of both kinds."""
    sample, share = training_sample(docs, labels)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for batch in batches for r in batch.to_pylist())
        model: object = float(share)
        if len({toxic for *_, toxic in rows}) == 2:
            net = fit([text for _, text, _ in rows], [toxic for *_, toxic in rows], share)
            model = (net.weights, net.slope, net.shift)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task trains on it; the driver gets the weights only.
    found = sample.repartition(1).mapInArrow(train, "model binary").first()
    model = pickle.loads(found[0]) if found else float(share)
    if isinstance(model, float):
        return model
    net = Network.fresh(0)
    net.weights, net.slope, net.shift = model
    return net


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """All columns of ``docs`` (text among them) and its ``toxicity`` from 0 to 1."""
    schema = docs.select("*", F.lit(0.0).alias("toxicity")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = filled(batch, "text")
            found = model.scores(texts) if isinstance(model, Network) else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    model = fit_from(docs.filter(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
