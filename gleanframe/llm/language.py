"""Language of whole texts by averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte 3-grams and 4-grams (letters
only, in lower case), and a linear softmax reads the language off it. Both are
trained by stochastic gradient descent on a bounded sample; its held-back part
sets the temperature of the scores and the score below which a guess is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

UNKNOWN = "und"
# Bounds of the fit: texts a language, languages, and hash buckets.
TEXTS_PER_LANGUAGE = 600
LANGUAGES = 256
BUCKETS = 1 << 12
SIZE = 16
HELD_BACK = 0.2
ACCEPTED = 0.99


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    accept_at: float

    def probabilities(self, means: np.ndarray, weights: np.ndarray) -> np.ndarray:
        logits = (means @ weights + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _letters() -> np.ndarray:
    """Lower-case letters; every other byte is a space."""
    return np.where(K.letter_words(False), K.lower_table(), 0x20).astype(np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of rows framed by a space, and each row's first n-gram (one entry more than rows)."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    framed = np.full(len(data) + 3 * rows, 0x20, dtype=np.uint8)
    framed[np.arange(len(data)) + np.repeat(3 * np.arange(rows) + 1, lengths)] = letters[data]
    # A row of n bytes has n + 3 framed ones: n of its 4-grams and n of its 3-grams stay inside.
    starts = np.arange(len(data)) + np.repeat(3 * np.arange(rows), lengths)
    wide = framed.astype(np.uint32)
    three = wide[starts] | wide[starts + 1] << 8 | wide[starts + 2] << 16
    four = three | wide[starts + 3] << 24
    shift = np.uint32(33 - int(buckets).bit_length())
    out = np.empty(2 * len(data), dtype=np.int64)
    with np.errstate(over="ignore"):
        out[0::2] = (three ^ np.uint32(0x5BD1E995)) * np.uint32(2654435761) >> shift
        out[1::2] = (four + np.uint32(0x68E31DA4)) * np.uint32(2246822519) >> shift
    return out, 2 * offsets


def _counted(buckets: int) -> K.Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(2)):
                grams, firsts = subwords(data, offsets, letters, buckets)
                found = [np.unique(grams[a:b], return_counts=True) for a, b in zip(firsts[:-1], firsts[1:])]
                rest = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                     pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                    ["place", "lang", "grams", "counts"])

    return run


def _train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 12, batch: int = 32, rate: float = 0.3):
    """Embeddings, weights and bias; steps are scaled by each parameter's past gradients."""
    rng = np.random.default_rng(3)
    params = [rng.standard_normal((x.shape[1], SIZE)).astype(np.float32), np.zeros((SIZE, classes), np.float32),
              np.zeros(classes, np.float32)]
    past = [np.full_like(p, 1e-6) for p in params]
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            mean = x[rows] @ params[0]
            logits = mean @ params[1] + params[2]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(rows)), y[rows]] -= 1
            odds /= len(rows)
            steps = [x[rows].T @ (odds @ params[1].T), mean.T @ odds, odds.sum(axis=0)]
            for p, s, g in zip(params, past, steps):
                s += g * g
                p -= rate * g / np.sqrt(s) * (0.1 if p is params[0] else 1)
    return params


def fit(labelled: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel | None:
    """Model from ``labelled(doc_id, text, lang)``; null texts and languages are left out; none if nothing is left.

    About ``texts_per_language`` texts of each language are used, those with the
    smallest hashes of id and text, for at most ``LANGUAGES`` languages (the most
    frequent ones).
    """
    known = labelled.where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.lit(23), "doc_id", F.xxhash64("text")), F.lit(1 << 30))
    limits = {r["lang"]: int((1 << 30) * min(1.0, texts_per_language / r["count"])) for r in counts}
    chosen = F.lit(False)
    for lang, limit in limits.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("_place") < limit))
    sample = known.select(place.alias("_place"), "lang", "text").where(chosen)
    table = sample.limit(2 * texts_per_language * len(limits)).mapInArrow(
        _counted(buckets), "place long, lang string, grams array<int>, counts array<int>").toArrow()
    table = table.sort_by([("place", "ascending"), ("lang", "ascending")]).combine_chunks()
    languages = sorted(set(table.column("lang").to_pylist()))
    y = np.array([languages.index(v) for v in table.column("lang").to_pylist()], dtype=np.int64)
    x = np.zeros((len(y), buckets), dtype=np.float32)
    lists = table.column("grams").combine_chunks()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    x[owner, lists.flatten().to_numpy()] = table.column("counts").combine_chunks().flatten().to_numpy()
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    held = np.random.default_rng(9).random(len(y)) < HELD_BACK
    if held.all() or not held.any():
        held[:] = False
    embeddings, weights, bias = _train(x[~held], y[~held], len(languages))
    model = LanguageModel(languages, embeddings, weights, bias, 1.0, 0.0)
    if not held.any():
        return model
    means = x[held] @ embeddings
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 41):
        chance = LanguageModel(languages, embeddings, weights, bias, float(temperature), 0.0).probabilities(means, weights)
        best = min(best, (float(-np.log(np.maximum(chance[np.arange(len(means)), y[held]], 1e-12)).mean()), float(temperature)))
    model = LanguageModel(languages, embeddings, weights, bias, best[1], 0.0)
    chance = model.probabilities(means, weights)
    # Lowest score from which the guesses above it are right often enough.
    order = np.argsort(-chance.max(axis=1), kind="stable")
    right = (chance.argmax(axis=1) == y[held])[order]
    good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= ACCEPTED)
    accept_at = float(chance.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return LanguageModel(languages, embeddings, weights, bias, best[1], accept_at)


def _guess(model: LanguageModel, text: str, buckets: int) -> K.Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        # With few languages, each bucket's share of the logits is looked up at once.
        few = len(model.languages) < SIZE
        table = (model.embeddings @ model.weights if few else model.embeddings).T.astype(np.float64).copy()
        weights = np.eye(len(model.languages)) if few else model.weights.astype(np.float64)
        for batch in batches:
            row, lettered = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            pred, score = [], []
            for _, _, data, offsets in K.text_slices(row.field(text)):
                grams, firsts = subwords(data, offsets, letters, buckets)
                means = np.empty((len(offsets) - 1, len(table)))
                for i, column in enumerate(table):
                    sums = np.append(0, np.cumsum(column[grams]))
                    means[:, i] = (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)
                chance = model.probabilities(means, weights)
                pred += chance.argmax(axis=1).tolist()
                score += chance.max(axis=1).tolist()
            langs = [model.languages[p] if ok else UNKNOWN for p, ok in zip(pred, lettered)]
            score = [min(s, 1.0) if ok else 0.0 for s, ok in zip(score, lettered)]
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                 pa.array([s >= model.accept_at and bool(ok) for s, ok in zip(score, lettered)], pa.bool_())],
                ["row", "lang_pred", "score", "accepted"])

    return run


def identified(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred``, ``score`` and ``accepted``, one row a document.

    ``score`` is the calibrated probability of the guess; ``accepted`` is false
    where it is below the score from which guesses are right often enough. Null
    texts and texts without a letter are ``und`` with score 0, and so is all
    without a model. Whole texts are read. Column names of ``docs`` cannot
    clash, as they stay inside ``row``.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return packed.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    schema = T.StructType([
        packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType())])
    return packed.mapInArrow(_guess(model, text, len(model.embeddings)), schema)
