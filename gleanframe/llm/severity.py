"""Toxicity grades by cumulative-link ordinal regression on hashed words and word beginnings.

One weight vector serves all thresholds: P(grade > k) = s(score - cut_k) with
ordered cuts. It is fitted on a bounded, hash-chosen sample of labelled rows and
then applied to every text where it lies.
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

# Bounds of the fit: labelled rows of a grade, grades, and features in the model.
ROWS_PER_GRADE = 1500
GRADES = 16
FEATURES = 1024
# Distinct features a text brings to the fit, those with the smallest hashes: a text of any length sends 64 KB at most.
TEXT_FEATURES = 8192
# Besides whole words, their first so many bytes: inflected forms share them.
BEGINNINGS = (4, 5, 6, 7, 8)
# A feature is used if enough sampled rows have it and its share differs by this many standard errors.
LEAST_ROWS = 4
ERRORS = 4.0
HELD_OUT = 0.2
# Parts of the labelled texts of which one is kept from the fit to measure it.
PARTS = 5
# Rows that share so many of the smallest hashes of their features that are in few rows count as copies of one text.
SKETCH, SHARED, RARE = 8, 5, 0.02


@dataclass(frozen=True)
class SeverityModel:
    """Sorted feature hashes, a weight each, ordered cuts, and the chance above grade 0 from which a text is rejected."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    reject_at: float

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each score."""
        if len(self.cuts) == 0:
            return np.zeros((len(scores), 0))
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.cuts, -40, 40)))


def features_of(data: np.ndarray, offsets: np.ndarray, hasher: K.Hasher, table: np.ndarray, fold: np.ndarray,
                maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the row of each, of all words or of those whose low bits ``maybe`` marks."""
    starts, ends, firsts = K.word_bounds(data, offsets, table)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    values, hashes, rows = hasher.bytes[fold[data]], [], []
    sums = hasher.sums(values)
    for size in (None, *BEGINNINGS):
        some = slice(None) if size is None else ends - starts > size
        first = starts[some]
        found = hasher.spans(sums, first, ends[some] if size is None else first + size) ^ np.uint64(size or 0)
        own = owner[some]
        if maybe is not None:
            keep = maybe[(found & np.uint64(0xFFFF)).astype(np.int64)]
            found, own = found[keep], own[keep]
        hashes.append(found)
        rows.append(own)
    return np.concatenate(hashes), np.concatenate(rows)


def _feature_sets(most: int) -> K.Kernel:
    """Distinct feature hashes of each text, the ``most`` smallest; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(False), K.lower_table()
        for batch in batches:
            for first, last, data, offsets in K.text_slices(batch.column(2)):
                hashes, rows = features_of(data, offsets, hasher, table, fold)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(len(offsets)))
                sets = [np.unique(hashes[order[a:b]])[:most] for a, b in zip(cuts[:-1], cuts[1:])]
                rest = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1),
                     K.list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64())],
                    ["doc_id", "grade", "words"])

    return run


def _selected(grade: np.ndarray, owner: np.ndarray, word: np.ndarray, features: int) -> np.ndarray:
    """Words whose share of rows differs most between grade 0 and the others."""
    known, at = np.unique(word, return_inverse=True)
    bad = grade > 0
    with_bad = np.bincount(at, bad[owner], len(known))
    with_any = np.bincount(at, minlength=len(known))
    share = with_any / len(grade)
    n_bad, n_good = max(bad.sum(), 1), max((~bad).sum(), 1)
    gap = with_bad / n_bad - (with_any - with_bad) / n_good
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_bad + 1 / n_good))
    fit = np.flatnonzero((with_any >= LEAST_ROWS) & (np.abs(gap) >= ERRORS * error))
    return np.sort(known[fit[np.argsort(-np.abs(gap[fit]) / error[fit], kind="stable")[:features]]])


def _distinct_rows(sets: list[np.ndarray]) -> list[int]:
    """Rows that are no near copy of an earlier one, by the smallest hashes they share of features that few rows have."""
    known, at, rows_with = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.split(rows_with[at] <= max(2, RARE * len(sets)), np.cumsum([len(s) for s in sets])[:-1])
    kept, holders = [], {}
    for i, (own, few) in enumerate(zip(sets, rare)):
        sketch = own[few][:SKETCH].tolist()
        met: dict[int, int] = {}
        for value in sketch:
            for other in holders.get(value, ()):
                met[other] = met.get(other, 0) + 1
        if max(met.values(), default=0) < SHARED:
            kept.append(i)
            for value in sketch:
                holders.setdefault(value, []).append(i)
    return kept


def _descend(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, top: int, steps: int = 400,
             ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by Adam on the weighted negative log-likelihood; gaps between cuts are exponentials."""
    n, m = x.shape
    params = np.zeros(m + top)
    params[m] = 1.0
    moment, square = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        cuts = params[m] + np.append(0, np.cumsum(np.exp(params[m + 1 :])))
        above = 1 / (1 + np.exp(-np.clip((x @ params[:m])[:, None] - cuts, -30, 30)))
        bounds = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        chance = np.maximum(bounds[rows, grade] - bounds[rows, grade + 1], 1e-12)
        slope = bounds * (1 - bounds)
        by_score = -weight * (slope[rows, grade] - slope[rows, grade + 1]) / chance
        by_cut = np.zeros((n, top + 2))
        by_cut[rows, grade] += weight * slope[rows, grade] / chance
        by_cut[rows, grade + 1] -= weight * slope[rows, grade + 1] / chance
        by_cut = by_cut[:, 1 : top + 1].sum(axis=0)
        gradient = np.empty_like(params)
        gradient[:m] = x.T @ by_score / n + ridge * params[:m]
        after = np.cumsum(by_cut[::-1])[::-1] / n
        gradient[m] = after[0]
        gradient[m + 1 :] = after[1:] * np.exp(params[m + 1 :])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        params[m + 1 :] = np.clip(params[m + 1 :], -6, 6)
    return params[:m], params[m] + np.append(0, np.cumsum(np.exp(params[m + 1 :])))


def _best_cut(chance: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """Cut with the highest weighted F1; one half if no cut is better."""
    best, at = -1.0, 0.5
    for cut in (0.5, *np.linspace(0.2, 0.9, 15)):
        hit = chance >= cut
        right = weight[hit & bad].sum()
        score = 2 * right / max(weight[hit].sum() + weight[bad].sum(), 1e-12)
        if score > best + 1e-9:
            best, at = score, float(cut)
    return at


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", rows_per_grade: int = ROWS_PER_GRADE,
        features: int = FEATURES, text_features: int = TEXT_FEATURES, split_top: bool = False) -> SeverityModel:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, grade)``, grades being 0, 1, 2, ...

    At most about ``rows_per_grade`` labelled ids of each grade are used, those
    with the smallest hashes, weighted back to their true shares. An id with
    several labels has the highest; null ids and grades are left out. Grades are
    those of the labels: 0 and 1 make one threshold. ``split_top`` adds a third
    one to those, made of the texts with more telling features than the median
    of the bad ones that are learnt from. The driver gets at most
    ``text_features`` feature hashes of each text of the sample.
    Without labels of two grades, every text is of grade 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where(
        "doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().limit(GRADES + 1).collect()}
    if len(counts) > GRADES or (counts and max(counts) >= GRADES):
        raise ValueError(f"at most {GRADES} grades")
    nothing = SeverityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0), 0.5)
    if len(counts) < 2:
        return nothing
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for g, n in counts.items():
        chosen = chosen | ((F.col("grade") == g) & (place < int((1 << 30) * min(1.0, rows_per_grade / n))))
    # Bounded by grades times rows_per_grade.
    sample = F.broadcast(known.where(chosen))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "grade", "text")
    table = texts.limit(2 * rows_per_grade * len(counts)).mapInArrow(
        _feature_sets(text_features), "doc_id long, grade int, words array<long>").toArrow()
    if table.num_rows == 0:
        return nothing
    table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = table.column("words").combine_chunks()
    cuts, flat = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0], lists.flatten().to_numpy().view(np.uint64)
    # Copies of a text would make its own rare words look telling.
    sets = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    rows = _distinct_rows(sets)
    y = table.column("grade").to_numpy().astype(np.int64)[rows]
    owner, word = np.repeat(np.arange(len(y)), [len(sets[i]) for i in rows]), np.concatenate([sets[i] for i in rows])
    held = np.random.default_rng(5).random(len(y)) < HELD_OUT
    learn = ~held[owner]
    words = _selected(y[~held], (np.cumsum(~held) - 1)[owner[learn]], word[learn], features)
    if len(words) == 0 or len(np.unique(y)) < 2:
        return nothing
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    met = words[at] == word
    x = np.zeros((len(y), len(words)))
    x[owner[met], at[met]] = 1
    shares = np.array([counts.get(g, 0) / max((y == g).sum(), 1) for g in range(y.max() + 1)])
    weight = shares[y] / shares[y].mean()
    if split_top and y.max() == 1:
        telling = x[(y == 1) & ~held].sum(axis=0) * max(((y == 0) & ~held).sum(), 1) > (
            x[(y == 0) & ~held].sum(axis=0) * max(((y == 1) & ~held).sum(), 1))
        number = x[:, telling].sum(axis=1)
        least = np.median(number[(y == 1) & ~held]) if ((y == 1) & ~held).any() else np.inf
        if number[y == 1].min() < least == number[y == 1].max():  # the median is tied with the highest
            least -= 0.5
        y = y + ((y == 1) & (number > least))
    weights, cuts = _descend(x[~held], y[~held], weight[~held], int(y.max()))
    model = SeverityModel(words, weights, cuts, 0.5)
    if held.any():
        chance = model.chances(x[held] @ weights)[:, 0]
        model = SeverityModel(words, weights, cuts, _best_cut(chance, y[held] > 0, weight[held]))
    return model


def _score(model: SeverityModel, text: str) -> K.Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, fold = K.Hasher(), K.letter_words(False), K.lower_table()
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(model.words & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            row = batch.column(0)
            scores = np.zeros(len(row))
            for first, _, data, offsets in K.text_slices(row.field(text)):
                hashes, owner = features_of(data, offsets, hasher, table, fold, maybe)
                if len(hashes) == 0:
                    continue
                at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
                found = model.words[at] == hashes
                once = np.unique(owner[found] * len(model.words) + at[found])
                np.add.at(scores, first + once // len(model.words), model.weights[once % len(model.words)])
            above = model.chances(scores)
            bounds = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
            chance = above[:, 0] if above.shape[1] else np.zeros(len(scores))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array((bounds[:, :-1] - bounds[:, 1:]).argmax(axis=1).astype(np.int32)), pa.array(above.sum(axis=1)),
                 pa.array(chance), pa.array((chance >= model.reject_at) if above.shape[1] else np.zeros(len(scores), dtype=bool))],
                ["row", "severity", "expected_severity", "p_toxic", "toxic"])

    return run


def graded(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``severity``, ``expected_severity``, ``p_toxic`` and ``toxic``, one row a document.

    ``severity`` is the likeliest grade, ``expected_severity`` the sum of the
    chances of reaching each grade, ``p_toxic`` the chance above grade 0, and
    ``toxic`` whether it reaches the model's cut. Whole texts count, each feature
    once. Null and empty texts have no words and get the base rates. Column
    names of ``docs`` cannot clash, as they stay inside ``row``.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([
        *packed.schema.fields, T.StructField("severity", T.IntegerType()), T.StructField("expected_severity", T.DoubleType()),
        T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return packed.mapInArrow(_score(model, text), schema)


def held_out(docs: DataFrame, labels: DataFrame, grade: str = "toxic", parts: int = PARTS, **settings) -> DataFrame:
    """``grade, n_rows, n_rejected, expected_severity`` of labelled texts that a model has not seen.

    One part in ``parts`` of the texts, chosen by the hash of the text, so that
    copies are on one side, is graded by a model fitted on the labels of the
    others. Each labelled row of ``docs(doc_id, text)`` counts, repeated ids too;
    null texts are empty ones. Without labels: no rows. ``settings`` go to ``fit``.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where(
        "doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
    held = F.pmod(F.xxhash64(F.lit(23), F.coalesce("text", F.lit(""))), F.lit(parts)) == 0
    rest = labelled.where(~held)
    model = fit(rest.select("doc_id", "text"), rest.select("doc_id", "grade"), grade="grade", **settings)
    return graded(labelled.where(held), model).groupBy(F.col("row.grade").alias("grade")).agg(
        F.count("*").alias("n_rows"), F.count_if("toxic").alias("n_rejected"),
        F.avg("expected_severity").alias("expected_severity"))
