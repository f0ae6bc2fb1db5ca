"""Quality: Bradley-Terry scores of documents, learned from preference pairs.

A document is described by shares and means, which don't grow with its length: which kinds of
bytes follow each other (`KINDS`), how often a word is the same as the word one to eight
places before, and how long its words are.
A pair says that a document of label 1 beats one of label 0 with the odds

    P(a beats b) = sigmoid(w . (f(a) - f(b)))

so a document's utility is w . f. Weights are learned by the logistic loss of feature
differences, by Newton steps. The cut is a quantile of the utilities of all labelled rows,
the level at which it errs least on them; a score is the odds of a document
against one at the cut, moved so that the cut is at `CUT`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches
from tidemark.llm.words import FIRST, Words, chunks

#: The sample bound: the weights are fitted on at most so many labelled documents.
TRAIN_ROWS = 8000
#: Pairs that each sampled document takes part in, about.
PAIRS = 4
#: The score at the cut.
CUT = 0.7
LAGS = (1, 2, 3, 4, 5, 6, 7, 8)
CHUNK_BYTES = 1 << 19
#: Utilities are counted in bins of 1 / BINS between -REACH and REACH for the cut.
BINS, REACH = 64, 64

# Kinds of bytes: upper, lower, digit, space, line end, full stop or comma, other ASCII sign, beyond ASCII.
KINDS = 8
_KIND = np.full(256, 6, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[[32, 9]], _KIND[[10, 13]], _KIND[[44, 46]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7
SIZE = KINDS * KINDS + len(LAGS) + 2


def features(column: pa.Array) -> np.ndarray:
    """One row of `SIZE` numbers for each text of a chunk; a null or empty text gives zeros."""
    n = len(column)
    with np.errstate(over="ignore"):
        words = Words(column)
        hashes = FIRST.words(words)
    out = np.zeros((n, SIZE))
    kind, offsets = _KIND[words.data].astype(np.int64), words.offsets
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    if len(kind) > 1:
        same = owner[1:] == owner[:-1]
        pair = (owner[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
        counts = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    n_words = np.diff(words.at)
    mine = np.repeat(np.arange(n), n_words)
    at = KINDS * KINDS
    for lag in LAGS:
        if len(hashes) > lag:
            again = (hashes[lag:] == hashes[:-lag]) & (mine[lag:] == mine[:-lag])
            out[:, at] = np.sqrt(np.bincount(mine[lag:][again], minlength=n) / np.maximum(n_words, 1))
        at += 1
    if len(hashes):
        length = (words.ends - words.starts).astype(float)
        out[:, at] = np.bincount(mine, length, n) / np.maximum(n_words, 1)
        out[:, at + 1] = np.sqrt(np.bincount(mine[length > 20], minlength=n) / np.maximum(n_words, 1))
    return out


class Model:
    """Weights on features that are centred and scaled as in the sample, within `REACH` in all; and the cut."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float = 0.0):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def utility(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights, -REACH, REACH)


#: Without documents of both labels no preference is known: all utilities are equal, and lie above the cut.
NOTHING = Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), -1.0)


def pairs(label: np.ndarray, each: int = PAIRS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(winner, loser) row numbers: every document meets ``each`` drawn documents of the other label, and those that draw it."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    winner = np.concatenate([np.repeat(good, each), rng.choice(good, len(bad) * each)])
    loser = np.concatenate([rng.choice(bad, len(good) * each), np.repeat(bad, each)])
    return winner, loser


def loss(weights: np.ndarray, differences: np.ndarray, l2: float) -> float:
    return float(np.logaddexp(0, -differences @ weights).mean() + l2 / 2 * weights @ weights)


def fit_weights(differences: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """The weights with the least mean logistic loss of the pairs' feature differences, by Newton steps that are halved until they help."""
    w = np.zeros(differences.shape[1])
    now = loss(w, differences, l2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -40, 40)))
        gradient = l2 * w - differences.T @ p / len(differences)
        curvature = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences)
        step = np.linalg.solve(curvature + l2 * np.eye(len(w)), gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step, differences, l2) > now:
            rate /= 2
        w = w - rate * step
        before, now = now, loss(w, differences, l2)
        if before - now < 1e-10:
            break
    return w


def fit(f: np.ndarray, label: np.ndarray) -> Model:
    """Weights from the preference pairs of a sample; its cut is not set yet."""
    winner, loser = pairs(label)
    if not len(winner):
        return NOTHING
    mean, scale = f.mean(axis=0), f.std(axis=0)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(SIZE))
    z = np.clip((f - model.mean) / model.scale, -8, 8)
    model.weights = fit_weights(z[winner] - z[loser])
    return model


def best_cut(bins: list[tuple[int, int, int]]) -> float:
    """The utility that splits labelled rows with the fewest errors, from (bin, label, count); of ties the middle of the widest gap, then the lowest."""
    if len({label for _, label, _ in bins}) < 2:
        return NOTHING.cut
    least, most = min(b for b, *_ in bins), max(b for b, *_ in bins)
    counts = np.zeros((2, most - least + 1))
    for b, label, n in bins:
        counts[label, b - least] += n
    below = np.concatenate([[0], np.cumsum(counts[1])])  # good ones that a cut below bin i rejects
    above = counts[0].sum() - np.concatenate([[0], np.cumsum(counts[0])])
    errors = below + above
    good = np.flatnonzero(errors == errors.min())
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    run = max(runs, key=len)
    return float((run[0] + run[-1]) / 2 + least) / BINS


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _mapped(make, names: list[str]):
    """A mapInArrow function: the columns ``names``, then those that ``make`` gives for a chunk of `_text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            for low, high in chunks(text, CHUNK_BYTES):
                rest = [batch.column(name).slice(low, high - low) for name in names]
                got = make(text.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([*rest, *got.values()], [*names, *got])

    return run


def train(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Weights from at most ``rows`` of the ids of ``known`` (doc_id, label), half of each label where there are so many, the first by a hash of the id.

    Documents that repeat an id count once, by the mean of their features.
    """
    first = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for v in (0, 1)]
    sample = materialize(first[0].unionByName(first[1]), "quality-sample")
    # The sample is bounded by ``rows``, so it may be broadcast, and its features collected.
    texts = docs.join(F.broadcast(sample), "doc_id")
    as_list = "doc_id long, label int, " + ", ".join(f"f{k} double" for k in range(SIZE))
    got = texts.select("doc_id", "label", "_text").mapInArrow(_mapped(lambda t: {f"f{k}": pa.array(c) for k, c in enumerate(features(t).T)}, ["doc_id", "label"]), as_list)
    mean = got.groupBy("doc_id", "label").agg(*[F.avg(f"f{k}").alias(f"f{k}") for k in range(SIZE)]).orderBy("doc_id").toArrow()
    if not len(mean):
        return NOTHING
    return fit(np.stack([mean[f"f{k}"].to_numpy() for k in range(SIZE)], axis=1), mean["label"].to_numpy())


def quality(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from `CUT` on), and the columns ``keep``.

    ``labels`` has doc_id and quality (0 or 1; other values are no label; of repeated rows the largest counts). Labels are learned only
    from rows outside the held-out fold. Labels, lang, source and doc_id are no inputs of a
    score. Without labels of both values every document is predicted 1. Null and empty texts get the
    score of no words. Repeated rows each come back; columns that are not named are not read.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = materialize(known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")), "quality-labels")
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *keep)
    model = train(docs.select("doc_id", "_text"), known, rows)
    kept = docs.drop("_text").schema
    scored = docs.mapInArrow(_mapped(lambda t: {"_utility": pa.array(model.utility(features(t)))}, [f.name for f in kept]), kept.add("_utility", "double"))
    scored = materialize(scored, "quality-utilities")
    bins = scored.join(known, "doc_id").groupBy(F.floor(F.col("_utility") * BINS).cast("int").alias("bin"), "label").count()
    cut = best_cut([(r["bin"], r["label"], r["count"]) for r in bins.collect()])  # 2 * BINS * 2 * REACH rows at most
    odds = F.col("_utility") - F.lit(cut) + F.lit(float(np.log(CUT / (1 - CUT))))
    out = scored.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= F.lit(CUT)).cast("int").alias("predicted"), *keep)
