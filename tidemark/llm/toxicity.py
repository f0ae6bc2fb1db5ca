"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text (runs of ASCII letters, digits and non-ASCII
bytes, A-Z lower-cased) and their prefixes of 4, 5 and 6 bytes, which catch inflected
forms. A term is known by its 64-bit hash. Fitting selects the terms that go with
either class by a likelihood-ratio test, so that the thousands of neutral terms of a
long text don't add up, then learns a weight and a factor vector for each:

    score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j)

The pair term is what an additive model misses (an insult next to a group's name).
The model is fitted on a bounded sample of labelled rows, in one task; scoring reads
every text once and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches
from tidemark.llm.words import FIRST, Words, chunks, mix

#: The sample bound: at most so many labelled rows are used to fit.
TRAIN_ROWS = 8000
#: Longer texts are not fitted on (they are scored whole, as all are).
TRAIN_CHARS = 200_000
PREFIXES = (4, 5, 6)
TERMS = 4096
FACTORS = 8
#: Likelihood-ratio statistic that a term needs: about p = 1e-6 for one degree of freedom.
EVIDENCE = 24.0
COUNTERS = 1 << 20
CHUNK_BYTES = 1 << 19
_COUNTER = np.uint64(64 - 20)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, their text's number) of a chunk of texts; a term may repeat within a text."""
    with np.errstate(over="ignore"):
        words = Words(column, lower=True, letters=True)
        owner = np.repeat(np.arange(len(column)), np.diff(words.at))
        sums = FIRST.sums(words.places())
        found, owners = [FIRST.words(words, sums)], [owner]
        for k, length in enumerate(PREFIXES, 1):
            longer = words.ends - words.starts > length
            start = words.starts[longer]
            found.append(mix((sums[start + length] - sums[start]) ^ FIRST.salt[1] ^ np.uint64(k)))
            owners.append(owner[longer])
        return np.concatenate(found), np.concatenate(owners)


def _distinct(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], owner[first]


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The likelihood-ratio statistic of a term's presence against the label."""
    out = np.zeros(len(toxic))
    total = max(n_toxic + n_clean, 1)
    seen = toxic + clean
    for part, n in ((toxic, n_toxic), (clean, n_clean)):
        for cell, marginal in ((part, seen), (n - part, total - seen)):
            expected = marginal * (n / total)
            ok = (cell > 0) & (expected > 0)
            out[ok] += 2 * cell[ok] * np.log(cell[ok] / expected[ok])
    return out


class Model:
    """w0, and for each selected term (ascending hashes) a weight and a factor vector."""

    def __init__(self, w0: float, hashes: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.w0, self.hashes, self.weights, self.factors = w0, hashes, weights, factors

    def active(self, found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, text number), distinct, of the terms that the model knows."""
        if not len(self.hashes) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[at] == found
        pair = np.unique(owner[hit].astype(np.int64) * len(self.hashes) + at[hit])
        return pair % len(self.hashes), pair // len(self.hashes)

    def margin(self, term: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = self.w0 + np.bincount(owner, self.weights[term], n)
        sums = np.zeros((n, self.factors.shape[1]))
        for k in range(self.factors.shape[1]):
            v = self.factors[term, k]
            sums[:, k] = np.bincount(owner, v, n)
            out += 0.5 * (sums[:, k] ** 2 - np.bincount(owner, v * v, n))
        return out, sums

    def scores(self, column: pa.Array) -> np.ndarray:
        margin, _ = self.margin(*self.active(*terms(column)), len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


#: Of rows of one class, or none, nothing can be learned: everything counts as clean.
NOTHING = Model(-10.0, np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)))


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 1e-3, seed: int = 7) -> Model:
    """Fit on labelled texts: term selection, then Adam on the regularised log loss of all rows."""
    n, n_toxic = len(toxic), int(toxic.sum())
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return NOTHING
    w0 = float(np.log(n_toxic / n_clean))
    found, owners, counts = [], [], [np.zeros(COUNTERS), np.zeros(COUNTERS)]
    for low, high in chunks(texts, CHUNK_BYTES):
        f, o = _distinct(*terms(texts.slice(low, high - low)))
        label = toxic[low + o]
        cell = (f >> _COUNTER).astype(np.int64)
        for kind in (0, 1):
            counts[kind] += np.bincount(cell[label == kind], minlength=COUNTERS)
    # Counters first: only a term whose counter shows evidence is kept and counted exactly, in a second pass.
    strong = np.concatenate([evidence(counts[1][i : i + 65536], counts[0][i : i + 65536], n_toxic, n_clean) for i in range(0, COUNTERS, 65536)]) >= EVIDENCE / 2
    for low, high in chunks(texts, CHUNK_BYTES):
        f, o = _distinct(*terms(texts.slice(low, high - low)))
        keep = strong[(f >> _COUNTER).astype(np.int64)]
        found.append(f[keep])
        owners.append((low + o[keep]).astype(np.int32))
    every, owner = np.concatenate(found), np.concatenate(owners).astype(np.int64)
    hashes, code = np.unique(every, return_inverse=True)
    ones = np.bincount(code, toxic[owner], len(hashes))
    zeros = np.bincount(code, 1 - toxic[owner], len(hashes))
    stat = evidence(ones, zeros, n_toxic, n_clean)
    best = np.sort(np.argsort(-stat, kind="stable")[:TERMS])
    best = best[stat[best] >= EVIDENCE]
    model = Model(w0, hashes[best], np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.05, (len(best), FACTORS)))
    if not len(best):
        return model
    term, owner = model.active(every, owner)
    # The intercept stays at the classes' odds: were it learned, it would sink as the terms explain the toxic
    # texts, and a text with one weak sign, such as the prefix of a form never seen, would no longer outweigh it.
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.factors)]
    params = [model.weights, model.factors]
    for step in range(1, steps + 1):
        margin, sums = model.margin(term, owner, n)
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic) / n
        grads = [np.bincount(term, error[owner], len(best)) + l2 * model.weights / len(best), np.zeros_like(model.factors)]
        for k in range(FACTORS):
            grads[1][:, k] = np.bincount(term, error[owner] * (sums[owner, k] - model.factors[term, k]), len(best)) + l2 * model.factors[:, k] / len(best)
        for p, g, m in zip(params, grads, moments, strict=True):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    table = pa.Table.from_batches(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())})
    table = table.sort_by("doc_id")
    text = table["text"].combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    model = fit(text, table["toxic"].to_numpy().astype(np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.w0]), *(pa.array([x.tobytes()], pa.binary()) for x in (model.hashes, model.weights, model.factors))], ["w0", "hashes", "weights", "factors"]
    )


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, the first by a hash of their id.

    ``labels`` has doc_id and toxic (0 or 1; null or repeated rows: the largest counts). Of documents that repeat an id one text
    is fitted on, the first by a hash; texts above `TRAIN_CHARS` are not. So rows and bytes of the fit are bounded.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxicity-sample")
    # The sample is bounded by ``rows``, so it may be broadcast.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).groupBy("doc_id", "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    fitted = materialize(texts.select("doc_id", "text", "toxic").repartition(1).mapInArrow(_fit, "w0 double, hashes binary, weights binary, factors binary"), "toxicity-model")
    row = fitted.first()
    if row is None:  # an empty table may have no partition at all
        return NOTHING
    return Model(row.w0, np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.weights), np.frombuffer(row.factors).reshape(-1, FACTORS))


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on), and the columns ``keep``.

    Labels are learned only from rows outside the held-out fold. Labels, lang, source and
    doc_id are no inputs of a score. Without labels of both classes everything counts as
    clean; null and empty texts get the score of no terms. Repeated rows each come back;
    columns that are not named are not read.
    """
    model = train(documents, labels, rows)
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *keep)
    kept = docs.drop("_text").schema
    scored = docs.mapInArrow(_scores(model, [f.name for f in kept]), kept.add("score", "double"))
    judged = [held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")]
    return scored.select("doc_id", *judged, *keep)


def _scores(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            for low, high in chunks(text, CHUNK_BYTES):
                score = pa.array(model.scores(text.slice(low, high - low)))
                yield pa.RecordBatch.from_arrays([*(x.slice(low, high - low) for x in rest), score], [*names, "score"])

    return run
