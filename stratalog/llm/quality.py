"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every token stands for two words, its letters as they are and its shape (runs of upper, lower, digit, other bytes).
A word's index vector is a sparse ternary row, drawn from a seed; its context vector is the sum of the index vectors of
the words within CONTEXT tokens, over all documents. Words share WORD_BUCKETS classes by hash, so the vector is a
class's. Documents pool their words' normalised context vectors; beside the means stand a flag for no token and the share
of repeated pairs of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, fold, mix64, run_hashes, token_bounds

WORD_BUCKETS, SHAPE_BUCKETS, DIM, NONZERO, CONTEXT, HIDDEN = 4096, 1024, 32, 4, 2, 24
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Bound of the labelled sample, over all labelled documents by hash.
SAMPLE_DOCS = 3000
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    mean: np.ndarray
    scale: np.ndarray


def index_vectors(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int32)
    where = rng.random((BUCKETS, DIM)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, where, rng.choice([-1, 1], (BUCKETS, NONZERO)).astype(np.int32), 1)
    return out


def tokens_of(data: np.ndarray, offsets: np.ndarray):
    """(word bucket, shape bucket, first token of each text) of a slice of texts; tokens end at ASCII white space."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    starts, ends = token_bounds(~space[data], offsets)
    words = (run_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    kind = np.full(256, 4, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 2
    punctuation = np.arange(33, 48)
    kind[punctuation] = punctuation + 5
    shape = kind[data]
    n = len(data)
    change = np.ones(n, bool)
    change[1:] = shape[1:] != shape[:-1]
    change[starts] = True
    change &= ~space[data]
    at = np.flatnonzero(change)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    shapes = (run_hashes(shape[at], first, last) >> np.uint64(40)).astype(np.int64) % SHAPE_BUCKETS + WORD_BUCKETS
    return words, shapes, np.searchsorted(starts, offsets)


def _contexts(batches):
    """Sums of index vectors in the context of each bucket, over a partition: at most BUCKETS rows."""
    index, total, counts = index_vectors(), np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, offsets in byte_slices(batch.column(0)):
            words, shapes, firsts = tokens_of(data, offsets)
            n = len(words)
            if not n:
                continue
            text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            own = index[words] + index[shapes]
            near = np.zeros((n, DIM), np.int32)
            for d in range(1, CONTEXT + 1):
                same = (text[d:] == text[:-d])[:, None]
                near[d:] += np.where(same, own[:-d], 0)
                near[:-d] += np.where(same, own[d:], 0)
            for ids in (words, shapes):
                order = np.argsort(ids, kind="stable")
                held, at = np.unique(ids[order], return_index=True)
                total[held] += np.add.reduceat(near[order], at, axis=0, dtype=np.int64)
                counts[held] += np.diff(np.concatenate((at, [n])))
    held = np.flatnonzero(counts)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), *(pa.array(total[held, d]) for d in range(DIM))], ["bucket", "n", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Normalised context vectors of all buckets, from the whole texts of all documents. Sums of integers: the same however rows are dealt."""
    bound_batches(docs.sparkSession)
    names = ["n", *(f"v{d}" for d in range(DIM))]
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, "bucket bigint, " + ", ".join(f"{c} bigint" for c in names))
    table = np.zeros((BUCKETS, DIM), np.float64)
    for row in found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).collect():  # BUCKETS rows at most
        v = np.array(row[2:], np.float64)
        table[row[0]] = v / max(1e-9, np.sqrt((v**2).sum()))
    return table.astype(np.float32)


def pooled(table: np.ndarray, column: pa.Array) -> np.ndarray:
    """Of each text, the means over its tokens of the word and shape rows of ``table``, a flag for no token and the share of repeated tokens."""
    n, width = len(column), table.shape[1]
    out = np.zeros((n, 2 * width + 2), np.float64)
    out[:, 2 * width] = 1
    for first, last, data, offsets in byte_slices(column):
        words, shapes, firsts = tokens_of(data, offsets)
        rows = np.flatnonzero(np.diff(firsts))
        if not len(rows):
            continue
        at, counts = firsts[rows], np.diff(firsts)[rows][:, None]
        out[first + rows, :width] = np.add.reduceat(table[words], at, axis=0, dtype=np.float64) / counts
        out[first + rows, width : 2 * width] = np.add.reduceat(table[shapes], at, axis=0, dtype=np.float64) / counts
        out[first + rows, 2 * width] = 0
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        inside = text[1:] == text[:-1]
        if inside.any():
            owner = text[1:][inside]
            pair = mix64((words[1:] * BUCKETS + words[:-1])[inside].astype(np.uint64) * np.uint64(1 << 32) + owner.astype(np.uint64))
            _, where = np.unique(pair, return_index=True)
            fresh, pairs = (np.bincount(x, minlength=len(firsts) - 1)[rows] for x in (owner[where], owner))
            out[first + rows, 2 * width + 1] = np.where(pairs > 0, 1 - fresh / np.maximum(1, pairs), 0)
    return out


def _hidden(model: Model, x: np.ndarray) -> np.ndarray:
    return np.maximum(((x - model.mean) / model.scale) @ model.first + model.first_bias, 0)


def train(table: np.ndarray, rows: list[tuple[int, np.ndarray]], seed: int = 3, epochs: int = 60) -> Model:
    """Adam on (label, pooled text) rows, four fifths of them; the rest sets the temperature."""
    rng = np.random.default_rng(seed)
    if not rows:
        width = 2 * table.shape[1] + 2
        return Model(table, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 4.0, 1.0, np.zeros(width), np.ones(width))
    x = np.array([v for _, v in rows])
    y = np.array([float(q) for q, _ in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    fits = np.arange(len(rows)) % 5 != 0
    z = (x - mean) / scale
    width = x.shape[1]
    params = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step, at = 0, np.flatnonzero(fits)
    for _ in range(epochs if len(set(y)) > 1 else 0):
        order = rng.permutation(at)
        for batch in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            h = np.maximum(z[batch] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[batch]) / len(batch)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[batch].T @ back + 1e-3 * params[0], back.sum(0), h.T @ g + 1e-3 * params[2], g.sum(keepdims=True)]
            for param, grad, m in zip(params, grads, moments):
                m[0][:] = 0.9 * m[0] + 0.1 * grad
                m[1][:] = 0.999 * m[1] + 0.001 * grad**2
                param -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model = Model(table, params[0], params[1], params[2], float(params[3][0]), 1.0, mean, scale)
    if len(set(y)) < 2:
        model.second, model.second_bias = np.zeros(HIDDEN), (4.0 if y.mean() > 0.5 else -4.0)
    elif (~fits).any():
        logits = _hidden(model, x[~fits]) @ model.second + model.second_bias
        sign = np.where(y[~fits] > 0, 1.0, -1.0)
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: float(np.logaddexp(0, -sign * logits / t).mean())))
    return model


def probability(model: Model, column: pa.Array) -> np.ndarray:
    logits = _hidden(model, pooled(model.table, column)) @ model.second + model.second_bias
    return 1 / (1 + np.exp(-np.clip(logits / model.temperature, -40, 40)))


def _score(shared):
    """Probabilities of a column of texts: only the texts go to Python and only the scores come back."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(probability(shared.value, column), pa.float64())

    # not deterministic, so that a filter on the score doesn't compute it again
    return F.arrow_udf(run, "double").asNondeterministic()


def _pooled(shared):
    def run(batches):
        for batch in batches:
            x = pooled(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["place", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_DOCS) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``most`` labelled documents where ``where`` (over the ids) holds, the least by a hash of the id.

    Rows without id, text or label (0 or 1) don't count. An id with both labels counts as 0; of an id that repeats in
    ``docs`` the text with the least hash counts. Without both labels the score is a constant, high without any label.
    Equal tables give equal models. Texts are pooled where they lie: only vectors come to the driver, a row a document.
    """
    spark = docs.sparkSession
    table = word_vectors(docs, text_col)
    h = F.xxhash64(F.lit(13), F.col(id_col))
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__label")).where(F.col(id_col).isNotNull() & F.col("__label").isin(0, 1))
    known = known.where(where).groupBy(id_col).agg(F.min("__label").alias("__label")).orderBy(h, id_col).limit(most)
    known = known.select(F.col(id_col).alias("__of"), "__label", h.alias("__place"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    rows = texts.join(F.broadcast(known), F.col("__id") == F.col("__of"))  # ``most`` rows
    nth = F.row_number().over(W.partitionBy("__id").orderBy(F.xxhash64("__text"), F.xxhash64(F.lit(1), "__text")))
    rows = rows.withColumn("__nth", nth).where("__nth = 1").select("__place", "__label", "__text")
    found = rows.mapInArrow(_pooled(spark.sparkContext.broadcast(table)), "place bigint, label int, x array<double>").collect()
    return train(table, [(r["label"], np.array(r["x"])) for r in sorted(found, key=lambda r: (r["place"], r["label"], r["x"]))])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of each row of ``docs``, and score and predicted (1 from a score of 0.3), from the whole text alone.

    A null text counts as empty; an empty one has a score as any other. Very long texts are pooled slice by slice, whole.
    Rows that repeat come back as often; an empty table gives an empty one. Result columns replace columns with their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    found = docs.select(*kept, _score(spark.sparkContext.broadcast(model))(F.col(text_col).cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 5 isn't 0 and score all."""
    found = score(docs, fit(docs, labels, fold("doc_id", 5) != 0), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
