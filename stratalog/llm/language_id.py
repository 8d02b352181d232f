"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, byte_slices, fold

GRAMS, BUCKET_BITS, DIM = (2, 3, 4), 16, 16
#: Bounds of the labelled sample, by hash: documents over all languages, and what each language has in any case, however many there are.
SAMPLE_DOCS, LEAST_DOCS = 600, 6
#: Steps of training a language, where that is more than all should have.
LANG_STEPS = 300
#: Logits that are held at a time.
LOGITS = 1 << 21
#: Bytes of the pieces that a sampled text is cut in, in turn; texts of more than MOST_PIECES of them have proportionally longer ones.
PIECES, MOST_PIECES = (24, 60, 200, 600), 64
#: Share of accepted texts that may be wrong.
TARGET_ERROR = 0.01
UNKNOWN = "und"


@dataclass
class Model:
    """A text's logits are the mean of its subwords' rows of ``table``, times ``out`` if there is one, plus ``bias``.

    ``table`` is the embeddings times the output weights for up to DIM languages; for more it is the embeddings alone, so
    that it doesn't grow with the languages, and ``out`` holds the weights.
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    out: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Bytes of letters, lower-cased; others become a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def subwords(data: np.ndarray, offsets: np.ndarray):
    """Yield (bucket, text) of all subwords of 2 to 4 bytes of each word with its boundaries; each length at a time."""
    # Each text gets a space before and after, which mark the bounds of its first and last word.
    n_texts, lengths = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n_texts, dtype=np.int32), lengths + 2)
    padded = np.full(len(owner), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n_texts) + 1, lengths)] = _classes()[data]
    # Runs of spaces collapse, so that what separates words doesn't count.
    stay = np.ones(len(padded), bool)
    stay[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (owner[1:] != owner[:-1])
    padded, owner = padded[stay], owner[stay]
    code = padded.astype(np.uint32)
    space = padded == 32
    for k in range(2, max(GRAMS) + 1):
        if len(code) < 2:
            return
        code = (code[:-1] << np.uint32(8)) | padded[k - 1 :]
        if k in GRAMS:
            ok = owner[: len(code)] == owner[k - 1 :]
            for i in range(1, k - 1):
                ok &= ~space[i : i + len(code)]
            if k == 2:
                ok &= ~(space[:-1] & space[1:])
            c = code[ok] * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
            c = (c ^ (c >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield c >> np.uint32(32 - BUCKET_BITS), owner[: len(ok)][ok]


def piece_bounds(n: int) -> list[int]:
    """Where the pieces of a text of ``n`` bytes begin, and its end: all of the text, in at most MOST_PIECES pieces."""
    cycle = sum(PIECES)
    scale = max(1, -(-n * len(PIECES) // (cycle * MOST_PIECES)))
    steps = np.cumsum([0, *(p * scale for p in PIECES)])
    starts = [int(s) + k * cycle * scale for k in range(-(-n // (cycle * scale)) or 1) for s in steps[:-1]]
    return [s for s in starts if s < n] + [n] if n else [0, 0]


def piece_features(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each piece of a text, whole; counts are scaled to 16 bits."""
    bounds = piece_bounds(len(text))
    out = []
    for at, end in zip(bounds[:-1], bounds[1:]):
        found = [b for b, _ in subwords(np.frombuffer(text, np.uint8, end - at, at), np.array([0, end - at]))]
        ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(counts) and counts.max() > 0xFFFF:
            counts = np.maximum(1, counts * 0xFFFF // counts.max())
        out.append((ids.astype(np.uint16), counts.astype(np.uint16)))
    return out


def train(rows: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], seed: int = 7, steps: int = 9000, rate: float = 0.5) -> Model:
    """Fit on (lang, pieces of a text) rows by stochastic gradient descent, a piece a step, at least ``steps`` of them and LANG_STEPS a language.

    Every fifth text of each language, whole, is kept out: those set the temperature, and the least score at which no more than
    TARGET_ERROR of the texts above it are wrong. Texts below that score are to be rejected.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows}, key=str.encode)
    known, n_langs = {lang: i for i, lang in enumerate(langs)}, len({lang for lang, _ in rows})
    use, held, nth = [], [], Counter()
    for i, (lang, pieces) in enumerate(rows):
        nth[lang] += 1
        (use if nth[lang] % 5 else held).extend([(i, known[lang], ids.astype(np.int64), counts.astype(np.float32)) for ids, counts in pieces if len(ids)])
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, n_langs), np.float32), np.zeros(n_langs, np.float32)
    epochs = -(-max(steps, LANG_STEPS * n_langs) // len(use)) if use else 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(use)):
            _, label, ids, counts = use[i]
            share = counts / counts.sum()
            x = share @ embed[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            grad = out @ p
            out -= step * np.outer(x, p)
            bias -= step * 0.1 * p
            embed[ids] -= np.outer(share * step, grad)
    table, weights = (embed @ out, None) if n_langs <= DIM else (embed, out)
    temperature, reject = 1.0, 0.0
    if held:
        texts = sorted({i for i, *_ in held})
        at = {i: k for k, i in enumerate(texts)}
        sums, totals, truth = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, label, ids, counts in held:
            sums[at[i]] += counts @ table[ids]
            totals[at[i]] += counts.sum()
            truth[at[i]] = label
        logits = (sums if weights is None else sums @ weights) / totals[:, None] + bias

        # A right answer counts as (n + 1) / (n + 2) and not as certain, so that few errors don't make scores extreme.
        want = np.full(logits.shape, 1 / (len(texts) + 2) / max(1, n_langs - 1))
        want[np.arange(len(texts)), truth] = (len(texts) + 1) / (len(texts) + 2)

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float(np.mean((want * (np.log(np.exp(z).sum(1, keepdims=True)) - z)).sum(1)))

        temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        z = logits / temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        reject = rejection_threshold(p.max(1), p.argmax(1) == truth)
    return Model(langs, table.astype(np.float32), bias, temperature, reject, weights)


def rejection_threshold(scores: np.ndarray, right: np.ndarray, error: float = TARGET_ERROR) -> float:
    """The least of ``scores`` from which on at most a share of ``error`` is wrong; above all of them if there is none such."""
    order = np.argsort(-scores, kind="stable")
    top, wrong = scores[order], np.cumsum(~right[order])
    last = np.append(top[1:] != top[:-1], True)  # equal scores are accepted together
    good = np.flatnonzero(last & (wrong <= error * np.arange(1, len(top) + 1)))
    return float(top[good[-1]]) if len(good) else float(np.nextafter(top[0], 2)) if len(top) else 0.0


def _features(batches):
    for batch in batches:
        rows = [(lang, nth, k, ids.tobytes(), counts.tobytes()) for lang, nth, text in zip(*(batch.column(i).to_pylist() for i in range(3))) for k, (ids, counts) in enumerate(piece_features(text.encode("utf-8", "surrogatepass")))]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["lang", "nth", "piece", "ids", "counts"])


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, where, most: int = SAMPLE_DOCS) -> list[tuple[str, list]]:
    """(lang, pieces) of ``most`` documents at most, as many of each language, and of LEAST_DOCS a language where there are more languages than that allows; the least by a hash of id and text over the whole table.

    Every language that a text has is learned. Their number is the model's width, so what comes to the driver is bounded by
    the model: a count a language, and texts as bucket counts, made where they lie, of the greater of ``most`` and
    LEAST_DOCS a language times MOST_PIECES * 2**BUCKET_BITS entries of four bytes, in practice by the sample's length.
    """
    text, label = F.col(text_col).cast("string"), F.col(label_col).cast("string")
    rows = docs.where(where & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(label.alias("lang")).count().collect()
    if not counts:
        return []
    each = max(LEAST_DOCS, most // len(counts))
    # A threshold of the hash lets about 1.2 * each rows of a language through to the exact choice. A row a language is less than the model, which travels too.
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.2 * max(each, 50) / r["count"]) * (1 << 30))) for r in counts], "lang string, below long")
    h = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), text), F.lit(1 << 30))
    rows = rows.select(label.alias("lang"), h.alias("h"), F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(limits), "lang").where(F.col("h") < F.col("below"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64(F.lit(12), F.col("id"), F.col("text"))))).where(F.col("nth") <= each)
    found = rows.select("lang", "nth", "text").mapInArrow(_features, "lang string, nth int, piece int, ids binary, counts binary").collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["nth"], r["lang"].encode(), r["piece"])):
        out.setdefault((r["nth"], r["lang"]), []).append((np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["counts"], np.uint16)))
    return [(lang, pieces) for (_, lang), pieces in out.items()]


def _predict(shared, n_keep: int, names: list[str]):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            n = batch.num_rows
            sums, counts = np.zeros((n, model.table.shape[1]), np.float64), np.zeros(n, np.int64)
            for first, last, data, offsets in byte_slices(batch.column(n_keep)):
                for buckets, owner in subwords(data, offsets):
                    if len(owner):
                        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                        rows = owner[at] + first
                        sums[rows] += np.add.reduceat(model.table[buckets], at, axis=0, dtype=np.float64)
                        counts[rows] += np.diff(np.concatenate((at, [len(owner)])))
            best, score = np.zeros(n, np.int64), np.zeros(n)
            step = max(1, LOGITS // len(model.langs))
            for at in range(0, n, step):
                part = slice(at, at + step)
                logits = sums[part] if model.out is None else sums[part] @ model.out
                z = (logits / np.maximum(counts[part], 1)[:, None] + model.bias) / model.temperature
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[part], score[part] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array([model.langs[i] for i in best], pa.string()), pa.array(score)], names)

    return run


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of each row of ``docs``, and lang_pred, score and rejected, from the whole text alone.

    lang_pred is the likeliest language of the model, ``und`` for a null text and one without a letter; those have score
    0 and are rejected. ``score`` is the probability after temperature scaling; ``rejected`` says that it is less than
    the model's threshold, calibrated on whole texts kept out of training for an error of TARGET_ERROR. Of equal
    probabilities the first language in code point order counts. Very long texts are taken slice by slice, whole; rows
    that repeat come back as often; an empty table gives an empty one. Result columns replace columns with their names.
    """
    bound_batches(docs.sparkSession)
    results = ["lang_pred", "score", "rejected"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    text = F.col(text_col).cast("string")
    rows = docs.select(*[F.col(c) for c in kept], F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"), text.alias("__text"))
    names = [*kept, "__letter", "__lang", "__score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "__lang string", "__score double"])
    found = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), len(kept) + 1, names), schema)
    score = F.when(F.col("__letter"), F.col("__score")).otherwise(F.lit(0.0))
    return found.select(*[F.col(c) for c in kept], F.when(F.col("__letter"), F.col("__lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), ((score < F.lit(model.reject_below)) | ~F.col("__letter")).alias("rejected"))


def fit(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int = SAMPLE_DOCS) -> Model:
    """Train on ``labelled_sample`` of the rows where ``where`` holds; equal tables give equal models. Without any labelled text, every text is ``und``."""
    rows = labelled_sample(docs, id_col, text_col, label_col, where, most)
    if not rows:
        return Model([UNKNOWN], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    return train(rows)


def op1(docs: DataFrame) -> DataFrame:
    """Fit on documents whose crc32(doc_id) mod 3 isn't 1 and predict all."""
    held_out = fold("doc_id", 3) == 1
    found = identify(docs, fit(docs, ~held_out), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
