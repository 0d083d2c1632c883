"""Text classifiers: logistic regression over hashed word n-grams, fitted by FTRL updates.

The learner keeps, for each coordinate, the sum of its gradients and of their squares; the rate of a
coordinate falls as it is met, and the L1 term holds weights of rare or useless features at exactly zero
(follow the regularised leader, proximal form). What is left is broadcast, and a score is a sparse dot product.

Fitting uses a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each label, those of the
least id hash, so the same on every run. Scoring covers every row and the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, fold, mix, pair_hash, slices, table
from quillspark.llm.wordhash import SPACE, column_hashes, hashes, raw

#: The bound of the training sample, for each label.
PER_CLASS = 4000
#: Weights are 2**BITS numbers while fitting, and those that aren't zero afterwards.
BITS = 20

#: Lower-cases A-Z and keeps letters, digits and bytes from 128 on; all else ends a word.
BARE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else SPACE for c in range(256)], np.uint8)
#: The kind of a letter (capital A, other a) or digit (0); punctuation stays.
SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else SPACE if chr(c) in " \t\n\x0b\x0c\r" else c for c in range(256)], np.uint8)


def shape_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of words whose runs of small letters are cut to one and runs of capitals to one mark, so that case and punctuation remain."""
    data, at = raw(texts)
    data = SHAPE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & ~first[1:-1] & ((data[1:] == 65) | (data[1:] == 97))
    led = np.zeros(len(data), bool)
    led[:-1] = again[1:] & (data[:-1] == 65)
    data[led] = 66
    kept = np.concatenate([[0], np.cumsum(~again)])
    return hashes(data[~again], kept[at])


def _grams(words: tuple[np.ndarray, np.ndarray], salt: int, n: int, skips: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document number, hash) of word 1- to n-grams, and of pairs of words with so many words between."""
    flat, size = words
    flat = mix(flat + np.uint64(salt))
    doc = np.repeat(np.arange(len(size)), size)
    out, run = [(doc, flat)], flat
    for k in range(1, n):
        if len(flat) <= k:
            break
        run = pair_hash(run[: len(flat) - k], flat[k:])
        inside = doc[k:] == doc[:-k]
        out.append((doc[k:][inside], run[inside]))
    for s in skips:
        if len(flat) > s + 1:
            inside = doc[s + 1 :] == doc[: -s - 1]
            out.append((doc[s + 1 :][inside], pair_hash(flat[: -s - 1], flat[s + 1 :] ^ np.uint64(s))[inside]))
    return out


def quality_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word 1- and 2-grams, of the words and of their shapes."""
    return _grams(column_hashes(texts, BARE), 1, 2) + _grams(shape_hashes(texts), 2, 2)


def toxicity_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word 1- and 2-grams, and pairs of words with one or two words between."""
    return _grams(column_hashes(texts, BARE), 3, 2, (1, 2))


def _hashed(features: Callable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = features(texts)
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)


def _extract(features: Callable):
    out = pa.schema([("label", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, index = _hashed(features, batch.column("text"))
                both = np.unique(doc.astype(np.uint64) << np.uint64(BITS) | index)
                cut = np.searchsorted(both >> np.uint64(BITS), np.arange(batch.num_rows + 1))
                low = (both & np.uint64((1 << BITS) - 1)).astype(np.uint32)
                rows = [low[cut[i] : cut[i + 1]].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], schema=out)

    return run


def ftrl(rows: list[tuple[float, np.ndarray]], alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, epochs: int = 4) -> tuple[np.ndarray, float]:
    """Weights (dense, mostly zero) and intercept of a logistic regression over sets of feature numbers.

    Classes count alike in total. Without rows of both labels the weights are zero and the intercept is the
    logit of the one label's share, smoothed.
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(y for y, _ in rows)
    if not 0 < ones < len(rows):
        return np.zeros(size, np.float32), float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    share = ones / len(rows)
    weight_of = {1: min(0.5 / share, 10.0), 0: min(0.5 / (1 - share), 10.0)}
    zb = nb = 0.0
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, idx = rows[i]
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = (p - y) * weight_of[int(y)]
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha))


class Model:
    """The weights that aren't zero, their positions, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.index = np.flatnonzero(weights).astype(np.uint32)
        self.value = weights[self.index]
        self.intercept = intercept


def fit(docs: DataFrame, labels: DataFrame, features: Callable, per_class: int = PER_CLASS, **rates: float) -> Model:
    """docs: ``doc_id``, ``text``. labels: ``doc_id``, ``label`` 0 or 1; null labels and ids with both labels don't count.

    Of documents that repeat an id the least text counts, once; null texts are empty. Other columns are ignored. Without a labelled
    document, as in an empty table, all weights are 0 and every score is one half. The sample is chosen from ids and labels alone (at most 2 * per_class ids, hence the broadcast), then only
    its texts are turned into features.
    """
    bounded_batches(docs.sparkSession)
    clean = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    chosen = [clean.where(f"label = {k}").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = chosen[0].union(chosen[1]).select("doc_id", F.col("label").cast("int").alias("label"))
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = sample.select("label", "text").mapInArrow(_extract(features), "label int, features binary").toLocalIterator()
    rows = sorted((float(r.label), bytes(r.features)) for r in got)  # in an order that no schedule changes
    return Model(*ftrl([(y, np.frombuffer(x, np.uint32)) for y, x in rows], **rates))


def _totals(features: Callable, weights: np.ndarray, intercept: float, batch: pa.RecordBatch) -> np.ndarray:
    """Log-odds of each text: the weights of its distinct features and the intercept."""
    doc, index = _hashed(features, batch.column("text"))
    use = weights[index] != 0
    both = np.unique(doc[use].astype(np.uint64) << np.uint64(BITS) | index[use])
    at = (both >> np.uint64(BITS)).astype(np.int64)
    return np.bincount(at, weights[(both & np.uint64((1 << BITS) - 1)).astype(np.int64)], batch.num_rows) + intercept


def _score(features: Callable, model, id_type: pa.DataType):
    out = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float64)
        weights[model.value.index] = model.value.value
        for whole in batches:
            for batch in slices(whole, "text"):
                total = _totals(features, weights, model.value.intercept, batch)
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=out)

    return run


def score(docs: DataFrame, model: Model, features: Callable, held_out: Column) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, repeated ones too; null texts score as empty ones, whose score is that of
    the intercept. An empty table gives no rows. Other columns are ignored, whatever their names."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_score(features, shared, pa.int64()), "doc_id long, held_out boolean, score double, predicted int")


QUALITY = {"alpha": 0.1, "l1": 1.0, "l2": 1.0}
TOXICITY = {"alpha": 1.0, "l1": 12.0, "l2": 1.0}


def fit_on(docs: DataFrame, labels: DataFrame, label: str, features: Callable, learns: Column, **rates: float) -> Model:
    """Fits on labelled ids that ``learns`` admits."""
    known = labels.select("doc_id", F.col(label).alias("label")).where(learns)
    return fit(docs.select("doc_id", "text"), known, features, **rates)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = fold(F.col("doc_id"), 3) == 1
    return score(docs, fit_on(docs, labels, "quality", quality_features, ~out, **QUALITY), quality_features, out)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = fold(F.col("doc_id"), 5) == 0
    return score(docs, fit_on(docs, labels, "toxic", toxicity_features, ~out, **TOXICITY), toxicity_features, out)


def _mark(features: Callable, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float64)
        weights[model.value.index] = model.value.value
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(_totals(features, weights, model.value.intercept, batch) < 0))

    return run


def keep_clean(docs: DataFrame, model: Model, features: Callable) -> DataFrame:
    """The rows of docs, whole, that score under 0.5: one pass, no shuffle. Null texts are scored as empty ones; each of repeated rows
    is scored; rows without an id and all other columns are kept as they are. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_mark(features, shared), docs.schema)
