"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other signs. Each falls into one of BUCKETS rows by its
hash. A row has a sparse random index vector, and its word vector is that plus the index vectors of its neighbours within
REACH tokens, summed over the training texts and weighted by rarity. A document is the mean of its tokens' vectors, joined
by the mean vector of their shapes (case and length, or that they repeat the token before), which are indexed alike. A network with one hidden layer, trained by
Adam, gives a logit; a temperature fitted on training rows set apart makes it a probability.

The model is fitted by one task, so that the driver holds neither texts nor what the fit needs, from at most MAX_PER_CLASS labelled documents of each class (the first by md5 of the id, one text of each id,
as long as they have no more than MAX_FIT_CHARS code points together, so that the sample's bytes are bounded too), weighted back to the classes' counts among all labelled rows; its size is fixed by the parameters here. Scoring is one map
over all rows and whole texts. Neither labels nor lang, source and doc_id are inputs.

Defined cases: a null or empty text is scored as a document without tokens; labels that are null or neither 0 nor 1 are
left out, of an id's repeated labels the smaller counts and of its repeated texts the one of the least SHA-256; a text
that would exceed the sample's bound is left out of the fit, with those after it; without both labels the score is their share (0.5 without any);
repeated rows are scored each; clashing extra columns are passed through by keep_good and ignored elsewhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import fold, free_name, give_back, small_batches

BUCKETS = 1 << 15
DIMENSIONS = 48
NONZERO = 4
REACH = 2
HIDDEN = 32
EPOCHS = 250
MAX_PER_CLASS = 3000
MAX_FIT_CHARS = 60_000_000
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = np.where(tk.WORDS, 1, np.where(tk.SOLID, 2, 0)).astype(np.uint8)
_CLASSES[0x41:0x5B] = 1
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
SHAPES = 32


class Pieces(NamedTuple):
    rows: np.ndarray
    shapes: np.ndarray
    bounds: np.ndarray


def pieces(column: pa.Array) -> Pieces:
    data, offsets = tk.text_bytes(column)
    tokens = tk.tokenize(data, offsets, _CLASSES, tk.FOLDED)
    if not len(tokens.start):
        return Pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), tokens.bounds)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[data], dtype=np.int32)))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int32)))
    length = tokens.end - tokens.start
    high, numeric = (x[tokens.end] - x[tokens.start] for x in (capitals, digits))
    first = _CAPITAL[data[tokens.start]]
    case = np.select([numeric == length, high == 0, (high > 1) & (high * 2 >= length), (high == 1) & first], [4, 0, 2, 1], 3)
    size = np.searchsorted([2, 4, 7, 11], length, "right")
    shapes = np.where(_CLASSES[data[tokens.start]] == 1, case * 5 + size, 24 + np.minimum(length, 6))
    again = np.flatnonzero(tokens.hash[1:] == tokens.hash[:-1]) + 1
    shapes[again[~np.isin(again, tokens.bounds)]] = SHAPES - 1
    return Pieces((tokens.hash & np.uint64(BUCKETS - 1)).astype(np.int64), shapes, tokens.bounds)


def _sums(rows: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Per document the sum of its tokens' vectors, a block of tokens at a time."""
    out = np.zeros((len(bounds) - 1, vectors.shape[1]), np.float64)
    for a in range(0, len(rows), block):
        b = min(a + block, len(rows))
        first = int(np.searchsorted(bounds, a, "right")) - 1
        last = int(np.searchsorted(bounds, b, "left")) - 1
        starts = np.maximum(bounds[first : last + 1], a) - a
        full = bounds[first + 1 : last + 2] > bounds[first : last + 1]
        out[first : last + 1][full] += np.add.reduceat(vectors[rows[a:b]], starts[full], axis=0)
    return out


class Model(NamedTuple):
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    constant: float | None

    def features(self, p: Pieces) -> np.ndarray:
        n = np.diff(p.bounds)
        divisor = np.maximum(n, 1)[:, None]
        doc = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(doc * SHAPES + p.shapes, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        return np.hstack((_sums(p.rows, p.bounds, self.words) / divisor, counts @ self.shapes / divisor, np.log1p(n)[:, None]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, p: Pieces) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(p.bounds) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(p)) / self.temperature, -40, 40)))


def _index_vectors(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    return rng.integers(0, DIMENSIONS, (n, NONZERO)), rng.choice((-1.0, 1.0), (n, NONZERO))


def _random_indexing(parts: Iterator[tuple[np.ndarray, np.ndarray]], n: int, rng: np.random.Generator) -> np.ndarray:
    """Word vectors from (rows, bounds) of chunks: own index vector plus the mean of the neighbours', weighted by rarity."""
    place, sign = _index_vectors(n, rng)
    own = np.zeros((n, DIMENSIONS))
    np.add.at(own, (np.repeat(np.arange(n), NONZERO), place.ravel()), sign.ravel())
    context, seen, counts = np.zeros(n * DIMENSIONS), np.zeros(n), np.zeros(n)
    for rows, bounds in parts:
        counts += np.bincount(rows, minlength=n)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for step in range(1, REACH + 1):
            same = doc[step:] == doc[:-step]
            for one, other in ((rows[step:][same], rows[:-step][same]), (rows[:-step][same], rows[step:][same])):
                seen += np.bincount(one, minlength=n)
                for k in range(NONZERO):
                    context += np.bincount(one * DIMENSIONS + place[other, k], weights=sign[other, k], minlength=n * DIMENSIONS)
    context = context.reshape(n, DIMENSIONS) / np.maximum(seen, 1)[:, None]
    return ((own + context) * (1e-3 / (1e-3 + counts / max(1, counts.sum())))[:, None]).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, shares: tuple[float, float], seed: int = 7) -> Model:
    """shares: the classes' shares among all labelled rows. Every tenth training row is for the temperature alone."""
    rng = np.random.default_rng(seed)
    empty = np.zeros(0)
    if len(set(labels.tolist())) < 2:
        return Model(empty, empty, empty, empty, (), 1.0, float(shares[1]))
    chunks = list(tk.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"))
    shapes = _random_indexing(((p.shapes, p.bounds) for p in map(pieces, (c.column(0) for c in chunks))), SHAPES, rng)
    words = _random_indexing(((p.rows, p.bounds) for p in map(pieces, (c.column(0) for c in chunks))), BUCKETS, rng)
    model = Model(words, shapes, 0.0, 1.0, (), 1.0, None)
    x = np.vstack([model.features(pieces(c.column(0))) for c in chunks])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    model = model._replace(mean=mean, scale=scale)
    y = labels.astype(float)
    weight = np.where(y == 1, shares[1] / max(y.mean(), 1e-9), shares[0] / max(1 - y.mean(), 1e-9))
    apart = np.arange(len(y)) % 10 == 9
    if len(set(labels[~apart].tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    z = np.clip((x - mean) / scale, -8, 8)
    layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step, train = 0, np.flatnonzero(~apart)
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), 512):
            rows = order[at : at + 512]
            step += 1
            h = np.tanh(z[rows] @ layers[0] + layers[1])
            out = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
            d = (out - y[rows]) * weight[rows] / len(rows)
            dh = np.outer(d, layers[2]) * (1 - h * h)
            for i, g in enumerate((z[rows].T @ dh + 1e-4 * layers[0], dh.sum(0), h.T @ d + 1e-4 * layers[2], d.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = model._replace(layers=tuple(layers))
    held = apart if apart.any() else np.ones(len(y), bool)
    logits = model.logits(x[held])
    heats = np.geomspace(0.25, 8, 41)
    losses = [np.sum(weight[held] * np.logaddexp(0, -(2 * y[held] - 1) * logits / t)) for t in heats]
    return model._replace(temperature=float(heats[int(np.argmin(losses))]))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, tuple[float, float]]:
    """The texts to fit on (text, quality) in one partition and in order, if there are labels, and the classes' shares."""
    small_batches(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(fold("doc_id", FOLDS) != 0)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total) if total else (0.5, 0.5)
    place = F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(place, "doc_id").limit(MAX_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.collect()  # at most 2 * MAX_PER_CLASS ids
    if not ids:
        return None, shares
    keys = docs.sparkSession.createDataFrame(ids, chosen.schema)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")
    texts = texts.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    texts = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "quality"), "digest").alias("one")).select("doc_id", "one.text", "one.quality")
    before = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the sample alone
    texts = texts.withColumn("place", place).withColumn("chars", F.sum(F.length("text")).over(before)).where(F.col("chars") <= MAX_FIT_CHARS)
    return texts.coalesce(1).sortWithinPartitions("place", "doc_id").select("text", "quality"), shares


def _fit_table(found: pa.Table, shares: tuple[float, float]) -> Model:
    return fit(found.column("text").combine_chunks(), np.asarray(found.column("quality").to_numpy(), int), shares)


_SAMPLE = pa.schema([("text", pa.string()), ("quality", pa.int32())])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, fitted in this process."""
    texts, shares = sample(docs, labels)
    return _fit_table(_SAMPLE.empty_table() if texts is None else texts.toArrow(), shares)


def train_by_task(docs: DataFrame, labels: DataFrame) -> Model:
    """The same model, fitted by a task: the driver gets no texts and holds nothing of what the fit needs."""
    texts, shares = sample(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fit_table(pa.Table.from_batches(batches, _SAMPLE), shares)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = [] if texts is None else texts.mapInArrow(run, "model binary").collect()
    give_back(docs.sparkSession)
    return pickle.loads(found[0]["model"]) if found else _fit_table(_SAMPLE.empty_table(), shares)


def annotate(docs: DataFrame, model: Model, columns: list[str]) -> tuple[DataFrame, str]:
    """The given columns of docs (text among them) with a score; and the name of that column."""
    spark = docs.sparkSession
    small_batches(spark)
    fixed, name = spark.sparkContext.broadcast(model), free_name(columns, "score")
    rows, at = docs.select(*[F.col(f"`{c}`") for c in columns]), columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                scores = pa.array(fixed.value.score(pieces(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    ddl = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns] + [f"`{name}` double"])
    return rows.mapInArrow(run, ddl), name


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = train_by_task(docs, labels)
    found, name = annotate(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, ["doc_id", "text"])
    return found.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    found, name = annotate(docs, train_by_task(docs, labels), docs.columns)
    return found.where(F.col(name) >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
