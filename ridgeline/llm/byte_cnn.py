"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters over ``WIDTH`` neighbouring bytes (each byte has a learned vector) run along the whole document at a stride
of ``STRIDE``. The document is cut into overlapping chunks of ``2 * HALF`` bytes that start every ``HALF`` bytes; each
filter is max-pooled in each chunk, and the chunks are combined by their mean, maximum and minimum into one probability.
The minimum tells repetitive documents: where few different windows occur, most filters stay low.

Training uses a bounded sample of labelled rows (``most_rows``, those with the smallest hash of their id) and runs on the
driver; the model has some hundred kB. Scoring is one pass over the documents without a shuffle and keeps at most a few
segments of window values, however long a document is.

Defined results: null and empty texts are one empty chunk and get the model's score for it; equal texts get equal scores;
without labelled rows of both kinds every score is the share of label 1 (1.0 if there are no labels). Rows whose label is
null are not learned from. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ridgeline.llm.common import fresh, slices

WIDTH, STRIDE, HALF = 8, 2, 512
VECTOR, FILTERS = 8, 24
SEGMENT = 64  # halves scored at a time


@dataclass
class Model:
    vectors: np.ndarray  # (256, VECTOR)
    filters: np.ndarray  # (WIDTH, VECTOR, FILTERS)
    weights: np.ndarray  # (3, FILTERS): of the mean, maximum and minimum
    bias: float
    constant: float | None = None  # the score of every text, where nothing could be learned

    def tables(self) -> np.ndarray:
        """(WIDTH, 256, FILTERS): what a byte at a place adds to each filter."""
        return np.einsum("bv,wvf->wbf", self.vectors, self.filters).astype(np.float32)


def buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each closed with zero bytes up to a whole number of halves; and the number of halves of each."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts], dtype=np.int64)
    flat = b"".join([t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves, strict=True)])
    return np.frombuffer(flat, dtype=np.uint8), halves


def half_maxima(flat: np.ndarray, halves: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum in each half; with ``where`` also the byte offset of its window."""
    n, per = int(halves.sum()), HALF // STRIDE
    out = np.empty((n, tables.shape[2]), dtype=np.float32)
    place = np.empty(out.shape, dtype=np.int64) if where else None
    last = np.zeros(n, dtype=bool)
    last[np.cumsum(halves) - 1] = True
    over = -(-(WIDTH - STRIDE) // STRIDE)  # windows at the end of a half that reach into the next
    longer = np.concatenate((flat, np.zeros(WIDTH, dtype=np.uint8)))
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT)
        rows = (b - a) * per
        start = a * HALF
        values = tables[0][longer[start : start + rows * STRIDE : STRIDE]]
        for j in range(1, WIDTH):
            values += tables[j][longer[start + j : start + j + rows * STRIDE : STRIDE]]
        values = values.reshape(b - a, per, -1)
        values[last[a:b], per - over :] = -np.inf  # they would see the next document
        out[a:b] = values.max(axis=1)
        if where:
            place[a:b] = (np.arange(a, b)[:, None] * per + values.argmax(axis=1)) * STRIDE
    return out, place


def chunk_maxima(half: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks are two neighbouring halves (or a document's only one): maxima, chunks of each document, their two halves."""
    chunks = np.maximum(halves - 1, 1)
    first = np.cumsum(halves) - halves
    within = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    left = np.repeat(first, chunks) + within
    right = np.minimum(left + 1, np.repeat(first + halves - 1, chunks))
    return np.maximum(half[left], half[right]), chunks, left, right


def combine(chunk: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """(documents, 3, FILTERS)"""
    at = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(chunk, at, axis=0, dtype=np.float64) / chunks[:, None]
    return np.stack([mean, np.maximum.reduceat(chunk, at, axis=0), np.minimum.reduceat(chunk, at, axis=0)], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(model: Model, tables: np.ndarray, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant or 0.0)
    flat, halves = buffer([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    chunk, chunks, _, _ = chunk_maxima(half_maxima(flat, halves, tables)[0], halves)
    return logistic((combine(chunk, chunks) * model.weights).sum((1, 2)) + model.bias)


def train(texts: list[str | None], labels: list[int], epochs: int = 10, batch: int = 48, rate: float = 0.02, decay: float = 1e-4, least_steps: int = 250, seed: int = 11) -> Model:
    """Fit by Adam on the logistic loss; the rarer label's rows weigh up to three times as much.

    Small samples are gone through more often, until there are ``least_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((256, VECTOR)), np.zeros((WIDTH, VECTOR, FILTERS)), np.zeros((3, FILTERS)), 0.0, float(y.mean()) if len(y) else 1.0)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    share = y.mean()
    weigh = np.where(y == 1, 1.0, min(3.0, share / (1 - share))) if share > 0.5 else np.where(y == 0, 1.0, min(3.0, (1 - share) / share))
    values = {
        "vectors": rng.normal(size=(256, VECTOR)), "filters": rng.normal(size=(WIDTH, VECTOR, FILTERS)) / np.sqrt(WIDTH * VECTOR),
        "weights": rng.normal(size=(3, FILTERS)) * 0.05, "bias": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    step = 0
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            model = Model(values["vectors"], values["filters"], values["weights"], float(values["bias"][0]))
            slopes = gradient(model, [raw[k] for k in rows], y[rows], weigh[rows])
            step += 1
            speed = rate * (1 - 0.9 * step / total)
            for k, v in values.items():
                g = slopes[k] + decay * v
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                v -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(values["vectors"], values["filters"], values["weights"], float(values["bias"][0]))


def gradient(model: Model, raw: list[bytes], y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean weighted loss of a batch."""
    tables = model.tables()
    flat, halves = buffer(raw)
    half, place = half_maxima(flat, halves, tables, where=True)
    chunk, chunks, left, right = chunk_maxima(half, halves)
    pooled = combine(chunk, chunks)
    off = (logistic((pooled * model.weights).sum((1, 2)) + model.bias) - y) * weigh / len(y)
    slopes = {"weights": np.einsum("n,nkf->kf", off, pooled), "bias": np.array([off.sum()])}
    per = np.repeat(off, chunks)[:, None]
    down = per * model.weights[0] / np.repeat(chunks, chunks)[:, None]
    at = np.cumsum(chunks) - chunks
    for k in (1, 2):  # ties share
        same = chunk == np.repeat(pooled[:, k], chunks, axis=0)
        down = down + per * model.weights[k] * same / np.repeat(np.add.reduceat(same, at, axis=0, dtype=np.int64), chunks, axis=0)
    to_half = np.zeros(half.shape)
    is_left = half[left] >= half[right]
    np.add.at(to_half, left, down * is_left)
    np.add.at(to_half, right, down * ~is_left)
    table_slopes = np.empty(tables.shape)
    n_filters = tables.shape[2]
    longer = np.concatenate((flat, np.zeros(WIDTH, dtype=np.uint8)))
    for j in range(WIDTH):
        cell = longer[place + j].astype(np.int64) * n_filters + np.arange(n_filters)
        table_slopes[j] = np.bincount(cell.ravel(), weights=to_half.ravel(), minlength=256 * n_filters).reshape(256, n_filters)
    slopes["filters"] = np.einsum("bv,wbf->wvf", model.vectors, table_slopes)
    slopes["vectors"] = np.einsum("wbf,wvf->bv", table_slopes, model.filters)
    return slopes


#: The sample's rows, and the bytes of a text that is learned from; longer labelled texts aren't learned from, but are scored whole.
MOST_ROWS, MOST_BYTES = 2500, 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: F.Column, most_rows: int = MOST_ROWS) -> tuple[list[str | None], list[int]]:
    """At most ``most_rows`` labelled texts for which ``learn`` holds, those with the smallest hash of their id, of ``MOST_BYTES`` at most."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = labels.select(id_col, F.col(label_col).cast("int").alias("_label")).where(learn & F.col("_label").isNotNull()).distinct().orderBy(order, "_label").limit(most_rows)
    short = docs.select(id_col, text_col).where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= MOST_BYTES)
    rows = short.join(F.broadcast(picked), id_col).orderBy(order, text_col).limit(most_rows).collect()  # both sides bounded
    return [r[text_col] for r in rows], [r["_label"] for r in rows]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model learned from labelled rows that are not held out."""
    texts, known = labelled_sample(docs, labels, id_col, text_col, label_col, ~held_out(id_col), most_rows)
    return train(texts, known)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """The given columns of the documents (all if not given), and the score."""
    keep = [c for c in (columns or docs.columns) if c.lower() != name]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(name, DoubleType())])
    tables = model.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                scores = score(model, tables, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, name])

    return docs.select(*keep, F.col(text_col).alias(fresh(keep, "_scored"))).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The documents, in their own columns, that a model learned from the labels doesn't reject."""
    name = fresh(docs.columns, "_quality_score")
    return with_score(docs, fit(docs, labels, id_col, text_col, label_col), text_col, name=name).where(F.col(name) >= threshold).select(*docs.columns)
