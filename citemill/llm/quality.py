"""Operator 7, a quality classifier over random-indexing word vectors.

Random indexing: each of `BUCKETS` word buckets (hashed lower-cased words) has a fixed sparse random
index vector; a bucket's context vector is the sum of the index vectors of the words around it, within
`WINDOW` places, over all documents. Words as they are written are a second vocabulary, by their form (letter
case, punctuation, digits, length, and whether the word repeats one of the two before it), with context
vectors from the forms around them, about their mean. A document's vector is the mean of its words' context
vectors at unit length in both vocabularies; nothing else goes into the network. All words of all documents
are counted; each task passes on one table of fixed size.

The network has one hidden layer and one output, in numpy; it learns from at most `SAMPLE` labelled
documents of the table, those of the smallest hash, and a fifth of them sets the temperature that calibrates its
probabilities. Labels, languages, sources and ids are never inputs of a score. Every whole text of the
table is scored.

Null, empty and blank texts have the zero vector and the network's score of it. A null doc_id is scored
but never learned from. Repeated rows have equal scores. Without labels of both kinds every score is
0.5, and an empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import textkernel as tk
from citemill.llm.rows import row_key, without
from citemill.runtime import materialize, table

BUCKETS, DIMS, FILLED, WINDOW = 1 << 14, 32, 4, 2
FORMS, FORM_DIMS = 1024, 64
SAMPLE, HIDDEN, EPOCHS, RATE = 20_000, 32, 40, 0.003
#: A document is of high quality from this probability on; the filter rejects below `REJECT`.
PREDICT, REJECT = 0.7, 0.3
#: Blocks that a task's table is sent in, and streams that each block is added up in first.
BLOCKS, STREAMS = 16, 32
WIDTH = DIMS + FORM_DIMS
WORD_PART = BUCKETS * DIMS


def _random_index(rows: int, dims: int, filled: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the filled components of fixed random index vectors."""
    rng = np.random.default_rng(seed)
    return rng.random((rows, dims)).argsort(1)[:, :filled], rng.choice([-1.0, 1.0], (rows, filled))


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word buckets, row of each word, form of each word) for pieces of a column."""
    for i, j, data, offs in tk.chunks(column):
        h, doc, start, end = tk.words(data, offs)
        if not len(h):
            yield i, j, h.astype(np.int64), doc, doc
            continue
        kinds = [(data >= 65) & (data <= 90), ((data >= 97) & (data <= 122)) | (data >= 128), (data >= 48) & (data <= 57)]
        sums = [np.concatenate(([0], np.cumsum(k))) for k in kinds]
        upper, lower, digit = (s[end] - s[start] for s in sums)
        size = end - start
        marks = size - upper - lower - digit
        case = np.where(upper == 0, 0, np.where(lower > 0, np.where(upper == 1, 1, 2), 3))
        mark = np.where(marks == size, 3, np.minimum(marks, 2))
        repeats = np.zeros(len(h), np.int64)
        repeats[1:] |= (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        repeats[2:] |= ((h[2:] == h[:-2]) & (doc[2:] == doc[:-2])) << 1
        length = np.searchsorted([3, 6, 10, 20, 60], size)
        form = ((((case * 4 + mark) * 2 + (digit > 0)) * 6 + length) * 4 + repeats) % FORMS
        yield i, j, (h >> tk.U(64 - 14)).astype(np.int64), doc, form


def _form_index() -> np.ndarray:
    places, signs = _random_index(FORMS, FORM_DIMS, FILLED, 2)
    out = np.zeros((FORMS, FORM_DIMS))
    np.put_along_axis(out, places, signs, 1)
    return out


def context_tables(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The context vectors of all buckets and of all forms, from all words of `docs`."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _random_index(BUCKETS, DIMS, FILLED, 1)
        total, beside, uses = np.zeros(WORD_PART), np.zeros(FORMS * FORMS), np.zeros(FORMS)
        for batch in batches:
            for _, _, w, doc, form in _words(batch.column(0)):
                uses += np.bincount(form, minlength=FORMS)
                for gap in range(1, WINDOW + 1):
                    same = doc[gap:] == doc[:-gap]
                    left, right = w[:-gap][same], w[gap:][same]
                    beside += np.bincount(form[:-gap][same] * FORMS + form[gap:][same], minlength=len(beside))
                    for at, near in ((left, right), (right, left)):
                        for f in range(FILLED):
                            total += np.bincount(at * DIMS + places[near, f], signs[near, f], len(total))
        if uses.any():
            beside = beside.reshape(FORMS, FORMS)
            forms = (beside + beside.T) @ _form_index()
            yield _blocks(dict(enumerate(np.concatenate((total, forms.ravel(), uses)).reshape(BLOCKS, -1))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(part)
        yield _blocks(sums)

    kind = "block int, part binary"
    found = docs.select("text").mapInArrow(gather, kind)
    found = found.withColumn("stream", F.monotonically_increasing_id() % STREAMS).repartition("block", "stream").drop("stream").mapInArrow(add, kind)
    size = WORD_PART + FORMS * FORM_DIMS + FORMS
    table_ = np.zeros((BLOCKS, size // BLOCKS))
    for block, part in found.repartition("block").mapInArrow(add, kind).collect():  # BLOCKS rows, 5 MB in all
        table_[block] += np.frombuffer(part)
    words, forms, uses = np.split(table_.ravel(), [WORD_PART, size - FORMS])
    forms = forms.reshape(FORMS, FORM_DIMS) / np.maximum(uses, 1)[:, None]
    forms -= uses @ forms / max(uses.sum(), 1)
    return _unit(words.reshape(BUCKETS, DIMS)), _unit(forms)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def _blocks(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], names=["block", "part"]
    )


def document_vectors(docs: DataFrame, contexts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, row (its key) and vector (32-bit floats) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for i, j, w, doc, form in _words(batch.column(2)):
                m = j - i
                count = np.bincount(doc, minlength=m)
                out = np.zeros((m, WIDTH), np.float32)
                full = count > 0
                begin = (np.cumsum(count) - count)[full]
                if len(w):
                    out[full, :DIMS] = np.add.reduceat(tables[0][w], begin, axis=0)
                    if m * FORMS < 1 << 22:  # the same sums by counts, where they fit
                        uses = np.bincount(doc * FORMS + form, minlength=m * FORMS).reshape(m, FORMS)
                        out[full, DIMS:] = uses[full] @ tables[1]
                    else:
                        out[full, DIMS:] = np.add.reduceat(tables[1][form], begin, axis=0)
                    out[full] /= count[full, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, m), batch.column(1).slice(i, m), pa.array([x.tobytes() for x in out], pa.binary())],
                    names=["doc_id", "row", "vector"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row binary, vector binary")


class Network:
    """A two-layer network with a calibrated output; trained with Adam on the weighted log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.center) / self.scale
        held = max(1, len(x) // 5)
        tx, ty, vx, vy = x[held:], y[held:], x[:held], y[:held]
        n = x.shape[1]
        w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(tx)), max(1, len(tx) // 256)):
                hidden = np.tanh(tx[at] @ w[0] + w[1])
                slip = (self._sigmoid(hidden @ w[2] + w[3]) - ty[at]) / max(1, len(at))
                back = np.outer(slip, w[2]) * (1 - hidden**2)
                grads = [tx[at].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ slip + 1e-4 * w[2], slip.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        logits = self._logits(vx)
        loss = [(self._loss(logits / t, vy), t) for t in np.exp(np.linspace(-1.5, 2.5, 81))]
        self.temperature = min(loss)[1]

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    @staticmethod
    def _loss(z: np.ndarray, y: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).mean())

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._logits((x - self.center) / self.scale) / self.temperature)


def remainder(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % modulus


def quality_scores(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, row (its key) and score of every row of `docs`; `labels` (doc_id, quality) teaches, where `learn_from` holds."""
    vectors = materialize(document_vectors(docs, context_tables(docs)), "vectors")
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    if learn_from is not None:
        known = known.where(learn_from)
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("quality")).cast("binary"))
    chosen = known.join(vectors.select("doc_id"), "doc_id", "left_semi").orderBy(order, "quality").limit(sample)
    rows = vectors.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "vector")  # `sample` ids at most
    met = rows.orderBy(order, "quality", "vector").limit(sample).toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in met["vector"]]).reshape(-1, WIDTH)
    y = met["quality"].to_numpy()
    net = Network(x, y) if len(set(y)) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(v, np.float32) for v in batch.column(2).to_pylist()]).reshape(-1, WIDTH)
            score = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "row", "score"])

    return vectors.mapInArrow(run, "doc_id long, row binary, score double")


def without_rejected(docs: DataFrame, labels: DataFrame, least: float = REJECT) -> DataFrame:
    """The rows of `docs` whose score, learned from all labels, is at least `least`."""
    low = quality_scores(docs, labels).where(F.col("score") < least)
    return without(docs, materialize(low.select("row").distinct(), "rejected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`; learned from labels whose crc32(doc_id) modulo 4 isn't 2."""
    learn = remainder(F.col("doc_id"), 4) != 2
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
