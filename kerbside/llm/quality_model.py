"""Quality classifier on random-indexing word vectors.

1. Random indexing over all documents: a word's index vector has ``NONZERO`` ±1
   entries drawn from its hash; its context vector (one row per hash bucket) sums
   the index vectors of its neighbours.  A task adds up its own table; the tables
   (fixed size, whatever the corpus) are summed slice by slice in a shuffle.
   Words are runs of letters, lower-cased, and runs of other visible characters;
   each also counts as its shape (lower, Capital, CAPITALS, digits, marks, …),
   a word like any other, so unseen words still have a known vector.
2. A document's vector is the mean and the spread of its words' unit vectors.
3. A two-layer numpy network is fitted on at most ``SAMPLE`` labelled documents
   outside the held-out fold (smallest hash of the id first); a fifth of them only
   sets the temperature that calibrates the probabilities.

Defined results: null and empty texts have the zero vector and get a score like
any other; null labels are not learned from; with no labels, or only one class,
every score is that class's share (0.5 without labels); repeated rows and null
ids are scored row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import learn_fold, mix64, read_table, text_chunks, word_hashes

BUCKETS, DIM, NONZERO, SHAPES = 8192, 32, 4, 8
#: Most labelled documents the network is fitted on.
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 32, 40, 7
_CHUNK = 1 << 20
_SLICES = 16

_KIND = np.full(256, 3, dtype=np.uint8)  # 0 blank, 1 letter, 2 digit, 3 mark
_KIND[9:14] = 0
_KIND[32] = 0
_KIND[65:91] = 1
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_NEVER = np.zeros(256, dtype=bool)
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shapes, and each text's first word (n + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[data]
    new = np.empty(len(data), dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[offs[(offs > 0) & (offs < len(data))]] = True
    run = np.flatnonzero(new)
    end = np.append(run[1:], len(data))
    solid = kind[run] != 0
    upper = np.add.reduceat(_UPPER[data], run)[solid]
    hashes = word_hashes(data, run, end, True, _NEVER)[solid]
    run, end = run[solid], end[solid]
    k, n, first = kind[run], end - run, _UPPER[data[run]]
    shape = np.where(k == 1, np.where(upper == 0, 0, np.where((upper * 2 > n) & (n > 1), 2, np.where((first == 1) & (upper == 1), 1, 3))),
                     np.where(k == 2, 4, np.where(n == 1, 5, np.where(n == 2, 6, 7))))
    return hashes, shape, np.searchsorted(run, offs)


def _index_entries(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each nonzero entry of the index vectors."""
    h = mix64(h)
    out = []
    for i in range(NONZERO):
        part = h >> np.uint64(12 * i)
        out.append(((part & np.uint64(DIM - 1)).astype(np.int64), 1.0 - 2.0 * ((part >> np.uint64(8)) & np.uint64(1)).astype(np.float64)))
    return out


def _rows(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xABCDEF12345)) % np.uint64(BUCKETS)).astype(np.int64)


def _context(batches):
    """texts → this task's context table, in slices."""
    table = np.zeros((BUCKETS + SHAPES) * DIM)
    used = False
    shape_hash = mix64(np.arange(900, 900 + SHAPES, dtype=np.uint64))
    for batch in batches:
        for _, data, offs in text_chunks(batch.column(0), _CHUNK):
            h, shape, first = units(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            if not len(pair):
                continue
            used = True
            word, form = _rows(h) * DIM, (BUCKETS + shape) * DIM
            for entries in (_index_entries(h), [(d[shape], s[shape]) for d, s in _index_entries(shape_hash)]):
                for dim, sign in entries:
                    for here, there in ((pair, pair + 1), (pair + 1, pair)):
                        table += np.bincount(word[here] + dim[there], weights=sign[there], minlength=len(table))
                        table += np.bincount(form[here] + dim[there], weights=sign[there], minlength=len(table))
    if used:
        for k, part in enumerate(np.array_split(table, _SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary())], names=["slice", "part"])


def _add(t: pa.Table) -> pa.Table:
    total = None
    for x in t["part"]:
        v = np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
        total = v if total is None else total + v
    return pa.table({"slice": [t["slice"][0].as_py()], "part": [total.astype("<f8").tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("part", pa.binary())]))


def context_vectors(texts: DataFrame) -> np.ndarray:
    """``texts(text)`` → unit context vectors, (BUCKETS + SHAPES, DIM)."""
    tables = texts.select("text").mapInArrow(_context, "slice int, part binary")
    # tables are summed in two rounds, so that no task gets one slice of every task
    salted = tables.withColumn("salt", F.spark_partition_id() % 32)
    once = salted.groupBy("slice", "salt").applyInArrow(lambda t: _add(t.drop_columns(["salt"])), "slice int, part binary")
    once = once.withColumn("part", F.col("part"))
    parts = {r["slice"]: r["part"] for r in once.groupBy("slice").applyInArrow(_add8, "slice int, part binary").collect()}  # _SLICES rows
    if not parts:
        return np.zeros((BUCKETS + SHAPES, DIM), dtype=np.float32)
    table = np.concatenate([np.frombuffer(parts[k], "<f8") for k in range(_SLICES)]).reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def _add8(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in t["part"])
    return pa.table({"slice": [t["slice"][0].as_py()], "part": [total.astype("<f8").tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("part", pa.binary())]))


def document_vectors(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(rows, 2 · DIM): mean and spread of the words' vectors (word plus shape)."""
    out = np.zeros((len(column), 2 * DIM), dtype=np.float64)
    for row, data, offs in text_chunks(column, _CHUNK):
        h, shape, first = units(data, offs)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        step = 1 << 18  # words at once: bounds the memory of a very long text
        for a in range(0, len(h), step):
            v = vectors[_rows(h[a:a + step])] + vectors[BUCKETS + shape[a:a + step]]
            own = doc[a:a + step]
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[row + own[at], :DIM] += np.add.reduceat(v, at, axis=0)
            out[row + own[at], DIM:] += np.add.reduceat(v * v, at, axis=0)
        n = np.maximum(1, np.diff(first))[:, None]
        own = out[row: row + len(offs) - 1]
        own /= n
        own[:, DIM:] = np.sqrt(np.maximum(0, own[:, DIM:] - own[:, :DIM] ** 2))
    return out


class Network:
    """Two layers (tanh, logistic) on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.constant = None
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(y))
        fit, cal = order[len(y) // 5:], order[: len(y) // 5]
        z = (x - self.mean) / self.std
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                b = fit[i:i + 128]
                hid = np.tanh(z[b] @ w[0] + w[1])
                err = (1 / (1 + np.exp(-(hid @ w[2] + w[3]))) - y[b]) / len(b)
                back = np.outer(err, w[2]) * (1 - hid ** 2)
                grads = [z[b].T @ back + 1e-4 * w[0], back.sum(axis=0), hid.T @ err + 1e-4 * w[2], err.sum(keepdims=True)]
                t += 1
                for p, g, mm, vv in zip(w, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= 0.003 * (mm / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.999 ** t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logits = self._logits(x[cal])
        loss = lambda k: np.mean(np.logaddexp(0, np.where(y[cal] > 0, -1, 1) * logits / k))
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -50, 50)))


def _features(shared):
    def run(batches):
        for batch in batches:
            x = document_vectors(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _score(shared):
    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            s = net.score(document_vectors(batch.column(2), vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.3).astype(np.int32))],
                                             names=["id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             folds: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), (learn_fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))
    vectors = context_vectors(rows)
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
                   .filter(learn_fold("id", folds) != held).groupBy("id").agg(F.max("label").alias("label"))
                   .orderBy(F.xxhash64("id"), "id").limit(sample))
    shared = sc.broadcast(vectors)
    # one row of each id, so at most `sample` rows
    one = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = one.select("label", "text").mapInArrow(_features(shared), "label int, x array<double>").collect()
    got.sort(key=lambda r: (r["label"], r["x"]))
    net = Network(np.array([r["x"] for r in got]).reshape(len(got), 2 * DIM), np.array([r["label"] for r in got], dtype=np.float64))
    both = sc.broadcast((vectors, net))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(both), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
