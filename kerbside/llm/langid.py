"""Language identification with language-bitmask Bloom filters.

Learning counts the letter 3-grams of every learning document per language
(exact counts, one aggregate); a language keeps the n-grams that make up at least
``MIN_RATE`` of its own, so at most 1 / MIN_RATE of them whatever the corpus size.
They go into one bit-sliced Bloom filter: a cell holds one bit per language, an
n-gram sets its language's bit in ``HASHES`` cells, and the AND of an n-gram's
cells is the mask of all languages that contain it — one lookup for all languages.

A document's hits per language are the popcounts of its masks in each bit;
with fill f of a language's bit plane the chance of a false hit is f^HASHES, and
(hits − n·fp) / (1 − fp) corrects for it.  The largest corrected count decides;
``score`` is its share of all languages' counts.

Defined results: a null text or one without a letter is ``und`` with score 0; a
text without a known n-gram gets the language with most learned text, score 0;
with nothing to learn from every answer is ``und``.  Rows are independent, so
null ids, repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import learn_fold, mix64, read_table

MIN_RATE = 5e-5
HASHES = 3
CELLS_PER_KEY = 16
#: Characters handled at once inside a task.
CHUNK_CHARS = 2 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 3-grams of the texts (letters in lower case, any run of other
    characters and the text's ends as one blank) and each text's first (n + 1)."""
    low = [" " + t.lower() + " " for t in texts]
    lens = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    doc = np.repeat(np.arange(len(low)), lens)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    begin = np.cumsum(lens) - lens
    keep[begin] = True
    # a blank right after a text's opening blank would double it
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    doc = doc[keep]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    grams = codes[:-2] | codes[1:-1] << np.uint64(21) | codes[2:] << np.uint64(42)
    fine = doc[:-2] == doc[2:]
    return grams[fine], np.searchsorted(doc[:-2][fine], np.arange(len(texts) + 1))


def _runs(texts: list[str | None]):
    """(first row, texts) in runs of about CHUNK_CHARS characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


def _count(batches):
    """(lang, text) → (lang, gram, n), one row per distinct pair and task (or 1M-row flush)."""
    table: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def merged(parts):
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, at = np.unique(g, return_inverse=True)
        return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

    def rows():
        for lang, (g, n) in table.items():
            for i in range(0, len(g), 1 << 16):
                part = g[i: i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(n[i: i + (1 << 16)])],
                                                 names=["lang", "gram", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, t in zip(langs, texts):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            for _, part in _runs(own):
                u, n = np.unique(ngrams(part)[0], return_counts=True)
                table[lang] = merged([table[lang], (u, n)]) if lang in table else (u, n)
        if sum(len(g) for g, _ in table.values()) > 1_000_000:
            yield from rows()
            table.clear()
    yield from rows()


def _places(grams: np.ndarray, cells: int) -> list[np.ndarray]:
    h = mix64(grams)
    step = mix64(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)]


class Filter:
    """Bit-sliced Bloom filter: ``cells[c, w]`` holds 64 languages' bits."""

    def __init__(self, langs: list[str], weights: list[int], keys: list[np.ndarray]):
        self.langs, self.best = langs, int(np.argmax(weights)) if langs else -1
        distinct = len(np.unique(np.concatenate(keys))) if keys else 0
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, distinct * CELLS_PER_KEY)))))
        self.cells = np.zeros((max(1, -(-len(langs) // 64)), self.size), dtype=np.uint64)
        for k, own in enumerate(keys):
            for at in _places(own, self.size):
                plane = self.cells[k // 64]
                plane[at] |= np.uint64(1) << np.uint64(k % 64)
        fill = [float(np.mean((self.cells[k // 64] >> np.uint64(k % 64)) & np.uint64(1))) for k in range(len(langs))]
        self.fp = np.array([f ** HASHES for f in fill])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        grams, first = ngrams(texts)
        n = np.diff(first)
        hits = np.zeros((len(self.langs), len(texts)))
        places = _places(grams, self.size)
        for w, plane in enumerate(self.cells):
            mask = plane[places[0]]
            for at in places[1:]:
                mask &= plane[at]
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                total = np.concatenate([[0], np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1))])
                hits[k] = total[first[1:]] - total[first[:-1]]
        true = np.maximum(0.0, (hits - n * self.fp[:, None]) / (1 - self.fp[:, None]))
        win, share = true.argmax(axis=0), true.sum(axis=0)
        out, score = [], []
        for i, t in enumerate(texts):
            if not any(c.isalpha() for c in t):
                out.append("und")
                score.append(0.0)
            elif share[i] <= 0:
                out.append(self.langs[self.best])
                score.append(0.0)
            else:
                out.append(self.langs[win[i]])
                score.append(float(true[win[i], i] / share[i]))
        return out, score


def learn(examples: DataFrame) -> Filter:
    """``examples(lang, text)`` → the filter."""
    counts = (examples.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
                      .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    from kerbside.session import materialize

    counts = materialize(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    # at most 1 / MIN_RATE rows per language, by the rate itself
    rows = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= MIN_RATE * F.col("total")).select("lang", "gram", "total").toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    own = [rows[rows["lang"] == x] for x in langs]
    return Filter(langs, [int(x["total"].iloc[0]) for x in own], [x["gram"].to_numpy().astype(np.uint64) for x in own])


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores = [], []
            for _, part in _runs(texts):
                if model.langs:
                    a, b = model.predict(part)
                else:
                    a, b = ["und"] * len(part), [0.0] * len(part)
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row."""
    rows = docs.select(F.col(id_col).alias("id"), (learn_fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = learn(rows.filter(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "held_out", "text").mapInArrow(_predict(shared), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
