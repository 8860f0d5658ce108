"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words (runs of
letters and digits; in scripts written without spaces each character is a word).
Five-word windows shared with an item are the seeds, of shorter items their whole
sequence; for each document and item that share one, tiles are marked greedily: the longest
match of unmarked words in both is found by running Karp-Rabin hashes (prefix
sums give the hash of any window; the length is searched by halving, since a
match of length L contains one of every shorter length), all non-overlapping
matches of that length are marked, and so on down to ``SEED_WORDS``.  The share
of the item's words under tiles is its coverage, whatever the order of the
passages in the document; at ``threshold`` or more the document is contaminated.

The benchmark is the stated query set, taken in blocks of about ``BLOCK_BYTES``
of text: each block is broadcast (bounded) and all documents stream past it, one
block after the other, so no document is shuffled and the work per document does not depend on how many
documents share a passage.  Windows that occur often in one text are tried once
per round, so a text of one repeated word costs no more than any other.

Defined results: null or empty texts contain nothing; an item with fewer than
``SEED_WORDS`` words is found where its whole sequence occurs, one without words
nowhere; repeated items are reported under each id; repeated documents and null ids are judged row by row;
an empty benchmark or document table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import mix64, read_table, text_chunks, window_hashes, word_hashes, word_spans
from kerbside.session import discard, materialize

SEED_WORDS = 5
THRESHOLD = 0.5
#: Benchmark text of one broadcast block.
BLOCK_BYTES = 16 << 20

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[48:58] = False
_BETWEEN[65:91] = False
_BETWEEN[97:123] = False
_BETWEEN[128:] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Scripts written without spaces: each character is a word.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Other characters than letters, marks and digits, beyond ASCII.
_MARKS = r"[^\p{L}\p{M}\p{N}\x00-\x7F]+"


def _spaced(column: pa.LargeStringArray) -> pa.LargeStringArray:
    """Blanks between the words that Unicode tells apart; texts without the lead bytes of
    such characters are passed on as they are."""
    if not len(column):
        return column
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offs[0]: offs[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    odd = np.searchsorted(offs - offs[0], np.flatnonzero((raw >= 0xE0) | (raw == 0xC2)), side="right") - 1
    mask = np.zeros(len(column), dtype=bool)
    mask[odd] = True
    if not mask.any():
        return column
    mask = pa.array(mask)
    apart = pc.replace_substring_regex(column.filter(mask), _UNSPACED, r" \1 ")
    return pc.replace_with_mask(column, mask, pc.replace_substring_regex(apart, _MARKS, " "))


def _words(column: pa.Array):
    """Per run of texts: first row, word hashes, each text's first word (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for row, data, offs in text_chunks(_spaced(pc.utf8_lower(column.cast(pa.large_string())))):
        starts, ends, first = word_spans(data, offs, _BETWEEN)
        yield row, word_hashes(data, starts, ends, True, _BETWEEN), first


class _Rolling:
    """Hashes of all windows of any length of one sequence."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power = np.ones(n + 1, dtype=np.uint64)
        self.power[1:] = _BASE
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.power[:n], out=self.sums[1:])

    def windows(self, at: np.ndarray, length: int, top: int) -> np.ndarray:
        """Hash of the windows that begin at ``at``, all raised to power ``top``."""
        return (self.sums[at + length] - self.sums[at]) * self._raise(top, at)

    def _raise(self, top: int, at: np.ndarray) -> np.ndarray:
        return _powers(top)[top - at]


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) <= n:
        p = np.full(max(n + 1, 2 * len(_POWERS[0])), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` without a marked word."""
    if len(marked) < length:
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(c[length:] == c[:-length])


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS, blocked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length), longest first; words are
    hashes.  ``blocked`` marks words of the text that no tile may touch."""
    a, b = _Rolling(item), _Rolling(text)
    top = max(len(item), len(text))
    in_a, in_b = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool) if blocked is None else blocked.copy()
    tiles: list[tuple[int, int, int]] = []

    def common(length: int):
        wa, wb = _free(in_a, length), _free(in_b, length)
        if not len(wa) or not len(wb):
            return None
        ha, hb = a.windows(wa, length, top), b.windows(wb, length, top)
        ua, ia = np.unique(ha, return_index=True)
        ub, ib = np.unique(hb, return_index=True)
        _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        return (wa[ia[x]], wb[ib[y]]) if len(x) else None

    longest = min(len(item), len(text))
    while longest >= least:
        lo, hi = least - 1, longest  # lo always matches (or is least - 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if common(mid) is None:
                hi = mid - 1
            else:
                lo = mid
        if lo < least:
            break
        longest = lo
        at_a, at_b = common(longest)
        for i, j in sorted(zip(at_a.tolist(), at_b.tolist())):
            if not in_a[i:i + longest].any() and not in_b[j:j + longest].any() and (item[i:i + longest] == text[j:j + longest]).all():
                in_a[i:i + longest] = True
                in_b[j:j + longest] = True
                tiles.append((i, j, longest))
    return tiles


class Seeds:
    """The seed windows of one length and the items that hold them."""

    def __init__(self, length: int, windows: list[np.ndarray], items: list[int]):
        self.length = length
        seeds = np.concatenate(windows)
        owners = np.repeat(items, [len(w) for w in windows])
        order = np.argsort(seeds, kind="stable")
        self.owners = owners[order]
        self.seeds, self.begin = np.unique(seeds[order], return_index=True)
        self.begin = np.append(self.begin, len(seeds))
        self.present = np.zeros(1 << 20, dtype=bool)  # cheap first test
        self.present[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, word) of every seed in the texts."""
        win = window_hashes(words, self.length)
        at = np.flatnonzero(self.present[(win & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.seeds, win[at]), len(self.seeds) - 1)
        same = self.seeds[k] == win[at]
        at, k = at[same], k[same]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + self.length <= first[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        n = self.begin[k + 1] - self.begin[k]
        item = self.owners[np.arange(n.sum()) + np.repeat(self.begin[k] - (np.cumsum(n) - n), n)]
        return np.repeat(doc, n), item, np.repeat(at, n)


class Items:
    """One block of the benchmark: word hashes per item and the seed windows.  An item of
    fewer than SEED_WORDS words has its whole sequence as seed."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.words = ids, [np.zeros(0, np.uint64)] * len(ids)
        seeds: dict[int, tuple[list, list]] = {}
        for row, words, first in _words(pa.array(texts, pa.string())):
            for i in range(len(first) - 1):
                own = words[first[i]: first[i + 1]]
                self.words[row + i] = own
                if len(own):
                    length = min(SEED_WORDS, len(own))
                    windows, items = seeds.setdefault(length, ([], []))
                    windows.append(np.unique(window_hashes(own, length)))
                    items.append(row + i)
        self.seeds = [Seeds(length, *found) for length, found in sorted(seeds.items())]

    def matches(self, column: pa.Array):
        """(row, item index, tiles) of every text and item that share a seed."""
        for row, words, first in _words(column):
            hits = [(*s.hits(words, first), s.length) for s in self.seeds]
            if not any(len(h[0]) for h in hits):
                continue
            doc, item, spot = (np.concatenate([h[i] for h in hits]) for i in range(3))
            order = np.lexsort((item, doc))
            doc, item, spot = doc[order], item[order], spot[order]
            begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
            for i, j in zip(begin.tolist(), np.append(begin[1:], len(doc)).tolist()):
                d, x = int(doc[i]), int(item[i])
                least = min(SEED_WORDS, len(self.words[x]))
                # only words under a seed of this item can be tiled: the rest shrinks to one blocked word
                covered = np.zeros(first[d + 1] - first[d] + 1, dtype=bool)
                rel = spot[i:j] - first[d]
                for o in range(least):
                    covered[rel + o] = True
                cut = covered.copy()
                cut[1:] |= covered[:-1]  # the word after a covered run stays, as a border
                keep = np.flatnonzero(cut[:-1])
                yield row + d, x, tile(self.words[x], words[first[d]: first[d + 1]][keep], least, ~covered[keep])


def _report(shared, threshold: float, id_type):
    def run(batches):
        items = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for row, x, tiles in items.matches(batch.column(1)):
                size, matched = len(items.words[x]), sum(t[2] for t in tiles)
                if matched >= threshold * size:
                    out.append((ids[row], items.ids[x], size, matched, len(tiles), matched / size))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)],
                                             names=["doc", "item_id", "item_words", "matched_words", "n_tiles", "coverage"])

    return run


def _clean(shared, threshold: float):
    def run(batches):
        items = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("__text"))
            good = np.ones(batch.num_rows, dtype=bool)
            for row, x, tiles in items.matches(text):
                if sum(t[2] for t in tiles) >= threshold * len(items.words[x]):
                    good[row] = False
            yield batch.filter(pa.array(good))

    return run


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The benchmark in bounded blocks (each a broadcast value), and whether it is the last
    one; a block is read when it is asked for and let go when the next one is."""
    sc = benchmark.sparkSession.sparkContext
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES if total else 0
    for b in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        sent = sc.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))
        yield sent, b + 1 == blocks
        if b + 1 < blocks:
            sent.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item whose coverage reaches the threshold:
    id, item_id, item_words, matched_words, n_tiles, coverage.  All blocks but the last are
    worked off and their findings written before the next one is sent out."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType
    schema = f"doc {kind.simpleString()}, item_id long, item_words long, matched_words long, n_tiles int, coverage double"
    out = None
    for shared, last in item_blocks(benchmark):
        found = rows.mapInArrow(_report(shared, threshold, kind), schema)
        found = found if last else materialize(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("doc", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns unchanged.  What a
    block leaves is written before the next one is sent out."""
    out = docs.withColumn("__text", F.col(text_col))
    for shared, last in item_blocks(benchmark):
        before, out = out, out.mapInArrow(_clean(shared, threshold), out.schema)
        if not last:
            out = materialize(out, "decontaminated")
            discard(before)
    return out.drop("__text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
