"""Shared helpers: reading tables, text buffers as numpy arrays, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; bounds the numpy scratch arrays.
CHUNK_BYTES = 4 << 20

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def one_of_equals(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row of ``rows`` for each value of ``keys``: the first by a hash of ``columns``,
    the columns returned (maps cannot be hashed and do not count)."""
    known = [F.col(f"`{f.name}`") for f in rows.select(*[F.col(f"`{c}`") for c in columns]).schema if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*known)).alias("__row")).select(*[F.col("__row").getField(c).alias(c) for c in columns])


def learn_fold(id_col: str, mod: int):
    """crc32 of the id's decimal text modulo ``mod`` (null id: fold of the empty text, 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield ``(first_row, bytes uint8[], offsets int64[])`` for runs of whole
    texts of about ``limit`` bytes (a longer text is a run of its own; a null
    text has no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, raw[offs[row]: offs[stop]], offs[row: stop + 1] - offs[row]
        row = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(29)
    x *= _U64(0xA0761D6478BD642F)
    x ^= x >> _U64(32)
    return x


def _byte_table(lower_ascii: bool) -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=_U64) * _MULT)
    if lower_ascii:
        t[65:91] = t[97:123]
    t[9:14] = 0
    t[32] = 0
    return t


_EXACT, _LOWER = _byte_table(False), _byte_table(True)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[9:14] = True
_SPACE[32] = True


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not ``between`` words; as given, of
    ``[^\\x20\\x09-\\x0D]``) of the texts in one buffer: start and end byte of each
    word, and per text the index of its first word (n + 1 values)."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    solid = ~between[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower_ascii: bool, between: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hash of every word: a polynomial over random byte values, mixed."""
    if len(starts) == 0:
        return np.zeros(0, _U64)
    lo, hi = int(starts[0]), int(ends[-1])
    body = data[lo:hi]
    rel = starts - lo
    lens = np.diff(np.append(rel, hi - lo))
    pos = np.arange(hi - lo, dtype=np.int32) - np.repeat(rel, lens).astype(np.int32)
    powers = np.empty(int(lens.max()), dtype=_U64)
    powers[0] = 1
    powers[1:] = _MULT
    np.multiply.accumulate(powers, out=powers)
    table = _LOWER if lower_ascii else _EXACT
    if between is not _SPACE:
        table = np.where(between, np.uint64(0), table)
    vals = table[body]
    vals *= powers[pos]
    # separators inside a run hash to zero, so only the word's own bytes count
    return mix64(np.add.reduceat(vals, rel) + (ends - starts).astype(_U64))


_COEF = mix64(np.arange(101, 117, dtype=_U64) * _MULT) | _U64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive word hashes (may span texts)."""
    if len(words) < k:
        return np.zeros(0, _U64)
    acc = words[: len(words) - k + 1] * _COEF[0]
    for i in range(1, k):
        acc = acc + words[i: len(words) - k + 1 + i] * _COEF[i]
    return mix64(acc)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles (lower-cased
    A-Z); a text with fewer words has its whole sequence as one shingle, a text
    without words none."""
    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends, True)
    win = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= k:
            s = np.sort(win[a: b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix64(np.array([(words[a:b] * _COEF[:n]).sum() + _U64(n)], dtype=_U64)))
        else:
            out.append(np.zeros(0, _U64))
    return out
