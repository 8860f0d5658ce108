"""Whole texts to token ids with the ``tokenizers`` library, many times faster
than one call per text: a text is cut where the tokenizer itself always cuts
(white space; between a run of letters and a run of punctuation), each distinct
piece is encoded once per worker, and the ids are put together by numpy.

A piece made only of ASCII letters, Latin-1 letters and plain punctuation is cut
into its runs with A-Z lower-cased (the tokenizer lower-cases, and nothing in
such a piece composes under NFC).  Any other piece (digits, apostrophes, angle
brackets, combining marks, other scripts) is given to the tokenizer as it is,
from white space to white space, so special-token strings and normalisation
behave as in the whole text.  Works for the given vocabulary's tokenizer, which
drops white space and matches letters, digits and the rest apart.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

# byte classes
_SPACE, _LETTER, _PUNCT, _OTHER = 0, 1, 2, 3
_CLS = np.full(256, _OTHER, dtype=np.uint8)
_CLS[9:14] = _SPACE
_CLS[32] = _SPACE
_CLS[65:91] = _LETTER
_CLS[97:123] = _LETTER
for _c in b'!"#$%&()*+,-./:;=?@[]^_`{|}~':
    _CLS[_c] = _PUNCT
_CLS[0xC3] = _LETTER  # lead byte of the Latin-1 letters; its second byte is looked at below

_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!\"#$%&()*+,\-./:;=?@\[\]^_`{|}~]+").fullmatch

#: Words kept by a worker before its cache starts anew (memory bound only).
CACHE_WORDS = 1_500_000


class Encoder:
    #: Pieces kept by a worker.
    keep = CACHE_WORDS

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for plain pieces, which need no normalising but lower case and no cutting but at the blank
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)

    def _store(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n0, n1 = len(self.index), len(self.index) + len(words)
        while n1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used: self.used + len(ids)] = ids
        self.start[n0:n1] = self.used + np.cumsum(counts) - counts
        self.count[n0:n1] = counts
        self.used += len(ids)
        self.index.update(zip(words, range(n0, n1)))

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are not in the cache: plain ones many to a call (one
        pre-token each, told apart by word number), others one by one."""
        plain, other = [], []
        for w in words:
            (plain if _PLAIN(w) else other).append(w)
        step = 1000
        groups = [plain[i: i + step] for i in range(0, len(plain), step)]
        for g, e in zip(groups, self.plain.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            at = np.asarray(e.word_ids, dtype=np.int64)
            if len(at) and at[-1] == len(g) - 1:
                self._store(g, np.asarray(e.ids, dtype=np.uint32), np.bincount(at, minlength=len(g)))
            else:
                other.extend(g)
        for i in range(0, len(other), step):
            part = other[i: i + step]
            got = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)]
            self._store(part, np.array([t for x in got for t in x], dtype=np.uint32), np.array([len(x) for x in got], dtype=np.int64))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one buffer and each text's offset among them (n + 1)."""
        spans, first = _pieces(data, offs)
        buf, (starts, ends) = spans
        lens = ends - starts
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        at = np.concatenate([[0], np.cumsum(lens)])
        # the spans cover every byte that is not white space, in order
        arr = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(buf)])
        coded = arr.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > self.keep:
            self.clear()
        get = self.index.get
        new = [w for w in words if get(w) is None]
        if new:
            self._learn(new)
            get = self.index.get
        slot = np.fromiter((get(w) for w in words), dtype=np.int64, count=len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.count[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.start[slot] - total[:-1], n)]
        return ids, total[first]


def _pieces(data: np.ndarray, offs: np.ndarray):
    """Byte spans to encode apart, in order, and each text's first span (n + 1)."""
    empty = np.zeros(0, np.int64)
    if len(data) == 0:
        return (data, (empty, empty)), np.zeros(len(offs), np.int64)
    cls = _CLS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    fine = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    cls[lead + 1] = np.where(fine, _LETTER, _OTHER)
    new = np.empty(len(data), dtype=bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    inner = offs[(offs > 0) & (offs < len(data))]
    new[inner] = True
    run = np.flatnonzero(new)
    kind = cls[run]
    end = np.append(run[1:], len(data))
    # chunks: white space or a text's start begins a new one
    opens = np.zeros(len(run), dtype=bool)
    opens[0] = True
    opens[1:] = kind[:-1] == _SPACE
    opens[np.searchsorted(run, inner)] = True
    chunk = np.cumsum(opens) - 1
    odd = np.zeros(chunk[-1] + 1, dtype=bool)
    odd[chunk[kind == _OTHER]] = True
    solid = kind != _SPACE
    in_odd = odd[chunk]
    head = np.empty(len(run), dtype=bool)  # first solid run of an odd chunk
    head[:] = opens
    keep = solid & (~in_odd | head)
    starts = run[keep]
    # an odd chunk ends where its last solid run ends
    last = np.zeros(len(odd), dtype=np.int64)
    last[chunk[solid]] = end[solid]
    ends = np.where(in_odd[keep], last[chunk[keep]], end[keep])
    upper = (data >= 65) & (data <= 90)
    if in_odd.any():
        upper &= ~np.repeat(in_odd, end - run)
    buf = data.copy()
    buf[upper] |= 0x20
    return (buf[cls != _SPACE], (starts, ends)), np.searchsorted(starts, offs)


_ENCODERS: dict[str, Encoder] = {}


def tokenizer_file(name_or_path: str) -> str:
    """A bare name is looked up among the public tokenizer files."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def encoder(name_or_path: str) -> Encoder:
    """The worker's encoder."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = Encoder(tokenizer_file(name_or_path))
    return _ENCODERS[name_or_path]
