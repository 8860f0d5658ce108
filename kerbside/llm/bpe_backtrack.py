"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A tokenizer file gives the merges.  A sequence of tokens is what the merges make
of a text exactly if every token is what they make of its own string and every
two neighbours are *compatible*: no merge across their border comes before the
merges that built them.  So a piece of text is encoded from left to right: an
Aho-Corasick automaton over the vocabulary finds the longest token at every
place; it is taken if the pair table lets it follow the token before, else the
next shorter token is tried, and where none is left the last token is given
back.  A place that failed once is never tried again, so the work grows with the
length of the piece.  Pair verdicts are found by undoing merges from the latest
to the earliest, and are kept in a table per worker.

Text is normalised and cut into pieces as the tokenizer file says; pieces are
encoded once per worker (``encode.Encoder`` keeps the distinct ones), ids are put
together by numpy.  Decoding gathers each id's string from one flat buffer by an
offset table; where the file names no decoder, strings are joined by blanks.

Defined results: a null text has no ids and decodes to the empty text; ids that
the vocabulary does not know decode to nothing; null ids and repeated rows are
rows like any other; an empty table gives no rows.  Every row is its own unit of
work: nothing is shuffled, and a lost executor repeats only its input splits.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import read_table, text_chunks
from kerbside.llm.encode import _PLAIN, Encoder, tokenizer_file

TOKENIZER = "word_bpe_49k.json"
#: Verdicts and pieces that a worker keeps before it starts its tables anew (memory bounds only).
PAIR_TABLE, PIECES = 400_000, 250_000
#: Ids decoded at once inside a task.
DECODE_IDS = 1 << 20
#: Added to the code point of a word's last symbol when the vocabulary marks word ends.
_LAST = 0x400


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file as automaton and pair table."""

    def __init__(self, model: dict):
        import ahocorasick

        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a byte-pair vocabulary without prefixes, byte fallback or ignored merges is needed")
        vocab = model["vocab"]
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.join: dict[tuple[int, int], int] = {}
        self.verdicts: dict[int, bool] = {}
        self.wide = max(vocab.values(), default=0) + 1
        made = set()
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if self.rank[left] >= r or self.rank[right] >= r or whole in made:
                raise ValueError("a merge uses a token of a later merge, or makes a token again")
            made.add(whole)
            self.join[left, right] = r
            self.rank[whole], self.parts[whole] = r, (left, right)
        self.single: dict[str, int] = {}
        for token, i in vocab.items():
            key = self.symbols(token)
            # a token that the merges never leave whole is no candidate
            if i in self.parts and not self._undo(*self.parts[i], self.rank[i]):
                continue
            if i in self.parts or len(key) == 1:
                self.single[key] = i
        self.width = {i: len(k) for k, i in self.single.items()}
        self.shorter = {i: next((self.single[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in self.single), None) for k, i in self.single.items()}
        self.automaton = ahocorasick.Automaton()
        for key, i in self.single.items():
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        """A vocabulary string as symbols: the last one differs where it ends a word."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.word(token[: -len(self.suffix)])
        return token

    def word(self, piece: str) -> str:
        return piece[:-1] + chr(ord(piece[-1]) + _LAST) if self.suffix else piece

    def _undo(self, a: int, b: int, limit: float) -> bool:
        """No merge over the border of ``a`` and ``b`` comes before ``limit`` or before
        the merges that made them (equal merges: the left one comes first)."""
        rank, parts, join = self.rank, self.parts, self.join
        while True:
            if join.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.verdicts.get(a * self.wide + b)
        if got is None:
            if len(self.verdicts) >= PAIR_TABLE:
                self.verdicts.clear()
            got = self.verdicts[a * self.wide + b] = self._undo(a, b, float("inf"))
        return got

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece (byte symbols)."""
        if not piece:
            return []
        text = self.word(piece)
        if text in self.single:
            return [self.single[text]]
        n, width, shorter, verdicts, wide = len(text), self.width, self.shorter, self.verdicts, self.wide
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(text):
            longest[end + 1 - width[token]] = token  # ends ascend: the last one is the longest
        dead, out, at = bytearray(n + 1), [], 0
        token = longest[0]
        while at < n:
            while token is not None:
                if not dead[at + width[token]]:
                    if not out:
                        break
                    fits = verdicts.get(out[-1] * wide + token)
                    if self.compatible(out[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += width[token]
                token = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                dead[at] = 1
                last = out.pop()
                at -= width[last]
                token = shorter[last]
        return out


class BacktrackEncoder(Encoder):
    """``Encoder`` whose distinct pieces are encoded by ``Merges``."""

    keep = PIECES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.cutter = whole.normalizer, whole.pre_tokenizer
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.find_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_map = dict(enumerate(byte_symbols()))
        self.clear()

    def _learn(self, words: list[bytes]) -> None:
        ids = []
        for w in words:
            if _PLAIN(w):
                ids.append(self.merges.encode(w.decode().lower().encode().decode("latin-1").translate(self.byte_map)))
            else:
                ids.append(self._other(w.decode()))
        self._store(words, np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64))

    def _other(self, text: str) -> list[int]:
        """Special-token strings are cut out of the raw text; the rest is normalised and cut."""
        out: list[int] = []
        for part in self.find_special.split(text) if self.find_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    out += self.merges.encode(piece)
        return out


class Decoder:
    """Strings of all ids in one buffer, found by an offset table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError("a vocabulary file without a decoder is needed")
        text = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        size = max(text, default=-1) + 1
        strings = [b" " + text[i].encode() if i in text else b"" for i in range(size + 1)]  # the last entry: unknown ids
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.unknown = size

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts whose ids are ``ids[at[i]:at[i + 1]]``, and their offsets (n + 1)."""
        slot = np.minimum(ids.astype(np.int64), self.unknown)
        begin = self.offsets[slot]
        size = self.offsets[slot + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        # every string brings a blank; a text's first one goes
        filled = np.flatnonzero(size)
        first = filled[np.searchsorted(filled, at[:-1]).clip(max=max(len(filled) - 1, 0))] if len(filled) else np.zeros(0, np.int64)
        first = first[(first >= at[:-1]) & (first < at[1:])] if len(filled) else first
        begin[first] += 1
        size[first] -= 1
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.flat[where], total[at]


_LOADED: dict[tuple[str, type], object] = {}


def _loaded(kind: type, name_or_path: str):
    """The worker's encoder or decoder of a file."""
    if (name_or_path, kind) not in _LOADED:
        _LOADED[name_or_path, kind] = kind(tokenizer_file(name_or_path))
    return _LOADED[name_or_path, kind]


def _encode(tokenizer: str):
    def run(batches):
        enc = _loaded(BacktrackEncoder, tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for row, data, offs in text_chunks(batch.column(1)):
                ids, at = enc.encode(data, offs)
                raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([keys.slice(row, len(at) - 1), pa.array(np.diff(at)), raw.cast(pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids binary")


def _decode(tokenizer: str, ids_at: int):
    def run(batches):
        dec = _loaded(Decoder, tokenizer)
        for batch in batches:
            raw = batch.column(ids_at).cast(pa.large_binary())
            if raw.null_count:
                raw = raw.fill_null(b"")
            offs = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset: raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            flat = np.frombuffer(raw.buffers()[2], dtype="<u4", count=int(offs[-1]) // 4) if len(raw) and raw.buffers()[2] is not None else np.zeros(0, "<u4")
            at, row = offs // 4, 0
            while row < len(raw):
                stop = max(row + 1, int(np.searchsorted(at, at[row] + DECODE_IDS, side="right")) - 1)
                data, cut = dec.decode(flat[at[row]: at[stop]], at[row: stop + 1] - at[row])
                text = pa.Array.from_buffers(pa.large_string(), stop - row, [None, pa.py_buffer(cut), pa.py_buffer(data)]).cast(pa.string())
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])
                row = stop

    return run


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its texts as column ``decoded`` (special tokens kept)."""
    rows = encoded.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(tokenizer, rows.columns.index(ids_col)), f"{kinds}, decoded string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = decode_documents(encode_documents(read_table(spark, sf_dir, "documents")))
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
