"""Encoder, Merkle proofs and hard negatives against the library or plain Python."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import bpe_backtrack, hard_negatives, merkle
from kerbside.llm.encode import tokenizer_file

COLS = "doc_id long, text string, lang string, source string, n_chars long, ids string, anchor int, tree int, p int, digest string, decoded string"


def rows():
    rng = random.Random(3)
    texts = [None, "", " \n ", "one two", "it's we'll 'RE 12,5% #$%", "a" * 4000, "<|endoftext|>x<|startoftext|>", "日本語 Été ﬁ Å İ́", "ab" * 900,
             "line\nline\n\nend", "ing ings ingsing reading"]
    texts += ["".join(rng.choice("abcdeéß '.-1\n<|>") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    out = [(i, t, "en" if i % 3 else None, [None, "a", "b", "a", "é", "a", "lone"][i % 6] if i else "lone", len(t) if t else None, "z", 1, 2, 3, "d", "e")
           for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "no\nid", "en", "a", 5, "z", 1, 2, 3, "d", "e"), (None, "no\nid", "en", "a", 5, "z", 1, 2, 3, "d", "e")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLS)


def test_encoder_and_decoder_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(bpe_backtrack.TOKENIZER))
    want = collections.Counter()
    for x in rows():
        ids = t.encode(x[1] or "", add_special_tokens=False).ids
        want[(x[0], len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))] += 1
    coded = bpe_backtrack.encode_documents(docs)
    got = bpe_backtrack.decode_documents(coded).collect()
    assert collections.Counter((g.doc_id, g.n_tokens, bytes(g.ids), g.decoded) for g in got) == want
    assert bpe_backtrack.decode_documents(bpe_backtrack.encode_documents(none)).count() == 0
    assert bpe_backtrack.decode_documents(coded.withColumn("decoded", F.lit(1)).withColumn("ids", F.lit(None).cast("binary"))).filter("decoded <> ''").count() == 0


def test_backtracking_equals_plain_merging():
    """Merges in rank order on a small vocabulary whose longest match is often wrong."""
    symbols = list("abc")
    merges = ["a b", "b c", "c a", "ab c", "a bc", "ab ab", "ca b", "abab c", "bc a", "bca ca"]
    vocab = {s: i for i, s in enumerate([*symbols, *[m.replace(" ", "") for m in merges]])}
    kept = []
    for m in merges:  # "abc" is made by two merges: the file keeps the first
        if m.replace(" ", "") not in {k.replace(" ", "") for k in kept}:
            kept.append(m)
    model = {"type": "BPE", "vocab": vocab, "merges": kept}
    enc = bpe_backtrack.Merges(model)
    rank = {tuple(m.split(" ")): r for r, m in enumerate(kept)}

    def plain(text):
        parts = list(text)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not pairs:
                return [vocab[p] for p in parts]
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(symbols) for _ in range(rng.randint(1, 24)))
        assert enc.encode(text) == plain(text)


def test_decoder_skips_unknown_ids():
    d = bpe_backtrack.Decoder(tokenizer_file(bpe_backtrack.TOKENIZER))
    ids = np.array([10**6, 320, 10**6, 321, 10**6], np.uint32)
    data, at = d.decode(ids, np.array([0, 0, 5, 5]))
    assert at[0] == at[1] and bytes(data[at[1]:at[2]]).count(b" ") == 1 and at[2] == at[3]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(table, fanout=3):
    def leaf(x, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (x[0], x[3], x[2], x[4], text)])

    per = collections.defaultdict(list)
    for x in table:
        cut = x[1].replace("\n", "") if x[1] is not None and x[0] is not None and zlib.crc32(str(x[0]).encode()) % 2 == 0 else x[1]
        per[x[3]].append((x[0] is not None, x[0] or 0, leaf(x, x[1]), leaf(x, cut)))

    def climb(nodes):
        """(top digest, [(level segments) per node])"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // fanout * fanout: k // fanout * fanout + fanout]
                paths[i].append(("".join(run[:k % fanout]), "".join(run[k % fanout + 1:])))
            nodes = [H(*nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)]
            at = [k // fanout for k in at]
        return nodes[0], paths

    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: climb([x[2] for x in sorted(per[s])]) for s in order}
    root, high = climb([low[s][0] for s in order])
    for s, above in zip(order, high):
        for x, path in zip(sorted(per[s]), low[s][1]):
            acc = x[3]
            for left, right in [*path, *above]:
                acc = H(left, acc, right)
            yield (x[1] if x[0] else None, x[2], low[s][0], root, H(*[a + b for a, b in [*path, *above]]), acc, acc == root)


@pytest.mark.parametrize("part", ["all", "one source", "one row", "lone sources"])
def test_manifest_equals_plain_python(spark, tmp_path, part):
    table = {"all": rows(), "one source": [x for x in rows() if x[3] == "a"], "one row": rows()[:1],
             "lone sources": [(*x[:3], f"s{i}", *x[4:]) for i, x in enumerate(rows()[:11])]}[part]
    spark.createDataFrame(table, COLS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifest(table)))


def test_manifest_of_nothing_and_broadcast_rounds(none, docs, monkeypatch):
    assert merkle.prove(none).count() == 0
    want = sorted(map(str, merkle.prove(docs, fanout=2).select("key", "leaf", "root", "proof").collect()))
    monkeypatch.setattr(merkle, "WIDE", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    assert sorted(map(str, merkle.prove(docs, fanout=2).select("key", "leaf", "root", "proof").collect())) == want


def vectors():
    rng = np.random.default_rng(4)
    out = [(i, [float(v) for v in rng.normal(0.2, 0.4, 6).astype("f4")], int(rng.integers(0, 3))) for i in range(300)]
    out += [(300, None, 1), (301, [1.0] * 6, None), (302, [1.0, None, 1.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (350, [], 2),
            (351, [1.0, 2.0], 2), (50, out[50][1], out[50][2]), (50, out[50][1], out[50][2]), (7, [0.5] * 6, 1), (7, [0.5] * 6, 2), (None, [0.6] * 6, 0),
            (None, [0.6] * 6, 1), (400, [0.0] * 6, 0), (450, [-1.0] * 6, 1), (451, [3e38] * 6, 1), (500, [2e5, -1e5, 7.0, 1.0, 2.0, 3.0], 2)]
    return out


def mined(table, k_pos=5, k_neg=3):
    use = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in table if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-2**63 + 1, min(2**63 - 1, s))
    first = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    for n, (i, v, c) in enumerate(use):
        if i is None or i % 50:
            continue
        scored = [(clip(sum(a * b for a, b in zip(v, w))), j, d) for m, (j, w, d) in enumerate(use) if m != n]
        for ps, pid, _ in first([x for x in scored if x[2] == c])[:k_pos]:
            window = first([x for x in scored if x[2] != c and 50 * ps <= 100 * x[0] <= 95 * ps])[:k_neg]
            for rank, (ns, nid, _) in enumerate(window):
                yield (i, pid, rank + 1, nid, ps, ns)


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit("x"), "anchor": F.lit(1), "g": F.lit(2)})
    table = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    want = sorted(map(str, mined(table)))
    assert len(want) > 30
    run = lambda: sorted(map(str, map(tuple, hard_negatives.mine(df.repartition(3), F.col("vec_id") % 50 == 0).collect())))
    assert run() == want
    # many groups of anchors, many blocks
    for name, value in (("GROUP_BYTES", 200), ("ROW_BLOCK", 16), ("ANCHOR_BLOCK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert run() == want


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], none.schema)
    assert hard_negatives.mine(lone, F.col("vec_id") % 50 == 0).count() == 0
    tied = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), *[(i, [0.75], 2) for i in range(2, 40)]], none.schema)
    got = hard_negatives.mine(tied, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(g.positive_id, g.negative_id) for g in got] == [(1, 2), (1, 3), (1, 4)]
