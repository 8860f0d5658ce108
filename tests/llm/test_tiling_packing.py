"""Tiling against plain Python, short and unspaced items, several blocks; uniform packing; few labels."""

import random

import numpy as np
import pytest

from kerbside.llm import quality_model, ss_packing, string_tiling

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def plain_tiles(item, text, least):
    """Greedy string tiling by comparing all places."""
    in_a, in_b, out = [False] * len(item), [False] * len(text), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_a[i + n] and not in_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(in_a[i:i + best]) and not any(in_b[j:j + best]):
                in_a[i:i + best] = in_b[j:j + best] = [True] * best
                out.append(best)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_coverage_equals_plain_tiling(spark, monkeypatch, block):
    monkeypatch.setattr(string_tiling, "BLOCK_BYTES", block)
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [[word() for _ in range(rnd.randint(1, 30))] for _ in range(25)]
    texts = []
    for _ in range(80):
        t = [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            src = rnd.choice(items)
            a = rnd.randrange(len(src))
            at = rnd.randint(0, len(t))
            t[at:at] = src[a: a + rnd.randint(1, 20)]
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS).repartition(2)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], ITEMS)
    want = set()
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            tiles = plain_tiles(x, t, min(5, len(x)))
            if tiles and sum(tiles) >= 0.5 * len(x):
                want.add((i, k, sum(tiles)))
    got = {(g.doc_id, g.item_id, g.matched_words) for g in string_tiling.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 20
    left = {r.doc_id for r in string_tiling.decontaminate(docs, bench).collect()}
    assert left == set(range(80)) - {w[0] for w in want}


def test_short_unspaced_and_quoted_items(spark):
    chinese = "我们在北京的一家小书店里找到了这本关于星星的旧书"
    items = [(1, chinese), (2, "four words are here"), (3, "“quoted” passage — with typographic marks, six"), (4, "!!!"), (5, None), (6, "")]
    docs = [(1, f"今天{chinese}，很好。"), (2, "so four words are here again"), (3, "a \"quoted\" passage - with typographic marks six b"), (4, "four words were here"),
            (5, "我们在上海的一家大书店"), (6, None), (7, "")]
    got = string_tiling.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((g.doc_id, g.item_id) for g in got) == [(1, 1), (2, 2), (3, 3)]


def test_very_long_text_with_one_passage(spark):
    rnd = random.Random(2)
    item = [f"b{i}" for i in range(40)]
    text = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    text[50_000:50_000] = item
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:50_000]))], DOCS)
    got = string_tiling.contaminated(docs, spark.createDataFrame([(9, " ".join(item))], ITEMS)).collect()
    assert [(g.doc_id, g.matched_words, g.n_tiles) for g in got] == [(1, 40, 1)]


def test_uniform_lengths_stay_near_the_bound():
    """Lengths 1 to 2047, where the earlier form needed 4 to 6 % over the least number."""
    for pieces, part in ((3000, 1.03), (16_000, 1.01)):
        n = np.random.default_rng(0).integers(1, 2048, pieces)
        _, _, fill = ss_packing.pack(n, 2048)
        assert len(fill) <= part * -(-n.sum() // 2048)


def test_classifier_on_few_labels(spark):
    """The 399 labels of the smaller table (README: 0.90)."""
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(d, lab).join(lab, "doc_id").filter("held_out").toPandas()
    good, bad = (got[got["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.85
