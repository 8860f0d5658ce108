"""Operators of kerbside.llm against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns whose names clash."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

from kerbside.llm import (fuzzy_lines, langid, ngram_join, quality_model, robust_rules, ss_packing, stratified_shards,
                          string_tiling, token_index, url_rules)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = "doc_id long, text string, lang string, source string, n long, comp string, node long, list long, key string, shard int"


def rows():
    base = " ".join(f"w{i}" for i in range(80))
    near = base.replace("w40", "changed")
    texts = [None, "", "  \n ", "one two", "one two", "ONE two", base, base.upper(), near, near + " tail", " ".join(f"x{i % 7}" for i in range(3000)),
             "#$% " * 60, "a b c\na b c\nnot", "\u65e5\u672c\u8a9e \u00c9t\u00e9 <|endoftext|> it's 12,5%", base + "\nlast", base]
    out = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, "c", 2, 3, "k", 4) for i, t in enumerate(texts)]
    return [*out, (3, "one two", "en", "s", 1, "c", 2, 3, "k", 4), (None, base, "en", "s", 1, "c", 2, 3, "k", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLS)


def shingles(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def closed(sets):
    """Class of each index under Jaccard >= 0.8, by comparing all pairs."""
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_ngram_join_matches_all_pairs(spark, docs, none):
    r = rows()
    sets = [shingles(x[1]) for x in r]
    root = closed(sets)
    least = {}
    for x, c in zip(r, root):
        if x[0] is not None:
            least[c] = min(least.get(c, x[0]), x[0])
    want = sorted((str(x[0]), len(s), str(least.get(c)) if s else str(x[0])) for x, s, c in zip(r, sets, root))
    for heavy in (64, 2):  # with and without frequent shingles at the end of the order
        got = ngram_join.classes(docs, heavy=heavy).collect()
        assert sorted((str(g.doc_id), g.n_shingles, str(g.component_id)) for g in got) == want
    assert ngram_join.classes(none).count() == 0


def test_keep_one_of_each_class(docs):
    got = ngram_join.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect() if x.text and "w1 " in x.text.lower()) == [6]


def library(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark, docs, none, tmp_path):
    token_index.write_token_files(docs, str(tmp_path / "a"))
    got = token_index.read_tokens(str(tmp_path / "a"), token_index.document_keys(docs)).collect()
    want = collections.defaultdict(list)
    for x in rows():
        want[x[0]].append(library(x[1], 2))
    assert len(got) == len(rows())
    start = 0
    for g in sorted(got, key=lambda g: g.start):
        ids = np.frombuffer(g.ids, "<u4").tolist()
        assert g.start == start and ids in want[g.key]
        start += len(ids)
    keys = [g.key for g in sorted(got, key=lambda g: g.start)]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    absent = spark.createDataFrame([(10**9 + i, 0) for i in range(200)], "key long, seen int")
    assert token_index.read_tokens(str(tmp_path / "a"), absent).count() == 0
    token_index.write_token_files(none, str(tmp_path / "b"))
    assert token_index.read_tokens(str(tmp_path / "b"), absent).count() == 0


def test_minimal_perfect_hash_is_a_bijection():
    h = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    levels, slot = token_index.build_mph(h)
    assert sorted(slot) == list(range(3000))
    assert (token_index.find_slots(h, [len(x) for x in levels], np.concatenate(levels)) == slot).all()


def test_packing_holds_every_token_once(spark, docs, none):
    got = ss_packing.digest(ss_packing.pack_documents(docs, capacity=64)).collect()
    want = collections.Counter()
    for x in rows():
        ids = library(x[1], 0)
        for p, s in enumerate(range(0, len(ids), 64)):
            part = ids[s:s + 64]
            want[(x[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = collections.defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert ss_packing.pack_documents(none).count() == 0


def test_sum_of_squares_wastes_little(spark):
    """Piece lengths of documents (uniform lengths leave about 5 %, see README)."""
    chars = spark.read.parquet(f"{SF[:-3]}01/documents.parquet").select("n_chars").toPandas()["n_chars"].to_numpy() // 3 + 1
    n = np.concatenate([np.full((chars // 2048).sum(), 2048), chars % 2048])
    n = n[n > 0]
    _, _, fill = ss_packing.pack(n, 2048)
    assert len(fill) <= 1.03 * -(-n.sum() // 2048)


def test_rule_counts_match_brute_force(spark, docs, none):
    got = robust_rules.quality_rules(docs).collect()

    def stat(t):
        t = t or ""
        w = WORD.findall(t)
        win = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if win[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    want = collections.Counter((x[0], *stat(x[1])) for x in rows())
    assert collections.Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.base_failed and g.kept)
    assert robust_rules.quality_rules(none).count() == 0
    assert robust_rules.keep_documents(docs).columns == docs.columns


def test_rules_reject_symbols_and_keep_prose(spark):
    clean = [(i, " ".join(f"word{(i * j) % 97}x" for j in range(1, 90 + i % 9)), "en", "a") for i in range(80)]
    junk = [(100 + i, " ".join(f"w{j * i}##$" for j in range(1, 80)), "en", "a") for i in range(1, 6)]
    got = {r.doc_id: r for r in robust_rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].kept for i in range(101, 106))
    assert all(got[i].kept for i in range(80) if not got[i].base_failed)


def test_language_id(spark, docs, none):
    table = spark.read.parquet(f"{SF[:-3]}01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = {g.doc_id: g for g in langid.identify(docs).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and len(langid.identify(docs).collect()) == len(rows())
    assert langid.identify(none).count() == 0


def test_quality_classifier(spark, docs, none):
    d, lab = (spark.read.parquet(f"{SF[:-5]}0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(d, lab).join(lab, "doc_id").filter("held_out").toPandas()
    good, bad = (got[got["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    few = quality_model.classify(docs, lab.limit(0)).collect()
    assert len(few) == len(rows()) and all(r.score == 0.5 and r.predicted == 1 for r in few)
    assert quality_model.classify(none, lab).count() == 0


def test_tiling_finds_reordered_passages(spark, docs, none):
    item = [f"b{i}" for i in range(40)]
    text = ["x"] * 30 + item[20:40] + ["y"] * 9 + item[0:20] + ["z"] * 30
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(item))], "item_id long, text string")
    more = docs.limit(0).unionByName(docs).unionByName(spark.createDataFrame(
        [(50, " ".join(text).upper(), "en", "s", 1, "c", 2, 3, "k", 4), (51, " ".join(item[:12]), "en", "s", 1, "c", 2, 3, "k", 4)], COLS))
    got = string_tiling.contaminated(more, bench).collect()
    assert sorted((g.doc_id, g.item_id, g.matched_words, g.n_tiles) for g in got) == [(50, 1, 40, 2), (50, 4, 40, 2)]
    assert string_tiling.contaminated(none, bench).count() == 0
    assert string_tiling.contaminated(docs, bench.limit(0)).count() == 0
    kept = string_tiling.decontaminate(more, bench)
    assert kept.columns == more.columns and kept.count() == len(rows()) + 1


def test_url_rules_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet') UNION ALL BY NAME SELECT * FROM (VALUES "
                "(-1, NULL), (-2, ''), (-3, 'nonsense'), (-4, 'HTTP://NET/'), (-5, 'http://net'), (-6, 'http://xnet/a'), "
                "(-7, 'https://A.example.NET/en/?q#f'), (-8, 'x://a.org/fr/b'), (-8, 'x://a.org/fr/b'), (-9, 'x://example.com?/de/')) t(page_id, url)")
    pages = spark.createDataFrame(con.sql("SELECT page_id, url FROM pages").df().astype(object).where(lambda d: d.notna(), None).values.tolist(), "page_id long, url string")
    got = url_rules.judge_urls(pages, spark.createDataFrame(url_rules.RULES, "verdict string, rule string")).collect()
    assert len(got) == pages.count()
    assert {tuple(map(str, g)) for g in got} == {tuple(map(str, r)) for r in con.sql(url_rules.SQL).fetchall()}
    assert {g.verdict for g in url_rules.judge_urls(pages, spark.createDataFrame([], "verdict string, rule string")).collect()} == {"allow"}
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(url_rules.RULES, "verdict string, rule string")).count() == 0


def test_shards_match_the_mixture(spark, docs, none):
    table = spark.read.parquet(f"{SF[:-3]}01/documents.parquet")
    got = stratified_shards.interleave_shards(table).join(table.select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("shard").size()
    assert len(got) == 1000 and per.max() - per.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    mix = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    odd = stratified_shards.interleave_shards(docs).collect()
    assert collections.Counter((o.doc_id, o.size, o.text_crc32) for o in odd) == collections.Counter(
        (x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows())
    assert stratified_shards.interleave_shards(none).count() == 0


def test_line_dedup_matches_all_pairs(spark, docs, none):
    got = fuzzy_lines.line_components(docs).collect()
    lines = sorted({x for r in rows() for x in (r[1] or "").split("\n") if WORD.search(x)})
    sets = [frozenset(x[i:i + 5] for i in range(max(1, len(x) - 4))) for x in lines]
    assert len({g.component_id for g in got}) == len(set(closed(sets))) == sum(
        c for c in collections.Counter(g.component_id for g in {(g.component_id, str(g.doc_id), g.th, g.line_no): g for g in got if g.kept}.values()).values())
    out = fuzzy_lines.dedupe_lines(docs)
    assert out.columns == docs.columns and {0, 1, 2} <= {r.doc_id for r in out.collect()}
    assert fuzzy_lines.line_components(none).count() == 0 and fuzzy_lines.dedupe_lines(none).count() == 0


def test_line_classes_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    more = [t.replace("e", "\u00e9", 2) + "\n" + (t.split("\n")[0] + " x") + "\n\n" for t in texts if t][:30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", *more, "ab", "ab", "abc\n", "abcd "])], "doc_id long, text string").repartition(4)
    got = fuzzy_lines.line_components(docs).collect()
    line = {(r.doc_id, i): x for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if WORD.search(x)}
    assert {(g.doc_id, g.line_no) for g in got} == set(line) and len(got) == len(line)
    lines = sorted(set(line.values()))
    classes = dict(zip(lines, closed([frozenset(x[i:i + 5] for i in range(max(1, len(x) - 4))) for x in lines])))
    mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for g in got:
        mine[g.component_id].add((g.doc_id, g.line_no))
        theirs[classes[line[g.doc_id, g.line_no]]].add((g.doc_id, g.line_no))
    assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in theirs.values()}
    assert {(g.doc_id, g.line_no) for g in got if g.kept} == {min(x) for x in mine.values()}


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns and len(corpus_pipeline.STAGES) == 5


def repeated_rows(spark):
    """Groups of equal rows: with an id, without any id, near copies without ids, and blank texts."""
    base, other = (" ".join(f"{p}{i}" for i in range(60)) + f"\n{p} last line of it" for p in "wv")
    near = other.replace("v30", "changed")
    r = [*[(1, base, "a")] * 4, (1, base, "b"), *[(None, other, "a")] * 30, *[(None, near, "a")] * 9, (7, "", "a"), (7, "", "a"), (None, None, "a"), (None, None, "a"), (9, "quite alone\nhere", "a")]
    return spark.createDataFrame(r, "doc_id long, text string, source string").repartition(3), base, other, near


def test_one_of_repeated_rows_stays(spark):
    docs, base, other, near = repeated_rows(spark)
    out = ngram_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got[1, base] == 1 and got[None, other] + got[None, near] == 1
    assert got[7, ""] == 2 and got[None, None] == 2 and got[9, "quite alone\nhere"] == 1 and sum(got.values()) == 7


def test_one_line_of_repeated_rows_stays(spark):
    docs, base, other, near = repeated_rows(spark)
    got = fuzzy_lines.line_components(docs).collect()
    assert len(got) == sum(WORD.search(x) is not None for r in docs.collect() for x in (r.text or "").split("\n"))
    kept = collections.Counter(g.component_id for g in got if g.kept)
    assert set(kept) == {g.component_id for g in got} and set(kept.values()) == {1}
    out = fuzzy_lines.dedupe_lines(docs)
    lines = collections.Counter(x for r in out.collect() for x in (r.text or "").split("\n") if WORD.search(x))
    assert out.columns == docs.columns and len(lines) == len(kept) and set(lines.values()) == {1}
    blank = collections.Counter((r.doc_id, r.text) for r in out.collect() if not r.text)
    assert blank == {(7, ""): 2, (None, None): 2}


def test_rules_reject_one_outlier_of_each_statistic(spark):
    rng = np.random.default_rng(5)

    def prose(n, letters=(3, 4, 5, 6, 7)):
        """Different words, so that no three of them come back."""
        return [f"{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) + "o" * int(rng.choice(letters) - 3) for k in rng.permutation(1000)[:n]]

    def broken(w):
        return "\n".join(" ".join(w[i:i + 20]) for i in range(0, len(w), 20))

    clean = [(i, broken(prose(int(rng.integers(260, 340))))) for i in range(200)]
    w = prose(300)
    planted = [(1000, broken(prose(300, (4, 5, 6, 7, 8)))), (1001, broken([x + "#" if i % 15 == 0 else x for i, x in enumerate(w)])),
               (1002, broken(w) + "\nend" * 6), (1003, broken(w[:240] + w[:60]))]
    table = spark.createDataFrame([(*x, "en", "a") for x in clean + planted], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in robust_rules.quality_rules(table).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(1000, 1004)), [got[i].distance for i in range(1000, 1004)]
    assert sum(got[i].kept for i in range(200)) >= 198


def test_classifier_learns_from_one_row_of_each_id(spark, monkeypatch):
    docs = spark.createDataFrame([*[(2, f"good words number {i}") for i in range(60)], *[(i, f"text of {i} here") for i in range(3, 60)]], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i == 2)) for i in range(2, 60)], "doc_id long, quality int")
    seen, plain = [], quality_model.Network.__init__
    monkeypatch.setattr(quality_model.Network, "__init__", lambda own, x, y: seen.append(y) or plain(own, x, y))
    assert quality_model.classify(docs, lab, sample=58).count() == 117
    learned = [i for i in range(2, 60) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0]) == len(learned) and seen[0].sum() == (2 in learned) == 1
