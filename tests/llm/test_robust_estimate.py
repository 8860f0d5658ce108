"""The minimum-covariance-determinant search and the verdict against plain numpy."""

import numpy as np

from kerbside.llm import robust_rules as rr


def plain_mcd(x, least, starts=300, seed=1):
    """Concentration steps from many random subsets: the smallest determinant found."""
    rng, best = np.random.default_rng(seed), None
    floor = np.diag(np.square(least))
    for _ in range(starts):
        own, last, mean, cov = rng.choice(len(x), 6, replace=False), np.inf, None, None
        for step in range(100):
            m = x[own].mean(axis=0)
            c = np.cov(x[own].T, bias=True) * rr.CONSISTENCY + 1e-3 * floor
            # the six first ones are no share of SUPPORT: their determinant does not count
            if step:
                if np.linalg.det(c) >= last * (1 - rr.FALL):
                    break
                last, mean, cov = np.linalg.det(c), m, c
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = np.flatnonzero(d <= np.quantile(d, rr.SUPPORT))
        if best is None or last < best[0]:
            best = (last, mean, cov)
    return best


def test_estimate_finds_the_smallest_determinant(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for name, n, junk in (("a", 120, 20), ("b", 80, 0)):
        core = rng.multivariate_normal([5000, 100, 200, 50], np.diag([300.0, 20, 40, 15]) ** 2, n)
        core[:, 1] += 0.05 * (core[:, 0] - 5000)
        far = rng.multivariate_normal([9000, 900, 200, 700], np.diag([200.0, 50, 40, 30]) ** 2, junk)
        groups[name] = np.round(np.concatenate([core, far])).astype(int)
    rows = [("en", g, 100, *map(int, v)) for g, x in groups.items() for v in x]
    vectors = spark.createDataFrame(rows, "lang string, source string, words long, x_0 long, x_1 long, x_2 long, x_3 long").repartition(3)
    least = rr.floors(vectors)
    got = {r["ks"]: r for r in rr.estimate(vectors).collect()}
    assert set(got) == {"=a", "=b"}  # no group is small: no language, no corpus
    for g, x in groups.items():
        det, mean, cov = plain_mcd(x.astype(float), least)
        r = got[f"={g}"]
        low = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                low[i, j] = r[f"l_{i}_{j}"]
        assert np.prod(np.diag(low)) ** 2 <= 1.05 * det
        assert np.abs([r[f"m_{i}"] for i in range(4)] - mean).max() < 0.25 * np.sqrt(np.diag(cov)).max()
    # every far row of the first group is beyond the cut, hardly any other is
    r = got["=a"]
    mean = np.array([r[f"m_{i}"] for i in range(4)])
    low = np.array([[r[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    d = (np.linalg.solve(low, (groups["a"] - mean).T) ** 2).sum(axis=0)
    assert (d[120:] > rr.CUTOFF).all() and (d[:120] > rr.CUTOFF).mean() < 0.02


def test_small_groups_ask_for_their_language_and_the_corpus(spark):
    rows = [("en", f"s{i % 4}", 100, 5000 + i, 100, 200, 50 + i % 5) for i in range(60)] + [("de", "s", 100, 5000 + i, 100, 200, 50 + i % 7) for i in range(5)]
    vectors = spark.createDataFrame(rows, "lang string, source string, words long, x_0 long, x_1 long, x_2 long, x_3 long")
    assert sorted({r["level"] for r in rr.estimate(vectors).collect()}) == [0, 1, 2]


def test_good_documents_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = rr.quality_rules(table).join(lab, "doc_id").filter("NOT base_failed").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() >= 0.99
    assert got[got["quality"] == 0]["kept"].mean() <= 0.01
