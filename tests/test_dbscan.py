import math

import pytest
from pyspark.sql import functions as F

from kerbside.operators.components import connected_components
from kerbside.operators.dbscan import dbscan, dbscan_plain
from kerbside.operators.spatial import eps_pairs
from kerbside.plans.inputs import violations

EPS = 8e-4


def pts(spark, rows):
    return spark.createDataFrame(rows, "id long, latitude double, longitude double")


def labels(df):
    return {r.id: r.cluster_label for r in df.select("id", "cluster_label").collect()}


def brute_dbscan(points, eps_deg, m):
    """Sequential textbook DBSCAN in row-id order (the reference numbering)."""
    e = math.radians(eps_deg)

    def d(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[2]) - math.radians(a[2])) / 2) ** 2
        return 2 * math.asin(math.sqrt(h))

    pts_ = sorted(points)
    nb = {p[0]: [q[0] for q in pts_ if d(p, q) <= e] for p in pts_}
    core = {k for k, v in nb.items() if len(v) >= m}
    lab = {p[0]: -1 for p in pts_}
    k = 0
    for p in pts_:
        i = p[0]
        if lab[i] != -1 or i not in core:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if lab[j] == -1:
                lab[j] = k
                if j in core:
                    stack.extend(x for x in nb[j] if lab[x] == -1)
        k += 1
    return lab


def test_core_border_noise_and_shared_border(spark):
    step = 0.0003
    rows = []
    # cluster A: 5 points on a line (ids 10..14), cluster B: 5 points (ids 20..24)
    for i in range(5):
        rows.append((10 + i, 12.9, 77.5 + i * step))
        rows.append((20 + i, 12.9, 77.5 + 0.0040 + i * step))
    # border point between them, within eps of the end of each line but not core
    rows.append((30, 12.9, 77.5 + 4 * step + 0.0005 + 0.0004))
    rows.append((40, 13.5, 78.0))  # noise
    got = labels(dbscan(pts(spark, rows), EPS, 3))
    assert got == brute_dbscan(rows, EPS, 3)
    assert got[40] == -1


def test_duplicates_count_as_separate_records(spark):
    rows = [(i, 12.95, 77.55) for i in range(1, 6)] + [(9, 12.96, 77.55)]
    got = labels(dbscan(pts(spark, rows), EPS, 5))
    assert [got[i] for i in range(1, 6)] == [0] * 5 and got[9] == -1
    got4 = labels(dbscan(pts(spark, rows[:4] + rows[5:]), EPS, 5))
    assert set(got4.values()) == {-1}


def test_all_noise(spark):
    rows = [(i, 12.0 + i * 0.01, 77.0) for i in range(10)]
    assert set(labels(dbscan(pts(spark, rows), EPS, 2)).values()) == {-1}


def test_random_points_match_textbook(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        c = rnd.choice([(12.90, 77.50), (12.902, 77.503), (12.95, 77.6)])
        rows.append((i, c[0] + rnd.gauss(0, 0.0007), c[1] + rnd.gauss(0, 0.0007)))
    for m in (4, 8):
        got = labels(dbscan(pts(spark, rows), 1e-3, m))
        assert got == brute_dbscan(rows, 1e-3, m)


def test_hot_location_skew(spark):
    """A third of the records on one location: collapsed to one weighted point;
    quadtrees several levels deep still give the textbook result."""
    rows = [(i, 12.9, 77.5) for i in range(300)]
    rows += [(1000 + i, 12.9 + 0.0001 * (i % 30), 77.5 + 0.0001 * (i // 30)) for i in range(600)]
    got = labels(dbscan(pts(spark, rows), EPS, 5, leaf=3))
    assert len(got) == 900
    assert got == brute_dbscan(rows, EPS, 5)


def test_labels_stable_under_repartition(spark):
    v = violations(spark, "/root/testdata/sf0.001", "live").select("id", "latitude", "longitude")
    a = labels(dbscan(v, EPS, 5))
    b = labels(dbscan(v.repartition(7).orderBy(F.rand(1)), EPS, 5))
    assert a == b


def test_subcell_equals_plain_and_invariants(spark):
    v = violations(spark, "/root/testdata/sf0.001", "batch").select("id", "latitude", "longitude")
    sub = labels(dbscan(v, 1e-3, 8))
    plain = labels(dbscan_plain(v, 1e-3, 8))
    assert sub == plain
    # every core point has at least min_samples neighbours; counts + noise = rows
    n = eps_pairs(v, 1e-3).groupBy("id_a").count()
    assert n.count() == v.count()
    assert sum(1 for x in sub.values() if x >= 0) + sum(1 for x in sub.values() if x < 0) == v.count()


def test_components_path_and_isolated(spark):
    n = 500
    nodes = spark.range(n + 3).select(F.col("id").alias("node"))
    edges = spark.range(n - 1).select(((F.col("id") * 37) % n).alias("src"), (((F.col("id") + 1) * 37) % n).alias("dst"))
    lab = {r.node: r.label for r in connected_components(nodes, edges).collect()}
    assert {lab[i] for i in range(n)} == {0}
    assert [lab[n], lab[n + 1], lab[n + 2]] == [n, n + 1, n + 2]


def gap_blobs(phi, lon, g):
    """Blob A: grid with lat ≤ phi, lon ≤ lon plus two edge points; blob B:
    grid with lat ≥ phi+0.0004, lon ≥ lon+g plus two edge points.  The
    nearest cross pairs sit close to eps, inside boxes that straddle eps."""
    a = [(phi - 1e-4 * r, lon - 4e-5 - 1e-4 * c) for r in range(4) for c in range(5)]
    a += [(phi, lon), (phi, lon - 3e-5)]
    b = [(phi + 4.3e-4 + 1e-4 * r, lon + g + 4e-5 + 1e-4 * c) for r in range(4) for c in range(5)]
    b += [(phi + 4e-4, lon + g), (phi + 3.7e-4, lon + g + 3e-5)]
    return a + b


def test_dense_clusters_across_a_gap_use_micro_refinement(spark):
    rows = []
    for k, g in enumerate((7.0e-4, 7.2e-4)):
        for lat, lon in gap_blobs(12.9 + 0.01 * k, 77.5, g):
            rows.append((len(rows), lat, lon))
    got = labels(dbscan(pts(spark, rows), EPS, 5))
    want = brute_dbscan(rows, EPS, 5)
    assert got == want
    assert len({v for v in want.values() if v >= 0}) == 3   # joined at 0.99 eps, apart at 1.01 eps


def test_neighbor_counts_with_duplicates(spark):
    from kerbside.operators.spatial import neighbor_counts
    rows = [(i, 12.9, 77.5) for i in range(50)] + [(100, 12.9, 77.5005), (101, 12.9, 77.502)]
    got = {r.id: r.neighbor_count for r in neighbor_counts(pts(spark, rows), EPS).collect()}
    assert got[0] == 51 and got[49] == 51 and got[100] == 51 and got[101] == 1


def test_tile_contraction_matches_plain_components(spark):
    """Adjacency components with tiles of 2×2 sub-cells (many cross-tile edges)
    equal the components of the full adjacency graph."""
    from kerbside.operators.tiles import adjacency_components
    import random
    rnd = random.Random(5)
    cells = {(rnd.randrange(0, 40), rnd.randrange(0, 40)) for _ in range(700)}
    rows = [(ci, cj, ci * 1000 + cj) for ci, cj in sorted(cells)]
    cc = spark.createDataFrame(rows, "ci long, cj long, node long")
    got = {r.node: r.label for r in adjacency_components(cc, tile=2).collect()}
    parent = {n: n for _, _, n in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for ci, cj, n in rows:
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                if (ci + di, cj + dj) in cells:
                    a, b = find(n), find((ci + di) * 1000 + cj + dj)
                    parent[max(a, b)] = min(a, b)
    want = {}
    for _, _, n in rows:
        want.setdefault(find(n), []).append(n)
    expect = {n: min(ns) for ns in want.values() for n in ns}
    assert got == expect


def test_density_counts_match_pair_counts(spark):
    """Bounded-work neighbour counts equal plain pair counts, with
    quadtrees down to single locations."""
    from kerbside.operators.density import neighbor_counts as dense_counts
    from kerbside.operators.spatial import neighbor_counts as pair_counts
    v = violations(spark, "/root/testdata/sf0.001", "live").select("id", "latitude", "longitude")
    want = {r.id: r.neighbor_count for r in pair_counts(v, EPS).collect()}
    for leaf in (32, 1):
        got = {r.id: r.neighbor_count for r in dense_counts(v, EPS, leaf=leaf).collect()}
        assert got == want


def test_components_random_graphs_match_union_find(spark):
    import random
    rnd = random.Random(9)
    for n, m in ((60, 40), (200, 180), (300, 600)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
        edges = spark.createDataFrame(pairs, "src long, dst long")
        got = {r.node: r.label for r in connected_components(nodes, edges).collect()}
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        for a, b in pairs:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        groups = {}
        for i in range(n):
            groups.setdefault(find(i), []).append(i)
        want = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_dense_grid_across_tiny_tiles(spark):
    """A dense grid with a hole and a detached strip; 2×2-sub-cell tiles put
    almost every pair across a tile border (bridge filter, ring tests)."""
    rows, i = [], 0
    for r in range(40):
        for c in range(40):
            if 15 <= r <= 22 and 15 <= c <= 22:
                continue  # hole
            rows.append((i, 12.9 + r * 9e-5, 77.5 + c * 9e-5))
            i += 1
    for r in range(40):
        rows.append((i, 12.9 + r * 9e-5, 77.5 + 39 * 9e-5 + 8.1e-4))  # strip just beyond eps
        i += 1
    df = pts(spark, rows)
    got = labels(dbscan(df, EPS, 5, tile=2))
    want = labels(dbscan_plain(df, EPS, 5))
    assert got == want


def test_empty_and_single_record_inputs(spark):
    from kerbside.operators.clusters import cluster_summary
    from kerbside.operators.score import score_live
    empty = pts(spark, [])
    assert dbscan(empty, EPS, 5).count() == 0
    one = pts(spark, [(1, 12.9, 77.5)])
    assert labels(dbscan(one, EPS, 1)) == {1: 0}
    assert labels(dbscan(one, EPS, 2)) == {1: -1}
    lab = violations(spark, "/root/testdata/sf0.001", "live").limit(0)
    summ = cluster_summary(dbscan(lab, EPS, 5), "live")
    assert summ.count() == 0 and score_live(summ).count() == 0


def _spot(lat, lon, n, step=1e-5):
    return [(lat + i * step, lon) for i in range(n)]


def test_ids_only_order_clusters(spark):
    a, b = _spot(12.9, 77.5, 12), _spot(12.9, 78.1, 12)
    for ids in ([*range(12), *range(12)], [None] * 24, [*range(50, 62), *range(12)]):
        rows = [(i, x, y) for i, (x, y) in zip(ids, a + b)]
        got = dbscan(pts(spark, rows), EPS, 5).collect()
        first = 1 if ids[0] == 50 else 0
        assert sorted((r.longitude, r.cluster_label) for r in got) == sorted([(77.5, first)] * 12 + [(78.1, 1 - first)] * 12)


def test_text_ids_survive_cleaning(spark):
    from kerbside.operators.clean import clean
    raw = spark.createDataFrame([(f"KA-{i}", str(12.9 + i * 1e-5), "77.5", "2024-01-01 08:00:00", "VALID") for i in range(6)],
                                "id string, latitude string, longitude string, created_datetime string, validation_status string")
    assert [r.cluster_label for r in dbscan(clean(raw), EPS, 5).collect()] == [0] * 6


def test_wrap_and_outlier_latitudes(spark):
    from kerbside.operators.density import neighbor_counts as dense_counts
    rows = [(i, 10.0, lon) for i, lon in enumerate([179.9999, 179.99995, 180.0, -180.0, -179.9999, -179.99995, 179.9994, -179.9994])]
    rows += [(100 + i, 10.0, -179.9 + i * 1e-5) for i in range(5)]
    rows += [(200 + i, 85.0, 20.0 + i * 4e-3) for i in range(6)] + [(300 + i, 89.9, -179.8 + i * 72.0) for i in range(5)]
    rows += [(400 + i, 89.9997, i * 72.0) for i in range(5)]
    df = pts(spark, rows)
    assert labels(dbscan(df, EPS, 4)) == brute_dbscan(rows, EPS, 4)
    e = math.radians(EPS)

    def near(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * math.asin(math.sqrt(h)) <= e

    assert {r.id: r.neighbor_count for r in dense_counts(df, EPS, leaf=2).collect()} == {p[0]: sum(near(p, q) for q in rows) for p in rows}


def test_labels_do_not_depend_on_the_leaves(spark):
    """Dense sub-cells around sparse ones: core test, edges and border labels by
    quadtrees down to single locations equal the textbook."""
    import random
    rnd = random.Random(8)
    rows = []
    for x in (0.0, 7.6e-4, 1.7e-3):
        rows += [(len(rows) + i, 12.9 + rnd.random() * 1e-4, 77.5 + x + rnd.random() * 1e-4) for i in range(60)]
    rows += [(1000 + i, 12.9 + rnd.uniform(-1e-3, 1e-3), 77.5 + rnd.uniform(-1e-3, 2.7e-3)) for i in range(60)]
    for m in (5, 40):
        want = brute_dbscan(rows, EPS, m)
        assert labels(dbscan(pts(spark, rows), EPS, m, leaf=2)) == want
        assert labels(dbscan(pts(spark, rows), EPS, m)) == want


def test_frontier_grows_slower_than_the_pairs(spark, monkeypatch):
    """Ten times as many locations in one place: the pairs of a location and a box or
    another location that are looked at grow about with n^1.5, the eps pairs with n²."""
    import random

    from kerbside.operators import quadtree
    from kerbside.operators.density import neighbor_counts as dense_counts

    def work(n):
        rnd = random.Random(n)
        rows = [(i, 12.9 + rnd.random() * 9e-4, 77.5 + rnd.random() * 9e-4) for i in range(n)]
        looked = []
        plain, tested = quadtree._verdicts, quadtree._tested
        monkeypatch.setattr(quadtree, "_verdicts", lambda probe, eps: looked.append(probe) or plain(probe, eps))
        leaves = []
        monkeypatch.setattr(quadtree, "_tested", lambda cut, tree, keep, eps: leaves.append((cut, tree)) or tested(cut, tree, keep, eps))
        dense_counts(pts(spark, rows), EPS, leaf=8).count()
        monkeypatch.setattr(quadtree, "_verdicts", plain)
        monkeypatch.setattr(quadtree, "_tested", tested)
        boxes = sum(p.count() for p in looked)
        return boxes + sum(c.join(t.leaves, ["ci", "cj", "level", "q"]).count() for c, t in leaves)

    few, many = work(400), work(4000)
    assert many / few < 10 ** 1.7  # the pairs themselves: 10 ** 2
    assert many < 0.25 * 4000 ** 2
