from pyspark.sql import functions as F

from kerbside.operators.density import SUB_FRACTION, block_weights
from kerbside.operators.spatial import columns_around, grid, ring_join, ring_lookups

EPS = 8e-4
CELL = EPS * SUB_FRACTION


def cells(spark, rows):
    return spark.createDataFrame(rows, "ci long, cj long, W long")


def test_ring_of_a_cell_is_looked_up_in_few_blocks(spark):
    at = grid(spark.createDataFrame([(12.9, 77.5), (48.1, -3.2), (-64.0, 179.9999)], "lat double, lon double"), CELL)
    rows = [(r.ci + i, r.cj + j, 1) for r in at.collect() for i in range(16) for j in range(8)]
    probe, _ = ring_lookups(cells(spark, rows).drop("W"), EPS, CELL)
    most = probe.groupBy("ai", "aj").count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] <= 6 and most[1] <= 4 * len(rows)  # one per cell of the ring: 49 and more


def test_ring_join_finds_every_cell_of_the_ring_once(spark):
    n = columns_around(CELL)
    for lat in (12.9, 64.0, 89.99):
        base = int(lat // CELL)
        rows = [(base + i, j % n, 1) for i in range(-9, 9) for j in range(-9, 9)]  # across the last column
        left, right = cells(spark, rows[::3]).drop("W"), cells(spark, rows).drop("W")
        got = sorted(tuple(r) for r in ring_join(left, right, EPS, CELL).select("ai", "aj", "ci", "cj").collect())
        assert len(set(got)) == len(got)
        near = {(a, b, c, d) for a, b, _ in rows[::3] for c, d, _ in rows
                if abs(a - c) <= 3 and 2 <= max(abs(a - c), abs((d - b + n // 2) % n - n // 2)) <= 3}
        assert near <= set(got)
        assert all(abs(a - c) <= 3 and max(abs(a - c), abs((d - b + n // 2) % n - n // 2)) >= 2 for a, b, c, d in got)


def test_block_weights_are_of_cells_and_shuffle_few_rows(spark):
    n = 64
    rows = [(i, j, 1 + i * j % 5) for i in range(-9, 10) for j in [*range(0, 10), 62, 63] if (i + j) % 3]
    out = block_weights(cells(spark, rows), n)
    got = {(r.ci, r.cj): r.B for r in out.collect()}
    w = {(i, j): x for i, j, x in rows}
    assert got == {(i, j): sum(w.get((i + a, (j + b) % n), 0) for a in (-1, 0, 1) for b in (-1, 0, 1)) for i, j in w}
    assert out.count() == len(rows)
