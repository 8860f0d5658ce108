"""Property tests (random inputs) against brute-force references."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.operators import timestats as ts
from kerbside.operators.dbscan import dbscan
from kerbside.plans.inputs import violations
from test_dbscan import brute_dbscan

point_sets = st.lists(
    st.tuples(st.integers(0, 3), st.floats(-6e-4, 6e-4), st.floats(-6e-4, 6e-4), st.integers(1, 3)),
    min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pts=point_sets, m=st.integers(2, 6))
def test_dbscan_matches_textbook_on_random_sets(spark, pts, m):
    centres = [(12.9, 77.5), (12.9012, 77.5009), (-33.86, 151.2), (12.9, 77.5016)]
    rows, i = [], 0
    for c, dy, dx, dup in pts:
        for _ in range(dup):  # repeated coordinates
            rows.append((i, round(centres[c][0] + dy, 7), round(centres[c][1] + dx, 7)))
            i += 1
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r.id: r.cluster_label for r in dbscan(df, 8e-4, m).collect()}
    assert got == brute_dbscan(rows, 8e-4, m)


def test_bucket_totals_equal_valid_rows(spark):
    for prof, hi in (("live", None), ("batch", 1440.0)):
        v = violations(spark, "/root/testdata/sf0.001", prof)
        total = sum(r["count"] for r in ts.resolution_buckets(v, prof).collect())
        cond = F.col("resolution_minutes") >= 0
        if hi is not None:
            cond = cond & (F.col("resolution_minutes") <= hi)
        assert total == v.filter(cond).count()


def test_cluster_sizes_and_noise_cover_all_rows(spark):
    from kerbside.plans.inputs import clusters, labeled
    lab = labeled(spark, "/root/testdata/sf0.001", "live")
    cl = clusters(spark, "/root/testdata/sf0.001", "live")
    noise = lab.filter(F.col("cluster_label") < 0).count()
    assert cl.agg(F.sum("violation_count")).first()[0] + noise == lab.count()
