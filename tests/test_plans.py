"""Physical-plan properties: pruning, pushdown, single scans, no products."""


from kerbside.operators import timestats as ts
from kerbside.operators.dbscan import dbscan
from kerbside.plans.inputs import labeled, violations
from kerbside.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan(QUERIES["hourly"](spark, SF))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scan, p
    assert "PushedFilters: [IsNotNull(latitude), IsNotNull(longitude)" in scan[0]
    read = scan[0].split("ReadSchema: ")[1]
    assert read.count(":") == 4  # latitude, longitude, created_datetime, validation_status


def test_statistics_read_the_records_once(spark, monkeypatch):
    """The bundle is one aggregate over one scan, and the queries that show many
    statistics read its few rows, not the records."""
    from kerbside.plans import inputs
    lab = labeled(spark, SF, "live")
    records = lab.kerbside_path.rsplit("/", 1)[-1]
    written = []
    plain = ts.materialize

    def recording(df, name, compression=None):
        written.append(plan(df))
        return plain(df, name, compression)

    monkeypatch.setattr(ts, "materialize", recording)
    for name in ("insight_context", "insight_document", "report_sections"):
        written.clear()
        out = QUERIES[name](spark, SF)
        out.collect()
        assert len(written) == 1 and written[0].count("FileScan") == 1 and "Expand" in written[0]
        # only the dashboard's own totals read the records once more
        assert plan(out).count(records) <= (name == "report_sections")
    assert inputs.labeled(spark, SF, "live") is lab
    for name in ("vehicle_mix", "data_profile"):
        assert plan(QUERIES[name](spark, SF)).count("[events") <= 1


def test_clustering_plans_have_no_products(spark, monkeypatch):
    from kerbside.operators import dbscan as dbscan_module
    from kerbside.operators import quadtree
    v = violations(spark, SF, "live").select("id", "latitude", "longitude")
    plans = []
    orig = type(v).checkpoint

    def recording(self, eager=True):
        plans.append(plan(self))
        return orig(self, eager)

    for module in (dbscan_module, quadtree):
        own = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, compression=None, own=own: plans.append(plan(df)) or own(df, name, compression))
    type(v).checkpoint = recording
    try:
        out = dbscan(v, 8e-4, 5)
        plans.append(plan(out))
    finally:
        type(v).checkpoint = orig
    assert len(plans) > 5
    for p in plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p
