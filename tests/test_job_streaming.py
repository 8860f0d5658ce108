import os

from kerbside.plans.job import run_job
from kerbside.sources.snapshot import read_published
from kerbside.sources.synthetic import synthetic_records
from kerbside.streaming.ingest import ingest_available, refresh

HEADER = "id,latitude,longitude,vehicle_type,violation_type,created_datetime,closed_datetime,junction_name,police_station,validation_status\n"


COLS = HEADER.strip().split(",")


def _csv(rows):
    return HEADER + "".join(",".join(r) + "\n" for r in rows)


def test_job_publishes_all_sections(spark, tmp_path):
    raw = synthetic_records(spark, n=300, seed=5)
    root = str(tmp_path / "out")
    out = run_job(spark, raw, "live", out_root=root, run_id="r1")
    assert out["summary"].first().records_processed == 300
    assert read_published(spark, root, "clusters").count() == out["clusters"].count()
    assert read_published(spark, root, "hourly").count() == 24


def test_streaming_ingest_is_incremental(spark, tmp_path):
    landing, table, ck = (str(tmp_path / x) for x in ("landing", "table", "ck"))
    os.makedirs(landing)
    rows1 = [(str(i), "12.9", f"{77.5 + i * 1e-4:.4f}", "CAR", '"[""NO PARKING""]"', "2024-01-01 08:00:00+00",
              "2024-01-01 08:30:00+00", "J1", "PS 1", "VALID") for i in range(1, 7)]
    open(os.path.join(landing, "a.csv"), "w").write(_csv(rows1))
    ingest_available(spark, landing, table, ck, columns=COLS)
    assert spark.read.parquet(table).count() == 6
    rows2 = [(str(i), "12.9", "77.6", "BUS", "x", "2024-01-02 18:00:00", "", "J2", "PS 2", "INVALID") for i in range(7, 9)]
    rows2 += [("9", "12.9", "77.7", "BUS", "x", "2024-01-02 18:00:00", "", "J2", "PS 2", "VALID")]
    open(os.path.join(landing, "b.csv"), "w").write(_csv(rows2))
    out = refresh(spark, landing, table, ck, str(tmp_path / "pub"), run_id="r2", columns=COLS)
    recs = spark.read.parquet(table)
    assert recs.count() == 7            # INVALID rows dropped, nothing read twice
    assert recs.filter("violation_type = 'No Parking'").count() == 6
    assert out["clusters"].count() == 1  # six records 11 m apart form one hotspot


def test_job_command_line(spark, tmp_path):
    from kerbside.plans.job import main
    landing = tmp_path / "csv"
    landing.mkdir()
    rows = [(str(i), "12.9", f"{77.5 + i * 1e-4:.4f}", "CAR", "x", "2024-01-01 08:00:00", "", "J1", "PS 1", "VALID")
            for i in range(1, 8)]
    (landing / "r.csv").write_text(_csv(rows))
    main(["--input", str(landing), "--out", str(tmp_path / "pub"), "--run-id", "cli"])
    assert read_published(spark, str(tmp_path / "pub"), "clusters").count() == 1
