"""Records with newlines in quotes, read in many splits, against the multi-line reader."""

import csv
import random

from kerbside.sources.csv import read_records_csv


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "location", "latitude", "violation_type"])
        w.writerows(rows)


def test_splits_give_the_records_of_the_whole_file(spark, tmp_path):
    rnd = random.Random(9)
    cell = lambda: "".join(rnd.choice(['a', 'b', '"', ",", "\n", " ", "é"]) for _ in range(rnd.randint(0, 30)))
    rows = [(str(i), cell(), "12.9", '["A","B"]' if i % 3 else "x\ny\n\nz") for i in range(400)]
    rows[200] = ("200", "line\n" * 400, "1", "long")
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", rows[:250])
    write(tmp_path / "in" / "b.CSV", rows[250:], "\r\n")
    (tmp_path / "in" / "notes.txt").write_text('id,"\n')
    want = [tuple(v or None for v in r) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = read_records_csv(spark, str(tmp_path / "in"), multi_line="split", order_key="file")
            got = [(r.id, r.location, r.latitude, r.violation_type) for r in df.orderBy("seq").collect()]
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text("")
    assert read_records_csv(spark, str(empty), multi_line="split").count() == 0
