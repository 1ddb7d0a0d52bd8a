"""Files: splits, mixed headers, safe overwrites, rescans."""

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import spectral
from tidegrid.sources import tables, wide


def test_wide_without_index_over_many_splits(spark, tmp_path):
    path = tmp_path / "w.csv"
    rows = ["a,DK_Region,r1,r2"] + [f"a,,{k}.5,{-k}" for k in range(1500)] + ["b,DK_Region,r3,r4"] + [f"b,,{k},{2 * k}" for k in range(1500)]
    path.write_text("SubID,Atlas,LA1,LA2\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        meta, long = wide.read_wide(spark, str(path))
        got = {(r["SubID"], r["label"], r["window_idx"]): r["value"] for r in long.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 6000 and meta.count() == 4
    assert all(got["a", "LA1", k] == k + 0.5 and got["b", "LA2", k] == 2 * k for k in range(1500))


def test_read_many_binds_by_name(spark, tmp_path):
    for name, text in {"1": "id,label\n1,x\n", "2": "label,id\ny,2\n", "3": "Name ,ID\nz,3\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = tables.read_many(spark, {"t": str(tmp_path)}, {"id": [], "label": ["name"]})
    assert {(r["id"], r["label"], r["source_csv"]) for r in got.collect()} == {("1", "x", "1.csv"), ("2", "y", "2.csv"), ("3", "z", "3.csv")}


def test_failed_overwrite_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.write_once(spark.range(3), path)
    with pytest.raises(Exception):
        tables.write_once(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3
    assert tables.write_once(spark.range(5), path, overwrite=True) and not tables.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_rescans_are_numbered(spark, tmp_path):
    path = str(tmp_path / "c")
    seen, blank = (spark.createDataFrame([(1, x)], "k int, include string") for x in ("yes", ""))
    assert tables.write_coverage(seen, path) == path
    assert tables.write_coverage(seen, path) == f"{path}_rescan"
    assert tables.write_coverage(blank, path) == f"{path}_rescan2"
    assert tables.write_coverage(blank, path) == f"{path}_rescan2"
    assert spark.read.parquet(f"{path}_rescan").first()["include"] == "yes"


def test_absent_and_missing_samples_agree(spark):
    full = spark.range(64).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.sin("id") * 3).alias("v"))
    null, gone = full.withColumn("v", F.when(F.col("i") != 30, F.col("v"))), full.where("i <> 30")
    for run in (lambda d: spectral.welch_psd(d, ["k"], "i", "v", 8.0, 16), lambda d: spectral.tf_power(d, ["k"], "i", "v", 8.0, [1.0], [2.0], 2)):
        a, b = (sorted(map(tuple, run(d).collect()), key=str) for d in (null, gone))
        assert a == b and a
    plan = spectral.welch_psd(full, ["k"], "i", "v", 8.0, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
