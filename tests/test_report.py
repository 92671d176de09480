"""Reports are published whole: by the commit of all tasks, or not at all."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.sources import report as rp


def rows(spark, n, parts=4):
    return spark.range(n).repartition(parts).select("id", F.concat(F.lit("é | "), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("half"))


def test_a_report_is_read_as_it_was_written(spark, tmp_path):
    path = f"{tmp_path}/report"
    with pytest.raises(FileNotFoundError):
        rp.read_report(spark, path)
    df = rows(spark, 50)
    rp.publish_report(df, path)
    assert sorted(rp.read_report(spark, path).collect()) == sorted(df.collect())
    for f in rp.manifest_of(path)["files"]:
        assert hashlib.sha256((Path(path) / f["file"]).read_bytes()).hexdigest() == f["sha256"]
    rp.publish_report(rows(spark, 7), path, append=True)
    assert rp.read_report(spark, path).count() == 57
    rp.publish_report(rows(spark, 3), f"file:{path}")
    assert rp.read_report(spark, path).count() == 3
    assert rp.clear_report(path) == 2 and rp.read_report(spark, path).count() == 3
    rp.publish_report(rows(spark, 0), path)
    assert rp.read_report(spark, path).collect() == [] and rp.read_report(spark, path).schema == df.schema


def test_a_failed_task_leaves_the_old_report_whole(spark, tmp_path):
    path = f"{tmp_path}/report"
    rp.publish_report(rows(spark, 20), path)
    before = sorted(p.name for p in Path(path).iterdir())
    bad = rows(spark, 1000).withColumn("half", F.when(F.col("id") == 700, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("half")))
    with pytest.raises(Exception, match="no"):
        rp.publish_report(bad, path)
    assert sorted(p.name for p in Path(path).iterdir()) == before
    assert rp.read_report(spark, path).count() == 20


def test_a_failed_commit_leaves_the_old_report_whole(spark, tmp_path):
    path = f"{tmp_path}/report"
    rp.publish_report(rows(spark, 20), path)
    with pytest.raises(Exception, match="own kind and schema"):
        rp.publish_report(rows(spark, 5).drop("half"), path, append=True)
    assert rp.read_report(spark, path).count() == 20


def test_markdown(spark, tmp_path):
    path = f"{tmp_path}/report"
    rp.publish_report(rows(spark, 2, 1).orderBy("id"), path, "markdown")
    lines = [r.line for r in rp.read_report(spark, path).collect()]
    assert lines[:2] == ["| id | name | half |", "|---|---|---|"]
    assert sorted(lines[2:]) == ["| 0 | é \\| 0 | 0.0 |", "| 1 | é \\| 1 |  |"]
    with pytest.raises(Exception, match="json or markdown"):
        rp.publish_report(rows(spark, 2), path, "xml")
