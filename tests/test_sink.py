"""The transactional sink: all files of a job or none."""

import os

import pytest
from pyspark.sql import functions as F

from scholion.sources import sink


def test_documents_come_back_as_written(spark, tmp_path):
    sink.register(spark)
    target = str(tmp_path / "out")
    rows = spark.range(20).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"), F.repeat(F.lit("é"), F.col("id").cast("int")).cast("binary").alias("content")).repartition(3)
    rows.write.format("document_files").mode("append").save(target)
    back = {r.name: bytes(r.content) for r in spark.read.format("document_files").load(target).collect()}
    assert back == {f"d{k:03d}": ("é" * k).encode() for k in range(20)}
    with pytest.raises(Exception, match="fresh folder"):
        rows.write.format("document_files").mode("append").save(target)
    entry = sink.committed(target)[7]
    with open(f"{target}/{entry['stored']}", "wb") as file:
        file.write(b"changed")
    with pytest.raises(Exception, match="differs"):
        spark.read.format("document_files").load(target).collect()


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    sink.register(spark)
    target = str(tmp_path / "out")
    rows = spark.range(40).select(F.when(F.col("id") != 33, F.concat(F.lit("d"), "id")).alias("name"), F.lit(b"x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="needs a name"):
        rows.write.format("document_files").mode("append").save(target)
    assert not any(files for _, _, files in os.walk(target))
    with pytest.raises(Exception, match="no committed files"):
        spark.read.format("document_files").load(target).collect()
    twice = spark.range(4).select(F.lit("same").alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="written twice"):
        twice.write.format("document_files").mode("append").save(target)
    assert not any(files for _, _, files in os.walk(target))


def test_an_empty_table_commits_no_files(spark, tmp_path):
    sink.register(spark)
    target = str(tmp_path / "out")
    spark.createDataFrame([], "name string, content binary").write.format("document_files").mode("append").save(target)
    assert spark.read.format("document_files").load(target).count() == 0
