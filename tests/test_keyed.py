"""State by key over restarts: every step is a query of its own that goes on from the checkpoint."""

import pytest

from scholion.streaming import keyed

pytestmark = pytest.mark.filterwarnings("ignore")


def steps(spark, tmp_path, schema, batches, transform):
    keyed.keep_state(spark)
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr(*[f"to_timestamp({x}) as {x}" if x == "at" else x for x in [c.split()[0] for c in schema.split(", ")]]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        seen = []
        query = transform(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _, seen=seen: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        out.append(sorted((tuple(map(str, r)) for r in seen)))
    return out


def test_a_later_deadline_survives_other_hours(spark, tmp_path):
    found = steps(spark, tmp_path, "host string, at string, seconds long", [
        [("h", "2024-01-01 00:00:00", 10800), ("h", "2024-01-01 00:00:01", 5), ("g", "2024-01-01 00:00:05", 1), (None, "2024-01-01 00:00:05", 86400), ("n", None, 5), ("n", "2024-01-01 00:00:05", None)],
        [("h", "2024-01-01 01:30:00", 10)],  # earlier than the deadline of another hour
        [("k", "2024-01-01 04:00:00", 60)],
        [("h", "2024-01-01 04:00:01", 3600)],
    ], keyed.host_cooldowns)
    first, second, third, fourth = found
    assert ("h", "2024-01-01 03:00:00", "deferred") in first and ("None", "2024-01-02 00:00:05", "deferred") in first and not any(r[0] == "n" for r in first)
    assert [r for r in first + second if r[0] == "g"] == [("g", "2024-01-01 00:00:06", "deferred"), ("g", "2024-01-01 00:00:06", "released")]
    assert not any(r[0] == "h" for r in second)
    assert [r for r in third if r[0] == "h"] == [("h", "2024-01-01 03:00:00", "released")]
    assert [r for r in fourth if r[0] == "h"] == [("h", "2024-01-01 05:00:01", "deferred")]


def test_content_is_read_again_only_when_it_changed(spark, tmp_path):
    found = steps(spark, tmp_path, "doc string, version long, sha string", [
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, None), (None, 1, "z")],
        [("a", 1, "x"), ("a", 3, "y"), ("b", 1, "w"), ("c", 1, "v")],
        [("a", 2, "q"), ("a", 4, "x"), ("c", 1, "v")],
    ], lambda s: keyed.content_index(s, "doc", "version", "sha"))
    assert found[0] == [("None", "1", "z", "new"), ("a", "2", "y", "new"), ("b", "-1", "", "new")]
    assert found[1] == [("b", "1", "w", "changed"), ("c", "1", "v", "new")]
    assert found[2] == [("a", "4", "x", "changed")]
