"""Saved inventories, settings, commands, lookups: what queries on the tables don't show."""

import json

import pytest

from scholion.__main__ import main
from scholion.functions import records as r
from scholion.operators import evaluation, metrics, reading
from scholion.plans import settings
from scholion.sources import enrichment, manifest


def test_manifest_is_checked_and_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3)], "k long, s string, n long")
    path = f"{tmp_path}/run"
    digest = manifest.save(rows.repartition(3), path, {"query": "x"})
    back, sidecar = manifest.load(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, "a", None), (2, None, 3)] and sidecar["state"] == {"query": "x"} and sidecar["records_sha256"] == digest
    with pytest.raises(manifest.ManifestError):
        manifest.save(rows, path, {})
    every, rest = manifest.resume(spark, path, f"{tmp_path}/next", rows.where("k = 1"), "k", {})
    assert every.count() == 2 and [x.k for x in rest.collect()] == [2] and manifest.load(spark, f"{tmp_path}/next")[1]["parent_sha256"] == digest
    rows.where("k = 1").write.mode("overwrite").parquet(f"{path}/records")
    with pytest.raises(manifest.ManifestError):
        manifest.load(spark, path)


def test_settings():
    made = settings.effective({"search": {"workers": 2}})
    assert made["search"] == {"workers": 2, "max_records": 100_000} and settings.DEFAULTS["search"]["workers"] == 5
    for bad in ({"search": {"workers": 0}}, {"search": {"workers": True}}, {"search": {"more": 1}}, {"none": {}}, {"search": 3}, {"reading": {"chunk_chars": 1.5}}, {"general": {"output_root": 1}}):
        with pytest.raises(settings.SettingsError):
            settings.effective(bad)
    assert settings.effective({"network": {"max_retries": 0}})["network"]["max_retries"] == 0 and settings.section({"a": {"b": 1}}, "a") == {"b": 1}


def test_commands(tmp_path, capsys):
    plan = {"schema_version": 1, "question": "q", "concepts": [{"id": "c", "terms": ["salt"]}], "routes": [{"id": "p", "source": "pubmed", "concept_ids": ["c"]}]}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(plan))
    bad.write_text(json.dumps(plan | {"routes": []}))
    assert main(["query-check", str(good)]) == 0 and main(["query-check", str(bad)]) == 2 and main(["query-check", str(tmp_path / "none")]) == 2
    assert main(["coverage-plan", str(good), "3"]) == 0 and main(["unknown"]) == 2 and main([]) == 2 and main(["queries"]) == 0
    assert '"limit": 3' in capsys.readouterr().out


def test_works_count_once_at_their_best_place(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("c", 3, False)], "work string, place int, relevant boolean")
    one = metrics.evaluate_at_k(rows, 2, ["place"]).head()
    assert (one.returned, one.relevant_at_k, one.precision_at_k, one.recall) == (2, 1, 0.5, 1.0)


def test_conflicting_judgments_are_flagged(spark):
    records = spark.createDataFrame([(1, ["doi:a", "pmid:1"]), (2, ["doi:b"]), (3, ["x"])], "id long, aliases array<string>")
    judgments = spark.createDataFrame([(7, ["doi:a"], True), (8, ["pmid:1", "doi:b"], False)], "j long, ids array<string>, relevant boolean")
    found = {x.id: (x.j, x.relevant, x.conflict) for x in evaluation.judge(records, "id", "aliases", judgments, "j", "ids", "relevant").collect()}
    assert found == {1: (7, True, True), 2: (8, False, False), 3: (None, None, False)}


def test_jobs_without_their_setting_are_disabled(spark):
    empty = spark.createDataFrame([], "record long, doi string, title string, year int, authors array<string>, download_status string, identity_status string")
    answers = spark.createDataFrame([], "service string, key string, raw string")
    out, status = enrichment.enrich(empty, answers, {"core_api_key": "k"})
    assert out.count() == 0 and status["unpaywall"] == "disabled_missing_email" and status["core"] == "ok"


def test_receipts_of_a_chain(spark):
    rows = spark.createDataFrame([("c", 1, ["a", "b"]), ("c", 2, ["b"]), ("c", 3, ["z", "a"]), ("d", 1, None)], "chain string, n int, covered array<string>")
    found = {(x.chain, x.n): x.covered_so_far for x in reading.cumulative_cover(rows, "chain", "n", "covered").collect()}
    assert found == {("c", 1): ["a", "b"], ("c", 2): ["a", "b"], ("c", 3): ["a", "b", "z"], ("d", 1): []}
    chain = spark.createDataFrame([("a", "b", "x", "x"), ("b", "a", "x", "y"), ("c", None, "x", "x"), ("e", "none", "x", "x")], "receipt string, previous string, digest string, claimed string")
    faults = sorted(map(tuple, reading.receipt_faults(chain, "receipt", "previous", "digest", "claimed").collect()))
    assert faults == [("a", "circle"), ("b", "changed"), ("b", "circle"), ("e", "missing_predecessor")]


def test_metered_policy():
    assert r.content_policy() == ("disabled", 0) and r.content_policy(enabled=True) == ("blocked", 0)
    assert r.content_policy(enabled=True, free_only=False, allow_paid=True, max_files=9, max_cost=0.05, has_key=True) == ("enabled", 5)
    assert r.canonical({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}'


def test_equal_titles_meet_in_cells(spark):
    """Pairs of a frequent title are dealt over cells and equal the comparison pair by pair."""
    from pyspark.sql import functions as F

    from scholion.operators import authors as people

    rows = [(k, "https://doi.org/10.1000/A" if k % 5 == 0 else "10.1000/b" if k % 5 == 1 else "", "One Title!" if k % 7 else "other", 2000 + k % 3 if k % 4 else None, ["Lee Chan"] if k % 3 else ["Bo Nowak"]) for k in range(60)]
    frame = spark.createDataFrame(rows, "id long, raw_doi string, title string, year int, authors array<string>")
    found = people.equal_title_pairs(frame.where("id % 2 = 0"), frame.where("id % 2 = 1"), "id", part=4)
    a, b = [frame.where(f"id % 2 = {k}").select(*[F.col(c).alias(f"{s}_{c}") for c in frame.columns]) for k, s in ((0, "a"), (1, "b"))]
    same = people.same_publication("a_raw_doi", "b_raw_doi", "a_title", "b_title", "a_year", "b_year", "a_authors", "b_authors")
    want = a.join(b, F.lower(F.regexp_replace("a_title", "!", "")) == F.lower(F.regexp_replace("b_title", "!", ""))).select("a_id", "b_id", same)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.where("same").count() > 9


def test_udfs_work_in_slices_and_heavy_rows_are_spread(spark, tmp_path, monkeypatch):
    import pandas as pd
    from pyspark.sql import functions as F

    from scholion import catalogue, catalogue_plans
    from scholion.functions import arrow

    texts = pd.Series(["a" * k for k in (3, 3, 9, 20, 1)], dtype=object)
    monkeypatch.setattr(arrow, "LETTERS", 10)
    assert [(x.start, x.stop) for x in arrow.slices((texts, pd.Series(range(5))))] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    monkeypatch.setattr(arrow, "ROWS", 1)
    assert len(list(arrow.slices((texts,)))) == 5 and [x.stop for x in arrow.slices((texts[:0],))] == [0]
    monkeypatch.undo()

    @arrow.arrow_udf("int")
    def rows_at_once(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(a)] * len(a))

    held = spark.range(5000, numPartitions=1).select(rows_at_once(F.lit("x"), F.col("id")).alias("n"))
    assert held.agg(F.max("n"), F.count("n")).first() == (arrow.ROWS, 5000)
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert len({r[0] for r in catalogue_plans.plans(spark, str(tmp_path)).select(F.spark_partition_id()).collect()}) == 4
    spark.range(9).selectExpr("id AS doc_id", "'a b  a' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["inverted_abstract"](spark, str(tmp_path))
    assert found.count() == 9
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_file_names_of_device_words_equal_their_sql(spark, tmp_path):
    import oracle

    from scholion import catalogue

    spark.createDataFrame([(1, "aux\nmore"), (2, "CON"), (3, ""), (4, " nul. ")], "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang", "1L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    ours, theirs = oracle.rows_of(spark, catalogue.QUERIES["file_names"], catalogue.ORACLE_SQL["file_names"], str(tmp_path))
    assert ours == theirs
