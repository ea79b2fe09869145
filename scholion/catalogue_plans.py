"""Registered queries over plans: one plan for every part, compiled, checked and rewritten in bulk; functions in SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scholion import sql
from scholion.catalogue import query, table
from scholion.functions.arrow import arrow_udf
from scholion.plans import query_plan

_NAME = "'part ' || p_partkey"


def plans(spark, d) -> DataFrame:
    """A plan a part: its number and size as terms of a concept, two native routes and a text route."""
    concept = F.struct(F.lit("c").alias("id"), F.array(F.expr(f"{_NAME}"), F.expr("'size   ' || p_size")).alias("terms"))
    route = lambda name, source, **more: F.struct(
        F.lit(name).alias("id"), F.lit(source).alias("source"), more.get("query", F.lit(None).cast("string")).alias("query"), more.get("ids", F.array(F.lit("c"))).alias("concept_ids"), F.lit(10).alias("limit")
    )
    none = F.array().cast("array<string>")
    routes = F.array(route("p", "pubmed"), route("e", "europe_pmc"), route("o", "openalex", query=F.expr(_NAME), ids=none))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is a few small files, and a plan is much work
    rows = table(spark, d, "part").select("p_partkey", "p_size").repartition(tasks).select("p_partkey", "p_size", F.struct(F.lit(1).alias("schema_version"), F.expr(f"'Which ' || {_NAME}").alias("question"), F.array(concept).alias("concepts"), routes.alias("routes")).alias("plan"))
    return rows.select("p_partkey", "p_size", F.to_json("plan").alias("plan"))


def _routes(rows: DataFrame, routes) -> DataFrame:
    return rows.select("p_partkey", F.explode(routes).alias("r")).select("p_partkey", "r.id", "r.source", "r.query", F.col("r.limit").cast("long").alias("limit"))


_P = """'("part ' || p_partkey || '"[Title/Abstract] OR "size ' || p_size || '"[Title/Abstract])'"""
_E = """'(TITLE_ABS:"part ' || p_partkey || '" OR TITLE_ABS:"size ' || p_size || '")'"""
_BP = """'((part ' || p_partkey || ') OR (size ' || p_size || '))'"""
_BE = """'("part ' || p_partkey || '" OR "size ' || p_size || '")'"""
_COMPILED = f"""SELECT p_partkey, 'p' AS id, 'pubmed' AS source, {_P} AS query, CAST(10 AS BIGINT) AS "limit" FROM part UNION ALL SELECT p_partkey, 'e', 'europe_pmc', {_E}, 10 FROM part
UNION ALL SELECT p_partkey, 'o', 'openalex', 'part ' || p_partkey, 10 FROM part"""


@query(_COMPILED)
def compiled_plans(spark, d):
    return _routes(plans(spark, d), query_plan.compiled_routes("plan", F.lit(0)))


@query(f"""SELECT * FROM ({_COMPILED}) UNION ALL SELECT p_partkey, 'add_pubmed_' || substr(sha256('["pubmed","' || replace({_BP}, '"', '\\"') || '"]'), 1, 16), 'pubmed', {_BP}, 7 FROM part
UNION ALL SELECT p_partkey, 'add_europe_pmc_' || substr(sha256('["europe_pmc","' || replace({_BE}, '"', '\\"') || '"]'), 1, 16), 'europe_pmc', {_BE}, 7 FROM part""")
def covered_plans(spark, d):
    return _routes(plans(spark, d), query_plan.covered_routes("plan", F.lit(7)))


@query(f"""SELECT p_partkey, 'precision_p' AS id, 'pubmed' AS source, {_P} AS query, CAST(4 AS BIGINT) AS "limit" FROM part UNION ALL SELECT p_partkey, 'native_broad_p', 'pubmed', {_BP}, 3 FROM part
UNION ALL SELECT p_partkey, 'precision_e', 'europe_pmc', {_E}, 4 FROM part UNION ALL SELECT p_partkey, 'native_broad_e', 'europe_pmc', {_BE}, 3 FROM part""")
def shared_plans(spark, d):
    rows = plans(spark, d).withColumn("plan", F.regexp_replace("plan", r',\{"id":"o"[^}]*\}', ""))
    return _routes(rows, query_plan.shared_routes("plan", F.lit(7)))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'plan' WHEN 1 THEN 'plan.question' WHEN 2 THEN 'plan.concepts[0].terms[0]' WHEN 3 THEN 'plan.routes[0].limit' WHEN 4 THEN 'plan.routes[1]' ELSE NULL END AS error FROM part""")
def plan_faults(spark, d):
    wrong = [
        ('"schema_version":1', '"schema_version":1,"more":2'), ('"question":"Which', '"question":"\\u0001'), ('"terms":["part', '"terms":["[part'), ('"limit":10}', '"limit":0}'), ('"id":"e"', '"id":"p"'),
    ]
    made = F
    for k, (part, other) in enumerate(wrong):
        rest = F.substring(F.col("plan"), F.instr("plan", part) + len(part), F.lit(1 << 20))
        made = made.when(F.col("p_partkey") % 6 == k, F.concat(F.substring_index("plan", part, 1), F.lit(other), rest))
    found = plans(spark, d).select("p_partkey", query_plan.compiled_routes(made.otherwise(F.col("plan")), F.lit(0)).alias("r"))
    return found.select("p_partkey", F.element_at("r", 1)["error"].alias("error"))


@arrow_udf("string")
def _rewritten(texts: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for text, key in zip(texts, keys):
        made = query_plan.add_coverage(json.loads(text), 5)
        if key % 3 == 1:
            made["original_sha256"] = "0" * 64
        if key % 3 == 2:
            made["routes"][0]["limit"] = 9
        out.append(json.dumps(made))
    return pd.Series(out)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'other_origin' ELSE 'changed_routes' END AS fault FROM part""")
def plan_provenance(spark, d):
    return plans(spark, d).select("p_partkey", query_plan.provenance_column(_rewritten("plan", "p_partkey"), "plan").alias("fault"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'trailing_boolean_operator@' || (length(source) + 2) WHEN 1 THEN 'unclosed_quote@' || (length(source) + 4) WHEN 2 THEN 'unmatched_closing_delimiter@' || length(source) ELSE '' END AS errors,
  CASE doc_id % 5 WHEN 3 THEN 'field_requires_provider_verification' WHEN 4 THEN 'mixed_boolean_precedence_requires_review' ELSE '' END AS warnings,
  CASE WHEN doc_id % 5 < 3 THEN 'error' ELSE 'warnings' END AS status FROM documents""")
def lint_queries(spark, d):
    # sources hold no delimiters or operators; letters only keep offsets plain
    text = F.expr("""CASE doc_id % 5 WHEN 0 THEN '(' || source || ' AND)' WHEN 1 THEN source || ' OR "open' WHEN 2 THEN source || ') OR b' WHEN 3 THEN source || '[zz]' ELSE source || ' AND b OR c' END""")
    rows = table(spark, d, "documents").select("doc_id", query_plan.lint_column(text, F.lit("pubmed"), F.lit("native")).alias("l"))
    marks = F.transform("l.errors", lambda e: F.concat(e["code"], F.lit("@"), e["offset"]))
    return rows.select("doc_id", F.array_join(marks, ";").alias("errors"), F.array_join("l.warnings.code", ";").alias("warnings"), "l.status")


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS title, trim(regexp_replace(source, '\s+', ' ', 'g')) AS source,
  round_even(greatest(0.0, 1 - (doc_id % 50) / 40.0), 5) AS score, 7 // 3 + CASE WHEN doc_id % 3 + 1 <= 7 % 3 THEN 1 ELSE 0 END AS quota, 'a b' AS plain FROM documents""")
def sql_functions(spark, d):
    sql.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("scholion_documents")
    return spark.sql(
        "SELECT doc_id, norm_title(split_part(text, chr(10), 1)) AS title, norm_space(source) AS source, rank_score(CAST(doc_id % 50 AS DOUBLE), 40.0D) AS score, "
        "quota(7, 3, doc_id % 3 + 1) AS quota, strip_tags('<p>a</p>b') AS plain FROM scholion_documents"
    )
