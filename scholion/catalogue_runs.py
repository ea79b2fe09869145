"""Registered queries over a run: evaluation, diagnosis, reports, enrichment, library plans, reading, saved inventories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from scholion.catalogue import attempts, judged, query, table, works, _ATTEMPTS, _WORKS
from scholion.catalogue_records import DOI, KEYED, NT, PMID, RECORDS, keyed, records
from scholion.functions import normalize as n
from scholion.operators import authors as people
from scholion.operators import evaluation, metrics, reading, reports, resolve
from scholion.session import shared_folder
from scholion.sources import enrichment, manifest

# ---------------------------------------------------------------- evaluation


@query(f"""WITH {_WORKS}, w AS (SELECT coalesce(title_key, 'doc:' || w.doc_id) AS work, min(struct_pack(a := -w.n_chars, b := w.doc_id)) AS place,
  arg_min(l.quality = 1, struct_pack(a := -w.n_chars, b := w.doc_id)) AS judged_first FROM works w LEFT JOIN labels l USING (doc_id) GROUP BY 1),
j AS (SELECT coalesce(title_key, 'doc:' || w.doc_id) AS work, min(struct_pack(a := -w.n_chars, b := w.doc_id, r := CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 0 END)) AS m FROM works w LEFT JOIN labels l USING (doc_id) GROUP BY 1),
top AS (SELECT work, m.r AS r FROM j ORDER BY m.a, m.b LIMIT 100), total AS (SELECT count(*) AS k FROM j WHERE m.r = 1)
SELECT count(*) AS returned, count(*) FILTER (r = 1) AS relevant_at_k, count(*) FILTER (r IS NULL) AS unknown_at_k, any_value(k) AS known_relevant,
  CASE WHEN count(*) FILTER (r IS NULL) = 0 THEN round(count(*) FILTER (r = 1) / 100.0, 6) END AS precision_at_k, round(count(*) FILTER (r = 1) / 100.0, 6) AS precision_lower_bound,
  CASE WHEN any_value(k) > 0 THEN round(count(*) FILTER (r = 1) / any_value(k), 6) END AS recall FROM top, total""")
def eval_repeats(spark, d):
    rows = judged(spark, d).join(works(spark, d).select("doc_id", "title_key"), "doc_id")
    rows = rows.withColumn("work", F.coalesce("title_key", F.concat(F.lit("doc:"), "doc_id"))).withColumn("relevant", F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False))
    return metrics.evaluate_at_k(rows, 100, [-F.col("n_chars"), F.col("doc_id")], work="work")


@query(f"""WITH {KEYED}, a AS (SELECT doc_id, unnest(list_distinct(keys)) AS alias FROM keyed), j AS (SELECT k.doc_id AS judgment, l.quality = 1 AS relevant, unnest(list_distinct(k.keys)) AS alias FROM keyed k JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
m AS (SELECT a.doc_id, min(judgment) AS judgment, max(judgment) AS last, arg_min(relevant, judgment) AS relevant FROM a JOIN j USING (alias) GROUP BY a.doc_id)
SELECT k.doc_id, judgment, relevant, coalesce(judgment <> last, false) AS conflict FROM keyed k LEFT JOIN m USING (doc_id)""")
def judgment_aliases(spark, d):
    rows = keyed(spark, d).select("doc_id", "keys")
    labels = table(spark, d, "labels").where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return evaluation.judge(rows, "doc_id", "keys", rows.join(labels, "doc_id").select(F.col("doc_id").alias("judgment"), "keys", "relevant"), "judgment", "keys", "relevant")


@query(f"""WITH {KEYED}, w AS (SELECT DISTINCT 'DOI:' || ({DOI}) AS alias FROM records WHERE ({DOI}) <> '' UNION ALL SELECT 'pmid:none')
SELECT alias, count(DISTINCT doc_id) AS matches, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS doc_id FROM w LEFT JOIN (SELECT doc_id, unnest(keys) AS k FROM keyed) ON lower(alias) = k GROUP BY alias""")
def exactly_one(spark, d):
    rows = keyed(spark, d).select("doc_id", "keys")
    wanted = rows.select(F.explode(F.filter("keys", lambda k: k.startswith("doi:"))).alias("k")).distinct().select(F.concat(F.lit("DOI:"), F.substring("k", 5, 500)).alias("alias"))
    wanted = wanted.unionByName(spark.createDataFrame([("pmid:none",)], "alias string"))
    return evaluation.select_exactly_one(rows, "keys", wanted).select("alias", "matches", F.col("row.doc_id").alias("doc_id"))


# ---------------------------------------------------------------- coverage and diagnosis


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'gold' ELSE 'green' END AS s, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT coalesce(nullif(s, ''), 'unknown') AS oa_status, count(*) AS records, count(*) FILTER (n > 0) AS with_candidates, count(*) FILTER (n = 0) AS without_candidates, round(sum(n) / count(*), 3) AS mean_candidates
FROM o GROUP BY ROLLUP (1)""")
def coverage_overview(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_linenumber").alias("candidates"))  # a few lines an order
    status = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", "gold").otherwise("green")
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left").withColumn("oa_status", status)
    return metrics.population_coverage(rows)


@query("""WITH a AS (SELECT l_suppkey % 5 AS adapter, l_orderkey AS record, CASE WHEN l_returnflag = 'N' THEN 'disabled_missing_key' WHEN l_linestatus = 'O' THEN 'ok' ELSE 'error' END AS status, l_quantity > 25 AND l_returnflag <> 'N' AS won FROM lineitem),
s AS (SELECT adapter, status, count(*) AS n FROM a GROUP BY 1, 2)
SELECT adapter, (SELECT count(DISTINCT record) FROM a x WHERE x.adapter = a.adapter) AS records, count(*) FILTER (NOT starts_with(status, 'disabled')) AS attempted, count(*) FILTER (won) AS enriched,
  (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM s WHERE s.adapter = a.adapter) AS statuses FROM a GROUP BY adapter""")
def fallback_sources(spark, d):
    status = F.when(F.col("l_returnflag") == "N", "disabled_missing_key").when(F.col("l_linestatus") == "O", "ok").otherwise("error")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("adapter"), F.col("l_orderkey").alias("record"), status.alias("status"), ((F.col("l_quantity") > 25) & (F.col("l_returnflag") != "N")).alias("won"))
    out = metrics.fallback_sources(rows, "adapter", "record", "status", "won")
    return out.select("adapter", "records", "attempted", "enriched", "statuses")


@query(f"""WITH {_ATTEMPTS}, i AS (SELECT record_id, CASE WHEN bool_or(outcome = 'downloaded') THEN 'extracted' WHEN count(*) = 1 THEN 'pending_budget' ELSE 'failed' END AS status, record_id % 2 = 0 AS reused FROM attempts GROUP BY record_id)
SELECT count(*) AS records, count(*) FILTER (status = 'extracted') AS extracted, count(*) FILTER (status = 'pending_budget') AS pending, count(*) FILTER (status = 'extracted' AND reused) AS reused,
  round(count(*) FILTER (status = 'extracted') / count(*), 4) AS extraction_rate FROM i""")
def content_progress(spark, d):
    per = attempts(spark, d).groupBy("record_id").agg(F.bool_or(F.col("outcome") == "downloaded").alias("done"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("done"), "extracted").when(F.col("n") == 1, "pending_budget").otherwise("failed")
    return metrics.content_metrics(per.withColumn("status", status).withColumn("reused", F.col("record_id") % 2 == 0), "status", "reused")


_STATES = """s AS (SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1, 2, 3) THEN 'downloaded' WHEN doc_id % 8 = 4 THEN 'fulltext_only' WHEN doc_id % 8 = 5 THEN 'deferred' WHEN doc_id % 8 = 6 THEN 'pending' ELSE 'dead_link' END AS status FROM documents),
p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'unverified_pdf' WHEN 1 THEN 'missing_pdf' WHEN 2 THEN 'changed_pdf' WHEN 3 THEN 'verified_pdf' WHEN 4 THEN CASE WHEN doc_id % 16 = 4 THEN 'fulltext_only' ELSE 'missing_fulltext_reader' END ELSE status END AS state FROM s)"""


def _states(spark, d) -> DataFrame:
    status = F.expr("CASE WHEN doc_id % 8 IN (0, 1, 2, 3) THEN 'downloaded' WHEN doc_id % 8 = 4 THEN 'fulltext_only' WHEN doc_id % 8 = 5 THEN 'deferred' WHEN doc_id % 8 = 6 THEN 'pending' ELSE 'dead_link' END")
    rows = table(spark, d, "documents").withColumn("status", status).withColumn("identity", F.when(F.col("doc_id") % 8 == 0, "unverified").otherwise("verified")).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("found", F.when(F.col("doc_id") % 8 == 1, None).when(F.col("doc_id") % 8 == 2, F.lit("0")).otherwise(F.col("sha"))).withColumn("reader", F.col("doc_id") % 16 == 4)
    return rows.withColumn("state", metrics.pdf_state("status", "identity", "sha", "found", "reader"))


@query(f"""WITH {_STATES}, a AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in metrics.NEXT_ACTIONS.items())})
SELECT doc_id, state, coalesce(a.col1, CASE WHEN state NOT IN ('verified_pdf', 'duplicate_pdf', 'fulltext_only', 'pending') THEN '{metrics.OTHER_ACTION}' END) AS next_action
FROM p LEFT JOIN a ON a.col0 = state""")
def run_check(spark, d):
    return _states(spark, d).select("doc_id", "state", metrics.next_action("state").alias("next_action"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not_checked' WHEN 1 THEN 'pending_budget' WHEN 2 THEN 'content_integrity_error' WHEN 3 THEN 'extracted_with_gaps' ELSE 'extracted' END AS state FROM documents""")
def content_check(spark, d):
    rows = table(spark, d, "documents").withColumn("status", F.expr("CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'pending_budget' ELSE 'extracted' END"))
    rows = rows.withColumn("gaps", F.when(F.col("doc_id") % 6 == 3, F.array(F.lit("page_limit"))).otherwise(F.array().cast("array<string>"))).withColumn("intact", F.col("doc_id") % 6 != 2)
    return rows.select("doc_id", metrics.content_state("status", "gaps", "intact").alias("state"))


@query(f"""WITH {_STATES}, {_ATTEMPTS}, b AS (SELECT doc_id FROM p WHERE state NOT IN ('verified_pdf', 'duplicate_pdf', 'fulltext_only', 'pending'))
SELECT CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'landing' END AS stage, outcome, host % 3 AS source, count(*) AS attempts FROM attempts
WHERE outcome NOT IN ('downloaded', 'already_downloaded', 'response_received', 'resolved', 'fulltext_only', 'extracted') AND record_id IN (SELECT doc_id FROM b) GROUP BY 1, 2, 3""")
def failed_attempts(spark, d):
    rows = attempts(spark, d).withColumn("stage", F.when(F.col("event_id") % 2 == 0, "direct").otherwise("landing")).withColumn("source", F.col("host") % 3)
    return metrics.failed_attempts(rows, _states(spark, d).select(F.col("doc_id").alias("record_id"), "state"), "record_id", "state", "stage", "outcome", "source")


# ---------------------------------------------------------------- reports

_REPORTED = f"""{RECORDS}, r AS (SELECT *, {DOI} AS doi, {PMID} AS pmid, CASE doc_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'dead_link' WHEN 2 THEN 'deferred' ELSE 'odd' END AS download_status,
  CASE WHEN doc_id % 4 = 1 THEN 'gone' ELSE '' END AS failure_reason FROM records)"""


def _reported(spark, d) -> DataFrame:
    rows = records(spark, d).withColumn("doi", n.doi("raw_doi")).withColumn("pmid", n.pmid("raw_pmid"))
    rows = rows.withColumn("download_status", F.expr("CASE doc_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'dead_link' WHEN 2 THEN 'deferred' ELSE 'odd' END"))
    return rows.withColumn("failure_reason", F.when(F.col("doc_id") % 4 == 1, "gone").otherwise("")).withColumn("verified", F.col("doc_id") % 4 == 0)


@query(f"""WITH {_REPORTED}, l AS (
  SELECT doc_id, list_filter([
    '## ' || title,
    '- `' || download_status || '`: ' || CASE download_status WHEN 'dead_link' THEN '{reports.GUIDANCE["dead_link"]}' WHEN 'deferred' THEN '{reports.GUIDANCE["deferred"].replace("'", "''")}' ELSE '{reports.OTHERWISE}' END,
    '- What was recorded: ' || coalesce(nullif(failure_reason, ''), '{reports.NO_REASON}'),
    CASE WHEN doc_id % 4 = 2 THEN '- Next attempt from: 2024-01-' || lpad('' || (1 + doc_id % 28), 2, '0') END,
    '- Attempts so far: ' || doc_id % 3,
    CASE WHEN doi <> '' THEN '- DOI: https://doi.org/' || doi END,
    CASE WHEN pmid <> '' THEN '- PubMed: https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' END,
    CASE WHEN doc_id % 5 = 0 THEN '- Europe PMC: https://europepmc.org/articles/PMC' || doc_id END,
    CASE WHEN doc_id % 7 = 0 THEN '- Page: https://example.org/' || doc_id END], lambda x: x IS NOT NULL) AS lines
  FROM r WHERE doc_id % 4 <> 0)
SELECT doc_id, CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM l""")
def failure_report(spark, d):
    rows = _reported(spark, d).withColumn("retry_at", F.expr("CASE WHEN doc_id % 4 = 2 THEN '2024-01-' || lpad(1 + doc_id % 28, 2, '0') END"))
    rows = rows.withColumn("attempts", F.expr("slice(array('a', 'b', 'c'), 1, cast(doc_id % 3 as int))"))
    rows = rows.withColumn("pmcid", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'PMC' || doc_id ELSE '' END")).withColumn("url", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'https://example.org/' || doc_id END"))
    return reports.failure_report(rows, "doc_id", "download_status", "verified")


@query(rf"""WITH {_REPORTED} SELECT doc_id, '| ' || doc_id || ' | ' || replace(title, '|', '\|') || ' | ' || coalesce('' || year, '') || ' | J | ' || coalesce(nullif(doi, ''), nullif(pmid, ''), '') || ' | ' || download_status || ' | ' || replace(source, '|', '\|') || ' |' AS value FROM r""")
def inventory_report(spark, d):
    rows = _reported(spark, d).withColumn("journal", F.lit("J")).withColumn("pmcid", F.lit("")).withColumn("arxiv_id", F.lit(None).cast("string")).withColumn("sources", F.array("source"))
    return reports.inventory_markdown(rows, "doc_id")


@query(rf"""WITH {_REPORTED} SELECT doc_id, '| ' || doc_id || ' | ' || CASE doc_id % 3 WHEN 1 THEN 'create' ELSE 'imported_with_pdf' END || ' | ' || replace(title, '|', '\|') || ' | ' ||
  CASE doc_id % 3 WHEN 1 THEN 'K' || doc_id ELSE '[K' || doc_id || '](zotero://select/library/items/K' || doc_id || ')' END || ' |' AS value FROM r WHERE doc_id % 3 <> 0""")
def import_preview(spark, d):
    rows = _reported(spark, d).withColumn("plan", F.expr("CASE doc_id % 3 WHEN 1 THEN 'create' WHEN 2 THEN 'imported_with_pdf' END")).withColumn("key", F.expr("'K' || doc_id"))
    return reports.import_preview(rows, "doc_id", "plan", "key")


@query(f"""WITH {_ATTEMPTS}, e AS (SELECT outcome AS source, count(*) AS offered, count(DISTINCT record_id) AS reached, count(DISTINCT record_id) FILTER (host % 5 = 0) AS won FROM attempts GROUP BY outcome)
SELECT source, '| ' || source || ' | ' || offered || ' | ' || reached || ' | ' || won || ' | ' || format('{{:.2f}}', CAST(round(won / reached, 4) * 100 AS DOUBLE)) || ' % |' AS value FROM e""")
def coverage_report(spark, d):
    rows = attempts(spark, d).withColumn("source", F.col("outcome")).withColumn("won", F.col("host") % 5 == 0)
    return reports.coverage_markdown(metrics.source_effectiveness(rows, "source", "record_id", "won"))


@query("""SELECT '{"records":' || (SELECT count(*) FROM documents) || ',"states":{' || (SELECT string_agg('"' || s || '":' || n, ',' ORDER BY s) FROM (SELECT coalesce(lang, 'not_planned') AS s, count(*) AS n FROM documents GROUP BY 1)) || '}}' AS value""")
def run_summary(spark, d):
    docs = table(spark, d, "documents")
    return reports.run_summary(docs.agg(F.count(F.lit(1)).alias("records")), docs.select("lang"), "lang")


@query(f"""WITH {_REPORTED} SELECT title, first_author || '; ' || second_author AS authors, '' || year AS year, doi, download_status FROM r""")
def csv_report(spark, d):
    from scholion.sources import replay

    return replay.csv_report(_reported(spark, d), ["title", "authors", "year", "doi", "download_status"])


# ---------------------------------------------------------------- enrichment


def _enriched(spark, d) -> DataFrame:
    rows = records(spark, d).select(F.col("doc_id").alias("record"), n.doi("raw_doi").alias("doi"), F.expr("'A title of number ' || doc_id").alias("title"), F.expr("1990 + doc_id % 9").alias("year"), "authors", F.col("source"))
    return rows.withColumn("download_status", F.when(F.col("record") % 10 == 0, "downloaded").otherwise("pending")).withColumn("identity_status", F.lit("verified"))


def _answers(rows: DataFrame, service: str, *fields) -> DataFrame:
    key = F.when(F.col("doi") != "", F.col("doi")).otherwise(n.title("title"))
    return rows.select(F.lit(service).alias("service"), key.alias("key"), F.to_json(F.struct(*fields)).alias("raw")).dropDuplicates(["key"])


_ASKED = f"""e AS (SELECT doc_id AS record, source, {DOI} AS doi, doc_id AS id FROM documents)"""


@query(f"""WITH {_ASKED} SELECT record, 'http://b/' || doi || '.pdf' AS url, 'unpaywall' AS source, 'cc-by' AS license, 'publishedVersion' AS version, 'pdf' AS kind FROM e WHERE doi <> ''
UNION ALL SELECT record, 'http://l/' || doi, 'unpaywall_landing', '', '', 'landing' FROM e WHERE doi <> ''""")
def enrich_unpaywall(spark, d):
    rows = _enriched(spark, d)
    null = F.lit(None).cast("string")
    best = F.struct(F.concat(F.lit("http://b/"), "doi", F.lit(".pdf")).alias("url_for_pdf"), null.alias("url_for_landing_page"), F.concat(F.lit("http://b/"), "doi", F.lit(".pdf")).alias("url"), F.lit("cc-by").alias("license"), F.lit("publishedVersion").alias("version"))
    other = F.struct(null.alias("url_for_pdf"), F.concat(F.lit("http://l/"), "doi").alias("url_for_landing_page"), null.alias("url"), null.alias("license"), null.alias("version"))
    return enrichment.unpaywall(rows, _answers(rows, "unpaywall", best.alias("best_oa_location"), F.array(best, other).alias("oa_locations"), F.lit(True).alias("is_oa")))


@query("""SELECT doc_id AS record, 'https://www.medrxiv.org/content/10.1101/x' || doc_id || 'v10.full.pdf' AS url, 'medrxiv' AS source, 'cc_by' AS license, 'submittedVersion' AS version, 'pdf' AS kind FROM documents WHERE doc_id % 3 = 0""")
def enrich_preprints(spark, d):
    rows = _enriched(spark, d).withColumn("doi", F.when(F.col("record") % 3 == 0, F.concat(F.lit("10.1101/x"), "record")).otherwise(""))
    one = lambda v, doi: F.struct(doi.alias("doi"), F.lit(v).alias("version"), F.lit("cc_by").alias("license"), F.lit("medrxiv").alias("server"))
    items = F.array(one("9", F.col("doi")), one("10", F.upper("doi")), one("x", F.col("doi")), one("99", F.lit("10.1101/other")))
    return enrichment.preprint_servers(rows, _answers(rows, "preprints", items.alias("collection")))


@query("""SELECT doc_id AS record, 'http://p/' || doc_id AS url, 'europe_pmc_preprint' AS source, '' AS license, 'submittedVersion' AS version, 'pdf' AS kind FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 <= 2""")
def enrich_titles(spark, d):
    rows = _enriched(spark, d)
    item = F.struct(F.upper("title").alias("title"), (F.col("year") + F.col("record") % 4).cast("string").alias("pubYear"), F.array(F.lit("Lee AB"), F.lit("Maria Anna O'Neil")).alias("authors"), F.concat(F.lit("http://p/"), "record").alias("url"), F.lit(None).cast("string").alias("license"))
    return enrichment.preprints_by_title(rows, rows.select(F.lit("preprint_titles").alias("service"), F.lit("").alias("key"), F.to_json(F.struct(F.array(item).alias("results"))).alias("raw")))


@query("""SELECT doc_id AS record, 'http://c/' || doc_id || '.pdf' AS url, 'core' AS source, 'cc' AS license, 'repositoryVersion' AS version, 'pdf' AS kind FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'http://s/' || doc_id, 'core_landing', 'cc', 'repositoryVersion', 'landing' FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 2 = 0""")
def enrich_core(spark, d):
    rows = _enriched(spark, d).withColumn("doi", F.lit(""))
    item = F.struct(
        F.lit("").alias("doi"), "title", F.when(F.col("record") % 2 == 0, F.col("year")).otherwise(F.col("year") + 1).cast("string").alias("yearPublished"), F.transform("authors", lambda x: F.struct(x.alias("name"))).alias("authors"),
        F.lit("cc").alias("license"), F.concat(F.lit("http://c/"), "record", F.lit(".pdf")).alias("downloadUrl"), F.array(F.concat(F.lit("http://c/"), "record", F.lit(".pdf")), F.concat(F.lit("http://s/"), "record"), F.lit("ftp://x")).alias("sourceFulltextUrls"),
    )
    return enrichment.core(rows, _answers(rows, "core", F.array(item).alias("results")))


@query("""SELECT doc_id AS record, 'http://o/' || doc_id || '.pdf' AS url, 'openaire' AS source, 'l' AS license, 'repositoryVersion' AS version, 'pdf' AS kind FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 5 <> 1
UNION ALL SELECT doc_id, 'http://o/page', 'openaire_landing', 'l', 'repositoryVersion', 'landing' FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 5 <> 1""")
def enrich_openaire(spark, d):
    rows = _enriched(spark, d).withColumn("doi", F.concat(F.lit("10.1000/o"), "record"))
    instance = lambda code, *urls: F.struct(F.struct(F.lit(code).alias("code"), F.lit("x").alias("label")).alias("accessRight"), F.lit("l").alias("license"), F.array(*urls).alias("urls"))
    instances = F.array(instance("c_abf2", F.concat(F.lit("http://o/"), "record", F.lit(".pdf")), F.lit("http://o/page")), instance("closed", F.lit("http://closed/x.pdf")))
    pid = F.struct(F.lit("DOI").alias("scheme"), F.when(F.col("record") % 5 == 1, F.lit("10.1000/another")).otherwise(F.upper("doi")).alias("value"))
    item = F.struct(F.array(pid).alias("pids"), "title", F.col("title").alias("mainTitle"), F.lit("2000-01-01").alias("publicationDate"), F.array(F.struct(F.lit("N").alias("fullName"))).alias("authors"), instances.alias("instances"))
    return enrichment.openaire(rows, _answers(rows, "openaire", F.array(item).alias("results")))


@query("""SELECT doc_id AS record, 'http://d/' || doc_id AS url, 'doaj' AS source, '' AS license, 'publishedVersion' AS version, 'pdf' AS kind FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, 'http://d/html', 'doaj_landing', '', 'publishedVersion', 'landing' FROM documents WHERE doc_id % 10 <> 0""")
def enrich_doaj(spark, d):
    rows = _enriched(spark, d).withColumn("doi", F.concat(F.lit("10.1000/d"), "record"))
    links = F.array(F.struct(F.concat(F.lit("http://d/"), "record").alias("url"), F.lit("application/pdf").alias("content_type")), F.struct(F.lit("http://d/html").alias("url"), F.lit("text/html").alias("content_type")))
    body = F.struct(F.array(F.struct(F.lit("doi").alias("type"), F.col("doi").alias("id"))).alias("identifier"), "title", F.lit("1").alias("year"), F.array(F.struct(F.lit("N").alias("name"))).alias("author"), links.alias("link"))
    return enrichment.doaj(rows, _answers(rows, "doaj", F.array(F.struct(body.alias("bibjson"))).alias("results")))


@query("""SELECT doc_id AS record, 'is-preprint-of' AS relation, '10.1000/j' || doc_id AS target, 'doi' AS target_type, 'doi:10.1000/p' || doc_id AS source_record, 'https://api.crossref.org/works/10.1000%2Fp' || doc_id AS evidence_url,
  sha256('{"DOI":"10.1000/p' || doc_id || '","relation":{"isPreprintOf":[{"id":" 10.1000/j' || doc_id || '","id-type":"doi"},{"id":" ","id-type":"doi"}]}}') AS source_sha256 FROM documents""")
def version_edges(spark, d):
    raw = F.expr("""'{"DOI":"10.1000/p' || doc_id || '","relation":{"isPreprintOf":[{"id":" 10.1000/j' || doc_id || '","id-type":"doi"},{"id":" ","id-type":"doi"}]}}'""")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record"), F.concat(F.lit("10.1000/p"), "doc_id").alias("doi"), raw.alias("raw"))
    return enrichment.version_edges(rows, "record", "doi", "raw")


# ---------------------------------------------------------------- libraries, populations, differences


@query(f"""WITH {RECORDS}, r AS (SELECT doc_id, {DOI} AS doi, {NT} AS nt FROM records), a AS (SELECT * FROM r WHERE doc_id % 2 = 0), i AS (SELECT * FROM r WHERE doc_id % 2 = 1),
x AS (SELECT doi, min(doc_id) AS item FROM i WHERE doi <> '' GROUP BY doi), t AS (SELECT nt, min(doc_id) AS item, arg_min(doi, doc_id) AS its FROM i WHERE nt <> '' GROUP BY nt)
SELECT a.doc_id, CASE WHEN x.item IS NOT NULL THEN 'exists' WHEN t.item IS NOT NULL AND a.doi <> '' AND t.its <> '' AND a.doi <> t.its THEN 'review' WHEN t.item IS NOT NULL THEN 'exists' ELSE 'create' END AS action,
  CASE WHEN x.item IS NOT NULL THEN 'doi' WHEN t.item IS NOT NULL AND a.doi <> '' AND t.its <> '' AND a.doi <> t.its THEN 'title_doi_conflict' WHEN t.item IS NOT NULL THEN 'title' ELSE 'no_match' END AS reason, coalesce(x.item, t.item) AS item
FROM a LEFT JOIN x ON a.doi = x.doi LEFT JOIN t ON a.nt = t.nt""")
def import_plan(spark, d):
    rows = records(spark, d).select("doc_id", n.doi("raw_doi").alias("doi"), "title")
    return resolve.library_plan(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "item"), "doc_id", "item")


@query("""SELECT 'key:' || n_nationkey AS wanted, '' || n_nationkey AS key, CAST(1 AS BIGINT) AS matches FROM nation UNION ALL SELECT upper(r_name) || ' ' AS wanted, 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'twice', NULL, 2 UNION ALL SELECT 'key:none', NULL, 0""")
def collection_lookup(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    held = nation.select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("name")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lower("r_name").alias("name")))
    held = held.unionByName(spark.createDataFrame([("a", "Twice"), ("b", "twice ")], "key string, name string"))
    wanted = nation.select(F.concat(F.lit("key:"), "n_nationkey").alias("wanted")).unionByName(region.select(F.concat(F.upper("r_name"), F.lit(" ")).alias("wanted")))
    return resolve.find_collections(wanted.unionByName(spark.createDataFrame([("twice",), ("key:none",)], "wanted string")), held)


@query("""WITH r AS (SELECT c_custkey AS node, c_custkey // 2 AS key, CASE WHEN c_custkey % 4 = 0 THEN 'd' || c_custkey ELSE '' END AS doi FROM customer WHERE c_custkey % 2 = 0),
a AS (SELECT c_custkey AS node, c_custkey // 2 + CASE WHEN c_custkey % 3 = 0 THEN 1000000 ELSE 0 END AS key, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE '' END AS doi FROM customer WHERE c_custkey % 2 = 1),
j AS (SELECT a.node, a.key, r.node AS rec, r.node IS NOT NULL AND NOT (r.doi <> '' AND a.doi <> '' AND r.doi <> a.doi) AS fits FROM a LEFT JOIN r USING (key)),
c AS (SELECT rec, count(*) AS n FROM j WHERE fits GROUP BY rec), bad AS (SELECT DISTINCT key FROM j WHERE NOT fits AND rec IS NOT NULL)
SELECT r.node, r.key, 'record' AS origin, coalesce(n, 0) AS legacy_attempts, r.key IN (SELECT key FROM bad) AS identity_conflict FROM r LEFT JOIN c ON rec = r.node
UNION ALL SELECT node, key, 'attempt', 0, rec IS NOT NULL FROM j WHERE NOT fits""")
def population_union(spark, d):
    c = table(spark, d, "customer")
    mine = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS node", "c_custkey div 2 AS key", "CASE WHEN c_custkey % 4 = 0 THEN 'd' || c_custkey ELSE '' END AS doi")
    theirs = c.where("c_custkey % 2 = 1").selectExpr("c_custkey AS node", "c_custkey div 2 + CASE WHEN c_custkey % 3 = 0 THEN 1000000 ELSE 0 END AS key", "CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE '' END AS doi")
    return resolve.union_population(mine, theirs, "key", "node", ("doi",))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(spark, d):
    return reading.uncovered(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.doc_id < y.doc_id AND x.doc_id - x.doc_id % 4 = y.doc_id - y.doc_id % 4""")
def author_pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array(F.expr("'Writer' || (doc_id - doc_id % 4) || ' AB'"), F.expr("'Own' || doc_id || ' C'")).alias("authors"))
    return people.shared_author_pairs(rows, "doc_id", "authors", part=2).select("a", "b")


# ---------------------------------------------------------------- reading


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS n, 0 AS pos, 0 AS start, 0 AS stop FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, n, pos + 1, stop, CASE WHEN stop + 4000 >= n THEN n ELSE coalesce(nullif(greatest(
    CASE WHEN strpos(reverse(substr(text, stop + 2001, 2000)), chr(10) || chr(10)) > 0 THEN stop + 2000 + 2000 - strpos(reverse(substr(text, stop + 2001, 2000)), chr(10) || chr(10)) + 1 ELSE 0 END,
    CASE WHEN strpos(reverse(substr(text, stop + 2001, 2000)), ' .') > 0 THEN stop + 2000 + 2000 - strpos(reverse(substr(text, stop + 2001, 2000)), ' .') + 1 ELSE 0 END), 0), stop + 4000) END
  FROM c WHERE stop < n)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM c WHERE pos > 0""")
def chunks(spark, d):
    return reading.chunk(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", "start", "end")


_CELLS = """c AS (SELECT doc_id, pos, least(1000, length(text) - pos * 1000) AS length FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0))"""


@query(f"""WITH {_CELLS}, r AS (SELECT *, sum(length) OVER (PARTITION BY doc_id ORDER BY pos) AS running FROM c WHERE pos > 2 AND doc_id % 3 <> 0)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(running AS BIGINT) AS running FROM r WHERE running <= 4000""")
def next_pack(spark, d):
    cells = reading.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 1000)
    offered = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("pos"))
    covered = offered.where("doc_id % 3 <> 0 or pos <> 1")
    return reading.next_pack(cells, offered, covered, "doc_id", "pos", "length", 4000).select("doc_id", "pos", F.col("running").cast("long").alias("running"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN contains(text, substr(text, 5, 30)) AND length(substr(text, 5, 30)) > 0 WHEN 1 THEN false ELSE false END AS verified FROM documents""")
def verified_quotes(spark, d):
    docs = table(spark, d, "documents")
    quote = F.when(F.col("doc_id") % 4 == 0, F.substring("text", 5, 30)).when(F.col("doc_id") % 4 == 1, F.lit("")).when(F.col("doc_id") % 4 == 2, F.concat(F.substring("text", 1, 9), F.lit("\x01"))).otherwise(F.substring("text", 1, 9))
    notes = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 3, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("chunk_id"), quote.alias("quote"))
    return reading.verify_quotes(notes, docs.select(F.col("doc_id").alias("chunk_id"), "text")).select("doc_id", "verified")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 1 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn) THEN 'changed' END AS fault FROM conversations c WHERE turn % 5 = 1
UNION ALL SELECT conv_id, min(turn), 'missing_predecessor' FROM conversations GROUP BY conv_id""")
def receipt_faults(spark, d):
    name = lambda conv, turn: F.concat(F.col(conv), F.lit("/"), F.col(turn))
    rows = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    before = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    chain = rows.join(before, (F.col("c") == F.col("conv_id")) & (F.col("t") < F.col("turn")), "left").groupBy("conv_id", "turn").agg(F.max("t").alias("previous"))
    chain = chain.select(name("conv_id", "turn").alias("receipt"), F.coalesce(F.concat(F.col("conv_id"), F.lit("/"), F.col("previous")), F.concat(F.lit("none/"), "conv_id")).alias("previous"), "turn")
    chain = chain.withColumn("digest", F.sha2("receipt", 256)).withColumn("claimed", F.when(F.col("turn") % 5 == 1, F.lit("x")).otherwise(F.col("digest")))
    faults = reading.receipt_faults(chain, "receipt", "previous", "digest", "claimed")
    return faults.select(F.split("receipt", "/")[0].cast("long").alias("conv_id"), F.split("receipt", "/")[1].cast("long").alias("turn"), "fault")


@query("""SELECT doc_id, sha256('src' || doc_id) AS source_sha256, sha256(substr(text, 1, 100)) AS text_sha256, 0 AS char_start, least(100, length(text)) AS char_end FROM documents""")
def locators(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("src"), "doc_id"), 256).alias("sha"), F.substring("text", 1, 100).alias("part"), F.lit(0).cast("long").alias("start"), F.least(F.lit(100), F.length("text")).cast("long").alias("end"))
    return reading.locator(rows, "doc_id", "sha", "part", "start", "end")


@query("""WITH p AS (SELECT o_orderkey AS document, unnest(range(1, 8)) AS page FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY page) AS place FROM p WHERE NOT (page <= document % 4))
SELECT document, page, document % 4 + place AS number FROM o WHERE place <= 3""")
def page_continuation(spark, d):
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("page"))
    return reading.missing_pages(pages, pages.where("page <= document % 4"), "document", "page", 3)


# ---------------------------------------------------------------- saved inventories, integrity


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def manifest_round_trip(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    manifest.save(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), path, {"query": "all"})
    return manifest.load(spark, path)[0]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_run(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    manifest.save(table(spark, d, "documents").select("doc_id"), path, {"run": 1})
    _, rest = manifest.resume(spark, path, f"{path}-2", table(spark, d, "labels"), "doc_id", {"run": 2})
    return rest


@query("""SELECT doc_id AS document, '' || doc_id AS object, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 7 = 1
UNION ALL SELECT doc_id, 'o' || doc_id, 'missing' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 100000000, 'x' || doc_id, 'missing' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id + 100000000, 'x' || doc_id, 'unbound' FROM documents WHERE doc_id % 11 = 0""")
def source_integrity(spark, d):
    docs = table(spark, d, "documents")
    claims = docs.select(F.col("doc_id").alias("document"), F.when(F.col("doc_id") % 7 == 1, F.lit("0")).otherwise(F.sha2("text", 256)).alias("sha256"))
    parts = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document"), F.concat(F.lit("o"), "doc_id").alias("object"), F.lit("0").alias("sha256"))
    loose = docs.where("doc_id % 11 = 0").select((F.col("doc_id") + 100_000_000).alias("document"), F.concat(F.lit("x"), "doc_id").alias("object"), F.lit("0").alias("sha256"))
    files = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    return manifest.verify_sources(claims, parts.unionByName(loose), files)


@query("""SELECT doc_id, doc_id % 3 = 0 AS hit FROM documents""")
def extraction_cache(spark, d):
    rows = table(spark, d, "documents").withColumn("key", manifest.cache_key(F.sha2("text", 256), F.lit("parser"), F.col("doc_id")))
    cache = rows.where("doc_id % 3 <> 2").select("key", F.concat(F.lit("p"), "doc_id").alias("payload"), F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat(F.lit("p"), "doc_id"), 256)).otherwise("bad").alias("digest"))
    hits, misses = manifest.cached(rows.select("doc_id", "key"), cache, "key", "payload", "digest")
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))
