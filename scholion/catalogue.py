"""Registered queries of the reference operators, with the SQL that expresses the same result.

The driver's tables hold no bibliographic records, so each operator runs on a stand-in: the first line of a document is
its title, its source the route that returned it, its id the position; events are retrieval attempts; labels are
judgments. Queries run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from scholion.functions import normalize as n
from scholion.operators import families, graph, identity, library, metrics, ranking, reading, resolve, shredding
from scholion.plans import boolean, query_plan

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins


def works(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, route, lang, abstract, title, nt, title_key)."""
    line = F.substring_index("text", "\n", 1)
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("route"), "lang", "n_chars", F.col("text").alias("abstract"), line.alias("title"))
    rows = rows.withColumn("nt", n.title("title"))
    return rows.withColumn("title_key", F.when(F.length("nt") >= 20, F.col("nt")))


_NT = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_WORKS = f"""works AS (
  SELECT *, CASE WHEN length(nt) >= 20 THEN nt END AS title_key FROM (
    SELECT doc_id, source AS route, lang, n_chars, text AS abstract, split_part(text, chr(10), 1) AS title,
      {_NT.format("split_part(text, chr(10), 1)")} AS nt
    FROM documents))"""

_OUTCOME = {"purchase": "downloaded", "signup": "fulltext_only", "click": "response_received", "view": "pending", "error": "download_failed"}


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, record_id, host, at, outcome)."""
    kind = F.create_map(*[F.lit(x) for pair in _OUTCOME.items() for x in pair])
    return table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("record_id"),
        F.col("user_id").alias("host"),
        F.col("ts").alias("at"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.col("event_type")).alias("outcome"),
    )


_ATTEMPTS = (
    "attempts AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS record_id, user_id AS host, ts AS tried, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OUTCOME.items())
    + " ELSE event_type END AS outcome FROM events)"
)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, …, quality, relevant): relevant is null without a judgment."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("judged_id"), "quality")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return rows.join(labels, F.col("doc_id") == F.col("judged_id"), "left").drop("judged_id").withColumn("relevant", F.col("quality") == 1)


# ---------------------------------------------------------------- scalars


@query(f"SELECT doc_id, {_NT.format('split_part(text, chr(10), 1)')} AS nt FROM documents")
def norm_title(spark, d):
    return works(spark, d).select("doc_id", "nt")


#: Identifier spellings and what they are.
SPELLINGS = [
    ("doi:10.1000/ABC.1", "doi"), ("https://doi.org/10.1234/x(1)", "doi"), ("10.5555/12345678.", "doi"), ("PMC123456", "pmcid"), ("PMCID: pmc77", "pmcid"),
    ("12345678", "pmid"), ("PMID: 1234567", "pmid"), ("1234", "text"), ("arXiv:2101.00001v2", "arxiv"), ("hep-th/9901001", "arxiv"), ("chloride outcomes", "text"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS) + ") t(query, kind) UNION ALL SELECT url AS query, 'text' AS kind FROM pages")
def identifier_kind(spark, d):
    fixed = spark.createDataFrame([(a,) for a, _ in SPELLINGS], "query string")
    return fixed.unionByName(table(spark, d, "pages").select(F.col("url").alias("query"))).select("query", n.identifier_kind("query").alias("kind"))


@query(f"WITH {_WORKS} SELECT doc_id, sha256(abstract) AS content_sha, substr(sha256(nt), 1, 16) AS identity FROM works")
def content_sha(spark, d):
    return works(spark, d).select("doc_id", F.sha2("abstract", 256).alias("content_sha"), n.identity_digest("nt").alias("identity"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", n.host("url").alias("host"))


@query("""SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'token=REDACTED&page=' || page_id AS url
FROM pages""")
def redacted_url(spark, d):
    base = F.regexp_replace("url", "#.*$", "")
    secret = F.concat(base, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("token=s"), F.col("page_id"), F.lit("&page="), F.col("page_id"), F.lit("#f"))
    return table(spark, d, "pages").select("page_id", n.redact_url(secret).alias("url"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'journal-of-' || lang ELSE 'has-' || lang END AS relation FROM documents")
def relation_type(spark, d):
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("journal_Of "), F.col("lang"))).otherwise(F.concat(F.lit("has"), F.lit("-_ "), F.upper("lang")))
    return table(spark, d, "documents").select("doc_id", n.relation_type(raw).alias("relation"))


# ---------------------------------------------------------------- planning and filters

_TERMS = [("article", "the"), ("article", "la"), ("passage", "of the"), ("passage", "de la"), ("license", "apache license")]


@query(
    f"""WITH {_WORKS}, terms AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TERMS)}) t(concept, term)),
fields AS (SELECT doc_id, 'title' AS field, nt AS body FROM works UNION ALL SELECT doc_id, 'abstract', {_NT.format("abstract")} FROM works)
SELECT doc_id, concept, term, field FROM fields, terms WHERE contains(' ' || body || ' ', ' ' || term || ' ')"""
)
def concept_evidence(spark, d):
    return query_plan.concept_evidence(works(spark, d), "doc_id", {"title": "title", "abstract": "abstract"}, _TERMS)


@query(
    """SELECT doc_id, source FROM documents WHERE contains(lower(text), 'apache license') OR contains(lower(text), 'idiot')"""
)
def required_terms(spark, d):
    return resolve.required_terms(table(spark, d, "documents"), ["Apache License ", "idiot"], "text").select("doc_id", "source")


@query(
    """SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'research' WHEN 0 THEN 'letter' ELSE 'unknown' END AS type
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 0"""
)
def type_filter(spark, d):
    types = F.when(F.col("quality") == 1, F.array(F.lit("Clinical Trial"))).when(F.col("quality") == 0, F.array(F.lit("Letter")))
    rows = judged(spark, d).withColumn("type", n.article_type(types, F.lit("journalArticle")))
    return rows.where(F.col("type").isin("research", "unknown")).select("doc_id", "type")


# ---------------------------------------------------------------- ranks, fusion, selection


@query("SELECT doc_id, source AS route, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents")
def route_rank(spark, d):
    return ranking.rank_within(table(spark, d, "documents").select("doc_id", F.col("source").alias("route")), "route", "doc_id")


_HITS = f"""{_WORKS}, hits AS (SELECT coalesce('title:' || title_key, 'doc:' || doc_id) AS candidate_id, route AS route_id,
  row_number() OVER (PARTITION BY route ORDER BY doc_id) AS rank FROM works)"""


@query(
    f"""WITH {_HITS}, best AS (SELECT candidate_id, route_id, min(rank) AS best FROM hits GROUP BY ALL)
SELECT candidate_id, round(sum(1.0 / (60 + best)), 9) AS score, count(*) AS routes FROM best GROUP BY candidate_id ORDER BY score DESC, candidate_id LIMIT 25"""
)
def rrf_topk(spark, d):
    ranked = ranking.rank_within(works(spark, d).select("doc_id", "route", "title_key"), "route", "doc_id")
    hits = ranked.select(F.coalesce(F.concat(F.lit("title:"), "title_key"), F.concat(F.lit("doc:"), "doc_id")).alias("candidate_id"), F.col("route").alias("route_id"), "rank")
    fused = resolve.reciprocal_rank_fusion(hits)
    return resolve.select_queue(fused, 25).select("candidate_id", F.round("score", 9).alias("score"), "routes")


@query(
    f"""WITH {_HITS}, pool AS (SELECT count(DISTINCT candidate_id) AS deduplicated FROM hits), eligible AS (
  SELECT count(DISTINCT candidate_id) AS eligible FROM hits WHERE candidate_id LIKE 'title:%')
SELECT (SELECT count(*) FROM hits) AS raw, deduplicated, eligible, least(eligible, 25) AS selected, deduplicated - eligible AS excluded,
  greatest(eligible - 25, 0) AS outside_cap FROM pool, eligible"""
)
def selection_statistics(spark, d):
    raw = works(spark, d).select(F.coalesce(F.concat(F.lit("title:"), "title_key"), F.concat(F.lit("doc:"), "doc_id")).alias("candidate_id"))
    pool = raw.distinct()
    return resolve.selection_statistics(raw, pool, pool.where(F.col("candidate_id").startswith("title:")), 25)


@query(
    """SELECT c_custkey, round(0.5 + log10(count(o_orderkey) + 1) / 20 + least(count(DISTINCT o_orderstatus), 5) * 0.01, 5) AS score
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def legacy_rank(spark, d):
    counted = (
        table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy("c_custkey").agg(F.count("o_orderkey").alias("citations"), F.count_distinct("o_orderstatus").alias("sources"))
    )
    return counted.select("c_custkey", resolve.legacy_score(F.lit(0.5), F.col("citations"), F.col("sources")).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id <= (SELECT max(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)) THEN 'processed' ELSE 'pending_budget' END AS state FROM documents")
def batch_pending(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    last = docs.orderBy("doc_id").limit(100).agg(F.max("doc_id").alias("last"))
    return docs.join(F.broadcast(last)).select("doc_id", F.when(F.col("doc_id") <= F.col("last"), "processed").otherwise("pending_budget").alias("state"))


# ---------------------------------------------------------------- deduplication


@query(f"WITH {_WORKS} SELECT title_key, min(doc_id) AS first, count(*) AS members, string_agg(DISTINCT route, ';' ORDER BY route) AS routes FROM works WHERE title_key IS NOT NULL GROUP BY title_key")
def title_dedup(spark, d):
    rows = works(spark, d).where("title_key is not null")
    return rows.groupBy("title_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set("route")), ";").alias("routes"))


@query(
    f"""WITH {_WORKS}, bad AS (SELECT title_key FROM works WHERE title_key IS NOT NULL GROUP BY title_key HAVING count(DISTINCT lang) > 1)
SELECT doc_id, title_key IS NOT NULL AND title_key IN (SELECT title_key FROM bad) AS identity_conflict FROM works"""
)
def identity_conflicts(spark, d):
    rows = works(spark, d).select("doc_id", "title_key", "lang")
    bad = rows.where("title_key is not null").groupBy(F.col("title_key").alias("bad")).agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b").select("bad")
    return rows.join(bad, F.col("title_key") == F.col("bad"), "left").select("doc_id", F.col("bad").isNotNull().alias("identity_conflict"))


@query(
    f"""WITH {_WORKS} SELECT title_key, min(doc_id) AS first, sha256(arg_min(abstract, [-length(abstract), doc_id])) AS longest_sha,
  string_agg(DISTINCT route, ';' ORDER BY route) AS sources, count(*) AS members FROM works WHERE title_key IS NOT NULL GROUP BY title_key"""
)
def merge_fields(spark, d):
    merged = resolve.merge_fields(works(spark, d).where("title_key is not null"), "title_key", "doc_id", "abstract", "route")
    return merged.select("title_key", "first", F.sha2("longest", 256).alias("longest_sha"), F.array_join("sources", ";").alias("sources"), "members")


@query()
def merge_fold_exact(spark, d):
    rows = works(spark, d).select(
        F.col("doc_id").alias("pos"), F.array_compact(F.array(F.concat(F.lit("title:"), "title_key"))).alias("keys"), "title",
        F.array().cast("array<string>").alias("authors"), F.crc32(F.col("lang").cast("binary")).cast("long").alias("year"), F.array("route").alias("sources"),
    )
    return identity.merge_records(rows)


@query(
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents"
)
def dup_by_hash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return resolve.first_per_hash(rows, "sha", "doc_id").select("doc_id", "first", "is_duplicate")


@query("SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'include' WHEN 0 THEN 'uncertain' ELSE 'unreviewed' END AS decision FROM documents d LEFT JOIN labels l USING (doc_id)")
def screening_join(spark, d):
    decision = F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "uncertain").otherwise("unreviewed")
    return judged(spark, d).select("doc_id", decision.alias("decision"))


@query(f"WITH {_WORKS} SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM works w WHERE w.nt = {_NT.format('b.text')}) THEN 'exists' ELSE 'create' END AS plan FROM benchmark b")
def library_plan(spark, d):
    items = table(spark, d, "benchmark").select("item_id", n.title("text").alias("key"))
    held = works(spark, d).select(F.col("nt").alias("held")).distinct()
    return items.join(held, F.col("key") == F.col("held"), "left").select("item_id", F.when(F.col("held").isNotNull(), "exists").otherwise("create").alias("plan"))


@query()
def fuzzy_title(spark, d):
    return families.fuzzy_titles(works(spark, d).where("title_key is not null"), "doc_id", "nt")


_BORN = "ascii(lang) * 256 + ascii(substr(lang, 2, 1))"  # a year that a language stands for


def _identity_rows(spark, d):
    return works(spark, d).where("lang is not null").select(
        F.col("doc_id").alias("pos"), F.array_compact(F.array(F.concat(F.lit("title:"), "title_key"))).alias("keys"), "title",
        F.expr(_BORN).cast("long").alias("year"), (F.col("doc_id") % 3 == 0).alias("original"), F.concat(F.lit("c"), "doc_id").alias("candidate"), (-F.col("doc_id")).alias("rank"),
    )


@query(
    f"""WITH {_WORKS}, rows AS (SELECT doc_id, title_key, lang FROM works WHERE lang IS NOT NULL)
SELECT doc_id AS pos, CASE WHEN title_key IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY title_key, lang) END AS entity,
  title_key IS NOT NULL AND (SELECT count(DISTINCT lang) FROM rows o WHERE o.title_key = rows.title_key) > 1 AS identity_conflict FROM rows"""
)
def identity_rounds(spark, d):
    return identity.identities(_identity_rows(spark, d))


@query(
    f"""WITH {_WORKS}, rows AS (SELECT doc_id, coalesce(title_key, 'doc:' || doc_id) AS k, lang, doc_id % 3 = 0 AS original FROM works WHERE lang IS NOT NULL)
SELECT doc_id AS pos, 'c' || coalesce(min(doc_id) FILTER (original) OVER (PARTITION BY k, lang), min(doc_id) OVER (PARTITION BY k, lang)) AS candidate_id,
  count(*) FILTER (original) OVER (PARTITION BY k, lang) > 0 AS pinned,
  (SELECT count(DISTINCT lang) FROM rows o WHERE o.k = rows.k) > 1 AS identity_conflict FROM rows"""
)
def additive_merge(spark, d):
    return identity.merge_additions(_identity_rows(spark, d), "original", "candidate", "rank")


#: One query in each provider's syntax, over the documents' own words.
_BOOLEAN = {
    "pubmed": 'the[tiab] OR en[ab] AND ("in the"[ab] OR is) NOT apache[title]',
    "europe_pmc": 'TITLE_ABS:the OR ABSTRACT:en AND NOT (ABSTRACT:"in the" OR is) AND lic*',
    "arxiv": "(ti:the OR abs:en) ANDNOT abs:apache AND (all:and OR NOT abs:of) th*",
}
_HAS = {k: f"contains(' ' || {{}} || ' ', '{v}')" for k, v in {"the": " the ", "en": " en ", "inthe": " in the ", "is": " is ", "apache": " apache ", "lic": " lic", "and": " and ", "of": " of ", "th": " th"}.items()}


def _any_of(word: str, *fields: str) -> str:
    return "(" + " OR ".join(_HAS[word].format(f) for f in fields) + ")"


@query(
    f"""WITH {_WORKS}, folded AS (SELECT doc_id, nt AS t, {_NT.format("abstract")} AS a FROM works WHERE abstract IS NOT NULL)
SELECT doc_id, (({_any_of("the", "t", "a")} OR {_any_of("en", "a")}) AND ({_any_of("inthe", "a")} OR {_any_of("is", "t", "a")})) AND NOT {_any_of("apache", "t")} AS pubmed,
  {_any_of("the", "t", "a")} OR ({_any_of("en", "a")} AND NOT ({_any_of("inthe", "a")} OR {_any_of("is", "t", "a")}) AND {_any_of("lic", "t", "a")}) AS europe_pmc,
  ({_any_of("the", "t")} OR {_any_of("en", "a")}) AND NOT {_any_of("apache", "a")} AND ({_any_of("and", "t", "a")} OR NOT {_any_of("of", "a")}) AND {_any_of("th", "t", "a")} AS arxiv
FROM folded"""
)
def boolean_matches(spark, d):
    folded = works(spark, d).where("abstract is not null").select("doc_id", "nt", n.title("abstract").alias("body"))
    return folded.select("doc_id", *[boolean.matches(q, dialect, F.col("nt"), F.col("body")).alias(dialect) for dialect, q in _BOOLEAN.items()])


def sentence_titles(spark, d):
    """(doc_id, name): a document's first sentence, folded, as its title."""
    return table(spark, d, "documents").select("doc_id", n.title(F.regexp_extract("text", r"^[^.!?\n]*", 0)).alias("name"))


@query()
def library_fuzzy(spark, d):
    """Odd documents against a library of the even ones, by first sentences; held against all pairs in the tests."""
    rows = sentence_titles(spark, d)
    return library.fuzzy_matches(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "item"), "doc_id", "item", "name")


# ---------------------------------------------------------------- metrics


@query(
    """WITH r AS (SELECT d.doc_id, d.n_chars, l.quality = 1 AS relevant FROM documents d LEFT JOIN labels l USING (doc_id)), top AS (
  SELECT * FROM r ORDER BY n_chars DESC, doc_id LIMIT 100), total AS (SELECT count(*) AS k FROM r WHERE relevant)
SELECT count(*) AS returned, count(*) FILTER (relevant) AS relevant_at_k, count(*) FILTER (relevant IS NULL) AS unknown_at_k, any_value(k) AS known_relevant,
  CASE WHEN count(*) FILTER (relevant IS NULL) = 0 THEN round(count(*) FILTER (relevant) / 100.0, 6) END AS precision_at_k,
  round(count(*) FILTER (relevant) / 100.0, 6) AS precision_lower_bound, CASE WHEN any_value(k) > 0 THEN round(count(*) FILTER (relevant) / any_value(k), 6) END AS recall
FROM top, total"""
)
def eval_at_k(spark, d):
    return metrics.evaluate_at_k(judged(spark, d), 100, [-F.col("n_chars"), F.col("doc_id")], work="doc_id")


_FINAL = f"""{_ATTEMPTS}, final AS (SELECT record_id, arg_max(outcome, event_id) AS status, arg_max(host, event_id) AS host, count(*) AS attempts FROM attempts GROUP BY record_id)"""


def final_records(spark, d):
    return attempts(spark, d).groupBy("record_id").agg(F.max_by("outcome", "event_id").alias("status"), F.max_by("host", "event_id").alias("host"), F.count(F.lit(1)).alias("attempts"))


@query(
    f"""WITH {_FINAL} SELECT count(*) AS record_count, count(*) FILTER (status <> 'pending') AS attempted_records, count(*) FILTER (status = 'pending') AS pending_records,
  count(DISTINCT host) FILTER (status = 'downloaded') AS pdf_count, count(*) FILTER (status = 'fulltext_only') AS fulltext_only_count,
  round(count(DISTINCT host) FILTER (status = 'downloaded') / count(*), 4) AS download_rate,
  CASE WHEN count(*) FILTER (status <> 'pending') > 0 THEN round(count(DISTINCT host) FILTER (status = 'downloaded') / count(*) FILTER (status <> 'pending'), 4) ELSE 0.0 END AS attempted_download_rate,
  least(count(DISTINCT host) FILTER (status = 'downloaded') / 10, 1.0) AS task_completion_rate FROM final"""
)
def outcome_summary(spark, d):
    rows = final_records(spark, d).withColumn("verified", F.lit(True)).withColumn("sha256", F.col("host").cast("string"))
    return metrics.outcome_summary(rows, target=10)


_CLASS = """CASE WHEN host % 7 = 0 THEN 'pmc_without_pdf' WHEN host % 2 = 0 AND attempts = 0 THEN 'landing_page_only' WHEN host % 2 = 0 AND attempts = 1 THEN 'single_candidate'
  WHEN host % 2 = 0 THEN 'oa_but_failed' WHEN host % 3 = 0 THEN 'doi_without_candidate' ELSE 'closed_no_route' END"""


@query(f"WITH {_FINAL}, b AS (SELECT record_id, {_CLASS} AS bucket FROM final WHERE status NOT IN ('downloaded', 'pending')) SELECT bucket, count(*) AS records, min(record_id) AS example FROM b GROUP BY bucket")
def coverage_buckets(spark, d):
    rows = final_records(spark, d).where(~F.col("status").isin("downloaded", "pending"))
    bucket = n.recoverable_class(F.when(F.col("host") % 7 == 0, "PMC1"), F.col("host") % 2 == 0, F.col("attempts"), F.when(F.col("host") % 3 == 0, "10.1000/x"))
    return rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("records"), F.min("record_id").alias("example"))


@query(
    f"""WITH {_ATTEMPTS} SELECT outcome AS source, count(*) AS offered, count(DISTINCT record_id) AS reached, count(DISTINCT record_id) FILTER (host % 5 = 0) AS won,
  CASE WHEN count(DISTINCT record_id) > 0 THEN round(count(DISTINCT record_id) FILTER (host % 5 = 0) / count(DISTINCT record_id), 4) ELSE 0.0 END AS win_rate FROM attempts GROUP BY outcome"""
)
def source_effectiveness(spark, d):
    rows = attempts(spark, d).withColumn("source", F.col("outcome")).withColumn("won", F.col("host") % 5 == 0)
    return metrics.source_effectiveness(rows, "source", "record_id", "won")


@query(
    f"""WITH {_ATTEMPTS} SELECT host, count(DISTINCT record_id) AS failed_records FROM attempts WHERE outcome = 'download_failed' GROUP BY host
ORDER BY failed_records DESC, host LIMIT 15"""
)
def failing_hosts(spark, d):
    return metrics.failing_hosts(attempts(spark, d).where("outcome = 'download_failed'"), "record_id", "host")


@query(
    f"""WITH {_ATTEMPTS} SELECT CAST(CAST(tried AS DATE) AS VARCHAR) AS run, count(*) AS attempts, count(*) FILTER (outcome = 'downloaded') AS downloaded
FROM attempts GROUP BY ROLLUP (run)"""
)
def merge_runs(spark, d):
    daily = attempts(spark, d).groupBy(F.to_date("at").cast("string").alias("run")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "downloaded").alias("downloaded"))
    return metrics.merge_runs(daily, "run", ["attempts", "downloaded"])


_FAILURES = {"response_received": "dead_link", "pending": "deferred", "fulltext_only": "landing_unresolved"}


@query(
    f"""WITH {_ATTEMPTS}, a AS (SELECT record_id, event_id, CASE outcome WHEN 'response_received' THEN 'dead_link' WHEN 'pending' THEN 'deferred'
  WHEN 'fulltext_only' THEN 'landing_unresolved' ELSE outcome END AS outcome FROM attempts)
SELECT record_id, min(event_id) FILTER (outcome = 'downloaded') AS first_success, count(*) AS attempts,
  CASE WHEN bool_or(outcome = 'downloaded') THEN 'downloaded' WHEN bool_or(outcome = 'deferred') THEN 'deferred' WHEN bool_or(outcome = 'landing_unresolved') THEN 'landing_unresolved'
  WHEN bool_or(outcome = 'dead_link') THEN 'dead_link' ELSE 'download_failed' END AS status FROM a GROUP BY record_id"""
)
def attempt_first_success(spark, d):
    names = F.create_map(*[F.lit(x) for pair in _FAILURES.items() for x in pair])
    rows = attempts(spark, d).withColumn("outcome", F.coalesce(F.try_element_at(names, F.col("outcome")), F.col("outcome")))
    return metrics.first_success(rows, "record_id", "event_id", "outcome")


@query(
    f"""WITH {_ATTEMPTS}, f AS (SELECT host, min(event_id) AS first FROM attempts WHERE outcome = 'downloaded' GROUP BY host), t AS (SELECT * FROM f ORDER BY first LIMIT 50)
SELECT max(first) AS cutoff, count(*) AS unique_files FROM t"""
)
def target_stop(spark, d):
    return metrics.target_cutoff(attempts(spark, d).where("outcome = 'downloaded'"), "host", "event_id", 50)


@query(
    """WITH p AS (SELECT user_id AS host, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS deadline FROM events WHERE event_type = 'error')
SELECT host, epoch_us(max(deadline)) AS retry_at FROM p GROUP BY host HAVING max(deadline) > (SELECT min(ts) FROM events)"""
)
def host_deadlines(spark, d):
    events = table(spark, d, "events")
    as_of = events.agg(F.min("ts")).head()[0]
    rows = events.where("event_type = 'error'").select(
        F.col("user_id").alias("host"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.get_json_object("props", "$.k").cast("long") * 1_000_000).alias("deadline")
    )
    return metrics.latest_deadlines(rows, "host", "deadline", F.lit(as_of).cast("timestamp")).select("host", F.unix_micros("retry_at").alias("retry_at"))


@query("SELECT source AS route, count(*) AS n, CASE WHEN count(*) = 0 THEN 'zero_results' WHEN count(*) >= 50 THEN 'quota_reached' ELSE 'ok' END AS status FROM documents GROUP BY source")
def route_status(spark, d):
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("status", metrics.route_status(rows, "n", 50))


@query(
    """SELECT n_nationkey, n_regionkey, CAST(floor(53 / count(*) OVER r) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 53 % count(*) OVER r THEN 1 ELSE 0 END AS quota
FROM nation WINDOW r AS (PARTITION BY n_regionkey)"""
)
def quota_allocation(spark, d):
    group = W.partitionBy("n_regionkey")  # a few routes a source
    rows = table(spark, d, "nation").withColumn("n", F.count(F.lit(1)).over(group)).withColumn("place", F.row_number().over(group.orderBy("n_nationkey")))
    return rows.select("n_nationkey", "n_regionkey", metrics.quota(53, F.col("n"), F.col("place")).alias("quota"))


# ---------------------------------------------------------------- reading


@query(
    """WITH s AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'ening', ''))) // 5 + (length(lower(text)) - length(replace(lower(text), 'de', ''))) // 2 AS score FROM documents)
SELECT doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""
)
def lexical_find(spark, d):
    return reading.lexical_find(table(spark, d, "documents").select("doc_id", "text"), "Ening, de ening", "text", "doc_id", 20).select("doc_id", "score")


@query(
    """WITH c AS (SELECT doc_id, pos, least(1000, length(text) - pos * 1000) AS length FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0)),
r AS (SELECT *, sum(length) OVER (PARTITION BY doc_id ORDER BY pos) AS running FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(running AS BIGINT) AS running FROM r WHERE running <= 4000"""
)
def pack_chunks(spark, d):
    chunks = reading.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 1000)
    return reading.pack(chunks, "doc_id", "pos", "length", most=4000).select("doc_id", "pos", F.col("running").cast("long").alias("running"))


def _covered(spark, d, passage):
    quotes = table(spark, d, "benchmark").select("item_id", F.lower(passage).alias("quote"))
    held = families.quotes_held(table(spark, d, "documents"), "doc_id", "text", quotes, "item_id", "quote")
    counted = held.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))
    return quotes.select("item_id").join(counted, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


@query(
    """WITH q AS (SELECT item_id, lower(text) AS quote FROM benchmark) SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first
FROM q LEFT JOIN documents ON contains(lower(text), quote) GROUP BY item_id"""
)
def receipt_coverage(spark, d):
    return _covered(spark, d, F.col("text"))


@query(
    """SELECT conv_id, turn, list_aggregate(list_sort(list_distinct(list(role) OVER w)), 'string_agg', ';') AS covered, CAST(sum(length(text)) OVER w AS BIGINT) AS chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def conversation_receipts(spark, d):
    window = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = table(spark, d, "conversations").withColumn("covered", F.array("role"))
    out = reading.cumulative_cover(rows, "conv_id", "turn", "covered").withColumn("chars", F.sum(F.length("text")).over(window))
    return out.select("conv_id", "turn", F.array_join("covered_so_far", ";").alias("covered"), "chars")


def _inverted(docs):
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts move once, by document; words and positions are then grouped where they are
    rows = docs.select("doc_id", n.clean_text("text").alias("t")).where("t <> ''").repartition(tasks, "doc_id")
    words = rows.select("doc_id", F.posexplode(F.split("t", " ")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("positions"))
    return reading.rebuild_inverted(index, "doc_id", "w", "positions").select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_sha FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def inverted_abstract(spark, d):
    return _inverted(table(spark, d, "documents"))


# ---------------------------------------------------------------- shredding


@query()
def html_elements(spark, d):
    elements = shredding.html_elements(table(spark, d, "pages"), "page_id", "html", mode="generic")
    return elements.groupBy("page_id", "kind", "content_role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, unnest(hrefs) AS href, CAST(unnest(range(0, len(hrefs))) AS INTEGER) AS pos FROM l""")
def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


@query()
def element_cells(spark, d):
    return shredding.cells(shredding.html_elements(table(spark, d, "pages"), "page_id", "html", mode="generic"), "page_id")


# ---------------------------------------------------------------- families


#: Distinct five-word runs of the abstracts whose title key several works share, and the works themselves with their block's head.
_GRAMS = f"""{_WORKS}, w AS (SELECT doc_id, title_key, string_split({_NT.format("abstract")}, ' ') AS words FROM works WHERE title_key IN (SELECT title_key FROM works GROUP BY title_key HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, title_key, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, title_key, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), h AS (SELECT title_key, min(doc_id) AS head FROM w GROUP BY title_key),
x AS (SELECT h.head, b.doc_id, count(*) AS k FROM h JOIN g a ON a.doc_id = h.head JOIN g b ON b.title_key = h.title_key AND b.s = a.s WHERE b.doc_id <> h.head GROUP BY h.head, b.doc_id),
p AS (SELECT h.head, w.doc_id, coalesce(k, 0) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS total FROM h JOIN w ON w.title_key = h.title_key AND w.doc_id <> h.head
  LEFT JOIN x ON x.head = h.head AND x.doc_id = w.doc_id LEFT JOIN n a ON a.doc_id = h.head LEFT JOIN n b ON b.doc_id = w.doc_id)"""


@query(f"WITH {_GRAMS} SELECT head, doc_id, round(CASE WHEN total = 0 THEN 0.0 ELSE 2.0 * k / total END, 6) AS dice FROM p")
def shingle_pairs(spark, d):
    return _shingled(works(spark, d).where("title_key is not null"))


def _shingled(rows):
    # pairs first, words after: the words of a pair are split once, not once a run
    pairs = families.pairs_with_head(rows.select("doc_id", "title_key", n.title("abstract").alias("w")), "title_key", "doc_id", "w")
    pairs = pairs.withColumn("a", F.split("head_w", " ")).withColumn("b", F.split("w", " "))
    pairs = pairs.select("head", "doc_id", families.shingles("a", 5).alias("head_s"), families.shingles("b", 5).alias("s"))
    return pairs.select("head", "doc_id", F.round(families.dice("head_s", "s"), 6).alias("dice"))


@query(
    f"""WITH {_WORKS}, t AS (SELECT doc_id, nt, list_distinct(list_filter(string_split(nt, ' '), lambda x: NOT list_contains({families.STOP_LIST_SQL}, x))) AS words,
  list_aggregate(string_split(nt, ' ')[1:3], 'string_agg', ' ') AS block FROM works WHERE title_key IS NOT NULL),
h AS (SELECT block, min(doc_id) AS head FROM t GROUP BY block)
SELECT h.head, b.doc_id, len(list_intersect(a.words, b.words)) AS shared_tokens,
  round(CASE WHEN least(len(a.words), len(b.words)) = 0 THEN 0.0 ELSE len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) END, 6) AS containment,
  len(a.words) >= 6 AND len(b.words) >= 6 AND length(a.nt) >= 45 AND length(b.nt) >= 45 AND len(list_intersect(a.words, b.words)) >= 4
    AND len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) >= 0.6 AS candidate
FROM h JOIN t a ON a.doc_id = h.head JOIN t b ON b.block = h.block WHERE b.doc_id <> h.head"""
)
def title_evidence(spark, d):
    rows = works(spark, d).where("title_key is not null").select("doc_id", "nt", F.array_join(F.slice(F.split("nt", " "), 1, 3), " ").alias("block"))
    return families.title_evidence(families.pairs_with_head(rows, "block", "doc_id", "nt"), "head_nt", "nt").select("head", "doc_id", "shared_tokens", "containment", "candidate")


_LINKS = f"""{_WORKS}, k AS (SELECT doc_id, 't:' || title_key AS key FROM works WHERE title_key IS NOT NULL UNION ALL SELECT doc_id, 's:' || sha256(abstract) FROM works),
heads AS (SELECT key, min(doc_id) AS a FROM k GROUP BY key), links AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN heads USING (key)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, w) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
comp AS (SELECT v AS doc_id, min(w) AS component FROM reach GROUP BY v)"""


def _components(spark, d):
    rows = works(spark, d).select("doc_id", "title_key", F.sha2("abstract", 256).alias("sha"))
    found = graph.connected_components(graph.star_links(rows, "doc_id", "title_key", "sha"))
    return rows.select("doc_id").join(found, F.col("doc_id") == F.col("vertex"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query(f"WITH RECURSIVE {_LINKS} SELECT doc_id, component FROM comp")
def components(spark, d):
    return _components(spark, d)


@query(
    f"""WITH RECURSIVE {_LINKS}, m AS (SELECT c.component, w.doc_id, w.n_chars, coalesce(l.quality, 2) AS role FROM comp c JOIN works w USING (doc_id) LEFT JOIN labels l USING (doc_id))
SELECT component, count(*) AS members, arg_min(doc_id, [role, -n_chars, doc_id]) AS representative,
  CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT role) > 1 THEN 'mixed' ELSE 'uniform' END AS classification FROM m GROUP BY component"""
)
def family_inventory(spark, d):
    rows = _components(spark, d).join(judged(spark, d).select("doc_id", "n_chars", F.coalesce("quality", F.lit(2)).cast("long").alias("role")), "doc_id")
    return families.inventory(rows, "component", "doc_id", "role", "n_chars")


# ---------------------------------------------------------------- joins and graph


@query(
    """SELECT DISTINCT l_suppkey AS seed, 'references' AS direction, l_partkey AS neighbour FROM lineitem
UNION SELECT DISTINCT l_partkey, 'cited_by', l_suppkey FROM lineitem"""
)
def citation_one_hop(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    seeds = edges.select(F.col("source").alias("seed")).union(edges.select("target")).distinct()
    number = lambda x: F.substring(x, 2, 20).cast("long").alias(x)
    return graph.one_hop(edges, seeds).select(number("seed"), "direction", number("neighbour"))


@query(
    """SELECT o_orderkey, count(l_linenumber) AS locations, min(l_linenumber) FILTER (l_returnflag = 'N') AS best FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def enrich_by_key(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    joined = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("locations"), F.min(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))).alias("best"))


@query(
    f"""WITH {_WORKS}, s AS (SELECT doc_id, sha256(abstract) AS sha, title_key, lang FROM works)
SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY sha) < doc_id THEN min(doc_id) OVER (PARTITION BY sha)
  WHEN title_key IS NOT NULL AND min(doc_id) OVER (PARTITION BY title_key, lang) < doc_id THEN min(doc_id) OVER (PARTITION BY title_key, lang) END AS same_as FROM s"""
)
def same_publication(spark, d):
    rows = works(spark, d).select("doc_id", F.sha2("abstract", 256).alias("sha"), "title_key", "lang")
    by_id = rows.groupBy(F.col("sha").alias("k1")).agg(F.min("doc_id").alias("m1"))
    by_title = rows.where("title_key is not null").groupBy(F.col("title_key").alias("k2"), F.col("lang").alias("k3")).agg(F.min("doc_id").alias("m2"))
    joined = rows.join(by_id, F.col("sha") == F.col("k1")).join(by_title, (F.col("title_key") == F.col("k2")) & (F.col("lang") == F.col("k3")), "left")
    return joined.select("doc_id", F.when(F.col("m1") < F.col("doc_id"), F.col("m1")).when(F.col("m2") < F.col("doc_id"), F.col("m2")).alias("same_as"))


# the other modules register themselves
from scholion import catalogue_documents, catalogue_families, catalogue_plans, catalogue_records, catalogue_runs, catalogue_scans, catalogue_streams  # noqa: E402, F401
