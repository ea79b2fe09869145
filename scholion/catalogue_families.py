"""Registered queries over work families: roles, relations, layers, evidence between abstracts, extracted cohorts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.catalogue import query, table, works, _GRAMS
from scholion.functions import normalize as n
from scholion.operators import clinical, families, work_families

_ROLE = "CASE WHEN doc_id % 6 = 5 OR doc_id % 10 = 0 THEN 'separate_related_work' WHEN doc_id % 2 = 0 THEN 'preprint' ELSE 'journal' END"


def versions(spark, d) -> DataFrame:
    """Records of which every two neighbours are a preprint and a journal article; some are notices."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return rows.select(
        "id", F.expr("CASE WHEN id % 6 = 5 THEN 'Erratum to work ' || id ELSE 'Work of number ' || id END").alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(2001).alias("year"),
        F.lit("").alias("abstract"), F.expr("'10.1000/w' || id").alias("doi"), F.lit("").alias("pmid"), F.lit("").alias("pmcid"), F.lit("").alias("arxiv_id"),
        F.expr("CASE WHEN id % 2 = 0 THEN 'preprint' ELSE 'journalArticle' END").alias("item_type"), F.when(F.col("id") % 10 == 0, F.array(F.lit("Letter"))).alias("publication_types"),
    )


def declared(spark, d) -> DataFrame:
    """Every fourth record names the next as its journal version; some name nothing, some without provenance, some a reply."""
    rows = table(spark, d, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("subject"))
    return rows.select(
        "subject", F.expr("CASE WHEN subject % 28 = 4 THEN 'hasReply' WHEN subject % 28 = 8 THEN 'cites' ELSE 'isPreprintOf' END").alias("relation"), F.lit("DOI").alias("target_type"),
        F.expr("CASE WHEN subject % 28 = 12 THEN '10.1000/none' ELSE 'https://doi.org/10.1000/W' || (subject + 1) END").alias("target_id"), F.lit("crossref").alias("source"),
        F.expr("'doi:10.1000/w' || subject").alias("source_record"), F.expr("CASE WHEN subject % 28 = 16 THEN 'https://api.crossref.org/works/x?token=1' ELSE 'https://api.crossref.org/works/x' END").alias("evidence_url"),
        F.sha2(F.col("subject").cast("string"), 256).alias("source_sha256"),
    )


_EDGES = f"""m AS (SELECT doc_id AS id, {_ROLE} AS role FROM documents), e AS (SELECT a.id AS subject, CASE WHEN a.id % 28 = 12 THEN NULL ELSE b.id END AS object,
  CASE WHEN a.id % 28 = 4 THEN 'has-reply' WHEN a.id % 28 = 8 THEN 'cites' ELSE 'is-preprint-of' END AS relation, a.role AS r1, b.role AS r2 FROM m a LEFT JOIN m b ON b.id = a.id + 1 WHERE a.id % 4 = 0),
s AS (SELECT subject, object, relation, CASE WHEN object IS NULL THEN 'target_not_in_inventory' WHEN relation = 'has-reply' THEN 'non_version_relation' WHEN relation = 'cites' THEN 'unsupported_relation_type'
  WHEN subject % 28 = 16 THEN 'unbound_or_untrusted_provider_provenance' WHEN r1 = 'separate_related_work' OR r2 = 'separate_related_work' THEN 'separate_related_work' ELSE '' END AS reason FROM e)"""


@query(f"SELECT doc_id, {_ROLE} AS role FROM documents")
def role_labels(spark, d):
    return work_families.members(versions(spark, d)).select(F.col("id").alias("doc_id"), "role")


@query(f"SELECT doc_id, 'doi:10.1000/w' || doc_id AS aliases, CAST(1 AS INTEGER) AS ids, {_ROLE} = 'separate_related_work' AS restricted FROM documents")
def family_members(spark, d):
    rows = work_families.members(versions(spark, d))
    return rows.select(F.col("id").alias("doc_id"), F.array_join(F.filter("aliases", lambda a: ~a.startswith("title:")), ";").alias("aliases"), "ids", "restricted")


@query(f"WITH {_EDGES} SELECT subject, object, relation, reason, CASE WHEN reason = '' THEN 'proposed' ELSE 'review' END AS status, object IS NOT NULL AND relation = 'has-reply' AS parts FROM s")
def relation_status(spark, d):
    who = work_families.members(versions(spark, d))
    return work_families.resolve_relations(who, declared(spark, d)).select("subject", "object", "relation", "reason", "status", "parts")


@query(f"""WITH {_EDGES}, g AS (SELECT m.id, m.role, CASE WHEN x.subject IS NOT NULL THEN x.subject ELSE m.id END AS component FROM m LEFT JOIN s x ON x.reason = '' AND m.id = x.object)
SELECT component, count(*) AS members, arg_min(id, [CASE role WHEN 'journal' THEN 0 WHEN 'preprint' THEN 1 ELSE 3 END, -length('Work'), id]) AS representative, CASE WHEN count(*) > 1 THEN 'confirmed_relation' ELSE 'singleton' END AS classification FROM g GROUP BY component""")
def work_family_view(spark, d):
    return work_families.build(versions(spark, d), declared(spark, d)).families


@query(f"""WITH {_EDGES}, c AS (SELECT count(*) AS n FROM m), a AS (SELECT count(*) AS n FROM s WHERE reason = '')
SELECT c.n AS record_count, c.n - a.n AS confirmed_layer_family_count, c.n - a.n AS work_family_count, a.n AS confirmed_relation_families, CAST(0 AS BIGINT) AS high_confidence_metadata_families, c.n - 2 * a.n AS singleton_families,
  a.n AS accepted_provider_relations, CAST(0 AS BIGINT) AS accepted_metadata_relations, CAST(0 AS BIGINT) AS blocked_relations, (SELECT count(*) FROM s WHERE reason <> '') AS review_candidates FROM c, a""")
def family_counts(spark, d):
    return work_families.build(versions(spark, d), declared(spark, d)).counts


@query(f"""WITH {_EDGES}, p AS (SELECT subject AS a, object AS b FROM s WHERE reason = ''), bad AS (SELECT a FROM p WHERE a % 8 = 0)
SELECT a, b FROM p WHERE a NOT IN (SELECT a FROM bad)""")
def quarantined_edges(spark, d):
    from scholion.operators import graph

    who = work_families.members(versions(spark, d))
    edges = work_families.resolve_relations(who, declared(spark, d)).where("status = 'proposed'").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return families.quarantine(edges, edges.where("a % 8 = 0"), graph.connected_components(edges)).select("a", "b")


@query(f"""WITH {_GRAMS}, t AS (SELECT DISTINCT doc_id, title_key, unnest(words) AS t FROM w), m AS (SELECT doc_id, count(*) AS m FROM t GROUP BY doc_id),
y AS (SELECT h.head, b.doc_id, count(*) AS j FROM h JOIN t a ON a.doc_id = h.head JOIN t b ON b.title_key = h.title_key AND b.t = a.t WHERE b.doc_id <> h.head GROUP BY h.head, b.doc_id)
SELECT p.head, p.doc_id, CAST(p.k AS INTEGER) AS shared_fivegrams, round(CASE WHEN total = 0 THEN 0.0 ELSE 2.0 * p.k / total END, 6) AS fivegram_dice, round(coalesce(j, 0) / least(a.m, b.m), 6) AS token_containment
FROM p LEFT JOIN y ON y.head = p.head AND y.doc_id = p.doc_id JOIN m a ON a.doc_id = p.head JOIN m b ON b.doc_id = p.doc_id""")
def abstract_pairs(spark, d):
    rows = works(spark, d).where("title_key is not null").select("doc_id", "title_key", n.title("abstract").alias("words"))
    read = families.abstract_evidence(families.pairs_with_head(rows, "title_key", "doc_id", "words"), "head_words", "words")
    return read.select("head", "doc_id", "shared_fivegrams", "fivegram_dice", "token_containment")


_ABSTRACT = """'Methods: A total of ' || (1000 + doc_id) || ' adults with renal failure were studied from 2001 to ' || (2002 + doc_id % 5) || '. Results: sodium >= ' || (130 + doc_id % 9) ||
 ' raised mortality (OR = ' || (1 + doc_id % 3) || '.50, 95% CI: 0.5–9.' || doc_id % 10 || '). The hazard ratio was ' || (doc_id % 4) || '.0 (95 % CI 1.0 to 2.0). NCT0123456' || doc_id % 10 || '.'"""


@query("""SELECT doc_id, 'or' AS statistic, (1 + doc_id % 3) || '.5' AS point, '0.5' AS low, CASE WHEN doc_id % 10 = 0 THEN '9' ELSE '9.' || doc_id % 10 END AS high, 'sodium>=' || (130 + doc_id % 9) AS stratum FROM documents
UNION ALL SELECT doc_id, 'hr', '' || doc_id % 4, '1', '2', 'sodium>=' || (130 + doc_id % 9) FROM documents WHERE doc_id % 4 IN (1, 2)""")
def result_groups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(clinical.effects_of(F.expr(_ABSTRACT))).alias("e"))
    return rows.select("doc_id", "e.statistic", "e.point", "e.low", "e.high", "e.stratum")


@query("""SELECT doc_id, '' || (1000 + doc_id) AS sizes, 'adult' AS age, 'failure renal' AS conditions, '2001-' || (2002 + doc_id % 5) AS windows, 'nct0123456' || doc_id % 10 AS trials FROM documents""")
def cohort_fingerprint(spark, d):
    c = table(spark, d, "documents").select("doc_id", clinical.cohort_of(F.expr(_ABSTRACT)).alias("c"))
    return c.select(
        "doc_id", F.array_join("c.sizes", ";").alias("sizes"), F.array_join("c.population.age", ";").alias("age"), F.array_join(F.flatten("c.conditions"), " ").alias("conditions"),
        F.array_join("c.windows", ";").alias("windows"), F.array_join("c.trials", ";").alias("trials"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'sizes;population_age' END AS conflicts FROM documents""")
def clinical_pairs(spark, d):
    own = F.expr(_ABSTRACT)
    other = F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.regexp_replace(own, "A total of [0-9]+ adults", "A total of 7 children"))
    return table(spark, d, "documents").select("doc_id", F.array_join(clinical.clinical_evidence(own, other)["conflicts"], ";").alias("conflicts"))


@query("SELECT doc_id, '1200.5' AS number, 'sodium >= 145, 1.4-3.2 x 7' AS text FROM documents")
def clinical_numbers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", clinical.canonical_numbers(F.lit("1200.50")).alias("number"), clinical.canonical_numbers(F.lit("sodium ≥ 145.0, 1.40 to 3.20 x 7")).alias("text"))
    return rows
