"""Registered queries over replayed scans: provider pages are made from ``documents``, parsed, and held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scholion.catalogue import query, table
from scholion.catalogue_records import DOI, RECORDS, records
from scholion.sources import replay

PAGE = 25
_TITLE = "trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))"
_YEAR = "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 1990 + doc_id % 9 END"


def _paged(rows: DataFrame, source: str, body: str) -> DataFrame:
    """Saved pages of ``PAGE`` ids each, a route a language; ``body`` joins the items of a page."""
    grouped = rows.withColumn("page", F.floor(F.col("doc_id") / PAGE)).groupBy(F.coalesce("lang", F.lit("none")).alias("route_id"), "page")
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"])  # at most PAGE rows
    left, right = body.split("@")
    raw = F.concat(F.lit(left), F.array_join(items, "" if source in ("pubmed", "arxiv") else ","), F.lit(right))
    return grouped.agg(raw.alias("raw")).withColumn("source", F.lit(source))


def _xml(x) -> F.Column:
    return F.replace(F.replace(F.replace(F.col(x) if isinstance(x, str) else x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _clean(x):
    """Without the control characters that XML doesn't hold."""
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def pubmed(spark, d) -> DataFrame:
    rows = records(spark, d)
    item = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.expr("'' || (1 + doc_id)"), F.lit("</PMID><Article><ArticleTitle>"), _xml(_clean("title")),
        F.lit("</ArticleTitle><Abstract><AbstractText Label=\"AIM\">to <i>see</i></AbstractText><AbstractText>"), _xml("source"),
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList><Journal><Title>J</Title>"),
        F.lit("<JournalIssue><PubDate><MedlineDate>"), F.coalesce(F.concat(F.col("year").cast("string"), F.lit(" Jan-Feb")), F.lit("undated")),
        F.lit("</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">"), F.col("raw_doi"),
        F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    book = F.expr("'<PubmedBookArticle><BookDocument><PMID>' || (1 + doc_id) || '</PMID><ArticleTitle>Chapter</ArticleTitle><Book><BookTitle>B</BookTitle></Book></BookDocument></PubmedBookArticle>'")
    return _paged(rows.withColumn("item", F.when(F.col("doc_id") % 10 == 9, book).otherwise(item)), "pubmed", "<PubmedArticleSet>@</PubmedArticleSet>")


def _json(rows: DataFrame, source: str, body: str, *fields) -> DataFrame:
    return _paged(rows.withColumn("item", F.to_json(F.struct(*fields))), source, body)


def openalex(spark, d) -> DataFrame:
    rows = records(spark, d)
    index = F.map_from_arrays(F.array(F.concat(F.lit("b"), "source"), F.lit("a")), F.array(F.array(F.lit(1)), F.array(F.lit(0), F.lit(2))))
    places = F.array(
        F.struct(F.lit(True).alias("is_oa"), F.col("page").alias("pdf_url"), F.lit("http://l").alias("landing_page_url")),
        F.struct((F.col("doc_id") % 2 == 0).alias("is_oa"), F.lit("http://q").alias("pdf_url"), F.lit(None).cast("string").alias("landing_page_url")),
    )
    authors = F.array(F.struct(F.struct(F.col("second_author").alias("display_name")).alias("author")))
    return _json(
        rows, "openalex", '{"results":[@],"meta":{"next_cursor":null}}', F.when(F.col("doc_id") % 10 != 3, F.expr("'https://openalex.org/W' || doc_id")).alias("id"), "title",
        F.when(F.col("doc_id") % 3 == 0, F.col("raw_doi")).alias("doi"), F.col("year").alias("publication_year"), index.alias("abstract_inverted_index"), places.alias("locations"), authors.alias("authorships"),
        (F.col("doc_id") % 100).alias("cited_by_count"),
    )


def crossref(spark, d) -> DataFrame:
    rows = records(spark, d)
    licence = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("http://creativecommons.org/licenses/by/4.0/").alias("URL"))))
    link = F.array(F.struct(F.col("page").alias("URL"), F.lit("application/pdf").alias("content-type")))
    people = F.array(F.struct(F.lit("Bo").alias("given"), F.col("source").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Group").alias("family")))
    return _json(
        rows, "crossref", '{"message":{"items":[@]}}', F.array("title").alias("title"), F.expr("'10.1000/ABC.' || doc_id").alias("DOI"), people.alias("author"),
        F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), licence.alias("license"), link.alias("link"), F.when(F.col("doc_id") % 7 == 0, "posted-content").otherwise("journal-article").alias("type"),
    )


def europe_pmc(spark, d) -> DataFrame:
    rows = records(spark, d)
    return _json(
        rows, "europe_pmc", '{"resultList":{"result":[@]}}', "title", F.concat(F.lit("Lee A., "), "second_author", F.lit(".")).alias("authorString"), F.col("year").cast("string").alias("pubYear"),
        F.expr("'pmc' || (1 + doc_id)").alias("pmcid"), F.when(F.col("doc_id") % 2 == 0, "Y").otherwise("N").alias("isOpenAccess"), F.when(F.col("doc_id") % 5 == 0, "PPR").otherwise("MED").alias("source"),
    )


def semantic_scholar(spark, d) -> DataFrame:
    rows = records(spark, d)
    ids = F.struct(F.expr(f"CASE WHEN doc_id % 3 = 0 THEN raw_doi END").alias("DOI"), F.expr("1 + doc_id").alias("PubMed"))
    return _json(
        rows, "semantic_scholar", '{"data":[@]}', F.expr("'s' || doc_id").alias("paperId"), "title", "year", ids.alias("externalIds"), F.array(F.struct(F.col("second_author").alias("name"))).alias("authors"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("page").alias("url"))).alias("openAccessPdf"), F.array(F.lit("Review")).alias("publicationTypes"),
    )


def arxiv(spark, d) -> DataFrame:
    rows = records(spark, d)
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2101."), F.expr("'' || (10000 + doc_id % 80000)"), F.lit("v1</id><title>"), _xml(_clean("title")), F.lit("</title><published>"),
        F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("</published><author><name>"), _xml("second_author"), F.lit('</name></author><link title="pdf" href="http://p"/></entry>'),
    )
    bad = F.lit("<entry><id>http://arxiv.org/api/errors#x</id><title>Error</title><summary>bad</summary></entry>")
    return _paged(rows.withColumn("item", F.when(F.col("doc_id") % 10 == 4, bad).otherwise(entry)), "arxiv", '<feed xmlns="http://www.w3.org/2005/Atom">@</feed>')


def _good(pages: DataFrame, key, *more) -> DataFrame:
    rows = replay.records(pages).where("error is null")
    return rows.select(key.cast("long").alias("doc_id"), "title", "year", *more)


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'Chapter' ELSE {_TITLE} END AS title, CASE WHEN doc_id % 10 <> 9 THEN CAST({_YEAR} AS INTEGER) END AS year,
  CASE WHEN doc_id % 10 <> 9 THEN {DOI} ELSE '' END AS doi, '' || (1 + doc_id) AS pmid, CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'AIM: to see' || chr(10) || source END AS abstract,
  CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'Ann Lee;Group' END AS people, CASE WHEN doc_id % 10 = 9 THEN 'bookSection' ELSE 'journalArticle' END AS item_type FROM documents""")
def scan_pubmed(spark, d):
    return _good(pubmed(spark, d), F.col("pmid") - 1, "doi", "pmid", "abstract", F.array_join("authors", ";").alias("people"), "item_type")


@query(f"""WITH {RECORDS} SELECT doc_id, title, CAST(year AS INTEGER) AS year, {DOI} AS doi, 'a b' || source || ' a' AS abstract, page || CASE WHEN doc_id % 2 = 0 THEN ';http://q' ELSE '' END AS pdfs,
  'http://l' AS landings, second_author AS people, CAST(doc_id % 100 AS INTEGER) AS citation_count FROM records WHERE doc_id % 10 <> 3""")
def scan_openalex(spark, d):
    more = ("doi", "abstract", F.array_join("pdf_urls", ";").alias("pdfs"), F.array_join("landing_urls", ";").alias("landings"), F.array_join("authors", ";").alias("people"), "citation_count")
    return _good(openalex(spark, d), F.regexp_extract("openalex_id", "W(.*)", 1), *more)


@query(f"""WITH {RECORDS} SELECT doc_id, title, CAST(year AS INTEGER) AS year, '10.1000/abc.' || doc_id AS doi, second_author || ';Group' AS people, CASE WHEN doc_id % 2 = 0 THEN page ELSE '' END AS pdfs,
  CASE WHEN doc_id % 7 = 0 THEN 'preprint' ELSE 'journalArticle' END AS item_type FROM records""")
def scan_crossref(spark, d):
    return _good(crossref(spark, d), F.regexp_extract("doi", "abc.(.*)", 1), "doi", F.array_join("authors", ";").alias("people"), F.array_join("pdf_urls", ";").alias("pdfs"), "item_type")


@query(f"""WITH {RECORDS} SELECT doc_id, title, CAST(year AS INTEGER) AS year, 'Lee A;' || second_author AS people, 'PMC' || (1 + doc_id) AS pmcid, doc_id % 2 = 0 AS is_oa,
  CASE WHEN doc_id % 5 = 0 THEN 'preprint' ELSE 'journalArticle' END AS item_type FROM records""")
def scan_europe_pmc(spark, d):
    return _good(europe_pmc(spark, d), F.regexp_extract("pmcid", "PMC(.*)", 1).cast("long") - 1, F.array_join("authors", ";").alias("people"), "pmcid", "is_oa", "item_type")


@query(f"""WITH {RECORDS} SELECT doc_id, title, CAST(year AS INTEGER) AS year, {DOI} AS doi, '' || (1 + doc_id) AS pmid, second_author AS people, CASE WHEN doc_id % 2 = 0 THEN page ELSE '' END AS pdfs FROM records""")
def scan_semantic_scholar(spark, d):
    return _good(semantic_scholar(spark, d), F.regexp_extract("semantic_scholar_id", "s(.*)", 1), "doi", "pmid", F.array_join("authors", ";").alias("people"), F.array_join("pdf_urls", ";").alias("pdfs"))


@query(rf"""SELECT {_TITLE} AS title, CAST({_YEAR} AS INTEGER) AS year, '2101.' || (10000 + doc_id % 80000) || 'v1' AS arxiv_id, trim(regexp_replace('Bo ' || source, '\s+', ' ', 'g')) AS people
FROM documents WHERE doc_id % 10 <> 4""")
def scan_arxiv(spark, d):
    return replay.records(arxiv(spark, d)).where("error is null").select("title", "year", "arxiv_id", F.array_join("authors", ";").alias("people"))


@query("""WITH o AS (SELECT coalesce(lang, 'none') AS route_id, doc_id % 10 = 3 AS bad FROM documents)
SELECT route_id, count(*) AS raw, count(*) FILTER (NOT bad) AS parsed, count(*) FILTER (bad) AS skipped, least(count(*) FILTER (bad), 50) AS listed,
  CASE WHEN bool_or(bad) AND NOT bool_and(bad) THEN 'partial' WHEN bool_or(bad) THEN 'error' ELSE 'ok' END AS status FROM o GROUP BY route_id""")
def row_guard(spark, d):
    out = replay.scan_status(replay.records(openalex(spark, d)))
    return out.select("route_id", "raw", "parsed", "skipped", F.size("row_errors").cast("long").alias("listed"), "status")


@query("""WITH o AS (SELECT coalesce(lang, 'none') AS route_id, doc_id, row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY doc_id) AS rank FROM documents WHERE doc_id % 10 <> 3)
SELECT route_id, doc_id, CAST(rank AS INTEGER) AS rank, round_even(greatest(0.0, 1 - (rank - 1) / 40.0), 5) AS score FROM o WHERE rank <= 40""")
def finished_scan(spark, d):
    out = replay.finish_scan(replay.records(openalex(spark, d)), 40)
    return out.select("route_id", F.regexp_extract("openalex_id", "W(.*)", 1).cast("long").alias("doc_id"), "rank", "score")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS place, CASE WHEN doc_id % 10 = 1 THEN 0 WHEN doc_id % 10 = 2 THEN 2 ELSE 1 END AS copies,
  CASE WHEN doc_id % 10 = 0 THEN 'unexpected' WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'duplicate' ELSE 'ok' END AS state FROM documents""")
def requested_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    delivered = docs.where("doc_id % 10 <> 1").unionByName(docs.where("doc_id % 10 = 2"))
    out = replay.requested_ids(delivered, docs.where("doc_id % 10 <> 0").withColumn("place", F.col("doc_id")), "doc_id", "place")
    return out.withColumn("copies", F.col("copies").cast("long"))


@query("SELECT min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS held FROM customer GROUP BY floor(c_custkey / 64)")
def id_ranges(spark, d):
    ids = table(spark, d, "customer").select("c_custkey")
    part = F.floor(F.col("c_custkey") / 64)
    counts = {r.part: r.n for r in ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # what the service counts, a row a range
    width = 64
    while width <= 64 * max(counts):
        width *= 2
    count = lambda a, b: sum(counts.get(k, 0) for k in range(a // 64, b // 64 + 1))
    ranges = replay.split_ranges(0, width - 1, 64, count)
    if not replay.ranges_agree(ranges, 0, width - 1, count):
        raise ValueError("the ranges don't add up to the whole")
    marks = spark.createDataFrame(ranges, "low_mark long, high_mark long")
    held = ids.join(F.broadcast(marks), F.col("c_custkey").between(F.col("low_mark"), F.col("high_mark")))
    return held.groupBy(part.alias("part")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"), F.count(F.lit(1)).alias("held")).drop("part")


_VERSIONS = """v AS (SELECT l_orderkey AS pmcid, l_linenumber AS version, CASE l_partkey % 5 WHEN 0 THEN 'CC_BY' WHEN 1 THEN 'TDM' WHEN 2 THEN '' WHEN 3 THEN 'unknown' ELSE 'CC BY-NC' END AS license_code,
  l_returnflag <> 'N' AS oa, l_linestatus = 'O' AS manuscript, CASE WHEN l_partkey % 7 = 0 THEN true WHEN l_partkey % 7 = 1 THEN NULL ELSE false END AS retracted FROM lineitem)"""


@query(f"""WITH {_VERSIONS} SELECT pmcid, version, CASE WHEN license_code = '' THEN NULL WHEN oa AND license_code IN ('CC_BY', 'CC BY-NC') THEN 'open_access' WHEN NOT oa AND manuscript AND license_code = 'TDM' THEN 'author_manuscript_tdm' END AS route,
  CASE WHEN license_code = '' THEN 'license_unknown' WHEN NOT (oa AND license_code IN ('CC_BY', 'CC BY-NC')) AND NOT (NOT oa AND manuscript AND license_code = 'TDM') THEN 'no_oa_version' END AS error,
  CASE WHEN retracted THEN 'retracted_do_not_use_as_active_evidence' WHEN retracted IS NULL THEN 'status_unknown' ELSE 'not_flagged_retracted' END AS evidence_use FROM v""")
def pmc_listing(spark, d):
    from scholion.sources import objects

    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS pmcid", "l_linenumber AS version", "CASE l_partkey % 5 WHEN 0 THEN 'CC_BY' WHEN 1 THEN 'TDM' WHEN 2 THEN '' WHEN 3 THEN 'unknown' ELSE 'CC BY-NC' END AS license_code",
        "l_returnflag <> 'N' AS is_pmc_openaccess", "l_linestatus = 'O' AS is_manuscript", "CASE WHEN l_partkey % 7 = 0 THEN true WHEN l_partkey % 7 = 1 THEN NULL ELSE false END AS is_retracted",
    )
    return objects.pmc_versions(rows).select("pmcid", "version", "route", "error", "evidence_use")


@query("""WITH c AS (SELECT l_orderkey AS record, l_partkey AS id, CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS kind, CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS version,
  l_returnflag = 'A' AS manuscript, l_linenumber AS article_version, l_partkey % 6 AS source FROM lineitem)
SELECT record, id, article_version, CAST(row_number() OVER (PARTITION BY record ORDER BY kind, version, manuscript, -article_version, source, 'u' || id) AS INTEGER) AS place FROM c QUALIFY place = 1""")
def candidate_order(spark, d):
    from scholion.sources import objects

    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("id"), F.expr("CASE l_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'landing' WHEN 2 THEN 'jats' ELSE 'pmc_listing' END").alias("kind"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'publishedVersion' WHEN 2 THEN 'submittedVersion' END").alias("version"), (F.col("l_returnflag") == "A").alias("is_manuscript"),
        F.col("l_linenumber").alias("article_version"), F.concat(F.lit("u"), "l_partkey").alias("url"), (F.col("l_partkey") % 6).alias("rank"),
    )
    return objects.order_candidates(rows, "record", F.col("rank")).where("place = 1").select("record", "id", "article_version", "place")


@query("""SELECT page_id, 'https://h.example/files/' || page_id || '.pdf;https://other.example/b.pdf' AS links FROM pages""")
def declared_links(spark, d):
    from scholion.sources import objects

    head = F.expr("""'<head><meta name="citation_pdf_url" content="/files/' || page_id || '.pdf#page=2"><link rel="alternate" type="application/pdf" href="https://other.example/b.pdf"></head>'""")
    tail = F.expr("""'<a type="application/pdf" href="https://other.example/b.pdf">again</a><a href="x.html">no</a>'""")
    rows = table(spark, d, "pages").select("page_id", F.concat(head, F.regexp_replace("html", "(?s)<[^>]*>", " "), tail).alias("html"))
    return rows.select("page_id", F.array_join(objects.declared_pdf_links("html", F.lit("https://h.example/a/b")), ";").alias("links"))


#: What the first page of a document shows beside the title: (text, identity). ``@`` stands for its id.
_FIRST_PAGES = [
    ("Supplementary Information", "mismatch"),
    ("Erratum", "manual_review"),
    ("doi: 10.1000/X.@.", "verified"),
    ("doi 10.1000/other.@", "manual_review"),
    ("Anna Leeson", "verified"),
    ("no identifier, nobody named", "manual_review"),
    ("Anna Leeson https://doi.org/10.1101/2024.@", "manual_review"),  # a preprint's DOI that nobody approved
    ("https://doi.org/10.21203/rs.@", "verified"),  # an approved version
    ("Anna Leeson https://arxiv.org/abs/2401.00007v2", "verified"),  # the record's number
    ("Anna Leeson https://arxiv.org/pdf/2401.00008", "manual_review"),
    ("Anna Leeson arXiv: hep-th/9901001 and arXiv:2401.00007", "manual_review"),
    ("doi 10.1000/other.@ and 10.1000/x.@", "verified"),
]


@query(f"""SELECT doc_id, list_extract([{", ".join(f"'{state}'" for _, state in _FIRST_PAGES)}], CAST((doc_id + coalesce(length(text), 0)) % {len(_FIRST_PAGES)} AS INTEGER) + 1) AS identity FROM documents""")
def page_identity(spark, d):
    from scholion.sources import objects

    which = (F.col("doc_id") + F.coalesce(F.length("text"), F.lit(0))) % len(_FIRST_PAGES)
    shown = F.replace(F.element_at(F.array(*[F.lit(x) for x, _ in _FIRST_PAGES]), which.cast("int") + 1), F.lit("@"), F.col("doc_id").cast("string"))
    title = F.expr("'A study of sodium outcomes number ' || doc_id")
    page = F.concat(shown, F.lit("\n"), F.upper(title), F.lit("\nbody text\nReferences\n10.1000/far.9"))
    rows = table(spark, d, "documents").select(
        "doc_id", page.alias("page"), title.alias("title"), F.expr("'https://doi.org/10.1000/x.' || doc_id").alias("doi"), F.array(F.lit("Anna Leeson")).alias("authors"),
        F.lit("arXiv:2401.00007v1").alias("arxiv_id"), F.array(F.expr("'10.21203/rs.' || doc_id")).alias("versions"),
    )
    return rows.select("doc_id", objects.first_page_identity("page", "title", "doi", "authors", "arxiv_id", "versions").alias("identity"))


@query("""SELECT l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS line, l_partkey || ';' || l_suppkey AS cells FROM lineitem""")
def delimited_objects(spark, d):
    from scholion.sources import objects

    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit('"'), x["l_partkey"], F.lit('",'), x["l_suppkey"])), "\n")
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(text.cast("binary").alias("content")).withColumn("name", F.lit("a.CSV"))  # a few lines an order
    rows = objects.objects(files, "file").select("file", F.posexplode("rows").alias("line", "cells"))
    return rows.select("file", "line", F.array_join("cells", ";").alias("cells"))
