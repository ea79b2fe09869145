"""Lookup joins of records with saved answers of open-access services.

A saved answer is one row: (service, key, raw), ``key`` the DOI or normalised title that was asked for. Every adapter gives
candidate rows (record, url, source, license, version, kind); ``enrich`` runs them in a fixed order and reports a
status for each. Answers are parsed by declared schemas, nested links are exploded, and identity is checked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scholion.functions import normalize as n
from scholion.functions.records import direct_pdf
from scholion.operators import authors as people

OUT = ["record", "url", "source", "license", "version", "kind"]
_S = "string"


def _found(rows: DataFrame, source: Column, kind: Column, version) -> DataFrame:
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    made = rows.select("record", F.trim(text("url")).alias("url"), source.alias("source"), text("license").alias("license"), version.alias("version"), kind.alias("kind"))
    return made.where(n.is_web_url("url")).dropDuplicates(["record", "url", "kind"])


def _asked(records: DataFrame, answers: DataFrame, service: str, schema: str, force: bool = False) -> DataFrame:
    """Records without a verified file, joined with the service's answer for their DOI or else title."""
    wanted = records if force else records.where(~direct_pdf("download_status", "identity_status"))
    wanted = wanted.withColumn("__key", F.when(F.col("doi") != "", F.col("doi")).otherwise(n.title("title"))).where("__key <> ''")
    saved = answers.where(F.col("service") == service).select(F.col("key").alias("__asked"), F.from_json("raw", schema).alias("answer"))
    return wanted.join(saved, F.col("__key") == F.col("__asked"))


def unpaywall(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Every open location, the best first; a landing page where it isn't the PDF itself."""
    place = f"struct<url_for_pdf:{_S},url_for_landing_page:{_S},url:{_S},license:{_S},version:{_S}>"
    rows = _asked(records.where("doi <> ''"), answers, "unpaywall", f"best_oa_location {place}, oa_locations array<{place}>, is_oa boolean", force=True)
    places = rows.select("record", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("answer.best_oa_location"), F.coalesce("answer.oa_locations", F.array().cast(f"array<{place}>")))))).alias("p"))
    flat = places.select("record", "p.*")
    pdf = flat.withColumn("url", F.col("url_for_pdf")).where("url <> ''")
    page = flat.withColumn("url", F.coalesce(F.nullif("url_for_landing_page", F.lit("")), "url")).where("url <> '' and not (url <=> url_for_pdf)")
    version = F.coalesce("version", F.lit(""))
    return _found(pdf, F.lit("unpaywall"), F.lit("pdf"), version).unionByName(_found(page, F.lit("unpaywall_landing"), F.lit("landing"), version))


def preprint_servers(records: DataFrame, answers: DataFrame, prefix: str = "10.1101/") -> DataFrame:
    """The latest numbered version of a DOI of the preprint servers."""
    item = f"struct<doi:{_S},version:{_S},license:{_S},server:{_S}>"
    rows = _asked(records.where(F.col("doi").startswith(prefix)), answers, "preprints", f"collection array<{item}>", force=True)
    items = rows.select("record", F.col("doi").alias("own"), F.explode("answer.collection").alias("i")).select("record", "own", "i.*").where(n.doi("doi") == F.col("own"))
    numbered = items.withColumn("number", F.when(F.col("version").rlike("^[0-9]+$"), F.col("version").try_cast("long")).otherwise(0))
    latest = numbered.groupBy("record", "own").agg(F.max_by(F.struct("version", "license", "server"), F.struct("number", "server")).alias("b")).select("record", "own", "b.*")
    url = F.concat(F.lit("https://www."), "server", F.lit(".org/content/"), "own", F.lit("v"), "version", F.lit(".full.pdf"))
    return _found(latest.withColumn("url", url), F.col("server"), F.lit("pdf"), F.lit("submittedVersion"))


def preprints_by_title(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Preprints with the same title, two years apart at most, and an author in common."""
    item = f"struct<title:{_S},pubYear:{_S},authors:array<{_S}>,url:{_S},license:{_S}>"
    wanted = records.where(~direct_pdf("download_status", "identity_status")).withColumn("__title", n.title("title")).where("__title <> ''")
    saved = answers.where("service = 'preprint_titles'").select(F.explode(F.from_json("raw", f"results array<{item}>").results).alias("i")).select("i.*")
    saved = saved.select(n.title("title").alias("__same"), F.col("pubYear").try_cast("int").alias("printed"), F.col("authors").alias("theirs"), "url", "license")
    rows = wanted.drop("url", "license").join(saved, F.col("__title") == F.col("__same")).where(F.abs(F.col("year") - F.col("printed")) <= 2)
    rows = rows.where(F.arrays_overlap(people.match_tokens("authors"), people.match_tokens("theirs")))
    return _found(rows, F.lit("europe_pmc_preprint"), F.lit("pdf"), F.lit("submittedVersion"))


def core(records: DataFrame, answers: DataFrame) -> DataFrame:
    item = f"struct<doi:{_S},title:{_S},yearPublished:{_S},authors:array<struct<name:{_S}>>,license:{_S},downloadUrl:{_S},sourceFulltextUrls:array<{_S}>>"
    rows = _asked(records, answers, "core", f"results array<{item}>").select("record", "doi", "title", "year", "authors", F.explode("answer.results").alias("i"))
    rows = rows.select("record", "doi", "title", "year", "authors", *[F.col(f"i.{x}").alias(f"i_{x}") for x in ("doi", "title", "yearPublished", "license", "downloadUrl", "sourceFulltextUrls")], F.col("i.authors.name").alias("i_authors"))
    same = rows.where(people.same_publication("doi", "i_doi", "title", "i_title", "year", "i_yearPublished", "authors", "i_authors")).withColumn("license", F.col("i_license"))
    pdf = same.withColumn("url", F.col("i_downloadUrl"))
    page = same.withColumn("url", F.explode("i_sourceFulltextUrls")).where("not (url <=> i_downloadUrl)")
    version = F.lit("repositoryVersion")
    return _found(pdf, F.lit("core"), F.lit("pdf"), version).unionByName(_found(page, F.lit("core_landing"), F.lit("landing"), version))


def _is_pdf_path(x: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(x), F.lit("")), "^[^?#]*", 0)).endswith(".pdf")


def _own_or_described(rows: DataFrame) -> DataFrame:
    """Items that carry the record's DOI, or none and its description; another DOI is another work."""
    dois = F.transform(F.coalesce("i_dois", F.array().cast("array<string>")), lambda x: n.doi(x))
    rows = rows.withColumn("__dois", F.filter(dois, lambda x: x != "")).withColumn("__hit", F.when(F.array_contains("__dois", F.col("doi")), F.col("doi")).otherwise(""))
    rows = rows.where((F.col("doi") == "") | (F.size("__dois") == 0) | (F.col("__hit") != ""))
    return rows.where(people.same_publication("doi", "__hit", "title", "i_title", "year", "i_year", "authors", "i_authors"))


def openaire(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Copies whose own access right is open; a path ending in .pdf is the file, others are landing pages."""
    instance = f"struct<accessRight:struct<code:{_S},label:{_S}>,license:{_S},urls:array<{_S}>>"
    item = f"struct<pids:array<struct<scheme:{_S},value:{_S}>>,mainTitle:{_S},publicationDate:{_S},authors:array<struct<fullName:{_S}>>,instances:array<{instance}>>"
    rows = _asked(records, answers, "openaire", f"results array<{item}>").select("record", "doi", "title", "year", "authors", F.explode("answer.results").alias("i"))
    dois = F.transform(F.filter("i.pids", lambda p: F.lower(p["scheme"]) == "doi"), lambda p: p["value"])
    rows = rows.select("record", "doi", "title", "year", "authors", dois.alias("i_dois"), F.col("i.mainTitle").alias("i_title"), F.col("i.publicationDate").alias("i_year"), F.col("i.authors.fullName").alias("i_authors"), "i.instances")
    open_ = F.filter("instances", lambda x: x["accessRight"]["code"].eqNullSafe("c_abf2") | x["accessRight"]["label"].eqNullSafe("OPEN"))
    flat = _own_or_described(rows).select("record", F.explode(open_).alias("x")).select("record", F.col("x.license").alias("license"), F.explode("x.urls").alias("url"))
    return _found(flat, F.when(_is_pdf_path("url"), "openaire").otherwise("openaire_landing"), F.when(_is_pdf_path("url"), "pdf").otherwise("landing"), F.lit("repositoryVersion"))


def doaj(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Links of open journals; the declared content type or the path decides what they are."""
    link = f"struct<url:{_S},content_type:{_S}>"
    item = f"struct<bibjson:struct<identifier:array<struct<type:{_S},id:{_S}>>,title:{_S},year:{_S},author:array<struct<name:{_S}>>,link:array<{link}>>>"
    rows = _asked(records, answers, "doaj", f"results array<{item}>").select("record", "doi", "title", "year", "authors", F.explode("answer.results.bibjson").alias("b"))
    dois = F.transform(F.filter("b.identifier", lambda p: p["type"] == "doi"), lambda p: p["id"])
    rows = rows.select("record", "doi", "title", "year", "authors", dois.alias("i_dois"), F.col("b.title").alias("i_title"), F.col("b.year").alias("i_year"), F.col("b.author.name").alias("i_authors"), F.col("b.link").alias("links"))
    flat = _own_or_described(rows).select("record", F.explode("links").alias("x")).select("record", "x.*").withColumn("license", F.lit(""))
    pdf = F.coalesce(F.col("content_type") == "application/pdf", F.lit(False)) | _is_pdf_path("url")
    return _found(flat, F.when(pdf, "doaj").otherwise("doaj_landing"), F.when(pdf, "pdf").otherwise("landing"), F.lit("publishedVersion"))


#: Name, adapter, the setting it can't do without.
JOBS: list[tuple[str, Callable, str | None]] = [
    ("unpaywall", unpaywall, "contact_email"), ("preprints", preprint_servers, None), ("preprint_titles", preprints_by_title, None),
    ("core", core, "core_api_key"), ("openaire", openaire, None), ("doaj", doaj, None),
]


def enrich(records: DataFrame, answers: DataFrame, settings: dict, jobs=JOBS) -> tuple[DataFrame, dict[str, str]]:
    """Candidates of all enabled adapters in order, and each adapter's status."""
    out, status = None, {}
    for name, adapter, needs in jobs:
        if needs and not settings.get(needs):
            status[name] = f"disabled_missing_{'email' if needs.endswith('email') else 'key'}"
            continue
        status[name] = "ok"
        found = adapter(records, answers).select(*OUT).withColumn("adapter", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out, status


def version_edges(items: DataFrame, record: str, doi: str, raw: str) -> DataFrame:
    """(record, relation, target, target_type, source_record, evidence_url, source_sha256) of every relation a provider declares;
    the digest binds an edge to the raw item it came from."""
    relations = F.from_json(F.get_json_object(raw, "$.relation"), f"map<{_S},array<struct<id:{_S},`id-type`:{_S}>>>")
    flat = items.select(record, doi, F.sha2(F.col(raw), 256).alias("source_sha256"), F.explode(relations).alias("relation", "entries"))
    flat = flat.select(record, doi, "source_sha256", n.relation_type("relation").alias("relation"), F.explode("entries").alias("e"))
    return flat.where("trim(e.id) <> ''").select(
        record, "relation", F.trim("e.id").alias("target"), F.col("e.id-type").alias("target_type"), F.concat(F.lit("doi:"), doi).alias("source_record"),
        F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(F.col(doi))).alias("evidence_url"), "source_sha256",
    )
