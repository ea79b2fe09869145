"""Sources and sinks over saved provider responses, records and reports.

Live services are out of scope: every provider is read from saved pages (one row a page: route, page number, raw body),
so a run can be replayed. Malformed rows are counted, never fatal: a page keeps its other rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholion.functions import normalize as n
from scholion.functions.arrow import arrow_udf, exploded

RECORD = (
    "title string, authors array<string>, year int, journal string, abstract string, doi string, pmid string, pmcid string, arxiv_id string, "
    "openalex_id string, semantic_scholar_id string, url string, item_type string, citation_count int, is_oa boolean, license string, "
    "publication_types array<string>, pdf_urls array<string>, landing_urls array<string>, error string"
)


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _year(value) -> int | None:
    found = re.search(r"(?:1[5-9]|20)[0-9]{2}", str(value or ""))
    return int(found[0]) if found else None


def _pubmed_items(raw: str) -> list:
    return [x for x in ET.fromstring(raw) if x.tag in ("PubmedArticle", "PubmedBookArticle")]


def _pubmed(item) -> dict:
    """Journal and book articles; labelled abstract parts are joined by line feeds."""
    journal = item.tag == "PubmedArticle"
    body = item.find("MedlineCitation") if journal else item.find("BookDocument")
    if body is None or not _text(body.find("PMID")):
        raise ValueError("no identifier")
    article = body.find("Article") if journal else body
    parts = []
    for part in article.iterfind("Abstract/AbstractText"):
        label = part.get("Label")
        parts.append((f"{label}: " if label else "") + _text(part))
    # a chapter's own identifiers only, not those of the book around it
    ids = {x.get("IdType"): _text(x) for x in [*item.iterfind("PubmedData/ArticleIdList/ArticleId"), *body.iterfind("ArticleIdList/ArticleId")]}
    names = [" ".join(filter(None, (_text(a.find("ForeName")), _text(a.find("LastName"))))) or _text(a.find("CollectiveName")) for a in article.iterfind("AuthorList/Author")]
    date = article.find("Journal/JournalIssue/PubDate") if journal else body.find("Book/PubDate")
    return {
        "title": _text(article.find("ArticleTitle")), "authors": [x for x in names if x], "year": _year(_text(date)),
        "journal": _text(article.find("Journal/Title")) or _text(body.find("Book/BookTitle")), "abstract": "\n".join(parts), "pmid": _text(body.find("PMID")),
        "doi": ids.get("doi", ""), "pmcid": ids.get("pmc", ""), "item_type": "journalArticle" if journal else "bookSection",
        "publication_types": [_text(x) for x in article.iterfind("PublicationTypeList/PublicationType")],
    }


def _abstract_from_index(index: dict | None) -> str:
    places = sorted((p, w) for w, ps in (index or {}).items() for p in ps)
    return " ".join(w for _, w in places)


def _openalex(x: dict) -> dict:
    places = [p for p in x.get("locations") or [] if p.get("is_oa")]
    ids = x.get("ids") or {}
    return {
        "title": x.get("title") or "", "authors": [a["author"]["display_name"] for a in x.get("authorships") or []], "year": x.get("publication_year"),
        "abstract": _abstract_from_index(x.get("abstract_inverted_index")), "doi": x.get("doi") or "", "pmid": ids.get("pmid", ""), "pmcid": ids.get("pmcid", ""),
        "openalex_id": x["id"], "citation_count": x.get("cited_by_count"), "is_oa": (x.get("open_access") or {}).get("is_oa"),
        "item_type": "preprint" if x.get("type") == "preprint" else "journalArticle", "pdf_urls": [p["pdf_url"] for p in places if p.get("pdf_url")],
        "landing_urls": [p["landing_page_url"] for p in places if p.get("landing_page_url")],
    }


def _crossref(x: dict) -> dict:
    licences = [y.get("URL", "") for y in x.get("license") or []]
    free = next((u for u in licences if "creativecommons.org" in u), "")
    date = ((x.get("issued") or {}).get("date-parts") or [[None]])[0][0]
    return {
        "title": (x.get("title") or [""])[0], "authors": [" ".join(filter(None, (a.get("given"), a.get("family")))) for a in x.get("author") or []], "year": _year(date),
        "journal": (x.get("container-title") or [""])[0], "doi": x.get("DOI", ""), "url": x.get("URL", ""), "citation_count": x.get("is-referenced-by-count"),
        "license": free, "pdf_urls": [y["URL"] for y in x.get("link") or [] if free and y.get("content-type") == "application/pdf"],
        "item_type": "preprint" if x.get("type") == "posted-content" else "journalArticle",
    }


def _europe_pmc(x: dict) -> dict:
    return {
        "title": x.get("title", ""), "authors": [a.strip(" .") for a in (x.get("authorString") or "").split(",") if a.strip(" .")], "year": _year(x.get("pubYear")),
        "journal": x.get("journalTitle", ""), "abstract": x.get("abstractText", ""), "doi": x.get("doi", ""), "pmid": x.get("pmid", ""), "pmcid": x.get("pmcid", ""),
        "citation_count": x.get("citedByCount"), "is_oa": x.get("isOpenAccess") == "Y", "item_type": "preprint" if x.get("source") == "PPR" else "journalArticle",
    }


def _semantic_scholar(x: dict) -> dict:
    ids = x.get("externalIds") or {}
    pdf = (x.get("openAccessPdf") or {}).get("url")
    return {
        "title": x.get("title") or "", "authors": [a.get("name", "") for a in x.get("authors") or []], "year": x.get("year"), "abstract": x.get("abstract") or "",
        "doi": ids.get("DOI", ""), "pmid": str(ids.get("PubMed", "")), "arxiv_id": ids.get("ArXiv", ""), "semantic_scholar_id": x["paperId"],
        "citation_count": x.get("citationCount"), "publication_types": x.get("publicationTypes") or [], "pdf_urls": [pdf] if pdf else [],
    }


_ATOM = "{http://www.w3.org/2005/Atom}"


def _arxiv(x) -> dict:
    """An Atom entry; one that reports an error is an error, not a record."""
    address = _text(x.find(f"{_ATOM}id"))
    if "/errors" in address or _text(x.find(f"{_ATOM}title")) == "Error":
        raise ValueError(_text(x.find(f"{_ATOM}summary")))
    return {
        "title": _text(x.find(f"{_ATOM}title")), "authors": [_text(a) for a in x.iterfind(f"{_ATOM}author/{_ATOM}name")], "year": _year(_text(x.find(f"{_ATOM}published"))),
        "abstract": _text(x.find(f"{_ATOM}summary")), "arxiv_id": address, "url": address, "item_type": "preprint", "is_oa": True,
        "pdf_urls": [y.get("href") for y in x.iterfind(f"{_ATOM}link") if y.get("title") == "pdf"],
    }


def _json_items(*path: str):
    def items(raw: str) -> list:
        value = json.loads(raw)
        for name in path:
            value = value.get(name, {})
        return list(value or [])

    return items


#: By source: how a page is cut into items, how an item becomes a record, the credentials a live scan takes.
SOURCES = {
    "pubmed": (_pubmed_items, _pubmed, ("contact_email", "ncbi_api_key")),
    "europe_pmc": (_json_items("resultList", "result"), _europe_pmc, ()),
    "crossref": (_json_items("message", "items"), _crossref, ("contact_email",)),
    "openalex": (_json_items("results"), _openalex, ("openalex_api_key", "contact_email")),
    "semantic_scholar": (_json_items("data"), _semantic_scholar, ("s2_api_key",)),
    "arxiv": (lambda raw: list(ET.fromstring(raw).iterfind(f"{_ATOM}entry")), _arxiv, ()),
}
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_LISTS = {"authors", "publication_types", "pdf_urls", "landing_urls"}
_MALFORMED = (AttributeError, KeyError, TypeError, ValueError, OverflowError)


def route_options(source: str, settings: dict, native: bool = False) -> dict:
    """What a scan of one route may use: its own source's credentials and no others; native syntax where the source has one."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    options = {name: settings[name] for name in SOURCES[source][2] if settings.get(name)}
    return options | ({"native_query": True} if native and source == "arxiv" else {})


def _whole(record: dict) -> dict:
    return {f: record.get(f) if f in ("year", "citation_count", "is_oa", "error") else record.get(f) or ([] if f in _LISTS else "") for f in _FIELDS}


def parse_page(source: str, body: str) -> list[dict]:
    """A record or an error for every item: a malformed item costs itself, only an unreadable page costs its items."""
    items, one, _ = SOURCES[source]
    try:
        found = items(body)
    except (ET.ParseError, *_MALFORMED) as error:
        return [_whole({"error": f"page: {type(error).__name__}"})]
    out = []
    for item in found:
        try:
            out.append(_whole(one(item)))
        except _MALFORMED as error:
            out.append(_whole({"error": f"row: {type(error).__name__}"}))
    return out


@arrow_udf(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in RECORD.split(', '))}>>")
def _parse(sources: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([parse_page(s, b) for s, b in zip(sources, bodies)])


def records(pages: DataFrame) -> DataFrame:
    """Saved pages (route_id, source, page, raw) -> one row a record with its place on the page and normalised identifiers."""
    flat = exploded(pages, ["route_id", "source", "page"], _parse("source", "raw"), "r", "place").select("route_id", "source", "page", "place", "r.*")
    clean = {"doi": n.doi, "pmid": n.pmid, "pmcid": n.pmcid, "arxiv_id": n.arxiv_id}
    return flat.withColumns({k: f(k) for k, f in clean.items()})


ROW_ERRORS = 50


def scan_status(found: DataFrame) -> DataFrame:
    """Per route: raw, parsed and skipped rows, up to ``ROW_ERRORS`` errors with their place, and the status: ``partial`` if
    anything was malformed, ``error`` if nothing else came, ``zero_results`` if nothing came at all."""
    bad = F.when(F.col("error").isNotNull(), F.struct("page", "place", "error"))
    out = found.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count("error").alias("skipped"), F.slice(F.array_sort(F.collect_list(bad)), 1, ROW_ERRORS).alias("row_errors")
    )
    status = F.when((F.col("skipped") > 0) & (F.col("parsed") > 0), "partial").when(F.col("skipped") > 0, "error").when(F.col("parsed") == 0, "zero_results").otherwise("ok")
    return out.withColumn("status", status)


def finish_scan(found: DataFrame, limit: int) -> DataFrame:
    """The records of a route with their rank (page by page) and the score that falls with it; malformed rows are left out.

    A route holds ``limit`` records at most, so the window of a route is bounded.
    """
    order = W.partitionBy("route_id").orderBy("page", "place")
    ranked = found.where("error is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.withColumn("score", n.rank_score(F.col("rank") - 1, F.lit(float(limit))))


def requested_ids(found: DataFrame, requested: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, copies, state) of ids asked for and delivered, in the order asked for: ok, missing, duplicate, or
    unexpected (without a place)."""
    delivered = found.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("copies"))
    joined = requested.select(key, place).join(delivered, F.col(key) == F.col("__key"), "full")
    state = F.when(F.col(place).isNull(), "unexpected").when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "duplicate").otherwise("ok")
    return joined.select(F.coalesce(key, "__key").alias(key), place, F.coalesce("copies", F.lit(0)).alias("copies"), state.alias("state"))


def rank_semantics(source: str, mode: str = "relevance") -> str:
    """What a place in a result list means: bulk and partitioned deliveries come by id, not by relevance."""
    return "identifier_order" if mode in ("bulk", "partitioned") else "relevance"


def json_pages(fetch, limit: int, size: int = 100, token: str | None = "*") -> tuple[list, dict]:
    """Items of a paged service and how it ended. ``fetch(token or offset, size)`` gives (items, next token, total).

    A short page or a missing token ends the scan; a token that repeats, or a failing page, leaves it partial. Sequential
    by nature: the next token is in the page before.
    """
    items, seen, status = [], set(), {"pages": 0, "errors": [], "exhausted": False, "status": "ok"}
    at = token if token is not None else 0
    while len(items) < limit and not status["exhausted"]:
        if token is not None and at in seen:
            return items, status | {"status": "partial", "errors": ["repeated token"]}
        seen.add(at)
        want = min(size, limit - len(items))
        try:
            found, following, total = fetch(at, want)
        except (OSError, *_MALFORMED) as error:
            return items, status | {"status": "partial" if items else "error", "errors": [type(error).__name__]}
        status["pages"] += 1
        items += found[:want]
        status["exhausted"] = len(found) < want or (token is not None and not following) or (token is None and total is not None and at + len(found) >= total)
        at = following if token is not None else at + len(found)
    return items, status | {"continuation": None if status["exhausted"] else at}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


def split_ranges(low: int, high: int, most: int, count) -> list[tuple[int, int]]:
    """Halves of a number range until each holds at most ``most`` records by ``count(low, high)``."""
    out, work = [], [(low, high)]
    while work:
        a, b = work.pop()
        if count(a, b) <= most or a == b:
            out.append((a, b))
        else:
            middle = (a + b) // 2
            work += [(middle + 1, b), (a, middle)]
    return out


def ranges_agree(ranges: list[tuple[int, int]], low: int, high: int, count) -> bool:
    """Do the ranges hold as many records as the whole, without a gap?"""
    joined = all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:])) and ranges[0][0] == low and ranges[-1][1] == high
    return joined and sum(count(a, b) for a, b in ranges) == count(low, high)


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").option("path", ...)``: JSON lines of saved pages, split by byte ranges of lines."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(x, T.LongType() if x == "page" else T.StringType()) for x in ("route_id", "source", "page", "raw")])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SavedPagesReader(self.options)


def _opened(path: str):
    """The file behind a path or address, on whatever store the address names."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, name


class _SavedPagesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.slices = options["path"], int(options.get("slices", "4"))

    def partitions(self):
        system, name = _opened(self.path)
        size = system.get_file_info(name).size
        step = -(-size // self.slices) or 1
        return [_Range(a, min(a + step, size)) for a in range(0, size, step)]

    def read(self, partition):
        import io

        low, high = partition.value
        system, name = _opened(self.path)
        with io.BufferedReader(system.open_input_file(name)) as file:
            if low:
                file.seek(low - 1)
                file.readline()
            while file.tell() < high and (line := file.readline()):
                row = json.loads(line)
                yield row["route_id"], row["source"], row["page"], row["raw"]


def write_records(rows: DataFrame, path: str) -> None:
    """Exclusive: an existing target is an error."""
    rows.write.mode("errorifexists").json(path)


def csv_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed columns for a CSV sink, lists joined by '; '."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.array_join(x, "; ").alias(x) if kinds[x].startswith("array") else F.col(x).cast("string").alias(x) for x in columns])


def bibtex(rows: DataFrame) -> DataFrame:
    """One entry a record, for a text sink."""
    escape = lambda x: F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r"([\\{}%&#_$])", r"\\$1")
    key = F.concat(F.regexp_replace(n.title(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("anon"))), " ", ""), F.coalesce(F.col("year").cast("string"), F.lit("nd")))
    return rows.select(
        F.format_string("@article{%s,\n  title = {%s},\n  author = {%s},\n  year = {%s},\n  doi = {%s}\n}\n", key, escape("title"), F.array_join("authors", " and "), escape("year"), escape("doi")).alias("value")
    )


def enrich(rows: DataFrame, lookup: DataFrame, key: str, locations: str) -> DataFrame:
    """Lookup join: each record with the addresses a saved lookup lists for its key, in their order; none keeps the record."""
    found = lookup.select(F.col(key).alias("__key"), F.col(locations).alias("__found")).where(F.col("__key") != "")
    return rows.join(found, F.col(key) == F.col("__key"), "left").withColumn(locations, F.coalesce("__found", F.array().cast("array<string>"))).drop("__key", "__found")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPages)
