"""Reports of a run as rows of text: inventory, failures, import plan, coverage, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholion.functions.records import md_cell

#: Columns of the inventory as CSV.
CSV_COLUMNS = (
    "title authors year journal doi pmid pmcid arxiv_id citation_count is_oa oa_status license sources download_status identity_status sha256 "
    "duplicate_of retry_at article_type item_type book_title publisher isbn local_pdf local_fulltext fulltext_format retrieval_type "
    "download_version download_source url failure_reason"
).split()
#: What a status means for the reader, in this library's words.
GUIDANCE = {
    "no_oa_version": "None of the sources asked knows a free copy.",
    "license_unknown": "A file may exist, but no source states under which terms it may be used.",
    "anti_bot": "The site wants a person: visit the page in a browser.",
    "rate_limited": "Too many requests for this source; a later run may succeed, a key may raise the limit.",
    "download_timeout": "The transfer ran out of time before the file was complete.",
    "dead_link": "The address that was given leads nowhere now.",
    "not_pdf": "What came back isn't a PDF.",
    "too_large": "The file is bigger than the settings allow.",
    "landing_unresolved": "No link to a file was found on the article's page.",
    "fulltext_unavailable": "The archive lists the article, but gives neither a file nor its text.",
    "fulltext_only": "The text was saved from XML; a PDF was not found.",
    "pending": "The run ended before this record's turn, so nothing has failed yet.",
    "deferred": "The host asked to wait; the next attempt is due after its deadline.",
    "duplicate_pdf": "Another record already holds the same file.",
    "manual_review": "Someone has to decide whether the file belongs to this record.",
}
OTHERWISE = "Every automatic way was tried without a usable file."
NO_REASON = "no file was offered"


def guidance(status: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col(status)), F.lit(OTHERWISE))


def failure_report(records: DataFrame, place: str, status: str, verified: str) -> DataFrame:
    """(place, line_no, line) of every record without a verified file: heading, status with its meaning, reason, when the
    next attempt is due, how many were made, and the addresses its identifiers lead to.

    ``retry_at``, ``attempts`` (an array), ``pmcid`` and ``url`` are read where the records have them."""
    rows = records.where(~F.col(verified)).withColumn("__means", guidance(status))
    held = lambda x: F.nullif(F.col(x).cast("string"), F.lit("")) if x in records.columns else F.lit(None).cast("string")
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"- {label}: "), value))
    address = lambda before, x, after="": F.concat(F.lit(before), held(x), F.lit(after))
    tried = F.coalesce(F.size("attempts"), F.lit(0)).cast("string") if "attempts" in records.columns else F.lit(None).cast("string")
    lines = F.array_compact(F.array(
        F.concat(F.lit("## "), F.col("title")), F.concat(F.lit("- `"), F.col(status), F.lit("`: "), F.col("__means")),
        line("What was recorded", F.coalesce(held("failure_reason"), F.lit(NO_REASON))), line("Next attempt from", held("retry_at")), line("Attempts so far", tried),
        line("DOI", address("https://doi.org/", "doi")), line("PubMed", address("https://pubmed.ncbi.nlm.nih.gov/", "pmid", "/")),
        line("Europe PMC", address("https://europepmc.org/articles/", "pmcid")), line("Page", held("url")),
    ))
    return rows.select(place, F.posexplode(lines).alias("line_no", "line"))


def inventory_markdown(records: DataFrame, place: str) -> DataFrame:
    """(place, value): a table row for each record."""
    identifier = F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in ("doi", "pmid", "pmcid", "arxiv_id")], F.lit(""))
    cells = [F.col(place).cast("string"), md_cell("title"), md_cell("year"), md_cell("journal"), identifier, md_cell("download_status"), md_cell(F.array_join("sources", ", "))]
    row = F.concat(F.lit("| "), cells[0], *[x for c in cells[1:] for x in (F.lit(" | "), c)], F.lit(" |"))
    return records.select(place, row.alias("value"))


def import_preview(records: DataFrame, place: str, state: str, key: str) -> DataFrame:
    """(place, value) of the planned records; a key is a link only where something was written."""
    written = F.col(state).isin("imported_with_pdf", "imported_without_pdf", "attached_pdf_to_existing") & (F.coalesce(F.col(key), F.lit("")) != "")
    shown = F.when(written, F.concat(F.lit("["), F.col(key), F.lit("](zotero://select/library/items/"), F.col(key), F.lit(")"))).otherwise(F.coalesce(key, F.lit("")))
    return records.where(F.col(state).isNotNull()).select(place, F.concat(F.lit("| "), F.col(place).cast("string"), F.lit(" | "), md_cell(state), F.lit(" | "), md_cell("title"), F.lit(" | "), shown, F.lit(" |")).alias("value"))


def coverage_markdown(effectiveness: DataFrame, source: str = "source") -> DataFrame:
    cells = [md_cell(source), *[F.col(x).cast("string") for x in ("offered", "reached", "won")], F.format_number(F.col("win_rate") * 100, 2)]
    return effectiveness.select(source, F.concat(F.lit("| "), cells[0], *[x for c in cells[1:] for x in (F.lit(" | "), c)], F.lit(" % |")).alias("value"))


def run_summary(outcome: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """One JSON line: the outcome's figures with the number of records in each state."""
    counts = states.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    folded = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(state, F.lit("not_planned")).alias("state"), "n")))).alias("states"))  # a row a state
    return outcome.join(F.broadcast(folded)).select(F.to_json(F.struct(*outcome.columns, "states")).alias("value"))
