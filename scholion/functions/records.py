"""Scalar functions over whole records: keys, digests, file names, addresses, deadlines, predicates, report fields."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F

from scholion.functions import normalize as n
from scholion.functions.arrow import arrow_udf

_col = n._col


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- identity


def strong_keys(keys) -> Column:
    return F.filter(_col(keys), lambda k: ~k.startswith("title:"))


def record_key(keys, title, year, authors) -> Column:
    """First strong key, else title, year and authors."""
    described = F.concat_ws("|", F.concat(F.lit("title:"), n.title(title)), F.coalesce(_col(year).cast("string"), F.lit("None")), F.array_join(F.coalesce(_col(authors), _strings()), "|"))
    return F.coalesce(F.try_element_at(strong_keys(keys), F.lit(1)), described)


def strong_id(keys, candidate) -> Column:
    return F.coalesce(F.try_element_at(strong_keys(keys), F.lit(1)), F.concat(F.lit("candidate:"), _col(candidate)))


def record_digest(keys, title, year, authors) -> Column:
    """Sixteen hex digits of the first strong key, else of normalised title, year and authors."""
    names = F.transform(F.coalesce(_col(authors), _strings()), lambda x: n.title(x))
    described = F.array_join(F.concat(F.array(n.title(title), F.coalesce(_col(year).cast("string"), F.lit(""))), names), "|")
    return F.substring(F.sha2(F.coalesce(F.try_element_at(strong_keys(keys), F.lit(1)), described), 256), 1, 16)


def canonical(value) -> str:
    """JSON with sorted keys, without spaces, Unicode as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@arrow_udf("string")
def candidate_id(keys: pd.Series, years: pd.Series, authors: pd.Series, urls: pd.Series) -> pd.Series:
    """Twenty-four hex digits over all keys, year and authors; the address counts where no key is strong."""
    out = []
    for key, year, names, url in zip(keys, years, authors, urls):
        value = {"ids": list(key), "year": None if pd.isna(year) else int(year), "authors": list(names)}
        if all(k.startswith("title:") for k in value["ids"]):
            value["source_url"] = url or ""
        out.append(hashlib.sha256(canonical(value).encode()).hexdigest()[:24])
    return pd.Series(out, dtype=object)


def request_key(url, kind, referer) -> Column:
    """What tells two requests apart; a missing kind is a PDF."""
    text = lambda x: F.trim(F.coalesce(_col(x), F.lit("")))
    return F.struct(text(url).alias("url"), F.coalesce(F.nullif(_col(kind), F.lit("")), F.lit("pdf")).alias("kind"), text(referer).alias("referer"))


def identifier_tail(x) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), "/+$", ""), "([^/]*)$", 1)


def loose_pmid(x) -> Column:
    """Digits after the prefix or address; leading zeros allowed, unlike ``pmid``."""
    tail = F.regexp_replace(identifier_tail(x), r"(?i)^PMID\s*:\s*", "")
    return F.when(tail.rlike("^[0-9]+$"), tail).otherwise("")


def clean_names(names) -> Column:
    """Trimmed names without the words that stand for none."""
    return F.filter(F.transform(F.coalesce(_col(names), _strings()), lambda x: n.identifier_text(x)), lambda x: x != "")


def whole_number(x) -> Column:
    """Digits only; null for others, which a record refuses."""
    text = _col(x).cast("string")
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def value_at(document, *path) -> Column:
    """A value inside JSON text by its path, null where a step is missing."""
    return F.get_json_object(_col(document), "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path))


# ---------------------------------------------------------------- names of files, addresses


#: Names that a file system keeps for devices.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))]


def safe_filename(x, length: int = 150, devices: bool = True) -> Column:
    """With ``devices``, names of devices get a prefix."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    text = F.regexp_replace(text, r"^[ .]+|[ .]+$", "")
    text = F.when(text == "", "paper").otherwise(text)
    if devices:
        text = F.when(F.upper(text).isin(DEVICES), F.concat(F.lit("paper-"), text)).otherwise(text)
    return F.regexp_replace(F.substring(text, 1, length), r"[ .]+$", "")


def file_name(year, authors, title, digest) -> Column:
    """``year - author - title - digest.pdf``; the author's last part, or the first where the last are initials."""
    parts = F.split(F.try_element_at(_col(authors), F.lit(1)), r"\s+")
    last = F.element_at(parts, -1)
    initials = (F.size(parts) > 1) & last.rlike(r"^[\p{Lu}.\-]{1,5}$")
    author = F.coalesce(F.when(initials, F.element_at(parts, 1)).otherwise(last), F.lit("Unknown"))
    readable = safe_filename(F.concat(F.coalesce(_col(year).cast("string"), F.lit("n.d.")), F.lit(" - "), author, F.lit(" - "), _col(title)), 125)
    return F.concat(readable, F.lit(" - "), _col(digest), F.lit(".pdf"))


def is_https_url(x) -> Column:
    return n.is_web_url(x) & F.lower(_col(x)).startswith("https:")


def safe_url(x) -> Column:
    """Redacted address of a web page, '' for anything else."""
    text = F.trim(F.coalesce(_col(x), F.lit("")))
    return F.when(n.is_web_url(text), n.redact_url(text)).otherwise("")


#: Labels of hosts that hand out copies without a licence.
SHADOW_LABELS = r"(?:^|\.)(?:sci-hub|scihub|libgen|library-genesis|gen\.lib|annas-archive|z-lib|zlibrary)(?:\.|$)"


def is_shadow(x) -> Column:
    return n.host(x).rlike(SHADOW_LABELS)


def safe_message(x, length: int = 700) -> Column:
    """Text without credentials: secret query values and ``name: value`` pairs go."""
    text = F.coalesce(_col(x).cast("string"), F.lit(""))
    text = F.regexp_replace(text, f"(?i)([?&](?:{n.SECRET_NAMES})=)[^&\\s<>\"']*", "$1REDACTED")
    text = F.regexp_replace(text, r"(?i)(?:api[_-]?key|token|password|authorization|cookie)\s*[:=]\s*(?!REDACTED)\S+", "[redacted credential]")
    return F.substring(text, 1, length)


# ---------------------------------------------------------------- deadlines


def retry_after(value, as_of) -> Column:
    """Seconds to wait: a number as it is, an HTTP date as the time left; never negative, null for other text."""
    text = F.trim(_col(value))
    seconds = F.when(text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), text.try_cast("double"))
    stamp = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    left = (F.unix_micros(stamp) - F.unix_micros(as_of)) / 1_000_000
    wait = F.coalesce(seconds, left.cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def retry_delay(value, as_of, attempt) -> Column:
    """The server's delay in full, else doubling from one to eight seconds."""
    wait = retry_after(value, as_of)
    return F.when(wait.isNotNull(), wait).otherwise(F.least(F.pow(F.lit(2.0), _col(attempt)), F.lit(8.0)))


def is_deferred(deadline, as_of) -> Column:
    """Does a recorded deadline still lie ahead?"""
    return F.coalesce(_col(deadline).try_cast("timestamp") > as_of, F.lit(False))


# ---------------------------------------------------------------- predicates


def verified_pdf(status, identity, digest) -> Column:
    return F.coalesce(_col(status).isin("downloaded", "already_downloaded") & (_col(identity) == "verified") & (F.coalesce(_col(digest), F.lit("")) != ""), F.lit(False))


def direct_pdf(status, identity) -> Column:
    return F.coalesce(_col(status).isin("downloaded", "already_downloaded") & (_col(identity) == "verified"), F.lit(False))


def qualified_jats(source, kind, candidate_pmcid, pmcid, version, license_, route, url, host: str) -> Column:
    """An article's own XML in the open archive: every field must name the same version."""
    name = F.concat(_col(pmcid), F.lit("."), _col(version).cast("string"))
    address = F.concat(F.lit(f"https://{host}/"), name, F.lit("/"), name, F.lit(".xml"))
    ok = (_col(source) == "pmc_oa_cloud") & (_col(kind) == "jats") & (_col(candidate_pmcid) == _col(pmcid)) & (_col(version) > 0)
    ok = ok & (F.coalesce(_col(license_), F.lit("")) != "") & _col(route).isin("open_access", "author_manuscript_tdm") & (_col(url) == address)
    return F.coalesce(ok, F.lit(False))


def pmc_listing(kind, source, url) -> Column:
    """A listing of an article's deposited versions, by its kind or by source and query."""
    return F.coalesce((_col(kind) == "pmc_listing") | ((_col(source) == "pmc_oa_cloud") & _col(url).rlike(r"[?&]list-type=2(?:&|$)")), F.lit(False))


def listing_url(pmcid, host: str) -> Column:
    return F.when(F.coalesce(_col(pmcid), F.lit("")) != "", F.concat(F.lit(f"https://{host}/?list-type=2&prefix="), _col(pmcid), F.lit(".")))


def asset_permitted(license_, route, verified) -> Column:
    """Text-mining deposits don't license assets; open access, a verified copy or a real licence does."""
    licence = F.upper(F.trim(F.coalesce(_col(license_), F.lit(""))))
    real = ~licence.isin("", "NONE", "NULL", "UNKNOWN", "N/A", "TDM")
    return (licence != "TDM") & (F.coalesce(_col(route), F.lit("")) != "author_manuscript_tdm") & ((F.coalesce(_col(route), F.lit("")) == "open_access") | F.coalesce(_col(verified), F.lit(False)) | real)


def in_section(headings, wanted: str) -> Column:
    return F.lower(F.array_join(_col(headings), " / ")).contains(wanted.lower())


def open_content(has_pdf, url, work_id, license_, is_oa, enabled: bool) -> Column:
    """May a metered archive copy be offered? Declared for this work, credential-free, openly licensed, and enabled."""
    declared = F.coalesce(_col(has_pdf), F.lit(False)) & (_col(url) == F.concat(F.lit("https://content.openalex.org/works/"), _col(work_id), F.lit(".pdf")))
    licensed = F.lower(_col(license_)).rlike("^cc-(?:by(?:-nc)?(?:-nd|-sa)?|0)$") & F.coalesce(_col(is_oa), F.lit(False))
    return F.lit(enabled) & F.coalesce(declared & licensed, F.lit(False))


def content_policy(enabled: bool = False, free_only: bool = True, allow_paid: bool = False, max_files: int = 0, max_cost: float = 0.0, has_key: bool = False) -> tuple[str, int]:
    """(status, requests allowed) of metered delivery: off, blocked, or enabled up to the smaller of files and cost in cents."""
    if not enabled:
        return "disabled", 0
    if free_only or not allow_paid or not 0.01 <= max_cost < float("inf") or max_files <= 0 or not has_key:
        return "blocked", 0
    return "enabled", min(max_files, int(round(max_cost * 100, 6)))


# ---------------------------------------------------------------- report fields


def md_cell(x) -> Column:
    return F.replace(F.replace(F.coalesce(_col(x).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def bib_key(authors, year, place) -> Column:
    name = F.regexp_replace(F.element_at(F.split(F.coalesce(F.try_element_at(_col(authors), F.lit(1)), F.lit("paper")), r"\s+"), -1), r"[^\p{L}\p{N}_]+", "")
    return F.concat(name, F.coalesce(_col(year).cast("string"), F.lit("nd")), F.lit("_"), _col(place).cast("string"))


def bib_escape(x) -> Column:
    text = F.replace(F.coalesce(_col(x).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\textbackslash "))
    return F.replace(F.replace(text, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
