"""HTML extraction: page structure, then a suffix array over the pages of a host.

A tolerant one-pass tokenizer cuts a page into blocks and follows the open elements. Elements that aren't the
article by their nature (menus, page headers, footers, sidebars, forms, scripts, hidden ones) or by their class, id
or role (adverts, notices, comments, ...) are left out with all they hold. If blocks stand inside ``article``
(else ``main``), the page is framed and these are its blocks.

Every page then meets the others of its host. Their token streams are concatenated (exact copies of a page once) and
a suffix array bounded at ``MIN_TOKENS`` names the substrings of that many tokens. Of these a winnowing by hash counts
some: in every ``WINDOW`` consecutive ones that with the smallest hash, besides the first and last of every block,
so a shared run of ``MIN_TOKENS + WINDOW - 1`` tokens, and every shared block, is met wherever it stands.

* Substrings on ``MIN_PAGES`` distinct pages cover what is loosely shared. On pages without a frame, blocks covered to
  ``COVER`` or more are boilerplate.
* Articles quote and repeat each other, so being shared says little about a run inside a text. A page with ``OWN`` tokens or
  more that it shares with nobody is a witness; the others are copies of an article or boilerplate only. Runs that
  are on ``PRINTED`` of the host's witnesses, ``PRINTED_PAGES`` at least, are what the host prints beside different
  texts. They are cut out of the witnesses, framed or not, and the unique runs around them are kept.

Hosts with more than ``SECTION`` pages are dealt into sections by content, so copies of a page meet, and decided by the same
counts: every section counts the distinct pages of its chosen substrings (64-bit hashes) once, the counts are added up over
the host, dealt by hash, and every section gets back which of its substrings the host repeats; the witnesses' votes
travel likewise. What is boilerplate doesn't depend on the number of sections.

White space inside a block (no-break spaces too) becomes one space, blocks are trimmed and joined by one line feed;
table cells and line breaks count as white space. Character references are decoded once.

Defined results: null or empty html, or a page that is boilerplate only, gives the empty text; a null or odd url
belongs to the host ''; repeated rows and ids are extracted each; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

MIN_TOKENS, WINDOW, MIN_PAGES, COVER, SECTION = 8, 8, 3, 0.8, 2000
PRINTED_PAGES, PRINTED, OWN = 5, 0.6, 16
LARGE_HOSTS, FLUSH = 50_000, 4 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACE = frozenset("br td th wbr".split()) - {"wbr"}
_NOISE = frozenset(
    "nav footer aside form button select datalist dialog menu template svg canvas audio video object applet map head noscript iframe script style "
    "title textarea".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCK - {"caption", "tbody", "tfoot", "thead", "tr", "dd", "dt", "li", "body", "html", "legend", "summary"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE_WORDS = (
    "nav|navbar|navigation|menu|sidebar|footer|masthead|topbar|ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|"
    "promotion|cookie|cookies|consent|gdpr|comment|comments|commentlist|respond|reply|replies|disqus|share|sharing|social|related|recommended|"
    "breadcrumb|breadcrumbs|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|notice|notices|alert|toolbar|widget|widgets|"
    "pagination|pager|copyright|search|searchbox|tagcloud|skip|paywall"
)
_NOISE_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NOISE_WORDS})(?:$|[\s_-])", re.I)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_NOT_NOISE = re.compile(r"^(?:has|with|no|without|is|show|hide)[_-]", re.I)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _is_noise(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _NOISE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in _NOISE_ROLES:
        return True
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        if _NOT_NOISE.match(name):
            continue
        if tag == "article":
            if re.fullmatch(r"(?:.*[_-])?(?:comment|reply|ad|promo|teaser)", name, re.I):
                return True
        elif _NOISE_NAME.search(name) or (not in_article and _HEADER_NAME.search(name)):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str, float]]:
    """(place, text, share of link characters) of each block; place: 2 in an article, 1 in main, 0 elsewhere."""
    out: list[tuple[int, str, float]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, noise, place, only headings count
    noise, place, only_headings = False, 0, False
    pieces: list[str] = []
    linked = [0, 0]
    links = headings = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((block_place, text, linked[0] / max(linked[1], 1)))
            pieces.clear()
        linked[0] = linked[1] = 0

    def pop() -> None:
        nonlocal noise, place, only_headings, links, headings
        tag = stack.pop()[0]
        links -= tag == "a"
        headings -= tag in _HEADING
        _, noise, place, only_headings = stack[-1] if stack else ("", False, 0, False)

    at, block_place, size = 0, 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and not noise and (headings or not only_headings):
            text = html.unescape(page[at:stop])
            if not pieces:
                block_place = place
            pieces.append(text)
            n = len(text) - text.count(" ")
            linked[1] += n
            linked[0] += n if links else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            elif tag in _SPACE:
                pieces.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body", "nav", "aside", "table") and tag in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                    break  # a stray end tag doesn't close what holds it
            continue
        if tag in _BLOCK:
            flush()
        elif tag in _SPACE:
            pieces.append(" ")
        if tag in _ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _BLOCK or stack[k][0] in ("td", "th"):
                    break
        if tag in _SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SIBLINGS[tag]:
                    while len(stack) > k:
                        pop()
                    if tag != "tr":
                        break
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else size
            continue
        attributes = _attributes(m[3])
        noise = noise or _is_noise(tag, attributes, place == 2)
        only_headings = only_headings or (tag == "header" and place == 2)
        if tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
            place = 2
        elif tag == "main" or attributes.get("role", "").lower() == "main":
            place = max(place, 1)
        stack.append((tag, noise, place, only_headings))
        links += tag == "a"
        headings += tag in _HEADING
    flush()
    return out


def main_blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks of the article, or else the main part, and True; without either, those of the body that aren't
    short link lists, and False."""
    found = blocks(page or "")
    for place in (2, 1):
        inside = [text for p, text, _ in found if p >= place]
        if inside:
            return inside, True
    return [text for _, text, share in found if share < 0.8 or len(text.split()) > 12], False


def bounded_suffix_array(stream: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``length`` (a power of two) tokens, and each suffix's rank: equal ranks, equal
    starts. Prefix doubling, stopped at the bound."""
    rank, step = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while step < length:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def _covered(starts: np.ndarray, length: int = MIN_TOKENS) -> np.ndarray:
    """Tokens within ``length`` of a marked start."""
    at = np.flatnonzero(starts)
    change = np.bincount(at, minlength=len(starts) + length + 1)[: len(starts) + length + 1].astype(np.int64)
    change[length:] -= np.bincount(at, minlength=len(starts) + 1)[: len(starts) + 1]
    return np.cumsum(change)[: len(starts)] > 0


class Stream:
    """The blocks of pages as one stream of tokens, every page ended by a separator of one token."""

    def __init__(self, pages: pa.Array):
        pages = pages.combine_chunks() if isinstance(pages, pa.ChunkedArray) else pages
        many = np.diff(pages.offsets.to_numpy()) + 1
        place = np.ones(many.sum(), bool)
        place[np.cumsum(many) - 1] = False
        order = np.where(place, np.cumsum(place) - 1, place.sum())
        raw, offsets = c.text_buffer(pa.concat_arrays([pages.flatten().cast(pa.large_string()), pa.array(["\x00"], pa.large_string())]).take(pa.array(order)))
        raw = np.insert(raw, offsets[1:-1], 32) if len(order) else raw  # blocks hold single spaces: one more ends each
        start, end, first = c.words(raw, offsets + np.r_[np.arange(len(order)), max(len(order) - 1, 0)])
        self.pages, self.sizes = len(pages), np.diff(first)  # tokens of every block and separator
        self.token = c.span_hash(c.prefix_hash(raw), start, end)
        self.page = np.repeat(np.repeat(np.arange(len(pages), dtype=np.int32), many), self.sizes)
        self.tokens = np.bincount(self.page, minlength=len(pages)) - 1
        n = len(self.token)
        self.after = np.cumsum(self.tokens + 1)[self.page]  # where the next page begins
        weight, gram = c.stream(MIN_TOKENS, MIN_TOKENS) | c.U(1), np.zeros(n, c.U)
        with np.errstate(over="ignore"):
            for k in range(min(MIN_TOKENS, n)):
                gram[: n - k] += self.token[k:] * weight[k]
        self.gram = c.mix(gram)  # of the ``MIN_TOKENS`` tokens from here on
        self.whole = np.arange(n) + MIN_TOKENS < self.after
        self.chosen = self._winnowed(first)

    def _winnowed(self, first: np.ndarray) -> np.ndarray:
        """The substrings that are counted, by their content and the block's ends only."""
        n = len(self.gram)
        chosen = np.zeros(n, bool)
        at = np.flatnonzero(self.whole)
        if len(at):
            value = np.where(self.whole, self.gram, ~c.U(0))
            least, best = value.copy(), np.arange(n)
            for k in range(1, min(WINDOW, n)):
                better = value[k:] < least[: n - k]
                least[: n - k][better] = value[k:][better]
                best[: n - k][better] = np.flatnonzero(better) + k
            full = self.whole.copy()  # windows inside one page
            full[: n - WINDOW + 1] &= self.whole[WINDOW - 1 :] & (self.page[: n - WINDOW + 1] == self.page[WINDOW - 1 :]) if n >= WINDOW else False
            full[max(n - WINDOW + 1, 0) :] = False
            chosen[best[full]] = True
            edges = np.r_[first[:-1], first[1:] - MIN_TOKENS]
            owner = np.r_[first[:-1], first[1:] - 1]
            inside = (edges >= 0) & (owner < n) & (np.r_[self.sizes, self.sizes] > 0)
            edges, owner = edges[inside], owner[inside]
            chosen[edges[self.page[edges] == self.page[owner]]] = True
        return chosen & self.whole

    def covered(self, starts: np.ndarray) -> np.ndarray:
        return _covered(starts)

    def near(self, covered: np.ndarray) -> np.ndarray:
        """Substrings that touch what is covered, or could belong to the same shared run."""
        wide = np.r_[0, np.cumsum(covered)]
        at = np.arange(len(covered))
        return self.whole & (wide[np.minimum(at + MIN_TOKENS + WINDOW, self.after)] > wide[np.maximum(at - WINDOW, self.after - self.tokens[self.page] - 1)])

    def witnesses(self, loose: np.ndarray) -> np.ndarray:
        """Pages with ``OWN`` tokens or more that they share with nobody."""
        return self.tokens - np.bincount(self.page, loose, self.pages) >= OWN

    def boilerplate(self, loose: np.ndarray) -> np.ndarray:
        """Tokens of blocks that are covered to ``COVER`` or more."""
        hits = np.diff(np.r_[0, np.r_[0, np.cumsum(loose)][np.cumsum(self.sizes)]])
        return np.repeat((hits >= COVER * self.sizes) & (hits > 0), self.sizes)

    def kept(self, lists: list[list[str]], gone: np.ndarray) -> list[list[str]]:
        """The blocks without the tokens that go; a block all of which goes is left out."""
        out, at = [], 0
        for page in lists:
            blocks = []
            for text in page:
                n = int(self.sizes[at])
                first = int(self._first[at])
                at += 1
                mine = gone[first : first + n]
                if not mine.any():
                    blocks.append(text)
                elif not mine.all():
                    blocks.append(" ".join(w for w, x in zip(text.split(" "), mine.tolist()) if not x))
            at += 1
            out.append(blocks)
        return out

    @property
    def _first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _needed(witnesses: int) -> int:
    return max(PRINTED_PAGES, int(np.ceil(PRINTED * witnesses)))


def without_repeats(pages: list[list[str]], framed: list[bool]) -> list[list[str]]:
    """The blocks of the pages of one host without boilerplate."""
    first: dict[tuple, int] = {}
    copy_of = [first.setdefault((bool(f), *p), k) for k, (p, f) in enumerate(zip(pages, framed))]
    distinct = [k for k in sorted(set(copy_of)) if pages[k]]
    if len(distinct) < MIN_PAGES:
        return pages
    lists = [pages[k] for k in distinct]
    s = Stream(pa.array(lists, pa.list_(pa.string())))
    names = np.unique(s.token, return_inverse=True)[1].astype(np.int64)
    names[s.after - 1] = -1 - s.page  # a separator of its own ends every page
    _, rank = bounded_suffix_array(names, MIN_TOKENS)

    def pages_of(which: np.ndarray) -> np.ndarray:
        held = np.unique(rank[which] * s.pages + s.page[which])  # (substring, page) once
        return np.bincount(held // s.pages, minlength=len(rank))[rank]

    loose = s.covered(s.chosen & (pages_of(s.chosen) >= MIN_PAGES))
    witness = s.witnesses(loose)
    votes = s.near(loose) & witness[s.page]
    printed = s.covered(votes & (pages_of(votes) >= _needed(int(witness.sum()))))
    is_framed = np.array([framed[k] for k in distinct], bool)[s.page]
    gone = printed | (~is_framed & s.boilerplate(loose))
    of = dict(zip(distinct, s.kept(lists, gone)))
    return [of.get(copy_of[k], pages[k]) for k in range(len(pages))]


# ---------------------------------------------------------------- hosts of several sections


def _counts(gram: np.ndarray, page_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct substrings and on how many pages each is."""
    order = np.lexsort((page_of, gram))
    gram, page_of = gram[order], page_of[order]
    once = np.r_[True, (gram[1:] != gram[:-1]) | (page_of[1:] != page_of[:-1])] if len(gram) else np.zeros(0, bool)
    return np.unique(gram[once], return_counts=True)


_PARTS = "host string, section int, bucket int, witnesses long, grams binary, counts binary"


def _parts(host, section: int, sections: int, witnesses: int, gram: np.ndarray, page_of: np.ndarray) -> pa.Table:
    """A section's counts, a row a bucket of hashes: as many buckets as sections, the empty ones too."""
    grams, counts = _counts(gram, page_of)
    bucket = (grams % c.U(sections)).astype(np.int64)
    order = np.lexsort((counts == 1, bucket))  # substrings on one page last: their counts don't travel
    bucket, grams, counts = bucket[order], grams[order], counts[order]
    edges, more = np.arange(1, sections), counts > 1
    return pa.table(
        {
            "host": pa.array([host] * sections, pa.string()),
            "section": pa.array([section] * sections, pa.int32()),
            "bucket": pa.array(range(sections), pa.int32()),
            "witnesses": pa.array([witnesses] * sections, pa.int64()),
            "grams": pa.array([x.tobytes() for x in np.split(grams, np.searchsorted(bucket, edges))], pa.binary()),
            "counts": pa.array([x.astype(np.uint32).tobytes() for x in np.split(counts[more], np.searchsorted(bucket[more], edges))], pa.binary()),
        }
    )


def _added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a bucket: the substrings of every row; all distinct ones and their pages on the whole host."""
    rows = [np.frombuffer(x, c.U) for x in table["grams"].to_pylist()]
    grams, place = np.unique(np.concatenate(rows), return_inverse=True)
    pages, at = np.bincount(place, minlength=len(grams)), 0
    for row, x in zip(rows, table["counts"].to_pylist()):
        counts = np.frombuffer(x, np.uint32)
        pages[place[at : at + len(counts)]] += counts - 1
        at += len(row)
    return rows, grams, pages


def _repeated(table: pa.Table) -> pa.Table:
    """To every section its substrings on ``MIN_PAGES`` pages of the host."""
    rows, grams, pages = _added(table)
    often = grams[pages >= MIN_PAGES]
    back = [x[np.isin(x, often)].tobytes() for x in rows]
    return pa.table({"host": table["host"], "section": table["section"], "grams": pa.array(back, pa.binary())})


def _printed(table: pa.Table) -> pa.Table:
    """To every section its substrings that the host prints beside different texts."""
    rows, grams, pages = _added(table)
    printed = grams[pages >= _needed(sum(table["witnesses"].to_pylist()))]
    back = [x[np.isin(x, printed)].tobytes() for x in rows]
    return pa.table({"host": table["host"], "section": table["section"], "printed": pa.array(back, pa.binary())})


def _joined(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), c.U)


def _host_wide(large: DataFrame, ids: str) -> DataFrame:
    """(copies, text) of the pages of hosts with several sections."""

    def count(table: pa.Table) -> pa.Table:
        c.release()
        s = Stream(table["blocks"])
        return _parts(table["host"][0].as_py(), table["section"][0].as_py(), table["sections"][0].as_py(), 0, s.gram[s.chosen], s.page[s.chosen])

    def decide(table: pa.Table, repeated: pa.Table) -> tuple:
        c.release()
        s = Stream(table["blocks"])
        loose = s.covered(s.chosen & np.isin(s.gram, _joined(repeated["grams"].to_pylist())))
        return s, loose, s.witnesses(loose)

    def vote(table: pa.Table, repeated: pa.Table) -> pa.Table:
        table = _distinct(table)
        s, loose, witness = decide(table, repeated)
        held = s.near(loose) & witness[s.page]
        return _parts(table["host"][0].as_py(), table["section"][0].as_py(), table["sections"][0].as_py(), int(witness.sum()), s.gram[held], s.page[held])

    def finish(table: pa.Table, repeated: pa.Table) -> pa.Table:
        votes = [x for x in repeated["printed"].to_pylist() if x is not None]
        s, loose, witness = decide(table, repeated.filter(pa.compute.is_valid(repeated["grams"])))
        printed = s.covered(s.near(loose) & witness[s.page] & np.isin(s.gram, _joined(votes)))
        framed = np.array(table["framed"].to_pylist(), bool)[s.page]
        kept = s.kept(table["blocks"].to_pylist(), printed | (~framed & s.boilerplate(loose)))
        return pa.table({"copies": table["copies"], "text": pa.array(["\n".join(p) for p in kept], pa.string())})

    sections = large.groupBy("host", "section")
    repeated = sections.applyInArrow(lambda t: count(_distinct(t)), _PARTS).groupBy("host", "bucket").applyInArrow(_repeated, "host string, section int, grams binary")
    both = sections.cogroup(repeated.groupBy("host", "section"))
    votes = both.applyInArrow(vote, _PARTS).groupBy("host", "bucket").applyInArrow(_printed, "host string, section int, printed binary")
    back = repeated.select("host", "section", "grams", F.lit(None).cast("binary").alias("printed")).unionByName(
        votes.select("host", "section", F.lit(None).cast("binary").alias("grams"), "printed")
    )
    return sections.cogroup(back.groupBy("host", "section")).applyInArrow(finish, f"copies {ids}, text string")


def _distinct(table: pa.Table) -> pa.Table:
    """The rows of a section, one for every content."""
    first: dict[bytes, int] = {}
    for k, (p, f) in enumerate(zip(table["blocks"], table["framed"])):
        first.setdefault(_digest(f.as_py(), p.as_py()), k)
    return table.take(pa.array(sorted(first.values()), pa.int64()))


def _digest(framed: bool, found: list[str]) -> bytes:
    return hashlib.blake2b("\x00".join((str(framed), *found)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    hosted = rows.withColumn("host", F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit(""))))
    sizes = hosted.groupBy(F.col("host").alias("large")).agg(F.ceil(F.count(F.lit(1)) / SECTION).cast("int").alias("sections")).where("sections > 1")
    few = sizes.limit(LARGE_HOSTS + 1).count() <= LARGE_HOSTS
    if few:
        sizes = F.broadcast(sizes)  # else the pages move once more
    sectioned = hosted.join(sizes, F.col("host") == F.col("large"), "left").withColumn("sections", F.coalesce("sections", F.lit(1)))
    ids = f"array<struct<id:{kind},url:string>>"

    def cut(batches):
        for batch in batches:
            packed: dict[tuple, list] = {}  # equal pages travel once
            size = 0
            for part in c.chunks(batch, "html"):
                for row in part.to_pylist():
                    found, framed = main_blocks(row["html"])
                    copies = packed.setdefault((row["host"], row["sections"], framed, *found), [])
                    size += 0 if copies else sum(map(len, found))
                    copies.append({"id": row["id"], "url": row["url"]})
                if size > FLUSH:
                    yield _packed_rows(packed, batch.schema.field("id").type)
                    packed, size = {}, 0
            if packed:
                yield _packed_rows(packed, batch.schema.field("id").type)

    def clean(table: pa.Table) -> pa.Table:
        lists = table["blocks"].to_pylist()
        kept = without_repeats(lists, table["framed"].to_pylist())
        return pa.table({"copies": table["copies"], "text": pa.array(["\n".join(p) for p in kept], pa.string())})

    schema = f"host string, section int, sections int, framed boolean, blocks array<string>, copies {ids}"
    parsed = lambda where: sectioned.where(where).select("id", "url", "host", "sections", "html").mapInArrow(cut, schema)
    small = parsed("sections = 1").groupBy("host", "section").applyInArrow(clean, f"copies {ids}, text string")
    out = small.unionByName(_host_wide(parsed("sections > 1"), ids)).select(F.explode("copies").alias("copy"), "text")
    return out.select(F.col("copy.id").alias(id_column), F.col("copy.url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def _packed_rows(packed: dict[tuple, list], kind: pa.DataType) -> pa.RecordBatch:
    """A row for every content of a host, its section by a hash of the content."""
    keys = list(packed)
    place = [int.from_bytes(_digest(k[2], k[3:])[:8], "big") % k[1] for k in keys]
    copies = pa.list_(pa.struct([("id", kind), ("url", pa.string())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array(place, pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.bool_()), pa.array([k[3:] for k in keys], pa.list_(pa.string())), pa.array(list(packed.values()), copies),
        ],
        ["host", "section", "sections", "framed", "blocks", "copies"],
    )
