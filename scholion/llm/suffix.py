"""Suffix-array dedup: remove every byte covered by a 400-byte string that also starts anywhere else.

Texts are UTF-8 bytes, matches stay within a document, occurrences may overlap, all occurrences go.

1. Routing. Every 400-byte window has a minimizer: its 64-byte gram with the smallest hash (the leftmost of equals).
   Windows with the same minimizer, in three classes by their distance from it, share a core of 288 bytes or more.
   Consecutive windows of a class make a segment, keyed by the hash of its core: equal windows have equal keys
   wherever they are. A segment is about 60 windows long and costs 31 bytes; no text moves yet.
2. Segments are dealt by key, packed. A key met once is done. Segments with equal content (equal 64-bit digests; copies
   first meet within a task) are covered as a whole, and one of them stands for all. Only keys with different
   contents go on. A key whose contents exceed ``LARGE`` bytes is split first, as often as needed: its segments are
   halved by the distance of their windows from the minimizer, and the windows of a half share more bytes, which make
   the new key. Equal windows stay together, keys get smaller, and a key that is down to one window is settled
   by its content. So no task holds more than ``LARGE`` bytes of one key, whatever many documents share.
3. Their bytes are fetched by one join and dealt by key. A task concatenates the segments, each ended by a
   separator of its own, sorts the suffixes by prefix doubling bounded at the least length, takes the
   Burrows-Wheeler transform and expands intervals breadth-first by backward extension: the intervals of
   all strings of length l, extended by the byte before, close every boundary whose common prefix is
   l, for l = 0, 1, ..., 399. Boundaries still open then lie between suffixes that share 400 bytes:
   those windows repeat. Keys are independent, so a batch holds as many as fit ``BATCH`` bytes.
4. Spans are merged by document and joined with the texts.

Words can count instead of bytes: the same steps then read every text as a row of symbols, a word's 64-bit hash each, so
that a window of n + 1 words has one length whatever the words' letters, and white space doesn't count; grams have
``WORD_GRAM`` words, bounds of bytes count symbols. Each window is judged by itself; what is cut runs from the first to the
last word of a maximal run. ``cut_repeats`` cuts by either, ``repeats`` can give both side by side.

Defined results: a null text is empty; texts below 400 bytes lose nothing by themselves and are no match; equal
rows are occurrences of each other; a null id is kept; other columns are ignored (``cut_repeats`` carries them
through); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

LEAST, GRAM, CLASSES = 400, 64, 3
WORD_GRAM = 8
BATCH, LARGE = 1 << 20, 4 << 20
_PLACE = 33  # bits of a position in a chunk: the same for all chunks, so that equal windows always agree
FLUSH_SEGMENTS, FLUSH_BYTES = 250_000, 8 << 20
BUCKET_BYTES = 48 << 20

_SEGMENT = np.dtype([("key", "u8"), ("digest", "u8"), ("doc", "i8"), ("start", "u4"), ("windows", "u2"), ("level", "u1")])
_SPAN = np.dtype([("doc", "i8"), ("start", "u4"), ("end", "u4")])
_WANT = np.dtype([("doc", "i8"), ("start", "u4"), ("end", "u4"), ("key", "u8"), ("level", "u1")])  # level: of its halves; 0 where it isn't split
_PACKED = "bucket int, segments binary, spans binary, wants binary"
_NAMES = ["bucket", "segments", "spans", "wants"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _NAMES)


# ---------------------------------------------------------------- 1: segments


def word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with every word ``[^\\x20\\x09-\\x0D]+`` as one symbol, its hash, and nothing between."""
    start, end, first = c.words(raw, offsets)
    if not len(start):
        return np.zeros(0, c.U), np.zeros(len(offsets), np.int64)
    return c.span_hash(c.prefix_hash(raw), start, end), first


def _read(text: str, view) -> np.ndarray:
    """A text's symbols: its bytes, or what ``view`` makes of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw if view is None else view(raw, np.array([0, len(raw)]))[0]


def _gram(raw: np.ndarray, least: int) -> int:
    return min(GRAM if raw.dtype == np.uint8 else WORD_GRAM, least)


def _prefix(raw: np.ndarray) -> np.ndarray:
    """``prefix_hash`` of a row of symbols; words are hashes already."""
    if raw.dtype == np.uint8:
        return c.prefix_hash(raw)
    out = np.zeros(len(raw) + 1, c.U)
    with np.errstate(over="ignore"):
        np.cumsum(raw * c.powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def segments(raw: np.ndarray, offsets: np.ndarray, docs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The segments of a chunk of texts."""
    gram = _gram(raw, least)
    width = least - gram + 1
    starts = np.maximum(np.diff(offsets) - least + 1, 0)
    if not starts.any():
        return np.zeros(0, _SEGMENT)
    prefix = _prefix(raw)
    n = len(raw) - gram + 1
    at = np.arange(n)
    bits = c.U(_PLACE)
    value = c.span_hash(prefix, at, at + gram)
    value = ((value >> bits) << bits) | at.astype(c.U)
    value = np.r_[value, np.full(-n % width + width, ~c.U(0))]
    grid = value.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])  # smallest of value[s : s + width]
    window = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(starts)[:-1]], starts) + np.arange(starts.sum())
    owner = np.repeat(np.arange(len(starts)), starts)
    anchor = (low[window] & ((c.U(1) << bits) - c.U(1))).astype(np.int64)
    step = -(-width // CLASSES)
    kind = (anchor - window) // step
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])])
    size = np.diff(np.r_[head, len(window)])
    first, anchor, kind, owner = window[head], anchor[head], kind[head], owner[head]
    near = kind * step
    far = np.minimum(near + step, width) - 1
    out = np.zeros(len(head), _SEGMENT)
    with np.errstate(over="ignore"):
        out["key"] = c.mix(c.span_hash(prefix, anchor - near, anchor - far + least) + kind.astype(c.U))
        out["digest"] = c.mix(c.span_hash(prefix, first, first + size - 1 + least) + (anchor - first).astype(c.U))
    out["doc"] = docs[owner]
    out["start"] = first - offsets[owner]
    out["windows"] = size
    return out


def _halves(offset: int, width: int, level: int) -> tuple[int, int]:
    """The range of distances from the minimizer that ``offset`` belongs to after ``level`` halvings of its class."""
    step = -(-width // CLASSES)
    low = offset // step * step
    high = min(low + step, width)
    for _ in range(level):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        low, high = (low, middle) if offset < middle else (middle, high)
    return low, high


def halved(raw: np.ndarray, start: int, end: int, level: int, least: int) -> list[tuple]:
    """The windows of the segment raw[start:end], by their distance from its minimizer: (key, digest, start, windows)."""
    gram = _gram(raw, least)
    width = least - gram + 1
    body = raw[start:end]
    prefix = _prefix(body)
    at = np.arange(width)
    value = c.span_hash(prefix, at, at + gram) >> c.U(_PLACE)
    anchor = int(np.argmin(value))  # the leftmost of equals, as in ``segments``
    windows = len(body) - least + 1
    out, first = [], 0
    while first < windows:
        low, high = _halves(anchor - first, width, level)
        n = min(anchor - first - low + 1, windows - first)
        with np.errstate(over="ignore"):
            key = c.mix(c.span_hash(prefix, np.array([anchor - low]), np.array([anchor - high + 1 + least])) + c.U(low * 1000 + high))
            digest = c.mix(c.span_hash(prefix, np.array([first]), np.array([first + n - 1 + least])) + c.U(anchor - first))
        out.append((int(key[0]), int(digest[0]), start + first, n))
        first += n
    return out


def _collapse(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One segment of each content, and the spans of those met more than once."""
    order = np.lexsort((rows["digest"], rows["key"]))
    rows = rows[order]
    head = np.flatnonzero(np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1])])
    size = np.diff(np.r_[head, len(rows)])
    repeated = np.repeat(size > 1, size)
    return rows[head], _spans(rows[repeated], least)


def _spans(rows: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros(len(rows), _SPAN)
    out["doc"], out["start"] = rows["doc"], rows["start"]
    out["end"] = rows["start"].astype(np.int64) + rows["windows"] - 1 + least
    return out


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union per document, sorted; touching spans become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    doc = np.r_[0, np.cumsum(spans["doc"][1:] != spans["doc"][:-1])]
    wide = doc << 33
    end = np.maximum.accumulate(wide + spans["end"])
    head = np.flatnonzero(np.r_[True, (wide + spans["start"])[1:] > end[:-1]])
    out = spans[head].copy()
    last = np.r_[head[1:], len(spans)] - 1
    out["end"] = end[last] - wide[last]
    return out


def _deal(rows: np.ndarray, by: np.ndarray, buckets: int):
    """(bucket, rows of it) pairs."""
    bucket = (by.astype(c.U) % c.U(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), rows[a:b]


def _route(buckets: int, least: int, view=None):
    def run(batches):
        held, total = [], 0

        def flush():
            rows, spans = _collapse(np.concatenate(held), least)
            out = [(b, x.tobytes(), None, None) for b, x in _deal(rows, c.mix(rows["key"]), buckets)]
            if len(spans):
                out.append((int(rows["key"][0] % c.U(buckets)), None, merge_spans(spans).tobytes(), None))
            return _rows(out)

        for batch in batches:
            for piece in c.chunks(batch, "text"):
                buffer = c.text_buffer(c.column(piece, "text"))
                found = segments(*(view(*buffer) if view else buffer), c.column(piece, "doc").to_numpy(), least)
                held.append(found)
                total += len(found)
                if total >= FLUSH_SEGMENTS:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()
        c.release()

    return run


def _match(buckets: int, least: int, large: int):
    """One bucket of keys -> spans and wanted bytes, dealt by document; segments of keys beyond ``large`` bytes are marked to be halved."""

    def run(table: pa.Table) -> pa.Table:
        spans = [np.frombuffer(x, _SPAN) for x in table["spans"].to_pylist() if x is not None]
        blobs = [np.frombuffer(x, _SEGMENT) for x in table["segments"].to_pylist() if x is not None]
        wants = np.zeros(0, _WANT)
        if blobs:
            rows = np.concatenate(blobs)
            rows = rows[np.lexsort((rows["start"], rows["doc"], rows["digest"], rows["key"]))]
            new_key = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
            head = np.flatnonzero(new_key | np.r_[True, rows["digest"][1:] != rows["digest"][:-1]])
            size = np.diff(np.r_[head, len(rows)])
            spans.append(_spans(rows[np.repeat(size > 1, size)], least))
            one = rows[head]  # one segment of each content
            key_head = np.flatnonzero(new_key[head])
            contents = np.diff(np.r_[key_head, len(head)])
            rest = one[np.repeat(contents > 1, contents)]
            wants = np.zeros(len(rest), _WANT)
            wants["doc"], wants["start"], wants["key"] = rest["doc"], rest["start"], rest["key"]
            wants["end"] = rest["start"].astype(np.int64) + rest["windows"] - 1 + least
            _, of = np.unique(rest["key"], return_inverse=True)
            beyond = np.bincount(of, wants["end"] - wants["start"].astype(np.int64))[of] > large if len(rest) else np.zeros(0, bool)
            wants["level"] = np.where(beyond, rest["level"] + 1, 0)
        merged = merge_spans(np.concatenate(spans)) if spans else np.zeros(0, _SPAN)
        out = [(b, None, x.tobytes(), None) for b, x in _deal(merged, c.mix(merged["doc"].view(c.U)), buckets)]
        out += [(b, None, None, x.tobytes()) for b, x in _deal(wants, c.mix(wants["doc"].view(c.U)), buckets)]
        return pa.Table.from_batches([_rows(out)])

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """One bucket of documents -> a row a document with merged spans and sorted wants."""
    out: dict[int, list] = {}
    for name, kind, k in (("spans", _SPAN, 0), ("wants", _WANT, 1)):
        blobs = [np.frombuffer(x, kind) for x in table[name].to_pylist() if x is not None]
        if blobs:
            rows = np.concatenate(blobs)
            rows = merge_spans(rows) if k == 0 else rows[np.lexsort((rows["start"], rows["doc"]))]
            head = np.flatnonzero(np.r_[True, rows["doc"][1:] != rows["doc"][:-1]])
            for a, b in zip(head, [*head[1:], len(rows)]):
                out.setdefault(int(rows["doc"][a]), [None, None])[k] = rows[a:b].tobytes()
    return pa.table(
        {
            "doc": pa.array(list(out), pa.int64()),
            "spans": pa.array([x[0] for x in out.values()], pa.binary()),
            "wants": pa.array([x[1] for x in out.values()], pa.binary()),
        }
    )


# ---------------------------------------------------------------- 3: suffix array, transform, intervals


def suffix_array(text: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Suffixes sorted by their first ``least`` symbols or more; each segment ends in a separator of its own.

    text: bytes or words, separators at ``ends`` (any value). Prefix doubling from eight bytes or one word on; suffixes that
    reach their separator within them are unique at once.
    """
    n = len(text)
    distance = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    step = 8 if text.dtype == np.uint8 else 1
    key = np.zeros(n, np.uint64)
    padded = np.r_[text, np.zeros(step, text.dtype)].astype(np.uint64)
    for k in range(step):
        key = (key << np.uint64(8)) | np.where(distance > k, padded[k : n + k], np.uint64(0))
    # suffixes that end before so many: their order beyond the separator is by segment
    short = distance < step
    order = np.lexsort((np.where(short, np.arange(n), -1), np.where(short, distance, step + 1), key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | short[order][1:] | short[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    while step < least:
        # only suffixes that still share a rank can move, and only among their equals
        run = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
        size = np.diff(np.r_[run, n])
        open_at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_at):
            break
        which = order[open_at]
        after = rank[which + step]  # equals have no separator within the first ``step`` symbols
        again = np.lexsort((after, rank[which]))
        now, after = rank[which[again]], after[again]
        order[open_at] = which[again]
        base = np.repeat(run, size)  # a rank is the place of the first of its equals
        fresh = np.r_[True, (now[1:] != now[:-1]) | (after[1:] != after[:-1])]
        base[open_at] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        rank = np.empty(n, np.int64)
        rank[order] = base
        step *= 2
    return order


def open_boundaries(text: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For every suffix in sorted order: does it share ``least`` symbols with the one before it?

    Breadth-first backward extension on the Burrows-Wheeler transform: the queue holds the intervals of strings of one
    length l; prepending each symbol found in an interval of the transform gives the intervals of length l + 1, whose
    right boundary, where still open, has a common prefix of l and is closed. Separators differ from each other.
    """
    n = len(text)
    symbol = text.astype(np.int64) if text.dtype == np.uint8 else np.unique(text, return_inverse=True)[1]
    symbol[ends] = symbol.max() + 1 + np.arange(len(ends))
    transform = symbol[order - 1]  # the first suffix is preceded by the last symbol, a separator
    by_symbol = np.lexsort((np.arange(n), transform))
    forward = np.empty(n, np.int64)
    first = symbol[order]
    forward[by_symbol] = np.argsort(first, kind="stable")
    before, behind = np.full(n, -1), np.full(n, n)
    same = transform[by_symbol][1:] == transform[by_symbol][:-1]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    behind[by_symbol[:-1][same]] = by_symbol[1:][same]
    is_open = np.ones(n + 1, bool)
    is_open[0] = is_open[n] = False
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(left):
            break
        size = right - left + 1
        interval = np.repeat(np.arange(len(left)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + left[interval]
        last = behind[at] > right[interval]
        start = before[at] < left[interval]
        ends_at, starts_at = at[last], at[start]
        pair = np.lexsort((transform[ends_at], interval[last]))
        twin = np.lexsort((transform[starts_at], interval[start]))
        next_right, next_left = forward[ends_at[pair]], forward[starts_at[twin]]
        fresh = is_open[next_right + 1]
        left, right = next_left[fresh], next_right[fresh]
        is_open[right + 1] = False
    return is_open[:n]


def repeated_windows(pieces: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Per piece the starts of its strings of ``least`` symbols that start more than once in the pieces."""
    sizes = np.array([len(p) for p in pieces])
    stop = np.cumsum(sizes + 1) - 1
    text = np.zeros(stop[-1] + 1, pieces[0].dtype)
    text[np.delete(np.arange(len(text)), stop)] = np.concatenate(pieces)
    order = suffix_array(text, stop, least)
    shared = open_boundaries(text, stop, order, least)
    hit = shared | np.r_[shared[1:], False]
    found = np.sort(order[hit])
    cut = np.searchsorted(found, np.r_[0, stop + 1])
    return [found[a:b] - (e - s) for a, b, e, s in zip(cut[:-1], cut[1:], stop, sizes)]


_FETCHED = "bucket int, heads binary, content binary"


def _fetch(buckets: int, view=None):
    """Documents with wants -> their symbols, packed by key."""

    def run(batches):
        heads, parts, total = [], [], 0

        def flush():
            head = np.concatenate(heads)
            bucket = (c.mix(head["key"]) % c.U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
            rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)])]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[r[0]]) for r in rows], pa.int32()),
                    pa.array([head[r].tobytes() for r in rows], pa.binary()),
                    pa.array([b"".join(parts[k] for k in r.tolist()) for r in rows], pa.binary()),
                ],
                ["bucket", "heads", "content"],
            )

        for batch in batches:
            for text, wants in zip(c.column(batch, "text").to_pylist(), c.column(batch, "wants").to_pylist()):
                want = np.frombuffer(wants, _WANT)
                want = want[want["level"] == 0]
                if not len(want):
                    continue
                raw = _read(text, view)
                heads.append(want)
                parts += [raw[a:b].tobytes() for a, b in zip(want["start"].tolist(), want["end"].tolist())]
                total += int((want["end"] - want["start"]).sum()) * raw.itemsize
                if total >= FLUSH_BYTES:
                    yield flush()
                    heads, parts, total = [], [], 0
        if heads:
            yield flush()

    return run


def _resegment(buckets: int, least: int, view=None):
    """Documents with segments to be halved -> the halves, dealt by key."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, wants in zip(*(c.column(batch, x).to_pylist() for x in ("doc", "text", "wants"))):
                raw = _read(text, view)
                for want in np.frombuffer(wants, _WANT):
                    if want["level"]:
                        level = int(want["level"])
                        out += [(key, digest, doc, start, n, level) for key, digest, start, n in halved(raw, int(want["start"]), int(want["end"]), level, least)]
            if out:
                rows, spans = _collapse(np.array(out, _SEGMENT), least)
                packed = [(b, x.tobytes(), None, None) for b, x in _deal(rows, c.mix(rows["key"]), buckets)]
                if len(spans):
                    packed.append((int(rows["key"][0] % c.U(buckets)), None, merge_spans(spans).tobytes(), None))
                yield _rows(packed)

    return run


def _search(buckets: int, least: int, view=None):
    """One bucket of keys with their symbols -> spans, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, _WANT) for x in table["heads"].to_pylist()]
        head = np.concatenate(heads)
        content = np.frombuffer(b"".join(table["content"].to_pylist()), np.uint8 if view is None else c.U)
        size = (head["end"] - head["start"]).astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((head["start"], head["doc"], head["key"]))
        key = head["key"][order]
        cuts = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), len(order)]
        total = np.r_[0, np.cumsum(size[order])]
        spans, at = [], 0
        while at < len(cuts) - 1:
            to = at + 1
            while to < len(cuts) - 1 and total[cuts[to + 1]] - total[cuts[at]] <= BATCH:
                to += 1
            rows = order[cuts[at] : cuts[to]]
            found = repeated_windows([content[begin[k] : begin[k] + size[k]] for k in rows.tolist()], least)
            n = np.array([len(f) for f in found])
            new = np.zeros(n.sum(), _SPAN)
            new["doc"] = np.repeat(head["doc"][rows], n)
            new["start"] = np.repeat(head["start"][rows], n) + np.concatenate(found)
            new["end"] = new["start"] + least
            spans.append(merge_spans(new))
            at = to
        merged = merge_spans(np.concatenate(spans))
        c.release()
        return pa.Table.from_batches([_rows([(b, None, x.tobytes(), None) for b, x in _deal(merged, c.mix(merged["doc"].view(c.U)), buckets)])])

    return run


# ---------------------------------------------------------------- the operator


_MARKS = "doc long, spans binary, wants binary"


def repeated_spans(docs: DataFrame, doc: str = "doc", text: str = "text", least: int = LEAST, large: int = LARGE, view=None) -> DataFrame:
    """(doc, spans: list of packed spans) of the documents that lose bytes; ``doc`` is a 64-bit key. With ``view``
    (``word_codes``) ``least`` and the spans count its symbols."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    partitions = c.shuffle_partitions(spark)
    buckets = int(max(partitions, chars / BUCKET_BYTES))

    def settled(routed: DataFrame) -> DataFrame:
        return routed.groupBy("bucket").applyInArrow(_match(buckets, least, large), _PACKED).groupBy("bucket").applyInArrow(_by_document, _MARKS)

    shortest = least if view is None else 2 * least - 1  # so many words with white space between
    marks = c.cut_lineage(settled(rows.where(F.octet_length("text") >= shortest).mapInArrow(_route(buckets, least, view), _PACKED)), free=True)
    rounds, last = [marks], marks
    while last.where(F.expr("wants is not null")).mapInArrow(_any_to_halve, "n int").limit(1).count():
        split = rows.join(last.where("wants is not null").select("doc", "wants"), "doc").select("doc", "text", "wants")
        last = c.cut_lineage(settled(split.mapInArrow(_resegment(buckets, least, view), _PACKED)), free=True)
        rounds.append(last)
    found = []
    for marked in rounds:
        wanted = marked.where("wants is not null").select("doc", "wants")
        fetched = rows.join(wanted, "doc").select("text", "wants").mapInArrow(_fetch(buckets, view), _FETCHED)
        # dealt by hand: coalescing by bytes would leave a few tasks with all the sorting
        searched = fetched.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(_search(buckets, least, view), _PACKED)
        found += [marked.where("spans is not null").select("doc", "spans"), searched.groupBy("bucket").applyInArrow(_by_document, _MARKS).select("doc", "spans")]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return c.cut_lineage(both.groupBy("doc").agg(F.collect_list("spans").alias("spans")), free=True)  # two a round


def _any_to_halve(batches):
    for batch in batches:
        n = sum(bool(np.frombuffer(x, _WANT)["level"].any()) for x in c.column(batch, "wants").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([1] * min(n, 1), pa.int32())], ["n"])


def _cut(raw: bytes, packed: list[bytes] | None, by_words: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the spans of bytes that go; those of words run from the first one's start to the last one's end."""
    if not packed:
        return raw, []
    spans = merge_spans(np.concatenate([np.frombuffer(x, _SPAN) for x in packed]))
    cuts = list(zip(spans["start"].tolist(), spans["end"].tolist()))
    if by_words:
        start, end, _ = c.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        cuts = [(int(start[a]), int(end[b - 1])) for a, b in cuts]
    kept, at = [], 0
    for a, b in cuts:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), cuts


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_column), body).alias("doc"), F.col(id_column).alias("id"), body.alias("text"))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, words: int = 0) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, text) of every row; spans are (start, end) in bytes, text is what is
    kept, without characters that were cut in two. If ``words`` is given, (n_passages, passages, prose) follow: the maximal runs
    of passages of more than ``words`` words that repeat, however short these are, as (start, end) in bytes, and the whole text
    without them; the columns before don't depend on it."""
    rows = _keyed(docs, id_column, text)
    found = repeated_spans(rows, least=least)
    if words:
        found = found.join(repeated_spans(rows, least=words + 1, view=word_codes).withColumnRenamed("spans", "runs"), "doc", "full")
    joined = rows.join(found, "doc", "left").drop("doc")

    bytes_kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _RUNS), ("text", pa.string())])
    words_kind = pa.struct([("n_passages", pa.int64()), ("passages", _RUNS), ("prose", pa.string())])

    def by_bytes(raw: bytes, packed: list[bytes] | None) -> tuple:
        kept, cuts = _cut(raw, packed)
        return len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), cuts, kept.decode("utf-8", "ignore")

    def by_words(raw: bytes, packed: list[bytes] | None) -> tuple:
        kept, cuts = _cut(raw, packed, True)
        return len(cuts), cuts, kept.decode()

    views = [("spans", by_bytes, bytes_kind), *[("runs", by_words, words_kind)] * bool(words)]

    def run(batches):
        for batch in batches:
            for part in c.chunks(batch, "text"):
                raws = [body.encode() for body in c.column(part, "text").to_pylist()]
                columns, names = [c.column(part, "id")], ["id"]
                for spans, cut, kind in views:
                    made = [cut(raw, packed) for raw, packed in zip(raws, c.column(part, spans).to_pylist())]
                    for k, field in enumerate(kind):
                        values = [x[k] for x in made]
                        columns.append(pa.array([[{"start": a, "end": b} for a, b in v] for v in values] if field.type == _RUNS else values, field.type))
                        names.append(field.name)
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, text string"
    schema += ", n_passages long, passages array<struct<start:long,end:long>>, prose string" * bool(words)
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, words: int = 0) -> DataFrame:
    """``docs`` with what repeats cut out of the text: strings of ``least`` bytes, where a character cut in two goes too, or, if
    ``words`` is given, passages of more than ``words`` words, of any number of bytes. Other columns are kept."""
    view, least = (word_codes, words + 1) if words else (None, least)
    names, schema = docs.columns, docs.schema
    mark = "__cut"
    while any(name.startswith(mark) for name in names):
        mark += "_"
    spans = repeated_spans(_keyed(docs, id_column, text), least=least, view=view).select(F.col("doc").alias(f"{mark}doc"), F.col("spans").alias(f"{mark}spans"))
    keyed = docs.withColumn(f"{mark}doc", F.xxhash64(F.col(id_column), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = keyed.join(spans, f"{mark}doc", "left").drop(f"{mark}doc")

    def run(batches):
        for batch in batches:
            for part in c.chunks(batch, text):
                texts = [
                    body if body is None or not packed else _cut(body.encode(), packed, bool(words))[0].decode("utf-8", "ignore")
                    for body, packed in zip(c.column(part, text).to_pylist(), c.column(part, f"{mark}spans").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == text else c.column(part, x) for x in names], names)

    return joined.mapInArrow(run, schema)
