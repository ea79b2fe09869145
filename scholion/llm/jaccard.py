"""N-gram Jaccard join: which documents' shingle sets overlap by at least 85 %, by prefix-tree joins.

A document's set holds its distinct 4-word shingles (A-Z folded) as 64-bit hashes. Sets x and y link when
100 * |x & y| >= 85 * |x | y|.

1. Shingles are dealt by hash in packed blocks; each task counts, for its share of the shingles, in how many
   documents they occur, and returns those that occur twice or more to the block they came from. A set of n
   shingles that keeps fewer than ceil(0.85 n) of them can't link with anything and is final.
2. The remaining sets are ordered from their rarest shingle on (document frequency, then hash). Equal sets become
   one class, by digest, before any comparison.
3. Prefix trees: classes meet in blocks and each block's sets, ordered by frequency, form a path-compressed trie.
   Every set walks the trie; sets below a node share the partial overlap on the path to it, and subtrees are
   left where the overlap still possible with the shingles that remain can't reach the bound, or where lengths
   don't fit. Links only matter between sets that aren't joined yet (union-find), so a block of n near copies
   costs about n leaves, not n * n pairs, and gives n - 1 links.
   First come blocks of classes that share their smallest shingle under one of ``ROUTES`` hash functions, large
   blocks salted; this joins nearly all groups.
4. Exact completion: linked sets share a shingle among their first |x| - ceil(0.85 |x|) + 1 in the common order.
   Shingles whose holders already are one component can't add a link; the holders of each other one (once for
   equal lists) meet in a block. Beyond ``BLOCK`` holders they meet in cells by size: sizes of linked sets differ by a
   factor of 100/85 at most, so each set is in the cell of its size class and in the next. Cells are judged like
   shingles, and one that still is beyond ``BLOCK`` sets is cut into all pairs of parts. No cap anywhere.
5. Components of links between classes, on the cluster.

Defined results: texts without words have the empty set and link with nothing (component: their id); with fewer
than four words the whole sequence is the only shingle. A null id gets its component's smallest id, or null.
Rows that share an id are compared each. Ids are integers. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scholion.llm import common as c

SIZE, SHARE = 4, 85
ROUTES, BLOCK = 2, 400
FLUSH_TOKENS, FLUSH_DOCS = 1_200_000, 60_000
BUCKET_WORDS = 2_000_000
_ROUTE_SALT = c.stream(41, ROUTES)


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def least_overlap(n, share: int = SHARE):
    """ceil(share * n / 100)."""
    return -(-share * n // 100)


# ---------------------------------------------------------------- 1: document frequencies, packed


def _pack(flush: int, sets: list[np.ndarray], ids: list, buckets: int):
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, c.U)
    owner = np.repeat(np.arange(len(sets)), size)
    bucket = ((tokens >> c.U(33)) % c.U(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)] if len(cuts) else cuts
    n = len(cuts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[bucket[cuts].astype(np.int32), np.int32(flush % buckets)]),
            pa.array(np.full(n + 1, flush, np.int64)),
            pa.array([pack(tokens[a:b]) for a, b in zip(cuts, ends)] + [None], pa.binary()),
            pa.array([np.diff(owner[a:b], prepend=0).astype(np.uint16).tobytes() for a, b in zip(cuts, ends)] + [None], pa.binary()),
            pa.array([None] * (n + 1), pa.binary()),
            pa.array([None] * n + [ids], pa.list_(pa.int64())),
            pa.array([None] * n + [size.astype(np.int32).tolist()], pa.list_(pa.int32())),
        ],
        _PACKED_NAMES,
    )


_PACKED_NAMES = ["bucket", "flush", "tokens", "owners", "counts", "ids", "sizes"]
_PACKED = "bucket int, flush long, tokens binary, owners binary, counts binary, ids array<long>, sizes array<int>"


def _shingle(buckets: int, size: int):
    def run(batches):
        part, seq, held, ids, total = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for piece in c.chunks(batch, "text"):
                sets = c.shingle_sets(*c.text_buffer(c.column(piece, "text")), size)
                held += sets
                ids += c.column(piece, "id").to_pylist()
                total += sum(map(len, sets))
                while len(held) >= FLUSH_DOCS or total >= FLUSH_TOKENS:
                    yield from _pack((part << 24) + seq, held[:FLUSH_DOCS], ids[:FLUSH_DOCS], buckets)
                    held, ids, seq = held[FLUSH_DOCS:], ids[FLUSH_DOCS:], seq + 1
                    total = sum(map(len, held))
        if held:
            yield from _pack((part << 24) + seq, held, ids, buckets)
        c.release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: keep the tokens of two or more documents, with their document frequency."""
    rows = table.to_pylist()
    data = [r for r in rows if r["tokens"] is not None]
    out = [r for r in rows if r["tokens"] is None]
    if data:
        parts = [unpack(r["tokens"]) for r in data]
        tokens = np.concatenate(parts)
        order = np.argsort(tokens)
        ranked = tokens[order]
        head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        run = np.diff(np.r_[head, len(ranked)])
        count = np.empty(len(tokens), np.int64)
        count[order] = np.repeat(run, run)
        at = 0
        for r, part in zip(data, parts):
            n = count[at : at + len(part)]
            at += len(part)
            keep = n >= 2
            if keep.any():
                owner = np.cumsum(np.frombuffer(r["owners"], np.uint16), dtype=np.int64)[keep]
                out.append(r | {"tokens": pack(part[keep]), "owners": owner.astype(np.uint16).tobytes(), "counts": np.minimum(n[keep], (1 << 32) - 1).astype(np.uint32).tobytes()})
    c.release()
    return pa.Table.from_pylist(out, schema=_PACKED_SCHEMA)


_PACKED_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("flush", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
)


def _assemble(share: int):
    def run(table: pa.Table) -> pa.Table:
        """One flush: every document with its size; those that may link with their shared tokens in the common order."""
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        data = [r for r in rows if r["ids"] is None]
        ids, sizes = own["ids"], np.array(own["sizes"], np.int64)
        digest, kept, routes = ([None] * len(ids) for _ in range(3))
        if data:
            owner = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in data]).astype(np.int64)
            tokens = np.concatenate([unpack(r["tokens"]) for r in data])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in data])
            many = np.bincount(owner, minlength=len(ids))
            alive = (many >= least_overlap(sizes, share)) & (sizes > 0)
            select = alive[owner]
            owner, tokens, counts = owner[select], tokens[select], counts[select]
            order = np.lexsort((tokens, counts, owner))
            owner, tokens = owner[order], tokens[order]
            ends = np.searchsorted(owner, np.arange(len(ids)), "right")
            for k in np.flatnonzero(alive):
                mine = tokens[ends[k] - many[k] : ends[k]]
                name = pack(mine) if many[k] == sizes[k] else pack(mine) + repr((own["flush"], int(k))).encode()
                digest[k] = hashlib.blake2b(name, digest_size=16).digest()
                kept[k] = pack(mine)
                routes[k] = [int(mine[np.argmin(c.mix(mine ^ salt))].astype(np.int64)) for salt in _ROUTE_SALT]
        return pa.table(
            {
                "id": pa.array(ids, pa.int64()),
                "n": pa.array(sizes),
                "digest": pa.array(digest, pa.binary()),
                "tokens": pa.array(kept, pa.binary()),
                "routes": pa.array(routes, pa.list_(pa.int64())),
            }
        )

    return run


# ---------------------------------------------------------------- 3: the prefix tree of a block


class Node:
    __slots__ = ("tokens", "children", "sets", "depth", "low", "high", "shortest", "longest", "deepest")


def build_trie(sets: list[np.ndarray], sizes: list[int], low: int, high: int, depth: int) -> Node:
    """Node over sets[low:high], which are sorted and share their first ``depth`` tokens."""
    root = Node()
    work = [(root, low, high, depth)]
    while work:
        node, low, high, depth = work.pop()
        first, last = sets[low], sets[high - 1]
        n = min(len(first), len(last)) - depth
        differ = np.flatnonzero(first[depth : depth + n] != last[depth : depth + n])
        shared = int(differ[0]) if len(differ) else n
        node.tokens, node.depth, node.low, node.high = first[depth : depth + shared], depth + shared, low, high
        node.shortest, node.longest = min(sizes[low:high]), max(sizes[low:high])
        node.deepest = max(len(s) for s in sets[low:high])
        depth += shared
        node.sets, node.children = [], []
        at = low
        while at < high and len(sets[at]) == depth:
            node.sets.append(at)
            at += 1
        while at < high:
            token, end = sets[at][depth], at + 1
            step = 1
            while end < high and sets[min(end + step, high) - 1][depth] == token:  # gallop, then close in
                end = min(end + step, high)
                step *= 2
            while step >= 1:
                if end + step <= high and sets[end + step - 1][depth] == token:
                    end += step
                else:
                    step //= 2
            child = Node()
            node.children.append(child)
            work.append((child, at, end, depth))
            at = end
    return root


def trie_links(tokens: list[np.ndarray], sizes: list[int], joined: list[int] | None = None, share: int = SHARE) -> list[tuple[int, int]]:
    """Links (of those found, enough to connect what links) between the sets of a block.

    ``joined`` numbers sets that are connected already. Tokens that a set doesn't share with any other may be
    missing from ``tokens``; ``sizes`` counts them.
    """
    n = len(tokens)
    forest = c.Forest(n)
    if joined is not None:
        seen: dict[int, int] = {}
        for k, group in enumerate(joined):
            forest.union(seen.setdefault(group, k), k)
    if forest.parts == 1:
        return []
    flat = np.concatenate(tokens)
    names, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, -count))] = np.arange(len(names))  # frequent first: long common paths
    code = place[code]
    ends = np.cumsum([len(t) for t in tokens])
    sets = [np.sort(code[e - len(t) : e]) for e, t in zip(ends, tokens)]
    order = sorted(range(n), key=lambda k: sets[k].astype(">u4").tobytes())
    sets, sizes = [sets[k] for k in order], [int(sizes[k]) for k in order]
    root = build_trie(sets, sizes, 0, n, 0)
    mark = np.zeros(len(names), bool)
    links = []
    for x in range(n):
        if forest.parts == 1:
            break
        own, size = sets[x], sizes[x]
        mark[own] = True
        least, most = -(-share * size // 100), size * 100 // share
        stack = [(root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.high <= x + 1 or node.longest < least or node.shortest > most:
                continue
            if len(node.tokens):
                overlap += int(np.count_nonzero(mark[node.tokens]))
                rest = len(own) - int(np.searchsorted(own, node.tokens[-1], "right"))
            else:
                rest = len(own)
            possible = overlap + min(rest, node.deepest - node.depth)
            if (100 + share) * possible < share * (size + max(node.shortest, least)):
                continue
            for y in node.sets:
                if y > x and (100 + share) * overlap >= share * (size + sizes[y]) and forest.union(order[x], order[y]):
                    links.append((order[x], order[y]))
            stack.extend((child, overlap) for child in node.children)
        mark[own] = False
    return links


def _block_links(share: int):
    """Rows sorted by block: (block, key, n, tokens, joined) -> links between keys."""

    def close(rows, out):
        if len(rows) > 1:
            found = trie_links([unpack(r["tokens"]) for r in rows], [r["n"] for r in rows], [r["joined"] for r in rows], share)
            out += [(rows[a]["key"], rows[b]["key"]) for a, b in found]

    def run(batches):
        block, rows, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != block:
                    close(rows, out)
                    block, rows = r["block"], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
            out = []
        close(rows, out)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _meet(rows: DataFrame, share: int) -> DataFrame:
    """Links of rows (block, key, n, tokens, joined), blocks in one task each."""
    n = c.shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "block").sortWithinPartitions("block").select("block", "key", "n", "tokens", "joined").mapInArrow(_block_links(share), "a long, b long")


# ---------------------------------------------------------------- the join


def _prefixes(share: int):
    """Classes (key, n, tokens) -> (key, level, shingle) of every shingle of the prefix, with the set's size class."""

    def run(batches):
        for batch in batches:
            keys, levels, shingles = [], [], []
            for key, n, raw in zip(*(c.column(batch, x).to_pylist() for x in ("key", "n", "tokens"))):
                tokens = unpack(raw)
                first = tokens[: len(tokens) - int(least_overlap(n, share)) + 1].astype(np.int64)
                keys.append(np.full(len(first), key, np.int64))
                levels.append(np.full(len(first), size_class(n, share), np.int32))
                shingles.append(first)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, levels, shingles)], ["key", "level", "shingle"])

    return run


def _mixed(holders: DataFrame, cell: list[str]) -> DataFrame:
    """Cells (of ``cell``, members) whose sets aren't one component yet."""
    found = holders.groupBy(cell).agg(
        F.min("joined").alias("low"), F.max("joined").alias("high"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("list")
    )
    return found.where("low <> high").drop("low", "high")


def _once(cells: DataFrame, cell: list[str]) -> DataFrame:
    """One of the cells with the same list of sets."""
    return cells.groupBy("list", "members").agg(F.min(F.struct(cell)).alias("cell")).select("members", "cell.*")


def size_class(n: int, share: int = SHARE) -> int:
    """A number that grows with n; of linked sets it differs by one at most."""
    level, bound = 0, 1
    while bound < n:  # bounds: 1, and the largest size that links with one more than the bound before
        bound, level = (bound + 1) * 100 // share, level + 1
    return level


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    partitions = c.shuffle_partitions(spark)
    buckets = int(max(partitions, chars / 6 / BUCKET_WORDS))

    def assembled() -> DataFrame:
        packed = rows.mapInArrow(_shingle(buckets, size), _PACKED)
        counted = packed.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(_count, _PACKED)
        return counted.drop("bucket").groupBy("flush").applyInArrow(_assemble(share), "id long, n long, digest binary, tokens binary, routes array<long>")

    key = F.xxhash64("digest")
    full = c.cut_lineage(assembled(), free=True)
    # equal sets are one class, named by a 64-bit key of their digest
    classes = c.cut_lineage(
        full.where("digest is not null").groupBy(key.alias("key")).agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("routes").alias("routes"))
    )
    every = c.cut_lineage(full.select("id", "n", "digest"))
    del full
    c.free_files(spark)
    alive = every.where("digest is not null")
    names = alive.groupBy("digest").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    routed = classes.select("key", F.posexplode("routes").alias("route", "shared")).withColumn("place", F.xxhash64("route", "shared"))
    busy = routed.groupBy("place").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = routed.join(busy, "place").select(
        "key", F.xxhash64("place", F.pmod(F.xxhash64("key", "route"), F.ceil(F.col("members") / BLOCK))).alias("block"), F.col("key").alias("joined")
    )
    sets = classes.select("key", "n", "tokens")
    links = c.cut_lineage(_meet(blocks.join(sets, "key"), share), free=True)
    first = c.connected_components(links)
    state = c.cut_lineage(
        classes.select("key").join(first, F.col("key") == F.col("vertex"), "left").select("key", F.coalesce("component", "key").alias("joined"))
    )
    # exact completion
    cell = ["shingle", "level"]
    holders = sets.mapInArrow(_prefixes(share), "key long, level int, shingle long").join(state, "key")
    mixed = c.cut_lineage(_mixed(holders, ["shingle"]), free=True)
    whole = holders.drop("level").join(_once(mixed.where(F.col("members") <= BLOCK), ["shingle"]), "shingle").withColumn("level", F.lit(-1))
    large = holders.join(mixed.where(F.col("members") > BLOCK).select("shingle"), "shingle").withColumn("level", F.explode(F.array("level", F.col("level") + 1)))
    sized = large.join(_once(_mixed(large, cell), cell), cell)
    names_of = ["key", "joined", *cell, "members"]
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    cells = whole.select(names_of).unionByName(sized.select(names_of)).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key", "shingle"), F.col("parts")).cast("int"))
    cells = cells.select("key", "joined", *cell, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("key", "joined", F.xxhash64(*cell, F.least("part", "other"), F.greatest("part", "other")).alias("block"))
    more = c.cut_lineage(_meet(cells.join(sets, "key"), share), free=True)
    if more.limit(1).count():
        a = state.select(F.col("key").alias("a"), F.col("joined").alias("ca"))
        b = state.select(F.col("key").alias("b"), F.col("joined").alias("cb"))
        second = c.connected_components(more.join(a, "a").join(b, "b").select("ca", "cb"), "ca", "cb")
        state = state.join(second, F.col("joined") == F.col("vertex"), "left").select("key", F.coalesce("component", "joined").alias("joined"))
    groups = names.withColumn("key", key).join(state, "key")
    least = groups.groupBy("joined").agg(F.min("least_id").alias("component_id"))
    class_groups = groups.join(least, "joined").select("digest", "component_id")
    linked = alive.select("id", "n", "digest").join(class_groups, "digest").select("id", "n", "component_id")
    single = every.where("digest is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(single).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, share: int = SHARE) -> DataFrame:
    """Of every group one row of ``docs``, the one with the smallest id (null ids last, then by text); all columns kept.

    Rows are told apart by id and text, so rows that share an id are decided each; of rows equal in both one stays,
    whatever their other columns. Texts without words link with nothing: all their rows stay.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn(name, F.xxhash64(F.col(id_column), body))
    rows = keyed.select(F.col(name).alias("row"), F.col(id_column).alias("id"))
    groups = jaccard_groups(keyed.select(F.col(name).alias("row"), body.alias("text")), "row", "text", size, share).where("n_shingles > 0").select("row", "component_id")
    members = groups.groupBy("row").agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("copies"))
    members = members.join(rows.groupBy("row").agg(F.first("id").alias("id")), "row")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")).select("group", F.col("first.row").alias("kept"))
    decided = c.cut_lineage(
        members.join(first, "group").where("row <> kept or copies > 1").select(F.col("row").alias(name), (F.col("row") == F.col("kept")).alias("twin")), free=True
    )
    whole = keyed.join(decided.select(name), name, "left_anti")
    twins = keyed.join(decided.where("twin").select(name), name).dropDuplicates([name])
    return whole.unionByName(twins).select(*docs.columns)
