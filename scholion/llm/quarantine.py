"""Quarantine and cascading release: replays of conversations whose turns wait for their parents and for repair.

A partitioned Python table function does the replay: PARTITION BY conversation and piece, ORDER BY place. Its ``eval`` keeps the
outcomes of the last four turns, all that a later turn can depend on; ``terminate`` sorts the deliveries and yields
releases and states. Everything a turn draws is computed before as DataFrame columns, so texts never reach Python.

Long conversations. A turn's parent is at most ``REACH`` turns earlier, so where no later turn reaches back over a
place the conversation falls into independent halves. From ``PIECE`` turns on it is cut at the first such place of
every ``PIECE`` turns (one place in 26 is one), and each piece is a partition of the table function. Places come from
``ranking.rank_within``: ranges and prefix sums, no task a conversation. Releases of cut conversations are
numbered in the same way, by (last attempt, place) over ranges, and their states are running sums over those. What a range
needs of the others are two totals a partition, so neither a task, nor the driver, nor a broadcast grows with a
conversation.

Defined results: null conversation ids are one conversation and hash as the empty text, as do null turns, which come
first. Rows that repeat (conv_id, turn) are turns of their own, ordered by the checksum of their text, and draw alike; where
a repeated turn draws a parent, all its copies are one chain that can't be cut. A null text is the empty text. States are
64-bit and wrap around, which needs more than 90,000 releases. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scholion.llm import common as c
from scholion.operators import ranking

SPACING = 7  # seconds between arrivals
REACH = 4  # a parent is at most as many turns earlier
ATTEMPTS, WAIT = 6, 10
PIECE = 4096


def draw(k: int) -> Column:
    """crc32 of ``k:conv_id:turn`` in decimal."""
    text = F.concat(F.lit(f"{k}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    return F.crc32(text.cast("binary"))


def drawn(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, weight, back, repair, misses): the text's checksum, the distance to the parent, seconds to repair (null:
    not faulty), one bit for every attempt that fails by its draw."""
    misses = sum((F.when(draw(a + 2) % 3 == 0, 1 << a).otherwise(0) for a in range(1, ATTEMPTS + 1)), F.lit(0))
    return conversations.select(
        "conv_id", "turn",
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("weight"),
        (draw(0) % (REACH + 1)).cast("int").alias("back"),
        F.when(draw(1) % 101 < 50, (draw(2) % 101).cast("int")).alias("repair"),
        misses.cast("int").alias("misses"),
    )


def pieces(placed: DataFrame, piece: int) -> DataFrame:
    """``placed`` (conv_id, place, back, ...) with ``piece``: the place at which the part of its conversation starts that it belongs to.

    Only conversations beyond ``piece`` turns have rows in what is computed here.
    """
    far = placed.where(F.col("place") >= piece).select("conv_id", "place", "back")
    # a turn that reaches back over a place forbids a cut there
    over = far.where("back > 0").select("conv_id", F.explode(F.sequence(F.col("place") - F.col("back") + 1, F.col("place"))).alias("place"))
    marks = far.select("conv_id", "place", F.lit(0).alias("over")).unionByName(over.select("conv_id", "place", F.lit(1).alias("over")))
    cuts = marks.groupBy("conv_id", "place").agg(F.max("over").alias("over")).where(f"over = 0 and place >= {piece}")
    block = F.floor(F.col("place") / piece)
    first = cuts.groupBy("conv_id", block.alias("block")).agg(F.min("place").alias("cut"))
    blocks = far.select("conv_id", block.alias("block")).distinct().join(_renamed(first), _same("block"), "left").drop("__conv", "__block")
    # the last cut before a block: cuts grow, so it is a running maximum, taken in two levels
    above = blocks.withColumn("upper", F.floor(F.col("block") / piece))
    near = W.partitionBy("conv_id", "upper").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    uppers = above.groupBy("conv_id", "upper").agg(F.max("cut").alias("most"))
    uppers = uppers.select(
        F.col("conv_id").alias("__conv"), F.col("upper").alias("__upper"),
        F.max("most").over(W.partitionBy("conv_id").orderBy("upper").rowsBetween(W.unboundedPreceding, -1)).alias("__most"),
    )
    above = above.withColumn("__near", F.max("cut").over(near)).join(uppers, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("upper") == F.col("__upper")))
    table = above.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "cut", F.coalesce("__near", "__most", F.lit(0)).alias("open"))
    beyond = placed.where(f"place >= {piece}").withColumn("block", block).join(table, _same("block"))
    beyond = beyond.withColumn("piece", F.when(F.col("place") >= F.col("cut"), F.col("cut")).otherwise(F.col("open")).cast("long"))
    return placed.where(f"place < {piece}").withColumn("piece", F.lit(0).cast("long")).unionByName(beyond.select(*placed.columns, "piece"))


def _renamed(first: DataFrame) -> DataFrame:
    return first.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "cut")


def _same(block: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col(block) == F.col("__block"))


def outcome(arrival: int, repair: int | None, misses: int, parent: tuple[str, int] | None) -> tuple[str, int, int | None, int | None]:
    """(status, attempts, first attempt, last attempt) of a turn whose parent ended as (status, last attempt)."""
    if parent is not None and parent[0] != "delivered":
        return "blocked", 0, None, None
    at = first = arrival if parent is None else max(arrival, parent[1])
    if repair is None:
        return "delivered", 1, first, first
    wait = WAIT
    for attempt in range(1, ATTEMPTS + 1):
        if at >= arrival + repair and not misses >> attempt & 1:
            return "delivered", attempt, first, at
        if attempt < ATTEMPTS:
            at, wait = at + wait, wait * 2
    return "dead", ATTEMPTS, first, at


class Replay:
    """The table function: one instance a piece of a conversation."""

    def __init__(self):
        self.rows, self.recent, self.least = [], {}, None

    def eval(self, row):
        place, back = row["place"], row["back"]
        parent = self.recent.get(place - back) if back else None
        found = outcome(SPACING * place, row["repair"], row["misses"], parent)
        self.recent[place] = (found[0], found[3])
        self.recent.pop(place - REACH - 1, None)
        self.rows.append((row["conv_id"], row["turn"], place, row["weight"], row["limit"], *found))

    def terminate(self):
        """Releases and states within the piece; they stand if it is the whole conversation."""
        if not self.rows:
            return
        released, state = {}, 0
        whole = self.rows[0][2] == 0 and len(self.rows) < self.rows[0][4]
        if whole:
            for number, row in enumerate(sorted((r for r in self.rows if r[5] == "delivered"), key=lambda r: (r[8], r[2])), 1):
                state = ranking._wrap(state + number * row[3])
                released[row[2]] = (number, state)
        for conv, turn, place, weight, _, *found in self.rows:
            yield (conv, turn, place, weight, *found, *released.get(place, (None, None)), whole)


COLUMNS = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def replay(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state) of every turn."""
    turns = c.cut_lineage(drawn(conversations))  # numbers only: texts are read once
    placed = ranking.rank_within(turns, "conv_id", ["turn", "weight"], "place").withColumn("place", F.col("place") - 1)
    ready = pieces(c.cut_lineage(placed), piece).withColumn("limit", F.lit(piece))
    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}
    function = F.udtf(
        Replay, useArrow=False,  # most conversations are short: a record batch each costs more than pickled rows
        returnType=f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, place long, weight long, status string, attempts int, first_at long, last_at long, release_no long, state long, whole boolean",
    )
    ended = c.cut_lineage(function(ready.asTable().partitionBy("conv_id", "piece").orderBy("place")))
    cut = ended.where("not whole").drop("release_no", "state")
    ranged = ranking.in_ranges(cut.where("status = 'delivered'"), ["conv_id"], ["last_at", "place"])
    numbered = ranking.running_sum(ranged, ["conv_id"], None, "release_no")
    # a product beyond 64 bits wraps as the sum does
    product = F.expr("pmod(cast(release_no as decimal(20,0)) * weight + 9223372036854775808, 18446744073709551616) - 9223372036854775808")
    stated = ranking.running_sum(numbered.withColumn("product", product.cast("long")), ["conv_id"], "product", "state")
    rest = cut.where("status <> 'delivered'").select(*COLUMNS[:-2], F.lit(None).cast("long").alias("release_no"), F.lit(None).cast("long").alias("state"))
    return ended.where("whole").select(*COLUMNS).unionByName(stated.select(*COLUMNS)).unionByName(rest)


#: The same replay for a database with recursion: checksums byte by byte, then one place of every conversation a step.
ORACLE = f"""
WITH RECURSIVE ranked AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
strings AS (
  SELECT conv_id, place, k, CASE WHEN k = 9 THEN text ELSE k || ':' || conv_id || ':' || turn END AS s
  FROM ranked, (SELECT unnest(range(10)) AS k)),
sums AS (
  SELECT conv_id, place, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
  FROM strings, polynomial),
drawn AS (
  SELECT conv_id, place, max(h) FILTER (k = 9) AS weight, max(h) FILTER (k = 0) % 5 AS back,
    CASE WHEN max(h) FILTER (k = 1) % 101 < 50 THEN max(h) FILTER (k = 2) % 101 END AS repair,
    list(h % 3 = 0 ORDER BY k) FILTER (k BETWEEN 3 AND 8) AS misses
  FROM sums GROUP BY conv_id, place),
steps(conv_id, place, ended) AS (
  SELECT conv_id, CAST(-1 AS BIGINT), CAST([] AS STRUCT(status VARCHAR, attempts INT, first_at BIGINT, last_at BIGINT)[]) FROM ranked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, place, list_append(ended, CASE
    WHEN parent.status <> 'delivered' THEN {{'status': 'blocked', 'attempts': 0, 'first_at': NULL, 'last_at': NULL}}
    WHEN good IS NOT NULL THEN {{'status': 'delivered', 'attempts': good, 'first_at': began, 'last_at': began + {WAIT} * (CAST(pow(2, good - 1) AS BIGINT) - 1)}}
    ELSE {{'status': 'dead', 'attempts': {ATTEMPTS}, 'first_at': began, 'last_at': began + {WAIT} * (CAST(pow(2, {ATTEMPTS - 1}) AS BIGINT) - 1)}} END)
  FROM (SELECT *, CASE WHEN repair IS NULL THEN 1 ELSE list_filter(range(1, {ATTEMPTS + 1}),
      lambda a: began + {WAIT} * (CAST(pow(2, a - 1) AS BIGINT) - 1) >= {SPACING} * place + repair AND NOT misses[a])[1] END AS good
    FROM (SELECT *, greatest({SPACING} * place, coalesce(parent.last_at, 0)) AS began
      FROM (SELECT s.conv_id, d.place, s.ended, d.repair, d.misses,
          CASE WHEN d.back > 0 AND d.back <= d.place THEN s.ended[d.place - d.back + 1] END AS parent
        FROM steps s JOIN drawn d ON d.conv_id = s.conv_id AND d.place = s.place + 1)))),
finished AS (
  SELECT r.conv_id, r.turn, r.place, d.weight, unnest(list_extract(s.ended, r.place + 1)) FROM ranked r JOIN drawn d USING (conv_id, place)
  JOIN (SELECT conv_id, max_by(ended, place) AS ended FROM steps GROUP BY conv_id) s USING (conv_id)),
released AS (
  SELECT conv_id, place, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, place) AS release_no, weight, last_at FROM finished WHERE status = 'delivered'),
stated AS (
  SELECT conv_id, place, release_no, CAST(sum(release_no * weight) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM released)
SELECT conv_id, turn, status, CAST(attempts AS INTEGER) AS attempts, first_at, last_at, release_no, state FROM finished LEFT JOIN stated USING (conv_id, place)
"""
