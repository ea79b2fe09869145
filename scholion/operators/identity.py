"""Identity of records: an order-dependent greedy merge, found by parallel rounds.

The rule is sequential: a record joins the first entity, among those that hold one of its keys, that it doesn't contradict, and
starts an entity of its own otherwise; entities fill their empty fields from what joins them. What an entity knows when a
record arrives is the first value of each field among its earlier members, so a whole assignment of records to entities can be
checked at once, by joins and aggregates: every record's choice is made anew against the entities as they were before it.
An assignment that gives itself is the sequential one, as a record's choice depends on earlier records only.

Choices are kept as pointers to the member that brought the shared key, and entities are the roots of these pointers, found by
pointer jumping. So when a record leaves its entity, all that follow it through later records move at once. Rounds are as
many as there are contradictions that depend on each other, not as records in a chain; the first guess, that nothing contradicts, is
usually the result. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholion.operators import ranking
from scholion.session import stored

STRONG = ("doi", "pmid", "pmcid", "arxiv_id")
PROVIDERS = ("openalex:", "semantic_scholar:")


def _held(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def _any_starts(keys: str, prefix: str) -> Column:
    return F.exists(keys, lambda x: x.startswith(prefix))


def _completed(records: DataFrame) -> DataFrame:
    """The columns that decide, null where the records lack them."""
    kinds = {**dict.fromkeys(STRONG, "string"), "year": "long", "authors": "array<string>"}
    for name, kind in kinds.items():
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    names = F.array_distinct(F.transform("authors", lambda x: F.lower(x)))
    return records.select("pos", "keys", *STRONG, "year", F.when(F.size("authors") > 0, names).alias("authors"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(pos, entity): where the pointers (pos, to) end; a record that points to itself is an entity."""
    now = stored(pointers.select("pos", F.col("to").alias("entity")))
    while True:
        moved = stored(_jumped(_jumped(now.withColumn("__moved", F.lit(False)))))
        now = moved.drop("__moved")
        if not moved.where("__moved").head(1):
            return now


def _jumped(now: DataFrame) -> DataFrame:
    """Every pointer twice as far; entities, which point to themselves, are left out of the join."""
    ahead = now.where("pos <> entity").select(F.col("pos").alias("__at"), F.col("entity").alias("__next"))
    moved = now.join(ahead, F.col("entity") == F.col("__at"), "left")
    return moved.select("pos", F.coalesce("__next", "entity").alias("entity"), (F.col("__moved") | F.col("__next").isNotNull()).alias("__moved"))


def _choices(rows: DataFrame, keys: DataFrame, entities: DataFrame) -> DataFrame:
    """(pos, entity, at, brought, fits) of every record and earlier entity that shares a key: ``at`` is the key's place in the record,
    ``brought`` the member through which the entity has it."""
    owned = keys.join(entities, "pos").groupBy("entity", "key").agg(F.min("pos").alias("brought"))
    pairs = keys.join(owned, "key").where("brought < pos")
    near = pairs.groupBy("pos", "entity").agg(
        F.min(F.struct("at", "brought")).alias("first"), F.max(~F.col("key").startswith("title:")).alias("plain"),
        *[F.max(F.col("key").startswith(p)).alias(f"shares{k}") for k, p in enumerate(PROVIDERS)],
    )
    members = rows.join(entities, "pos")
    fields = [*STRONG, "year", "authors"]
    known = members.groupBy("entity").agg(
        *[F.min(F.when(_held(x) if x != "authors" else F.col(x).isNotNull(), F.struct("pos", x))).alias(f"e_{x}") for x in fields],
        *[F.min(F.when(F.col(f"has{k}"), F.col("pos"))).alias(f"e_has{k}") for k in range(len(PROVIDERS))],
    )
    rich = near.join(known, "entity").join(rows, "pos")
    before = lambda x: F.when(F.col(f"e_{x}.pos") < F.col("pos"), F.col(f"e_{x}.{x}"))
    differ = F.lit(False)
    for x in STRONG:
        differ |= F.coalesce(_held(x) & (before(x) != F.col(x)), F.lit(False))
    doubt = F.coalesce(before("year") != F.col("year"), F.lit(False)) | F.coalesce(~F.arrays_overlap(before("authors"), F.col("authors")), F.lit(False))
    for k in range(len(PROVIDERS)):
        doubt |= F.coalesce(F.col(f"has{k}") & (F.col(f"e_has{k}") < F.col("pos")) & ~F.col(f"shares{k}"), F.lit(False))
    return rich.select("pos", "entity", F.col("first.at").alias("at"), F.col("first.brought").alias("brought"), (~differ & (F.col("plain") | ~doubt)).alias("fits"))


def identities(records: DataFrame) -> DataFrame:
    """(pos, entity, identity_conflict) of records (pos, keys, and as far as they exist doi, pmid, pmcid, arxiv_id, year, authors).

    ``pos`` orders the records and is unique; ``entity`` is the position of an entity's first record. An entity is in conflict
    if it shared a key with entities that contradicted it when it began, or if it was such a one.
    """
    rows = _completed(records)
    rows = stored(rows.select("*", *[_any_starts("keys", p).alias(f"has{k}") for k, p in enumerate(PROVIDERS)]))
    keys = rows.select("pos", F.posexplode("keys").alias("at", "key")).where("key is not null").groupBy("pos", "key").agg(F.min("at").alias("at"))
    keys = stored(keys)
    rows = rows.drop("keys")
    # the first guess: each record joins through the first of its keys that an earlier record has
    first = keys.groupBy("key").agg(F.min("pos").alias("brought"))
    guess = keys.join(first, "key").where("brought < pos").groupBy("pos").agg(F.min(F.struct("at", "brought"))["brought"].alias("to"))
    entities = _roots(rows.select("pos").join(guess, "pos", "left").select("pos", F.coalesce("to", "pos").alias("to")))
    while True:
        choices = stored(_choices(rows, keys, entities))
        best = choices.where("fits").groupBy("pos").agg(F.min(F.struct("at", "brought", "entity")).alias("best"))
        chosen = entities.join(best.select("pos", F.col("best.brought").alias("to"), F.col("best.entity").alias("into")), "pos", "left")
        if not chosen.where(F.coalesce("into", "pos") != F.col("entity")).head(1):
            break
        entities = _roots(chosen.select("pos", F.coalesce("to", "pos").alias("to")))
    clashes = choices.join(entities.where("pos = entity").select("pos"), "pos")
    flagged = clashes.select(F.col("pos").alias("entity")).unionByName(clashes.select("entity")).distinct().withColumn("identity_conflict", F.lit(True))
    return entities.join(flagged, "entity", "left").select("pos", "entity", F.coalesce("identity_conflict", F.lit(False)).alias("identity_conflict"))


def merge_records(records: DataFrame) -> DataFrame:
    """(pos, title, year, keys, members, identity_conflict): one row an entity, with the first title and year that its members have,
    and all keys and positions of its members in their order."""
    found = records.select("pos", "keys", "title", "year").join(identities(records), "pos")
    keyed = found.select("entity", "pos", F.posexplode("keys").alias("at", "key")).groupBy("entity", "key").agg(F.min(F.struct("pos", "at")).alias("place"))
    keys = keyed.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    merged = found.groupBy("entity").agg(
        F.min(F.when(_held("title"), F.struct("pos", "title")))["title"].alias("title"), F.min(F.when(F.col("year").isNotNull(), F.struct("pos", "year")))["year"].alias("year"),
        F.array_sort(F.collect_list("pos")).alias("members"), F.max("identity_conflict").alias("identity_conflict"),
    )
    out = merged.join(keys, "entity", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    return out.select(F.col("entity").alias("pos"), "title", F.col("year").cast("long").alias("year"), "keys", "members", "identity_conflict")


def entity_fields(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records an entity stands for as one: (entity, keys, the deciding fields, identity_conflict), each field as its first member has it."""
    rows = _completed(records).join(found, "pos")
    firsts = [F.min(F.when(_held(x) if x != "authors" else F.col(x).isNotNull(), F.struct("pos", x)))[x].alias(x) for x in (*STRONG, "year", "authors")]
    keyed = rows.select("entity", "pos", F.posexplode("keys").alias("at", "key")).groupBy("entity", "key").agg(F.min(F.struct("pos", "at")).alias("place"))
    keys = keyed.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))  # an entity's own identifiers
    return rows.groupBy("entity").agg(*firsts, F.max("identity_conflict").alias("identity_conflict")).join(keys, "entity", "left")


def merge_additions(records: DataFrame, original: str, candidate: str, rank: str, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Two-phase merge: (pos, candidate_id, pinned, identity_conflict, ``pinned`` columns) of every record.

    First the records whose ``original`` is true are merged among themselves; their entities get the ``candidate`` of their first record
    and keep it, with the columns named in ``pinned`` (a screening decision), whatever is added later. Then those entities, by
    ``rank`` and candidate, and after them all other records in their order are merged again, so additions complete originals
    but never rename them. An entity without an original has its first record's candidate. An original entity that a later one turns out to be
    the same as joins it, and its pin goes.
    """
    keep = [candidate, rank, *pinned]
    used = dict.fromkeys(("pos", "keys", *STRONG, "year", "authors", original, *keep))
    records = stored(records.select([x for x in used if x in records.columns]))  # read again at every step; what they are made of isn't
    first = records.where(F.col(original))
    found = stored(identities(first))
    pins = records.select(F.col("pos").alias("entity"), *keep)
    ones = entity_fields(first, found).join(pins, "entity")
    placed = ranking.rank_within(ones.select("entity", F.col(rank).alias("__rank"), F.col(candidate).alias("__candidate")).withColumn("__all", F.lit(0)), "__all", ["__rank", "__candidate", "entity"], "place")
    placed = stored(placed.select("entity", (F.col("place") - 1).alias("again")))
    count = placed.count()
    rest = records.where(~F.coalesce(F.col(original), F.lit(False)))
    order = ranking.rank_within(rest.select("pos", F.lit(0).alias("__all")), "__all", ["pos"], "place").select("pos", (F.col("place") - 1 + count).alias("again"))
    order = stored(order)
    fields = ["keys", *STRONG, "year", "authors"]
    again = ones.join(placed, "entity").select(F.col("again").alias("pos"), *fields).unionByName(
        _completed(rest).join(order, "pos").select(F.col("again").alias("pos"), *fields)
    )
    final = stored(identities(again))
    names = pins.join(placed, "entity").select("again", *keep, F.lit(True).alias("is_pinned")).unionByName(
        rest.join(order, "pos").select("again", *keep, F.lit(False).alias("is_pinned"))
    )
    named = final.join(names.withColumnRenamed("again", "entity"), "entity").withColumnRenamed("pos", "again")
    of_first = found.select("pos", "entity", F.col("identity_conflict").alias("__early")).join(placed, "entity").select("pos", "again", "__early")
    where_ = of_first.unionByName(order.select("pos", "again", F.lit(False).alias("__early")))
    joined = where_.join(named, "again")
    early = joined.groupBy(F.col("entity").alias("__e")).agg(F.max("__early").alias("__any"))
    out = joined.join(early, F.col("entity") == F.col("__e"))
    return out.select("pos", F.col(candidate).alias("candidate_id"), F.col("is_pinned").alias("pinned"), (F.col("identity_conflict") | F.col("__any")).alias("identity_conflict"), *pinned)
