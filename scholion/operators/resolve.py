"""Entity resolution, ranking and selection over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scholion.functions import normalize as n

RRF_K = 60
#: Priority of the metadata sources, 99 for others.
SOURCE_PRIORITY = {"pubmed": 0, "europe_pmc": 1, "crossref": 2, "openalex": 3, "semantic_scholar": 4, "arxiv": 5}


def source_priority(source) -> Column:
    chain = F
    for name, place in SOURCE_PRIORITY.items():
        chain = chain.when(F.col(source) == name, place)
    return chain.otherwise(99)


def reciprocal_rank_fusion(hits: DataFrame, candidate: str = "candidate_id", route: str = "route_id", rank: str = "rank", semantics: str | None = None) -> DataFrame:
    """(candidate, score, routes): the best rank of each route counts 1 / (60 + rank); hits whose rank means nothing count as first."""
    place = F.col(rank) if semantics is None else F.when(F.coalesce(F.col(semantics), F.lit("relevance")) == "relevance", F.col(rank)).otherwise(1)
    best = hits.groupBy(candidate, route).agg(F.min(place).alias("best"))
    return best.groupBy(candidate).agg(F.sum(1.0 / (RRF_K + F.col("best"))).alias("score"), F.count(F.lit(1)).alias("routes"))


def legacy_score(base, citations, n_sources) -> Column:
    return F.bround(base + F.log10(F.coalesce(citations, F.lit(0)) + 1) / 20 + F.least(n_sources, F.lit(5)) * 0.01, 5)


def select_queue(scored: DataFrame, k: int, score: str = "score", candidate: str = "candidate_id") -> DataFrame:
    """The k best, in a total order; scores that differ by rounding only are equal."""
    return scored.orderBy(F.round(F.col(score), 9).desc(), candidate).limit(k)


def selection_statistics(raw: DataFrame, pool: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    a, b, e = raw.agg(F.count(F.lit(1)).alias("raw")), pool.agg(F.count(F.lit(1)).alias("deduplicated")), eligible.agg(F.count(F.lit(1)).alias("eligible"))
    return a.join(b).join(e).select(
        "raw", "deduplicated", "eligible", F.least("eligible", F.lit(k)).alias("selected"), (F.col("deduplicated") - F.col("eligible")).alias("excluded"),
        F.greatest(F.col("eligible") - k, F.lit(0)).alias("outside_cap"),
    )


def required_terms(rows: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """Rows whose joined text holds one of the terms; no term keeps all."""
    terms = [t.lower().strip() for t in terms if t.strip()]
    if not terms:
        return rows
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in columns]))
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return rows.where(found)


def first_per_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Marks later holders of a digest: (…, first, is_duplicate). A partial minimum, not a window per digest."""
    first = rows.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__digest")).agg(F.min(order).alias("first"))
    joined = rows.join(first, F.col(digest) == F.col("__digest"), "left").drop("__digest")
    return joined.withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("first"), F.lit(False)))


def merge_fields(rows: DataFrame, key: str, pos: str, longest: str, source: str) -> DataFrame:
    """Field merge of conflict-free groups: the longest text (earliest of equals), the union of sources, the first position."""
    return rows.groupBy(key).agg(
        F.min(pos).alias("first"),
        F.max_by(longest, F.struct(F.length(longest), -F.col(pos))).alias("longest"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.count(F.lit(1)).alias("members"),
    )


def candidate_key(title_column: str, fallback: Column) -> Column:
    """The title key from 20 characters on, else a key of its own."""
    name = n.title(title_column)
    return F.when(F.length(name) >= 20, F.concat(F.lit("title:"), name)).otherwise(fallback)


def union_candidates(rows: DataFrame, record: str, place: str, fields: list[str]) -> DataFrame:
    """One row a record and request (address, kind, referer), its fields filled by the first that has them."""
    from scholion.functions.records import request_key

    keyed = rows.withColumn("__request", request_key("url", "kind", "referer")).where("__request.url <> ''")
    filled = [F.coalesce(F.min(F.when(F.coalesce(F.col(x), F.lit("")) != "", F.struct(place, x)))[x], F.lit("")).alias(x) for x in fields]
    return keyed.groupBy(record, "__request").agg(F.min(place).alias("first"), *filled).select(record, "__request.*", "first", *fields)


#: What a filter by type may ask for.
ARTICLE_TYPES = ("research", "review", "case_report", "letter", "editorial", "preprint", "unknown")


def types_first(rows: DataFrame, type_column: str, wanted: list[str], order: str, k: int) -> DataFrame:
    """The first k rows of a wanted or unknown type, wanted ones before unknown ones, each in its order."""
    if not set(wanted) <= set(ARTICLE_TYPES):
        raise ValueError(f"unsupported types: {sorted(set(wanted) - set(ARTICLE_TYPES))}")
    kept = rows.where(F.col(type_column).isin(*wanted, "unknown"))
    unknown = (F.col(type_column) == "unknown") & F.lit("unknown" not in wanted)
    top = kept.withColumn("__later", unknown).orderBy("__later", order).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy("__later", order)).cast("long")).drop("__later")  # k rows


def library_plan(records: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """(key, action, reason, item) of each record against a library: the same DOI exists; the same title exists, unless both
    have DOIs that differ, which needs a look; everything else is created (a fuzzy title is looked for among those)."""
    dois = items.where("doi <> ''").groupBy(F.col("doi").alias("__doi")).agg(F.min(item).alias("__by_doi"))
    titles = items.withColumn("__t", n.title("title")).where("__t <> ''").groupBy("__t").agg(
        F.min(item).alias("__by_title"), F.min_by("doi", item).alias("__its_doi")
    )
    rows = records.withColumn("__nt", n.title("title")).join(dois, F.col("doi") == F.col("__doi"), "left").join(titles, F.col("__nt") == F.col("__t"), "left")
    conflict = (F.col("doi") != "") & (F.coalesce("__its_doi", F.lit("")) != "") & (F.col("doi") != F.col("__its_doi"))
    action = F.when(F.col("__by_doi").isNotNull(), "exists").when(F.col("__by_title").isNotNull() & conflict, "review").when(F.col("__by_title").isNotNull(), "exists").otherwise("create")
    reason = F.when(F.col("__by_doi").isNotNull(), "doi").when(F.col("__by_title").isNotNull() & conflict, "title_doi_conflict").when(F.col("__by_title").isNotNull(), "title").otherwise("no_match")
    return rows.select(key, action.alias("action"), reason.alias("reason"), F.coalesce("__by_doi", "__by_title").alias("item"))


def find_collections(wanted: DataFrame, collections: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """(wanted, key, matches): ``key:K`` names a collection exactly, other text by its name whatever the case, if only one has it."""
    exact = F.when(F.col("wanted").startswith("key:"), F.substring("wanted", 5, 1000))
    rows = wanted.select("wanted", exact.alias("__exact"), F.lower(F.trim("wanted")).alias("__folded"))
    held = collections.select(F.col(key).alias("__key"), F.lower(F.trim(name)).alias("__name"))
    by_key = rows.where("__exact is not null").join(held, F.col("__exact") == F.col("__key"), "left")
    by_name = rows.where("__exact is null").join(held, F.col("__folded") == F.col("__name"), "left")
    found = by_key.unionByName(by_name).groupBy("wanted").agg(F.count("__key").alias("matches"), F.min("__key").alias("key"))
    return found.select("wanted", F.when(F.col("matches") == 1, F.col("key")).alias("key"), "matches")


def union_population(records: DataFrame, attempts: DataFrame, key: str, node: str, strong: tuple[str, ...] = ("doi", "pmid", "pmcid")) -> DataFrame:
    """(node, key, origin, legacy_attempts, identity_conflict): records with the earlier attempts of the same key that don't
    contradict them; attempts that do, or that have no record, stay as rows of their own."""
    differ = F.lit(False)
    for x in strong:
        differ = differ | ((F.coalesce(f"r_{x}", F.lit("")) != "") & (F.coalesce(f"a_{x}", F.lit("")) != "") & (F.col(f"r_{x}") != F.col(f"a_{x}")))
    mine = records.select(F.col(key).alias("__k"), F.col(node).alias("__node"), *[F.col(x).alias(f"r_{x}") for x in strong])
    theirs = attempts.select(F.col(key), F.col(node).alias("__attempt"), *[F.col(x).alias(f"a_{x}") for x in strong])
    pairs = theirs.join(mine, F.col(key) == F.col("__k"), "left").withColumn("__fits", F.col("__node").isNotNull() & ~differ)
    by_attempt = pairs.groupBy("__attempt", key).agg(F.min(F.when(F.col("__fits"), F.col("__node"))).alias("__into"), F.count("__node").alias("__near"))
    counts = by_attempt.where("__into is not null").groupBy(F.col("__into").alias("__n")).agg(F.count(F.lit(1)).alias("legacy_attempts"))
    clash = by_attempt.where("__into is null and __near > 0").select(F.col(key).alias("__clash")).distinct()
    kept = records.select(F.col(node), key).join(counts, F.col(node) == F.col("__n"), "left").join(clash, F.col(key) == F.col("__clash"), "left")
    kept = kept.select(node, key, F.lit("record").alias("origin"), F.coalesce("legacy_attempts", F.lit(0)).alias("legacy_attempts"), F.col("__clash").isNotNull().alias("identity_conflict"))
    own = by_attempt.where("__into is null").select(F.col("__attempt").alias(node), key, F.lit("attempt").alias("origin"), F.lit(0).cast("long").alias("legacy_attempts"), (F.col("__near") > 0).alias("identity_conflict"))
    return kept.unionByName(own)
