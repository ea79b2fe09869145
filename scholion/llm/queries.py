"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.llm import common as c
from scholion.llm import compression as _compression
from scholion.llm import fingerprint as _fingerprint
from scholion.llm import jaccard as _jaccard
from scholion.llm import language as _language
from scholion.llm import mixing as _mixing
from scholion.llm import neighbours as _neighbours
from scholion.llm import pages as _pages
from scholion.llm import pieces as _pieces
from scholion.llm import quarantine as _quarantine
from scholion.llm import resampling as _resampling
from scholion.llm import suffix as _suffix
from scholion.llm import token_files as _token_files
from scholion.llm import toxicity as _toxicity


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours.near_duplicates(c.table(spark, sf_dir, "embeddings"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprint.edited_pairs(c.table(spark, sf_dir, "documents"))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampling.resample(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces.encode(c.table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_groups(c.table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.repeats(c.table(spark, sf_dir, "documents"), words=50)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(c.table(spark, sf_dir, "documents"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages.extract(c.table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.replicate(c.table(spark, sf_dir, "documents")).drop("shuffle_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _toxicity.toxicity(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))
    return scored.withColumn("n_spans", F.size("spans"))


def op11_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarantine.replay(c.table(spark, sf_dir, "conversations"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compression.compress(c.table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_files.round_trip(c.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_fingerprint": op2_fingerprint,
    "op3_resampling": op3_resampling,
    "op4_pieces": op4_pieces,
    "op5_jaccard": op5_jaccard,
    "op6_suffix": op6_suffix,
    "op7_language": op7_language,
    "op8_pages": op8_pages,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_quarantine": op11_quarantine,
    "op12_compression": op12_compression,
    "op13_token_files": op13_token_files,
}

_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, w) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a),
comp AS (SELECT v, min(w) AS component FROM reach GROUP BY v)"""

ORACLE_SQL: dict[str, str] = {
    "op1_neighbours": f"""WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x, vectors y WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN n ON a = vec_id LEFT JOIN comp ON v = vec_id""",
    "op5_jaccard": rf"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'),
    lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM sets LEFT JOIN comp ON v = doc_id""",
    "op9_mixing": _mixing.ORACLE,
    "op11_quarantine": _quarantine.ORACLE,
    "op12_compression": _compression.ORACLE,
}
