"""Registered queries that run as streams over whole tables: each drains what is available, its rows are held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.catalogue import query, table
from scholion.session import shared_folder
from scholion.sources import cursor
from scholion.streaming import keyed

ROWS_A_PAGE = 2000


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of files."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def drained(stream: DataFrame, mode: str = "update") -> DataFrame:
    """The rows of a stream over what is available now. A batch that is tried again replaces its own rows."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    started = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    names = stream.columns
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*").select(*names)


@query(
    """WITH p AS (SELECT user_id AS host, ts + to_seconds(CAST(json_extract_string(props, '$.k') AS BIGINT) * 3600) AS deadline FROM events WHERE event_type = 'error'),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_type = 'error')
SELECT host, epoch_us(max(deadline)) AS retry_at, max(deadline) <= max(mark) AS released FROM p, m GROUP BY host"""
)
def host_cooldowns(spark, d):
    keyed.keep_state(spark)
    rows = _source(spark, d, "events").where("event_type = 'error'")
    events = rows.select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("at"), (F.get_json_object("props", "$.k").cast("long") * 3600).alias("seconds"))
    changes = drained(keyed.host_cooldowns(events))
    last = changes.groupBy("host").agg(F.max(F.struct("retry_at", (F.col("state") == "released").alias("released"))).alias("last"))
    return last.select("host", F.unix_micros("last.retry_at").alias("retry_at"), "last.released")


@query("SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS kind, 'new' AS state FROM events GROUP BY user_id")
def content_states(spark, d):
    keyed.keep_state(spark)
    events = _source(spark, d, "events").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("kind"))
    return drained(keyed.content_index(events, "user_id", "version", "kind"))


@query("SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS text_md5 FROM documents")
def cursor_documents(spark, d):
    folder = _folder(spark)
    table(spark, d, "documents").select("doc_id", "lang", "text").write.option("parquet.block.row.count.limit", ROWS_A_PAGE).parquet(folder)
    cursor.register(spark)
    pages = spark.readStream.format("cursor_pages").option("service", "row_groups").option("path", folder).option("pages", 1_000_000).load()
    item = F.from_json("raw", "doc_id long, lang string, text string")
    rows = pages.select(item.alias("r")).select("r.doc_id", "r.lang", F.length("r.text").cast("long").alias("n_chars"), F.md5(F.col("r.text").cast("binary")).alias("text_md5"))
    return drained(rows, "append")
