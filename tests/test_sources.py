"""Replayed provider pages, sinks and the stream of deadlines."""

import json

from pyspark.sql import functions as F

from scholion.sources import replay
from scholion.streaming import deadlines

PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>10001</PMID><Article><ArticleTitle>One <i>t</i></ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText>
<AbstractText>y</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate>
<MedlineDate>2022 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1000/A</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>10002</PMID><ArticleTitle>Chapter</ArticleTitle><Book><BookTitle>B</BookTitle></Book></BookDocument></PubmedBookArticle></PubmedArticleSet>"""
OPENALEX = json.dumps({"results": [{"id": "https://openalex.org/W1", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "locations": [{"is_oa": True, "pdf_url": "http://p"}, {"is_oa": False, "pdf_url": "http://q"}]}]})
ARXIV = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>T</title><published>2021-01-01</published></entry><entry><id>http://arxiv.org/api/errors#x</id>
<title>Error</title><summary>bad</summary></entry></feed>"""


def test_records(spark, tmp_path):
    rows = [("p", "pubmed", 0, PUBMED), ("o", "openalex", 0, OPENALEX), ("a", "arxiv", 0, ARXIV), ("x", "crossref", 0, "{broken")]
    path = tmp_path / "pages.jsonl"
    path.write_text("".join(json.dumps(dict(zip(("route_id", "source", "page", "raw"), r))) + "\n" for r in rows))
    replay.register(spark)
    pages = spark.read.format("saved_pages").option("path", str(path)).option("slices", "3").load()
    assert pages.count() == 4
    found = {(r.route_id, r.place): r for r in replay.records(pages).collect()}
    assert found["p", 0].doi == "10.1000/a" and found["p", 0].abstract == "AIM: x\ny" and found["p", 0].year == 2022 and found["p", 1].item_type == "bookSection"
    assert found["o", 0].abstract == "a b a" and found["o", 0].pdf_urls == ["http://p"] and found["a", 0].arxiv_id == "2101.00001v1"
    status = {r.route_id: r.status for r in replay.scan_status(replay.records(pages)).collect()}
    assert status == {"p": "ok", "o": "ok", "a": "partial", "x": "error"}  # nothing but errors is no partial result
    text = replay.bibtex(replay.records(pages).where("route_id = 'p'")).collect()[0].value
    assert "title = {One t}" in text and "annlee2022" in text
    assert replay.csv_report(replay.records(pages), ["title", "authors"]).count() == 6


def test_a_malformed_item_costs_itself_only():
    body = json.dumps({"results": [{"id": "W1", "title": "a"}, {"id": "W2", "authorships": [{}]}, {"id": "W3", "title": "c"}, {"title": "no id"}, 7]})
    found = replay.parse_page("openalex", body)
    assert [r["openalex_id"] for r in found if not r["error"]] == ["W1", "W3"] and [r["error"] for r in found if r["error"]] == ["row: KeyError", "row: KeyError", "row: AttributeError"]


def test_json_pages():
    pages = {"*": ([1, 2], "b", None), "b": ([3, 4], "c", None), "c": ([5], "d", None)}
    assert replay.json_pages(lambda t, n: pages[t], 9, 2)[0] == [1, 2, 3, 4, 5]
    items, status = replay.json_pages(lambda t, n: ([1, 2], "*", None), 9, 2)
    assert items == [1, 2] and status["status"] == "partial"
    items, status = replay.json_pages(lambda at, n: (list(range(at, min(at + n, 5))), None, 5), 4, 2, token=None)
    assert items == [0, 1, 2, 3] and status["continuation"] == 4
    assert replay.json_pages(lambda t, n: {}["x"], 5)[1]["status"] == "error"
    assert replay.route_options("openalex", {"openalex_api_key": "k", "s2_api_key": "x", "contact_email": ""}) == {"openalex_api_key": "k"}


def test_ranges():
    ranges = replay.split_ranges(1, 100, 30, lambda a, b: b - a + 1)
    assert ranges[0][0] == 1 and ranges[-1][1] == 100 and all(b - a < 30 for a, b in ranges) and all(x[1] + 1 == y[0] for x, y in zip(ranges, ranges[1:]))


def test_deadline_stream(spark, tmp_path):
    rows = [("h", "2024-01-01 00:00:00", 10), ("h", "2024-01-01 00:00:05", 60), ("g", "2024-01-01 00:00:05", 1)]
    static = spark.createDataFrame(rows, "host string, at string, seconds long").withColumn("at", F.to_timestamp("at"))
    static.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(static.schema).parquet(f"{tmp_path}/in")
    query = deadlines.host_deadlines(stream).writeStream.format("memory").queryName("deadlines").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    found = {r.host: str(r.retry_at) for r in spark.table("deadlines").collect()}
    assert found == {"h": "2024-01-01 00:01:05", "g": "2024-01-01 00:00:06"}
