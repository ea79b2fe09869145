"""Every registered query against its SQL; those without one give rows."""

import os

import pytest

import oracle
from scholion import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = oracle.rows_of(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert ours == theirs


def test_queries_without_sql_are_few():
    """Order-dependent merging, matching ratios, and what a tolerant parser finds in raw pages have tests of their own."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"merge_fold_exact", "fuzzy_title", "html_elements", "element_cells", "library_fuzzy"}


def test_elements_of_raw_pages(spark, tmp_path):
    page = '<nav>menu</nav><article><h2>Head</h2><p>Text<table><tr><th>a<td>b</table></article>'
    spark.createDataFrame([(5, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.kind, r.content_role): (r.n, r.chars) for r in catalogue.QUERIES["html_elements"](spark, str(tmp_path)).collect()}
    assert found == {("heading", "body"): (1, 4), ("paragraph", "body"): (1, 4), ("table", "body"): (1, 3)}
    assert sorted((r.row, r.column, r.text, r.header) for r in catalogue.QUERIES["element_cells"](spark, str(tmp_path)).collect()) == [(0, 0, "a", True), (0, 1, "b", False)]


def test_long_documents_are_in_the_whole_queries(spark, tmp_path):
    title, body = "one long title of twenty letters", " ".join(f"w{k}" for k in range(900))
    rows = [(1, f"{title}\n{body}", "en", "a", 4000), (2, f"{title}\n{body} more", "en", "a", None), (3, "short", "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in catalogue.QUERIES["inverted_abstract"](spark, str(tmp_path)).collect()) == [1, 2, 3]
    (pair,) = catalogue.QUERIES["shingle_pairs"](spark, str(tmp_path)).collect()
    assert (pair.head, pair.doc_id) == (1, 2) and 0.99 < pair.dice < 1


def test_a_quotation_is_held_only_as_a_whole(spark, tmp_path):
    quote = "A passage whose first forty letters are as they were, and then more"
    docs = [(1, f"x {quote.upper()} y"), (2, quote[:50] + " another end"), (3, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["receipt_coverage"](spark, str(tmp_path)).collect()] == [(7, 1, 1)]


def test_expansion_runs_on_all_edges(spark, tmp_path):
    spark.createDataFrame([(9, 8), (9, 8)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, catalogue.QUERIES["citation_one_hop"](spark, str(tmp_path)).collect())) == [(8, "cited_by", 9), (9, "references", 8)]


def test_articles_of_odd_texts_equal_their_sql(spark, tmp_path):
    texts = ["", None, " \n\t", "one", "one", None, "a\fb\n\x01\n\x0b", "\xa0a\xa0b \u3000\n\x85\n\u2028", "<b>&amp;</b>\r\n&#65;\n\x1cc"]
    rows = spark.createDataFrame([(k // 2 or None, x) for k, x in enumerate(texts)], "doc_id long, text string")  # ids are missing or occur twice
    rows.coalesce(1).write.parquet(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    for name in ("structure_counts", "html_articles"):
        ours, theirs = oracle.rows_of(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path))
        assert ours == theirs
