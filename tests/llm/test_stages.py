"""What the pipeline's stages share: rows told apart in place, rows left out without shuffling the rest."""

import collections

import corpus_pipeline
import pytest
from test_corpus import SCHEMA, awkward

from geostat_spark.llm import queries
from geostat_spark.llm.exact_dedup import without
from geostat_spark.llm.text import in_place
from geostat_spark.session import cut, cut_and_release, tables_so_far


def test_rows_are_told_apart_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/d.parquet"
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(path)
    table = in_place(spark.read.parquet(path), "told")
    first = {r["told"]: r["text"] for r in table.collect()}
    assert len(first) == len(awkward())
    again = in_place(spark.read.parquet(path).where("text is not null"), "told").select("told", "text").repartition(5).collect()
    assert again and all(first[r["told"]] == r["text"] for r in again)
    numbered = in_place(spark.createDataFrame(awkward(), SCHEMA).distinct(), "told")
    assert numbered.select("told").distinct().count() == numbered.count()


@pytest.mark.parametrize("gone", [[], [3], list(range(0, 500, 2)), list(range(500))])
def test_without(spark, gone):
    rows = spark.range(500).selectExpr("id", "id % 7 as n")
    left = without(rows, spark.createDataFrame([(g,) for g in gone], "id long"), "id")
    assert sorted(r["id"] for r in left.collect()) == sorted(set(range(500)) - set(gone)) and left.columns == ["id", "n"]


def test_warc_of_null_page_ids(spark, tmp_path):
    """Pages without an id are responses of their own; of other equal payloads the smallest id is the response."""
    rows = [(None, None, "<p>a</p>"), (None, None, "<p>b</p>"), (1, None, "<p>b</p>"), (2, None, None), (7, None, "<p>b</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = queries.op4_warc(spark, f"file://{tmp_path}").collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(r[0] for r in rows)
    of = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert of[1]["record_type"] == "response" and of[7]["record_type"] == "revisit" and of[7]["refers_to"] == 1
    assert sum(r["record_type"] == "response" for r in got) == 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_tables_on_the_way_are_deleted(spark):
    begun = tables_so_far()
    one = cut(spark.range(5))
    two = cut_and_release(one.selectExpr("id + 1 as id"), begun)
    assert two.count() == 5 and tables_so_far() == begun + 1
    with pytest.raises(Exception):
        one.count()
