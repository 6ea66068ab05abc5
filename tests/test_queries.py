import duckdb
import pytest
from oracle import rows, same

from unitloom import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_titles_decode_what_the_sql_decodes(spark, tmp_path):
    """Titles that were cut off within a reference, and references that the SQL doesn't know."""
    titles = ["a&amp;&amp", "b &am", "c &quot", "d &amp;lt; &lt;i&gt; &#39;&quot;", "e &eacute;&AMP;", "f <b>x</b>", "&nbsp;", " ", "&", "g\r\n\xa0 h"]
    pages = [(k, f"http://x.example/{k}", f"<html><title lang=en>{t}</title><body><p>p &amp</p></body></html>") for k, t in enumerate(titles)]
    pages += [(90, "u", "<title>open<p>p</p>"), (91, "u", "<p>none</p>"), (92, "u", "<title/><p>p</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got, want = registry.QUERIES["page_titles"](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES["page_titles"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) == 9 and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and "document_id" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
