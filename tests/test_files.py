import duckdb
from oracle import rows
from pyspark.sql import functions as F

from unitloom import plans, registry, streaming  # noqa: F401
from unitloom.functions import urls
from unitloom.plans.extraction import docx_bytes
from unitloom.schemas import SOURCES
from unitloom.sources import catalogue, files, service


def test_files_to_tables_and_back(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a page.HTML").write_bytes(b"<title>T</title><p>x</p>")
    (tmp_path / "in" / "deep" / "b.docx").write_bytes(docx_bytes(["Top", "y"]))
    (tmp_path / "in" / "c.xyz").write_bytes(b"?")
    src = files.read_files(spark, str(tmp_path / "in"))
    assert src.schema.names == SOURCES.fieldNames()
    out = service.extract(src)
    assert sorted(r.content for r in out.units.collect()) == ["T", "Top", "x", "y"]
    assert [r.error_code for r in out.errors.collect()] == ["extractor_not_registered"]
    names = {r.original_filename: r.source_type for r in src.collect()}
    assert names == {"a page.HTML": "url", "b.docx": "docx", "c.xyz": None}
    files.write_tables({"units": out.units, "sources": src}, str(tmp_path / "out"), "json")
    back = spark.read.json(str(tmp_path / "out" / "sources"))
    assert back.count() == 3 and "content_bytes" not in back.columns
    table = catalogue.catalogue(src.where("source_type is not null"), out)
    assert {r.source_type: (r.status, r.metadata.paragraph_count) for r in table.collect()} == {"url": ("completed", None), "docx": ("completed", 2)}
    assert catalogue.broken(table).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        rows = [(f"s{k}", f"d{k}", "url", None, None, None, None, f"<p> a\xa0{k} </p><p>\x01</p>".encode())]
        spark.createDataFrame(rows, SOURCES).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SOURCES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = streaming.start(stream, streaming.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    query.awaitTermination()
    units = spark.read.parquet(str(tmp_path / "out" / "clean_units"))
    assert sorted((r.document_id, r.content) for r in units.collect()) == [(f"d{k}", f"a {k}") for k in range(3)]
    assert spark.read.parquet(str(tmp_path / "out" / "cleaning_stats")).agg(F.sum("input_units")).first()[0] == 6


def test_file_names(spark):
    df = spark.createDataFrame([("http://x.example/a/b%20c.html?q",), ("http://x.example/",), ("nonsense",)], "u string")
    assert [r[0] for r in df.select(urls.file_name(F.col("u"))).collect()] == ["b c.html", None, "nonsense"]


def test_streamed_statistics_of_a_folder_of_files(spark, tmp_path):
    """A table may be a folder of part files; tables of similar names are none of its files."""
    docs = spark.createDataFrame([(k, None if k == 5 else f"a{k} b\nc\x01\n\n d") for k in range(20)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id + 100 AS doc_id", "text").toPandas().to_parquet(f"{tmp_path}/documents_old.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES["streamed_cleaning_stats"](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES["streamed_cleaning_stats"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) == 19 and rows(got) == rows(want)


def test_streamed_statistics_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["streamed_cleaning_stats"](spark, str(tmp_path)).count() == 0
