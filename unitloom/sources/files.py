"""Files as sources, and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import SOURCES

# File endings and media types by source type.
ENDINGS = {"pdf": "pdf", "docx": "docx", "html": "url", "htm": "url", "xhtml": "url"}
MEDIA = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "url": "text/html"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All files below a path, in the form of sources; types by ending, ids by path.

    Contents are read by the tasks that use them; a filter on source_type or document_id needs no
    content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    kind = _lookup(ENDINGS, F.lower(F.substring_index(name, ".", -1)))
    id_ = F.substring(F.sha2("path", 256), 1, 32)
    values = {
        "source_id": F.concat(F.lit("src-"), id_),
        "document_id": F.concat(F.lit("doc-"), id_),
        "source_type": kind,
        "source_uri": F.col("path"),
        "original_filename": F.try_url_decode(name),
        "media_type": _lookup(MEDIA, kind),
        "charset": F.lit(None),
        "content_bytes": F.col("content"),
    }
    return files.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SOURCES])


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table to a folder of its own, as parquet or JSON lines; bytes of sources never go out."""
    for name, table in tables.items():
        table.drop("content_bytes").write.mode("overwrite").format(form).save(f"{folder}/{name}")
