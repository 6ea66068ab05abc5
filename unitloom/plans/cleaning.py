"""Registered queries over the cleaner: units, drops, warnings, statistics, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import pytext as P, tsv
from ..operators import cleaner, normalize
from ..registry import register
from ..schemas import METADATA
from ..session import table
from . import sql


def metadata(**known: Column) -> Column:
    """A metadata struct with the given fields and nulls elsewhere."""
    return F.struct(*[(known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA])


def units_of(df: DataFrame, source_type: str, **meta) -> DataFrame:
    """Raw units from document_id, unit_index, content and content_type."""
    have = set(df.columns)
    extra = {"page_start": "int", "page_end": "int", "section": "string"}
    return df.select(
        P.unit_id("raw", F.col("document_id"), F.col("unit_index")).alias("raw_unit_id"),
        "document_id",
        F.concat(F.lit("src-"), "document_id").alias("source_id"),
        F.lit(source_type).alias("source_type"),
        F.lit(None).cast("string").alias("source_uri"),
        F.col("unit_index").cast("int").alias("unit_index"),
        "content",
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in extra.items()],
        F.array().cast("array<string>").alias("heading_path"),
        "content_type",
        metadata(**meta).alias("extra_metadata"),
    )


def dirty_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as raw units, with dirt by document and line."""
    return dirty_rows(table(spark, sf_dir, "documents"))


def dirty_rows(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line, lit = F.col("line"), F.lit
    dirt = [
        line,
        F.concat(line, lit("\xa0\tx")),
        F.concat(lit("  "), line, lit("  \r\n\r\n\r\nend\r")),
        F.concat(lit("e\u0301 "), line),
        F.concat(lit("\x01"), line, lit("\x7f")),
        lit("\u3000 \t"),
        F.concat(lit("\ufffd"), line),
        F.replace(line, lit(" "), lit("  \t ")),
        F.concat(line, lit(" \x02 b")),
    ]
    which = (F.col("doc_id") + F.col("i")) % 9
    content = dirt[-1]
    for k in range(len(dirt) - 2, -1, -1):
        content = F.when(which == k, dirt[k]).otherwise(content)
    kind = F.element_at(F.array(*[lit(x) for x in ("paragraph", "list", "code", "unknown")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return units_of(rows.select(F.concat(lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.col("i").alias("unit_index"), content.alias("content"), kind.alias("content_type")), "docx")


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


@register(
    "raw_unit_metrics",
    f"WITH {sql.DIRTY} SELECT format('raw:{{}}:{{:06d}}', document_id, unit_index) AS raw_unit_id, length(content)::BIGINT AS character_count, {sql.word_count('content')} AS word_count, sha256(content) AS content_hash FROM raw",
)
def raw_unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("content")
    return dirty_units(spark, sf_dir).select("raw_unit_id", P.character_count(text).cast("long").alias("character_count"), P.word_count(text).cast("long").alias("word_count"), P.content_hash(text).alias("content_hash"))


@register(
    "clean_prose_units",
    f"WITH {sql.DIRTY} SELECT format('clean:{{}}:{{:06d}}', document_id, unit_index) AS clean_unit_id, clean_unit_index::BIGINT AS clean_unit_index, transformations, length(normalized)::BIGINT AS character_count, {sql.word_count('normalized')} AS word_count, sha256(normalized) AS content_hash FROM good WHERE reason IS NULL",
)
def clean_prose_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaner.clean(dirty_units(spark, sf_dir)).units
    return out.select("clean_unit_id", *_long("clean_unit_index"), F.array_join("transformations", ",").alias("transformations"), *_long("character_count", "word_count"), "content_hash")


@register("dropped_units", f"WITH {sql.DIRTY} SELECT document_id, unit_index::BIGINT AS unit_index, reason AS reason_code, sha256(content) AS content_hash FROM good WHERE reason IS NOT NULL")
def dropped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.clean(dirty_units(spark, sf_dir)).dropped.select("document_id", *_long("unit_index"), "reason_code", "content_hash")


@register(
    "cleaning_warnings",
    f"""WITH {sql.DIRTY} SELECT document_id, unit_index::BIGINT AS unit_index, clean_unit_index::BIGINT AS clean_unit_index, 'replacement_character_detected' AS warning_code, NULL::BIGINT AS removed_count FROM good WHERE replaced
    UNION ALL SELECT document_id, unit_index::BIGINT, clean_unit_index::BIGINT, 'suspicious_control_characters_removed', removed::BIGINT FROM good WHERE removed > 0""",
)
def cleaning_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.clean(dirty_units(spark, sf_dir)).warnings.select("document_id", *_long("unit_index", "clean_unit_index"), "warning_code", *_long("removed_count"))


STATS_SQL = f"""WITH {sql.DIRTY} SELECT document_id, count(*)::BIGINT AS input_units, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS output_units, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS dropped_units,
  count(*) FILTER (WHERE reason IS NULL AND content <> normalized)::BIGINT AS modified_units, count(*) FILTER (WHERE reason IS NULL AND content = normalized)::BIGINT AS unchanged_units,
  sum(length(content))::BIGINT AS characters_before, coalesce(sum(length(normalized)) FILTER (WHERE reason IS NULL), 0)::BIGINT AS characters_after,
  sum(replaced::INT + (removed > 0)::INT)::BIGINT AS warning_count FROM good GROUP BY document_id"""


@register("cleaning_stats", STATS_SQL)
def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaner.clean(dirty_units(spark, sf_dir)).stats
    return out.select("document_id", *_long("input_units", "output_units", "dropped_units", "modified_units", "unchanged_units", "characters_before", "characters_after", "warning_count"))


@register(
    "cleaning_reason_stats",
    f"""WITH {sql.DIRTY} SELECT document_id, count(*) FILTER (WHERE reason = 'empty_after_normalization')::BIGINT AS dropped_empty_after_normalization, 0::BIGINT AS dropped_pdf_page_number, sum(replaced::INT + (removed > 0)::INT)::BIGINT AS normalization_warning_count,
    0::BIGINT AS source_filter_warning_count, (coalesce(sum(length(normalized)) FILTER (WHERE reason IS NULL), 0) - sum(length(content)))::BIGINT AS character_delta FROM good GROUP BY document_id""",
)
def cleaning_reason_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops by reason and warnings by origin."""
    out = cleaner.clean(dirty_units(spark, sf_dir)).stats
    return out.select("document_id", *_long("dropped_empty_after_normalization", "dropped_pdf_page_number", "normalization_warning_count", "source_filter_warning_count"), (-F.col("character_delta")).cast("long").alias("character_delta"))


@register(
    "cleaning_errors",
    f"""WITH {sql.DIRTY}, t AS (SELECT document_id, count(*) AS n, sum(length(content)) AS c, count(*) FILTER (WHERE reason IS NULL) AS o, coalesce(sum(length(normalized)) FILTER (WHERE reason IS NULL), 0) AS d FROM judged GROUP BY document_id),
    f AS (SELECT document_id, CASE WHEN n > 20 THEN 'cleaning_limit_exceeded:max_input_units' WHEN c > 6000 THEN 'cleaning_limit_exceeded:max_input_characters' WHEN o = 0 THEN 'cleaning_no_content:empty_after_normalization'
      WHEN o > 12 THEN 'cleaning_limit_exceeded:max_output_units' WHEN d > 5000 THEN 'cleaning_limit_exceeded:max_output_characters' END AS x FROM t)
    SELECT document_id, split_part(x, ':', 1) AS error_code, split_part(x, ':', 2) AS details FROM f WHERE x IS NOT NULL""",
)
def cleaning_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fail under tight limits, each by the first one that it breaks."""
    tight = {"max_input_units": 20, "max_input_characters": 6000, "max_output_units": 12, "max_output_characters": 5000}
    return cleaner.clean(dirty_units(spark, sf_dir), tight).errors.select("document_id", "error_code", "details")


# --- tables -------------------------------------------------------------------------------------

_CELLS = """
cells AS (SELECT p_partkey AS k, [[p_name, 'e' || chr(769) || p_brand || chr(160)], [p_type || chr(1), 'a' || chr(92) || 'b' || chr(9) || p_size], [CASE WHEN p_partkey % 3 = 0 THEN chr(65533) ELSE ' ' END, 'x' || chr(13) || chr(10) || 'y']] AS cs FROM part)"""
_ESC = "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n')"
_UNESC = "replace(replace(replace(replace({0}, chr(92) || chr(92), chr(65534)), chr(92) || 't', chr(9)), chr(92) || 'n', chr(10)), chr(65534), chr(92))"


def _joined(rows: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda r: array_to_string(list_transform(r, lambda c: {_ESC.format('c')}), chr(9))), chr(10))"


TABLE_SQL = f"""WITH {_CELLS}, t AS (SELECT k, {_joined("cs")} AS content FROM cells),
p AS (SELECT k, content, list_transform(string_split(content, chr(10)), lambda r: list_transform(string_split(r, chr(9)), lambda c: {_UNESC.format("c")})) AS rs FROM t),
n AS (SELECT k, content, list_transform(rs, lambda r: list_transform(r, lambda c: {sql.controls(sql.nbsp(sql.lines("nfc_normalize(c)")), True)})) AS ns, rs FROM p)
SELECT k::BIGINT AS k, sha256(content) AS raw_hash, sha256({_joined("ns")}) AS content_hash, len(ns)::BIGINT AS row_count,
  'unicode_nfc,nbsp_normalized,control_characters_removed,table_cells_normalized' AS transformations, (1 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS warnings FROM n"""


@register("table_units", TABLE_SQL)
def table_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of dirty cells through the cell codec and the normalizer."""
    part = table(spark, sf_dir, "part")
    lit = F.lit
    rows = F.array(
        F.array(F.col("p_name"), F.concat(lit("e\u0301"), F.col("p_brand"), lit("\xa0"))),
        F.array(F.concat(F.col("p_type"), lit("\x01")), F.concat(lit("a\\b\t"), F.col("p_size").cast("string"))),
        F.array(F.when(F.col("p_partkey") % 3 == 0, lit("\ufffd")).otherwise(lit(" ")), lit("x\r\ny")),
    )
    df = part.select(F.col("p_partkey").cast("string").alias("document_id"), lit(0).alias("unit_index"), tsv.serialize(rows).alias("content"), lit("table").alias("content_type"), F.col("p_partkey"))
    units = units_of(df, "docx", serialization_format=lit(tsv.FORMAT))
    out = normalize.normalize(units)
    return out.select(F.col("document_id").cast("long").alias("k"), F.sha2("content", 256).alias("raw_hash"), F.sha2("normalized", 256).alias("content_hash"), F.size(F.split("normalized", "\n")).cast("long").alias("row_count"), F.array_join("transformations", ",").alias("transformations"), F.size("normalization_warnings").cast("long").alias("warnings"))


@register(
    "table_codec_round_trip",
    f"WITH {_CELLS}, t AS (SELECT k, {_joined('cs')} AS content FROM cells) SELECT k::BIGINT AS k, 3::BIGINT AS n_rows, 2::BIGINT AS n_columns, sha256(array_to_string(list_transform(string_split(content, chr(10)), lambda r: array_to_string(list_transform(string_split(r, chr(9)), lambda c: {_UNESC.format('c')}), '|')), '#')) AS cells_hash FROM t",
)
def table_codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells through serialization and back."""
    part = table(spark, sf_dir, "part")
    lit = F.lit
    rows = F.array(
        F.array(F.col("p_name"), F.concat(lit("e\u0301"), F.col("p_brand"), lit("\xa0"))),
        F.array(F.concat(F.col("p_type"), lit("\x01")), F.concat(lit("a\\b\t"), F.col("p_size").cast("string"))),
        F.array(F.when(F.col("p_partkey") % 3 == 0, lit("\ufffd")).otherwise(lit(" ")), lit("x\r\ny")),
    )
    back = part.select(F.col("p_partkey").cast("long").alias("k"), tsv.parse(tsv.serialize(rows)).alias("r"))
    return back.select("k", F.size("r").cast("long").alias("n_rows"), F.array_max(tsv.column_counts(F.col("r"))).cast("long").alias("n_columns"), F.sha2(F.array_join(F.transform("r", lambda row: F.array_join(row, "|")), "#"), 256).alias("cells_hash"))
