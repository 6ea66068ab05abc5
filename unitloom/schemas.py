"""Tables of the engine: enumerations, explicit schemas and default limits."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType, "timestamp": T.TimestampType}


def struct(columns: str) -> T.StructType:
    """Nullable columns from "name type, ..."; needs no session, so workers can import this."""

    def kind(name: str) -> T.DataType:
        if name.startswith("array<"):
            return T.ArrayType(kind(name[6:-1]))
        if name == "map<string string>":
            return T.MapType(T.StringType(), T.StringType())
        return _SIMPLE[name]()

    pairs = (c.strip().split(" ", 1) for c in columns.split(","))
    return T.StructType([T.StructField(name, kind(of)) for name, of in pairs])


# Members of the enumerations.
SOURCE_TYPES = ["pdf", "docx", "url"]
SOURCE_STATUSES = ["pending", "processing", "completed", "failed"]
STAGES = ["queued", "downloading", "parsing", "extracting", "cleaning", "chunking", "embedding", "indexing", "completed", "failed"]
CONTENT_TYPES = ["page", "section", "paragraph", "table", "list", "code", "unknown"]
RETRIEVAL_METHODS = ["vector", "keyword", "metadata", "rerank"]
DROP_REASONS = ["empty_after_normalization", "html_reading_time", "html_ui_noise", "pdf_page_number"]

# Default resource bounds.
HTML_LIMITS = {"max_input_bytes": 5 * 1024 * 1024, "max_candidate_blocks": 50_000, "max_units": 10_000, "max_total_extracted_characters": 5_000_000}
FETCH_LIMITS = {"max_redirects": 5, "max_body_bytes": 5 * 1024 * 1024}
CLEANING_LIMITS = {"max_input_units": 50_000, "max_input_characters": 20_000_000, "max_output_units": 50_000, "max_output_characters": 20_000_000}
QUESTION_LIMITS = {"max_question_characters": 3_000, "min_top_k": 1, "max_top_k": 20, "default_top_k": 5}

SOURCES = struct("source_id string, document_id string, source_type string, source_uri string, original_filename string, media_type string, charset string, content_bytes binary")

#: Typed form of a unit's open metadata: a missing key and a null mean the same.
METADATA = struct(
    "parser string, parser_version string, block_type string, block_index int, html_tag string, nearest_semantic_container string,"
    "heading_level int, heading_index int, paragraph_index int, code_block_index int,"
    "list_container_global_index int, list_item_global_index int, list_item_index_in_container int, list_depth int, list_type string, parent_emitted_list_item_global_index int,"
    "table_index int, row_count int, column_count int, row_column_counts array<int>, serialization_format string,"
    "style_name string, page_index int, page_number int, page_block_index int, document_block_index int, bbox array<double>, block_number int, raw_block_type int,"
    "page_width double, page_height double"
)

RAW_UNITS = (
    struct("raw_unit_id string, document_id string, source_id string, source_type string, source_uri string, unit_index int, content string, page_start int, page_end int, section string, heading_path array<string>, content_type string")
    .add("extra_metadata", METADATA)
    .add("character_count", T.IntegerType())
    .add("word_count", T.IntegerType())
    .add("content_hash", T.StringType())
    .add("extracted_at", T.TimestampType())
)

WARNINGS = struct("document_id string, stage string, warning_code string, item_index int, message string, details string")
ERRORS = struct("document_id string, source_id string, error_code string, message string, failed_stage string, retryable boolean, details string")

#: What a parser yields for each block it sees, before indexes and paths are worked out.  A row
#: without a block_type speaks of its document (failure, facts) or is a warning.
BLOCKS = struct(
    "document_id string, source_id string, source_type string, source_uri string, block_index int, block_type string, content_type string, content string, blank boolean, path array<string>,"
    "heading_level int, page_start int, page_end int, item_index int, warning_code string, warning_detail string, cells array<array<string>>, failure string, facts map<string string>"
).add("extra_metadata", METADATA)
