import pytest
from pyspark.sql import functions as F

from unitloom.operators import cleaner, validate
from unitloom.operators.normalize import normalize
from unitloom.plans.cleaning import units_of

TSV = "tsv_escaped_v1"


def units(spark, rows, source_type="docx"):
    """rows: (document, index, content, content_type, metadata)."""
    names = ["serialization_format", "block_type", "page_number", "bbox", "page_width", "page_height"]
    data = [(d, i, c, k, m.get("page_start"), *[m.get(n) for n in names]) for d, i, c, k, m in rows]
    df = spark.createDataFrame(data, "document_id string, unit_index int, content string, content_type string, page_start int, serialization_format string, block_type string, page_number int, bbox array<double>, page_width double, page_height double")
    return units_of(df.withColumn("page_end", F.col("page_start")), source_type, **{n: F.col(n) for n in names})


CASES = [
    ("\t red \xa0 \xa0kite ", "paragraph", {}, "red kite", ["nbsp_normalized", "prose_whitespace_normalized"], []),
    ("12\x0134\x02\x7f56", "paragraph", {}, "123456", ["control_characters_removed"], [("suspicious_control_characters_removed", 3)]),
    ("1.\xa0\xa0item\t", "list", {}, "1. item", ["nbsp_normalized", "list_whitespace_normalized"], []),
    ("u\u0308ber\xa0all\t7", "table", {"serialization_format": TSV}, "über all\t7", ["unicode_nfc", "nbsp_normalized", "table_cells_normalized"], []),
    ("\xa0free\r\n\tform ", "table", {}, "\xa0free\r\n\tform ", [], []),
    ("if x:\r\tgo(\xa0)", "code", {}, "if x:\n\tgo(\xa0)", ["line_endings_normalized"], []),
    ("left \x05 right", "paragraph", {}, "left  right", ["control_characters_removed"], [("suspicious_control_characters_removed", 1)]),
    ("is\ufffdland", "unknown", {}, "is\ufffdland", [], [("replacement_character_detected", None)]),
    ("c:\\dir\tend\\", "table", {"serialization_format": TSV}, "c:\\\\dir\tend\\\\", [], []),
    ("9\t\ufffd", "table", {"serialization_format": TSV}, "9\t\ufffd", [], [("replacement_character_detected", None)] * 2),
    ("plain words", "paragraph", {}, "plain words", [], []),
]


def test_normalization_cases(spark):
    rows = [("d", i, c, k, m) for i, (c, k, m, *_) in enumerate(CASES)]
    got = normalize(units(spark, rows)).orderBy("unit_index").collect()
    for row, (_, _, _, text, codes, warnings) in zip(got, CASES, strict=True):
        assert row.normalized == text
        assert row.transformations == codes
        assert [(w.code, w.removed_count) for w in row.normalization_warnings] == warnings


def test_blank_middle_unit_keeps_raw_index(spark):
    done = cleaner.clean(units(spark, [("d", 0, "one way", "paragraph", {}), ("d", 1, "\x06", "paragraph", {}), ("d", 2, "or another", "paragraph", {})]))
    assert [tuple(r) for r in done.units.orderBy("unit_index").select("clean_unit_id", "clean_unit_index").collect()] == [("clean:d:000000", 0), ("clean:d:000002", 1)]
    assert done.dropped.select("unit_index", "reason_code").first()[1] == "empty_after_normalization"
    stats = done.stats.first()
    assert (stats.input_units, stats.output_units, stats.dropped_units, stats.modified_units, stats.unchanged_units) == (3, 2, 1, 0, 2)
    warning = done.warnings.first()
    assert warning.clean_unit_index is None and warning.removed_count == 1


PAGE = {"page_width": 500.0, "page_height": 1000.0}
LOW = [240.0, 930.0, 255.0, 945.0]
PDF = [
    ({"bbox": LOW, **PAGE}, "drop"),
    ({"bbox": [240.0, 41.0, 255.0, 56.0], **PAGE}, "valid_header_band"),
    ({"bbox": [240.0, 500.0, 255.0, 515.0], **PAGE}, None),
    ({"bbox": LOW}, "missing_page_dimensions"),
    ({"bbox": LOW, "page_width": 500.0, "page_height": 0.0}, "invalid_page_dimensions"),
    ({"bbox": [255.0, 930.0, 240.0, 945.0], **PAGE}, None),
    ({}, None),
]


def test_pdf_page_numbers(spark):
    rows = [("d", i, "17", "paragraph", m | {"page_start": 17, "page_number": 17}) for i, (m, _) in enumerate(PDF)]
    rows.append(("d", 99, "18", "paragraph", PDF[0][0] | {"page_start": 17, "page_number": 17}))
    done = cleaner.clean(units(spark, rows, "pdf"))
    assert [r.unit_index for r in done.dropped.collect()] == [0]
    warned = {r.unit_index: r.details for r in done.warnings.collect()}
    assert warned == {i: d for i, (_, d) in enumerate(PDF) if d not in (None, "drop")}


@pytest.mark.parametrize(
    ("text", "block_type", "reason"),
    [("7 min read", "container_text", "html_reading_time"), ("٣ MINUTES\u3000read", "container_text", "html_reading_time"), ("7 min read", "paragraph", None), ("Link Copied!", "container_text", "html_ui_noise"), ("link copied!", "container_text", None), ("7 min reads", "container_text", None)],
)
def test_html_noise(spark, text, block_type, reason):
    done = cleaner.clean(units(spark, [("d", 0, text, "paragraph", {"block_type": block_type}), ("d", 1, "rest", "paragraph", {})], "url"))
    assert [r.reason_code for r in done.dropped.collect()] == ([reason] if reason else [])


def test_failures_are_whole_documents(spark):
    rows = [("a", 0, "\x00", "paragraph", {}), ("b", 0, "x", "paragraph", {}), ("b", 1, "y", "paragraph", {}), ("c", 0, "x" * 50, "paragraph", {}), ("d", 0, "ok", "paragraph", {})]
    done = cleaner.clean(units(spark, rows), {"max_input_units": 1, "max_input_characters": 20})
    errors = {r.document_id: (r.error_code, r.details) for r in done.errors.collect()}
    assert errors == {"a": ("cleaning_no_content", "empty_after_normalization"), "b": ("cleaning_limit_exceeded", "max_input_units"), "c": ("cleaning_limit_exceeded", "max_input_characters")}
    for table in (done.units, done.dropped, done.warnings, done.stats):
        assert {r.document_id for r in table.collect()} <= {"d"}


def test_reserved_metadata_fails_the_document(spark):
    done = cleaner.clean(units(spark, [("a", 0, "x", "paragraph", {}), ("b", 0, "y", "paragraph", {})]), reserved=F.col("document_id") == "a")
    assert [(r.document_id, r.error_code) for r in done.errors.collect()] == [("a", "cleaning_input_error")]


@pytest.mark.parametrize("config", [{"unknown": 1}, {"max_input_units": 0}, {"max_input_units": True}, {"max_input_units": "1"}])
def test_bad_config(config):
    with pytest.raises(cleaner.CleaningInputError):
        cleaner.policy(config)


def test_empty_table(spark):
    done = cleaner.clean(units(spark, [("a", 0, "x", "paragraph", {})]).where("false"))
    assert [t.count() for t in (done.units, done.dropped, done.warnings, done.stats, done.errors)] == [0] * 5


def test_rules_find_what_is_broken(spark):
    df = units(spark, [("d", 0, "x", "paragraph", {}), ("d", 2, " ", "odd", {"page_start": 0})])
    broken = {(r.rule, r.key) for r in validate.raw_units(df).collect()}
    assert broken == {("V1 content is not blank", "raw:d:000002"), ("V2 pages", "raw:d:000002"), ("V3 unit_index is the position", "raw:d:000002"), ("enumerations", "raw:d:000002")}
