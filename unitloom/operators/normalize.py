"""Normalization of unit content by content type, with transformation codes and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pytext as P, tsv

# Transformation and warning codes.
NFC, LINES, SPACES, CONTROLS, CELLS = "unicode_nfc", "line_endings_normalized", "nbsp_normalized", "control_characters_removed", "table_cells_normalized"
PROSE, LIST = "prose_whitespace_normalized", "list_whitespace_normalized"
REPLACEMENT_FOUND, CONTROLS_REMOVED = "replacement_character_detected", "suspicious_control_characters_removed"

#: What a warning is before it has a unit: code, where it comes from, and what it tells.
WARNING = "struct<code:string,origin:string,removed_count:int,details:string>"


def _warning(code: str, origin: str = "normalization", removed: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(origin).alias("origin"), (F.lit(None).cast("int") if removed is None else removed.cast("int")).alias("removed_count"), F.lit(None).cast("string").alias("details"))


def _kinds(df: DataFrame) -> Column:
    """prose, list, table, raw (a table of another format) or code, by content type."""
    kind, form = F.col("content_type"), F.col("extra_metadata.serialization_format")
    return F.when(kind == "paragraph", "prose").when(kind == "list", "list").when((kind == "table") & (form == tsv.FORMAT), "table").when(kind == "table", "raw").otherwise("code")


def normalize(units: DataFrame) -> DataFrame:
    """units with normalized, transformations and normalization_warnings; no shuffle.

    Every step is a column of its own, so Catalyst evaluates it once however often it is compared.
    The only Python in the plan is the NFC pass over text and over table cells.
    """
    text = F.col("content")
    df = units.withColumn("__kind", _kinds(units))
    df = df.withColumn("__rows", F.when(F.col("__kind") == "table", tsv.parse(P.line_endings(text))))
    df = df.withColumns({"__c1": P.nfc(text), "__n1": P.nfc_cells("__rows")})
    flowing = F.col("__kind").isin("prose", "list")
    df = df.withColumn("__c2", P.line_endings(F.col("__c1")))
    df = df.withColumn("__c3", F.when(flowing, P.nbsp(F.col("__c2"))).otherwise(F.col("__c2")))
    df = df.withColumn("__c4", F.when(flowing, P.linewise(F.col("__c3"))).otherwise(F.col("__c3")))
    df = df.withColumn("__c5", F.when(flowing, P.controls(F.col("__c4"), False)).otherwise(P.controls(F.col("__c4"), True)))
    # Table cells go through their own steps; each nested array is a column.
    each = lambda name, f: F.transform(F.col(name), lambda row: F.transform(row, f))
    df = df.withColumn("__n2", each("__n1", P.line_endings))
    df = df.withColumn("__n3", each("__n2", P.nbsp))
    df = df.withColumn("__n4", each("__n3", lambda x: P.controls(x, True)))
    df = df.withColumn("__t1", tsv.serialize(F.col("__n4")))
    df = df.withColumn("__t2", P.controls(F.col("__t1"), True))
    table, raw = F.col("__kind") == "table", F.col("__kind") == "raw"
    normalized = F.when(raw, text).when(table, F.col("__t2")).otherwise(F.col("__c5"))
    changed = P.changed
    space = F.when(F.col("__c3") != F.col("__c4"), F.when(F.col("__kind") == "list", F.lit(LIST)).otherwise(F.lit(PROSE)))
    plain_codes = P.codes(changed(text, F.col("__c1"), NFC), changed(F.col("__c1"), F.col("__c2"), LINES), changed(F.col("__c2"), F.col("__c3"), SPACES), space, changed(F.col("__c4"), F.col("__c5"), CONTROLS))
    # Codes of cells come cell by cell, so their order is that of the first cell with each.
    steps = [("__rows", "__n1", NFC), ("__n1", "__n2", LINES), ("__n2", "__n3", SPACES), ("__n3", "__n4", CONTROLS)]
    flat = {name: F.flatten(F.col(name)) for name in ("__rows", "__n1", "__n2", "__n3", "__n4")}
    zipped = F.arrays_zip(*[flat[n].alias(n) for n in flat])
    df = df.withColumn("__cells", F.when(table, zipped))
    of_cell = lambda x: F.array_compact(F.array(*[F.when(x[a] != x[b], F.lit(code)) for a, b, code in steps]))
    cell_codes = F.flatten(F.transform("__cells", of_cell))
    any_cell = F.exists("__cells", lambda x: x["__rows"] != x["__n4"])
    table_codes = F.array_distinct(F.array_compact(F.concat(F.array(changed(text, P.line_endings(text), LINES)), cell_codes, F.array(F.when(any_cell, F.lit(CELLS)), changed(F.col("__t1"), F.col("__t2"), CONTROLS)))))
    codes = F.when(raw, F.array().cast("array<string>")).when(table, table_codes).otherwise(plain_codes)
    found = lambda c: F.contains(c, F.lit(P.REPLACEMENT))
    removed = F.length("__c4") - F.length("__c5")
    plain_warnings = F.array(F.when(found(text), _warning(REPLACEMENT_FOUND)), F.when(removed > 0, _warning(CONTROLS_REMOVED, removed=removed)))
    of_cell_warnings = lambda x: F.array(F.when(found(x["__rows"]), _warning(REPLACEMENT_FOUND)), F.when(x["__n3"] != x["__n4"], _warning(CONTROLS_REMOVED, removed=F.length(x["__n3"]) - F.length(x["__n4"]))))
    rest = F.length("__t1") - F.length("__t2")
    table_warnings = F.concat(F.array(F.when(found(text), _warning(REPLACEMENT_FOUND))), F.flatten(F.transform("__cells", of_cell_warnings)), F.array(F.when(rest > 0, _warning(CONTROLS_REMOVED, removed=rest))))
    raw_warnings = F.array(F.when(found(text), _warning(REPLACEMENT_FOUND)))
    warnings = F.array_compact(F.when(raw, raw_warnings).when(table, table_warnings).otherwise(plain_warnings))
    out = df.withColumns({"normalized": normalized, "transformations": codes, "normalization_warnings": warnings})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
