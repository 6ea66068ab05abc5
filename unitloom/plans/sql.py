"""DuckDB fragments that say what the Catalyst expressions say."""

from __future__ import annotations

from ..functions.pytext import PYWS, PYWS_H


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{PYWS}]+|[{PYWS}]+\z', '', 'g')"


def blank(c: str) -> str:
    return rf"NOT regexp_matches({c}, '[^{PYWS}]')"


def word_count(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{PYWS}]+'))::BIGINT"


def lines(c: str) -> str:
    return f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def nbsp(c: str) -> str:
    return f"replace({c}, chr(160), ' ')"


def linewise(c: str) -> str:
    c = f"regexp_replace({c}, '[{PYWS_H}]+', ' ', 'g')"
    c = rf"regexp_replace({c}, ' ?\n ?', chr(10), 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({c}, '\A[ \n]+|[ \n]+\z', '', 'g')"


def controls(c: str, keep_tab: bool) -> str:
    return rf"regexp_replace({c}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')" if keep_tab else rf"regexp_replace({c}, '[\x00-\x09\x0B-\x1F\x7F]', '', 'g')"


#: Lines of documents as raw units, with dirt by document and line so that every rule has work.
DIRTY = f"""
lines_of AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
raw AS (
  SELECT 'doc-' || doc_id AS document_id, i::INT AS unit_index,
    CASE doc_id % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'list' WHEN 2 THEN 'code' ELSE 'unknown' END AS content_type,
    CASE (doc_id + i) % 9
      WHEN 0 THEN line
      WHEN 1 THEN line || chr(160) || chr(9) || 'x'
      WHEN 2 THEN '  ' || line || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || 'end' || chr(13)
      WHEN 3 THEN 'e' || chr(769) || ' ' || line
      WHEN 4 THEN chr(1) || line || chr(127)
      WHEN 5 THEN chr(12288) || ' ' || chr(9)
      WHEN 6 THEN chr(65533) || line
      WHEN 7 THEN replace(line, ' ', '  ' || chr(9) || ' ')
      ELSE line || ' ' || chr(2) || ' b' END AS content
  FROM lines_of),
s1 AS (SELECT *, content_type IN ('paragraph', 'list') AS flowing, nfc_normalize(content) AS c1 FROM raw),
s2 AS (SELECT *, {lines("c1")} AS c2 FROM s1),
s3 AS (SELECT *, CASE WHEN flowing THEN {nbsp("c2")} ELSE c2 END AS c3 FROM s2),
s4 AS (SELECT *, CASE WHEN flowing THEN {linewise("c3")} ELSE c3 END AS c4 FROM s3),
s5 AS (SELECT *, CASE WHEN flowing THEN {controls("c4", False)} ELSE {controls("c4", True)} END AS normalized FROM s4),
judged AS (
  SELECT *, CASE WHEN {blank("normalized")} THEN 'empty_after_normalization' END AS reason,
    contains(content, chr(65533)) AS replaced, length(c4) - length(normalized) AS removed,
    array_to_string(list_filter([CASE WHEN content <> c1 THEN 'unicode_nfc' END, CASE WHEN c1 <> c2 THEN 'line_endings_normalized' END, CASE WHEN c2 <> c3 THEN 'nbsp_normalized' END,
      CASE WHEN c3 <> c4 THEN CASE content_type WHEN 'list' THEN 'list_whitespace_normalized' ELSE 'prose_whitespace_normalized' END END,
      CASE WHEN c4 <> normalized THEN 'control_characters_removed' END], lambda x: x IS NOT NULL), ',') AS transformations,
    count(*) FILTER (WHERE NOT {blank("normalized")}) OVER (PARTITION BY document_id) AS left_over
  FROM s5),
good AS (SELECT *, CASE WHEN reason IS NULL THEN count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY document_id ORDER BY unit_index) - 1 END AS clean_unit_index FROM judged WHERE left_over > 0)
"""
