import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from unitloom.functions import pytext as P, tsv

ODD = list("ab  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b\ufeff\x00\x7fé\u0301\\ntx\ufffd")


def texts(n, seed, alphabet=ODD, longest=14):
    own = random.Random(seed)
    return ["".join(own.choice(alphabet) for _ in range(own.randint(0, longest))) for _ in range(n)] + [""]


def apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").repartition(4)
    return [r[1] for r in sorted(df.select("i", f(F.col("c"))).collect())]


def linewise(text):
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in text.split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def controls(text, keep_tab):
    return "".join(c for c in text if c == "\n" or (keep_tab and c == "\t") or not (ord(c) < 32 or ord(c) == 127))


@pytest.mark.parametrize(
    ("native", "python"),
    [
        (P.strip, str.strip),
        (P.is_blank, lambda x: not x.strip()),
        (P.word_count, lambda x: len(x.split())),
        (P.line_endings, lambda x: x.replace("\r\n", "\n").replace("\r", "\n")),
        (P.nbsp, lambda x: x.replace("\xa0", " ")),
        (lambda c: P.linewise(P.line_endings(c)), lambda x: linewise(x.replace("\r\n", "\n").replace("\r", "\n"))),
        (lambda c: P.controls(c, False), lambda x: controls(x, False)),
        (lambda c: P.controls(c, True), lambda x: controls(x, True)),
        (P.nfc, lambda x: unicodedata.normalize("NFC", x)),
    ],
)
def test_text_functions_equal_python(spark, native, python):
    values = texts(1500, 1)
    assert apply(spark, values, native) == [python(v) for v in values]


def escape(x):
    return x.replace("\\", "\\\\").replace("\r\n", "\n").replace("\r", "\n").replace("\t", "\\t").replace("\n", "\\n")


def unescape(x):
    return re.sub(r"\\([\\tn])", lambda m: {"\\": "\\", "t": "\t", "n": "\n"}[m[1]], x)


def test_cell_codec_equals_python(spark):
    values = texts(1500, 2, list("\\\\tn\t\r\na\ufffe"))
    assert apply(spark, values, tsv.escape) == [escape(v) for v in values]
    assert apply(spark, values, tsv.unescape) == [unescape(v) for v in values]
    assert apply(spark, values, lambda c: tsv.parse(c)) == [[[unescape(c) for c in r.split("\t")] for r in v.split("\n")] for v in values]


def test_unit_ids(spark):
    df = spark.createDataFrame([(" d ", 7), ("d", 1_234_567), ("  ", 0), ("d", -1), (None, 1)], "d string, i int")
    got = [r[0] for r in df.select(P.unit_id("raw", F.col("d"), F.col("i"))).collect()]
    assert got == ["raw:d:000007", "raw:d:1234567", None, None, None]


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    c = F.col("c")
    row = df.select(P.strip(c), P.nfc(c), P.linewise(c), tsv.escape(c), P.is_blank(c)).first()
    assert list(row) == [None, None, None, None, True]
