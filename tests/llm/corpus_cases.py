import hashlib
import re
import zlib

import pytest

BLANK = re.compile(r"[\x20\x09-\x0D]+")
ODD = [
    (1, "a b  c\td", "en", "x", 7), (2, "abcd", "en", "x", 4), (3, None, None, None, None), (4, "", "", "", 0),
    (5, " \n ", "en", "y", 3), (5, " \n ", "en", "y", 3), (None, "a b c d", "en", None, 7), (None, "ABCD e", None, "x", 6),
    (6, "w " * 60_000, "en", "x", 120_000), (7, "<|im_end|> é ß 中 İ", "de", "ü", 1), (2, "other text", "en", "x", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, file string, row string, score string, size string, kept string"
    return spark.createDataFrame([(*r, "f", "r", "s", "z", "k") for r in ODD], ddl)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def normal(text):
    return BLANK.sub("", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
