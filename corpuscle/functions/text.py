"""Text functions: normalisation, character and word counts, byte tokens."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: White space as Unicode has it, with the four separators that Java's \s leaves out.
SPACE = r"[\s\x1C-\x1F\x85\x0B\p{Z}]"
#: Byte tokens: the id of a byte is the byte plus this number of special ids.
N_SPECIAL = 4

# Language code, name, script, whether white space separates words.
LANGUAGES = [
    ("en", "English", "Latin", True),
    ("ja", "Japanese", "Japanese", False),
    ("hi", "Hindi", "Devanagari", True),
    ("ar", "Arabic", "Arabic", True),
    ("th", "Thai", "Thai", False),
    ("sw", "Swahili", "Latin", True),
    ("ko", "Korean", "Hangul", True),
    ("bn", "Bengali", "Bengali", True),
    ("te", "Telugu", "Telugu", True),
    ("ta", "Tamil", "Tamil", True),
    ("am", "Amharic", "Ethiopic", True),
    ("my", "Burmese", "Myanmar", False),
    ("zh", "Chinese (Simplified)", "Han", False),
    ("ru", "Russian", "Cyrillic", True),
    ("es", "Spanish", "Latin", True),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "lang string, name string, script string, whitespace_delimited boolean")


def language(code: Column, registry: DataFrame | None = None) -> Column:
    """The registered entry of a code, as a struct; an unknown code is an error."""
    rows = LANGUAGES if registry is None else [tuple(r) for r in registry.collect()]  # a registry is a row for each language
    table = F.create_map(*[x for c, name, script, cut in rows for x in (F.lit(c), F.struct(F.lit(c).alias("code"), F.lit(name).alias("name"), F.lit(script).alias("script"), F.lit(cut).alias("whitespace_delimited")))])
    found = F.try_element_at(table, code)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown language "), F.coalesce(code, F.lit("null")))))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC form; texts in ASCII are in it already and never leave the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfc(text))


def count_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def count_words(text: Column, delimited: Column | None = None) -> Column:
    """Runs between white space; null where white space separates no words."""
    words = F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")).cast("long")
    return words if delimited is None else F.when(delimited, words)


def count_alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def byte_tokens(text: Column) -> Column:
    """The byte tokens of a text as a binary: one byte a token, its id less N_SPECIAL."""
    return F.encode(text, "utf-8")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


@F.pandas_udf(ArrayType(IntegerType()))
def _ids(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else np.frombuffer(b, np.uint8).astype(np.int32) + N_SPECIAL)


def byte_ids(tokens: Column) -> Column:
    """Ids of a binary of byte tokens, as an array; a batch at a time, since array functions would look at each byte several times."""
    return _ids(tokens)


def byte_text(ids: Column) -> Column:
    """Text of an array of byte ids; ids out of range are dropped, invalid bytes become marks."""
    good = F.filter(ids, lambda i: (i >= N_SPECIAL) & (i < 256 + N_SPECIAL))
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(good, lambda i: F.lpad(F.hex(i - N_SPECIAL), 2, "0")), "")).cast("string"))


def token_pieces(ids: Column) -> Column:
    """How byte ids are shown: <xx>."""
    return F.transform(ids, lambda i: F.concat(F.lit("<"), F.lower(F.lpad(F.hex(i - N_SPECIAL), 2, "0")), F.lit(">")))
