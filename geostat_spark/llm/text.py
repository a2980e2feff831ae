"""Text conventions that the corpus operators share."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.session import cut

# White space is the six ASCII characters 20 and 09-0D; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

words_in = re.compile(WORD).findall
LOWERED = {ord(a): b for a, b in zip(UPPER, LOWER)}


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lowered and every other character as it was."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def hash_part(key: Column, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts``."""
    return F.crc32(key.cast("string")) % parts


def fresh(df, *names: str) -> list[str]:
    """The names, each lengthened until no column of the table (in any case) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def in_place(table: DataFrame, name: str) -> DataFrame:
    """The rows of a table, as ``spark.read`` gives it, with a text that tells each from all others at every reading:
    a hash of its file's name and its place there. Other rows are numbered in a written table."""
    try:
        return table.select("*", F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index").alias(name))
    except AnalysisException:
        return cut(table.withColumn(name, F.monotonically_increasing_id()))
