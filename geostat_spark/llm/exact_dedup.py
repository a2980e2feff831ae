"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.llm.text import fresh, in_place, lower_ascii
from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut

CHUNK = 32768  # bits of one row that bitmap_construct_agg returns


def _sieve(counted: DataFrame, key: Column, bits: int) -> DataFrame:
    """(chunk, bitmap): a bitmap of ``bits`` bits in which the bucket of every counted key is set."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return cut(
        counted.select(at.alias("at"))
        .groupBy(F.expr(f"at div {CHUNK}").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("at") % CHUNK).alias("bitmap"))
    )


def _through(rows: DataFrame, sieve: DataFrame, key: Column, bits: int) -> DataFrame:
    """The rows with ``shared``: false if the sieve proves that no other row has their key.

    The sieve has bits / 8 bytes whatever the data's size, so it is broadcast; a false alarm costs one hash."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast((at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        rows.withColumn("at", at)
        .withColumn("chunk", F.expr(f"at div {CHUNK}"))
        .join(F.broadcast(sieve), "chunk", "left")
        .withColumn("shared", F.coalesce(F.getbit(byte, F.col("at") % 8) == 1, F.lit(False)))
        .drop("at", "chunk", "bitmap")
    )


def exact_dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    prefix_chars: int = 64,
    sieve_bits: int = 1 << 22,
    digest_all: bool = False,
    row: str | None = None,
) -> DataFrame:
    """One row per document: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lowering A-Z. Of equal texts the largest id stays. Three
    passes, each over what the one before left: lengths; hashes of prefixes among shared lengths; SHA-256 of
    whole texts among shared (length, prefix) pairs. Texts never leave their scan: only counts and digests are
    shuffled. ``text_sha256`` is null for a text proven unique before its last pass, unless ``digest_all``.

    ``row``: a column that tells the rows apart; it is returned too.

    Null text counts as empty; an empty text is a text like others. A null id is smaller than any other. Of
    rows that repeat both id and text one (any) is kept. Other columns are ignored. No rows give no rows."""
    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(id).alias("id"), whole.alias("whole"), number.alias("row"))
    length = F.octet_length("whole")
    lengths = _sieve(rows.groupBy(length.alias("n")).count().where("count > 1"), F.col("n"), sieve_bits)

    def measured():
        return _through(rows.withColumn("n", length), lengths, F.col("n"), sieve_bits)

    head = F.xxhash64("n", lower_ascii(F.substring("whole", 1, prefix_chars)))
    heads = _sieve(
        measured().where("shared").groupBy(head.alias("head")).count().where("count > 1"), F.col("head"), sieve_bits
    )
    known = measured().withColumn("head", F.when(F.col("shared"), head)).withColumnRenamed("shared", "same_length")
    known = _through(known, heads, F.col("head"), sieve_bits)
    known = known.withColumn("shared", F.col("shared") & F.col("same_length"))
    digest = F.sha2(lower_ascii(F.col("whole")), 256)
    hashed = cut(
        known.select(
            "id",
            "shared",
            (digest if digest_all else F.when(F.col("shared"), digest)).alias("sha"),
            "row",
        )
    )
    groups = (
        hashed.where("shared")
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("best"))
        .where("group_size > 1")
    )
    joined = attach_counted(hashed, groups, ["sha"], "group_size", "row", hashed.count())
    return joined.select(
        F.col("id").alias(id),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row)] if row else []),
    )


MOST_BITS = 1 << 25  # 4 MB, the most that is broadcast to tell rows without a mark from others


def sieved(rows: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """The rows with ``shared``: false where surely no row of ``marked`` has their key. 16 bits a mark up to
    ``MOST_BITS`` let a sixteenth of the other rows through; with very many marks more come through, never fewer."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * max(marked.count(), 1)).bit_length()))
    return _through(rows, _sieve(marked.select(key), F.col(key), bits), F.col(key), bits)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``gone``. Only rows that a sieve of the gone keys lets through are shuffled."""
    told = sieved(rows, gone, key)
    stay = told.where(~F.col("shared")).drop("shared")
    return stay.unionByName(told.where("shared").drop("shared").join(gone.select(key), key, "left_anti").select(*stay.columns))


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one row left of each group of equal texts (see ``exact_dedup``).

    Rows that repeat id and text but differ in other columns leave one of them."""
    (row,) = fresh(docs, "_row")
    rows = in_place(docs, row)
    gone = cut(exact_dedup(rows, id, text, row=row, **options).where("not kept").select(row))
    return without(rows, gone, row).select(*docs.columns)
