"""Reproducible splits and folds. Order comes from a seeded hash of the row's id, so the same rows land in
the same part on any cluster and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geostat_spark.operators.ordering import hash_position, seeded_hash, with_row_number
from geostat_spark.session import shuffle_width

TEST_SHARE = 0.15
VAL_SHARE_OF_REST = 0.1765


def with_folds(df: DataFrame, id_column: str, folds: int, shuffle: bool, seed: int = 42) -> DataFrame:
    """``fold`` 1..k, sizes differing by at most one (larger ones first): contiguous in id order, or in
    the order of the seeded hash."""
    key = hash_position(id_column, seed) if shuffle else F.col(id_column)
    # equal leading hash digits are told apart by the rest of the hash
    tie = "_whole" if shuffle else id_column
    rows = df.withColumn("_whole", seeded_hash(id_column, seed)) if shuffle else df
    numbered = with_row_number(rows, key, tie, "_row")
    n = df.agg(F.count(F.lit(1))).scalar()
    numbered = numbered.withColumn("_n", n)
    small = F.floor(F.col("_n") / folds)
    extra = F.col("_n") % folds
    row = F.col("_row") - 1
    in_large = row < extra * (small + 1)
    fold = F.when(in_large, F.floor(row / (small + 1))).otherwise(
        extra + F.floor((row - extra * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn("fold", (fold + 1).cast("long")).drop("_row", "_n", "_whole")


def _position_in_stratum(df: DataFrame, id_column: str, stratum: Column, seed: int) -> DataFrame:
    """1-based hash position inside the stratum and the stratum's size. The hash is uniform, so its
    leading bits cut even a stratum that holds most rows into equal pieces."""
    pieces = shuffle_width(df)
    position = hash_position(id_column, seed)
    rows = df.withColumns(
        {
            "_s": stratum,
            "_h": seeded_hash(id_column, seed),
            "_piece": F.floor(F.shiftright(position, 30) * F.lit(pieces) / F.lit(2.0**30)).cast("int"),
        }
    )
    sizes = rows.groupBy("_s", "_piece").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_s")
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_s").alias("_os"),
        F.col("_piece").alias("_op"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_size"),
    )
    inside = Window.partitionBy("_s", "_piece").orderBy("_h", id_column)
    return (
        rows.join(offsets, F.col("_s").eqNullSafe(F.col("_os")) & (F.col("_piece") == F.col("_op")))
        .withColumn("_pos", F.col("_before") + F.row_number().over(inside))
        .drop("_s", "_h", "_piece", "_os", "_op", "_before")
    )


def _share(n: Column, share: float) -> Column:
    """Rows of a part, rounded up; the inner rounding removes float residue such as 15.000000002."""
    return F.ceil(F.round(n * F.lit(share), 9))


def train_val_test(
    df: DataFrame,
    id_column: str = "site_id",
    stratify_by: str | None = "continent",
    test_share: float = TEST_SHARE,
    val_share_of_rest: float = VAL_SHARE_OF_REST,
    seed: int = 42,
) -> DataFrame:
    """``split`` = test, val or train. Stratified unless a stratum has fewer than two rows; the second cut
    falls back on its own when a stratum is left with fewer than two rows after the first."""
    stratum = F.lit("all")
    if stratify_by is not None:
        sizes = df.groupBy(stratify_by).agg(F.count(F.lit(1)).alias("n"))
        left = F.col("n") - _share(F.col("n"), test_share)
        smallest, smallest_left = sizes.agg(F.min("n"), F.min(left)).first()
        if smallest is not None and smallest >= 2:
            stratum = F.coalesce(F.col(stratify_by).cast("string"), F.lit(""))
    placed = _position_in_stratum(df, id_column, stratum, seed)
    is_test = F.col("_pos") <= _share(F.col("_size"), test_share)
    rest = F.col("_size") - _share(F.col("_size"), test_share)
    if stratify_by is None or smallest is None or smallest < 2 or smallest_left >= 2:
        is_val = F.col("_pos") <= _share(F.col("_size"), test_share) + _share(rest, val_share_of_rest)
        return placed.withColumn(
            "split", F.when(is_test, "test").when(is_val, "val").otherwise("train")
        ).drop("_pos", "_size")
    test = placed.where(is_test).drop("_pos", "_size").withColumn("split", F.lit("test"))
    again = _position_in_stratum(placed.where(~is_test).drop("_pos", "_size"), id_column, F.lit("all"), seed)
    others = again.withColumn(
        "split", F.when(F.col("_pos") <= _share(F.col("_size"), val_share_of_rest), "val").otherwise("train")
    ).drop("_pos", "_size")
    return test.unionByName(others)
