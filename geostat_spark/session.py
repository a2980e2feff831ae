"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def local_session(cores: int | str = 8, app: str = "geostat-spark") -> SparkSession:
    """A session for tests and benches; on a cluster, pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session. Only a local session
    that names none gets a folder of its own, kept as the context's checkpoint folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="geostat-"))
        named = context.getCheckpointDir()
    return named


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used; ``release`` deletes what was written there."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame, *partition_by: str, rows_a_file: int = 0) -> DataFrame:
    """Write the rows to the shared folder as a table and go on from that table.

    What was computed is computed once: a lost executor costs a re-read, later steps read only the columns
    they use, and the table's real size lets Spark choose between broadcast and shuffle joins. ``rows_a_file`` bounds the
    rows of a file (0: no bound)."""
    path = new_path(df.sparkSession)
    writer = df.write.option("maxRecordsPerFile", rows_a_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_so_far() -> int:
    """A mark for ``release``: how many paths have been given out."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this process has cut since the mark ``since``; results that still read them must be
    written first."""
    deleted = 0
    while len(_WRITTEN) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def last_path() -> str:
    """Where the last table was cut to: what ``release_others`` keeps."""
    return _WRITTEN[-1]


def release_others(spark: SparkSession, since: int, keep: Sequence[str]) -> None:
    """Delete the tables cut since the mark, but those at the paths of ``keep``."""
    kept = [path for path in _WRITTEN[since:] if path in keep]
    _WRITTEN[since:] = [path for path in _WRITTEN[since:] if path not in keep]
    release(spark, since)
    _WRITTEN.extend(kept)


@contextmanager
def _set(spark: SparkSession, name: str, value: str, otherwise: str) -> Iterator[None]:
    """The setting while the block runs; ``otherwise``: what the session has where it names none."""
    before = spark.conf.get(name, otherwise)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them has ended, not when the driver next collects its garbage. For
    rounds whose tables are all cut."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false"):
        yield


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = 1 << 19) -> Iterator[None]:
    """No table of over ``most`` bytes is sent to the driver for a join, unless the session's own bound is lower. For runs of
    very many joins, which together would send what each of them may."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    bound = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    with _set(spark, name, str(min(bound, most)), str(bound)):
        yield


def cut_and_release(df: DataFrame, since: int) -> DataFrame:
    """``cut``, and delete the tables cut since the mark that led to it."""
    out = cut(df)
    path = _WRITTEN.pop()
    release(df.sparkSession, since)
    _WRITTEN.append(path)
    return out


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
