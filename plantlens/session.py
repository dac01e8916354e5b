"""Session defaults and the two helpers every multi-pass job needs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side never exceeds this many rows; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def build_session(app_name: str = "plantlens", master: str | None = None, **conf) -> SparkSession:
    """Create a session with UTC time, AQE and runtime skew-join handling."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python functions run wherever the driver was started.

    Not needed where the package is installed on every machine.  A session gets it once.
    """
    if getattr(spark, "_plantlens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plantlens-package-")  # on the driver only; Spark copies the archive
    archive = Path(folder) / "plantlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("plantlens") / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark._plantlens_shipped = True


def named(column: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to /tmp in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plantlens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder next to the checkpoints, shared by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Used where several passes must see the very same rows (range partition bounds
    are sampled anew in every query) and where lineage would otherwise be recomputed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it has been written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as packed Parquet beside the checkpoints and read it from there; its shuffle files go.

    For rows of text, which a checkpoint holds unpacked with all their repeated columns.
    """
    folder = work_folder(df.sparkSession, purpose)
    with files_cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join a summary table to its detail rows, broadcasting only behind a row count.

    The summary is materialised once, so that the count is not a second computation.
    Above ``max_rows`` the join is a normal shuffle join (AQE splits skewed keys).  Keys are
    compared null-safely: a missing series name is a series of its own.
    """
    small = materialize(small)
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return null_safe_join(big, small, on, how)


# Characters of text that one task takes where they become rows of words.
TASK_CHARS = 8 << 20


def dealt_by_text(rows: DataFrame, texts: list[str], *by: str | Column) -> DataFrame:
    """Rows dealt by a key to as many partitions as their texts ask for, so that a task's words do not grow with the table.

    The number is given outright, as partitions of texts look small to a merge by size.
    """
    length = sum((F.coalesce(F.length(named(c)), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    chars = rows.agg(F.sum(length)).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), *by)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where two missing keys are equal; the left key columns are kept."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in on})
    condition = F.lit(True)
    for k in on:
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{k}" for k in on])


def read_table(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Read a Parquet table; a small one is spread over all cores.

    A file with one row group is one task however many cores there are.  Larger tables (by the optimizer's size
    estimate) are read as they are: nothing beyond ``most_bytes`` is ever shuffled just to be read.
    """
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if (1 << 20) < size < most_bytes else df
