"""What the operators of this subpackage share: scratch tables and word patterns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a single-process session may go without that setting; it gets a
    temporary folder, which nobody else could read on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="driftlens-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it from there.

    This cuts the lineage: later stages survive the loss of executors, and
    generated ids and sampled range bounds stay as they were written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/driftlens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far; frames that still read them must be done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop().rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):
            release(spark)


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def workers_know(spark: SparkSession) -> None:
    """Tells Python workers where this package lies, wherever the driver was started.

    On a cluster the package is installed on all machines, at any place that
    Python looks in, or shipped with --py-files.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it has over 1 / HOT_SHARE of all rows, and HOT_LEAST rows: there are fewer than HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 2000, 1000
#: Parts that the rows of a hot key are dealt to.
SPREAD = 64


def hot_keys(counts: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """The keys of counts(on..., n) that hold a large share of `total` rows; fewer than HOT_SHARE, whatever the size."""
    return counts.filter(F.col(n) > max(total // HOT_SHARE, HOT_LEAST)).select(*on)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """big joined with small, which has few rows for each key; the rows of hot keys are dealt to SPREAD parts.

    small's rows of those keys are repeated for each part. hot(on...) comes from
    hot_keys, so its size is bounded and it can be broadcast. `by` are columns of
    big that tell rows of one key apart, so a task that runs again deals alike.
    """
    part, seen = fresh(big, "part", small), fresh(big, "is_hot", small)
    marked = F.broadcast(hot.withColumn(seen, F.lit(True)))
    dealt = F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")
    left = big.join(marked, on, "left").withColumn(part, F.when(F.col(seen), dealt).otherwise(F.lit(0))).drop(seen)
    parts = F.when(F.col(seen), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(marked, on, "left").withColumn(part, F.explode(parts)).drop(seen)
    return left.join(right.hint("merge"), [*on, part], how).drop(part)


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """A column name that neither df nor the others have, whatever the case."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
