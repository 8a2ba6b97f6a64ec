"""What every job needs from the cluster: the shared folder and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_session: list[str] = []
#: Where new folders are noted: those of the session, or of the innermost scratch block.
_folders: ContextVar[list[str]] = ContextVar("folders", default=_session)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names it.

    Where it is unset and Spark runs in one process (tests), a temporary folder is made and set;
    on a cluster a missing setting is an error, as no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probitas-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _folders.get().append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor
    costs a read instead of the work above."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_rows(df: DataFrame, label: str) -> DataFrame:
    """stage() of a table that grows with the input; see merged()."""
    return merged(stage(df, label))


def merged(df: DataFrame) -> DataFrame:
    """df for joins by key with others that grow with the input: they are merge joins. Spark judges a table by the size of
    its files, of which a few packed columns are a fraction of their rows, and would send those through the driver."""
    return df.hint("merge")


#: Rows of a task where a table is dealt by a key, about.
ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Into how many tasks a table of so many rows is dealt: more as it grows, so that none of them does; not fewer
    than other shuffles have, for which Spark would deal its rows once more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _table_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def stage_by(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """stage() into n buckets by a key: what groups, numbers or joins the rows by it, with tables of as many
    buckets too, shuffles none of them."""
    path = new_folder(df.sparkSession, label)
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(_table_of(path))
    return df.sparkSession.table(_table_of(path))


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_table_of(path)}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose staged tables are removed at its end. The function it gives stages a table that
    stays; nothing else that reads the block's tables may leave it."""
    before, mine = _folders.get(), []
    token = _folders.set(mine)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _folders.set(before)
        try:
            return stage(df, label)
        finally:
            _folders.reset(inner)

    try:
        yield keep
    finally:
        _folders.reset(token)
        _remove(spark, mine)


def release(spark: SparkSession) -> None:
    """Remove what this session has staged outside of scratch blocks: for when results are written."""
    _remove(spark, _session)
    _session.clear()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, for functions that run in their Python."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="probitas-code-"), "probitas.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".yaml")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("probitas", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)
