"""Where intermediate tables live, and how lineage is cut.

Every table that an operator writes for its own use goes below the folder named by ``spark.checkpoint.dir``, which all
executors of a cluster share, so the loss of an executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, or one of our own where a local session has none.

    Raises ``RuntimeError`` on a cluster that names no folder: a machine-local folder would not be seen by executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gaugewell-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_MADE: dict[str, list[tuple[SparkSession, str, str]]] = {}  # by application: what is to be removed


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for a new intermediate table that no other run uses; ``release`` removes it unless it is to be kept."""
    path = f"{shared_dir(spark)}/gaugewell/{name}-{uuid.uuid4().hex}"
    if keep:
        return path
    _MADE.setdefault(spark.sparkContext.applicationId, []).append((spark, "path", path))
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A name for a new table in the session's catalog; ``release`` drops it."""
    table_ = f"gaugewell_{name}_{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append((spark, "table", table_))
    return table_


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables that operators of this application have written so far.

    Frames that were made from them can't be read any more.  Runs by itself when the program ends.
    """
    for session, kind, name in _MADE.pop(spark.sparkContext.applicationId, []):
        if kind == "table":
            session.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            files, at = _files(session, name)
            files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What operators write for themselves inside this block is removed at its end."""
    app = spark.sparkContext.applicationId
    before = _MADE.pop(app, [])
    try:
        yield
    finally:
        release(spark)
        _MADE[app] = before + _MADE.get(app, [])


@atexit.register
def _at_end() -> None:
    for made in list(_MADE.values()):
        try:
            release(made[0][0])
        except Exception:  # noqa: BLE001  the session is gone; its folder is whoever's that named it
            pass


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as parquet in the shared folder and read again: the plan after it starts at those files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark resolves them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, by which others see that something is whole."""
    files, at = _files(spark, path)
    files.create(at, True).close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    files, at = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's (plans, declared keys) as a local relation: its size is known and it needs no job."""
    struct = _parse_datatype_string(schema)
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(struct.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=struct.names), struct)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
