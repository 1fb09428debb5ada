"""What the operators of this subpackage share: reading tables, text columns, and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The whole text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def zipped(text: str, level: int = 3) -> bytes:
    """The whole text, compressed, after its length in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def unzipped(data: bytes) -> str:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs
    inside one process (tests), a temporary folder of this machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="tickerloom-")
    return _local


def trim() -> None:
    """Gives the memory that a task has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_local: str | None = None
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that a query writes and reads; deleted as materialise()'s tables are."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def forget(*tables: DataFrame) -> None:
    """Deletes what materialise() has written for tables, once nothing that is still to be worked out reads them."""
    for df in tables:
        path = getattr(df, "written", None)
        if path in _written:
            _written.remove(path)
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end all that materialise() has written inside; for work whose result is written by then."""
    start = len(_written)
    yield
    while len(_written) > start:
        delete(spark, _written.pop())


def join_by_parts(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, parts: int) -> DataFrame:
    """rows joined to facts, which has one row for each combination of keys. The join is by keys and one of parts parts,
    dealt by the column by, so a hot key is many tasks' work; facts are repeated for the parts that rows have, so never
    more often than there are rows. rows are read twice."""
    part = F.pmod(F.xxhash64(by), F.lit(parts)).alias("_part")
    dealt = rows.select(*keys, part).distinct().join(facts, keys)
    return rows.select("*", part).join(dealt, [*keys, "_part"]).drop("_part")


def drop_materialised() -> None:
    """Deletes the tables that materialise() has written; for the end of a session, once no result refers to them."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        delete(spark, _written.pop())


def _at_exit() -> None:
    try:
        drop_materialised()
    except Exception:  # noqa: BLE001  the JVM may be gone
        _written.clear()


atexit.register(_at_exit)
