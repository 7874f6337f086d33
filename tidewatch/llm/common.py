"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(name: str) -> Column:
    """The named text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one of its own (tests); a cluster gets an error, since no executor could read
    back what another one wrote to a folder of its machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


#: Paths of the tables made by ``stored``, in order, and what deletes each.
_made: dict[str, Callable[[], None]] = {}


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remember(name: str, drop: Callable[[], None]) -> None:
    """Drop a stored table at the end of the program, also after a failure, if nobody has dropped it before."""
    _made[name] = drop


def stored(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back; ``by`` names columns to make folders of.

    This cuts lineage: a lost executor re-reads the table instead of repeating the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    remember(path, lambda: delete_path(spark, path))
    df.write.partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_tables() -> set[str]:
    return set(_made)


def drop_stored(keep: set[str] = frozenset()) -> None:
    """Delete the tables stored so far, but for those to keep. Results that still read them are lost."""
    for name in [n for n in _made if n not in keep]:
        _made.pop(name)()


@atexit.register
def _drop_all() -> None:
    for drop in list(_made.values()):
        try:
            drop()
        except Exception:  # noqa: BLE001  the session may be gone
            continue
    _made.clear()


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        found = next((n for n in _made if n.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]), None)
        if found:
            _made.pop(found)()


def with_group(rows: DataFrame, names: list[str], values: dict[str, tuple[Column, Callable[[str], Column]]], spread: list[str]) -> DataFrame:
    """Add to each row aggregates over its group, without bringing a hot group into one task.

    ``values``: name to (aggregate of a part, how to combine the parts). A group is dealt by a hash of ``spread`` into as many
    parts as there are shuffle partitions; the parts' aggregates are combined over their group (one row a part), and each
    part's rows meet the outcome by (group, part). ``rows`` is read twice.
    """
    salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    parts = dealt.groupBy(*names, "__part").agg(*[part.alias(k) for k, (part, _) in values.items()])
    group = Window.partitionBy(*names)
    whole = parts.select(*names, "__part", *[combine(k).over(group).alias(k) for k, (_, combine) in values.items()])
    return dealt.join(whole, [*names, "__part"]).drop("__part")


#: Rows of an Arrow batch: batches are off the JVM's heap, and its buffers stay with the executor.
BATCH, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@cache
def _ship(app: str) -> None:
    """Send this package to the executors, which need not have it installed."""
    spark = SparkSession.getActiveSession()
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tidewatch-")) / "tidewatch.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))


def map_batches(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]], rows: int = 1000) -> DataFrame:
    """``mapInArrow`` over columns: ``work`` gets dicts of columns, of ``rows`` rows at most, and yields such dicts.

    Python holds the objects of one such part at a time, and Spark sends no larger Arrow batches: the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` is lowered to ``BATCH`` where it is above.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH:
        conf.set(_BATCH, str(BATCH))
    arrow = _arrow_schema(schema)
    _ship(df.sparkSession.sparkContext.applicationId)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        parts = (dict(zip(b.schema.names, b.columns, strict=True)) for b in cut)
        out = None
        for out in work(parts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in arrow], schema=arrow)
        del out, cut, parts
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand freed memory back to the system: a worker outlives its task and would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
