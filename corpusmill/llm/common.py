"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from ..sources.files import spread_out, work_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of one Arrow batch that become Python objects at a time.
CHUNK_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_out(df) if name in ("documents", "pages") else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  On a cluster it is named by
    spark.checkpoint.dir; only on one machine (tests) a local one is set where that is unset."""
    folder = work_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


#: Shuffle files of a query go when it has ended, rather than when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside lie in one shared folder, which goes at the end."""
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token, before = _FOLDER.set(folder), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        _FOLDER.reset(token)
        spark.conf.set(_CLEANUP, before)
        _remove(spark, folder)


def written(df: DataFrame, folder: str, what: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes stored tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            _remove(df.sparkSession, path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that
    survives the loss of executors.  The folder is a new one at each call."""
    return written(df, _FOLDER.get() or shared_dir(df.sparkSession), what)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, whatever the length of the texts: a JVM task and its
    Python worker hold a few batches at a time, and executors have little room beside the heap."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def rows_in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, small enough to turn into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(at, CHUNK_ROWS)


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on between
    tasks, and their executor has little room beside the heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> bool:
    """Gives memory that the driver has freed back to the system, in Python and in the JVM, whose
    many threads (planner, compiler, network) each leave freed blocks in a C heap of their own.
    Whether the JVM did so: a JDK without that command (before 17.0.9) goes on as it is."""
    release()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        # by the interface's method, as the class of the server is closed to reflection
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType | str, work: Callable) -> DataFrame:
    """work(chunk: RecordBatch) -> list of columns, run in Arrow batches on the chosen columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parsed)
        for chunk in rows_in_chunks(batches):
            if chunk.num_rows:
                out = work(chunk)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
                del out
        release()

    small_batches(df.sparkSession)
    parsed = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return df.select(*columns).mapInArrow(run, parsed)


def filter_rows(df: DataFrame, column: str, keep: Callable) -> DataFrame:
    """The rows of df for which keep(values of one column) says so, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in rows_in_chunks(batches):
            yield chunk.filter(pa.array(keep(chunk.column(at).to_pylist()), pa.bool_()))
        release()

    small_batches(df.sparkSession)
    at = df.columns.index(column)
    return df.mapInArrow(run, df.schema)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once.  A filter on columns that are themselves
    expressions is moved below them with the expressions written out at each use, and inside
    lambdas they would run for each element; a lambda's variable can't be written out."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of a block that a fold appends to, and blocks of a group.
FOLD = 32


def folded(items: Column, at, step, kind: str) -> Column:
    """What a fold over items gives out, in a row.  step(at, x) is the new state (an int) and an
    array of elements of the kind.  Appending to an array copies it, so the fold goes by blocks
    of FOLD elements, blocks by groups, and appends whole blocks and groups."""
    out, outs = f"array<{kind}>", f"array<array<{kind}>>"
    cut = lambda some, size: F.transform(F.sequence(F.lit(0), F.size(some) - 1, F.lit(size)), lambda b: F.slice(some, b + 1, size))

    def inner(start: Column, block: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            now, more = step(a["at"], x)
            return F.struct(now.cast("int").alias("at"), F.concat(a["out"], more.cast(out)).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(out).alias("out")), one)

    def over(parts: Column, start: Column, body) -> Column:
        merge = lambda a, part: let(body(a["at"], part), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(parts, F.struct(start.alias("at"), F.array().cast(outs).alias("out")), merge, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["out"]).alias("out")))

    group = lambda start, some: over(cut(some, FOLD), start, inner)
    whole = lambda all_: F.when(F.size(all_) > 0, over(cut(all_, FOLD * FOLD), F.lit(at).cast("int"), group)["out"]).otherwise(F.array().cast(out))
    return let(items, whole)
