"""What the operators of this subpackage share: scratch tables, batch sizes and reading."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. A batch is what a Python worker holds at once, so it is small: texts may be long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; sets the batch size for the Python operators on it.

    A table of fewer splits than there are cores, so of bounded size, is dealt out to all cores.
    """
    bound_batches(spark)
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small (a run-time setting of this session)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def settle(spark: SparkSession) -> None:
    """Between large steps: let both sides of the driver collect garbage, upon which Spark's cleaner removes the shuffle files and broadcasts of finished steps, and hand freed memory back to the system."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Let the driver's JVM return native memory that it has freed (compiled code's scratch and the like), which its allocator keeps otherwise; what the JVM says of it.

    The command is that of `jcmd PID System.trim_native_heap`; a JVM without it is left as it is.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    kind, server = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    takes, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        takes[i] = kind(name)
    given[0], given[1] = command, "systemTrimNativeHeap"
    try:
        return str(kind("javax.management.MBeanServer").getMethod("invoke", takes).invoke(server, given))
    except Py4JJavaError:
        return ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    set_to = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, computed now."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which the shuffle files of a query go when it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """What is run in here removes its shuffle files when it has ended, not when the driver happens to collect garbage (a run-time setting of this session, put back after)."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


#: Tables that written() has made and clear() has not removed, in order.
_MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: compressed, and safe when executors are lost. Results may read it until clear() removes it; what was shuffled for it goes at once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables written() has made that are still there; for clear()."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables that written() made after the first `since`, but the last `keep`: for callers that have saved what they computed."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while len(_MADE) - since > keep:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop(since))
        path.getFileSystem(conf).delete(path, True)


def rows_as(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under fixed names, so that extra or clashing columns do no harm."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def row_key(doc_id, text):
    """128 bits of a row's id and text, as bytes; a null text counts as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit("/"), F.coalesce(text.cast("string"), F.lit("")))))


def whole_row_key(docs: DataFrame):
    """128 bits of all columns of a row, as bytes."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    half = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return F.unhex(F.concat(half(*columns), half(F.lit(1), *columns)))


def packed(docs: DataFrame, **more) -> DataFrame:
    """(_doc, more): all columns of a row as one struct, beside what an operator works on, so that no names clash; unpacked() undoes it."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_doc"), *(c.alias(name) for name, c in more.items()))


def unpacked(docs: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns that packed() put together; those in new are replaced."""
    return docs.select(*((new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in columns))
