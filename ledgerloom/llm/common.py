"""What the operators of this subpackage share: word grammar, written stages and row identity."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.functions.stages import shared_dir

#: Blanks that part words; a word is a run of other characters.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def sql_regex(pattern: str) -> str:
    """A Spark SQL string literal of a regular expression."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_sql(text: str) -> str:
    """Spark SQL for the array of words of a text expression."""
    return f"filter(split({text}, {sql_regex(BLANKS)}), x -> x <> '')"


def text_udf(kind, values, rows: int = 128):
    """An Arrow UDF of type ``kind`` over a text column.

    ``values(texts)`` gives a list for a list of texts.  It sees ``rows`` texts at a time, so that a worker never holds a
    whole batch as Python strings.
    """
    target = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(values(texts.slice(i, rows).to_pylist()), type=target) for i in range(0, len(texts), rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=target)

    return run


def repeated(df: DataFrame, times: str, into: str, chunk: int = 10_000) -> DataFrame:
    """Each row of ``df`` as often as the SQL ``times`` says, numbered from 1 in ``into``; never a long list in one row."""
    parts = df.withColumn("__part", F.explode(F.expr(f"sequence(0L, (cast({times} as bigint) - 1) div {chunk})")))
    each = F.expr(f"sequence(__part * {chunk} + 1, least(cast({times} as bigint), (__part + 1) * {chunk}))")
    return parts.withColumn(into, F.explode(each)).drop("__part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def _writing(spark: SparkSession, batch_rows: int | None):
    """What is run inside drops its shuffle files when it ends, as nothing reads them once its table is written.

    ``batch_rows``: rows that Python workers are given at a time, where rows are large.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a table written in the shared folder: it cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _writing(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str, batch_rows: int | None = None) -> DataFrame:
    """``written``, dealt to files by ``key``: joins on it move the other side alone.

    There are as many buckets as shuffles have partitions.  Tasks write their own rows, without a shuffle.  The catalogue holds the table only until it is read.
    """
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    with _writing(spark, batch_rows):
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out.written_path = path
    return out


_GROUP_ROWS = 512


def release() -> None:
    """Gives what a Python worker has freed back to the system: workers live on between tasks, beside the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def _packed(chars: int, prepare):
    def of(batches):
        """Rows (row, id, t) to groups: (grp, ids, blob), blob an Arrow stream of (row, t)."""
        task, number = TaskContext.get().partitionId() << 24, 0
        ids, sink, out, size = [], None, None, 0

        def group() -> pa.RecordBatch:
            out.close()
            lists, blob = pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type)), sink.getvalue()
            blob = pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, blob.size], pa.int32()).buffers()[1], blob])
            return pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), lists, blob], ["grp", "ids", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, _GROUP_ROWS):
                part = batch.slice(at, _GROUP_ROWS)
                texts = part.column("t").cast(pa.string())
                if prepare is not None:
                    texts = pa.array([prepare(t) for t in texts.to_pylist()], pa.string())
                # Copied, or else it keeps its whole batch, and compressed at once: a group is held as its blob alone.
                ids.append(pa.concat_arrays([part.column("id"), part.column("id").slice(0, 0)]))
                part = pa.RecordBatch.from_arrays([part.column("row"), texts], ["row", "t"])
                if out is None:
                    sink = pa.BufferOutputStream()
                    out = pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6)))
                out.write_batch(part)
                size += texts.nbytes
                if size >= chars:
                    yield group()
                    ids, sink, out, size, number = [], None, None, 0, number + 1
                    release()
        if out is not None:
            yield group()
            ids, sink, out = [], None, None
        release()

    return of


def packed_groups(df: DataFrame, text: str, keep: tuple[str, ...] | None, chars: int, name: str, prepare=None) -> DataFrame:
    """``grp, ids, blob``: the rows of ``df`` (doc_id, ...) in groups of about ``chars`` characters, a compressed row each,
    bucketed by group.  A task packs what it reads, without a shuffle, and later joins by group move no text.

    ``keep``: the columns that ``blob`` holds besides the texts, all if None; ``prepare``: what is done to each text.
    """
    row = F.struct(*[df[c] for c in (df.columns if keep is None else keep)])
    rows = df.select(row.alias("row"), F.col("doc_id").alias("id"), F.col(text).alias("t"))
    kind = T.StructType([T.StructField("grp", T.LongType()), T.StructField("ids", T.ArrayType(df.schema["doc_id"].dataType)), T.StructField("blob", T.BinaryType())])
    return bucketed(rows.mapInArrow(_packed(chars, prepare), kind), "grp", name, batch_rows=1000)


def group_parts(blob: pa.Scalar):
    """The record batches (row, t) of a group, one at a time."""
    return pa.ipc.open_stream(pa.py_buffer(blob.as_buffer()))


def group_texts(blob: pa.Scalar):
    for part in group_parts(blob):
        yield from part.column("t").to_pylist()


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote; for tables that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
