"""Shared plumbing: run a function over whole texts, a few megabytes at a time.

Rows reach Python in Arrow batches of bounded bytes; each batch is cut into slices,
so memory follows the longest text and not the number of rows. Null texts arrive
as "", an empty table gives an empty one, repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that are handled at once (a longer single text is one slice).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python (a longer single row is one batch).
BATCH_BYTES = 1 << 21


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n, at = len(texts), texts.offset
    _, offsets, data = texts.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each."""
    _, off = buffers(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield batch.slice(first, last - first)
        first = last


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def freed() -> None:
    """Give memory that a finished task no longer uses back to the system: workers live on, and allocators keep what they once had."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_texts(docs: DataFrame, id_col: str, text_col: str, start: Callable, schema: str | T.StructType) -> DataFrame:
    """Apply ``start()(ids, texts) -> {column: values}`` to slices of (id, text).

    ``start`` runs once a task, so it may build tables. Only the two columns are
    read; other columns of ``docs`` can have any name. Null texts arrive as "".
    """
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(batches):
        work, out = start(), arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).fill_null("")
                cols = work(part.column(0), texts)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in out for c in [cols[f.name]]], schema=out
                )
        del work  # with its tables
        freed()

    small_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, schema)


def text_column(docs: DataFrame, text_col: str, start: Callable, kind: str) -> Column:
    """A column of ``docs``: what ``start()(texts) -> values`` makes from slices of a text column.

    Only the texts go to Python and only the values come back; the other columns
    stay where they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    arrow = arrow_schema(T._parse_datatype_string(f"value {kind}")).field(0).type

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")
            done = [work(part.column(0).fill_null("")) for part in parts]
            done = [x if isinstance(x, pa.Array) else pa.array(x, arrow) for x in done]
            yield pa.concat_arrays(done) if done else pa.array([], arrow)
        del work
        freed()

    return F.arrow_udf(run, kind)(F.col(text_col).cast("string"))


#: Rows of at most a few numbers each that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded(small: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, stored and counted; marked for broadcast only where it has few rows."""
    small = stored(small, name)
    return F.broadcast(small) if small.count() <= most else small


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir.

    Where that is unset, only a session that runs on one machine gets a local folder.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a finished query are deleted at once.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder (with the writer's options) and read it again: cuts the lineage, survives lost executors.

    Nothing reads the shuffles of the write again once the table is there, so their
    files go with it instead of waiting for the driver to collect its garbage. The
    session's own setting holds again afterwards.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
