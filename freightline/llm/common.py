"""Helpers shared by the training-data operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from freightline.session import ensure_checkpoint_dir, scratch_path

#: Rows that one Arrow batch may hold; texts are long, so it is far below Spark's default.
BATCH_ROWS = 1000

#: ASCII white space as the word contract defines it: everything else belongs to a word.
WHITE = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch so that a batch of long texts fits a Python worker.
    A smaller setting made by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def utf8(text: str) -> bytes:
    """UTF-8 bytes; a lone surrogate, which UTF-8 cannot hold, becomes ``?``."""
    return text.encode("utf-8", "replace")


def map_batches(df: DataFrame, fn: Callable[..., Iterator[dict]], fields: Sequence[tuple[str, T.DataType]],
                inputs: Sequence[str]) -> DataFrame:
    """``fn(*columns as lists)`` yields dicts of output columns for one Arrow batch; the output rows
    need not match the input rows."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([T.StructField(n, t, True) for n, t in fields])
    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            for out in fn(*columns):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*inputs).mapInArrow(run, schema)


def append_columns(df: DataFrame, fn: Callable[..., dict], fields: Sequence[tuple[str, T.DataType]],
                   inputs: Sequence[str]) -> DataFrame:
    """Append computed columns to every row without moving any row.  ``fn(*columns as lists)``
    returns one list per new column.  Input columns with a new column's name are replaced."""
    bounded_batches(df.sparkSession)
    new = [n for n, _ in fields]
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*keep, *(T.StructField(n, t, True) for n, t in fields)])
    types = {n: to_arrow_type(t) for n, t in fields}
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = fn(*(batch.column(at(c)).to_pylist() for c in inputs))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at(n)) for n in names), *(pa.array(out[n], type=types[n]) for n in new)],
                names=[*names, *new])

    return df.mapInArrow(run, schema)


#: Removes the shuffle files of a query when it ends; a written table no longer needs them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later jobs neither recompute the
    lineage nor depend on one executor's disk.  :func:`release` deletes the table."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote, once what was made of them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(df: DataFrame) -> DataFrame:
    """The two columns every document operator needs, typed; other columns cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
