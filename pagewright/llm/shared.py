"""Helpers of the operators here: stored tables, Arrow batches, column bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import run_folder

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java pattern.
GAPS = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch: whole texts travel in it, so it is kept small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder of the cluster's shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a read, not the work before it.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str) -> DataFrame:
    """Run `work` on Arrow batches of at most BATCH_ROWS rows; it returns the columns of `schema` for each."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    names, types = zip(*(part.rsplit(" ", 1) for part in schema.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([pa.field(n, kinds[t]) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            if made.num_rows:
                yield made

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once per row and then used many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def by_slice(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str) -> DataFrame:
    """Run `work` on slices of at most BATCH_ROWS rows; it returns the columns of `schema` for each.

    Spark bounds its Arrow batches in bytes (64 MB) and the slices share their memory, so no setting of the
    session changes. A row longer than that bound is a batch of its own.
    """
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([pa.field(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = work(batch.slice(at, BATCH_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
