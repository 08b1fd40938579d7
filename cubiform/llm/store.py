"""Lineage cuts that survive lost executors, and the few session settings the operators rely on."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import cubiform

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(cubiform)

#: Most bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20
#: Spark's setting that removes the shuffle files of a query when the query ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: Arrow batches bounded by bytes, so that very long texts don't pile up in a

    Python worker; and run-time filters on scans of any size, so that a join with a selective side
    drops rows before they are shuffled.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    return spark


class Shared:
    """A broadcast value whose classes travel with it."""

    def __init__(self, spark: SparkSession, value: object):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self) -> object:
        return pickle.loads(self._sent.value)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that spark.checkpoint.dir names.

    Where none is named, a local master gets a temporary one; on a cluster that is an error, as
    executors don't see each other's disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/cubiform-{context.applicationId}"
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="cubiform-")
        atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
    return _local[context.applicationId]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and safe when executors go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def freed(df: DataFrame, name: str = "cut") -> DataFrame:
    """cut(), and the shuffle files behind it go at once.

    Spark else keeps them until the driver happens to collect its garbage. Nothing reads them again:
    each write is planned anew, with shuffles of its own.
    """
    conf = df.sparkSession.conf
    was = conf.get(FREES, "false")
    conf.set(FREES, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(FREES, was)


def without(docs: DataFrame, doc_id: str, gone: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """docs without the rows whose id is in gone, of which one column, doc_id, holds each id once; null ids stay.

    Rows are not shuffled for it, but for few. Ids are hashed into a bitmap with 32 bits an id, which goes
    to the executors in pieces of 4 KB; rows whose bit isn't set stay where they are. Those that are
    gone, and about one in 32 others, are looked up in gone itself. Beyond 4 million ids the bitmap
    doesn't grow, and more rows are looked up.
    """
    bits, many = 1 << 15, 32 * gone.count()
    while bits < min(many, most_bits):
        bits *= 2
    place, piece, held = (f"{unused(docs, '_gone_')}{c}" for c in ("place", "piece", "held"))
    hashed = F.pmod(F.xxhash64(ref(doc_id)), F.lit(bits))
    pieces = gone.select(hashed.alias(place)).groupBy(F.bitmap_bucket_number(ref(place)).alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ref(place))).alias(held))
    marked = docs.withColumn(place, hashed).join(F.broadcast(pieces), F.bitmap_bucket_number(ref(place)) == ref(piece), "left")
    at = F.bitmap_bit_position(ref(place))
    octet = F.conv(F.hex(F.substring(ref(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn(held, F.coalesce(F.getbit(octet, (at % 8).cast("int")) == 1, F.lit(False)))
    names = [ref(c) for c in docs.columns]
    return marked.filter(~ref(held)).select(*names).union(marked.filter(ref(held)).select(*names).join(gone, doc_id, "left_anti").select(*names))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*cuts: DataFrame) -> None:
    """Deletes written frames that nothing will read again, once all that was made of them is written, too."""
    for df in cuts:
        _delete(df.sparkSession, df._cut_path)


def clear(spark: SparkSession) -> None:
    """Deletes all written frames of this application; results not yet written elsewhere can't be read any more."""
    _delete(spark, shared_folder(spark))


def release() -> None:
    """Gives memory that earlier tasks of a reused worker left behind back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow for frames with any column names; function sees the names that df has."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from function(batch.rename_columns(names) for batch in batches)
        release()

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


def output_schema(docs: DataFrame, keep: list[str], made: str) -> StructType:
    """The kept columns as they are, then those that an operator makes, given as DDL."""
    return StructType([docs.schema[c] for c in keep] + StructType.fromDDL(made).fields)


def unused(docs: DataFrame, prefix: str) -> str:
    """A prefix that no column of docs begins with."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def shielded(docs: DataFrame, made: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with those columns renamed that an operator would overwrite, and how to name them back."""
    prefix = unused(docs, "_own_")
    clash = {c: f"{prefix}{c}" for c in docs.columns if c.lower() in {m.lower() for m in made}}
    return docs.select(*(ref(c).alias(clash.get(c, c)) for c in docs.columns)), {v: k for k, v in clash.items()}


def unshielded(df: DataFrame, columns: list[str], back: dict[str, str]) -> DataFrame:
    """The named columns, under their own names again."""
    inner = {v: k for k, v in back.items()}
    return df.select(*(ref(inner.get(c, c)).alias(c) for c in columns))
