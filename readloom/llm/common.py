"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.plans.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and executors are threads of
    this machine, a folder of our own; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = own = tempfile.mkdtemp(prefix="readloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + _OWN[context.applicationId]


#: What has been stored in each open ``scratch``.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that are stored inside are removed at the end; but those given to what this yields."""
    own: list[DataFrame] = []
    _SCRATCH.append(own)
    kept: list[DataFrame] = []

    def keep(one: DataFrame) -> DataFrame:
        kept.append(one)
        return one

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        discard(*(x for x in own if not any(x is k for k in kept)))
        if _SCRATCH:
            _SCRATCH[-1].extend(kept)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and the loss of an
    executor costs only a re-read. The table is removed by ``discard``, or when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def remove(jvm=spark.sparkContext._jvm, conf=spark.sparkContext._jsc.hadoopConfiguration()):
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session has ended before us; its owner clears the folder
            pass

    atexit.register(remove)
    out = spark.read.schema(df.schema).parquet(path)
    out._discard = remove
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for one in tables:
        one._discard()
        atexit.unregister(one._discard)
        for held in _SCRATCH:
            held[:] = [x for x in held if x is not one]


def fresh(df: DataFrame, name: str) -> str:
    """A column's name that the input doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, id_col: str, value_col: str, value: str) -> tuple[DataFrame, DataFrame | None]:
    """((doc_id bigint, value) of the rows without nulls, names). Whole-number ids are their own numbers; others
    (strings, say) get numbers in their order, and names has (id, doc_id)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).alias(value)).where(F.col("id").isNotNull() & F.col(value).isNotNull())
    if dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        return rows.select(F.col("id").cast("bigint").alias("doc_id"), value), None
    names = stored(rows.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("doc_id")), "names")
    return rows.join(sized(names, 64), "id").select("doc_id", value), names


def renamed(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """The result with the ids in place of their numbers."""
    if names is None:
        return df
    order = df.columns
    for c in columns:
        df = df.withColumnRenamed(c, "__number").join(sized(names.select(F.col("id").alias(c), F.col("doc_id").alias("__number")), 64), "__number").drop("__number")
    return df.select(*order)


def give_back() -> None:
    """Return the memory that a finished task has freed: workers live on, several to an executor, and what one
    keeps for itself is missing to the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_batches(df: DataFrame, work, schema: str) -> DataFrame:
    reachable(df.sparkSession)

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def in_groups(grouped, work, schema: str) -> DataFrame:
    def run(*args):
        try:
            return work(*args)
        finally:
            give_back()

    # Spark looks at the number of parameters: a key comes first if there is one more
    if len(inspect.signature(work).parameters) == 2:
        return grouped.applyInArrow(lambda a, b: run(a, b), schema)
    return grouped.applyInArrow(lambda a: run(a), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, without making Python strings. Null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """Split a batch so that a slice holds about ``most`` bytes of text (one row at least)."""
    sizes = np.diff(utf8(batch.column(column))[1])
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    first = np.cumsum(lengths) - lengths
    out[first[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    out[0] = starts[0]
    return np.cumsum(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Sides of joins are broadcast up to this size, which is counted first; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, bytes_per_row: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """The smaller side of a join, already stored: broadcast if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() * bytes_per_row <= most else df.hint("shuffle_hash")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest type that holds them; the first byte names it."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k, bits in (("B", 8), ("H", 16), ("I", 32), ("Q", 64)) if top < 1 << bits)
    return kind.encode() + values.astype(kind).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, chr(raw[0]), offset=1).astype(np.uint64 if raw[:1] == b"Q" else np.int64)
