"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are what lies between runs of these ASCII blanks; ``bytes.split()`` splits on the same six characters.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; set here only for local sessions that name none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    base = spark.conf.get("gridrisk.local.checkpoint.dir", None)
    if not base:
        base = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("gridrisk.local.checkpoint.dir", base)
    return base


#: Rows travel to Python in batches of at most so many bytes, however long their texts; a session can name its own size.
BATCH_BYTES, BATCH_KEY, BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def in_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(task, schema) in batches bounded by bytes. Spark keeps workers for later tasks, so one gives the
    memory that it has freed back to the system when its task ends."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


#: Spark drops the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, so a lost executor costs no
    recomputation of what came before and every later pass sees the same rows. The shuffle files of the query that wrote
    it go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridrisk/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of keys are broadcast up to this many rows; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def hinted(few: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, for working columns beside any columns of the caller."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def label_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def hashable(df: DataFrame) -> list[str]:
    """Columns that xxhash64 accepts: all but those that hold maps or variants."""

    def fit(kind: T.DataType) -> bool:
        if isinstance(kind, (T.MapType, T.VariantType)):
            return False
        if isinstance(kind, T.ArrayType):
            return fit(kind.elementType)
        return not isinstance(kind, T.StructType) or all(fit(f.dataType) for f in kind.fields)

    return [f"`{f.name}`" for f in df.schema.fields if fit(f.dataType)]


#: A group's figures are broadcast where it holds one of so many equal shares of all rows or more: at most so many groups.
SHARES = 10_000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows (a stored table of total rows), left-joined to groups (stored, one row per key, ``count`` of rows each) on keys
    that may be null. Groups so large that fewer than SHARES of them fit into total are broadcast; what remains joins by a
    shuffle in which no key has more rows than such a share."""
    least, marks = total // SHARES + 1, {k: f"group_{k}" for k in keys}
    groups = groups.withColumnsRenamed(marks)
    heavy, light = F.broadcast(groups.where(F.col(count) >= least)), groups.where(F.col(count) < least)
    same = [F.col(k).eqNullSafe(F.col(mark)) for k, mark in marks.items()]
    found, rest = rows.join(heavy, same), rows.join(heavy, same, "left_anti")
    return found.unionByName(rest.join(light, same, "left")).drop(*marks.values())
