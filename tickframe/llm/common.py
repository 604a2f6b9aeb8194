"""What the training-data operators share: the shared folder, word splitting, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of ASCII digits, ASCII letters and non-ASCII characters, compared without ASCII case.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

#: A key that more than one in so many rows hold counts as hot; there are fewer such keys than this.
HOT_KEYS = 4_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes, A-Z lower-cased; a null text has none. Lone surrogates cannot occur in Spark strings."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def give_back() -> None:
    """Return what this process freed to the system: a Python worker lives on between tasks, and its allocators keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back at the end of each task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or a local folder where that is unset (tests).

    This application's checkpoints in it go when the driver ends.
    """
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not told:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            told = tempfile.mkdtemp(prefix="tickframe-checkpoints-")
        context.setCheckpointDir(told)
    own = context._jsc.sc().getCheckpointDir().get()  # a folder of this application alone, below the one that was set
    if getattr(context, "_tickframe_checkpoints", None) != own:
        context._tickframe_checkpoints = own
        _remove_at_exit(spark, own)
    return told or own


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more, such as a round that the next one replaced."""
    try:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    except Exception:  # noqa: BLE001 - not a settled frame: there is nothing to delete
        return
    _deleter(df.sparkSession, path)()


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for a new table in the shared folder; unless kept, it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _remove_at_exit(spark, path)
    return path


def _deleter(spark: SparkSession, path: str):
    """A function that deletes a folder by Spark's own file system access, also after the session was stopped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)

    def delete() -> None:
        try:
            files.delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass

    return delete


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_deleter(spark, path))


def join_counted(big: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small (one row per key, with the number of big's rows that hold the key in column count) on key.

    Keys that more than one in HOT_KEYS of big's `total` rows hold are broadcast: there are fewer than HOT_KEYS of
    them, whatever the size. The rest are dealt by key, so no task gets more than that share by one key. big is read
    twice, so it should be settled or cheap. how: inner or left.
    """
    hot = small.filter(F.col(count) * HOT_KEYS > total)
    few = small.filter(F.col(count) * HOT_KEYS <= total)
    near = big.join(F.broadcast(hot), key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(few, key, how)
    return near.unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id) -> Column:
    """crc32 of the id as text, modulo 3; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Numbers that one step of prefix_sums adds up before its list joins the others.
SUM_BLOCK = 128


def prefix_sums(numbers: Column) -> Column:
    """The running totals of an array of numbers, as an array<bigint>. Totals are gathered by blocks, so that long arrays are not copied at every step."""
    none = F.array().cast("array<bigint>")
    n = F.size(numbers)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(SUM_BLOCK)), lambda at: F.slice(numbers, at + 1, SUM_BLOCK))

    def one(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.concat(state["own"], F.array(total)).alias("own"))

    def block(state: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(state["total"].alias("total"), none.alias("own")), one)
        return F.struct(done["total"].alias("total"), F.concat(state["all"], F.array(done["own"])).alias("all"))

    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.flatten(F.aggregate(blocks, zero, block)["all"])


def fresh(names: list[str]) -> str:
    """A column name that is none of names, whatever their case."""
    name, taken = "own_", {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name
