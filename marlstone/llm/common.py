"""What the operators share: lineage cuts in the shared folder, and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import released_at_end

#: White space of every word and normalisation rule here: space and \t \n \v \f \r, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where unset (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _own_folder[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later plans start there, so what
    a lost executor held is read again, and nothing above the cut is computed twice."""
    spark = df.sparkSession
    path = f"{_own_cuts(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: set[str] = set()


def _own_cuts(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends, if not before."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if path not in _made:
        released_at_end(spark, path)
        _made.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete this application's cuts, once no DataFrame that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], wish: str) -> str:
    """wish, with underscores put before it until no column has that name in any case."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish = "_" + wish
    return wish


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text. bytes.split() cuts at exactly the six characters of SPACE_CLASS."""
    return text.split() if text else []


def join_apart(left: DataFrame, grouped: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with groups made of its own rows, by long keys.

    A join straight above an aggregation keeps the aggregation's partitions, and then a hot key of
    the left side can't be split. The first key is joined as an expression that Spark doesn't see
    through, so both sides are dealt anew and AQE splits what is hot.
    """
    hide = F.col(keys[0]).bitwiseXOR(F.lit(1))
    a, b = left.withColumn("__j", hide), grouped.withColumn("__j", hide).drop(keys[0])
    return a.join(b, ["__j", *keys[1:]], how).drop("__j")


def row_name(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that name a row by all its columns; rows that are alike in all have one name."""
    return F.xxhash64(*df.columns), F.xxhash64(F.lit(7), *reversed(df.columns))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def values(column: pa.Array) -> Iterator:
    """Values of a column one at a time, so that a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """Texts as their UTF-8 bytes, one at a time."""
    return values(pc.cast(column, pa.binary()))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
