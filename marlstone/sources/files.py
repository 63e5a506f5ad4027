"""Files as relations with declared types: Parquet, CSV, JSON lines, media folders, GeoJSON, JDBC."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..types import Field

RESCUED = "_rescued_data"


def declared(fields: list[Field]) -> T.StructType:
    return T.StructType([f.to_spark() for f in fields])


def _as_text(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in fields if f.name != RESCUED])


def typed(text: DataFrame, fields: list[Field]) -> DataFrame:
    """Columns of text as their declared types. With a _rescued_data field a value that doesn't fit is
    null and its text kept there, by column; without one the read stops at it."""
    rescue = any(f.name == RESCUED for f in fields)
    cols, bad = [], []
    for f in fields:
        if f.name == RESCUED:
            continue
        kind, c = ty.to_spark(f.type), F.col(f"`{f.name}`")
        if isinstance(kind, T.BinaryType):
            cols.append(F.unbase64(c).alias(f.name))
            continue
        cast = c.try_cast(kind) if rescue else c.cast(kind)
        cols.append(cast.alias(f.name))
        bad.append(F.when(c.isNotNull() & cast.isNull(), F.struct(F.lit(f.name).alias("k"), c.alias("v"))))
    if rescue:
        entries = F.filter(F.array(*bad), lambda x: x.isNotNull())
        cols.append(F.when(F.size(entries) > 0, F.to_json(F.map_from_arrays(F.transform(entries, lambda x: x["k"]), F.transform(entries, lambda x: x["v"])))).alias(RESCUED))
    return text.select(*cols)


def read_csv(spark: SparkSession, path: str, fields: list[Field], header: bool = True, separator: str = ",") -> DataFrame:
    """An empty field is null unless it is quoted: then it is the empty text."""
    # an empty field reads as nullValue, a quoted one as emptyValue: a text that no file has tells them apart
    options = {"header": header, "sep": separator, "mode": "FAILFAST", "nullValue": "\u0001null\u0001", "emptyValue": "", "enforceSchema": True, "multiLine": True, "escape": '"'}
    text = spark.read.options(**options).schema(_as_text(fields)).csv(path)
    return typed(text, fields)


def read_jsonl(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    return typed(spark.read.options(mode="FAILFAST", primitivesAsString=True).schema(_as_text(fields)).json(path), fields)


def read_parquet(spark: SparkSession, path: str, fields: list[Field] | None = None) -> DataFrame:
    """Columns by name, cast to what is declared; partition folders k=v are columns and are pruned."""
    df = spark.read.parquet(path)
    if fields is None:
        return df
    if missing := [f.name for f in fields if f.name not in df.columns]:
        raise ValueError(f"no column {missing[0]} in {path}")
    return df.select(*[F.col(f"`{f.name}`").cast(ty.to_spark(f.type)).alias(f.name) for f in fields])


def infer_text_columns(df: DataFrame, order: tuple[str, ...] = ("Integer", "Decimal<38,18>", "Boolean", "Date", "DateTime")) -> list[Field]:
    """The narrowest type that every value of a text column fits, all columns in one pass. One value
    that doesn't fit keeps the whole column as text."""
    checks = [F.sum(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(ty.to_spark(ty.parse(t))).isNull(), 1).otherwise(0)).alias(f"{i}_{j}") for i, c in enumerate(df.columns) for j, t in enumerate(order)]
    seen = df.agg(*checks).first()
    return [Field(c, ty.parse(next((t for j, t in enumerate(order) if seen[f"{i}_{j}"] == 0), "String"))) for i, c in enumerate(df.columns)]


def media_items(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """A folder as a media collection: one row per file with its reference, size and digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digest = F.sha2(F.col("content"), 256)
    return files.select(
        F.struct(F.lit(collection).alias("collection"), F.col("path"), digest.alias("version"), digest.alias("digest")).alias("_item"),
        "path",
        digest.alias("digest"),
        F.col("length").alias("size"),
        F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"),
        F.col("modificationTime").alias("modified"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features with their geometry as WKB and properties as JSON text. A file is one task's."""
    from ..functions import geo

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for content in batch.column(0):
                doc = json.loads(content.as_py())
                features = doc["features"] if doc.get("type") == "FeatureCollection" else [doc]
                rows = [(str(f["id"]) if "id" in f else None, geo.encode(geo.from_geojson(f["geometry"])) if f.get("geometry") else None, json.dumps(f.get("properties") or {})) for f in features]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["id", "geometry", "properties"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, "id string, geometry binary, properties string")


def read_jdbc(spark: SparkSession, url: str, request, dialect: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A request to a database, run there: its filters, order and limit are in the text that is sent.
    partition: numeric column, low, high, number of readers. What to connect with (driver, user) are
    options; any database with a JDBC driver and one of the dialects will do."""
    from .request import Request, to_sql

    assert isinstance(request, Request)
    text, _ = to_sql(request, dialect, inline=True)
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        col, low, high, n = partition
        return reader.option("dbtable", f"({text}) q").option("partitionColumn", col).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()
    return reader.option("query", text).load()


def _swapped(df: DataFrame, path: str) -> None:
    """Write df beside path, and only when it is whole put it in its place. A crash between the two
    renames leaves both the old table (path.before) and the new one (path.next) whole."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    now, after, before = (hadoop(path + end) for end in ("", ".next", ".before"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".next")
    fs.delete(before, True)
    if not (fs.rename(now, before) and fs.rename(after, now)):
        raise OSError(f"{path} could not be swapped")
    fs.delete(before, True)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """overwrite, append, or upsert by key: the new content, written beside the old and then returned.
    A table without columns, a column of type null, and a list of lists are refused."""
    if not df.columns:
        raise ValueError("no columns")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NullType):
            raise ValueError(f"{f.name} has no type")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType):
            raise ValueError(f"{f.name} is a list of lists")
    if mode in ("overwrite", "append"):
        df.write.mode(mode).parquet(path)
    elif mode == "upsert":
        if not key:
            raise ValueError("upsert takes a key")
        twice = df.groupBy(*key).count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError("a key comes twice")
        old = df.sparkSession.read.parquet(path)
        merged = old.join(df.select(*key), key, "left_anti").unionByName(df.select(*old.columns))
        _swapped(merged, path)
    else:
        raise ValueError(f"no mode {mode}")
    return df.sparkSession.read.parquet(path)
