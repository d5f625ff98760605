"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis import schemas
from affinis.session import materialize


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table; naming columns keeps the others out of the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that is read in fewer tasks than there are cores before costly work on each row.

    One file may be a single row group, which only one task can read. A table
    that is cut into more tasks, because it has many files or large ones, is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def _marks(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _depth_change(text: Column) -> Column:
    opened = _marks(text, "{") + _marks(text, "[")
    return opened - _marks(text, "}") - _marks(text, "]")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number and record (JSON text) of every object in files that are JSON arrays, each read by many tasks.

    Files are read in byte ranges and cut at every closing brace, wherever it stands. A range can't know
    whether it begins inside a string or how deep: it reports its quotes and, for both cases, how its
    brackets change the depth. Sums over the reports of the ranges before give each range its start. A
    piece that closes an object just below the array ends a record; pieces of a record are joined,
    however many ranges it spans. Between ranges only one row each is summed up in one place.

    A file may hold several arrays. Elements that are no objects are left out; an empty array has none.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    rows = spark.read.option("lineSep", "}").text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("}")).alias("piece"))
    # without escaped characters, every quote begins or ends a string
    parts = F.split(F.regexp_replace("piece", r"\\.", ""), '"', -1)
    outside = lambda inside: F.aggregate(
        F.filter(parts, lambda _, i: i % 2 == inside), F.lit(0), lambda depth, part: depth + _depth_change(part))
    pieces = materialize(rows.select("*", (F.size(parts) - 1).alias("quotes"), outside(0).alias("d0"), outside(1).alias("d1")), "json-pieces")

    within = Window.partitionBy("file", "range").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = lambda start: F.when((F.col("odd") + start) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))
    reports = local.groupBy("file", "range").agg(F.sum("quotes").alias("quotes"), F.sum(change(0)).alias("c0"), F.sum(change(1)).alias("c1"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = reports.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = starts.withColumn("change", F.when(F.col("start") == 0, F.col("c0")).otherwise(F.col("c1")))
    starts = starts.select("file", "range", "start", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("deep"))

    known = local.join(starts, ["file", "range"])
    known = known.withColumn("depth", F.col("deep") + F.sum(change(F.col("start"))).over(within))
    closes = (F.col("odd") + F.col("start") + F.col("quotes")) % 2 == 0  # its brace is in no string
    known = materialize(known.select("file", "range", "at", "piece", (closes & (F.col("depth") == 1)).cast("int").alias("ends")), "json-depths")
    counts = known.groupBy("file", "range").agg(F.sum("ends").alias("ends"))
    counts = counts.select("file", "range", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("first"))
    numbered = known.join(counts, ["file", "range"]).withColumn("number", F.col("first") + F.coalesce(F.sum("ends").over(before), F.lit(0)))
    joined = numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("range", "at", "piece"))).alias("pieces"), F.max("ends").alias("ends"))
    record = F.regexp_replace(F.array_join(F.col("pieces.piece"), ""), r"^[^{]*", "")
    return joined.filter("ends = 1").select("file", "number", record.alias("record"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays as rows of ``schema``."""
    return json_array_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def read_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Institution registry: one JSON array, or one record per line with ``multi_line=False``."""
    if multi_line:
        return read_json_array(spark, path, schemas.REGISTRY)
    return spark.read.schema(schemas.REGISTRY).json(path)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a text file."""
    return spark.read.text(path).select(F.col("value").alias("term")).distinct()


def terms_from_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(F.split(text_col, "\n")).alias("term")).distinct()


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, columns: list[str],
                   sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=True).select(*columns)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with an affiliation string; numbers are read as text."""
    return spark.read.schema(schemas.REQUEST).json(path)


def request_from_json(c: Column) -> Column:
    return F.from_json(c, schemas.REQUEST)["affiliation_string"]


def parse_labels(c: Column) -> Column:
    """``a||||b`` or ``[a, b]`` to a list of ids; parts that are no number are dropped."""
    parts = F.split(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), r"\|\|\|\||,")
    return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("bigint")), lambda x: x.isNotNull())


def read_gold(spark: SparkSession, path: str, id_prefix: bool = False, sep: str = "\t") -> DataFrame:
    """Labelled strings. Leading index column ignored; ``id_prefix`` drops the id's first letter."""
    raw = T.StructType([T.StructField("row", T.StringType()), *schemas.GOLD_RAW.fields])
    df = read_delimited(spark, path, raw, schemas.GOLD_RAW.names, sep)
    paper = F.substring("paper_id", 2, 100) if id_prefix else F.col("paper_id")
    return df.withColumn("paper_id", paper.try_cast("bigint")).withColumn("labels", parse_labels(F.col("labels")))
