"""Writers. None of them funnels the data through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.text import one_line


def write_table(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 0) -> None:
    """Parquet. ``rows_per_file`` bounds file size instead of a single-file merge."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_text_corpus(df: DataFrame, text_col: str, path: str) -> None:
    """One text per line; line breaks inside a text become blanks."""
    df.select(one_line(F.col(text_col)).alias("value")).write.text(path)


def write_shards(df: DataFrame, path: str) -> None:
    """Folders ``split=…/shard=0000``; rows of a shard are brought together first."""
    df.repartition("split", "shard").write.partitionBy("split", "shard").parquet(path)


def write_csv_results(df: DataFrame, path: str) -> None:
    """CSV with header; list columns are written as JSON text."""
    cols = [
        F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.csv(path, header=True)


def prediction_json(ids: str):
    return F.to_json(F.struct(F.col(ids).alias("affiliation_id")))


def write_json_predictions(df: DataFrame, ids: str, path: str) -> None:
    """One ``{"affiliation_id": [...]}`` record per line."""
    df.select(prediction_json(ids).alias("value")).write.text(path)
