"""Reading and writing documents, splits, samples and results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from maskloom.sources.files import save_file

# Texts hold line breaks, quotes and blanks at the ends; the defaults would change all three.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": r"\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_NOTHING = {"model": None, "results": {}}


def read_csv(spark: SparkSession, path: str, schema: ST.StructType, separator: str = ";") -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).option("sep", separator).option("multiLine", "true").csv(path)


def write_csv(df: DataFrame, path: str, separator: str = ";", rows_per_file: int = 1_000_000) -> None:
    """Files of bounded size: texts with line breaks make a file readable by one task only."""
    df.write.options(**_CSV).option("sep", separator).option("maxRecordsPerFile", rows_per_file).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that readers of one split open only its files."""
    df.write.partitionBy("split").option("compression", "snappy").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def write_sample(df: DataFrame, path: str, column: str = "text") -> None:
    """A sample as JSON lines, characters unescaped."""
    df.select(F.to_json(F.struct(F.col(column).alias("text"))).alias("value")).write.text(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A sample written as JSON lines."""
    return spark.read.schema("text string").json(path)


def read_sample_array(spark: SparkSession, path: str) -> DataFrame:
    """A sample kept as one JSON array of strings per file.

    The format has no line breaks to split at, so a file is read by one task and must stay below 2 GB.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", "array<string>")).alias("text"))


def write_results(df: DataFrame, path: str) -> None:
    """One JSON line per row: (model, sample, text, ppl), or the losses of a checkpoint."""
    df.write.json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result files to one row per text."""
    files = spark.read.text(path, wholetext=True)
    return explode_results(files, "value")


def read_result_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_results`` wrote, one row per line."""
    return spark.read.schema(schema).json(path)


def explode_results(df: DataFrame, column: str) -> DataFrame:
    """One row per text of a JSON column that holds a model and a map from text to score.

    The texts are the names, and the JVM parser refuses names of more than 50,000 characters, so each document is
    parsed once in Arrow batches. A null document gives no rows; broken JSON fails.
    """
    rest = [c for c in df.columns if c != column]
    schema = ST.StructType(
        [
            *[df.schema[c] for c in rest],
            ST.StructField("model", ST.StringType()),
            ST.StructField("text", ST.StringType()),
            ST.StructField("ppl", ST.DoubleType()),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.loads(text) if text is not None else _NOTHING for text in batch.column(column).to_pylist()]
            rows = [(i, d.get("model"), text, s["ppl"]) for i, d in enumerate(found) for text, s in d["results"].items()]
            at, models, texts, scores = zip(*rows) if rows else ((), (), (), ())
            kept = batch.select(rest).take(pa.array(at, pa.int64()))
            columns = [*kept.columns, pa.array(models, pa.string()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*rest, column).mapInArrow(parse, schema)


def write_statistics(df: DataFrame, path: str) -> None:
    """Statistics as CSV, one folder per model and sample."""
    df.write.partitionBy("model", "sample").option("header", "true").csv(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stat string, value double, model string, sample string").option("header", "true").csv(path)


def write_statistics_files(df: DataFrame, path: str) -> list[str]:
    """One plain file ``{model}_{sample}_stats.csv`` per model and sample, as other tools expect it.

    Each group is a few rows of statistics, written by the task that holds it. Returns the names.
    """

    def write(key: tuple, table: pa.Table) -> pa.Table:
        name = f"{key[0].as_py()}_{key[1].as_py()}_stats.csv".replace("/", "-")
        rows = sorted(zip(table.column("stat").to_pylist(), table.column("value").to_pylist()))
        text = "stat,value\n" + "".join(f"{s},{'' if v is None else repr(v)}\n" for s, v in rows)
        save_file(f"{path}/{name}", text.encode())
        return pa.table({"name": [name]})

    few = df.select("model", "sample", "stat", F.col("value").cast("double").alias("value"))
    done = few.groupBy("model", "sample").applyInArrow(write, "name string")
    return sorted(r["name"] for r in done.collect())
