"""Files in and out: CSV, JSON lines, text, images, snapshots, resuming."""

from __future__ import annotations

import time
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CONCEPTS = "entity string, importance int, category string, chunk_id string, type string"
RELATIONSHIPS = "node_1 string, node_2 string, edge string, weight double, chunk_id string, source string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by a given schema; a missing path gives an empty table of that schema. A byte-order mark is skipped by the reader."""
    try:
        return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.csv(path, header=True, mode=mode, escape='"', emptyValue="")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that exists, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    return None


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, a missing path gives an empty table."""
    try:
        return spark.read.json(path, schema=schema, mode="DROPMALFORMED")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="append")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, name, text of whole files."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "text")


def scan_binary(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, name, size, hash and content of files such as papers, for a provider that reads them."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.md5("content").alias("hash"), "content")


def needs_ocr(pages: DataFrame, least: float = 50, first: int = 3) -> DataFrame:
    """paper, scanned: the first pages hold pictures and under `least` characters on average. pages: paper, page, n_chars, n_images."""
    return pages.where(F.col("page") <= first).groupBy("paper").agg(((F.avg("n_chars") < least) & (F.sum("n_images") > 0)).alias("scanned"))


def lines_above(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Recognised lines (paper, page, line, text, confidence) above a confidence."""
    return lines.where(F.col("confidence") > least)


def pictures(images: DataFrame, width: int = 100, height: int = 100, per_paper: int = 50) -> DataFrame:
    """Pictures large enough, the first of each paper by page and place. images: paper, page, idx, width, height."""
    from boscograph.operators.graph import top_per_group

    big = images.where((F.col("width") >= width) & (F.col("height") >= height))
    return top_per_group(big, "paper", [F.col("page"), F.col("idx")], per_paper)


def top_label(scores: DataFrame) -> DataFrame:
    """image_path, label of the highest probability, the smallest label of ties. scores: image_path, label, probability."""
    return scores.groupBy("image_path").agg(F.min_by("label", F.struct(-F.col("probability"), "label")).alias("label"))


def uncached(df: DataFrame, cache: DataFrame, content: str) -> DataFrame:
    """Rows whose content (by hash) isn't in the cache (hash)."""
    return df.withColumn("hash", F.md5(F.col(content))).join(cache.select("hash"), "hash", "left_anti")


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def snapshot(df: DataFrame, root: str, name: str, stamp: str | None = None) -> str:
    """A dated copy of a table under root; returns its path."""
    stamp = stamp or time.strftime("%Y%m%d_%H%M%S", time.gmtime())
    path = f"{root}/{name}/{stamp}"
    df.write.parquet(path, mode="errorifexists")
    return path


def snapshots(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of the dated copies, the oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(PurePosixPath(root) / name / s.getPath().getName()) for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))) if fs.exists(at) else []


def restore(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The newest copy, or an empty table of the schema."""
    found = snapshots(spark, root, name)
    return spark.read.parquet(found[-1]) if found else spark.createDataFrame([], schema)


def clear(spark: SparkSession, root: str, name: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bulk_files(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type) and relations (head, relation, tail, confidence by id) for bulk loading; the last id of a name counts, ends without node drop out."""
    ids = concepts.groupBy("name").agg(F.max_by("id", "ord").alias("id"), F.max_by("type", "ord").alias("type"))
    a, b = ids.select(F.col("name").alias("head"), F.col("id").alias("head_id")), ids.select(F.col("name").alias("tail"), F.col("id").alias("tail_id"))
    rel = edges.join(a, "head").join(b, "tail").select("head_id", "relation", "tail_id", "confidence")
    return ids.select("id", "name", "type"), rel


def log_problems(lines: DataFrame, last: int = 5) -> tuple[DataFrame, DataFrame]:
    """(errors, timeouts) counted over log lines (line_no, line), and the last errors."""
    error = F.col("line").contains("ERROR")
    late = F.col("line").contains("WARNING") & F.lower("line").contains("timeout")
    return lines.agg(F.count_if(error).alias("errors"), F.count_if(late).alias("timeouts")), lines.where(error).orderBy(F.desc("line_no")).limit(last)
