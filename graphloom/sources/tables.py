"""Readers and writers of the engine's artefacts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunks array<struct<section_id string, section_title string, ata string, level int, page_start int, page_end int, chunk_id string, text string, word_count int, chunk_seq int, global_seq int>>"
DATASET = "entities array<struct<id string, type string, name string, text string, title string, description string, ata string, source_chunks array<string>>>, relationships array<struct<source string, target string, type string, source_chunk string>>"
COMMUNITIES = "id string, size int, ata_chapters array<string>, ata_names array<string>, summary string, member_ids array<string>"
QUESTIONS = "id string, query string, expected_keywords array<string>, reference_answer string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir. Where that is unset the warehouse, if it lies in a store or all runs on one machine; else nothing is known to be shared, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_disk = warehouse.startswith("file:") or "://" not in warehouse
    if own_disk and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return warehouse + "/graphloom-intermediate"


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, noted for sweep()."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession, since: int = 0) -> int:
    """Deletes what this session's operators wrote on the way (of it, what came after the first since paths), once no result that reads it is needed any more; the number of paths."""
    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone, held[since:] = held[since:], []
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate tables are deleted at its end; results have to be written or collected inside."""
    since = len(_SCRATCH.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        sweep(spark, since)


def settled(rows: DataFrame) -> DataFrame:
    """rows computed once, written as Parquet to the shared folder and read again: cut off from what made them. scratch() or sweep() deletes the files."""
    path = scratch_path(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def chunks_json(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CHUNKS).select(F.explode("chunks").alias("c")).select("c.*")


def dataset_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of one document."""
    whole = _json(spark, path, DATASET)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("entities", "relationships"))


def communities_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, size, ata_chapters, ata_names, summary, member_ids) of a list of communities."""
    return _json(spark, path, COMMUNITIES)


def embeddings_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of an object keyed by id."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("id", "embedding"))


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, QUESTIONS)


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf", first_only: bool = True) -> DataFrame:
    """Files under path; the first by path unless all are asked for."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.orderBy("path").limit(1) if first_only else rows


def pages_of(files: DataFrame, parse) -> DataFrame:
    """(path, page_idx, text) by a parser of bytes to texts; blank pages are left out."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                texts = [(i, t.strip()) for i, t in enumerate(parse(bytes(content)))]
                yield pd.DataFrame([(path, i, t) for i, t in texts if t], columns=["path", "page_idx", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_idx int, text string")


def write_artefact(rows: DataFrame, path: str, form: str = "parquet") -> None:
    rows.write.mode("overwrite").format(form).save(path)


def write_csv(rows: DataFrame, path: str) -> bool:
    """A CSV with a header; nothing for no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def append_progress(rows: DataFrame, path: str) -> None:
    rows.select("chunk_id", "result").write.mode("append").parquet(path)


def remaining(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks that the progress table at path doesn't hold yet."""
    spark = chunks.sparkSession
    if not exists(spark, path):
        return chunks
    return chunks.join(spark.read.parquet(path).select("chunk_id").distinct(), "chunk_id", "left_anti")
