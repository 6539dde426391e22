"""A stream of chunks through an extractor, each chunk once, whatever dies in between."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.encoding import extract
from graphloom.sources.tables import exists

DONE = "chunk_id string, found array<struct<id:string,type:string,text:string,ord:int>>, batch string"


def written(rows: DataFrame, out: str, batch: str) -> None:
    """A batch's rows as the folder of its name: a second attempt puts its rows in place of the first's."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def done(spark, out: str) -> DataFrame:
    """(chunk_id, found, batch) of all chunks done so far."""
    return spark.read.schema(DONE).option("basePath", out).parquet(out) if exists(spark, out) else spark.createDataFrame([], DONE)


def extraction_stream(chunks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's chunks (chunk_id, text) that no other batch has done are extracted and written to out, one row a chunk with what was found.

    A row is result and progress in one, and a batch is a folder named by the stream's id, which its checkpoint keeps, and its number. So whatever the
    stream dies between, the batch that it repeats replaces its own rows, and a new stream with another checkpoint leaves out what is done. A chunk that
    comes twice in a batch is done once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        own = f"{stream}-{number}"
        others = done(spark, out).filter(F.col("batch") != own).select("chunk_id")
        todo = batch.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).join(others, "chunk_id", "left_anti")
        found = extract(todo).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "text", "ord"))).alias("found"))
        none = F.array().cast("array<struct<id:string,type:string,text:string,ord:int>>")
        written(todo.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", F.coalesce("found", none).alias("found")), out, own)

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark, out: str) -> DataFrame:
    """(chunk_id, id, type, text, ord) of everything found."""
    return done(spark, out).select("chunk_id", F.explode("found").alias("x")).select("chunk_id", "x.*")
