"""Scoring as files arrive: what is row-local runs on the stream, what looks across rows runs on each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions import scoring
from ..operators import matching
from ..operators.rubric import Rubric


def scored(docs: DataFrame, rubric: Rubric, cfg: Config = Config()) -> DataFrame:
    """Coverage, calibrated score and tier of each document, on a stream or a table: a projection without state."""
    out = matching.coverage(docs, rubric)
    missing = F.size(matching.must_haves(F.col("categories"), False))
    out = out.withColumn("score", scoring.calibrated(F.col("base"), F.lit(0.0), missing, F.lit("Unknown"), F.lit(False), cfg.score))
    return out.withColumn("tier", scoring.tier(F.col("score"), cfg.score)).drop("hits", "categories")


def follow(spark: SparkSession, folder: str, schema, rubric: Rubric, table: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Appends scores of new Parquet files to a table until all that is there is done; the checkpoint makes each file count once."""
    rows = scored(spark.readStream.schema(schema).parquet(folder), rubric, cfg).select("doc_id", "score", "tier")
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh(docs: DataFrame, watermark: str = "1 hour", at: str = "arrived", content: str = "sha1") -> DataFrame:
    """The first row of each content within the watermark, so that state is bounded."""
    return docs.withWatermark(at, watermark).dropDuplicatesWithinWatermark([content])
