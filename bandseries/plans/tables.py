"""The shared tables seen as the library's own: observations, feature rows, scored rows; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import lookup
from ..operators.align import relative_time

BAND_OF = {"view": "g", "click": "r", "purchase": "i", "signup": "z"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: objects are users, hours since the user's first event, band `u` for unknown."""
    e = table(spark, sf_dir, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select(
        F.col("user_id").alias("object_id"), seq.alias("seq"), "event_id", F.col("_us").alias("time"),
        F.coalesce(lookup(BAND_OF, F.col("event_type")), F.lit("u")).alias("band"), F.col("value").alias("flux"),
        F.get_json_object("props", "$.k").try_cast("double").alias("flux_err"),
    )
    return relative_time(rows, norm=3.6e9)


OBS = """
    obs AS (
        SELECT user_id AS object_id, CAST(row_number() OVER o - 1 AS INTEGER) AS seq, event_id,
               (epoch_us(ts) - first_value(epoch_us(ts)) OVER o) / 3600000000.0::DOUBLE AS t,
               CASE event_type WHEN 'view' THEN 'g' WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'i' WHEN 'signup' THEN 'z' ELSE 'u' END AS band,
               value AS flux, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS flux_err
        FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a score by the document's length: (doc_id, label, toxic, score, pred)."""
    score = F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0)), 3)
    docs = table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic").join(docs, "doc_id")
    return rows.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


SCORED = """
    scored AS (
        SELECT doc_id, quality AS label, toxic, round(n_chars / (n_chars + 2000::DOUBLE), 3) AS score,
               CAST(round(n_chars / (n_chars + 2000::DOUBLE), 3) >= 0.5 AS INTEGER) AS pred
        FROM labels JOIN documents USING (doc_id))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def uniform_sql(*keys: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def bin_sql(t: str, frac: str) -> str:
    return f"CAST(round(({t} - {t} % (1.0::DOUBLE / {frac})) / (1.0::DOUBLE / {frac})) AS BIGINT)"
