"""Text sources: a file per object, with header lines `KEY: value` and observation lines `OBS: ...`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import CLASS_CODES
from . import object_files
from .tables import stored

#: Header keys and the columns they fill.
HEADERS = {
    "survey": ("SURVEY", lambda v: v),
    "object_id": ("SNID", lambda v: v.try_cast("long")),
    "sn_type": ("SNTYPE", lambda v: v.try_cast("long")),
    "ra": ("RA", lambda v: S.number_with_unit(v, "deg")),
    "decl": ("DECL", lambda v: S.number_with_unit(v, "deg")),
    "mwebv": ("MWEBV", lambda v: S.number_with_unit(v, "MW")),
    "host_id": ("HOST_GALAXY_GALID", lambda v: v.try_cast("long")),
    "hostz": ("HOST_GALAXY_PHOTO-Z", S.value_and_error),
    "spec": ("REDSHIFT_SPEC", S.value_and_error),
    "sim_type": ("SIM_COMMENT", S.class_name),
    "sim_z": ("SIM_REDSHIFT", lambda v: v.try_cast("double")),
}


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each file under a path or glob, by Spark's own listing, which suits thousands of files; see also read_folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _lines(objects: DataFrame) -> DataFrame:
    split = objects.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).filter("instr(line, ':') > 0")
    part = F.split("line", ":")
    return split.select("file", "pos", F.trim(part[0]).alias("key"), F.trim(part[1]).alias("value"))  # later colons don't count


def parse_headers(objects: DataFrame) -> DataFrame:
    """One row per file: HEADERS as columns, null where a line is missing, and class_code (null: no known class)."""
    keys = [k for k, _ in HEADERS.values()]
    wide = _lines(objects).filter(F.col("key").isin(keys)).groupBy("file").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_{n}") for n, (k, _) in HEADERS.items()))
    out = wide.select("file", *(f(F.col(f"_{n}")).alias(n) for n, (_, f) in HEADERS.items()))
    return out.withColumn("class_code", S.lookup(CLASS_CODES, F.col("sim_type")))


def parse_observations(objects: DataFrame) -> DataFrame:
    """One row per OBS line: file, seq (place in the file), time, band, flux, flux_err."""
    field = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.get(field, F.lit(k)).try_cast("double")
    return _lines(objects).filter("key = 'OBS'").select("file", F.col("pos").alias("seq"), number(0).alias("time"), F.get(field, F.lit(1)).alias("band"), number(3).alias("flux"), number(4).alias("flux_err"))


def accepted(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of a known class, and the rejects."""
    return headers.filter("class_code IS NOT NULL"), headers.filter("class_code IS NULL")


def tally(headers: DataFrame) -> DataFrame:
    """(name, n): objects of each known class, of all of these (`total`), and without a known class (`rejected`)."""
    known = F.col("class_code").isNotNull()
    each = F.explode(F.array(F.when(known, F.col("sim_type")).otherwise("rejected"), F.when(known, F.lit("total"))))
    return headers.select(each.alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each file under a folder, by the `object_files` source: files are listed once, and dealt by their bytes.

    Texts are written once, many to a file, as every parser reads them again.
    """
    object_files.register(spark)
    return stored(spark.read.format("object_files").schema("file string, text string").load(path), "texts")


def write_objects(objects: DataFrame, path: str) -> None:
    """A folder with one text file, `<file>.txt`, for each of objects (file, text)."""
    object_files.register(objects.sparkSession)
    objects.select(F.concat("file", F.lit(".txt")).alias("file"), "text").write.format("object_files").mode("append").save(path)


def render(headers: DataFrame, observations: DataFrame) -> DataFrame:
    """(file, text) from headers (file, key columns as text lines) and observations: the inverse of the parsers.

    headers: file, lines array<string>; observations: file, seq, time, band, flux, flux_err.
    """
    text = lambda c: F.col(c).cast("string")
    line: Column = F.concat(F.lit("OBS: "), F.concat_ws(" ", text("time"), F.col("band"), F.lit("NULL"), text("flux"), text("flux_err")))
    obs = observations.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("obs"))
    body = headers.join(obs, "file", "left")
    return body.select("file", F.array_join(F.concat("lines", F.coalesce(F.transform("obs", lambda o: o["line"]), F.array().cast("array<string>"))), "\n").alias("text"))
