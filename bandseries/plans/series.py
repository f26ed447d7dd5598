"""Queries of the time-series operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align, fill, methods, resample, sequences, splits
from ..schemas import BANDS, CLASS_CODES, TARGETS
from ..sources import light_curves
from ..sources import object_files as files_source
from ..sources.tables import scratch
from .tables import OBS, bin_sql, features, observations, uniform_sql

ERRORS = [f"{b}_err" for b in BANDS]
FRAC = 0.5
#: Rows of a range of an object that is taken to be larger than a task.
LONG = 4096


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def long_observations(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("object_id", "seq", "band", "flux", "flux_err")


def relative_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations(spark, d).select("object_id", "seq", "t"), "t")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Objects as text blocks (file, text); every ninth is of no known class."""
    obs = observations(spark, d).withColumn("file", F.col("object_id").cast("string"))
    name = F.element_at(F.array(*map(F.lit, [*CLASS_CODES, "XX"])), F.pmod("object_id", F.lit(len(CLASS_CODES) + 1)).cast("int") + 1)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    oid = F.col("object_id")
    lines = F.array(
        F.lit("SURVEY: EVT"), text("SNID: ", oid), text("RA: ", oid % 360, ".5 deg"), F.lit("MWEBV: 0.0096 MW E(B-V)"),
        text("HOST_GALAXY_PHOTO-Z: 0.", oid % 9 + 1, " +- 0.02"), text("SIM_COMMENT: SN Type = ", name, " , MODEL = X"), F.lit("SIM_REDSHIFT: 0.49"),
    )
    return light_curves.render(obs.select("file", "object_id").distinct().select("file", lines.alias("lines")), obs)


def text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Objects rendered as text blocks and parsed back: headers and observations."""
    blocks = rendered(spark, d)
    heads, _ = light_curves.accepted(light_curves.parse_headers(blocks))
    back = light_curves.parse_observations(blocks)
    rows = heads.select("file", "object_id", "ra", "decl", F.col("hostz.value").alias("hostz"), F.col("hostz.error").alias("hostz_err"), "sim_type", "class_code").join(back, "file")
    return rows.select("object_id", "ra", "decl", "hostz", "hostz_err", "sim_type", "class_code", "time", "band", "flux", "flux_err")


def object_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each object, scanned and parsed: its class and number of observations."""
    path = scratch(spark, "objects")
    light_curves.write_objects(rendered(spark, d), path)
    objects = light_curves.read_folder(spark, path)
    counts = light_curves.parse_observations(objects).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return light_curves.parse_headers(objects).join(counts, "file").select("object_id", "class_code", "n")


def object_files_io(spark: SparkSession, d: str) -> DataFrame:
    """Objects written as one named file each and read again, with the parsers on what comes back."""
    files_source.register(spark)
    path = scratch(spark, "files")
    rendered(spark, d).select(F.concat("file", F.lit(".txt")).alias("file"), "text").write.format("object_files").mode("append").save(path)
    back = spark.read.format("object_files").schema("file string, text string").load(path)
    n = light_curves.parse_observations(back).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flux"), 4).alias("flux"))
    return light_curves.parse_headers(back).select("file", "object_id", "class_code").join(n, "file")


def ingest_tally(spark: SparkSession, d: str) -> DataFrame:
    return light_curves.tally(light_curves.parse_headers(rendered(spark, d)))


def align_last(spark: SparkSession, d: str) -> DataFrame:
    return methods.epochs(observations(spark, d), "last").select("object_id", F.col("bin").alias("seq"), *BANDS, *ERRORS)


def align_augment(spark: SparkSession, d: str) -> DataFrame:
    out = methods.epochs(observations(spark, d), "no such name")
    return rounded(out.withColumn("t", F.round("t", 4)), *BANDS, *ERRORS)


def align_spline(spark: SparkSession, d: str) -> DataFrame:
    out = methods.epochs(observations(spark, d), "spline")
    return rounded(out.withColumn("t", F.round("t", 4)), *BANDS, *ERRORS)


def class_map(spark: SparkSession, d: str) -> DataFrame:
    codes = list(CLASS_CODES)
    rows = features(spark, d).select("vec_id", F.get(F.array(*map(F.lit, codes)), F.col("label")).alias("name"), F.when(F.col("label") == 9, -999).otherwise(F.col("label")).alias("raw"))
    code = S.lookup(CLASS_CODES, F.col("name"))
    out = rows.select("vec_id", "name", S.sentinel_to_null(F.col("raw")).alias("raw"), code.alias("code"), *(S.lookup(m, code).alias(n) for n, m in TARGETS.items()))
    return out.withColumn("shown", F.when(F.col("binary") == 0, "Type Ia").when(F.col("binary") == 1, "Non Type Ia"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return align.carry_forward(observations(spark, d)).drop("t")


def fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    out = align.cluster_times(align.fixed_bins(observations(spark, d), FRAC))
    return rounded(out.withColumn("members", F.array_join("members", ",")), "t")


def adaptive_bins(spark: SparkSession, d: str) -> DataFrame:
    out = align.adaptive_bins(observations(spark, d))
    return rounded(out.select("object_id", "seq", "bin", "frac", "unresolved"), "frac")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.align_bands(align.fixed_bins(observations(spark, d), FRAC))


def band_align(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aligned(spark, d), "t")


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    out = fill.fill_gaps(aligned(spark, d), n_passes=5)
    return rounded(out.select("pass", "object_id", "bin", *BANDS, *ERRORS), *BANDS, *ERRORS)


def edge_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_gaps(aligned(spark, d), interior=False).select("object_id", "bin", *BANDS)


def times(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, d)
    return obs, align.cluster_times(align.fixed_bins(obs, FRAC)).select("object_id", "bin", "t")


def nearest_error(spark: SparkSession, d: str) -> DataFrame:
    obs, at = times(spark, d)
    return align.nearest_values(obs, at, BANDS).drop("t")


def one_long_series(spark: SparkSession, d: str) -> DataFrame:
    """All events as one object, cut into ranges: carried forward, and each band's gaps filled by the values about them."""
    every = observations(spark, d).select(F.lit(0).cast("long").alias("object_id"), F.col("event_id").alias("seq"), F.lit(0.0).alias("t"), "band", "flux", "flux_err")
    carried = align.carry_forward(every, rows=LONG)
    wide = every.select("object_id", F.col("seq").alias("bin"), "t", *(c.alias(n) for n, c in align.band_columns().items()))
    filled = fill.fill_gaps(wide, rows=LONG).select(F.col("bin").alias("seq"), *(F.round(n, 6).alias(f"{n}_filled") for n in [*BANDS, *ERRORS]))
    return carried.select("seq", *BANDS, *ERRORS).join(filled, "seq")


def linear_resample(spark: SparkSession, d: str) -> DataFrame:
    obs, at = times(spark, d)
    return rounded(resample.linear_resample(obs, at, BANDS).drop("t"), "value")


def cubic_resample(spark: SparkSession, d: str) -> DataFrame:
    obs, at = times(spark, d)
    return rounded(resample.cubic_resample(obs, at, BANDS).drop("t"), "value")


def sequence(spark: SparkSession, d: str) -> DataFrame:
    return sequences.assemble(rounded(fill.fill_gaps(aligned(spark, d), interior=False), "t"), ["t", *BANDS])


def sequence_pad_pre(spark: SparkSession, d: str) -> DataFrame:
    return sequences.exploded(sequences.pad_sequences(sequence(spark, d), 5, 24), ["t", *BANDS])


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Padded sequences as one vector each, and its places as rows."""
    from pyspark.ml.functions import vector_to_array

    flat = sequences.flat_vector(sequences.pad_sequences(sequence(spark, d), 5, 24))
    return flat.select("object_id", F.posexplode(vector_to_array("features")).alias("k", "value"))


def width_check(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose sequences are not of the width asked for: here those of odd number, built without the last band."""
    rows = rounded(fill.fill_gaps(aligned(spark, d), interior=False), "t")
    whole, short = rows.filter("object_id % 2 = 0"), rows.filter("object_id % 2 = 1")
    both = sequences.assemble(whole, ["t", *BANDS]).unionByName(sequences.assemble(short, ["t", *BANDS[:-1]]))
    return sequences.check_width(both, 5).select("object_id")


def sequence_pad_post(spark: SparkSession, d: str) -> DataFrame:
    return sequences.exploded(sequences.pad_sequences(sequence(spark, d), 5, None, "post", "post"), ["t", *BANDS])


def sequence_reverse(spark: SparkSession, d: str) -> DataFrame:
    return sequences.exploded(sequences.reversed_view(sequence(spark, d), 5), ["t", *BANDS])


def object_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_objects(splits.object_ids(observations(spark, d)))


def split_gather(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d).select("object_id", "seq", "flux")
    train, test = splits.route(obs, splits.split_objects(splits.object_ids(obs)))
    count = lambda rows, name: rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flux"), 4).alias("flux")).withColumn("split", F.lit(name))
    return count(train, "train").unionByName(count(test, "test"))


def class_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain in small: bins, bands, edges filled, and counts and means per class of object."""
    name = F.element_at(F.array(*map(F.lit, CLASS_CODES)), F.pmod("object_id", F.lit(len(CLASS_CODES))).cast("int") + 1)
    rows = fill.fill_gaps(aligned(spark, d), interior=False).withColumn("class", name)
    return rounded(rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_epochs"), F.count_distinct("object_id").alias("n_objects"), *(F.avg(b).alias(b) for b in BANDS)), *BANDS)


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    label = (F.col("object_id") % 3).cast("int")
    rows = sequence(spark, d).withColumn("label", label).join(splits.split_objects(splits.object_ids(observations(spark, d))), "object_id")
    return sequences.profile(rows, ["split"], "label")


QUERIES = {
    f.__name__: f
    for f in (
        class_profile, long_observations, relative_time, text_roundtrip, class_map, carry_forward, fixed_bins, adaptive_bins, band_align, gap_fill, edge_fill,
        nearest_error, linear_resample, cubic_resample, sequence_pad_pre, sequence_pad_post, sequence_reverse, object_split, split_gather, dataset_profile,
        one_long_series, object_files_io, object_files, ingest_tally, align_last, align_augment, align_spline, feature_matrix, width_check,
    )
}

_BINNED = f"{OBS}, binned AS (SELECT *, {bin_sql('t', '0.5::DOUBLE')} AS bin FROM obs)"
_WIDE = ", ".join(f"max(CASE WHEN band = '{b}' THEN flux END) AS {b}, max(CASE WHEN band = '{b}' THEN flux_err END) AS {b}_err" for b in BANDS)
_OK = " AND ".join(f"count(CASE WHEN band = '{b}' THEN 1 END) <= 1" for b in BANDS)
_ALIGNED = f"{_BINNED}, aligned AS (SELECT object_id, bin, avg(t) AS t, count(*) AS n, {_WIDE}, {_OK} AS ok FROM binned GROUP BY object_id, bin)"


def _filled(c: str, interior: bool, keys: list[str]) -> str:
    last, next_ = f"last_value({c} IGNORE NULLS) OVER p", f"first_value({c} IGNORE NULLS) OVER f"
    u = uniform_sql("'42'", *keys, "bin", f"'{c}'")
    inner = f"{last} + {u} * ({next_} - {last})" if interior else last
    return f"coalesce({c}, {inner}, {last}, {next_}, 0.0)"


def _windows(keys: str) -> str:
    return (
        f"WINDOW p AS (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"f AS (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


_EDGE = f"{_ALIGNED}, filled AS (SELECT object_id, bin, round(t, 6) AS t, {', '.join(f'{_filled(b, False, [])} AS {b}' for b in BANDS)} FROM aligned {_windows('object_id')})"
_SEQ = f"{_EDGE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY object_id) AS len FROM filled)"
_TIMES = f"{_BINNED}, times AS (SELECT object_id, bin, avg(t) AS t FROM binned GROUP BY object_id, bin)"
# Walks the grid, object by object, until no pair shares a bin; from the 200th value on, pairs with equal times are left aside.
_ADAPTIVE = f"""{OBS},
    pairs AS (
        SELECT object_id, t, unnest([CASE WHEN band <> 'u' THEN lag(t) OVER (PARTITION BY object_id, band ORDER BY t, seq) END, lag(t, 4) OVER (PARTITION BY object_id ORDER BY t, seq)]) AS p FROM obs),
    close AS MATERIALIZED (SELECT * FROM pairs WHERE p IS NOT NULL AND t - p < 1.001),
    walk AS (
        SELECT DISTINCT user_id AS object_id, 0 AS k, 1.0::DOUBLE AS f FROM events
        UNION ALL
        SELECT DISTINCT w.object_id, w.k + 1, w.f + 0.1::DOUBLE FROM walk w JOIN close c ON c.object_id = w.object_id AND {bin_sql('c.p', 'w.f')} = {bin_sql('c.t', 'w.f')} AND (c.p <> c.t OR w.k < 199)),
    got AS (SELECT object_id, max(f) AS frac, object_id IN (SELECT object_id FROM close WHERE p = t) AS unresolved FROM walk GROUP BY object_id),
    binned AS MATERIALIZED (SELECT obs.*, frac, unresolved, {bin_sql('t', 'frac')} AS bin FROM obs JOIN got USING (object_id))"""
_SPLIT = f"""
    ids AS (SELECT DISTINCT user_id AS object_id FROM events),
    split AS (
        SELECT object_id, CASE WHEN row_number() OVER (ORDER BY {uniform_sql("'42'", "object_id")}, object_id) <= CAST(floor((SELECT count(*) FROM ids) * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split
        FROM ids)"""
# Written out by hand, so that the SQL doesn't share the library's own tables.
_CLASSES = "'Ia', 'II', 'Ibc', 'IIn', 'IIP', 'IIL', 'Ib', 'Ic'"
_CODE = "CASE name WHEN 'Ia' THEN 1 WHEN 'II' THEN 2 WHEN 'Ibc' THEN 3 WHEN 'IIn' THEN 21 WHEN 'IIP' THEN 22 WHEN 'IIL' THEN 23 WHEN 'Ib' THEN 32 WHEN 'Ic' THEN 33 END"
_BINARY = "CASE WHEN code = 1 THEN 0 WHEN code IN (2, 3, 21, 22, 23, 32, 33) THEN 1 END"
_THREE = "CASE WHEN code = 1 THEN 0 WHEN code IN (2, 21, 22, 23) THEN 1 WHEN code IN (3, 32, 33) THEN 2 END"
_SUBTYPE = "CASE code WHEN 1 THEN 0 WHEN 21 THEN 1 WHEN 22 THEN 2 WHEN 23 THEN 3 WHEN 32 THEN 4 WHEN 33 THEN 5 WHEN 3 THEN 6 END"


def _padded(maxlen: str, at: str, rows: str) -> str:
    """SQL that shows each object's rows at positions `at` of a length, -1 elsewhere."""
    return f"""
        WITH {_SEQ}, size AS (SELECT max(len) AS most FROM numbered), objects AS (SELECT DISTINCT object_id FROM numbered),
        slots AS (SELECT object_id, unnest(range(0, {maxlen})) AS pos FROM objects, size),
        placed AS (SELECT object_id, {at} AS pos, t, {', '.join(BANDS)} FROM numbered, size WHERE {rows})
        SELECT s.object_id, CAST(s.pos AS INTEGER) AS pos, coalesce(p.t, -1.0) AS t, {', '.join(f'coalesce(p.{b}, -1.0) AS {b}' for b in BANDS)}
        FROM slots s LEFT JOIN placed p ON s.object_id = p.object_id AND s.pos = p.pos
    """


def _resampled() -> str:
    one = "SELECT object_id, band, t, avg(flux) AS y FROM obs WHERE band IN ('g', 'r', 'i', 'z') GROUP BY ALL"
    return f"""
        WITH {_TIMES}, pts AS ({one}),
        lines AS (
            SELECT object_id, band, t,
                   CASE WHEN lead(t) OVER w IS NULL THEN coalesce(lag(t) OVER w, t) ELSE t END AS ta, CASE WHEN lead(t) OVER w IS NULL THEN coalesce(lag(y) OVER w, y) ELSE y END AS ya,
                   coalesce(lead(t) OVER w, t) AS tb, coalesce(lead(y) OVER w, y) AS yb, row_number() OVER w AS k
            FROM pts WINDOW w AS (PARTITION BY object_id, band ORDER BY t)),
        asked AS (SELECT object_id, bin, t, unnest(['g', 'r', 'i', 'z']) AS band FROM times),
        found AS (
            SELECT a.object_id, a.band, a.bin, a.t, coalesce(p.ta, f.ta) AS ta, coalesce(p.ya, f.ya) AS ya, coalesce(p.tb, f.tb) AS tb, coalesce(p.yb, f.yb) AS yb
            FROM asked a ASOF LEFT JOIN lines p ON a.object_id = p.object_id AND a.band = p.band AND a.t >= p.t
            LEFT JOIN lines f ON a.object_id = f.object_id AND a.band = f.band AND f.k = 1)
        SELECT object_id, band, bin, round(coalesce(ya + CASE WHEN ta = tb THEN 0.0 ELSE (yb - ya) / (tb - ta) END * (t - ta), 0.0), 6) AS value FROM found
    """


_BAND_LIST = "['g', 'r', 'i', 'z']"
_CELLS = ", ".join(f"CASE WHEN band = '{b}' THEN {v} END AS {n}" for b in BANDS for v, n in (("flux", b), ("flux_err", f"{b}_err")))


def _carried(c: str) -> str:
    return f"coalesce(last_value({c} IGNORE NULLS) OVER p, 0.0) AS {c}"


def _cubic(times: str) -> str:
    """CTEs that end in cubic (object_id, band, bin, t, value): not-a-knot splines of the bands at times, by one sweep down and one up."""
    by = "PARTITION BY object_id, band"
    return f"""
    times AS ({times}),
    pts AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER ({by}) AS n, lead(t) OVER w - t AS h, t - lag(t) OVER w AS hp, lead(y) OVER w AS yn, lag(y) OVER w AS yp
        FROM (SELECT object_id, band, t, avg(flux) AS y FROM obs WHERE band IN ('g', 'r', 'i', 'z') GROUP BY ALL) WINDOW w AS ({by} ORDER BY t)),
    rows_ AS MATERIALIZED (
        SELECT object_id, band, i, n, hp - CASE WHEN i = n - 2 THEN h * h / hp ELSE 0 END AS low, h - CASE WHEN i = 1 THEN hp * hp / h ELSE 0 END AS up,
               2 * (hp + h) + CASE WHEN i = 1 THEN hp * (hp + h) / h ELSE 0 END + CASE WHEN i = n - 2 THEN h * (hp + h) / hp ELSE 0 END AS mid, 6 * ((yn - y) / h - (y - yp) / hp) AS r
        FROM pts WHERE n >= 4 AND i BETWEEN 1 AND n - 2),
    down AS (
        SELECT object_id, band, i, n, up, mid, r FROM rows_ WHERE i = 1
        UNION ALL SELECT b.object_id, b.band, b.i, b.n, b.up, b.mid - b.low / a.mid * a.up, b.r - b.low / a.mid * a.r FROM down a JOIN rows_ b ON b.object_id = a.object_id AND b.band = a.band AND b.i = a.i + 1),
    swept AS MATERIALIZED (SELECT * FROM down),
    back AS (
        SELECT object_id, band, i, r / mid AS m FROM swept WHERE i = n - 2
        UNION ALL SELECT b.object_id, b.band, b.i, (b.r - b.up * a.m) / b.mid FROM back a JOIN swept b ON b.object_id = a.object_id AND b.band = a.band AND b.i = a.i - 1),
    inner_ AS MATERIALIZED (SELECT * FROM back),
    bent AS (
        SELECT p.*, CASE WHEN n < 4 THEN 0.0 WHEN i = 0 THEN ((h + lead(h) OVER w) * lead(m) OVER w - h * lead(m, 2) OVER w) / lead(h) OVER w
            WHEN i = n - 1 THEN ((lag(hp) OVER w + hp) * lag(m) OVER w - hp * lag(m, 2) OVER w) / lag(hp) OVER w ELSE m END AS m
        FROM pts p LEFT JOIN inner_ USING (object_id, band, i) WINDOW w AS ({by} ORDER BY i)),
    spans AS MATERIALIZED (SELECT *, lead(m) OVER ({by} ORDER BY i) AS mn FROM bent),
    spline AS MATERIALIZED (SELECT * FROM spans WHERE i < n - 1 OR n = 1),
    asked AS (SELECT object_id, bin, t, unnest({_BAND_LIST}) AS band FROM times),
    used AS (
        SELECT a.object_id, a.band, a.bin, a.t, coalesce(s.t, f.t) AS x, coalesce(s.y, f.y) AS y, coalesce(s.yn, f.yn) AS yn, coalesce(s.h, f.h) AS h, coalesce(s.m, f.m) AS m, coalesce(s.mn, f.mn) AS mn
        FROM asked a ASOF LEFT JOIN spline s ON a.object_id = s.object_id AND a.band = s.band AND a.t >= s.t LEFT JOIN spline f ON a.object_id = f.object_id AND a.band = f.band AND f.i = 0),
    cubic AS (
        SELECT object_id, band, bin, t, CASE WHEN y IS NULL THEN 0.0 WHEN h IS NULL THEN y ELSE y + (t - x) * ((yn - y) / h - h * (2 * m + mn) / 6 + (t - x) * (m / 2 + (t - x) * (mn - m) / (6 * h))) END AS value FROM used)"""


ORACLE = {
    "class_profile": f"""
        WITH {_EDGE} SELECT ([{_CLASSES}])[object_id % 8 + 1] AS class, count(*) AS n_epochs, count(DISTINCT object_id) AS n_objects, {', '.join(f'round(avg({b}), 6) AS {b}' for b in BANDS)} FROM filled GROUP BY 1""",
    "long_observations": f"WITH {OBS} SELECT object_id, seq, band, flux, flux_err FROM obs",
    "relative_time": f"WITH {OBS} SELECT object_id, seq, round(t, 6) AS t FROM obs",
    "text_roundtrip": """
        WITH named AS (SELECT *, (['Ia', 'II', 'Ibc', 'IIn', 'IIP', 'IIL', 'Ib', 'Ic', 'XX'])[user_id % 9 + 1] AS sim_type FROM events)
        SELECT user_id AS object_id, user_id % 360 + 0.5::DOUBLE AS ra, NULL::DOUBLE AS decl, CAST('0.' || CAST(user_id % 9 + 1 AS VARCHAR) AS DOUBLE) AS hostz, 0.02::DOUBLE AS hostz_err,
               sim_type, CASE sim_type WHEN 'Ia' THEN 1 WHEN 'II' THEN 2 WHEN 'Ibc' THEN 3 WHEN 'IIn' THEN 21 WHEN 'IIP' THEN 22 WHEN 'IIL' THEN 23 WHEN 'Ib' THEN 32 WHEN 'Ic' THEN 33 END AS class_code,
               epoch_us(ts)::DOUBLE AS time, CASE event_type WHEN 'view' THEN 'g' WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'i' WHEN 'signup' THEN 'z' ELSE 'u' END AS band,
               value AS flux, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS flux_err
        FROM named WHERE sim_type <> 'XX'""",
    "class_map": f"""
        WITH n AS (SELECT vec_id, ([{_CLASSES}])[label + 1] AS name, CASE WHEN label = 9 THEN NULL ELSE label END AS raw FROM embeddings),
        c AS (SELECT *, {_CODE} AS code FROM n),
        m AS (SELECT *, {_BINARY} AS "binary", {_THREE} AS three_way, {_SUBTYPE} AS subtype FROM c)
        SELECT *, CASE "binary" WHEN 0 THEN 'Type Ia' WHEN 1 THEN 'Non Type Ia' END AS shown FROM m""",
    "carry_forward": f"""
        WITH {OBS} SELECT object_id, seq, {', '.join(f"coalesce(last_value(CASE WHEN band = '{b}' THEN {v} END IGNORE NULLS) OVER w, 0.0) AS {n}" for b in BANDS for v, n in (('flux', b), ('flux_err', f'{b}_err')))}
        FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fixed_bins": f"WITH {_BINNED} SELECT object_id, bin, round(avg(t), 6) AS t, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS members FROM binned GROUP BY object_id, bin",
    "adaptive_bins": f"WITH RECURSIVE {_ADAPTIVE} SELECT object_id, seq, bin, round(frac, 6) AS frac, unresolved FROM binned",
    "align_augment": f"""
        WITH RECURSIVE {_ADAPTIVE}, aligned AS (SELECT object_id, bin, avg(t) AS t, {_WIDE} FROM binned GROUP BY object_id, bin), passed AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS pass FROM aligned)
        SELECT pass, object_id, bin, round(t, 4) AS t, {', '.join(f'round({_filled(c, True, ["pass", "object_id"])}, 6) AS {c}' for c in [*BANDS, *ERRORS])} FROM passed {_windows('pass, object_id')}""",
    "band_align": f"WITH {_ALIGNED} SELECT * REPLACE (round(t, 6) AS t) FROM aligned",
    "gap_fill": f"""
        WITH {_ALIGNED}, passed AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS pass FROM aligned)
        SELECT pass, object_id, bin, {', '.join(f'round({_filled(c, True, ["pass", "object_id"])}, 6) AS {c}' for c in [*BANDS, *ERRORS])} FROM passed {_windows('pass, object_id')}""",
    "edge_fill": f"WITH {_EDGE} SELECT object_id, bin, {', '.join(BANDS)} FROM filled",
    "nearest_error": f"""
        WITH {_TIMES}, near AS (
            SELECT a.object_id, a.bin, a.band, o.flux_err, row_number() OVER (PARTITION BY a.object_id, a.bin, a.band ORDER BY abs(o.t - a.t), o.t, o.seq) AS k
            FROM (SELECT *, unnest(['g', 'r', 'i', 'z']) AS band FROM times) a LEFT JOIN obs o ON a.object_id = o.object_id AND a.band = o.band)
        SELECT object_id, bin, band, coalesce(flux_err, 0.0) AS value FROM near WHERE k = 1""",
    "linear_resample": _resampled(),
    "cubic_resample": f"WITH RECURSIVE {_BINNED}, {_cubic('SELECT object_id, bin, avg(t) AS t FROM binned GROUP BY object_id, bin').strip()} SELECT object_id, band, bin, round(value, 6) AS value FROM cubic",
    "align_spline": f"""
        WITH RECURSIVE {OBS}, whole AS (SELECT *, {bin_sql('t', '1.0::DOUBLE')} AS bin FROM obs), {_cubic('SELECT object_id, bin, avg(t) AS t FROM whole GROUP BY object_id, bin').strip()},
        near AS (
            SELECT a.object_id, a.bin, a.band, o.flux_err, row_number() OVER (PARTITION BY a.object_id, a.bin, a.band ORDER BY abs(o.t - a.t), o.t, o.seq) AS k
            FROM asked a LEFT JOIN obs o ON a.object_id = o.object_id AND a.band = o.band)
        SELECT CAST(1 AS INTEGER) AS pass, c.object_id, c.bin, round(any_value(c.t), 4) AS t, {', '.join(f"round(max(CASE WHEN c.band = '{b}' THEN value END), 6) AS {b}, round(max(CASE WHEN c.band = '{b}' THEN coalesce(flux_err, 0.0) END), 6) AS {b}_err" for b in BANDS)}
        FROM cubic c JOIN near n ON n.object_id = c.object_id AND n.bin = c.bin AND n.band = c.band AND k = 1 GROUP BY c.object_id, c.bin""",
    "one_long_series": f"""
        WITH {OBS}, wide AS (SELECT event_id AS seq, event_id AS bin, 0 AS object_id, {_CELLS} FROM obs)
        SELECT seq, {', '.join(_carried(c) for c in [*BANDS, *ERRORS])}, {', '.join(f'round({_filled(c, True, ["object_id"])}, 6) AS {c}_filled' for c in [*BANDS, *ERRORS])} FROM wide {_windows('object_id')}""",
    "object_files": f"""
        WITH named AS (SELECT user_id AS object_id, ([{_CLASSES}, 'XX'])[user_id % 9 + 1] AS name FROM events)
        SELECT object_id, {_CODE} AS class_code, count(*) AS n FROM named GROUP BY object_id, name""",
    "object_files_io": f"""
        WITH named AS (SELECT *, ([{_CLASSES}, 'XX'])[user_id % 9 + 1] AS name FROM events)
        SELECT concat(user_id, '.txt') AS file, user_id AS object_id, {_CODE} AS class_code, count(*) AS n, round(sum(value), 4) AS flux FROM named GROUP BY user_id, name""",
    "ingest_tally": f"""
        WITH o AS (SELECT DISTINCT user_id, ([{_CLASSES}, 'rejected'])[user_id % 9 + 1] AS name FROM events)
        SELECT name, count(*) AS n FROM o GROUP BY name UNION ALL SELECT 'total', count(*) FROM o WHERE name <> 'rejected'""",
    "feature_matrix": f"SELECT object_id, CAST(pos * 5 + c AS INTEGER) AS k, ([t, g, r, i, z])[c + 1] AS value FROM ({_padded('24', '24 - least(len, 24) + k - greatest(len - 24, 0)', 'k >= len - 24')}), (SELECT unnest(range(0, 5)) AS c)",
    "width_check": "SELECT DISTINCT user_id AS object_id FROM events WHERE user_id % 2 = 1",
    "sequence_pad_pre": _padded("24", "24 - least(len, 24) + k - greatest(len - 24, 0)", "k >= len - 24"),
    "sequence_pad_post": _padded("most", "k", "true"),
    "sequence_reverse": _padded("most", "most - 1 - k", "true"),
    "object_split": f"WITH {_SPLIT} SELECT * FROM split",
    "split_gather": f"WITH {_SPLIT} SELECT object_id, count(*) AS n, round(sum(value), 4) AS flux, split FROM events JOIN split ON user_id = object_id GROUP BY object_id, split",
    "dataset_profile": f"""
        WITH {_SEQ.replace("obs AS", _SPLIT.strip() + ", obs AS", 1)}, per AS (SELECT object_id, max(len) AS len FROM numbered GROUP BY object_id)
        SELECT split, count(*) AS n_objects, max(len) AS max_length, CAST(sum(len) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS width, count(DISTINCT object_id % 3) AS n_classes FROM per JOIN split USING (object_id) GROUP BY split""",
}
ORACLE["align_last"] = ORACLE["carry_forward"]
