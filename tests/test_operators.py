"""Operators on small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandseries.functions import scalars as S
from bandseries.functions.ranks import rank_by_uniform, running_totals
from bandseries.operators import align, balance, bootstrap, curves, fill, metrics, models, resample, sequences, splits
from bandseries.schemas import BANDS
from bandseries.sources import light_curves, tables

HEAD = ["SURVEY: DES", "SNID: {id}", "SNTYPE: 1", "RA: 52.50 deg", "DECL: -27.50 deg", "MWEBV: 0.0096 MW E(B-V)", "HOST_GALAXY_PHOTO-Z: 0.4904 +- 0.0248", "SIM_COMMENT: SN Type = {kind} , MODEL = X", "SIM_REDSHIFT: 0.4900"]
OBJECTS = {
    101: ("Ia", [(0.0, "g", 3), (0.3, "r", 4)]),
    102: ("II", [(0.0, "g", 1), (0.3, "r", 2), (0.6, "g", 5)]),
    103: ("Ibc", [(0, "g", 2), (1, "r", 7), (2, "g", 4)]),
    104: ("IIn", [(0, "g", 1), (1, "u", 9)]),
    105: ("XX", [(0, "g", 1)]),
    106: ("Ia", [(0, "z", 8)]),
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("objects")
    for k, (kind, obs) in OBJECTS.items():
        head = [h for h in HEAD if k != 106 or not h.startswith(("SNTYPE", "DECL"))]
        lines = [h.format(id=k, kind=kind) for h in head] + [f"OBS: {56177 + t} {b} NULL {v}.0 0.5" for t, b, v in obs]
        (folder / f"OBJ_{k}.DAT").write_text("\n".join(lines) + "\n")
    return f"{folder}/OBJ_*.DAT"


@pytest.fixture(scope="module")
def parsed(spark, files):
    objects = light_curves.read_objects(spark, files)
    heads, rejects = light_curves.accepted(light_curves.parse_headers(objects))
    obs = light_curves.parse_observations(objects).join(heads.select("file", "object_id"), "file")
    obs = align.relative_time(obs).withColumn("t", F.round("t", 6)).cache()
    return heads, rejects, obs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_headers(parsed):
    heads, rejects, _ = parsed
    assert rows(heads, "object_id", "class_code") == [(101, 1), (102, 2), (103, 3), (104, 21), (106, 1)]
    assert rows(rejects, "object_id", "sim_type") == [(105, "XX")]
    one = heads.filter("object_id = 101").first()
    assert (one["ra"], one["decl"], one["mwebv"], one["sim_z"], one["sn_type"]) == (52.5, -27.5, 0.0096, 0.49, 1)
    assert (one["hostz"]["value"], one["hostz"]["error"]) == (0.4904, 0.0248)
    last = heads.filter("object_id = 106").first()
    assert last["sn_type"] is None and last["decl"] is None


def test_carry_forward(parsed):
    out = align.carry_forward(parsed[2].filter("object_id IN (103, 104)"))
    assert rows(out, "object_id", "t", "g", "r") == [(103, 0, 2, 0), (103, 1, 2, 7), (103, 2, 4, 7), (104, 0, 1, 0), (104, 1, 1, 0)]


def test_adaptive_bins_and_fill(parsed):
    binned = align.adaptive_bins(parsed[2])
    frac = {r["object_id"]: round(r["frac"], 6) for r in binned.collect()}
    assert frac == {101: 1.0, 102: 1.7, 103: 1.0, 104: 1.0, 106: 1.0}
    aligned = align.align_bands(binned)
    assert rows(aligned.filter("object_id = 101"), "t", *BANDS) == [(0.15, 3, 4, None, None)]
    filled = fill.fill_gaps(aligned)
    assert rows(filled.filter("object_id = 102"), F.round("t", 6), *BANDS) == [(0.15, 1, 2, 0, 0), (0.6, 5, 2, 0, 0)]
    middle = filled.filter("object_id = 103").orderBy("t").collect()
    assert 2 <= middle[1]["g"] <= 4 and [r["r"] for r in middle] == [7, 7, 7]
    assert [r["g"] for r in filled.filter("object_id = 104").collect()] == [1, 1]
    again = fill.fill_gaps(aligned.repartition(7))
    assert rows(again, "object_id", "bin", *BANDS) == rows(filled, "object_id", "bin", *BANDS)


def test_equal_times_are_unresolved(spark):
    obs = spark.createDataFrame([(1, 0, 0.0, "g", 1.0, 0.1), (1, 1, 0.0, "g", 2.0, 0.1)], "object_id long, seq int, t double, band string, flux double, flux_err double")
    assert align.adaptive_frac(obs).first()["unresolved"]
    assert not align.align_bands(align.adaptive_bins(obs)).first()["ok"]


def test_dense_objects_are_resolved_beyond_the_first_steps(spark):
    times = {1: [0.0, 0.001], 2: [3.0, 3.002, 3.002], 3: [0.1 + k * 0.013 for k in range(12)]}
    data = [(o, k, t, "gr"[o == 2 and k == 2], 1.0, 0.1) for o, ts in times.items() for k, t in enumerate(ts)] + [(4, k, 0.5 + 0.004 * (k // 2), "g", 1.0, 0.1) for k in range(4)]
    obs = spark.createDataFrame(data, "object_id long, seq int, t double, band string, flux double, flux_err double")
    found = {r["object_id"]: (r["frac"], r["unresolved"]) for r in align.adaptive_frac(obs).collect()}
    assert {o: u for o, (_, u) in found.items()} == {1: False, 2: False, 3: False, 4: True}

    def number(t, f):
        return round((t - t % (1.0 / f)) / (1.0 / f))

    for o, pairs in {1: [(0.0, 0.001)], 2: [(3.0, 3.002)], 3: list(zip(times[3], times[3][1:])), 4: [(0.5, 0.504)]}.items():
        f = 1.0
        while any(number(p, f) == number(t, f) for p, t in pairs) or o == 4 and f < align.frac_grid()[-1]:
            f += 0.1
        assert found[o][0] == f
    assert found[1][0] > align.frac_grid()[-1]
    ok = {r["object_id"]: r["ok"] for r in align.align_bands(align.adaptive_bins(obs)).groupBy("object_id").agg(F.min("ok").alias("ok")).collect()}
    assert ok == {1: True, 2: True, 3: True, 4: False}


def test_grid_values_are_those_of_repeated_addition():
    from bandseries.operators.steps import Grid

    grid = Grid()
    assert [grid.value(k) for k in range(200)] == align.frac_grid()
    sums = np.cumsum(np.concatenate(([1.0], np.full(3_000_000, 0.1))))
    for k in [*range(0, 3_000_000, 997), *(int(np.searchsorted(sums, 2.0**e)) + d for e in range(1, 18) for d in (-1, 0, 1))]:
        assert grid.value(k) == sums[k]
    assert grid.value(grid.size - 1) + 0.1 == grid.value(grid.size - 1) or grid.size > 10**15


def test_next_parting_step_is_the_first():
    import random

    from bandseries.operators.steps import Grid, first_free, next_parted, shared

    grid, r = Grid(), random.Random(3)
    values = np.asarray([grid.value(k) for k in range(60_000)])
    for _ in range(60):
        p = r.choice([0.0, r.uniform(0, 1e-3), r.uniform(0, 5), r.uniform(0, 400), -r.uniform(0, 3)])
        t = p + r.choice([1e-3, 2e-4, 0.01, 0.3]) * r.uniform(0.5, 1.5)
        k = r.randrange(200)
        rows = [j for j in range(k, 60_000) if not shared(p, t, float(values[j]))][:1]
        found = next_parted(grid, p, t, k)
        assert found == rows[0] if rows else found >= 60_000
    p = np.asarray([1.0, 7.25, 30.5, 30.501])
    t = p + np.asarray([0.002, 0.004, 0.001, 0.03])
    want = next(f for f in values if not shared(p, t, float(f)).any())
    assert first_free(grid, p, t, 0) == (want, True)


def test_pairs_a_microsecond_apart_are_parted_at_once():
    import time

    from bandseries.operators.steps import Grid, first_free, shared

    grid, day = Grid(), 1e-6 / 86400
    began = time.time()
    for p in (0.0, 0.37, 12.3456, 871.001):
        one, other = np.asarray([p, p + 3.0]), np.asarray([p + day, p + 3.5])
        if one[0] == other[0]:
            continue
        f, free = first_free(grid, one, other, 199)
        assert free
        assert not shared(one, other, f).any()
    assert time.time() - began < 1
    next_to = np.nextafter(871.001, 1e9)
    f, free = first_free(grid, np.asarray([871.001]), np.asarray([next_to]), 199)
    assert free
    assert not shared(871.001, float(next_to), f)


def test_a_long_object_in_ranges_is_scanned_as_in_one_piece(spark):
    from bandseries.functions.ranks import ranged

    value = lambda every, at: F.when(F.col("id") % every == at, F.col("id") * 0.5)
    base = spark.range(0, 6000, 1, 5).select("*", F.when(F.col("id") < 5000, 1).when(F.col("id") < 5990, F.col("id") % 3).alias("object_id"))  # one long, some short, one without id
    wide = base.select("object_id", F.col("id").alias("bin"), F.lit(0.0).alias("t"), *(value(7 + 900 * k, k).alias(b) for k, b in enumerate("griz")), *(F.lit(None).cast("double").alias(f"{b}_err") for b in "griz"))
    plain = sorted(map(str, fill.fill_gaps(wide).collect()))
    assert sorted(map(str, fill.fill_gaps(wide, rows=100).collect())) == plain
    obs = base.select("object_id", F.col("id").alias("seq"), F.lit(0.0).alias("t"), F.element_at(F.array(*map(F.lit, "grizu")), F.pmod(F.col("id") * F.col("id"), F.lit(5)).cast("int") + 1).alias("band"), F.col("id").cast("double").alias("flux"), F.lit(1.0).alias("flux_err"))
    assert sorted(map(str, align.carry_forward(obs, rows=100).collect())) == sorted(map(str, align.carry_forward(obs).collect()))
    obs = obs.withColumn("t", (F.col("seq") % 1700) / 8)
    times = base.filter("id % 4 = 0").select("object_id", F.col("id").alias("bin"), (F.col("id") / 31).alias("t"))
    assert sorted(map(str, align.nearest_values(obs, times, BANDS, rows=100).collect())) == sorted(map(str, align.nearest_values(obs, times, BANDS).collect()))
    cut, pieces = ranged(wide, [F.col("object_id"), F.col("bin")], rows=100)
    assert pieces == 60
    assert max(r["count"] for r in cut.groupBy("_piece").count().collect()) < 400


def test_nearest_is_the_first_of_equals(spark):
    obs = spark.createDataFrame([(1, 0, 1.0, "g", 0.0, 5.0), (1, 1, 3.0, "g", 0.0, 7.0), (1, 2, 3.0, "g", 0.0, 8.0), (1, 3, 2.0, "r", 0.0, 1.0)], "object_id long, seq int, t double, band string, flux double, flux_err double")
    times = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (1, 2, 2.5), (1, 3, -4.0), (2, 0, 1.0)], "object_id long, bin long, t double")
    got = {(r["object_id"], r["bin"], r["band"]): r["value"] for r in align.nearest_values(obs, times, ["g", "r"]).collect()}
    assert [got[1, k, "g"] for k in range(4)] == [5.0, 7.0, 7.0, 5.0]
    assert (got[1, 0, "r"], got[2, 0, "g"], got[2, 0, "r"]) == (1.0, 0.0, 0.0)


def test_a_label_of_equal_scores_has_a_density(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 0.4), (0, 0.9), (1, 0.5), (1, 0.5), (2, 0.1), (2, None), (None, 0.3)], "label int, score double")
    got = {(r["label"], r["k"]): r["density"] for r in curves.score_density(rows, 10).collect()}
    assert len(got) == 40
    assert got[1, 5] == pytest.approx(1 / (0.1 * (2 * np.pi) ** 0.5))
    alone = curves.score_density(rows.filter("label = 1"), 3).collect()
    assert {round(r["density"], 6) for r in alone} == {round(1 / (2 * np.pi) ** 0.5, 6)}


def test_runs_follow_file_order(spark):
    obs = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.1, 0.2, 1.5, 0.3])], "object_id long, seq int, t double")
    assert [r["bin"] for r in align.runs(obs).orderBy("seq").collect()] == [0, 0, 1, 2]


def test_padding(spark):
    s = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[1.0], [2.0], [3.0], [4.0]])], "object_id long, seq array<array<double>>")
    flat = lambda df: [[x[0] for x in r["seq"]] for r in df.orderBy("object_id").collect()]
    assert flat(sequences.pad_sequences(s, 1)) == [[-1, -1, 1, 2], [1, 2, 3, 4]]
    assert flat(sequences.pad_sequences(s, 1, 4, "post")) == [[1, 2, -1, -1], [1, 2, 3, 4]]
    assert flat(sequences.reversed_view(s, 1)) == [[-1, -1, 2, 1], [4, 3, 2, 1]]
    assert flat(sequences.pad_sequences(s, 1, 2))[1] == [3, 4]
    assert flat(sequences.pad_sequences(s, 1, 2, truncating="post"))[1] == [1, 2]
    with pytest.raises(ValueError, match="padding"):
        sequences.pad_sequences(s, 1, 2, padding="left")
    assert sequences.check_width(s, 1).count() == 0 and sequences.check_width(s, 2).count() == 2


SCORES = [(0.9, 1), (0.9, 0), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1), (0.5, 0)]


def test_metrics(spark):
    p = spark.createDataFrame([(k, s, y, int(s >= 0.65)) for k, (s, y) in enumerate(SCORES)], "id int, score double, label int, pred int")
    t = curves.score_totals(p)
    assert curves.roc_auc(t).first()[0] == pytest.approx(7 / 12)
    assert curves.pr_auc(t).first()[0] == pytest.approx(0.656845, abs=1e-6)
    counts = metrics.binary_counts(p)
    assert tuple(counts.first()) == (3, 1, 1, 2)
    assert metrics.figure_of_merit(counts).first()["fom"] == pytest.approx(0.375)
    prf = metrics.weighted_prf(metrics.confusion(p, [0, 1])).first()
    assert all(prf[c] == pytest.approx(5 / 7) for c in ("precision", "recall", "f1", "accuracy"))
    bent = curves.score_totals(p.withColumn("score", F.exp("score")))
    assert curves.roc_auc(bent).first()[0] == pytest.approx(7 / 12)


def test_metrics_equal_the_library(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    r = np.random.default_rng(1)
    data = [(float(round(s, 2)), int(y)) for s, y in zip(r.random(500), r.integers(0, 2, 500), strict=True)]
    p = spark.createDataFrame(data, "score double, label int").withColumn("pred", (F.col("score") > 0.4).cast("int"))
    ours = metrics.weighted_prf(metrics.confusion(p, [0, 1])).first()
    typed = p.select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction"), "score")
    for ours_name, name in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert ours[ours_name] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(typed))
    assert curves.roc_auc(curves.score_totals(p)).first()[0] == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(typed))


def test_one_class_only(spark):
    p = spark.createDataFrame([(0.3, 1), (0.4, 1)], "score double, label int").withColumn("pred", F.lit(0))
    assert curves.roc_auc(curves.score_totals(p)).first()[0] is None
    assert metrics.weighted_prf(metrics.confusion(p, [0, 1])).first()["f1"] == 0


def test_splines():
    x = np.array([0, 0.5, 1.1, 2.0, 3.5, 4.0])
    cubic = lambda t: 2 - t + 0.5 * t**2 - 0.3 * t**3
    at = np.linspace(-1, 5, 41)
    assert resample.not_a_knot(x, cubic(x), at) == pytest.approx(cubic(at))
    assert resample.not_a_knot(x[:2], np.array([1.0, 2.0]), np.array([1.0])) == pytest.approx([3.0])
    assert resample.not_a_knot(x[:1], np.array([4.0]), at).tolist() == [4.0] * 41
    assert resample.not_a_knot(x[:0], x[:0], at).tolist() == [0.0] * 41


def test_split_and_folds(spark):
    ids = spark.range(103).withColumnRenamed("id", "object_id")
    split = splits.split_objects(ids, 0.25)
    assert split.filter("split = 'test'").count() == 25 and split.distinct().count() == 103
    table = spark.range(97).select(F.col("id"), (F.col("id") % 3).cast("int").alias("label"))
    n = splits.stratified_folds(table, "label", "id").groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in n.collect())


def test_two_level_ranks(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), S.hash_uniform("id").alias("u"), "id", F.lit(2).alias("w"))
    ranked = rank_by_uniform(df, ["k"], "u", ["id"], "r", buckets=7).orderBy("k", "u").collect()
    assert [r["r"] for r in ranked] == [*range(250), *range(250)]
    run = running_totals(df, ["k"], "u", {"total": "w"}, rows=5).orderBy("k", F.desc("u")).collect()
    assert [r["total"] for r in run] == [*range(2, 502, 2)] * 2


def test_smote(spark):
    data = [(k, int(k < 12), [float(k), float(k * k % 7)]) for k in range(60)]
    df = spark.createDataFrame(data, "id long, label int, x array<double>")
    made = balance.smote(df, "id", "label", "x").collect()
    assert len(made) == 48 - 12 and {r["label"] for r in made} == {1}
    at = {k: np.array(v) for k, _, v in data}
    for r in made:
        assert np.array(r["x"]) == pytest.approx(at[r["base"]] + r["step"] * (at[r["neighbour"]] - at[r["base"]]))
    assert balance.oversampled(df, "id", "label", "x").groupBy("label").count().select("count").distinct().count() == 1
    near = balance.class_neighbours(df.filter("label = 1"), "id", "label", "x", exact_rows=5)  # by hashing
    assert near.filter("neighbour = id").count() == 0 and near.count() > 0


def test_neighbours_of_many_blocks_are_exact(spark):
    r = np.random.default_rng(4)
    x = np.concatenate((r.integers(0, 4, (150, 3)).astype(float), 1000 * r.normal(size=(50, 3))))  # ties, and rows far from all others
    df = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(x)], "id long, label int, x array<double>")
    got = balance.class_neighbours(df, "id", "label", "x", exact_rows=20).orderBy("id", "rank").collect()
    want = []
    for k in range(200):
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x[k], x[j], strict=True)))), j) for j in range(k % 2, 200, 2) if j != k)
        want += [(k, k % 2, i + 1, j) for i, (_, j) in enumerate(near[:5])]
    assert [tuple(g)[:4] for g in got] == want
    few = spark.createDataFrame([(k, int(k < 30), [1000.0 * k]) for k in range(100)], "id long, label int, x array<double>")
    assert balance.smote(few, "id", "label", "x").count() == 40


def test_bootstrap(spark):
    p = spark.createDataFrame([(k, s, y) for k, (s, y) in enumerate(SCORES * 8)], "id int, score double, label int")
    exact = bootstrap.resampled_exactly(p, "id", 5)
    assert [r["n"] for r in exact.groupBy("iter").agg(F.sum("weight").alias("n")).collect()] == [56] * 5
    each = bootstrap.iteration_metrics(bootstrap.resampled(p, "id", 30))
    got = {r["metric"]: r for r in bootstrap.intervals(each).collect()}
    assert set(got) == set(bootstrap.MEASURES)
    assert got["roc_auc"]["lower"] < 7 / 12 < got["roc_auc"]["upper"]


def test_models(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (240, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.8).astype(float)
    data = models.with_vector(spark.createDataFrame([(k, [*map(float, v)], float(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, a array<double>, label double"), "a").drop("a")
    got = models.score(models.fit(data, "linear", balance=True, maxIter=20), data, "m").collect()
    assert sum(r["pred"] == r["label"] for r in got) > 0.9 * len(got)
    assert models.trials("forest", 3) == models.trials("forest", 9)[:3]
    assert models.classifier("forest", maxDepth=49, gamma=1.0).getMaxDepth() == 30


def test_scaling_uses_the_population_deviation(spark):
    from pyspark.ml.functions import vector_to_array

    data = models.with_vector(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "a array<double>"), "a")
    z = sorted(r[0] for r in models.standardise(data, data).select(vector_to_array("scaled")).collect())
    assert z == [[-1.0, 0.0], [1.0, 0.0]]


def test_sinks(spark, tmp_path):
    data = spark.createDataFrame([(1, "train", [[1.0]]), (2, "test", [[2.0]])], "object_id long, split string, seq array<array<double>>")
    for fmt in tables.FORMATS:
        tables.save_dataset(data, f"{tmp_path}/{fmt}", fmt)
        assert rows(tables.load_dataset(spark, f"{tmp_path}/{fmt}", data.schema, fmt), "object_id", "split") == [(1, "train"), (2, "test")]
    with pytest.raises(ValueError, match="npz"):
        tables.save_dataset(data, f"{tmp_path}/x", "npz")
    with pytest.warns(UserWarning, match="no results"):
        assert tables.load_results(spark, [f"{tmp_path}/nothing"]).count() == 0


def test_scalars(spark):
    one = spark.range(1).select(
        S.bin_of(F.lit(1.0), F.lit(10.0)).alias("bin"), S.lookup({1: "a"}, F.lit(2)).alias("unknown"), S.one_hot(F.lit(7), 3).alias("outside"),
        S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("first"), S.class_name(F.lit("no class")).alias("none"), S.value_and_error(F.lit("x +- 2")).alias("pair"),
    ).first()
    assert (one["bin"], one["unknown"], one["outside"], one["first"], one["none"]) == (9, None, [0.0, 0.0, 0.0], 1, None)
    assert (one["pair"]["value"], one["pair"]["error"]) == (None, 2.0)


def dense_not_a_knot(x, y, at):
    """The same spline from a full system, as a check."""
    import numpy as np

    h, n = np.diff(x), len(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    d = at - x[k]
    return y[k] + d * ((y[k + 1] - y[k]) / h[k] - h[k] * (2 * m[k] + m[k + 1]) / 6 + d * (m[k] / 2 + d * (m[k + 1] - m[k]) / (6 * h[k])))


def test_spline_by_three_diagonals():
    import numpy as np

    from bandseries.operators.resample import not_a_knot

    r = np.random.default_rng(1)
    for n in (4, 5, 6, 40):
        x = np.cumsum(r.uniform(0.1, 2, n))
        at = np.linspace(x[0] - 1, x[-1] + 1, 60)
        y = r.normal(size=n)
        assert np.allclose(not_a_knot(x, y, at), dense_not_a_knot(x, y, at))
        assert np.allclose(not_a_knot(x, x**3 - 2 * x, at), at**3 - 2 * at)  # a cubic is its own spline
    x = np.arange(200_000.0)
    assert np.allclose(not_a_knot(x, np.sin(x / 50), x[:5] + 0.5), np.sin((x[:5] + 0.5) / 50), atol=1e-6)


def test_one_long_object_fills_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from bandseries.operators.fill import fill_gaps

    value = lambda k: F.when(F.col("bin") % 1000 == k, F.col("bin").cast("double"))
    rows = spark.range(200_000).select(F.lit(1).alias("object_id"), F.col("id").alias("bin"), F.col("id").cast("double").alias("t"))
    rows = rows.select("*", *(value(k).alias(b) for k, b in enumerate("griz")), *(F.lit(None).cast("double").alias(f"{b}_err") for b in "griz"))
    began = time.time()
    got = fill_gaps(rows, interior=False).agg(F.sum("g"), F.max("z"), F.min("z"), F.sum("g_err")).first()
    assert tuple(got) == (sum(b // 1000 * 1000.0 for b in range(200_000)), 199_003.0, 3.0, 0.0)
    assert time.time() - began < 60


def test_smote_makes_every_draw_for_a_class_of_one(spark):
    from bandseries.operators.balance import smote

    rows = spark.createDataFrame([(k, 0, [float(k), 1.0]) for k in range(6)] + [(9, 1, [5.0, 5.0])], "id long, label int, x array<double>")
    made = smote(rows, "id", "label", "x").collect()
    assert [(r["label"], r["base"], r["neighbour"], r["x"]) for r in made] == [(1, 9, 9, [5.0, 5.0])] * 5


def test_neighbours_by_pivots_are_those_of_all_pairs(spark):
    from bandseries.operators.balance import class_neighbours, pairs_compared

    r = np.random.default_rng(4)
    at = r.uniform(-10, 10, (12, 3))
    x = np.concatenate([c + r.normal(0, 0.05, (60, 3)) for c in at] + [np.zeros((30, 3)), at[:1].repeat(40, 0)])
    rows = [(k, k % 3 == 0, [float(v) for v in row]) for k, row in enumerate(x)] + [(10_000, None, [0.0] * 3), (None, True, [0.0] * 3), (10_001, True, None)]
    df = spark.createDataFrame(rows, "id long, label boolean, v array<double>").repartition(4)
    few = {(p["id"], p["rank"]): (p["neighbour"], p["distance"]) for p in class_neighbours(df, "id", "label", "v", 4, exact_rows=16).collect()}
    one = {(p["id"], p["rank"]): (p["neighbour"], p["distance"]) for p in class_neighbours(df, "id", "label", "v", 4, exact_rows=5_000).collect()}
    assert few == one
    assert len(one) == 4 * len(x)
    for k in range(0, len(x), 37):
        same = [j for j in range(len(x)) if j != k and (j % 3 == 0) == (k % 3 == 0)]
        want = sorted((float(np.sqrt(np.square(x[k] - x[j]).sum())), j) for j in same)[:4]
        assert [one[k, i + 1][0] for i in range(4)] == [j for _, j in want]
    most = sum(int((np.arange(len(x)) % 3 == 0).sum() if c else (np.arange(len(x)) % 3 != 0).sum()) ** 2 for c in (0, 1))
    assert pairs_compared(df, "id", "label", "v", 4, exact_rows=16) < 0.25 * most
    assert {(p["id"], p["rank"]): (p["neighbour"], p["distance"]) for p in class_neighbours(df, "id", "label", "v", 4, exact_rows=64, pivot_bytes=1).collect()} == one


def test_draws_of_a_small_class_are_dealt_out(spark, monkeypatch):
    from bandseries.operators import balance

    rows = spark.createDataFrame([(k, 0, [float(k), 1.0]) for k in range(200)] + [(1000 + k, 1, [float(k), 5.0]) for k in range(3)], "id long, label int, x array<double>")
    plain = sorted(map(str, balance.smote(rows, "id", "label", "x").collect()))
    monkeypatch.setattr(balance, "DRAWS", 8)
    assert sorted(map(str, balance.smote(rows, "id", "label", "x").collect())) == plain
    assert len(plain) == 197


def test_methods_are_chosen_by_name(spark):
    from bandseries.operators.methods import epochs

    obs = spark.createDataFrame([(1, k, k * 0.7, "griz"[k % 4], float(k), 0.1) for k in range(24)], "object_id long, seq int, t double, band string, flux double, flux_err double")
    count = lambda m: epochs(obs, m, 3).groupBy("pass").count().count()
    assert (count("augment"), count(None), count("other"), count("spline"), count("last")) == (3, 3, 3, 1, 1)
    assert epochs(obs, "last").count() == 24
    columns = epochs(obs, "spline").columns
    assert columns == epochs(obs, "last").columns == epochs(obs).columns
    assert not epochs(obs, "spline").filter("g IS NULL OR z_err IS NULL").count()


def test_rows_of_other_classes_are_counted_apart(spark):
    from bandseries.operators import metrics

    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (None, 1), (1, None), (1, 1)], "label int, pred int")
    assert metrics.left_out(rows, [0, 1]) == 3
    assert sum(r["n"] for r in metrics.confusion(rows, [0, 1]).collect()) == 3


def test_rows_without_clusters_are_sent_once_for_each_block(spark, monkeypatch):
    from bandseries.operators import balance

    monkeypatch.setattr(balance, "BLOCKS", 4)
    x = np.random.default_rng(6).normal(size=(600, 16)) + 1e5
    x[300:340] = x[:40]
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate(x.tolist())], "id long, label int, v array<double>")
    _, sides = balance._neighbours(df, "id", "label", "v", 3, 16, 1 << 20)
    assert sides[1][0].count() + sides[1][1].count() <= 2 * 600 * (4 + 1)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in balance.class_neighbours(df, "id", "label", "v", 3, exact_rows=16).collect()}
    for k in range(0, 600, 13):
        square = np.zeros(600)
        for d in range(16):
            square += (x[k, d] - x[:, d]) ** 2
        square[k] = np.inf
        assert [got[k, i] for i in (1, 2, 3)] == np.argsort(square, kind="stable")[:3].tolist()


def test_learnt_does_not_depend_on_how_many_rows_there_are(spark):
    r = np.random.default_rng(7)
    rows = [(m, k, int(k % 8 == 0), float(round(r.normal(0.2 if m == "weak" and k % 8 == 0 else 0.0), 3))) for m in ("weak", "random") for k in range(16_000)]
    df = spark.createDataFrame(rows, "model string, id long, label int, score double")
    got = {x["model"]: x for x in curves.learnt(curves.score_totals(df, 1, ["model"]), ["model"]).collect()}
    assert got["weak"]["roc_auc"] < 0.6 and got["weak"]["learnt"]
    assert not got["random"]["learnt"]


def test_bootstrap_draws_rows_not_cells(spark, sf, tmp_path):
    from bandseries.plans import learning

    for name in ("labels", "documents"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        rows.withColumn("doc_id", F.col("doc_id") + 1_000_000).write.parquet(f"{tmp_path}/{name}.parquet")
    one, two = ({r["metric"]: r for r in learning.bootstrap_ci(spark, d).collect()} for d in (sf, str(tmp_path)))
    assert all(one[m]["point"] == two[m]["point"] for m in one)
    assert any(one[m]["mean"] != two[m]["mean"] for m in one)


def test_passes_are_made_after_neighbours_are_found(spark, sf):
    from bandseries.plans import series

    once = series.aligned(spark, sf).cache()
    assert rows(fill.fill_gaps(once, n_passes=3), "pass", "object_id", "bin", *BANDS) == rows(fill.fill_gaps(fill.passes(once, 3)), "pass", "object_id", "bin", *BANDS)
    once.unpersist()
    for query in (series.gap_fill, series.align_augment):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        repeated = next(k for k, line in enumerate(plan) if "Generate explode" in line and "[pass#" in line)
        assert not any("Window" in line for line in plan[:repeated])  # no window has more rows than the aligned epochs


def test_a_forest_has_no_more_partitions_than_cores(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from bandseries.operators import models

    class Seen(RandomForestClassifier):
        def _fit(self, dataset):
            Seen.partitions = dataset.rdd.getNumPartitions()
            return super()._fit(dataset)

    plain = spark.range(400).select("id", F.array(F.col("id") % 7, F.col("id") % 3).alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    train = models.with_vector(plain, "x").repartition(100)
    models.BalancedClassifier(Seen(featuresCol="scaled", labelCol="label", numTrees=2, seed=1), balance=False).fit(train)
    assert Seen.partitions <= spark.sparkContext.defaultParallelism
    assert models.classifier("forest").getCacheNodeIds() and not models.classifier("forest", cacheNodeIds=False).getCacheNodeIds()
