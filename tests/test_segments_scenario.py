"""Segmentation and scenario invariants."""

from pyspark.sql import functions as F

from almagest.operators import scenario as Z
from almagest.operators import segments as G
from almagest.sources import canonical as C


def test_segments_ordered_by_spend(spark, sf_dir):
    micro = C.microdata(spark, sf_dir, with_raw=True)
    labels = G.segment(micro, k=None, seed=42, restarts=1)
    j = micro.join(labels, G.KEY)
    assert j.count() == micro.count()
    stats = j.groupBy("cluster_id").agg(F.avg("gasto_euros").alias("s"), F.count("*").alias("n")).orderBy("cluster_id").collect()
    k = len(stats)
    assert 2 <= k <= 8 and [r.cluster_id for r in stats] == list(range(k))
    spends = [r.s for r in stats]
    assert spends == sorted(spends)
    prof = G.profiles(j).collect()
    assert abs(sum(r.size_pct for r in prof) - 100.0) < 0.5


def test_scenario_zero_change_equals_baseline(spark, sf_dir):
    ts = C.time_series(spark, sf_dir)
    geo = C.geo_dim(spark, sf_dir)
    grid = Z.scenario_grid(occupancy=(0.0, 20.0), price=(0.0,), foreign=(0.0,))
    aligned, model, sd = Z.run(ts, geo, horizon=6, gbt_params=dict(maxIter=5, maxDepth=3, seed=42), grid=grid)
    rows = aligned.collect()
    assert rows and all(r.value >= 0 and r.ci_lower_95 >= 0 for r in rows)
    zero = [r for r in rows if r.occupancy_pct == 0]
    assert all(r.value == r.baseline for r in zero)
    assert {r.h for r in rows} == set(range(1, 7))
    imp = Z.impact(aligned).filter(F.col("occupancy_pct") == 0).collect()
    assert all(r.avg_change_pct == 0.0 and r.direction == "neutral" for r in imp)
    w = [r.importance for r in Z.importances(spark, model).collect()]
    assert abs(sum(w) - 1.0) < 1e-6


def test_segments_of_clear_groups(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(3)
    spots = r.standard_normal((4, 3)) * 8
    at = r.integers(0, 4, 600)
    x = spots[at] + r.standard_normal((600, 3))
    df = spark.createDataFrame([("q", i, Vectors.dense(row), float(row[0])) for i, row in enumerate(x)],
                               ["quarter", "cuestionario", "features", "gasto_euros"]).repartition(5).persist()
    assert G.choose(df) == 4
    one, best = G._fit(df, 4, 42).summary.trainingCost, G.fit_segments(df, 4, 42, restarts=4)
    assert best.summary.trainingCost <= one + 1e-6
    centres = np.array(best.clusterCenters())
    assert np.allclose(sorted(centres.sum(axis=1)), sorted(spots.sum(axis=1)), atol=0.5)
    labels = G.relabel_by_spend(best.transform(df)).select("cuestionario", "cluster_id").collect()
    found = np.zeros(600, int)
    for row in labels:
        found[row.cuestionario] = row.cluster_id
    assert len({(a, b) for a, b in zip(at.tolist(), found.tolist(), strict=True)}) == 4
    assert G.choose(df.limit(2)) == 2
    df.unpersist()


def test_profiles_of_missing_answers(spark, sf_dir):
    micro = C.microdata(spark, sf_dir, with_raw=True)
    few = micro.limit(40).withColumn("cluster_id", F.when(F.col("cuestionario") % 3 != 0, F.lit(7)))
    few = few.withColumns({"edad": F.lit(None).cast("int"), "proposito": F.lit("_Z"), "nacionalidad": F.lit(None).cast("string")})
    rows = G.profiles(few).collect()
    assert [r.cluster_id for r in rows] == [7] and rows[0].cluster_name == "Cluster 7"
    assert rows[0].avg_age is None and rows[0].purpose is None and rows[0].top_nationalities == [] and rows[0].size_pct == 100.0
    assert G.summary(G.profiles(few)).columns == G.SUMMARY
    assert G.detail(G.profiles(few), 7).count() == 1 and G.detail(G.profiles(few), 1).count() == 0
    assert G.profiles(few.filter("false")).count() == 0


def test_a_profile_reads_respondents_once(spark, sf_dir):
    micro = C.microdata(spark, sf_dir, with_raw=True).withColumn("cluster_id", F.lit(0))
    plan = G.answers(micro)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_baseline_does_not_depend_on_the_grid(spark, sf_dir):
    ts, geo = C.time_series(spark, sf_dir), C.geo_dim(spark, sf_dir)
    params = dict(maxIter=3, maxDepth=2, seed=42)
    with_zero, _, _ = Z.run(ts, geo, 2, params, Z.scenario_grid((0.0, 10.0), (0.0,), (0.0,)))
    without, _, _ = Z.run(ts, geo, 2, params, Z.scenario_grid((10.0,), (0.0,), (0.0,)))
    want = {(r.geo_code, r.h): r.baseline for r in with_zero.collect()}
    got = {(r.geo_code, r.h): r.baseline for r in without.collect()}
    assert got == want and None not in got.values()


def test_fits_in_step_equal_single_fits(spark):
    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(5)
    x = r.standard_normal((500, 4)) + r.integers(0, 3, 500)[:, None] * 3
    df = spark.createDataFrame([(Vectors.dense(row),) for row in np.concatenate([x, x[:50]])], ["features"]).repartition(4).persist()
    fits = [(2, 42), (3, 42), (5, 43)]
    blocks = G._blocks(df)
    passes, totals = [], G._totals
    G._totals = lambda *a: passes.append(1) or totals(*a)
    try:
        centres, costs = G._together(blocks, G._first_centres(df, fits))
    finally:
        G._totals = totals
    single = [G._fit(df, *f) for f in fits]
    assert len(passes) <= max(m.summary.numIter for m in single) + 2  # as many as the longest fit, not the sum
    for c, cost, score, m in zip(centres, costs, G._silhouettes(blocks, centres), single, strict=True):
        assert np.allclose(c, np.array(m.clusterCenters()), atol=1e-8) and abs(cost - m.summary.trainingCost) < 1e-6
        assert abs(score - ClusteringEvaluator().evaluate(m.transform(df))) < 1e-9
    df.unpersist()


class _Counted:
    """A kept RDD that counts the passes over it."""

    def __init__(self, rdd):
        self.rdd, self.passes = rdd, 0

    def __getattr__(self, name):
        if name.startswith("mapPartitions"):
            self.passes += 1
        return getattr(self.rdd, name)


def test_draws_of_many_rows_share_their_passes(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(7)
    x = np.concatenate([r.standard_normal((1500, 3)), r.standard_normal((1500, 3)) + 12, r.standard_normal((4, 3)) + 300])
    df = spark.createDataFrame([(Vectors.dense(row),) for row in r.permutation(np.concatenate([x, x[:90]]))], ["features"]).repartition(6).persist()
    monkeypatch.setattr(G, "WHOLE_DRAW", 0)
    monkeypatch.setattr(G, "_fit", None)  # nothing is fitted anew, nor the best seed once more
    blocks, fits = G._blocks(df), [(k, 42 + i) for i, k in enumerate((2, 3, 3, 5, 8))]
    few, many = _Counted(blocks), _Counted(blocks)
    G._first_centres(df, fits[1:2], few)
    found = G._first_centres(df, fits, many)
    assert few.passes == many.passes == G.ROUNDS + 2  # first rows, rounds, weights: not a pass for each fit
    assert [c.shape for c in found] == [(k, 3) for k, _ in fits]
    again = G._first_centres(df, fits, blocks)
    assert all(np.array_equal(a, b) for a, b in zip(found, again, strict=True))
    for c in found[1:]:  # four rows far off have a centre from the start
        assert np.abs(c - 300).sum(axis=1).min() < 6
    best = G.fit_segments(df, 3, 42, restarts=2, blocks=blocks)
    assert sorted(round(c.mean() / 12) for c in best.clusterCenters()) == [0, 1, 25]
    near = ((x[:, None] - np.array(best.clusterCenters())[None]) ** 2).sum(axis=2).min(axis=1)
    assert abs(best.summary.trainingCost - near.sum() - near[:90].sum()) < 1e-6
    assert sorted(n for (n,) in best.transform(df).groupBy("prediction").count().select("count").collect()) == [4, 1500, 1590]
    blocks.unpersist()
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 20, ["features"])
    one = G.fit_segments(same, 3, 42, restarts=2)
    assert [c.tolist() for c in one.clusterCenters()] == [[1.0, 2.0]] and one.transform(same).filter("prediction <> 0").count() == 0
    df.unpersist()


def test_scaled_equals_the_library(spark):
    import numpy as np
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    r, cols = np.random.default_rng(11), G.feature_columns()
    rows = []
    for i in range(300):
        value = {c: float(r.integers(0, 4)) if c.startswith("imp_") else float(r.random() < 0.3) for c in cols}
        value |= {c: float(r.lognormal(8, 2)) for c in G.NUMERIC} | {"personas": 4.0, "act_golf": 1.0, "proposito_top5": 0.0}
        value |= {c: None for c in (*G.NUMERIC[:4], "imp_mar", "satisfaccion_n") if r.random() < 0.2}
        rows.append(("2020Q1", i, *[value[c] for c in cols]))
    feat = spark.createDataFrame(rows, f"quarter string, cuestionario long, {', '.join(f'{c} double' for c in cols)}").persist()
    names = [f"{c}__i" for c in cols]
    wide = Imputer(inputCols=cols, outputCols=names, strategy="median").fit(feat).transform(feat)
    wide = VectorAssembler(inputCols=names, outputCol="all").transform(wide)
    want = StandardScaler(inputCol="all", outputCol="want", withMean=True, withStd=True).fit(wide).transform(wide)
    want = {x.cuestionario: x.want.toArray() for x in want.select("cuestionario", "want").collect()}
    kept = G.narrow(feat)
    assert dict(kept.dtypes)["act_playa"] == dict(kept.dtypes)["imp_mar"] == "tinyint" and dict(kept.dtypes)["edad"] == "double"
    got = G.scaled(kept).collect()
    assert len(got) == 300 and all(np.allclose(x.features.toArray(), want[x.cuestionario], rtol=1e-9, atol=1e-12) for x in got)
    feat.unpersist()


def test_profiles_of_coded_respondents(spark, sf_dir):
    from almagest.operators import sinks as K

    micro = C.microdata(spark, sf_dir, with_raw=True).limit(300)
    micro = micro.unionByName(micro.limit(5)).withColumn("quarter", F.when(F.col("cuestionario") % 11 != 0, F.col("quarter"))).persist()
    labels = micro.select(*G.KEY, (F.col("cuestionario") % 3).cast("int").alias("cluster_id")).distinct()
    wide, coded = K.label_back(micro, labels, G.KEY), K.label_back(G.coded(micro), labels, G.KEY)
    assert "raw" not in coded.columns and "raw_json" not in coded.columns and dict(coded.dtypes)["ACTIV_GOLF"] == "tinyint"
    assert coded.filter("cluster_id IS NULL").count() > 0
    want, got = (G.profiles(x).orderBy("cluster_id").collect() for x in (wide, coded))
    assert len(want) == 3 and want == got
    micro.unpersist()


def test_numbers_become_exact_once_a_respondent(spark, sf_dir):
    micro = C.microdata(spark, sf_dir, with_raw=True).withColumn("cluster_id", F.col("cuestionario") % 2)
    node, above, below = G.answers(micro)._jdf.queryExecution().optimizedPlan(), [], []
    into = above
    while node.children().size():
        into = below if node.nodeName() == "Generate" else into
        into.append(node.expressions().toString())
        node = node.children().head()
    assert below and "decimal(28,6)" in " ".join(below) and " as decimal(28,6)" not in " ".join(above)


def test_labels_meet_narrow_respondents(spark, sf_dir, monkeypatch):
    from almagest.plans import segment_queries as Q

    labels = C.microdata(spark, sf_dir).select(*G.KEY, (F.col("cuestionario") % 2).cast("int").alias("cluster_id"))
    monkeypatch.setattr(Q, "_labels", lambda spark, sf: labels, raising=False)
    monkeypatch.setattr(Q.G, "segment", None)  # nothing is trained here
    sizes = {r.cluster_id: r["size"] for r in Q.m15_segments(spark, sf_dir).collect()}
    assert sum(sizes.values()) == labels.count() and set(sizes) == {0, 1}
    assert not {"raw", "raw_json"} & set(Q._segmented(spark, sf_dir).columns)
    assert {r.cluster_id: r["size"] for r in Q.q14_trained(spark, sf_dir).collect()} == sizes
