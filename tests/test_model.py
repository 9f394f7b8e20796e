"""Forest, components, stability and ranking."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditrank import fixed_values as fv
from auditrank.operators import iforest as fo
from auditrank.operators.pca import fit_components, variance_table
from auditrank.operators.consolidate import KEY
from auditrank.operators.iforest import ForestSettings, fit_forest, with_scores
from auditrank.plans.model import SCORE, classified
from auditrank.plans.stability import stability

FEATURES = ["x", "y", "z"]


def _points(n=1_000, outliers=8):
    rng = np.random.default_rng(11)
    data = pd.DataFrame(rng.normal(size=(n, 3)), columns=FEATURES)
    data.loc[: outliers - 1, FEATURES] = rng.choice([-1, 1], size=(outliers, 3)) * 12
    data.insert(0, "id_cliente", [f"{i:05d}" for i in range(n)])
    return data


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(_points()).repartition(6)


def test_average_path_closed_form():
    n = 256
    harmonic = math.log(n - 1) + 0.5772156649015329
    out = fo.average_path(np.array([0, 1, 2, n]))
    assert list(out[:3]) == [0.0, 0.0, 1.0]
    assert out[3] == pytest.approx(2 * harmonic - 2 * (n - 1) / n)


def test_scores_of_a_hand_built_tree():
    """x <= 1: leaf of 1 row; else y <= 5: leaves of 1 and 4 rows."""
    nodes = pd.DataFrame(
        [(0, 0, 0, 1.0, 1, 2, 6, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, 1, 5.0, 3, 4, 5, 1),
         (0, 3, -1, 0.0, -1, -1, 1, 2), (0, 4, -1, 0.0, -1, -1, 4, 2)],
        columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"],
    )
    forest = fo.packed(nodes, ["x", "y"], 6)
    x = np.array([[0.0, 9.0], [1.0, 0.0], [2.0, 5.0], [2.0, 6.0]])
    paths = forest.path_sums(x, [1])[:, 0]
    assert paths == pytest.approx([1, 1, 2, 2 + fo.average_path(np.array([4]))[0]])
    normal = fo.average_path(np.array([6]))[0]
    assert forest.score_samples(x, [1])[:, 0] == pytest.approx(-(2 ** (-paths / normal)))


def test_grown_trees_are_sound():
    x = _points(256)[FEATURES].to_numpy()
    nodes = {n[0]: n for n in fo.grow_tree(x, 42, 1)}
    assert sorted(fo.grow_tree(x[::-1], 42, 1)) == sorted(nodes.values()) != sorted(fo.grow_tree(x, 42, 2))
    assert nodes[0][5] == 256
    for _, feature, _, left, right, size, depth in nodes.values():
        assert depth <= 8
        if feature >= 0:
            assert nodes[left][5] + nodes[right][5] == size
            assert nodes[left][5] > 0 and nodes[right][5] > 0
    assert fo.grow_tree(np.ones((5, 2)), 42, 1) == [(0, -1, 0.0, -1, -1, 5, 0)]


def test_samples_have_exact_size_and_draw_evenly(spark, points):
    settings = fo.ForestSettings(trees=40)
    samples = fo.tree_samples(points, "id_cliente", settings, 1_000, 1.2).toPandas()
    per_tree = samples.groupby("tree").size()
    assert len(per_tree) == 40 and (per_tree == 256).all()
    assert samples.duplicated(["tree", "id_cliente"]).sum() == 0
    per_row = samples.groupby("id_cliente").size().reindex(_points()["id_cliente"], fill_value=0)
    assert per_row.sum() == 40 * 256 and per_row.max() <= 14  # three trees a round, 14 rounds
    assert 6 < per_row.quantile(0.05) <= per_row.quantile(0.95) < 14  # mean 10.2, deviation 1.5


def test_large_tables_are_hashed_once_and_cut_before_the_shuffle(spark, points):
    samples = fo.tree_samples(points, "id_cliente", fo.ForestSettings(trees=4, max_samples=16), 1_000, 1.2)
    plan = samples._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert plan.count("WindowGroupLimit") >= 2
    found = samples.toPandas()
    assert dict(found.groupby("tree").size()) == dict.fromkeys(range(4), 16)
    assert found["id_cliente"].is_unique  # one round: no row in two trees


def test_samples_follow_from_a_plain_hash(spark, points):
    import hashlib

    found = fo.tree_samples(points, "id_cliente", fo.ForestSettings(trees=5), 1_000, 5.0).toPandas()
    for r in (0, 1):
        ids = sorted(_points()["id_cliente"], key=lambda i: (hashlib.md5(f"{i}|42|{r}".encode()).hexdigest()[:13], i))
        for c in range(3 if r == 0 else 2):
            assert set(found.loc[found["tree"] == 3 * r + c, "id_cliente"]) == set(ids[256 * c : 256 * (c + 1)])

def test_planted_outliers_rank_first_and_layout_does_not_matter(spark, points):
    settings = fo.ForestSettings(trees=60)
    one = fo.fit_forest(points.coalesce(1), "id_cliente", FEATURES, settings)
    many = fo.fit_forest(points.repartition(16), "id_cliente", FEATURES, settings)
    scored = [
        fo.with_scores(p, [(f, {60: "s"})]).toPandas().sort_values("id_cliente")["s"].to_numpy()
        for f, p in ((one, points), (many, points.repartition(3)))
    ]
    assert np.array_equal(*scored)
    assert set(np.argsort(scored[0])[:8]) == set(range(8))
    assert ((scored[0] < 0) & (scored[0] > -1)).all()


def test_first_trees_of_a_larger_forest_are_the_smaller_one(spark, points):
    small = fo.fit_forest(points, "id_cliente", FEATURES, fo.ForestSettings(trees=10))
    large = fo.fit_forest(points, "id_cliente", FEATURES, fo.ForestSettings(trees=25))
    both = fo.with_scores(points, [(small, {10: "a"}), (large, {10: "b", 25: "c"})])
    assert both.where("a <> b").isEmpty() and not both.where("b <> c").isEmpty()


def test_small_tables_use_all_rows(spark):
    df = spark.createDataFrame(_points(20, 1))
    forest = fo.fit_forest(df, "id_cliente", FEATURES, fo.ForestSettings(trees=30))
    assert forest.sample_size == 20
    scores = fo.with_scores(df, [(forest, {30: "s"})]).orderBy("s").first()
    assert scores.id_cliente == "00000"
    with pytest.raises(ValueError):
        fo.fit_forest(df.where("x > 1e9"), "id_cliente", FEATURES, fo.ForestSettings())


def test_flag_share_and_levels(spark, points):
    scores = points.select("id_cliente", (-F.abs("x") / 100).alias("s"))
    out = classified(scores, "s", 0.05).toPandas()
    assert out["cliente_atipico_iforest_v4"].sum() == 50
    assert (out["score_anomalia_iforest_v4"] > 0).sum() == 50
    counts = out["nivel_prioridade_iforest_v4"].value_counts()
    assert dict(counts) == {"Baixa": 899, "Moderada": 50, "Alta": 40, "Crítica": 11}
    top = out.sort_values("ranking_anomalia_iforest_v4").iloc[0]
    assert top["percentil_anomalia_iforest_v4"] == 99.65  # eight outliers tie: mean of places 993 to 1000


def test_components_equal_svd(spark, points):
    data = _points()[FEATURES].to_numpy()
    found = fit_components(points, FEATURES)
    centred = data - data.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    for i in range(2):
        v = vt[i] * (1 if vt[i][np.abs(vt[i]).argmax()] > 0 else -1)
        assert np.allclose(found.loadings[i], v, atol=1e-8)
    assert np.allclose(found.shares, (s**2 / (s**2).sum())[:2])
    projected = points.select(found.projection(0, [F.col(c) for c in FEATURES]).alias("p")).toPandas()["p"]
    assert abs(projected.mean()) < 1e-9
    rows = variance_table(points, found).collect()
    assert rows[2].variancia_explicada == pytest.approx(rows[0].variancia_explicada + rows[1].variancia_explicada)


def test_stability_of_the_base_setting_is_one(spark, points):
    def scores(settings):
        forest = fit_forest(points, KEY, FEATURES, settings)
        return with_scores(points, [(forest, {forest.trees: "s"})]).select(KEY, (-F.col("s")).alias(SCORE))

    base = scores(ForestSettings())
    same = scores(ForestSettings(max_samples="256"))
    assert base.exceptAll(same).isEmpty()  # the study fits both as one
    rows = {(r.n_estimators, r.max_samples): r for r in stability(base, points, FEATURES).collect()}
    assert list(rows) == list(fv.STABILITY_SETTINGS)
    for setting in ((300, "auto"), (300, "256")):
        r = rows[setting]
        assert r.correlacao_spearman_ranking == pytest.approx(1.0)
        assert (r.sobreposicao_top100, r.sobreposicao_top1000) == (1.0, 1.0)
    for r in rows.values():
        assert 0.8 < r.correlacao_spearman_ranking <= 1.0 + 1e-9 and 0 <= r.sobreposicao_top100 <= 1
        assert r.sobreposicao_top1000 == 1.0  # all customers
