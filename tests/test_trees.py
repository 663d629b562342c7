import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sievekit.plans import trees as tr


def frame(spark, x, y, parts=4):
    rows = [(int(i), [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartitionByRange(parts, "id")
    return df.select("id", array_to_vector("x").alias("features"), "label")


def data(n, d, seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, d)), 1)
    y = (x[:, 0] + (x[:, 1] > 0.5) * x[:, 2] + 0.3 * draw.normal(size=n) > 0.2).astype(float)
    return x, y


def plain_tree(x, g, h, rows, depth, l2, least):
    """Nested (feature, value, left, right) or a leaf weight, by trying every value."""
    G, H = g[rows].sum(), h[rows].sum()
    best = None
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= v]
                right = rows[x[rows, f] > v]
                if min(h[left].sum(), h[right].sum()) < least:
                    continue
                gain = (g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2)
                        - G ** 2 / (H + l2)) / 2
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, v, left, right)
    if best is None:
        return -G / (H + l2)
    return (best[1], best[2], plain_tree(x, g, h, best[3], depth - 1, l2, least),
            plain_tree(x, g, h, best[4], depth - 1, l2, least))


def nested(t, step, node=0):
    if t["feature"][node] < 0:
        return t["value"][node] / step
    return (t["feature"][node], t["cut"][node], nested(t, step, t["left"][node]), nested(t, step, t["right"][node]))


def value_of(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        assert a[:2] == b[:2]
        same(a[2], b[2])
        same(a[3], b[3])
    else:
        assert a == pytest.approx(b, abs=1e-6)


@pytest.mark.parametrize("local", [0, 60, 50_000])
def test_boosting_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(tr, "REFRESH", 2)
    monkeypatch.setattr(tr, "LOCAL_ROWS", local)
    x, y = data(200, 5, 1)
    p = tr.Boosting(rounds=5, depth=3, step=0.3, l2=1.0, least_hessian=1.0)
    model = tr.fit_boosting(frame(spark, x, y), p)
    margin = np.zeros(len(y))
    for t in model.tree_list():
        prob = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, prob - y, prob * (1 - prob), np.arange(len(y)), 3, 1.0, 1.0)
        same(nested(t, 0.3), want)
        margin += 0.3 * np.array([value_of(want, r) for r in x])
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_result_does_not_depend_on_partitions(spark):
    x, y = data(300, 4, 2)
    p = tr.Boosting(rounds=3, depth=4)
    assert tr.fit_boosting(frame(spark, x, y, 1), p).tree_list() == tr.fit_boosting(frame(spark, x, y, 7), p).tree_list()


def test_many_open_nodes_take_several_jobs(spark, monkeypatch):
    x, y = data(300, 4, 3)
    monkeypatch.setattr(tr, "LOCAL_ROWS", 20)
    want = tr.fit_boosting(frame(spark, x, y), tr.Boosting(rounds=1, depth=5)).tree_list()
    monkeypatch.setattr(tr, "JOB_NODES", 2)
    assert tr.fit_boosting(frame(spark, x, y), tr.Boosting(rounds=1, depth=5)).tree_list() == want


def test_where_a_node_grows_does_not_matter(spark, monkeypatch):
    x, y = data(300, 9, 8)
    df, p = frame(spark, x, y), tr.Forest(trees=5, seed=1)

    def shape(t, node=0):
        if t["feature"][node] < 0:
            return t["value"][node], t["n"][node]
        return t["feature"][node], t["cut"][node], shape(t, t["left"][node]), shape(t, t["right"][node])

    found = []
    for local in (0, 40, 50_000):
        monkeypatch.setattr(tr, "LOCAL_ROWS", local)
        found.append([shape(t) for t in tr.fit_forest(df, p).tree_list()])
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("local", [0, 50_000])
def test_forest_rules(spark, monkeypatch, local):
    monkeypatch.setattr(tr, "TREES_AT_ONCE", 6)
    monkeypatch.setattr(tr, "LOCAL_ROWS", local)
    x, y = data(400, 9, 4)
    p = tr.Forest(trees=10, depth=20, min_split=5, min_leaf=2, seed=7)
    df = frame(spark, x, y)
    model = tr.fit_forest(df, p)
    rows = tr.binned_rows(df, tr.cut_points(df, 9)).select("row", "label").collect()
    for k, t in enumerate(model.tree_list()):
        drawn = tr.bootstrap(np.array([r.row for r in rows]), k, 7)
        assert t["n"][0] == (drawn > 0).sum()
        path = {0: 1}
        for node, f in enumerate(t["feature"]):
            if f >= 0:
                path[t["left"][node]], path[t["right"][node]] = 2 * path[node], 2 * path[node] + 1
            if f >= 0:  # no node under five rows is split, no leaf has one row
                assert t["n"][node] >= 5
                assert t["n"][t["left"][node]] + t["n"][t["right"][node]] == t["n"][node]
                assert min(t["n"][t["left"][node]], t["n"][t["right"][node]]) >= 2
                assert f in p.features(k, path[node], 9)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_forest_cuts_are_the_best(spark):
    """The root's cut of each tree has the largest fall of impurity."""
    x, y = data(200, 4, 5)
    df = frame(spark, x, y, 3)
    model = tr.fit_forest(df, tr.Forest(trees=4, depth=1, min_leaf=2, seed=3))
    ids = df.select("id", F.monotonically_increasing_id().alias("row")).collect()
    row = {r.id: r.row for r in ids}
    for k, t in enumerate(model.tree_list()):
        w = tr.bootstrap(np.array([row[i] for i in range(200)]), k, 3).astype(float)

        def impurity(m):
            total, pos = w[m].sum(), (w * y)[m].sum()
            return 2 * pos * (total - pos) / max(total, 1)

        ways = [(impurity(np.arange(200)) - impurity(x[:, f] <= v) - impurity(x[:, f] > v), -f, -v)
                for f in tr.Forest(seed=3).features(k, 1, 4) for v in np.unique(x[:, f])[:-1]
                if min(((x[:, f] <= v) & (w > 0)).sum(), ((x[:, f] > v) & (w > 0)).sum()) >= 2]
        top = max(g for g, *_ in ways)
        assert (t["feature"][0], t["cut"][0]) in {(-f, -v) for g, f, v in ways if g > top - 1e-9}


def test_bootstrap_is_poisson():
    drawn = tr.bootstrap(np.arange(200_000), 3, 42)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    assert (drawn != tr.bootstrap(np.arange(200_000), 4, 42)).mean() > 0.5


def test_saved_model_scores_alike(spark, tmp_path):
    from pyspark.ml import PipelineModel
    x, y = data(120, 3, 6)
    df = frame(spark, x, y)
    model = PipelineModel([tr.fit_boosting(df, tr.Boosting(rounds=3, depth=3))])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    pick = ["id", "prediction", "probability"]
    assert model.transform(df).select(pick).collect() == again.transform(df).select(pick).collect()


def test_cut_points(spark):
    """All values while they are few; even quantiles beyond that, whatever the partitions."""
    draw = np.random.default_rng(9)
    x = np.stack([draw.integers(0, 40, 20_000), draw.normal(size=20_000)], 1).astype(float)
    few, many = tr.cut_points(frame(spark, x, np.zeros(20_000), 6), 2)
    assert few.tolist() == list(range(39))
    share = np.searchsorted(np.sort(x[:, 1]), many, "right") / 20_000
    assert len(many) == 255 and np.abs(share - np.arange(1, 256) / 256).max() < 0.003


def test_one_class_and_constant_features(spark):
    x = np.zeros((20, 2))
    model = tr.fit_boosting(frame(spark, x, np.ones(20)), tr.Boosting(rounds=2, depth=3))
    assert all(t["feature"] == [-1] for t in model.tree_list()) and (model.score(x) > 0.5).all()
    forest = tr.fit_forest(frame(spark, x, np.ones(20)), tr.Forest(trees=3))
    assert (forest.score(x) == 1).all()


def test_sums_without_the_common_bins(monkeypatch):
    """Only cells off the common bin are added up; completed, the sums are those of all cells."""
    draw = np.random.default_rng(11)
    cuts = [np.arange(w, dtype=float) for w in (0, 1, 3, 6)]
    bins = np.stack([draw.integers(0, len(c) + 1, 500) * (draw.random(500) < 0.1) for c in cuts], 1).astype(np.uint8)
    slot = draw.integers(0, 3, 500)
    n, a, b = np.ones(500), draw.integers(-9, 9, 500).astype(float), draw.integers(0, 9, 500).astype(float)
    for features in (None, np.array([[0, 2], [1, 3], [2, 3]])):
        for common in (np.zeros(4, int), np.array([0, 1, 2, 5])):
            layout = tr.Layout(cuts, common)
            row, cells = layout.cells(bins, slot, features)
            if not common.any():
                assert len(cells) < bins.size * 0.2
            values, sums = layout.complete(*tr._cell_sums(row, cells, 3 * layout.width, n, a, b),
                                           tr._sums(slot, 3, n, a, b), features)
            got = dict(zip(values.tolist(), map(tuple, sums.tolist())))
            want = {}
            for i in range(500):
                for f in range(4) if features is None else features[slot[i]]:
                    at = int(slot[i] * layout.width + layout.offset[f] + bins[i, f])
                    want[at] = tuple(int(x) + y for x, y in zip((n[i], a[i], b[i]), want.get(at, (0, 0, 0))))
            assert got == want


def shape(t, node=0):
    if t["feature"][node] < 0:
        return round(t["value"][node], 6), t["n"][node]
    return t["feature"][node], t["cut"][node], shape(t, t["left"][node]), shape(t, t["right"][node])


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_trees_of_one_stage_are_those_of_a_job_a_level(spark, monkeypatch, block):
    """One task, several that exchange sums, or a job a level: the same trees."""
    monkeypatch.setattr(tr, "STAGE_TREES", 3)
    monkeypatch.setattr(tr, "HELD_TREES", 600)
    monkeypatch.setattr(tr, "JOB_NODES", 7)
    monkeypatch.setattr(tr, "BLOCK", block)
    monkeypatch.setattr(tr, "LOCAL_ROWS", 100)
    x, y = data(300, 9, 8)
    x[:, 3:] *= np.random.default_rng(1).random((300, 6)) < 0.2  # a common bin
    df, found = frame(spark, x, y), []
    for size in (0, 1, 3):
        monkeypatch.setattr(tr, "crew_size", lambda *_: size)
        found.append([[shape(t) for t in model.tree_list()] for model in (
            tr.fit_boosting(df, tr.Boosting(rounds=7, depth=6, step=0.3)), tr.fit_forest(df, tr.Forest(trees=5, seed=2)))])
    assert found[0] == found[1] == found[2]


def test_a_fit_is_a_few_stages(spark):
    """200 rounds took a job and more each."""
    x, y = data(300, 5, 8)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        tr.fit_boosting(frame(spark, x, y), tr.Boosting(rounds=60, depth=3))
        assert len(tracker.getJobIdsForGroup("rounds")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_crew_needs_slots_and_a_shared_folder(spark, monkeypatch):
    assert tr.crew_size(spark, 10) == 1
    most = tr.crew_size(spark, 10 ** 9)
    assert most > 1
    spark.sparkContext.setLocalProperty(tr.SIDE_BY_SIDE, "2")
    try:
        assert tr.crew_size(spark, 10 ** 9) == most // 2
    finally:
        spark.sparkContext.setLocalProperty(tr.SIDE_BY_SIDE, None)
    monkeypatch.setattr(tr, "shared_path", lambda *_: "hdfs://h/x")
    assert tr.crew_size(spark, 10 ** 9) == 0 and tr._folder("file:///a/b") == tr._folder("file:/a/b") == "/a/b"


@pytest.mark.parametrize("size", [0, 1, 2])
def test_gradient_boosting_equals_brute_force(spark, monkeypatch, size):
    """Least-squares trees on the residuals from the log-odds on, Newton steps as leaves."""
    monkeypatch.setattr(tr, "crew_size", lambda *_: size)
    monkeypatch.setattr(tr, "STAGE_TREES", 3)
    monkeypatch.setattr(tr, "REFRESH", 2)
    x, y = data(150, 4, 12)
    first, *found = tr.fit_boosting(frame(spark, x, y), tr.GradientBoosting(rounds=4, depth=3, step=0.2)).tree_list()
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    assert first["feature"] == [-1] and first["value"] == pytest.approx([margin[0]]) and len(found) == 4
    for t in found:
        prob = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))

        def walk(want, node, rows):
            if not isinstance(want, tuple):
                assert t["feature"][node] < 0 and t["n"][node] == len(rows)
                p = prob[rows]
                step[rows] = 0.2 * (y[rows] - p).sum() / (p * (1 - p)).sum()
                assert t["value"][node] == pytest.approx(step[rows[0]], abs=1e-5)
                return
            assert (t["feature"][node], t["cut"][node]) == want[:2]
            low = x[rows, want[0]] <= want[1]
            walk(want[2], t["left"][node], rows[low])
            walk(want[3], t["right"][node], rows[~low])

        walk(plain_tree(x, prob - y, np.ones(len(y)), np.arange(len(y)), 3, 0.0, 1.0), 0, np.arange(len(y)))
        margin += step


def test_gradient_boosting_of_one_class(spark):
    model = tr.fit_boosting(frame(spark, np.zeros((20, 2)), np.ones(20)), tr.GradientBoosting(rounds=2, depth=3))
    assert (model.score(np.zeros((3, 2))) > 0.99).all()
