"""Tree learners and the line against direct versions in numpy."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.hashing import hash52, uniform
from wattloom.operators import linear, trees
from wattloom.runtime import scratch_path

ORDER = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, t double"


def some_rows(seed, n):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(0, 3, n).round(1), rng.integers(0, 4, n) * 1.0, np.full(n, 7.0)
    t = np.where(a > 0, 20.0, -5.0) + 3 * b + rng.normal(0, 1, n).round(2)
    return [(i, *map(float, x)) for i, x in enumerate(zip(a, b, c, t))]


@pytest.fixture(scope="module")
def rows():
    return some_rows(3, 300)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_cuts(x, bins):
    s = np.sort(x)
    return sorted({s[int(np.ceil(k / bins * len(s))) - 1] for k in range(1, bins)})


def brute_tree(x, r, w, cuts, depth, l2, rate):
    """Leaf values and weights by recursion over all features and cuts; r are exact steps."""
    s, h = (w * r).sum(), w.sum()
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                left = x[:, f] <= cut
                sl, hl = (w * r)[left].sum(), w[left].sum()
                if 1 <= hl <= h - 1:
                    gain = sl * sl / (hl + l2) + (s - sl) ** 2 / (h - hl + l2) - s * s / (h + l2)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (f, cut))
    if best[1] is None:
        return lambda q: np.full(len(q), rate * s / (h + l2))
    f, cut = best[1]
    side = x[:, f] <= cut
    lo = brute_tree(x[side], r[side], w[side], cuts, depth - 1, l2, rate)
    hi = brute_tree(x[~side], r[~side], w[~side], cuts, depth - 1, l2, rate)
    return lambda q: np.where(q[:, f] <= cut, lo(q), hi(q))


def predictions(model, table):
    return np.array([r.p for r in model.predict(table, "p").orderBy("id").collect()])


@pytest.mark.parametrize("task_rows", [0, 40, 1 << 17])
def test_boosting_matches_a_direct_version(table, rows, task_rows):
    x, t = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    rounds, depth = (3, 3) if task_rows < 100 else (12, 4)
    model = trees.fit_boosted(table, ORDER, "t", rounds, depth, 0.05, 16, task_rows=task_rows)
    cuts = [brute_cuts(x[:, f], 16) for f in range(3)]
    y = np.floor(t * 65536 + 0.5) / 65536
    pred = np.full(len(y), y.mean())
    for _ in range(rounds):
        r = np.floor((y - pred) * 65536 + 0.5) / 65536
        pred = pred + brute_tree(x, r, np.ones(len(y)), cuts, depth, 1.0, 0.05)(x)
    np.testing.assert_allclose(predictions(model, table), pred, rtol=1e-9)


def test_boosting_gets_closer_to_the_target(table, rows):
    t = np.array([r[4] for r in rows])
    model = trees.fit_boosted(table, ORDER, "t", 12, 3, 0.3, 16)
    assert np.sqrt(np.mean((predictions(model, table) - t) ** 2)) < 0.35 * t.std()
    assert len(model.roots) == 12 and model.depth <= 3


def bootstrap(spark, ids, tree, seed):
    u = spark.createDataFrame([(i,) for i in ids], "id long").select(
        (hash52(F.concat(F.lit(f"{tree}:"), F.col("id").cast("string")), f"bag{seed}") / 2.0 ** 52).alias("u"))
    return np.array([np.searchsorted(trees.POISSON, r.u, "right") for r in u.collect()])


@pytest.mark.parametrize("task_rows", [0, 60, 1 << 17])
def test_forests_match_a_direct_version(spark, table, rows, task_rows):
    x, t = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    model = trees.fit_forest(table, ORDER, "t", "id", 3, 4, 16, 7, task_rows=task_rows)
    cuts, y = [brute_cuts(x[:, f], 16) for f in range(3)], np.floor(t * 65536 + 0.5) / 65536
    each = []
    for k in range(3):
        w = bootstrap(spark, [r[0] for r in rows], k, 7)
        some = w > 0
        each.append(brute_tree(x[some], y[some], w[some], cuts, 4, 0.0, 1.0)(x))
        assert abs(w.mean() - 1) < 0.25
    np.testing.assert_allclose(predictions(model, table), np.mean(each, 0), rtol=1e-9)


def test_small_subtrees_in_tasks_are_those_of_the_cluster(table):
    found = [trees.fit_forest(table, ORDER, "t", "id", 4, 6, 16, 1, task_rows=n) for n in (0, 25, 1 << 17)]
    walked = [predictions(m, table) for m in found]
    assert (walked[0] == walked[1]).all() and (walked[0] == walked[2]).all()
    shapes = [sorted(zip(m.nodes.tree, m.nodes.feature, m.nodes.threshold, m.nodes.value, m.nodes.weight)) for m in found]
    assert shapes[0] == shapes[1] == shapes[2]


def test_unlimited_trees_end_in_pure_leaves(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(i), float(rng.integers(0, 9)), 0.0, round(float(rng.normal(0, 50)), 2)) for i in range(200)]
    # A comb: each row can only be told from the rest one after the other.
    rows += [(200 + k, 1000.0 + k, 0.0, 0.0, round(1000 * 1.5 ** k, 2)) for k in range(52)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = trees.fit_forest(table, ORDER, "t", "id", 2, 10_000, 256, 5)
    assert model.depth > 30
    for k in range(2):
        w = bootstrap(spark, [r[0] for r in rows], k, 5)
        own = trees.TreeModel(ORDER, 0.0, True, [model.roots[k]], model.nodes)
        p, t = predictions(own, table), np.array([r[4] for r in rows])
        np.testing.assert_allclose(p[w > 0], t[w > 0], rtol=1e-6, atol=0.01)


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.5)], SCHEMA)
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 4.0) for i in range(9)], SCHEMA)
    for table, value in ((one, 5.5), (same, 4.0)):
        boosted = trees.fit_boosted(table, ORDER, "t", 3, 4, 0.05, 16)
        assert predictions(boosted, table).tolist() == pytest.approx([value] * table.count())
        assert boosted.depth == 0 and boosted.importances().tolist() == [0, 0, 0]
    forest = trees.fit_forest(same, ORDER, "t", "id", 5, 4, 16, 1)
    assert set(predictions(forest, same)) == {4.0}
    with pytest.raises(ValueError, match="no rows"):
        trees.fit_forest(same.limit(0), ORDER, "t", "id", 5, 4, 16, 1)
    nan = spark.createDataFrame([(i, float("nan") if i > 4 else 1.0, 0.0, 0.0, float(i > 4)) for i in range(9)], SCHEMA)
    above = trees.fit_boosted(nan, ORDER, "t", 1, 1, 1.0, 16, l2=0.0)
    assert predictions(above, nan).tolist() == pytest.approx([0.0] * 5 + [1.0] * 4, abs=1e-4)
    gap = spark.createDataFrame([(1, None, 1.0, 1.0, 4.0)], SCHEMA)
    with pytest.raises(Exception, match="a feature is missing"):
        forest.predict(gap, "p").collect()


def test_stored_nodes_are_walked_by_joins(spark, table, rows):
    """Another engine scores from the stored table, a level at a time."""
    model = trees.fit_forest(table, ORDER, "t", "id", 6, 5, 16, 2)
    path = scratch_path(spark, "forest")
    model.save(spark, path)
    again = trees.TreeModel.load(spark, path)
    assert again == model and (predictions(again, table) == predictions(model, table)).all()
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT * FROM (VALUES " + ", ".join(
        f"({i}, [{a!r}, {b!r}, {c!r}]::DOUBLE[])" for i, a, b, c, _ in rows) + ") AS v(id, f)")
    found = con.execute(f"""
        WITH RECURSIVE nodes AS (SELECT * FROM '{path}/nodes/*.parquet'),
        walk AS (
            SELECT x.id, f, unnest({model.roots}) AS node FROM x
            UNION ALL
            SELECT w.id, f, n.left + (f[n.feature + 1] > n.threshold)::INT
            FROM walk w JOIN nodes n ON n.id = w.node WHERE n.feature >= 0)
        SELECT w.id, avg(n.value) FROM walk w JOIN nodes n ON n.id = w.node WHERE n.feature < 0 GROUP BY w.id
        ORDER BY w.id""").fetchall()
    np.testing.assert_allclose([v for _, v in found], predictions(model, table), rtol=1e-12)


def test_importances_follow_the_target(table):
    model = trees.fit_boosted(table, ORDER, "t", 4, 3, 0.05, 16)
    shares = model.importances()
    assert shares.sum() == pytest.approx(1) and shares[0] > shares[1] > shares[2] == 0


def test_large_targets_take_fewer_steps(spark):
    table = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1e15 * (i % 2)) for i in range(50)], SCHEMA)
    assert trees.power_step(table, "t") < 16
    model = trees.fit_forest(table, ORDER, "t", "id", 3, 50, 64, 1)
    assert 0 <= predictions(model, table).min() and predictions(model, table).max() <= 1e15


@pytest.mark.parametrize("collinear", [False, True])
def test_the_line_is_that_of_least_norm(spark, collinear):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(1e4, 3, 200), rng.normal(size=200), np.full(200, 5.0), rng.integers(0, 2, 200)])
    if collinear:
        x = np.column_stack([x, 1 - x[:, 3], 2 * x[:, 1] - x[:, 0]])
    y = 3.0 + x[:, 0] - 2 * x[:, 1] + 4 * x[:, 3] + rng.normal(size=200)
    names = [f"f{i}" for i in range(x.shape[1])]
    table = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)],
                                  ", ".join(f"{n} double" for n in [*names, "t"])).repartition(5)
    model = linear.fit_linear(table, names, "t")
    deviation = x.std(0)
    scaled = np.where(deviation > 1e-9, (x - x.mean(0)) / np.maximum(deviation, 1e-9), 0.0)
    wanted = np.linalg.lstsq(scaled, y - y.mean(), rcond=1e-8)[0]
    np.testing.assert_allclose(np.array(model.coefficients) * deviation, wanted, atol=1e-6)
    np.testing.assert_allclose([r.p for r in model.predict(table, "p").select("p", "t").orderBy("t").collect()],
                               (scaled @ wanted + y.mean())[np.argsort(y)], rtol=1e-8)


def test_draws_are_those_of_the_columns(spark):
    keys = ["1", "22", "-3", "", "ä", None]
    table = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").coalesce(1)
    found = trees.draws(keys, 3, 7)
    for t in range(3):
        u = uniform(F.concat(F.lit(f"{t}:"), "k"), "bag7").alias("u")
        wanted = [0 if r.u is None else np.searchsorted(trees.POISSON, r.u, "right")
                  for r in table.orderBy("id").select(u).collect()]
        assert found[t].tolist() == wanted


def jobs_of(spark, fit):
    group = scratch_path(spark, "group")
    spark.sparkContext.setJobGroup(group, "a fit")
    try:
        fit()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_boosting_takes_a_job_a_level(spark, table):
    assert jobs_of(spark, lambda: trees.fit_boosted(table, ORDER, "t", 8, 4, 0.05, 16, task_rows=0)) <= 8 * 4 + 20
    assert jobs_of(spark, lambda: trees.fit_boosted(table, ORDER, "t", 8, 4, 0.05, 16)) <= 8 + 20


def test_a_forest_takes_few_jobs(spark, table):
    assert jobs_of(spark, lambda: trees.fit_forest(table, ORDER, "t", "id", 30, 8, 16, 1)) <= 20


def test_missing_features_are_below_all_cuts(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 7), float("nan") if i % 5 == 0 else 1.0, 2.0, 50.0 * (i % 3 == 0) + i % 5)
            for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    found = [trees.fit_boosted(table, ORDER, "t", 3, 3, 0.3, 16, task_rows=n).nodes for n in (0, 1 << 17)]
    assert sorted(zip(found[0].tree, found[0].feature, found[0].cut, found[0].value)) == sorted(
        zip(found[1].tree, found[1].feature, found[1].cut, found[1].value))


def test_small_boosting_takes_the_same_few_jobs_for_any_rounds(spark, table):
    assert jobs_of(spark, lambda: trees.fit_boosted(table, ORDER, "t", 40, 2, 0.05, 16)) <= 20


@pytest.mark.parametrize("weighted", [False, True])
def test_features_counted_together_give_the_sums_of_each(monkeypatch, weighted):
    rng = np.random.default_rng(5)
    growth = trees.Growth(1.0, 0.05, 65536.0, [list(range(n)) for n in (9, 0, 40, 3, 1)])
    bins = np.array([rng.integers(0, n, 50_000) for n in growth.sizes], np.uint8)
    node, weight = rng.integers(0, 3, 50_000), rng.integers(1, 4, 50_000) if weighted else None
    residual = rng.integers(-2 ** 24, 2 ** 24, 50_000)
    rows = np.flatnonzero(node < 2)
    some = (node[rows], 2, residual[rows], weight[rows] if weighted else None, growth)
    assert len(growth.groups) < len(bins)
    pairs = growth.paired(bins)
    found = trees.cell_sums(bins, pairs, rows, *some)
    assert (found == trees.cell_sums(bins, None, rows, *some)).all()
    for f, first in enumerate(growth.starts[:-1]):
        for b in range(growth.sizes[f]):
            own = (bins[f] == b) & (node == 1)
            assert found[0, 1, first + b] == residual[own].sum()
            assert found[1, 1, first + b] == (weight[own].sum() if weighted else own.sum())
    # So many rows that doubles wouldn't hold their sums.
    large = residual[rows] * 2 ** 20
    exact = trees.cell_sums(bins, pairs, rows, node[rows], 2, large, some[3], growth)
    assert (exact[0] == found[0] * 2 ** 20).all()


def test_boosting_by_one_task_keeps_leaves_of_any_depth(spark, table):
    """A constant feature, early leaves and a round without splits."""
    rows = [(i, float(i % 2), 0.0, 7.0, 10.0 * (i % 2)) for i in range(64)]
    small = spark.createDataFrame(rows, SCHEMA)
    for t, least in ((small, 0), (table, 2)):
        found = [trees.fit_boosted(t, ORDER, "t", 5, 4, 1.0, 16, task_rows=n) for n in (0, 1 << 17)]
        assert found[0] == found[1] and found[0].depth > least


@pytest.mark.parametrize("keys", [["7", "", None, "ä|1", "x" * 44], ["x" * 45, "1"], ["y\0", "y"], ["z" * 300], [None], []])
def test_draws_of_all_rows_at_once_are_those_of_the_library(monkeypatch, keys):
    bounds = [int(np.ceil(p * 2.0 ** 52)) for p in trees.POISSON]

    def wanted(t, key):
        x = int.from_bytes(hashlib.md5(f"bag42:{t}:{key}".encode()).digest()[:8], "big") >> 12
        return 0 if key is None else sum(x >= b for b in bounds)

    each = []
    monkeypatch.setattr(trees.hashlib, "md5", lambda x, *a, md5=hashlib.md5, **k: each.append(x) or md5(x, *a, **k))
    found = trees.draws(keys, 120, 42)
    assert all(len(x) > 55 or max(map(len, keys)) > 44 for x in each)
    monkeypatch.undo()
    assert found.shape == (120, len(keys)) and found.tolist() == [[wanted(t, k) for k in keys] for t in range(120)]


def test_rows_are_walked_a_tree_at_a_time():
    """NaN goes to the right; leaves at several depths; no rows."""
    feature, threshold = np.array([0, -1, 1, -1, -1, -1], np.int16), np.array([1.0, 0.0, 2.0, 0.0, 0.0, 0.0])
    left, value = np.array([1, 0, 3, 0, 0, 0], np.int32), np.array([0.0, 10.0, 0.0, 20.0, 30.0, 0.5])
    x = np.array([[1.0, 9.0], [1.5, 2.0], [np.nan, 2.5], [np.nan, np.nan], [-np.inf, 0.0], [np.inf, 2.0]])
    args = (np.array([0, 5, 0]), feature, threshold, left, value)
    assert trees._walked(x, *args).tolist() == [20.5, 40.5, 60.5, 60.5, 20.5, 40.5]
    assert trees._walked(x[:0], *args).tolist() == []


@pytest.mark.parametrize("weighted", [False, True])
def test_rows_by_node_and_rows_of_each_node_give_the_same_splits(monkeypatch, weighted):
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 9, (3, 3000)).astype(np.uint8)
    growth = trees.Growth(1.0, 0.1, 65536.0, [[float(x) for x in range(8)]] * 3, 5)
    weight = rng.integers(1, 4, 3000) if weighted else None
    residual = rng.integers(-2**20, 2**20, 3000) * (1 if weight is None else weight)
    found, reached = [], []
    for apart in (0, 2, 1 << 6):
        monkeypatch.setattr(trees, "APART", apart)
        reached.append(np.full(3000, -1))
        found.append(trees.subtree(bins, growth.paired(bins), residual, weight, 9, growth, reached[-1]))
    assert len(found[0]["node"]) > 100 and reached[0].min() >= 0
    for other, last in zip(found[1:], reached[1:]):
        assert last.tolist() == reached[0].tolist()
        assert all(other[c].tolist() == found[0][c].tolist() for c in found[0])


def test_moments_are_those_of_each_pair_of_columns(spark):
    """Over any layout, also with missing values, a column without any and parts without rows."""
    rng = np.random.default_rng(4)
    x = rng.normal([1e6, 0, 5, 0], [1, 3, 1e-3, 1], (500, 4))
    rows = [[None if rng.random() < 0.2 or i == 3 else float(v) for i, v in enumerate(r)] for r in x]
    table = spark.createDataFrame(rows, "c0 double, c1 double, c2 double, c3 double")
    wanted = table.agg(*[F.covar_pop(f"c{i}", f"c{j}") for i in range(4) for j in range(4)]).first()
    for layout in (table.coalesce(1), table.repartition(7), table.repartition(700)):
        parts = [[np.frombuffer(m).reshape(4, 4) for m in part] for part in layout.mapInArrow(
            linear._moments, "n binary, mean binary, product binary").collect()]
        n, mean, product = linear.reduce(linear._merged, parts)
        for i in range(4):
            for j in range(4):
                both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
                assert n[i, j] == len(both)
                if both:
                    assert mean[i, j] == pytest.approx(np.mean([b[0] for b in both]), rel=1e-9, abs=1e-9)
                    assert product[i, j] / n[i, j] == pytest.approx(wanted[4 * i + j], rel=1e-7, abs=1e-9)


def test_the_line_leaves_the_summing_to_few_columns(spark, table):
    """Not an aggregate function for every pair of features."""
    wide = table.select("t", *[(F.col("a") * i).alias(f"f{i}") for i in range(30)])
    found = linear.fit_linear(wide, [f"f{i}" for i in range(30)], "t")
    assert len(found.coefficients) == 30
    nothing = table.filter("id < 0")
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_linear(nothing, ORDER, "t")


def test_nodes_are_stored_in_one_write(spark, table, tmp_path, monkeypatch):
    model = trees.fit_boosted(table, ORDER, "t", 4, 3, 0.3, 16)
    monkeypatch.setattr(trees, "STORED", 3, raising=False)
    path = str(tmp_path / "model")
    assert jobs_of(spark, lambda: model.save(spark, path)) <= 2
    assert vars(trees.TreeModel.load(spark, path).nodes) == vars(model.nodes)
    part = model.table(spark, 2, 5).orderBy("id").collect()
    assert [r.id for r in part] == [2, 3, 4] and [r.value for r in part] == list(model.nodes.value[2:5])


def test_cuts_of_each_feature_come_from_its_own_group(spark, table, rows):
    nan = float("nan")
    more = table.unionByName(spark.createDataFrame([(1000 + i, None, nan, None, 0.0) for i in range(5)], SCHEMA))
    wanted = [brute_cuts(np.array([r[k] for r in rows] + [nan] * 5 * (k == 2)), 16) for k in (1, 2)]
    found = trees.find_cuts(more.withColumn("none", F.lit(None).cast("double")), [*ORDER[:2], "none"], 16)
    assert found == [wanted[0], [x for x in wanted[1] if x == x], []]
    assert trees.find_cuts(more.limit(0), ORDER, 16) == [[], [], []]


def test_lines_of_picked_rows_lie_in_one_piece(spark, table, monkeypatch):
    """Else each step copies whole lines for the rows of a node."""
    grown, seen = trees.subtree, []
    bins = np.arange(24, dtype=np.uint8).reshape(3, 8)
    picked = trees.columns(bins, np.array([1, 5, 6]))
    np.testing.assert_array_equal(picked, bins[:, [1, 5, 6]])
    assert picked.flags.c_contiguous

    def watched(bins, pairs, *rest):
        seen.append(bins.flags.c_contiguous and pairs.flags.c_contiguous)
        return grown(bins, pairs, *rest)

    monkeypatch.setattr(trees, "subtree", watched)
    sample = spark.sparkContext.parallelize([0], 1).map(lambda _: (bins, np.arange(8), np.ones((2, 8), np.uint8)))
    growth, nodes = trees.Growth(0.0, 1.0, 1.0, [[x + 0.5 for x in range(23)]] * 3), trees.Nodes()
    for t in range(2):
        nodes.add(t, 0.0, 8)

    class Here:
        """What the tasks would do, in this process."""

        context = spark.sparkContext

        def flatMap(self, f):
            self.rows = [x for block in sample.collect() for x in f(block)]
            return self

        def partitionBy(self, n, by):
            return self

        def mapPartitions(self, f):
            self.rows = list(f(iter(self.rows)))
            return self

        def collect(self):
            return self.rows

    trees._grow_small(Here(), {0: 3, 1: 3}, 8, nodes, growth, 3)
    assert seen == [True, True]


def test_a_walk_over_bins_keeps_small_numbers():
    """Rows stay at leaves of any depth, also those in the highest bin; half the memory of 64-bit numbers."""
    feature, cut, left = np.array([0, -1, 1, -1, -1]), np.array([3, 0, 254, 0, 0]), np.array([1, 0, 3, 0, 0])
    bins = np.array([[0, 3, 4, 255, 255], [255, 0, 254, 255, 0]], np.uint8)
    for steps, wanted in ((0, [0] * 5), (1, [1, 1, 2, 2, 2]), (2, [1, 1, 3, 4, 3]), (9, [1, 1, 3, 4, 3])):
        found = trees.walked(bins, 0, steps, feature, cut, left)
        assert found.tolist() == wanted and found.dtype == np.int32
    assert trees.walked(bins[:, :0], 0, 3, feature, cut, left).tolist() == []
