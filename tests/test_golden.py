"""Published values, and formulas in numpy held against the operators."""

import base64
import hashlib
import shutil
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.iterate import in_order
from graphloom.operators import community, construction, diffusion, display, graph, netstats, nulls, routing, spatial, spreading, statistics
from graphloom.sources import cifti, files, formats, registry


def edges(spark, w):
    i, j = np.nonzero(w)
    return spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j)], "src long, dst long, w double")


def nodes(spark, *columns):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*columns))], "id long, " + ", ".join(f"{c} double" for c in "xy"[: len(columns)]))


def matrix(df, n, value="w"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.src, r.dst] = r[value]
    return out


def network(n=12, seed=3, density=0.4):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
    w[np.arange(n - 1), np.arange(1, n)] += 0.1
    return w + w.T


GOLDEN = {3: (0.04811638, 0.5665884, -0.03207622), 4: (0.10194804, 0.6756672, 0.023249778)}


@pytest.mark.parametrize("n", [3, 4])
def test_spatial(spark, n):
    rng = np.random.default_rng(1234)
    x, y, w = rng.random(n), rng.random(n), rng.random((n, n))
    e, v = edges(spark, w), nodes(spark, x, y)
    got = spatial.morans_i(v, e).first()[0], spatial.gearys_c(v, e).first()[0], spatial.lees_l(v, e).first()[0]
    assert np.allclose(got, GOLDEN[n], rtol=1e-5, atol=1e-8)
    if n == 3:
        for rows, want in (
            (spatial.local_morans_i(v, e), [0.17645791, 0.03789162, -0.04622557]),
            (spatial.local_gearys_c(v, e), [1.06577412558015, 2.51230240958039, 2.36109222974053]),
            (spatial.local_lees_l(v, e), [-0.297374681957742, 0.0116826474633146, -0.0293788020084983]),
        ):
            assert np.allclose([r[1] for r in rows.orderBy("id").collect()], want, rtol=1e-5, atol=1e-8)


def test_communicability(spark):
    a = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 1.0]])
    want = [[4.19452805, 0, 3.19452805], [1.47624622, 2.71828183, 3.19452805], [3.19452805, 0, 4.19452805]]
    assert np.allclose(matrix(diffusion.communicability_bin(edges(spark, a)), 3), want)
    b = np.array([[2, 0, 3], [0, 2, 1], [0.5, 0, 1]])
    assert np.allclose(matrix(diffusion.communicability_wei(edges(spark, b)), 3), [[0, 0, 1.93581903], [0.07810379, 0, 0.94712177], [0.32263651, 0, 0]])
    with pytest.raises(ValueError):
        diffusion.communicability_bin(edges(spark, b))


def test_walks(spark):
    w = network()
    n = len(w)
    m = matrix(diffusion.mean_first_passage_time(edges(spark, w)), n)
    p = w / w.sum(axis=1, keepdims=True)
    for j in range(n):  # one step, then on from there
        step = 1 + p @ m[:, j]
        assert np.allclose(np.delete(step, j), np.delete(m[:, j], j)) and m[j, j] == 0
    r = matrix(netstats.effective_resistance(edges(spark, w), directed=False), n)
    assert np.isclose((w * r).sum() / 2, n - 1)


def test_paths_both_ways(spark):
    w = network(30, 5, 0.08)
    w[:, 7] = w[7, :] = 0  # a node apart
    lengths, ids = edges(spark, w), nodes(spark, np.zeros(30))
    d = np.where(w > 0, w, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(30):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    sent = routing.shortest_paths(lengths, ids).collect()
    joined = {(r.src, r.dst): (r.hops, r.path) for r in routing.shortest_paths(lengths, ids, max_sent=0).collect()}
    assert {(r.src, r.dst): (r.hops, r.path) for r in sent} == joined and len(sent) == np.isfinite(d).sum()
    assert all(np.isclose(r.dist, d[r.src, r.dst]) for r in sent)
    table = routing.distance_wei_floyd(lengths, ids)
    assert [r.id for r in routing.retrieve_shortest_path(0, 7, table).collect()] == [-1]
    assert [r.id for r in routing.retrieve_shortest_path(0, 20, table).orderBy("step").collect()] == joined[0, 20][1]
    with pytest.raises(ValueError):
        routing.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, 0.5)], "src long, dst long, w double"))


def test_partitions(spark):
    x, y = [0, 0, 0, 1, 1, 1, 2, 1, 1, 2, 0], [2, 0, 3, 3, 1, 0, 2, 1, 3, 1, 2]
    label = lambda v: spark.createDataFrame([(i, a) for i, a in enumerate(v)], "id long, label long")
    assert np.isclose(community.zrand(label(x), label(y)).first()[0], -0.06593804733957866)
    assert np.isclose(community.zrand(label([0] * 100 + [1] * 100), label([1] * 100 + [0] * 100)).first()[0], 140.356688476182)
    match = lambda a, b: [r.label for r in community.match_cluster_labels(label(a), label(b)).orderBy("id").collect()]
    three = [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert match(three, [2, 2, 2, 1, 1, 1, 3, 3, 3]) == [2, 2, 2, 1, 1, 1, 3, 3, 3]
    table = pd.DataFrame([(p, i, v) for p, c in enumerate([three, [2, 2, 2, 3, 3, 3, 1, 1, 1], [3, 3, 3, 1, 1, 1, 2, 2, 2]]) for i, v in enumerate(c)], columns=["part", "id", "label"])
    found = [r.label for r in community.find_consensus(spark.createDataFrame(table)).orderBy("id").collect()]
    assert found == three
    assert [r.bound for r in display.grid_communities(label([0, 0, 0, 0, 1, 1, 1, 1, 2, 2])).orderBy("bound").collect()] == [0, 4, 8, 10]
    assert [r.id for r in display.sort_communities(edges(spark, np.arange(9).reshape(3, 3)), label([0, 0, 2])).orderBy("place").collect()] == [1, 0, 2]
    assert sorted(r.w for r in construction.get_triu(edges(spark, np.arange(9).reshape(3, 3))).collect()) == [1, 2, 5]


def test_louvain_finds_blocks():
    w = np.kron(np.eye(3), np.ones((6, 6))) + 0.02
    np.fill_diagonal(w, 0)
    labels, q = community.louvain_labels(w, 1.0, np.random.default_rng(0))
    assert len(set(labels)) == 3 and all(len(set(labels[k : k + 6])) == 1 for k in (0, 6, 12)) and q > 0.5


def test_correlation_and_permutations(spark):
    x, y, w = [3, 5, 6, 8, 3, 2, 6], [3, 5, 2, 8, 3, 3, 6], [7, 3, 3, 2, 4, 5, 7]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, w)], "x double, y double, w double")
    assert np.isclose(statistics.weighted_pearsonr(df, "x", "y", "w").first()[0], 0.7356763090950997)
    pairs = spark.createDataFrame(pd.DataFrame({"row": range(100), "a": np.linspace(1, 100, 100), "b": np.linspace(1.01, 99.989, 100)}))
    got = statistics.permtest_rel(pairs, "a", "b", "row", seed=1234).first()
    assert np.isclose(got["mean"], -0.0005) and np.isclose(got["p"], 0.4175824175824176)
    v = statistics.correlated_vectors(0.1, 100, seed=12345678)
    drawn = spark.createDataFrame(pd.DataFrame({"row": range(100), "a": v[0], "b": v[1]}))
    got = statistics.permtest_pearsonr(drawn, "a", "b", "row").first()
    assert np.isclose(got["r"], 0.10032564626876286) and np.isclose(got["p"], 0.3046953046953047)
    signs = statistics._sign_sums(pairs, pairs.b - pairs.a, "row", 1000, 1).first()
    assert np.isclose(signs["mean"], -0.0005) and 0.3 < signs["p"] < 0.55
    for bad in (1.5, [0.85], np.ones((2, 3)), np.array([[0.85]])):
        with pytest.raises(ValueError):
            statistics.correlated_vectors(bad, 10)


def test_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 3))
    y = x @ [1, 2, 0.5] + rng.random(200) + 3
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    slopes = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0][:3]
    rest = y - x @ slopes
    got = np.array([r.y_residual for r in statistics.residualize(df, ["a", "b", "c"], ["y"]).collect()])
    assert np.allclose(got, (rest - rest.mean()) / rest.std())
    stats = statistics.get_dominance_stats(df, ["a", "b", "c"], "y").collect()
    assert np.isclose(sum(r.value for r in stats if r.kind == "total"), next(r.value for r in stats if r.kind == "full"))


@pytest.mark.parametrize("directed", [False, True])
def test_null_models(spark, directed):
    w = network(16, 8)
    if directed:
        w = np.triu(w) + 0.5 * np.tril(w) * (np.random.default_rng(1).random(w.shape) < 0.5)
    for run in (nulls.randmio_dir, nulls.randmio_dir_connected) if directed else (nulls.randmio_und, nulls.randmio_und_connected):
        rows = run(edges(spark, w), 5).collect()
        new = np.zeros_like(w)
        for r in rows:
            new[r.src, r.dst] = r.w
        assert ((new != 0).sum(axis=0) == (w != 0).sum(axis=0)).all() and ((new != 0).sum(axis=1) == (w != 0).sum(axis=1)).all()
        assert np.allclose(np.sort(new[new > 0]), np.sort(w[w > 0])) and (new != w).any()
    if not directed:
        near = nulls.strength_preserving_rand_sa(edges(spark, w), nstage=10, niter=2000).collect()
        new = np.zeros_like(w)
        for r in near:
            new[r.src, r.dst] = r.w
        assert np.isclose(((new.sum(axis=1) - w.sum(axis=1)) ** 2).sum(), near[0].energy) and np.allclose(new, new.T)
        with pytest.raises(ValueError):
            nulls.strength_preserving_rand_sa(edges(spark, w), energy_type="none")


def test_spanning_tree_and_threshold(spark):
    w = network(14, 2, 0.6)
    tree = construction.spanning_tree(edges(spark, w)).collect()
    order, root, want = sorted(((-w[i, j], i, j) for i in range(14) for j in range(i + 1, 14) if w[i, j])), list(range(14)), set()
    for _, i, j in order:
        if root[i] != root[j]:
            want.add((i, j))
            root = [root[i] if r == root[j] else r for r in root]
    assert {(r.src, r.dst) for r in tree} == want
    ids = nodes(spark, np.zeros(14))
    assert construction.threshold_network(edges(spark, w), ids, 30).count() == 2 * int(0.3 * 91)
    with pytest.raises(ValueError):
        construction.threshold_network(edges(spark, w), ids, 5)


def test_spreading_keeps_to_the_seed(spark):
    w = network(6, 1, 0.9)
    i, j = np.nonzero(w)
    paths = spark.createDataFrame([(int(a), int(b), float(w[a, b]), 2.0) for a, b in zip(i, j)], "src long, dst long, w double, length double")
    regions = spark.createDataFrame([(k, 1.0 + k) for k in range(6)], "id long, size double")
    rows = spreading.simulate_atrophy(paths, regions, [0, 3], 30).toPandas()
    assert len(rows) == 2 * 6 * 30 and (rows["atrophy"] >= 0).all()
    for s in (0, 3):
        one = rows[rows["seed"] == s]
        assert one[one["t"] == 0].set_index("id")["atrophy"].idxmax() == s
        assert (one.sort_values(["id", "t"]).groupby("id")["atrophy"].diff().dropna() >= 0).all()


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "m.csv").write_text("0,1\n2,x\n")
    assert {(r.src, r.dst, r.w) for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == {(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, None)}
    np.save(tmp_path / "a.npy", np.eye(2))
    assert {(r.src, r.dst, r.w) for r in files.read_npy(spark, str(tmp_path / "a.npy")).collect()} == {(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)}
    word = lambda s: struct.pack(">i", len(s) + 1) + s.encode() + b"\0"
    table = [(0, "unknown", (1, 2, 3)), (1, "front", (9, 8, 7))]
    colour = lambda c: c[0] | c[1] << 8 | c[2] << 16
    body = struct.pack(">i", 3) + b"".join(struct.pack(">ii", v, c) for v, c in ((0, colour((9, 8, 7))), (1, colour((1, 2, 3))), (2, 5)))
    body += struct.pack(">iii", 1, -2, 2) + word("table") + struct.pack(">i", 2) + b"".join(struct.pack(">i", k) + word(n) + struct.pack(">iiii", *c, 0) for k, n, c in table)
    (tmp_path / "lh.annot").write_bytes(body)
    assert [r.key for r in files.read_annot_vertices(spark, str(tmp_path / "lh.annot"), "L").orderBy("vertex").collect()] == [1, 0, -1]
    assert [(r.key, r.label) for r in files.read_parcels(spark, str(tmp_path / "lh.annot"), "L").collect()] == [(0, "unknown"), (1, "front")]
    (tmp_path / "p.gii").write_text('<GIFTI><LabelTable><Label Key="4">front</Label></LabelTable></GIFTI>')
    assert [(r.key, r.label) for r in files.read_parcels(spark, str(tmp_path / "p.gii"), "R").collect()] == [(4, "front")]
    (tmp_path / "r.json").write_text('{"a": {"v1": {"url-type": "osf", "url": ["x", "y"], "md5": "m", "rel-path": "p"}, "v2": {"k": {"url-type": "github-archive", "url": ["o", "n", "c"], "rel-path": "q"}}}}')
    table = registry.load_registry(spark, str(tmp_path / "r.json"))
    assert {r.version: r.address for r in registry.dataset_info(table, "a").collect()} == {"v1": "https://files.osf.io/v1/resources/x/providers/osfstorage/y", "v2/k": "https://github.com/o/n/archive/c.tar.gz"}
    assert registry.resolve(spark, table, "a", "v1", str(tmp_path)).first().present is False
    with pytest.raises(KeyError):
        registry.dataset_info(table, "b")
    assert display.parcellation_key("Schaefer400x17") == ("schaefer", "400Parcels17Networks") and display.parcellation_key("mmpall")[0] == "mmpall"
    with pytest.raises(ValueError):
        display.parcellation_key("schaeferx")


def test_places_and_sums_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 40, 500), rng.random(500))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k long, v double")
    got = in_order(df, "k", "v").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(range(500), key=lambda i: rows[i])
    sums = {r.id: r.upto for r in in_order(df, "k", "v", sum_of="v", name="upto").collect()}
    total = 0.0
    for i in sorted(range(500), key=lambda i: rows[i]):
        total += rows[i][1]
        assert np.isclose(sums[i], total)
    assert in_order(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("seed,low", [(0, 0.0), (1, -1.0), (2, -3.0)])
def test_binarized_without_pairs(spark, seed, low):
    """Percentiles over all pairs, absent ones as 0, with weights of both signs."""
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((12, 12)) < 0.5, rng.integers(low * 4, 9, (12, 12)) / 4, 0.0)
    w = np.triu(w, 1) + np.triu(w, 1).T + np.diag(rng.random(12))
    for retain in (0, 7, 30, 80, 100):
        for keep in (False, True):
            bar = np.percentile(w[np.triu_indices(12, 1)], 100 - retain)
            want = {(int(i), int(j)) for i, j in zip(*np.nonzero(w > bar)) if keep or i != j}
            got = construction.binarize_network(edges(spark, w), nodes(spark, np.zeros(12)), retain, keep).collect()
            assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)


def test_navigation_both_ways(spark):
    w = network(15, 4, 0.25)
    d = np.abs(np.random.default_rng(1).normal(size=(15, 15))).round(1)
    np.fill_diagonal(d, 0)
    ids = nodes(spark, np.zeros(15))
    found = [sorted(map(tuple, routing.navigation_wu(edges(spark, d), edges(spark, w), ids, n).select("src", "dst", "hops", "dist", "path").collect())) for n in (10**6, 0)]
    assert len(found[0]) == 225 and [x[:3] + x[4:] for x in found[0]] == [x[:3] + x[4:] for x in found[1]]
    assert all(np.isclose(a[3], b[3]) or a[3] == b[3] for a, b in zip(*found, strict=True))


def test_leaf_order_takes_the_nearest_first():
    def plain(rows):
        n = len(rows)
        d = (rows[:, None, :] != rows[None, :, :]).mean(axis=2)
        np.fill_diagonal(d, np.inf)
        sizes, leaves, number, alive = np.ones(n), [[i] for i in range(n)], list(range(n)), np.ones(n, bool)
        for step in range(n - 1):
            i, j = sorted(divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), n))
            a, b = (i, j) if number[i] < number[j] else (j, i)
            joined = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
            d[i], d[:, i] = joined, joined
            d[i, i], alive[j] = np.inf, False
            leaves[i], sizes[i], number[i] = leaves[a] + leaves[b], sizes[i] + sizes[j], n + step
        return leaves[int(np.flatnonzero(alive)[0])]

    rng = np.random.default_rng(5)
    for n in (2, 3, 9, 40):
        for _ in range(8):
            rows = rng.integers(0, 3, (n, 7))
            assert community.leaf_order(rows) == plain(rows)


def test_matching_of_many_partitions_and_surplus_labels(spark):
    rows = [(0, i, i // 3) for i in range(9)] + [(1, i, 9 - i // 3) for i in range(9)] + [(2, i, i) for i in range(9)]
    got = {(r.part, r.id): r.label for r in community.match_assignments(spark.createDataFrame(rows, "part long, id long, label long"), target=0).collect()}
    assert all(got[p, i] == i // 3 for p in (0, 1) for i in range(9))
    labels = [got[2, i] for i in range(9)]
    assert len(set(labels)) == 9 and {labels[i] for i in range(9) if labels[i] < 3} == {0, 1, 2} and sorted(x for x in labels if x > 2) == [3, 4, 5, 6, 7, 8]
    assert all(labels[i] == i // 3 for i in range(9) if labels[i] < 3)


def test_any_null_function(spark):
    rows = [(p, i, (i + p * (i == 4)) // 3) for p in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "part long, id long, label long")
    for null in ("mean", lambda x: F.percentile(x, F.lit(0.9))):
        assert [r.label for r in community.find_consensus(df, null).orderBy("id").collect()] in ([1, 1, 1, 2, 2, 2, 3, 3, 3],)
    with pytest.raises(ValueError):
        community.find_consensus(df, "none")


@pytest.mark.parametrize("energy", ["sse", "mse", "mae", "rmse", "max"])
def test_annealing_ends_at_the_energy_it_says(energy):
    w = network(12, 3, 0.6)
    ends = np.nonzero(np.triu(w, 1))
    rng = np.random.default_rng(0)
    start = rng.permutation(w[ends])
    goal = w.sum(axis=1)
    deviation = lambda x: np.bincount(ends[0], x, 12) + np.bincount(ends[1], x, 12) - goal
    found, least = nulls.annealed([goal], start, ends, False, energy, 20, 500, 1.0, 0.7, rng)
    assert np.allclose(np.sort(found), np.sort(start)) and np.isclose(nulls.ENERGIES[energy](deviation(found)), least)
    assert least < nulls.ENERGIES[energy](deviation(start))
    own, by = nulls.annealed([goal], start, ends, False, nulls.ENERGIES[energy], 20, 500, 1.0, 0.7, np.random.default_rng(1))
    same, of = nulls.annealed([goal], start, ends, False, energy, 20, 500, 1.0, 0.7, np.random.default_rng(1))
    assert np.isclose(by, of) and np.allclose(own, same)


def test_hubs_make_their_wedges_in_parts(spark, monkeypatch):
    w = network(14, 6, 0.5)
    whole = sorted(map(tuple, graph.matching_index(edges(spark, w)).collect()))
    monkeypatch.setattr(graph, "HUB", 3)
    parts = sorted(map(tuple, graph.matching_index(edges(spark, w)).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in parts] and np.allclose([x[2] for x in whole], [x[2] for x in parts])


def test_draws_and_degrees_of_freedom(spark):
    pairs = spark.createDataFrame(pd.DataFrame({"row": range(50), "a": np.linspace(1, 5, 50), "b": np.linspace(1.2, 5.1, 50) ** 1.1}))
    for run in (lambda d: statistics.permtest_1samp(pairs, "a", "row", 3.0, draws=d), lambda d: statistics.permtest_rel(pairs, "a", "b", "row", draws=d)):
        one, other = (run(d).first() for d in ("numpy", "hash"))
        assert np.isclose(one["mean"], other["mean"]) and abs(one["p"] - other["p"]) < 0.1
    with pytest.raises(ValueError):
        statistics.permtest_1samp(pairs, "a", "row", draws="none")
    r = statistics.efficient_pearsonr(pairs, ["a"], ["b"]).first().r
    assert np.isclose(statistics.efficient_pearsonr(pairs, ["a"], ["b"], ddof=3).first().r, r * 47 / 49)


def test_agents_under_way(spark):
    w = network(6, 1, 0.9)
    i, j = np.nonzero(w)
    paths = spark.createDataFrame([(int(a), int(b), float(w[a, b]), 2.0) for a, b in zip(i, j)], "src long, dst long, w double, length double")
    regions = spark.createDataFrame([(k, 1.0 + k) for k in range(6)], "id long, size double")
    inside, under_way = spreading.misfolded_spread(paths, regions, [0], 20, return_agents_in_paths=True)
    rows = under_way.collect()
    assert inside.count() == 6 * 20 and {(r.src, r.dst) for r in rows} == set(zip(i.tolist(), j.tolist())) and all(r.normal > 0 and r.misfolded >= 0 for r in rows)


@pytest.mark.parametrize("order", ["<", ">"])
def test_cifti_files(spark, tmp_path, order):
    data = np.arange(12.0).reshape(2, 6)
    content = formats.cifti(data, [("L", 7, [1, 3, 6])], [("T", [(0, 1, 2), (3, 4, 5), (6, 7, 8)])], [(0, "???"), (1, "a & b"), (2, "c")], order)
    (tmp_path / "x.dlabel.nii").write_bytes(content)
    path = str(tmp_path / "x.dlabel.nii")
    assert {(r["map"], r.row): r.x for r in cifti.read_values(spark, path).collect()} == {(m, k): data[m, k] for m in range(2) for k in range(6)}
    assert sorted((r.row, r.vertex) for r in cifti.read_places(spark, path).collect()) == [(0, 1), (1, 3), (2, 6)]
    assert sorted((r.row, r.i, r.j, r.k) for r in cifti.read_voxels(spark, path).collect()) == [(3, 0, 1, 2), (4, 3, 4, 5), (5, 6, 7, 8)]
    assert {(r.key, r.label) for r in cifti.read_labels(spark, path).filter("map = 0").collect()} == {(0, "???"), (1, "a & b"), (2, "c")}
    vertices, labels = files.load_parcellation(spark, path, "L", "L")
    assert [r.key for r in vertices.orderBy("vertex").collect()] == [0, 0, 0, 1, 0, 0, 2] and {r.key for r in labels.collect()} == {1, 2}
    assert {(r.kind, r.name) for r in cifti.describe_file(spark, path).collect()} >= {("LABELS", "c"), ("BRAIN_MODELS", "T")}
    for bad in (lambda: files.load_parcellation(spark, path, "L"), lambda: files.load_parcellation(spark, path, "L", "R").count(), lambda: files.check_parc_files("x.gii", "both"), lambda: files.check_parc_files("x.txt", "L"), lambda: files.check_parc_files("x.gii", "M"), lambda: cifti.parse_cifti(b"\0" * 600)):
        with pytest.raises(ValueError):
            bad()


def test_gifti_encodings():
    a = np.array([[1.5, 2.0], [3.0, 4.0]])
    for encoding, data in (("ASCII", "1.5 2 3 4"), ("Base64Binary", base64.b64encode(a.astype(">f8").tobytes()).decode())):
        (got,) = files.parse_gifti_values(f'<GIFTI><DataArray DataType="NIFTI_TYPE_FLOAT64" Dimensionality="2" Dim0="2" Dim1="2" Encoding="{encoding}" Endian="BigEndian"><Data>{data}</Data></DataArray></GIFTI>'.encode())
        assert (got == a).all()


def test_files_of_versions_sums_and_archives(spark, tmp_path):
    rows = registry.surface_files(spark, "fsaverage_curated", "fsaverage5", str(tmp_path), ("pial",)).collect()
    assert [(r.density, r.hemi, r.present) for r in rows] == [("10k", "L", False), ("10k", "R", False)] and rows[0].path.endswith("tpl-fsaverage_den-10k_hemi-L_pial.surf.gii")
    assert {r.kind for r in registry.surface_files(spark, "fslr_curated", "fslr4k").collect()} == {"midthickness", "inflated", "sphere", "medial", "sulc", "vaavg"}
    with pytest.raises(ValueError):
        registry.surface_files(spark, "civet", "civet10k")
    with pytest.raises(KeyError):
        registry.surface_files(spark, "none")
    (tmp_path / "a").write_text("x")
    sums = spark.createDataFrame([(str(tmp_path / "a"), hashlib.md5(b"x").hexdigest()), (str(tmp_path / "a"), "0"), (str(tmp_path / "b"), "0"), (str(tmp_path / "a"), None)], "path string, md5 string")
    assert sorted((r.md5 is None, r.md5 or "", r.intact) for r in registry.verified(spark, sums).collect()) == [(False, "0", False), (False, "0", False), (False, hashlib.md5(b"x").hexdigest(), True), (True, "", None)]
    (tmp_path / "in" / "old").mkdir(parents=True)
    (tmp_path / "in" / "old" / "f").write_text("1")
    made = shutil.make_archive(str(tmp_path / "z"), "gztar", tmp_path / "in")
    target = registry.install(made, str(tmp_path / "out" / "new"), rename="old") if (tmp_path / "out").mkdir() is None else ""
    assert (tmp_path / "out" / "new" / "f").read_text() == "1" and registry.install("none", target) == target
    with pytest.raises(ValueError):
        registry.install(made, target, force=True, md5="0")
    (tmp_path / "refs.json").write_text('{"a": {"primary": [{"bibkey": "k", "citation": "c"}]}, "b": {}}')
    assert [tuple(r) for r in registry.references(spark, str(tmp_path / "refs.json"), "a").collect()] == [("a", "primary", "k", "c")]
    with pytest.raises(KeyError):
        registry.references(spark, str(tmp_path / "refs.json"), "none")
    assert registry.subject_dir("in", str(tmp_path)).endswith("/in")
    with pytest.raises(FileNotFoundError):
        registry.subject_dir("none", str(tmp_path))


def test_spanning_forest_by_rounds(spark):
    w = network(12, 9, 0.4).round(1)
    w[:, 5] = w[5, :] = 0
    trees = [{tuple(r) for r in construction.spanning_tree(edges(spark, w), n).collect()} for n in (10**6, 0)]
    assert trees[0] == trees[1] and len(trees[0]) >= 9
    assert construction.spanning_tree(edges(spark, w * 0)).count() == 0
