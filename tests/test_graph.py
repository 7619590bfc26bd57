"""Hand-checkable graphs, traps of the data model, sources and the engine."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import noise, scalars
from orrery.graph import Graph, numbered
from orrery.operators import datacenters as dc
from orrery.operators import kmeans1d as km
from orrery.operators.programs import clamped, guarded_change, hits, pagerank, personalized_pagerank, relative_change, salsa
from orrery.plans.private import PrivacyConfig
from orrery.plans.superstep import GraphEngine, run_program
from orrery.schema import Mode, datacenters
from orrery.sources.files import dataset, edge_list, point_file


def graph(spark, n, pairs, seeds=()):
    vertices = spark.createDataFrame([(i, i % 5, i in seeds) for i in range(n)], "id long, location_id int, is_seed boolean")
    return Graph(vertices, spark.createDataFrame(pairs, "src long, dst long"))


def state(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_cycle_is_a_fixed_point(spark):
    g = graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert all(v[0] == pytest.approx(1.0) for v in state(run_program(g, pagerank(), 5), "rank").values())
    assert set(state(run_program(g, hits(), 4), "authority", "hub").values()) == {(1.0, 1.0)}


def test_star_isolated_and_self_loop(spark):
    g = graph(spark, 4, [(1, 0), (2, 0), (3, 0)])
    one, two = (state(run_program(g, pagerank(), k), "rank") for k in (1, 2))
    assert one[0][0] == pytest.approx(2.7) and one[1][0] == pytest.approx(0.15)
    assert two[0][0] == pytest.approx(0.5325)
    h = state(run_program(g, hits(), 1), "authority", "hub")
    assert h[0] == (3.0, 0.0) and h[1] == (0.0, 1.0)
    alone = graph(spark, 1, [])
    assert state(run_program(alone, pagerank(), 2), "rank")[0][0] == pytest.approx(0.15)
    assert state(run_program(alone, salsa(), 2), "authority", "hub")[0] == (0.0, 0.0)
    assert state(run_program(graph(spark, 1, [(0, 0)]), pagerank(), 3), "rank")[0][0] == pytest.approx(1.0)


def test_personalized_mass_starts_at_seeds(spark):
    g = graph(spark, 3, [(0, 1)], seeds=(0,))
    assert state(run_program(g, personalized_pagerank(), 1), "rank") == {0: (pytest.approx(0.15),), 1: (pytest.approx(0.85),), 2: (0.0,)}
    assert state(run_program(g, personalized_pagerank(), 2), "rank")[1][0] == pytest.approx(0.1275)


def test_duplicate_edges_count_once_after_uniquing(spark):
    g = graph(spark, 2, [(0, 1), (0, 1)]).unique_edges()
    assert g.edges.count() == 1


def test_hits_first_step_is_degrees(spark):
    g = graph(spark, 4, [(0, 1), (0, 2), (3, 1), (1, 2)])
    found = state(run_program(g, hits(), 1), "authority", "hub")
    into, out = ({r["id"]: r["degree"] for r in g.degrees(e).collect()} for e in ("dst", "src"))
    assert found == {i: (into[i], out[i]) for i in range(4)}


def test_tolerance_and_normalisation(spark):
    g = graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert run_program(g, pagerank(), 50, tolerance=1e-9).count() == 3
    a = state(run_program(g, hits(), 3, normalize=True), "authority")
    assert sum(v[0] ** 2 for v in a.values()) == pytest.approx(1.0)


def test_changes_and_clamp(spark):
    row = spark.range(1).select(
        relative_change(F.lit(1.0), F.lit(0.0)).alias("inf"), relative_change(F.lit(0.0), F.lit(0.0)).alias("nan"), guarded_change(F.lit(1.0), F.lit(0.0)).alias("guarded"),
        clamped(F.lit(float("nan")), 0.0, 1.0).alias("c"), clamped(F.lit(700.0), 0.15, 500.0).alias("high"),
    ).first()
    assert math.isinf(row["inf"]) and math.isnan(row["nan"]) and row["guarded"] == 1.0 and math.isnan(row["c"]) and row["high"] == 500.0


def test_structure(spark):
    g = graph(spark, 3, [(2, 0), (1, 0)])
    assert state(g.neighbours("dst"), "neighbours") == {0: ([1, 2],), 1: ([],), 2: ([],)}
    assert g.edge(2, 0).count() == 1 and g.edge(0, 2).count() == 0
    ids = numbered(g.edges, ["src", "dst"], "edge_id")
    assert {(r["edge_id"], r["src"]) for r in ids.collect()} == {(0, 1), (1, 2)}
    assert Graph.blank(spark, 3, g.edges).vertices.count() == 3


def test_edge_list_with_malformed_lines(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,2,0.5,3,x\n3,4\nbad,5,1,1,y\n,7,1,1,y\n8,9,2\n")
    edges, bad = edge_list(spark, str(tmp_path / "e.csv"))
    assert {(r["src"], r["dst"], r["weight"], r["edge_type"]) for r in edges.collect()} == {(1, 2, 0.5, "x"), (3, 4, 1.0, ""), (8, 9, 2.0, "")}
    assert bad.select("source").count() == 2
    (tmp_path / "p.txt").write_text("1 0.5\nx y\n2 -3\n")
    assert {tuple(r) for r in point_file(spark, str(tmp_path / "p.txt")).collect()} == {(1, 0.5), (2, -3.0)}
    assert dataset("bitcoinalpha", "/d")[1:] == (3783, 24186)
    with pytest.raises(ValueError):
        dataset("other", "/d")


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.fibonacci(F.lit(10)).alias("f10"), scalars.fibonacci(F.lit(0)).alias("f0"), scalars.fibonacci(F.lit(5), F.lit(2), F.lit(3)).alias("front"), scalars.fibonacci_sum(F.lit(5)).alias("s5"),
        scalars.fibonacci_sum(F.lit(0)).alias("s0"), scalars.next_power_of_two(F.lit(0)).alias("p0"), scalars.next_power_of_two(F.lit(5)).alias("p5"), scalars.next_power_of_two(F.lit(2**31 + 1)).alias("wrap"),
        scalars.to_binary_string(F.lit(5), F.lit(2)).alias("b5"), scalars.to_binary_string(F.lit(0), F.lit(4)).alias("b0"), scalars.to_unsigned(F.lit("101")).alias("u"), scalars.to_unsigned(F.lit("")).alias("empty"),
    ).first().asDict()
    assert row == {"f10": 55, "f0": 1, "front": 5, "s5": 12, "s0": 2, "p0": 1, "p5": 8, "wrap": 0, "b5": "101", "b0": "0000", "u": 5, "empty": 0}
    with pytest.raises(Exception, match="not a binary number"):
        spark.range(1).select(scalars.to_unsigned(F.lit("12"))).collect()


def test_noise_moments(spark):
    df = spark.range(20000).select("id", noise.laplace(1.0, 2.0, noise.uniform("s", F.col("id"))).alias("x"))
    m = df.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert m["m"] == pytest.approx(1.0, abs=0.06) and m["s"] == pytest.approx(2.0, abs=0.08)
    scale = spark.range(20000).select(noise.laplace(0.0, 1.0, noise.uniform("s", F.col("id")), "scale").alias("x")).agg(F.stddev("x")).first()[0]
    assert scale == pytest.approx(2**0.5, abs=0.05)
    g = [noise.gamma(spark.range(4000), 2.0, 1.5, "id", "x").agg(F.avg("x"), F.variance("x")).first() for _ in range(2)]
    assert g[0] == g[1] and g[0][0] == pytest.approx(3.0, abs=0.15) and g[0][1] == pytest.approx(4.5, abs=0.5)


def test_kmeans_traps(spark):
    points = lambda *xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, x double")
    tie = km.lloyd(km.single(points(0, 1, 2)), {0: {0: 0.0, 1: 2.0}}, 0.0, 9.0, 0.0, "s", rounds=1)
    assert {r["id"]: r["c"] for r in tie.assigned.collect()} == {0: 0, 1: 0, 2: 1}
    dead = km.lloyd(km.single(points(0, 0.1)), {0: {0: 0.0, 1: 9.0}}, 0.0, 9.0, 0.0, "s")
    assert list(dead.centroids[0]) == [0] and dead.centroids[0][0] == pytest.approx(0.05)
    assert km.noise_deviation(0.0, 0.5, 0.0) == 0.0 and km.noise_deviation(0.0, 0.5, 1.0) == 7.5
    found = km.kmeans(points(0, 0.01, 0.4, 0.41, 7), 2, 0.0, 0.5, 0.0, "s")
    assert sorted(found.centroids[0].values())[0] == pytest.approx(0.005, abs=1e-9)
    assert len(km.seeded(points(1, 1, 1), 3, "s")) == 1  # no other value is left
    assert 0.0 not in list(km.seeded(points(3, 0, 0, 0), 2, "s", parity=True).values())[1:]
    with pytest.raises(ValueError):
        km.noisy_index(F.lit(0.1), {0: 0.0}, 0.0, "s")


def test_budget_shares(spark):
    rows = {r["dc_id"]: (r["budget_weight"], r["budget_share"]) for r in dc.budget_shares(datacenters(spark)).collect()}
    assert [rows[i][0] for i in range(5)] == [1, 2, 0, 2, 2] and rows[2][1] == 0 and rows[1][1] == pytest.approx(2 / 7)
    equal = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "dc_id int, region string, pri_rank int")
    assert all(r["budget_share"] is None for r in dc.budget_shares(equal).collect())


def test_engine(spark):
    g = graph(spark, 6, [(i, (i + k) % 6) for i in range(6) for k in (1, 2)])
    engine = GraphEngine(spark)
    assert engine.run(g, "pagerank", 2).count() == 6
    a, b = (state(engine.run(g, "pagerank", 2, method="private", privacy=PrivacyConfig(budget=50.0)), "rank") for _ in range(2))
    assert a == b
    for bad in (("sssp", "pregel"), ("pagerank", "other"), ("hits", "private")):
        with pytest.raises(ValueError):
            engine.run(g, bad[0], 1, bad[1])
    with pytest.raises(ValueError):
        GraphEngine(spark, Mode.ASYNCHRONOUS).run(g, "pagerank")


def test_private_leaves_messages_within_a_center_alone(spark):
    vertices = spark.createDataFrame([(i, 3, False) for i in range(4)], "id long, location_id int, is_seed boolean")
    g = Graph(vertices, spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "src long, dst long"))
    exact = state(run_program(g, pagerank(), 2), "rank")
    close = state(GraphEngine(spark).run(g, "pagerank", 2, method="private", privacy=PrivacyConfig()), "rank")
    assert all(close[i][0] == pytest.approx(exact[i][0]) for i in range(4))


def test_supersteps_do_not_shuffle_edges(spark):
    from orrery.plans import superstep

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        graph = Graph.blank(spark, 50, spark.createDataFrame([(i, (i * 7 + 1) % 50) for i in range(50)], "src long, dst long"))
        for name in ("pagerank", "hits"):
            program = superstep.PROGRAMS[name]()
            edges = superstep.laid_out(graph, program)
            state = superstep.started(graph, program)
            for _ in range(2):
                state = superstep.superstep(edges, state, program)
            lines = state._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [i for i, line in enumerate(lines) if "ExistingRDD" in line and "out_degree" in line]
            assert scans
            # what stands above a scan of edges, up to the join, is no exchange
            for i in scans:
                above = lines[max(0, i - 4) : i]
                joins = [k for k, line in enumerate(above) if "Join" in line]
                assert joins and not any("Exchange" in line for line in above[joins[-1] :]), above
    finally:
        spark.conf.set(key, before)
