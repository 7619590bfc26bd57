"""Every registered query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..functions import noise, scalars
from ..operators import datacenters as dc
from ..operators import kmeans1d as km
from ..operators.programs import clamped, hits, pagerank, personalized_pagerank, salsa
from ..schema import MESSAGE_MB, PRIORITY, REGIONS, UPLOAD_PRICE, USUAL_PRICE, datacenters, regions
from ..sources.files import edge_list, point_file, write_edge_list
from ..sources.trade import price_points, read, trade_graph, trade_graph_numbered
from . import oracle as o
from .private import PrivacyConfig, private_pagerank
from .superstep import GraphEngine, run_program, started

STEPS, K, BOUND, SEED = 10, 4, 0.5, "orrery"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank_top(spark, sf_dir)


# ---------------------------------------------------------------- sources


@query(f"WITH {o.EDGES} SELECT * FROM edges")
def edges_from_trade(spark, d):
    return trade_graph_numbered(spark, d).edges.select("edge_id", "src", "dst", "weight", "obs", "edge_type")


@query(f"WITH {o.VERTICES} SELECT id, location_id, is_seed, 1.0::DOUBLE AS rank, 0.0::DOUBLE AS last_change FROM vertices")
def vertex_init(spark, d):
    return started(trade_graph(spark, d), pagerank())


@query(f"WITH {o.EDGES} SELECT src, dst, weight, obs, edge_type FROM edges")
def edge_list_scan(spark, d):
    """Written as text lines and read back by the edge list source."""
    path = f"{shared_dir(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    write_edge_list(trade_graph(spark, d).edges.withColumn("edge_type", F.lit("trade")), path)
    return edge_list(spark, path)[0]


@query("SELECT s_suppkey AS id, s_acctbal AS x FROM supplier")
def point_file_scan(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/points-{uuid.uuid4().hex}"
    read(spark, d, "supplier").select("s_suppkey", "s_acctbal").write.option("sep", " ").csv(path)
    return point_file(spark, path)


@query("SELECT s_suppkey AS id, least(greatest(s_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) AS x FROM supplier")
def point_source_clipped(spark, d):
    """Points from memory or a table, clipped into their bounds as they come in."""
    return km.clipped(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")), 0.0, 5000.0)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{REGIONS[i]}', {p})" for i, p in enumerate(PRIORITY)) + ") t(dc_id, region, pri_rank)")
def datacenter_table(spark, d):
    return datacenters(spark)


# ---------------------------------------------------------------- structure


def degree_sql(end: str) -> str:
    return f"WITH {o.EDGES}, {o.VERTICES} SELECT id, coalesce(n, 0) AS degree FROM vertices LEFT JOIN (SELECT {end}, count(*) AS n FROM e0 GROUP BY {end}) t ON id = {end}"


@query(degree_sql("src"))
def out_degree(spark, d):
    return trade_graph(spark, d).degrees("src")


@query(degree_sql("dst"))
def in_degree(spark, d):
    return trade_graph(spark, d).degrees("dst")


@query(f"WITH {o.EDGES} SELECT src AS id, dst AS neighbour FROM e0")
def neighbors_out(spark, d):
    return trade_graph(spark, d).neighbours("src").select("id", F.explode("neighbours").alias("neighbour"))


@query(f"WITH {o.EDGES} SELECT dst AS id, src AS neighbour FROM e0")
def neighbors_in(spark, d):
    return trade_graph(spark, d).neighbours("dst").select("id", F.explode("neighbours").alias("neighbour"))


@query(
    f"WITH {o.EDGES}, {o.VERTICES} SELECT id, coalesce(a, '') AS out_neighbours, coalesce(b, '') AS in_neighbours FROM vertices "
    "LEFT JOIN (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS a FROM e0 GROUP BY src) x ON id = x.src "
    "LEFT JOIN (SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src) AS b FROM e0 GROUP BY dst) y ON id = y.dst"
)
def adjacency_sorted(spark, d):
    g = trade_graph(spark, d)
    lists = [g.neighbours(e).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias(n)) for e, n in (("src", "out_neighbours"), ("dst", "in_neighbours"))]
    return lists[0].join(lists[1], "id")


@query(f"WITH {o.EDGES} SELECT src, dst, weight, obs FROM e0 JOIN (SELECT src, min(dst) AS dst FROM e0 GROUP BY src) USING (src, dst)")
def edge_lookup(spark, d):
    """Attributes of one edge of every vertex, by its ends."""
    g = trade_graph(spark, d)
    return g.edge_attributes(g.edges.groupBy("src").agg(F.min("dst").alias("dst"))).select("src", "dst", "weight", "obs")


@query(f"WITH {o.EDGES} SELECT edge_id, src, dst FROM edges")
def edge_endpoints(spark, d):
    return trade_graph_numbered(spark, d).edges.select("edge_id", "src", "dst")


@query(f"WITH {o.EDGES} SELECT edge_id, src, dst FROM edges WHERE edge_id = 17")
def edge_by_id(spark, d):
    return trade_graph_numbered(spark, d).edge_by_id(17)


@query(f"WITH {o.EDGES}, {o.DEGREES} SELECT src, dst, out_degree, in_degree FROM g")
def edges_with_degrees(spark, d):
    return trade_graph(spark, d).with_degrees()


# ---------------------------------------------------------------- vertex programs

RANKS = f"WITH {o.GRAPH}, {o.ranks(STEPS, False)} "
PERSONAL = f"WITH {o.GRAPH}, {o.ranks(STEPS, True)} "
HITS = f"WITH {o.GRAPH}, {o.two_sided(STEPS, False)} "
SALSA = f"WITH {o.GRAPH}, {o.two_sided(STEPS, True)} "


@query(f"{RANKS} SELECT id, round(rank, 6) AS rank FROM r{STEPS}")
def pagerank_ranks(spark, d):
    return run_program(trade_graph(spark, d), pagerank(), STEPS).select("id", F.round("rank", 6).alias("rank"))


@query(f"{RANKS} SELECT id, round(rank, 6) AS rank FROM r{STEPS} ORDER BY round(rank, 6) DESC, id LIMIT 20")
def pagerank_top(spark, d):
    """A top-k report: the limit is the feature."""
    return pagerank_ranks(spark, d).orderBy(F.desc("rank"), "id").limit(20)


@query(f"{RANKS} SELECT id, round(last_change, 6) AS last_change FROM r3")
def pagerank_change(spark, d):
    return run_program(trade_graph(spark, d), pagerank(), 3).select("id", F.round("last_change", 6).alias("last_change"))


@query(f"{PERSONAL} SELECT id, is_seed, round(rank, 6) AS rank, round(last_change, 6) AS last_change FROM r{STEPS}")
def personalized_ranks(spark, d):
    out = run_program(trade_graph(spark, d), personalized_pagerank(), STEPS)
    return out.select("id", "is_seed", F.round("rank", 6).alias("rank"), F.round("last_change", 6).alias("last_change"))


@query(f"{HITS} SELECT id, authority, hub FROM h{STEPS}")
def hits_scores(spark, d):
    return run_program(trade_graph(spark, d), hits(), STEPS).select("id", "authority", "hub")


@query(f"{HITS} SELECT id, round(last_change_a, 6) AS last_change_a, round(last_change_h, 6) AS last_change_h FROM h4")
def hits_change(spark, d):
    return run_program(trade_graph(spark, d), hits(), 4).select("id", F.round("last_change_a", 6).alias("last_change_a"), F.round("last_change_h", 6).alias("last_change_h"))


@query(
    f"{HITS} SELECT n.id, round(abs((n.hub - b.a) / b.a), 6) AS last_change_a, round(abs((n.authority - b.h) / b.h), 6) AS last_change_h FROM h4 n JOIN "
    "(SELECT id, CASE WHEN authority <> 0 THEN authority ELSE 1e-6 END AS a, CASE WHEN hub <> 0 THEN hub ELSE 1e-6 END AS h FROM h3) b USING (id)"
)
def hits_change_crossed(spark, d):
    return run_program(trade_graph(spark, d), hits("reference"), 4).select("id", F.round("last_change_a", 6).alias("last_change_a"), F.round("last_change_h", 6).alias("last_change_h"))


@query(f"{SALSA} SELECT id, round(authority, 6) AS authority, round(hub, 6) AS hub FROM h{STEPS}")
def salsa_scores(spark, d):
    return run_program(trade_graph(spark, d), salsa(), STEPS).select("id", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


@query(f"{SALSA} SELECT id, round(last_change_a, 6) AS last_change_a, round(last_change_h, 6) AS last_change_h FROM h4")
def salsa_change(spark, d):
    return run_program(trade_graph(spark, d), salsa(), 4).select("id", F.round("last_change_a", 6).alias("last_change_a"), F.round("last_change_h", 6).alias("last_change_h"))


@query(f"{RANKS} SELECT id, round(rank, 6) AS rank FROM r5")
def engine_run(spark, d):
    """Dispatch by the algorithm's name."""
    return GraphEngine(spark).run(trade_graph(spark, d), "pagerank", iterations=5).select("id", F.round("rank", 6).alias("rank"))


# ---------------------------------------------------------------- noise


def u(*keys: str) -> str:
    return o.uniform(f"'{SEED}'", *keys)


@query(f"SELECT c_custkey AS id, round({u('c_custkey')}, 9) AS u FROM customer")
def uniform_noise(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.uniform(SEED, F.col("c_custkey")), 9).alias("u"))


@query(f"SELECT c_custkey AS id, round(-3 + 10 * ({u('c_custkey')}), 9) AS u FROM customer")
def uniform_range(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.uniform_between(-3.0, 7.0, SEED, F.col("c_custkey")), 9).alias("u"))


@query(f"SELECT c_custkey AS id, round({o.laplace('1.0::DOUBLE', '2.0::DOUBLE', '(' + u('c_custkey') + ')')}, 6) AS noise FROM customer")
def laplace_noise(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.laplace(1.0, 2.0, noise.uniform(SEED, F.col("c_custkey"))), 6).alias("noise"))


@query(f"SELECT c_custkey AS id, round({o.laplace('1.0::DOUBLE', '2.0::DOUBLE', '(' + u('c_custkey') + ')', '1.0::DOUBLE')}, 6) AS noise FROM customer")
def laplace_noise_scale(spark, d):
    """The textbook form: 2 is the scale, not the deviation."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.laplace(1.0, 2.0, noise.uniform(SEED, F.col("c_custkey")), parameter="scale"), 6).alias("noise"))


@query(f"SELECT c_custkey AS id, round({o.gamma(2.0, 1.5, 'c_custkey')}, 6) AS noise FROM customer")
def gamma_noise(spark, d):
    out = noise.gamma(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), 2.0, 1.5, "id", "noise")
    return out.withColumn("noise", F.round("noise", 6))


CDF = "SELECT p_partkey AS id, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) / (sum(p_size) OVER ())::DOUBLE AS cdf FROM part"


@query(f"SELECT id, round(cdf, 6) AS cdf FROM ({CDF})")
def cdf(spark, d):
    return sizes_cdf(spark, d).select("id", F.round("cdf", 6).alias("cdf"))


def sizes_cdf(spark, d):
    return noise.pdf_to_cdf(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w")), "w", "id")


@query("SELECT p_partkey AS id, 1::BIGINT AS drawn FROM part")
def multinomial_stub(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), noise.multinomial_stub().alias("drawn"))


@query(f"SELECT min(id) AS id FROM ({CDF}) WHERE cdf > 0.37")
def multinomial_draw(spark, d):
    return noise.multinomial(sizes_cdf(spark, d), 0.37, "id")


@query(f"SELECT c_custkey AS id, least(greatest(c_acctbal / 10000.0::DOUBLE, 0.0::DOUBLE), {BOUND}::DOUBLE) AS x FROM customer")
def clip_messages(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), clamped(F.col("c_acctbal") / F.lit(10000.0), 0.0, BOUND).alias("x"))


# ---------------------------------------------------------------- k-means

GROUPED = f"{o.POINTS}, gp AS MATERIALIZED (SELECT 0 AS group_id, id, x FROM points)"
SIGMA = km.noise_deviation(0.0, BOUND, 1.0)


@query(f"WITH {o.POINTS}, {o.seeding(K, SEED)} SELECT c, round(x, 6) AS x FROM s{K - 1}")
def kmeans_seeding(spark, d):
    rows = [(c, x) for c, x in km.seeded(price_points(spark, d), K, SEED).items()]
    return spark.createDataFrame(rows, "c int, x double").select("c", F.round("x", 6).alias("x"))


@query(f"WITH {o.POINTS}, {o.seeding(K, SEED, True)} SELECT c, round(x, 6) AS x FROM s{K - 1}")
def kmeans_seeding_parity(spark, d):
    """Seeding to which the value 0 counts as used."""
    rows = [(c, x) for c, x in km.seeded(price_points(spark, d), K, SEED, parity=True).items()]
    return spark.createDataFrame(rows, "c int, x double").select("c", F.round("x", 6).alias("x"))


@query(f"WITH {GROUPED}, {o.seeding(K, SEED)}, {o.lloyd('k', 'gp', f'SELECT 0 AS group_id, c, x FROM s{K - 1}', SIGMA, SEED, 0.0, BOUND)} SELECT c, n, round(x, 4) AS x FROM k5")
def kmeans_whole(spark, d):
    """Clipping, seeding and five noisy rounds in one call."""
    return centroids(spark, km.kmeans(price_points(spark, d), K, 0.0, BOUND, 1.0, SEED))


FAR = {0: 0.05, 1: 0.2, 2: 9.0}


@query(f"WITH {GROUPED}, {o.lloyd('k', 'gp', 'SELECT * FROM (VALUES ' + ', '.join(f'(0, {c}, {x}::DOUBLE)' for c, x in FAR.items()) + ') t(group_id, c, x)', 0.0, SEED, 0.0, BOUND)} SELECT c, n, round(x, 4) AS x FROM k5")
def kmeans_dead_cluster(spark, d):
    """A centroid that no point is nearest to is dropped."""
    return centroids(spark, km.lloyd(km.single(price_points(spark, d)), {0: FAR}, 0.0, BOUND, 0.0, SEED))


def clusters(spark, d, sigma):
    return km.lloyd(km.single(price_points(spark, d)), {0: km.even(K, 0.0, BOUND)}, 0.0, BOUND, sigma, SEED)


def centroids(spark, found):
    rows = [(c, found.sizes[0][c], x) for c, x in found.centroids[0].items()]
    return spark.createDataFrame(rows, "c int, n long, x double").select("c", "n", F.round("x", 4).alias("x"))


def lloyd_sql(sigma: float) -> str:
    return f"WITH {GROUPED}, {o.lloyd('k', 'gp', o.even(K, 0.0, BOUND), sigma, SEED, 0.0, BOUND)}"


@query(f"{lloyd_sql(0.0)} SELECT c, n, round(x, 4) AS x FROM k5")
def kmeans_lloyd(spark, d):
    return centroids(spark, clusters(spark, d, 0.0))


@query(f"{lloyd_sql(SIGMA)} SELECT c, n, round(x, 4) AS x FROM k5")
def kmeans_noisy(spark, d):
    return centroids(spark, clusters(spark, d, SIGMA))


@query(f"{lloyd_sql(SIGMA)} SELECT id, c FROM ka4")
def kmeans_assign(spark, d):
    return clusters(spark, d, SIGMA).assigned.select("id", "c")


CENTERS = {0: 0.05, 1: 0.15, 2: 0.3, 3: 0.45}


@query(
    "WITH m AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 20000.0::DOUBLE, 0.0::DOUBLE), 0.5::DOUBLE) AS x FROM customer), "
    "k AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {x}::DOUBLE)" for c, x in CENTERS.items()) + ") t(c, v)), "
    "w AS (SELECT id, c, abs(x - v) AS d, max(abs(x - v)) OVER (PARTITION BY id) - min(abs(x - v)) OVER (PARTITION BY id) AS spread FROM m, k) "
    f"SELECT id, min(struct_pack(v := d + {o.laplace('0.0', 'spread * 2.0', '(' + u('id', 'c') + ')')}, c := c)).c AS c FROM w GROUP BY id"
)
def noisy_index(spark, d):
    x = clamped(F.col("c_acctbal") / F.lit(20000.0), 0.0, BOUND)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), km.noisy_index(x, CENTERS, 1.0, SEED, F.col("c_custkey")).alias("c"))


@query(
    "WITH m AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 20000.0::DOUBLE, 0.0::DOUBLE), 0.5::DOUBLE) AS x FROM customer), "
    "k AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {x}::DOUBLE)" for c, x in CENTERS.items()) + ") t(c, v)), "
    "w AS (SELECT id, c, abs(x - v) AS d, max(abs(x - v)) OVER (PARTITION BY id) - min(abs(x - v)) OVER (PARTITION BY id) AS spread FROM m, k) "
    f"SELECT id, c, round(d, 9) AS distance, round({o.laplace('0.0', 'spread * 2.0', '(' + u('id', 'c') + ')')}, 6) AS noise FROM w"
)
def noisy_index_parts(spark, d):
    """The distances and noises that the noisy choice is made of."""
    x = clamped(F.col("c_acctbal") / F.lit(20000.0), 0.0, BOUND)
    parts = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(km.noisy_distances(x, CENTERS, 1.0, SEED, F.col("c_custkey"))).alias("k"))
    return parts.select("id", "k.c", F.round("k.distance", 9).alias("distance"), F.round("k.noise", 6).alias("noise"))


# ---------------------------------------------------------------- data centers


@query(
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p})" for i, p in enumerate(PRIORITY)) + ") t(dc_id, pri_rank)), "
    "w AS (SELECT a.dc_id, a.pri_rank, (SELECT count(*) FROM c b WHERE a.pri_rank > b.pri_rank) AS budget_weight FROM c a) "
    "SELECT dc_id, pri_rank, budget_weight, CAST(sum(budget_weight) OVER () AS BIGINT) AS budget_sum, round(budget_weight / CAST(sum(budget_weight) OVER () AS DOUBLE), 6) AS budget_share FROM w"
)
def dc_budget(spark, d):
    return dc.budget_shares(datacenters(spark)).withColumn("budget_share", F.round("budget_share", 6))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', {UPLOAD_PRICE.get(r, USUAL_PRICE)}::DOUBLE, 100.0::DOUBLE, 500.0::DOUBLE)" for i, r in enumerate(REGIONS)) + ") "
    "t(location_id, region, upload_price, upload_band, download_band)"
)
def region_prices(spark, d):
    return regions(spark)


PLACED = f"{o.EDGES}, {o.VERTICES}, {o.LOCATED}"


@query(f"WITH {PLACED}, {o.TRAFFIC} SELECT src_dc, dst_dc, n_messages, n_combined, round(n_messages * {MESSAGE_MB}::DOUBLE, 9) AS mb, round(n_combined * {MESSAGE_MB}::DOUBLE, 9) AS mb_combined FROM traffic")
def dc_traffic(spark, d):
    return dc.traffic(dc.located_edges(trade_graph(spark, d))).withColumns({c: F.round(c, 9) for c in ("mb", "mb_combined")})


@query(
    f"WITH {PLACED}, {o.TRAFFIC}, up AS (SELECT src_dc, sum(n_messages) * {MESSAGE_MB}::DOUBLE AS mb FROM traffic GROUP BY src_dc), down AS (SELECT dst_dc, sum(n_messages) * {MESSAGE_MB}::DOUBLE AS mb FROM traffic GROUP BY dst_dc), "
    "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {UPLOAD_PRICE.get(REGIONS[i], USUAL_PRICE)}::DOUBLE)" for i in range(5)) + ") t(dc_id, price)) "
    "SELECT dc_id, round(coalesce(up.mb, 0), 6) AS upload_mb, round(coalesce(down.mb, 0), 6) AS download_mb, round(coalesce(up.mb, 0) * price, 9) AS upload_cost FROM p LEFT JOIN up ON dc_id = src_dc LEFT JOIN down ON dc_id = dst_dc"
)
def dc_traffic_cost(spark, d):
    out = dc.traffic_totals(dc.located_edges(trade_graph(spark, d)))
    return out.select("dc_id", F.round("upload_mb", 6).alias("upload_mb"), F.round("download_mb", 6).alias("download_mb"), F.round("upload_cost", 9).alias("upload_cost"))


@query(f"WITH {PLACED}, {o.DEGREES} SELECT src_dc, l.dst, dst_dc, round(sum(1.0::DOUBLE / out_degree), 6) AS value, count(*) AS n_messages, string_agg(l.src::VARCHAR, ',' ORDER BY l.src) AS sources FROM located l JOIN dout ON l.src = dout.src GROUP BY src_dc, l.dst, dst_dc")
def dc_combine(spark, d):
    g = trade_graph(spark, d)
    out = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    sent = dc.located_edges(g).join(out, "src").withColumn("value", F.lit(1.0) / F.col("n"))
    return dc.combined_sources(sent).select("src_dc", "dst", "dst_dc", F.round("value", 6).alias("value"), "n_messages", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("SELECT o_orderpriority AS key, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice, o_orderkey) AS items FROM orders GROUP BY 1")
def message_collector(spark, d):
    out = dc.collected(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return out.select(F.col("o_orderpriority").alias("key"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(f"WITH {PLACED}, {o.DEGREES}, {o.private(3, 1.0, 2, BOUND, 'private')} SELECT id, round(rank, 6) AS rank FROM q3")
def private_ranks(spark, d):
    return private_pagerank(trade_graph(spark, d), PrivacyConfig(), 3).select("id", F.round("rank", 6).alias("rank"))


# ---------------------------------------------------------------- scalars

FIB = "WITH RECURSIVE f(k, a, b) AS (SELECT 1, 1::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 60)"


@query(f"{FIB} SELECT p_partkey AS id, p_size AS k, f.a AS fib, CASE WHEN p_partkey <> 0 THEN p_partkey + p_size ELSE f.a END AS fib_front FROM part JOIN f ON p_size = f.k")
def fibonacci(spark, d):
    k = F.col("p_size")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), k.alias("k"), scalars.fibonacci(k).alias("fib"), scalars.fibonacci(k, F.col("p_partkey"), k).alias("fib_front"))


@query(f"{FIB}, s AS (SELECT k, CAST(sum(a) OVER (ORDER BY k) AS BIGINT) AS s FROM f) SELECT p_partkey AS id, p_size AS k, s.s AS fib_sum FROM part JOIN s ON p_size = s.k")
def fibonacci_sum(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("k"), scalars.fibonacci_sum(F.col("p_size")).alias("fib_sum"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey <= 1 THEN 1::BIGINT ELSE 1::BIGINT << length(bin(o_orderkey - 1)) END AS power FROM orders")
def next_pow2(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), scalars.next_power_of_two(F.col("o_orderkey")).alias("power"))


@query("SELECT o_orderkey AS n, lpad(bin(o_orderkey), greatest(8, length(bin(o_orderkey)))::INT, '0') AS digits FROM orders")
def to_binary(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), scalars.to_binary_string(F.col("o_orderkey"), F.lit(8)).alias("digits"))


@query("SELECT o_orderkey AS n, o_orderkey AS parsed FROM orders")
def to_unsigned(spark, d):
    n = F.col("o_orderkey")
    return read(spark, d, "orders").select(n.alias("n"), scalars.to_unsigned(scalars.to_binary_string(n, F.lit(8))).alias("parsed"))
