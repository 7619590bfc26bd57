"""The SQL twins of the queries, written for DuckDB, independently of the DataFrame plans."""

from __future__ import annotations

EDGES = """e0 AS MATERIALIZED (
  SELECT o_custkey AS src, l_partkey % n AS dst, round(avg(round(l_discount * 100) - 5), 6) AS weight, round(sum(l_quantity), 6) AS obs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN (SELECT count(*) AS n FROM customer) c
  WHERE l_returnflag = 'R' AND o_custkey <> l_partkey % n GROUP BY ALL),
edges AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS edge_id, src, dst, weight, obs, 'trade' AS edge_type FROM e0)"""
VERTICES = """vertices AS MATERIALIZED (
  SELECT c_custkey AS id, n_regionkey AS location_id, (c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS is_seed
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
DEGREES = """dout AS MATERIALIZED (SELECT src, count(*) AS out_degree FROM e0 GROUP BY src),
din AS MATERIALIZED (SELECT dst, count(*) AS in_degree FROM e0 GROUP BY dst),
g AS MATERIALIZED (SELECT src, dst, out_degree, in_degree FROM e0 JOIN dout USING (src) JOIN din USING (dst))"""
POINTS = """points AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS id,
         least(greatest(l_extendedprice / CAST(210000 AS DOUBLE), 0), 0.5) AS x FROM lineitem)"""
GRAPH = f"{EDGES}, {VERTICES}, {DEGREES}"


def uniform(*keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def laplace(mu: str, sigma: str, u: str, divisor: str = "sqrt(2.0::DOUBLE)") -> str:
    v = f"({u} - 0.5)"
    return f"({mu} - ({sigma}) / {divisor} * sign{v} * ln(1 - 2 * abs{v}))"


def gamma(shape: float, scale: float, key: str, tries: int = 12) -> str:
    """Marsaglia and Tsang's method, for shapes from 1 on."""
    d = shape - 1 / 3
    cases = []
    for t in range(tries):
        u1, u2, u3 = (uniform("'gamma'", key, f"'{t}{x}'") for x in "abc")
        normal = f"(sqrt(-2 * ln({u1})) * cos(2 * 3.141592653589793::DOUBLE * {u2}))"
        root = f"(1 + {1 / (9 * d) ** 0.5}::DOUBLE * {normal})"
        cases.append(f"WHEN {root} > 0 AND ln({u3}) < 0.5 * pow({normal}, 2) + {d}::DOUBLE - {d}::DOUBLE * pow({root}, 3) + {d}::DOUBLE * 3 * ln(greatest({root}, 1e-300::DOUBLE)) THEN {d}::DOUBLE * pow({root}, 3)")
    return f"({scale}::DOUBLE * CASE {' '.join(cases)} ELSE {d}::DOUBLE END)"


def ranks(steps: int, personal: bool) -> str:
    """CTEs r0 ... rN of (id, is_seed, rank, last_change)."""
    first = "CASE WHEN is_seed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if personal else "1.0::DOUBLE"
    out = [f"r0 AS MATERIALIZED (SELECT id, is_seed, {first} AS rank, 0.0::DOUBLE AS last_change FROM vertices)"]
    base, low = ("CASE WHEN v.is_seed THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END", "0.0") if personal else ("0.15::DOUBLE", "0.15")
    for k in range(steps):
        new = f"least(greatest({base} + 0.85::DOUBLE * coalesce(s, 0), {low}::DOUBLE), 500.0::DOUBLE)"
        change = f"abs({new} - v.rank) / CASE WHEN abs(v.rank) > 1e-5 THEN abs(v.rank) ELSE 1.0 END" if personal else f"abs(({new} - v.rank) / v.rank)"
        out.append(
            f"r{k + 1} AS MATERIALIZED (SELECT v.id, v.is_seed, {new} AS rank, {change} AS last_change FROM r{k} v LEFT JOIN "
            f"(SELECT dst, sum(rank / out_degree) AS s FROM g JOIN r{k} ON src = id GROUP BY dst) m ON v.id = m.dst)"
        )
    return ", ".join(out)


def two_sided(steps: int, salsa: bool) -> str:
    """CTEs h0 ... hN of (id, authority, hub, last_change_a, last_change_h)."""
    out = ["h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS authority, 1.0::DOUBLE AS hub, 0.0::DOUBLE AS last_change_a, 0.0::DOUBLE AS last_change_h FROM vertices)"]
    f, b = ("hub / out_degree", "authority / in_degree") if salsa else ("hub", "authority")
    change = "abs((coalesce({n}, 0) - {o}) / {o})".replace("{o}", "CASE WHEN v.{c} <> 0 THEN v.{c} ELSE 1e-6 END")
    for k in range(steps):
        out.append(
            f"h{k + 1} AS MATERIALIZED (SELECT v.id, coalesce(a, 0) AS authority, coalesce(h, 0) AS hub, {change.format(n='a', c='authority')} AS last_change_a, "
            f"{change.format(n='h', c='hub')} AS last_change_h FROM h{k} v LEFT JOIN (SELECT dst, sum({f}) AS a FROM g JOIN h{k} ON src = id GROUP BY dst) x ON v.id = x.dst "
            f"LEFT JOIN (SELECT src, sum({b}) AS h FROM g JOIN h{k} ON dst = id GROUP BY src) y ON v.id = y.src)"
        )
    return ", ".join(out)


def lloyd(name: str, points: str, start: str, sigma: float, seed: str, low: float, high: float, rounds: int = 5) -> str:
    """CTEs {name}0 ... {name}N of (group_id, c, n, x), and the assignment {name}a of the last round; points has (group_id, x) and a key ``id``."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for r in range(rounds):
        out.append(
            f"{name}a{r} AS MATERIALIZED (SELECT p.group_id, p.id, any_value(p.x) AS x, min(struct_pack(d := (p.x - k.x) * (p.x - k.x), c := k.c)).c AS c "
            f"FROM {points} p JOIN {name}{r} k ON p.group_id = k.group_id GROUP BY p.group_id, p.id)"
        )
        keys = lambda what: uniform(f"'{seed}'", str(r), "group_id", "c", f"'{what}'")  # noqa: B023, E731
        out.append(
            f"{name}n{r} AS MATERIALIZED (SELECT group_id, c, CAST(trunc(n + {laplace('0.0', str(sigma), keys('count'))}) AS BIGINT) AS n, s + {laplace('0.0', str(sigma), keys('sum'))} AS s "
            f"FROM (SELECT group_id, c, count(*) AS n, sum(x) AS s FROM {name}a{r} GROUP BY group_id, c))"
        )
        out.append(
            f"{name}{r + 1} AS MATERIALIZED (SELECT group_id, c, n, least(greatest(m, {low}::DOUBLE), {high}::DOUBLE) AS x FROM (SELECT group_id, c, n, "
            f"CASE WHEN n <> 0 THEN s / n WHEN s > 0 THEN {high}::DOUBLE WHEN s < 0 THEN {low}::DOUBLE END AS m FROM {name}n{r}) WHERE m IS NOT NULL)"
        )
    return ", ".join(out)


def even(k: int, low: float, high: float, groups: int = 1) -> str:
    rows = ", ".join(f"({g}, {c}, {low + (high - low) * (c + 0.5) / k}::DOUBLE)" for g in range(groups) for c in range(k))
    return f"SELECT * FROM (VALUES {rows}) t(group_id, c, x)"


def seeding(k: int, seed: str, parity: bool = False) -> str:
    """CTEs s0 ... of (c, x): a random point, then the first point by id where the running squared distance reaches a random share of the total."""
    out = [f"s0 AS MATERIALIZED (SELECT 0 AS c, x FROM points WHERE id = (SELECT least(count(*) - 1, CAST(floor({uniform(f"'{seed}'", "'seed'", '0')} * count(*)) AS BIGINT)) FROM points))"]
    for i in range(1, k):
        out.append(f"d{i} AS MATERIALIZED (SELECT p.id, any_value(p.x) AS x, min((p.x - s.x) * (p.x - s.x)) AS d FROM points p, s{i - 1} s GROUP BY p.id)")
        out.append(f"c{i} AS MATERIALIZED (SELECT id, x, sum(d) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM d{i})")
        out.append(
            f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT {i}, x FROM (SELECT x FROM c{i} WHERE run >= {uniform(f"'{seed}'", "'seed'", str(i))} * (SELECT sum(d) FROM d{i}) "
            f"AND x NOT IN (SELECT x FROM s{i - 1}) {'AND x <> 0' if parity else ''} ORDER BY id LIMIT 1))"
        )
    return ", ".join(out)


LOCATED = "located AS MATERIALIZED (SELECT e0.src, e0.dst, a.location_id AS src_dc, b.location_id AS dst_dc FROM e0 JOIN vertices a ON e0.src = a.id JOIN vertices b ON e0.dst = b.id)"
TRAFFIC = """traffic AS MATERIALIZED (SELECT src_dc, dst_dc, CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_combined
  FROM (SELECT src_dc, dst_dc, dst, count(*) AS n FROM located WHERE src_dc <> dst_dc GROUP BY ALL) GROUP BY ALL)"""


def private(steps: int, budget: float, bits: int, bound: float, seed: str) -> str:
    k, share = 2**bits, budget / steps
    sigma = (bound + 1) * 5 / (share * 0.5)
    out = ["q0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS rank FROM vertices)"]
    start = even(k, 0.0, bound, 5)
    for t in range(steps):
        out.append(f"v{t} AS MATERIALIZED (SELECT l.src_dc, l.dst, l.dst_dc, rank / out_degree AS value FROM located l JOIN q{t} ON l.src = id JOIN dout ON l.src = dout.src)")
        out.append(f"w{t} AS MATERIALIZED (SELECT src_dc AS group_id, dst AS id, round(least(greatest(sum(value), 0.0::DOUBLE), {bound}::DOUBLE), 9) AS x FROM v{t} WHERE src_dc <> dst_dc GROUP BY src_dc, dst)")
        out.append(lloyd(f"p{t}_", f"w{t}", start, sigma, f"{seed}|{t}", 0.0, bound))
        start = f"SELECT group_id, c, x FROM p{t}_5"
        out.append(
            f"i{t} AS MATERIALIZED (SELECT w.group_id, w.id, k.c, k.x, abs(w.x - k.x) AS d, max(abs(w.x - k.x)) OVER z - min(abs(w.x - k.x)) OVER z AS spread "
            f"FROM w{t} w JOIN p{t}_5 k ON w.group_id = k.group_id WINDOW z AS (PARTITION BY w.group_id, w.id))"
        )
        noise = laplace("0.0", f"spread * ({2.0 / (share * 0.5)})", uniform(f"'{seed}|{t}'", "group_id", "id", "c"))
        out.append(f"j{t} AS MATERIALIZED (SELECT id AS dst, min(struct_pack(v := d + {noise}, c := c, x := x)).x AS value FROM i{t} GROUP BY group_id, id)")
        out.append(
            f"q{t + 1} AS MATERIALIZED (SELECT id, least(greatest(0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0), 0.15::DOUBLE), 500.0::DOUBLE) AS rank FROM q{t} LEFT JOIN "
            f"(SELECT dst, sum(value) AS s FROM (SELECT dst, value FROM v{t} WHERE src_dc = dst_dc UNION ALL SELECT dst, value FROM j{t}) GROUP BY dst) ON id = dst)"
        )
    return ", ".join(out)
