"""Mixing sources to target weights, in DataFrame operations only.

Token shares p of the sources are tempered: w = p^a / sum(p^a).  At exponent 1
the mix is the corpus as it is, at 0 all sources weigh the same.  Entropy falls
and repetition shrinks as the exponent grows, so bisection finds the largest
exponent whose entropy reaches a target and the smallest one that repeats no
source more than a limit; the mix takes the larger, so the limit always holds.
Six levels of bisection are evaluated in one pass over the table of sources.

The weights become a stream of blocks.  Every source gets its share of the
token budget, reads its documents epoch by epoch, each in an order of its own
(by digest), and deals them evenly over the blocks; each block is then permuted.

The running sums are two-level: a digest prefix splits each epoch of a source
into many groups, whose sums are added up first.  A source with a third of all
rows is thus spread over thousands of groups; the join with the table of
sources is salted.  Nothing is broadcast by hand and no group is collected.

Defined results: a null text has no tokens; a null source is the source '';
a source without tokens gets weight 0 and no rows; rows that repeat a document
are documents of their own; an empty table gives no rows; extra columns are
ignored; ``keep_row`` carries them along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import checkpointed

LEVELS, PASSES, SALTS = 6, 4, 64


def word_count(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, entropy_share: float, budget_ratio: float, max_repeats: float) -> float:
    """The exponent for sources with positive shares ``p``; collects 63 sums a pass, whatever the number of sources."""
    sources = shares.count()
    if sources < 2:
        return 1.0
    target = entropy_share * math.log(sources)
    spans = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    for _ in range(PASSES):
        points = sorted({lo + (hi - lo) * k / 2**LEVELS for lo, hi in spans.values() for k in range(1, 2**LEVELS)} | {0.0, 1.0})
        sums = (
            shares.withColumn("a", F.explode(F.array(*map(F.lit, points))))
            .withColumn("pa", F.pow("p", "a"))
            .groupBy("a")
            .agg(F.sum("pa").alias("z"), F.sum(F.col("pa") * F.col("a") * F.ln("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("most"))
            .collect()
        )
        entropy = {r["a"]: math.log(r["z"]) - r["s"] / r["z"] for r in sums}
        repeats = {r["a"]: budget_ratio * r["most"] / r["z"] for r in sums}
        if entropy[1.0] >= target:
            spans["entropy"] = (1.0, 1.0)
        for _ in range(LEVELS):
            lo, hi = spans["entropy"]
            if lo < hi:
                mid = (lo + hi) / 2
                spans["entropy"] = (mid, hi) if entropy[mid] >= target else (lo, mid)
            lo, hi = spans["repeats"]
            mid = (lo + hi) / 2
            spans["repeats"] = (lo, mid) if mid in repeats and repeats[mid] <= max_repeats else (mid, hi)
    return max(spans["entropy"][0], 0.0 if repeats[0.0] <= max_repeats else spans["repeats"][1])


def mixed(
    docs: DataFrame,
    tokens: Column,
    entropy_share: float = 0.95,
    max_repeats: float = 4.0,
    budget_ratio: float = 1.0,
    block_tokens: int = 1 << 20,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    keep_row: bool = False,
    prefix: int = 3,
) -> DataFrame:
    """The mixed stream, a row per use of a document: doc_id, source, epoch, block, position, n_tokens, weight
    (and, with ``keep_row``, the whole row as a struct ``row``).

    ``budget_ratio`` is the token budget as a multiple of the corpus; order the
    rows by block and position to read the stream.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        tokens.alias("n_tokens"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns] if keep_row else [F.lit(True)]).alias("row"),
    )
    sums = checkpointed(rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).where("t > 0"))
    total = sums.agg(F.sum("t")).first()[0] or 0
    shares = sums.withColumn("p", F.col("t") / F.lit(float(total or 1)))
    a = exponent(shares, entropy_share, budget_ratio, max_repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    budget = math.floor(total * budget_ratio)
    blocks = max(1, -(-budget // block_tokens))
    quotas = (
        shares.withColumn("weight", F.round(F.pow("p", F.lit(a)) / F.lit(z), 12))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
        .where("quota > 0")
        .withColumn("full", F.expr("quota div t"))
        .withColumn("rest", F.expr("quota - full * t"))
        .select("source", "t", "weight", "quota", "full", "rest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    used = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(quotas, ["source", "salt"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("full - if(rest = 0, 1, 0)"))))
        .withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("sub", F.substring("h", 1, prefix))
    )
    group = ["source", "epoch", "sub"]
    before = (
        used.drop("row")
        .groupBy(*group)
        .agg(F.sum("n_tokens").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("source", "epoch").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("_sum")
    )
    own = W.partitionBy(*group).orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        used.withColumn("_own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(before, group)
        .withColumn("_at", F.col("_before") + F.col("_own"))
        .where("epoch < full or _at < rest")
        .withColumn("block", F.expr(f"(cast(epoch * t + _at as decimal(28,0)) * {blocks}) div quota"))
        .withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.lit("block"), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    last = W.partitionBy("block").orderBy("_h", "doc_id", "source", "n_tokens")
    out = placed.withColumn("position", F.row_number().over(last).cast("long"))
    return out.select("doc_id", "source", "epoch", "block", "position", "n_tokens", F.round("weight", 9).alias("weight"), *["row"] * keep_row)


def oracle_sql(entropy_share: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 20, seed: str = "mix") -> str:
    """The same rows in DuckDB, for a budget of the whole corpus and words as tokens."""
    steps = LEVELS * PASSES
    z = "(SELECT sum(pow(p, {a})) FROM s)"
    entropy = f"(ln({z}) - (SELECT sum(pow(p, {{a}}) * {{a}} * ln(p)) FROM s) / {z})"
    repeats = f"((SELECT max(pow(p, {{a}} - 1)) FROM s) / {z})"
    target = f"({entropy_share} * ln((SELECT count(*) FROM s)))"
    chain = ["b0 AS (SELECT CAST(0 AS DOUBLE) AS el, CAST(1 AS DOUBLE) AS eh, CAST(0 AS DOUBLE) AS rl, CAST(1 AS DOUBLE) AS rh)"]
    for k in range(steps):
        at = {x: f"(SELECT ({x}l + {x}h) / 2 FROM b{k})" for x in "er"}
        chain.append(f"m{k} AS MATERIALIZED (SELECT {at['e']} AS e, {at['r']} AS r)")
        e_ok = f"{entropy} >= {target}".replace("{a}", f"(SELECT e FROM m{k})")
        r_ok = f"{repeats} <= {max_repeats}".replace("{a}", f"(SELECT r FROM m{k})")
        chain.append(f"o{k} AS MATERIALIZED (SELECT {e_ok} AS e_ok, {r_ok} AS r_ok)")
        chain.append(
            f"b{k + 1} AS MATERIALIZED (SELECT CASE WHEN e_ok THEN e ELSE el END AS el, CASE WHEN e_ok THEN eh ELSE e END AS eh, "
            f"CASE WHEN r_ok THEN rl ELSE r END AS rl, CASE WHEN r_ok THEN r ELSE rh END AS rh FROM b{k}, m{k}, o{k})"
        )
    e1, r0 = entropy.replace("{a}", "1.0"), repeats.replace("{a}", "0.0")
    return f"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t FROM d GROUP BY source HAVING sum(n_tokens) > 0),
s AS MATERIALIZED (SELECT source, t, t / CAST((SELECT sum(t) FROM t) AS DOUBLE) AS p FROM t),
{', '.join(chain)},
a AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM s) < 2 THEN 1.0 ELSE greatest(
  CASE WHEN {e1} >= {target} THEN 1.0 ELSE (SELECT el FROM b{steps}) END,
  CASE WHEN {r0} <= {max_repeats} THEN 0.0 ELSE (SELECT rh FROM b{steps}) END) END AS a),
w AS (SELECT *, round(pow(p, (SELECT a FROM a)) / {z.replace('{a}', '(SELECT a FROM a)')}, 12) AS weight FROM s),
q AS (SELECT *, CAST(floor(weight * (SELECT CAST(sum(t) AS DOUBLE) FROM t)) AS BIGINT) AS quota FROM w),
f AS (SELECT *, quota // t AS full_epochs, quota % t AS rest FROM q WHERE quota > 0),
u AS (SELECT d.*, f.* EXCLUDE (source), unnest(range(0, full_epochs + CASE WHEN rest = 0 THEN 0 ELSE 1 END)) AS epoch FROM d JOIN f USING (source)),
h AS (SELECT *, md5(concat_ws('|', '{seed}', epoch, doc_id)) AS h FROM u),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM h),
k AS (SELECT *, CAST((epoch * t + place)::HUGEINT * (SELECT greatest(1, ceil(sum(t) / {block_tokens}.0))::BIGINT FROM t) // quota AS BIGINT) AS block FROM c WHERE epoch < full_epochs OR place < rest)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', '{seed}', 'block', epoch, doc_id)), doc_id, source, n_tokens) AS BIGINT) AS position,
       n_tokens, round(weight, 9) AS weight FROM k"""
