"""Stress transforms, noise plans, the privacy ledger, secure sums and leakage tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.functions import tails
from sitefold.operators import ordered as od

MODES = ("central", "local", "distributed")
TWO64 = 18446744073709551616
TWO63 = 9223372036854775808


# ---- stress transforms


def poison(updates: DataFrame, kind: str, scale: float = 1.0, noise_sd: float = 1.0, seed: int = 0,
           sites: DataFrame | None = None) -> DataFrame:
    """Replace the listed sites' vectors: sign_flip, scale or gaussian. All sites when none listed."""
    if kind == "sign_flip":
        vec = sc.scale(F.col("vec"), F.lit(-float(scale)))
    elif kind == "scale":
        vec = sc.scale(F.col("vec"), F.lit(float(scale)))
    elif kind == "gaussian":
        vec = F.transform("vec", lambda v, i: F.lit(float(noise_sd)) * sc.hash_normal(F.lit(seed), F.col("round"), F.col("site"), i))
    else:
        raise ValueError(f"unknown stress {kind!r}")
    if sites is None:
        return updates.withColumn("vec", vec)
    hit = sites.select("site", F.lit(True).alias("_hit"))
    return updates.join(hit, "site", "left").withColumn("vec", F.when(F.col("_hit"), vec).otherwise(F.col("vec"))).drop("_hit")


def flip_outcome(df: DataFrame, y: str = "y", binary: bool = False) -> DataFrame:
    return df.withColumn(y, (1 - F.col(y)) if binary else -F.col(y))


def shuffle_outcomes(df: DataFrame, outcomes: list[str], ids: list[str], seed: int = 0) -> DataFrame:
    """Permute outcome columns together within each site: two independent hashed orders of the same
    rows, joined position by position. `ids` need not be unique: the other columns break ties, so rows that still tie are alike
    and a repeated task deals the same values to the same rows."""
    fixed = [*ids, *(c for c in df.columns if c not in (*ids, *outcomes, "site"))]
    left = od.hashed_rank(df.drop(*outcomes), ["site"], fixed, seed, "_pos")
    right = od.hashed_rank(df, ["site"], [*fixed, *outcomes], seed + 1, "_pos").select("site", "_pos", *outcomes)
    return left.join(right, ["site", "_pos"]).drop("_pos").select(*df.columns)


# ---- noise and accounting


def noise_plan(weights: DataFrame, mode: str, clip_norm: float, z: float, min_honest: int | None = None) -> DataFrame:
    """Noise sd per site (on the unweighted update) and on the server, from public weights w."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    every = Window.partitionBy(F.lit(0))
    w_max = F.max("w").over(every)
    m = F.lit(float(min_honest)) if min_honest else F.count(F.lit(1)).over(every).cast("double")
    client = {"central": F.lit(0.0), "local": F.lit(float(z * clip_norm)),
              "distributed": F.lit(float(z * clip_norm)) * w_max / (F.sqrt(m) * F.col("w"))}[mode]
    server = F.lit(float(z * clip_norm)) * w_max if mode == "central" else F.lit(0.0)
    return weights.withColumn("client_sd", client).withColumn("server_sd", server)


def add_noise(updates: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """Add each site's planned Gaussian noise; draws depend on (seed, round, site, coordinate) only."""
    j = updates.join(plan.select("site", "client_sd"), "site")
    vec = F.transform("vec", lambda v, i: v + F.col("client_sd") * sc.hash_normal(F.lit(seed), F.col("round"), F.col("site"), i))
    return j.withColumn("vec", vec).drop("client_sd")


def ledger(releases: DataFrame, z: float, with_epsilon: bool = True, delta: float = 1e-5) -> DataFrame:
    """Account a log of releases (mode, secure, round, site, noisy) against the released model and
    against whoever sees single messages.

    T is the number of rounds, h the sites that add noise, m the honest count the noise was sized
    for. Replacing a record instead of removing it doubles mu.
    """
    g = releases.groupBy("mode", "secure").agg(
        F.countDistinct("round").alias("rounds"), F.countDistinct("site").alias("sites"),
        F.countDistinct(F.when(F.col("noisy"), F.col("site"))).alias("noise_adders"), F.max("min_honest").alias("_m"))
    m = F.coalesce(F.col("_m"), F.col("sites")).cast("double")
    h = F.col("noise_adders").cast("double")
    base = F.sqrt(F.col("rounds").cast("double")) / F.lit(float(z))
    inf = F.lit(math.inf)
    dist = F.when(h > 0, base / F.sqrt(h / m)).otherwise(inf)
    mode = F.col("mode")
    agg = F.when(mode == "distributed", dist).otherwise(base)
    srv = (F.when(mode == "central", inf).when(mode == "local", base).when(F.col("secure"), dist).otherwise(base * F.sqrt(m)))
    out = g.withColumn("mu_aggregate", agg).withColumn("mu_server", srv).drop("_m")
    if with_epsilon:
        d = F.lit(float(delta))
        for name in ("aggregate", "server"):
            out = out.withColumn(f"epsilon_{name}", tails.gdp_eps(F.col(f"mu_{name}"), d))
            out = out.withColumn(f"epsilon_{name}_replace", tails.gdp_eps(2 * F.col(f"mu_{name}"), d))
    return out


# ---- secure sum


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _wide(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


def _mod64(c: Column) -> Column:
    return F.pmod(c, _wide(TWO64))


def pair_masks(updates: DataFrame, key: int) -> DataFrame:
    """For every pair of sites i < j in a round one shared pseudo-random number per coordinate,
    added by i and subtracted by j (in 0..2^64). The last coordinate carries the weight."""
    s = updates.select("round", "site", F.size("vec").alias("_p"))
    a, b = s.select("round", F.col("site").alias("i"), "_p"), s.select("round", F.col("site").alias("j"))
    pairs = a.join(b, "round").filter(F.col("i") < F.col("j"))
    r = pairs.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("_p"))))
    raw = _dec(F.xxhash64(F.lit(key), F.col("i"), F.col("j"), F.col("round"), F.col("c")))
    r = r.withColumn("_r", _mod64(raw))
    both = r.select("round", "c", F.explode(F.array(
        F.struct(F.col("i").alias("site"), F.col("_r").alias("m")), F.struct(F.col("j").alias("site"), (-F.col("_r")).cast("decimal(38,0)").alias("m"))
    )).alias("e"))
    return both.groupBy("round", F.col("e.site").alias("site"), "c").agg(_mod64(F.sum("e.m").cast("decimal(38,0)")).alias("mask"))


def masked_messages(updates: DataFrame, key: int, bits: int = 24) -> DataFrame:
    """Fixed-point weighted updates with masks added, mod 2^64: what a single message looks like."""
    payload = F.concat(sc.scale(F.col("vec"), F.col("weight").cast("double")), F.array(F.col("weight").cast("double")))
    enc = updates.select("round", "site", F.posexplode(payload).alias("c", "v")).withColumn("_e", _dec(sc.fixed_encode(F.col("v"), bits)))
    j = enc.join(pair_masks(updates, key), ["round", "site", "c"], "left")
    return j.select("round", "site", "c", _mod64((F.col("_e") + F.coalesce(F.col("mask"), F.lit(0))).cast("decimal(38,0)")).alias("message"))


def unmask_sum(messages: DataFrame, bits: int = 24) -> DataFrame:
    """Sum mod 2^64, recentre, decode and divide by the carried weight: the weighted mean."""
    t = messages.groupBy("round", "c").agg(_mod64(F.sum("message").cast("decimal(38,0)")).alias("t"))
    big = _wide(TWO64)
    signed = F.when(F.col("t") >= _wide(TWO63), F.col("t") - big).otherwise(F.col("t"))
    t = t.withColumn("v", sc.fixed_decode(signed, bits)).select("round", "c", "v")
    last = t.groupBy("round").agg(F.max_by("v", "c").alias("w"), F.max("c").alias("_last"))
    return t.join(last, "round").filter(F.col("c") < F.col("_last")).select("round", F.col("c").alias("j"), (F.col("v") / F.col("w")).alias("v"))


# ---- leakage


def leakage_table(seen: DataFrame, truth: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Cosine between what an observer reads and the true update per (round, site), with the honest
    mean per round."""
    j = seen.select("round", "site", F.col("vec").alias("_s")).join(truth.select("round", "site", F.col("vec").alias("_t")), ["round", "site"])
    out = j.select("round", "site", sc.cosine(F.col("_s"), F.col("_t")).alias("update_cos"))
    if flagged is not None:
        out = out.join(flagged.select("site"), "site", "left_anti")
    return out
