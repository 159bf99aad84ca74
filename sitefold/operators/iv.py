"""Two-stage least squares over data split by site.

Every estimator is: per-site moments -> sum -> one small solve. Rows are scanned once for the
moments, once more only where the statistic truly needs row values (a squared prediction, a fold
prediction, or squared residuals).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import matrix as mx
from sitefold.operators import moments as mo
from sitefold.runtime import cut, join_small

# Columns that may never enter a design: kept in the data only to check results against.
ORACLE_COLUMNS = ("u", "U")
BASES = ("linear", "quadratic")


@dataclass(frozen=True)
class Design:
    """Column names by role. Excluded instruments precede covariates in Z, endogenous columns in W."""

    instruments: tuple[str, ...]
    endogenous: tuple[str, ...]
    exogenous: tuple[str, ...] = field(default=())
    y: str = "y"

    def __post_init__(self):
        bad = set(self.instruments + self.endogenous + self.exogenous) & set(ORACLE_COLUMNS)
        if bad:
            raise ValueError(f"oracle column(s) {sorted(bad)} may not enter a design")
        if set(self.instruments) & set(self.exogenous):
            raise ValueError("a column cannot be an excluded instrument and exogenous at once")

    @property
    def z(self) -> list[str]:
        return [*self.instruments, *self.exogenous]

    @property
    def w(self) -> list[str]:
        return [*self.endogenous, *self.exogenous]

    @property
    def columns(self) -> list[str]:
        return sorted({*self.z, *self.w, self.y})


def shared_design(snps: Sequence[str], covariates: Sequence[str] = (), x: str = "x", y: str = "y") -> Design:
    return Design(tuple(snps), (x,), tuple(covariates), y)


def generated_design(basis: str = "linear", covariates: Sequence[str] = (), x: str = "x", y: str = "y") -> Design:
    if basis == "linear":
        return Design(("xhat",), (x,), tuple(covariates), y)
    if basis == "quadratic":
        return Design(("xhat", "xhat2"), (x, "x2"), tuple(covariates), y)
    raise ValueError(f"unknown basis {basis!r}; use one of {BASES}")


def fit(sums: DataFrame, d: Design, by: Sequence[str] = ()) -> DataFrame:
    """Solve from summed moments; one row per group with an `iv` struct (see matrix.IV_FIT)."""
    s = F.struct(
        mx.flat(mo.gram(d.z, d.z)).alias("a"), mx.flat(mo.gram(d.z, d.w)).alias("b"),
        F.array(*[mo.S(z, d.y) for z in d.z]).alias("c"), mx.flat(mo.gram(d.w, d.w)).alias("d"),
        F.array(*[mo.S(w, d.y) for w in d.w]).alias("e"), mo.S(d.y, d.y).alias("f"), F.col("n"), F.col("absorbed"),
        F.lit(len(d.endogenous)).alias("n_endog"), F.lit(len(d.instruments)).alias("n_instr"))
    return sums.withColumn("iv", mx.iv_fit(s))


def require_identified(fitted: DataFrame) -> DataFrame:
    """Turn a failed solve into an error that carries the reason."""
    ok = F.col("iv.status") == "ok"
    return fitted.withColumn("iv", F.when(ok, F.col("iv")).otherwise(F.raise_error(F.col("iv.status")).cast(
        fitted.schema["iv"].dataType)))


def tidy(fitted: DataFrame, d: Design, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, term): estimate, classical and (if present) robust standard error."""
    p = len(d.w)
    robust = "robust_cov" in fitted.columns
    rows = [F.struct(F.lit(w).alias("term"), F.col("iv.theta")[i].alias("theta"),
                     F.sqrt(F.col("iv.cov")[i * p + i]).alias("se"),
                     (F.sqrt(F.col("robust_cov")[i * p + i]) if robust else F.lit(None).cast("double")).alias("robust_se"))
            for i, w in enumerate(d.w)]
    return fitted.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def _with_site_means(df: DataFrame, site_moments: DataFrame, cols: Sequence[str], site: str) -> DataFrame:
    means = site_moments.select(site, *[mo.M(c).alias(f"_m_{c}") for c in cols])
    return join_small(df, means, [site], ready=True)


def robust_meat(df: DataFrame, site_moments: DataFrame, d: Design, theta: Sequence[float], site: str = "site") -> DataFrame:
    """Sum of u^2 z z' over centred rows, u the structural residual at theta (second scan)."""
    rows = _with_site_means(df, site_moments, d.columns, site)
    c = {v: F.col(v) - F.col(f"_m_{v}") for v in d.columns}
    u = c[d.y]
    for t, w in zip(theta, d.w):
        u = u - F.lit(float(t)) * c[w]
    rows = rows.select(*[c[z].alias(z) for z in d.z], (u * u).alias("_u2"))
    return rows.agg(*[F.sum(F.col("_u2") * F.col(a) * F.col(b)).alias(mo.s_name(a, b)) for a, b in mo.pairs(d.z)])


def with_robust(fitted: DataFrame, df: DataFrame, site_moments: DataFrame, d: Design, site: str = "site") -> DataFrame:
    """Attach the HC0 covariance. theta (a handful of numbers) is read once and sent to the scan."""
    fitted = cut(fitted)
    theta = fitted.select("iv.theta", "iv.status").first()
    if theta["status"] != "ok":
        return fitted.withColumn("robust_cov", F.lit(None).cast("array<double>"))
    meat = robust_meat(df, site_moments, d, theta["theta"], site)
    meat = meat.select(mx.flat(mo.gram(d.z, d.z)).alias("h"))
    return fitted.withColumn("_h", meat.scalar()).withColumn("robust_cov", mx.sandwich("iv.bread", "_h")).drop("_h")


# ---------------------------------------------------------------- first stages


def local_first_stage(site_moments: DataFrame, snps: Sequence[str], covariates: Sequence[str] = (), x: str = "x",
                      by: Sequence[str] = ("site",)) -> DataFrame:
    """Per-site regression of x on [1, G, C]: coefficients `pi`, intercept, and the two residual sums
    of squares the combined first-stage F needs."""
    z = [*snps, *covariates]
    fs = site_moments.withColumn("_fs", mx.project(mx.flat(mo.gram(z, z)), mx.flat(mo.gram(z, [x]))))
    fs = fs.withColumn("pi", F.col("_fs.coef")).withColumn("fs_rss_full", mo.S(x, x) - F.col("_fs.explained")[0])
    intercept = mo.M(x)
    for j, c in enumerate(z):
        intercept = intercept - F.col("pi")[j] * mo.M(c)
    fs = fs.withColumn("fs_intercept", intercept)
    if covariates:
        red = mx.project(mx.flat(mo.gram(covariates, covariates)), mx.flat(mo.gram(covariates, [x])))
        fs = fs.withColumn("fs_rss_reduced", mo.S(x, x) - red["explained"][0])
    else:
        fs = fs.withColumn("fs_rss_reduced", mo.S(x, x))
    return (fs.withColumn("fs_n_instruments", F.lit(len(snps))).withColumn("fs_n_params", F.lit(len(z) + 1)).drop("_fs"))


FS_SUMS = ("fs_rss_full", "fs_rss_reduced", "fs_n_instruments", "fs_n_params")


def add_xhat_moments(fs: DataFrame, z: Sequence[str], others: Sequence[str]) -> DataFrame:
    """Cross-products of xhat = a + z pi by algebra on the moments; no row is touched."""
    def along(v):
        total = F.col("pi")[0] * mo.S(z[0], v)
        for j in range(1, len(z)):
            total = total + F.col("pi")[j] * mo.S(z[j], v)
        return total

    out = fs.select("*", *[along(v).alias(mo.s_name("xhat", v)) for v in dict.fromkeys([*others, *z])])
    quad = F.col("pi")[0] * mo.S("xhat", z[0])
    for j in range(1, len(z)):
        quad = quad + F.col("pi")[j] * mo.S("xhat", z[j])
    return out.withColumn(mo.s_name("xhat", "xhat"), quad)


def predict_rows(df: DataFrame, coefs: DataFrame, z: Sequence[str], on: Sequence[str], name: str = "xhat") -> DataFrame:
    """xhat = fs_intercept + z pi on the rows, coefficients joined from a written per-group table."""
    rows = join_small(df, coefs.select(*on, F.col("fs_intercept").alias("_a"), F.col("pi").alias("_pi")), list(on), ready=True)
    xhat = F.col("_a")
    for j, c in enumerate(z):
        xhat = xhat + F.col("_pi")[j] * F.col(c)
    return rows.withColumn(name, xhat).drop("_a", "_pi")


def with_squares(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("x2", F.col(x) * F.col(x)).withColumn("xhat2", F.col("xhat") * F.col("xhat"))


def global_first_stage(site_moments: DataFrame, snps: Sequence[str], covariates: Sequence[str] = (), x: str = "x",
                       site: str = "site") -> DataFrame:
    """One first stage over all sites with site intercepts; the intercept is recovered per site."""
    z = [*snps, *covariates]
    total = mo.combine(site_moments)
    pi = total.select(mx.project(mx.flat(mo.gram(z, z)), mx.flat(mo.gram(z, [x])))["coef"].alias("pi"))
    with_pi = site_moments.withColumn("pi", cut(pi).scalar())
    a = mo.M(x)
    for j, c in enumerate(z):
        a = a - F.col("pi")[j] * mo.M(c)
    return with_pi.withColumn("fs_intercept", a)


def local_first_stage_f(sums: DataFrame) -> list[Column]:
    """F and partial R2 of the whole instrument set from summed local residual sums of squares."""
    gain = F.col("fs_rss_reduced") - F.col("fs_rss_full")
    df1, df2 = F.col("fs_n_instruments"), F.col("n") - F.col("fs_n_params")
    return [((gain / df1) / (F.col("fs_rss_full") / df2)).alias("first_stage_F"),
            (gain / F.col("fs_rss_reduced")).alias("partial_r2"), df1.alias("df1"), df2.alias("df2")]


# ---------------------------------------------------------------- cross-fitting


def leave_fold_out_shared(fold_moments: DataFrame, z: Sequence[str], x: str = "x", site: str = "site",
                          fold: str = "fold") -> DataFrame:
    """Global coefficients without fold j, from moments centred within (site, fold), and the site
    intercept from the site's other folds. One row per (site, fold)."""
    per_fold = mo.combine(fold_moments, [fold])
    cols = [mo.s_name(a, b) for a, b in mo.pairs([*z, x])]
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(0))
    rest = per_fold.select(fold, *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in cols])
    pi = rest.select(fold, mx.project(mx.flat(mo.gram(z, z)), mx.flat(mo.gram(z, [x])))["coef"].alias("pi"))
    own = Window.partitionBy(site)
    n_out = F.sum("n").over(own) - F.col("n")

    def mean_out(c):
        return (F.sum(F.col("n") * mo.M(c)).over(own) - F.col("n") * mo.M(c)) / n_out

    means = fold_moments.select(site, fold, *[mean_out(c).alias(f"o_{c}") for c in [*z, x]])
    joined = means.join(pi, fold)
    a = F.col(f"o_{x}")
    for j, c in enumerate(z):
        a = a - F.col("pi")[j] * F.col(f"o_{c}")
    return joined.select(site, fold, "pi", a.alias("fs_intercept"))


def leave_fold_out_local(fold_moments: DataFrame, z: Sequence[str], x: str = "x", site: str = "site",
                         fold: str = "fold") -> DataFrame:
    """Per-site coefficients without fold j, fitted on the other folds together: (n, mean,
    cross-product) triples are merged and the held-out part removed."""
    names = sorted({*z, x})
    site_total = _merge_groups(fold_moments, names, [site])
    t = fold_moments.join(site_total, site)
    total = {"n": F.col("T_n"), "m": {c: F.col(f"T_m_{c}") for c in names},
             "s": {(a, b): F.col("T_" + mo.s_name(a, b)) for a, b in mo.pairs(names)}}
    part = {"n": F.col("n"), "m": {c: mo.M(c) for c in names}, "s": {(a, b): mo.S(a, b) for a, b in mo.pairs(names)}}
    out = mo.merge_out(total, part)
    rest = t.select(site, fold, out["n"].alias("n"), *[out["m"][c].alias(f"m_{c}") for c in names],
                    *[out["s"][ab].alias(mo.s_name(*ab)) for ab in out["s"]])
    return local_first_stage(rest, z, (), x).select(site, fold, "pi", "fs_intercept")


def _merge_groups(m: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Moments of the union of groups, columns prefixed T_."""
    s = mo.total_scatter(m.select(*by, "n", *[f"m_{c}" for c in names],
                                  *[mo.s_name(a, b) for a, b in mo.pairs(names)]), by)
    return s.select(*by, *[F.col(c).alias(f"T_{c}") for c in s.columns if c not in (*by, "sites")])


def crossfit_site_moments(fold_moments: DataFrame, coefs: DataFrame, z: Sequence[str], d: Design) -> DataFrame:
    """Second-stage site moments of the linear cross-fit without touching a row: inside one (site,
    fold) the prediction is linear in z, so its moments are algebra; folds then merge."""
    part = add_xhat_moments(fold_moments.join(coefs, ["site", "fold"]), z, ["x", d.y, *d.exogenous])
    mean = F.col("fs_intercept")
    for j, c in enumerate(z):
        mean = mean + F.col("pi")[j] * mo.M(c)
    part = part.withColumn("m_xhat", mean)
    cols = d.columns
    part = part.select("site", "n", *[f"m_{c}" for c in cols], *[mo.s_name(a, b) for a, b in mo.pairs(cols)])
    return mo.total_scatter(part, ["site"]).drop("sites")


# ---------------------------------------------------------------- protocols


@dataclass
class Run:
    """A completed run: per-site moments of the second stage, their sums with the solve, and the
    number of times statistics left the sites."""

    design: Design
    site_moments: DataFrame
    fitted: DataFrame
    rounds: int

    def estimates(self) -> DataFrame:
        return tidy(self.fitted, self.design)


def _finish(df: DataFrame, site_moments: DataFrame, d: Design, robust: bool, rounds: int, extra: Sequence[str] = ()) -> Run:
    site_moments = cut(site_moments)
    fitted = fit(mo.combine(site_moments, extra=extra), d)
    if robust:
        fitted = with_robust(fitted, df, site_moments, d)
    return Run(d, site_moments, fitted, rounds + int(robust))


def _origin(first: DataFrame, d: Design) -> dict[str, float]:
    """Rough centres of the second-stage columns from first-stage moments; xhat shares x's mean."""
    c = mo.centres(first, ["x"])
    c.update(xhat=c["x"], xhat2=c["x"] * c["x"])
    return {name: c[name] for name in d.columns}


def shared_instruments(df: DataFrame, snps: Sequence[str], covariates: Sequence[str] = (), basis: str = "linear",
                       crossfit: int = 0, robust: bool = True, fold: str = "fold") -> Run:
    """The same instruments at every site: one global first stage."""
    z = [*snps, *covariates]
    if crossfit:
        d = generated_design(basis, covariates)
        folded = df if fold == "fold" else df.withColumn("fold", F.col(fold))
        fold_moments = cut(mo.moments(folded, [*z, "x", d.y], ("site", "fold")))
        coefs = cut(leave_fold_out_shared(fold_moments, z))
        rows = with_squares(predict_rows(folded, coefs, z, ("site", "fold"))) if robust or basis != "linear" else None
        m = crossfit_site_moments(fold_moments, coefs, z, d) if basis == "linear" else mo.moments(rows, d.columns, origin=_origin(fold_moments, d))
        return _finish(rows, m, d, robust, 2)
    elif basis == "quadratic":
        first = cut(mo.moments(df, [*z, "x", "y"]))
        rows = predict_rows(df, cut(global_first_stage(first, snps, covariates)), z, ("site",))
    else:
        d = shared_design(snps, covariates)
        return _finish(df, mo.moments(df, d.columns), d, robust, 1)
    rows = with_squares(rows)
    d = generated_design(basis, covariates)
    return _finish(rows, mo.moments(rows, d.columns, origin=_origin(first, d)), d, robust, 2)


def local_first_stages(df: DataFrame, snps: Sequence[str], covariates: Sequence[str] = (), basis: str = "linear",
                       crossfit: int = 0, robust: bool = True, fold: str = "fold") -> Run:
    """Site-specific instruments: each site fits its own first stage and only the generated
    instrument's moments are combined. The linear basis needs no second scan."""
    z = [*snps, *covariates]
    d = generated_design(basis, covariates)
    if crossfit:
        folded = df if fold == "fold" else df.withColumn("fold", F.col(fold))
        fold_moments = cut(mo.moments(folded, [*z, "x", d.y], ("site", "fold")))
        fs = cut(local_first_stage(mo.total_scatter(fold_moments, ["site"]).drop("sites"), snps, covariates))
        coefs = cut(leave_fold_out_local(fold_moments, z))
        rows = with_squares(predict_rows(folded, coefs, z, ("site", "fold"))) if robust or basis != "linear" else None
        if basis == "linear":
            m = crossfit_site_moments(fold_moments, coefs, z, d).join(fs.select("site", *FS_SUMS), "site")
            return _finish(rows, m, d, robust, 1, FS_SUMS)
    else:
        fs = cut(local_first_stage(mo.moments(df, [*z, "x", d.y]), snps, covariates))
        rows = with_squares(predict_rows(df, fs, z, ("site",))) if (robust or basis == "quadratic") else None
        if basis == "linear":
            m = add_xhat_moments(fs, z, ["x", "y", *covariates]).withColumn("m_xhat", mo.M("x"))
            return _finish(rows, m, d, robust, 1, FS_SUMS)
    m = mo.moments(rows, d.columns, origin=_origin(fold_moments if crossfit else fs, d)).join(fs.select("site", *FS_SUMS), "site")
    return _finish(rows, m, d, robust, 1, FS_SUMS)


def protocol_for(manifest: dict):
    """Shared instruments only where the manifest says so."""
    return shared_instruments if manifest.get("shared_snps") else local_first_stages


def from_manifest(manifest: DataFrame, df: DataFrame, snps: Sequence[str], sites: DataFrame | None = None, **options) -> Run:
    """The protocol that the one document of a manifest table asks for, run on the rows of its sites. Rows of sites that the manifest does not
    name are refused, and so are sites of the manifest without rows. `sites`, where it is known, has the sites of `df`, and spares a scan."""
    docs = manifest.select("shared_snps", F.col("sites.site_id").alias("ids")).take(2)
    if len(docs) != 1:
        raise ValueError(f"one manifest is needed, not {len(docs) or 'none'}")
    known, found = set(docs[0]["ids"] or ()), {r["site"] for r in (df if sites is None else sites).select("site").distinct().collect()}
    if known != found:
        raise ValueError(f"sites without rows: {sorted(known - found)}; rows of sites not in the manifest: {sorted(found - known)}")
    return protocol_for({"shared_snps": bool(docs[0]["shared_snps"])})(df, snps, **options)


def estimate(df: DataFrame, snps: Sequence[str], instruments: str = "site", **options) -> Run:
    """One call: instruments 'site' (own first stages) or 'shared'."""
    if instruments not in ("site", "shared"):
        raise ValueError(f"instruments must be 'site' or 'shared', got {instruments!r}")
    return (shared_instruments if instruments == "shared" else local_first_stages)(df, snps, **options)


def packed_first_stages(df: DataFrame, g: str, width: int, x: str = "x", y: str = "y", by: Sequence[str] = ("site",)) -> DataFrame:
    """Local first stages with the instruments in one array column of any width: one scan.

    Each task reduces its rows to one cross-product matrix per site; what remains per site are the
    six scalar moments of (xhat, x, y), in the layout `fit` takes.
    """
    a = mo.moments_arrays(df, [x, y], by, g, width)
    s = a.select(*by, "n", "mean", mx.first_stage_packed("m2", F.lit(width)).alias("_p"))
    xx, xy, yy, px, py = (F.col("_p")[i] for i in range(5))
    return s.select(*by, "n", F.col("mean")[width].alias(f"m_{x}"), F.col("mean")[width].alias("m_xhat"), F.col("mean")[width + 1].alias(f"m_{y}"),
                    xx.alias(mo.s_name(x, x)), xy.alias(mo.s_name(x, y)), yy.alias(mo.s_name(y, y)), px.alias(mo.s_name("xhat", x)),
                    px.alias(mo.s_name("xhat", "xhat")), py.alias(mo.s_name("xhat", y)), (xx - px).alias("fs_rss_full"), xx.alias("fs_rss_reduced"),
                    F.lit(width).alias("fs_n_instruments"), F.lit(width + 1).alias("fs_n_params"))


def require_identity(table: DataFrame, where: Column, tol: float = 1e-10) -> DataFrame:
    """Fail the run when an estimate that must equal the pooled fit does not."""
    gap = F.col("abs_diff_from_pooled")
    checked = F.when(where & (gap >= tol), F.raise_error(F.concat(F.lit("differs from the pooled fit by "), gap.cast("string"))).cast("double"))
    return table.withColumn("abs_diff_from_pooled", F.coalesce(checked, gap))


# ---------------------------------------------------------------- other estimators on moments


def pooled_naive(site_moments: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """OLS of y on x with site intercepts."""
    return site_moments.agg((F.sum(mo.S(x, y)) / F.sum(mo.S(x, x))).alias("naive"))


def single_table(df: DataFrame, snps: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """OLS and 2SLS of one table with a single intercept: cov(xhat, y) / var(xhat)."""
    whole = mo.moments(df, [*snps, x, y], ())
    p = mx.project(mx.flat(mo.gram(snps, snps)), mx.flat(mo.gram(snps, [x, y])))
    return whole.select((mo.S(x, y) / mo.S(x, x)).alias("ols"), p.alias("p")).select(
        "ols", (F.col("p.explained")[1] / F.col("p.explained")[0]).alias("tsls"))


def pooled_estimand(site_moments: DataFrame, site_theta: DataFrame, instruments: Sequence[str], x: str = "x") -> DataFrame:
    """The limit of pooled 2SLS when slopes differ by site: first-stage weighted site slopes."""
    sums = site_moments.join(site_theta, "site").agg(
        *[F.sum(mo.S(a, b)).alias(mo.s_name(a, b)) for a, b in mo.pairs(instruments)],
        *[F.sum(mo.S(z, x)).alias(f"b_{z}") for z in instruments],
        *[F.sum(mo.S(z, x) * F.col("theta")).alias(f"bt_{z}") for z in instruments])
    cross = mx.flat([[F.col(f"b_{z}"), F.col(f"bt_{z}")] for z in instruments])
    p = mx.project(mx.flat(mo.gram(instruments, instruments)), cross)
    return sums.select(p.alias("p")).select((F.col("p.explained")[1] / F.col("p.explained")[0]).alias("estimand"))


def residual_orthogonality(rows: DataFrame, theta: float, instruments: Sequence[str] = ("xhat",)) -> DataFrame:
    """Centred sum of instrument times residual: the estimating equation, zero at the estimate."""
    u = F.col("y") - F.lit(theta) * F.col("x")
    return (rows.groupBy("site").agg(*[(F.covar_pop(F.col(z), u) * F.count(F.lit(1))).alias(z) for z in instruments])
            .agg(*[F.sum(z).alias(z) for z in instruments]))
