"""Estimators side by side: what each says, what it needs from the sites, and how far it is from the fit on all rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.operators import curves as cv
from sitefold.operators import gwas as gw
from sitefold.operators import iv
from sitefold.operators import meta as ma
from sitefold.operators import moments as mo
from sitefold.runtime import cut

NUMBERS = ("theta1", "se1", "robust_se1", "theta2", "se2", "robust_se2", "first_stage_F", "partial_r2", "generated_instrument_F", "abs_diff_from_pooled")
# What has to leave a site for each kind of estimator.
ROWS, STATISTICS, FOLD_STATISTICS, ESTIMATES, SUMMARIES = (
    "rows", "n, means and cross-products, first-stage sums, then the meat of the robust covariance", "first-stage statistics by fold, then as without folds",
    "coefficients with their covariance", "slope and standard error of exposure and outcome on every instrument")


def first_stage_record(run: iv.Run, x: str = "x") -> DataFrame:
    """(endogenous, F, partial_r2, df1, df2, conditional, source, generated_instrument_F), one row per endogenous column.

    `conditional` says that F is about this column given the others, which holds with one endogenous column, and for x where sites fitted their own
    first stages: then F is that of all their instruments together, from the sums of their residual squares, and that of the
    generated instrument stands beside it."""
    d, fitted = run.design, run.fitted
    local = all(c in fitted.columns for c in iv.FS_SUMS)
    rows = []
    for i, name in enumerate(d.endogenous):
        generic = {"F": F.col("iv.fs_f")[i], "partial_r2": F.col("iv.fs_r2")[i], "df1": F.col("iv.fs_df1").cast("long"), "df2": F.col("iv.fs_df2").cast("long"),
                   "conditional": F.lit(len(d.endogenous) == 1), "source": F.lit("excluded instruments"), "generated_instrument_F": F.lit(None).cast("double")}
        if name == x and local:
            f, r2, df1, df2 = iv.local_first_stage_f(fitted)
            generic |= {"F": f, "partial_r2": r2, "df1": df1.cast("long"), "df2": df2.cast("long"), "conditional": F.lit(True), "source": F.lit("first stages of the sites"), "generated_instrument_F": generic["F"]}
        rows.append(F.struct(F.lit(name).alias("endogenous"), *[c.cast("double").alias(k) if k in ("F", "partial_r2") else c.alias(k) for k, c in generic.items()]))
    return fitted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pooled_rows(rows: DataFrame, d: iv.Design) -> DataFrame:
    """The same fit from centred rows instead of combined statistics: what the sites would get by putting their rows together."""
    centred = mo.centre_within(rows, d.columns)
    c = lambda v: F.col(f"{v}_c")
    sums = centred.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site").alias("absorbed"), *[F.sum(c(a) * c(b)).alias(mo.s_name(a, b)) for a, b in mo.pairs(d.columns)])
    return iv.fit(sums, d)


def _line(name: str, terms: DataFrame, leaves: str, record: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """One row of the table from (term, theta, se, robust_se)."""
    of = lambda term, value: F.max(F.when(F.col("term") == term, F.col(value)))
    out = terms.agg(*[of(t, v).alias(f"{label}{i}") for i, t in ((1, "x"), (2, "x2")) for label, v in (("theta", "theta"), ("se", "se"), ("robust_se", "robust_se"))])
    if record is not None:
        out = out.crossJoin(record.where("endogenous = 'x'").select(F.col("F").alias("first_stage_F"), "partial_r2", "generated_instrument_F"))  # one row and one row
    return out.withColumn("estimator", F.lit(name)).withColumn("rounds", F.lit(rounds).cast("int")).withColumn("what_leaves_site", F.lit(leaves))


def _plain(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(F.lit("x").alias("term"), *[columns.get(c, F.lit(None).cast("double")).alias(c) for c in ("theta", "se", "robust_se")])


def _site_meta(site_moments: DataFrame, d: iv.Design) -> DataFrame:
    """Inverse-covariance combination of each site's own fit."""
    p = len(d.w)
    fits = iv.fit(site_moments.withColumn("absorbed", F.lit(1)), d, ("site",)).where("iv.status = 'ok'")
    est = fits.select(*[F.col("iv.theta")[i].alias(f"theta_{i + 1}") for i in range(p)], *[F.col("iv.cov")[i * p + j].alias(f"v_{i + 1}_{j + 1}") for i in range(p) for j in range(i, p)])
    m = ma.matrix_meta(est, p)
    rows = [F.struct(F.lit(w).alias("term"), F.col(f"theta_{i + 1}").alias("theta"), F.col(f"se_{i + 1}").alias("se"), F.lit(None).cast("double").alias("robust_se")) for i, w in enumerate(d.w)]
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def comparison_table(df: DataFrame, snps: Sequence[str], shared: bool = False, curved: bool = False, crossfit: int = 5, tol: float = 1e-10) -> DataFrame:
    """One row per estimator: both coefficients with classical and robust standard errors, first-stage figures, distance from the fit on all rows, rounds
    of communication and what leaves a site.

    With `curved` the quadratic fits follow the linear ones (own first stages only: shared instruments have no such benchmark). A combined fit that
    is further than `tol` from its benchmark on rows is an error."""
    protocol = iv.shared_instruments if shared else iv.local_first_stages
    label = "shared instruments" if shared else "own first stages"
    design = iv.shared_design(snps) if shared else iv.generated_design("linear")
    site = cut(mo.moments(df, [*snps, "x", "y"]))
    fs = cut(iv.local_first_stage(site, snps))
    rows = iv.with_squares(iv.predict_rows(df, fs, snps, ("site",)))
    pooled = cut(iv.tidy(pooled_rows(df if shared else rows, design), design))
    own = cut(iv.add_xhat_moments(fs, snps, ["x", "y"]).withColumn("m_xhat", mo.M("x")))
    generated = iv.generated_design("linear")

    def protocol_line(name: str, leaves: str, **options) -> DataFrame:
        run = protocol(df, snps, **options)
        return _line(name, run.estimates(), leaves, first_stage_record(run), run.rounds)

    lines = [_line("all rows", pooled, ROWS)]
    if shared:
        lines.append(_line("all rows, own first stages", iv.tidy(pooled_rows(rows, generated), generated), ROWS))
    lines += [protocol_line(label, STATISTICS), protocol_line(f"{label}, {crossfit} folds", FOLD_STATISTICS, crossfit=crossfit),
              _line("meta-analysis of sites", _site_meta(own, generated), ESTIMATES)]
    ivw = ma.inverse_variance(gw.ivw(gw.gwas(df, snps)).select(F.col("ivw").alias("theta"), F.col("ivw_se").alias("se")))
    lines += [_line("meta-analysis of summary statistics", _plain(ivw, theta=F.col("meta"), se=F.col("meta_se")), SUMMARIES),
              _line("no instruments", _plain(iv.pooled_naive(site), theta=F.col("naive")), STATISTICS)]
    exact = {label}
    parts = [(lines, pooled)]
    if curved and not shared:
        quadratic = iv.generated_design("quadratic")
        stacked = cut(iv.tidy(pooled_rows(rows, quadratic), quadratic))
        run = iv.local_first_stages(df, snps, basis="quadratic")
        parts.append(([_line("all rows, quadratic", stacked, ROWS), _line(f"{label}, quadratic", run.estimates(), STATISTICS, first_stage_record(run), run.rounds),
                       protocol_line(f"{label}, quadratic, {crossfit} folds", FOLD_STATISTICS, basis="quadratic", crossfit=crossfit),
                       _line("meta-analysis of sites, quadratic", _site_meta(run.site_moments, quadratic), ESTIMATES)], stacked))
        exact.add(f"{label}, quadratic")
    out = None
    for group, benchmark in parts:
        table = None
        for line in group:
            table = line if table is None else table.unionByName(line, allowMissingColumns=True)
        of = lambda term: benchmark.where(F.col("term") == term).select("theta").scalar()  # noqa: E731, B023
        gap = F.greatest(F.abs(F.col("theta1") - of("x")), F.abs(F.col("theta2") - of("x2")))
        table = table.withColumn("abs_diff_from_pooled", F.when(~F.col("estimator").startswith("all rows"), gap))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    out = iv.require_identity(out, F.col("estimator").isin(*exact), tol)
    return out.select("estimator", *[(F.col(c) if c in out.columns else F.lit(None).cast("double")).alias(c) for c in NUMBERS], "rounds", "what_leaves_site")


def run_curve(run: iv.Run, robust: bool = True, full_covariance: bool = False) -> DataFrame:
    """The curve of a fit on the x grid with its 95% band: (site, round, k, x, f, f_lo, f_hi), site 'all', round the rounds it took.

    The band comes from the robust covariance where the run has one, as its standard errors do; `full_covariance` adds the covariance between the
    coefficients to their variances."""
    p, w = len(run.design.endogenous), len(run.design.w)
    cov = "robust_cov" if robust and "robust_cov" in run.fitted.columns else "iv.cov"
    est = cut(run.fitted.select(*[F.col("iv.theta")[i].alias(f"theta_{i + 1}") for i in range(p)], *[F.col(cov)[i * w + j].alias(f"v_{i + 1}_{j + 1}") for i in range(p) for j in range(i, p)]))
    curve = cv.coefficient_curve(est, p, full_covariance=full_covariance)
    return curve.select(F.lit("all").alias("site"), F.lit(run.rounds).alias("round"), "k", "x", "f", "f_lo", "f_hi")
