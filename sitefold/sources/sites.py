"""Scans: site rows, roles, manifests, truth records, logs and moment tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.operators.iv import ORACLE_COLUMNS

SITE_RECORD = T.StructType([
    T.StructField("site_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("h2_x", T.DoubleType()),
    T.StructField("gamma_x", T.DoubleType()), T.StructField("gamma_y", T.DoubleType()), T.StructField("theta1", T.DoubleType()),
    T.StructField("avg_slope", T.DoubleType()), T.StructField("seed", T.LongType()), T.StructField("events", T.LongType())])

MANIFEST = T.StructType([
    T.StructField("shape", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("theta1", T.DoubleType()),
    T.StructField("theta2", T.DoubleType()), T.StructField("n_snps", T.LongType()), T.StructField("seed", T.LongType()),
    T.StructField("shared_snps", T.BooleanType()), T.StructField("shared_maf", T.ArrayType(T.DoubleType())),
    T.StructField("shared_beta", T.ArrayType(T.DoubleType())), T.StructField("sites", T.ArrayType(SITE_RECORD))])

TRUTH = T.StructType([T.StructField(n, T.DoubleType()) for n in (
    "avg_slope", "h2_x", "gamma_x", "gamma_y", "theta1", "theta2", "theta")])

CURVES = T.StructType([T.StructField("site", T.StringType()), T.StructField("round", T.IntegerType()),
                       T.StructField("x", T.DoubleType()), T.StructField("f", T.DoubleType()),
                       T.StructField("f_lo", T.DoubleType()), T.StructField("f_hi", T.DoubleType())])

# Shapes a folder name may carry when the manifest has none, in order of search.
SHAPES = ("quadratic", "threshold", "linear", "cox")


def site_name(suffix: str) -> Column:
    """File stem (or the dataset folder carrying the suffix) of the row's source file. It is cut out of the path of every row, so plain searches
    do it; the pattern, which tries every place of a path, is left to paths without such a stem."""
    path = F.col("_metadata.file_path")
    stem = F.substring_index(F.substring_index(path, suffix, 1), "/", -1)
    return F.when(F.contains(path, F.lit(suffix)) & (stem != ""), stem).otherwise(F.regexp_extract(path, r"([^/]+?)" + re.escape(suffix), 1))


def site_schema(n_snps: int, survival: bool = False, oracle: bool = True) -> T.StructType:
    fields = [T.StructField("id", T.LongType()), *[T.StructField(f"snp{j}", T.ByteType()) for j in range(n_snps)]]
    fields += [T.StructField("U", T.DoubleType())] if oracle else []
    fields += [T.StructField("X", T.DoubleType())]
    fields += [T.StructField("time", T.DoubleType()), T.StructField("event", T.ByteType())] if survival else [T.StructField("Y", T.DoubleType())]
    return T.StructType(fields)


def scan_sites(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, suffix: str | None = None, folders: bool = False) -> DataFrame:
    """Many per-site files as one table; the site column comes from the file name, or with `folders` from the name of the folder that Spark wrote a
    site's files to."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(site_name((suffix or f".{fmt}") + ("/" if folders else "")).alias("site"), *df.columns)


def instrument_columns(df: DataFrame, pattern: str = r"^snp") -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def pack_instruments(df: DataFrame, pattern: str = r"^snp", name: str = "g") -> DataFrame:
    """Instrument columns as one array column, in column order."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in instrument_columns(df, pattern)]))


def select_covariates(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Covariates under a cov: prefix; an oracle column is refused when the plan is built."""
    for c in covariates:
        if c in ORACLE_COLUMNS:
            raise ValueError(f"{c!r} is an oracle column and may not be a covariate")
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    return df.select(*[c for c in df.columns if c not in covariates], *[F.col(c).alias(f"cov:{c}") for c in covariates])


def infer_roles(columns: Sequence[str]) -> dict[str, str]:
    """Roles by naming convention: snp* instruments, X endogenous, Y or (time, event) outcome."""
    roles = {}
    for c in columns:
        low = c.lower()
        if low.startswith("snp"):
            roles[c] = "instrument"
        elif c in ORACLE_COLUMNS:
            roles[c] = "oracle"
        elif low == "x":
            roles[c] = "endogenous"
        elif low in ("y", "time", "event"):
            roles[c] = "outcome"
    return roles


def detect_family(df: DataFrame, y: str = "y", outcome: str | None = None) -> DataFrame:
    """One-row table naming the outcome family: survival by schema, binary by values."""
    cols = {c.lower() for c in df.columns}
    if {"time", "event"} <= cols:
        return df.agg(F.lit("survival").alias("family"))
    if y not in df.columns:
        raise ValueError(f"no outcome column in {sorted(df.columns)}")
    binary = F.lit(outcome == "binary") | F.coalesce(F.bool_and(F.col(y).isin(0, 1)), F.lit(False))
    return df.agg(F.when(binary, "binary").otherwise("continuous").alias("family"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents; a missing shape falls back to the folder name."""
    folder = F.col("_metadata.file_path")
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    named = F.lit("linear")
    for s in reversed(SHAPES):
        named = F.when(F.element_at(F.split(folder, "/"), -2).contains(s), s).otherwise(named)
    return df.withColumn("shape", F.coalesce(F.nullif("shape", F.lit("")), named))


def explode_sites(manifest: DataFrame) -> DataFrame:
    keep = [c for c in manifest.columns if c not in ("sites", "seed", "theta1", "shared_maf", "shared_beta")]
    return manifest.select(*keep, F.explode("sites").alias("s")).select(*keep, "s.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    return df.select(site_name(".truth.json").alias("site"), *TRUTH.fieldNames())


def site_sizes(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Rows and training rows per site; only the site column is read."""
    n = F.count(F.lit(1))
    return df.groupBy("site").agg(n.alias("n"), (n - F.ceil(n * F.lit(test_size))).alias("n_train"))


def concat_logs(parts: Sequence[DataFrame], order: Sequence[str] = ("round", "site")) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*order)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURVES).option("header", True).csv(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def write_summary_statistics(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").partitionBy("site").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_moments(site_moments: DataFrame, path: str) -> None:
    """What one site hands over: the wide moment rows, one folder per site."""
    site_moments.write.mode("overwrite").partitionBy("site").parquet(path)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
