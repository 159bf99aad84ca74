"""Structured Streaming runs over the event files, checked against the batch result."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query
from sitefold.runtime import scratch_path
from sitefold.streaming import moments as sm
from sitefold.streaming import rounds as rd


def event_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    src = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return src.select(F.col("event_type").alias("site"), F.col("value").alias("x"), (F.col("value") + F.col("user_id") % 7).alias("y"))


@query("running_moments_str2", "STR2", q.select(["ev AS (SELECT event_type AS site, value AS x, value + user_id % 7 AS y FROM events)"], f"SELECT site, count(*) AS n, {q.rnd('regr_slope(y, x)')} AS slope FROM ev GROUP BY site"))
def running_moments(spark, d):
    out = scratch_path(spark, "stream-out")

    def keep(batch, _epoch):
        sm.slopes(batch).write.mode("overwrite").parquet(out)

    sm.run_available(sm.running_moments(event_stream(spark, d), ["x", "y"]), keep, scratch_path(spark, "stream-cp"))
    return spark.read.parquet(out).select("site", "n", r("slope").alias("slope"))


@query("running_wide_moments_str2b", "STR2 AGG3", q.select(["u AS (SELECT label AS site, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x, list_sum(CAST(embedding AS DOUBLE[])) AS total FROM embeddings)"],
       f"SELECT site, CAST(k AS INT) AS k, count(*) AS n, {q.rnd('avg(x)')} AS mean, {q.rnd('covar_pop(x, x)*count(*)', 5)} AS own, {q.rnd('covar_pop(x, total)*count(*)', 4)} AS row_total FROM u GROUP BY site, k"))
def running_wide_moments(spark, d):
    """All dimensions of the embeddings by label, over several triggers; row totals take in every cell of the matrix."""
    files, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    table = fx.table(spark, d, "embeddings").select(F.col("label").alias("site"), "embedding")
    table.repartition(6).write.parquet(files)
    width = table.agg(F.max(F.size("embedding"))).first()[0]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(files)

    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    sm.run_available(sm.running_moment_arrays(stream, [], ("site",), "embedding", width), keep, scratch_path(spark, "stream-cp"), "update")
    seen = spark.read.parquet(out)
    last = seen.join(seen.groupBy("site").agg(F.max("epoch").alias("epoch")), ["site", "epoch"]).select("site", "n", F.posexplode(F.arrays_zip("mean")).alias("k", "z"), "m2")
    row = F.slice("m2", F.col("k") * width + 1, F.lit(width))
    return last.select("site", "k", "n", r("z.mean").alias("mean"), r(F.get("m2", F.col("k") * (width + 1)), 5).alias("own"), r(F.aggregate(row, F.lit(0.0), lambda a, b: a + b), 4).alias("row_total"))


@query("round_barrier_str1", "STR1", q.select([q.EMB, "mw AS (SELECT max(vec_id) AS last, CAST(vec_id % 3 AS INT) AS round, label AS site FROM embeddings GROUP BY 2, 3)",
       "lv AS (SELECT m.round, e.label AS site, e.j, e.v FROM emb e JOIN mw m ON e.vec_id = m.last)"], f"SELECT round, 'complete' AS status, CAST(j AS INT) AS j, {q.rnd('avg(v)')} AS v FROM lv GROUP BY round, j"))
def round_barrier(spark, d):
    schema = fx.table(spark, d, "embeddings").schema
    src = spark.readStream.schema(schema).parquet(f"{d}/embeddings.parque[t]")
    msgs = src.select((F.col("vec_id") % 3).cast("int").alias("round"), F.col("label").cast("string").alias("site"), F.col("vec_id").alias("seq"),
                      F.lit(1.0).alias("weight"), F.col("embedding").cast("array<double>").alias("vec"))
    expected = sorted(x[0] for x in fx.table(spark, d, "embeddings").select(F.col("label").cast("string")).distinct().collect())  # one per site
    path = scratch_path(spark, "rounds")
    qy = (rd.round_barrier(msgs, expected).writeStream.format("parquet").outputMode("append")
          .option("checkpointLocation", scratch_path(spark, "rounds-cp")).trigger(availableNow=True).start(path))
    qy.awaitTermination()
    done = spark.read.parquet(path).filter("status = 'complete'")
    return done.select("round", "status", F.posexplode("vec").alias("j", "v")).select("round", "status", "j", r("v").alias("v"))
