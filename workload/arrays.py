"""Array queries on the embeddings table."""

from pyspark.sql import functions as F

from tabloom.operators import arrays
from workload.registry import query, rounded, table


def bundle(spark, sf_dir):
    """The embeddings as two arrays of one file: X (n x 64) and y (n)."""
    rows = table(spark, sf_dir, "embeddings")
    values = F.col("embedding").cast("array<double>")
    x = rows.select(
        F.lit("embeddings").alias("file"), F.lit(0).alias("position"), F.lit("X").alias("name"),
        F.col("vec_id").alias("sample_index"), F.array(F.size("embedding")).alias("shape"),
        F.lit("float32").alias("dtype"), values.alias("values"), F.lit(None).cast("string").alias("text"))
    y = rows.select(
        F.lit("embeddings").alias("file"), F.lit(1).alias("position"), F.lit("label").alias("name"),
        F.col("vec_id").alias("sample_index"), F.array().cast("array<int>").alias("shape"),
        F.lit("int32").alias("dtype"), F.array(F.col("label").cast("double")).alias("values"),
        F.lit(None).cast("string").alias("text"))
    return x.unionByName(y)


STATS_SQL = """
SELECT vec_id, round(list_avg(v), 6) AS img_mean, round(list_stddev_pop(v), 6) AS img_std,
  round(list_min(v), 6) AS img_min, round(list_max(v), 6) AS img_max,
  round(list_aggregate(v, 'quantile_cont', 0.1), 6) AS img_p10, round(list_aggregate(v, 'quantile_cont', 0.5), 6) AS img_p50,
  round(list_aggregate(v, 'quantile_cont', 0.9), 6) AS img_p90,
  round(list_avg(list_transform(v, lambda x: x * x)), 6) AS img_energy
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""


@query("array_stats", STATS_SQL)
def q_array_stats(spark, sf_dir):
    return rounded(arrays.sample_features(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding"), 6)


@query("array_feature_table", f"""
SELECT 'embeddings' AS file, s.vec_id AS sample_index, img_mean, img_std, img_min, img_max, img_p10, img_p50, img_p90,
  img_energy, label::DOUBLE AS target FROM ({STATS_SQL}) s JOIN embeddings e ON e.vec_id = s.vec_id""")
def q_array_feature_table(spark, sf_dir):
    return rounded(arrays.feature_table(bundle(spark, sf_dir), "X", "label"), 6)


@query("array_summary", """
SELECT 'embeddings' AS file, 'X' AS name, count(*) || ' × 64' AS shape, 2::INTEGER AS ndim, 'float32' AS dtype,
  round(min(list_min(v)), 6) AS min, round(max(list_max(v)), 6) AS max, round(avg(list_avg(v)), 6) AS mean
FROM (SELECT embedding::DOUBLE[] AS v FROM embeddings)
UNION ALL SELECT 'embeddings', 'label', count(*)::VARCHAR, 1, 'int32', min(label)::DOUBLE, max(label)::DOUBLE,
  round(avg(label), 6) FROM embeddings""")
def q_array_summary(spark, sf_dir):
    return rounded(arrays.array_summary(bundle(spark, sf_dir)).drop("position", "samples"), 6)


@query("guess_arrays", "SELECT 'embeddings' AS file, 'X' AS x_name, 'label' AS y_name FROM (SELECT count(*) FROM embeddings)")
def q_guess_arrays(spark, sf_dir):
    return arrays.guess_arrays(arrays.array_summary(bundle(spark, sf_dir)))


@query("array_standardize", """
WITH n AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM n)
SELECT vec_id, pos::INTEGER AS pos, round((x - mean) / (std + 0.000001), 6) AS value FROM n, m""")
def q_array_standardize(spark, sf_dir):
    out = arrays.standardize(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(out.select("vec_id", F.posexplode("standardized").alias("pos", "value")), 6)


@query("array_rescale", """
SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos,
  round(unnest(embedding)::DOUBLE * CASE WHEN label = 0 THEN 1.0 ELSE label END - 0.5, 6) AS value FROM embeddings""")
def q_array_rescale(spark, sf_dir):
    slope = F.when(F.col("label") != 0, F.col("label").cast("double"))
    out = arrays.rescale(table(spark, sf_dir, "embeddings"), "embedding", slope, F.lit(-0.5))
    return rounded(out.select("vec_id", F.posexplode("rescaled").alias("pos", "value")), 6)


@query("subsample", """
SELECT vec_id, label FROM embeddings ORDER BY ('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 8))::BIGINT, vec_id::VARCHAR LIMIT 128""")
def q_subsample(spark, sf_dir):
    return arrays.subsample(table(spark, sf_dir, "embeddings"), F.col("vec_id"), 128).select("vec_id", "label")


@query("array_slice", """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
SELECT vec_id AS sample_index, 3 AS slice_index, (i - 25)::INTEGER AS pos, v[i] AS value
FROM s, (SELECT unnest(range(25, 33)) AS i)""")
def q_array_slice(spark, sf_dir):
    # the same numbers seen as n x 8 x 8 samples; the item index is clipped to the last one
    cubes = bundle(spark, sf_dir).withColumn(
        "shape", F.when(F.col("name") == "X", F.array(F.lit(8), F.lit(8), F.lit(1))).otherwise(F.col("shape")))
    cut = arrays.array_slice(cubes, "X", index=10**9, slice_index=3)
    return cut.select("sample_index", "slice_index", F.posexplode("values").alias("pos", "value"))


# two short files and a long one that has all other rows
UNEVEN_SQL = "CASE WHEN vec_id < 30 THEN 1 WHEN vec_id < 70 THEN 2 ELSE 0 END"


@query("array_slice_uneven_files", f"""
WITH f AS (SELECT {UNEVEN_SQL} AS part, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT *, vec_id - min(vec_id) OVER (PARTITION BY part) AS sample_index FROM f),
l AS (SELECT *, max(sample_index) OVER (PARTITION BY part) AS last FROM p)
SELECT 'part' || part AS file, sample_index::INTEGER AS sample_index, round(list_sum(v), 4) AS total FROM l WHERE sample_index = least(35, last)""")
def q_array_slice_uneven_files(spark, sf_dir):
    rows = bundle(spark, sf_dir).where("name = 'X'")
    vec_id = F.col("sample_index")
    part = F.when(vec_id < 30, 1).when(vec_id < 70, 2).otherwise(0)
    start = F.when(vec_id < 30, 0).when(vec_id < 70, 30).otherwise(70)
    files = rows.withColumns({
        "file": F.concat(F.lit("part"), part.cast("string")), "sample_index": (vec_id - start).cast("int"),
        "shape": F.array(F.lit(1), F.lit(64), F.lit(1))})
    cut = arrays.array_slice(files, "X", index=35)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return cut.select("file", "sample_index", F.round(total, 4).alias("total"))
