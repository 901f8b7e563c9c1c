"""Queries over vectors: the table of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import vectors as vx
from colloquy.operators import clusters, pipeline
from colloquy.plans.registry import query, table

VX = "x as (select vec_id, label, list_transform(embedding, lambda a: a::double) v from embeddings), u as (select vec_id, label, list_transform(v, lambda a: a / greatest(sqrt(list_dot_product(v, v)), 1e-12)) v from x)"


def _mid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vx.doubles(F.col("embedding")).alias("v"))


def _next(spark, sf_dir):
    e = _mid(spark, sf_dir)
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


@query("f16_unit", f"with {VX} select vec_id, round(list_sum(v), 9) total, round(sqrt(list_dot_product(v, v)), 9) n from u")
def f16_unit(spark, sf_dir):
    e = _mid(spark, sf_dir).select("vec_id", vx.unit(F.col("v")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), F.round(vx.norm(F.col("v")), 9).alias("n"))


@query("f17_cosine_distance", f"with {VX} select a.vec_id, round(greatest(0, least(2, 1 - list_dot_product(a.v, b.v))), 9) distance from x a join x b on b.vec_id = a.vec_id + 1")
def f17_cosine_distance(spark, sf_dir):
    return _next(spark, sf_dir).select("vec_id", F.round(vx.cosine_distance(F.col("v"), F.col("w")), 9).alias("distance"))


@query("f20_logsumexp", f"with {VX} select vec_id, round(ln(list_sum(list_transform(v, lambda a: exp(a)))), 9) lse, round(list_max(list_transform(v, lambda a: exp(a))) / list_sum(list_transform(v, lambda a: exp(a))), 9) top from x")
def f20_logsumexp(spark, sf_dir):
    return _mid(spark, sf_dir).select("vec_id", F.round(vx.logsumexp(F.col("v")), 9).alias("lse"), F.round(F.array_max(vx.softmax(F.col("v"))), 9).alias("top"))


@query("f18_projected")
def f18_projected(spark, sf_dir):
    rng = np.random.default_rng(7)
    return clusters.transform(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rng.normal(size=64) * 0.01, rng.normal(size=(64, 16)), rng.normal(size=16) * 0.01)


CENTROIDS = f"""{VX}, parts as (select label, unnest(v) a, generate_subscripts(v, 1) p from u), means as (select label, p, avg(a) a from parts group by all),
raw as (select label, list(a order by p) c from means group by all), cen as (select label, list_transform(c, lambda a: a / greatest(sqrt(list_dot_product(c, c)), 1e-12)) c from raw)"""


@query("a03_centroids", f"with {CENTROIDS} select label, round(list_sum(c), 9) total, round(c[1], 9) first_x, (select count(*) from u where u.label = cen.label) n from cen")
def a03_centroids(spark, sf_dir):
    c = clusters.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), F.round(F.element_at("centroid", 1), 9).alias("first_x"), "n")


@query("a26_silhouettes", f"""with {VX}, d as (select a.vec_id, a.label, b.label other, sum(greatest(0, least(2, 1 - list_dot_product(a.v, b.v)))) d, count(*) n from u a join u b on a.vec_id <> b.vec_id group by all),
m as (select vec_id, label, coalesce(max(d / n) filter (other = label), 0) a, min(d / n) filter (other <> label) b from d group by all) select vec_id, label, round((b - a) / greatest(a, b), 6) silhouette from m""")
def a26_silhouettes(spark, sf_dir):
    s = clusters.silhouettes(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return s.select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query("m04_absorbed", f"""with {CENTROIDS}, n as (select label, count(*) n from u group by all), big as (select cen.* from cen join n using (label) where n >= 52),
s as (select u.vec_id, big.label c, round(list_dot_product(u.v, big.c), 9) sc from u join n using (label), big where n < 52),
moved as (select vec_id, c from s qualify row_number() over (partition by vec_id order by sc desc, c) = 1 union all select u.vec_id, u.label from u join n using (label) where n >= 52 or not exists (select 1 from big)),
k as (select c, (row_number() over (order by c) - 1)::int label from (select distinct c from moved)) select vec_id, label from moved join k using (c)""")
def m04_absorbed(spark, sf_dir):
    return clusters.absorb(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 52)


@query("m02_linkage")
def m02_linkage(spark, sf_dir):
    """Clusters of each group of vectors by calibrated average linkage."""
    e = table(spark, sf_dir, "embeddings").withColumn("rec", (F.col("vec_id") % 8).cast("int"))
    return clusters.cluster_recordings(e, "rec", "vec_id", "embedding")


@query("m08_refined")
def m08_refined(spark, sf_dir):
    """The same with the Markov refinement."""
    e = table(spark, sf_dir, "embeddings").withColumn("rec", (F.col("vec_id") % 8).cast("int"))
    return clusters.cluster_recordings(e, "rec", "vec_id", "embedding", refine=True)


@query("m14_turns_of_windows")
def m14_turns_of_windows(spark, sf_dir):
    """The first pipeline as a whole; vectors stand for windows of 1.5 s every 0.75 s of eight recordings."""
    i = F.floor(F.col("vec_id") / 8).cast("long")
    w = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id") % 8).alias("rec_id"), i.alias("idx"), (i * 0.75).alias("start"), (i * 0.75 + 1.5).alias("end"), F.lit(1.0).alias("speech"), F.lit(1.0).alias("rms"), F.col("embedding").alias("vector"))
    return pipeline.turns_of_windows(w)


@query("m15_turns_of_activities")
def m15_turns_of_activities(spark, sf_dir):
    """The second pipeline as a whole; vectors stand for two local speakers in windows of 16 frames every 8, of whom one speaks before the other."""
    i = F.floor(F.col("vec_id") / 8).cast("long")
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id") % 8).alias("rec_id"), F.floor(i / 2).alias("win"), (i % 2).alias("local"), F.col("embedding").alias("vector"))
    f = v.select("rec_id", "win", "local", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    act = F.lit(0.95) - F.lit(0.07) * F.abs(F.col("pos") - F.when(F.col("local") == 0, 4).otherwise(11))
    f = f.select("*", (F.col("win") * 8 + F.col("pos")).alias("frame"), F.lit(16).alias("len"), act.alias("act"))
    return pipeline.turns_of_activities(f, v, 10.0, refine=True)
