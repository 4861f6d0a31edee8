"""Queries on label transfer, markers, evaluation and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialis.operators import genes as G
from spatialis.operators import metrics as E
from spatialis.operators import sampling as M
from spatialis.operators import transfer as L
from spatialis.plans.registry import query
from spatialis.sources.staging import staged
from spatialis.sources.standins import standin

DIST = "sqrt(list_sum(list_transform(list_zip(r.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"
COS = "list_dot_product(r.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(r.embedding::double[], r.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"
NEAR = f"near as (select q.vec_id as query_id, r.vec_id, r.label, round({DIST}, 9) as dist, (row_number() over (partition by q.vec_id order by round({DIST}, 9), r.vec_id))::int as rank from vec q join vec r on q.role = 'query' and r.role = 'ref' qualify rank <= 10)"
VOTE = "vote as (select query_id, label, round(sum(case when z then (dist = 0)::int::double else 1 / dist end), 9) as w from (select *, bool_or(dist = 0) over (partition by query_id) as z from near) group by 1, 2), pred as (select query_id, label as pred from vote qualify row_number() over (partition by query_id order by w desc, label) = 1)"
CENTER = "dims as (select label, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from vec where role = 'ref'), center as (select label, list(v order by dim) as centroid from (select label, dim, avg(v) as v from dims group by 1, 2) group by 1)"


def _parts(spark, d):
    vec = standin(spark, d, "vec")
    return vec.where("role = 'ref'"), vec.where("role = 'query'")


def _near(spark, d, metric="euclidean"):
    return L.top_neighbours(*_parts(spark, d), 10, metric)


@query("A5_centroids", f"with {CENTER} select label, list_transform(centroid, lambda x: round(x, 6) + 0.0) as centroid from center", "vec")
def a5(spark, d):
    return L.centroids(_parts(spark, d)[0], ["label"]).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query("J13_top_neighbours", f"with {NEAR} select query_id, vec_id, label, rank, round(dist, 6) as dist from near", "vec")
def j13(spark, d):
    return _near(spark, d).withColumn("dist", F.round("dist", 6))


@query("L3_knn_vote", f"with {NEAR}, {VOTE} select query_id, pred from pred", "vec")
def l3(spark, d):
    return L.knn_vote(_near(spark, d))


UNASSIGNED = f"{NEAR}, {VOTE}, e as (select min(dist) as lo, max(dist) as hi from near), m as (select query_id, sum(1 / (dist + 1e-8) * (1 - (dist - lo) / (hi - lo + 1e-8))) / sum(1 / (dist + 1e-8)) as sim from near, e where rank <= 3 group by 1), said as (select query_id, case when round(sim, 9) < 0.4 then 'unassigned' else pred::varchar end as pred from pred join m using (query_id))"


@query("L4_knn_unassigned", f"with {UNASSIGNED} select query_id, pred from said", "vec")
def l4(spark, d):
    near = staged(_near(spark, d), "near")
    return L.knn_unassigned(near, L.knn_vote(near), 10, 0.4)


@query("L5_ann_vote")
def l5(spark, d):
    return L.ann_vote(*_parts(spark, d), 10)


CPRED = f"{CENTER}, cpred as (select q.vec_id as query_id, q.label as truth, c.label as pred from vec q, (select label, centroid as embedding from center) c where q.role = 'query' qualify row_number() over (partition by q.vec_id order by round(list_sum(list_transform(list_zip(c.embedding, q.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), c.label) = 1)"


@query("L6_nearest_centroid", f"with {CPRED} select query_id, pred from cpred", "vec")
def l6(spark, d):
    ref, asked = _parts(spark, d)
    return L.nearest_centroid(L.centroids(ref, ["label"]), asked)


@query("L7_logreg")
def l7(spark, d):
    return L.logreg(*_parts(spark, d), max_iter=20)


@query("L8_label_transfer_native", f"with {NEAR.replace('rank <= 10', 'rank <= 30')}, {VOTE} select query_id, pred from pred", "vec")
def l8native(spark, d):
    return L.label_transfer(*_parts(spark, d), method="native")


@query("L8_label_transfer_flat", f"with {NEAR.replace('rank <= 10', 'rank <= 30')} select query_id, label as pred from (select query_id, label, count(*) as w from near group by 1, 2) qualify row_number() over (partition by query_id order by w desc, label) = 1", "vec")
def l8flat(spark, d):
    return L.label_transfer(*_parts(spark, d), method="flat")


@query("L8_label_transfer", f"with {CPRED} select query_id, pred from cpred", "vec")
def l8(spark, d):
    return L.label_transfer(*_parts(spark, d), method="prototype")


@query("L2_scale_pca")
def l2(spark, d):
    return L.scale_pca(standin(spark, d, "vec"), 8)


@query("L10_marker_dict", "select class, gene_id, rank::int as rank from (select *, row_number() over (partition by class order by round(weight, 9) desc, gene_id) as rank from markers where weight > 2.5) where rank <= 10", "markers")
def l10(spark, d):
    return L.marker_dict(standin(spark, d, "markers"), 2.5, 10).select("class", "gene_id", "rank")


@query("T3_top_markers", "select class, gene_id from markers qualify row_number() over (partition by class order by round(weight, 9) desc, gene_id) <= 5", "markers")
def t3(spark, d):
    return L.marker_dict(standin(spark, d, "markers"), float("-inf"), 5).select("class", "gene_id")


SCORE = "there as (select * from markers where gene_id in (select gene_id from expr)), tot as (select class, sum(weight) as total from there group by 1), lib as (select cell_id, sum(value) as lib from expr group by 1), ms as (select e.cell_id, t.class, sum(t.weight * ln(1 + e.value * 1e4 / lib.lib)) / (tot.total + 1e-8) as score from expr e join there t using (gene_id) join lib using (cell_id) join tot using (class) group by e.cell_id, t.class, tot.total)"


@query("L11_marker_score", f"with {SCORE} select cell_id, class, round(score, 6) as score from ms", "expr", "markers")
def l11(spark, d):
    return L.marker_score(standin(spark, d, "expr"), standin(spark, d, "markers")).withColumn("score", F.round("score", 6))


@query("A11_marker_stats", "select min(n) as least, max(n) as most, avg(n) as mean from (select class, count(*) as n from markers where weight > 2.6 group by 1)", "markers")
def a11(spark, d):
    n = standin(spark, d, "markers").where("weight > 2.6").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def _scored(spark, d):
    score = L.marker_score(standin(spark, d, "expr"), standin(spark, d, "markers")).where("class = 'BUILDING'").select("cell_id", F.round("score", 6).alias("score"))
    return standin(spark, d, "cells").join(score, "cell_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


POOL = f"{SCORE}, sc as (select c.cell_id, c.cell_type, coalesce(round(ms.score, 6), 0) as score from cells c left join (select * from ms where class = 'BUILDING') ms using (cell_id)), pool as (select * from sc qualify row_number() over (partition by cell_type order by score desc, cell_id) <= 30)"


@query("T5_marker_pool", f"with {POOL} select cell_id, cell_type from pool", "expr", "markers", "cells")
def t5(spark, d):
    return M.subsample_marker(_scored(spark, d), "cell_type", "score", 30, 1).select("cell_id", "cell_type")


@query("M5_subsample_marker", f"with {POOL} select cell_id, cell_type from pool qualify row_number() over (partition by cell_type order by ('0x' || substr(md5(concat_ws('|', 'subsample', cast(cell_id as varchar))), 1, 8))::bigint, cell_id) <= 10", "expr", "markers", "cells")
def m5(spark, d):
    return M.subsample_marker(_scored(spark, d), "cell_type", "score", 10, 3).select("cell_id", "cell_type")


@query("A15_dotplot_table", "select c.cell_type, e.gene_id, round(sum(e.value) / n.n, 6) as mean_expr, round(count(*) / n.n, 6) as fraction from expr e join cells c using (cell_id) join (select cell_type, count(*)::double as n from cells group by 1) n using (cell_type) where e.gene_id in (select gene_id from markers) group by c.cell_type, e.gene_id, n.n", "expr", "cells", "markers")
def a15(spark, d):
    cells = standin(spark, d, "cells")
    n = cells.groupBy("cell_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = standin(spark, d, "expr").join(standin(spark, d, "markers"), "gene_id", "left_semi").join(cells.select("cell_id", "cell_type"), "cell_id")
    return own.groupBy("cell_type", "gene_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k")).join(n, "cell_type").select("cell_type", "gene_id", F.round(F.col("s") / F.col("n"), 6).alias("mean_expr"), F.round(F.col("k") / F.col("n"), 6).alias("fraction"))


@query("L15_decode_argmax", "select vec_id, list_position(e, list_max(e))::int - 1 as code, 'c' || (list_position(e, list_max(e)) - 1) as label from (select vec_id, embedding[1:10] as e from vec)", "vec")
def l15(spark, d):
    codes = spark.range(10).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"))
    return L.decode_argmax(standin(spark, d, "vec").select("vec_id", F.slice("embedding", 1, 10).alias("logits")), codes).select("vec_id", "code", "label")


def _pred(spark, d):
    ref, asked = _parts(spark, d)
    return L.nearest_centroid(L.centroids(ref, ["label"]), asked).join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth")), "query_id")


@query("A6_confusion", f"with {CPRED} select truth, pred, count(*) as n, round(count(*) / sum(count(*)) over (partition by truth), 6) as share from cpred group by truth, pred", "vec")
def a6(spark, d):
    return E.confusion(_pred(spark, d)).withColumn("share", F.round("share", 6))


@query("A7_layer_distribution", "with n as (select region, cell_type, count(*) as n from cells group by 1, 2), p as (select *, n / sum(n) over (partition by region) as p from n) select region, cell_type, round(p / sum(p) over (partition by cell_type), 6) as p from p", "cells")
def a7(spark, d):
    return E.layer_distribution(standin(spark, d, "cells"), "region", "cell_type").withColumn("p", F.round("p", 6))


@query("A8_label_proportions", f"with {CPRED}, a as (select truth as label, count(*) as a from cpred group by 1), b as (select pred as label, count(*) as b from cpred group by 1) select coalesce(a.label, b.label) as label, round(coalesce(a, 0) / (select count(*) from cpred), 6) as true_share, round(coalesce(b, 0) / (select count(*) from cpred), 6) as pred_share from a full join b on a.label = b.label", "vec")
def a8(spark, d):
    return E.label_proportions(_pred(spark, d)).withColumns({c: F.round(c, 6) for c in ("true_share", "pred_share")})


REP = f"{CPRED}, lab as (select truth as label from cpred union select pred from cpred), rep0 as (select label, (select count(*) from cpred where pred = label and truth = label)::double as tp, (select count(*) from cpred where pred = label)::double as said, (select count(*) from cpred where truth = label)::double as support from lab), rep1 as (select *, case when said = 0 then 0 else tp / said end as p, case when support = 0 then 0 else tp / support end as r from rep0), rep as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f from rep1)"


@query("E3_class_report", f"with {REP} select label, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, support::bigint as support from rep", "vec")
def e3(spark, d):
    return E.class_report(_pred(spark, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("E1_class_metrics", f"with {REP} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(f), 6) as f1, round(avg(p), 6) as precision, round(avg(r), 6) as recall from rep", "vec")
def e1(spark, d):
    return E.class_metrics(_pred(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision", "recall")])


@query("E2_weighted_metrics", f"with {REP} select round(sum(tp) / sum(support), 6) as accuracy, round(sum(f * support) / sum(support), 6) as weighted_f1 from rep", "vec")
def e2(spark, d):
    return E.class_metrics(_pred(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"))


@query("E4_ari", f"with {CPRED}, n as (select truth, pred, count(*)::double as n from cpred group by 1, 2), s as (select (select sum(n * (n - 1) / 2) from n) as ij, (select sum(m * (m - 1) / 2) from (select sum(n) as m from n group by truth)) as i, (select sum(m * (m - 1) / 2) from (select sum(n) as m from n group by pred)) as j, (select sum(n) from n) as t) select round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) as ari from s", "vec")
def e4(spark, d):
    return E.ari(_pred(spark, d), "truth", "pred").withColumn("ari", F.round("ari", 6))


@query("E5_nmi", f"with {CPRED}, n as (select truth, pred, count(*)::double as n from cpred group by 1, 2), t as (select sum(n) as t from n), a as (select truth, sum(n) as na from n group by 1), b as (select pred, sum(n) as nb from n group by 1), mi as (select sum(n / t * ln(n * t / (na * nb))) as mi from n join a using (truth) join b using (pred), t), ha as (select -sum(na / t * ln(na / t)) as h from a, t), hb as (select -sum(nb / t * ln(nb / t)) as h from b, t) select round(2 * mi / (ha.h + hb.h), 6) as nmi from mi, ha, hb", "vec")
def e5(spark, d):
    return E.nmi(_pred(spark, d), "truth", "pred").withColumn("nmi", F.round("nmi", 6))


@query("A12_unassigned_ratio", f"with {UNASSIGNED} select round(100 * avg((pred = 'unassigned')::int), 6) as ratio from said", "vec")
def a12(spark, d):
    return E.unassigned_ratio(l4(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("A16_mean_metrics", "select metric, round(avg(value), 6) as value from (select 'x' as metric, avg(x) as value from cells group by slice union all select 'y', avg(y) from cells group by slice) group by metric", "cells")
def a16(spark, d):
    by = standin(spark, d, "cells").groupBy("slice").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return by.unpivot(["slice"], ["x", "y"], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))


PAIR = "pr as (select cell_id, gene_id, value * 0.9 - 2 as value from expr where gene_id % 7 <> 0)"


def _predicted(spark, d):
    expr = standin(spark, d, "expr")
    return expr.where("gene_id % 7 <> 0").withColumn("value", F.col("value") * 0.9 - 2), expr


def _eval_sql(by, other, relu):
    p = "greatest(coalesce(p.value, 0), 0)" if relu else "coalesce(p.value, 0)"
    return f"""with {PAIR}, s as (select coalesce(p.{by}, e.{by}) as k, sum({p}) as sp, sum(coalesce(e.value, 0)) as st, sum({p} * {p}) as spp, sum(coalesce(e.value, 0) ^ 2) as stt, sum({p} * coalesce(e.value, 0)) as spt, sum(({p} - coalesce(e.value, 0)) ^ 2) as se, sum(abs({p} - coalesce(e.value, 0))) as ae, (select count(distinct {other}) from expr) as n from pr p full join expr e on p.cell_id = e.cell_id and p.gene_id = e.gene_id group by 1),
v as (select *, n * spp - sp * sp as vp, n * stt - st * st as vt from s)"""


@query("E8_impute_eval", _eval_sql("gene_id", "cell_id", True) + " select round(avg(se / n), 6) as mse, round(avg(sqrt(se / n)), 6) as rmse, round(avg(ae / n), 6) as mae, round(avg(case when vp > 1e-9 and vt > 1e-9 then (n * spt - sp * st) / sqrt(vp * vt) else 0 end), 6) as corr, round(avg(case when spp > 0 and stt > 0 then spt / sqrt(spp * stt) else 0 end), 6) as cosine from v", "expr")
def e8(spark, d):
    return E.impute_eval(*_predicted(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "corr", "cosine")])


@query("E6_pearson_rows", _eval_sql("cell_id", "gene_id", False) + " select round(avg(case when vp > 1e-9 and vt > 1e-9 then (n * spt - sp * st) / sqrt(vp * vt) else 0 end), 6) as pearson from v", "expr")
def e6(spark, d):
    return E.pearson_rows(*_predicted(spark, d)).withColumn("pearson", F.round("pearson", 6))


@query("E7_denoise_eval", f"with {PAIR}, j as (select p.value as p, e.value as t from pr p join expr e using (cell_id, gene_id)) select round(avg((p - t) ^ 2), 6) as mse, round(sqrt(avg((p - t) ^ 2)), 6) as rmse, round(avg(abs(p - t)), 6) as mae, round(corr(p, t), 6) as corr, round(sum(p * t) / sqrt(sum(p * p) * sum(t * t)), 6) as cosine from j", "expr")
def e7(spark, d):
    p, t = _predicted(spark, d)
    pairs = p.withColumnRenamed("value", "pred").join(t.withColumnRenamed("value", "true"), ["cell_id", "gene_id"])
    return E.denoise_eval(pairs).select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae", "corr", "cosine")])


def _ages(spark, d):
    vec = standin(spark, d, "vec")
    return vec.where("slice = 'young'"), vec.where("slice = 'old'")


@query("E10_emd_per_dim", "with l as (select slice, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from vec), n as (select count(*) filter (slice = 'young') as na, count(*) filter (slice = 'old') as nb from vec), s as (select dim, v, count(*) filter (slice = 'young') as ka, count(*) filter (slice = 'old') as kb from l group by 1, 2), g as (select dim, abs(sum(ka / na - kb / nb) over w) * (lead(v) over w - v) as d from s, n window w as (partition by dim order by v)) select round(avg(d), 6) as emd from (select dim, sum(d) as d from g group by 1)", "vec")
def e10(spark, d):
    return E.emd_per_dim(*_ages(spark, d)).withColumn("emd", F.round("emd", 6))


@query("E11_mmd_rbf", f"with k as (select r.slice as a, q.slice as b, avg(exp(-1.0 * {DIST} * {DIST})) as k from vec r, vec q group by 1, 2) select round((select k from k where a = 'young' and b = 'young') + (select k from k where a = 'old' and b = 'old') - 2 * (select k from k where a = 'young' and b = 'old'), 6) as mmd", "vec")
def e11(spark, d):
    return E.mmd_rbf(*_ages(spark, d)).withColumn("mmd", F.round("mmd", 6))


@query("E12_coral", "with c as (select slice, i, j, covar_samp(embedding[i]::double, embedding[j]::double) as c from vec, range(1, 65) a(i), range(1, 65) b(j) group by 1, 2, 3) select round(avg((a.c - b.c) * (a.c - b.c)), 6) as coral from c a join c b on a.slice = 'young' and b.slice = 'old' and a.i = b.i and a.j = b.j", "vec")
def e12(spark, d):
    return E.coral(*_ages(spark, d)).withColumn("coral", F.round("coral", 6))


@query("W6_codes_inverse", "select cell_id, cell_type from cells", "cells")
def w6i(spark, d):
    cells = standin(spark, d, "cells")
    codes = G.label_codes(cells, "cell_type")
    return G.label_encode(cells, "cell_type", codes).select("cell_id", "code").join(F.broadcast(codes), "code").select("cell_id", "cell_type")
