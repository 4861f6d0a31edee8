"""Queries on vectors, perturbation and shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialis.functions.scalars import hashed_sql
from spatialis.operators import jobs as J
from spatialis.operators import normalize as N
from spatialis.operators import perturb as X
from spatialis.operators import tokens as T
from spatialis.operators import transfer as L
from spatialis.operators import vectors as V
from spatialis.plans.matrix import RANKED
from spatialis.plans.registry import query
from spatialis.sources.standins import standin

GV = "gv as (select g.gene_id, g.gene_symbol, v.embedding from genes g join vec v on v.vec_id = g.gene_id % (select count(*) from vec))"
#: Adding 0.0 makes a rounded -0.0 the 0.0 that Spark gives.
ROUND = "list_transform({}, lambda x: round(x, 6) + 0.0)"


def _gene_vec(spark, d):
    vec = standin(spark, d, "vec").select("vec_id", "embedding")
    n = F.broadcast(vec.agg(F.count(F.lit(1)).alias("n")))
    return standin(spark, d, "genes").crossJoin(n).withColumn("vec_id", F.col("gene_id") % F.col("n")).join(vec, "vec_id").select("gene_id", "gene_symbol", "embedding")


def _tokens(spark, d):
    expr = standin(spark, d, "expr")
    return T.token_long(expr, standin(spark, d, "genes"), N.gene_nonzero_mean(expr))


def _rounded(df, c="embedding"):
    return df.withColumn(c, F.transform(c, lambda x: F.round(x, 6)))


@query("J15_token_vectors", f"with {RANKED}, {GV} select t.cell_id, t.pos, round(gv.embedding[1]::double, 6) + 0.0 as first from tok t join gv using (gene_id)", "expr", "genes", "vec")
def j15(spark, d):
    return V.token_vectors(_tokens(spark, d), _gene_vec(spark, d)).select("cell_id", "pos", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def _pool_sql(weight):
    return f"with {RANKED}, {GV}, w as (select t.cell_id, {weight} as w, gv.embedding from tok t join gv using (gene_id)), l as (select cell_id, w, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from w), m as (select cell_id, dim, sum(w * v) / sum(w) as v from l group by 1, 2) select cell_id, list(round(v, 6) + 0.0 order by dim) as embedding from m group by 1"


@query("B1_pool_mean", _pool_sql("1.0::double"), "expr", "genes", "vec")
def b1(spark, d):
    return _rounded(V.pool_mean(_tokens(spark, d), _gene_vec(spark, d)))


@query("B2_pool_weighted", _pool_sql("power(0.998, t.pos)"), "expr", "genes", "vec")
def b2(spark, d):
    return _rounded(V.pool_weighted(T.rank_weights(_tokens(spark, d), "decay"), _gene_vec(spark, d)))


@query("B4_score_tokens", f"with {RANKED} select cell_id, sum(token)::double as score from (select cell_id, gene_id + 20 as token from tok) group by 1", "expr", "genes")
def b4(spark, d):
    rows = T.token_rows(_tokens(spark, d)).select("cell_id", "X")
    return V.score_tokens(rows, lambda b: b.assign(score=b["X"].map(sum).astype(float))[["cell_id", "score"]], "cell_id long, score double")


@query("B5_gene_vector_embed", f"with {GV}, l as (select e.cell_id, ln(1 + e.value) as w, unnest(range(1, 65)) as dim, unnest(gv.embedding)::double as v from expr e join gv using (gene_id)), m as (select cell_id, dim, sum(w * v) as v from l group by 1, 2) select cell_id, list(round(v, 6) + 0.0 order by dim) as embedding from m group by 1", "expr", "genes", "vec")
def b5(spark, d):
    return _rounded(V.gene_vector_embed(standin(spark, d, "expr"), _gene_vec(spark, d).drop("gene_symbol")))


@query("B6_combine_gene_vectors", "select g.gene_id, list_transform(list_zip(a.embedding, b.embedding, c.embedding), lambda p: round(p[1]::double + p[2]::double + p[3]::double, 6) + 0.0) as embedding from genes g join vec a on a.vec_id = g.gene_id % 100 join vec b on b.vec_id = g.homo_connect_id join vec c on c.vec_id = g.gene_type_id", "genes", "vec")
def b6(spark, d):
    genes, vec = standin(spark, d, "genes"), standin(spark, d, "vec").select("vec_id", "embedding")
    gene = genes.select("gene_id", (F.col("gene_id") % 100).alias("vec_id")).join(vec, "vec_id")
    return _rounded(V.combine_gene_vectors(genes, gene, vec.withColumnRenamed("vec_id", "homo_connect_id"), vec.withColumnRenamed("vec_id", "gene_type_id")))


@query("J7_reattach_vectors", f"select c.cell_id, coalesce({ROUND.format('v.embedding::double[]')}, list_transform(range(64), lambda i: 0.0::double)) as embedding from cells c left join (select * from vec where vec_id % 3 = 0) v on v.vec_id = c.cell_id", "cells", "vec")
def j7(spark, d):
    vec = standin(spark, d, "vec").where("vec_id % 3 = 0").select(F.col("vec_id").alias("cell_id"), "embedding")
    return _rounded(V.reattach_vectors(standin(spark, d, "cells").select("cell_id"), vec, 64))


@query("X1_perturb_expr_knockout", "select * from expr where not (gene_id in (50, 100, 150) and cell_id in (select cell_id from cells where slice < 10))", "expr", "cells")
def x1k(spark, d):
    return X.perturb_expr(standin(spark, d, "expr"), [50, 100, 150], "knockout", standin(spark, d, "cells").where("slice < 10"))


@query("X1_perturb_expr_overexpress", "with t as (select cell_id from cells where slice < 10), m as (select gene_id, max(value) * 2 as value from expr where gene_id in (50, 100, 150) group by 1) select * from expr where not (gene_id in (50, 100, 150) and cell_id in (select cell_id from t)) union all select t.cell_id, m.gene_id, m.value from t, m", "expr", "cells")
def x1o(spark, d):
    return X.perturb_expr(standin(spark, d, "expr"), [50, 100, 150], "overexpress", standin(spark, d, "cells").where("slice < 10"))


HIT = "(70, 120, 170)"


@query("X3_delete_tokens", f"""with {RANKED} select cell_id, list(case when gene_id + 20 in {HIT} then 1 else gene_id + 20 end order by pos) as "X" from tok group by 1""", "expr", "genes")
def x3(spark, d):
    return X.delete_tokens(T.token_rows(_tokens(spark, d)), [70, 120, 170]).select("cell_id", "X")


INFO = f"info as (select cell_id, bool_or(gene_id + 20 in {HIT}) as is_perturbed, count(*) filter (gene_id + 20 in {HIT}) as n_perturbed, count(*) as n_expressed from tok where pos >= 2 group by 1)"


@query("X4_perturb_info", f"with {RANKED}, {INFO} select * from info", "expr", "genes")
def x4(spark, d):
    return X.perturb_info(_tokens(spark, d), [70, 120, 170]).drop("ranks")


@query("F15_keep_perturbed", f"with {RANKED}, {INFO} select * from info where is_perturbed", "expr", "genes")
def f15(spark, d):
    return X.keep_perturbed(X.perturb_info(_tokens(spark, d), [70, 120, 170])).drop("ranks")


AFTER = "after as (select vec_id, list_transform(list_zip(embedding, range(64)), lambda p: p[1]::double + (p[2] % 5) / 10.0) as embedding from vec where vec_id % 4 <> 0)"


def _after(spark, d):
    vec = standin(spark, d, "vec").where("vec_id % 4 <> 0")
    return vec.withColumn("embedding", F.transform("embedding", lambda x, i: x.cast("double") + (i % 5) / 10))


SIM = "sim as (select a.vec_id, list_dot_product(v.embedding::double[], a.embedding) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(a.embedding, a.embedding))) as cosine, sqrt(list_sum(list_transform(list_zip(v.embedding, a.embedding), lambda p: (p[1]::double - p[2]) ^ 2))) as l2 from vec v join after a using (vec_id))"


@query("J14_pair_states", "select vec_id from vec where vec_id % 4 <> 0", "vec")
def j14(spark, d):
    return X.pair_states(standin(spark, d, "vec"), _after(spark, d), "vec_id").select("vec_id")


@query("X5_state_similarity", f"with {AFTER}, {SIM} select vec_id, round(cosine, 6) as cosine, round(l2, 6) as l2 from sim", "vec")
def x5(spark, d):
    return X.state_similarity(X.pair_states(standin(spark, d, "vec"), _after(spark, d), "vec_id"), "vec_id").select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("l2", 6).alias("l2"))


def _changes(spark, d):
    sim = X.state_similarity(X.pair_states(standin(spark, d, "vec"), _after(spark, d), "vec_id"), "vec_id")
    return sim.select(F.col("vec_id").alias("gene_id"), (F.col("vec_id") % 20).alias("cell_id"), (1 - F.col("cosine")).alias("change"))


CH = f"{AFTER}, {SIM}, ch as (select vec_id as gene_id, vec_id % 20 as cell_id, 1 - cosine as change from sim)"


def _token_states(spark, d):
    """Vectors of tokens before and after, and which cells are perturbed: cell 3, 6, ... by every third gene."""
    state = lambda df: df.select((F.col("vec_id") % 20).alias("cell_id"), F.floor(F.col("vec_id") / 20).cast("int").alias("pos"), F.col("vec_id").alias("gene_id"), (F.col("vec_id") + T.AUX).alias("token"), "embedding")
    before, after = state(standin(spark, d, "vec")), state(_after(spark, d))
    hit = (F.col("cell_id") % 3 == 0) & (F.col("pos") % 3 == 0)
    info = before.groupBy("cell_id").agg(F.max(hit).alias("is_perturbed"), F.collect_list(F.when(hit, F.col("pos"))).alias("ranks"), F.count(F.lit(1)).alias("n_expressed"))
    return before, after, info


_MEANS = lambda t, name: f"{name} as (select cell_id, list(v order by dim) as c from (select vec_id % 20 as cell_id, dim, avg(v) as v from (select vec_id, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from {t} where vec_id // 20 >= 2) group by 1, 2) group by 1)"


@query("X5_token_similarity", f"with {AFTER}, {SIM}, {_MEANS('vec', 'm1')}, {_MEANS('after', 'm2')}, n as (select vec_id % 20 as cell_id, count(*) as n_expressed from vec group by 1) select s.vec_id % 20 as cell_id, s.vec_id + 20 as token, (s.vec_id // 20 - 2)::int as rank, n_expressed, s.vec_id % 20 % 3 = 0 as is_perturbed, s.vec_id % 20 % 3 = 0 and s.vec_id // 20 % 3 = 0 as is_perturbed_gene, round(s.cosine, 6) as cos_gene, round(s.l2, 6) as l2_gene, round(list_dot_product(m1.c, m2.c) / (sqrt(list_dot_product(m1.c, m1.c)) * sqrt(list_dot_product(m2.c, m2.c))), 6) as cos_cell from sim s join n on n.cell_id = s.vec_id % 20 join m1 on m1.cell_id = n.cell_id join m2 on m2.cell_id = n.cell_id where s.vec_id // 20 >= 2", "vec")
def x5t(spark, d):
    return X.token_similarity(*_token_states(spark, d)).withColumns({c: F.round(c, 6) for c in ("cos_gene", "l2_gene", "cos_cell")})


for _metric, _score, _change in (("cosine", "cosine", "1 - cosine"), ("l2", "l2", "l2")):

    @query(f"X6_gene_impact_{_metric}", f"with {AFTER}, {SIM} select vec_id % 20 as cell_id, round(avg({_score}), 6) as score, list(vec_id order by round({_change}, 9) desc, vec_id)[1:10] as top_genes from sim where vec_id % 20 % 3 = 0 group by 1", "vec")
    def x6(spark, d, metric=_metric):
        return X.gene_impact(*_token_states(spark, d), metric).withColumn("score", F.round("score", 6))

    @query(f"X7_gene_change_matrix_{_metric}", f"with {AFTER}, {SIM}, ch as (select vec_id as gene_id, vec_id % 20 as cell_id, {_change} as change from sim where vec_id % 20 % 3 = 0) select gene_id, cell_id, round(change, 6) as change from ch qualify row_number() over (partition by cell_id order by round(change, 9) desc, gene_id) <= 5", "vec")
    def x7k(spark, d, metric=_metric):
        return X.gene_change_matrix(*_token_states(spark, d), metric, 5).withColumn("change", F.round("change", 6))


@query("X6_gene_impact", f"with {CH} select cell_id, round(avg(1 - change), 6) as mean_cosine, count(*) as n_genes from ch group by 1", "vec")
def x6m(spark, d):
    return _changes(spark, d).groupBy("cell_id").agg(F.round(F.avg(1 - F.col("change")), 6).alias("mean_cosine"), F.count(F.lit(1)).alias("n_genes"))


@query("T2_top_changed_genes", f"with {CH} select cell_id, gene_id from ch qualify row_number() over (partition by cell_id order by round(change, 9) desc, gene_id) <= 3", "vec")
def t2(spark, d):
    return X.top_changed(_changes(spark, d), "cell_id", "gene_id", 3).select("cell_id", "gene_id")


@query("X7_gene_change_matrix", f"with {CH} select gene_id, cell_id, round(change, 6) as change from ch", "vec")
def x7(spark, d):
    return _changes(spark, d).select("gene_id", "cell_id", F.round("change", 6).alias("change"))


@query("A9_top_gene_frequency", f"with {CH}, t as (select cell_id, gene_id % 7 as gene_id from ch qualify row_number() over (partition by cell_id order by round(change, 9) desc, gene_id) <= 3) select gene_id, count(*) as n, round(100.0 * count(*) / (select count(distinct cell_id) from ch), 6) as percent from t group by 1", "vec")
def a9(spark, d):
    top = X.top_changed(_changes(spark, d), "cell_id", "gene_id", 3).withColumn("gene_id", F.col("gene_id") % 7)
    return X.top_gene_frequency(top).withColumn("percent", F.round("percent", 6))


DELTA = "a as (select gene_id, sum(value) / (select count(distinct cell_id) from expr) as before from expr group by 1), b as (select gene_id, sum(value) / (select count(distinct cell_id) from expr) as after from (select gene_id, value * (1 + gene_id % 3) as value from expr where gene_id % 50 <> 0) group by 1), d as (select gene_id, coalesce(before, 0) as before, coalesce(after, 0) as after, coalesce(after, 0) - coalesce(before, 0) as delta, abs(coalesce(after, 0) - coalesce(before, 0)) as abs_delta from a full join b using (gene_id))"


def _delta(spark, d):
    expr = standin(spark, d, "expr")
    return X.gene_delta(expr, expr.where("gene_id % 50 <> 0").withColumn("value", F.col("value") * (1 + F.col("gene_id") % 3)))


@query("A10_gene_delta", f"with {DELTA} select gene_id, round(before, 6) as before, round(after, 6) as after, round(delta, 6) + 0.0 as delta, round(abs_delta, 6) as abs_delta from d", "expr")
def a10(spark, d):
    return _delta(spark, d).select("gene_id", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta", "abs_delta")])


@query("T4_top_delta_genes", f"with {DELTA} select gene_id from d order by round(abs_delta, 9) desc, gene_id limit 25", "expr")
def t4(spark, d):
    return X.top_delta_genes(_delta(spark, d), 25).select("gene_id")


@query("X15_recon_change", f"with {DELTA} select gene_id, round(delta, 6) + 0.0 as delta from d order by round(delta, 9) desc, gene_id limit 10", "expr")
def x15(spark, d):
    return X.top_delta_genes(_delta(spark, d), 10, "delta").select("gene_id", F.round("delta", 6).alias("delta"))


COND = f"{GV}, sy as (select gene_symbol, min_by(embedding, gene_id) as e from gv group by 1), cond as (select gene_id, gene_symbol || ' + nosuch' as condition from genes where gene_id % 40 = 1 union all select gene_id, 'ctrl' from genes where gene_id % 40 = 2)"


@query("X16_condition_vectors", f"with {COND}, one as (select distinct condition from cond) select o.condition, case when o.condition = 'ctrl' then list_transform(range(64), lambda i: 0.0::double) else list_transform(sy.e, lambda x: round(x::double / 2, 6) + 0.0) end as vector from one o left join sy on o.condition = sy.gene_symbol || ' + nosuch'", "genes", "vec")
def x16(spark, d):
    genes = standin(spark, d, "genes")
    cond = genes.where("gene_id % 40 = 1").select(F.concat("gene_symbol", F.lit(" + nosuch")).alias("condition")).union(genes.where("gene_id % 40 = 2").select(F.lit("ctrl")))
    return _rounded(X.condition_vectors(cond, _gene_vec(spark, d), 64), "vector")


@query("X17_perturb_covariates", "select cell_id, case when cell_id % 3 = 0 then cell_id % 50 end as perturb_gene_id, (cell_id % 3 = 0)::int as perturb_flag from cells", "cells")
def x17(spark, d):
    cells = standin(spark, d, "cells").select("cell_id")
    return X.perturb_covariates(cells, cells.where("cell_id % 3 = 0").withColumn("perturb_gene_id", F.col("cell_id") % 50))


@query("X17_n_conditions", "select count(distinct cell_id % 50) as n_conditions from cells where cell_id % 3 = 0", "cells")
def x17n(spark, d):
    return X.n_conditions(x17(spark, d))


_R = lambda salt, key="cell_id": hashed_sql(key, salt=salt)
PLAIN = "select cell_id::varchar as cell_name, cell_type, x, y, false as injected from cells where slice = 1"


@query("X9_inject_random", f"with p as (select cell_id, cell_type, row_number() over (order by {_R('inject-order')}, cell_id) - 1 as k from cells where slice = 2), m as (select count(*) as m from p), box as (select min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy from cells where slice = 1), dr as (select i, floor({_R('inject-donor', 'i')} * m) as k from range(40) t(i), m) select p.cell_id || '_inj' || i as cell_name, cell_type, round(lox + {_R('inject-x', 'i')} * (hix - lox), 6) as x, round(loy + {_R('inject-y', 'i')} * (hiy - loy), 6) as y, true as injected from dr join p using (k), box union all {PLAIN}", "cells")
def x9(spark, d):
    cells = standin(spark, d, "cells")
    return X.inject_random(cells.where("slice = 1"), cells.where("slice = 2"), 40).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("X10_inject_replace", f"with p as (select cell_id as donor_id, row_number() over (order by {_R('replace-order')}, cell_id) - 1 as k from cells where slice = 2 and cell_type = 'BUILDING'), m as (select count(*) as m from p) select c.cell_id, c.x, c.y, p.donor_id from (select *, floor({_R('replace')} * (select m from m)) as k from cells where slice = 1 and cell_type = 'BUILDING') c join p using (k) union all select cell_id, x, y, null from cells where slice = 1 and cell_type <> 'BUILDING'", "cells")
def x10(spark, d):
    cells = standin(spark, d, "cells")
    return X.inject_replace(cells.where("slice = 1"), "BUILDING", cells.where("slice = 2"))


YC = "yc as (select list(v order by dim) as c from (select dim, avg(v) as v from (select unnest(range(1, 65)) as dim, unnest(embedding)::double as v from vec where slice = 'young') group by 1))"
CC = "list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)))"
DD = "sqrt(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) ^ 2)))"


def _center(spark, d, age="young"):
    return L.centroids(standin(spark, d, "vec").where(F.col("slice") == age), ["slice"]).select("centroid")


@query("X11_shift_to_reference", f"with {AFTER}, {YC}, b as (select embedding::double[] as e, c from vec, yc where slice = 'old'), a as (select embedding as e, c from after, yc) select (select round(avg({CC}), 6) from b) as cos_before, (select round(avg({DD}), 6) from b) as dist_before, (select round(avg({CC}), 6) from a) as cos_after, (select round(avg({DD}), 6) from a) as dist_after", "vec")
def x11(spark, d):
    out = X.shift_to_reference(standin(spark, d, "vec").where("slice = 'old'"), _after(spark, d), _center(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("X11_shift_to_young")
def x11y(spark, d):
    return J.shift_to_young(standin(spark, d, "vec"), _after(spark, d), "young", "old", 3, niche=True)


@query("E9_to_centroid", f"with {YC}, b as (select embedding::double[] as e, c from vec, yc) select round(avg({CC}), 6) as cos, round(avg({DD}), 6) as dist from b", "vec")
def e9(spark, d):
    vec = standin(spark, d, "vec")
    out = X.shift_to_reference(vec, vec, _center(spark, d))
    return out.select(F.round("cos_before", 6).alias("cos"), F.round("dist_before", 6).alias("dist"))


def _unit_center(spark, d, age):
    return X.unit_centroid(standin(spark, d, "vec").where(F.col("slice") == age))


#: The mean of unit vectors; its own length doesn't matter to a cosine.
_UC = lambda name, column, age: f"{name} as (select list(v order by dim) as {column} from (select dim, avg(v) as v from (select unnest(range(1, 65)) as dim, unnest(list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))) as v from vec where slice = '{age}') group by 1))"
UYC = _UC("yc", "c", "young")


@query("X13_delta_cosine", f"with {UYC}, s as (select vec_id, label, slice, {CC} as k from (select *, embedding::double[] as e from vec), yc), b as (select label, avg(k) as base from s where slice = 'old' group by 1) select vec_id, round(k - base, 6) + 0.0 as delta from s join b using (label)", "vec")
def x13(spark, d):
    vec = standin(spark, d, "vec")
    return X.delta_cosine(vec, _unit_center(spark, d, "young"), vec.where("slice = 'old'"), "label").select("vec_id", F.round("delta", 6).alias("delta"))


@query("X14_centroid_coords", f"with {UYC}, {_UC('oc', 'oc', 'old')} select vec_id, round({CC}, 6) + 0.0 as cos_young, round(list_dot_product(e, oc) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(oc, oc))), 6) + 0.0 as cos_old from (select vec_id, embedding::double[] as e from vec), yc, oc", "vec")
def x14(spark, d):
    out = X.centroid_coords(standin(spark, d, "vec"), _unit_center(spark, d, "young"), _unit_center(spark, d, "old"))
    return out.select("vec_id", F.round("cos_young", 6).alias("cos_young"), F.round("cos_old", 6).alias("cos_old"))


@query("X14_centroid_coords_by_type", f"with {UYC}, {_UC('oc', 'oc', 'old')} select label, round(avg({CC}), 6) + 0.0 as cos_young, round(avg(list_dot_product(e, oc) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(oc, oc)))), 6) + 0.0 as cos_old from (select vec_id, label, embedding::double[] as e from vec), yc, oc group by label", "vec")
def x14type(spark, d):
    out = X.centroid_coords(standin(spark, d, "vec"), _unit_center(spark, d, "young"), _unit_center(spark, d, "old"), "label")
    return out.select("label", F.round("cos_young", 6).alias("cos_young"), F.round("cos_old", 6).alias("cos_old"))
