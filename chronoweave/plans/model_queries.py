"""Queries on masked sequences, predictions, attribution, folds and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion
from ..operators import attribution as at
from ..operators import audit, joins, kernel, metrics, pooling, probe
from .interval_queries import r6
from .registry import query
from .views import view

V = ["vec_id"]
MODELS = tuple(at.COEFFICIENTS)


def logit_sql(c, t="t", a="a", v="v"):
    return f"({c[0]} + {c[1]} * {t} + {c[2]} * {a} + {c[3]} * {v} + {c[4]} * {t} * {a})"


def reg_sql(t="t", a="a", v="v"):
    return f"tanh(0.5 * {t} - 0.25 * {a} + 0.4 * {v} + 0.3 * {t} * {a})"


def mean_sql(m, on=None):
    on = on or f"m{m}"
    return f"coalesce(sum(CASE WHEN {on} THEN {m} END) / nullif(count(*) FILTER (WHERE {on}), 0), 0.0)"


def argmax_sql(*xs):
    g = f"greatest({', '.join(xs)})"
    return "CASE " + " ".join(f"WHEN {x} = {g} THEN {i}" for i, x in enumerate(xs)) + " END"


MEANS = "mean_v AS (SELECT vec_id, any_value(class_id) AS class_id, any_value(reg) AS r, " + ", ".join(f"{mean_sql(m)} AS {m}" for m in "tav") + " FROM seq_v GROUP BY vec_id)"
PRED = MEANS + ", pred_v AS (" + " UNION ALL ".join(
    f"SELECT vec_id, class_id, r, '{name}' AS model, " + ", ".join(f"{logit_sql(c)} AS logit{i}" for i, c in enumerate(at.COEFFICIENTS[name])) + f", {reg_sql()} AS pred FROM mean_v" for name in MODELS
) + f"), told_v AS (SELECT *, {argmax_sql('logit0', 'logit1', 'logit2')} AS p FROM pred_v)"


def f1_sql(src: str, by: str, labels: str | None = None) -> str:
    """CTEs ``per`` and ``score`` with accuracy and macro F1 of (by, y, p)."""
    cls = f"(SELECT unnest([{labels}]) AS c)" if labels else None
    pairs = f"SELECT DISTINCT s.{by}, k.c FROM {src} s, {cls} k" if labels else f"SELECT DISTINCT {by}, c FROM (SELECT {by}, y AS c FROM {src} UNION SELECT {by}, p FROM {src})"
    return f"""per AS (SELECT k.{by}, k.c, CASE WHEN sum(CASE WHEN y = c THEN 1 ELSE 0 END) + sum(CASE WHEN p = c THEN 1 ELSE 0 END) > 0
      THEN 2.0 * sum(CASE WHEN y = c AND p = c THEN 1 ELSE 0 END) / (sum(CASE WHEN y = c THEN 1 ELSE 0 END) + sum(CASE WHEN p = c THEN 1 ELSE 0 END)) ELSE 0.0 END AS f1
      FROM ({pairs}) k JOIN {src} s ON s.{by} = k.{by} GROUP BY k.{by}, k.c),
    score AS (SELECT s.{by}, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy, (SELECT avg(f1) FROM per WHERE per.{by} = s.{by}) AS macro_f1, count(*) AS n FROM {src} s GROUP BY s.{by})"""


def seq(spark, d):
    return view(spark, d, "seq_v")


def preds(spark, d, models=MODELS):
    s = seq(spark, d).withColumnRenamed("reg", "r")
    parts = [at.score_sequences(s, V, at.linear_scorer(m), carry=("class_id", "r")).withColumn("model", F.lit(m)) for m in models]
    return told(metrics.union_all(parts))


def told(scored):
    """Scored rows with each logit, the class told, and the names that metrics read."""
    out = scored.select("*", *(F.get("logits", F.lit(i)).alias(f"logit{i}") for i in range(3))).withColumn("p", at.argmax(F.col("logits"))).drop("logits")
    return out.withColumn("y", F.col("class_id")).withColumn("pred", F.col("reg"))


@query("p10_derive_masks", """x AS (SELECT vec_id, pos, CAST((vec_id * 13 + pos * 7) % 120 AS INT) AS id, CASE WHEN pos < 14 THEN 1 ELSE 0 END AS attn, CASE WHEN ma THEN a ELSE 0 END AS a, CASE WHEN mv THEN v ELSE 0 END AS v FROM seq_v),
    y AS (SELECT *, attn > 0 AND id NOT IN (0, 101, 102) AS text FROM x), z AS (SELECT *, text OR a <> 0 OR v <> 0 AS valid FROM y) SELECT vec_id, pos, text, valid, a <> 0 AND valid AS audio, v <> 0 AND valid AS vision FROM z""")
def p10(spark, d):
    x = seq(spark, d).select("vec_id", "pos", ((F.col("vec_id") * 13 + F.col("pos") * 7) % 120).cast("int").alias("id"), F.when(F.col("pos") < 14, 1).otherwise(0).alias("attn"), F.when(F.col("ma"), F.col("a")).otherwise(0.0).alias("a"), F.when(F.col("mv"), F.col("v")).otherwise(0.0).alias("v"))
    masks = pooling.derive_masks(F.col("id"), F.col("attn"), F.array("a"), F.array("v"))
    return x.select("vec_id", "pos", *(c.alias(k) for k, c in masks.items()))


@query("a5_moments", "m AS (SELECT vec_id, coalesce(sum(CASE WHEN ma THEN a END), 0.0) / greatest(count_if(ma), 1) AS mean, count_if(ma) / count(*) AS present FROM seq_v GROUP BY vec_id) SELECT s.vec_id, round(any_value(mean), 6) AS mean, round(sqrt(coalesce(sum(CASE WHEN ma THEN (a - mean) * (a - mean) END), 0.0) / greatest(count_if(ma), 1) + 1e-8), 6) AS std, round(any_value(present), 6) AS present FROM seq_v s JOIN m ON s.vec_id = m.vec_id GROUP BY s.vec_id")
def a5(spark, d):
    out = pooling.moments(seq(spark, d), V, "a", "ma")
    return out.select("vec_id", r6("mean").alias("mean"), r6("std").alias("std"), r6("present").alias("present"))


@query("a6_standardise", "st AS (SELECT avg(a) AS mu, greatest(stddev_pop(a), 1e-5) AS sd FROM seq_v WHERE ma AND vec_id % 5 <> 0) SELECT vec_id, pos, CASE WHEN ma THEN round(greatest(-8, least(8, (a - mu) / sd)), 6) ELSE 0.0 END AS z FROM seq_v, st")
def a6(spark, d):
    stats = pooling.fit_observed_stats(seq(spark, d), F.col("vec_id") % 5 != 0, "a", "ma")
    return pooling.standardise(seq(spark, d), stats, "a", "ma").select("vec_id", "pos", r6("z").alias("z"))


#: Features of two dimensions for audio, and of one more for the others.
def vectors(spark, d):
    s = seq(spark, d)
    return s.withColumns({"t": F.array("t", F.col("t") - F.col("a")), "a": F.array(F.col("a"), 2 * F.col("v")), "v": F.array("v", "t", "a")})


@query("a5_vector_moments", "m AS (SELECT vec_id, coalesce(sum(CASE WHEN ma THEN 2 * v END), 0.0) / greatest(count_if(ma), 1) AS mean FROM seq_v GROUP BY vec_id) SELECT s.vec_id, round(any_value(mean), 6) AS mean, round(sqrt(coalesce(sum(CASE WHEN ma THEN (2 * v - mean) * (2 * v - mean) END), 0.0) / greatest(count_if(ma), 1) + 1e-8), 6) AS std, 2 AS d FROM seq_v s JOIN m ON s.vec_id = m.vec_id GROUP BY s.vec_id")
def a5v(spark, d):
    out = pooling.moments(vectors(spark, d), V, "a", "ma")
    return out.select("vec_id", r6(F.get("mean", F.lit(1))).alias("mean"), r6(F.get("std", F.lit(1))).alias("std"), F.size("mean").alias("d"))


@query("a6_vector_standardise", "st AS (SELECT avg(2 * v) AS mu, greatest(stddev_pop(2 * v), 1e-5) AS sd FROM seq_v WHERE ma AND vec_id % 5 <> 0) SELECT vec_id, pos, CASE WHEN ma THEN round(greatest(-8, least(8, (2 * v - mu) / sd)), 6) ELSE 0.0 END AS z FROM seq_v, st")
def a6v(spark, d):
    x = vectors(spark, d)
    stats = pooling.fit_observed_stats(x, F.col("vec_id") % 5 != 0, "a", "ma")
    return pooling.standardise(x, stats, "a", "ma").select("vec_id", "pos", r6(F.get("z", F.lit(1))).alias("z"))


@query("a12_classification", PRED + ", src AS (SELECT model, class_id AS y, p FROM told_v), " + f1_sql("src", "model", "0, 1, 2") + " SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n FROM score")
def a12(spark, d):
    out = metrics.classification_metrics(preds(spark, d), ["model"], [0, 1, 2])
    return out.select("model", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), "n")


@query("a12_labels_present", PRED + ", src AS (SELECT model, CASE WHEN class_id = 2 THEN 0 ELSE class_id END AS y, CASE WHEN p = 2 THEN 0 ELSE p END AS p FROM told_v), " + f1_sql("src", "model") + " SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n FROM score")
def a12b(spark, d):
    x = preds(spark, d).withColumn("y", F.when(F.col("y") == 2, 0).otherwise(F.col("y"))).withColumn("p", F.when(F.col("p") == 2, 0).otherwise(F.col("p")))
    out = metrics.classification_metrics(x, ["model"])
    return out.select("model", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), "n")


@query("a12_confusion", PRED + " SELECT model, class_id AS y, p, count(*) AS n FROM told_v GROUP BY ALL")
def a12c(spark, d):
    return metrics.confusion(preds(spark, d), ["model"])


@query("a13_regression", PRED + " SELECT model, round(avg(abs(pred - r)), 6) AS mae, round(CASE WHEN stddev_pop(r) <= 1e-8 OR stddev_pop(pred) <= 1e-8 THEN 0.0 ELSE covar_pop(r, pred) / (stddev_pop(r) * stddev_pop(pred)) END, 6) AS pearson FROM told_v GROUP BY model")
def a13(spark, d):
    out = metrics.regression_metrics(preds(spark, d), ["model"])
    return out.select("model", r6("mae").alias("mae"), r6("pearson").alias("pearson"))


COHERENT = "CASE WHEN p = 1 THEN 0.0 WHEN p = 0 THEN least(pred, -1e-6) ELSE greatest(pred, 1e-6) END"


@query("a14_coherent", PRED + f", co AS (SELECT model, r, {COHERENT} AS c FROM told_v) SELECT model, round(avg(abs(c - r)), 6) AS mae, round(CASE WHEN stddev_pop(r) <= 1e-8 OR stddev_pop(c) <= 1e-8 THEN 0.0 ELSE covar_pop(r, c) / (stddev_pop(r) * stddev_pop(c)) END, 6) AS pearson FROM co GROUP BY model")
def a14(spark, d):
    out = metrics.regression_metrics(preds(spark, d).withColumn("c", metrics.coherent("p", "pred")), ["model"], p="c")
    return out.select("model", r6("mae").alias("mae"), r6("pearson").alias("pearson"))


@query("m9_coherent", PRED + f" SELECT vec_id, model, round({COHERENT}, 6) AS reg FROM told_v")
def m9(spark, d):
    return preds(spark, d).select("vec_id", "model", r6(metrics.coherent("p", "pred")).alias("reg"))


@query("a15_per_class_error", PRED + " SELECT model, class_id AS y, count(*) AS n, round(avg(CASE WHEN class_id = p THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(abs(pred - r)), 6) AS mae FROM told_v GROUP BY model, class_id")
def a15(spark, d):
    out = metrics.per_class_error(preds(spark, d), ["model"])
    return out.select("model", "y", "n", r6("recall").alias("recall"), r6("mae").alias("mae"))


@query("a21_loss_report", PRED + """, pr AS (SELECT model, r, pred, exp(CASE class_id WHEN 0 THEN logit0 WHEN 1 THEN logit1 ELSE logit2 END - greatest(logit0, logit1, logit2)) / (exp(logit0 - greatest(logit0, logit1, logit2)) + exp(logit1 - greatest(logit0, logit1, logit2)) + exp(logit2 - greatest(logit0, logit1, logit2))) AS q FROM told_v),
    l AS (SELECT model, avg(-ln(q)) AS ce, avg(CASE WHEN abs(pred - r) <= 1 THEN (pred - r) * (pred - r) / 2 ELSE abs(pred - r) - 0.5 END) AS h FROM pr GROUP BY model) SELECT model, round(ce, 6) AS cross_entropy, round(h, 6) AS huber, round(ce + 0.5 * h, 6) AS loss FROM l""")
def a21(spark, d):
    p = preds(spark, d)
    prob = fusion.softmax([F.col(f"logit{i}") for i in range(3)])
    p = p.withColumn("q", F.when(F.col("y") == 0, prob[0]).when(F.col("y") == 1, prob[1]).otherwise(prob[2]))
    out = metrics.loss_report(p, ["model"], "q", "r", "pred")
    return out.select("model", r6("cross_entropy").alias("cross_entropy"), r6("huber").alias("huber"), r6("loss").alias("loss"))


SOFTMAX = ", ".join(f"round(exp(logit{i} - g) / (exp(logit0 - g) + exp(logit1 - g) + exp(logit2 - g)), 6) AS p{i}" for i in range(3))


@query("m4_softmax", PRED + f", g AS (SELECT *, greatest(logit0, logit1, logit2) AS g FROM pred_v) SELECT vec_id, model, {SOFTMAX} FROM g")
def m4(spark, d):
    prob = fusion.softmax([F.col(f"logit{i}") for i in range(3)])
    return preds(spark, d).select("vec_id", "model", *(r6(x).alias(f"p{i}") for i, x in enumerate(prob)))


@query("m5_masked_softmax_fuse", """x AS (SELECT *, greatest(CASE WHEN mt THEN a END, CASE WHEN ma THEN v END, CASE WHEN mv THEN t END) AS g FROM seq_v),
    w AS (SELECT *, CASE WHEN mt THEN exp(a - g) ELSE 0 END AS wt, CASE WHEN ma THEN exp(v - g) ELSE 0 END AS wa, CASE WHEN mv THEN exp(t - g) ELSE 0 END AS wv FROM x) SELECT vec_id, pos, round((t * wt + a * wa + v * wv) / greatest(wt + wa + wv, 1e-8), 6) AS fused FROM w""")
def m5(spark, d):
    c = lambda *xs: [F.col(x) for x in xs]
    return seq(spark, d).select("vec_id", "pos", r6(fusion.masked_softmax_fuse(c("t", "a", "v"), c("a", "v", "t"), c("mt", "ma", "mv"))).alias("fused"))


@query("m6_inverse_variance_fuse", """x AS (SELECT *, -greatest(-4, least(4, a * 9)) AS st, -greatest(-4, least(4, v * 9)) AS sa, -greatest(-4, least(4, t * 9)) AS sv FROM seq_v), y AS (SELECT *, greatest(CASE WHEN mt THEN st END, CASE WHEN ma THEN sa END, CASE WHEN mv THEN sv END) AS g FROM x),
    w AS (SELECT *, CASE WHEN mt THEN exp(st - g) ELSE 0 END AS wt, CASE WHEN ma THEN exp(sa - g) ELSE 0 END AS wa, CASE WHEN mv THEN exp(sv - g) ELSE 0 END AS wv FROM y) SELECT vec_id, pos, round((t * wt + a * wa + v * wv) / greatest(wt + wa + wv, 1e-8), 6) AS fused FROM w""")
def m6(spark, d):
    c = lambda *xs: [F.col(x) for x in xs]
    return seq(spark, d).select("vec_id", "pos", r6(fusion.inverse_variance_fuse(c("t", "a", "v"), [F.col(x) * 9 for x in "avt"], c("mt", "ma", "mv"))).alias("fused"))


@query("m7_shared_mean_fuse", "SELECT vec_id, pos, round((CASE WHEN mt THEN t ELSE 0 END + CASE WHEN ma THEN a ELSE 0 END + CASE WHEN mv THEN v ELSE 0 END) / greatest(CAST(mt AS INT) + CAST(ma AS INT) + CAST(mv AS INT), 1), 6) AS fused FROM seq_v")
def m7(spark, d):
    c = lambda *xs: [F.col(x) for x in xs]
    return seq(spark, d).select("vec_id", "pos", r6(fusion.shared_mean_fuse(c("t", "a", "v"), c("mt", "ma", "mv"))).alias("fused"))


@query("m8_query_pool", "x AS (SELECT vec_id, t, (0.8 * t - 0.6 * a) / sqrt(2) AS s FROM seq_v WHERE mt), g AS (SELECT vec_id, max(s) AS g FROM x GROUP BY vec_id) SELECT x.vec_id, round(sum(exp(s - g) * t) / sum(exp(s - g)), 6) AS pooled FROM x JOIN g ON x.vec_id = g.vec_id GROUP BY x.vec_id")
def m8(spark, d):
    return pooling.query_pool(seq(spark, d), V, [0.8, -0.6], F.array("t", "a"), F.col("t"), "mt").select("vec_id", r6("pooled").alias("pooled"))


@query("o5_first_argmax", PRED + " SELECT vec_id, model, p FROM told_v")
def o5(spark, d):
    return preds(spark, d).select("vec_id", "model", "p")


@query("e10_ensemble_mean", PRED + " SELECT vec_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("logit0", "logit1", "logit2")) + ", round(avg(pred), 6) AS reg FROM told_v GROUP BY vec_id")
def e10(spark, d):
    out = at.ensemble_mean(preds(spark, d), V)
    return out.select("vec_id", *(r6(c).alias(c) for c in ("logit0", "logit1", "logit2", "reg")))


SUBSETS = {"+".join(m for i, m in enumerate(MODELS) if bits & (1 << i)): [m for i, m in enumerate(MODELS) if bits & (1 << i)] for bits in range(1, 8)}


def candidates(spark, d):
    table = spark.createDataFrame([(s, m) for s, ms in SUBSETS.items() for m in ms], "subset string, model string")
    out = at.ensemble_candidates(preds(spark, d), table, ["vec_id", "y", "r"])
    # Ties between equal means must not hang on the last bit.
    return out.withColumn("p", at.first_argmax([F.round(f"logit{i}", 9) for i in range(3)])).withColumn("pred", F.col("reg"))


CANDIDATES = PRED + ", subs(subset, model) AS (VALUES " + ", ".join(f"('{s}', '{m}')" for s, ms in SUBSETS.items() for m in ms) + f"""),
    ens AS (SELECT subset, vec_id, class_id AS y, r, round(avg(logit0), 9) AS logit0, round(avg(logit1), 9) AS logit1, round(avg(logit2), 9) AS logit2, avg(pred) AS pred FROM told_v JOIN subs ON told_v.model = subs.model GROUP BY subset, vec_id, class_id, r),
    src AS (SELECT *, {argmax_sql('logit0', 'logit1', 'logit2')} AS p FROM ens), """ + f1_sql("src", "subset", "0, 1, 2") + ", mae AS (SELECT subset, avg(abs(pred - r)) AS mae FROM src GROUP BY subset)"


@query("e11_select_ensemble", CANDIDATES + " SELECT s.subset, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(mae, 6) AS mae FROM score s JOIN mae ON s.subset = mae.subset")
def e11(spark, d):
    c = candidates(spark, d)
    out = metrics.classification_metrics(c, ["subset"], [0, 1, 2]).join(metrics.regression_metrics(c, ["subset"]), "subset")
    return out.select("subset", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), r6("mae").alias("mae"))


@query("o6_model_ranking", CANDIDATES + " SELECT s.subset FROM score s JOIN mae ON s.subset = mae.subset ORDER BY round(accuracy, 6) DESC, round(macro_f1, 6) DESC, round(mae, 6), s.subset LIMIT 1")
def o6(spark, d):
    return metrics.ranked(e11(spark, d)).select("subset")


def coalition_sql():
    parts = []
    for bits in range(8):
        t, a, v = (m if bits & (1 << i) else "0.0" for i, m in enumerate("tav"))
        logits = [logit_sql(c, t, a, v) for c in at.COEFFICIENTS["first"]]
        parts.append(f"CASE target WHEN 0 THEN {logits[0]} WHEN 1 THEN {logits[1]} ELSE {logits[2]} END AS c{bits}, {reg_sql(t, a, v)} AS r{bits}")
    full = [logit_sql(c) for c in at.COEFFICIENTS["first"]]
    w = {0: "2.0 / 6", 1: "1.0 / 6", 2: "2.0 / 6"}
    term = lambda k, i: " + ".join(f"{w[bin(b).count('1')]} * ({k}{b | 1 << i} - {k}{b})" for b in range(8) if not b & (1 << i))
    contributions = ", ".join(f"{term('c', i)} AS class_{m}, {term('r', i)} AS reg_{m}" for i, m in enumerate("tav"))
    return MEANS + f", tg AS (SELECT *, {argmax_sql(*full)} AS target FROM mean_v), co AS (SELECT vec_id, target, {', '.join(parts)} FROM tg), sh AS (SELECT vec_id, target, c0 AS base, c7 AS \"full\", {contributions} FROM co)"


SHAPLEY = coalition_sql()


@query("e12_shapley", SHAPLEY + " SELECT vec_id, target, " + ", ".join(f"round({k}_{m}, 6) AS {k}_{m}" for k in ("class", "reg") for m in "tav") + ", " + ", ".join(f"round(abs(class_{m}) / greatest(abs(class_t) + abs(class_a) + abs(class_v), 1e-8), 6) AS share_{m}" for m in "tav") + ", CASE WHEN greatest(class_t, class_a, class_v) > 0 THEN ['t', 'a', 'v'][1 + " + argmax_sql("class_t", "class_a", "class_v") + "] ELSE ['t', 'a', 'v'][1 + " + argmax_sql("abs(class_t)", "abs(class_a)", "abs(class_v)") + "] END AS main FROM sh")
def e12(spark, d):
    s = at.shapley(seq(spark, d), V)
    return s.select("vec_id", "target", *(r6(f"{k}_{m}").alias(f"{k}_{m}") for k in ("class", "reg", "share") for m in "tav"), "main")


@query("q5_explanation_checks", SHAPLEY + ' SELECT vec_id, \'efficiency\' AS check_id FROM sh WHERE abs(class_t + class_a + class_v - ("full" - base)) > 2e-5')
def q5(spark, d):
    return audit.violations(at.shapley(seq(spark, d), V), V, audit.explanation_checks(), F.lit("")).drop("detail")


def mean_logits(t, a, v):
    """A second scorer, over vectors and in Python: three logits and an intensity of each row."""
    mean = [[sum(x) / len(x) for x in m] for m in (t, a, v)]
    return [[x + y, y * z, z - 0.5 * x] for x, y, z in zip(*mean, strict=True)], [x * z for x, _, z in zip(*mean, strict=True)]


#: Averages of the mean vectors of ``vectors``, and what the second scorer makes of them.
VECTOR_MEANS = "vm AS (SELECT vec_id, any_value(class_id) AS class_id, " + ", ".join(f"coalesce(sum(CASE WHEN m{m} THEN {x} END) / nullif(count(*) FILTER (WHERE m{m}), 0), 0.0) AS {m}" for m, x in (("t", "(2 * t - a) / 2"), ("a", "(a + 2 * v) / 2"), ("v", "(v + t + a) / 3"))) + " FROM seq_v GROUP BY vec_id)"
SECOND = ("{t} + {a}", "{a} * {v}", "{v} - 0.5 * {t}", "{t} * {v}")


def second_sql(t, a, v):
    return [x.format(t=t, a=a, v=v) for x in SECOND]


@query("e9_vector_scores", VECTOR_MEANS + ", sc AS (SELECT vec_id, " + ", ".join(f"{x} AS {n}" for x, n in zip(second_sql("t", "a", "v"), ("l0", "l1", "l2", "reg"), strict=True)) + f" FROM vm) SELECT vec_id, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2, round(reg, 6) AS reg FROM sc")
def e9v(spark, d):
    out = at.score_sequences(vectors(spark, d), V, at.batch_scorer(mean_logits))
    return out.select("vec_id", *(r6(F.get("logits", F.lit(i))).alias(f"l{i}") for i in range(3)), r6("reg").alias("reg"))


def second_shapley_sql():
    parts = []
    for bits in range(8):
        x = second_sql(*(m if bits & (1 << i) else "0.0" for i, m in enumerate("tav")))
        parts.append(f"CASE target WHEN 0 THEN {x[0]} WHEN 1 THEN {x[1]} ELSE {x[2]} END AS c{bits}, {x[3]} AS r{bits}")
    w = {0: "2.0 / 6", 1: "1.0 / 6", 2: "2.0 / 6"}
    term = lambda k, i: " + ".join(f"{w[bin(b).count('1')]} * ({k}{b | 1 << i} - {k}{b})" for b in range(8) if not b & (1 << i))
    return VECTOR_MEANS + f", tg AS (SELECT *, {argmax_sql(*second_sql('t', 'a', 'v')[:3])} AS target FROM vm), co AS (SELECT vec_id, target, {', '.join(parts)} FROM tg) SELECT vec_id, target, " + ", ".join(f"round({term('c', i)}, 6) AS class_{m}, round({term('r', i)}, 6) AS reg_{m}" for i, m in enumerate("tav")) + " FROM co"


@query("e12_vector_shapley", second_shapley_sql())
def e12v(spark, d):
    s = at.shapley(vectors(spark, d), V, at.batch_scorer(mean_logits))
    return s.select("vec_id", "target", *(r6(f"{k}_{m}").alias(f"{k}_{m}") for m in "tav" for k in ("class", "reg")))


@query("e13_vector_windows", VECTOR_MEANS + """, lg AS (SELECT vec_id, pos, 't' AS modality, (2 * t - a) / 2 AS x FROM seq_v WHERE mt UNION ALL SELECT vec_id, pos, 'a', (a + 2 * v) / 2 FROM seq_v WHERE ma UNION ALL SELECT vec_id, pos, 'v', (v + t + a) / 3 FROM seq_v WHERE mv),
    bd AS (SELECT vec_id, modality, min(pos) AS lo, max(pos) + 1 AS hi, sum(x) AS sx, count(*) AS n FROM lg GROUP BY vec_id, modality), st AS (SELECT *, CAST(unnest(range(lo, hi)) AS INT) AS start FROM bd),
    wn AS (SELECT st.vec_id, st.modality, st.start, least(st.start + 3, any_value(hi)) AS "end", any_value(sx) AS sx, any_value(n) AS n, sum(lg.x) AS hx, count(*) AS hn FROM st JOIN lg ON st.vec_id = lg.vec_id AND st.modality = lg.modality AND lg.pos >= st.start AND lg.pos < st.start + 3 GROUP BY st.vec_id, st.modality, st.start),
    wm AS (SELECT w.*, m.t, m.a, m.v, coalesce((sx - hx) / nullif(n - hn, 0), 0.0) AS rest FROM wn w JOIN vm m ON w.vec_id = m.vec_id), wx AS (SELECT *, CASE WHEN modality = 't' THEN rest ELSE t END AS t2, CASE WHEN modality = 'a' THEN rest ELSE a END AS a2, CASE WHEN modality = 'v' THEN rest ELSE v END AS v2 FROM wm),
    wt AS (SELECT *, """ + argmax_sql(*second_sql("t", "a", "v")[:3]) + " AS target FROM wx) SELECT vec_id, modality, start, \"end\", target, round(CASE target " + " ".join(f"WHEN {i} THEN {x} - ({y})" for i, (x, y) in enumerate(zip(second_sql("t", "a", "v")[:3], second_sql("t2", "a2", "v2")[:3], strict=True))) + f" END, 6) AS drop, round({second_sql('t', 'a', 'v')[3]} - {second_sql('t2', 'a2', 'v2')[3]}, 6) AS reg_change FROM wt")
def e13v(spark, d):
    w = at.occlusion_windows(vectors(spark, d), V, at.batch_scorer(mean_logits))
    return w.select("vec_id", "modality", "start", "end", "target", r6("drop").alias("drop"), r6("reg_change").alias("reg_change"))


WINDOWS = MEANS + """, lg AS (SELECT vec_id, pos, 't' AS modality, t AS x FROM seq_v WHERE mt UNION ALL SELECT vec_id, pos, 'a', a FROM seq_v WHERE ma UNION ALL SELECT vec_id, pos, 'v', v FROM seq_v WHERE mv),
    bd AS (SELECT vec_id, modality, min(pos) AS lo, max(pos) + 1 AS hi, sum(x) AS sx, count(*) AS n FROM lg GROUP BY vec_id, modality), st AS (SELECT *, CAST(unnest(range(lo, hi)) AS INT) AS start FROM bd),
    wn AS (SELECT st.vec_id, st.modality, st.start, least(st.start + 3, any_value(hi)) AS "end", any_value(sx) AS sx, any_value(n) AS n, sum(lg.x) AS hx, count(*) AS hn FROM st JOIN lg ON st.vec_id = lg.vec_id AND st.modality = lg.modality AND lg.pos >= st.start AND lg.pos < st.start + 3 GROUP BY st.vec_id, st.modality, st.start),
    wm AS (SELECT w.*, m.t, m.a, m.v, coalesce((sx - hx) / nullif(n - hn, 0), 0.0) AS rest FROM wn w JOIN mean_v m ON w.vec_id = m.vec_id), wx AS (SELECT *, CASE WHEN modality = 't' THEN rest ELSE t END AS t2, CASE WHEN modality = 'a' THEN rest ELSE a END AS a2, CASE WHEN modality = 'v' THEN rest ELSE v END AS v2 FROM wm),
    wt AS (SELECT *, """ + argmax_sql(*(logit_sql(c) for c in at.COEFFICIENTS["first"])) + " AS target FROM wx), win AS (SELECT vec_id, modality, start, \"end\", target, CASE target " + " ".join(f"WHEN {i} THEN {logit_sql(c)} - {logit_sql(c, 't2', 'a2', 'v2')}" for i, c in enumerate(at.COEFFICIENTS["first"])) + f" END AS drop, {reg_sql()} - {reg_sql('t2', 'a2', 'v2')} AS reg_change FROM wt)"


@query("e13_occlusion_windows", WINDOWS + ' SELECT vec_id, modality, start, "end", target, round(drop, 6) AS drop, round(reg_change, 6) AS reg_change FROM win')
def e13(spark, d):
    w = at.occlusion_windows(seq(spark, d), V)
    return w.select("vec_id", "modality", "start", "end", "target", r6("drop").alias("drop"), r6("reg_change").alias("reg_change"))


GREEDY = """, w9 AS (SELECT vec_id, modality, start, "end", round(drop, 9) AS drop FROM win), k0 AS (SELECT *, row_number() OVER (PARTITION BY vec_id, modality ORDER BY drop DESC, start) AS k FROM w9), f0 AS (SELECT * FROM k0 WHERE k = 1),
    k1 AS (SELECT w.*, row_number() OVER (PARTITION BY w.vec_id, w.modality ORDER BY w.drop DESC, w.start) AS k FROM w9 w JOIN f0 f ON w.vec_id = f.vec_id AND w.modality = f.modality AND (w."end" <= f.start OR f."end" <= w.start)), f1 AS (SELECT * FROM k1 WHERE k = 1),
    k2 AS (SELECT w.*, row_number() OVER (PARTITION BY w.vec_id, w.modality ORDER BY w.drop DESC, w.start) AS k FROM w9 w JOIN f0 f ON w.vec_id = f.vec_id AND w.modality = f.modality AND (w."end" <= f.start OR f."end" <= w.start)
      JOIN f1 g ON w.vec_id = g.vec_id AND w.modality = g.modality AND (w."end" <= g.start OR g."end" <= w.start)), f2 AS (SELECT * FROM k2 WHERE k = 1),
    gr AS (SELECT *, 0 AS rank FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2) SELECT vec_id, modality, rank, start, "end", round(drop, 6) AS drop FROM gr"""


@query("o4_greedy_nonoverlap", WINDOWS + GREEDY)
def o4(spark, d):
    w = at.occlusion_windows(seq(spark, d), V).withColumn("drop", F.round("drop", 9))
    return at.greedy_nonoverlap(w, ["vec_id", "modality"]).withColumn("drop", r6("drop"))


@query("o3_top_k", WINDOWS + ' SELECT vec_id, modality, start, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(drop, 6) DESC, modality, start) AS INT) AS rank FROM win) WHERE rank <= 5')
def o3(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(r6("drop")), "modality", "start"))
    return at.occlusion_windows(seq(spark, d), V).withColumn("rank", rank).where("rank <= 5").select("vec_id", "modality", "start", "rank")


TIMES = "tm AS (SELECT vec_id, pos, 'w' || pos AS token, CASE WHEN (vec_id + pos) % 4 <> 0 THEN pos * 1000 END AS start_us, CASE WHEN (vec_id + pos) % 4 <> 0 THEN pos * 1000 + 900 END AS end_us FROM seq_v)"


def times(spark, d):
    ok = (F.col("vec_id") + F.col("pos")) % 4 != 0
    return seq(spark, d).select("vec_id", F.col("pos").alias("token_idx"), F.concat(F.lit("w"), F.col("pos").cast("string")).alias("token"), F.when(ok, F.col("pos") * 1000).alias("start_us"), F.when(ok, F.col("pos") * 1000 + 900).alias("end_us"))


TIMED = WINDOWS + ", " + TIMES + """, ev2 AS (SELECT w.vec_id, w.modality, w.start, any_value(w."end") AS "end", any_value(w.drop) AS drop, min(start_us) AS from_us, max(end_us) AS to_us, string_agg(token, ' ' ORDER BY pos) AS span
    FROM win w JOIN tm ON w.vec_id = tm.vec_id AND tm.pos >= w.start AND tm.pos < w."end" GROUP BY w.vec_id, w.modality, w.start)"""


def timed(spark, d):
    w = at.occlusion_windows(seq(spark, d), V)
    return joins.window_times(w, times(spark, d), V, ["modality", "start"])


@query("j8_evidence_times", TIMED + " SELECT vec_id, modality, start, from_us, to_us, span, CASE WHEN from_us IS NULL THEN 'unresolved' ELSE 'aligned' END AS status FROM ev2")
def j8(spark, d):
    return timed(spark, d).select("vec_id", "modality", "start", "from_us", "to_us", "span", "status")


@query("j9_best_evidence", TIMED + """, shm AS (SELECT vec_id, CASE WHEN greatest(class_t, class_a, class_v) > 0 THEN ['t', 'a', 'v'][1 + """ + argmax_sql("class_t", "class_a", "class_v") + "] ELSE ['t', 'a', 'v'][1 + " + argmax_sql("abs(class_t)", "abs(class_a)", "abs(class_v)") + "] END AS main FROM (" + "WITH " + SHAPLEY.replace(MEANS + ", ", "", 1) + """ SELECT * FROM sh)),
    bst AS (SELECT s.vec_id, e.start, e.drop, row_number() OVER (PARTITION BY s.vec_id ORDER BY round(e.drop, 9) DESC, e.start) AS r FROM shm s JOIN ev2 e ON s.vec_id = e.vec_id AND e.modality = s.main WHERE from_us IS NOT NULL)
    SELECT s.vec_id, s.main, b.start, round(round(b.drop, 9), 6) AS drop FROM shm s LEFT JOIN (SELECT * FROM bst WHERE r = 1) b ON s.vec_id = b.vec_id""")
def j9(spark, d):
    told = at.shapley(seq(spark, d), V).select("vec_id", "main")
    out = joins.best_evidence(told, timed(spark, d).withColumn("drop", F.round("drop", 9)), V)
    return out.select("vec_id", "main", "start", r6("drop").alias("drop"))


@query("e15_evidence_cards", TIMED + " SELECT vec_id, modality, start, status, rank FROM (SELECT vec_id, modality, start, CASE WHEN from_us IS NULL THEN 'unresolved' ELSE 'aligned' END AS status, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(drop, 6) DESC, modality, start) AS INT) AS rank FROM ev2) WHERE rank <= 5")
def e15(spark, d):
    return joins.evidence_cards(timed(spark, d).withColumn("drop", r6("drop")), V).select("vec_id", "modality", "start", "status", "rank")


@query("t12_evidence_string", TIMED + " SELECT vec_id, string_agg(modality || ':' || start || '-' || (\"end\" - 1), ';' ORDER BY modality, start) AS evidence FROM ev2 GROUP BY vec_id")
def t12(spark, d):
    return joins.evidence_string(timed(spark, d), V)


SCEN = "scen(kind, modality, rate, place) AS (VALUES " + ", ".join(f"('{k}', '{m}', {r}::DOUBLE, '{p}')" for k, m, r, p in at.SCENARIOS) + """),
    rk AS (SELECT *, mt OR ma OR mv AS valid, count_if(mt OR ma OR mv) OVER (PARTITION BY vec_id) AS n, count_if(mt OR ma OR mv) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS i FROM seq_v),
    ln AS (SELECT *, CASE WHEN rate > 0 THEN greatest(1, CAST(round_even(n * rate, 0) AS INT)) ELSE 0 END AS len FROM rk, scen),
    gn AS (SELECT *, CASE WHEN place = 'start' THEN 0 WHEN place = 'middle' THEN (n - len) // 2 ELSE n - len END AS f FROM ln),
    ms AS (SELECT *, valid AND i >= f AND i < f + len AS gone FROM gn),
    mk AS (SELECT vec_id, pos, class_id, reg, t, a, v, kind, modality, rate, place, mt AND NOT (gone AND contains(modality, 't')) AS mt, ma AND NOT (gone AND contains(modality, 'a')) AS ma, mv AND NOT (gone AND contains(modality, 'v')) AS mv FROM ms)"""


def valid_seq(spark, d):
    return seq(spark, d).withColumn("valid", F.col("mt") | F.col("ma") | F.col("mv"))


def scenario_scores(spark, d):
    out = at.score_scenarios(valid_seq(spark, d).withColumnRenamed("reg", "r"), V, at.linear_scorer("first"), carry=("class_id", "r"))
    return told(out.withColumn("scenario", F.concat_ws(":", "kind", "modality", F.col("rate").cast("string"), "place")))


@query("e7_mask_scenarios", SCEN + " SELECT kind, modality, rate, place, vec_id, CAST(count_if(mt) AS BIGINT) AS t, CAST(count_if(ma) AS BIGINT) AS a, CAST(count_if(mv) AS BIGINT) AS v, CAST(sum(CASE WHEN mt THEN pos ELSE 0 END) AS BIGINT) AS at FROM mk GROUP BY kind, modality, rate, place, vec_id")
def e7(spark, d):
    return at.scenario_counts(valid_seq(spark, d), V)


SCORED = SCEN + ", sm AS (SELECT kind, modality, rate, place, vec_id, any_value(class_id) AS y, any_value(reg) AS r, " + ", ".join(f"{mean_sql(m)} AS {m}" for m in "tav") + f" FROM mk GROUP BY kind, modality, rate, place, vec_id), sp AS (SELECT *, kind || ':' || modality || ':' || rate || ':' || place AS scenario, {argmax_sql(*(logit_sql(c) for c in at.COEFFICIENTS['first']))} AS p, {reg_sql()} AS pred FROM sm), " + f1_sql("sp", "scenario", "0, 1, 2")


def scenario_metrics(spark, d):
    out = scenario_scores(spark, d)
    return metrics.classification_metrics(out, ["kind", "scenario"], [0, 1, 2]).join(metrics.regression_metrics(out, ["kind", "scenario"]), ["kind", "scenario"])


@query("a16_scenario_means", SCORED + ", mae AS (SELECT kind, scenario, avg(abs(pred - r)) AS mae FROM sp GROUP BY kind, scenario) SELECT m.kind, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1, round(avg(mae), 6) AS mae, count(*) AS scenarios FROM score s JOIN mae m ON s.scenario = m.scenario GROUP BY m.kind")
def a16(spark, d):
    out = metrics.scenario_means(scenario_metrics(spark, d), ["kind"])
    return out.select("kind", *(r6(c).alias(c) for c in ("accuracy", "macro_f1", "mae")), "scenarios")


@query("a16_rate_curve", SCORED + ", nm AS (SELECT DISTINCT scenario, modality, rate FROM sp WHERE kind = 'single') SELECT modality, CAST(rate AS VARCHAR) AS rate, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1, count(*) AS scenarios FROM score s JOIN nm ON s.scenario = nm.scenario GROUP BY modality, nm.rate")
def a16c(spark, d):
    rows = scenario_metrics(spark, d).where("kind = 'single'").withColumns({"modality": F.split("scenario", ":")[1], "rate": F.split("scenario", ":")[2]})
    out = metrics.scenario_means(rows, ["modality", "rate"], ("accuracy", "macro_f1"))
    return out.select("modality", "rate", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), "scenarios")


@query("e14_robust_versus_baseline", SCORED + ", kd AS (SELECT DISTINCT scenario, kind FROM sp) SELECT 'first' AS model, round(avg(macro_f1) FILTER (kind = 'complete'), 6) AS complete, round(avg(macro_f1) FILTER (kind <> 'complete'), 6) AS masked, round(avg(macro_f1) FILTER (kind = 'complete') - avg(macro_f1) FILTER (kind <> 'complete'), 6) AS lost FROM score s JOIN kd ON kd.scenario = s.scenario")
def e14b(spark, d):
    out = metrics.robust_versus_baseline(scenario_metrics(spark, d).withColumn("model", F.lit("first")))
    return out.select("model", *(r6(c).alias(c) for c in ("complete", "masked", "lost")))


@query("e14_confusion", SCORED + " SELECT kind, y, p, count(*) AS n FROM sp GROUP BY kind, y, p")
def e14c(spark, d):
    return metrics.confusion(scenario_scores(spark, d), ["kind"])


@query("e9_score_batches", SCORED + " SELECT scenario, vec_id, p, round(pred, 6) AS reg FROM sp")
def e9(spark, d):
    return scenario_scores(spark, d).select("scenario", "vec_id", "p", r6("reg").alias("reg"))


@query("e14_reliability_report", SCORED + ", cl AS (SELECT kind, y, count(*) AS n, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS recall, avg(abs(pred - r)) AS mae FROM sp GROUP BY kind, y) SELECT kind, y, n, round(recall, 6) AS recall, round(mae, 6) AS mae FROM cl")
def e14(spark, d):
    return metrics.per_class_error(scenario_scores(spark, d), ["kind"]).select("kind", "y", "n", r6("recall").alias("recall"), r6("mae").alias("mae"))


def uniform_sql(name):
    return f"CAST('0x' || substr(md5('7|{name}|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0"


def list_gap_sql(m, touched, low, high):
    """A modality's mask after a gap in the list of its observed positions."""
    return f"""(SELECT vec_id, pos, m{m} AND NOT ({touched} AND n >= 2 AND m{m} AND i >= st AND i < st + ln) AS m FROM (SELECT *, floor({uniform_sql('start' + m)} * (n - ln + 1)) AS st FROM
      (SELECT *, greatest(1, round_even(n * ({low} + {high - low:.2f} * {uniform_sql('rate' + m)}), 0)) AS ln FROM (SELECT vec_id, pos, m{m}, count_if(m{m}) OVER (PARTITION BY vec_id) AS n, count_if(m{m}) OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS i FROM seq_v))))"""


LOST = {m: " + ".join(f"CASE WHEN {uniform_sql(o)} < {uniform_sql(m)} THEN 1 ELSE 0 END" for o in "tav" if o != m) for m in "tav"}
GAPS = f"""bo AS (SELECT *, min(CASE WHEN mt OR ma OR mv THEN pos END) OVER (PARTITION BY vec_id) AS lo, max(CASE WHEN mt OR ma OR mv THEN pos END) OVER (PARTITION BY vec_id) + 1 AS hi FROM seq_v),
    le AS (SELECT *, greatest(1, round_even((hi - lo) * (0.1 + 0.5 * {uniform_sql('rate')}), 0)) AS ln FROM bo), sa AS (SELECT *, lo + floor({uniform_sql('start')} * greatest(1, hi - lo - ln + 1)) AS st, [1, 1, 1, 2, 2, 3][CAST(floor({uniform_sql('n')} * 6) AS INT) + 1] AS k FROM le),
    go AS (SELECT *, {uniform_sql('touch')} >= 0.2 AND pos >= st AND pos < st + ln AS gone FROM sa),
    sp AS (SELECT vec_id, 'span' AS rule, {", ".join(f"CAST(count_if(m{m} AND NOT coalesce(gone AND {LOST[m]} < k, false)) AS BIGINT) AS {m}" for m in "tav")} FROM go GROUP BY vec_id),
    wh AS (SELECT vec_id, CAST(count_if(mt) AS BIGINT) AS t, CAST(count_if(ma) AS BIGINT) AS a, CAST(count_if(mv) AS BIGINT) AS v FROM seq_v GROUP BY vec_id),
    tx AS (SELECT vec_id, CAST(count_if(m) AS BIGINT) AS t FROM {list_gap_sql('t', 'true', 0.15, 0.5)} GROUP BY vec_id),
    la AS (SELECT vec_id, CAST(count_if(m) AS BIGINT) AS a FROM {list_gap_sql('a', f"({uniform_sql('modes')} < 0.3 OR ({uniform_sql('modes')} >= 0.6 AND {uniform_sql('modes')} < 0.9)) AND {uniform_sql('touch')} >= 0.2", 0.1, 0.5)} GROUP BY vec_id),
    lv AS (SELECT vec_id, CAST(count_if(m) AS BIGINT) AS v FROM {list_gap_sql('v', f"({uniform_sql('modes')} >= 0.3 AND {uniform_sql('modes')} < 0.9) AND {uniform_sql('touch')} >= 0.2", 0.1, 0.5)} GROUP BY vec_id)
    SELECT vec_id, t, a, v, rule FROM sp UNION ALL SELECT w.vec_id, x.t, w.a, w.v, 'text' FROM wh w JOIN tx x ON w.vec_id = x.vec_id UNION ALL SELECT w.vec_id, w.t, a.a, v.v, 'list' FROM wh w JOIN la a ON w.vec_id = a.vec_id JOIN lv v ON w.vec_id = v.vec_id"""


@query("e8_random_gap_masks", GAPS)
def e8(spark, d):
    s = valid_seq(spark, d)
    parts = [at.random_gap_masks(s, V, 7, rule).groupBy("vec_id").agg(*(F.count_if(f"m{m}").alias(m) for m in "tav")).withColumn("rule", F.lit(rule)) for rule in ("span", "text", "list")]
    return metrics.union_all(parts)


@query("a19_missing_positions", "SELECT vec_id, CAST(count_if((mt OR ma OR mv) AND NOT mt) AS BIGINT) AS t, CAST(count_if((mt OR ma OR mv) AND NOT ma) AS BIGINT) AS a, CAST(count_if((mt OR ma OR mv) AND NOT mv) AS BIGINT) AS v, bool_or(ma) AS audio FROM seq_v GROUP BY vec_id")
def a19(spark, d):
    out = metrics.missing_positions(valid_seq(spark, d), V, F.col("valid"), {m: f"m{m}" for m in "tav"})
    return out.select("vec_id", "t", "a", "v", F.col("has_a").alias("audio"))


@query("j13_join_predictions", PRED + " SELECT vec_id, count(*) AS models, round(avg(logit1), 6) AS neutral FROM told_v GROUP BY vec_id")
def j13(spark, d):
    return joins.join_predictions(preds(spark, d), V, ["logit1"]).select("vec_id", "models", r6("logit1").alias("neutral"))


@query("q4_prediction_checks", PRED + " SELECT vec_id, model, 'sign' AS check_id FROM told_v WHERE (p = 0 AND pred >= 0) OR (p = 1 AND pred <> 0) OR (p = 2 AND pred <= 0)")
def q4(spark, d):
    p = preds(spark, d)
    for i, x in enumerate(fusion.softmax([F.col(f"logit{i}") for i in range(3)])):
        p = p.withColumn(f"p{i}", x)
    return audit.violations(p, ["vec_id", "model"], audit.prediction_checks("p0", "p1", "p2", "p", "pred"), F.lit("")).drop("detail")


@query("q4_prediction_ids", "SELECT DISTINCT vec_id, CASE WHEN vec_id % 40 = 1 THEN 'missing_id' WHEN vec_id % 50 = 0 THEN 'repeated_id' ELSE 'unexpected_id' END AS check_id FROM seq_v WHERE vec_id % 40 = 1 OR vec_id % 50 = 0 UNION ALL SELECT DISTINCT vec_id, 'unexpected_id' FROM seq_v WHERE vec_id % 60 = 7 AND vec_id % 40 <> 1")
def q4i(spark, d):
    ids = seq(spark, d).select("vec_id").distinct()
    given = ids.where("vec_id % 40 <> 1")
    return audit.prediction_file_violations(given.unionByName(ids.where("vec_id % 50 = 0")), ids.where("vec_id % 60 <> 7 or vec_id % 40 = 1"), V)


@query("q5_window_rows", "n AS (SELECT vec_id, count(*) AS n FROM seq_v WHERE mt GROUP BY vec_id) SELECT vec_id, 'window_rows' AS check_id FROM n WHERE vec_id % 9 = 2")
def q5w(spark, d):
    rows = seq(spark, d).where("mt")
    said = rows.groupBy("vec_id").agg(F.count("*").alias("n_windows")).withColumn("n_windows", F.col("n_windows") + F.when(F.col("vec_id") % 9 == 2, 1).otherwise(0))
    return audit.window_count_violations(said, rows, V)


@query("q5_availability", "SELECT DISTINCT vec_id, 'availability' AS check_id FROM seq_v WHERE vec_id % 9 = 4")
def q5a(spark, d):
    told_ = seq(spark, d).groupBy("vec_id").agg(F.bool_or("mv").alias("vision"))
    said = told_.withColumn("vision", F.when(F.col("vec_id") % 9 == 4, ~F.col("vision")).otherwise(F.col("vision")))
    return audit.availability_violations(said, told_, V, "vision")


AUX = ", ".join(f"-ln(exp(b{k} - g{k}) / (exp(b{k} - g{k}) + exp(-g{k}))) AS l{k}" for k in range(3))


@query("a21_auxiliary_loss", f"""m AS (SELECT vec_id, bool_or(mt) AS ht, bool_or(ma) AS ha, bool_or(mv) AS hv, {", ".join(f"{mean_sql(m)} AS b{k}" for k, m in enumerate("tav"))} FROM seq_v GROUP BY vec_id), g AS (SELECT *, {", ".join(f"greatest(b{k}, 0) AS g{k}" for k in range(3))} FROM m),
    l AS (SELECT vec_id % 2 AS part, ht, ha, hv, {AUX} FROM g) SELECT part, round(coalesce(avg(l0) FILTER (ht), 0) + coalesce(avg(l1) FILTER (ha), 0) + coalesce(avg(l2) FILTER (hv), 0), 6) AS aux FROM l GROUP BY part""")
def a21b(spark, d):
    s = seq(spark, d)
    means = s.groupBy("vec_id").agg(*(F.coalesce(F.avg(F.when(F.col(f"m{m}"), F.col(m))), F.lit(0.0)).alias(m) for m in "tav"), *(F.bool_or(f"m{m}").alias(f"h{m}") for m in "tav"))
    probs = means.select((F.col("vec_id") % 2).alias("part"), *(f"h{m}" for m in "tav"), *(fusion.softmax([F.col(m), F.lit(0.0)])[0].alias(f"q{m}") for m in "tav"))
    return metrics.auxiliary_loss(probs, ["part"], [(f"q{m}", f"h{m}") for m in "tav"]).select("part", r6("aux").alias("aux"))


# Folds and probes: groups are sources, labels are quality + toxic.

FOLDS = """cn AS (SELECT grp, label, count(*) AS n FROM groups_v GROUP BY grp, label), sd AS (SELECT grp, stddev_pop(n) AS spread, sum(n) AS size FROM cn GROUP BY grp),
    rk AS (SELECT grp, row_number() OVER (ORDER BY round(spread, 9) DESC, size DESC, md5('0:' || grp), grp) - 1 AS i FROM sd), folds AS (SELECT grp, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INT) AS fold FROM rk)"""


def groups(spark, d):
    return view(spark, d, "groups_v")


def folds(spark, d):
    return metrics.group_folds(groups(spark, d), "grp", "label", 5)


@query("e1_group_folds", FOLDS + " SELECT grp, fold FROM folds")
def e1(spark, d):
    return folds(spark, d)


@query("u4_disjointness", FOLDS + " SELECT fold, count(DISTINCT grp) AS groups, 0 AS shared FROM folds GROUP BY fold")
def u4(spark, d):
    return metrics.fold_overlap(folds(spark, d), "grp")


@query("a20_fold_profile", FOLDS + " SELECT fold, count(*) AS n, count(DISTINCT g.grp) AS groups, CAST(count_if(label = 0) AS BIGINT) AS class_0, CAST(count_if(label = 1) AS BIGINT) AS class_1, CAST(count_if(label = 2) AS BIGINT) AS class_2 FROM groups_v g JOIN folds f ON g.grp = f.grp GROUP BY fold")
def a20(spark, d):
    return metrics.fold_profile(groups(spark, d), folds(spark, d), "grp", "label")


MAJORITY = FOLDS + ", lf AS (SELECT fold, label, count(*) AS n FROM groups_v g JOIN folds f ON g.grp = f.grp GROUP BY fold, label), ot AS (SELECT o.fold, l.label, sum(l.n) AS n FROM (SELECT DISTINCT fold FROM lf) o JOIN lf l ON l.fold <> o.fold GROUP BY o.fold, l.label), mj AS (SELECT fold, label AS majority FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) AS r FROM ot) WHERE r = 1)"


@query("e3_majority_baseline", MAJORITY + " SELECT fold, majority FROM mj")
def e3(spark, d):
    return metrics.majority_baseline(groups(spark, d).join(folds(spark, d), "grp"))


@query("a17_fold_mean_sd", MAJORITY + ", ac AS (SELECT f.fold, avg(CASE WHEN g.label = m.majority THEN 1.0 ELSE 0.0 END) AS accuracy FROM groups_v g JOIN folds f ON g.grp = f.grp JOIN mj m ON m.fold = f.fold GROUP BY f.fold) SELECT 'majority' AS block, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd FROM ac")
def a17(spark, d):
    g = groups(spark, d).join(folds(spark, d), "grp")
    acc = g.join(metrics.majority_baseline(g), "fold").groupBy("fold").agg(F.avg(F.when(F.col("label") == F.col("majority"), 1.0).otherwise(0.0)).alias("accuracy")).withColumn("block", F.lit("majority"))
    return metrics.fold_mean_sd(acc, ["block"], "accuracy").select("block", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("e4_impute_and_scale", "x AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS DOUBLE) END AS v, doc_id % 5 <> 0 AS tr FROM groups_v), st AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM x WHERE tr) SELECT doc_id, round((coalesce(v, mu) - mu) / sd, 6) AS scaled FROM x, st")
def e4(spark, d):
    x = groups(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars").cast("double")).alias("v"), (F.col("doc_id") % 5 != 0).alias("tr"))
    return probe.impute_and_scale(x, "tr", "v").select("doc_id", r6("scaled").alias("scaled"))


def stats_vector(spark, d):
    m = pooling.moments(seq(spark, d), V, "a", "ma").withColumnsRenamed({"mean": "m_a", "std": "s_a"}).drop("present")
    t = pooling.moments(seq(spark, d), V, "t", "mt").withColumnsRenamed({"mean": "m_t", "std": "s_t"}).drop("present")
    labels = seq(spark, d).groupBy("vec_id").agg(F.first("class_id").alias("label"))
    return m.join(t, "vec_id").join(labels, "vec_id").withColumn("fold", (F.col("vec_id") % 3).cast("int"))


@query("e2_grouped_probe")
def e2(spark, d):
    return probe.grouped_probe(stats_vector(spark, d), ["m_a", "s_a", "m_t", "s_t"], "label", "fold", 3).select("vec_id", "label", "fold", "predicted")


@query("e5_pca_projection")
def e5(spark, d):
    return probe.pca_projection(view(spark, d, "SELECT vec_id, embedding FROM embeddings"), "embedding", 2).select("vec_id", "pc1", "pc2")


@query("e6_kernel_probe")
def e6(spark, d):
    x = stats_vector(spark, d).withColumn("x", F.array("m_a", "s_a", "m_t", "s_t")).withColumn("train", F.col("fold") != 0)
    return probe.kernel_probe(x, "x", "label", "train", 4).select("vec_id", "label", "predicted")


@query("e6_kernel_ridge")
def e6b(spark, d):
    s = seq(spark, d)
    x = s.groupBy("vec_id").agg(F.first("class_id").alias("label"), F.first("reg").alias("reg")).withColumn("train", F.col("vec_id") % 3 != 0)
    for m in "tav":
        x = x.join(pooling.moments(s, V, m, f"m{m}").select("vec_id", F.array("mean", "std", "present").alias(m)), "vec_id")
    model = kernel.fit(x, {"t": 3, "a": 2, "v": 2}, "label", "reg", "train", width=256)
    return model.transform(x).select("vec_id", "label", "reg", "train", "predicted", "intensity")
