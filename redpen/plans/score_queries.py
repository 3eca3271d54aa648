"""Queries of risk scores, emission matrices, calibration, latency reports, sources and prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from redpen.functions import ctc, scores, text
from redpen.operators import calibration, reports
from redpen.plans.common import F, cache, over_cache, r6, table
from redpen.plans.registry import register
from redpen.sources import files

# -- emission matrices: each embedding of 64 numbers is 8 steps of 8 classes ---------------------

RHO, TEMPERATURE = 0.3, 0.2


def _matrix(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.slice("embedding", t * 8 + 1, F.lit(8)), lambda x: F.round(x.cast("double"), 6)))
    return table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("logits"))


def _emission(spark, sf_dir):
    return _matrix(spark, sf_dir).select("vec_id", ctc.softmax(F.col("logits"), TEMPERATURE).alias("e"))


EMISSION = [
    "m AS (SELECT vec_id, list_transform(range(0, 8), lambda t: list_transform(embedding[t * 8 + 1 : t * 8 + 8], lambda x: round(x::DOUBLE, 6))) AS logits FROM embeddings)",
    f"x AS (SELECT vec_id, list_transform(logits, lambda r: list_transform(r, lambda x: exp((x - list_max(r)) / {TEMPERATURE}::DOUBLE))) AS e0 FROM m)",
    "em AS (SELECT vec_id, list_transform(e0, lambda r: list_transform(r, lambda x: x / list_sum(r))) AS e FROM x)",
    "best AS (SELECT *, list_transform(e, lambda r: list_position(r, list_max(r)) - 1) AS b FROM em)",
    "kept AS (SELECT *, list_filter(range(0, 8), lambda i: b[i + 1] <> 0 AND (i = 0 OR b[i] <> b[i + 1])) AS k FROM best)",
]


def emission_sql(body):
    return "WITH " + ", ".join(EMISSION) + "\n" + body


def _round_all(c):
    return F.transform(c, lambda x: F.round(x, 6))


@register("c1_softmax", emission_sql("SELECT vec_id, list_transform(flatten(e), lambda x: round(x, 6)) AS p FROM em"))
def c1_softmax(spark, sf_dir):
    return _emission(spark, sf_dir).select("vec_id", _round_all(F.flatten("e")).alias("p"))


@register("c2_boundary_stats", emission_sql("""SELECT vec_id, round((e[1][1] + e[2][1]) / 2, 6) AS blank_mean_l, round((e[7][1] + e[8][1]) / 2, 6) AS blank_mean_r, round(greatest(e[1][1], e[2][1]), 6) AS blank_peak_l, round(greatest(e[7][1], e[8][1]), 6) AS blank_peak_r, TRUE AS valid FROM em"""))
def c2_boundary_stats(spark, sf_dir):
    s = _emission(spark, sf_dir).select("vec_id", ctc.boundary_stats(F.col("e"), 0, RHO).alias("s"))
    return s.select("vec_id", *[r6(F.col(f"s.blank_{k}_{e}")).alias(f"blank_{k}_{e.lower()}") for k in ("mean", "peak") for e in "LR"], "s.valid")


TOP = "top AS (SELECT vec_id, list_transform(e, lambda r: list_reverse_sort(r)[1]) AS p1, list_transform(e, lambda r: list_reverse_sort(r)[2]) AS p2, list_transform(e, lambda r: list_position(r, list_max(r)) - 1) AS i1 FROM em)"


def top_sql(body):
    return "WITH " + ", ".join([*EMISSION, TOP]) + "\n" + body


def _top(spark, sf_dir):
    t = _emission(spark, sf_dir).select("vec_id", "e", F.transform("e", ctc.top_two).alias("t"))
    part = lambda n: F.transform("t", lambda s: s[n])
    return t.select("vec_id", "e", part("first").alias("i1"), part("p1").alias("p1"), part("p2").alias("p2"))


@register("c3_top_two", top_sql("SELECT vec_id, i1, list_transform(p1, lambda x: round(x, 6)) AS p1, list_transform(p2, lambda x: round(x, 6)) AS p2, round((list_sum(p1) - list_sum(p2)) / 8, 6) AS gap FROM top"))
def c3_top_two(spark, sf_dir):
    t = _top(spark, sf_dir)
    return t.select("vec_id", "i1", _round_all(F.col("p1")).alias("p1"), _round_all(F.col("p2")).alias("p2"), r6(ctc.mean(F.zip_with("p1", "p2", lambda a, b: a - b))).alias("gap"))


@register("c4_greedy_decode", emission_sql("SELECT vec_id, list_transform(k, lambda i: b[i + 1]) AS classes, round(coalesce(list_sum(list_transform(k, lambda i: list_max(e[i + 1]))) / nullif(len(k), 0), 0), 6) AS confidence FROM kept"))
def c4_greedy_decode(spark, sf_dir):
    g = _emission(spark, sf_dir).select("vec_id", ctc.greedy(F.col("e")).alias("g"))
    return g.select("vec_id", "g.classes", r6(F.col("g.confidence")).alias("confidence"))


@register("c5_decode_driver", emission_sql("SELECT vec_id, array_to_string(list_transform(k, lambda i: substring('-abcdefg', b[i + 1] + 1, 1)), '') AS label, len(k) AS n_chars FROM kept"))
def c5_decode_driver(spark, sf_dir):
    g = _emission(spark, sf_dir).select("vec_id", ctc.greedy(F.col("e")).alias("g"))
    return g.select("vec_id", F.array_join(F.transform("g.classes", lambda c: F.substring(F.lit("-abcdefg"), c + 1, F.lit(1))), "").alias("label"), F.size("g.classes").alias("n_chars"))


@register("c6_step_entropy", emission_sql("SELECT vec_id, list_transform(e, lambda r: round(list_sum(list_transform(r, lambda p: -p * ln(p))), 6)) AS h FROM em"))
def c6_step_entropy(spark, sf_dir):
    return _emission(spark, sf_dir).select("vec_id", _round_all(ctc.entropy(F.col("e"))).alias("h"))


@register("c7_c9_ctc_alignment")
def c7_c9_ctc_alignment(spark, sf_dir):
    """Steps of each character of a text whose length may differ from the decoded one, and its entropy."""
    e = _emission(spark, sf_dir).withColumn("n", (F.col("vec_id") % 9).cast("int"))
    return e.select("vec_id", "n", ctc.aligned_steps(F.col("e"), F.col("n")).alias("a")).select("vec_id", "n", "a.strategy", "a.steps")


@register("c10_uniform_alignment", "SELECT vec_id, list_transform(range(0, (vec_id % 9 + 1)::INT), lambda i: floor(i * (8.0::DOUBLE / (vec_id % 9 + 1)))::INT) AS starts FROM embeddings")
def c10_uniform_alignment(spark, sf_dir):
    a = ctc.uniform_alignment(F.lit(8), (F.col("vec_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(a, lambda s: s["start"]).alias("starts"))


@register("c11_alignment_stats", emission_sql("""SELECT vec_id, len(k) AS decoded_chars, CASE WHEN d = 0 THEN 'perfect_match' WHEN d <= 2 THEN 'tolerant_align' WHEN d / greatest(n, 1)::DOUBLE <= 0.3::DOUBLE THEN 'greedy_align' ELSE 'fallback_align' END AS strategy
  FROM (SELECT *, vec_id % 9 AS n, abs(len(k) - vec_id % 9) AS d FROM kept)"""))
def c11_alignment_stats(spark, sf_dir):
    g = _emission(spark, sf_dir).select("vec_id", F.size(ctc.greedy(F.col("e"))["classes"]).alias("decoded_chars"))
    return g.select("vec_id", "decoded_chars", ctc.alignment_kind(F.col("decoded_chars"), (F.col("vec_id") % 9).cast("int")).alias("strategy"))


@register("c12_char_entropy")
def c12_char_entropy(spark, sf_dir):
    e = _emission(spark, sf_dir).withColumn("n", (F.col("vec_id") % 9).cast("int"))
    per_char = F.transform(ctc.aligned_steps(F.col("e"), F.col("n"))["steps"], lambda s: F.array_max(F.transform(s, lambda i: F.get("h", i))))
    rows = e.withColumn("h", ctc.entropy(F.col("e"))).select("vec_id", per_char.alias("c"))
    return rows.select("vec_id", F.array_max("c").alias("top"), ctc.argmax(F.col("c")).alias("at"))


@register("c13_batched_by_ratio", over_cache("SELECT row_idx, length(gt) AS width FROM cache ORDER BY row_idx"))
def c13_batched_by_ratio(spark, sf_dir):
    """Lines dealt into batches of like length and given back in input order."""
    rows = cache(spark, sf_dir).select("row_idx", F.length("gt").alias("width"))
    dealt = rows.repartitionByRange(8, "width").sortWithinPartitions("width", "row_idx")
    return dealt.select("row_idx", "width", F.spark_partition_id().alias("batch")).select("row_idx", "width").orderBy("row_idx")


@register("c14_crop_columns", "SELECT vec_id, len(embedding[7:]) AS n_left, round(embedding[7]::DOUBLE, 6) AS first_left, len(embedding[:58]) AS n_right FROM embeddings")
def c14_crop_columns(spark, sf_dir):
    left, right = ctc.crop(F.col("embedding"), 0.1, "left"), ctc.crop(F.col("embedding"), 0.1, "right")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(left).alias("n_left"), r6(left[0].cast("double")).alias("first_left"), F.size(right).alias("n_right"))


# -- scores --------------------------------------------------------------------------------------

SIGNALS = top_sql("") + ", sig AS (SELECT vec_id, p1, p2, round((e[1][1] + e[2][1]) / 2, 9) AS ml, round((e[7][1] + e[8][1]) / 2, 9) AS mr, greatest(e[1][1], e[2][1]) AS pl, greatest(e[7][1], e[8][1]) AS pr, (vec_id % 7) / 7.0::DOUBLE AS v, (vec_id % 5) / 10.0::DOUBLE AS dr, (vec_id % 3) / 3.0::DOUBLE AS rd FROM em JOIN top USING (vec_id))"
EDGE = "greatest(0.6 * ml + 0.4 * pl, 0.6 * mr + 0.4 * pr)"


def signal_sql(body):
    return SIGNALS + "\n" + body


def _signals(spark, sf_dir):
    rows = _top(spark, sf_dir).withColumn("s", ctc.boundary_stats(F.col("e"), 0, RHO))
    v = F.col("vec_id")
    return rows.withColumns({"v": v % 7 / F.lit(7.0), "dr": v % 5 / F.lit(10.0), "rd": v % 3 / F.lit(3.0)})


def _s_b():
    return scores.boundary_score(F.col("s"), F.col("v"), F.col("dr"), 0.0, 0.5)


def _s_a():
    return scores.ambiguity_score(F.lit("available"), F.col("p1"), F.col("p2"), F.lit(None).cast("double"), F.lit(None).cast("double"))


CLIP = "greatest(0.0, least(1.0, %s))"
S_B = CLIP % f"({CLIP % '(v / 0.5)'} * {EDGE} + {EDGE} + dr) / 3.0"
S_A = CLIP % "1.0 - list_min(list_transform(range(1, 9), lambda i: p1[i] - p2[i]))"


def _single(bias, *terms):
    """SQL of a logistic score whose products and sums are in single precision."""
    z = f"{bias}::FLOAT"
    for x, w in terms:
        z = f"({z} + ({x}) * {w}::FLOAT)"
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-500.0::DOUBLE, least(500.0::DOUBLE, ({z})::DOUBLE))))"


@register("m2_logistic_scores", over_cache(f"""SELECT row_idx, round({_single('0.1', ('mean_conf::FLOAT', '(-1.2)'), ('min_conf::FLOAT', '(-0.8)'), ('"drop"::FLOAT', '2.0'), ('r_d::FLOAT', '0.5'), ('conf::FLOAT', '(-0.3)'))}, 6) AS q FROM cache"""))
def m2_logistic_scores(spark, sf_dir):
    q = scores.logistic([F.col("mean_conf"), F.col("min_conf"), F.col("drop"), F.col("r_d"), F.col("conf")], [-1.2, -0.8, 2.0, 0.5, -0.3], 0.1)
    return cache(spark, sf_dir).select("row_idx", r6(q).alias("q"))


@register("m3_unified_scores", over_cache(f"""SELECT row_idx, round({_single('0.2', ('mean_conf::FLOAT', '(-1.5)'), ('min_conf::FLOAT', '(-0.5)'), ('(mean_conf * "drop")::FLOAT', '1.0'), ('0.0::FLOAT', '0.3'))}, 6) AS q FROM cache"""))
def m3_unified_scores(spark, sf_dir):
    """Features padded with 0 or cut to the number of weights, the product of two appended."""
    x = F.array("mean_conf", "min_conf", F.col("mean_conf") * F.col("drop"))
    return cache(spark, sf_dir).select("row_idx", r6(scores.padded_logistic(x, [-1.5, -0.5, 1.0, 0.3], 0.2)).alias("q"))


@register("m5_rule_risk", over_cache(f"SELECT row_idx, round({CLIP % '0.5::DOUBLE * (1 - mean_conf) + 0.3::DOUBLE * r_d + 0.2::DOUBLE * \"drop\"'}, 6) AS q FROM cache"))
def m5_rule_risk(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", r6(scores.rule_risk(F.col("mean_conf"), F.col("r_d"), F.col("drop"))).alias("q"))


@register("m6_boundary_score", signal_sql(f"SELECT vec_id, round({S_B}, 6) AS s_b FROM sig"))
def m6_boundary_score(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", r6(_s_b()).alias("s_b"))


@register("m7_ambiguity_tiers", signal_sql(f"""SELECT vec_id, round(CASE vec_id % 5 WHEN 0 THEN {S_A} WHEN 1 THEN {CLIP % '1.0 - greatest(0.0, 0.4 - 0.1)'} WHEN 2 THEN {CLIP % '1.0 - list_min(p1)'} WHEN 3 THEN {CLIP % '1.0 - greatest(0.0, 0.6 - 0.15)'} ELSE 0.8 END, 6) AS s_a FROM sig"""))
def m7_ambiguity_tiers(spark, sf_dir):
    i = F.col("vec_id") % 5
    status = F.when(i <= 1, "available").otherwise("missing")
    a = scores.ambiguity_score(status, F.when(i.isin(0, 2), F.col("p1")), F.when(i == 0, F.col("p2")), F.when(i == 1, F.lit(0.4)), F.when(i == 3, F.lit(0.6)))
    return _signals(spark, sf_dir).select("vec_id", r6(a).alias("s_a"))


@register("m8_scaled_entropy", signal_sql(f"SELECT vec_id, round({CLIP % '(v - 0.2) / 0.5'}, 6) AS v, 0.5::DOUBLE AS degenerate FROM sig"))
def m8_scaled_entropy(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", r6(scores.scaled_entropy(F.col("v"), 0.2, 0.7)).alias("v"), scores.scaled_entropy(F.col("v"), 1.0, 1.0).alias("degenerate"))


ROUTE = f"CASE WHEN round({S_B}, 6) >= 0.4 AND round({S_A}, 6) >= 0.9 THEN 'both' WHEN round({S_B}, 6) >= 0.4 THEN 'boundary' WHEN round({S_A}, 6) >= 0.9 THEN 'ambiguity' ELSE 'none' END"


@register("m9_route_types", signal_sql(f"SELECT route, count(*) AS n FROM (SELECT {ROUTE} AS route FROM sig) GROUP BY route"))
def m9_route_types(spark, sf_dir):
    b, a = r6(_s_b()) >= 0.4, r6(_s_a()) >= 0.9
    rows = _signals(spark, sf_dir).select(scores.route(b.cast("double"), a.cast("double"), F.lit(1.0)).alias("route"))
    return rows.groupBy("route").agg(F.count("*").alias("n"))


@register("m10_combined_priority", signal_sql(f"SELECT vec_id, round(greatest({S_B}, {S_A}) + 0.5 * rd, 6) AS q, round({S_B}, 6) AS s_b, round({S_A}, 6) AS s_a FROM sig"))
def m10_combined_priority(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", r6(scores.priority(_s_b(), _s_a(), F.col("rd"))).alias("q"), r6(_s_b()).alias("s_b"), r6(_s_a()).alias("s_a"))


@register("m11_calibrated_route", signal_sql(f"SELECT vec_id, round(greatest(1 / (1 + exp(-(1.5 * {EDGE} + dr - 0.2))), {S_A}), 4) AS q FROM sig"))
def m11_calibrated_route(spark, sf_dir):
    s_b = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5) * scores.edge_blank(F.col("s")) + F.col("dr") - 0.2)))
    return _signals(spark, sf_dir).select("vec_id", F.round(F.greatest(s_b, _s_a()), 4).alias("q"))


@register("m12_edge_blank", signal_sql(f"SELECT vec_id, round({EDGE}, 6) AS b_edge FROM sig"))
def m12_edge_blank(spark, sf_dir):
    return _signals(spark, sf_dir).select("vec_id", r6(scores.edge_blank(F.col("s"))).alias("b_edge"))


@register("m13_suspicious_place", top_sql("SELECT vec_id, list_position(m, list_min(m)) - 1 AS at FROM (SELECT vec_id, list_transform(range(1, 9), lambda i: p1[i] - p2[i]) AS m FROM top)"))
def m13_suspicious_place(spark, sf_dir):
    return _top(spark, sf_dir).select("vec_id", scores.suspicious(F.col("p1"), F.col("p2")).alias("at"))


@register("m14_m15_features", signal_sql(f"SELECT vec_id, round(list_sum(p1) / 8, 6) AS mean_conf, round(list_min(p1), 6) AS min_conf, list_position(p1, list_min(p1)) - 1 AS min_at, round({EDGE}, 6) AS b_edge, round(greatest(0.0, (10 - vec_id % 12) / 10.0::DOUBLE), 6) AS missing FROM sig"))
def m14_m15_features(spark, sf_dir):
    p = F.col("p1")
    return _signals(spark, sf_dir).select("vec_id", r6(ctc.mean(p)).alias("mean_conf"), r6(F.array_min(p)).alias("min_conf"), (F.array_position(p, F.array_min(p)) - 1).alias("min_at"), r6(scores.edge_blank(F.col("s"))).alias("b_edge"), r6(scores.missing_share(F.lit(10), F.col("vec_id") % 12)).alias("missing"))


@register("m16_strategy_dispatch", over_cache("SELECT row_idx, round(CASE row_idx % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1 - conf ELSE 0.5::DOUBLE * (1 - mean_conf) + 0.3::DOUBLE * (1 - min_conf) + 0.2::DOUBLE * \"drop\" + CASE WHEN min_conf < 0.35::DOUBLE THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN \"drop\" > 0.2::DOUBLE THEN 0.1::DOUBLE ELSE 0 END END, 6) AS q FROM cache"))
def m16_strategy_dispatch(spark, sf_dir):
    i = F.col("row_idx") % 3
    return cache(spark, sf_dir).select("row_idx", r6(F.when(i == 0, F.lit(0.0)).when(i == 1, scores.strategy("GCR")).otherwise(scores.strategy("WUR"))).alias("q"))


@register("m17_score_components", over_cache("SELECT row_idx, round(1 - conf, 6) AS score_base, round(0.5::DOUBLE * r_d, 6) AS r_d_part, round((1 - conf) + 0.5::DOUBLE * r_d, 6) AS q FROM cache"))
def m17_score_components(spark, sf_dir):
    part = F.struct(scores.low_confidence().alias("base"), (F.lit(0.5) * F.col("r_d")).alias("r_d"))
    rows = cache(spark, sf_dir).select("row_idx", part.alias("p"))
    return rows.select("row_idx", r6(F.col("p.base")).alias("score_base"), r6(F.col("p.r_d")).alias("r_d_part"), r6(F.col("p.base") + F.col("p.r_d")).alias("q"))


@register("m18_risk_levels", over_cache("SELECT level, count(*) AS n FROM (SELECT CASE WHEN r_d > 0.8::DOUBLE OR coalesce(s > 3.0::DOUBLE, FALSE) THEN 'high' WHEN r_d > 0.5::DOUBLE OR coalesce(s > 2.0::DOUBLE, FALSE) THEN 'medium' ELSE 'low' END AS level FROM (SELECT r_d, CASE WHEN row_idx % 2 = 0 THEN conf * 4 END AS s FROM cache)) GROUP BY level"))
def m18_risk_levels(spark, sf_dir):
    rows = cache(spark, sf_dir).select(scores.risk_level(F.col("r_d"), F.when(F.col("row_idx") % 2 == 0, F.col("conf") * 4)).alias("level"))
    return rows.groupBy("level").agg(F.count("*").alias("n"))


@register("m19_end_confidence", top_sql("SELECT vec_id, least((p1[1] + p1[2]) / 2, (p1[7] + p1[8]) / 2) < 0.25 AS risky FROM top"))
def m19_end_confidence(spark, sf_dir):
    return _top(spark, sf_dir).select("vec_id", scores.end_risk(F.col("p1"), 0.25).alias("risky"))


@register("x15_router_facade", signal_sql(f"SELECT vec_id, round(greatest({S_B}, {S_A}) + 0.5 * rd, 6) AS q, round(greatest({S_B}, {S_A}) + 0.5 * rd, 6) >= 1.0 AS upgrade, {ROUTE} AS route FROM sig"))
def x15_router_facade(spark, sf_dir):
    q = r6(scores.priority(_s_b(), _s_a(), F.col("rd")))
    b, a = r6(_s_b()) >= 0.4, r6(_s_a()) >= 0.9
    return _signals(spark, sf_dir).select("vec_id", q.alias("q"), (q >= 1.0).alias("upgrade"), scores.route(b.cast("double"), a.cast("double"), F.lit(1.0)).alias("route"))


@register("x16_x17_logit_router")
def x16_x17_logit_router(spark, sf_dir):
    """Risk by the highest character entropy; no matrix or no text is low risk, one character is by its own."""
    e = _emission(spark, sf_dir).withColumn("n", (F.col("vec_id") % 9).cast("int"))
    e = e.withColumn("h", ctc.entropy(F.col("e")))
    top = F.array_max(F.transform(ctc.aligned_steps(F.col("e"), F.col("n"))["steps"], lambda s: F.array_max(F.transform(s, lambda i: F.get("h", i)))))
    return e.select("vec_id", F.when(F.col("n") == 0, "low").otherwise(scores.risk_level(top, F.lit(None).cast("double"), (1.9, 3.0), (1.6, 2.0))).alias("risk"))


# -- calibration ---------------------------------------------------------------------------------

def labelled_sql(body):
    return over_cache(body, "y AS (SELECT row_idx, floor(600 * (1 - conf) + 400 * r_d)::BIGINT AS p, CASE WHEN ocr_text <> gt AND row_idx % 3 <> 0 THEN 1 ELSE 0 END AS y FROM cache)")


def _labelled(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", F.floor(600 * (1 - F.col("conf")) + 400 * F.col("r_d")).cast("long").alias("p"), ((F.col("ocr_text") != F.col("gt")) & (F.col("row_idx") % 3 != 0)).cast("int").alias("y"))


@register("l2_auc_and_average_precision", labelled_sql("""SELECT round((sum(mid * pos) - p1 * (p1 + 1) / 2.0) / (p1 * (n - p1)), 6) AS roc_auc, round(sum(pos * cp / cn::DOUBLE) / p1, 6) AS average_precision FROM (
  SELECT p, sum(y) AS pos, sum(count(*)) OVER (ORDER BY p DESC) AS cn, sum(sum(y)) OVER (ORDER BY p DESC) AS cp, sum(count(*)) OVER (ORDER BY p) - (count(*) - 1) / 2.0 AS mid, sum(count(*)) OVER () AS n, sum(sum(y)) OVER () AS p1 FROM y GROUP BY p) GROUP BY n, p1"""))
def l2_auc_and_average_precision(spark, sf_dir):
    return calibration.ranking_quality(_labelled(spark, sf_dir), "p", "y").select(r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("average_precision")).alias("average_precision"))


@register("l3_budget_threshold", labelled_sql("SELECT t AS threshold, round(count(*) FILTER (p >= t) / count(*), 6) AS actual_rate FROM y, (SELECT quantile_cont(p, 0.8) AS t FROM y) GROUP BY t"))
def l3_budget_threshold(spark, sf_dir):
    return calibration.budget_threshold(_labelled(spark, sf_dir), "p", 0.2).select("threshold", r6(F.col("actual_rate")).alias("actual_rate"))


@register("l1_logistic_regression")
def l1_logistic_regression(spark, sf_dir):
    model = calibration.train(_features(spark, sf_dir), ["mean_conf", "min_conf", "drop", "r_d"], "y")
    return spark.createDataFrame([(n, float(w)) for n, w in model.weights.items()] + [("bias", float(model.bias))], "feature string, weight double")


def _features(spark, sf_dir):
    return cache(spark, sf_dir).select("mean_conf", "min_conf", "drop", "r_d", ((F.col("conf") + F.col("r_d") < 0.8) & (F.col("row_idx") % 5 != 3)).cast("int").alias("y"))


@register("l5_feature_ablation")
def l5_feature_ablation(spark, sf_dir):
    return calibration.ablation(_features(spark, sf_dir), ["mean_conf", "min_conf", "drop", "r_d"], "y", "r_d")


@register("l6_feature_preparation")
def l6_feature_preparation(spark, sf_dir):
    from redpen.functions import align

    rows = cache(spark, sf_dir)
    return rows.select("sample_id", "domain", "mean_conf", "min_conf", "drop", align.deletion_by_ops(F.col("ocr_text"), align.edit_ops(F.col("ocr_text"), F.col("gt"))).alias("y_deletion"))


# -- latency and usage ---------------------------------------------------------------------------


@register("a1_corpus_cer", over_cache("SELECT round(sum(levenshtein(replace(ocr_text, ' ', ''), replace(gt, ' ', '')))::DOUBLE / sum(length(replace(gt, ' ', ''))), 6) AS cer FROM cache"))
def a1_corpus_cer(spark, sf_dir):
    n = text.no_spaces
    return cache(spark, sf_dir).agg(r6(text.ratio(F.sum(F.levenshtein(n(F.col("ocr_text")), n(F.col("gt")))), F.sum(F.length(n(F.col("gt")))))).alias("cer"))


@register("a2_exact_accuracy", over_cache("SELECT domain, count(*) FILTER (replace(final_text_if_upgraded, ' ', '') = replace(gt, ' ', '')) / count(*) AS accuracy FROM cache GROUP BY domain"))
def a2_exact_accuracy(spark, sf_dir):
    n = text.no_spaces
    return cache(spark, sf_dir).groupBy("domain").agg((F.count_if(n(F.col("final_text_if_upgraded")) == n(F.col("gt"))) / F.count("*")).alias("accuracy"))


def nonempty_sql(what):
    return over_cache("SELECT " + what + " FROM (SELECT CASE WHEN row_idx % 6 = 0 THEN '' ELSE final_text_if_upgraded END AS t, gt FROM cache) WHERE t <> ''")


def _nonempty(spark, sf_dir):
    return cache(spark, sf_dir).select(F.when(F.col("row_idx") % 6 == 0, "").otherwise(F.col("final_text_if_upgraded")).alias("t"), "gt").where("t <> ''")


@register("a3_cer_without_empty", nonempty_sql("round(sum(levenshtein(t, gt))::DOUBLE / sum(length(gt)), 6) AS cer"))
def a3_cer_without_empty(spark, sf_dir):
    n = text.narrow_marks
    return _nonempty(spark, sf_dir).agg(r6(F.sum(F.levenshtein(n(F.col("t")), n(F.col("gt")))) / F.sum(F.length(n(F.col("gt"))))).alias("cer"))


@register("a4_accuracy_without_empty", nonempty_sql("round(count(*) FILTER (t = gt) / count(*), 6) AS accuracy"))
def a4_accuracy_without_empty(spark, sf_dir):
    return _nonempty(spark, sf_dir).agg(r6(F.count_if(F.col("t") == F.col("gt")) / F.count("*")).alias("accuracy"))


@register("a6_latency_and_tokens", over_cache("SELECT round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms, round(sum(token_usage)::DOUBLE / count(token_usage), 3) AS avg_token_usage, sum(token_usage)::DOUBLE AS total_token_usage, count(latency_ms) AS n_latency_valid, count(token_usage) AS n_token_valid FROM cache"))
def a6_latency_and_tokens(spark, sf_dir):
    return reports.usage(cache(spark, sf_dir))


@register("a13_nearest_lower_p95", over_cache("SELECT domain, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[1 + floor(0.95 * (count(latency_ms) - 1))::INT] AS p95 FROM cache GROUP BY domain"))
def a13_nearest_lower_p95(spark, sf_dir):
    return reports.order_statistic(cache(spark, sf_dir), ["domain"], "latency_ms", lambda n: F.floor(F.lit(0.95) * (n - 1)) + 1, "p95")


@register("a14_provider_report", over_cache("""SELECT error_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[1 + greatest(0, floor(0.95 * count(latency_ms))::INT - 1)] AS p95 FROM cache GROUP BY error_type"""))
def a14_provider_report(spark, sf_dir):
    rows = cache(spark, sf_dir)
    p95 = reports.order_statistic(rows, ["error_type"], "latency_ms", lambda n: F.greatest(F.lit(0), F.floor(F.lit(0.95) * n) - 1) + 1, "p95")
    counts = rows.groupBy("error_type").agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))  # a row per status
    return counts.join(p95, "error_type")


PROFILE = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, min(v) AS low, max(v) AS high"


@register("a15_latency_profile", f"SELECT event_type, {PROFILE} FROM (SELECT event_type, round(value * 100)::BIGINT AS v FROM events) GROUP BY event_type")
def a15_latency_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return reports.profile(rows, ["event_type"], "v")


@register("a16_latency_fields", f"SELECT field, {PROFILE} FROM (SELECT unnest(['lat_a', 'lat_b', 'lat_total']) AS field, unnest([user_id, event_id % 97 - 5, user_id + event_id % 97]) AS v FROM events) WHERE v >= 0 GROUP BY field")
def a16_latency_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lat_a"), (F.col("event_id") % 97 - 5).alias("lat_b"), (F.col("user_id") + F.col("event_id") % 97).alias("lat_total"))
    return reports.profile(rows.unpivot([], ["lat_a", "lat_b", "lat_total"], "field", "v").where("v >= 0"), ["field"], "v")


@register("a23_reliability_rates", over_cache("SELECT round(count(*) FILTER (length(b) > length(gt) * 1.02) / count(*), 6) AS hallucination, round(count(*) FILTER (contains(b, '@')) / count(*), 6) AS format_collapse, round(count(*) FILTER (a = gt AND b <> gt) / count(*), 6) AS over_correction FROM (SELECT ocr_text AS a, final_text_if_upgraded AS b, gt FROM cache)"))
def a23_reliability_rates(spark, sf_dir):
    a, b, gt = F.col("ocr_text"), F.col("final_text_if_upgraded"), F.col("gt")
    share = lambda c: r6(F.count_if(c) / F.count("*"))
    return cache(spark, sf_dir).agg(share(F.length(b) > F.length(gt) * 1.02).alias("hallucination"), share(F.contains(b, F.lit("@"))).alias("format_collapse"), share((a == gt) & (b != gt)).alias("over_correction"))


@register("a26_baseline_cer", over_cache("SELECT round(sum(levenshtein(ocr_text, gt))::DOUBLE / sum(length(gt)), 6) AS base_ocr_cer FROM cache"))
def a26_baseline_cer(spark, sf_dir):
    return cache(spark, sf_dir).agg(r6(F.sum(F.levenshtein("ocr_text", "gt")) / F.sum(F.length("gt"))).alias("base_ocr_cer"))


@register("a28_pipeline_totals", over_cache("SELECT CASE WHEN conf < 0.3::DOUBLE THEN 'high' WHEN conf < 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS risk, count(*) AS n, round(sum(round(levenshtein(ocr_text, gt)::DOUBLE / length(gt) * 1000000)) / count(*) / 1000000, 6) AS cer_before, round(count(*) FILTER (ocr_text <> gt AND final_text_if_upgraded = gt) / count(*), 6) AS fix_rate FROM cache GROUP BY 1"))
def a28_pipeline_totals(spark, sf_dir):
    cer = F.round(F.levenshtein("ocr_text", "gt") / F.length("gt") * 1000000)
    rows = cache(spark, sf_dir).withColumn("risk", F.when(F.col("conf") < 0.3, "high").when(F.col("conf") < 0.6, "medium").otherwise("low"))
    fixed = F.count_if((F.col("ocr_text") != F.col("gt")) & (F.col("final_text_if_upgraded") == F.col("gt")))
    return rows.groupBy("risk").agg(F.count("*").alias("n"), r6(F.sum(cer) / F.count("*") / 1000000).alias("cer_before"), r6(fixed / F.count("*")).alias("fix_rate"))


@register("a29_error_types", over_cache("SELECT error_type, count(*) AS n FROM cache GROUP BY 1"))
def a29_error_types(spark, sf_dir):
    return cache(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n"))


@register("a31_approximate_transitions", over_cache("SELECT greatest(0, cc) AS cc, greatest(0, n - cc) AS cw, greatest(0, fixed) AS wc, greatest(0, wrong - fixed) AS ww FROM (SELECT sum(length(gt)) AS n, sum(length(gt) - levenshtein(final_text_if_upgraded, gt)) AS cc, sum(levenshtein(ocr_text, gt)) AS wrong, sum(levenshtein(ocr_text, gt) - levenshtein(final_text_if_upgraded, gt)) AS fixed FROM cache)"))
def a31_approximate_transitions(spark, sf_dir):
    rows = cache(spark, sf_dir).select(F.length("gt").alias("n"), F.levenshtein("ocr_text", "gt").alias("o"), F.levenshtein("final_text_if_upgraded", "gt").alias("u"))
    t = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("u")).alias("cc"), F.sum("o").alias("wrong"), F.sum(F.col("o") - F.col("u")).alias("fixed"))
    floor = lambda c: F.greatest(F.lit(0), c)
    return t.select(floor(F.col("cc")).alias("cc"), floor(F.col("n") - F.col("cc")).alias("cw"), floor(F.col("fixed")).alias("wc"), floor(F.col("wrong") - F.col("fixed")).alias("ww"))


# -- sources -------------------------------------------------------------------------------------

RECORD = StructType([StructField("id", LongType()), StructField("text", StringType()), StructField("conf", DoubleType()), StructField("hard", BooleanType())])


def _json_lines(spark, sf_dir):
    """Event records as JSON text, every seventh one broken."""
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("value").alias("conf"), (F.col("event_id") % 2 == 0).alias("hard")))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value"))


def _written(spark, kind):
    from redpen.session import shared_dir

    return f"{shared_dir(spark)}/redpen-{kind}-{uuid.uuid4().hex}"


@register("io1_io3_jsonl_round_trip", "SELECT event_id AS id, event_type AS text, value AS conf, event_id % 2 = 0 AS hard FROM events")
def io1_io3_jsonl_round_trip(spark, sf_dir):
    """Rows as JSON lines, read back under their schema."""
    path = _written(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("value").alias("conf"), (F.col("event_id") % 2 == 0).alias("hard")), path)
    return files.read_jsonl(spark, path, RECORD)


@register("io4_io5_csv_round_trip", "SELECT cast(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ',\"' || o_orderpriority END AS note, '' AS extra FROM orders")
def io4_io5_csv_round_trip(spark, sf_dir):
    """Rows as CSV with a header and a column they lack, read back as strings."""
    path = _written(spark, "csv")
    note = F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderstatus", F.lit(',"'), "o_orderpriority"))
    files.write_csv_rows(table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")), path, ["o_orderkey", "note", "extra"])
    return files.read_csv_rows(spark, path)


@register("io8_tolerant_records", "SELECT event_id AS id, event_type AS text, value AS conf, event_id % 2 = 0 AS hard FROM events WHERE event_id % 7 <> 0")
def io8_tolerant_records(spark, sf_dir):
    return files.from_json_lines(_json_lines(spark, sf_dir), "value", RECORD)


@register("io9_router_features", "SELECT event_id % 2 = 0 AS hard, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def io9_router_features(spark, sf_dir):
    return files.from_json_lines(_json_lines(spark, sf_dir), "value", RECORD).groupBy("hard").agg(F.count("*").alias("n"))


@register("io10_io11_row_checks", "SELECT count(*) AS n, count(*) >= 100 AS ok FROM documents")
def io10_io11_row_checks(spark, sf_dir):
    return files.counted(table(spark, sf_dir, "documents"), least=100)


@register("io12_limited_baseline", "SELECT event_id AS id, event_type AS text FROM events WHERE event_id % 7 <> 0 ORDER BY event_id LIMIT 50")
def io12_limited_baseline(spark, sf_dir):
    return files.from_json_lines(_json_lines(spark, sf_dir), "value", RECORD).select("id", "text").orderBy("id").limit(50)


@register("io15_cache_guard", "SELECT (SELECT count(*) FROM labels) AS n_cache, (SELECT count(*) FROM documents) AS n_test, (SELECT count(*) FROM labels) = (SELECT count(*) FROM documents) AS complete")
def io15_cache_guard(spark, sf_dir):
    return files.cache_guard(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


@register("io16_term_dictionary", "SELECT DISTINCT trim(w) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS w FROM benchmark) WHERE trim(w) <> ''")
def io16_term_dictionary(spark, sf_dir):
    return files.dictionary(table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")))


@register("io17_feature_matrix", "SELECT label, count(*) AS n, round(sum(round(embedding[1]::DOUBLE, 5)), 3) AS s FROM embeddings GROUP BY label")
def io17_feature_matrix(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("embedding")[0].cast("double"), 5)), 3).alias("s"))


@register("io22_coerced_numbers", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE cast(user_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def io22_coerced_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("v"))
    return files.numbers(rows, ["v"])


# -- prompts -------------------------------------------------------------------------------------


@register("p1_p7_prompts", over_cache("""SELECT row_idx, 'Read: ' || ocr_text || CASE WHEN row_idx % 3 = 0 THEN ' Look at ' || cast(row_idx % 10 + 1 AS VARCHAR) || '.' ELSE '' END || CASE WHEN domain = 'en' THEN '' ELSE ' Field: ' || domain || '.' END AS targeted, 'Ends of: ' || ocr_text AS boundary,
  'One of ' || substring(ocr_text, 1, 1) || '/' || substring(gt, 1, 1) || ' in ' || ocr_text AS ambiguity, CASE WHEN conf < 0.3::DOUBLE THEN 'Careful: ' ELSE 'Check: ' END || ocr_text AS by_risk FROM cache"""))
def p1_p7_prompts(spark, sf_dir):
    c = F.col
    hint = F.when(c("row_idx") % 3 == 0, files.prompt(" Look at {i}.", i=text.shown_index(c("row_idx") % 10))).otherwise("")
    domain = F.when(c("domain") != "en", files.prompt(" Field: {d}.", d=c("domain"))).otherwise("")
    return cache(spark, sf_dir).select(
        "row_idx",
        files.prompt("Read: {t}{h}{d}", t=c("ocr_text"), h=hint, d=domain).alias("targeted"),
        files.prompt("Ends of: {t}", t=c("ocr_text")).alias("boundary"),
        files.prompt("One of {a}/{b} in {t}", a=F.substring("ocr_text", 1, 1), b=F.substring("gt", 1, 1), t=c("ocr_text")).alias("ambiguity"),
        F.when(c("conf") < 0.3, files.prompt("Careful: {t}", t=c("ocr_text"))).otherwise(files.prompt("Check: {t}", t=c("ocr_text"))).alias("by_risk"),
    )
