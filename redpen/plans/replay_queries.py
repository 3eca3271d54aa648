"""Queries of the offline replay family: scores, ranks, budgets, grids and their reports."""

from __future__ import annotations

from pyspark.sql import Window

from redpen.functions import scores, text
from redpen.operators import replay
from redpen.operators.ranking import ranked, top_k
from redpen.plans.common import CHOSEN_SQL, OUTCOMES_SQL, SCORES_SQL, SUMMARY_SQL, F, cache, chosen_grid, figures, grid_cells, grid_sql, over_cache, r6
from redpen.plans.registry import register

GRID = grid_sql()


@register("x1_replay_gcr_domain", over_cache("""SELECT domain, count(*) AS n_samples, count(*) FILTER (selected) AS n_upgraded, round(count(*) FILTER (selected) / count(*), 4) AS actual_call_rate,
  round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS "CER" FROM chosen GROUP BY domain""", *grid_sql(["GCR"], [0.3])))
def x1_replay_gcr_domain(spark, sf_dir):
    rows = chosen_grid(spark, sf_dir, ["GCR"], [0.3])
    return rows.groupBy("domain").agg(F.count("*").alias("n_samples"), F.count_if("selected").alias("n_upgraded"), F.round(F.count_if("selected") / F.count("*"), 4).alias("actual_call_rate"), r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"))


@register("x1_replay_grid_summary", over_cache(f"SELECT router_name, budget, {SUMMARY_SQL}, abs(count(*) FILTER (selected) / count(*) - max(budget)) <= 0.005 AS call_rate_valid FROM chosen GROUP BY ALL", *GRID))
def x1_replay_grid_summary(spark, sf_dir):
    return replay.grid_summary(replay.outcomes(cache(spark, sf_dir), ()), figures(spark, sf_dir))


@register("x1_replay_per_sample", over_cache("""SELECT sample_id, domain, router_name, round(score, 6) AS router_score, budget, 'offline_replay' AS budget_mode, selected AS selected_for_upgrade, rank AS replay_rank,
  CASE WHEN selected THEN final_text_if_upgraded ELSE ocr_text END AS final_text, CASE WHEN selected THEN latency_ms END AS latency_ms, CASE WHEN selected THEN token_usage END AS token_usage,
  CASE WHEN selected THEN error_type ELSE 'not_upgraded' END AS error_type, CASE WHEN selected THEN 'skipped' ELSE 'not_upgraded' END AS backfill_status, FALSE AS cvr_flag, ok_final AS is_correct_final, ed_final AS edit_distance_final
  FROM chosen""", *grid_sql(["WUR"], [0.3])))
def x1_replay_per_sample(spark, sf_dir):
    return replay.per_sample(cache(spark, sf_dir), "WUR", 0.3)


@register("x4_replay_zero_based_rank", over_cache("SELECT sample_id, rank - 1 AS replay_rank, selected AS selected_for_upgrade, ed_final AS edit_distance_final FROM chosen", *grid_sql(["DWUR"], [0.2])))
def x4_replay_zero_based_rank(spark, sf_dir):
    rows = chosen_grid(spark, sf_dir, ["DWUR"], [0.2], keep=("sample_id",))
    return rows.select("sample_id", (F.col("rank") - 1).alias("replay_rank"), F.col("selected").alias("selected_for_upgrade"), F.col("ed_final").alias("edit_distance_final"))


@register("w1_rank_descending", over_cache("SELECT row_idx, row_number() OVER (ORDER BY 1.0::DOUBLE - conf DESC, row_idx) AS rank FROM cache"))
def w1_rank_descending(spark, sf_dir):
    return ranked(cache(spark, sf_dir).select("row_idx", scores.low_confidence().alias("score")), "score").select("row_idx", "rank")


@register("w2_rank_zero_based_missing", over_cache("SELECT row_idx, row_number() OVER (ORDER BY coalesce(CASE WHEN row_idx % 3 <> 0 THEN conf END, 0) DESC, row_idx) - 1 AS rank FROM cache"))
def w2_rank_zero_based_missing(spark, sf_dir):
    score = F.coalesce(F.when(F.col("row_idx") % 3 != 0, F.col("conf")), F.lit(0.0))
    return ranked(cache(spark, sf_dir).select("row_idx", score.alias("score")), "score").select("row_idx", (F.col("rank") - 1).alias("rank"))


MINCONF_GRID = [OUTCOMES_SQL, "budgets AS (SELECT unnest([0.1, 0.3])::DOUBLE AS budget)",
    "ranked AS (SELECT *, row_number() OVER (ORDER BY 1.0::DOUBLE - min_conf DESC, 1.0::DOUBLE - conf DESC, row_idx) AS rank, count(*) OVER () AS n FROM outcomes)",
    "grid AS (SELECT *, rank <= round_even(n * budget, 0) AS selected FROM ranked, budgets)", CHOSEN_SQL]


def _minconf(spark, sf_dir):
    rows = replay.outcomes(cache(spark, sf_dir), ("domain",)).withColumn("first", F.lit(1.0) - F.col("min_conf"))
    # Equal first keys go by the second: its rank among equals is the tie.
    rows = rows.withColumn("tie", F.struct((F.col("conf") - 1.0).alias("a"), F.col("row_idx").alias("b")))
    return ranked(rows, "first", tie="tie").drop("tie", "first")


@register("w8_two_key_rank", over_cache("SELECT row_idx, rank FROM ranked", *MINCONF_GRID[:3]))
def w8_two_key_rank(spark, sf_dir):
    return _minconf(spark, sf_dir).select("row_idx", "rank")


@register("x6_minconf_replay_nearest_p95", over_cache("""SELECT budget, round(count(*) FILTER (selected) / count(*), 4) AS actual_call_rate, round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS "CER",
  round(count(*) FILTER (accepted)::DOUBLE / count(*) FILTER (selected), 4) AS "AER",
  round(list_sort(list(latency_ms) FILTER (selected AND latency_ms IS NOT NULL))[1 + cast(floor(0.95 * (count(latency_ms) FILTER (selected) - 1)) AS INT)], 3) AS p95_latency_ms FROM chosen GROUP BY budget""", *MINCONF_GRID))
def x6_minconf_replay_nearest_p95(spark, sf_dir):
    rows = _minconf(spark, sf_dir).withColumn("budget", F.explode(F.array(F.lit(0.1), F.lit(0.3))))
    rows = replay.chosen(rows.withColumn("selected", F.col("rank") <= top_k("n", F.col("budget"))))
    latency = F.when(F.col("selected"), F.col("latency_ms"))
    # Nearest lower value: the discrete percentile at the rank of floor(0.95 (n - 1)) + 1.
    counts = rows.where(F.col("selected") & F.col("latency_ms").isNotNull()).groupBy("budget", "latency_ms").agg(F.count("*").alias("c"))
    by = Window.partitionBy("budget")
    counts = counts.withColumn("upto", F.sum("c").over(by.orderBy("latency_ms"))).withColumn("m", F.sum("c").over(by))
    p95 = counts.where(F.col("upto") >= F.floor(F.lit(0.95) * (F.col("m") - 1)) + 1).groupBy("budget").agg(F.round(F.min("latency_ms"), 3).alias("p95_latency_ms"))
    found = rows.groupBy("budget").agg(F.round(F.count_if("selected") / F.count("*"), 4).alias("actual_call_rate"), r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"), F.round(F.count_if("accepted") / F.count_if("selected"), 4).alias("AER"), F.count(latency).alias("k"))
    return found.drop("k").join(p95, "budget")


@register("t1_budget_top_k", over_cache("SELECT router_name, budget, count(*) FILTER (selected) AS k FROM grid GROUP BY ALL", *grid_sql(["GCR", "DGCR"], [0.1, 0.25, 0.33, 0.5, 1.0])[:-1]))
def t1_budget_top_k(spark, sf_dir):
    rows = chosen_grid(spark, sf_dir, ["GCR", "DGCR"], [0.1, 0.25, 0.33, 0.5, 1.0])
    return rows.groupBy("router_name", "budget").agg(F.count_if("selected").alias("k"))


@register("x20_budget_grid", "SELECT i / 100.0::DOUBLE AS budget FROM range(1, 101) t(i)")
def x20_budget_grid(spark, sf_dir):
    return spark.range(1, 101).select((F.col("id") / F.lit(100.0)).alias("budget"))


@register("j12_strategy_budget_cross", over_cache("SELECT router_name, budget, count(*) AS n, sum(rank) AS ranks, count(*) FILTER (selected) AS n_upgraded FROM grid GROUP BY ALL", *GRID[:-1]))
def j12_strategy_budget_cross(spark, sf_dir):
    return chosen_grid(spark, sf_dir).groupBy("router_name", "budget").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"), F.count_if("selected").alias("n_upgraded"))


@register("pf15_score_matrix", over_cache("SELECT row_idx, " + ", ".join(f'round({SCORES_SQL[s]}, 9) AS "{s}"' for s in replay.STRATEGIES) + " FROM cache"))
def pf15_score_matrix(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", *[F.round(scores.strategy(s), 9).alias(s) for s in replay.STRATEGIES])


@register("m1_strategy_scores", over_cache("SELECT router_name, count(*) AS n, max(round(score, 9)) AS top, min(round(score, 9)) AS low, count(*) FILTER (score > 1) AS above_one FROM scored GROUP BY ALL", *GRID[:4]))
def m1_strategy_scores(spark, sf_dir):
    rows = replay.scored(replay.outcomes(cache(spark, sf_dir)))
    return rows.groupBy("router_name").agg(F.count("*").alias("n"), F.max(F.round("score", 9)).alias("top"), F.min(F.round("score", 9)).alias("low"), F.count_if(F.col("score") > 1).alias("above_one"))


# -- reports over the grid -----------------------------------------------------------------------

DOMAIN_AGG = """count(*) AS n_samples, round(count(*) FILTER (selected) / count(*), 4) AS actual_call_rate, round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS "CER", round(count(*) FILTER (ok_final) / count(*), 6) AS final_accuracy"""


def _by(rows, *keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.round(F.count_if("selected") / F.count("*"), 4).alias("actual_call_rate"), r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"), r6(F.count_if("ok_final") / F.count("*")).alias("final_accuracy"))


def _by_cells(cells, *keys):
    n = F.sum("n_rows")
    selected = F.coalesce(F.sum(F.when(F.col("selected"), F.col("n_rows"))), F.lit(0))
    return cells.groupBy(*keys).agg(n.alias("n_samples"), F.round(selected / n, 4).alias("actual_call_rate"), r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"), r6(F.sum("ok_final") / n).alias("final_accuracy"))


@register("a8_domain_breakdown", over_cache(f"SELECT router_name, budget, domain, {DOMAIN_AGG} FROM chosen GROUP BY ALL", *GRID))
def a8_domain_breakdown(spark, sf_dir):
    return _by_cells(grid_cells(spark, sf_dir, ["domain"]), "router_name", "budget", "domain")


@register("a9_breakdown_by_keys", over_cache(f"SELECT source, budget, {DOMAIN_AGG} FROM chosen GROUP BY ALL", *grid_sql(["GCR"])))
def a9_breakdown_by_keys(spark, sf_dir):
    return _by(chosen_grid(spark, sf_dir, ["GCR"], keep=("domain", "source")), "source", "budget")


@register("a10_domain_accuracy", over_cache("SELECT domain, round(count(*) FILTER (ok_final) / count(*), 6) AS accuracy FROM chosen GROUP BY ALL", *grid_sql(["WUR"], [0.2])))
def a10_domain_accuracy(spark, sf_dir):
    return chosen_grid(spark, sf_dir, ["WUR"], [0.2]).groupBy("domain").agg(r6(F.count_if("ok_final") / F.count("*")).alias("accuracy"))


@register("a11_case_counts", over_cache("SELECT router_name, budget, count(*) FILTER (ed_final < ed_ocr) AS improved, count(*) FILTER (ed_final = ed_ocr) AS unchanged, count(*) FILTER (ed_final > ed_ocr) AS worsened FROM chosen WHERE selected GROUP BY ALL", *GRID))
def a11_case_counts(spark, sf_dir):
    u, o = F.col("ed_up"), F.col("ed_ocr")
    kinds = {k: F.when(c, 1).otherwise(0) for k, c in (("improved", u < o), ("unchanged", u == o), ("worsened", u > o))}
    rows = grid_cells(spark, sf_dir, sums=kinds)
    return rows.where("selected").groupBy("router_name", "budget").agg(*[F.sum(k).alias(k) for k in kinds])


@register("a12_mean_std_over_seeds", over_cache("""SELECT budget, floor(sum(c) / count(*)::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS "CER_mean",
    floor(sqrt((count(*) * sum(c * c) - sum(c) * sum(c))::DOUBLE) / count(*)::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS "CER_std", count(*) AS n_seeds
  FROM (SELECT router_name, budget, ((2000000 * sum(ed_final) + sum(gt_len)) // (2 * sum(gt_len)))::BIGINT AS c FROM chosen GROUP BY ALL) GROUP BY budget""", *GRID))
def a12_mean_std_over_seeds(spark, sf_dir):
    """Error rates in whole millionths, so that sums are exact in whatever order they are made."""
    runs = chosen_grid(spark, sf_dir).groupBy("router_name", "budget").agg(F.sum("ed_final").alias("e"), F.sum("gt_len").alias("l"))
    runs = runs.withColumn("c", F.expr("(2000000 * e + l) div (2 * l)"))
    n, s = F.count("*"), F.sum("c")
    millionths = lambda x: F.floor(x + F.lit(0.5)).cast("double") / F.lit(1e6)
    spread = F.sqrt((n * F.sum(F.col("c") * F.col("c")) - s * s).cast("double")) / n.cast("double")
    return runs.groupBy("budget").agg(millionths(s.cast("double") / n.cast("double")).alias("CER_mean"), millionths(spread).alias("CER_std"), n.alias("n_seeds"))


@register("w3_rank_routers_in_domain", over_cache(f"""SELECT domain, budget, router_name, row_number() OVER (PARTITION BY domain, budget ORDER BY "CER", router_name) AS rank_by_cer, "CER", final_accuracy
  FROM (SELECT router_name, budget, domain, {DOMAIN_AGG} FROM chosen GROUP BY ALL)""", *GRID))
def w3_rank_routers_in_domain(spark, sf_dir):
    rows = _by(chosen_grid(spark, sf_dir), "router_name", "budget", "domain")
    return rows.select("domain", "budget", "router_name", F.row_number().over(Window.partitionBy("domain", "budget").orderBy("CER", "router_name")).alias("rank_by_cer"), "CER", "final_accuracy")


CURVE = """curve AS (SELECT router_name, budget, round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS cer, round(sum(ed_ocr)::DOUBLE / sum(gt_len), 6) AS base FROM chosen GROUP BY ALL)"""
GAINS = """gains AS (SELECT *, lag(budget, 1, 0.0::DOUBLE) OVER w AS prev_budget, coalesce(lag(cer) OVER w, base) AS prev_cer FROM curve WINDOW w AS (PARTITION BY router_name ORDER BY budget))"""


@register("w4_gain_curve", over_cache("""SELECT router_name, budget, cer AS "CER", round(prev_cer - cer, 6) AS delta_cer, round((prev_cer - cer) / (budget - prev_budget), 6) AS gain_per_budget,
  row_number() OVER (PARTITION BY router_name ORDER BY round((prev_cer - cer) / (budget - prev_budget), 6) DESC, budget) = 1 AS is_best FROM gains""", *GRID, CURVE, GAINS))
def w4_gain_curve(spark, sf_dir):
    curve = grid_cells(spark, sf_dir).groupBy("router_name", "budget").agg(r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"), r6(F.sum("ed_ocr") / F.sum("gt_len")).alias("base"))
    w = Window.partitionBy("router_name").orderBy("budget")
    before, prior = F.lag("budget", 1, 0.0).over(w), F.coalesce(F.lag("CER").over(w), F.col("base"))
    rows = curve.select("router_name", "budget", "CER", r6(prior - F.col("CER")).alias("delta_cer"), r6((prior - F.col("CER")) / (F.col("budget") - before)).alias("gain_per_budget"))
    best = Window.partitionBy("router_name").orderBy(F.desc("gain_per_budget"), "budget")
    return rows.withColumn("is_best", F.row_number().over(best) == 1)


@register("a25_cost_effectiveness", over_cache("""SELECT router_name, budget, round(greatest(0.0, base - cer), 6) AS absolute_cer_reduction, round(greatest(0.0, base - cer) / base, 6) AS relative_error_reduction,
  round(greatest(0.0, base - cer) / budget, 6) AS errors_reduced_per_call FROM curve""", *GRID, CURVE))
def a25_cost_effectiveness(spark, sf_dir):
    curve = grid_cells(spark, sf_dir).groupBy("router_name", "budget").agg(r6(F.sum("ed_final") / F.sum("gt_len")).alias("cer"), r6(F.sum("ed_ocr") / F.sum("gt_len")).alias("base"))
    cut = F.greatest(F.lit(0.0), F.col("base") - F.col("cer"))
    return curve.select("router_name", "budget", r6(cut).alias("absolute_cer_reduction"), r6(text.ratio(cut, F.col("base"))).alias("relative_error_reduction"), r6(text.ratio(cut, F.col("budget"))).alias("errors_reduced_per_call"))


@register("pf13_official_budgets", over_cache("SELECT router_name, budget, round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS \"CER\" FROM chosen WHERE round(budget, 2) IN (0.1, 0.2, 0.3) GROUP BY ALL", *GRID))
def pf13_official_budgets(spark, sf_dir):
    rows = chosen_grid(spark, sf_dir).where(F.round("budget", 2).isin(0.1, 0.2, 0.3))
    return rows.groupBy("router_name", "budget").agg(r6(F.sum("ed_final") / F.sum("gt_len")).alias("CER"))


@register("a27_tagged_domain_accuracy", over_cache("SELECT router_name, domain, 'offline:' || cast(round(budget * 100) AS INT) AS budget_tag, round(count(*) FILTER (ok_final) / count(*), 6) AS accuracy FROM chosen GROUP BY ALL", *GRID))
def a27_tagged_domain_accuracy(spark, sf_dir):
    rows = chosen_grid(spark, sf_dir).groupBy("router_name", "domain", "budget").agg(r6(F.count_if("ok_final") / F.count("*")).alias("accuracy"))
    return rows.select("router_name", "domain", F.concat(F.lit("offline:"), text.budget_tag(F.col("budget"))).alias("budget_tag"), "accuracy")


@register("t8_pareto_frontier", over_cache("""SELECT router_name, budget, p95, cer FROM (SELECT *, min(cer) OVER (ORDER BY p95, cer, router_name, budget ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM
  (SELECT router_name, budget, round(quantile_cont(CASE WHEN selected THEN latency_ms END, 0.95), 3) AS p95, round(sum(ed_final)::DOUBLE / sum(gt_len), 6) AS cer FROM chosen GROUP BY ALL)) WHERE best IS NULL OR cer < best""", *GRID))
def t8_pareto_frontier(spark, sf_dir):
    points = replay.summary(chosen_grid(spark, sf_dir), ["router_name", "budget"]).select("router_name", "budget", F.col("p95_latency_ms").alias("p95"), F.col("CER").alias("cer"))
    # A point per strategy and budget: a bounded list, so one window over all of it is small.
    before = Window.orderBy("p95", "cer", "router_name", "budget").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("best", F.min("cer").over(before)).where("best is null or cer < best").drop("best")


MODELS = {"M1": 7, "M2": 11, "M3": 13}
MODEL_TEXT_SQL = "CASE row_idx % (CASE model WHEN 'M1' THEN 7 WHEN 'M2' THEN 11 ELSE 13 END) WHEN 0 THEN gt || '!' WHEN 1 THEN ocr_text ELSE gt END"
MODEL_CTE = [f"models AS (SELECT *, {MODEL_TEXT_SQL} AS model_text FROM cache, (SELECT unnest(['M1', 'M2', 'M3']) AS model))"]


def _models(spark, sf_dir):
    """The cache once per model, with that model's reading."""
    i = F.col("row_idx")
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.when(i % p == 0, F.concat("gt", F.lit("!"))).when(i % p == 1, F.col("ocr_text")).otherwise(F.col("gt")).alias("model_text")) for m, p in MODELS.items()])
    return cache(spark, sf_dir).select("*", F.inline(each))


@register("x7_cross_model_budget", over_cache("""SELECT model, round(sum(levenshtein(CASE WHEN rank <= round_even(n * 0.3::DOUBLE, 0) THEN model_text ELSE ocr_text END, gt))::DOUBLE / sum(length(gt)), 6) AS "CER", count(*) FILTER (rank <= round_even(n * 0.3::DOUBLE, 0)) AS n_upgraded
  FROM models JOIN (SELECT row_idx, row_number() OVER (ORDER BY 1.0::DOUBLE - conf DESC, row_idx) AS rank, count(*) OVER () AS n FROM cache) USING (row_idx) GROUP BY model""", *MODEL_CTE))
def x7_cross_model_budget(spark, sf_dir):
    # The rank is made once and holds for every model: a join on row_idx, not on position.
    rank = ranked(cache(spark, sf_dir).select("row_idx", scores.low_confidence().alias("score")), "score").select("row_idx", "rank", "n")
    rows = _models(spark, sf_dir).select("row_idx", "model", F.levenshtein("model_text", "gt").alias("up"), F.levenshtein("ocr_text", "gt").alias("ocr"), F.length("gt").alias("len"))
    sel = F.col("rank") <= top_k("n", F.lit(0.3))
    return rows.join(rank, "row_idx").groupBy("model").agg(r6(F.sum(F.when(sel, F.col("up")).otherwise(F.col("ocr"))) / F.sum("len")).alias("CER"), F.count_if(sel).alias("n_upgraded"))


@register("j5_rank_join_by_row", over_cache("SELECT a.row_idx, a.rank, b.final_text_if_upgraded FROM (SELECT row_idx, row_number() OVER (ORDER BY r_d DESC, row_idx) AS rank FROM cache) a JOIN cache b USING (row_idx)"))
def j5_rank_join_by_row(spark, sf_dir):
    rank = ranked(cache(spark, sf_dir).select("row_idx", "r_d"), "r_d").select("row_idx", "rank")
    return rank.join(cache(spark, sf_dir).select("row_idx", "final_text_if_upgraded"), "row_idx")


@register("j6_three_model_join", over_cache("""SELECT row_idx, d1, d2, d3 FROM (SELECT row_idx, max(levenshtein(model_text, gt)) FILTER (model = 'M1') AS d1, max(levenshtein(model_text, gt)) FILTER (model = 'M2') AS d2, max(levenshtein(model_text, gt)) FILTER (model = 'M3') AS d3
  FROM models GROUP BY row_idx) WHERE greatest(d1, d2, d3) > least(d1, d2, d3)""", *MODEL_CTE))
def j6_three_model_join(spark, sf_dir):
    rows = _models(spark, sf_dir).select("row_idx", "model", F.levenshtein("model_text", "gt").alias("d"))
    # One pivoting aggregate in place of two joins: the same rows, one shuffle.
    d = rows.groupBy("row_idx").agg(*[F.max(F.when(F.col("model") == m, F.col("d"))).alias(f"d{k}") for k, m in enumerate(MODELS, 1)])
    return d.where(F.greatest("d1", "d2", "d3") > F.least("d1", "d2", "d3"))


@register("x13_bounds_comparison", over_cache("""SELECT system, round(sum(levenshtein(t, gt))::DOUBLE / sum(length(gt)), 6) AS "CER", round(count(*) FILTER (t = gt) / count(*), 6) AS accuracy, count(*) AS n FROM (
  SELECT unnest(['a_only', 'b_only', 'a_and_b']) AS system, unnest([ocr_text, final_text_if_upgraded, CASE WHEN 1.0::DOUBLE - conf >= 0.7::DOUBLE THEN final_text_if_upgraded ELSE ocr_text END]) AS t, gt FROM cache) WHERE t <> '' GROUP BY system"""))
def x13_bounds_comparison(spark, sf_dir):
    both = F.when(scores.low_confidence() >= 0.7, F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text"))
    each = F.array(*[F.struct(F.lit(n).alias("system"), t.alias("t")) for n, t in (("a_only", F.col("ocr_text")), ("b_only", F.col("final_text_if_upgraded")), ("a_and_b", both))])
    rows = cache(spark, sf_dir).select("gt", "conf", F.inline(each)).where("t <> ''")
    return rows.groupBy("system").agg(r6(F.sum(F.levenshtein("t", "gt")) / F.sum(F.length("gt"))).alias("CER"), r6(F.count_if(F.col("t") == F.col("gt")) / F.count("*")).alias("accuracy"), F.count("*").alias("n"))


@register("j9_three_system_flags", over_cache("""SELECT sample_id, d_ab < d_a AS ab_better_than_a, CASE WHEN d_b IS NULL THEN FALSE ELSE d_ab < d_b END AS ab_better_than_b FROM (
  SELECT sample_id, levenshtein(ocr_text, gt) AS d_a, CASE WHEN row_idx % 9 <> 0 THEN levenshtein(final_text_if_upgraded, gt) END AS d_b, levenshtein(CASE WHEN conf < 0.3::DOUBLE THEN final_text_if_upgraded ELSE ocr_text END, gt) AS d_ab FROM cache)"""))
def j9_three_system_flags(spark, sf_dir):
    c = cache(spark, sf_dir)
    a = c.select("sample_id", F.levenshtein("ocr_text", "gt").alias("d_a"), F.levenshtein(F.when(F.col("conf") < 0.3, F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text")), F.col("gt")).alias("d_ab"))
    b = c.where(F.col("row_idx") % 9 != 0).select("sample_id", F.levenshtein("final_text_if_upgraded", "gt").alias("d_b"))
    rows = a.join(b, "sample_id", "left")
    return rows.select("sample_id", (F.col("d_ab") < F.col("d_a")).alias("ab_better_than_a"), (F.col("d_b").isNotNull() & (F.col("d_ab") < F.col("d_b"))).alias("ab_better_than_b"))


@register("a22_model_error_styles", over_cache("""SELECT model, count(*) AS n, count(*) FILTER (d < o) AS n_beneficial, count(*) FILTER (d > o) AS n_harmful, round(count(*) FILTER (d > o) / count(*), 6) AS harmful_ratio
  FROM (SELECT model, levenshtein(model_text, gt) AS d, levenshtein(ocr_text, gt) AS o FROM models) GROUP BY model""", *MODEL_CTE))
def a22_model_error_styles(spark, sf_dir):
    rows = _models(spark, sf_dir).select("model", F.levenshtein("model_text", "gt").alias("d"), F.levenshtein("ocr_text", "gt").alias("o"))
    harm = F.count_if(F.col("d") > F.col("o"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("d") < F.col("o")).alias("n_beneficial"), harm.alias("n_harmful"), r6(harm / F.count("*")).alias("harmful_ratio"))


@register("a24_ceiling_metrics", over_cache("""SELECT count(*) FILTER (final_text_if_upgraded <> ocr_text) / count(*) AS change_rate, count(*) FILTER (u < o) / count(*) AS improve_rate, count(*) FILTER (u > o) / count(*) AS worsen_rate, count(*) FILTER (u = o) / count(*) AS same_rate, round(sum(u)::DOUBLE / sum(length(gt)), 6) AS "CER"
  FROM (SELECT *, levenshtein(final_text_if_upgraded, gt) AS u, levenshtein(ocr_text, gt) AS o FROM cache)"""))
def a24_ceiling_metrics(spark, sf_dir):
    rows = cache(spark, sf_dir).select((F.col("final_text_if_upgraded") != F.col("ocr_text")).alias("c"), F.levenshtein("final_text_if_upgraded", "gt").alias("u"), F.levenshtein("ocr_text", "gt").alias("o"), F.length("gt").alias("n"))
    share = lambda c, name: (F.count_if(c) / F.count("*")).alias(name)
    u, o = F.col("u"), F.col("o")
    return rows.agg(share(F.col("c"), "change_rate"), share(u < o, "improve_rate"), share(u > o, "worsen_rate"), share(u == o, "same_rate"), r6(F.sum("u") / F.sum("n")).alias("CER"))


@register("v1_injected_metrics", over_cache("SELECT router_name, budget, count(*) AS n_valid, max(ed_final) AS worst, round(sum(ed_final * ed_final)::DOUBLE / count(*), 6) AS mean_square FROM chosen GROUP BY ALL", *grid_sql(["GCR", "WUR"], [0.2])))
def v1_injected_metrics(spark, sf_dir):
    metric = lambda: [F.max("ed_final").alias("worst"), r6(F.sum(F.col("ed_final") * F.col("ed_final")) / F.count("*")).alias("mean_square")]
    return replay.summary(chosen_grid(spark, sf_dir, ["GCR", "WUR"], [0.2]), ["router_name", "budget"], extra=metric).select("router_name", "budget", "n_valid", "worst", "mean_square")
