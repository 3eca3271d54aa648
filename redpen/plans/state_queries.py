"""Queries of ordered stateful operators, composite pipelines, alignment metrics and plug-ins."""

from __future__ import annotations

from pyspark.sql import Window

from redpen.functions import align, ctc, scores, text
from redpen.operators import edits, plugins, state
from redpen.operators.ranking import ranked, top_k
from redpen.plans.common import SCORES_SQL, F, cache, over_cache, r6, table
from redpen.plans.registry import register

CONFIG = state.BudgetConfig(window=20, warmup=10, gain=0.05, target=0.3)
BREAKER = state.BreakerConfig(min_calls=5, threshold=0.6, cooldown=4)

EVENTS = "ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ((event_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE AS q, event_id % 3 <> 0 AS rejected FROM events)"


def steps_sql(source, run, row, warm=10, window=20, gain=0.05, target=0.3, initial=0.5):
    """Recursive SQL of the controller and the breaker over `source` (run, row, i, q, rejected): `st`."""
    return f"""st AS (
  SELECT {run}, 0::BIGINT AS i, NULL::BIGINT AS {row}, NULL::DOUBLE AS q, NULL::BOOLEAN AS want, NULL::BOOLEAN AS go, NULL::DOUBLE AS before, NULL::DOUBLE AS rate, {initial}::DOUBLE AS lam, TRUE AS warm, []::INTEGER[] AS h, 0 AS calls, 0 AS rej, 0 AS cool
  FROM (SELECT DISTINCT {run} FROM {source})
  UNION ALL
  SELECT {run}, i, {row}, q, want, go, before, rate, CASE WHEN i < {warm} THEN before ELSE least(greatest(before + {gain}::DOUBLE * (rate - {target}::DOUBLE), 0.0::DOUBLE), 2.0::DOUBLE) END, i < {warm}, h, calls, rej,
    CASE WHEN go AND calls >= 5 AND rej / calls::DOUBLE >= 0.6::DOUBLE THEN 4 ELSE greatest(cool - 1, 0) END
  FROM (SELECT *, list_sum(h) / len(h)::DOUBLE AS rate FROM (
    SELECT e.{run}, e.i, e.{row}, e.q, e.q >= s.lam AS want, e.q >= s.lam AND s.cool <= 0 AS go, s.lam AS before,
      list_slice(list_append(s.h, CASE WHEN e.q >= s.lam THEN 1 ELSE 0 END), greatest(1, len(s.h) + 2 - {window}), len(s.h) + 1) AS h,
      s.calls + CASE WHEN e.q >= s.lam AND s.cool <= 0 THEN 1 ELSE 0 END AS calls, s.rej + CASE WHEN e.q >= s.lam AND s.cool <= 0 AND e.rejected THEN 1 ELSE 0 END AS rej, s.cool
    FROM st s JOIN {source} e ON e.{run} = s.{run} AND e.i = s.i + 1)))"""


def of_events(body):
    return f"WITH RECURSIVE {EVENTS}, {steps_sql('ev', 'user_id', 'event_id')}\n{body}"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(F.col("user_id").cast("string").alias("run"), i.alias("row_idx"), ((i * 7919) % 1000).cast("double").__truediv__(F.lit(1000.0)).alias("q"), (i % 3 != 0).alias("rejected"))


def _decided(spark, sf_dir, breaker=None):
    return state.controlled(_events(spark, sf_dir), CONFIG, breaker)


@register("g1_budget_controller", of_events("SELECT event_id, want AS upgrade, round(before, 9) AS lambda_before, round(lam, 9) AS lambda_after FROM st WHERE i > 0"))
def g1_budget_controller(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.col("row_idx").alias("event_id"), "upgrade", F.round("lambda_before", 9).alias("lambda_before"), F.round("lambda_after", 9).alias("lambda_after"))


@register("g2_update_details", of_events("SELECT event_id, round(rate, 9) AS actual_budget, 0.3::DOUBLE AS target_budget, warm AS is_warmup, NOT warm AS updated FROM st WHERE i > 0"))
def g2_update_details(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.col("row_idx").alias("event_id"), F.round("actual_budget", 9).alias("actual_budget"), F.lit(0.3).alias("target_budget"), "is_warmup", (~F.col("is_warmup")).alias("updated"))


@register("g3_decision_only", "SELECT event_id, ((event_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE >= 0.7::DOUBLE AS upgrade FROM events")
def g3_decision_only(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("row_idx").alias("event_id"), (F.col("q") >= 0.7).alias("upgrade"))


@register("g4_g5_controller_stats", of_events("SELECT cast(user_id AS VARCHAR) AS run, count(*) AS sample_count, count(*) FILTER (want) AS total_upgrades, round(arg_max(lam, i), 9) AS lambda_current, count(*) FILTER (want) / count(*) AS total_budget FROM st WHERE i > 0 GROUP BY user_id"))
def g4_g5_controller_stats(spark, sf_dir):
    """One state per run: a new run key is a reset."""
    up = F.count_if("upgrade")
    return _decided(spark, sf_dir).groupBy("run").agg(F.count("*").alias("sample_count"), up.alias("total_upgrades"), F.round(F.max_by("lambda_after", "row_idx"), 9).alias("lambda_current"), (up / F.count("*")).alias("total_budget"))


@register("g6_g8_circuit_breaker", of_events("SELECT event_id, go AS upgrade, want AND NOT go AS blocked, cool > 0 AS breaker_open FROM st WHERE i > 0"))
def g6_g8_circuit_breaker(spark, sf_dir):
    return _decided(spark, sf_dir, BREAKER).select(F.col("row_idx").alias("event_id"), "upgrade", "blocked", "breaker_open")


@register("g9_meltdown_monitor", """SELECT event_id, round(rej / n, 9) AS current_cvr, max(CASE WHEN n >= 20 AND rej / n > 0.7::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS meltdown_active FROM (
  SELECT user_id, event_id, sum(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END) OVER w AS rej, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def g9_meltdown_monitor(spark, sf_dir):
    return state.meltdown(_events(spark, sf_dir), 20, 0.7).select(F.col("row_idx").alias("event_id"), F.round("current_cvr", 9).alias("current_cvr"), "meltdown_active")


@register("w6_budget_stability", """SELECT cast(user_id AS VARCHAR) AS run, count(*) AS n, sum(up) AS n_upgrades, round(coalesce(stddev_pop(rate), 0), 6) AS window_std, round(coalesce(avg(rate), sum(up) / count(*)), 6) AS window_mean, round(coalesce(max(abs(rate - 0.3)), abs(sum(up) / count(*) - 0.3)), 6) AS max_deviation FROM (
  SELECT user_id, up, CASE WHEN count(*) OVER w = 20 THEN sum(up) OVER w / 20.0::DOUBLE END AS rate FROM (SELECT user_id, event_id, CASE WHEN ((event_id * 7919) % 1000) >= 700 THEN 1 ELSE 0 END AS up FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY user_id""")
def w6_budget_stability(spark, sf_dir):
    rows = _events(spark, sf_dir).select("run", "row_idx", (F.col("q") >= 0.7).alias("upgrade"))
    found = state.stability(rows, 20, 0.3)
    return found.select("run", "n", "n_upgrades", *[r6(F.col(c)).alias(c) for c in ("window_std", "window_mean", "max_deviation")])


@register("w7_rolling_budget", "SELECT event_id, round(sum(CASE WHEN ((event_id * 7919) % 1000) >= 700 THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 9) AS actual_budget FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w7_rolling_budget(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("row_idx").rowsBetween(-19, 0)
    return _events(spark, sf_dir).select(F.col("row_idx").alias("event_id"), F.round(F.sum((F.col("q") >= 0.7).cast("int")).over(w) / F.count("*").over(w), 9).alias("actual_budget"))


# -- online pipelines: every document is a run of its lines --------------------------------------

REASON = "CASE WHEN levenshtein(ocr_text, final_text_if_upgraded) > 3 THEN TRUE WHEN length(ocr_text) > 0 AND abs(length(final_text_if_upgraded) - length(ocr_text))::DOUBLE / length(ocr_text) > 0.2::DOUBLE THEN TRUE ELSE FALSE END"
ONLINE = [
    f"ol AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS i, {SCORES_SQL['WUR']} AS q, {REASON} AS rejected FROM cache)",
    steps_sql("ol", "doc_id", "row_idx", warm=5),
]
ONLINE_CONFIG = state.BudgetConfig(window=20, warmup=5, gain=0.05, target=0.3)


def online_sql(body):
    return over_cache(body, *ONLINE).replace("WITH ", "WITH RECURSIVE ", 1)


def _online(spark, sf_dir, breaker=None):
    """Cache rows with their decision; only (run, row, q, rejected) pass through the stateful step."""
    rows = cache(spark, sf_dir)
    rejected = F.coalesce(edits.global_rejection(F.col("ocr_text"), F.col("final_text_if_upgraded")).isNotNull(), F.lit(False))
    feed = rows.select(F.col("doc_id").alias("run"), "row_idx", scores.strategy("WUR").alias("q"), rejected.alias("rejected"))
    decisions = state.controlled(feed, ONLINE_CONFIG, breaker).drop("run", "q")
    return rows.withColumn("rejected", rejected).join(decisions, "row_idx")


@register("x2_online_replay", online_sql("""SELECT domain, count(*) AS n_valid, count(*) FILTER (want) AS n_upgraded, round(count(*) FILTER (want) / count(*), 4) AS actual_call_rate, count(*) FILTER (want AND ol.row_idx % 4 = 0) AS missing_cached_rows,
  round(sum(levenshtein(CASE WHEN want AND ol.row_idx % 4 <> 0 THEN final_text_if_upgraded ELSE ocr_text END, gt))::DOUBLE / sum(length(gt)), 6) AS "CER" FROM ol JOIN st USING (row_idx) GROUP BY domain"""))
def x2_online_replay(spark, sf_dir):
    rows = _online(spark, sf_dir)
    hit = F.col("row_idx") % 4 != 0
    final = F.when(F.col("upgrade") & hit, F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text"))
    up = F.count_if("upgrade")
    return rows.groupBy("domain").agg(F.count("*").alias("n_valid"), up.alias("n_upgraded"), F.round(up / F.count("*"), 4).alias("actual_call_rate"), F.count_if(F.col("upgrade") & ~hit).alias("missing_cached_rows"), r6(F.sum(F.levenshtein(final, "gt")) / F.sum(F.length("gt"))).alias("CER"))


@register("x5_online_with_breaker", online_sql("""SELECT domain, count(*) FILTER (go) AS n_upgraded, count(*) FILTER (want AND NOT go) AS n_blocked, count(*) FILTER (go AND ol.rejected) AS n_rejected, count(*) FILTER (go AND NOT ol.rejected AND final_text_if_upgraded <> ocr_text) AS n_accepted,
  round(sum(levenshtein(CASE WHEN go AND NOT ol.rejected THEN final_text_if_upgraded ELSE ocr_text END, gt))::DOUBLE / sum(length(gt)), 6) AS "CER" FROM ol JOIN st USING (row_idx) GROUP BY domain"""))
def x5_online_with_breaker(spark, sf_dir):
    rows = _online(spark, sf_dir, BREAKER)
    ok = F.col("upgrade") & ~F.col("rejected")
    final = F.when(ok, F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text"))
    return rows.groupBy("domain").agg(F.count_if("upgrade").alias("n_upgraded"), F.count_if("blocked").alias("n_blocked"), F.count_if(F.col("upgrade") & F.col("rejected")).alias("n_rejected"), F.count_if(ok & (F.col("final_text_if_upgraded") != F.col("ocr_text"))).alias("n_accepted"), r6(F.sum(F.levenshtein(final, "gt")) / F.sum(F.length("gt"))).alias("CER"))


PIPE = f"""pipe AS (SELECT *, rank <= round_even(n * 0.3::DOUBLE, 0) AS sel FROM (SELECT *, row_number() OVER (ORDER BY {SCORES_SQL['WUR']} DESC, row_idx) AS rank, count(*) OVER () AS n, {REASON} AS rejected FROM cache))"""


@register("x3_pipeline_with_backfill", over_cache("""SELECT count(*) FILTER (sel) AS n_upgraded, round(count(*) FILTER (sel AND rejected) / count(*) FILTER (sel), 4) AS "CVR", round(count(*) FILTER (sel AND NOT rejected AND final_text_if_upgraded <> ocr_text) / count(*) FILTER (sel), 4) AS "AER",
  round(sum(levenshtein(CASE WHEN sel AND NOT rejected THEN final_text_if_upgraded ELSE ocr_text END, gt))::DOUBLE / sum(length(gt)), 6) AS "CER" FROM pipe""", PIPE))
def x3_pipeline_with_backfill(spark, sf_dir):
    rows = cache(spark, sf_dir)
    rejected = edits.global_rejection(F.col("ocr_text"), F.col("final_text_if_upgraded")).isNotNull()
    slim = rows.select("row_idx", scores.strategy("WUR").alias("score"), rejected.alias("rejected"), (F.col("final_text_if_upgraded") != F.col("ocr_text")).alias("changed"), F.levenshtein("ocr_text", "gt").alias("o"), F.levenshtein("final_text_if_upgraded", "gt").alias("u"), F.length("gt").alias("len"))
    found = ranked(slim, "score").withColumn("sel", F.col("rank") <= top_k("n", F.lit(0.3)))
    ok, up = F.col("sel") & ~F.col("rejected"), F.count_if("sel")
    return found.agg(up.alias("n_upgraded"), F.round(F.count_if(F.col("sel") & F.col("rejected")) / up, 4).alias("CVR"), F.round(F.count_if(ok & F.col("changed")) / up, 4).alias("AER"), r6(F.sum(F.when(ok, F.col("u")).otherwise(F.col("o"))) / F.sum("len")).alias("CER"))


@register("x11_frontier_per_model", over_cache(f"""SELECT model, round(sum(levenshtein(CASE WHEN sel AND levenshtein(ocr_text, t) <= 3 THEN t ELSE ocr_text END, gt))::DOUBLE / sum(length(gt)), 6) AS "CER" FROM (
  SELECT *, CASE model WHEN 'M1' THEN final_text_if_upgraded ELSE gt || 'zzzz' END AS t FROM pipe, (SELECT unnest(['M1', 'M2']) AS model)) GROUP BY model""", PIPE))
def x11_frontier_per_model(spark, sf_dir):
    rows = ranked(cache(spark, sf_dir).withColumn("score", scores.strategy("WUR")).select("row_idx", "score", "ocr_text", "final_text_if_upgraded", "gt"), "score")
    each = F.array(F.struct(F.lit("M1").alias("model"), F.col("final_text_if_upgraded").alias("t")), F.struct(F.lit("M2").alias("model"), F.concat("gt", F.lit("zzzz")).alias("t")))
    rows = rows.select("rank", "n", "ocr_text", "gt", F.inline(each))
    near = F.levenshtein(F.col("ocr_text"), F.col("t"), 3) >= 0
    final = F.when((F.col("rank") <= top_k("n", F.lit(0.3))) & near, F.col("t")).otherwise(F.col("ocr_text"))
    return rows.groupBy("model").agg(r6(F.sum(F.levenshtein(final, "gt")) / F.sum(F.length("gt"))).alias("CER"))


@register("x12_integrated_pipeline")
def x12_integrated_pipeline(spark, sf_dir):
    """Route, gate by the meltdown monitor of earlier rows, validate, and log the outcome."""
    rows = _online(spark, sf_dir).where("upgrade").withColumn("run", F.col("doc_id").cast("string"))
    found = state.meltdown(rows, 20, 0.3)
    before = Window.partitionBy("run").orderBy("row_idx")
    closed = F.coalesce(F.lag("meltdown_active").over(before), F.lit(False))
    action = F.when(closed, "meltdown_skip").when(F.col("rejected"), "rejected").otherwise("accepted")
    return found.select("sample_id", "domain", action.alias("action"), F.when(action == "accepted", F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text")).alias("final_text"))


@register("x14_legacy_row_processing", over_cache("SELECT sample_id, CASE WHEN conf < 0.4::DOUBLE THEN 'hard' ELSE 'easy' END AS route, round(levenshtein(CASE WHEN conf < 0.4::DOUBLE THEN final_text_if_upgraded ELSE ocr_text END, gt)::DOUBLE / length(gt), 6) AS cer_after FROM cache"))
def x14_legacy_row_processing(spark, sf_dir):
    hard = F.col("conf") < 0.4
    final = F.when(hard, F.col("final_text_if_upgraded")).otherwise(F.col("ocr_text"))
    return cache(spark, sf_dir).select("sample_id", F.when(hard, "hard").otherwise("easy").alias("route"), r6(F.levenshtein(final, "gt") / F.length("gt")).alias("cer_after"))


@register("x10_full_call_cache")
def x10_full_call_cache(spark, sf_dir):
    return plugins.called(cache(spark, sf_dir), plugins.expert("echo"), ["ocr_text"], "row_idx", "ocr_text")


@register("v5_mock_recogniser", "SELECT doc_id, CASE lang WHEN 'en' THEN 'hello' WHEN 'de' THEN 'hallo' ELSE '' END AS t FROM documents")
def v5_mock_recogniser(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", plugins.mocked(F.col("lang"), {"en": "hello", "de": "hallo"}).alias("t"))


@register("x18_emission_to_cache_rows")
def x18_emission_to_cache_rows(spark, sf_dir):
    from redpen.plans.score_queries import _emission

    rows = _emission(spark, sf_dir).withColumns({"g": ctc.greedy(F.col("e")), "s": ctc.boundary_stats(F.col("e"))})
    return rows.select("vec_id", F.array_join(F.transform("g.classes", lambda c: F.substring(F.lit("-abcdefg"), c + 1, F.lit(1))), "").alias("T_A"), F.col("g.confidence").alias("conf"), scores.edge_blank(F.col("s")).alias("b_edge"))


@register("x19_stepwise_augmentation", over_cache("""SELECT row_idx, r AS ratio FROM (SELECT row_idx, min(r) AS r FROM (SELECT row_idx, gt, unnest([0.05, 0.1, 0.2])::DOUBLE AS r FROM cache) WHERE length(gt) - floor(length(gt) * r) <= length(gt) - 3 GROUP BY row_idx)"""))
def x19_stepwise_augmentation(spark, sf_dir):
    n = F.length("gt")
    found = plugins.first_passing(cache(spark, sf_dir).select("row_idx", "gt"), "row_idx", [0.2, 0.05, 0.1], lambda r: n - F.floor(n * r), lambda left: left <= n - 3)
    return found.select("row_idx", "ratio")


# -- alignment -----------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Both readings aligned with the truth, each pair once."""
    return cache(spark, sf_dir).select("row_idx", "sample_id", "error_type", "conf", "gt", "ocr_text", align.aligned(F.col("ocr_text"), F.col("gt")).alias("a"), align.aligned(F.col("final_text_if_upgraded"), F.col("gt")).alias("s"))


@register("s8_alignment_cer")
def s8_alignment_cer(spark, sf_dir):
    a = F.col("a")
    errors = a["substitutions"] + a["deletions"] + a["insertions"]
    return _pairs(spark, sf_dir).select("row_idx", a["substitutions"].alias("s"), a["deletions"].alias("d"), a["insertions"].alias("i"), text.ratio(errors, F.length("gt")).alias("cer"))


@register("s9_s14_boundary_deletions")
def s9_s14_boundary_deletions(spark, sf_dir):
    a = F.col("a")
    guarded = a["boundary_deletion"] & (F.abs(F.length("ocr_text") - F.length("gt")) <= F.length("gt") * 0.5)
    return _pairs(spark, sf_dir).select("row_idx", a["boundary_deletion"].alias("flag"), a["substitutions"].alias("substitutions"), a["left_deletions"].alias("left"), a["right_deletions"].alias("right"), a["middle_deletions"].alias("middle"), guarded.alias("guarded"))


@register("s11_opcodes")
def s11_opcodes(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_idx", F.explode("a.opcodes").alias("o")).select("row_idx", "o.*")


@register("s13_deletion_by_edit_ops")
def s13_deletion_by_edit_ops(spark, sf_dir):
    rows = cache(spark, sf_dir)
    return rows.select("row_idx", align.deletion_by_ops(F.col("ocr_text"), align.edit_ops(F.col("ocr_text"), F.col("gt"))).alias("label"))


@register("r1_r4_over_correction")
def r1_r4_over_correction(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_idx", align.over_correction(F.col("a"), F.col("s"), F.col("gt")).alias("r")).select("row_idx", "r.*")


@register("r2_r6_correction_rate")
def r2_r6_correction_rate(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_idx", align.correction(F.col("a"), F.col("s"), F.col("gt")).alias("r")).select("row_idx", "r.*")


@register("a5_extended_metrics")
def a5_extended_metrics(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    hit, up = F.col("a.boundary_deletion"), F.col("conf") < 0.3
    subs = F.when(up, F.col("s.substitutions")).otherwise(F.col("a.substitutions"))
    return rows.agg(r6(text.ratio(F.count_if(hit & up), F.count_if(hit))).alias("boundary_deletion_recall"), r6(text.ratio(F.sum(subs), F.sum(F.length("gt")))).alias("substitution_cer"))


@register("a17_full_audit")
def a17_full_audit(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    r, c = align.over_correction(F.col("a"), F.col("s"), F.col("gt")), align.correction(F.col("a"), F.col("s"), F.col("gt"))
    rows = rows.select("error_type", F.col("a.substitutions").alias("s"), F.col("a.deletions").alias("d"), F.col("a.insertions").alias("i"), r["ratio"].alias("ocr_r"), c["ratio"].alias("cr"), F.col("a.boundary_deletion").alias("bd"))
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), F.sum("s").alias("substitutions"), F.sum("d").alias("deletions"), F.sum("i").alias("insertions"), r6(F.avg("ocr_r")).alias("ocr_r"), r6(F.avg("cr")).alias("correction_rate"), F.count_if("bd").alias("boundary_deletions"))


@register("a18_transition_matrix")
def a18_transition_matrix(spark, sf_dir):
    """Truth characters by right or wrong before and after; also the set operations U4 and U5."""
    both = F.size(F.array_intersect("a.equal_positions", "s.equal_positions"))
    fixed = F.size(F.array_intersect("a.wrong_positions", "s.equal_positions"))
    lost = F.size(F.array_except("a.equal_positions", "s.equal_positions"))
    rows = _pairs(spark, sf_dir).select(both.alias("cc"), lost.alias("cw"), fixed.alias("wc"), (F.size("a.wrong_positions") - fixed).alias("ww"))
    return rows.agg(*[F.sum(c).alias(c) for c in ("cc", "cw", "wc", "ww")])


@register("a30_edit_op_coverage")
def a30_edit_op_coverage(spark, sf_dir):
    rows = cache(spark, sf_dir).select("row_idx", F.length("ocr_text").alias("n"), "final_text_if_upgraded", F.explode(align.edit_ops(F.col("ocr_text"), F.col("gt"))).alias("o"))
    edge = (F.col("o.src") < 2) | (F.col("o.src") >= F.col("n") - 2)
    return rows.groupBy(F.col("o.op").alias("op")).agg(F.count("*").alias("n"), F.count_if(edge).alias("at_edge"))


