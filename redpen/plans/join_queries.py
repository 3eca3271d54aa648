"""Queries of sources, schema adaptation, joins, merges and set operations."""

from __future__ import annotations

from pyspark.sql import Window

from redpen.functions import text
from redpen.operators import joins
from redpen.plans.common import F, cache, over_cache, r6, table, whole_sum
from redpen.plans.registry import register

TURNS = "turns AS (SELECT conv_id AS k, turn, role, length(text) AS n FROM conversations)"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), "turn", "role", F.length("text").cast("long").alias("n"))


@register("j1_index_first", f"WITH {TURNS} SELECT k, turn, role, n FROM turns QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn) = 1")
def j1_index_first(spark, sf_dir):
    return joins.unique(_turns(spark, sf_dir), "k", "turn", "first")


@register("j1_index_last", f"WITH {TURNS} SELECT k, turn, role, n FROM turns QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC) = 1")
def j1_index_last(spark, sf_dir):
    return joins.unique(_turns(spark, sf_dir), "k", "turn", "last")


@register("j1_index_error_keys", f"WITH {TURNS} SELECT k, count(*) AS n_rows FROM turns GROUP BY k HAVING count(*) > 1")
def j1_index_error_keys(spark, sf_dir):
    return joins.duplicates(_turns(spark, sf_dir), "k")


@register("j2_lookup_last_nonempty", f"WITH {TURNS} SELECT k, turn, role FROM turns WHERE role <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC) = 1")
def j2_lookup_last_nonempty(spark, sf_dir):
    return joins.unique(_turns(spark, sf_dir).where("role <> ''"), "k", "turn", "last").select("k", "turn", "role")


CACHED = "cached AS (SELECT * FROM cache WHERE row_idx % 4 <> 0)"


@register("j3_decisions_to_cache", over_cache("""SELECT count(*) AS n, count(*) FILTER (up) AS n_upgraded, count(*) FILTER (up AND c.row_idx IS NULL) AS missing_cached_rows,
  sum(levenshtein(CASE WHEN up AND c.row_idx IS NOT NULL THEN coalesce(nullif(c.final_text_if_upgraded, ''), d.ocr_text) ELSE d.ocr_text END, d.gt)) AS errors
  FROM (SELECT *, conf < 0.4::DOUBLE AS up FROM cache) d LEFT JOIN cached c ON d.row_idx = c.row_idx""", CACHED))
def j3_decisions_to_cache(spark, sf_dir):
    rows = cache(spark, sf_dir)
    decided = rows.select("row_idx", "ocr_text", "gt", (F.col("conf") < 0.4).alias("up"))
    cached = rows.where("row_idx % 4 <> 0").select("row_idx", F.col("final_text_if_upgraded").alias("up_text"), F.lit(True).alias("hit"))
    found = joins.from_cache(decided, cached, "row_idx")
    final = F.when(F.col("up") & F.col("hit"), F.coalesce(F.nullif("up_text", F.lit("")), F.col("ocr_text"))).otherwise(F.col("ocr_text"))
    return found.agg(F.count("*").alias("n"), F.count_if("up").alias("n_upgraded"), F.count_if(F.col("up") & ~F.col("hit")).alias("missing_cached_rows"), F.sum(F.levenshtein(final, "gt")).alias("errors"))


@register("j4_strict_join", over_cache("SELECT d.source, count(*) AS n, sum(levenshtein(c.ocr_text, d.gt)) AS errors FROM lines d JOIN cache c USING (row_idx) GROUP BY d.source"))
def j4_strict_join(spark, sf_dir):
    from redpen.sources.recognition import lines

    rows = joins.strict(lines(spark, sf_dir).select("row_idx", "source", "gt"), cache(spark, sf_dir).select("row_idx", "ocr_text"), "row_idx")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.levenshtein("ocr_text", "gt")).alias("errors"))


@register("j4_strict_join_misses", over_cache("SELECT row_idx FROM cache WHERE row_idx NOT IN (SELECT row_idx FROM cached)", CACHED))
def j4_strict_join_misses(spark, sf_dir):
    rows = cache(spark, sf_dir).select("row_idx")
    return joins.misses(rows, rows.where("row_idx % 4 <> 0"), "row_idx")


@register("j7_semi_join_ids", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j7_semi_join_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(ids, "doc_id", "left_semi")


@register("j8_upsert_merge", """SELECT doc_id, lang, source, NULL::INT AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, NULL, NULL, quality FROM labels""")
def j8_upsert_merge(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return joins.upsert(base, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


SIG = "sha256(concat_ws('|', domain, source, gt))"


@register("j10_content_signature_join", over_cache(f"SELECT count(*) AS n, count(DISTINCT {SIG}) AS signatures, sum(first_row) AS first_rows FROM cache JOIN (SELECT {SIG} AS sig, min(row_idx) AS first_row FROM cache GROUP BY 1) ON sig = {SIG}"))
def j10_content_signature_join(spark, sf_dir):
    rows = cache(spark, sf_dir).select("row_idx", joins.signature("domain", "source", "gt").alias("sig"))
    firsts = rows.groupBy("sig").agg(F.min("row_idx").alias("first_row"))
    return rows.join(firsts, "sig").agg(F.count("*").alias("n"), F.count_distinct("sig").alias("signatures"), whole_sum("first_row").alias("first_rows"))


@register("j11_signature_reader", over_cache(f"SELECT sig, ocr_text FROM (SELECT {SIG} AS sig, ocr_text, row_idx FROM cache) QUALIFY row_number() OVER (PARTITION BY sig ORDER BY row_idx) = 1"))
def j11_signature_reader(spark, sf_dir):
    rows = cache(spark, sf_dir).select("row_idx", joins.signature("domain", "source", "gt").alias("sig"), "ocr_text")
    return joins.unique(rows, "sig", "row_idx", "first").drop("row_idx")


TERMS = """terms AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS domain, lower(w) AS term
  FROM (SELECT item_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 4)"""


@register("j13_dictionary_containment", over_cache("""SELECT row_idx, hits, round(least(hits / 3.0::DOUBLE, 1.0::DOUBLE), 6) AS r_d FROM (
  SELECT row_idx, sum(n)::BIGINT AS hits FROM (
    SELECT row_idx, domain, n, substring(t, i, n) AS piece FROM
      (SELECT row_idx, CASE WHEN domain IN ('en', 'de') THEN domain ELSE 'en' END AS domain, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT row_idx, domain, lower(gt) AS t FROM lines))
      CROSS JOIN (SELECT DISTINCT length(term) AS n FROM terms) WHERE i + n - 1 <= length(t)) p
  JOIN terms ON terms.domain = p.domain AND terms.term = p.piece GROUP BY row_idx)""", TERMS))
def j13_dictionary_containment(spark, sf_dir):
    from redpen.sources.recognition import lines

    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("length(w) >= 4")
    words = words.select(F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("domain"), F.lower("w").alias("term")).distinct()
    found = joins.contained(lines(spark, sf_dir).select("row_idx", "domain", F.lower("gt").alias("t")), words, "row_idx", "t", "term", "domain", "en")
    return found.select("row_idx", "hits", r6(joins.domain_risk(F.col("hits"))).alias("r_d"))


@register("j14_enrich_by_small_map", "SELECT d.doc_id, m.label FROM documents d JOIN (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French')) m(lang, label) USING (lang)")
def j14_enrich_by_small_map(spark, sf_dir):
    return joins.mapped(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": "English", "de": "German", "fr": "French"}, "label").select("doc_id", "label")


@register("j15_compare_systems_by_budget", """SELECT budget, a, b, round(a - b, 6) AS delta FROM (SELECT round(l_discount, 2) AS budget, round(sum(l_quantity) / count(*), 6) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
  JOIN (SELECT round(l_discount, 2) AS budget, round(sum(l_quantity) / count(*), 6) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (budget)""")
def j15_compare_systems_by_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.round("l_discount", 2).alias("budget"), "l_returnflag").agg(r6(F.sum("l_quantity") / F.count("*")).alias("v"))
    a, b = (rows.where(F.col("l_returnflag") == f).select("budget", F.col("v").alias(n)) for f, n in (("A", "a"), ("R", "b")))
    return a.join(b, "budget").withColumn("delta", r6(F.col("a") - F.col("b")))


@register("j16_ocr_lookup", over_cache("SELECT sample_id, ocr_text, conf FROM cached", CACHED))
def j16_ocr_lookup(spark, sf_dir):
    rows = cache(spark, sf_dir)
    return rows.where("row_idx % 4 <> 0").select("sample_id").join(rows.select("sample_id", "ocr_text", "conf"), "sample_id")


@register("j17_vlm_lookup_with_fallback", over_cache("""SELECT a.sample_id, CASE WHEN c.row_idx IS NULL THEN a.ocr_text ELSE coalesce(nullif(CASE WHEN a.row_idx % 5 <> 0 THEN c.final_text_if_upgraded ELSE '' END, ''), c.gt) END AS answer,
  CASE WHEN c.row_idx IS NULL THEN 'cached_result_missing' ELSE c.error_type END AS error_type FROM cache a LEFT JOIN cached c ON a.row_idx = c.row_idx""", CACHED))
def j17_vlm_lookup_with_fallback(spark, sf_dir):
    rows = cache(spark, sf_dir)
    cached = rows.where("row_idx % 4 <> 0").select("row_idx", F.when(F.col("row_idx") % 5 != 0, F.col("final_text_if_upgraded")).otherwise("").alias("corrected"), F.col("gt").alias("raw"), F.col("error_type").alias("error"), F.lit(True).alias("hit"))
    found = joins.from_cache(rows.select("row_idx", "sample_id", "ocr_text"), cached, "row_idx")
    answer = F.when(F.col("hit"), F.coalesce(F.nullif("corrected", F.lit("")), F.col("raw"))).otherwise(F.col("ocr_text"))
    return found.select("sample_id", answer.alias("answer"), F.when(F.col("hit"), F.col("error")).otherwise("cached_result_missing").alias("error_type"))


# -- adaptation ----------------------------------------------------------------------------------

RAW = """raw AS (SELECT row_idx, CASE WHEN row_idx % 3 <> 0 THEN conf END AS conf, CASE WHEN row_idx % 4 <> 0 THEN mean_conf END AS mean_conf, CASE WHEN row_idx % 5 <> 0 THEN min_conf END AS min_conf,
  CASE WHEN row_idx % 2 = 0 THEN 'a/' || sample_id END AS image_path, CASE WHEN row_idx % 2 = 1 THEN 'b/' || sample_id END AS img_path, CASE WHEN row_idx % 7 <> 0 THEN r_d END AS r_d FROM cache)"""


def _raw(spark, sf_dir):
    i = F.col("row_idx")
    c = cache(spark, sf_dir)
    keep = lambda m, n: F.when(i % m != 0, F.col(n)).alias(n)
    return c.select("row_idx", keep(3, "conf"), keep(4, "mean_conf"), keep(5, "min_conf"), F.when(i % 2 == 0, F.concat(F.lit("a/"), "sample_id")).alias("image_path"), F.when(i % 2 == 1, F.concat(F.lit("b/"), "sample_id")).alias("img_path"), keep(7, "r_d"))


@register("pf1_fill_defaults", over_cache("""SELECT row_idx, c AS conf, coalesce(mean_conf, c) AS mean_conf, coalesce(min_conf, c) AS min_conf, coalesce(image_path, img_path) AS image_path, coalesce(img_path, image_path) AS img_path, coalesce(r_d, 0) AS r_d
  FROM (SELECT *, coalesce(conf, mean_conf, min_conf, 0) AS c FROM raw)""", RAW))
def pf1_fill_defaults(spark, sf_dir):
    return joins.filled(_raw(spark, sf_dir))


@register("pf2_adapt_aliases", over_cache("""SELECT sample_id, coalesce(o, t_a) AS ocr_text, coalesce(g, t_gt) AS gt, levenshtein(coalesce(o, t_a), coalesce(g, t_gt)) AS edit_distance_ocr FROM (SELECT sample_id, CASE WHEN row_idx % 2 = 0 THEN ocr_text END AS o, ocr_text AS t_a, CASE WHEN row_idx % 3 = 0 THEN gt END AS g, gt AS t_gt FROM cache)"""))
def pf2_adapt_aliases(spark, sf_dir):
    rows = cache(spark, sf_dir).select("sample_id", F.when(F.col("row_idx") % 2 == 0, F.col("ocr_text")).alias("ocr_text"), F.col("ocr_text").alias("T_A"), F.when(F.col("row_idx") % 3 == 0, F.col("gt")).alias("gt"), F.col("gt").alias("T_GT"))
    return joins.aliased(rows, {"ocr_text": ["ocr_text", "T_A"], "gt": ["gt", "T_GT"]}, keep=["sample_id"]).withColumn("edit_distance_ocr", F.levenshtein("ocr_text", "gt"))


@register("pf3_truthy_fallback", over_cache("SELECT sample_id, coalesce(nullif(a, ''), nullif(b, ''), 'none') AS v FROM (SELECT sample_id, CASE WHEN row_idx % 2 = 0 THEN '' ELSE ocr_text END AS a, CASE WHEN row_idx % 3 = 0 THEN '' ELSE gt END AS b FROM cache)"))
def pf3_truthy_fallback(spark, sf_dir):
    rows = cache(spark, sf_dir).select("sample_id", F.when(F.col("row_idx") % 2 == 0, "").otherwise(F.col("ocr_text")).alias("a"), F.when(F.col("row_idx") % 3 == 0, "").otherwise(F.col("gt")).alias("b"))
    return rows.select("sample_id", joins.truthy("a", "b", default="none").alias("v"))


@register("pf4_valid_rows", "SELECT count(*) FILTER (text IS NOT NULL AND text <> '') AS n_valid, count(*) FILTER (text IS NULL OR text = '') AS n_invalid FROM documents")
def pf4_valid_rows(spark, sf_dir):
    good = F.col("text").isNotNull() & (F.col("text") != "")
    return table(spark, sf_dir, "documents").agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_invalid"))


@register("pf5_protocol_records", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, lang AS domain, length(text) AS gt_char_len FROM documents WHERE text <> ''")
def pf5_protocol_records(spark, sf_dir):
    split = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train")
    record = F.struct(F.struct(F.col("lang").alias("domain"), split.alias("split"), F.length("text").cast("long").alias("gt_char_len")).alias("metadata"))
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", record.alias("r")).select("doc_id", "r.metadata.split", "r.metadata.domain", "r.metadata.gt_char_len")


@register("pf6_final_of_nested_record", over_cache("SELECT sample_id, CASE WHEN conf < 0.5 AND final_text_if_upgraded <> '' AND error_type = 'none' THEN final_text_if_upgraded ELSE ocr_text END AS final_text FROM cache"))
def pf6_final_of_nested_record(spark, sf_dir):
    c = cache(spark, sf_dir)
    nested = c.select("sample_id", F.struct(F.col("ocr_text").alias("text")).alias("agent_a"), F.struct((F.col("conf") < 0.5).alias("is_hard")).alias("router"), F.struct(F.col("final_text_if_upgraded").alias("text"), (F.col("error_type") != "none").alias("fallback")).alias("agent_b"))
    return nested.select("sample_id", joins.final_text("router", "agent_a", "agent_b").alias("final_text"))


@register("pf7_upgraded_rows", over_cache("SELECT sample_id FROM cache WHERE coalesce(CASE WHEN row_idx % 3 = 0 THEN conf < 0.5 END, CASE WHEN row_idx % 3 = 1 THEN min_conf < 0.5 END, FALSE)"))
def pf7_upgraded_rows(spark, sf_dir):
    i = F.col("row_idx") % 3
    return cache(spark, sf_dir).where(F.coalesce(F.when(i == 0, F.col("conf") < 0.5), F.when(i == 1, F.col("min_conf") < 0.5), F.lit(False))).select("sample_id")


@register("pf8_failures_and_degradations", over_cache("""SELECT 'failure' AS kind, count(*) AS n, NULL::BIGINT AS delta FROM cache WHERE ocr_text <> gt AND final_text_if_upgraded <> gt
  UNION ALL SELECT 'degradation', count(*), sum(u - o) FROM (SELECT levenshtein(final_text_if_upgraded, gt) AS u, levenshtein(ocr_text, gt) AS o FROM cache WHERE final_text_if_upgraded <> ocr_text) WHERE u > o"""))
def pf8_failures_and_degradations(spark, sf_dir):
    rows = cache(spark, sf_dir).select("ocr_text", "final_text_if_upgraded", "gt", F.levenshtein("final_text_if_upgraded", "gt").alias("u"), F.levenshtein("ocr_text", "gt").alias("o"))
    bad = rows.where("ocr_text <> gt and final_text_if_upgraded <> gt").agg(F.lit("failure").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("long").alias("delta"))
    worse = rows.where("final_text_if_upgraded <> ocr_text and u > o").agg(F.lit("degradation").alias("kind"), F.count("*").alias("n"), F.sum(F.col("u") - F.col("o")).alias("delta"))
    return bad.unionByName(worse)


CASES = "cases AS (SELECT *, levenshtein(final_text_if_upgraded, gt) - levenshtein(ocr_text, gt) AS delta, CASE WHEN levenshtein(final_text_if_upgraded, gt) < levenshtein(ocr_text, gt) THEN 'beneficial' WHEN levenshtein(final_text_if_upgraded, gt) > levenshtein(ocr_text, gt) THEN 'harmful' ELSE 'neutral' END AS label FROM cache WHERE conf < 0.3::DOUBLE)"


def _cases(spark, sf_dir):
    d = F.levenshtein("final_text_if_upgraded", "gt") - F.levenshtein("ocr_text", "gt")
    rows = cache(spark, sf_dir).where("conf < 0.3D").withColumn("delta", d)
    return rows.withColumn("label", F.when(F.col("delta") < 0, "beneficial").when(F.col("delta") > 0, "harmful").otherwise("neutral"))


@register("pf9_changed_case_pool", over_cache("SELECT sample_id, delta, label FROM cases WHERE final_text_if_upgraded <> ocr_text", CASES))
def pf9_changed_case_pool(spark, sf_dir):
    return _cases(spark, sf_dir).where("final_text_if_upgraded <> ocr_text").select("sample_id", "delta", "label")


@register("pf10_case_pool", over_cache("SELECT label, count(*) AS n, sum(delta) AS delta FROM cases GROUP BY label", CASES))
def pf10_case_pool(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


@register("pf11_valid_text_cer", over_cache("SELECT round(sum(levenshtein(t, gt))::DOUBLE / sum(length(gt)), 6) AS \"CER\", count(*) AS n FROM (SELECT CASE WHEN row_idx % 6 = 0 THEN '' ELSE ocr_text END AS t, gt FROM cache) WHERE t <> ''"))
def pf11_valid_text_cer(spark, sf_dir):
    rows = cache(spark, sf_dir).select(F.when(F.col("row_idx") % 6 == 0, "").otherwise(F.col("ocr_text")).alias("t"), "gt").where("t <> ''")
    return rows.agg(r6(F.sum(F.levenshtein("t", "gt")) / F.sum(F.length("gt"))).alias("CER"), F.count("*").alias("n"))


@register("pf12_stamp_run", over_cache("SELECT sample_id, 'exp_c' AS exp_id, 'm1' AS model_name, 0.3::DOUBLE AS budget FROM cache"))
def pf12_stamp_run(spark, sf_dir):
    return cache(spark, sf_dir).select("sample_id").withColumns({"exp_id": F.lit("exp_c"), "model_name": F.lit("m1"), "budget": F.lit(0.3)})


@register("pf14_integrity_counts", over_cache("SELECT count(*) AS n, count(*) FILTER (conf < 0 OR conf > 1) AS out_of_range, count(*) FILTER (conf = min_conf) AS collapsed, count(*) FILTER (latency_ms IS NULL) AS no_latency FROM cache"))
def pf14_integrity_counts(spark, sf_dir):
    return cache(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.expr("conf < 0 or conf > 1")).alias("out_of_range"), F.count_if(F.expr("conf = min_conf")).alias("collapsed"), F.count_if(F.col("latency_ms").isNull()).alias("no_latency"))


@register("pf16_stacked_summaries", """SELECT 'docs' AS tab, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY event_type
  UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def pf16_stacked_summaries(spark, sf_dir):
    part = lambda t, c, n: table(spark, sf_dir, t).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(n).alias("tab"), "name", "n")
    return part("documents", "lang", "docs").unionByName(part("events", "event_type", "events")).unionByName(part("orders", "o_orderpriority", "orders"))


@register("pf17_flat_or_nested_text", over_cache("SELECT sample_id, replace(CASE WHEN row_idx % 3 = 0 THEN ocr_text WHEN row_idx % 3 = 1 THEN gt ELSE '' END, ' ', '') AS v FROM cache"))
def pf17_flat_or_nested_text(spark, sf_dir):
    i = F.col("row_idx") % 3
    rows = cache(spark, sf_dir).select("sample_id", F.when(i == 0, F.col("ocr_text")).alias("flat"), F.when(i == 1, F.struct(F.col("gt").alias("text"))).alias("nested"))
    return rows.select("sample_id", text.no_spaces(F.coalesce("flat", F.col("nested.text"), F.lit(""))).alias("v"))


@register("pf18_tolerant_double", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE cast(event_id AS VARCHAR) END AS DOUBLE), -1) AS v FROM events")
def pf18_tolerant_double(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.tolerant_double(raw, -1.0).alias("v"))


# -- sets, order ---------------------------------------------------------------------------------


@register("u1_append_augmented", over_cache("SELECT origin, count(*) AS n, count(crop) AS cropped FROM (SELECT 'real' AS origin, NULL::DOUBLE AS crop FROM cache UNION ALL SELECT 'synthetic', 0.1 FROM cache WHERE conf < 0.2::DOUBLE) GROUP BY origin"))
def u1_append_augmented(spark, sf_dir):
    c = cache(spark, sf_dir)
    rows = c.select("row_idx", F.lit("real").alias("origin")).unionByName(c.where("conf < 0.2D").select("row_idx", F.lit("synthetic").alias("origin"), F.lit(0.1).alias("crop")), allowMissingColumns=True)
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.count("crop").alias("cropped"))


@register("u2_casebook_union", over_cache("SELECT sample_id, 'gain' AS case_group FROM cases WHERE label = 'beneficial' UNION ALL SELECT sample_id, 'loss' FROM cases WHERE label = 'harmful' UNION ALL SELECT sample_id, 'same' FROM cases WHERE label = 'neutral'", CASES))
def u2_casebook_union(spark, sf_dir):
    names = F.when(F.col("label") == "beneficial", "gain").when(F.col("label") == "harmful", "loss").otherwise("same")
    return _cases(spark, sf_dir).select("sample_id", names.alias("case_group"))  # one pass in place of three


@register("u3_pools_by_budget", over_cache("SELECT budget, count(*) AS n, sum(row_idx) AS ids FROM cache, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS budget) WHERE 1.0::DOUBLE - conf >= 1.0::DOUBLE - budget GROUP BY budget"))
def u3_pools_by_budget(spark, sf_dir):
    rows = cache(spark, sf_dir).select("row_idx", "conf", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2)))).alias("budget"))
    return rows.where(F.lit(1.0) - F.col("conf") >= F.lit(1.0) - F.col("budget")).groupBy("budget").agg(F.count("*").alias("n"), whole_sum("row_idx").alias("ids"))


@register("t2_pick_top", over_cache("SELECT sample_id, delta FROM cases WHERE label = 'harmful' ORDER BY delta DESC, row_idx LIMIT 12", CASES))
def t2_pick_top(spark, sf_dir):
    return _cases(spark, sf_dir).where("label = 'harmful'").orderBy(F.desc("delta"), "row_idx").limit(12).select("sample_id", "delta")


@register("t3_head", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100")
def t3_head(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id").orderBy("event_id").limit(100)


@register("t7_sort_by_key", "SELECT doc_id, source FROM documents ORDER BY source, doc_id")
def t7_sort_by_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id")


@register("t9_value_sort", "SELECT o_orderpriority, avg_price FROM (SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 2) AS avg_price FROM orders GROUP BY 1) ORDER BY avg_price")
def t9_value_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice") / F.count("*"), 2).alias("avg_price")).orderBy("avg_price")


#: A seeded order of rows that both engines can draw: a linear congruence of the row id, ties by the id.
DRAW = "(((row_idx % 2147483647) * 48271 + {seed}) % 2147483647)"


def _draw(seed):
    return (F.col("row_idx") % 2147483647 * 48271 + seed) % 2147483647


@register("t4_random_baseline", over_cache(f"""SELECT row_idx, rank FROM (SELECT row_idx, row_number() OVER (ORDER BY {DRAW.format(seed=1)} DESC, row_idx) AS rank, count(*) OVER () AS n FROM cache)
  WHERE rank <= round_even(n * 0.2::DOUBLE, 0)"""))
def t4_random_baseline(spark, sf_dir):
    """Our own seeded order, since the original one is Python's generator."""
    from redpen.operators.ranking import ranked

    rows = cache(spark, sf_dir).select("row_idx", _draw(1).cast("double").alias("score"))
    return ranked(rows, "score").where("rank <= bround(n * 0.2)").select("row_idx", "rank")


@register("t5_exact_split", over_cache(f"""SELECT row_idx, CASE WHEN rank <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT row_idx, row_number() OVER (ORDER BY {DRAW.format(seed=42)} DESC, row_idx) AS rank, count(*) OVER () AS n FROM cache)"""))
def t5_exact_split(spark, sf_dir):
    """60/20/20 of exact sizes by a seeded permutation; the test part is the remainder."""
    from redpen.operators.ranking import ranked

    rows = ranked(cache(spark, sf_dir).select("row_idx", _draw(42).cast("double").alias("score")), "score")
    sixth, fifth = F.floor(F.col("n") * F.lit(0.6)), F.floor(F.col("n") * F.lit(0.2))
    return rows.select("row_idx", F.when(F.col("rank") <= sixth, "train").when(F.col("rank") <= sixth + fifth, "val").otherwise("test").alias("split"))


@register("t6_sample_without_replacement", over_cache(f"SELECT row_idx FROM cache WHERE ocr_text = gt ORDER BY {DRAW.format(seed=7)}, row_idx LIMIT 500"))
def t6_sample_without_replacement(spark, sf_dir):
    rows = cache(spark, sf_dir).where("ocr_text = gt").select("row_idx", _draw(7).alias("draw"))
    return rows.orderBy("draw", "row_idx").limit(500).select("row_idx")


@register("g10_round_robin", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3 AS key_idx FROM events")
def g10_round_robin(spark, sf_dir):
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(turn - 1, F.lit(3)).alias("key_idx"))
