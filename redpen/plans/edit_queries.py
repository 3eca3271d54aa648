"""Queries of text metrics, edit validation and the edit taxonomy."""

from __future__ import annotations

from pyspark.sql import Window

from redpen.functions import align, text
from redpen.operators import edits
from redpen.plans.common import F, cache, over_cache, r6, table
from redpen.plans.registry import register

def of_edits(body):
    return over_cache(body, "e AS (SELECT *, ocr_text AS a, final_text_if_upgraded AS b FROM cache)")


def of_index(body):
    return over_cache(body, "x AS (SELECT row_idx, gt, (row_idx % 50 - 5)::INT AS i FROM cache)")


def _edits(spark, sf_dir):
    return cache(spark, sf_dir).withColumns({"a": F.col("ocr_text"), "b": F.col("final_text_if_upgraded")})


@register("s1_no_spaces", over_cache("SELECT row_idx, regexp_replace(gt, '\\s+', '', 'g') AS v FROM cache"))
def s1_no_spaces(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.no_spaces(F.col("gt")).alias("v"))


@register("s2_narrow_marks", "SELECT doc_id, md5(translate(text, '（）【】｛｝，：；！？。', '()[]{},:;!?.')) AS v FROM documents")
def s2_narrow_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.narrow_marks(F.col("text")).cast("binary")).alias("v"))


@register("s3_eval_form", over_cache("SELECT row_idx, translate(gt || '（）。', '（）【】｛｝，：；！？。', '()[]{},:;!?.') AS v FROM cache"))
def s3_eval_form(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.narrow_marks(F.concat("gt", F.lit("（）。"))).alias("v"))


@register("s4_plain_form", "SELECT doc_id, md5(trim(replace(replace(translate(text, '（）【】｛｝，：；！？。—–－　', '()[]{},:;!?.--- '), '→', '->'), ' ', ''))) AS v FROM documents")
def s4_plain_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_form(F.col("text")).cast("binary")).alias("v"))


@register("s5_edit_distance", of_edits("SELECT row_idx, levenshtein(a, gt) AS d_ocr, levenshtein(b, gt) AS d_up, levenshtein(a, b) AS d_ab FROM e"))
def s5_edit_distance(spark, sf_dir):
    return _edits(spark, sf_dir).select("row_idx", F.levenshtein("a", "gt").alias("d_ocr"), F.levenshtein("b", "gt").alias("d_up"), F.levenshtein("a", "b").alias("d_ab"))


@register("s6_cer_without_spaces", of_edits("SELECT row_idx, round(CASE WHEN r = '' THEN CASE WHEN p = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(p, r)::DOUBLE / length(r) END, 6) AS cer FROM (SELECT row_idx, replace(a, ' ', '') AS p, replace(gt, ' ', '') AS r FROM e)"))
def s6_cer_without_spaces(spark, sf_dir):
    return _edits(spark, sf_dir).select("row_idx", r6(text.cer_spaces(F.col("a"), F.col("gt"))).alias("cer"))


@register("s7_cer_narrow_marks", of_edits("SELECT row_idx, round(CASE WHEN gt = '' THEN 0.0 ELSE levenshtein(a, gt)::DOUBLE / length(gt) END, 6) AS cer FROM e"))
def s7_cer_narrow_marks(spark, sf_dir):
    return _edits(spark, sf_dir).select("row_idx", r6(text.cer_marks(F.col("a"), F.col("gt"))).alias("cer"))


@register("s15_simple_deletion_label", of_edits("SELECT row_idx, CASE WHEN length(gt) > length(a) AND (suffix(gt, a) OR starts_with(gt, a)) THEN 1 ELSE 0 END AS label FROM e"))
def s15_simple_deletion_label(spark, sf_dir):
    return _edits(spark, sf_dir).select("row_idx", text.deletion_label(F.col("a"), F.col("gt")).alias("label"))


@register("s16_answer_after_marker", over_cache("SELECT row_idx, trim(trim(string_split(trim(list_extract(string_split(raw, 'Answer:'), -1)), chr(10))[1]), '\"''`') AS v FROM (SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN 'note Answer: \"' || gt || '\"' || chr(10) || 'more' ELSE gt END AS raw FROM cache)"))
def s16_answer_after_marker(spark, sf_dir):
    raw = F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit('note Answer: "'), F.col("gt"), F.lit('"\nmore'))).otherwise(F.col("gt"))
    return cache(spark, sf_dir).select("row_idx", text.first_answer(raw, ["Answer:"]).alias("v"))


@register("s17_defended_answer", over_cache("""SELECT row_idx, CASE WHEN v = '' OR contains(v, 'Step 1') THEN ocr_text ELSE v END AS v FROM (SELECT row_idx, ocr_text,
  trim(trim(string_split(trim(regexp_replace(CASE row_idx % 3 WHEN 0 THEN '<think>why' || chr(10) || 'so</think>' || gt WHEN 1 THEN 'Step 1: look' ELSE gt END, '(?s)<think>.*?</think>', '', 'g')), chr(10))[1]), '"''`') AS v FROM cache)"""))
def s17_defended_answer(spark, sf_dir):
    i = F.col("row_idx") % 3
    raw = F.when(i == 0, F.concat(F.lit("<think>why\nso</think>"), F.col("gt"))).when(i == 1, "Step 1: look").otherwise(F.col("gt"))
    return cache(spark, sf_dir).select("row_idx", text.defended_answer(raw, F.col("ocr_text"), [], ["Step 1"]).alias("v"))


_ENDS = "(trim({t}, ' ')[1] = '{a}' AND trim({t}, ' ')[-1:] = '{b}' AND length(trim({t}, ' ')) >= 2)"


def _stripped(name, start):
    """Recursive SQL that takes one bracket pair off a text (row_idx, t, n) at a time."""
    cases = " OR ".join(_ENDS.format(t="t", a=a, b=b) for a, b in zip("【[(（", "】])）", strict=True))
    return f"""{name}(row_idx, t, n) AS (SELECT row_idx, {start}, 0 FROM cache
  UNION ALL SELECT row_idx, trim(substring(trim(t, ' '), 2, length(trim(t, ' ')) - 2), ' '), n + 1 FROM {name} WHERE {cases})"""


@register("s18_enclosing_brackets", "WITH RECURSIVE " + over_cache("""SELECT row_idx, CASE WHEN a.t = b.t THEN ocr_text ELSE a.t END AS v
  FROM (SELECT row_idx, max_by(trim(t, ' '), n) AS t FROM s GROUP BY row_idx) a JOIN (SELECT row_idx, max_by(trim(t, ' '), n) AS t FROM f GROUP BY row_idx) b USING (row_idx) JOIN cache USING (row_idx)""",
  _stripped("s", "'【(' || gt || ')】'"), _stripped("f", "ocr_text")).removeprefix("WITH "))
def s18_enclosing_brackets(spark, sf_dir):
    """Bracket pairs around a text go, to a fixpoint; a text that differs from its fallback only by
    them is the fallback."""
    t = F.concat(F.lit("【("), F.col("gt"), F.lit(")】"))
    return cache(spark, sf_dir).select("row_idx", text.unbracketed(t, F.col("ocr_text")).alias("v"))


@register("s19_compact_answer", over_cache("SELECT row_idx, regexp_replace(regexp_extract('Result: ' || gt, '(?s)Result:(.*)', 1), '\\s+', '', 'g') AS v FROM cache"))
def s19_compact_answer(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.no_spaces(F.regexp_extract(F.concat(F.lit("Result: "), F.col("gt")), "(?s)Result:(.*)", 1)).alias("v"))


@register("s20_bracketed_text", over_cache("SELECT row_idx, regexp_extract('x【 ' || replace(gt, '?', '') || ' 】y', '【\\s*(.+?)\\s*】', 1) AS v FROM cache"))
def s20_bracketed_text(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.between(F.concat(F.lit("x【 "), F.replace("gt", F.lit("?"), F.lit("")), F.lit(" 】y"))).alias("v"))


@register("s21_confusable_swap", over_cache("SELECT row_idx, CASE WHEN c IN ('e', 'o', 'l') THEN substring(gt, 1, k) || translate(c, 'eol', 'c01') || substring(gt, k + 2) ELSE gt END AS v FROM (SELECT row_idx, gt, (row_idx % 30)::INT AS k, substring(gt, (row_idx % 30)::INT + 1, 1) AS c FROM cache)"))
def s21_confusable_swap(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.swap_char(F.col("gt"), (F.col("row_idx") % 30).cast("int"), {"e": "c", "o": "0", "l": "1"}).alias("v"))


def _indexed(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", "gt", (F.col("row_idx") % 50 - 5).cast("int").alias("i"))


@register("s22_shown_index", of_index("SELECT row_idx, CASE WHEN i < 0 THEN '?' ELSE cast(i + 1 AS VARCHAR) END AS v FROM x"))
def s22_shown_index(spark, sf_dir):
    return _indexed(spark, sf_dir).select("row_idx", text.shown_index(F.col("i")).alias("v"))


@register("s23_checked_index", of_index("SELECT row_idx, i < length(gt) AS valid, CASE WHEN i < 0 THEN -1 ELSE least(i, length(gt) - 1) END AS idx FROM x"))
def s23_checked_index(spark, sf_dir):
    return _indexed(spark, sf_dir).select("row_idx", text.checked_index(F.col("i"), F.col("gt")).alias("c")).select("row_idx", "c.valid", F.col("c.index").alias("idx"))


@register("s24_char_at", of_index("SELECT row_idx, CASE WHEN i >= 0 AND i < length(gt) THEN substring(gt, i + 1, 1) ELSE '?' END AS v FROM x"))
def s24_char_at(spark, sf_dir):
    return _indexed(spark, sf_dir).select("row_idx", text.char_at(F.col("gt"), F.col("i")).alias("v"))


@register("s25_index_conversion", of_index("SELECT row_idx, i + 1 AS shown, i - 1 AS internal FROM x"))
def s25_index_conversion(spark, sf_dir):
    return _indexed(spark, sf_dir).select("row_idx", (F.col("i") + 1).alias("shown"), (F.col("i") - 1).alias("internal"))


@register("s26_budget_tag", "SELECT i, CASE WHEN i < 10 THEN '0' || i ELSE cast(i AS VARCHAR) END AS tag FROM range(1, 101) t(i)")
def s26_budget_tag(spark, sf_dir):
    return spark.range(1, 101).select(F.col("id").alias("i"), text.budget_tag(F.col("id") / F.lit(100.0)).alias("tag"))


@register("s27_reverse_runs")
def s27_reverse_runs(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", text.reversed_runs(F.col("gt")).alias("v"))


@register("s28_secret_forms", "SELECT doc_id, regexp_matches(text, '(?i)(api[_-]?key|token|secret|passw(or)?d)\\s*[:=]\\s*.?[A-Za-z0-9_/+=-]{16,}') AS key_assignment FROM documents")
def s28_secret_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(text.secret_forms(F.col("text")), "key_assignment").alias("key_assignment"))


@register("s29_ceiling_post_process", over_cache("SELECT row_idx, coalesce(nullif(trim(trim(string_split(trim(CASE WHEN row_idx % 4 = 0 THEN '' ELSE '\"' || gt || '\"' || chr(10) || 'x' END), chr(10))[1]), '\"''`'), ''), ocr_text) AS v FROM cache"))
def s29_ceiling_post_process(spark, sf_dir):
    raw = F.when(F.col("row_idx") % 4 == 0, "").otherwise(F.concat(F.lit('"'), F.col("gt"), F.lit('"\nx')))
    return cache(spark, sf_dir).select("row_idx", F.coalesce(F.nullif(text.first_answer(raw, []), F.lit("")), F.col("ocr_text")).alias("v"))


@register("r3_outcome_classes", of_edits("""SELECT CASE WHEN o = 0 AND u = 0 THEN 'unchanged_correct' WHEN o = 0 THEN 'overcorrected' WHEN u = 0 THEN 'corrected' WHEN u < o THEN 'improved' WHEN u > o THEN 'worsened' ELSE 'unchanged_wrong' END AS outcome, count(*) AS n
  FROM (SELECT levenshtein(replace(a, ' ', ''), replace(gt, ' ', '')) AS o, levenshtein(replace(b, ' ', ''), replace(gt, ' ', '')) AS u FROM e) GROUP BY 1"""))
def r3_outcome_classes(spark, sf_dir):
    n = text.no_spaces
    rows = _edits(spark, sf_dir).select(F.levenshtein(n(F.col("a")), n(F.col("gt"))).alias("o"), F.levenshtein(n(F.col("b")), n(F.col("gt"))).alias("u"))
    return rows.groupBy(align.outcome(F.col("o"), F.col("u")).alias("outcome")).agg(F.count("*").alias("n"))


def cvr_sql(a, b):
    return of_edits(f"""SELECT count(*) AS upgraded_count, count(*) FILTER (final <> a) / count(*) AS aer, count(*) FILTER (b <> '' AND b <> a AND (levenshtein(a, b) > 2 OR abs(length(b) - length(a)) / greatest(length(a), 1)::DOUBLE > 0.2::DOUBLE) AND final = a) / count(*) AS cvr
  FROM (SELECT {a} AS a, {b} AS b, CASE WHEN row_idx % 3 = 0 THEN {a} ELSE {b} END AS final FROM e WHERE conf < 0.5::DOUBLE)""")


def _cvr(rows):
    a, b, final = F.col("a"), F.col("b"), F.col("final")
    size = F.greatest(F.length(a), F.lit(1))
    broken = (b != "") & (b != a) & ((F.levenshtein(a, b) > 2) | (F.abs(F.length(b) - F.length(a)) / size > 0.2))
    return rows.agg(F.count("*").alias("upgraded_count"), (F.count_if(final != a) / F.count("*")).alias("aer"), (F.count_if(broken & (final == a)) / F.count("*")).alias("cvr"))


@register("a7_cvr_aer", cvr_sql("replace(a, ' ', '')", "replace(b, ' ', '')"))
def a7_cvr_aer(spark, sf_dir):
    a, b = text.no_spaces(F.col("a")), text.no_spaces(F.col("b"))
    return _cvr(_edits(spark, sf_dir).where("conf < 0.5D").select(a.alias("a"), b.alias("b"), F.when(F.col("row_idx") % 3 == 0, a).otherwise(b).alias("final")))


@register("r5_cvr_aer_raw", cvr_sql("a", "b"))
def r5_cvr_aer_raw(spark, sf_dir):
    return _cvr(_edits(spark, sf_dir).where("conf < 0.5D").select("a", "b", F.when(F.col("row_idx") % 3 == 0, F.col("a")).otherwise(F.col("b")).alias("final")))


# -- validation ----------------------------------------------------------------------------------

FMT = "(b <> '' AND a <> b AND translate(a, '（）【】｛｝，：；！？。', '()[]{},:;!?.') = translate(b, '（）【】｛｝，：；！？。', '()[]{},:;!?.'))"
CHANGE = "CASE WHEN length(a) = 0 THEN 0.0::DOUBLE ELSE abs(length(b) - length(a))::DOUBLE / length(a) END"
BACKFILL = f"""bf AS (SELECT *, levenshtein(a, b) AS edits, {CHANGE} AS change,
  CASE WHEN levenshtein(a, b) > 3 THEN 'rejected_global_ed_exceeded' WHEN {CHANGE} > 0.2::DOUBLE THEN 'rejected_global_length_change' WHEN {FMT} THEN 'rejected_pure_formatting_edit' ELSE 'accepted' END AS reason
  FROM (SELECT row_idx, gt, domain, ocr_text AS a, CASE row_idx % 6 WHEN 0 THEN final_text_if_upgraded || ' again' WHEN 1 THEN ocr_text || '' ELSE final_text_if_upgraded END AS b FROM cache))"""


def _proposed(spark, sf_dir):
    i = F.col("row_idx") % 6
    b = F.when(i == 0, F.concat("final_text_if_upgraded", F.lit(" again"))).when(i == 1, F.col("ocr_text")).otherwise(F.col("final_text_if_upgraded"))
    return cache(spark, sf_dir).select("row_idx", "gt", "domain", F.col("ocr_text").alias("a"), b.alias("b"))


@register("b1_backfill_decision", over_cache("SELECT row_idx, CASE WHEN reason = 'accepted' THEN b ELSE a END AS final, reason <> 'accepted' AS rejected, reason, edits, round(change, 6) AS change FROM bf", BACKFILL))
def b1_backfill_decision(spark, sf_dir):
    rows = _proposed(spark, sf_dir).select("row_idx", edits.backfill(F.col("a"), F.col("b")).alias("d")).select("row_idx", "d.*")
    return rows.withColumn("change", r6(F.col("change")))


@register("b2_global_limits", over_cache("SELECT domain, reason, count(*) AS n FROM bf WHERE reason LIKE '%global%' GROUP BY ALL", BACKFILL))
def b2_global_limits(spark, sf_dir):
    rows = _proposed(spark, sf_dir).withColumn("reason", edits.global_rejection(F.col("a"), F.col("b"))).where("reason is not null")
    return rows.groupBy("domain", "reason").agg(F.count("*").alias("n"))


@register("b3_format_rejection", over_cache("SELECT count(*) AS n FROM cache WHERE ocr_text <> replace(ocr_text, ',', '，')"))
def b3_format_rejection(spark, sf_dir):
    rows = cache(spark, sf_dir).select(edits.format_rejection(F.col("ocr_text"), F.replace("ocr_text", F.lit(","), F.lit("，"))).alias("r"))
    return rows.agg(F.count("r").alias("n"))


@register("b4_boundary_rejection")
def b4_boundary_rejection(spark, sf_dir):
    rows = _proposed(spark, sf_dir).where("a <> b")
    return rows.select("row_idx", F.coalesce(align.boundary_rejection(F.col("a"), align.edit_ops(F.col("a"), F.col("b"))), F.lit("accepted")).alias("reason"))


PLACES = "list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))"


@register("b5_ambiguity_rejection", of_edits(f"""SELECT row_idx, CASE WHEN length(a) <> length(b) THEN 'rejected_ambiguity_violation' WHEN len(p) > 1 THEN 'rejected_multiple_changes' WHEN len(p) = 1 AND p[1] - 1 <> 3 THEN 'rejected_ambiguity_violation'
  WHEN len(p) = 1 AND substring(b, p[1], 1) NOT IN ('@', 'x') THEN 'rejected_top2_mismatch' ELSE 'accepted' END AS reason FROM (SELECT *, {PLACES} AS p FROM e)"""))
def b5_ambiguity_rejection(spark, sf_dir):
    reason = edits.ambiguity_rejection(F.col("a"), F.col("b"), F.lit(3), F.array(F.lit("@"), F.lit("x")))
    return _edits(spark, sf_dir).select("row_idx", F.coalesce(reason, F.lit("accepted")).alias("reason"))


@register("b6_length_change", over_cache("SELECT row_idx, round(change, 6) AS change FROM bf", BACKFILL))
def b6_length_change(spark, sf_dir):
    return _proposed(spark, sf_dir).select("row_idx", r6(text.length_change(F.col("a"), F.col("b"))).alias("change"))


@register("b7_lenient_backfill", over_cache("SELECT row_idx, b AS final, 'accepted' AS reason FROM bf", BACKFILL))
def b7_lenient_backfill(spark, sf_dir):
    return _proposed(spark, sf_dir).select("row_idx", edits.backfill(F.col("a"), F.col("b"), strict=False).alias("d")).select("row_idx", "d.final", "d.reason")


# -- taxonomy ------------------------------------------------------------------------------------


def _chars(t, kind):
    body = "".join("\\" + c if c in "[]\\^-&~" else c for c in kind).replace("'", "''")
    return f"list_sort(list_distinct(string_split(regexp_replace({t}, '[^{body}]', '', 'g'), '')))"


def _any(t, kind):
    return f"(length({_strip(t, kind)}) < length({t}))"


def _strip(t, kind):
    body = "".join("\\" + c if c in "[]\\^-&~" else c for c in kind).replace("'", "''")
    return f"regexp_replace({t}, '[{body}]', '', 'g')"


PLAIN = "trim(replace(replace(translate(%s, '（）【】｛｝，：；！？。—–－　', '()[]{},:;!?.--- '), '→', '->'), ' ', ''))"
TAXONOMY = [
    "e AS (SELECT row_idx, domain, ocr_text AS a, final_text_if_upgraded AS b, gt, professional_terms AS ts, conf FROM cache)",
    "h AS (SELECT *, least(length(a), length(b)) AS m, coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))[1] - 1, least(length(a), length(b))) AS head FROM e)",
    "t AS (SELECT *, least(coalesce(list_filter(range(1, m + 1), lambda i: substring(reverse(a), i, 1) <> substring(reverse(b), i, 1))[1] - 1, m), m - head) AS tail, greatest(length(a), length(b)) AS longer FROM h)",
    f"""f AS (SELECT *, CASE WHEN a <> b THEN head END AS first, CASE WHEN a <> b THEN longer - 1 - tail END AS last, length(a) <> length(b) AS is_length_changed, {_chars('a', edits.NUMBERING)} <> {_chars('b', edits.NUMBERING)} AS is_numbering_changed,
      {_chars('a', edits.STRUCTURE)} <> {_chars('b', edits.STRUCTURE)} AS is_symbol_changed,
      list_sort(list_filter(ts, lambda x: contains(a, x) OR contains(gt, x))) <> list_sort(list_filter(ts, lambda x: contains(b, x) OR contains(gt, x))) AS is_term_changed,
      a <> b AND {PLAIN % 'a'} = {PLAIN % 'b'} AS is_format_normalization, len(list_filter(ts, lambda x: contains(a, x) OR contains(b, x) OR contains(gt, x))) > 0 AS term, levenshtein(a, gt) AS edit_distance_ocr, levenshtein(b, gt) AS edit_distance_vlm FROM t)""",
    """k AS (SELECT *, CASE WHEN a = b THEN 'no_change' WHEN is_length_changed THEN 'length_changed' WHEN last = first THEN 'single_char' WHEN last - first <= 2 THEN 'local_multi_char' ELSE 'long_span' END AS edit_span_type,
      coalesce(a <> b AND (first < 2 OR last >= longer - 2), FALSE) AS is_boundary_edit, coalesce(first < 2, FALSE) AS l, coalesce(last >= longer - 2, FALSE) AS r FROM f)""",
    f"""s AS (SELECT *, a <> b AND NOT is_length_changed AND NOT {_any('a || b', edits.NUMBERING)} AND NOT {_any('a || b', edits.STRUCTURE)} AND b <> gt AND edit_span_type IN ('local_multi_char', 'long_span') AS is_semantic_substitution,
      {_any('a', edits.ROMAN)} AS ar, {_any('b', edits.ROMAN)} AS br, {_any('a', edits.ARABIC)} AS aa, {_any('b', edits.ARABIC)} AS ba, edit_span_type = 'single_char' AS single FROM k)""",
    """c AS (SELECT *, CASE WHEN NOT is_semantic_substitution THEN 'none' WHEN term THEN 'domain_term_shift' ELSE 'near_synonym_or_shape_confusion' END AS semantic_subclass,
      CASE WHEN NOT is_numbering_changed THEN 'none' WHEN ar AND br AND NOT is_length_changed THEN 'roman_numeral_fix' WHEN aa AND ba AND NOT is_length_changed THEN 'arabic_digit_fix' WHEN (ar OR aa) AND (br OR ba) THEN 'enumeration_style_switch' ELSE 'numbering_content_rewrite' END AS numbering_subclass,
      CASE WHEN NOT is_boundary_edit THEN 'none' WHEN is_symbol_changed THEN 'boundary_plus_structure_symbol' WHEN l AND r THEN 'dual_boundary_edit' WHEN single AND l THEN 'left_boundary_single_char_fix' WHEN single THEN 'right_boundary_single_char_fix'
        WHEN l THEN 'left_boundary_multi_char_fix' ELSE 'right_boundary_multi_char_fix' END AS boundary_subclass,
      CASE WHEN edit_distance_vlm < edit_distance_ocr THEN 'beneficial' WHEN edit_distance_vlm = edit_distance_ocr THEN 'neutral' ELSE 'harmful' END AS edit_gain_type,
      CASE WHEN is_numbering_changed THEN 'numbering_rewrite' WHEN is_format_normalization THEN 'format_normalization' WHEN is_term_changed THEN 'term_edit' WHEN is_boundary_edit AND single THEN 'boundary_single_char_fix' WHEN is_boundary_edit THEN 'boundary_edit'
        WHEN is_symbol_changed THEN 'symbol_edit' WHEN is_semantic_substitution THEN 'semantic_substitution' WHEN single THEN 'single_char_fix' WHEN is_length_changed THEN 'length_change' ELSE edit_span_type END AS edit_type FROM s)""",
    """x AS (SELECT *, CASE WHEN is_format_normalization OR semantic_subclass = 'domain_term_shift' OR numbering_subclass = 'numbering_content_rewrite' THEN 'reject'
      WHEN semantic_subclass = 'near_synonym_or_shape_confusion' OR numbering_subclass IN ('enumeration_style_switch', 'arabic_digit_fix') OR boundary_subclass = 'boundary_plus_structure_symbol' THEN 'hard_review'
      WHEN boundary_subclass IN ('dual_boundary_edit', 'left_boundary_multi_char_fix', 'right_boundary_multi_char_fix') OR numbering_subclass = 'roman_numeral_fix' OR is_length_changed THEN 'soft_review' ELSE 'accept' END AS action,
      array_to_string(list_filter([CASE WHEN is_boundary_edit THEN 'boundary_edit' END, CASE WHEN is_numbering_changed THEN 'numbering_change' END, CASE WHEN is_symbol_changed THEN 'symbol_change' END, CASE WHEN is_term_changed THEN 'term_change' END,
        CASE WHEN is_format_normalization THEN 'format_norm' END, CASE WHEN is_semantic_substitution THEN 'semantic_sub' END, CASE WHEN is_length_changed THEN 'length_change' END], lambda y: y IS NOT NULL), '|') AS tags FROM c)""",
]


def _taxonomy(spark, sf_dir):
    return edits.enrich(cache(spark, sf_dir))


@register("b8_differing_span", over_cache("SELECT row_idx, first, last FROM f", *TAXONOMY[:4]))
def b8_differing_span(spark, sf_dir):
    return _edits(spark, sf_dir).select("row_idx", edits.span(F.col("a"), F.col("b")).alias("s")).select("row_idx", "s.first", "s.last")


@register("b9_span_types", over_cache("SELECT edit_span_type, count(*) AS n FROM k GROUP BY 1", *TAXONOMY[:5]))
def b9_span_types(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy("edit_span_type").agg(F.count("*").alias("n"))


@register("b10_boundary_edits", over_cache("SELECT row_idx, is_boundary_edit FROM k", *TAXONOMY[:5]))
def b10_boundary_edits(spark, sf_dir):
    return _taxonomy(spark, sf_dir).select("row_idx", "is_boundary_edit")


@register("b11_b12_flags", over_cache("SELECT count(*) FILTER (is_format_normalization) AS format_only, count(*) FILTER (is_semantic_substitution) AS semantic, count(*) FILTER (is_symbol_changed) AS symbols, count(*) FILTER (is_numbering_changed) AS numbering FROM s", *TAXONOMY[:6]))
def b11_b12_flags(spark, sf_dir):
    names = {"format_only": "is_format_normalization", "semantic": "is_semantic_substitution", "symbols": "is_symbol_changed", "numbering": "is_numbering_changed"}
    return _taxonomy(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in names.items()])


@register("b13_b15_subclasses", over_cache("SELECT semantic_subclass, numbering_subclass, boundary_subclass, count(*) AS n FROM c GROUP BY ALL", *TAXONOMY[:7]))
def b13_b15_subclasses(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy("semantic_subclass", "numbering_subclass", "boundary_subclass").agg(F.count("*").alias("n"))


@register("b16_gain_labels", over_cache("SELECT edit_gain_type, count(*) AS n, sum(edit_distance_vlm - edit_distance_ocr) AS delta FROM c GROUP BY 1", *TAXONOMY[:7]))
def b16_gain_labels(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy("edit_gain_type").agg(F.count("*").alias("n"), F.sum(F.col("edit_distance_vlm") - F.col("edit_distance_ocr")).alias("delta"))


@register("b17_proposed_actions", over_cache("SELECT action, count(*) AS n FROM x GROUP BY 1", *TAXONOMY))
def b17_proposed_actions(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@register("b18_rationales", over_cache(f"""SELECT CASE action WHEN 'accept' THEN '{edits.RATIONALE["accept"]}' WHEN 'soft_review' THEN '{edits.RATIONALE["soft_review"]}' WHEN 'hard_review' THEN '{edits.RATIONALE["hard_review"]}'
  ELSE CASE WHEN is_format_normalization THEN '{edits.RATIONALE["format"]}' WHEN semantic_subclass <> 'none' THEN '{edits.RATIONALE["semantic"]}' ELSE '{edits.RATIONALE["number"]}' END END AS rationale, count(*) AS n FROM x GROUP BY 1""", *TAXONOMY))
def b18_rationales(spark, sf_dir):
    return _taxonomy(spark, sf_dir).groupBy("rationale").agg(F.count("*").alias("n"))


@register("b19_term_hits", over_cache("SELECT row_idx, array_to_string(list_filter(professional_terms, lambda t: length(t) >= 2 AND (contains(ocr_text, t) OR contains(final_text_if_upgraded, t))), ',') AS hits FROM cache"))
def b19_term_hits(spark, sf_dir):
    hit = lambda t: (F.length(t) >= 2) & (F.contains(F.col("ocr_text"), t) | F.contains(F.col("final_text_if_upgraded"), t))
    return cache(spark, sf_dir).select("row_idx", F.array_join(F.filter("professional_terms", hit), ",").alias("hits"))


@register("b20_enriched_rows", over_cache("SELECT row_idx, edit_type, edit_span_type, CASE WHEN tags = '' THEN 'plain_local_edit' ELSE tags END AS risk_tag, action, edit_gain_type FROM x", *TAXONOMY))
def b20_enriched_rows(spark, sf_dir):
    return _taxonomy(spark, sf_dir).select("row_idx", "edit_type", "edit_span_type", "risk_tag", "action", "edit_gain_type")


def _count_any(t):
    return f"(length({t}) - length({_strip(t, edits.HARM_MARKS)}))"


HARM = f"""harm AS (SELECT *, CASE WHEN u <= o THEN 'not_harmful' WHEN ({_any('gt || a', edits.HARM_MARKS)} AND {_any('b || gt', edits.HARM_MARKS)}) OR {_count_any('b')} <> {_count_any('a')} THEN 'structure_symbol_break'
  WHEN regexp_matches(gt || a || b, '{edits.HARM_NUMBER}') THEN 'number_id_break' WHEN len(ts) > 0 THEN 'term_entity_mischange' WHEN length(a) <> length(b) OR len({PLACES}) >= 2 THEN 'semantic_overrewrite' ELSE 'other' END AS bucket
  FROM (SELECT *, levenshtein(a, gt) AS o, levenshtein(b, gt) AS u FROM e))"""


def _harm(spark, sf_dir):
    rows = _edits(spark, sf_dir).withColumns({"o": F.levenshtein("a", "gt"), "u": F.levenshtein("b", "gt")})
    return rows.withColumn("bucket", edits.harm_bucket(F.col("a"), F.col("b"), F.col("gt"), F.col("o"), F.col("u"), F.col("professional_terms")))


@register("b21_harm_buckets", over_cache("SELECT row_idx, bucket FROM harm", TAXONOMY[0], HARM))
def b21_harm_buckets(spark, sf_dir):
    return _harm(spark, sf_dir).select("row_idx", "bucket")


@register("a21_bucket_ratios", over_cache("SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM harm WHERE u > o GROUP BY bucket", TAXONOMY[0], HARM))
def a21_bucket_ratios(spark, sf_dir):
    counts = _harm(spark, sf_dir).where("u > o").groupBy("bucket").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))  # a row per bucket


@register("b22_upgraded_pool", over_cache("SELECT row_idx, edit_type, action FROM x WHERE conf < 0.2::DOUBLE", *TAXONOMY))
def b22_upgraded_pool(spark, sf_dir):
    return edits.enrich(cache(spark, sf_dir).where("conf < 0.2D")).select("row_idx", "edit_type", "action")


@register("a19_type_by_gain", over_cache("""SELECT edit_type, count(*) AS n, count(*) FILTER (edit_gain_type = 'beneficial') AS beneficial_count, count(*) FILTER (edit_gain_type = 'neutral') AS neutral_count, count(*) FILTER (edit_gain_type = 'harmful') AS harmful_count,
  round(count(*) FILTER (edit_gain_type = 'harmful') / count(*), 6) AS harmful_rate FROM c GROUP BY 1""", *TAXONOMY[:7]))
def a19_type_by_gain(spark, sf_dir):
    n = lambda g: F.count_if(F.col("edit_gain_type") == g)
    return _taxonomy(spark, sf_dir).groupBy("edit_type").agg(F.count("*").alias("n"), *[n(g).alias(f"{g}_count") for g in ("beneficial", "neutral", "harmful")], r6(n("harmful") / F.count("*")).alias("harmful_rate"))


GROUPS = "g AS (SELECT row_idx, unnest(['semantic', 'numbering', 'boundary']) AS feature_group, unnest([semantic_subclass, numbering_subclass, boundary_subclass]) AS subclass, edit_gain_type, action, edit_distance_vlm - edit_distance_ocr AS delta, conf FROM x)"


def _groups(spark, sf_dir):
    rows = _taxonomy(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.col(f"{g}_subclass").alias("subclass")) for g in ("semantic", "numbering", "boundary")])
    return rows.select("row_idx", F.inline(each), "edit_gain_type", "action", (F.col("edit_distance_vlm") - F.col("edit_distance_ocr")).alias("delta"), "conf").where("subclass <> 'none'")


@register("a20_rule_table", over_cache("""SELECT feature_group, subclass, sum(n)::BIGINT AS n, sum(harm)::BIGINT AS harmful_count, arg_min(action, (-n, f)) AS action FROM (
  SELECT feature_group, subclass, action, count(*) AS n, count(*) FILTER (edit_gain_type = 'harmful') AS harm, min(row_idx) AS f FROM g WHERE subclass <> 'none' GROUP BY ALL) GROUP BY 1, 2""", *TAXONOMY, GROUPS))
def a20_rule_table(spark, sf_dir):
    """The most frequent action of each subclass; of equally frequent ones the first seen."""
    counts = _groups(spark, sf_dir).groupBy("feature_group", "subclass", "action").agg(F.count("*").alias("k"), F.count_if(F.col("edit_gain_type") == "harmful").alias("harm"), F.min("row_idx").alias("f"))
    return counts.groupBy("feature_group", "subclass").agg(F.sum("k").alias("n"), F.sum("harm").alias("harmful_count"), F.min_by("action", F.struct(-F.col("k"), "f")).alias("action"))


@register("w9_top_cases", over_cache("SELECT feature_group, subclass, row_idx, delta FROM g WHERE subclass <> 'none' AND edit_gain_type = 'harmful' QUALIFY row_number() OVER (PARTITION BY feature_group, subclass ORDER BY delta DESC, conf, row_idx) <= 30", *TAXONOMY, GROUPS))
def w9_top_cases(spark, sf_dir):
    order = Window.partitionBy("feature_group", "subclass").orderBy(F.desc("delta"), "conf", "row_idx")
    rows = _groups(spark, sf_dir).where("edit_gain_type = 'harmful'")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 30").select("feature_group", "subclass", "row_idx", "delta")  # a group limit: pruned before the shuffle


@register("u6_character_sets", over_cache("SELECT row_idx, array_to_string(" + _chars("gt", edits.ARABIC) + ", '') AS digits FROM cache"))
def u6_character_sets(spark, sf_dir):
    return cache(spark, sf_dir).select("row_idx", F.array_join(edits.chars_of(F.col("gt"), edits.ARABIC), "").alias("digits"))
