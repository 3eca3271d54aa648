"""Pieces that several queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.operators import replay
from redpen.sources.recognition import CACHE_SQL, cache, figures, table

__all__ = ["CACHE_SQL", "F", "cache", "chosen_grid", "figures", "grid_cells", "grid_sql", "over_cache", "r6", "table", "whole_sum"]


def r6(c: Column) -> Column:
    return F.round(c, 6)


def whole_sum(name: str) -> Column:
    """The sum of whole numbers in 38 digits: ids of a large table add up to more than a long holds."""
    return F.sum(F.col(name).cast("decimal(28,0)")).cast("decimal(38,0)")


def over_cache(body: str, *more: str) -> str:
    """DuckDB SQL of `body` over the cache, with further common table expressions."""
    return "WITH " + ", ".join([CACHE_SQL.strip(), *more]) + "\n" + body


WIDE, NARROW = "（）【】｛｝，：；！？。", "()[]{},:;!?."

#: One row per line: what both readings cost.
OUTCOMES_SQL = f"""outcomes AS (
  SELECT *, levenshtein(translate(ocr_text, '{WIDE}', '{NARROW}'), translate(gt, '{WIDE}', '{NARROW}')) AS ed_ocr,
    levenshtein(translate(final_text_if_upgraded, '{WIDE}', '{NARROW}'), translate(gt, '{WIDE}', '{NARROW}')) AS ed_up,
    length(gt) AS gt_len, ocr_text <> final_text_if_upgraded AS changed, ocr_text = gt AS ok_ocr, final_text_if_upgraded = gt AS ok_up
  FROM cache)"""

WUR_SQL = (
    "(0.5::DOUBLE * (1.0::DOUBLE - mean_conf) + 0.3::DOUBLE * (1.0::DOUBLE - min_conf) + 0.2::DOUBLE * \"drop\""
    " + CASE WHEN min_conf < 0.35::DOUBLE THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN \"drop\" > 0.20::DOUBLE THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END)"
)
SCORES_SQL = {"GCR": "(1.0::DOUBLE - conf)", "DGCR": "((1.0::DOUBLE - conf) + r_d)", "WUR": WUR_SQL, "DWUR": f"({WUR_SQL} + 0.5::DOUBLE * r_d)"}


def grid_sql(strategies=replay.STRATEGIES, budgets=replay.BUDGETS) -> list[str]:
    score = "CASE router_name " + " ".join(f"WHEN '{s}' THEN {SCORES_SQL[s]}" for s in strategies) + " END"
    return [
        OUTCOMES_SQL,
        f"strategies AS (SELECT unnest({list(strategies)}) AS router_name)",
        f"budgets AS (SELECT unnest({list(budgets)})::DOUBLE AS budget)",
        f"scored AS (SELECT *, {score} AS score FROM outcomes, strategies)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY router_name ORDER BY score DESC, row_idx) AS rank, count(*) OVER (PARTITION BY router_name) AS n FROM scored)",
        "grid AS (SELECT *, rank <= round_even(n * budget, 0) AS selected FROM ranked, budgets)",
        CHOSEN_SQL,
    ]


CHOSEN_SQL = """chosen AS (
  SELECT *, CASE WHEN selected THEN ed_up ELSE ed_ocr END AS ed_final, CASE WHEN selected THEN ok_up ELSE ok_ocr END AS ok_final,
    selected AND changed AS accepted FROM grid)"""

SUMMARY_SQL = """count(*) AS n_valid, count(*) FILTER (selected) AS n_upgraded, round(count(*) FILTER (selected) / count(*), 4) AS actual_call_rate,
  round(coalesce(sum(ed_final)::DOUBLE / nullif(sum(gt_len), 0), 0), 6) AS "CER",
  round(coalesce(count(*) FILTER (accepted)::DOUBLE / nullif(count(*) FILTER (selected), 0), 0), 4) AS "AER", 0.0::DOUBLE AS "CVR",
  round(coalesce(quantile_cont(CASE WHEN selected THEN latency_ms END, 0.95), 0), 3) AS p95_latency_ms,
  round(coalesce(sum(CASE WHEN selected THEN token_usage END)::DOUBLE / nullif(count(CASE WHEN selected THEN token_usage END), 0), 0), 3) AS avg_token_usage"""


def chosen_grid(spark: SparkSession, sf_dir: str, strategies=replay.STRATEGIES, budgets=replay.BUDGETS, keep=("domain",)) -> DataFrame:
    return replay.grid(replay.outcomes(cache(spark, sf_dir), keep), strategies, budgets)


def grid_cells(spark: SparkSession, sf_dir: str, keys=(), sums=None, strategies=replay.STRATEGIES, budgets=replay.BUDGETS) -> DataFrame:
    """`chosen_grid` in sums: a few rows per strategy, budget, choice and keys."""
    rows, cuts = replay.outcomes(cache(spark, sf_dir), keys), replay.cutoffs(figures(spark, sf_dir), strategies, budgets)
    found = replay.cells(rows, replay.costs() if sums is None else sums, strategies, budgets, keys, cuts=cuts)
    return replay.chosen(found) if sums is None else found
