"""Adapters for injected recognisers and experts, and the operators that call them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Expert(Protocol):
    """Anything that answers requests: one dict with `corrected_text` (and optionally raw_output,
    latency_ms, token_usage, error_type) for each request dict."""

    def query(self, request: dict) -> dict: ...


RESULT = "final_text_if_upgraded string, vlm_raw_output string, latency_ms double, token_usage long, error_type string"


def called(df: DataFrame, make: Callable[[], Expert], request: Sequence[str], key: str, text: str, retries: int = 0) -> DataFrame:
    """One call per row, with a client per task. A failing call is repeated up to `retries` times and
    then falls back to the text with its error's name."""
    names = [p.split()[0] for p in RESULT.split(", ")]

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        found = client.query({k: r[k] for k in request})
                        break
                    except Exception as e:  # an expert's failure is a result here
                        found = {"error_type": type(e).__name__} if attempt == retries else None
                answer = found.get("corrected_text") or r[text]
                usage = found.get("token_usage")
                out.append((r[key], answer, found.get("raw_output", found.get("corrected_text", "")), found.get("latency_ms"), None if usage is None else int(usage), found.get("error_type", "none")))
            yield pd.DataFrame(out, columns=[key, *names]).astype({"token_usage": "Int64", "latency_ms": "float64"})

    kind = dict(df.dtypes)[key]
    wanted = list(dict.fromkeys([key, text, *request]))
    return df.select(*wanted).mapInPandas(per_task, f"{key} {kind}, {RESULT}")


class EchoExpert:
    """A mock that answers by a map, or with a fixed transformation of the text."""

    def __init__(self, answers: Mapping[str, str] | None = None, field: str = "ocr_text"):
        self.answers, self.field = answers or {}, field

    def query(self, request: dict) -> dict:
        text = request[self.field]
        return {"corrected_text": self.answers.get(text, text), "latency_ms": 1.0, "token_usage": len(text)}


def mocked(key: Column, answers: Mapping[str, str], default: str = "") -> Column:
    """A mock recogniser: a small map from ids to texts."""
    if not answers:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in answers.items() for x in kv]), key), F.lit(default))


_FACTORIES: dict[str, Callable[..., Expert]] = {"echo": EchoExpert}


def register_expert(kind: str, make: Callable[..., Expert]) -> None:
    _FACTORIES[kind] = make


def expert(kind: str, **options) -> Callable[[], Expert]:
    """A factory of experts by kind, to be called once per task."""
    if kind not in _FACTORIES:
        raise ValueError(f"unknown expert {kind}")
    make = _FACTORIES[kind]
    return lambda: make(**options)


def first_passing(df: DataFrame, key: str, ratios: Sequence[float], attempt: Callable[[Column], Column], passes: Callable[[Column], Column]) -> DataFrame:
    """(key, ratio, outcome): the least of `ratios` at which the attempt passes; rows with none are left
    out. Attempts are tried in one array per row, so no row is multiplied."""
    tried = F.array(*[F.struct(F.lit(float(r)).alias("ratio"), attempt(F.lit(float(r))).alias("outcome")) for r in sorted(ratios)])
    good = df.select(key, F.get(F.filter(tried, lambda t: passes(t["outcome"])), F.lit(0)).alias("t")).where("t is not null")
    return good.select(key, "t.ratio", "t.outcome")
