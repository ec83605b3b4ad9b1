"""Registry of runnable queries, each with the same question asked in plain SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.sources.panel import SQL, Panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _needed(SQL[n][0].split(), seen)
            seen.append(n)
    return seen


def sql_over(tables: str, body: str) -> str:
    """``body`` over the named panel tables, added as common table expressions."""
    names = _needed(tables.split(), [])
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in names)
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def nudge(places: int) -> float:
    """Shift before rounding: engines round exact halves differently; adding 0.0 afterwards turns -0.0 into 0.0."""
    return 1.7 * 10.0 ** -(places + 3)


def query(name: str, tables: str = "", sql: str | None = None, digits: str = ""):
    """Register ``fn(panel) -> DataFrame``; ``digits`` ("a:6 b:3") rounds both sides alike."""
    places = {c: int(d) for c, d in (x.split(":") for x in digits.split())}

    def register(fn: Callable[[Panel], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Panel(spark, sf_dir))
            return df.select(*[(F.round(F.col(c) + F.lit(nudge(places[c])), places[c]) + F.lit(0.0)).alias(c)
                               if c in places else F.col(c) for c in df.columns])

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            text = sql_over(tables, sql)
            if places:
                rep = ", ".join(f"round({c} + CAST({nudge(d)!r} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in places.items())
                text = f"SELECT * REPLACE ({rep}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return register


def load_all() -> None:
    from factorframe.plans import (  # noqa: F401
        q_quality, q_universe, q_align, q_transforms, q_technical, q_crosssection, q_classify, q_estimate, q_ml,
        q_signals, q_portfolio, q_analytics, q_monitor, q_sources,
    )
