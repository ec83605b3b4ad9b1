"""Portfolio builders (W14) as compositions of the operators; each is one lazy plan over all dates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorframe.operators import portfolio as w


def box_based(signals: DataFrame, boxes: DataFrame, targets: DataFrame, per_box=3, allocation="equal", minimum=0.0,
              max_leverage=1.0, maximum: float | None = None) -> DataFrame:
    """Select in boxes, allocate the box targets, apply the constraints."""
    chosen = w.with_targets(w.select_in_boxes(signals, boxes, per_box), targets)
    weights = {"equal": w.equal_in_box, "signal_proportional": w.proportional_in_box}[allocation](chosen)
    return w.constrained(weights.drop("box"), minimum, max_leverage, maximum)


def quantitative(signals: DataFrame, liquid: DataFrame, cov: DataFrame, n=20, method="mean_variance", cap=0.1,
                 limits: list[tuple[str, str, float]] = (), classes: DataFrame | None = None) -> DataFrame:
    """Liquid names, strongest signals, one optimisation per date.  liquid(symbol)."""
    chosen = w.strongest(signals.join(liquid.select("symbol"), "symbol", "left_semi"), n)
    if method == "equal_weight":
        return w.equal_weight(chosen)
    if method == "top_n":
        return w.top_n_weight(chosen, n)
    if classes is not None:
        chosen = chosen.join(classes, "symbol")
    return w.mean_variance(chosen, cov, cap=cap, limits=limits)
