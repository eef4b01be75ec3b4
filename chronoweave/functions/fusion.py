"""Fusion, softmax and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(xs: list[Column]) -> list[Column]:
    top = F.greatest(*xs)
    e = [F.exp(x - top) for x in xs]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def masked_softmax_fuse(values: list[Column], scores: list[Column], masks: list[Column], eps: float = 1e-8) -> Column:
    """Weighted mean by softmax of the scores over available modalities; 0 if all are absent."""
    top = F.coalesce(F.greatest(*(F.when(m, s) for s, m in zip(scores, masks, strict=True))), F.lit(0.0))
    w = [F.when(m, F.exp(s - top)).otherwise(0.0) for s, m in zip(scores, masks, strict=True)]
    total = sum(w[1:], w[0])
    terms = [F.coalesce(x, F.lit(0.0)) * v for x, v in zip(values, w, strict=True)]
    return sum(terms[1:], terms[0]) / F.greatest(total, F.lit(eps))


def inverse_variance_fuse(values: list[Column], log_variances: list[Column], masks: list[Column], limit: float = 4.0) -> Column:
    """The same with minus the clamped log variance as score."""
    return masked_softmax_fuse(values, [-F.greatest(F.lit(-limit), F.least(F.lit(limit), x)) for x in log_variances], masks)


def shared_mean_fuse(values: list[Column], masks: list[Column]) -> Column:
    """Sum over available modalities by their number, at least 1."""
    terms = [F.when(m, v).otherwise(0.0) for v, m in zip(values, masks, strict=True)]
    n = [F.when(m, 1).otherwise(0) for m in masks]
    return sum(terms[1:], terms[0]) / F.greatest(sum(n[1:], n[0]), F.lit(1))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes l, t, r, b; areas are clipped at 0, the denominator at 1e-12."""
    area = lambda x: F.greatest(F.lit(0.0), x["r"] - x["l"]) * F.greatest(F.lit(0.0), x["b"] - x["t"])
    inner = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])) * F.greatest(F.lit(0.0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    return inner / F.greatest(area(a) + area(b) - inner, F.lit(1e-12))


def relative_landmarks(x: Column, origin: Column, size: Column) -> Column:
    return (x - origin) / F.greatest(size, F.lit(1.0))


def polarity(label: Column) -> Column:
    return F.signum(label).cast("int")
