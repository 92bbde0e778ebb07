"""Bands, buckets, grades and rule tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import params as P
from ledgerscope.functions.numeric import col, value_map


def right_closed(x: Column | str, edges: list, labels: list[str]) -> Column:
    """labels[i] for edges[i-1] < x <= edges[i]; the last label is open above."""
    x = col(x)
    out = F.when(x <= F.lit(edges[0]), labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= F.lit(edge), label)
    return out.when(x > F.lit(edges[-1]), labels[len(edges)])


def inside_edges(x: Column | str, edges: list, labels: list[str]) -> Column:
    """Right-closed bands between the outer edges; null at or below the first and above the last."""
    x = col(x)
    inner = right_closed(x, edges[1:], labels + [None])
    return F.when((x > F.lit(edges[0])) & (x <= F.lit(edges[-1])), inner)


def left_closed_cuts(x: Column | str, cuts: list, labels: list[str]) -> Column:
    """Descending cut points: labels[i] where x >= cuts[i], else the last label."""
    x = col(x)
    out = F.when(x >= F.lit(cuts[0]), labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(x >= F.lit(cut), label)
    return out.when(x.isNotNull(), labels[-1])


def dpd_bucket(dpd: Column | str) -> Column:
    return right_closed(dpd, [0, 30, 60, 90], P.BUCKETS)


def bucket_rank(bucket: Column | str) -> Column:
    return value_map(bucket, {b: i for i, b in enumerate(P.BUCKETS)})


def grade_rank(grade: Column | str) -> Column:
    return value_map(grade, {g: i + 1 for i, g in enumerate(P.GRADES)})


def per_product(product: Column | str, x: Column | str, table: dict) -> Column:
    out = None
    for name, (edges, labels) in table.items():
        band = right_closed(x, edges, labels)
        out = F.when(col(product) == name, band) if out is None else out.when(col(product) == name, band)
    return out


def tenure_band(product: Column | str = "product_type", tenure: Column | str = "tenure_mo") -> Column:
    return per_product(product, tenure, P.TENURE_BANDS)


def ticket_band(product="product_type", ticket="ticket_size", table: dict | None = None) -> Column:
    return per_product(product, ticket, table or P.TICKET_BANDS)


def cashflow_band(x: Column | str) -> Column:
    return inside_edges(x, P.CASHFLOW_EDGES, P.CASHFLOW_LABELS)


def canonical_product(text: Column | str) -> Column:
    t = F.lower(F.trim(col(text)))
    return (
        F.when(t.startswith("bnpl"), "BNPL")
        .when(t.startswith("personal"), "Personal")
        .when(t.startswith("sme"), "SME")
        .otherwise(col(text))
    )


def segment(rules: dict, product="product_type", grade="origination_risk_grade") -> Column:
    """Segment by product and grade group; null where no rule matches."""
    out = None
    for name, groups in rules.items():
        for grades, label in groups.items():
            hit = (col(product) == name) & col(grade).isin(*grades)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def heuristic_segment() -> Column:
    return segment(P.HEURISTIC_SEGMENTS)


def frozen_segment() -> Column:
    return segment(P.FROZEN_SEGMENTS)


def hybrid_segment(cutoff: float = P.HIGH_APR) -> Column:
    danger = F.col("interest_rate_apr") > F.lit(cutoff)
    return F.when(danger, P.HIGH_APR_SEGMENT).otherwise(segment(P.HYBRID_SEGMENTS))


def posture(risk_pct: Column | str, value: Column | str, limits=P.POSTURE_SEASONED) -> Column:
    split, floor, high = limits
    return (
        F.when(col(value) < F.lit(floor), "exit")
        .when(col(risk_pct) > F.lit(split), "contain")
        .when(col(value) > F.lit(high), "grow")
        .otherwise("maintain")
    )


def warning_band(dpd, score, red, amber) -> Column:
    return (
        F.when(col(dpd) >= P.ESCALATION_DPD, "ESCALATION")
        .when(col(score) >= red, "RED")
        .when(col(score) >= amber, "AMBER")
        .otherwise("GREEN")
    )


def behavioural_distress() -> Column:
    return (
        (F.col("bounce_streak") >= 2)
        | (F.col("bounce_count_3m") >= 3)
        | ((F.col("utilisation_level") >= 70) & (F.col("spending_shock_rate_3m") > 0))
    )


def after_last_dot(text: Column | str) -> Column:
    """Last part after '. ', the display name of a numbered segment."""
    return F.element_at(F.split(col(text), r"\. "), -1)
