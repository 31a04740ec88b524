"""Figures of small report tables as SVG text. Spark places the points; only a row for each point reaches the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import profile

WIDTH, HEIGHT = 680, 460
LEFT, RIGHT, TOP, BOTTOM = 70, 640, 50, 400
COLOURS = ("#1b5e8c", "#b3541e", "#3f7d3a", "#6b4c9a")


def curve_points(rows: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """``keys``, and x and y in pixels, of shares in [0, 1]. A row without x or y (an empty bin, or no suggestion to be right) is no point."""
    zero, one = F.lit(0.0), F.lit(1.0)
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.select(*keys, profile.pixels(F.col(x), zero, one, LEFT, RIGHT).alias("x"), profile.pixels(F.col(y), zero, one, BOTTOM, TOP).alias("y"))


def reliability_points(bins: Mapping[str, DataFrame]) -> DataFrame:
    """series, bin, x and y of reliability bins (bin, mean_confidence, accuracy) by series."""
    out: DataFrame | None = None
    for name, rows in bins.items():
        own = rows.select(F.lit(name).alias("series"), "bin", "mean_confidence", "accuracy")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("figure_without_series")
    return curve_points(out, "mean_confidence", "accuracy", ["series", "bin"])


def risk_points(swept: DataFrame) -> DataFrame:
    """threshold, x (coverage) and y (selective risk) of a threshold sweep."""
    return curve_points(swept, "coverage", "selective_risk", ["threshold"])


def reliability_svg(bins: Mapping[str, DataFrame], title: str = "Reliability") -> str:
    """A curve for each series, beside the diagonal of perfect calibration."""
    points = _collected(reliability_points(bins), F.col("series"), F.col("bin"))
    return lines_svg({name: points.get(name, []) for name in bins}, title, "mean confidence", "accuracy", diagonal=True)


def risk_coverage_svg(swept: DataFrame, title: str = "Risk and coverage") -> str:
    return lines_svg(_collected(risk_points(swept).withColumn("series", F.lit("thresholds")), F.col("series"), -F.col("threshold")), title, "coverage", "selective risk")


def _collected(points: DataFrame, series: Column, order: Column) -> dict[str, list[tuple[float, float]]]:
    found: dict[str, list[tuple[float, float]]] = {}
    for row in points.select(series.alias("series"), order.alias("at"), "x", "y").orderBy("series", "at").collect():
        found.setdefault(row["series"], []).append((row["x"], row["y"]))
    return found


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def lines_svg(series: Mapping[str, Sequence[tuple[float, float]]], title: str, x_label: str, y_label: str, diagonal: bool = False) -> str:
    """Curves over the unit square; points are pixels. Equal input gives equal bytes."""
    parts = [f"<title>{escaped(title)}</title>", f'<text x="{LEFT}" y="28" font-size="18" font-weight="bold">{escaped(title)}</text>']
    for i in range(6):
        x, y = LEFT + (RIGHT - LEFT) * i / 5, BOTTOM - (BOTTOM - TOP) * i / 5
        parts.append(f'<path d="M{LEFT} {y:.1f}H{RIGHT}M{x:.1f} {TOP}V{BOTTOM}" stroke="#dddddd"/>')
        parts.append(f'<text x="{x:.1f}" y="{BOTTOM + 18}" text-anchor="middle">{i / 5:.1f}</text><text x="{LEFT - 8}" y="{y + 4:.1f}" text-anchor="end">{i / 5:.1f}</text>')
    parts.append(f'<text x="{(LEFT + RIGHT) // 2}" y="{BOTTOM + 42}" text-anchor="middle">{escaped(x_label)}</text>')
    parts.append(f'<text x="20" y="{(TOP + BOTTOM) // 2}" text-anchor="middle" transform="rotate(-90 20 {(TOP + BOTTOM) // 2})">{escaped(y_label)}</text>')
    if diagonal:
        parts.append(f'<path d="M{LEFT} {BOTTOM}L{RIGHT} {TOP}" stroke="#888888" stroke-dasharray="5 4"/>')
    for i, (name, points) in enumerate(series.items()):
        colour = COLOURS[i % len(COLOURS)]
        if points:
            parts.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.2f},{y:.2f}" for x, y in points)}"/>')
        parts += [f'<circle cx="{x:.2f}" cy="{y:.2f}" r="3" fill="{colour}"/>' for x, y in points]
        parts.append(f'<text x="{LEFT + 12}" y="{TOP + 18 + 18 * i}" fill="{colour}">{escaped(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">{"".join(parts)}</svg>\n'
