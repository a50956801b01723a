"""Text reports and character charts of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def _text(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, float):
        return f"{v:,.2f}" if abs(v) >= 1000 else f"{v:.4f}"
    return str(v)


def report(title: str, rows: DataFrame, order: str | None = None) -> str:
    """A titled table; refuses tables that are no report."""
    rows = rows.orderBy(order) if order else rows
    held = rows.limit(MOST_ROWS + 1).collect()
    if len(held) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    cells = [rows.columns, *[[_text(v) for v in r] for r in held]]
    wide = [max(len(c[k]) for c in cells) for k in range(len(rows.columns))]
    lines = ["  ".join(x.rjust(w) if n else x.ljust(w) for n, (x, w) in enumerate(zip(c, wide))).rstrip() for c in cells]
    return "\n".join([title, "=" * len(title), lines[0], "-" * len(lines[0]), *lines[1:]])


def _canvas(points: list[tuple[int, int, str]], width: int, height: int) -> list[str]:
    grid = [[" "] * width for _ in range(height)]
    for x, y, mark in points:
        grid[height - 1 - y][x] = mark
    return ["".join(r).rstrip() for r in grid]


def equity_chart(curve: DataFrame, width: int = 60, height: int = 12, order: str = "t", value: str = "equity") -> str:
    """One mark a column: the value at index floor(column * n / width); the rows that are shown are all that is collected."""
    n = curve.count()
    if not n:
        return "(no data)"
    width = min(width, n)
    wanted = sorted({c * n // width for c in range(width)})
    rows = curve.where(curve[order].isin(wanted)).orderBy(order).select(value).collect()
    values = [r[0] for r in rows]
    low, high = min(values), max(values)
    level = [round((v - low) / (high - low) * (height - 1)) if high > low else 0 for v in values]
    lines = _canvas([(x, y, "*") for x, y in enumerate(level)], width, height)
    return "\n".join([f"{high:,.2f}", *lines, f"{low:,.2f}"])


def frontier_chart(points: DataFrame, width: int = 60, height: int = 16) -> str:
    """Expected return over volatility; o marks the highest Sharpe ratio."""
    held = points.limit(MOST_ROWS).collect()
    if not held:
        return "(no data)"
    xs, ys = [r.volatility for r in held], [r.expected_return for r in held]
    best = max(range(len(held)), key=lambda k: held[k].sharpe)
    place = lambda v, a, n: round((v - min(a)) / (max(a) - min(a)) * (n - 1)) if max(a) > min(a) else 0
    marks = [(place(x, xs, width), place(y, ys, height), "*") for x, y in zip(xs, ys)]
    return "\n".join([f"return {min(ys):.4f} to {max(ys):.4f}", *_canvas([*marks, (*marks[best][:2], "o")], width, height), f"volatility {min(xs):.4f} to {max(xs):.4f}"])
