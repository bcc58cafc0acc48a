"""Number rules that must agree digit for digit with IEEE double arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_rounded(df: DataFrame, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add ``name: (source expression, digits)`` columns, the exact binary value rounded half to even.

    Built-in rounding works on the shortest decimal text, so 2.675 would go up although the
    stored double lies below the tie. Here the product with ``10^digits`` is computed together
    with its exact rounding error, which settles every apparent tie. The steps are projections of
    their own: as one expression the generated code would grow past what the JIT compiles.
    """
    split = "134217729D"  # 2**27 + 1 splits a double into two 26-bit halves
    values, products, parts, results = [], [], [], []
    for name, (source, digits) in columns.items():
        x, p, h, w, e = (f"_{step}_{name}" for step in "xphwe")
        scale = f"{10**digits}D"
        values.append(f"double({source}) AS {x}")
        products += [
            f"abs({x}) * {scale} AS {p}",
            f"abs({x}) * {split} - (abs({x}) * {split} - abs({x})) AS {h}",
        ]
        parts += [
            f"double(floor({p})) AS {w}",
            f"({h} * {scale} - {p}) + (abs({x}) - {h}) * {scale} AS {e}",
        ]
        up = f"{p} - {w} > 0.5D OR ({p} - {w} = 0.5D AND ({e} > 0D OR ({e} = 0D AND {w} % 2D = 1D)))"
        rounded = f"({w} + IF({up}, 1D, 0D)) / {scale}"
        results.append(f"IF({p} >= 4503599627370496D, {x}, IF({x} < 0D, -{rounded}, {rounded})) AS {name}")
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return (
        df.selectExpr("*", *values)
        .selectExpr("*", *products)
        .selectExpr("*", *parts)
        .selectExpr(*kept, *results)
    )


def with_fixed(df: DataFrame, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add ``name: (source expression, digits)`` columns as text with that many decimals."""
    rounded = with_rounded(df, columns)
    return rounded.withColumns({n: F.format_string(f"%.{d}f", F.col(n)) for n, (_, d) in columns.items()})


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
