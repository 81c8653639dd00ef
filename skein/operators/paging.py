"""Pages, top rows, sorts and dedup by rank."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after(order: list[tuple[str, bool]], anchor: tuple, include: bool = False) -> Column:
    """Rows beyond the anchor in an order of (column, ascending): a comparison of tuples, column by column."""
    out = F.lit(include)
    for (c, up), v in reversed(list(zip(order, anchor, strict=True))):
        beyond = F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)
        out = beyond | ((F.col(c) == F.lit(v)) & out)
    return out


def keyset(df: DataFrame, order: list[tuple[str, bool]], anchor: tuple | None, size: int, include: bool = False) -> DataFrame:
    """A page of ``size`` rows and one more, which tells whether there are others."""
    rows = df if anchor is None else df.where(after(order, anchor, include))
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(size + 1)


def cursor(scope: str, order: list[tuple[str, bool]], row: dict, include: bool) -> str:
    return json.dumps({"scope": scope, "at": [row[c] for c, _ in order], "include": include}, default=str)


def page(df: DataFrame, scope: str, order: list[tuple[str, bool]], size: int, token: str | None = None) -> tuple[list, str | None, str | None]:
    """Rows of a page, the cursor of the next page (behind its last row; None at the end) and the one back (from its first row).
    A cursor of another scope raises a ValueError."""
    anchor, include = None, False
    if token:
        held = json.loads(token)
        if held["scope"] != scope:
            raise ValueError("the cursor belongs to another listing")
        anchor, include = tuple(held["at"]), held["include"]
    rows = keyset(df, order, anchor, size, include).collect()
    shown = rows[:size]
    following = cursor(scope, order, shown[-1].asDict(), False) if len(rows) > size else None
    return shown, following, cursor(scope, order, shown[0].asDict(), True) if shown else None


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int, check: bool = False) -> DataFrame:
    if check and offset > df.count():
        raise ValueError("the offset is beyond the last row")
    return df.orderBy(*order).offset(offset).limit(size)


def batch_newest(df: DataFrame, key: list[str], position: str, size: Column, rows: int, cap: int) -> DataFrame:
    """The newest rows of each log, within both limits; the newest is given even if it alone is over the cap."""
    w = Window.partitionBy(*key).orderBy(F.desc(position))
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("_n") == 1) | ((F.col("_n") <= rows) & (F.col("_b") <= cap))).drop("_n", "_b")


def best_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order, which should end with something unique."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_total(df: DataFrame, order: list, n: int, into: str = "total") -> DataFrame:
    """The first ``n`` rows, each with how many there are in all."""
    total = df.agg(F.count("*").alias(into))
    return df.orderBy(*order).limit(n).join(F.broadcast(total))


def natural_key(text: Column) -> list[Column]:
    """Sort keys of names with numbers: what stands before the first number, the number, the rest."""
    return [F.regexp_extract(text, r"^(\D*)", 1), F.regexp_extract(text, r"^\D*(\d+)", 1).try_cast("long"), text]


def rank_bucket(rank: Column) -> Column:
    return F.when(rank == 1, "1").when(rank <= 5, "2_5").when(rank <= 10, "6_10").when(rank <= 20, "11_20").otherwise("miss")


def basis_points(a: str, b: str) -> Column:
    """a / b in hundredths of a percent, rounded down; 0 where b is 0."""
    return F.expr(f"case when {b} = 0 then 0 else {a} * 10000 div {b} end")
