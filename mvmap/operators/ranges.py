"""Total orders without a single task: ordered cells and what passes between them.

Rows are dealt to cells, ranges of the first order column cut at its quantiles.
Windows run inside a cell; what a cell needs of those around it (a sum, an end, a
running maximum) is one row per cell. The number of cells follows the number of rows,
up to ``MAX_CELLS``, which bounds the cut points in the plan and the rows of the
exchange between cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL, MAX_CELLS = 250_000, 1024


def place(rows: DataFrame, key: str) -> Column:
    """A number in the order of the key: itself, or the first seven bytes of text and
    bytes. Keys that agree in these are in one cell."""
    kind = rows.schema[key].dataType.typeName()
    if kind not in ("binary", "string"):
        return F.col(key)
    head = F.rpad(F.hex(F.substring(F.col(key).cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("bigint")


def cuts(rows: DataFrame, key: str, per_cell: int = ROWS_PER_CELL) -> list:
    """Ascending cut points between cells of about ``per_cell`` rows. Two reads of one column."""
    n = rows.agg(F.count(key).alias("n")).first()["n"]
    cells = min(MAX_CELLS, -(-n // per_cell))
    if cells < 2:
        return []
    found = rows.agg(F.percentile_approx(place(rows, key), [i / cells for i in range(1, cells)], 10 * cells).alias("c")).first()["c"]
    return sorted(set(found))


def cell(k: Column, points: list) -> Column:
    """The number of cut points at or below a place, by binary search."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def _carried(rows: DataFrame, value: Column, before, name: str) -> DataFrame:
    """rows with ``name``: ``before`` of the values that the cells ahead have in all."""
    ahead = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # One row per cell, MAX_CELLS at most: one task, and small enough to broadcast.
    ends = rows.groupBy("_cell").agg(before(value).alias("_of")).select("_cell", before(F.col("_of")).over(ahead).alias(name))
    return rows.join(F.broadcast(ends), "_cell")


def running(rows: DataFrame, order: list[str], value: Column, before, name: str, points: list | None = None) -> DataFrame:
    """rows with ``name``: ``before`` (F.sum, F.max) of ``value`` over all rows ahead in
    the total order; null for the first."""
    points = cuts(rows, order[0]) if points is None else points
    rows = rows.withColumn("_cell", cell(place(rows, order[0]), points))
    ahead = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _carried(rows, value, before, "_carried").withColumn("_inside", before(value).over(ahead))
    both = F.coalesce(F.col("_carried") + F.col("_inside"), "_carried", "_inside") if before is F.sum else F.greatest("_carried", "_inside")
    return rows.withColumn(name, both).drop("_cell", "_carried", "_inside")


def around(rows: DataFrame, key: str, points: list | None = None) -> DataFrame:
    """rows of distinct keys with ``prev_key`` and ``next_key``."""
    points = cuts(rows, key) if points is None else points
    rows = rows.withColumn("_cell", cell(place(rows, key), points))
    ends = rows.groupBy("_cell").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    w = Window.orderBy("_cell")
    ends = ends.select("_cell", F.lag("_hi").over(w).alias("_before"), F.lead("_lo").over(w).alias("_after"))
    inside = Window.partitionBy("_cell").orderBy(key)
    rows = rows.join(F.broadcast(ends), "_cell")
    rows = rows.withColumn("prev_key", F.coalesce(F.lag(key).over(inside), "_before")).withColumn("next_key", F.coalesce(F.lead(key).over(inside), "_after"))
    return rows.drop("_cell", "_before", "_after")


def nearest(probes: DataFrame, keys: DataFrame, probe: str, key: str, points: list | None = None) -> DataFrame:
    """For each distinct probe p: ``ge``, the least key >= p, ``lt``, the greatest key
    < p, and ``le``, the greatest key <= p. Each is one sort of a cell and one pass;
    those not asked for are not computed."""
    points = cuts(keys, key) if points is None else points
    kind = keys.schema[key].dataType
    k = keys.select(cell(place(keys, key), points).alias("_cell"), F.col(key).alias("_at"), F.lit(0).alias("_probe"))
    q = probes.select(F.col(probe).cast(kind).alias("_at")).distinct()
    q = q.select(cell(place(q, "_at"), points).alias("_cell"), "_at", F.lit(1).alias("_probe"))
    rows = k.union(q)
    key_at = F.when(F.col("_probe") == 0, F.col("_at"))
    # Cells with probes only need the ends of those around them, too: all cells have a row.
    ends = rows.groupBy("_cell").agg(F.min(key_at).alias("_lo"), F.max(key_at).alias("_hi"))
    w = Window.orderBy("_cell")
    ends = ends.select("_cell", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(w.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside = Window.partitionBy("_cell")
    last = lambda *order: F.last(key_at, ignorenulls=True).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at, kind_of = F.col("_at"), F.col("_probe")
    rows = rows.withColumn("ge", last(at.desc(), kind_of)).withColumn("lt", last(at, kind_of.desc())).withColumn("le", last(at, kind_of))
    rows = rows.filter("_probe = 1").join(F.broadcast(ends), "_cell")
    return rows.select(at.alias(probe), F.coalesce("ge", "_after").alias("ge"), F.coalesce("lt", "_before").alias("lt"), F.coalesce("le", "_before").alias("le"))


def covered(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str) -> DataFrame:
    """The distinct points inside a closed interval. Intervals may overlap: the greatest
    end of those that start at or before a point tells."""
    kind = intervals.schema[lo].dataType
    ends = intervals.select(F.col(lo).alias("_at"), F.lit(0).alias("_probe"), F.col(hi).alias("_hi"))
    asked = points.select(F.col(point).cast(kind).alias("_at")).distinct().select("_at", F.lit(1).alias("_probe"), F.lit(None).cast(kind).alias("_hi"))
    rows = running(ends.union(asked), ["_at", "_probe"], F.col("_hi"), F.max, "_seen")
    return rows.filter("_probe = 1 and _seen >= _at").select(F.col("_at").alias(point))


def sides(probes: DataFrame, at: str, rows: DataFrame, key: str, points: list, closed: bool = False, before: dict | None = None, after: dict | None = None) -> DataFrame:
    """probes with aggregates, by name, of the rows on either side of their ``at``:
    ``before`` of those with a key below it (``closed``: or at it), ``after`` of the
    others. name -> (F.sum, F.min or F.max, column of rows); a sum of none is 0. Equal
    probes stay apart. Probes are read once, rows twice."""
    before, after = before or {}, after or {}
    asked = {**before, **after}
    probe_turn, row_turn = (1, 0) if closed else (0, 1)
    held = rows.select(cell(place(rows, key), points).alias("_cell"), F.col(key).alias("_at"), F.lit(row_turn).alias("_turn"), *[c.alias(n) for n, (_, c) in asked.items()])
    q = probes.select(cell(place(probes, at), points).alias("_cell"), F.col(at).alias("_at"), F.lit(probe_turn).alias("_turn"), F.struct(*probes.columns).alias("_row"))
    # Cells with probes only need what is around them, too: all cells have a row.
    cells = rows.sparkSession.range(len(points) + 1).select(F.col("id").cast("int").alias("_cell"))
    ends = held.select("_cell", *asked).unionByName(cells, allowMissingColumns=True).groupBy("_cell").agg(*[f(n).alias(n) for n, (f, _) in asked.items()])
    around_cell = lambda n: Window.orderBy(F.col("_cell") if n in before else F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_cell", *[f(n).over(around_cell(n)).alias(f"_carried_{n}") for n, (f, _) in asked.items()])
    inside = Window.partitionBy("_cell")
    order = lambda n: inside.orderBy("_at", "_turn") if n in before else inside.orderBy(F.col("_at").desc(), F.col("_turn").desc())
    out = held.unionByName(q, allowMissingColumns=True).withColumns({n: f(n).over(order(n).rowsBetween(Window.unboundedPreceding, 0)) for n, (f, _) in asked.items()})
    out = out.filter(F.col("_turn") == probe_turn).join(F.broadcast(ends), "_cell")

    def both(n, f):
        if f is F.sum:
            return F.coalesce(n, F.lit(0)) + F.coalesce(f"_carried_{n}", F.lit(0))
        return (F.least if f is F.min else F.greatest)(n, f"_carried_{n}")

    return out.select("_row.*", *[both(n, f).alias(n) for n, (f, _) in asked.items()])


def meeting(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, per_group: int = 64) -> DataFrame:
    """Pairs of closed intervals that share a key: b starts inside a, or a starts inside
    b and later. Starts are numbered in order; an interval is met by a run of numbers and
    has a copy for each group of ``per_group`` numbers in it, so rows compared grow with
    the intervals and the pairs found, and copies with the pairs by ``per_group``."""
    a, b = a.filter(F.col(a_lo) <= F.col(a_hi)), b.filter(F.col(b_lo) <= F.col(b_hi))
    points = cuts(a.select(F.col(a_lo).alias("_at")).union(b.select(b_lo)), "_at")

    def starting(x, lo, hi, y, at, later):
        """Pairs whose y starts inside x; ``later``: after x's start."""
        # All columns order equal starts, so that a task run again numbers them alike.
        y = running(y, [at, *[c for c in y.columns if c != at]], F.lit(1), F.sum, "_no", points).withColumn("_no", F.coalesce("_no", F.lit(0)))
        y = y.withColumn("_group", F.floor(F.col("_no") / per_group))
        starts, one = y.select(at), (F.sum, F.lit(1))
        x = sides(x, lo, starts, at, points, later, before={"_from": one})
        x = sides(x, hi, starts, at, points, True, before={"_upto": one}).filter("_from < _upto")
        x = x.withColumn("_group", F.explode(F.sequence(F.floor(F.col("_from") / per_group), F.floor((F.col("_upto") - 1) / per_group))))
        return x.join(y, "_group").filter("_from <= _no and _no < _upto").drop("_group", "_no", "_from", "_upto")

    found = starting(a, a_lo, a_hi, b, b_lo, False)
    return found.unionByName(starting(b, b_lo, b_hi, a, a_lo, True))
