"""Panel cube: the figures of every panel filter, from stored counts.

A *cell* is a choice of panel filters: a type and a region (dashboard), or a
type, a city and a room bucket (analysis), each of them or none.  Two tables
are stored for all cells that have a listing:

* ``totals`` – rows, mean, least and greatest price of a cell;
* ``slices`` – of each measure's ordered slices (``wide_slice``) that a
  cell has values in: how many there are, how many come before, the least and
  the greatest one.

Both are made from one aggregate each of the listings by their own attributes,
combined map-side; cells are formed from its rows, whose number has a bound
(attributes x slices), not from the listings.

A quantile of a cell is an exact value: the stored running counts tell which
slice holds the wanted rank.  A slice with one value is that value; otherwise
the cell's rows in that slice alone are read from the listings and ranked, on
the driver if they are few, else by a grouped count.  A panel reads its totals
and slices in one scan and the listings at most once, whatever the number of its
types and measures; the histogram counts the cell's listings by bin.

Surface bounds are not part of a cell (they are any two numbers); panels with
them are computed from the rows.

``values`` has each cell's distinct values with running counts.  It is a view:
no panel needs it, and all cells' values are many times the listings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from immolens.functions.numeric import merged_parts, parts_mean, sum_parts
from immolens.operators import market
from immolens.operators.stats import interpolate, value_slice

DIMENSIONS = ("type", "region", "city", "rooms")
PRICES = ("prix", "prix_m2")
MEASURES = (*PRICES, "surface", "pieces")      # input ranges are those of all listings
# The attributes that cells are made by: a type or none, and a place or none.
PLACES = ((), ("region",), ("city",), ("rooms",), ("city", "rooms"))
CELLS = (*PLACES, *(("type", *by) for by in PLACES))
# A cell's slices to an octave; rows of wanted slices that the driver ranks.
OCTAVE_SLICES = 32
FEW = 1 << 17

Cell = tuple[str | None, str | None, str | None, str | None]


# --------------------------------------------------------------------- build
def _measured(rows: DataFrame) -> DataFrame:
    """Each row's own attributes, those that panels filter by, and its measures.

    A listing has at most one of the types that panels know."""
    has, nothing = rows.columns, F.lit(None).cast("string")
    own = nothing
    for name, flag in reversed(market.TYPE_COL_MAP.items()):
        if flag in has:
            own = F.when(F.col(flag), F.lit(name)).otherwise(own)
    region, city = (F.col(c) if c in has else nothing for c in ("region", "city"))
    prix, surface = F.col("prix").cast("double"), F.col("surface").cast("double")
    pieces = F.col("pieces").cast("double") if "pieces" in has else F.lit(None).cast("double")
    return rows.select(
        own.alias("type"), region.alias("region"), city.alias("city"),
        (market.room_bucket("pieces") if "pieces" in has else nothing).alias("rooms"),
        prix.alias("prix"), F.try_divide(prix, surface).alias("prix_m2"),
        surface.alias("surface"), pieces.alias("pieces"))


def _in_cells(own: DataFrame) -> DataFrame:
    """Each row of own attributes once per cell that it is in.

    Every row gives all the choices of ``CELLS``; those by an attribute that it lacks go
    after the generator.  From an array whose size depends on the row Catalyst infers a
    filter, which it pushes below the aggregate that made ``own``: each listing would
    then form its cells only to be counted."""
    rest = [c for c in own.columns if c not in DIMENSIONS]
    nothing = F.lit(None).cast("string")
    cells = F.array(*[F.struct(
        reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in by], F.lit(True)).alias("_there"),
        *[(F.col(d) if d in by else nothing).alias(d) for d in DIMENSIONS]) for by in CELLS])
    return (own.select(F.explode(cells).alias("_cell"), *rest).where("_cell._there")
            .select(*[F.col(f"_cell.{d}").alias(d) for d in DIMENSIONS], *rest))


def totals_of(rows: DataFrame) -> DataFrame:
    """One row per cell that has a listing."""
    own = _measured(rows).groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), *sum_parts("prix", "p"), F.min("prix").alias("low"),
        F.max("prix").alias("high"), F.count_if(F.col("surface") > 0).alias("with_surface"))
    return _in_cells(own).groupBy(*DIMENSIONS).agg(
        F.sum("n").alias("n"), *merged_parts("p"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("with_surface").alias("with_surface")).select(
        *DIMENSIONS, "n", parts_mean("p").alias("mean"), "low", "high", "with_surface")


def _long(rows: DataFrame) -> DataFrame:
    """(attributes, measure, value) of each row; surfaces and rooms are counted for all
    listings only, so they have no attributes.

    Nulls are left out after the generator: functions on arrays before it would be
    interpreted for each row, and again for the filter that Catalyst infers from them."""
    items = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])
    price = F.col("x.measure").isin(*PRICES)
    return (_measured(rows).select(*DIMENSIONS, F.explode(items).alias("x"))
            .where(F.col("x.value").isNotNull())
            .select(*[F.when(price, F.col(d)).alias(d) for d in DIMENSIONS], "x.measure", "x.value"))


def wide_slice(v: Column) -> Column:
    """A long that never falls when the double ``v`` rises (NaN comes last): equal
    steps of the logarithm, which is all that is computed for each value."""
    steps = F.least(F.log2(F.abs(v)), F.lit(1024.0)) * OCTAVE_SLICES
    place = F.floor(steps) + F.lit(1075 * OCTAVE_SLICES)
    return (F.when(F.isnan(v), F.lit(1 << 24)).when(v == 0, F.lit(0))
            .when(v < 0, -place).otherwise(place).cast("long"))


def slices_of(rows: DataFrame) -> DataFrame:
    """(cell, measure, slice, n, before, total, least, most)."""
    keys = [*DIMENSIONS, "measure"]
    least, most = F.min("least").alias("least"), F.max("most").alias("most")
    own = (_long(rows).withColumn("slice", wide_slice(F.col("value"))).groupBy(*keys, "slice")
           .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))
    cells = _in_cells(own).groupBy(*keys, "slice").agg(F.sum("n").alias("n"), least, most)
    whole = Window.partitionBy(*keys)
    upto = F.sum("n").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(*keys, "slice", "n", (upto - F.col("n")).alias("before"),
                        F.sum("n").over(whole).alias("total"), "least", "most")


def values_of(rows: DataFrame) -> DataFrame:
    """(cell, measure, value, n, before, total) for all cells.

    The running counts are made as ``stats.quantile_table`` does it: totals of ordered
    slices and a window inside each slice, so a cell with all rows is not one task's work."""
    keys = [*DIMENSIONS, "measure"]
    own = _long(rows).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = (_in_cells(own).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
              .withColumn("slice", wide_slice(F.col("value"))))
    upto = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy("value")
                           .rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
                                       for k in (*keys, "slice")])
    slices = slices_of(rows).select(*keys, "slice", F.col("before").alias("first"), "total")
    joined = counts.alias("c").join(slices.alias("s"), same).select("c.*", "s.first", "s.total")
    return (joined.withColumn("before", F.col("first") + upto - F.col("n"))
            .select(*keys, "value", "n", "before", "total"))


# --------------------------------------------------------------------- query
def _local(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A panel's few rows as a local relation (no job to read it)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in
                                           zip(columns, arrow, strict=True)], schema=arrow))


def _whole(value: float | None) -> int | None:
    """C11 for a figure on the driver: truncated; null when no long holds it."""
    return int(value) if value is not None and abs(value) < 1 << 63 else None


class PanelCube:
    """The panels over the stored tables; ``rows`` serve surface bounds."""

    def __init__(self, totals: DataFrame, slices: DataFrame, rows: DataFrame):
        self.totals, self.slices, self.rows = totals, slices, rows

    @classmethod
    def build(cls, rows: DataFrame, store: Callable[[str, Callable[[], DataFrame]], DataFrame]
              ) -> PanelCube:
        """``store(name, make)`` writes a table once and reads it back."""
        return cls(store("cube_totals", lambda: totals_of(rows)),
                   store("cube_slices", lambda: slices_of(rows)), rows)

    @property
    def values(self) -> DataFrame:
        """Every cell's distinct values with running counts."""
        return values_of(self.rows)

    def cell(self, type_str=None, region=None, zone=None, rooms=None) -> Cell:
        """The cell of a panel's parameters, read as ``panel_filter`` does."""
        has = self.rows.columns
        known = market.TYPE_COL_MAP.get(type_str) in has
        return (type_str if known else None,
                region if region not in (None, "", market.ALL_REGIONS) and "region" in has else None,
                zone if zone not in (None, "", market.ALL_CITIES) and "city" in has else None,
                rooms if rooms in market.ROOM_BUCKETS and "pieces" in has else None)

    @staticmethod
    def _is(cell: Cell) -> Column:
        return reduce(lambda a, b: a & b, [
            F.col(d).isNull() if v is None else F.col(d) == v
            for d, v in zip(DIMENSIONS, cell, strict=True)])

    def _typed(self, cell: Cell, types: list[str]) -> dict[str, Cell]:
        """The cells of a panel's types inside a cell; those that can hold a row."""
        return {t: (t, *cell[1:]) for t in types
                if market.TYPE_COL_MAP[t] in self.rows.columns and cell[0] in (None, t)}

    def _read(self, cells: Iterable[Cell], wanted: Iterable[tuple[Cell, str]], probs: list[float]
              ) -> tuple[dict[Cell, dict], dict[tuple[Cell, str], list]]:
        """The totals of the cells that have a row, and the slices that hold the wanted
        ranks: one pruned scan of both tables."""
        either = lambda all_: reduce(lambda a, b: a | b, all_)
        cells, wanted, parts = list(cells), list(wanted), []
        total = F.col("total") - 1
        ranks = [r for p in probs for r in (F.floor(F.lit(float(p)) * total),
                                            F.ceil(F.lit(float(p)) * total))]
        if cells:
            parts.append(self.totals.where(either(map(self._is, cells))))
        if wanted:
            asked = either(self._is(c) & (F.col("measure") == m) for c, m in wanted)
            holds = either((F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in ranks)
            parts.append(self.slices.where(asked & holds))
        if not parts:
            return {}, {}
        found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect()
        totals: dict[Cell, dict] = {}
        slices: dict[tuple[Cell, str], list] = {}
        for r in found:
            own = r.asDict()
            cell = tuple(own.get(d) for d in DIMENSIONS)
            if own.get("measure") is None:
                totals[cell] = own
            else:
                slices.setdefault((cell, own["measure"]), []).append(own)
        return totals, slices

    def _mine(self, cell: Cell) -> Column:
        """Whether a row's own attributes put it into a cell."""
        return reduce(lambda a, b: a & b, [F.col(d) == v for d, v in zip(DIMENSIONS, cell, strict=True)
                                           if v is not None], F.lit(True))

    def _ranked(self, asked: list[tuple[Cell, str, dict, list[int]]]) -> dict[tuple[int, int], float]:
        """{(i, rank): value}: the values at given ranks inside of slices, the i-th of
        which is (cell, measure, slice, ranks).  One scan of the rows where few are in
        these slices; else finer slices are counted first, and values inside of those."""
        hits = _measured(self.rows).where(reduce(lambda a, b: a | b, [
            F.col(m).between(s["least"], s["most"]) for _, m, s, _ in asked]))
        hits = hits.select(F.explode(F.array(*[
            F.when(self._mine(c) & F.col(m).between(s["least"], s["most"]),
                   F.struct(F.lit(i).alias("i"), F.col(m).alias("v")))
            for i, (c, m, s, _) in enumerate(asked)])).alias("x")) \
            .where(F.col("x").isNotNull()).select("x.i", "x.v")
        if sum(s["n"] for _, _, s, _ in asked) <= FEW:
            own: dict[int, list[float]] = {}
            for i, v in hits.collect():
                own.setdefault(i, []).append(v)
            for values in own.values():
                values.sort()
            return {(i, r): own[i][r] for i, (_, _, _, ranks) in enumerate(asked) for r in ranks}
        fine = hits.withColumn("s", value_slice(F.col("v")))
        upto: dict[int, int] = {}
        out, inside = {}, []
        for i, s, n, least, most in (fine.groupBy("i", "s").agg(F.count(F.lit(1)), F.min("v"), F.max("v"))
                                     .orderBy("i", "s").collect()):
            first = upto.get(i, 0)
            upto[i] = first + n
            for r in asked[i][3]:
                if first <= r < upto[i] and least == most:
                    out[i, r] = least
                elif first <= r < upto[i]:
                    inside.append((i, s, first, r))
        if inside:
            wanted = hits.sparkSession.createDataFrame(inside, "i int, s long, first long, r long")
            place = Window.partitionBy("i", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            counts = (fine.join(F.broadcast(wanted.select("i", "s").distinct()), ["i", "s"])
                      .groupBy("i", "s", "v").agg(F.count(F.lit(1)).alias("n"))
                      .withColumn("upto", F.sum("n").over(place)))
            at = F.col("r") - F.col("first")
            out |= {(i, r): v for i, r, v in counts.join(F.broadcast(wanted), ["i", "s"]).where(
                (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))).select("i", "r", "v").collect()}
        return out

    def total(self, cells: Iterable[Cell]) -> dict[Cell, dict]:
        """The totals of the cells that have a row: one pruned scan."""
        return self.figures(cells, (), [])[0]

    def quantiles(self, wanted: Iterable[tuple[Cell, str]], probs: list[float]
                  ) -> dict[tuple[Cell, str], list[float]]:
        """Quantiles (Spark's ``percentile``) of several cells' measures."""
        return self.figures((), wanted, probs)[1]

    def figures(self, cells: Iterable[Cell], wanted: Iterable[tuple[Cell, str]], probs: list[float]
                ) -> tuple[dict[Cell, dict], dict[tuple[Cell, str], list[float]]]:
        """``total`` of the cells and ``quantiles``: one scan of the tables, one of the rows."""
        totals, slices = self._read(cells, wanted, probs)
        asked: dict[tuple, tuple[Cell, str, dict, list[int]]] = {}
        known: dict[tuple, float | tuple] = {}
        for (cell, measure), own in slices.items():
            for place in [float(p) * (own[0]["total"] - 1) for p in probs]:
                for rank in {math.floor(place), math.ceil(place)}:
                    s = next(s for s in own if s["before"] <= rank < s["before"] + s["n"])
                    if s["least"] == s["most"] or s["most"] != s["most"]:   # NaN has its own slice
                        known[cell, measure, rank] = s["most"]
                    else:
                        one = asked.setdefault((cell, measure, s["slice"]), (cell, measure, s, []))
                        one[3].append(rank - s["before"])
                        known[cell, measure, rank] = (cell, measure, s["slice"]), rank - s["before"]
        if asked:
            at = {k: i for i, k in enumerate(asked)}
            found = self._ranked(list(asked.values()))
            known = {k: found[at[v[0]], v[1]] if isinstance(v, tuple) else v for k, v in known.items()}

        def one_quantile(key, p):
            place = float(p) * (slices[key][0]["total"] - 1)
            return interpolate(known[*key, math.floor(place)], known[*key, math.ceil(place)], place)

        return totals, {k: [one_quantile(k, p) for p in probs] for k in slices}

    @property
    def spark(self):
        return self.totals.sparkSession

    # ------------------------------------------------------------- B1
    def dashboard_kpis(self, type_str=None, region=None) -> DataFrame:
        """A6."""
        cell = self.cell(type_str, region)
        found, q = self.figures([cell], [(cell, "prix"), (cell, "prix_m2")], [0.5])
        own = found.get(cell, {"n": 0, "mean": None, "with_surface": 0})
        m2 = q.get((cell, "prix_m2"), [None])[0] if own["with_surface"] else None
        return _local(self.spark, [(_whole(q.get((cell, "prix"), [None])[0]), _whole(own["mean"]),
                                    _whole(m2), own["n"])],
                      "median_price long, mean_price long, prix_m2 long, ads_count long")

    def active_markets(self, type_str=None, region=None, r2: float | None = None) -> DataFrame:
        """A7."""
        typed = self._typed(self.cell(type_str, region), market.MARKET_TYPES)
        found = self.total(typed.values())
        rows = []
        for i, t in enumerate(market.MARKET_TYPES):
            own = found.get(typed.get(t))
            if own:
                sure = None if r2 is None else min(95, max(70, int(float(r2) * 100 + own["n"] / 100)))
                rows.append((t, i, own["n"], _whole(own["mean"]), sure, f"{own['n']} annonces"))
        return _local(self.spark, rows, "type string, type_order int, count long, mean_price long, "
                                        "confidence long, label string")

    def type_cards(self, type_str=None, region=None) -> DataFrame:
        """A8."""
        typed = self._typed(self.cell(type_str, region), market.CARD_TYPES)
        found, q = self.figures(typed.values(), [(c, "prix") for c in typed.values()], [0.5])
        return _local(self.spark, [
            (t, i, found.get(typed.get(t), {"n": 0})["n"],
             _whole(q.get((typed.get(t), "prix"), [None])[0]))
            for i, t in enumerate(market.CARD_TYPES)],
            "type string, type_order int, count long, median_price long")

    def price_histogram(self, type_str=None, region=None, legacy_edge: bool = False) -> DataFrame:
        """The bounds from the totals, the bins from the cell's rows."""
        cell = self.cell(type_str, region)
        own = self.total([cell]).get(cell)
        prices = _measured(self.rows).where(self._mine(cell))
        bounds = (own["low"], own["high"]) if own else (None, None)
        return market.histogram_of(prices, "prix", F.count(F.lit(1)), bounds, legacy_edge)

    def dashboard(self, type_str=market.ALL_TYPES, region=market.ALL_REGIONS,
                  metrics: dict | None = None) -> dict[str, DataFrame]:
        """B1."""
        metrics = metrics or {}
        return {"kpis": self.dashboard_kpis(type_str, region),
                "active_markets": self.active_markets(type_str, region, metrics.get("r2")),
                "type_cards": self.type_cards(type_str, region),
                "price_histogram": self.price_histogram(type_str, region),
                "model": market.metrics_display(self.spark, metrics)}

    # ------------------------------------------------------------- B2
    def analysis_stats(self, zone=None, type_str=None, rooms=None) -> DataFrame:
        """A13."""
        cell = self.cell(type_str, None, zone, rooms)
        found, q = self.figures([cell], [(cell, "prix")], [0.5])
        own = found.get(cell, {"n": 0, "mean": None, "low": None, "high": None})
        med = q.get((cell, "prix"), [None])[0]
        return _local(self.spark, [(own["n"], *map(_whole, (med, own["mean"], own["low"],
                                                            own["high"])))],
                      "count long, median long, mean long, min long, max long")

    def analysis_quartiles(self, zone=None, type_str=None, rooms=None, min_rows: int = 10
                           ) -> DataFrame:
        """A10."""
        cell = self.cell(type_str, None, zone, rooms)
        found, own = self.figures([cell], [(cell, "prix")], [0.25, 0.5, 0.75])
        n, q = found.get(cell, {"n": 0})["n"], own.get((cell, "prix"))
        return _local(self.spark, market.quartile_rows(q) if q and n > min_rows else [],
                      market.QUARTILES)

    def analysis_type_stats(self, zone=None, type_str=None, rooms=None) -> DataFrame:
        """A12."""
        typed = self._typed(self.cell(type_str, None, zone, rooms), market.STAT_TYPES)
        found, q = self.figures(typed.values(), [(c, m) for c in typed.values()
                                                 for m in ("prix", "prix_m2")], [0.5])
        rows = [(t, market.STAT_TYPES.index(t), found[c]["n"],
                 _whole(q.get((c, "prix"), [None])[0]), _whole(found[c]["low"]),
                 _whole(found[c]["high"]), _whole(q.get((c, "prix_m2"), [None])[0]))
                for t, c in typed.items() if c in found]
        return _local(self.spark, rows, "type string, type_order int, count long, median long, "
                                        "prix_min long, prix_max long, prix_m2 long")

    def analysis(self, raw: DataFrame, zone=market.ALL_CITIES, type_str=market.ALL_TYPES,
                 smin=None, smax=None, rooms=market.ALL_ROOMS) -> dict[str, DataFrame]:
        """B2; with surface bounds from the rows, without from the cube."""
        if market.is_number(smin) or market.is_number(smax):
            return market.analysis(self.rows, raw, zone, type_str, smin, smax, rooms)
        return {"stats": self.analysis_stats(zone, type_str, rooms),
                "quartiles": self.analysis_quartiles(zone, type_str, rooms),
                "type_stats": self.analysis_type_stats(zone, type_str, rooms),
                "top_cities": market.top_cities_m2(raw, type_str)}

    # ------------------------------------------------------------- B3
    def input_ranges(self) -> DataFrame:
        """A18."""
        cell = self.cell()
        q = self.quantiles([(cell, "surface"), (cell, "pieces")], [0.01, 0.99])
        return _local(self.spark, [market.range_row(q.get((cell, "surface")),
                                                    q.get((cell, "pieces")))], market.RANGES)
