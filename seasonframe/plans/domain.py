"""Domain tables derived from an order/line-item star schema, to run the operators at any scale.

Regions are nations, coded `R<region><nation>` so that a prefix is the parent region. Ship dates
give weather and growth, orders give yields, areas and forecasts. Values are whole numbers or
multiples of a power of two: sums are exact, hence independent of the order rows arrive in.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut


# The columns read from each table.
COLUMNS = {
    "nation": "n_nationkey int, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_shipdate timestamp_ntz",
}


def _cents(column: str) -> str:
    return f"floor({column} * 100 + 0.5D)"


def _grid(value: str, steps: int) -> str:
    """Round down to a multiple of 1/steps; steps is a power of two."""
    return f"CAST(floor(({value}) * {steps}) / {steps} AS DOUBLE)"


# even nations write yyyyMMdd, odd ones dd/MM/yyyy
_DATE_TEXT = "date_format({0}, CASE WHEN n_nationkey % 2 = 0 THEN 'yyyyMMdd' ELSE 'dd/MM/yyyy' END)"
_DEKAD = "CAST((month(day) - 1) * 3 + least(ceil(dayofmonth(day) / 10), 3) AS INT)"
_COUNTRY = "left(IDREGION, 2) AS IDREGION"
_YIELD = _grid("sum(cents) / sum(n) / 400000", 128) + " AS YIELD"


def grouped(df: DataFrame, keys: list[str], *aggregates: str) -> DataFrame:
    return df.groupBy(*map(F.expr, keys)).agg(*map(F.expr, aggregates))


class Domain:
    """Domain tables of one scale-factor directory, each built once per instance.

    Tables named in `kept` are materialised when first used: those a query reads repeatedly. So
    the line items are scanned, joined and reduced to days once, whatever is built on top.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, kept: tuple[str, ...] = ()):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, kept

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        return cut(df) if name in self.kept else df

    def prepare(self, *names: str) -> None:
        """Build several kept tables at once, so that their jobs overlap on the cluster."""
        build = inheritable_thread_target(self.spark)(lambda name: getattr(self, name))
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(build, names))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        """n_nationkey -> IDREGION. Nations are a fixed list of 25, hence the broadcasts below."""
        return self.table("nation").selectExpr(
            "n_nationkey",
            "concat('R', n_regionkey, lpad(CAST(n_nationkey AS STRING), 2, '0')) AS IDREGION")

    def _in_regions(self, df: DataFrame, nation: str) -> DataFrame:
        return df.join(F.broadcast(self.regions), df[nation] == F.col("n_nationkey"))

    @cached_property
    def daily(self) -> DataFrame:
        """Shipments reduced to region, day and crop: sums, counts and extremes."""
        lines = self.table("lineitem").selectExpr(
            "l_suppkey", "CASE WHEN l_linenumber <= 5 THEN 7 ELSE 6 END AS CROP_ID",
            "CAST(l_quantity AS BIGINT) AS qty", f"{_cents('l_extendedprice')} AS cents",
            f"{_cents('l_discount')} AS disc", "CAST(l_shipdate AS DATE) AS day")
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        shipped = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
        days = grouped(
            shipped, ["s_nationkey", "day", "CROP_ID"],
            "count(1) AS n", "sum(qty) AS qty", "sum(cents) AS cents", "sum(disc) AS disc",
            "max(qty) AS hi", "min(qty) AS lo")
        return self.keep("daily", self._in_regions(days, "s_nationkey").drop("s_nationkey"))

    @cached_property
    def weather(self) -> DataFrame:
        """Daily weather per region."""
        qty, disc, cents = (f"sum({c}) / sum(n)" for c in ("qty", "disc", "cents"))
        days = grouped(
            self.daily, ["IDREGION", "n_nationkey", "day"],
            "CAST(max(hi) AS DOUBLE) AS TMAX", "CAST(min(lo) AS DOUBLE) AS TMIN",
            f"{_grid(qty, 8)} AS TAVG", f"{_grid(f'{qty} / 4', 16)} AS PREC",
            f"{_grid(disc, 8)} AS ET0", f"{_grid(f'{cents} / 800', 1)} AS RAD")
        return days.selectExpr(
            "IDREGION", f"{_DATE_TEXT.format('day')} AS DATE",
            "TMAX", "TMIN", "TAVG", "PREC", "ET0", "RAD", "1 AS IDCOVER")

    @cached_property
    def growth(self) -> DataFrame:
        """Dekadal growth of two crops per region; development follows the year's shipped share."""
        cells = grouped(
            self.daily, ["CROP_ID", "IDREGION", "n_nationkey", "year(day) AS year",
                         f"{_DEKAD} AS dekad"],
            "sum(qty) AS qty", "sum(n) AS n", "sum(disc) AS disc", "max(hi) AS hi", "min(lo) AS lo")
        # at most 36 dekads per window
        year = "PARTITION BY CROP_ID, IDREGION, n_nationkey, year"
        upto = f"OVER ({year} ORDER BY dekad)"
        first = "make_date(year, (dekad - 1) DIV 3 + 1, (dekad - 1) % 3 * 10 + 1)"
        return cells.selectExpr(
            "CROP_ID", "IDREGION", f"{_DATE_TEXT.format(first)} AS DATE",
            f"CAST(sum(hi) {upto} AS DOUBLE) AS POT_YB",
            f"CAST(sum(n) {upto} AS DOUBLE) AS WLIM_YB",
            f"sum(lo) {upto} / 4 AS WLIM_YS",
            f"CAST(least(201, floor(sum(qty) {upto} * 250 / sum(qty) OVER ({year}))) AS DOUBLE)"
            " AS DVS",
            f"{_grid('qty / n', 8)} AS WLAI", f"{_grid('disc / n', 16)} AS RSM",
            "CAST(hi AS DOUBLE) AS TWC", "CAST(lo AS DOUBLE) AS TWR")

    @cached_property
    def remote_sensing(self) -> DataFrame:
        """Dekadal greenness per parent region (two-character code)."""
        tens = "CAST(least(floor((dayofmonth(day) - 1) / 10), 2) AS INT)"
        return grouped(
            self.daily, [_COUNTRY, f"date_add(trunc(day, 'month'), {tens} * 10) AS day"],
            f"{_grid('sum(disc) / sum(n) / 16', 256)} AS FAPAR",
        ).selectExpr("IDREGION", "date_format(day, 'yyyyMMdd') AS DATE", "FAPAR", "1 AS IDCOVER")

    @cached_property
    def _sold(self) -> DataFrame:
        orders = self.table("orders").selectExpr(
            "o_custkey", f"{_cents('o_totalprice')} AS cents", "CAST(o_orderdate AS DATE) AS day")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return orders.join(customers, orders["o_custkey"] == customers["c_custkey"])

    @cached_property
    def sales(self) -> DataFrame:
        """Orders with their customer's region."""
        return self._in_regions(self._sold, "c_nationkey").select("IDREGION", "day", "cents")

    @cached_property
    def monthly(self) -> DataFrame:
        """Sales reduced to region and month: sums and counts."""
        months = grouped(
            self._sold, ["c_nationkey", "trunc(day, 'month') AS month"],
            "sum(cents) AS cents", "count(1) AS n")
        return self.keep("monthly", self._in_regions(months, "c_nationkey").drop("c_nationkey"))

    @cached_property
    def raw_yields(self) -> DataFrame:
        """Long yields with crop names; one nation in seven grows something unknown."""
        crop = "CASE WHEN n_nationkey % 7 = 3 THEN 'Soybean' " \
            "WHEN n_nationkey % 2 = 0 THEN 'Potatoes' ELSE 'Total potatoes' END AS Crop"
        return grouped(
            self.monthly, ["IDREGION", "n_nationkey", "year(month) AS FYEAR"], _YIELD,
        ).selectExpr(crop, "IDREGION", "FYEAR", "YIELD")

    @cached_property
    def wide_yields(self) -> DataFrame:
        """The same yields with one column per year that occurs."""
        years = self.monthly.select(F.year("month").alias("y")).where("y IS NOT NULL").distinct()
        return self.raw_yields.groupBy("Crop", "IDREGION").pivot(
            "FYEAR", sorted(r["y"] for r in years.collect())).agg(F.first("YIELD"))

    @cached_property
    def yields(self) -> DataFrame:
        """Yields of every region, already clean."""
        return self.keep("yields", grouped(
            self.monthly, ["IDREGION", "year(month) AS FYEAR"], _YIELD))

    @cached_property
    def national_yields(self) -> DataFrame:
        """Yields of the two-character regions."""
        return grouped(self.monthly, [_COUNTRY, "year(month) AS FYEAR"], _YIELD)

    def areas(self, length: int) -> DataFrame:
        """Share of each region in its parent's sales, for region codes of the given length."""
        own = grouped(
            self.monthly, [f"left(IDREGION, {length}) AS IDREGION", "year(month) AS FYEAR"],
            "sum(cents) AS cents")
        share = f"cents / sum(cents) OVER (PARTITION BY left(IDREGION, {length - 1}), FYEAR)"
        return own.selectExpr(
            "IDREGION", "FYEAR", "7 AS CROP_ID", f"{_grid(share, 1024)} AS FRACTION")

    @cached_property
    def forecasts(self) -> DataFrame:
        """Monthly national forecasts issued on the 11th."""
        return grouped(
            self.monthly, [_COUNTRY, "date_add(month, 10) AS issued"], _YIELD,
        ).selectExpr(
            "IDREGION", "'Potatoes' AS CROP",
            "date_format(issued, 'dd/MM/yyyy') AS PREDICTION_DATE",
            "year(issued) AS FYEAR", "YIELD AS YIELD_PRED")

    @cached_property
    def soil(self) -> DataFrame:
        """Soil limits per region from its customers' balances."""
        customers = self.table("customer").selectExpr(
            "c_nationkey", f"{_cents('c_acctbal')} AS cents")
        return grouped(
            self._in_regions(customers, "c_nationkey"), ["IDREGION"],
            f"{_grid('max(cents) / 1000000', 128)} AS SM_FC",
            f"{_grid('avg(cents) / 4000000', 128)} AS SM_WP")

    @cached_property
    def centroids(self) -> DataFrame:
        """Centroids per region from its suppliers."""
        suppliers = self.table("supplier").selectExpr(
            "s_nationkey", "s_suppkey", f"{_cents('s_acctbal')} AS cents")
        return grouped(
            self._in_regions(suppliers, "s_nationkey"), ["IDREGION"],
            f"{_grid('avg(cents) / 10000', 1024)} AS CENTROID_X",
            f"{_grid('avg(s_suppkey)', 1024)} AS CENTROID_Y")
