"""Nested JSON reference data (S6-S8, D2) and JSON scalars.

Pages of the reference-data API look like ``{"MRData": {"total": .., "<Table>":
{"season": .., "<Items>": [...]}}}``. A landed page is read with
``spark.read.json`` (or parsed from a text column with ``from_json``), the
item array is exploded and nested fields are selected by path. Missing
objects give nulls (path access is null-safe), numbers parse with a default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.functions.scalar import number_or

S = T.StringType()

LOCATION = T.StructType([T.StructField(n, S) for n in ("locality", "country", "lat", "long")])
CIRCUIT = T.StructType([
    T.StructField("circuitId", S), T.StructField("circuitName", S), T.StructField("Location", LOCATION),
])
DRIVER = T.StructType([T.StructField(n, S) for n in (
    "driverId", "code", "givenName", "familyName", "nationality", "permanentNumber")])
RESULT = T.StructType([
    T.StructField("Driver", T.StructType([T.StructField("driverId", S)])),
    T.StructField("Constructor", T.StructType([T.StructField("constructorId", S)])),
    T.StructField("grid", S), T.StructField("position", S), T.StructField("points", S), T.StructField("status", S),
])
RACE = T.StructType([
    T.StructField("round", S),
    T.StructField("Circuit", T.StructType([T.StructField("circuitId", S)])),
    T.StructField("Results", T.ArrayType(RESULT)),
])


def page_schema(table: str, items: str, item_type: T.DataType) -> T.StructType:
    body = T.StructType([T.StructField("season", S), T.StructField(items, T.ArrayType(item_type))])
    return T.StructType([T.StructField("MRData", T.StructType([
        T.StructField("total", S), T.StructField(table, body)]))])


CIRCUIT_PAGE = page_schema("CircuitTable", "Circuits", CIRCUIT)
DRIVER_PAGE = page_schema("DriverTable", "Drivers", DRIVER)
RESULTS_PAGE = page_schema("RaceTable", "Races", RACE)


def parse_pages(df: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """JSON text column -> the page struct (``MRData``)."""
    return df.select(F.from_json(F.col(text_col), schema).alias("__p")).select("__p.*")


def read_pages(spark, path: str, schema: T.StructType, lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """Landed page files (one JSON document a file, or one a line); broken pages go to ``quarantine``."""
    from pitlane.sources.json_files import read_documents

    return read_documents(spark, path, schema, lines, ["MRData"], quarantine).rows


def flatten_circuits(pages: DataFrame) -> DataFrame:
    """Circuits; lat/long strings -> double, default 0."""
    c = pages.select(F.explode_outer("MRData.CircuitTable.Circuits").alias("c")).where(F.col("c").isNotNull())
    return c.select(
        F.col("c.circuitId").alias("circuit_id"),
        F.col("c.circuitName").alias("circuit_name"),
        F.col("c.Location.locality").alias("locality"),
        F.col("c.Location.country").alias("country"),
        number_or("c.Location.lat", 0.0).alias("lat"),
        number_or("c.Location.long", 0.0).alias("lon"),
    )


def flatten_drivers(pages: DataFrame) -> DataFrame:
    """S7 + D2: drivers of every season page; a driver seen in several
    seasons keeps the row of the first season (``min_by`` per driver, a
    partial aggregate - no group is collected)."""
    d = pages.select(
        number_or("MRData.DriverTable.season", 0, "int").alias("season"),
        F.explode("MRData.DriverTable.Drivers").alias("d"),
    )
    row = F.struct(
        F.col("d.code").alias("driver_code"), F.col("d.givenName").alias("given_name"),
        F.col("d.familyName").alias("family_name"), F.col("d.nationality").alias("nationality"),
        F.col("d.permanentNumber").alias("permanent_number"),
    )
    first = d.groupBy(F.col("d.driverId").alias("driver_id")).agg(
        F.min("season").alias("first_season"),
        F.min_by(row, F.struct("season", row)).alias("r"),
    )
    return first.select("driver_id", "r.*", "first_season")


def flatten_results(pages: DataFrame) -> DataFrame:
    """Races[] -> Results[] -> one row per result; round and grid int
    (default 0), points double (default 0). A race split over two pages is
    just two array entries."""
    races = pages.select(
        number_or("MRData.RaceTable.season", 0, "int").alias("year"),
        F.explode("MRData.RaceTable.Races").alias("race"),
    )
    res = races.select(
        "year",
        number_or("race.round", 0, "int").alias("round"),
        F.col("race.Circuit.circuitId").alias("circuit_id"),
        F.explode("race.Results").alias("r"),
    )
    return res.select(
        "year", "round", "circuit_id",
        F.col("r.Driver.driverId").alias("driver_id"),
        F.col("r.Constructor.constructorId").alias("constructor_id"),
        number_or("r.grid", 0, "int").alias("grid"),
        F.col("r.position").alias("position"),
        number_or("r.points", 0.0).alias("points"),
        F.col("r.status").alias("status"),
    )


def json_scalar(c: str, path: str, default, dtype: str = "int"):
    """scalar at a JSON path with a default."""
    return F.coalesce(F.get_json_object(F.col(c), path).try_cast(dtype), F.lit(default).cast(dtype))


# --- page builders over the testdata tables ----------------------------------
# Each page holds a bounded number of items (a page key groups at most
# ``page_size`` parents), as a paginated API would.

def circuit_pages(nation: DataFrame, region: DataFrame) -> DataFrame:
    """region/nation folded into circuit pages (25 nations -> one page)."""
    n = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    item = F.struct(
        F.lower(F.col("n_name")).alias("circuitId"),
        F.concat(F.col("n_name"), F.lit(" circuit")).alias("circuitName"),
        F.when(F.col("n_nationkey") % 6 == 0, F.lit(None)).otherwise(F.struct(
            F.col("r_name").alias("locality"), F.col("n_name").alias("country"),
            F.when(F.col("n_nationkey") % 4 == 0, F.lit(None).cast("string"))
            .otherwise((F.col("n_nationkey") * 1.5).cast("string")).alias("lat"),
            (F.col("n_regionkey") * -2.25).cast("string").alias("long"),
        )).alias("Location"),
    )
    page = n.groupBy((F.col("n_nationkey") / 100).cast("int").alias("page")).agg(F.collect_list(item).alias("items"))
    return page.select(F.to_json(F.struct(F.struct(
        F.lit("25").alias("total"),
        F.struct(F.lit(None).cast("string").alias("season"), F.col("items").alias("Circuits")).alias("CircuitTable"),
    ).alias("MRData"))).alias("json"))


def driver_pages(orders: DataFrame, customer: DataFrame, page_size: int = 100) -> DataFrame:
    """Distinct (customer, order year) as season driver lists; a customer's
    permanent number changes with the season, so the first season shows."""
    cy = orders.select("o_custkey", F.year("o_orderdate").alias("season")).distinct()
    c = cy.join(customer, cy.o_custkey == customer.c_custkey)
    item = F.struct(
        F.concat(F.lit("cust"), F.col("c_custkey").cast("string")).alias("driverId"),
        F.upper(F.substring(F.col("c_name"), -3, 3)).alias("code"),
        F.col("c_name").alias("givenName"),
        F.col("c_mktsegment").alias("familyName"),
        F.col("c_nationkey").cast("string").alias("nationality"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("c_custkey") % 100 + F.col("season") % 10).cast("string")).alias("permanentNumber"),
    )
    page = c.groupBy("season", (F.col("c_custkey") / page_size).cast("bigint").alias("page")).agg(
        F.collect_list(item).alias("items"))
    return page.select(F.to_json(F.struct(F.struct(
        F.lit(None).cast("string").alias("total"),
        F.struct(F.col("season").cast("string").alias("season"), F.col("items").alias("Drivers")).alias("DriverTable"),
    ).alias("MRData"))).alias("json"))


def result_pages(orders: DataFrame, lineitem: DataFrame, page_size: int = 100, split: int | None = None) -> DataFrame:
    """orders/lineitem folded into Races[].Results[] season pages; with ``split`` a race's results above that
    number are on another page than the rest."""
    res_item = F.struct(
        F.struct(F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("driverId")).alias("Driver"),
        F.struct(F.concat(F.lit("c"), (F.col("l_partkey") % 10).cast("string")).alias("constructorId")).alias("Constructor"),
        F.col("l_linenumber").cast("string").alias("grid"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("l_linenumber").cast("string")).alias("position"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("l_quantity").cast("string")).alias("points"),
        F.col("l_returnflag").alias("status"),
    )
    half = F.when(F.col("l_linenumber") > split, 1).otherwise(0) if split else F.lit(0)
    per_race = lineitem.groupBy("l_orderkey", half.alias("half")).agg(F.collect_list(res_item).alias("Results"))
    races = orders.join(per_race, orders.o_orderkey == per_race.l_orderkey, "left")
    race_item = F.struct(
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("TBD")).otherwise(F.col("o_orderkey").cast("string")).alias("round"),
        F.struct(F.col("o_orderstatus").alias("circuitId")).alias("Circuit"),
        F.col("Results"),
    )
    page = races.groupBy(
        F.year("o_orderdate").alias("season"), (F.col("o_orderkey") / page_size).cast("bigint").alias("page"), "half"
    ).agg(F.collect_list(race_item).alias("items"))
    return page.select(F.to_json(F.struct(F.struct(
        F.lit(None).cast("string").alias("total"),
        F.struct(F.col("season").cast("string").alias("season"), F.col("items").alias("Races")).alias("RaceTable"),
    ).alias("MRData"))).alias("json"))

