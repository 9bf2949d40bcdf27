"""Series and results of analyses as files: CSV and JSON, written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TSID = ("property", "param1", "param2")


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def tsid(at: str = "") -> Column:
    """The id of a series as JSON: ["property", "param1"] or ["property", ["param1", "param2"]]."""
    one, two = F.col(f"{at}param1"), F.col(f"{at}param2")
    params = F.when(two.isNull(), _quoted(one)).otherwise(F.to_json(F.array(one, two)))
    return F.concat(F.lit("["), _quoted(F.col(f"{at}property")), F.lit(","), params, F.lit("]"))


def parsed_tsid(text: Column) -> list[Column]:
    """property, param1 and param2 of an id."""
    parts = F.from_json(text, "array<string>")
    both = F.from_json(parts[1], "array<string>")
    pair = parts[1].startswith("[") & both[0].isNotNull()
    return [parts[0].alias("property"), F.when(pair, both[0]).otherwise(parts[1]).alias("param1"), F.when(pair, both[1]).alias("param2")]


def _lines(rows: DataFrame, ar: Column) -> DataFrame:
    return rows.select(F.concat(F.lit('{"tsid":'), "tsid", F.lit(',"ar":'), ar, F.lit("}")).alias("value"))


def points_json(points: DataFrame) -> DataFrame:
    """One JSON text a series: its id and the places of its points, counted from 1."""
    grouped = points.withColumn("tsid", tsid()).groupBy("tsid").agg(F.sort_array(F.collect_list(F.col("idx") + 1)).alias("ar"))
    return _lines(grouped, F.to_json("ar"))


def forecasts_json(forecasts: DataFrame) -> DataFrame:
    """One JSON text a series: its id and its forecasts (property, param1, param2, t, value) by time."""
    stamp = F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    grouped = forecasts.withColumn("tsid", tsid()).groupBy("tsid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stamp.alias("t"), "value")))).alias("ar"))
    return _lines(grouped, F.to_json("ar"))


def causes_json(causes: DataFrame) -> DataFrame:
    """One JSON text a caused series: its id, and the causing series with their lags."""
    grouped = causes.select(tsid("caused.").alias("tsid"), F.concat(F.lit("["), tsid("causing."), F.lit(","), F.to_json("lags"), F.lit("]")).alias("one")).groupBy("tsid").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return _lines(grouped, F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")))


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What the functions above make, of ``kind`` points, forecasts or causes, from JSON lines or one JSON array."""
    wanted = {"points": "array<int>", "forecasts": "map<string,double>", "causes": "array<string>"}
    if kind not in wanted:
        raise ValueError(f"kind must be one of {tuple(wanted)}")
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    whole = bool(first) and first[0]["value"].lstrip().startswith("[")
    rows = spark.read.schema(f"tsid string, ar {wanted[kind]}").option("multiLine", whole).json(path)
    if kind == "points":
        return rows.select(*parsed_tsid(F.col("tsid")), F.explode("ar").alias("place")).select(*TSID, (F.col("place") - 1).alias("idx"))
    if kind == "forecasts":
        return rows.select(*parsed_tsid(F.col("tsid")), F.explode("ar").alias("stamp", "value")).select(*TSID, F.to_date(F.to_timestamp("stamp")).alias("t"), "value")
    each = rows.select("tsid", F.explode("ar").alias("one")).select("tsid", F.from_json("one", "array<string>").alias("one"))
    side = lambda c: F.struct(*parsed_tsid(c))
    return each.select(side(F.col("tsid")).alias("caused"), side(F.col("one")[0]).alias("causing"), F.from_json(F.col("one")[1], "array<int>").alias("lags"))


def write_series_csv(series: DataFrame, path: str) -> None:
    """A folder of CSV files, one a series, in a folder named after its id: time and value."""
    rows = series.select(tsid().alias("tsid"), F.col("t").cast("date").alias("time"), "value")
    rows.repartition("tsid").sortWithinPartitions("tsid", "time").write.partitionBy("tsid").option("header", True).csv(path)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(property, param1, param2, idx, t, value) of the series that ``write_series_csv`` wrote, counted from 0 along time."""
    rows = spark.read.option("header", True).schema("time date, value double, tsid string").csv(path)
    idx = F.row_number().over(Window.partitionBy("tsid").orderBy("time")) - 1
    return rows.withColumn("idx", idx).select(*parsed_tsid(F.col("tsid")), "idx", F.col("time").alias("t"), "value")
