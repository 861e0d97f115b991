"""Edge, shock and impact tables as CSV and JSON, with the checks of a strict reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.scan import running

EDGES = "etf_node_id string, security_node_id string, security_ticker string, portfolio_weight double"
SHOCKS = "key string, shock double"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def _or_raise(df: DataFrame, good, message: str) -> DataFrame:
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges by their exact header; a blank weight is null, a non-finite one stops the job."""
    w = F.col("portfolio_weight")
    return _or_raise(_csv(spark, path, EDGES), w.isNull() | (~F.isnan(w) & (F.abs(w) != float("inf"))), "a weight isn't finite")


def read_shocks(spark: SparkSession, path: str) -> DataFrame:
    """Shocks by key; a key twice stops the job."""
    rows = _csv(spark, path, SHOCKS)
    once = rows.groupBy("key").agg(F.max("shock").alias("shock"), F.count(F.lit(1)).alias("n"))
    return _or_raise(once, F.col("n") == 1, "a shock key stands twice").drop("n")


def read_scenario(spark: SparkSession, path: str, scenario_id: str) -> DataFrame:
    """A JSON object of key to number as shocks in order; other values stop the job."""
    text = spark.read.text(path, wholetext=True)
    raw = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e"), "value")
    quoted = F.col("value").rlike(r":\s*(?:\"|true\b|false\b|null\b)")
    number = F.col("e.value").try_cast("double")
    rows = _or_raise(raw, ~quoted & number.isNotNull(), "a shock isn't a number")
    return rows.select(F.lit(scenario_id).alias("scenario_id"), "ord", F.col("e.key").alias("key"), F.col("e.value").cast("double").alias("shock"))


def write_scenario(shocks: DataFrame, path: str) -> None:
    """Shocks (key, shock) as lines of JSON objects with one member each, from every task."""
    shocks.select(F.to_json(F.create_map("key", "shock")).alias("value")).write.text(path)


def read_scenario_lines(spark: SparkSession, path: str, scenario_id: str) -> DataFrame:
    """Shocks of a file or folder of lines, a JSON object of key to number each, numbered in order of
    their keys by ranges, so a scenario of any size isn't one task's. Other values and keys that stand
    twice stop the job."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    raw = lines.select(F.explode_outer(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"), "value")
    quoted = F.col("value").rlike(r":\s*(?:\"|true\b|false\b|null\b)")
    shock = F.col("e.value").try_cast("double")
    rows = _or_raise(raw, F.col("e").isNotNull() & ~quoted & shock.isNotNull(), "a shock isn't a number")
    once = rows.groupBy(F.col("e.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(shock).alias("shock"))
    numbered = running(_or_raise(once, F.col("n") == 1, "a shock key stands twice").drop("n"), [], ["key"], sums={"ord": F.lit(1)})
    return numbered.select(F.lit(scenario_id).alias("scenario_id"), "ord", "key", "shock")


def export_graph(edges: DataFrame, shocks: DataFrame, root: str) -> None:
    """Edges and shocks as CSV, after a check for empty ids, control characters and non-finite
    numbers; nothing is written if it fails."""
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False)) & ~F.coalesce(F.col(c).rlike(r"\p{Cntrl}"), F.lit(False))
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) != float("inf")))
    bad_edges = edges.where(~(text("etf_node_id") & text("security_node_id") & finite("portfolio_weight")))
    bad_shocks = shocks.where(~(text("key") & F.col("shock").isNotNull() & finite("shock")))
    if not bad_edges.isEmpty() or not bad_shocks.isEmpty():
        raise ValueError("the graph holds an empty id, a control character or a number that isn't finite")
    edges.select("etf_node_id", "security_node_id", "security_ticker", "portfolio_weight").write.option("header", True).csv(f"{root}/edges")
    shocks.select("key", "shock").write.option("header", True).csv(f"{root}/shocks")


IMPACTS = "scenario_id string, etf_node_id string, direct_shock double, covered_weight double, weight_sum double, missing_weight_count long"


def write_impacts(impacts: DataFrame, path: str) -> None:
    """Impacts as CSV, ids quoted, so that commas, quotes and line feeds in them come back."""
    impacts.select(*[c.split()[0] for c in IMPACTS.split(", ")]).write.option("header", True).option("escape", '"').csv(path)


def read_impacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPACTS).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("node_id", F.col("vector").cast("array<float>")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_id string, vector array<float>").parquet(path)
