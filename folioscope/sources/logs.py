"""Event logs (tab-separated lines with key=value fields) and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import event_value


def event_line(at: Column, event: Column, fields: dict[str, Column]) -> Column:
    return F.concat_ws("\t", at, event, *(F.concat(F.lit(f"{k}="), event_value(v)) for k, v in fields.items()))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """(at, event, fields) of lines in the column ``value``; others are dropped."""
    parts = lines.select(F.split("value", "\t").alias("p")).where("size(p) >= 2")
    pairs = F.filter(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), lambda x: F.contains(x, F.lit("=")))
    unquoted = lambda v: F.when(F.startswith(v, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), unquoted(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    return parts.select(F.get("p", 0).alias("at"), F.get("p", 1).alias("event"), F.map_from_entries(entries).alias("fields"))


def read_events(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    out = parse_event_lines(spark.read.text(path))
    return out.orderBy(F.desc("at")).limit(newest) if newest else out


def append_events(rows: DataFrame, path: str) -> None:
    """Append (at, event, fields map) as lines."""
    fields = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), event_value(e["value"])))
    rows.select(F.array_join(F.concat(F.array("at", "event"), fields), "\t").alias("value")).write.mode("append").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """An exported report, one JSON document."""
    return spark.read.json(path, multiLine=True)


def append_run(report: DataFrame, path: str) -> None:
    report.write.mode("append").json(path)
