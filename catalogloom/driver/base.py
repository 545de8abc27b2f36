"""Shared pieces of the driver-table queries."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    """A Spark query over the driver tables and the SQL it must agree with."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    """A two-decimal amount as text, the same in every engine."""
    return F.col(name).cast("decimal(18,2)").cast("string")


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **slots: str) -> str:
    """The SQL concatenation that fills a template like ``completions.fill`` does."""
    pieces = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(sql_text(text))
        if slot is not None:
            pieces.append(f"coalesce(cast({slots[slot]} as varchar), '')")
    return "(" + " || ".join(pieces) + ")"


# The event types of the driver table in the role of pipeline stages.
EVENT_STAGE = {
    "signup": "concept",
    "view": "assets",
    "click": "package",
    "purchase": "listing",
    "error": "review",
}


def event_stage() -> Column:
    pairs = [F.lit(part) for pair in EVENT_STAGE.items() for part in pair]
    return F.create_map(*pairs)[F.col("event_type")]


EVENT_STAGE_SQL = (
    "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_STAGE.items()) + " end"
)

STAGE_ORD_SQL = (
    "case stage when 'concept' then 1 when 'assets' then 2 when 'postprocess' then 3 "
    "when 'package' then 4 when 'listing' then 5 when 'review' then 6 end"
)


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: user = product, type = stage, value = cost, small values = failures."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"),
        event_stage().alias("stage"),
        F.col("event_id").alias("run"),
        F.when(F.col("value") < 5, "failed").otherwise("done").alias("status"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("input_hash"),
        F.concat(F.lit("artifacts/"), "event_type", F.lit(".json")).alias("output_path"),
        F.col("value").alias("cost"),
        F.when(F.col("value") < 5, F.lit("run failed")).otherwise(F.lit("")).alias("error"),
        (F.col("value") >= 1).alias("started"),
        "ts",
    )


EVENT_RUNS_SQL = f"""runs as (
  select user_id as product_id, {EVENT_STAGE_SQL} as stage, event_id as run,
         case when value < 5 then 'failed' else 'done' end as status,
         sha256(cast(event_id as varchar)) as input_hash,
         'artifacts/' || event_type || '.json' as output_path, value as cost,
         case when value < 5 then 'run failed' else '' end as error, value >= 1 as started, ts
  from events)"""

NODE_STATE_SQL = f"""{EVENT_RUNS_SQL}, state as (
  select product_id, stage, arg_max(status, run) as status,
         coalesce(arg_max(input_hash, run) filter (where status = 'done'), '') as input_hash,
         coalesce(arg_max(output_path, run) filter (where status = 'done'), '') as output_path,
         coalesce(sum(cost) filter (where status = 'done'), 0) as cost,
         arg_max(error, run) as error,
         min(ts) filter (where started) as created_at, max(ts) as updated_at
  from runs group by product_id, stage)"""
