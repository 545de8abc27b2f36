"""Incremental work: binding inputs, node keys, skip decisions, run log and its folded state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import schemas
from ..functions.hashing import by_name, node_key
from ..session import shared_table
from .requests import distinct_keys


def bind_stage_inputs(
    products: DataFrame,
    artifacts: DataFrame,
    inputs: Sequence[str],
    key: str = "product_id",
    name: str = "name",
    value: str = "content_hash",
) -> tuple[DataFrame, DataFrame]:
    """Products whose declared inputs all exist, with one hash column each, and the others with a message.

    The lookup is a pivot over the stage's declared names, so an artifact table of any skew collapses
    to one row per product before it meets the products. The message names the first missing input
    in declared order.
    """
    columns = [f"in_{n}" for n in inputs]
    bound = mark_inputs(products, artifacts, inputs, key, name, value)
    return (
        bound.filter(F.col("error").isNull()).drop("error"),
        bound.filter(F.col("error").isNotNull()).drop(*columns),
    )


def mark_inputs(
    products: DataFrame,
    artifacts: DataFrame,
    inputs: Sequence[str],
    key: str = "product_id",
    name: str = "name",
    value: str = "content_hash",
) -> DataFrame:
    """All products with one hash column per declared input and ``error``, NULL where none is missing."""
    if not inputs:
        return products.withColumn("error", F.lit(None).cast("string"))
    held = artifacts.filter(F.col(name).isin(*inputs)).groupBy(key).agg(
        *[c.alias(f"in_{n}") for c, n in zip(by_name(F.col(name), F.col(value), inputs), inputs)]
    )
    # Fixed value: issue and error texts are matched on by users.
    absent = [F.when(F.col(f"in_{n}").isNull(), F.lit(f"missing input artifact: {n}")) for n in inputs]
    return products.join(held, key, "left").withColumn("error", F.coalesce(*absent))


def node_hash(
    bound: DataFrame,
    inputs: Sequence[str],
    code_version: str,
    prompt_version: str,
    config_hash: str = "config_hash",
    out: str = "input_hash",
) -> DataFrame:
    """Adds the node key of one stage to products bound by ``bind_stage_inputs``."""
    columns = [F.col(f"in_{n}") for n in inputs]
    return bound.withColumn(
        out, node_key(F.lit(code_version), F.lit(prompt_version), F.col(config_hash), columns)
    )


def combine_hashes(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    names: Sequence,
    code_version: str,
    prompt_version: str,
    config_hash: str,
    out: str = "node_hash",
) -> DataFrame:
    """Node key per group straight from (key, name, hash) rows, for a plan-time list of names."""
    slots = [f"_s{i}" for i in range(len(names))]
    picked = df.groupBy(*keys).agg(
        *[c.alias(s) for c, s in zip(by_name(F.col(name), F.col(value), names), slots)]
    )
    return picked.select(
        *keys,
        node_key(F.lit(code_version), F.lit(prompt_version), F.lit(config_hash), [F.col(s) for s in slots]).alias(out),
    )


def outputs_held(
    existing: DataFrame, keys: Sequence[str], output: str, outputs: Sequence, out: str = "outputs_ok"
) -> DataFrame:
    """Per key that holds any output: are all of ``outputs``, the stage's declared list, there?

    One flag per declared output, combined on the mappers: existing rows of any number and skew
    become one row of numbers per node.
    """
    flags = [F.max(F.when(F.col(output) == name, 1).otherwise(0)).alias(f"_has{i}") for i, name in enumerate(outputs)]
    held = existing.filter(F.col(output).isin(*outputs)).groupBy(*keys).agg(*flags)
    return held.select(*keys, reduce(lambda a, b: a & b, [F.col(f"_has{i}") == 1 for i in range(len(outputs))]).alias(out))


def outputs_complete(
    nodes: DataFrame, existing: DataFrame, keys: Sequence[str], output: str, outputs: Sequence, out: str = "outputs_ok"
) -> DataFrame:
    """``outputs_held`` for every node, those without any output included."""
    held = outputs_held(existing, keys, output, outputs, out)
    return nodes.select(*keys).join(held, list(keys), "left").select(*keys, F.coalesce(out, F.lit(False)).alias(out))


def decide(status: Column, prior_hash: Column, new_hash: Column, outputs_ok: Column) -> Column:
    """``skip`` for a finished record with the same key and all outputs, else ``run``."""
    keep = (status == "done") & (prior_hash == new_hash) & outputs_ok
    return F.when(F.coalesce(keep, F.lit(False)), F.lit("skip")).otherwise(F.lit("run"))


def plan_incremental(
    candidates: DataFrame,
    state: DataFrame,
    outputs: DataFrame | None = None,
    keys: Sequence[str] = ("product_id", "stage"),
    input_hash: str = "input_hash",
) -> DataFrame:
    """Skip-or-run decision for each candidate node. ``outputs`` comes from ``outputs_held``.

    Both lookups join on the full node key, which is unique on the right: no fan-out, no hot key.
    """
    prior = state.select(
        *keys, F.col("status").alias("prior_status"), F.col("input_hash").alias("prior_hash")
    )
    joined = candidates.join(prior, list(keys), "left")
    if outputs is not None:
        joined = joined.join(outputs.select(*keys, "outputs_ok"), list(keys), "left")
        outputs_ok = F.coalesce("outputs_ok", F.lit(False))
    else:
        outputs_ok = F.lit(True)
    decision = decide(F.col("prior_status"), F.col("prior_hash"), F.col(input_hash), outputs_ok)
    return joined.select(*candidates.columns, decision.alias("decision"))


def pending_files(
    wanted: DataFrame,
    existing: DataFrame,
    path: str = "path",
    by_content: bool = False,
    prompt_hash: str = "prompt_hash",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Files still to make: those whose target does not exist yet.

    A changed prompt alone does not count, unless ``by_content`` keys on the prompt hash too.
    """
    on = [*keys, path, *([prompt_hash] if by_content else [])]
    return wanted.join(distinct_keys(existing, *on), on, "left_anti")


def accumulate_node_cost(
    runs: DataFrame, keys: Sequence[str] = ("product_id", "stage"), include_failed: bool = False
) -> DataFrame:
    """Cost of a node over its runs; the cost of a failed run is lost unless asked for."""
    counted = F.col("cost") if include_failed else F.when(F.col("status") == "done", F.col("cost"))
    return runs.groupBy(*keys).agg(F.coalesce(F.sum(counted), F.lit(0.0)).alias("cost"))


def node_costs(runs: DataFrame, keys: Sequence[str] = ("product_id", "stage")) -> DataFrame:
    """Cost of a node over its finished runs and over all of them, in one aggregation."""
    done = F.when(F.col("status") == "done", F.col("cost"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.sum(done), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_with_failed")
    )


def node_timestamps(runs: DataFrame, keys: Sequence[str] = ("product_id", "stage"), ts: str = "ts") -> DataFrame:
    """First and last touch of a node."""
    return runs.groupBy(*keys).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"))


#: One record per node that two parts of a run log can be folded into and joined from.
RUN_STATE = (
    "product_id string, stage string, last struct<run:bigint,status:string,error:string>, "
    "done struct<run:bigint,input_hash:string,output_path:string>, cost double, cost_with_failed double, "
    "created_at timestamp, updated_at timestamp"
)


def run_state(runs: DataFrame) -> DataFrame:
    """A part of the run log as mergeable state, one row per node.

    The last run with its status and error, the last run that finished with hash and path, the cost of
    finished runs and of all, the first moment a run really started and the last of any.
    """
    done = F.col("status") == "done"
    number = F.col("run").cast("bigint").alias("run")
    return runs.groupBy("product_id", "stage").agg(
        F.max(F.struct(number, "status", "error")).alias("last"),
        F.max(F.when(done, F.struct(number, "input_hash", "output_path"))).alias("done"),
        F.coalesce(F.sum(F.when(done, F.col("cost"))), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_with_failed"),
        F.min(F.when(F.coalesce("started", F.lit(True)), F.col("ts"))).alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def merge_run_states(*states: DataFrame) -> DataFrame:
    """States of disjoint parts of the run log as the state of all of them, in any order."""
    together = reduce(lambda a, b: a.unionByName(b), states)
    return together.groupBy("product_id", "stage").agg(
        F.max("last").alias("last"),
        F.max("done").alias("done"),
        F.sum("cost").alias("cost"),
        F.sum("cost_with_failed").alias("cost_with_failed"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def node_records(state: DataFrame, include_failed: bool = False) -> DataFrame:
    """The current record of every node of a run state."""
    return state.select(
        "product_id",
        "stage",
        F.col("last.status").alias("status"),
        F.coalesce("done.input_hash", F.lit("")).alias("input_hash"),
        F.coalesce("done.output_path", F.lit("")).alias("output_path"),
        F.col("cost_with_failed" if include_failed else "cost").alias("cost"),
        F.coalesce("last.error", F.lit("")).alias("error"),
        "created_at",
        "updated_at",
    )


def fold_node_runs(runs: DataFrame, include_failed: bool = False) -> DataFrame:
    """The append-only run log folded to one record per node.

    Status and error come from the last run, hash and output path from the last run that finished,
    the cost from all finished runs, the first timestamp from the first run that really started.
    One aggregation with partial results per mapper. Run number and status share one number, so
    reports that need neither hash nor error fold numbers only, in a hash table.
    """
    done = F.col("status") == "done"
    counted = F.col("cost") if include_failed else F.when(done, F.col("cost"))
    codes = F.array(*[F.lit(s) for s in schemas.NODE_STATUSES])
    width = len(schemas.NODE_STATUSES) + 1
    numbered = F.col("run").cast("bigint") * F.lit(width) + F.array_position(codes, F.col("status"))
    folded = runs.groupBy("product_id", "stage").agg(
        F.max(numbered).alias("_status"),
        F.max(F.struct("run", "error"))["error"].alias("error"),
        F.max(F.when(done, F.struct("run", "input_hash", "output_path"))).alias("_done"),
        F.coalesce(F.sum(counted), F.lit(0.0)).alias("cost"),
        F.min(F.when(F.coalesce("started", F.lit(True)), F.col("ts"))).alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    return folded.select(
        "product_id",
        "stage",
        F.get(codes, (F.pmod(F.col("_status"), F.lit(width)) - 1).cast("int")).alias("status"),
        F.coalesce("_done.input_hash", F.lit("")).alias("input_hash"),
        F.coalesce("_done.output_path", F.lit("")).alias("output_path"),
        "cost",
        F.coalesce("error", F.lit("")).alias("error"),
        "created_at",
        "updated_at",
    )


def in_ranges(runs: DataFrame, keys: Sequence[str], order: Sequence[str], range_rows: int) -> DataFrame:
    """``runs`` with ``_key``, ``_tie`` and ``_part``: dealt by key and order into ranges of about ``range_rows``.

    Range bounds are sampled. The hash of the whole row comes last in the order, so that runs of one
    instant are parted, too.
    """
    # One struct as the key: it is never NULL itself, so runs with an unknown product keep their rows.
    plain = [f.name for f in runs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = runs.withColumns(
        {"_key": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), "_tie": F.xxhash64(*plain)}
    )
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return shared_table(keyed.repartitionByRange(ranges, "_key", *order, "_tie").withColumn("_part", F.spark_partition_id()))


def cumulative_cost(
    runs: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cost: str,
    out: str = "running_cost",
    range_rows: int = 1 << 20,
) -> DataFrame:
    """Running cost per node in run order, safe for a node with any share of all runs at any instant.

    A prefix sum over ranges: runs are dealt into ranges of bounded size, summed up per node and range,
    and the sums of earlier ranges, one row per node and range, give each range its starting value. Runs
    of equal order stand in an order of their own that every reading agrees on. The ranges are settled
    in the shared folder first, since both steps must see the same ones.
    """
    laid = in_ranges(runs, keys, order, range_rows)
    totals = laid.groupBy("_key", "_part").agg(F.sum(cost).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_key", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy("_key", "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        laid.withColumn("_in", F.sum(cost).over(inside))
        .join(starts, ["_key", "_part"], "inner")
        .withColumn(out, F.col("_start") + F.col("_in"))
        .select(*runs.columns, out)
    )
