"""Reports over node state: costs, latest status, status table, product list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas


def stage_ordinal(stage: Column) -> Column:
    """Position of a stage in the pipeline, from 1; NULL for other names. A literal, not a join."""
    order = F.array(*[F.lit(s) for s in schemas.STAGES])
    return F.nullif(F.array_position(order, stage), F.lit(0)).cast("int")


def cost_summary(
    df: DataFrame, product: str = "product_id", stage: str = "stage", cost: str = "cost"
) -> DataFrame:
    """Cost per stage, per product and in total; ``level`` is 0, 1 and 3 in that order.

    Rows are summed per (product, stage) first: the rollup then triples that small result, not the
    input, and a hot product has been reduced on every mapper.
    """
    node = df.groupBy(product, stage).agg(F.sum(cost).alias("_cost"))
    rolled = node.rollup(product, stage).agg(
        F.sum("_cost").alias("cost"), F.grouping_id().cast("int").alias("level")
    )
    return rolled.select(F.col(product).alias("product_id"), F.col(stage).alias("stage"), "cost", "level")


def latest_status(
    products: DataFrame, state: DataFrame, key: str = "product_id", stage: str = "stage", status: str = "status"
) -> DataFrame:
    """Status of the last stage, in pipeline order, that has a record; ``n/a`` without any.

    Ordinal and status code share one number, so the maximum is a plain numeric aggregate that
    reduces on the mappers in a hash table.
    """
    codes = F.array(*[F.lit(s) for s in schemas.NODE_STATUSES])
    width = F.lit(len(schemas.NODE_STATUSES) + 1)
    packed = stage_ordinal(F.col(stage)) * width + F.array_position(codes, F.col(status)).cast("int")
    last = state.select(key, packed.alias("_p")).groupBy(key).agg(F.max("_p").alias("_p"))
    decoded = F.get(codes, F.pmod(F.col("_p"), width) - F.lit(1))
    return products.join(last, key, "left").withColumn("status", F.coalesce(decoded, F.lit("n/a"))).drop("_p")


def status_table(state: DataFrame, key: str = "product_id") -> DataFrame:
    """Stage, status, start of the input hash and cost of each record, in pipeline order."""
    rows = state.select(
        key,
        stage_ordinal(F.col("stage")).alias("stage_ord"),
        "stage",
        "status",
        F.substring(F.coalesce("input_hash", F.lit("")), 1, 11).alias("short_hash"),
        "cost",
    )
    return rows.filter(F.col("stage_ord").isNotNull()).orderBy(key, "stage_ord")


def list_products(products: DataFrame, state: DataFrame, key: str = "product_id") -> DataFrame:
    """Each product with its pack, latest status and total cost, ordered by product.

    Status and cost come from one aggregation over the state.
    """
    codes = F.array(*[F.lit(s) for s in schemas.NODE_STATUSES])
    width = F.lit(len(schemas.NODE_STATUSES) + 1)
    packed = stage_ordinal(F.col("stage")) * width + F.array_position(codes, F.col("status")).cast("int")
    node = state.select(key, packed.alias("_p"), "cost")
    folded = node.groupBy(key).agg(F.max("_p").alias("_p"), F.sum("cost").alias("cost"))
    decoded = F.get(codes, F.pmod(F.col("_p"), width) - F.lit(1))
    return (
        products.join(folded, key, "left")
        .select(
            *products.columns,
            F.coalesce(decoded, F.lit("n/a")).alias("status"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"),
        )
        .orderBy(key)
    )


def total_cost(state: DataFrame) -> DataFrame:
    """Grand total over all products."""
    return state.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
