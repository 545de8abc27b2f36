"""Artifact envelopes: configuration hash and provenance columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.hashing import record_hash


def config_hash(
    df: DataFrame,
    profile: Sequence[str],
    request: Sequence[str],
    runtime: Sequence[str] = (),
    aux: Sequence[str] = (),
    include_aux: bool = False,
    out: str = "config_hash",
) -> DataFrame:
    """Adds the hash of pack profile, request and runtime columns.

    The optional pack files do not count unless ``include_aux``: editing them does not invalidate.
    """
    used = [*profile, *request, *runtime, *(aux if include_aux else [])]
    return df.withColumn(out, record_hash(df, used))


def provenance(
    input_hash: Column, config: Column, model: Column, provider: Column, prompt_version: Column, created_at: Column
) -> Column:
    return F.struct(
        input_hash.alias("input_hash"),
        config.alias("config_hash"),
        model.alias("model"),
        provider.alias("provider"),
        prompt_version.alias("prompt_version"),
        created_at.alias("created_at"),
    )


def wrap_provenance(
    df: DataFrame,
    stage: str,
    artifact: Column,
    runtime: dict[str, dict[str, str]],
    prompt_version: str,
    created_at: Column | None = None,
    input_hash: str = "input_hash",
    config: str = "config_hash",
    keep: Sequence[str] = ("product_id",),
    schema_version: int = 1,
) -> DataFrame:
    """Envelope rows of one stage's output.

    Only the image stage names the image provider; all others, deterministic ones included, name the
    text provider.
    """
    return wrap_stages(df, {stage: prompt_version}, artifact, runtime, created_at, input_hash, config, keep, schema_version)


def wrap_stages(
    df: DataFrame,
    prompt_versions: dict[str, str],
    artifact: Column,
    runtime: dict[str, dict[str, str]],
    created_at: Column | None = None,
    input_hash: str = "input_hash",
    config: str = "config_hash",
    keep: Sequence[str] = ("product_id",),
    schema_version: int = 1,
) -> DataFrame:
    """Envelope rows of several stages, given with their prompt versions, from one pass over the rows."""

    def envelope(stage: str, prompt_version: str) -> Column:
        using = runtime["image" if stage == "assets" else "llm"]
        return F.struct(
            F.lit(schemas.STAGE_OUTPUT[stage]).alias("name"),
            F.lit(schema_version).alias("schema_version"),
            artifact.alias("artifact"),
            provenance(
                F.col(input_hash),
                F.col(config),
                F.lit(using.get("model", "")),
                F.lit(using["provider"]),
                F.lit(prompt_version),
                F.current_timestamp() if created_at is None else created_at,
            ).alias("provenance"),
        )

    return df.select(*keep, F.inline(F.array(*[envelope(s, v) for s, v in prompt_versions.items()])))
