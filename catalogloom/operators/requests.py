"""Product requests and niche packs: normalising, resolving, guarding, validating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import contracts as C
from ..functions.text import slugify, split_list, truthy


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalize_requests(df: DataFrame) -> DataFrame:
    """Separated text to lists of trimmed, non-empty items, with the defaults where nothing was given."""
    return df.withColumns(
        {
            "page_count": F.coalesce(F.col("page_count"), F.lit(schemas.DEFAULT_PAGE_COUNT)),
            "languages": F.coalesce(split_list(F.col("languages")), text_array(schemas.DEFAULT_LANGUAGES)),
            "formats": F.coalesce(split_list(F.col("formats")), text_array(schemas.DEFAULT_FORMATS)),
            "title_hint": F.coalesce(F.col("title_hint"), F.lit("")),
        }
    )


def fill_request_defaults(df: DataFrame) -> DataFrame:
    """Defaults for requests whose lists are already arrays."""
    return df.withColumns(
        {
            "page_count": F.coalesce(F.col("page_count"), F.lit(schemas.DEFAULT_PAGE_COUNT)),
            "languages": F.coalesce(F.col("languages"), text_array(schemas.DEFAULT_LANGUAGES)),
            "formats": F.coalesce(F.col("formats"), text_array(schemas.DEFAULT_FORMATS)),
            "title_hint": F.coalesce(F.col("title_hint"), F.lit("")),
        }
    )


def derive_product_id(df: DataFrame, pack: str = "pack", theme: str = "theme", out: str = "product_id") -> DataFrame:
    """The given id unless blank, else the slug of pack and theme."""
    slug = slugify(F.concat(F.col(pack), F.lit("-"), F.col(theme)))
    given = truthy(F.col(out)) if out in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(given, slug))


def join_requests_packs(
    requests: DataFrame, packs: DataFrame, on: str = "pack", pack_key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Requests with their pack's columns, and the requests whose pack is unknown.

    No hint: packs are small in practice, and the optimizer broadcasts them exactly when their size
    says so. Past that threshold the join shuffles, and adaptive skew splitting spreads a pack that
    holds a large share of the requests.
    """
    marked = mark_packs(requests, packs, on, pack_key)
    known = F.col("known")
    return marked.filter(known).drop("known"), marked.filter(~known).select(*requests.columns)


def mark_packs(requests: DataFrame, packs: DataFrame, on: str = "pack", pack_key: str = "id") -> DataFrame:
    """All requests with their pack's columns and ``known``, in one join; pack keys are unique (``validate_packs``)."""
    keyed = packs.withColumnRenamed(pack_key, on).withColumn("known", F.lit(True))
    return requests.join(keyed, on, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys, reduced on the mappers first.

    Put in front of a semi or anti join it costs no extra shuffle (the join needs the same
    partitioning) and leaves one row per key, so a hot key cannot pile up on the probe side.
    """
    return df.select(*keys).distinct()


def guard_new_products(
    requests: DataFrame, existing: DataFrame, key: str = "product_id", force: str | None = "force"
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests: an existing product passes only when forced."""
    marked, refused = mark_guarded(requests, existing, key, force), F.col("decision") == "rejected"
    return marked.filter(~refused).drop("decision"), marked.filter(refused).drop("decision")


def mark_guarded(requests: DataFrame, existing: DataFrame, key: str = "product_id", force: str | None = "force") -> DataFrame:
    """All requests with ``decision``: accepted or rejected."""
    known = distinct_keys(existing, key)
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    marked = requests.join(known.withColumn("_known", F.lit(True)), key, "left")
    refused = F.coalesce(F.col("_known"), F.lit(False)) & ~forced
    return marked.withColumn("decision", F.when(refused, "rejected").otherwise("accepted")).drop("_known")


def _marketplaces(formats: Column, kind: str) -> tuple[C.Field, Column]:
    """Marketplaces of one format, and whether the object around them is well formed."""
    spec = C.member(formats, kind)
    listed = C.text_list_field(C.member(spec, "marketplaces"), text_array([]))
    return listed, spec.isNull() | C.is_object(spec)


PROFILE_KEYS = [
    "id",
    "schema_version",
    "pack_version",
    "pack_type",
    "default_language",
    "languages",
    "formats",
    "page_count",
    "image_size",
]


def check_packs(files: DataFrame) -> DataFrame:
    """One row per pack directory: the typed profile and ``reason``, NULL for a valid pack.

    ``files`` has one row per YAML file: pack_dir, stem, path, doc (JSON text or NULL), error. The
    pivot over the six known stems keeps one row per pack. A pack is reported under the first thing
    wrong with it, in reading order: profile file, profile fields, then each optional file.
    """
    stems = ["pack", *schemas.PACK_AUX_FILES]
    one = F.struct("path", "doc", "error")
    wide = files.groupBy("pack_dir").agg(*[F.max(F.when(F.col("stem") == s, one)).alias(s) for s in stems])
    flat = wide.select(
        "pack_dir",
        F.col("pack").isNotNull().alias("there"),
        *[F.col(f"{s}.{part}").alias(f"{s}_{part}") for s in stems for part in ("doc", "error")],
    )
    doc = C.once(flat, _doc=F.try_parse_json(F.col("pack_doc")))
    opened = C.once(doc, **{f"_{k}": C.member(F.col("_doc"), k) for k in PROFILE_KEYS})

    lit = F.lit
    v = {k: F.col(f"_{k}") for k in PROFILE_KEYS}
    fields = {
        "id": C.text_field(v["id"], lit(None).cast("string")),
        "schema_version": C.int_field(v["schema_version"], lit(1)),
        "pack_version": C.int_field(v["pack_version"], lit(1)),
        "pack_type": C.text_field(v["pack_type"], lit("generic")),
        "default_language": C.text_field(v["default_language"], lit("en")),
        "languages": C.text_list_field(v["languages"], text_array(schemas.DEFAULT_LANGUAGES)),
    }
    late = {
        "page_count": C.int_field(v["page_count"], lit(schemas.DEFAULT_PAGE_COUNT)),
        "image_size": C.text_field(v["image_size"], lit(schemas.DEFAULT_IMAGE_SIZE)),
    }
    digital, digital_shape = _marketplaces(v["formats"], "digital")
    printed, print_shape = _marketplaces(v["formats"], "print")
    formats_ok = (v["formats"].isNull() | C.is_object(v["formats"])) & digital_shape & digital.ok & print_shape & printed.ok

    def bad(field: str) -> Column:
        # Fixed value: issue and error texts are matched on by users.
        return lit(f"invalid pack profile: {field}")

    reason = C.first_reason(
        # Fixed value: issue and error texts are matched on by users.
        (F.col("there"), lit("missing pack.yaml")),
        (F.col("pack_error").isNull(), F.col("pack_error")),
        (v["id"].isNotNull(), bad("id")),
        *[(f.ok, bad(name)) for name, f in fields.items()],
        (formats_ok, bad("formats")),
        *[(f.ok, bad(name)) for name, f in late.items()],
        *[(F.col(f"{s}_error").isNull(), F.col(f"{s}_error")) for s in schemas.PACK_AUX_FILES],
    )
    shops = F.struct(
        F.struct(digital.value.alias("marketplaces")).alias("digital"),
        F.struct(printed.value.alias("marketplaces")).alias("print"),
    )
    return opened.select(
        "pack_dir",
        F.inline(
            F.array(
                F.struct(
                    reason.alias("reason"),
                    *[f.value.alias(name) for name, f in fields.items()],
                    shops.alias("formats"),
                    *[f.value.alias(name) for name, f in late.items()],
                    *[F.try_parse_json(F.col(f"{s}_doc")).alias(s) for s in schemas.PACK_AUX_FILES],
                )
            )
        ),
    )


def shared_ids(checked: DataFrame) -> DataFrame:
    """``check_packs`` rows, where valid packs that have an id in common become violations.

    Requests name their pack by id, so of several packs with one id none is the right one, and a join
    would multiply requests. Ids are counted on the valid packs alone; a hot id is one row per mapper.
    """
    valid = F.col("reason").isNull()
    counts = checked.filter(valid).groupBy("id").agg(F.count("*").alias("_packs")).filter(F.col("_packs") > 1)
    joined = checked.join(counts, "id", "left").withColumn("_packs", F.when(valid, F.col("_packs")))
    # Fixed value: issue and error texts are matched on by users.
    shared = F.concat(F.lit("duplicate pack id: "), F.col("id"))
    return joined.withColumn("reason", F.when(F.col("_packs").isNotNull(), shared).otherwise(F.col("reason"))).select(*checked.columns)


def validate_packs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid packs as typed rows with unique ids, and violations as (pack_dir, reason)."""
    checked = shared_ids(check_packs(files))
    return (
        checked.filter(F.col("reason").isNull()).drop("pack_dir", "reason"),
        checked.filter(F.col("reason").isNotNull()).select("pack_dir", "reason"),
    )
