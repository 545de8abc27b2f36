"""Marketplace listings: typing, the one kept per shelf, and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import contracts as C
from ..functions.text import truthy

# Fixed value: a listing with fewer tags than this draws a warning.
MIN_TAGS = 5


def _typed_listing(item: Column) -> Column:
    blank = F.lit("")
    fields = {
        "marketplace": C.text_field(item["marketplace"], blank),
        "language": C.text_field(item["language"], F.lit("en")),
        "title": C.text_field(item["title"], blank),
        "description": C.text_field(item["description"], blank),
        "tags": C.text_list_field(item["tags"], F.array().cast("array<string>")),
        "price": C.number_field(item["price"], F.lit(0.0)),
        "category": C.text_field(item["category"], blank),
    }
    reason = C.first_reason(*[(f.ok, F.lit(name)) for name, f in fields.items()])
    return F.struct(*[f.value.alias(name) for name, f in fields.items()], reason.alias("reason"))


def type_listings(df: DataFrame, listings: str = "listings") -> DataFrame:
    """Loose listing objects to typed ones, in place, plus ``listing_error`` naming the first bad field."""
    items = C.open_items(F.col(listings), schemas.LISTING_COLUMNS)
    typed = C.once(df, _typed=F.transform(items, _typed_listing))
    bad = F.get(F.filter(F.col("_typed"), lambda item: item["reason"].isNotNull()), F.lit(0))["reason"]
    return C.once(
        typed,
        listing_error=F.concat(F.lit("invalid listing field: "), bad),
        **{listings: F.transform("_typed", lambda item: item.dropFields("reason"))},
    ).drop("_typed")


def normalize_listings(
    df: DataFrame, listings: str = "listings", keep: Sequence[str] = ("product_id",)
) -> DataFrame:
    """One row per listing of the products whose listings are all well formed, with its position."""
    typed = type_listings(df, listings).filter(F.col("listing_error").isNull())
    rows = typed.select(*keep, F.posexplode(listings).alias("pos", "listing"))
    return rows.select(*keep, "pos", *[F.col(f"listing.{c}") for c in schemas.LISTING_COLUMNS])


def dedupe_listings(
    df: DataFrame, keys: Sequence[str] = ("product_id", "marketplace", "language"), pos: str = "pos"
) -> DataFrame:
    """The last listing per key, for the exported copies only.

    Each mapper keeps its last listing per key before anything moves, so a shelf with a large share
    of all listings sends one row per mapper, and texts travel once.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def check_listings(
    df: DataFrame,
    keys: Sequence[str] = ("product_id",),
    marketplace: str = "marketplace",
    language: str = "language",
    title: str = "title",
    tags: str = "tags",
    min_tags: int = MIN_TAGS,
) -> DataFrame:
    """Issues of each listing: an empty title is an error, few tags a warning; both may apply."""
    shelf = F.concat_ws("/", F.coalesce(marketplace, F.lit("")), F.coalesce(language, F.lit("")))
    count = F.coalesce(F.size(tags), F.lit(0))

    def issue(criterion: str, severity: str, detail: Column) -> Column:
        return F.struct(
            F.lit(criterion).alias("criterion"), F.lit(severity).alias("severity"), detail.alias("detail")
        )

    found = F.array_compact(
        F.array(
            F.when(
                truthy(F.col(title)).isNull(),
                # Fixed value: issue and error texts are matched on by users.
                issue("listing_title", "error", F.concat(F.lit("missing title for "), shelf)),
            ),
            F.when(
                count < F.lit(min_tags),
                issue(
                    "listing_tags",
                    "warning",
                    # Fixed value: issue and error texts are matched on by users.
                    F.concat(F.lit("few tags for "), shelf, F.lit(": "), count.cast("string")),
                ),
            ),
        )
    )
    return df.select(*keys, F.explode(found).alias("issue")).select(*keys, "issue.*")
