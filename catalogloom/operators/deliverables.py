"""Deliverables: expansion per format, marketplace and language; geometry, covers, bundles, paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.text import truthy
from .products import localized_title

# The two outputs of each format and the suffix of their files.
OUTPUTS = {
    "digital": [("pdf", ".pdf"), ("zip", ".zip")],
    "print": [("interior", "-interior.pdf"), ("cover", "-cover.png")],
}


def deliverables_of(
    marketplaces: dict[str, Column], formats: Column, languages: Column, pack: Column, theme: Column
) -> Column:
    """All outputs of a product as one array: format × marketplace of that format × language × kind.

    ``marketplaces`` maps a format to its array column. Formats the request names but no one knows
    yield nothing.
    """

    def outputs(kind: str, shop: Column, language: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(kind).alias("format"),
                    shop.alias("marketplace"),
                    language.alias("language"),
                    F.lit(name).alias("kind"),
                    deliverable_path(F.lit(kind), language, pack, theme, shop, F.lit(suffix)).alias("path"),
                )
                for name, suffix in OUTPUTS[kind]
            ]
        )

    def of_format(kind: str, shops: Column) -> Column:
        per_shop = F.transform(
            shops, lambda shop: F.flatten(F.transform(languages, lambda language: outputs(kind, shop, language)))
        )
        return F.when(F.array_contains(formats, kind), F.flatten(per_shop))

    return F.flatten(F.array_compact(F.array(*[of_format(k, shops) for k, shops in marketplaces.items()])))


def expand_deliverables(
    df: DataFrame,
    marketplaces: dict[str, Column] | None = None,
    formats: str = "formats",
    languages: str = "languages",
    pack: str = "pack",
    theme: str = "theme",
    keep: Sequence[str] = ("product_id",),
) -> DataFrame:
    """One row per output of each product. Rows multiply where they are, nothing moves."""
    if marketplaces is None:
        marketplaces = {kind: F.col(f"pack_formats.{kind}.marketplaces") for kind in OUTPUTS}
    made = deliverables_of(marketplaces, F.col(formats), F.col(languages), F.col(pack), F.col(theme))
    return df.select(*keep, F.inline(made))


def deliverable_path(
    fmt: Column, language: Column, pack: Column, theme: Column, marketplace: Column, suffix: Column
) -> Column:
    """Path of one output; the theme is used as given, not as a slug."""
    name = F.concat(pack, F.lit("-"), theme, F.lit("-"), marketplace, suffix)
    return F.concat_ws("/", F.lit("packages"), fmt, language, name)


def asset_paths(df: DataFrame, asset_id: str = "id") -> DataFrame:
    """Paths of the raw and the cleaned image of an asset."""
    return df.withColumns(
        {
            "asset_path": F.concat(F.lit("assets/"), F.col(asset_id), F.lit(".png")),
            "processed_path": F.concat(F.lit("processed/"), F.col(asset_id), F.lit(".png")),
        }
    )


def artifact_path(name: Column) -> Column:
    return F.concat(F.lit("artifacts/"), name, F.lit(".json"))


def resolve_page_size(
    df: DataFrame, packaging: str = "packaging", image_size: str = "image_size", strict_parity: bool = False
) -> DataFrame:
    """Page size and bleed per format from the packaging config.

    Print falls back to letter size with bleed. Digital has no sensible fallback: the image size in
    pixels would be read as inches. ``strict_parity`` reproduces exactly that; otherwise the size is
    NULL and ``geometry_error`` says so.
    """

    def setting(kind: str, key: str, as_type: str) -> Column:
        return F.try_variant_get(F.col(packaging), f"$.{kind}.{key}", as_type)

    digital = setting("digital", "page_size", "string")
    fallback = F.col(image_size) if strict_parity else F.lit(None).cast("string")
    return df.withColumns(
        {
            "digital_page_size": F.coalesce(digital, fallback),
            "digital_bleed": F.lit(G.DIGITAL_BLEED),
            "print_page_size": F.coalesce(setting("print", "page_size", "string"), F.lit(G.PRINT_PAGE)),
            "print_bleed": F.coalesce(setting("print", "bleed_inches", "double"), F.lit(G.PRINT_BLEED)),
            "geometry_error": F.when(
                digital.isNull() & F.lit(not strict_parity), F.lit("digital page size is not configured")
            ),
        }
    )


def geometry_of(size: Column, bleed: Column) -> dict[str, Column]:
    """Pixels and points of a page with bleed on all sides."""
    width, height = G.inches(size)
    full_w, full_h = width + F.lit(2) * bleed, height + F.lit(2) * bleed
    return {
        "width_px": G.to_pixels(full_w),
        "height_px": G.to_pixels(full_h),
        "width_pt": full_w * F.lit(G.POINTS),
        "height_pt": full_h * F.lit(G.POINTS),
    }


def page_geometry(df: DataFrame, size: str = "page_size", bleed: str = "bleed") -> DataFrame:
    """``geometry_of`` as columns."""
    return df.withColumns(geometry_of(F.col(size), F.col(bleed)))


def covers_of(titles: Column, languages: Column, theme: Column, subtitle: Column, size: Column) -> Column:
    """One cover per language as an array: its texts and its pixel size without bleed."""
    width, height = G.inches(size)
    return F.transform(
        languages,
        lambda language: F.struct(
            language.alias("language"),
            localized_title(titles, language, theme).alias("title"),
            subtitle.alias("subtitle"),
            G.to_pixels(width).alias("width_px"),
            G.to_pixels(height).alias("height_px"),
        ),
    )


def fit_crop_box(
    df: DataFrame, w: str = "width", h: str = "height", target_w: str = "target_w", target_h: str = "target_h"
) -> DataFrame:
    """Adds the crop box (left, top, width, height) that gives the source the target's ratio."""
    box = G.crop_box(F.col(w), F.col(h), F.col(target_w), F.col(target_h))
    return df.withColumn("_box", box).select(
        *df.columns,
        F.col("_box.left").alias("crop_left"),
        F.col("_box.top").alias("crop_top"),
        F.col("_box.width").alias("crop_width"),
        F.col("_box.height").alias("crop_height"),
    )


def cover_spec(
    df: DataFrame,
    titles: str = "titles",
    language: str = "language",
    theme: str = "theme",
    subtitle: str = "subtitle",
    size: str = "page_size",
) -> DataFrame:
    """What a cover shows: texts, pixel size without bleed, and which texts are left out when empty."""
    width, height = G.inches(F.col(size))
    title = localized_title(F.col(titles), F.col(language), F.col(theme))
    return df.withColumns(
        {
            "cover_title": title,
            "cover_subtitle": F.col(subtitle),
            "cover_width_px": G.to_pixels(width),
            "cover_height_px": G.to_pixels(height),
            "draw_title": truthy(title).isNotNull(),
            "draw_subtitle": truthy(F.col(subtitle)).isNotNull(),
        }
    )


def bundle_members(
    assets: DataFrame, stats: DataFrame | None = None, keys: Sequence[str] = ("product_id",), pos: str = "pos", name: str = "name"
) -> DataFrame:
    """Ordered members of a product's bundle: one row per member with its position and byte size.

    A row per member, not an array per bundle: a bundle of any size stays spread over the cluster,
    and the order is the position column. Every deliverable of a product has the same members, so
    they are listed once per product. ``stats`` has the sizes by product and name, as file names
    recur in every product; of repeated entries the largest counts, a member without one has no size.
    """
    if stats is None:
        listed = assets
    else:
        sizes = stats.groupBy(*keys, name).agg(F.max("length").alias("length"))
        listed = assets.join(sizes, [*keys, name], "left")
    return listed.select(*keys, F.col(pos).alias("pos"), F.col(name).alias("name"), "length")


def bundle_manifest(members: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Per bundle: member count, first and last position, total bytes. Reduced before the shuffle."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
