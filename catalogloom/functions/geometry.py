"""Page geometry and crop boxes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Print resolution and points per inch.
DPI = 300
POINTS = 72

# Print page size and bleed (inches) where the packaging config is silent.
PRINT_PAGE = "8.5x11"
PRINT_BLEED = 0.125
DIGITAL_BLEED = 0.0


def inches(size: Column) -> tuple[Column, Column]:
    """Width and height of a ``WxH`` text as doubles; NULL where either is not a number."""
    parts = F.split(size, "x")
    well_formed = F.size(parts) == 2
    return tuple(F.when(well_formed, F.get(parts, F.lit(i)).try_cast("double")) for i in (0, 1))


def to_pixels(length: Column, dpi: int = DPI) -> Column:
    """Inches to whole pixels, ties to even."""
    return F.bround(length * F.lit(dpi)).cast("int")


def crop_box(w: Column, h: Column, target_w: Column, target_h: Column) -> Column:
    """Centred box of the source that has the target's aspect ratio.

    A wider source loses its sides, any other its top and bottom; offsets are floored.
    """
    ratio = target_w.cast("double") / target_h.cast("double")
    wider = w.cast("double") / h.cast("double") > ratio
    new_w = F.when(wider, F.bround(h * ratio).cast("bigint")).otherwise(w.cast("bigint"))
    new_h = F.when(wider, h.cast("bigint")).otherwise(F.bround(w / ratio).cast("bigint"))

    def half(room: Column) -> Column:
        return F.floor(room / F.lit(2)).cast("bigint")

    return F.struct(
        half(w.cast("bigint") - new_w).alias("left"),
        half(h.cast("bigint") - new_h).alias("top"),
        new_w.alias("width"),
        new_h.alias("height"),
    )
