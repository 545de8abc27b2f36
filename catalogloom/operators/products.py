"""Concept output to rows: plans, pages, image assets, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import contracts as C


def page_id(pos: Column) -> Column:
    """Default id of the page at a zero-based position; wide numbers keep all their digits."""
    return F.format_string("page_%03d", pos + F.lit(1))


PAGE_KEYS = ["id", "index", "prompt", "title"]


def safe_name(name: Column) -> Column:
    """Whether a text can name a file in a folder: one path component that leads nowhere else."""
    return F.coalesce(~name.rlike(r"[/\\\x00]|\A\.{0,2}\z"), F.lit(False))


def _typed_page(page: Column, pos: Column) -> Column:
    given = C.text_field(page["id"], page_id(pos))
    ident = C.Field(given.value, given.ok & safe_name(given.value))
    index = C.int_field(page["index"], pos + F.lit(1))
    prompt = C.text_field(page["prompt"], F.lit(""))
    title = C.text_field(page["title"], ident.value)
    return F.struct(
        ident.value.alias("id"),
        index.value.alias("index"),
        prompt.value.alias("prompt"),
        title.value.alias("title"),
        C.first_reason(
            (ident.ok, F.lit("id")), (index.ok, F.lit("index")), (prompt.ok, F.lit("prompt")), (title.ok, F.lit("title"))
        ).alias("reason"),
    )


def type_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Loose page objects to typed ones, in place, plus ``page_error`` naming the first bad field.

    One bad page fails its product, so the check runs over the array before anything is exploded. Ids
    name files, so one that holds a path separator or leads elsewhere is bad.
    """
    typed = C.once(df, _typed=F.transform(C.open_items(F.col(pages), PAGE_KEYS), _typed_page))
    bad = F.get(F.filter(F.col("_typed"), lambda p: p["reason"].isNotNull()), F.lit(0))["reason"]
    return C.once(
        typed,
        page_error=F.concat(F.lit("invalid page field: "), bad),
        **{pages: F.transform("_typed", lambda p: p.dropFields("reason"))},
    ).drop("_typed")


def explode_pages(
    plans: DataFrame, pages: str = "pages", theme: str = "theme", keep: Sequence[str] = ("product_id",), outer: bool = False
) -> DataFrame:
    """One row per page of a plan with typed pages. The requested page count is not enforced.

    ``outer`` keeps plans without pages as one row of NULLs.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    out = plans.select(*keep, F.col(theme).alias("theme"), explode(pages).alias("pos", "page"))
    return out.select(*keep, "pos", "page.id", "page.index", "page.prompt", "page.title", "theme")


def explode_text_pages(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One page per non-empty line of a text, with default ids and titles."""
    out = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "prompt"))
    return out.filter(F.col("prompt") != "").select(
        *keep,
        "pos",
        page_id(F.col("pos")).alias("id"),
        (F.col("pos") + 1).alias("index"),
        "prompt",
        page_id(F.col("pos")).alias("title"),
    )


def asset_of(page_id: Column, prompt: Column, size: Column) -> Column:
    """The image asset of a page; the size comes from the pack, the rest is fixed."""
    return F.struct(
        page_id.alias("id"),
        page_id.alias("page_id"),
        prompt.alias("prompt"),
        F.lit("1:1").alias("aspect_ratio"),
        size.alias("size"),
        F.lit("high").alias("quality"),
    )


def plan_assets(pages: DataFrame, packs: DataFrame | None = None, on: str = "pack", size: str = "image_size") -> DataFrame:
    """One image asset per page.

    Give ``packs`` only when the pages do not carry the size yet: carrying it through the explode is
    free, joining after it moves every page.
    """
    joined = pages if packs is None else pages.join(packs.select(on, size), on, "inner")
    keys = [c for c in ("product_id", "pos") if c in joined.columns]
    made = joined.select(*keys, asset_of(F.col("id"), F.col("prompt"), F.col(size)).alias("asset"))
    return made.select(*keys, "asset.*")


def localized_title(titles: Column, language: Column, theme: Column) -> Column:
    """Title in the language, else the English one, else the theme. An empty title counts as present."""
    return F.coalesce(titles[language], titles["en"], theme)
