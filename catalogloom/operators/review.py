"""The quality gate: asset, package and listing issues, one verdict and four counts per product."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import truthy
from .listings import MIN_TAGS
from .requests import distinct_keys

# Fixed value: a cleaned image below this many bytes draws a warning.
MIN_ASSET_BYTES = 1000

# Names of the four scores.
SCORES = ["concept_pages", "assets_generated", "packages_built", "listings_count"]


def _issue(criterion: str, severity: str, detail: Column) -> list[Column]:
    return [F.lit(criterion).alias("criterion"), F.lit(severity).alias("severity"), detail.alias("detail")]


def check_assets(
    assets: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = ("product_id",),
    path: str = "path",
    length: str = "length",
    min_bytes: int = MIN_ASSET_BYTES,
    on: Sequence[str] | None = None,
) -> DataFrame:
    """Missing cleaned image: error. Present but too small: warning. Never both."""
    on = list(on or [path])
    sized = assets.select(*dict.fromkeys([*keys, *on, path])).join(
        stats.select(*on, F.col(length).alias("_bytes"), F.lit(True).alias("_there")), on, "left"
    )
    missing = F.col("_there").isNull()
    small = F.col("_bytes") < F.lit(min_bytes)
    return sized.filter(missing | small).select(
        *keys,
        F.when(missing, F.lit("asset_existence")).otherwise(F.lit("asset_size")).alias("criterion"),
        F.when(missing, F.lit("error")).otherwise(F.lit("warning")).alias("severity"),
        F.concat(
            # Fixed value: issue and error texts are matched on by users.
            F.when(missing, F.lit("missing processed asset: ")).otherwise(
                F.lit("asset suspiciously small (<1KB): ")
            ),
            F.col(path).cast("string"),
        ).alias("detail"),
    )


def check_packages(products: DataFrame, packages: DataFrame, key: str = "product_id") -> DataFrame:
    """Products without a single package."""
    bare = products.select(key).join(distinct_keys(packages, key), key, "left_anti")
    # Fixed value: issue and error texts are matched on by users.
    return bare.select(key, *_issue("packages", "error", F.lit("no packages produced")))


def union_issues(*parts: DataFrame) -> DataFrame:
    """All issues one after another, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def review_verdict(products: DataFrame, issues: DataFrame, key: str = "product_id") -> DataFrame:
    """``fail`` for products with an error among their issues, else ``pass``; issue-free ones included."""
    failed = distinct_keys(issues.filter(F.col("severity") == "error"), key).withColumn("_failed", F.lit(True))
    verdict = F.when(F.col("_failed"), F.lit("fail")).otherwise(F.lit("pass"))
    return products.select(key).join(failed, key, "left").select(key, verdict.alias("verdict"))


def review_scores(
    products: DataFrame,
    pages: DataFrame,
    assets: DataFrame,
    packages: DataFrame,
    listings: DataFrame,
    key: str = "product_id",
) -> DataFrame:
    """Row counts of the four child tables per product, as doubles.

    The children are reduced to the key and a one-hot column and counted in a single aggregation, so
    no child ever multiplies another and every mapper sends one row per product it saw.
    """
    children = dict(zip(SCORES, (pages, assets, packages, listings)))
    tagged = union_issues(*[df.select(key, F.lit(name).alias("_kind")) for name, df in children.items()])
    counts = tagged.groupBy(key).agg(*[F.count(F.when(F.col("_kind") == n, 1)).alias(n) for n in SCORES])
    return products.select(key).join(counts, key, "left").select(
        key, *[F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in SCORES]
    )


def review_report(
    products: DataFrame,
    issues: DataFrame,
    pages: DataFrame,
    assets: DataFrame,
    packages: DataFrame,
    listings: DataFrame,
    key: str = "product_id",
) -> DataFrame:
    """Verdict and scores of every product.

    Issues join the same single aggregation as the scores: one shuffle of narrow, pre-reduced rows.
    """
    children = dict(zip(SCORES, (pages, assets, packages, listings)))
    tagged = [df.select(key, F.lit(name).alias("kind"), F.lit(1).alias("n")) for name, df in children.items()]
    tagged.append(issues.select(key, F.col("severity").alias("kind"), F.lit(1).alias("n")))
    tagged.append(products.select(key, F.lit("product").alias("kind"), F.lit(1).alias("n")))
    return products.select(key).join(report_of(union_issues(*tagged), key), key)


def report_of(tagged: DataFrame, key: str = "product_id") -> DataFrame:
    """Verdict and scores from rows (key, kind, n); ``kind`` is a score or a severity.

    For callers that find several kinds in one pass. Every product has a row of some kind.
    """
    counts = tagged.groupBy(key).agg(
        *[F.sum(F.when(F.col("kind") == n, F.col("n")).otherwise(0)).alias(n) for n in [*SCORES, "error", "warning"]]
    )
    return counts.select(
        key,
        F.when(F.col("error") > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict"),
        *[F.coalesce(F.col(n), F.lit(0)).cast("double").alias(n) for n in SCORES],
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(f"{n}s") for n in ("error", "warning")],
    )


ITEM = "kind string, n bigint, criterion string, severity string, detail string"


def _item(kind: str | Column, n: Column, criterion: str | None = None, detail: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    severity = kind if criterion else F.lit(None)
    parts = (kind, n.cast("bigint"), F.lit(criterion), severity, detail if criterion else F.lit(None))
    names = [part.split()[0] for part in ITEM.split(", ")]
    return F.struct(*[p.cast("string" if name != "n" else "bigint").alias(name) for name, p in zip(names, parts)])


def review_items(
    df: DataFrame,
    keys: Sequence[str],
    pages: Column,
    assets: Column,
    packages: Column,
    listings: Column,
    min_bytes: int = MIN_ASSET_BYTES,
    min_tags: int = MIN_TAGS,
) -> DataFrame:
    """Everything the gate finds and counts, from one pass over rows that hold a product each.

    ``pages`` and ``packages`` are numbers, ``assets`` is an array of (path, length), the length NULL for
    a missing file, ``listings`` one of (marketplace, language, title, tags). One generator gives the four
    scores and all issues as rows (keys, kind, n, criterion, severity, detail): ``issues_of`` are the
    issues, ``report_of`` verdict and scores. The rules are those of ``check_assets``, ``check_packages``
    and ``check_listings``.
    """
    scores = dict(zip(SCORES, (pages, F.size(assets), packages, F.size(listings))))
    one = F.lit(1)

    def asset_issue(a: Column) -> Column:
        # Issue and error texts are matched on by users.
        return F.when(
            a["length"].isNull(), _item("error", one, "asset_existence", F.concat(F.lit("missing processed asset: "), a["path"]))
        ).when(
            a["length"] < min_bytes, _item("warning", one, "asset_size", F.concat(F.lit("asset suspiciously small (<1KB): "), a["path"]))
        )

    def listing_issues(x: Column) -> Column:
        shelf = F.concat_ws("/", F.coalesce(x["marketplace"], F.lit("")), F.coalesce(x["language"], F.lit("")))
        count = F.coalesce(F.size(x["tags"]), F.lit(0))
        # Issue and error texts are matched on by users.
        untitled = _item("error", one, "listing_title", F.concat(F.lit("missing title for "), shelf))
        bare = _item("warning", one, "listing_tags", F.concat(F.lit("few tags for "), shelf, F.lit(": "), count.cast("string")))
        return F.array(F.when(truthy(x["title"]).isNull(), untitled), F.when(count < min_tags, bare))

    found = F.concat(
        F.array(*[_item(name, n) for name, n in scores.items()]),
        F.transform(assets, asset_issue),
        F.array(F.when(packages == 0, _item("error", one, "packages", F.lit("no packages produced")))),
        F.flatten(F.transform(listings, listing_issues)),
    )
    return df.select(*keys, F.inline(F.array_compact(found)))


def issues_of(items: DataFrame) -> DataFrame:
    """The issues among ``review_items``."""
    return items.filter(F.col("severity").isNotNull()).drop("kind", "n")


def as_score_map(report: DataFrame) -> DataFrame:
    """The four score columns folded into one map column."""
    pairs = [part for n in SCORES for part in (F.lit(n), F.col(n))]
    return report.withColumn("scores", F.create_map(*pairs)).drop(*SCORES)
