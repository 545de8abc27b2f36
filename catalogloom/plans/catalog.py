"""The six stages for all products at once.

A stage is a function from product rows to one output row per product (``doc``, ``error``, ``cost``).
``produce`` runs the stages in order. The loop is over stages, never over products: in each one the
inputs are bound, the node keys compared with the run log, and only the nodes that changed are run.
Stage outputs are written before anything reads them, because a later stage is decided on the
content of the earlier ones, and because provider calls must not be repeated.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import contracts as C
from ..functions.hashing import record_hash
from ..operators import completions as L
from ..operators import deliverables as D
from ..operators import incremental as I
from ..operators import images as G
from ..operators import listings as K
from ..operators import products as P
from ..operators import provenance as V
from ..operators import review as W
from ..operators.requests import guard_new_products, join_requests_packs
from ..session import settle
from ..sources import tables as S

ASSET = "struct<id:string,page_id:string,prompt:string,aspect_ratio:string,size:string,quality:string>"
FILES = "product_id string, path string, length bigint, uri string"

# Name of each stage's prompt version, part of its node key.
PROMPT_VERSIONS = {stage: f"{stage}-v1" for stage in schemas.STAGES}

PROFILE = [
    "pack", "schema_version", "pack_version", "pack_type", "default_language", "pack_languages", "pack_formats",
    "pack_page_count", "image_size",
]
REQUEST = ["pack", "theme", "page_count", "languages", "formats", "title_hint"]


@dataclass(frozen=True)
class Run:
    """One execution over a working directory."""

    spark: SparkSession
    workdir: str
    number: int
    runtime: dict[str, dict[str, str]]
    complete: Callable[[DataFrame], DataFrame]
    draw: Callable[[DataFrame], DataFrame]
    decode: Callable[[bytes], tuple[int, int, int, bytes]] | None = None
    created_at: Column = field(default_factory=F.current_timestamp)

    def path(self, *parts: str) -> str:
        return "/".join([self.workdir, *parts])

    def out(self, name: str) -> str:
        return self.path("out", name, f"run={self.number}")


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at a path; without one, an empty table of the schema, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # an unreadable table is no empty one
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def current(run: Run, name: str, *columns: str) -> DataFrame | None:
    """The named columns of each product's latest output under a name; one shuffle of what is asked for."""
    rows = stored(run.spark, run.path("out", name))
    if rows is None:
        return None
    last = rows.filter(F.col("error").isNull()).groupBy("product_id").agg(
        F.max_by(F.struct(F.col("run"), *columns), F.col("run")).alias("_last")
    )
    return last.select("product_id", *[F.col(f"_last.{c}").alias(c) for c in columns])


def resolve(requests: DataFrame, packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the pack columns the stages need, and requests of unknown packs."""
    renamed = packs.select(
        "id",
        "schema_version",
        "pack_version",
        "pack_type",
        "default_language",
        F.col("languages").alias("pack_languages"),
        F.col("formats").alias("pack_formats"),
        F.col("page_count").alias("pack_page_count"),
        "image_size",
        F.to_json("packaging").alias("packaging"),
    )
    return join_requests_packs(requests, renamed)


def _result(df: DataFrame, doc: Column, error: Column | None = None, cost: Column | None = None) -> DataFrame:
    return df.select(
        "product_id",
        doc.alias("doc"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
        (F.lit(0.0) if cost is None else F.coalesce(cost, F.lit(0.0))).alias("cost"),
    )


def _asked(run: Run, stage: str, rows: DataFrame, parse: Callable[[DataFrame], DataFrame], columns: Sequence[str]):
    """Prompts through the provider with one repair round; replies, failures and cost joined to the rows."""
    prompts = L.render_prompts(rows, stage).select("product_id", "system", "user")
    accepted, failed, cost = L.retry_parse(prompts, run.complete, parse, run.path("attempts", stage, f"run={run.number}"))
    return (
        rows.join(accepted.select("product_id", *columns), "product_id", "left")
        .join(failed.withColumnRenamed("error", "reply_error"), "product_id", "left")
        .join(cost.withColumnRenamed("cost", "reply_cost"), "product_id", "left")
    )


def concept(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    asked = _asked(run, "concept", rows, L.parse_concept, ["pages", "titles", "subtitle", "description_hint"])
    typed = P.type_pages(asked)
    doc = F.struct(
        F.col("pack").alias("pack_id"), "pack_version", "theme", "pages", "titles", "subtitle", "description_hint"
    )
    return _result(typed, doc, F.coalesce("reply_error", "page_error"), F.col("reply_cost"))


def _assets_table(rows: DataFrame) -> DataFrame:
    """Assets of ``doc.assets`` as rows with their paths."""
    listed = rows.select("product_id", F.posexplode("doc.assets").alias("pos", "asset"))
    return D.asset_paths(listed.select("product_id", "pos", "asset.*"))


def assets(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    planned = rows.join(inputs["concept"], "product_id").select(
        "product_id",
        F.struct(
            F.transform("concept.pages", lambda p: P.asset_of(p["id"], p["prompt"], F.col("image_size"))).alias("assets")
        ).alias("doc"),
    )
    files = stored(run.spark, run.path("files"), FILES)
    wanted = _assets_table(planned).withColumn("path", F.col("asset_path"))
    rest = [c for c in wanted.columns if c not in ("product_id", "path")]
    pending = I.pending_files(wanted, files, keys=("product_id",))
    # A page id that a reply repeats is drawn once, by its first page.
    todo = pending.groupBy("product_id", "path").agg(F.min_by(F.struct(*rest), F.col("pos")).alias("_first"))
    todo = todo.select("product_id", "path", "_first.*").select(*wanted.columns)
    drawn = settle(run.draw(todo), run.path("drawn", f"run={run.number}"))
    good = drawn.filter(F.col("call_error").isNull())
    settle(_kept(run, good), run.path("files"), mode="append")
    broken = drawn.filter(F.col("call_error").isNotNull()).groupBy("product_id").agg(F.min("call_error").alias("error"))
    return _result(planned.join(broken, "product_id", "left"), F.col("doc"), F.col("error"))


def _kept(run: Run, images: DataFrame) -> DataFrame:
    """(product_id, path, length, uri) of images: written as files, or left as rows of their table."""
    if run.decode:
        return images.select("product_id", "path", F.octet_length("content").cast("bigint").alias("length"), F.lit(None).cast("string").alias("uri"))
    return S.write_files(images, run.path("images", f"run={run.number}"))


def _cleaned(run: Run, todo: DataFrame) -> DataFrame | None:
    """The cleaned images of (product_id, asset_path, path, uri); None if none is there."""
    if run.decode:
        drawn = stored(run.spark, run.path("drawn"))
        if drawn is None:
            return None
        # The list is settled on paths alone; bytes meet it last and only once.
        bytes_ = drawn.filter(F.col("content").isNotNull()).select("product_id", F.col("path").alias("asset_path"), "content")
        cleaned = G.clean_images(bytes_.join(todo.select("product_id", "asset_path", "path"), ["product_id", "asset_path"]), run.decode)
        return cleaned.filter(F.col("error").isNull())
    pixels = _pending_pixels(run, todo)
    return None if pixels is None else G.binarize_images(pixels, orientation="orientation")


RUN_FOLDER = r"^(.*/run=\d+)/"


def _pixels(run: Run, folders: list[str]) -> DataFrame:
    """Decoded images of whole run folders, with their orientation, product and file path read off their location."""
    inside = F.regexp_replace("uri", RUN_FOLDER, "")
    places = [f"{folder}/*/assets" for folder in folders]
    found = S.read_images(run.spark, places).join(S.read_orientations(run.spark, places), "path", "left")
    return found.withColumnRenamed("path", "uri").withColumns(
        {
            "product_id": F.substring_index(inside, "/", 1),
            "path": F.concat(F.lit("processed/"), F.substring_index(inside, "/", -1)),
        }
    ).drop("uri")


def _pending_pixels(run: Run, todo: DataFrame) -> DataFrame | None:
    """Pixels of the pending images: the folders of the runs that drew them, less what is cleaned already.

    What comes to the driver is one folder per run that has something pending.
    """
    folders = [r.folder for r in todo.select(F.regexp_extract("uri", RUN_FOLDER, 1).alias("folder")).distinct().collect() if r.folder]
    if not folders:
        return None
    return _pixels(run, folders).join(todo.select("product_id", "path"), ["product_id", "path"], "left_semi")


def postprocess(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    planned = rows.select("product_id").join(inputs["assets"], "product_id").withColumnRenamed("assets", "doc")
    files = stored(run.spark, run.path("files"), FILES)
    wanted = _assets_table(planned).select("product_id", "asset_path", F.col("processed_path").alias("path")).distinct()
    pending = I.pending_files(wanted, files, keys=("product_id",))
    located = files.select("product_id", F.col("path").alias("asset_path"), "uri")
    todo = settle(pending.join(located, ["product_id", "asset_path"], "left"), run.path("todo", f"run={run.number}"))
    cleaned = _cleaned(run, todo)
    if cleaned is None:
        cleaned_paths = todo.select("product_id", "path").filter(F.lit(False))
    else:
        cleaned = settle(cleaned, run.path("cleaned", f"run={run.number}"))
        settle(_kept(run, cleaned), run.path("files"), mode="append")
        cleaned_paths = cleaned.select("product_id", "path")
    lost = todo.join(cleaned_paths, ["product_id", "path"], "left_anti")
    error = lost.groupBy("product_id").agg(F.min(F.concat(F.lit("cannot clean image: "), "asset_path")).alias("error"))
    return _result(planned.join(error, "product_id", "left"), F.col("doc"), F.col("error"))


def package(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """Deliverables with the bytes of their images, page geometry, cover texts and number of members.

    Covers are drawn elsewhere and have no size yet.
    """
    shops = {kind: F.col(f"pack_formats.{kind}.marketplaces") for kind in D.OUTPUTS}
    listed = D.deliverables_of(shops, F.col("formats"), F.col("languages"), F.col("pack"), F.col("theme"))
    told = D.resolve_page_size(rows.join(inputs["concept"], "product_id").withColumn("packaging", F.try_parse_json("packaging")))
    geometry = {
        kind: F.struct(
            F.col(f"{kind}_page_size").alias("page_size"),
            F.col(f"{kind}_bleed").cast("double").alias("bleed"),
            *[c.alias(n) for n, c in D.geometry_of(F.col(f"{kind}_page_size"), F.col(f"{kind}_bleed").cast("double")).items()],
        )
        for kind in D.OUTPUTS
    }
    covers = D.covers_of(F.col("concept.titles"), F.col("languages"), F.col("theme"), F.col("concept.subtitle"), F.col("print_page_size"))
    made = told.select(
        "product_id", listed.alias("listed"), F.struct(*[g.alias(k) for k, g in geometry.items()]).alias("geometry"), covers.alias("covers"), "geometry_error"
    )
    now = _assets_table(rows.select("product_id").join(inputs["processed"], "product_id").withColumnRenamed("processed", "doc"))
    now = now.select("product_id", F.col("processed_path").alias("path")).distinct()
    files = stored(run.spark, run.path("files"), FILES).join(now, ["product_id", "path"], "left_semi")
    total = files.groupBy("product_id").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("members"))
    sized = made.join(total, "product_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "members")})
    packages = F.transform(
        "listed",
        lambda d: d.withField("file_size", F.when(d["kind"] == "cover", F.lit(0)).otherwise(F.col("total")).cast("bigint")),
    )
    return _result(sized, F.struct(packages.alias("packages"), "geometry", "covers", "members", "geometry_error"))


def listing(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    plans = rows.join(inputs["concept"], "product_id").select(
        *rows.columns, "concept.pages", "concept.titles", "concept.subtitle", "concept.description_hint"
    )
    typed = K.type_listings(_asked(run, "listing", plans, L.parse_listings, ["listings"]))
    made = settle(
        _result(typed, F.struct("listings"), F.coalesce("reply_error", "listing_error"), F.col("reply_cost")),
        run.path("listed", f"run={run.number}"),
    )
    S.write_listings(listing_rows(made.filter(F.col("error").isNull()).select("product_id", F.col("doc").alias("listings"))), run.path("listings", f"run={run.number}"))
    return made


def listing_rows(listings: DataFrame, doc: str = "listings") -> DataFrame:
    rows = listings.select("product_id", F.posexplode(f"{doc}.listings").alias("pos", "item"))
    return rows.select("product_id", "pos", "item.*")


def review(run: Run, rows: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """Verdict, scores and issues; the issues are a table of their own, too."""
    products = rows.select("product_id")
    joined = {name: products.join(df, "product_id") for name, df in inputs.items()}
    files = stored(run.spark, run.path("files"), FILES)
    assets_rows = _assets_table(joined["assets"].withColumnRenamed("assets", "doc")).withColumn("path", F.col("processed_path"))
    packages = joined["packages"].select("product_id", F.explode("packages.packages").alias("package"))
    pages = joined["concept"].select("product_id", F.explode("concept.pages").alias("page"))
    listings = listing_rows(joined["listings"])
    issues = settle(
        W.union_issues(
            W.check_assets(assets_rows, files, on=["product_id", "path"]),
            W.check_packages(products, packages),
            K.check_listings(listings),
        ),
        run.path("issues", f"run={run.number}"),
    )
    report = W.as_score_map(W.review_report(products, issues, pages, assets_rows, packages, listings))
    own = issues.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("criterion", "severity", "detail"))).alias("issues"))
    report = report.join(own, "product_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(own.schema["issues"].dataType)))
    return _result(report, F.struct("verdict", "scores", "errors", "warnings", "issues"))


STAGES: dict[str, Callable[[Run, DataFrame, dict[str, DataFrame]], DataFrame]] = {
    "concept": concept,
    "assets": assets,
    "postprocess": postprocess,
    "package": package,
    "listing": listing,
    "review": review,
}

#: Modules that a stage's result depends on, beside its own function.
PARTS = {
    "concept": (L, P, C),
    "assets": (L, P, D),
    "postprocess": (G, S),
    "package": (D,),
    "listing": (L, K, C),
    "review": (W, K, D),
}


def code_version(stage: str) -> str:
    """Hash of the code that makes a stage's result, so that changed code runs again."""
    sources = [inspect.getsource(part) for part in (STAGES[stage], *PARTS[stage])]
    return hashlib.sha256("\n".join(sources).encode()).hexdigest()


# Images are read by these stages without being declared inputs of them; the edge is explicit here.
HIDDEN_INPUTS = {"package": ["processed"], "review": ["processed"]}


def latest_issues(spark: SparkSession, workdir: str) -> DataFrame:
    """The issues of every product's last review: (product_id, criterion, severity, detail)."""
    issues = stored(spark, f"{workdir}/issues", "product_id string, criterion string, severity string, detail string, run int")
    reviews = stored(spark, f"{workdir}/out/{schemas.STAGE_OUTPUT['review']}", "product_id string, error string, run int")
    last = reviews.filter(F.col("error").isNull()).groupBy("product_id").agg(F.max("run").alias("run"))
    return issues.join(last, ["product_id", "run"], "left_semi").select("product_id", "criterion", "severity", "detail")


def node_table(spark: SparkSession, workdir: str) -> DataFrame:
    """The current record of every node; one whose output is gone is pending again and has no input hash."""
    records = S.read_node_state(spark, f"{workdir}/node_runs")
    held = None
    for stage, output in schemas.STAGE_OUTPUT.items():
        rows = stored(spark, f"{workdir}/out/{output}")
        if rows is not None:
            there = rows.filter(F.col("error").isNull()).select("product_id", F.lit(stage).alias("stage")).distinct()
            held = there if held is None else held.unionByName(there)
    if held is None:
        held = spark.createDataFrame([], "product_id string, stage string")
    joined = records.join(held.withColumn("_there", F.lit(True)), ["product_id", "stage"], "left")
    gone = (F.col("status") == "done") & F.col("_there").isNull()
    return joined.withColumns(
        {"status": F.when(gone, "pending").otherwise(F.col("status")), "input_hash": F.when(gone, "").otherwise(F.col("input_hash"))}
    ).drop("_there")


def produce(
    spark: SparkSession,
    products: DataFrame,
    workdir: str,
    runtime: dict[str, dict[str, str]],
    complete: Callable[[DataFrame], DataFrame] = L.placeholder_completion,
    draw: Callable[[DataFrame], DataFrame] = L.placeholder_images,
    run_number: int | None = None,
    stages: Sequence[str] = tuple(schemas.STAGES),
    guard: bool = False,
    snapshot_every: int = 16,
    decode: Callable[[bytes], tuple[int, int, int, bytes]] | None = None,
) -> DataFrame:
    """Run or resume the stages for resolved products; returns the decision of every node.

    With ``guard`` only products that are not in the working directory yet are produced, and those
    whose column ``force`` says so; the others are left as they are.

    A product that fails in a stage is logged as failed and left out of the later ones; the others
    go on. Running again with nothing changed skips every node. After ``snapshot_every`` runs the run log
    so far is folded into a snapshot, and later runs read that and what came after it.

    With ``decode`` (see ``images.clean_images``) images stay rows of the tables ``drawn`` and ``cleaned``;
    without it they are files that Spark's image source decodes.
    """
    log_path = f"{workdir}/node_runs"
    if guard:
        known = stored(spark, f"{workdir}/products", "product_id string").select("product_id")
        products, _ = guard_new_products(products, known, force="force" if "force" in products.columns else None)
        products = products.drop("force")
    upto = S.last_snapshot(spark, log_path)
    if run_number is None:
        log = stored(spark, log_path, schemas.NODE_RUNS)
        run_number = (log.agg(F.max("run")).first()[0] or 0) + 1
        if run_number - 1 - upto >= snapshot_every:
            S.write_snapshot(spark, log_path, run_number - 1)
    elif run_number <= upto:
        raise ValueError(f"run {run_number} is closed: runs up to {upto} are in a snapshot")
    run = Run(spark, workdir, run_number, runtime, complete, draw, decode)
    settings = [F.lit(v).alias(f"rt_{kind}_{name}") for kind, conf in runtime.items() for name, v in sorted(conf.items())]
    configured = products.select("*", *settings)
    names = [c for c in configured.columns if c.startswith("rt_")]
    everyone = settle(
        V.config_hash(configured, PROFILE, REQUEST, names).drop(*names), run.path("products", f"run={run.number}")
    )
    decisions = None
    for stage in stages:
        logged = stored(spark, log_path, schemas.NODE_RUNS)
        failed = logged.filter((F.col("run") == run.number) & (F.col("status") == "failed")).select("product_id")
        decided = run_stage(run, stage, everyone.join(failed, "product_id", "left_anti"), log_path)
        decisions = decided if decisions is None else decisions.unionByName(decided)
    return decisions


def resume(
    spark: SparkSession, workdir: str, packs: DataFrame, runtime: dict[str, dict[str, str]], product_ids: Sequence[str] | None = None, **options
) -> DataFrame:
    """Run known products again from their stored requests; packs and runtime are read anew."""
    known = spark.read.parquet(f"{workdir}/products")
    if product_ids is not None:
        known = known.filter(F.col("product_id").isin(*product_ids))
    last = known.groupBy("product_id").agg(F.max("run").alias("run"))
    requests = known.join(last, ["product_id", "run"], "left_semi").select("product_id", *REQUEST)
    products, _ = resolve(requests, packs)
    return produce(spark, products, workdir, runtime, **options)


def run_stage(run: Run, stage: str, alive: DataFrame, log_path: str) -> DataFrame:
    """Bind, compare, run and log one stage; returns its decisions."""
    spark, output = run.spark, schemas.STAGE_OUTPUT[stage]
    declared = [*schemas.STAGE_INPUTS[stage], *HIDDEN_INPUTS.get(stage, [])]
    held = {name: df for name in declared if (df := current(run, name, "content_hash")) is not None}
    hashes = None
    for name, df in held.items():
        part = df.select("product_id", F.lit(name).alias("name"), "content_hash")
        hashes = part if hashes is None else hashes.unionByName(part)
    if hashes is None:
        hashes = spark.createDataFrame([], "product_id string, name string, content_hash string")
    bound, missing = I.bind_stage_inputs(alive, hashes, declared)
    unbound = missing.select(
        "product_id",
        F.lit(stage).alias("stage"),
        F.lit(run.number).alias("run"),
        F.lit("failed").alias("status"),
        F.lit("").alias("input_hash"),
        F.lit("").alias("output_path"),
        F.lit(0.0).alias("cost"),
        "error",
        F.lit(False).alias("started"),
        run.created_at.alias("ts"),
    )
    if len(held) < len(declared):  # some input was never produced for anyone
        S.write_run_state(unbound, log_path)
        return spark.createDataFrame([], "product_id string, stage string, decision string")
    keyed = I.node_hash(bound, declared, code_version(stage), PROMPT_VERSIONS[stage])

    log = stored(spark, log_path, schemas.NODE_RUNS).filter(F.col("stage") == stage)
    state = I.node_records(S.read_run_log_state(spark, log_path, log)).filter(F.col("stage") == stage)
    existing = current(run, output)
    present = (
        keyed.select("product_id").filter(F.lit(False)) if existing is None else existing.select("product_id")
    ).select("product_id", F.lit(stage).alias("stage"), F.lit(True).alias("outputs_ok"))
    nodes = keyed.withColumn("stage", F.lit(stage))
    plan = settle(I.plan_incremental(nodes, state, present), run.path("plan", stage, f"run={run.number}"))

    decisions = plan.select("product_id", "stage", "decision")
    todo = plan.filter(F.col("decision") == "run")
    if todo.isEmpty():
        S.write_run_state(unbound, log_path)
        return decisions
    inputs = {name: current(run, name, "doc").withColumnRenamed("doc", name) for name in declared}
    made = STAGES[stage](run, todo, inputs).join(todo.select("product_id", "input_hash", "config_hash"), "product_id")
    using = run.runtime["image" if stage == "assets" else "llm"]
    enveloped = made.select(
        "*",
        F.lit(1).alias("schema_version"),
        record_hash(made, ["doc"]).alias("content_hash"),
        V.provenance(
            F.col("input_hash"),
            F.col("config_hash"),
            F.lit(using.get("model", "")),
            F.lit(using["provider"]),
            F.lit(PROMPT_VERSIONS[stage]),
            run.created_at,
        ).alias("provenance"),
    )
    done = settle(enveloped, run.out(output))

    ran = done.select(
        "product_id",
        F.lit(stage).alias("stage"),
        F.lit(run.number).alias("run"),
        F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"),
        "input_hash",
        D.artifact_path(F.lit(output)).alias("output_path"),
        "cost",
        F.coalesce("error", F.lit("")).alias("error"),
        F.lit(True).alias("started"),
        F.col("provenance.created_at").alias("ts"),
    )
    S.write_run_state(ran.unionByName(unbound), log_path)
    return decisions
