"""Run state, hashing, incremental decisions, reports and the quality gate on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import DIGITS, LANES, content_hash, files_digest as digest, ordered_digest, record_hash as hash_of
from ..operators import incremental as I
from ..operators import provenance as V
from ..operators import reports as T
from ..operators import review as W
from .base import (
    EVENT_RUNS_SQL,
    NODE_STATE_SQL,
    STAGE_ORD_SQL,
    STAMP_SQL,
    Query,
    event_runs,
    money,
    stamp,
    table,
)
from .product_queries import LISTING_ISSUES_SQL


def cost_summary(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "value")
    out = T.cost_summary(events, "user_id", "event_type", "value")
    return out.withColumn("cost", F.round("cost", 2))


COST_SUMMARY = """
select user_id as product_id, event_type as stage, round(sum(value), 2) as cost,
  cast(grouping(user_id, event_type) as integer) as level
from events group by rollup (user_id, event_type)"""


def cumulative_cost(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    out = I.cumulative_cost(events, ["user_id", "event_type"], ["ts", "event_id"], "value")
    return out.select("event_id", "user_id", "event_type", F.round("running_cost", 2).alias("running_cost"))


CUMULATIVE_COST = """
select event_id, user_id, event_type,
  round(sum(value) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding), 2) as running_cost
from events"""


def node_costs(spark, d):
    return I.node_costs(event_runs(spark, d)).select(
        "product_id", "stage", F.round("cost", 2).alias("cost"), F.round("cost_with_failed", 2).alias("cost_with_failed")
    )


NODE_COSTS = f"""
with {EVENT_RUNS_SQL}
select product_id, stage, round(coalesce(sum(cost) filter (where status = 'done'), 0), 2) as cost,
  round(sum(cost), 2) as cost_with_failed from runs group by product_id, stage"""


def node_timestamps(spark, d):
    out = I.node_timestamps(event_runs(spark, d))
    return out.select("product_id", "stage", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"))


NODE_TIMESTAMPS = f"""
with {EVENT_RUNS_SQL}
select product_id, stage, strftime(min(ts), {STAMP_SQL}) as created_at, strftime(max(ts), {STAMP_SQL}) as updated_at
from runs group by product_id, stage"""


def node_state(spark, d):
    out = I.fold_node_runs(event_runs(spark, d))
    return out.withColumns(
        {"cost": F.round("cost", 2), "created_at": stamp("created_at"), "updated_at": stamp("updated_at")}
    )


NODE_STATE = f"""
with {NODE_STATE_SQL}
select product_id, stage, status, input_hash, output_path, round(cost, 2) as cost, error,
  strftime(created_at, {STAMP_SQL}) as created_at, strftime(updated_at, {STAMP_SQL}) as updated_at from state"""


def node_state_resumed(spark, d):
    """The run log in two parts, as a snapshot holds the first and a resumed run reads the second."""
    runs = event_runs(spark, d)
    early = F.col("run") % 3 != 0
    state = I.merge_run_states(I.run_state(runs.filter(early)), I.run_state(runs.filter(~early)))
    return I.node_records(state).withColumns(
        {"cost": F.round("cost", 2), "created_at": stamp("created_at"), "updated_at": stamp("updated_at")}
    )


def _products(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_mktsegment").alias("pack"))


def latest_status(spark, d):
    return T.latest_status(_products(spark, d), I.fold_node_runs(event_runs(spark, d)))


LATEST_STATUS = f"""
with {NODE_STATE_SQL}, last as (select product_id, arg_max(status, {STAGE_ORD_SQL}) as status from state group by product_id)
select c_custkey as product_id, c_mktsegment as pack, coalesce(status, 'n/a') as status
from customer left join last on product_id = c_custkey"""


def status_table(spark, d):
    out = T.status_table(I.fold_node_runs(event_runs(spark, d)))
    return out.withColumn("cost", F.round("cost", 2))


STATUS_TABLE = f"""
with {NODE_STATE_SQL}
select product_id, {STAGE_ORD_SQL} as stage_ord, stage, status, substr(input_hash, 1, 11) as short_hash, round(cost, 2) as cost
from state order by product_id, stage_ord"""


def list_products(spark, d):
    out = T.list_products(_products(spark, d), I.fold_node_runs(event_runs(spark, d)))
    return out.withColumn("cost", F.round("cost", 2))


LIST_PRODUCTS = f"""
with {NODE_STATE_SQL}, last as (
  select product_id, arg_max(status, {STAGE_ORD_SQL}) as status, sum(cost) as cost from state group by product_id)
select c_custkey as product_id, c_mktsegment as pack, coalesce(status, 'n/a') as status, round(coalesce(cost, 0), 2) as cost
from customer left join last on product_id = c_custkey order by 1"""


def total_cost(spark, d):
    return T.total_cost(I.fold_node_runs(event_runs(spark, d))).withColumn("cost", F.round("cost", 2))


TOTAL_COST = f"with {NODE_STATE_SQL} select round(sum(cost), 2) as cost from state"

LINE_NAMES = [f"line{i}" for i in range(1, 8)]


def _line_artifacts(spark, d):
    """Order lines as artifacts: order = product, line number = artifact name."""
    line = table(spark, d, "lineitem")
    text = F.concat_ws("|", "l_partkey", "l_suppkey", money("l_quantity"), money("l_extendedprice"), "l_returnflag")
    return line.select(
        F.col("l_orderkey").alias("product_id"),
        F.concat(F.lit("line"), "l_linenumber").alias("name"),
        content_hash(text).alias("content_hash"),
    )


LINE_ARTIFACTS_SQL = """a as (
  select l_orderkey as product_id, 'line' || l_linenumber as name,
    max(sha256(l_partkey || '|' || l_suppkey || '|' || cast(l_quantity as decimal(18,2)) || '|'
      || cast(l_extendedprice as decimal(18,2)) || '|' || l_returnflag)) as h
  from lineitem group by l_orderkey, l_linenumber)"""


def node_hash(spark, d):
    return I.combine_hashes(
        _line_artifacts(spark, d), ["product_id"], "name", "content_hash", LINE_NAMES, "code-1", "prompt-1", "config-1"
    )


NODE_HASH = f"""
with {LINE_ARTIFACTS_SQL}
select product_id, sha256('code-1|prompt-1|config-1|' || string_agg(h, '|' order by h)) as node_hash from a group by product_id"""


def record_hash(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("o_totalprice"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    fields = ["o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"]
    return orders.select("o_orderkey", hash_of(orders, fields).alias("record_hash"))


RECORD_SQL = """'"o_custkey":' || o_custkey || ',"o_orderpriority":'
  || case when o_orderpriority = '5-LOW' then 'null' else '"' || o_orderpriority || '"' end
  || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":"' || cast(o_totalprice as decimal(18,2)) || '"'"""

RECORD_HASH = f"select o_orderkey, sha256('{{' || {RECORD_SQL} || '}}') as record_hash from orders"


def config_hash(spark, d):
    """Orders as requests, their customer as pack profile, one literal runtime."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    packs = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    joined = orders.join(packs, "o_custkey").withColumn("a_model", F.lit("m1"))
    out = V.config_hash(joined, ["c_mktsegment", "o_custkey"], ["o_orderstatus"], ["a_model"], aux=["c_nationkey"])
    return out.select("o_orderkey", "config_hash")


CONFIG_HASH = """
select o_orderkey, sha256('{"a_model":"m1","c_mktsegment":"' || c_mktsegment || '","o_custkey":' || o_custkey
  || ',"o_orderstatus":"' || o_orderstatus || '"}') as config_hash
from orders join customer on o_custkey = c_custkey"""


def files_digest(spark, d):
    docs = table(spark, d, "documents").select(
        "source", F.concat_ws("/", "source", "doc_id").alias("path"), content_hash(F.col("text")).alias("sha")
    )
    return digest(docs, ["source"], "path", "sha")


_LANE_SUMS = ", ".join(f"cast(sum(('0x' || substr(h, {1 + DIGITS * i}, {DIGITS}))::bigint) as bigint) as l{i}" for i in range(LANES))
_LANE_TEXT = " || '|' || ".join(f"l{i}" for i in range(LANES))

FILES_DIGEST = f"""
with e as (select source, sha256(source || '/' || doc_id || '|' || sha256(text)) as h from documents),
s as (select source, count(*) as files, {_LANE_SUMS} from e group by source)
select source, files, sha256(files || '|' || {_LANE_TEXT}) as digest from s"""

def tree_digest(spark, d):
    docs = table(spark, d, "documents").select(
        "source", F.concat_ws("/", "source", "doc_id").alias("path"), content_hash(F.col("text")).alias("sha")
    )
    return ordered_digest(docs, ["source"], "path", "sha", fan=16)


def _tree_sql(levels: int = 8) -> str:
    """Runs of 16 are hashed until one is left; a source that is down to one passes through."""
    parts = [
        """e as (select source, path, sha256(path || '|' || sha256(text)) as h from (select source, source || '/' || doc_id as path, text from documents)),
f as (select source, count(*) as files from e group by source),
n0 as (select source, row_number() over (partition by source order by encode(path)) - 1 as pos, h from e)"""
    ]
    for k in range(levels):
        parts.append(f"""m{k} as materialized (select *, count(*) over (partition by source) as n from n{k}),
n{k + 1} as materialized (select source, pos // 16 as pos, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '|' order by pos)) end as h from m{k} group by source, pos // 16)""")
    return "with " + ",\n".join(parts) + f"\nselect source, files, h as digest from n{levels} join f using (source)"


TREE_DIGEST = _tree_sql()

DECLARED = ["line1", "line2"]


def bind_stage_inputs(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_orderstatus").alias("config_hash"))
    keyed = I.node_hash(I.mark_inputs(orders, _line_artifacts(spark, d), DECLARED), DECLARED, "code-1", "prompt-1")
    return keyed.select(
        "product_id",
        F.when(F.col("error").isNull(), F.col("input_hash")).otherwise("").alias("input_hash"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


BIND_STAGE_INPUTS = f"""
with {LINE_ARTIFACTS_SQL},
p as (select o_orderkey as product_id, o_orderstatus,
    (select h from a where a.product_id = o_orderkey and name = 'line1') as h1,
    (select h from a where a.product_id = o_orderkey and name = 'line2') as h2 from orders)
select product_id,
  case when h1 is null or h2 is null then '' else sha256('code-1|prompt-1|' || o_orderstatus || '|' || least(h1, h2) || '|' || greatest(h1, h2)) end as input_hash,
  case when h1 is null then 'missing input artifact: line1' when h2 is null then 'missing input artifact: line2' else '' end as error
from p"""


def _line_outputs(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("product_id"), F.lit("package").alias("stage"), F.col("l_linenumber").alias("output")
    )


def outputs_complete(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.lit("package").alias("stage"))
    return I.outputs_complete(nodes, _line_outputs(spark, d), ["product_id", "stage"], "output", [1, 2])


OUTPUTS_COMPLETE_SQL = """o as (
  select o_orderkey as product_id, 'package' as stage,
    exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 1)
      and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 2) as outputs_ok
  from orders)"""

OUTPUTS_COMPLETE = f"with {OUTPUTS_COMPLETE_SQL} select * from o"


def plan_incremental(spark, d):
    """Orders as nodes: priority, status and price decide what the earlier state looked like."""
    orders = table(spark, d, "orders")
    key = content_hash(F.col("o_orderkey").cast("string"))
    candidates = orders.select(F.col("o_orderkey").alias("product_id"), F.lit("package").alias("stage"), key.alias("input_hash"))
    state = orders.filter(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").alias("product_id"),
        F.lit("package").alias("stage"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("status"),
        F.when(F.col("o_totalprice") > 300000, F.lit("old")).otherwise(key).alias("input_hash"),
    )
    outputs = I.outputs_held(_line_outputs(spark, d), ["product_id", "stage"], "output", [1, 2])
    return I.plan_incremental(candidates, state, outputs).select("product_id", "stage", "decision")


PLAN_INCREMENTAL = f"""
with {OUTPUTS_COMPLETE_SQL}
select o_orderkey as product_id, 'package' as stage,
  case when o_orderpriority = '1-URGENT' then 'run' when o_orderstatus = 'P' then 'run' when o_totalprice > 300000 then 'run'
    when not outputs_ok then 'run' else 'skip' end as decision
from orders join o on o.product_id = o_orderkey"""


def pending_files(spark, d):
    wanted = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("assets/"), "doc_id", F.lit(".png")).alias("path"), content_hash(F.col("text")).alias("prompt_hash")
    )
    done = table(spark, d, "labels").select(F.concat(F.lit("assets/"), "doc_id", F.lit(".png")).alias("path"))
    return I.pending_files(wanted, done)


PENDING_FILES = """
select doc_id, 'assets/' || doc_id || '.png' as path, sha256(text) as prompt_hash
from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)"""


def _asset_issues(spark, d, keys=("source",)):
    assets = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("processed/"), "doc_id", F.lit(".png")).alias("path"))
    stats = table(spark, d, "labels").select("doc_id", (F.col("quality") * 700 + F.col("toxic") * 900).alias("length"))
    return W.check_assets(assets, stats, keys, on=["doc_id"])


ASSET_ISSUES_SQL = """asset_issues as (
  select d.doc_id, source, case when l.doc_id is null then 'asset_existence' else 'asset_size' end as criterion,
    case when l.doc_id is null then 'error' else 'warning' end as severity,
    case when l.doc_id is null then 'missing processed asset: ' else 'asset suspiciously small (<1KB): ' end
      || 'processed/' || d.doc_id || '.png' as detail
  from documents d left join labels l on d.doc_id = l.doc_id
  where l.doc_id is null or quality * 700 + toxic * 900 < 1000)"""


def check_assets(spark, d):
    return _asset_issues(spark, d)


CHECK_ASSETS = f"with {ASSET_ISSUES_SQL} select * exclude (doc_id) from asset_issues"


def check_packages(spark, d):
    packages = table(spark, d, "orders").select((2 * F.col("o_custkey")).alias("product_id"))  # doubled keys leave gaps
    return W.check_packages(_products(spark, d), packages)


CHECK_PACKAGES = """
select c_custkey as product_id, 'packages' as criterion, 'error' as severity, 'no packages produced' as detail
from customer where not exists (select 1 from orders where 2 * o_custkey = c_custkey)"""


def _review_items(spark, d):
    """Each document as a product: its lines are pages and listings, its label a package, itself an asset."""
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") * 700 + F.col("toxic") * 900).alias("length"))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(labels, "doc_id", "left")
    lines = F.split("text", "\n")

    def listing(line):
        words = F.filter(F.split(line, " "), lambda w: F.length(w) > 2)
        title = F.when(F.size(words) < 2, "").otherwise(line)
        return F.struct(F.col("source").alias("marketplace"), F.col("lang").alias("language"), title.alias("title"), words.alias("tags"))

    asset = F.struct(F.concat(F.lit("processed/"), "doc_id", F.lit(".png")).alias("path"), "length")
    return W.review_items(
        docs,
        ["doc_id"],
        pages=F.size(F.filter(lines, lambda x: x != "")),
        assets=F.array(asset),
        packages=F.col("length").isNotNull().cast("int"),
        listings=F.transform(lines, listing),
    )


REVIEW_SQL = f"""{ASSET_ISSUES_SQL}, {LISTING_ISSUES_SQL},
pk as (select doc_id from labels),
issues as (
  select doc_id, criterion, severity, detail from asset_issues
  union all
  select doc_id, 'packages', 'error', 'no packages produced' from documents where doc_id not in (select doc_id from pk)
  union all
  select doc_id, criterion, severity, detail from listing_issues)"""


def union_issues(spark, d):
    return W.issues_of(_review_items(spark, d))


UNION_ISSUES = f"with {REVIEW_SQL} select * from issues"


def review_verdict(spark, d):
    return W.report_of(_review_items(spark, d), "doc_id").select("doc_id", "verdict")


REVIEW_VERDICT = f"""
with {REVIEW_SQL}
select d.doc_id, case when coalesce(bool_or(i.severity = 'error'), false) then 'fail' else 'pass' end as verdict
from documents d left join issues i on i.doc_id = d.doc_id group by d.doc_id"""


def review_scores(spark, d):
    return W.report_of(_review_items(spark, d), "doc_id").select("doc_id", *W.SCORES)


SCORES_SQL = """cast((select count(*) from lines x where x.doc_id = d.doc_id and line <> '') as double) as concept_pages,
  cast(1 as double) as assets_generated,
  cast((select count(*) from pk x where x.doc_id = d.doc_id) as double) as packages_built,
  cast((select count(*) from lines x where x.doc_id = d.doc_id) as double) as listings_count"""

REVIEW_SCORES = f"with {REVIEW_SQL} select d.doc_id, {SCORES_SQL} from documents d"


def review_report(spark, d):
    return W.report_of(_review_items(spark, d), "doc_id")


REVIEW_REPORT = f"""
with {REVIEW_SQL}
select d.doc_id, case when exists (select 1 from issues i where i.doc_id = d.doc_id and severity = 'error') then 'fail' else 'pass' end as verdict,
  {SCORES_SQL},
  (select count(*) from issues i where i.doc_id = d.doc_id and severity = 'error') as errors,
  (select count(*) from issues i where i.doc_id = d.doc_id and severity = 'warning') as warnings
from documents d"""

RUNTIME = {"llm": {"provider": "local", "model": "m1"}, "image": {"provider": "painter", "model": "m2"}}


def wrap_provenance(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("product_id"), "text", content_hash(F.col("text")).alias("input_hash"), F.col("source").alias("config_hash")
    )
    versions = {stage: f"{stage}-v1" for stage in ("concept", "assets", "postprocess")}
    wrapped = V.wrap_stages(docs, versions, F.col("text"), RUNTIME, F.lit("2024-01-01T00:00:00"))
    return wrapped.select("product_id", "name", "schema_version", F.length("artifact").alias("size"), "provenance.*")


WRAP_PROVENANCE = """
with s(name, model, provider, prompt_version) as (values ('concept', 'm1', 'local', 'concept-v1'),
  ('assets', 'm2', 'painter', 'assets-v1'), ('processed', 'm1', 'local', 'postprocess-v1'))
select doc_id as product_id, name, 1 as schema_version, cast(length(text) as integer) as size, sha256(text) as input_hash, source as config_hash,
  model, provider, prompt_version, '2024-01-01T00:00:00' as created_at
from documents cross join s"""


QUERIES = {
    "cost_summary": Query(cost_summary, COST_SUMMARY),
    "cumulative_cost": Query(cumulative_cost, CUMULATIVE_COST),
    "node_costs": Query(node_costs, NODE_COSTS),
    "node_timestamps": Query(node_timestamps, NODE_TIMESTAMPS),
    "node_state": Query(node_state, NODE_STATE),
    "node_state_resumed": Query(node_state_resumed, NODE_STATE),
    "tree_digest": Query(tree_digest, TREE_DIGEST),
    "latest_status": Query(latest_status, LATEST_STATUS),
    "status_table": Query(status_table, STATUS_TABLE),
    "list_products": Query(list_products, LIST_PRODUCTS),
    "total_cost": Query(total_cost, TOTAL_COST),
    "node_hash": Query(node_hash, NODE_HASH),
    "record_hash": Query(record_hash, RECORD_HASH),
    "config_hash": Query(config_hash, CONFIG_HASH),
    "files_digest": Query(files_digest, FILES_DIGEST),
    "bind_stage_inputs": Query(bind_stage_inputs, BIND_STAGE_INPUTS),
    "outputs_complete": Query(outputs_complete, OUTPUTS_COMPLETE),
    "plan_incremental": Query(plan_incremental, PLAN_INCREMENTAL),
    "pending_files": Query(pending_files, PENDING_FILES),
    "check_assets": Query(check_assets, CHECK_ASSETS),
    "check_packages": Query(check_packages, CHECK_PACKAGES),
    "union_issues": Query(union_issues, UNION_ISSUES),
    "review_verdict": Query(review_verdict, REVIEW_VERDICT),
    "review_scores": Query(review_scores, REVIEW_SCORES),
    "review_report": Query(review_report, REVIEW_REPORT),
    "wrap_provenance": Query(wrap_provenance, WRAP_PROVENANCE),
}
