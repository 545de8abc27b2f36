"""One query per operator over its whole table, and the SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import best_fit, byte_bpe, chat_format, embedding_dedup, jaccard_join, line_dedup, merkle, nearest, packing, suffix_dedup, token_counts, toxicity, whitening
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_examples(turns.unionByName(more)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.train_rows)
    return toxicity.scored(docs, lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted().alias("predicted"), "n_hits"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents")).drop("text_key")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.folded(merkle.manifest(docs, claimed=F.when(touched, merkle.leaf_digest(changed))))
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return found.select("doc_id", *digests, "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_chat_format, op3_line_dedup, op4_embedding_dedup, op5_toxicity,
        op6_byte_bpe, op7_nearest, op8_token_counts, op9_packing, op10_jaccard_join,
        op11_whitening, op12_best_fit, op13_merkle_manifest,
    )
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '</turn>', '\e'), '###', '\h')"
# A header, an escaped text and an end mark per turn.
_WRITTEN = (
    "'### ' || replace(" + _ESCAPED.format("role") + r", chr(10), '\n') || ':' || chr(10) || " + _ESCAPED.format("text") + " || '</turn>' || chr(10)"
)

_CHAT_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
numbered as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
         sum(length({_WRITTEN})) over w as upto
  from turns window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(case when role = 'assistant' or pos = n then upto else 0 end) as bigint) as formatted_chars
from numbered group by conv_id"""

_SUFFIX_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, unnest(list_transform(range(1, greatest(1, length(h) // 2 - 98)),
                                       lambda p: struct_pack(p := p, w := md5_number(substr(h, 2 * p - 1, 200))))) as s from d),
named as (select doc_id, s.p as p, row_number() over (partition by s.w order by doc_id, s.p) as k from windows),
spans as (select doc_id, p, max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as q
          from named where k > 1),
grouped as (select doc_id, p, sum(case when q is null or p > q + 100 then 1 else 0 end) over (partition by doc_id order by p) as g from spans),
runs as (select doc_id, g, min(p) as a, max(p) + 100 as b from grouped group by doc_id, g),
cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 1) as kept_from from runs),
pieces as (
  select c.doc_id, c.kept_from as s, c.a as e, c.b - c.a as gone from cuts c
  union all
  select d.doc_id, coalesce(max(r.b), 1), length(any_value(d.h)) // 2 + 1, 0 from d left join runs r using (doc_id) group by d.doc_id)
select d.doc_id, length(any_value(d.h)) // 2 as n_bytes, cast(sum(gone) as bigint) as n_removed,
       count(*) filter (where gone > 0) as n_spans,
       sha256(unhex(string_agg(substr(h, 2 * s - 1, 2 * (e - s)), '' order by s))) as kept_sha256
from d join pieces using (doc_id) group by d.doc_id"""

_COMPONENTS_SQL = """
reach as (
  select id as a, id as b from nodes
  union
  select reach.a, edges.b from reach join edges on reach.b = edges.a)"""

_EMBEDDING_SQL = f"""
with recursive v as (
  select vec_id as id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (
  select x.id as a, y.id as b from v x join v y on x.id <> y.id
  where list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.9),
nodes as (select vec_id as id from embeddings),
{_COMPONENTS_SQL}
select id as vec_id, (select count(*) from edges where a = id) as n_links, min(b) as component_id, min(b) = id as kept
from nodes join reach on nodes.id = reach.a group by id"""

_NEAREST_SQL = """
with v as (
  select vec_id as id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.id as query_id, c.id as vec_id,
         list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) as score
  from v q join v c on q.id <> c.id where q.id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5"""

_JACCARD_SQL = f"""
with recursive w as (
  select doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') as words from documents),
sets as (
  select id, case when len(words) = 0 then []
                  when len(words) < 5 then [list_aggregate(words, 'string_agg', ' ')]
                  else list_sort(list_distinct([list_aggregate(words[i:i + 4], 'string_agg', ' ') for i in range(1, len(words) - 3)])) end as s
  from w),
classes as (select min(id) as id, s, count(*) as copies from sets group by s),
grams as (select id, len(s) as n, unnest(s) as g from classes),
linked as (
  select x.id as a, y.id as b from grams x join grams y on x.g = y.g and x.id <> y.id
  group by x.id, y.id having count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*))),
edges as (select a, b from linked),
nodes as (select id from classes),
{_COMPONENTS_SQL},
lowest as (select a as id, min(b) as component_id from reach group by a),
counts as (select linked.a as id, sum(classes.copies) as links from linked join classes on classes.id = linked.b group by linked.a)
select sets.id as doc_id, classes.id as class_id, cast(classes.copies - 1 + coalesce(links, 0) as bigint) as n_links,
       component_id, sets.id = component_id as kept
from sets join classes using (s) join lowest on lowest.id = classes.id left join counts on counts.id = classes.id"""

#: CRC-32 of a text's bytes, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end))))"""


def _merkle_sql(group_levels: int = 14, top_levels: int = 6) -> str:
    """Levels are chained: a tree that has come down to one node passes through unchanged."""
    shown = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')".format
    leaf = lambda text: "sha256(" + " || ".join(map(shown, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    touched = _CRC32.format("doc_id::varchar") + " % 2 = 0"
    parts = [f"""
    d as (select row_number() over () as row, doc_id, coalesce('s' || source, 'n') as tree, {leaf("text")} as leaf,
                 case when {touched} then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as claimed from documents),
    f0 as materialized (select row, tree, leaf, row_number() over (partition by tree order by doc_id nulls first, leaf, row) - 1 as pos,
                 claimed as h, '' as proof from d),
    n0 as materialized (select tree, pos, leaf as h, count(*) over (partition by tree) as n from f0)"""]

    def level(k: int) -> None:
        parts.append(f"""
    r{k} as materialized (select tree, pos // 3 as run, list(h order by pos) as hs, any_value(n) as n from n{k} group by tree, pos // 3),
    n{k + 1} as materialized (select tree, run as pos, case when n = 1 then hs[1] else sha256(list_aggregate(hs, 'string_agg', '')) end as h, (n + 2) // 3 as n from r{k}),
    f{k + 1} as materialized (
      select f.row, f.tree, f.leaf, r.run as pos,
             case when r.n = 1 then f.h
                  else sha256(array_to_string(list_transform(r.hs, lambda x, i: case when i = f.pos % 3 + 1 then f.h else x end), '')) end as h,
             f.proof || case when r.n = 1 then '' else array_to_string(list_filter(r.hs, lambda x, i: i <> f.pos % 3 + 1), '') end as proof
      from f{k} f join r{k} r on r.tree = f.tree and r.run = f.pos // 3)""")

    for k in range(group_levels):
        level(k)
    g, t = group_levels, group_levels + 1
    parts.append(f"""
    sub as materialized (select tree, h as subroot, row_number() over (order by encode(tree)) - 1 as no from n{g}),
    n{t} as materialized (select 'top' as tree, no as pos, subroot as h, count(*) over () as n from sub),
    f{t} as materialized (select f.row, 'top' as tree, f.leaf, sub.no as pos, f.h, f.proof from f{g} f join sub on sub.tree = f.tree)""")
    for k in range(t, t + top_levels):
        level(k)
    last = t + top_levels
    return "with" + ",".join(parts) + f"""
    select d.doc_id, d.leaf, sub.subroot, top.h as root, sha256(f.proof) as proof_sha256, f.h as folded_root, f.h = top.h as verified
    from f{last} f join d on d.row = f.row join sub on sub.tree = d.tree cross join n{last} top"""


SQL = {
    "op1_suffix_dedup": _SUFFIX_SQL,
    "op2_chat_format": _CHAT_SQL,
    "op4_embedding_dedup": _EMBEDDING_SQL,
    "op7_nearest": _NEAREST_SQL,
    "op10_jaccard_join": _JACCARD_SQL,
    "op13_merkle_manifest": _merkle_sql(),
}
