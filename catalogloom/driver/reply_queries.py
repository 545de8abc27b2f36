"""Model replies, policy scan and pixels on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.text import fold_case, strip_json_fence as strip_fence
from ..operators import completions as L
from ..operators import images as G
from ..operators import policy as S
from ..operators import products as P
from ..operators.incremental import pending_files
from ..session import shared_folder
from .base import Query, table


def strip_json_fence(spark, d):
    role = F.col("role")
    wrapped = (
        F.when(role == "assistant", F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(role == "system", F.concat(F.lit("x ```"), "text", F.lit(" ``` y ```z```")))
        .otherwise(F.concat(F.lit(" \n"), "text", F.lit("\n ")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", strip_fence(wrapped).alias("body"))


STRIP_JSON_FENCE = r"""
with w as (select conv_id, turn, case role when 'assistant' then '```json' || chr(10) || text || chr(10) || '```'
    when 'system' then 'x ```' || text || ' ``` y ```z```' else text end as t from conversations)
select conv_id, turn, regexp_replace(case when regexp_matches(t, '(?s)```(?:json)?\s*(.*?)\s*```')
    then regexp_extract(t, '(?s)```(?:json)?\s*(.*?)\s*```', 1) else t end, '^\s+|\s+$', '', 'g') as body
from w"""


def parse_structured(spark, d):
    """Concept replies around each event: sound, wrongly typed, cut short, and with trailing text."""
    kind = F.col("event_type")
    subtitle = F.when(kind == "click", F.get_json_object("props", "$.k")).otherwise(
        F.concat(F.lit('"k'), F.get_json_object("props", "$.k"), F.lit('"'))
    )
    pages = F.when(kind == "view", F.concat(F.lit("["), "props", F.lit(",3]"))).otherwise(
        F.concat(F.lit("["), "props", F.lit("]"))
    )
    tail = F.when(kind == "signup", "} trailing").when(kind == "error", "").otherwise("}")
    reply = F.concat(
        F.lit('```json\n{"subtitle":'), subtitle, F.lit(',"titles":{"en":"'), kind, F.lit('"},"pages":'), pages, tail, F.lit("\n```")
    )
    events = table(spark, d, "events").select("event_id", reply.alias("content"))
    parsed = L.parse_concept(events)
    good = F.col("parse_error").isNull()
    return parsed.select(
        "event_id",
        F.coalesce("parse_error", F.lit("ok")).alias("outcome"),
        F.when(good, F.size("pages")).alias("page_total"),
        F.when(good, F.col("titles")["en"]).alias("title_en"),
        F.when(good, F.col("subtitle")).alias("subtitle"),
    )


PARSE_STRUCTURED = """
select event_id, case event_type when 'purchase' then 'ok' when 'click' then 'ValidationError: subtitle'
    when 'view' then 'ValidationError: pages' else 'ParseError: invalid json' end as outcome,
  case when event_type = 'purchase' then 1 end as page_total, case when event_type = 'purchase' then 'purchase' end as title_en,
  case when event_type = 'purchase' then 'k' || json_extract_string(props, '$.k') end as subtitle
from events"""


def chat_content(spark, d):
    talk = table(spark, d, "conversations")
    first = F.to_json(F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    second = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return talk.select(
        "conv_id",
        "turn",
        L.extract_chat_content(first).alias("content"),
        L.extract_chat_content(second, "choices").alias("choice"),
        L.extract_chat_content(second).alias("absent"),
    )


CHAT_CONTENT = "select conv_id, turn, text as content, text as choice, '' as absent from conversations"


def build_messages(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("system"), F.col("text").alias("user"))
    return L.build_messages(talk, "m1").select("conv_id", "turn", content_hash(F.col("request")).alias("request_hash"))


BUILD_MESSAGES = """
select conv_id, turn, sha256(cast(to_json({'model': 'm1', 'messages': [{'role': 'system', 'content': role}, {'role': 'user', 'content': text}],
  'stream': false, 'format': 'json'}) as varchar)) as request_hash from conversations"""


def placeholder_completion(spark, d):
    talk = table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat("text", F.when(F.col("role") == "assistant", " Write Listings").otherwise("")).alias("user")
    )
    replies = L.parse_listings(L.parse_concept(L.placeholder_completion(talk)).withColumnRenamed("parse_error", "concept_error"))
    return replies.select(
        "conv_id",
        "turn",
        F.size("pages").alias("page_total"),
        F.size("listings").alias("listing_total"),
        F.coalesce(F.col("titles")["es"], F.lit("")).alias("title_es"),
        L.estimate_cost(F.col("raw")).alias("cost"),
    )


PLACEHOLDER_COMPLETION = """
with t as (select *, role = 'assistant' or contains(lower(text), 'listings') as shop from conversations)
select conv_id, turn, case when shop then 0 else 3 end as page_total, case when shop then 2 else 0 end as listing_total,
  case when shop then '' else 'Placeholder ES' end as title_es, 2 * 2e-8::double as cost from t"""


class LengthProvider:
    """Deterministic stand-in for a model: reports the prompt length, fails on system prompts."""

    def complete(self, system: str, user: str) -> tuple[str, dict]:
        if system == "system":
            raise ValueError("refused")
        return f'{{"subtitle":"{len(user)}"}}', {"prompt_eval_count": len(user), "eval_count": 2}


def complete_batch(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("system"), F.col("text").alias("user"))
    replies = L.parse_concept(L.complete_batch(talk, LengthProvider))
    return replies.select(
        "conv_id",
        "turn",
        F.coalesce("call_error", "parse_error", F.lit("ok")).alias("outcome"),
        F.coalesce("subtitle", F.lit("")).alias("subtitle"),
        F.round(L.estimate_cost(F.col("raw")), 9).alias("cost"),
    )


COMPLETE_BATCH = """
select conv_id, turn, case when role = 'system' then 'ValueError(''refused'')' else 'ok' end as outcome,
  case when role = 'system' then '' else cast(length(text) as varchar) end as subtitle,
  case when role = 'system' then 0.0::double else round((length(text) + 2) * 2e-8::double, 9) end as cost
from conversations"""


def first_valid_attempt(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("attempt"), "role", "text")
    return L.first_valid_attempt(talk, ("conv_id",), valid=F.col("role") == "assistant")


FIRST_VALID_ATTEMPT = """
select conv_id, attempt, role, text from (
  select conv_id, turn + 1 as attempt, role, text, row_number() over (partition by conv_id order by turn) as n
  from conversations where role = 'assistant' and turn + 1 <= 2) where n = 1"""


def retry_parse(spark, d):
    """Each conversation as a prompt; its first two assistant turns are the replies of the two rounds.

    A reply is a JSON object around the text, or the bare text where its length is even.
    """
    talk = table(spark, d, "conversations")
    said = talk.filter(F.col("role") == "assistant").select("conv_id", F.struct("turn", "text").alias("said"))
    first = said.groupBy("conv_id").agg(F.min("said").alias("said"))  # on the mappers first, however long a conversation is
    later = said.join(first.withColumnRenamed("said", "first"), "conv_id").filter(F.col("said") > F.col("first"))
    second = later.groupBy("conv_id").agg(F.min("said").alias("said"))
    pairs = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    reply = F.when(F.length("said.text") % 2 == 0, F.col("said.text")).otherwise(F.to_json(F.struct(F.col("said.text").alias("subtitle"))))
    usage = F.concat(F.lit('{"prompt_eval_count":'), F.length("said.text"), F.lit("}"))
    replies = pairs.select("conv_id", "attempt", reply.alias("content"), usage.alias("raw"))
    prompts = talk.select("conv_id").distinct().withColumns({"system": F.lit("answer"), "user": F.col("conv_id").cast("string")})

    def complete(asked):
        told = asked.join(replies, ["conv_id", "attempt"], "left")
        return told.withColumn("call_error", F.when(F.col("content").isNull(), F.lit("no such turn")))

    folder = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    accepted, failed, cost = L.retry_parse(prompts, complete, L.parse_concept, folder, ("conv_id",))
    good = accepted.select("conv_id", F.concat(F.lit("attempt "), "attempt").alias("outcome"), F.sha2("subtitle", 256).alias("subtitle_hash"))
    bad = failed.select("conv_id", F.col("error").alias("outcome"), F.lit("").alias("subtitle_hash"))
    return good.unionByName(bad).join(cost, "conv_id").withColumn("cost", F.round("cost", 9))


RETRY_PARSE = """
with a as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as n from conversations where role = 'assistant'),
p as (select c.conv_id, x.text as one, y.text as two from (select distinct conv_id from conversations) c
  left join a x on x.conv_id = c.conv_id and x.n = 1 left join a y on y.conv_id = c.conv_id and y.n = 2)
select conv_id,
  case when one is null then 'no such turn' when length(one) % 2 = 1 then 'attempt 1' when two is null then 'no such turn'
       when length(two) % 2 = 1 then 'attempt 2' else 'ParseError: invalid json' end as outcome,
  case when length(one) % 2 = 1 then sha256(one) when length(two) % 2 = 1 then sha256(two) else '' end as subtitle_hash,
  round((coalesce(length(one), 0) + case when length(one) % 2 = 0 then coalesce(length(two), 0) else 0 end) * 2e-8::double, 9) as cost
from p"""


def estimate_cost(spark, d):
    raw = F.concat(
        F.lit('{"prompt_eval_count":'), F.get_json_object("props", "$.k"),
        F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(',"eval_count":'), F.col("value").cast("decimal(18,2)"))),
        F.lit("}"),
    )
    events = table(spark, d, "events").select("user_id", L.estimate_cost(raw).alias("cost"))
    return events.groupBy("user_id").agg(F.round(F.sum("cost"), 8).alias("cost"))


ESTIMATE_COST = """
select user_id, round(sum(cast(json_extract_string(props, '$.k') as bigint)
  + case when event_type = 'view' then 0 else cast(floor(value) as bigint) end)::double * 2e-8::double, 8) as cost
from events group by user_id"""

# Words of the corpus that stand in for a product's own banned terms.
CORPUS_TERMS = ["the", "that and", "la", "ês", "nicht", "de la", "sh"]


def _terms_sql(terms: list[str]) -> str:
    return ", ".join("('" + t.replace("'", "''") + "')" for t in terms)


def _whole_word_sql(text: str) -> str:
    """Term occurs as a whole word; the substring test comes first because the pattern search is slow."""
    return rf"""case when contains(lower({text}), lower(term)) then regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])'
  || regexp_replace(term, '([^\p{{L}}\p{{N}}_\s])', '\\\1', 'g') || '($|[^\p{{L}}\p{{N}}_])') else false end"""


def scan_banned_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.scan_banned_terms(docs, "text", ["doc_id"], [*S.BANNED_TERMS, *CORPUS_TERMS])


SCAN_BANNED_TERMS = f"""
with t(term) as (values {_terms_sql([*S.BANNED_TERMS, *CORPUS_TERMS])})
select doc_id, term from documents cross join t where {_whole_word_sql('text')}"""


def scan_banned_substrings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.scan_banned_terms(docs, "text", ["doc_id"], [*S.BANNED_TERMS, *CORPUS_TERMS], mode="substring")


SCAN_BANNED_SUBSTRINGS = f"""
with t(term) as (values {_terms_sql([*S.BANNED_TERMS, *CORPUS_TERMS])})
select doc_id, term from documents cross join t where contains(lower(text), lower(term))"""


def scan_banned_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return S.scan_banned_terms(pages, "html", ["page_id"], [*S.BANNED_TERMS, "script", "doctype html", "p{margin:0}"])


SCAN_BANNED_PAGES = f"""
with t(term) as (values {_terms_sql([*S.BANNED_TERMS, "script", "doctype html", "p{margin:0}"])})
select page_id, term from pages cross join t where {_whole_word_sql('html')}"""


def scan_term_table(spark, d):
    """Documents against every word, and every two and three words in a row, of the benchmark texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    bench = table(spark, d, "benchmark")
    singles = bench.select(F.explode(S.words(fold_case(F.col("text")))).alias("term"))
    parts = F.split("text", " ")

    def runs(n):
        places = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1))
        return bench.select(F.explode(F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.lit(n)), " "))).alias("term"))

    phrases = runs(2).unionByName(runs(3))
    return S.scan_term_table(docs, singles.unionByName(phrases), "text", "doc_id")


SCAN_TERM_TABLE = rf"""
with words as (select distinct unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as term from benchmark),
docs as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) as term from documents),
b as (select string_split(text, ' ') as w from benchmark),
phrases as (select distinct array_to_string(w[i:i + n - 1], ' ') as term
  from (select w, unnest(range(1, len(w) + 1)) as i from b) cross join (values (2), (3)) s(n) where i + n - 1 <= len(w))
select doc_id, term from docs join words using (term)
union all
select doc_id, term from documents cross join phrases
where not regexp_matches(term, '^[\p{{L}}\p{{N}}_]+$') and {_whole_word_sql('text')}"""


def _scaled(e):
    return F.floor((e.cast("double") + F.lit(0.5)) * F.lit(255)).cast("int")


def binarize_pixels(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), _scaled(e)))).alias("px"))
    bw = vectors.select("vec_id", G.binarize_pixels(F.col("px"), 140).alias("bw"))
    return bw.select(
        "vec_id",
        F.size(F.filter("bw", lambda p: p == 255)).alias("white"),
        F.size(F.filter("bw", lambda p: p == 0)).alias("black"),
    )


PIXELS_SQL = """px as (select vec_id, list_transform(embedding, lambda e: greatest(0, least(255,
    cast(floor((e::double + 0.5::double) * 255) as integer)))) as px from embeddings)"""

BINARIZE_PIXELS = f"""
with {PIXELS_SQL}
select vec_id, cast(len(list_filter(px, lambda p: p > 140)) as integer) as white,
  cast(len(list_filter(px, lambda p: p <= 140)) as integer) as black from px"""


def _vector_images(spark, d):
    """Each vector as a gray image of eight rows."""

    def pixel(e):
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), _scaled(e)))), 2, "0")

    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("assets/"), "vec_id", F.lit(".png")).alias("asset_path"),
        F.lit(8).alias("height"),
        F.floor(F.size("embedding") / 8).cast("int").alias("width"),
        F.lit(1).alias("channels"),
        F.unhex(F.array_join(F.transform("embedding", pixel), "")).alias("data"),
    )


def binarize_images(spark, d):
    images = _vector_images(spark, d).drop("label", "asset_path")
    return G.binarize_images(images, 140).select("vec_id", "height", "width", "white", "black")


BINARIZE_IMAGES = f"""
with {PIXELS_SQL}
select vec_id, 8 as height, cast(len(px) // 8 as integer) as width, len(list_filter(px, lambda p: p > 140)) as white,
  len(list_filter(px, lambda p: p <= 140)) as black from px"""


def clean_image_rows(spark, d):
    """Vectors as gray maps in rows, each tagged with one of the eight orientations."""
    images = _vector_images(spark, d)
    head = F.concat(F.lit("P5\n"), "width", F.lit(" 8\n255\n")).cast("binary")
    rows = images.select("vec_id", F.concat(head, "data").alias("content"), (F.col("vec_id") % 8 + 1).alias("tag"))
    cleaned = G.clean_images(rows, encode=G.bilevel_netpbm, threshold=140, orientation="tag")
    # The first bit after the header is the corner at the top left: clear where it is white.
    body = F.length(F.concat(F.lit("P4\n"), "width", F.lit(" "), "height", F.lit("\n")))
    corner = F.conv(F.hex(F.substring("content", body + 1, F.lit(1))), 16, 10).cast("int") < 128
    return cleaned.select("vec_id", "height", "width", "white", "black", corner.alias("corner_white"))


CLEAN_IMAGE_ROWS = f"""
with {PIXELS_SQL},
i as (select *, vec_id % 8 + 1 as tag, len(px) // 8 as w from px)
select vec_id, cast(case when tag < 5 then 8 else w end as integer) as height, cast(case when tag < 5 then w else 8 end as integer) as width,
  len(list_filter(px, lambda p: p > 140)) as white, len(list_filter(px, lambda p: p <= 140)) as black,
  px[case when tag in (1, 5) then 1 when tag in (2, 8) then w when tag in (4, 6) then 7 * w + 1 else 8 * w end] > 140 as corner_white
from i"""


def process_assets(spark, d):
    """Vectors as image assets; those of the lower labels have been cleaned before."""
    vectors = table(spark, d, "embeddings")
    processed_path = F.concat(F.lit("processed/"), "vec_id", F.lit(".png")).alias("processed_path")
    asset_path = F.concat(F.lit("assets/"), "vec_id", F.lit(".png")).alias("asset_path")
    done = vectors.filter(F.col("label") < 4).select("label", processed_path)
    images = _vector_images(spark, d).drop("vec_id")
    cleaned = G.process_assets(vectors.select("label", asset_path, processed_path), done, images, 140, keys=("label",))
    return cleaned.select("label", "processed_path", "white", "black")


PROCESS_ASSETS = f"""
with {PIXELS_SQL}
select label, 'processed/' || vec_id || '.png' as processed_path, len(list_filter(px, lambda p: p > 140)) as white,
  len(list_filter(px, lambda p: p <= 140)) as black from px join embeddings using (vec_id) where label >= 4"""


class TextPainter:
    """Deterministic stand-in for an image service: the size and the length of the prompt as bytes."""

    def generate(self, prompt: str, aspect_ratio: str, size: str, quality: str) -> bytes:
        if not prompt.strip():
            raise ValueError("nothing to draw")
        return f"{size} {quality} {len(prompt)}".encode()


def generate_images(spark, d):
    """Lines of the unlabelled documents as image assets, drawn where the file does not exist yet."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat("lang", F.lit("x"), "source").alias("image_size"))
    done = table(spark, d, "labels").select("doc_id")
    pages = P.explode_text_pages(pending_files(docs, done, "doc_id"), "text", ("doc_id", "image_size"))
    assets = P.plan_assets(pages.withColumnRenamed("doc_id", "product_id"))
    drawn = L.generate_images(assets, TextPainter)
    return drawn.select(
        "product_id", "id", F.sha2("content", 256).alias("content_hash"), F.coalesce("call_error", F.lit("")).alias("call_error")
    )


GENERATE_IMAGES = r"""
with lines as (
  select doc_id, lang || 'x' || source as size, unnest(string_split(text, chr(10))) as prompt, generate_subscripts(string_split(text, chr(10)), 1) as n
  from documents where doc_id not in (select doc_id from labels)),
p as (select *, regexp_matches(prompt, '\S') as visible from lines where prompt <> '')
select doc_id as product_id, printf('page_%03d', n) as id,
  case when visible then sha256(size || ' high ' || length(prompt)) end as content_hash,
  case when visible then '' else 'ValueError(''nothing to draw'')' end as call_error
from p"""


QUERIES = {
    "strip_json_fence": Query(strip_json_fence, STRIP_JSON_FENCE),
    "parse_structured": Query(parse_structured, PARSE_STRUCTURED),
    "chat_content": Query(chat_content, CHAT_CONTENT),
    "build_messages": Query(build_messages, BUILD_MESSAGES),
    "placeholder_completion": Query(placeholder_completion, PLACEHOLDER_COMPLETION),
    "complete_batch": Query(complete_batch, COMPLETE_BATCH),
    "retry_parse": Query(retry_parse, RETRY_PARSE),
    "first_valid_attempt": Query(first_valid_attempt, FIRST_VALID_ATTEMPT),
    "estimate_cost": Query(estimate_cost, ESTIMATE_COST),
    "scan_banned_terms": Query(scan_banned_terms, SCAN_BANNED_TERMS),
    "scan_banned_substrings": Query(scan_banned_substrings, SCAN_BANNED_SUBSTRINGS),
    "scan_banned_pages": Query(scan_banned_pages, SCAN_BANNED_PAGES),
    "scan_term_table": Query(scan_term_table, SCAN_TERM_TABLE),
    "binarize_pixels": Query(binarize_pixels, BINARIZE_PIXELS),
    "binarize_images": Query(binarize_images, BINARIZE_IMAGES),
    "clean_image_rows": Query(clean_image_rows, CLEAN_IMAGE_ROWS),
    "process_assets": Query(process_assets, PROCESS_ASSETS),
    "generate_images": Query(generate_images, GENERATE_IMAGES),
}
