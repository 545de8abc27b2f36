"""Requests, pages, deliverables and listings on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.text import slugify
from ..operators import completions as L
from ..operators import deliverables as D
from ..operators import listings as K
from ..operators import products as P
from ..operators import requests as R
from .base import Query, sql_fill, table


def slugify_products(spark, d):
    part = table(spark, d, "part").withColumns({"pack": F.col("p_brand"), "theme": F.col("p_name")})
    ided = R.derive_product_id(part)
    kept = slugify(F.concat_ws("-", "p_brand", "p_name"), keep_hyphen=True, fallback=None)
    return ided.select("p_partkey", "product_id", kept.alias("slug_kept"))


SLUGIFY_PRODUCTS = """
select p_partkey,
  coalesce(nullif(trim(regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'product') as product_id,
  trim(regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9-]+', '-', 'g'), '-') as slug_kept
from part"""


def slugify_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", slugify(F.col("text")).alias("slug"))


SLUGIFY_DOCUMENTS = """
select doc_id,
  coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'product') as slug
from documents"""


def normalize_requests(spark, d):
    raw = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("page_count"),
        F.when(F.col("p_type") != "PROMO", F.concat_ws(",", F.lit(" en"), F.lit(" "), F.concat("p_brand", F.lit(" ")))).alias("languages"),
        F.concat(F.lit(",, "), F.col("p_type"), F.lit(" ,"), F.col("p_name"), F.lit(",")).alias("formats"),
        F.lit(None).cast("string").alias("title_hint"),
    )
    out = R.normalize_requests(raw)
    return out.select(
        "p_partkey",
        "page_count",
        F.array_join("languages", "|").alias("languages"),
        F.array_join("formats", "|").alias("formats"),
        "title_hint",
    )


NORMALIZE_REQUESTS = """
with raw as (
  select p_partkey, case when p_size > 10 then p_size end as page_count,
    case when p_type <> 'PROMO' then ' en, ,' || p_brand || ' ' end as languages,
    ',, ' || p_type || ' ,' || p_name || ',' as formats from part)
select p_partkey, coalesce(page_count, 30) as page_count,
  coalesce(array_to_string(list_filter(list_transform(string_split(languages, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), 'en|es') as languages,
  array_to_string(list_filter(list_transform(string_split(formats, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as formats,
  '' as title_hint
from raw"""


def guard_new_products(spark, d):
    requests = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("force"))
    # Doubled customer keys leave gaps: half of the requests are new.
    existing = table(spark, d, "orders").select((2 * F.col("o_custkey")).alias("c_custkey"))
    return R.mark_guarded(requests, existing, "c_custkey")


GUARD_NEW_PRODUCTS = """
select c_custkey, c_mktsegment = 'BUILDING' as force,
  case when c_mktsegment <> 'BUILDING' and exists (select 1 from orders where 2 * o_custkey = c_custkey)
  then 'rejected' else 'accepted' end as decision
from customer"""


def validate_configs(spark, d):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    doc = (
        F.when(kind == "purchase", F.concat(F.lit('{"id":"p'), "event_id", F.lit('","page_count":'), k, F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"id":"c'), "event_id", F.lit('","page_count":'), k, F.lit(".5}")))
        .when(kind == "view", F.concat(F.lit('{"id":"v'), "event_id", F.lit('","formats":{"digital":{"marketplaces":["'), k, F.lit('"]}}}')))
        .when(kind == "signup", F.concat(F.lit('{"id":'), k, F.lit("}")))
        .otherwise(F.col("props"))
    )
    files = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("pack_dir"),
        F.when(kind == "error", "style").otherwise("pack").alias("stem"),
        F.lit("f").alias("path"),
        doc.alias("doc"),
        F.lit(None).cast("string").alias("error"),
    )
    checked = R.check_packs(files)
    good = F.col("reason").isNull()
    return checked.select(
        "pack_dir",
        F.coalesce("reason", F.lit("ok")).alias("outcome"),
        F.when(good, F.col("page_count")).alias("page_count"),
        F.when(good, F.concat_ws(",", "formats.digital.marketplaces")).alias("digital"),
    )


VALIDATE_CONFIGS = """
select cast(event_id as varchar) as pack_dir,
  case event_type when 'purchase' then 'ok' when 'view' then 'ok' when 'click' then 'invalid pack profile: page_count'
    when 'signup' then 'invalid pack profile: id' else 'missing pack.yaml' end as outcome,
  case event_type when 'purchase' then cast(json_extract_string(props, '$.k') as integer) when 'view' then 30 end as page_count,
  case event_type when 'purchase' then '' when 'view' then json_extract_string(props, '$.k') end as digital
from events"""


def join_requests_packs(spark, d):
    # More keys than nations: some packs are unknown.
    requests = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 30).alias("pack"))
    packs = table(spark, d, "nation").select("n_nationkey", "n_name")
    marked = R.mark_packs(requests, packs, "pack", "n_nationkey")
    return marked.select("c_custkey", "pack", F.when(F.col("known"), F.col("n_name")).otherwise("unknown pack").alias("outcome"))


JOIN_REQUESTS_PACKS = """
select c_custkey, c_custkey % 30 as pack, coalesce(n_name, 'unknown pack') as outcome
from customer left join nation on c_custkey % 30 = n_nationkey"""


def explode_pages(spark, d):
    return P.explode_text_pages(table(spark, d, "documents"), "text", ("doc_id",))


EXPLODE_PAGES = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as prompt, generate_subscripts(string_split(text, chr(10)), 1) as n
  from documents)
select doc_id, cast(n - 1 as integer) as pos, printf('page_%03d', n) as id, cast(n as integer) as index, prompt,
  printf('page_%03d', n) as title
from lines where prompt <> ''"""


def concept_pages(spark, d):
    """Structured replies of every shape: typed pages, rejected pages, broken JSON."""
    tail = F.when(F.col("p_type") == "MEDIUM", " done").otherwise("")
    second = F.when(F.col("p_type") == "SMALL", '{"id":null}').otherwise(
        F.concat(F.lit('{"prompt":"'), "p_name", F.lit('"}'))
    )
    reply = F.concat(
        F.lit('```json\n{"pages":[{"id":"'), "p_brand", F.lit('","index":'), "p_size", F.lit("},"), second,
        F.lit(',{"index":"7","title":""}],"titles":{"en":"t"}}'), tail, F.lit("\n```"),
    )
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("theme"), reply.alias("content"))
    typed = P.type_pages(L.parse_concept(part)).withColumn("error", F.coalesce("parse_error", "page_error"))
    sound = typed.withColumn("pages", F.when(F.col("error").isNull(), F.col("pages")))
    pages = P.explode_pages(sound, keep=("p_partkey", "error"), outer=True)
    return pages.withColumn("error", F.coalesce("error", F.lit("")))


CONCEPT_PAGES = """
with good as (select * from part where p_type not in ('MEDIUM', 'SMALL'))
select p_partkey, 0 as pos, p_brand as id, p_size as index, '' as prompt, p_brand as title, p_type as theme, '' as error from good
union all select p_partkey, 1, 'page_002', 2, p_name, 'page_002', p_type, '' from good
union all select p_partkey, 2, 'page_003', 7, '', '', p_type, '' from good
union all select p_partkey, null, null, null, null, null, p_type,
  case p_type when 'MEDIUM' then 'ParseError: invalid json' else 'invalid page field: id' end
from part where p_type in ('MEDIUM', 'SMALL')"""


def plan_assets(spark, d):
    docs = table(spark, d, "documents")
    packs = docs.groupBy("source").agg(
        F.concat(F.count(F.lit(1)), F.lit("x"), F.max("n_chars")).alias("image_size")
    )
    sized = docs.select("doc_id", "source", "text").join(packs, "source")
    pages = P.explode_text_pages(sized, "text", ("doc_id", "image_size")).withColumnRenamed("doc_id", "product_id")
    return P.plan_assets(pages)


PLAN_ASSETS = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as prompt, generate_subscripts(string_split(text, chr(10)), 1) as n
  from documents),
packs as (select source, count(*) || 'x' || max(n_chars) as size from documents group by source)
select doc_id as product_id, cast(n - 1 as integer) as pos, printf('page_%03d', n) as id, printf('page_%03d', n) as page_id,
  prompt, '1:1' as aspect_ratio, size, 'high' as quality
from lines join packs using (source) where prompt <> ''"""


def render_prompts(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_brand").alias("pack"),
        F.lower("p_type").alias("pack_type"),
        F.col("p_name").alias("theme"),
        F.col("p_size").alias("page_count"),
        F.array(F.lit("en"), F.lower("p_brand")).alias("pack_languages"),
        F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("title_hint"),
        F.array(F.lit("es"), F.lit("fr")).alias("languages"),
        F.array(F.lit("digital")).alias("formats"),
        F.sequence(F.lit(1), "p_size").alias("pages"),
        F.create_map(F.lit("en"), F.col("p_name")).alias("titles"),
        F.col("p_brand").alias("subtitle"),
        F.lit("").alias("description_hint"),
    )
    concept = L.render_prompts(part, "concept").select("p_partkey", F.lit("concept").alias("kind"), content_hash(F.col("user")).alias("prompt_hash"))
    listing = L.render_prompts(part, "listing").select("p_partkey", F.lit("listing").alias("kind"), content_hash(F.col("user")).alias("prompt_hash"))
    return concept.unionByName(listing)


RENDER_PROMPTS = f"""
select p_partkey, 'concept' as kind, sha256({sql_fill(L.CONCEPT_TEMPLATE, pack='p_brand', pack_type='lower(p_type)',
    theme='p_name', page_count='p_size', languages="('en, ' || lower(p_brand))",
    hint="(case when p_size > 25 then p_name else '(ninguna)' end)")}) as prompt_hash from part
union all
select p_partkey, 'listing', sha256({sql_fill(L.LISTING_TEMPLATE, pack='p_brand', pack_type='lower(p_type)',
    theme='p_name', page_total='p_size', languages="'es, fr'", formats="'digital'", title_en='p_name', title_es="''",
    subtitle='p_brand', hint="''")}) from part"""


def expand_deliverables(spark, d):
    size = F.col("p_size")
    part = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_brand").alias("pack"),
        F.col("p_name").alias("theme"),
        F.when(size < 20, F.array(F.lit("digital")))
        .when(size < 35, F.array(F.lit("digital"), F.lit("print")))
        .otherwise(F.array(F.lit("print"), F.lit("audio"))).alias("formats"),
        F.when(F.col("p_type") == "PROMO", F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("es"))).alias("languages"),
    )
    shops = {"digital": F.array(F.lit("shop"), F.lower("pack")), "print": F.array(F.lit("press"))}
    return D.expand_deliverables(part, shops, keep=("p_partkey",)).select(
        "p_partkey", "format", "marketplace", "language", "kind", "path"
    )


EXPAND_DELIVERABLES = """
with f(format, kind, suffix) as (values ('digital', 'pdf', '.pdf'), ('digital', 'zip', '.zip'),
    ('print', 'interior', '-interior.pdf'), ('print', 'cover', '-cover.png')),
l(language) as (values ('en'), ('es')), m(n) as (values (1), (2)),
x as (
  select p_partkey, p_brand, p_name, format, kind, suffix, language,
    case when format = 'print' then 'press' when n = 1 then 'shop' else lower(p_brand) end as marketplace
  from part cross join f cross join l cross join m
  where (language = 'en' or p_type <> 'PROMO') and (format = 'digital' or n = 1)
    and ((format = 'digital' and p_size < 35) or (format = 'print' and p_size >= 20)))
select p_partkey, format, marketplace, language, kind,
  'packages/' || format || '/' || language || '/' || p_brand || '-' || p_name || '-' || marketplace || suffix as path
from x"""


def page_geometry(spark, d):
    def side(factor: float):
        return (F.col("p_size") * F.lit(factor)).cast("decimal(8,3)").cast("string")

    part = table(spark, d, "part").select(
        "p_partkey",
        F.concat(side(0.055), F.lit("x"), side(0.125)).alias("page_size"),
        F.when(F.col("p_type") == "PROMO", 0.125).otherwise(0.0).alias("bleed"),
    )
    out = D.page_geometry(part)
    return out.select("p_partkey", "page_size", "width_px", "height_px", F.round("width_pt", 6).alias("width_pt"), F.round("height_pt", 6).alias("height_pt"))


PAGE_GEOMETRY = """
with s as (select p_partkey, cast(cast(p_size * 0.055 as decimal(8,3)) as varchar) as w,
    cast(cast(p_size * 0.125 as decimal(8,3)) as varchar) as h,
    case when p_type = 'PROMO' then 0.125::double else 0.0::double end as bleed from part),
g as (select *, cast(w as double) + 2 * bleed as fw, cast(h as double) + 2 * bleed as fh from s)
select p_partkey, w || 'x' || h as page_size, cast(round_even(fw * 300, 0) as integer) as width_px,
  cast(round_even(fh * 300, 0) as integer) as height_px, round(fw * 72, 6) as width_pt, round(fh * 72, 6) as height_pt
from g"""


def fit_crop_box(spark, d):
    line = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_quantity") * 20).cast("bigint").alias("width"),
        ((F.col("l_partkey") % 50 + 1) * 30).alias("height"),
        F.lit(2550).alias("target_w"),
        (F.lit(1000) + F.col("l_suppkey") * 7).alias("target_h"),
    )
    return D.fit_crop_box(line).select(
        "l_orderkey", "l_linenumber", "l_partkey", "width", "height", "crop_left", "crop_top", "crop_width", "crop_height"
    )


FIT_CROP_BOX = """
with s as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity * 20 as bigint) as width,
    (l_partkey % 50 + 1) * 30 as height, 2550::double / (1000 + l_suppkey * 7)::double as ratio from lineitem),
b as (select *, case when width::double / height::double > ratio then cast(round_even(height * ratio, 0) as bigint) else width end as cw,
    case when width::double / height::double > ratio then height else cast(round_even(width / ratio, 0) as bigint) end as ch from s)
select l_orderkey, l_linenumber, l_partkey, width, height, (width - cw) // 2 as crop_left, (height - ch) // 2 as crop_top,
  cw as crop_width, ch as crop_height from b"""

LANGS = ["de", "en", "es", "fr"]


def localized_title(spark, d):
    # Documents of one length in one source: few enough for languages to be missing.
    docs = table(spark, d, "documents").withColumn("source", F.concat("source", F.lit("/"), "n_chars"))
    wide = docs.groupBy("source").agg(*[F.max(F.when(F.col("lang") == g, F.col("doc_id"))).alias(g) for g in LANGS])
    pairs = F.array_compact(F.array(*[F.when(F.col(g).isNotNull(), F.struct(F.lit(g), F.col(g).cast("string"))) for g in LANGS]))
    titled = wide.select("source", F.map_from_entries(pairs).alias("titles"), F.explode(F.array(F.lit("es"), F.lit("en"), F.lit("it"))).alias("language"))
    return titled.select("source", "language", P.localized_title(F.col("titles"), F.col("language"), F.col("source")).alias("title"))


LOCALIZED_TITLE = """
with docs as (select doc_id, lang, source || '/' || n_chars as source from documents),
l(language) as (values ('es'), ('en'), ('it'))
select source, language, coalesce(cast(max(doc_id) filter (where lang = language) as varchar),
  cast(max(doc_id) filter (where lang = 'en') as varchar), source) as title
from docs cross join l group by source, language"""


def cover_spec(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("theme"),
        F.when(F.col("p_type") == "PROMO", F.create_map(F.lit("en"), F.lit("")))
        .when(F.col("p_type") == "SMALL", F.create_map(F.lit("es"), F.col("p_brand")))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("titles"),
        F.lit("es").alias("language"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("subtitle"),
        F.concat("p_size", F.lit(".5x11")).alias("page_size"),
    )
    return D.cover_spec(part).select(
        "p_partkey", "cover_title", "cover_subtitle", "cover_width_px", "cover_height_px", "draw_title", "draw_subtitle"
    )


COVER_SPEC = """
select p_partkey, case p_type when 'PROMO' then '' when 'SMALL' then p_brand else p_name end as cover_title,
  case when p_size > 25 then p_brand else '' end as cover_subtitle,
  cast((p_size + 0.5) * 300 as integer) as cover_width_px, 3300 as cover_height_px,
  p_type <> 'PROMO' as draw_title, p_size > 25 as draw_subtitle from part"""


def asset_paths(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_"), "doc_id").alias("id"))
    return D.asset_paths(docs).withColumn("artifact", D.artifact_path(F.col("id")))


ASSET_PATHS = """
select doc_id, source || '_' || doc_id as id, 'assets/' || source || '_' || doc_id || '.png' as asset_path,
  'processed/' || source || '_' || doc_id || '.png' as processed_path, 'artifacts/' || source || '_' || doc_id || '.json' as artifact
from documents"""


def bundle_members(spark, d):
    """Lines as pages, whose names recur in every order; sizes are by order and name, for two lines of each."""
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("product_id"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("page_"), "l_linenumber", F.lit(".png")).alias("name"),
    )
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("product_id"),
        F.explode(F.array(F.lit("page_1.png"), F.lit("page_2.png"))).alias("name"),
        F.col("o_totalprice").cast("bigint").alias("length"),
    )
    return D.bundle_members(line, orders)


BUNDLE_MEMBERS_SQL = """members as (
  select l_orderkey as product_id, l_linenumber as pos, 'page_' || l_linenumber || '.png' as name,
    case when l_linenumber < 3 then cast(trunc(o_totalprice) as bigint) end as length
  from lineitem left join orders on o_orderkey = l_orderkey)"""

BUNDLE_MEMBERS = f"with {BUNDLE_MEMBERS_SQL} select * from members"


def bundle_manifest(spark, d):
    return D.bundle_manifest(bundle_members(spark, d))


BUNDLE_MANIFEST = f"""
with {BUNDLE_MEMBERS_SQL}
select product_id, count(*) as members, min(pos) as first_pos, max(pos) as last_pos,
  cast(coalesce(sum(length), 0) as bigint) as total_bytes from members group by product_id"""


def _lines():
    return F.split("text", "\n")


def normalize_listings(spark, d):
    """Listing replies built from the documents, a listing per line, parsed strictly and typed field by field."""
    price = F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.concat("n_chars", F.lit(".25")))

    def listing(line):
        return F.struct(
            F.col("source").alias("marketplace"),
            F.when(F.col("lang") != "en", F.col("lang")).alias("language"),
            line.alias("title"),
            F.split(line, " ").alias("tags"),
            price.alias("price"),
        )

    doc = F.to_json(F.struct(F.transform(_lines(), listing).alias("listings")))
    docs = table(spark, d, "documents").select("doc_id", doc.alias("content"))
    rows = K.normalize_listings(L.parse_listings(docs), keep=("doc_id",))
    return rows.select(
        "doc_id", "pos", "marketplace", "language", "title", "description",
        F.array_join("tags", "|").alias("tags"), "price", "category",
    )


NORMALIZE_LISTINGS = """
with d as (select *, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, cast(pos as integer) as pos, source as marketplace, lang as language, line as title, '' as description,
  array_to_string(string_split(line, ' '), '|') as tags,
  case when lang = 'fr' then 0.0::double else n_chars + 0.25::double end as price, '' as category from d"""


def _document_listings(spark, d):
    """A listing per line of each document."""
    words = F.filter(F.split("line", " "), lambda w: F.length(w) > 2)
    lines = table(spark, d, "documents").select("doc_id", "source", "lang", F.explode(_lines()).alias("line"))
    return lines.select(
        "doc_id",
        "source",
        F.col("source").alias("marketplace"),
        F.col("lang").alias("language"),
        F.when(F.size(words) < 2, "").otherwise(F.col("line")).alias("title"),
        words.alias("tags"),
    )


LISTING_ISSUES_SQL = """lines as (select doc_id, source, lang, unnest(string_split(text, chr(10))) as line from documents),
l as (select *, list_filter(string_split(line, ' '), lambda w: length(w) > 2) as tags from lines),
listing_issues as (
  select doc_id, source, 'listing_title' as criterion, 'error' as severity, 'missing title for ' || source || '/' || lang as detail
  from l where len(tags) < 2 or line = ''
  union all
  select doc_id, source, 'listing_tags', 'warning', 'few tags for ' || source || '/' || lang || ': ' || len(tags) from l where len(tags) < 5)"""


def check_listings(spark, d):
    return K.check_listings(_document_listings(spark, d), ("doc_id",))


CHECK_LISTINGS = f"with {LISTING_ISSUES_SQL} select doc_id, criterion, severity, detail from listing_issues"


def dedupe_listings(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "text")
    return K.dedupe_listings(docs, ("source", "lang"), "doc_id")


DEDUPE_LISTINGS = """
select source, lang, max(doc_id) as doc_id, arg_max(text, doc_id) as text from documents group by source, lang"""


QUERIES = {
    "slugify_products": Query(slugify_products, SLUGIFY_PRODUCTS),
    "slugify_documents": Query(slugify_documents, SLUGIFY_DOCUMENTS),
    "normalize_requests": Query(normalize_requests, NORMALIZE_REQUESTS),
    "guard_new_products": Query(guard_new_products, GUARD_NEW_PRODUCTS),
    "validate_configs": Query(validate_configs, VALIDATE_CONFIGS),
    "join_requests_packs": Query(join_requests_packs, JOIN_REQUESTS_PACKS),
    "explode_pages": Query(explode_pages, EXPLODE_PAGES),
    "concept_pages": Query(concept_pages, CONCEPT_PAGES),
    "plan_assets": Query(plan_assets, PLAN_ASSETS),
    "render_prompts": Query(render_prompts, RENDER_PROMPTS),
    "expand_deliverables": Query(expand_deliverables, EXPAND_DELIVERABLES),
    "page_geometry": Query(page_geometry, PAGE_GEOMETRY),
    "fit_crop_box": Query(fit_crop_box, FIT_CROP_BOX),
    "localized_title": Query(localized_title, LOCALIZED_TITLE),
    "cover_spec": Query(cover_spec, COVER_SPEC),
    "asset_paths": Query(asset_paths, ASSET_PATHS),
    "bundle_members": Query(bundle_members, BUNDLE_MEMBERS),
    "bundle_manifest": Query(bundle_manifest, BUNDLE_MANIFEST),
    "normalize_listings": Query(normalize_listings, NORMALIZE_LISTINGS),
    "check_listings": Query(check_listings, CHECK_LISTINGS),
    "dedupe_listings": Query(dedupe_listings, DEDUPE_LISTINGS),
}
