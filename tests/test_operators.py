"""Operators on small frames: empty groups, NULLs, repeats, and one key that holds most rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogloom.functions import hashing as H
from catalogloom.operators import completions as L
from catalogloom.operators import deliverables as D
from catalogloom.operators import images as G
from catalogloom.operators import incremental as I
from catalogloom.operators import listings as K
from catalogloom.operators import policy as S
from catalogloom.operators import products as P
from catalogloom.operators import reports as R
from catalogloom.operators import requests as Q
from catalogloom.operators import review as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(tuple(r) for r in df.collect())


def test_guard_and_join(spark):
    asked = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "product_id string, force boolean")
    there = spark.createDataFrame([("a",), ("b",), ("b",)], "product_id string")
    accepted, rejected = Q.guard_new_products(asked, there)
    assert rows(accepted.select("product_id")) == [("a",), ("c",)]
    assert rows(rejected.select("product_id")) == [("b",)]


def test_derive_product_id(spark):
    df = spark.createDataFrame([("", "P k", "T!"), (None, "p", "t"), ("x", "p", "t")], "product_id string, pack string, theme string")
    assert sorted(r.product_id for r in Q.derive_product_id(df).collect()) == ["p-k-t", "p-t", "x"]


def page_products(spark, docs):
    df = spark.createDataFrame([(str(i), "t", d) for i, d in enumerate(docs)], "product_id string, theme string, content string")
    return P.type_pages(L.parse_concept(df))


def test_pages_defaults_and_rejections(spark):
    docs = [
        '{"pages":[{}, {"id":"z","index":"5"}, {"title":""}]}',
        '{"pages":[{"id":null}]}',
        '{"pages":[{"index":1.5}]}',
        '{}',
        '{"pages":null}',
        '{"pages":[1]}',
        '[]',
        '{"titles":{"en":5}}',
        None,
    ]
    typed = page_products(spark, docs)
    errors = {r.product_id: r.parse_error or r.page_error for r in typed.collect()}
    assert errors == {
        "0": None, "1": "invalid page field: id", "2": "invalid page field: index", "3": None,
        "4": "ValidationError: pages", "5": "ValidationError: pages", "6": "ValidationError: not an object",
        "7": "ValidationError: titles", "8": "no reply",
    }
    pages = rows(P.explode_pages(typed.filter("product_id = '0'")), "pos")
    assert [p[2:6] for p in pages] == [("page_001", 1, "", "page_001"), ("z", 5, "", "z"), ("page_003", 3, "", "")]


def test_page_id_keeps_wide_numbers(spark):
    assert spark.range(1).select(P.page_id(F.lit(1233))).first()[0] == "page_1234"


def test_localized_title(spark):
    df = spark.sql("select map('en','A','de','') as m, map() as e")
    got = df.select(
        P.localized_title(F.col("m"), F.lit("fr"), F.lit("T")),
        P.localized_title(F.col("m"), F.lit("de"), F.lit("T")),
        P.localized_title(F.expr("cast(map() as map<string,string>)"), F.lit("fr"), F.lit("T")),
    ).first()
    assert tuple(got) == ("A", "", "T")


def test_page_size_fallbacks(spark):
    df = spark.sql("""select parse_json(j) as packaging, '1024x1024' as image_size from values
        ('{"digital":{"page_size":"6x9"},"print":{"bleed_inches":0.25}}'), ('{}') as t(j)""")
    first, second = D.resolve_page_size(df).collect()
    assert (first.digital_page_size, first.print_page_size, first.print_bleed, first.geometry_error) == ("6x9", "8.5x11", 0.25, None)
    assert second.digital_page_size is None and second.geometry_error and second.print_bleed == 0.125
    strict = D.resolve_page_size(df, strict_parity=True).collect()[1]
    assert strict.digital_page_size == "1024x1024" and strict.geometry_error is None


def test_page_geometry(spark):
    df = spark.createDataFrame([("8.5x11", 0.125), ("oops", 0.0)], "page_size string, bleed double")
    good, bad = D.page_geometry(df).collect()
    assert (good.width_px, good.height_px, good.width_pt, good.height_pt) == (2625, 3375, 630.0, 810.0)
    assert bad.width_px is None


def test_listings(spark):
    docs = ['{"listings":[{"price":"4.50","tags":["a"],"format":"x"},{"language":"es"}]}', '{"listings":[{"tags":null}]}', '{"listings":[{"price":"free"}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "product_id int, content string")
    parsed = L.parse_listings(df)
    errors = {r.product_id: r.listing_error for r in K.type_listings(parsed).collect()}
    assert errors == {0: None, 1: "invalid listing field: tags", 2: "invalid listing field: price"}
    got = K.normalize_listings(parsed).orderBy("pos").collect()
    assert [(r.language, r.price, r.tags, r.title) for r in got] == [("en", 4.5, ["a"], ""), ("es", 0.0, [], "")]


def test_check_and_dedupe_listings(spark):
    df = spark.createDataFrame(
        [("p", 0, "m", "en", "", ["a"] * 4), ("p", 1, "m", "en", "x", ["a"] * 5), ("p", 2, "m", "es", "x", None)],
        "product_id string, pos int, marketplace string, language string, title string, tags array<string>",
    )
    issues = rows(K.check_listings(df).select("criterion", "severity", "detail"))
    assert issues == [
        ("listing_tags", "warning", "few tags for m/en: 4"),
        ("listing_tags", "warning", "few tags for m/es: 0"),
        ("listing_title", "error", "missing title for m/en"),
    ]
    assert rows(K.dedupe_listings(df).select("pos")) == [(1,), (2,)]


def test_check_assets(spark):
    assets = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "product_id string, path string")
    stats = spark.createDataFrame([("b", 999), ("c", 1000)], "path string, length bigint")
    assert rows(W.check_assets(assets, stats).select("criterion", "severity", "detail")) == [
        ("asset_existence", "error", "missing processed asset: a"),
        ("asset_size", "warning", "asset suspiciously small (<1KB): b"),
    ]


def test_review_of_empty_groups(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product_id string")
    child = spark.createDataFrame([("a",), ("a",)], "product_id string")
    none = child.limit(0)
    issues = W.check_packages(products, child)
    assert rows(issues.select("product_id", "detail")) == [("b", "no packages produced")]
    report = rows(W.review_report(products, issues, child, none, child, none))
    assert report == [("a", "pass", 2.0, 0.0, 2.0, 0.0, 0, 0), ("b", "fail", 0.0, 0.0, 0.0, 0.0, 1, 0)]
    assert rows(W.review_verdict(products, issues)) == [("a", "pass"), ("b", "fail")]
    assert W.as_score_map(W.review_report(products, issues, child, none, child, none)).filter("product_id='a'").first().scores["concept_pages"] == 2.0


def test_plan_incremental_truth_table(spark):
    nodes = spark.createDataFrame([(n, "package", "h") for n in "abcde"], "product_id string, stage string, input_hash string")
    state = spark.createDataFrame(
        [("b", "package", "failed", "h"), ("c", "package", "done", "x"), ("d", "package", "done", "h"), ("e", "package", "done", "h")],
        "product_id string, stage string, status string, input_hash string",
    )
    existing = spark.createDataFrame([(n, "package", o) for n in "abce" for o in "12"] + [("d", "package", "1")], "product_id string, stage string, name string")
    outputs = I.outputs_complete(nodes, existing, ["product_id", "stage"], "name", ["1", "2"])
    got = rows(I.plan_incremental(nodes, state, outputs).select("product_id", "decision"))
    assert got == [("a", "run"), ("b", "run"), ("c", "run"), ("d", "run"), ("e", "skip")]


def test_bind_names_first_missing(spark):
    products = spark.createDataFrame([("a",), ("b",), ("c",)], "product_id string")
    held = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "y", "2"), ("b", "z", "3")], "product_id string, name string, content_hash string")
    bound, missing = I.bind_stage_inputs(products, held, ["x", "y"])
    assert rows(bound) == [("a", "1", "2")]
    assert rows(missing) == [("b", "missing input artifact: x"), ("c", "missing input artifact: x")]
    free, none = I.bind_stage_inputs(products, held, [])
    assert free.count() == 3 and none.count() == 0


def test_pending_files_by_content(spark):
    wanted = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, prompt_hash string")
    done = spark.createDataFrame([("a", "old"), ("a", "old")], "path string, prompt_hash string")
    assert rows(I.pending_files(wanted, done)) == [("b", "h2")]
    assert rows(I.pending_files(wanted, done, by_content=True).select("path")) == [("a",), ("b",)]


RUNS = "product_id string, stage string, run int, status string, input_hash string, output_path string, cost double, error string, started boolean, ts timestamp"


def test_fold_node_runs_and_reports(spark):
    log = spark.sql("""select * from values
        ('p','concept',1,'failed','','',9D,'boom',false,timestamp'2024-01-01'),
        ('p','concept',2,'done','h2','o',1D,'',true,timestamp'2024-01-02'),
        ('p','concept',3,'failed','h3','',5D,'bang',true,timestamp'2024-01-03'),
        ('p','package',1,'done','0123456789abcdef','o',2D,'',true,timestamp'2024-01-01')
        as t(product_id,stage,run,status,input_hash,output_path,cost,error,started,ts)""")
    state = I.fold_node_runs(log)
    concept = state.filter("stage='concept'").first()
    assert (concept.status, concept.input_hash, concept.cost, concept.error) == ("failed", "h2", 1.0, "bang")
    assert (concept.created_at.day, concept.updated_at.day) == (2, 3)
    assert I.fold_node_runs(log, include_failed=True).filter("stage='concept'").first().cost == 15.0
    products = spark.createDataFrame([("p", "k"), ("q", "k")], "product_id string, pack string")
    assert rows(R.list_products(products, state)) == [("p", "k", "done", 3.0), ("q", "k", "n/a", 0.0)]
    assert rows(R.latest_status(products, state).select("product_id", "status")) == [("p", "done"), ("q", "n/a")]
    table = [tuple(r) for r in R.status_table(state).collect()]
    assert table == [("p", 1, "concept", "failed", "h2", 1.0), ("p", 4, "package", "done", "0123456789a", 2.0)]
    assert R.total_cost(state).first()[0] == 3.0


def test_cumulative_cost_of_a_hot_node(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else (f"p{i % 50}" if i % 50 else None), "s", i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "product_id string, stage string, run int, cost int").withColumn("cost", F.col("cost").cast("double"))
    out = I.cumulative_cost(df, ["product_id", "stage"], ["run"], "cost", range_rows=200)
    total, want = {}, {}
    for product, _, run, cost in data:
        total[product] = total.get(product, 0) + cost
        want[run] = total[product]
    assert {r.run: r.running_cost for r in out.collect()} == want


def test_retry_stops_after_two(spark, tmp_path):
    calls = {"a": ["bad", '{"listings":[]}'], "b": ["bad", "bad"], "c": ['{"listings":[]}']}
    prompts = spark.createDataFrame([(k, "sys", k) for k in calls], "product_id string, system string, user string")
    seen = []

    def complete(df):
        seen.append(sorted((r.user, r.system) for r in df.select("user", "system").collect()))
        reply = F.when((F.col("user") == "c") | ((F.col("user") == "a") & (F.col("attempt") == 2)), '{"listings":[]}').otherwise("bad")
        return df.withColumns({"content": reply, "raw": F.lit('{"eval_count":5}'), "call_error": F.lit(None).cast("string")})

    accepted, failed, cost = L.retry_parse(prompts, complete, L.parse_listings, str(tmp_path))
    assert rows(accepted.select("product_id", "attempt")) == [("a", 2), ("c", 1)]
    assert rows(failed) == [("b", "ParseError: invalid json")]
    assert {r[0]: r[1] for r in cost.collect()} == pytest.approx({"a": 2e-7, "b": 2e-7, "c": 1e-7})
    assert [u for u, _ in seen[1]] == ["a", "b"] and all("ParseError" in s for _, s in seen[1])
    attempts = spark.read.parquet(str(tmp_path))
    assert rows(L.first_valid_attempt(attempts.drop("attempt").withColumn("attempt", F.when(F.col("system") == "sys", 1).otherwise(2))).select("product_id", "attempt")) == [("a", 2), ("c", 1)]


def test_estimate_cost_of_odd_counts(spark):
    df = spark.createDataFrame([('{"prompt_eval_count":4.7}',), ("{}",), (None,), ('{"eval_count":"3"}',)], "raw string")
    assert [r[0] for r in df.select(L.estimate_cost(F.col("raw"))).collect()] == pytest.approx([8e-8, 0, 0, 6e-8])


def test_prompts(spark):
    df = spark.sql("select 'k' as pack, 'x' as pack_type, 'sea {a}' as theme, 3 as page_count, array('en','fr') as pack_languages, '' as title_hint")
    text = L.render_prompts(df, "concept").first().user
    assert "theme=sea {a}" in text and "languages=en, fr" in text and "hint=(ninguna)" in text and '{"pages": [{"id"' in text


TERMS = ["kindle", "drag", "battle map", "battle", "d&d", "dragon's", "c++", "&", "ſilk", "straße"]
TEXTS = [
    "Kindle a", "Dragón", "a BATTLE MAP.", "battle  map", "battle\nmap", "D&D!", "d & d", "the dragon's den", "c++, c+", "c+++",
    "kindles", "_kindle", "SILK", "STRASSE Straße", "", "drag-drag", "battlemap",
]


def scan_model(terms, text):
    return {t for t in terms if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", text, re.IGNORECASE)}


def test_policy_scan_matches_model(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want = {(i, t) for i, text in enumerate(TEXTS) for t in scan_model(TERMS, text)}
    assert {tuple(r) for r in S.scan_banned_terms(df, "text", ["id"], TERMS).collect()} == want
    terms = spark.createDataFrame([(t,) for t in TERMS] * 2 + [("",)], "term string")
    found = [tuple(r) for r in S.scan_term_table(df, terms, "text", "id").collect()]
    assert set(found) == want and len(found) == len(want)
    sub = {(i, t) for i, text in enumerate(TEXTS) for t in TERMS if t.lower() in text.lower()}
    assert {tuple(r) for r in S.scan_banned_terms(df, "text", ["id"], TERMS, mode="substring").collect()} == sub


def test_policy_scan_random_texts(spark):
    rng = random.Random(5)
    atoms = ["kindle", "drag", "battle", "map", "d", "&", "c", "+", " ", " ", "\n", "s", "'", "dragon", "É", "_"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {(i, t) for i, text in enumerate(texts) for t in scan_model(TERMS, text)}
    assert {tuple(r) for r in S.scan_banned_terms(df, "text", ["id"], TERMS).collect()} == want
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    assert {tuple(r) for r in S.scan_term_table(df, terms, "text", "id").collect()} == want


def png(pixels, color, depth=8, extra=b""):
    """A PNG of rows of bytes, for feeding the image source."""
    height, width = len(pixels), len(pixels[0]) // {0: 1, 2: 3, 6: 4}[color]
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    chunk = G._png_chunk
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    from catalogloom.sources import tables as T

    exif = G._png_chunk(b"eXIf", b"II*\0" + struct.pack("<IHHHII", 8, 1, 0x0112, 3, 1, 6) + b"\0" * 4)
    (tmp_path / "gray.png").write_bytes(png([[199, 200, 201]], 0))
    (tmp_path / "color.png").write_bytes(png([[255, 0, 0, 0, 255, 0, 255, 255, 255]], 2))
    (tmp_path / "turned.png").write_bytes(png([[255, 0], [0, 0], [0, 0]], 0, extra=exif))
    images = T.read_images(spark, str(tmp_path))
    keyed = images.join(T.read_orientations(spark, str(tmp_path)), "path", "left")
    out = {r.path.rsplit("/", 1)[1]: r for r in G.binarize_images(keyed, orientation="orientation").collect()}
    assert (out["gray.png"].white, out["gray.png"].black) == (1, 2)
    assert (out["color.png"].white, out["color.png"].black) == (1, 2)
    turned = out["turned.png"]
    assert (turned.height, turned.width, turned.white) == (2, 3, 1)
    # Turned clockwise: the white corner moves from top left to top right.
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "t.png").write_bytes(turned.content)
    back = T.read_images(spark, str(tmp_path / "again")).first()
    assert list(back.data)[:: back.channels] == [0, 0, 255, 0, 0, 0]
    assert T.read_file_stats(spark, str(tmp_path), "*.png").count() == 4


def test_bilevel_png_is_small():
    assert len(G.bilevel_png(np.ones((1, 1), bool))) < 1000


def test_binarize_array(spark):
    assert spark.sql("select array(199, 200, 201) as p").select(G.binarize_pixels(F.col("p"))).first()[0] == [0, 0, 255]


def test_generate_images_reports_errors(spark):
    class Painter:
        def generate(self, prompt, aspect_ratio, size, quality):
            if prompt == "bad":
                raise KeyError("no key")
            return f"{prompt}{size}".encode()

    df = spark.createDataFrame([("ok", "1:1", "2x2", "high"), ("bad", "1:1", "2x2", "high")], "prompt string, aspect_ratio string, size string, quality string")
    got = {r.prompt: (r.content, r.call_error) for r in L.generate_images(df, Painter).collect()}
    assert got == {"ok": (bytearray(b"ok2x2"), None), "bad": (None, "KeyError('no key')")}
    assert len(L.placeholder_images(df).first().content) == 68


def test_cumulative_cost_of_one_instant(spark):
    rows = spark.createDataFrame([("p", "s", 7, 1.0, k) for k in range(2000)] + [(None, "s", 7, 2.0, 0)], "product_id string, stage string, ts int, cost double, run int")
    found = I.cumulative_cost(rows, ["product_id", "stage"], ["ts"], "cost", range_rows=100).collect()
    assert sorted(r.running_cost for r in found if r.product_id) == [float(k + 1) for k in range(2000)]
    assert [r.running_cost for r in found if r.product_id is None] == [2.0]
    parts = I.in_ranges(rows, ["product_id", "stage"], ["ts"], 100).groupBy("_part").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 500


def test_ordered_digest(spark):
    def digest(files):
        return {r.k: (r.files, r.digest) for r in H.ordered_digest(spark.createDataFrame(files, "k string, path string, sha string"), ["k"], "path", "sha", fan=4).collect()}

    def tree(files):
        level = [sha(f"{p}|{c}") for p, c in sorted(files)]
        while len(level) > 1:
            level = [sha("|".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        return len(files), level[0]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    files = [("a", f"f{i:03}", f"c{i}") for i in range(70)] + [("b", "x", "1")] + [(None, "y", "2"), (None, "z", None)]
    got = digest(files)
    assert got["a"] == tree([f[1:] for f in files[:70]]) and got["b"] == tree([("x", "1")]) and got[None] == tree([("y", "2"), ("z", "")])
    assert digest(files[::-1]) == got
    other = [("a", "f000", "c1"), ("a", "f001", "c0"), *files[2:]]  # two contents change places
    assert digest(other)["a"] != got["a"] and digest(other)["b"] == got["b"]


def test_review_items_follow_the_single_checks(spark):
    rows = [
        ("a", 2, [("p1", 5), ("p2", None), ("p3", 5000)], 1, [("m", "en", "t", ["1"] * 6), ("m", "es", "", ["1"]), (None, None, None, None)]),
        ("b", 0, [], 0, []),
        ("c", 1, [("p1", 1000)], 2, [("m", "en", "t", ["1"] * 5)]),
    ]
    df = spark.createDataFrame(rows, "product_id string, pages int, assets array<struct<path:string,length:long>>, packages int, listings array<struct<marketplace:string,language:string,title:string,tags:array<string>>>")
    items = W.review_items(df, ["product_id"], *[F.col(c) for c in ("pages", "assets", "packages", "listings")])
    assets = df.select("product_id", F.explode("assets").alias("a")).select("product_id", "a.*")
    listings = df.select("product_id", F.explode("listings").alias("l")).select("product_id", "l.*")
    packages = df.where("packages > 0").select("product_id")
    stats = assets.where("length is not null")
    single = W.union_issues(
        W.check_assets(assets.drop("length"), stats, on=["product_id", "path"]), W.check_packages(df, packages), K.check_listings(listings)
    )
    assert sorted(map(tuple, W.issues_of(items).collect())) == sorted(map(tuple, single.collect()))
    report = {r.product_id: (r.verdict, r.concept_pages, r.assets_generated, r.packages_built, r.listings_count) for r in W.report_of(items).collect()}
    assert report == {"a": ("fail", 2, 3, 1, 3), "b": ("fail", 0, 0, 0, 0), "c": ("pass", 1, 1, 2, 1)}


def test_the_stage_turns_photographs(spark, tmp_path):
    from catalogloom.plans import catalog

    exif = G._png_chunk(b"eXIf", b"II*\0" + struct.pack("<IHHHII", 8, 1, 0x0112, 3, 1, 6) + b"\0" * 4)
    for product, name, extra in (("p", "turned", exif), ("p", "upright", b""), ("q", "turned", exif)):
        folder = tmp_path / "images" / "run=1" / product / "assets"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.png").write_bytes(png([[255, 0], [0, 0], [0, 0]], 0, extra=extra))
    run = catalog.Run(spark, str(tmp_path), 1, {}, None, None)
    pixels = catalog._pixels(run, [str(tmp_path / "images" / "run=1")])
    cleaned = {(r.product_id, r.path): (r.height, r.width) for r in G.binarize_images(pixels, orientation="orientation").collect()}
    assert cleaned == {("p", "processed/turned.png"): (2, 3), ("p", "processed/upright.png"): (3, 2), ("q", "processed/turned.png"): (2, 3)}


def test_issues_and_records_of_a_working_directory(spark, tmp_path):
    from catalogloom.plans import catalog
    from catalogloom.sources import tables as T

    def put(rows, schema, path, run):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{path}/run={run}")

    issue = "product_id string, criterion string, severity string, detail string"
    put([("a", "packages", "error", "old"), ("b", "packages", "error", "kept")], issue, "issues", 1)
    put([("a", "asset_size", "warning", "new")], issue, "issues", 2)
    put([("a", None), ("b", None), ("c", None)], "product_id string, error string", "out/review", 1)
    put([("a", None), ("b", "failed")], "product_id string, error string", "out/review", 2)
    assert rows(catalog.latest_issues(spark, str(tmp_path))) == [("a", "asset_size", "warning", "new"), ("b", "packages", "error", "kept")]
    log = [("a", "review", 2, "done", "h2"), ("c", "review", 1, "done", "h1"), ("a", "concept", 1, "done", "h0"), ("b", "concept", 1, "failed", "hx")]
    runs = spark.createDataFrame([(*r, "o", 1.0, "", True) for r in log], "product_id string, stage string, run int, status string, input_hash string, output_path string, cost double, error string, started boolean")
    T.write_run_state(runs.withColumn("ts", F.current_timestamp()), f"{tmp_path}/node_runs")
    found = {(r.product_id, r.stage): (r.status, r.input_hash) for r in catalog.node_table(spark, str(tmp_path)).collect()}
    assert found == {("a", "review"): ("done", "h2"), ("c", "review"): ("done", "h1"), ("a", "concept"): ("pending", ""), ("b", "concept"): ("failed", "")}
    assert catalog.latest_issues(spark, str(tmp_path / "none")).count() == 0


def test_image_rows_are_decoded_and_turned(spark):
    def gray(width, height, *values):
        return b"P5\n# note\n%d %d\n255\n" % (width, height) + bytes(values)

    data = [
        (1, gray(2, 3, 255, 0, 0, 0, 0, 0), 6), (2, gray(2, 3, 255, 0, 0, 0, 0, 0), None), (3, b"P6 1 1 255\n" + bytes([255, 0, 0]), 1),
        (4, b"no image", 1), (5, None, 1), (6, gray(3, 1, 199, 200, 201), 9),
    ]
    images = spark.createDataFrame(data, "id int, content binary, tag int").coalesce(1)
    for held in (1, 1 << 20):
        found = {r.id: r for r in G.clean_images(images, encode=G.bilevel_netpbm, orientation="tag", held_bytes=held).collect()}
        assert bytes(found[1].content) == b"P4\n3 2\n" + bytes([0b11000000, 0b11100000])  # the white corner moves to the right
        assert bytes(found[2].content) == b"P4\n2 3\n" + bytes([0b01000000, 0b11000000, 0b11000000])
        assert (found[3].white, found[3].black) == (0, 1) and (found[6].white, found[6].black) == (1, 2)
        assert "no P5" in found[4].error and found[5].error == "no content" and found[5].content is None
    assert G.clean_images(images.limit(0)).count() == 0
