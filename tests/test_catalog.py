"""The six stages end to end on offline providers, then resumed, changed and broken."""

import pytest
from pyspark.sql import functions as F

from catalogloom.operators import completions as L
from catalogloom.operators import incremental as I
from catalogloom.plans import catalog
from catalogloom.sources.packs import read_pack_configs
from catalogloom.operators.requests import derive_product_id, normalize_requests
from catalogloom.sources import tables as S

RUNTIME = {"llm": {"provider": "placeholder", "model": "p"}, "image": {"provider": "placeholder", "model": "p"}}

PACK = """
id: sample
pack_version: 2
pack_type: posters
languages: [en, es]
formats:
  digital:
    marketplaces: [shop-a, shop-b]
  print:
    marketplaces: [press]
image_size: 1024x1024
"""


@pytest.fixture(scope="module")
def packs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("packs")
    (root / "sample").mkdir()
    (root / "sample" / "pack.yaml").write_text(PACK)
    (root / "sample" / "packaging.yaml").write_text("digital:\n  page_size: 8.5x11\n")
    valid, violations = read_pack_configs(spark, str(root))
    assert violations.count() == 0
    return valid


def requests(spark, *themes):
    rows = [(None, "sample", t, None, None, None, None, False) for t in themes]
    raw = spark.createDataFrame(
        rows, "product_id string, pack string, theme string, page_count int, languages string, formats string, title_hint string, force boolean"
    )
    return derive_product_id(normalize_requests(raw)).drop("force")


def decisions(df):
    return {(r.product_id, r.stage): r.decision for r in df.collect()}


def test_offline_run_resume_and_change(spark, packs, tmp_path):
    work = str(tmp_path)
    products, unknown = catalog.resolve(requests(spark, "sea", "Deep Sky"), packs)
    assert unknown.count() == 0
    first = decisions(catalog.produce(spark, products, work, RUNTIME))
    assert set(first.values()) == {"run"} and len(first) == 12

    out = spark.read.parquet(f"{work}/out/review").collect()
    assert {r.doc.verdict for r in out} == {"pass"}
    assert out[0].doc.scores == {"concept_pages": 3.0, "assets_generated": 3.0, "packages_built": 12.0, "listings_count": 2.0}
    issues = spark.read.parquet(f"{work}/issues").groupBy("criterion", "severity").count().collect()
    assert [tuple(r) for r in issues] == [("asset_size", "warning", 6)]
    assert [len(r.doc.issues) for r in out] == [3, 3]
    package = spark.read.parquet(f"{work}/out/packages").first().doc
    assert package.members == 3 and package.geometry_error is None
    assert (package.geometry.digital.width_px, package.geometry.print.width_px) == (2550, 2625)
    assert [(c.language, c.title, c.height_px) for c in package.covers] == [("en", "Placeholder EN", 3300), ("es", "Placeholder ES", 3300)]
    copies = spark.read.json(f"{work}/listings/run=1")
    assert sorted((r.product_id, r.language) for r in copies.collect()) == [(p, g) for p in ("sample-deep-sky", "sample-sea") for g in ("en", "es")]
    guarded = catalog.produce(spark, products.withColumn("force", F.col("theme") == "none"), work, RUNTIME, guard=True)
    assert guarded.count() == 0

    state = S.read_node_state(spark, f"{work}/node_runs")
    costs = {r.stage: r.cost for r in state.filter("product_id = 'sample-sea'").collect()}
    assert costs["concept"] == pytest.approx(4e-8) and costs["listing"] == pytest.approx(4e-8)
    assert sum(costs.values()) == pytest.approx(8e-8)
    paths = {r.path for r in spark.read.parquet(f"{work}/files").filter("product_id = 'sample-deep-sky'").collect()}
    assert "assets/page_001.png" in paths and "processed/page_003.png" in paths and len(paths) == 6

    again = decisions(catalog.resume(spark, work, packs, RUNTIME))
    assert set(again.values()) == {"skip"}

    changed, _ = catalog.resolve(requests(spark, "sea").withColumn("title_hint", F.lit("Waves")), packs)
    third = decisions(catalog.produce(spark, changed, work, RUNTIME))
    assert set(third.values()) == {"run"} and len(third) == 6
    # The concept came out the same and the images exist already: none is drawn again.
    assert spark.read.parquet(f"{work}/files").count() == 12
    total = S.read_node_state(spark, f"{work}/node_runs").filter("product_id = 'sample-sea'").agg(F.sum("cost")).first()[0]
    assert total == pytest.approx(16e-8)


class Scripted:
    """Replies by theme: bad JSON once, bad JSON always, an error, a page the contract rejects."""

    def complete(self, system, user):
        usage = {"prompt_eval_count": 3, "eval_count": 2}
        if "theme=twice" in user or ("theme=once" in user and "could not be used" not in system):
            return "no json here", usage
        if "theme=down" in user:
            raise ConnectionError("down")
        if "theme=loose" in user:
            return '{"pages":[{"id":null}]}', usage
        if "listings" in user.lower():
            return '{"listings":[{"marketplace":"m","language":"en","title":"","tags":["a"]}]}', usage
        return '```json\n{"pages":[{"prompt":"p"}],"titles":{"en":"T"}}\n```', usage


def test_failures_stay_with_their_product(spark, packs, tmp_path):
    work = str(tmp_path)
    products, _ = catalog.resolve(requests(spark, "fine", "once", "twice", "down", "loose"), packs)
    done = decisions(catalog.produce(spark, products, work, RUNTIME, complete=lambda df: L.complete_batch(df, Scripted)))
    assert {p for p, s in done if s == "review"} == {"sample-fine", "sample-once"}

    state = {(r.product_id, r.stage): r for r in S.read_node_state(spark, f"{work}/node_runs").collect()}
    assert state[("sample-twice", "concept")].error == "ParseError: invalid json"
    assert "ConnectionError" in state[("sample-down", "concept")].error
    assert state[("sample-loose", "concept")].error == "invalid page field: id"
    assert state[("sample-loose", "concept")].cost == 0.0
    assert state[("sample-once", "concept")].cost == pytest.approx(2 * 5 * 2e-8)
    assert ("sample-twice", "assets") not in state

    report = {r.product_id: r.doc for r in spark.read.parquet(f"{work}/out/review").collect()}
    assert report["sample-fine"].verdict == "fail" and report["sample-fine"].errors == 1

    # A failed product runs again, a finished one does not.
    healed = decisions(catalog.produce(spark, products, work, RUNTIME, complete=L.placeholder_completion))
    assert healed[("sample-twice", "concept")] == "run" and healed[("sample-fine", "concept")] == "skip"


def test_missing_input_is_logged(spark, packs, tmp_path):
    work = str(tmp_path)
    products, _ = catalog.resolve(requests(spark, "sea"), packs)
    catalog.produce(spark, products, work, RUNTIME, stages=["assets"])
    runs = S.read_node_runs(spark, f"{work}/node_runs").collect()
    assert [(r.stage, r.status, r.error) for r in runs] == [("assets", "failed", "missing input artifact: concept")]
    assert I.fold_node_runs(S.read_node_runs(spark, f"{work}/node_runs")).first().created_at is None


def test_undecodable_image_fails_its_product_only(spark, packs, tmp_path):
    work = str(tmp_path)
    asked = requests(spark, "sea", "sky").withColumn(
        "product_id", F.when(F.col("theme") == "sea", "x y+é%20").otherwise(F.col("product_id"))
    )
    products, _ = catalog.resolve(asked, packs)

    def draw(df):
        return L.placeholder_images(df).withColumn(
            "content", F.when((F.col("product_id") == "sample-sky") & (F.col("id") == "page_002"), F.lit(b"no image")).otherwise(F.col("content"))
        )

    done = decisions(catalog.produce(spark, products, work, RUNTIME, draw=draw))
    assert {p for p, s in done if s == "review"} == {"x y+é%20"}
    state = {(r.product_id, r.stage): r for r in S.read_node_state(spark, f"{work}/node_runs").collect()}
    assert state[("sample-sky", "postprocess")].error == "cannot clean image: assets/page_002.png"
    assert state[("x y+é%20", "review")].status == "done"


def test_images_stay_rows(spark, packs, tmp_path):
    """With a decoder images are never files, and broken ones fail their product."""
    from pathlib import Path

    from catalogloom.operators import images as G

    class Painter:
        def generate(self, prompt, *_):
            return b"not an image" if prompt.endswith("3") else b"P5\n2 1\n255\n" + bytes([0, 255])

    products, _ = catalog.resolve(requests(spark, "sea"), packs)
    options = {"draw": lambda df: L.generate_images(df, Painter), "decode": G.decode_netpbm, "stages": ["concept", "assets", "postprocess"]}
    made = decisions(catalog.produce(spark, products, str(tmp_path), RUNTIME, **options))
    assert set(made.values()) == {"run"} and not (Path(tmp_path) / "images").exists()
    cleaned = spark.read.parquet(f"{tmp_path}/cleaned").orderBy("path").collect()
    assert [(r.path, r.white, r.black) for r in cleaned] == [(f"processed/page_00{k}.png", 1, 1) for k in (1, 2)]
    state = {r.stage: (r.status, r.error) for r in S.read_node_state(spark, f"{tmp_path}/node_runs").collect()}
    assert state["assets"] == ("done", "") and state["postprocess"] == ("failed", "cannot clean image: assets/page_003.png")
