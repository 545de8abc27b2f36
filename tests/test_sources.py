"""Readers and writers on files."""

import json

from pyspark.sql import functions as F

from catalogloom.sources import tables as T
from catalogloom.sources.packs import read_pack_configs, read_pack_files
from catalogloom.operators import incremental as I
from catalogloom.operators import reports as R


def test_read_packs(spark, tmp_path):
    def pack(name, **files):
        (tmp_path / name).mkdir()
        for stem, text in files.items():
            (tmp_path / name / f"{stem}.yaml").write_text(text)

    pack("good", pack="id: g\nformats:\n  digital:\n    marketplaces: [a]\n", quality="", packaging="print:\n  bleed_inches: 0.5\n")
    pack("orphan", style="x: 1")
    pack("broken", pack="id: [")
    pack("listed", pack="- 1")
    pack("noid", pack="pack_type: x")
    pack("typed", pack="id: t\npage_count: many")
    pack("aux", pack="id: a", themes="- 1")
    pack("empty", pack="")
    pack("twin", pack="id: same")
    pack("other", pack="id: same\npack_type: x")
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "pack.yaml").write_bytes(b"id: caf\xe9")
    (tmp_path / "latin" / "notes.yaml").write_text("left: alone")
    (tmp_path / "stray.yaml").write_text("id: stray")
    valid, violations = read_pack_configs(spark, str(tmp_path))
    good = valid.collect()
    assert [r.id for r in good] == ["g"]
    row = valid.select("*", F.try_variant_get("packaging", "$.print.bleed_inches", "double").alias("b")).first()
    assert (row.formats.digital.marketplaces, row.formats.print.marketplaces, row.languages, row.page_count, row.b) == (["a"], [], ["en", "es"], 30, 0.5)
    reasons = {r.pack_dir: r.reason for r in violations.collect()}
    assert reasons["orphan"] == "missing pack.yaml"
    assert reasons["broken"].startswith("invalid yaml")
    assert "expected a mapping, got list" in reasons["listed"] and "got list" in reasons["aux"]
    assert reasons["noid"] == reasons["empty"] == "invalid pack profile: id"
    assert reasons["twin"] == reasons["other"] == "duplicate pack id: same"
    assert reasons["latin"].startswith("invalid yaml") and "stray" not in str(reasons)
    assert reasons["typed"] == "invalid pack profile: page_count"


def test_pack_files_are_dealt_to_tasks(spark, tmp_path):
    for k in range(10):
        (tmp_path / f"p{k}").mkdir()
        (tmp_path / f"p{k}" / "pack.yaml").write_text(f"id: i{k}" if k else "")
    files = read_pack_files(spark, str(tmp_path), directories=3)
    assert files.rdd.getNumPartitions() == 4
    assert sorted((r.pack_dir, r.stem, json.loads(r.doc)) for r in files.collect()) == [(f"p{k}", "pack", {"id": f"i{k}"} if k else {}) for k in range(10)]
    assert read_pack_configs(spark, f"file://{tmp_path}")[0].count() == 9
    (tmp_path / "none").mkdir()
    assert read_pack_files(spark, str(tmp_path / "none")).count() == 0


def test_read_requests(spark, tmp_path):
    (tmp_path / "r.csv").write_text('product_id,pack,theme,page_count,languages,formats,title_hint,force\n,P,Big Sea,,"en, fr",,,\nx,P,t,5,,digital,h,true\n')
    got = {r.product_id: r for r in T.read_requests(spark, str(tmp_path / "r.csv"), "csv").collect()}
    assert got["p-big-sea"].languages == ["en", "fr"] and got["p-big-sea"].page_count == 30
    assert got["p-big-sea"].formats == ["digital", "print"] and got["x"].formats == ["digital"]
    (tmp_path / "r.json").write_text('{"pack":"p","theme":"t","languages":["de"]}\n')
    row = T.read_requests(spark, str(tmp_path / "r.json"), "json").first()
    assert (row.product_id, row.languages, row.formats) == ("p-t", ["de"], ["digital", "print"])


def test_state_and_artifacts_round(spark, tmp_path):
    for name, nodes in {"a": {"concept": ("done", 1.0), "package": ("failed", 0.5)}, "b": {}}.items():
        (tmp_path / name / "artifacts").mkdir(parents=True)
        state = {
            "product_id": name, "pack_id": "k", "pack_version": 1, "request": {"theme": "t"},
            "nodes": {s: {"name": s, "status": st, "input_hash": "h", "cost": c, "created_at": "2024-01-01T00:00:00+00:00"} for s, (st, c) in nodes.items()},
        }
        (tmp_path / name / "product.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "nostate").mkdir()
    (tmp_path / "a" / "artifacts" / "concept.json").write_text(json.dumps({"artifact": {"theme": "t", "pages": [{"id": "x"}]}, "provenance": {"model": "m"}}, indent=1))
    products, nodes = T.read_run_state(spark, str(tmp_path))
    listed = [tuple(r) for r in R.list_products(products.select("product_id", "pack"), nodes).collect()]
    assert listed == [("a", "k", "failed", 1.5), ("b", "k", "n/a", 0.0)]
    assert nodes.filter("stage='concept'").first().created_at.year == 2024
    artifacts = T.read_artifacts(spark, str(tmp_path))
    row = artifacts.first()
    assert (row.product_id, row.name, row.schema_version, json.loads(row.provenance)) == ("a", "concept", 1, {"model": "m"})
    doc = T.unwrap(artifacts, "concept", "theme string, pages array<struct<id:string>>").first()
    assert (doc.theme, doc.pages[0].id) == ("t", "x")
    T.write_artifacts(artifacts, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("name = 'concept'").count() == 1


def test_write_listings_keeps_last(spark, tmp_path):
    df = spark.createDataFrame(
        [("p", 0, "m", "en", "old"), ("p", 1, "m", "en", "new"), ("p", 2, "m", "es", "es")],
        "product_id string, pos int, marketplace string, language string, title string",
    )
    T.write_listings(df, str(tmp_path / "l"))
    back = spark.read.schema("product_id string, title string, marketplace string, language string").json(str(tmp_path / "l"))
    assert sorted((r.language, r.title) for r in back.collect()) == [("en", "new"), ("es", "es")]


def test_write_files_replaces(spark, tmp_path):
    df = spark.createDataFrame([("p", "a/x.bin", bytearray(b"123"))], "product_id string, path string, content binary")
    for _ in range(2):
        row = T.write_files(df, str(tmp_path)).first()
    assert (row.length, (tmp_path / "p/a/x.bin").read_bytes()) == (3, b"123")
    assert [f.name for f in (tmp_path / "p/a").iterdir()] == ["x.bin"]


def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path):
    import random

    rng, path = random.Random(2), str(tmp_path / "node_runs")
    fold = lambda: sorted(map(str, I.fold_node_runs(T.read_node_runs(spark, path)).withColumn("cost", F.round("cost", 6)).collect()))
    kept = lambda: sorted(map(str, T.read_node_state(spark, path).withColumn("cost", F.round("cost", 6)).collect()))
    for run in range(1, 9):
        rows = [
            (f"p{rng.randrange(6)}", rng.choice(["concept", "assets"]), run, rng.choice(["done", "failed"]), f"h{run}", f"o{run}", rng.random(), "", rng.random() < 0.7)
            for _ in range(5)
        ]
        rows = list({r[:2]: r for r in rows}.values())
        df = spark.createDataFrame(rows, "product_id string, stage string, run int, status string, input_hash string, output_path string, cost double, error string, started boolean")
        T.write_run_state(df.withColumn("ts", F.timestamp_seconds(F.lit(1000 * run))), path)
        if run in (3, 6):
            T.write_snapshot(spark, path, run)
            assert T.last_snapshot(spark, path) == run
        assert kept() == fold()
    T.write_snapshot(spark, path, 2)  # older than what there is
    assert T.last_snapshot(spark, path) == 6
    tail = T.read_run_log_state(spark, path)
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "(run" in plan and "> 6" in plan  # folders of older runs are not opened
