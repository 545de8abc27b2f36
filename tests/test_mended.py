"""Hashes of exact records, sizes by product, long term lists, replies paid once, unsplit marks."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalogloom.functions import hashing as H
from catalogloom.operators import completions as L
from catalogloom.operators import deliverables as D
from catalogloom.functions import pieces as P
from catalogloom.operators import policy as S
from catalogloom.operators import requests as Q
from catalogloom.operators import review as W
from catalogloom.plans import catalog
from catalogloom.sources import packs


def test_record_hash_sees_a_microsecond(spark):
    when = dt.datetime(2024, 1, 1, 12, 0, 0, 1)
    rows = spark.createDataFrame([(1, when, [when]), (2, when.replace(microsecond=2), [when])], "i int, t timestamp, a array<timestamp>")
    assert rows.select(H.record_hash(rows, ["t", "a"]).alias("h")).distinct().count() == 2


def test_record_hash_of_nested_maps(spark):
    one = spark.createDataFrame([({"a": {"x": 1, "y": 2}, "b": {}},)], "m map<string, map<string, int>>")
    two = spark.createDataFrame([({"b": {}, "a": {"y": 2, "x": 1}},)], "m map<string, map<string, int>>")
    other = spark.createDataFrame([({"b": {}, "a": {"y": 2, "x": 3}},)], "m map<string, map<string, int>>")
    h = [df.select(H.record_hash(df, ["m"])).first()[0] for df in (one, two, other)]
    assert h[0] == h[1] != h[2]


def test_bundle_sizes_are_by_product(spark):
    pages = [(p, k, f"page_{k}.png") for p in "abc" for k in (1, 2)]
    assets = spark.createDataFrame(pages, "product_id string, pos int, name string")
    stats = spark.createDataFrame([(p, n, ord(p) * k) for p, k, n in pages[:-1]] + [("a", "page_1.png", 1)], "product_id string, name string, length long")
    members = D.bundle_members(assets, stats)
    assert sorted(map(tuple, members.collect()), key=str) == [(p, k, n, None if (p, k) == ("c", 2) else ord(p) * k) for p, k, n in pages]
    totals = {r.product_id: r.total_bytes for r in D.bundle_manifest(members).collect()}
    assert totals == {"a": 3 * 97, "b": 3 * 98, "c": 99}


def test_many_inline_terms(spark):
    terms = [f"term{k}" for k in range(201)]
    docs = spark.createDataFrame([(1, "has term200 and TERM7."), (2, "term2001")], "id int, text string")
    found = S.scan_banned_terms(docs, "text", ["id"], terms).collect()
    assert sorted(map(tuple, found)) == [(1, "term200"), (1, "term7")]


@pytest.mark.parametrize(
    "term, text, found",
    [
        ("battle map", "A Battle Map.", True),
        ("battle map", "battle  map, battle\nmap", False),
        ("battle map", "battle maps", False),
        ("d&d", "d&d", True),
        ("d&d", "ad&d or d&dx", False),
        ("p{x}", "p{x} p{x}y", True),
        ("p{x}", "p{x}y", False),
        ("&", "a & b", True),
        ("&", "a&b", False),
        (r"a\E b", r"see a\E b", True),
        ("one two three", "zero one two three four", True),
    ],
)
def test_phrases_settle_on_their_pieces(spark, term, text, found):
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    terms = spark.createDataFrame([(term,), (term,), ("unmet words here and more",)], "term string")
    assert [tuple(r) for r in S.scan_term_table(docs, terms, "text", "id").collect()] == [(1, term)] * found


def test_marks_in_one_join(spark):
    requests = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, False)], "id int, pack string, force boolean")
    known = spark.createDataFrame([("a", 10)], "key string, size int")
    marked = Q.mark_packs(requests, known, "pack", "key")
    assert sorted((r.id, r.known, r.size) for r in marked.collect()) == [(1, True, 10), (2, False, None), (3, False, None)]
    assert marked._jdf.queryExecution().toString().count("LogicalRDD") <= 8
    there = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert {r.id: r.decision for r in Q.mark_guarded(requests, there, "id").collect()} == {1: "accepted", 2: "rejected", 3: "accepted"}


def test_report_leaves_strangers_out(spark):
    products = spark.createDataFrame([("a",)], "product_id string")
    issues = spark.createDataFrame([("a", "warning"), ("z", "error")], "product_id string, severity string")
    report = W.review_report(products, issues, products, products, products, products).collect()
    assert [(r.product_id, r.verdict, r.warnings, r.errors) for r in report] == [("a", "pass", 1, 0)]


def test_interrupted_calls_are_not_paid_again(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    reply = '{"listings":[{"marketplace":"m","language":"en","title":"t","tags":["a"]}]}'

    def complete(df):
        def call(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(content=[reply if p != "b" or a > 1 else "no json" for p, a in zip(batch["product_id"], batch["attempt"])], raw="{}", call_error=None)

        return df.mapInPandas(call, df.withColumns({c: F.lit(None).cast("string") for c in ("content", "raw", "call_error")}).schema)

    prompts = spark.createDataFrame([(p, "s", "u") for p in "abc"], "product_id string, system string, user string")
    once = L.retry_parse(prompts, complete, L.parse_listings, str(tmp_path))
    assert once[0].count() == 3 and calls.value == 4
    again = L.retry_parse(prompts.unionByName(spark.createDataFrame([("d", "s", "u")], prompts.schema)), complete, L.parse_listings, str(tmp_path))
    assert again[0].count() == 4 and again[1].count() == 0 and calls.value == 5  # only the new one


def test_images_come_a_few_at_a_time(spark):
    class Painter:
        def generate(self, prompt, *_):
            return prompt.encode()

    rows = spark.createDataFrame([(k, str(k), "1:1", "s", "q") for k in range(50)], "id int, prompt string, aspect_ratio string, size string, quality string")
    drawn = L.generate_images(rows, Painter, parallelism=3, held_bytes=4)
    assert drawn.rdd.getNumPartitions() == 3
    assert {r.id: bytes(r.content) for r in drawn.collect()} == {k: str(k).encode() for k in range(50)}


def test_bad_yaml_is_its_own_fault(spark, tmp_path):
    for name, text in {"day": "id: x\na: 2024-13-45\n", "key": "id: x\n2024-01-02: y\n", "nan": "id: x\nv: .nan\n", "good": "id: good\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.yaml").write_text(text)
    valid, violations = packs.read_pack_configs(spark, str(tmp_path))
    assert [r.id for r in valid.collect()] == ["good"]
    assert {r.pack_dir for r in violations.collect()} == {"day", "key", "nan"}


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    assert catalog.stored(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception) as caught:
        catalog.stored(spark, str(tmp_path / "bad"), "a int").count()
    assert not isinstance(caught.value, AnalysisException) or caught.value.getCondition() != "PATH_NOT_FOUND"


def test_changed_default_language_changes_the_key():
    assert {"default_language", "schema_version"} <= set(catalog.PROFILE)


def test_a_long_term_changes_nothing(spark):
    words = [f"word{k}" for k in range(400)]
    long_term = " ".join(words[100:300])
    docs = spark.createDataFrame([(1, " ".join(words).upper()), (2, " ".join(words[101:])), (3, "no word100 here")], "id int, text string")
    terms = spark.createDataFrame([(long_term,), ("word100",), ("word7 word8",)], "term string")
    assert sorted(tuple(r) for r in S.scan_term_table(docs, terms, "text", "id").collect()) == sorted([(1, long_term), (1, "word100"), (1, "word7 word8"), (3, "word100")])
    few = S.scan_term_table(docs, terms, "text", "id", phrases=False).collect()
    assert sorted(map(tuple, few)) == [(1, "word100"), (3, "word100")]
    assert S.scan_term_table(docs, terms.filter("term = ''"), "text", "id").collect() == []


def test_pieces_of_long_texts_are_those_of_one_strip():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab_é1.,&- \n\t") for _ in range(rng.randint(0, 400))) for _ in range(40)] + ["", " \n ", "x" * 300, "a  \n b"]
    whole, strips = P.pieces_of(texts), P.pieces_of(texts, 16)
    for n in (1, 2, 5):
        assert [list(c) for c in whole.names(n)] == [list(c) for c in strips.names(n)]
    for n in (1, 3):
        want = set()
        for t, text in enumerate(texts):
            spans = [m.span() for m in re.finditer(r"\w+|[^\w \t\n]", text)]
            for k in range(len(spans) - n + 1):
                start, end = spans[k][0], spans[k + n - 1][1]
                if not re.match(r"\w", text[start - 1 : start]) and not re.match(r"\w", text[end : end + 1]):
                    want.add((t, text[start:end]))
        text, a, b = P.distinct_names(whole, n)
        assert len(set(zip(text.tolist(), a.tolist(), b.tolist()))) == len(text) == len(want)


def test_a_repeated_task_pays_for_nothing_committed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Client:
        def complete(self, system, user):
            import uuid

            (calls / uuid.uuid4().hex).write_text(user)
            if user == "u7" and len(list(calls.iterdir())) < 40:
                raise RuntimeError("busy")
            return f"{system}-{user}", {"eval_count": 1}

    prompts = spark.createDataFrame([(k, "s", f"u{k}") for k in range(30)], "id int, system string, user string").coalesce(1)
    asked = L.complete_batch(prompts, Client, ledger=str(tmp_path / "ledger"), slice_rows=5)
    first = {r.id: (r.content, r.call_error) for r in asked.collect()}
    assert first[7] == (None, "RuntimeError('busy')") and first[8] == ("s-u8", None)
    assert len(list(calls.iterdir())) == 30
    again = {r.id: (r.content, r.call_error) for r in asked.collect()}  # the slice with the failure alone
    assert len(list(calls.iterdir())) == 35 and again[8] == first[8]
    for k in range(5):
        (calls / f"more{k}").write_text("")
    assert {r.call_error for r in asked.collect()} == {None}
    count = len(list(calls.iterdir()))
    assert {r.id: r.content for r in asked.collect()} == {k: f"s-u{k}" for k in range(30)} and len(list(calls.iterdir())) == count


def test_page_ids_that_leave_their_folder_fail(spark):
    from catalogloom.operators import products as products_

    ids = ["ok", "a.b", "../x", "a/b", "..", ".", "", "a\\b", "x\0y"]
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, id string")
    pages = rows.select("k", F.array(F.to_variant_object(F.struct("id"))).alias("pages"))
    found = {r.k: r.page_error for r in products_.type_pages(pages).select("k", "page_error").collect()}
    assert [found[k] is None for k in range(len(ids))] == [True, True, False, False, False, False, False, False, False]
    assert found[2] == "invalid page field: id"


def test_code_versions_follow_the_source(monkeypatch):
    before = {stage: catalog.code_version(stage) for stage in catalog.STAGES}
    assert len(set(before.values())) == len(before)
    monkeypatch.setattr(catalog.inspect, "getsource", lambda thing, real=catalog.inspect.getsource: real(thing) + ("#" if thing is W else ""))
    after = {stage: catalog.code_version(stage) for stage in catalog.STAGES}
    assert [s for s in before if before[s] != after[s]] == ["review"]


def nodes(plan):
    while plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def test_only_names_that_terms_may_have_leave_the_texts(spark):
    words = [f"word{k}" for k in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "word7 WORD8")], "id int, text string")
    terms = spark.createDataFrame([("word7",), ("word7 word8",), ("other word",)], "term string")
    df = S.scan_term_table(docs, terms, "text", "id")
    assert sorted(tuple(r) for r in df.collect()) == [(i, t) for i in (1, 3) for t in ("word7", "word7 word8")]
    given = [n.metrics().apply("pythonNumRowsReceived").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "MapInArrow"]
    assert given and max(given) < 50


def test_every_batch_and_partition_knows_the_terms(spark):
    docs = spark.range(25_000).select("id", F.format_string("a w%d b", "id").alias("text")).filter("id < 24000").repartition(3, "id")
    docs = docs.unionByName(spark.range(3).select((F.col("id") - 9).alias("id"), F.lit("Ζς w5").alias("text")).repartition(8))
    terms = spark.range(0, 30_000, 2).select(F.format_string("w%d", "id").alias("term")).unionByName(
        spark.createDataFrame([("ζΣ w5",), ("w7 b",), ("B",)], "term string")
    )
    found = S.scan_term_table(docs, terms, "text", "id").groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("t"))
    got = {r.id: r.t for r in found.collect()}
    want = {k: sorted(["B"] + ["w7 b"] * (k == 7) + [f"w{k}"] * (k % 2 == 0)) for k in range(24_000)}
    assert got == want | {k: ["ζΣ w5"] for k in (-9, -8, -7)}


def test_marked_slots_sort_out_names_and_nothing_else():
    pieces = P.pieces_of(["one two, one two; three", "", "two one", "ſilk SILK silk".lower()])
    for n in (1, 2, 3, 9):
        every = P.distinct_names(pieces, n)
        for marked in (np.ones(64, bool), np.arange(64) % 3 == 0, np.zeros(64, bool)):
            kept = marked[(every[1] % np.uint64(64)).astype(int)]
            want = sorted(zip(*(c[kept].tolist() for c in every)))
            assert sorted(zip(*(c.tolist() for c in P.distinct_names(pieces, n, marked)))) == want
    assert len(P.distinct_names(P.pieces_of(["ſilk silk"]), 1)[0]) == 1
