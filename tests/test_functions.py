"""Text, geometry, hashing and contract expressions against small models of the wanted behaviour."""

import hashlib
import json
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from catalogloom.functions import contracts as C
from catalogloom.functions import geometry as G
from catalogloom.functions import hashing as H
from catalogloom.functions import text as T


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", expr.alias("out")).orderBy("i").select("out").collect()]


def test_slugify(spark):
    cases = ["--Ñandú & DRAGONS!! 2--", "!!!", "", "A b_c", "İstanbul"]
    assert values(spark, cases, T.slugify(F.col("v"))) == ["and-dragons-2", "product", "product", "a-b-c", "i-stanbul"]
    assert values(spark, ["a--b c", "!!"], T.slugify(F.col("v"), keep_hyphen=True, fallback=None)) == ["a--b-c", ""]


def test_split_list(spark):
    assert values(spark, [" en, es,,fr ", "", ",", None], T.split_list(F.col("v"))) == [["en", "es", "fr"], [], [], None]


def fence_model(text):
    found = re.search(r"```(?:json)?\s*(.*?)\s*```", text.strip(), re.DOTALL)
    return found.group(1).strip() if found else text.strip()


FENCES = [
    "a ```json\n{}\n``` b ```x```", "``````", "```json```", "plain", "  x\n", "```open", "```` `x```", "```jsonx```", " x　",
]


def test_strip_json_fence(spark):
    assert values(spark, FENCES, T.strip_json_fence(F.col("v"))) == [fence_model(t) for t in FENCES]


PIECES = st.lists(st.sampled_from(["```", "json", "`", "\n", " ", "{}", "x", " ", "\x1f"]), max_size=10).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=40))
def test_strip_json_fence_model(spark, texts):
    assert values(spark, texts, T.strip_json_fence(F.col("v"))) == [fence_model(t) for t in texts]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aZé9 -_!ßŁ\n", max_size=12), min_size=1, max_size=40))
def test_slugify_model(spark, texts):
    want = [re.sub(r"[^a-z0-9]+", "-", t.lower()).strip("-") or "product" for t in texts]
    assert values(spark, texts, T.slugify(F.col("v"))) == want


def test_path_parts(spark):
    paths = ["a/b/c.json", "x.y.png", "a/.hidden", "noext"]
    assert values(spark, paths, T.file_stem(F.col("v"))) == ["c", "x.y", ".hidden", "noext"]
    assert values(spark, paths, T.file_name(F.col("v"))) == ["c.json", "x.y.png", ".hidden", "noext"]


def test_rounding_to_even(spark):
    assert values(spark, [2.5, 3.5, 0.5, 1.4], G.to_pixels(F.col("v"), 1), "v double") == [2, 4, 0, 1]


def crop_model(w, h, tw, th):
    if w / h > tw / th:
        new = int(round(h * (tw / th)))
        return ((w - new) // 2, 0, new, h)
    new = int(round(w / (tw / th)))
    return (0, (h - new) // 2, w, new)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.integers(1, 4000)] * 4), min_size=1, max_size=60))
def test_crop_box_model(spark, boxes):
    expr = G.crop_box(F.col("w"), F.col("h"), F.col("tw"), F.col("th"))
    got = values(spark, boxes, expr, "w bigint, h bigint, tw bigint, th bigint")
    assert [tuple(r) for r in got] == [crop_model(*b) for b in boxes]


def test_crop_box_example(spark):
    got = values(spark, [(1024, 1024, 2550, 3300)], G.crop_box(*[F.col(c) for c in "abcd"]), "a int, b int, c int, d int")
    assert tuple(got[0]) == (116, 0, 791, 1024)


STRICT = [
    '{}', ' {"a":1} ', '[1,2]', '"x"', '3', 'null', '{} trailing', '{} {}', '{},{}', '', '{"a":}', '{}]', '}{', '{}],[{}', "{'a':1}", '{"a":1,}',
]


def loads(text):
    try:
        json.loads(text)
        return True
    except json.JSONDecodeError:
        return False


def test_strict_json(spark):
    assert values(spark, STRICT, C.strict_json(F.col("v")).isNotNull()) == [loads(t) for t in STRICT]


def test_fields(spark):
    docs = ['{}', '{"k":null}', '{"k":"7"}', '{"k":7}', '{"k":7.0}', '{"k":7.5}', '{"k":true}', '{"k":["a"]}', '{"k":{"a":"b"}}', '{"k":[1]}', '{"k":"x"}']
    k = C.member(F.try_parse_json(F.col("v")), "k")

    def run(field):
        return values(spark, docs, F.when(field.ok, F.coalesce(field.value.cast("string"), F.lit("none"))).otherwise("bad"))

    assert run(C.text_field(k, F.lit("d"))) == ["d", "bad", "7", "bad", "bad", "bad", "bad", "bad", "bad", "bad", "x"]
    assert run(C.int_field(k, F.lit(0))) == ["0", "bad", "7", "7", "7", "bad", "1", "bad", "bad", "bad", "bad"]
    assert run(C.number_field(k, F.lit(0.0))) == ["0.0", "bad", "7.0", "7.0", "7.0", "7.5", "1.0", "bad", "bad", "bad", "bad"]
    assert run(C.text_list_field(k, F.array().cast("array<string>"))) == ["[]", "bad", "bad", "bad", "bad", "bad", "bad", "[a]", "bad", "bad", "bad"]
    assert run(C.text_map_field(k, F.expr("cast(map() as map<string,string>)"))) == ["{}"] + ["bad"] * 7 + ["{a -> b}", "bad", "bad"]


def test_node_key_ignores_input_order(spark):
    rows = [("h1", "h2"), ("h2", "h1"), ("h1", None)]
    key = H.node_key(F.lit("c"), F.lit("p"), F.lit("g"), [F.col("a"), F.col("b")])
    got = values(spark, rows, key, "a string, b string")
    assert got[0] == got[1] == hashlib.sha256(b"c|p|g|h1|h2").hexdigest()
    assert got[2] == hashlib.sha256(b"c|p|g|h1").hexdigest()
    assert values(spark, ["x"], H.node_key(F.lit("c"), F.lit("p"), F.lit("g"), []))[0] == hashlib.sha256(b"c|p|g").hexdigest()


def test_record_hash_ignores_field_and_entry_order(spark):
    one = spark.sql("select named_struct('b', 1, 'a', map('x', 1, 'y', 2)) as s, null as n")
    two = spark.sql("select named_struct('a', map('y', 2, 'x', 1), 'b', 1) as s, null as n")
    first, second = (df.select(H.record_hash(df, ["s", "n"])).first()[0] for df in (one, two))
    assert first == second
    other = spark.sql("select named_struct('a', map('y', 2, 'x', 3), 'b', 1) as s, null as n")
    assert other.select(H.record_hash(other, ["s", "n"])).first()[0] != first


def test_files_digest(spark):
    def digest(rows, slices):
        df = spark.createDataFrame(rows, "g string, p string, h string").repartition(slices)
        return {r.g: r.digest for r in H.files_digest(df, ["g"], "p", "h").collect()}

    base = [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x")]
    assert digest(base, 1) == digest(base[::-1], 3)
    swapped = [("a", "1", "y"), ("a", "2", "x"), ("b", "1", "x")]
    assert digest(swapped, 1)["a"] != digest(base, 1)["a"]
    assert digest(base + base[:1], 1)["a"] != digest(base, 1)["a"]


def test_once_keeps_structs_usable(spark):
    df = spark.sql("select 1 as k, named_struct('a', named_struct('b', array('x'))) as s, '{\"p\":1}' as t")
    step = C.once(C.once(df, v=F.try_parse_json("t")), w=C.member(F.col("v"), "p"))
    row = step.filter(F.col("w").isNotNull()).select("k", "s.a.b", F.try_variant_get("w", "$", "int").alias("p")).first()
    assert (row.k, row.b, row.p) == (1, ["x"], 1)


def test_once_is_computed_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    plan = C.once(df, v=F.sha2("t", 256)).filter(F.col("v") > "5").select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") == 1


@pytest.mark.parametrize("name,twin", [("s", "ſ"), ("i", "ı"), ("i", "İ"), ("K", "K"), ("Σ", "ς"), ("É", "é")])
def test_fold_case(spark, name, twin):
    a, b = values(spark, [name, twin], T.fold_case(F.col("v")))
    assert a == b
