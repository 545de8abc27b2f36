from helpers import prose, reachable

import corpus_pipeline
from catalogloom.llm import jaccard_join, line_dedup, suffix_dedup, toxicity
from catalogloom.llm.queries import QUERIES, SQL

import oracle

SF = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    con = oracle.connect(SF)
    for name, sql in SQL.items():
        problems, rows = oracle.compare(spark, con, oracle_query(QUERIES[name], sql), SF)
        assert not problems and rows, (name, problems)


class oracle_query:
    def __init__(self, run, sql):
        self.run, self.sql = run, sql


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = docs.count(), stage(spark, docs, SF).cache()
        assert kept.dtypes == docs.dtypes
        ids = kept.select("doc_id")
        assert ids.join(docs, "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.train_rows)
            assert kept.count() == toxicity.scored(docs, lexicon).where("score < 0.5").count()
        elif name == "jaccard_join":
            joined = jaccard_join.join_documents(docs)
            assert kept.count() == joined.where("kept").count() == joined.select("component_id").distinct().count()
        else:
            assert kept.count() == before
        if name == "line_dedup":
            assert kept.exceptAll(line_dedup.drop_lines(docs).withColumn("n_chars", kept_length()).select(*docs.columns)).count() == 0
        if name == "suffix_dedup":
            removed = suffix_dedup.remove_repeats(docs, whole_characters=True).where("n_removed > 0").count()
            assert docs.select("doc_id", "text").exceptAll(kept.select("doc_id", "text")).count() == removed
        docs = kept
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def kept_length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, n_bytes string, kept string, text_key int, rest0 string, `odd name` string"


def odd_table(spark):
    """Null ids and texts, empty, long and repeated rows, near copies, and names that operators use."""
    base, other = prose(1, 80), prose(2, 80)
    texts = [(1, base), (1, base), (3, base + " end"), (None, base), (None, base), (None, other), (5, other + " end"), (5, other + " end"), (5, prose(3, 50))]
    texts += [(6, None), (7, ""), (None, None), (8, prose(4, 9000)), (9, prose(4, 9000)), (9, None)]
    texts += [(20 + i, f"{prose(50 + i, 40)}\nPosted by {n} Brown") for i, n in enumerate("Anna Bela Cora Dina Edda Fina".split())]
    texts += [(40, prose(60, 30) + " " + prose(61, 60)), (41, prose(61, 60) + " " + prose(62, 30))]
    return texts, spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", 1, "b", "c", 2, "d", "e") for i, t in texts], SCHEMA)


def brute_near(rows):
    """One row per component of exact Jaccard similarity and per equal row."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in distinct]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    label = reachable(range(len(sets)), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    return [distinct[k][0] for k in range(len(sets)) if label[k] == k]


def test_stages_on_odd_rows(spark):
    texts, docs = odd_table(spark)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert rows(corpus_pipeline.drop_toxic(spark, docs, SF)) == sorted(texts, key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        for r in found.collect():
            assert (r["score"], r["n_lines"], r["n_bytes"], r["kept"], r["text_key"], r["rest0"], r["odd name"]) == ("a", 1, "b", "c", 2, "d", "e")
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    lines = rows(corpus_pipeline.drop_lines(spark, docs, SF))
    assert lines == sorted(((i, t if t is None else t.split("\nPosted")[0]) for i, t in texts), key=str)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted(brute_near(texts), key=str)
    cleaned = dict(rows(corpus_pipeline.drop_repeats(spark, docs.where("doc_id in (40, 41)"), SF)))
    assert cleaned[40] == dict(texts)[40] and prose(61, 60) not in cleaned[41]
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("start = 0").count() == len(texts) and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_only_one_of_all_copies_reaches_packing(spark):
    texts, docs = odd_table(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    found = docs.collect()
    assert sum((r["text"] or "").startswith(prose(1, 80)) for r in found) == 1
    assert sum(not r["text"] for r in found) == 1 and sum((r["text"] or "").startswith(prose(2, 80)) for r in found) == 1
