"""Line dedup by a tree of line templates.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens. Tokens that hold
digits or look like addresses are variable fields and become "<*>". A leaf whose lines differ is
generalised: lines that agree but for one run of tokens share the template in which this run is a
variable field. Lines of a leaf that differ in more places have no template in common. A template recurs
if it is met in enough documents that are otherwise different; its lines are dropped wherever they
stand. Copies of one document do not make its lines recur: each group of near copies counts once,
whatever its size, and does not keep a line that other documents hold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Arrow, stored, temporary, text_of
from .jaccard_join import join_documents, mixed

FIELD = "<*>"
_VARIABLE = re.compile(r"\d|@|://|www\.")
_DIGIT = re.compile(r"\d")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def masked(line: str) -> list[str]:
    """Tokens of a line, variable fields as ``FIELD``."""
    if not (_DIGIT.search(line) or "@" in line or "://" in line or "www." in line):
        return line.split()
    return [FIELD if _VARIABLE.search(t) else t for t in line.split()]


def leading(n: int, depth: int) -> int:
    """How many leading tokens of a line of ``n`` never vary: ``depth``, a quarter of long lines, 6 at most."""
    return max(depth, min(6, n // 4))


def as_is(line: str, tokens: list[str]) -> str:
    """The template of a line that is not generalised. One of fields alone recurs only as it stands."""
    if tokens.count(FIELD) == len(tokens):
        return f"{len(tokens)} as is {' '.join(line.split())}"
    return f"{len(tokens)} {' '.join(tokens)}"


def _name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def run_names(tokens: list[str], depth: int, longest: int, hashes: dict[str, int]) -> np.ndarray:
    """Names of the templates of a line in which one run of up to ``longest`` tokens is a field.

    The tokens that lead to the leaf (``leading``) stay, and at least half of all tokens are neither in the run nor fields.
    """
    n = len(tokens)
    codes = np.array([hashes[t] for t in tokens], np.uint64)
    powers = np.full(n, _STEP, np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
    plain = np.concatenate([[0], np.cumsum([t != FIELD for t in tokens])])
    out = []
    for size in range(1, longest + 1):
        start = np.arange(leading(n, depth), n - size + 1)
        fixed = plain[n] - (plain[start + size] - plain[start])
        start = start[2 * fixed >= n]
        rest = sums[n] - (sums[start + size] - sums[start])
        place = mixed((np.uint64(n) << np.uint64(32)) + (start.astype(np.uint64) << np.uint64(8)) + np.uint64(size))
        out.append(mixed(rest ^ place))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _lines(rows: DataFrame, depth: int) -> DataFrame:
    """(text_key, check, line, name, leaf) of every line that is not blank."""

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            out: list[tuple] = []
            for key, check, text in zip(*(batch.column(c).to_pylist() for c in ("text_key", "check", "text"))):
                for number, line in enumerate(text.split("\n")):
                    if tokens := masked(line):
                        n = len(tokens)
                        leaf = _name(f"{n} {' '.join(tokens[: leading(n, depth)])}")
                        out.append((key, check, number, _name(as_is(line, tokens)), leaf))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text_key", "check", "line", "name", "leaf"])

    schema = "text_key long, check long, line int, name long, leaf long"
    return rows.select("text_key", "check", "text").mapInArrow(run, schema)


def _generalised(texts: DataFrame, depth: int, longest: int) -> DataFrame:
    """(name, runs) of the lines of (text, chosen) that are numbered in chosen: their names as they are and generalised."""

    def run(batches: Arrow) -> Arrow:
        hashes: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for text, chosen in zip(*(batch.column(c).to_pylist() for c in ("text", "chosen"))):
                lines = text.split("\n")
                for number in chosen:
                    tokens = masked(lines[number])
                    if len(tokens) <= depth:
                        continue
                    if len(hashes) > 1 << 18:
                        hashes.clear()
                    for t in tokens:
                        if t not in hashes:
                            hashes[t] = xxhash.xxh3_64_intdigest(t)
                    if len(runs := run_names(tokens, depth, longest, hashes)):
                        out.append((_name(as_is(lines[number], tokens)), runs))
            columns = list(zip(*out)) or [()] * 2
            kinds = [pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "runs"])

    return texts.select("text", "chosen").mapInArrow(run, "name long, runs array<long>")


def _in_live_leaves(lines: DataFrame, least_docs: int) -> DataFrame:
    """The lines in leaves with ``least_docs`` lines or more, and whether those differ (``differ``).

    Equal lines share a leaf, so no line of another leaf recurs; most leaves hold a single line.
    """
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), (F.min("name") < F.max("name")).alias("differ"))
    return lines.join(stored(leaves.where(F.col("n") >= least_docs).select("leaf", "differ")), "leaf")


def _shared(lines: DataFrame, key: str, least_docs: int) -> DataFrame:
    """(key, text_key), each once, of the lines whose key is met in ``least_docs`` different texts."""
    often = lines.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(key)
    met = stored(lines.select(key, "text_key").join(stored(often), key, "left_semi").distinct())
    enough = met.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(key)
    return met.join(stored(enough), key, "left_semi").withColumnRenamed(key, "key")


def _kin(texts: DataFrame) -> DataFrame:
    """(text_key, kin): the verified group of every one of the different texts that has near copies."""
    joined = join_documents(texts.withColumnRenamed("text_key", "id"), id_col="id")
    return joined.where("n_links > 0").select(F.col("id").alias("text_key"), F.col("component_id").alias("kin"))


def _recurring(met: DataFrame, kin: DataFrame, least_docs: int) -> DataFrame:
    """(key): keys of (key, text_key) met in ``least_docs`` documents or more, near copies counted as one."""
    group = met.join(kin, "text_key", "left").select("key", F.coalesce("kin", "text_key").alias("kin")).distinct()
    return group.groupBy("key").agg(F.count("*").alias("groups")).where(F.col("groups") >= least_docs).select("key")


def _runs(lines: DataFrame, rows: DataFrame, depth: int, longest: int) -> DataFrame:
    """(name, run): the generalised names of each of the different lines, read off one text that holds it."""
    first = lines.groupBy("name").agg(F.min(F.struct("text_key", "check", "line")).alias("at")).select("at.*")
    chosen = stored(first.groupBy("text_key", "check").agg(F.collect_set("line").alias("chosen")))
    texts = rows.join(chosen, ["text_key", "check"])  # copies give the same names again
    return _generalised(texts, depth, longest).select("name", F.explode("runs").alias("run")).distinct()


def drop_lines(
    docs: DataFrame,
    least_docs: int = 5,
    depth: int = 2,
    longest: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs``, the text without lines of recurring templates, and (n_lines, n_dropped).

    Lines are what line feeds part; the others keep their order and their bytes. Blank lines are never
    dropped, lines of variable fields alone only as they stand. Beyond fields of digits and addresses, one
    run of up to ``longest`` tokens may vary after the leading ``depth`` (a quarter of longer lines, 6 at
    most); half of the tokens must not.

    A template recurs in ``least_docs`` documents, each group of near copies counting as one: a component
    of Jaccard similarity 0.8 among the texts with a line that ``least_docs`` texts hold as it is, or with
    one in a leaf of so many texts whose lines differ. Other texts decide nothing and are not compared.

    Null text stays null, without lines. Rows repeating an id or a text are cleaned alike, row by row;
    a null id is passed on; an empty table gives an empty one. Input columns called n_lines or
    n_dropped are replaced. Texts go by two 64-bit hashes.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = text_of(text_col)
    keys = [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("check")]
    rows = docs.select(*keys, text.alias("text"))
    with temporary():
        lines = stored(_in_live_leaves(stored(_lines(rows, depth)), least_docs))
        exact, leaves = stored(_shared(lines, "name", least_docs)), stored(_shared(lines.where("differ"), "leaf", least_docs))
        compared = exact.select("text_key").unionByName(leaves.select("text_key")).distinct()
        texts = rows.select("text_key", "text").join(compared, "text_key", "left_semi").dropDuplicates(["text_key"])
        kin = _kin(stored(texts))
        exact = _recurring(exact, kin, least_docs)
        # Elsewhere a generalised template can hold no more than the line itself.
        leaves = stored(_recurring(leaves, kin, least_docs).withColumnRenamed("key", "leaf"))
        names = stored(exact.withColumnRenamed("key", "name"))
        runs = stored(_runs(lines.join(leaves, "leaf", "left_semi"), rows, depth, longest))
        # What a line that recurs is generalised to recurs, too; for the others documents are counted.
        sure = runs.join(names, "name", "left_semi").select(F.col("run").alias("key"))
        met = lines.select("name", "text_key").join(names, "name", "left_anti").join(runs, "name").select("run", "text_key")
        often = sure.unionByName(_recurring(_shared(stored(met), "run", least_docs), kin, least_docs)).distinct()
        general = runs.join(stored(often).withColumnRenamed("key", "run"), "run", "left_semi").select("name")
        hit = lines.join(stored(names.unionByName(general).distinct()), "name", "left_semi")
        gone = stored(hit.groupBy("text_key", "check").agg(F.collect_set("line").alias("gone")), outlive=True)
    # The row travels as one column, so that no name of its own clashes with a helper's.
    joined = docs.select(F.struct(*kept).alias("row"), *keys).join(gone.hint("merge"), ["text_key", "check"], "left")
    return _rebuilt(joined, docs.select(*kept), text_col)


def _rebuilt(joined: DataFrame, shape: DataFrame, text_col: str) -> DataFrame:
    columns = shape.columns
    at = columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema)

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            texts, sizes, dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                lines, gone = (text.split("\n") if text is not None else []), set(gone or ())
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
                sizes.append(len(lines))
                dropped.append(len(gone))
            arrays = list(batch.columns)[: len(columns)]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], [*columns, "n_lines", "n_dropped"])

    flat = joined.select(*[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(columns)], "gone")
    return flat.mapInArrow(run, f"{fields}, n_lines long, n_dropped long")
