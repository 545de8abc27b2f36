"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lowers case, strips invisible signs and turns homoglyphs and digit substitutes into the
letters they stand for; words with accents are looked up without them, too. The lexicon is learned: every word of the labelled training rows,
and every beginning of such words, gets a weight from how much likelier it is in toxic texts. Phrases
in which a lexicon term is harmless are exceptions and hide the term. A text's score is its weighted
hits, normalised by length, through a logistic curve fitted on the same training rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Arrow, by_bytes, stored, temporary, text_of

# What stands for which letter (fixed values): digits and signs, Cyrillic and Greek lookalikes.
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
_WORD = re.compile(r"[^\W_]+")
_EDGE_SIGNS = re.compile(r"[!|]+(?![^\W_])")  # marks at the end of a word are marks
# Soft hyphens and zero-width signs go.
_TABLE = str.maketrans(SUBSTITUTES | dict.fromkeys(map(chr, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])))
_ACCENTS = re.compile("[\u0300-\u036f]")


def fold(text: str) -> str:
    """Lower case without invisible signs, lookalikes as plain letters. Accents stay: they part words."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _EDGE_SIGNS.sub(" ", text).translate(_TABLE)


def plain(words: list[str]) -> list[str]:
    """The words without accents."""
    line = " ".join(words)
    return words if line.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFKD", line)).split(" ")


@dataclass(frozen=True)
class Lexicon:
    """``terms``: weight of each; one that ends in ``*`` stands for all words that begin so."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 1.0
    level: float = 0.0

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.level + self.slope * values, -50, 50)))


class Matcher:
    """One automaton over terms and exceptions; texts are wrapped in blanks, words in single ones."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.machine.add_word(f" {phrase} ", (phrase, None))
        for term, weight in lexicon.terms.items():
            self.machine.add_word(f" {term[:-1]}" if term.endswith("*") else f" {term} ", (term, weight))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(word number, term, weight): for each word outside exceptions the weightiest term.

        A word is looked up as it stands and without its accents.
        """
        found = {i: (t, w) for i, t, w in self._hits(words)}
        bare = plain(words)
        if bare is not words and len(bare) == len(words):
            for i, term, weight in self._hits(bare):
                if i not in found or found[i][1] < weight:
                    found[i] = (term, weight)
        return [(i, *found[i]) for i in sorted(found)]

    def _hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        if not len(self.machine) or not words:
            return []
        line = f" {' '.join(words)} "
        found, hidden = {}, []
        for end, (term, weight) in self.machine.iter(line):
            if weight is None:
                hidden.append((end - len(term) - 1, end))
            else:
                at = end - len(term) + (1 if term.endswith("*") else -1)
                if at not in found or found[at][1] < weight:
                    found[at] = (term, weight)
        for low, high in hidden:
            for at in [p for p in found if low <= p < high]:
                del found[at]
        if not found:
            return []
        starts = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        return [(int(np.searchsorted(starts, at)), *found[at]) for at in sorted(found)]


def normalised(weight: float, words: int, base: int = 200) -> float:
    """Weighted hits in a hundred words, back on the scale of logarithms by a cube root.

    A text counts as ``base`` words longer, so short ones stay calm.
    """
    return (100 * weight / (words + base)) ** (1 / 3)


def _training(docs: DataFrame, labels: DataFrame, train_if, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """Distinct (text, label) of labelled rows: copies teach nothing new.

    A label that contradicts itself counts with both its values.
    """
    chosen = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.where(F.col("label").isin(0, 1)).where(train_if(F.col("k"))).distinct()
    # ``most`` ids and labels are a few megabytes: sent to the texts, so that no text moves.
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("k"), "k", "label").limit(most))
    return docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("text")).join(chosen, "k").select("text", "label").distinct()


def learn(
    docs: DataFrame,
    labels: DataFrame,
    train_if,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    least_docs: int = 5,
    least_ratio: float = 8.0,
    least_z: float = 3.0,
    most_terms: int | None = None,
    most_labels: int = 200_000,
    exceptions: tuple[str, ...] = (),
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8),
) -> Lexicon:
    """The lexicon of the labelled rows for which ``train_if(id)`` holds, ``most_labels`` of them at most.

    More labels than that are sampled by a hash of the id; scoring is not concerned.

    A term is kept if at least ``least_docs`` toxic texts hold it, it is ``least_ratio`` times as
    likely there and the logarithm of that ratio is ``least_z`` times its standard error. All such terms stay, and all
    harmless phrases that are learned: both are bounded by the sample of labelled rows. ``most_terms`` keeps
    the weightiest only. ``exceptions`` are more phrases in which a term does no harm.
    No labelled rows, or none toxic, give an empty lexicon and a constant score.
    """
    with temporary():
        rows = stored(_training(docs, labels, train_if, id_col, text_col, label_col, most_labels))
        totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
        bad, good = totals.get(1, 0), totals.get(0, 0)
        base = math.log((bad + 0.5) / (good + 0.5))
        if not bad:
            return Lexicon({}, exceptions, 0.0, base)

        def words(batches: Arrow) -> Arrow:
            for batch in batches:
                texts, labels_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for start, end in by_bytes(texts, 1 << 20):
                    found: dict[tuple[str, int], int] = {}
                    for text, label in zip(texts[start:end], labels_[start:end]):
                        for word in set(_WORD.findall(fold(text))):
                            if len(word) > 1:
                                found[word, label] = found.get((word, label), 0) + 1
                    names, marks = zip(*found) if found else ((), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array(marks, pa.int32()), pa.array(found.values(), pa.int64())],
                        ["word", "label", "n"],
                    )

        counts = rows.mapInArrow(words, "word string, label int, n long").groupBy("word").agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"),
        )
        counts = stored(counts.where("bad > 0 or good > 1"))
        starts = counts.select(
            F.explode(F.array(*[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in beginnings])).alias("word"),
            "bad",
            "good",
        )
        starts = starts.where("word is not null").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        ratio = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        terms = (
            counts.unionByName(starts)
            .where(F.col("bad") >= least_docs)
            .where((ratio >= math.log(least_ratio)) & (ratio >= least_z * error))
            # The cube of the logarithm: one sure term outweighs a handful of chance finds.
            .withColumn("weight", F.round(ratio * ratio * ratio, 6))
            .orderBy(F.desc("weight"), F.desc("bad"), "word")
        )
        terms = (terms if most_terms is None else terms.limit(most_terms)).collect()
        lexicon = Lexicon({r["word"]: r["weight"] for r in terms}, exceptions)
        lexicon = Lexicon(lexicon.terms, (*exceptions, *_harmless_phrases(rows, lexicon, good, bad, least_docs)))
        return _fitted(rows, lexicon, base)


def _harmless_phrases(rows: DataFrame, lexicon: Lexicon, good: int, bad: int, least_docs: int) -> list[str]:
    """Two-word phrases around lexicon terms that are as usual in harmless texts as in toxic ones."""

    def phrases(batches: Arrow) -> Arrow:
        matcher = Matcher(lexicon)
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall(fold(text))
                near = {pair for i, *_ in matcher.hits(words) for pair in ((i - 1, i), (i, i + 1))}
                out += [(p, label) for p in {f"{words[a]} {words[b]}" for a, b in near if a >= 0 and b < len(words)}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["phrase", "label"]
            )

    found = rows.mapInArrow(phrases, "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")
    )
    likely = (F.col("good") + 0.5) / (good + 1) >= (F.col("bad") + 0.5) / (bad + 1)
    kept_ = found.where((F.col("good") >= least_docs) & likely).orderBy(F.desc("good"), "phrase")
    return [r["phrase"] for r in kept_.collect()]  # bounded by the labelled rows


def _values(lexicon: Lexicon, texts: list[str], matcher: Matcher) -> np.ndarray:
    out = np.zeros(len(texts))
    for row, text in enumerate(texts):
        words = _WORD.findall(fold(text))
        weight = sum(w for _, _, w in matcher.hits(words))
        out[row] = normalised(weight, len(words))
    return out


def _fitted(rows: DataFrame, lexicon: Lexicon, base: float, width: float = 0.05, bins: int = 1000) -> Lexicon:
    """Slope and level of the logistic curve, by Newton steps on counts per bin of the value."""

    def values(batches: Arrow) -> Arrow:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = _values(lexicon, batch.column(0).to_pylist(), matcher)
            bin_ = np.minimum(np.ceil(found / width), bins).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), batch.column(1)], ["bin", "label"])

    table = rows.mapInArrow(values, "bin int, label int").groupBy("bin", "label").count().collect()  # 2 * bins rows at most
    x = np.array([r["bin"] * width for r in table])
    y = np.array([r["label"] for r in table], float)
    n = np.array([r["count"] for r in table], float)
    a = np.stack([np.ones_like(x), x], 1)
    theta = np.array([base, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        slope = a.T @ (n * (y - p)) - 1e-3 * theta  # a light pull to zero: classes may part cleanly
        bend = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.terms, lexicon.exceptions, float(theta[1]), float(theta[0]))


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (score 0..1, n_hits). The lexicon is shipped with the task code.

    Null text counts as empty and gets the score of a text without hits; its row is passed on with the
    null. Repeated rows give repeated rows, an empty table an empty one. Input columns called score or
    n_hits are replaced.
    """
    columns = [c for c in docs.columns if c not in ("score", "n_hits")]
    at = columns.index(text_col)
    rows = docs.select(*columns)

    def run(batches: Arrow) -> Arrow:
        matcher = Matcher(lexicon)
        for batch in batches:
            values, hits = [], []
            for text in batch.column(at).to_pylist():
                words = _WORD.findall(fold(text or ""))
                found = matcher.hits(words)
                values.append(normalised(sum(w for _, _, w in found), len(words)))
                hits.append(len(found))
            scores = lexicon.score(np.array(values, float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(hits, pa.int64())], [*columns, "score", "n_hits"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, score double, n_hits long")


def predicted():
    return F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")


def held_out(key):
    """A fifth of the ids, by the checksum of their text form."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train_rows(key):
    return ~held_out(key)
