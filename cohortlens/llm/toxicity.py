"""Toxicity scores: boosted trees over dense features of the text, calibrated isotonically.

A lexicon of insults is widened by words and beginnings of words that a part of the labelled
rows shows to be typical of toxic texts. Features are rates of what it finds, how close that
stands to the second person, and how the text is written. Trees are fitted on another part
of the labelled rows, the calibration on a third.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from cohortlens.llm.arrow import append_columns, coded, list_array, released, ship, slices
from cohortlens.llm.units import summed
from cohortlens.session import durable

#: Labelled rows that are learned from, at most; those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: Entries of the learned lexicon, at most.
LEXICON_ENTRIES = 2_000
#: Training texts that show an entry, at least, and by how much (log of the odds ratio).
ENTRY_TEXTS, ENTRY_ODDS = 4, 3.5
#: Tokens on either side that count as near.
NEAR = 4
#: Tokens a task remembers.
MEMO_TOKENS = 200_000

#: Insults in any case; the learned entries come on top.
INSULTS = frozenset("""
clown disgusting dumb fool garbage idiot idiotic loser moron moronic pathetic scum stupid trash
ugly useless vermin worthless
arschloch dreckig dumm idioten abschaum versager
abruti débile imbécile ordure pourri
basura estúpido imbécil inútil idiota
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre
vos tú ti tus usted ustedes vosotros
""".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¡¿“”„’‘…"

FEATURES = [
    "insult_rate", "insult_count", "learned_rate", "learned_count", "learned_weight", "near_rate",
    "near_count", "second_person_rate", "capital_rate", "caps_word_rate", "punctuation_rate",
    "exclamation_rate", "disguised_rate", "mixed_rate", "single_rate", "words",
]


def beginnings(word: str) -> list[str]:
    """What of a word may stand in the learned lexicon: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6, 7) if len(word) > n)]


def _core(token: str) -> str:
    return token.strip(_EDGES).lower()


class Features:
    """Dense features of texts by a lexicon of learned entries and their weights."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 12))

    def _describe(self, token: str) -> list[float]:
        core = _core(token)
        plain = core in INSULTS
        weight = max((self.learned.get(b, 0.0) for b in beginnings(core)), default=0.0) if core else 0.0
        letters = sum(map(str.isalpha, token))
        marks = len(token) - sum(map(str.isalnum, token))
        mixed = letters > 0 and core.isascii() and not core.isalpha() and len(core) > 2
        bare = "".join(c for c in core.translate(_LEET) if c.isalpha()) if mixed else core
        disguised = mixed and (bare in INSULTS or bare in self.learned)
        return [
            plain, weight > 0, weight, core in SECOND_PERSON, letters, sum(map(str.isupper, token)),
            len(core) > 1 and letters > 1 and token.isupper(), marks, token.count("!"), disguised,
            mixed, len(core) == 1,
        ]

    def _known(self, tokens: list[str]) -> np.ndarray:
        if len(self.rows) > MEMO_TOKENS:
            self.rows.clear()
        new = [t for t in tokens if t not in self.rows]
        need = len(self.rows) + len(new)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), self.table.shape[1]), self.table.dtype)
            grown[: len(self.table)] = self.table
            self.table = grown
        if new:
            at = len(self.rows)
            self.table[at : at + len(new)] = np.array([self._describe(t) for t in new])
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """One row of ``FEATURES`` per text; zeros for one without tokens."""
        tokens = coded(pc.ascii_split_whitespace(texts))
        rows = self._known(tokens.words.to_pylist())[tokens.codes]
        values, starts = self.table[rows], tokens.starts
        n = np.diff(starts)
        sums = np.stack([summed(values[:, k], starts) for k in range(values.shape[1])], 1)
        hit = (values[:, 0] > 0) | (values[:, 1] > 0) | (values[:, 9] > 0)
        second = np.concatenate([[0], np.cumsum(values[:, 3])])
        first = np.repeat(starts[:-1], n)
        last = np.repeat(starts[1:], n)
        at = np.arange(len(rows))
        near = second[np.minimum(at + NEAR + 1, last)] - second[np.maximum(at - NEAR, first)] > 0
        near = summed((hit & near).astype(float), starts)
        hits = summed(hit.astype(float), starts)
        words, letters = np.maximum(n, 1), np.maximum(sums[:, 4], 1)
        chars = np.maximum(sums[:, 4] + sums[:, 7], 1)
        single = summed(values[:, 11], starts)
        return np.stack([
            sums[:, 0] / words, np.log1p(sums[:, 0]), sums[:, 1] / words, np.log1p(sums[:, 1]),
            sums[:, 2] / np.maximum(sums[:, 1], 1), near / np.maximum(hits, 1), np.log1p(near),
            sums[:, 3] / words, sums[:, 5] / letters, sums[:, 6] / words, sums[:, 7] / chars,
            sums[:, 8] / chars, sums[:, 9] / words, sums[:, 10] / words, single / words, np.log1p(n),
        ], 1)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0)) == 0


def labelled_sample(labels: DataFrame, rows: int, id_col: str, label: str) -> DataFrame:
    """``id, label, part`` of at most ``rows`` labelled rows outside the held-out fold.

    Parts 0 to 4 by hash: 0 and 1 for the lexicon, 2 and 3 for the trees, 4 for the
    calibration. An id with several labels counts as its largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(rows)
    return durable(known.select("id", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).alias("part")))


def learn_lexicon(texts: DataFrame, text: str = "text", entries: int = LEXICON_ENTRIES) -> dict[str, float]:
    """Entries typical of rows with ``label`` 1 among ``text, label``, with their log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = sorted({k for k, _ in counts})
            columns = [pa.array([counts[k, v] for k in keys], pa.int64()) for v in (1, 0)]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], ["entry", "toxic", "clean"])

        for batch in batches:
            for part in slices(batch, text):
                for t, label in zip(part.column(text).to_pylist(), part.column("label").to_pylist(), strict=True):
                    words = {_core(w) for w in (t or "").split()} - {""}
                    counts.update((b, label) for b in {b for w in words for b in beginnings(w)})
                    if len(counts) > 200_000:
                        yield flush()
        yield flush()

    ship(texts.sparkSession)
    total = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return {}
    found = texts.select(text, "label").mapInArrow(released(run), "entry string, toxic long, clean long")
    found = found.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = found.where(F.col("toxic") >= ENTRY_TEXTS).withColumn("odds", odds)
    found = found.where(F.col("odds") >= ENTRY_ODDS).orderBy(F.desc("toxic"), "entry").limit(entries)
    return {r.entry: r.odds for r in found.collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration; without trees a constant score."""

    def __init__(self, learned: dict[str, float], trees: Model | None, calibration: Model | None, rate: float):
        self.learned, self.trees, self.calibration, self.rate = learned, trees, calibration, rate

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with ``score`` from 0 to 1 in place of the feature column."""
        if self.trees is None:
            return features.withColumn("score", F.lit(self.rate)).drop("features")
        out = features.withColumn("vector", array_to_vector("features"))
        out = self.trees.setFeaturesCol("vector").setPredictionCol("tree_label").transform(out)
        out = out.withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is not None:
            out = self.calibration.setFeaturesCol("raw").setPredictionCol("score").transform(out)
        else:
            out = out.withColumn("score", F.col("raw"))
        out = out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
        return out.drop("features", "vector", "rawPrediction", "probability", "tree_label", "raw")


def featured(docs: DataFrame, learned: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each row with ``features``, an array in the order of ``FEATURES``."""

    def make():
        features = Features(learned)

        def run(texts: pa.Array) -> list[pa.Array]:
            matrix = features.matrix(texts)
            starts = np.arange(len(texts) + 1) * len(FEATURES)
            return [list_array(matrix.reshape(-1), starts, pa.float64())]

        return run

    return append_columns(docs, make, [StructField("features", ArrayType(DoubleType()))], keep, text)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", sample_rows: int = SAMPLE_ROWS, trees: int = 25,
) -> ToxicityModel:
    """Learn from the texts of at most ``sample_rows`` labelled rows outside the held-out fold.

    Rows without a label, an id or a text to join are not used; of equal ids every text is.
    With fewer than two classes in what the trees see, the score is the share of label 1
    (0 without labels).
    """
    sample = labelled_sample(labels, sample_rows, id_col, label)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # the sample is bounded by its parameter: a broadcast, and no text is moved
    rows = rows.join(F.broadcast(sample), "id")
    learned = learn_lexicon(rows.where("part < 2"))
    known = durable(featured(rows.where("part >= 2"), learned, ["label", "part"]))
    counts = {(r.calibrate, r.label): r.n for r in known.groupBy((F.col("part") == 4).alias("calibrate"), "label")
              .agg(F.count("*").alias("n")).collect()}
    ones = sum(n for (_, v), n in counts.items() if v == 1)
    rate = ones / max(1, sum(counts.values()))
    if not all(counts.get((False, v)) for v in (0, 1)):
        return ToxicityModel(learned, None, None, rate)
    known = known.select("part", F.col("label").cast("double"), array_to_vector("features").alias("vector"))
    known = known.coalesce(4).cache()  # bounded by sample_rows
    booster = GBTClassifier(
        featuresCol="vector", labelCol="label", predictionCol="tree_label", maxIter=trees, maxDepth=3,
        stepSize=0.2, minInstancesPerNode=5, seed=8, cacheNodeIds=False,
    )
    model, calibration = booster.fit(known.where("part < 4")), None
    if all(counts.get((True, v), 0) >= 5 for v in (0, 1)):
        raw = model.transform(known.where("part = 4")).withColumn("raw", vector_to_array("probability")[1])
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    known.unpersist()
    return ToxicityModel(learned, model, calibration, rate)


def score(
    docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``keep`` of each row with ``score``, the calibrated chance of label 1.

    A null or empty text has features of zero and a score like any other; an empty table
    gives an empty one; repeated rows are scored alike; an input column named ``score`` or
    ``features`` is replaced. Only the text enters a score.
    """
    model = fit(docs, labels, id_col, text, label, sample_rows)
    return model.score(featured(docs, model.learned, [c for c in keep if c != "score"], text))
