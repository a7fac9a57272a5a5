"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows used for fitting are bounded: ``SAMPLE_ROWS`` documents, drawn by a hash of their
id. A lexicon of words and word beginnings is counted in Spark, once for each half of the sample. The
features of a row come from the lexicon of the other half, so that hits are as frequent as in unseen
texts, and calibration uses predictions of trees grown on the other half. The final lexicon and
trees use the whole sample. Scoring is one pass over all whole texts in Arrow batches, with the
lexicon and the trees, both of bounded size, sent to the tasks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from utterscope.llm.common import save, slices, small_batches

#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Entries of the learned lexicon, at most; toxic texts that hold an entry, at least; and the least
#: logarithm of the ratio of its frequencies in toxic and other texts, less ``CERTAINTY`` standard errors.
LEXICON, MIN_TOXIC, MIN_WEIGHT, CERTAINTY = 1000, 4, 1.6, 1.5
#: Lengths of word beginnings in the lexicon.
BEGINNINGS = range(3, 8)
DECISION = 0.7
TREES, DEPTH, RATE, BINS = 40, 3, 0.25, 32
# General insults, before anything is learned.
SEED_WORDS = """idiot moron stupid loser dumb fool scum trash pathetic worthless disgusting jerk clown imbecile
    bastard bitch asshole cretin retard vermin filth freak coward liar""".split()
# Second-person words in English, German, French and Spanish.
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous
    votre vos ti usted ustedes vosotros vuestra vuestro""".split()
NEAR = 5
_LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
FEATURES = (
    "lexicon density", "lexicon hits", "weight density", "total weight", "largest weight", "beginnings density",
    "near second person", "second person density", "capitals", "words in capitals", "punctuation",
    "exclamations", "obfuscated words", "lexicon hits when deobfuscated",
)


def is_held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _word_facts(word: str, words: dict[str, float], beginnings: dict[str, float]) -> tuple:
    """What one word adds: see the columns in :func:`features`."""
    core = word.strip(_EDGES)
    lowered = core.lower()
    hit = words.get(lowered, 0.0)
    start = max(beginnings.get(lowered[:k], 0.0) for k in BEGINNINGS if k == 3 or k <= len(lowered))
    obfuscated = deobfuscated = 0.0
    if lowered and not lowered.isalpha():
        letters = sum(c.isalpha() for c in lowered)
        if letters and not lowered.isdigit():
            inner = any(not c.isalpha() and c not in "'-’" for c in lowered)
            obfuscated = float(inner and letters * 2 >= len(lowered))
            plain = re.sub(r"[^a-z]", "", lowered.translate(_LOOKALIKES))
            deobfuscated = float(plain in words and not hit)
    capitals = sum(c.isupper() for c in word)
    return (
        float(hit > 0), hit, float(start > 0 and hit == 0), start, float(lowered in _SECOND), capitals,
        float(len(core) > 1 and capitals == len(core)), sum(c in _EDGES for c in word), word.count("!"),
        obfuscated, deobfuscated, len(word),
    )


_SECOND = frozenset(SECOND_PERSON)


def features(texts: pa.Array, words: dict[str, float], beginnings: dict[str, float]) -> np.ndarray:
    """One row of :data:`FEATURES` per text, taken a few megabytes of text at a time."""
    parts = [_features(texts[part], words, beginnings) for part in slices(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


def _features(texts: pa.Array, words: dict[str, float], beginnings: dict[str, float]) -> np.ndarray:
    """One row of :data:`FEATURES` per text; zeros for a null, empty or blank one."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    filled = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(filled), owner.filter(filled).to_numpy()
    n = len(texts)
    coded = flat.dictionary_encode()
    facts = np.array(
        [_word_facts(w, words, beginnings) for w in coded.dictionary.to_pylist()], np.float64
    ).reshape(-1, 12)
    codes = coded.indices.to_numpy()
    count = np.maximum(1, np.bincount(owner, minlength=n))
    total = lambda column: np.bincount(owner, facts[codes, column], minlength=n)
    hits, weight, starts, start_weight = (total(c) for c in range(4))
    largest = np.zeros(n)
    marked = np.flatnonzero((facts[codes, 0] > 0) | (facts[codes, 2] > 0))
    np.maximum.at(largest, owner[marked], np.maximum(facts[codes[marked], 1], facts[codes[marked], 3]))
    near = np.zeros(n)
    spoken = np.flatnonzero(facts[codes, 4] > 0)
    if len(spoken) and len(marked):
        right = np.searchsorted(spoken, marked)
        for side in (np.minimum(right, len(spoken) - 1), np.maximum(right - 1, 0)):
            other = spoken[side]
            close = (np.abs(other - marked) <= NEAR) & (owner[other] == owner[marked])
            np.add.at(near, owner[marked[close]], 1.0)
    letters = np.maximum(1, total(11))
    return np.column_stack(
        [
            hits / count, np.log1p(hits + starts), (weight + start_weight) / count,
            np.log1p(weight + start_weight), largest, starts / count,
            near / np.maximum(1, hits + starts), total(4) / count, total(5) / letters, total(6) / count,
            total(7) / letters, total(8) / count, total(9) / count, total(10) / count,
        ]
    )


class Trees:
    """Logistic gradient boosting with histogram splits; a few dozen small trees."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(rate / (1 - rate))
        self.trees, score = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._walk(tree, binned)
        return self

    def _grow(self, x, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = RATE * total_g / (total_h + 1.0)
        best, where = 1e-6, None
        for f in range(x.shape[1]) if depth and len(rows) > 10 else ():
            bins = x[rows, f]
            left_g = np.cumsum(np.bincount(bins, g[rows], BINS))[:-1]
            left_h = np.cumsum(np.bincount(bins, h[rows], BINS))[:-1]
            gain = (
                left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1)
                - total_g**2 / (total_h + 1)
            )
            at = int(gain.argmax())
            if gain[at] > best:
                best, where = gain[at], (f, at)
        if where is None:
            return leaf
        f, at = where
        below = x[rows, f] <= at
        return (f, at, self._grow(x, g, h, rows[below], depth - 1), self._grow(x, g, h, rows[~below], depth - 1))

    def _walk(self, tree, binned):
        if not isinstance(tree, tuple):
            return np.full(len(binned), tree)
        f, at, low, high = tree
        return np.where(binned[:, f] <= at, self._walk(low, binned), self._walk(high, binned))

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T)])
        return self.base + sum(self._walk(tree, binned) for tree in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit by pooling adjacent violators.

    A block is level from its first to its last value; between blocks the fit is linear.
    """
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first, last
    for value, label in zip(raw[order], y[order].astype(float)):
        blocks.append([label, 1.0, value, value])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            low = blocks[-1]
            low[0] = (low[0] * low[1] + m * w) / (low[1] + w)
            low[1] += w
            low[3] = last
    return (
        np.array([v for block in blocks for v in block[2:]]),
        np.array([block[0] for block in blocks for _ in range(2)]),
    )


class Model:
    """Lexicon, trees and calibration; ``share`` alone when labels of one kind only were seen."""

    def __init__(self, words, beginnings, share, trees=None, knots=None):
        self.words, self.beginnings, self.share, self.trees, self.knots = words, beginnings, share, trees, knots

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.empty(0)
        raw = self.trees.raw(features(texts, self.words, self.beginnings))
        # A little of the uncalibrated score keeps the order within a calibrated step.
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def _lexicons(sample: DataFrame) -> list[tuple[dict[str, float], dict[str, float]]]:
    """Words and word beginnings that mark toxic texts, with their weights: by half 0, by half 1, by both."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    starts = [
        F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
        for k in BEGINNINGS
    ]
    # A text that comes several times counts once.
    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.max("half").alias("half"))
    totals = {(r["half"], r["toxic"]): r["count"] for r in texts.groupBy("half", "toxic").count().collect()}
    counts = save(
        texts.select("toxic", "half", F.explode(F.array_distinct(F.concat(words, *starts))).alias("entry"))
        .where("entry <> ''")
        .groupBy("entry")
        .agg(
            *[F.sum(F.when(F.col("half") == h, F.col("toxic")).otherwise(0)).alias(f"held{h}") for h in (0, 1)],
            *[F.count_if(F.col("half") == h).alias(f"documents{h}") for h in (0, 1)],
        )
        .where(F.col("held0") + F.col("held1") >= MIN_TOXIC),
        "toxic-entries",
    )
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(totals.get((h, k), 0) for h in halves) for k in (1, 0))
        count = sum(F.col(f"held{h}") for h in halves)
        held, others = count + 0.5, sum(F.col(f"documents{h}") for h in halves) - count + 0.5
        weight = F.log((held / (toxic + 1)) / (others / (clean + 1))) - CERTAINTY * F.sqrt(1 / held + 1 / others)
        found = (
            counts.where(count >= MIN_TOXIC)
            .select("entry", weight.alias("weight"))
            .where(F.col("weight") >= MIN_WEIGHT)
            .orderBy(F.desc("weight"), "entry")
            .limit(LEXICON)
            .collect()
        )
        learned = {r["entry"]: r["weight"] for r in found}
        known = dict.fromkeys(SEED_WORDS, 2 * MIN_WEIGHT) | {w: v for w, v in learned.items() if w[-1] != "*"}
        out.append((known, {w[:-1]: v for w, v in learned.items() if w[-1] == "*"}))
    return out


def train(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out.

    Labels other than 0 and 1 and null ids are left out; contradicting labels of one id count as 1.
    Without both kinds of label in the sample every text gets the share of toxic labels as its score.
    """
    chosen = save(
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1) & ~is_held_out(F.col(id_column)))
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.max(label_column).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows),
        "toxic-labels",
    )
    texts = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # The labels are at most sample_rows small rows. Rows that repeat an id count once.
    sample = save(
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")),
        "toxic-sample",
    )
    *other, (words, beginnings) = _lexicons(sample)

    @pandas_udf("array<double>")
    def measured(text: pd.Series, half: pd.Series) -> pd.Series:
        out = [None] * len(text)
        for h in (0, 1):
            at = np.flatnonzero(half.to_numpy() == h)
            rows = features(pa.array(text.iloc[at], pa.string()), *other[1 - h])
            for i, row in zip(at, rows):
                out[i] = row
        return pd.Series(out)

    with small_batches(documents.sparkSession):
        rows = (
            sample.select("doc_id", "toxic", "half", measured("text", "half").alias("x")).orderBy("doc_id").collect()
        )  # at most sample_rows
    y = np.array([r["toxic"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    half = np.array([r["half"] for r in rows], int)
    if len(np.unique(y)) < 2:
        return Model(words, beginnings, float(y.mean()) if len(y) else 0.0)
    raw = np.zeros(len(y))
    for h in (0, 1):
        if len(np.unique(y[half != h])) == 2:
            raw[half == h] = Trees().fit(x[half != h], y[half != h]).raw(x[half == h])
    return Model(words, beginnings, float(y.mean()), Trees().fit(x, y), isotonic(raw, y))


def score_documents(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """``documents`` with held_out, score (0 to 1) and predicted (1 from :data:`DECISION` on).

    Every whole text is scored; a null text counts as empty and gets a score as well. Repeated rows get
    equal scores, an empty table stays empty. Columns of these names are replaced; no other column
    but the text enters the score.
    """
    model = train(documents, labels, id_column, text_column, **options)

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scores = pa.array(model.scores(text), pa.float64())
        pa.default_memory_pool().release_unused()
        return scores

    added = ("held_out", "score", "predicted")
    return documents.select(
        *[documents[c] for c in documents.columns if c not in added],
        is_held_out(documents[id_column]).alias("held_out"),
        score(F.coalesce(documents[text_column], F.lit(""))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
