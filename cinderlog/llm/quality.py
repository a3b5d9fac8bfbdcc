"""Quality classifier from weak labels: heuristics vote, their accuracies are estimated, and a linear scorer is trained."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import ready
from cinderlog.sources.workspace import written

HASHED, SAMPLE_ROWS, ROUNDS, STEPS, SEED = 1 << 12, 2000, 50, 300, 5
BAD, GOOD, NONE = "0", "1", "-"
#: Very common words of some languages; running text holds some of them.
COMMON = frozenset(
    "the of and to in a is that it for was on with as be by at or from this de la que el en y los las un una por con "
    "le les des et du est au der die das und ein eine den zu mit von auf für ist il di che e per o do da em".encode().split()
)
_SHAPES = bytes(
    ord("A") if chr(b).isascii() and chr(b).isupper() else ord("0") if 48 <= b < 58 else ord("a") if b >= 128 or chr(b).isalpha() else b for b in range(256)
)
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"!|%$&*#<>{}[]~^=+\\/@_")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"Aa")] = True


@dataclass(frozen=True)
class Traits:
    """What the heuristics look at."""

    words: int
    letters: float  # of all bytes that are not spaces
    capitals: float  # of all letters
    signs: float  # of all bytes
    distinct: float  # words of all words
    repeats: float  # words equal to the one before
    stops: float  # words that end a sentence
    common: float  # words of COMMON
    length: float  # mean bytes per word


def traits(raw: bytes, words: list[bytes]) -> Traits:
    n = len(words)
    if not n:
        return Traits(0, 0, 0, 0, 0, 0, 0, 0, 0)
    shape = np.frombuffer(raw.translate(_SHAPES), np.uint8)
    counts = np.bincount(shape, minlength=256)
    letters, solid = int(counts[_LETTERS].sum()), sum(map(len, words))
    low = raw.lower().split()
    return Traits(
        n, letters / solid, int(counts[ord("A")]) / max(1, letters), int(counts[_SIGNS].sum()) / len(raw), len(set(low)) / n,
        sum(map(eq, low, low[1:])) / n, sum(word.endswith((b".", b"!", b"?")) for word in words) / n,
        sum(map(COMMON.__contains__, low)) / n, solid / n,
    )


def _vote(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> str:
    return BAD if value < bad_below or value > bad_above else GOOD if good_from <= value <= good_to else NONE


def votes(t: Traits) -> str:
    """One character per labeller. Labellers that look at shares of words do not judge texts of under 20 words."""
    inf = float("inf")
    long = t.words >= 20
    return "".join([
        _vote(t.signs, -1, 0, 0.01, 0.05) if t.words else NONE,
        _vote(t.capitals, -1, 0, 0.2, 0.4) if t.words else NONE,
        _vote(t.letters, 0.75, 0.88, inf, inf) if t.words else NONE,
        _vote(t.repeats, -1, 0, 0.02, 0.1) if long else NONE,
        _vote(t.distinct, 0.3, 0.45, inf, inf) if long else NONE,
        _vote(t.stops, 0.01, 0.03, 0.25, 0.6) if long else NONE,
        _vote(t.common, 0.005, 0.05, 0.7, 0.95) if long else NONE,
        _vote(t.length, 2.5, 3.5, 9, 14) if t.words else NONE,
        BAD if not t.words else NONE,
    ])


@dataclass(frozen=True)
class LabelModel:
    """How often each labeller says what about bad and good texts, and how many texts are good."""

    prior: float
    rates: np.ndarray  # (labeller, class, vote); 1 for no vote, which says nothing

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of `good` for each row of votes."""
        seen = _codes(patterns)
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :] + sum(
            np.log(self.rates[k][:, seen[:, k]]).T for k in range(seen.shape[1])
        )
        logs -= logs.max(axis=1, keepdims=True)
        odds = np.exp(logs)
        return odds[:, 1] / odds.sum(axis=1)


def _codes(patterns: list[str]) -> np.ndarray:
    return np.array([[(BAD + GOOD + NONE).index(c) for c in pattern] for pattern in patterns], np.int64)


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the distinct rows of votes.

    It begins with alarms that are seldom false and silence that says little: junk of one kind passes the checks for others.
    """
    seen = _codes(patterns)
    labellers = seen.shape[1]
    rates = np.tile(np.array([[0.45, 0.55, 1.0], [0.01, 0.99, 1.0]]), (labellers, 1, 1))
    model = LabelModel(0.8, rates)
    for _ in range(rounds):
        good = model.posterior(patterns)
        weights = np.stack([(1 - good) * counts, good * counts])
        rates = np.ones_like(rates)
        for k in range(labellers):
            for vote in range(2):
                rates[k, :, vote] = weights[:, seen[:, k] == vote].sum(axis=1) + (0.5 if vote else 0.05)
            rates[k, :, :2] /= rates[k, :, :2].sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip(weights[1].sum() / counts.sum(), 0.01, 0.99)), rates)
    return model


def features(raw: bytes, words: list[bytes], t: Traits) -> dict[int, float]:
    """Hashed features: shapes of words (runs of alike characters collapsed), pairs of shapes, and traits in steps."""
    if not words:
        return {}
    shape = np.frombuffer(raw.translate(_SHAPES), np.uint8)
    shapes = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].tobytes().split()
    found: dict[int, float] = {}
    for kind, tally in ((b"1", Counter(shapes)), (b"2", Counter(zip(shapes, shapes[1:])))):
        norm = sum(count * count for count in tally.values()) ** 0.5
        for key, count in tally.items():
            slot = xxhash.xxh64_intdigest(kind + (key if isinstance(key, bytes) else b" ".join(key)), SEED) % HASHED
            found[slot] = found.get(slot, 0.0) + count / norm
    steps = (t.letters, t.capitals, t.signs * 4, t.distinct, t.repeats * 4, t.stops * 2, t.common, min(1.0, t.length / 16))
    for number, value in enumerate(steps):
        slot = xxhash.xxh64_intdigest(b"3%d:%d" % (number, min(9, int(value * 10))), SEED) % HASHED
        found[slot] = found.get(slot, 0.0) + 0.5
    return found


def _read(text: str) -> tuple[bytes, list[bytes], Traits]:
    raw = text.encode()
    words = raw.split()
    return raw, words, traits(raw, words)


def train(rows: list[dict[int, float]], good: np.ndarray, steps: int = STEPS, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels. The last weight is the constant."""
    size = np.array([len(row) for row in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    slot = np.fromiter((key for row in rows for key in row), np.int64, size.sum())
    value = np.fromiter((x for row in rows for x in row.values()), np.float64, size.sum())
    weights = np.zeros(HASHED + 1)
    for _ in range(steps):
        score = np.bincount(owner, value * weights[slot], len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-score)) - good) / len(rows)
        weights[:-1] -= rate * (np.bincount(slot, value * error[owner], HASHED) + decay * weights[:-1])
        weights[-1] -= rate * error.sum()
    return weights


def voted(docs: DataFrame) -> DataFrame:
    """The votes on each whole text, and a hash of id and text by which samples are drawn; written."""

    @F.pandas_udf("string")
    def vote(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([votes(_read(text)[2]) for text in series], dtype=object)

    return written(docs.select(vote(F.coalesce(docs["text"], F.lit(""))).alias("votes"), _draw(docs).alias("draw")), "votes")


def _draw(docs: DataFrame) -> Column:
    return F.xxhash64(F.lit(SEED), docs["doc_id"], docs["text"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes on all documents, and the scorer, from a bounded sample of each label.

    At most 3^9 distinct rows of votes come to the driver. The scorer sees up to sample_rows texts whose posterior label
    is good, and as many whose is bad: those of smallest hash of id and text (copies of a row count as one).
    """
    rows = voted(docs)
    counts = rows.groupBy("votes").count().collect()
    if not counts:
        return LabelModel(0.5, np.ones((9, 2, 3))), np.zeros(HASHED + 1)
    patterns = [row[0] for row in counts]
    model = estimate(patterns, np.array([row[1] for row in counts], np.float64))
    belief = dict(zip(patterns, model.posterior(patterns)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_read(text) for text in batch["text"].to_pylist()]
            found = [features(*one) for one in texts]
            said = pa.array([votes(one[2]) for one in texts], pa.string())
            slots = pa.array([list(one) for one in found], pa.list_(pa.int32()))
            values = pa.array([list(one.values()) for one in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["draw"], said, slots, values], ["draw", "votes", "slots", "values"])

    drawn = []
    for side in (True, False):
        names = [name for name, good in belief.items() if (good > 0.5) == side]
        picked = rows.where(F.col("votes").isin(names)).select("draw").distinct().orderBy("draw").limit(sample_rows)
        drawn += [row[0] for row in picked.collect()]
    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), _draw(docs).alias("draw"))
    texts = texts.where(F.col("draw").isin(drawn)).groupBy("draw").agg(F.min("text").alias("text"))  # copies of a row once
    texts = texts.mapInArrow(read, "draw long, votes string, slots array<int>, values array<double>")
    sample = {row["draw"]: row for row in texts.collect()}
    rows = [sample[draw] for draw in sorted(sample)]
    labels = np.array([belief[row["votes"]] for row in rows])
    return model, train([dict(zip(row["slots"], row["values"])) for row in rows], labels)


def score(docs: DataFrame, model: tuple[LabelModel, np.ndarray], keep_from: float = 0.5) -> DataFrame:
    """doc_id, text_key, votes, posterior (of the label model), score (of the scorer, 0 to 1) and keep for each document."""
    labels, weights = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, scores = [], []
            for text in batch["text"].to_pylist():
                raw, words, t = _read(text)
                found = features(raw, words, t)
                total = sum(weights[slot] * value for slot, value in found.items()) + weights[-1]
                said.append(votes(t))
                scores.append(1 / (1 + np.exp(-total)) if words else 0.0)
            posterior = labels.posterior(said) if said else []
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(said, pa.string()), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64())],
                ["doc_id", "text_key", "votes", "posterior", "score"],
            )

    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), text.alias("text"))
    rows = rows.mapInArrow(scored, "doc_id long, text_key long, votes string, posterior double, score double")
    return rows.withColumn("keep", F.col("score") >= keep_from)


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_from: float = 0.5) -> DataFrame:
    """Fit on docs (doc_id, text) and score them; see `fit` and `score`.

    Every whole text is voted on and scored by itself. Null texts, and those without words, score 0 and are not kept.
    Repeated rows and null ids are scored each; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    return score(docs, fit(docs, sample_rows), keep_from)


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_from: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with the columns of docs: scored in place, without a join."""
    ready(docs.sparkSession)
    _, weights = fit(docs, sample_rows)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            kept = []
            for text in series:
                raw, words, t = _read(text)
                total = sum(weights[slot] * value for slot, value in features(raw, words, t).items()) + weights[-1]
                kept.append(bool(words) and 1 / (1 + np.exp(-total)) >= keep_from)
            yield pd.Series(kept, dtype=bool)

    return docs.where(good(F.coalesce(docs["text"], F.lit(""))))
