"""Quality rules by host: failure rates of hosts, shrunk towards all hosts, decide about their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.bytewords import ByteWords
from cinderlog.llm.common import mixed, ready
from cinderlog.sources.workspace import written

#: Characters that count as symbols, and what separates words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
#: Bytes that begin a character and are no space.
_LETTER = ((np.arange(256) & 0xC0) != 0x80) & ~np.isin(np.arange(256), list(BLANKS.encode()))
#: First bytes of characters from U+0800 on: scripts some of which set no spaces, where the length of words says nothing.
_WIDE = np.arange(256) >= 0xE0
_WINDOW = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

#: A host goes if one of its shrunk rates is above MOST_FAILED. The correlation within hosts is kept in LEAST..MOST, so
#: that the prior counts as much as 1 to 999 documents.
MOST_FAILED, LEAST_CORRELATION, MOST_CORRELATION = 0.5, 0.001, 0.5
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or (word_chars > 12 * n_words and 2 * n_wide < word_chars)",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE_RULES = ("short", "repetitive")
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_wide long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(hashes: np.ndarray, text_no: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three words that the same text has twice or more."""
    hit = np.zeros(len(hashes), bool)
    if len(hashes) < 4:
        return hit
    key = mixed(hashes[:-2] * _WINDOW[0] + mixed(hashes[1:-1] * _WINDOW[1] + mixed(hashes[2:] * _WINDOW[2])))
    inside = np.flatnonzero(text_no[:-2] == text_no[2:])
    key = mixed(key[inside] + text_no[inside].astype(np.uint64) * _WINDOW[0])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return hit


def line_counts(text: str | None) -> tuple[int, int]:
    """(lines with a word, those of them that are equal to an earlier one)."""
    if not text:
        return 0, 0
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def text_counts(docs: DataFrame, host: Column) -> DataFrame:
    """A row of COUNTS for each row of docs (doc_id, text); null texts count as empty."""
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = ByteWords(batch["text"])
            again = words.text_no[repeated_words(words.hash, words.text_no)]
            lines = np.array([line_counts(text) for text in batch["text"].to_pylist()], np.int64).reshape(-1, 2)
            numbers = [
                words.per_text, words.sums(_LETTER), words.sums(_WIDE), words.sums(_SYMBOL), lines[:, 0], lines[:, 1],
                np.bincount(again, minlength=batch.num_rows),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["host"], *[pa.array(x.astype(np.int64)) for x in numbers]],
                ["doc_id", "host", "n_words", "word_chars", "n_wide", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), host.cast("string").alias("host"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTS)


def host_verdicts(counts: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """(host, host_docs, host_rate, host_kept) from rows of COUNTS: host_rate is the largest shrunk failure rate of a rule.

    Failures of a rule in the documents of a host are taken as beta-binomial. Mean and correlation within hosts come
    from the moments over all hosts (weighted by documents); they give the beta prior of the rule, which a host's own
    failures are added to. So a host of few documents is judged by what is usual, one of many by itself. A null host is
    a host. Only sums per host are shuffled, and one row of sums over hosts comes to the driver.
    """
    fails = [F.sum(F.expr(f"cast({rule} as long)")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = written(counts.groupBy("host").agg(F.count("*").alias("host_docs"), *fails), "host-failures")
    n = F.col("host_docs").cast("double")
    moments = [F.count("*").alias("hosts"), F.sum("host_docs").alias("docs"), F.sum(n * n).alias("squares")]
    moments += [x for name in RULES for x in (F.sum(f"f_{name}").alias(f"f_{name}"), F.sum(F.col(f"f_{name}") * F.col(f"f_{name}") / n).alias(f"s_{name}"))]
    total = hosts.agg(*moments).first()
    rates = [F.lit(0.0)]
    for name in RULES:
        a, strength = prior(total["hosts"], total["docs"] or 0, total["squares"] or 0.0, total[f"f_{name}"] or 0, total[f"s_{name}"] or 0.0)
        rates.append((F.col(f"f_{name}") + F.lit(a)) / (n + F.lit(strength)))
    rate = F.greatest(*rates)
    return hosts.select("host", "host_docs", F.round(rate, 9).alias("host_rate"), (rate <= most_failed).alias("host_kept"))


def prior(hosts: int, docs: int, squares: float, failed: int, spread: float) -> tuple[float, float]:
    """(a, a + b) of the beta prior of a rule.

    squares: sum of n^2 over hosts; failed: sum of failures f; spread: sum of f^2 / n.
    """
    mean = failed / docs if docs else 0.0
    chance = mean * (1 - mean)
    free = docs - squares / docs - (hosts - 1) if docs else 0.0
    correlation = ((spread - docs * mean * mean) / chance - (hosts - 1)) / free if chance > 0 and free > 0 else LEAST_CORRELATION
    correlation = min(max(correlation, LEAST_CORRELATION), MOST_CORRELATION)
    strength = 1 / correlation - 1
    return mean * strength, strength


def judge(docs: DataFrame, host: str | Column = "source", most_failed: float = MOST_FAILED) -> DataFrame:
    """Counts, base rules and verdict for each row of docs (doc_id, text, and what `host` needs).

    Gives doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_docs,
    host_rate. A word is a run of anything but ASCII spaces. `host` names a column or is an expression, such as the host
    part of a URL; a null host is a host of its own. A document stays if it passes the base rules and no rule fails, by
    the shrunk rate, in more than most_failed of its host's documents. Null and empty texts have no words and fail.
    Rows that share a doc_id, repeated rows included, are judged one by one; an empty table gives no rows; other columns
    are left out. Texts are read once, as a whole, and not shuffled; a host that holds most rows is reduced map-side, and
    its verdict is one row, which Spark broadcasts or joins with its skewed partitions split.
    """
    host = docs[host] if isinstance(host, str) else host
    counts = written(text_counts(docs, host), "text-counts")
    verdicts = written(host_verdicts(counts, most_failed), "host-verdicts").withColumnRenamed("host", "_host")
    rows = counts.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    failed = F.expr(" or ".join(RULES[name] for name in BASE_RULES))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("host_kept")).alias("kept"), "host", "host_docs", "host_rate",
    )
