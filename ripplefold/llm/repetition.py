"""Repetition inside a document, judged by weak supervision.

Several rules look at each text and vote that it repeats itself (+1), that it does not (-1), or abstain (0), also
where they do not apply (a text of few lines says nothing about lines). Expectation-maximisation over the counts
of vote patterns estimates how often each rule votes each way on repetitive and on clean texts, and gives every
pattern a posterior probability. That one probability chooses the texts, in place of a chain of filters that must
all pass; no rule knows the exact share below, which is compared afterwards, for the chosen texts only.

Measures, per text: words are the longest runs of letters and digits, in lower case.
- ``lines``: share of non-blank lines that occurred before in the text, of ``n_lines``.
- ``sentences``: share of sentences that occurred before, of ``n_sentences``.
- ``fours``: share of the words' runs of four that occurred before.
- ``top``: share of the words' runs of four that are the most frequent one, 0 where none occurs twice.
- ``variety``: distinct words over words.
- ``repeated``: the exact share of words inside a stretch of ``width`` consecutive words that also starts at an
  earlier word of the text; stretches may overlap and only the later one counts.

Null, empty and wordless texts have zero words, zero shares and variety 1. Repeated rows give repeated rows; no
rows give none.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 8
RULES = ("fours", "top", "lines", "sentences", "variety")
#: Lines or sentences from which on their rule votes. A text of which 0.3 lies in repeated stretches of 8 has at least
#: 5/8 of that in repeated runs of four, and at most 0.7 of its words are distinct: no such text gets the vote -1
#: of ``fours`` or ``variety``.
ENOUGH = 4

_WORDS = re.compile(r"[^\W_]+").findall
_SENTENCES = re.compile(r"[.!?。！？]+\s*|\n+").split


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, each in lower case."""
    if not text:
        return []
    return _WORDS(text.lower()) if text.isascii() else [word.lower() for word in _WORDS(text)]


def _again(places: np.ndarray) -> np.ndarray:
    """True where a value occurred at an earlier place."""
    later = np.ones(len(places), dtype=bool)
    later[np.unique(places, return_index=True)[1]] = False
    return later


def repeated_words(words: list[str], width: int = WIDTH) -> tuple[int, float, float, float]:
    """(covered words, share of runs of four seen before, of the most frequent one, distinct share); runs are told
    apart exactly.

    Runs of 2, 4 and 8 words get numbers by joining the numbers of their halves; other widths by one more join
    of two overlapping runs.
    """
    n = len(words)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    variety = len(numbers) / n if n else 1.0
    size, fours, top, runs = 1, 0.0, 0.0, ids
    while size < width and len(runs):
        step = min(size, width - size)
        if len(runs) <= step:
            runs = runs[:0]
            break
        joined = runs[:-step] * np.int64(n + 1) + runs[step:]
        runs = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        size += step
        if size == 4:
            fours = 1 - (int(runs.max()) + 1) / len(runs)
            if fours == 0 and width >= 4:
                return 0, 0.0, 0.0, variety
            top = int(np.bincount(runs).max()) / len(runs) if fours else 0.0
    if size < width or not len(runs):
        return 0, fours, top, variety
    starts = np.flatnonzero(_again(runs))
    if not len(starts):
        return 0, fours, top, variety
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), fours, top, variety


def _share_again(parts: list[str]) -> tuple[int, float]:
    kept = [p for p in (part.strip() for part in parts) if p]
    return len(kept), 1 - len(set(kept)) / len(kept) if kept else 0.0


COUNTS = ("n_words", "covered", "n_lines", "n_sentences")
SHARES = ("lines", "sentences", "fours", "top", "variety")


def _measurer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shares = [array("q") for _ in COUNTS], [array("d") for _ in SHARES]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hit, fours, top, variety = repeated_words(words, width)
                n_lines, lines = _share_again(text.split("\n")) if text else (0, 0.0)
                n_sentences, sentences = _share_again(_SENTENCES(text)) if text else (0, 0.0)
                for columns, row in ((counts, (len(words), hit, n_lines, n_sentences)), (shares, (lines, sentences, fours, top, variety))):
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), *map(pa.array, shares)], ["id", *COUNTS, *SHARES])

    return run


def measures(df: DataFrame, key: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, covered, n_lines, n_sentences, lines, sentences, fours, top, variety, repeated): one Arrow pass,
    no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_measurer(width), f"id {kind}, " + ", ".join([f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in SHARES]))
    share = F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0)
    return out.select(F.col("id").alias(key), *COUNTS, *SHARES, share.alias("repeated"))


def _vote(high: Column, low: Column) -> Column:
    return F.when(high, 1).when(low, -1).otherwise(0)


def votes() -> dict[str, Column]:
    """The vote of each rule over ``measures``."""
    many = F.col("n_words") >= 50
    lines, sentences = F.col("n_lines") >= ENOUGH, F.col("n_sentences") >= ENOUGH
    return {
        "fours": _vote(F.col("fours") >= 0.1875, F.col("fours") < 0.1),
        "top": _vote(many & (F.col("top") >= 0.02), many & (F.col("top") == 0)),
        "lines": _vote(lines & (F.col("lines") >= 0.3), lines & (F.col("lines") < 0.02)),
        "sentences": _vote(sentences & (F.col("sentences") >= 0.2), sentences & (F.col("sentences") < 0.02)),
        "variety": _vote(many & (F.col("variety") < 0.4), F.col("variety") > 0.7),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior probability of repetition of each vote pattern, by expectation-maximisation.

    Two classes; given the class, rules vote independently with their own chances of +1, 0 and -1. Starts from
    the vote of the first rule and, where that abstains, from the majority; each chance is smoothed by one vote, so
    none is ever zero. A corpus of one kind only keeps the side on which it starts. No patterns: empty.
    """
    if not patterns:
        return {}
    seen = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], dtype=float)
    belief = 0.5 + 0.45 * np.where(seen[:, 0] != 0, seen[:, 0], np.sign(seen.sum(1)) / 2)
    for _ in range(rounds):
        logs = np.zeros((len(seen), 2))
        for k, mass in enumerate((weight * (1 - belief), weight * belief)):
            logs[:, k] = np.log((mass.sum() + 1) / (weight.sum() + 2))
            for rule in range(seen.shape[1]):
                chance = np.array([(mass[seen[:, rule] == v].sum() + 1) for v in (-1, 0, 1)]) / (mass.sum() + 3)
                logs[:, k] += np.log(chance[seen[:, rule] + 1])
        after = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        moved = np.abs(after - belief).max()
        belief = after
        if moved < 1e-9:
            break
    return {tuple(map(int, p)): float(b) for p, b in zip(seen, belief)}


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` with the votes and ``posterior``, the probability that the text repeats itself.

    Only counts of vote patterns, at most 3 to the number of rules, leave the executors.
    """
    voted = measured.select("*", *(vote.cast("int").alias(f"vote_{name}") for name, vote in votes().items()))
    columns = [f"vote_{name}" for name in RULES]
    counted = [(tuple(row[c] for c in columns), row["n"]) for row in voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()]
    code = sum(((F.col(c) + 1) * 3**i for i, c in enumerate(columns)), F.lit(0))
    table = fit(counted)
    if not table:
        return voted.withColumn("posterior", F.lit(0.0))
    chances = F.create_map(*itertools.chain.from_iterable((F.lit(sum((v + 1) * 3**i for i, v in enumerate(p))), F.lit(b)) for p, b in table.items()))
    return voted.withColumn("posterior", chances[code])


def repetitive(measured: DataFrame, least: float = 0.3, belief: float = 0.5) -> DataFrame:
    """Texts that the posterior holds for repetitive, of which the exact share is then compared."""
    return judged(measured).where(F.col("posterior") >= belief).where(F.col("repeated") >= least)
