"""Periodic runs of words by heavy/light lag counting.

A run is a stretch of consecutive words whose smallest period is q, of at least
``LEAST`` words and ``TIMES`` periods, that no neighbouring word extends.  A run of
length L with period q has L - q places whose word stands again q places later, so
a lag q needs ``max(LEAST - q, (TIMES - 1) * q)`` such matches at least to hold one.

The matches of all lags are counted at once.  A word is heavy in a text if its
occurrences, squared, are more than a Fourier transform of the text costs: the
exact autocorrelation of its places comes from the transform (sums of 0 and 1,
rounded; the error is far below a half).  The places of a light word give their
differences pair by pair.  Lags are then taken in ascending order.  Matches at a
multiple of p inside a run of period p say nothing new, and no two runs hold the
same match of a lag, so L - lag is taken off the counts of the multiples of p for
every run found.  Only a lag that still has enough matches is looked at: first at
its multiples, where a run must show ``PROBE`` words twice, then, if some place
passes, by a scan for islands of matches.

Defined results: null and empty texts, and texts of white space, have no word and
no run; a null doc_id is a row like any other; repeated rows are repeated; an empty
table gives an empty result; other columns are ignored.  One task holds one Arrow
batch and the words of at most ``STEP`` bytes of text, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.codes import STEP
from strata.llm.common import utf8_values

LEAST = 6
TIMES = 4
PROBE = 12

Run = tuple[int, int, int]


def needed(lag: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    return np.maximum(least - lag, (times - 1) * lag)


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal ones alike, and the n + 1 offsets of the texts."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)])


def lag_matches(ids: np.ndarray, at: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the lags 1 to n // times of each text, one text after the other, and their offsets."""
    sizes = np.diff(at)
    lags = sizes // times
    base = np.concatenate([[0], np.cumsum(lags)])
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ids, text))  # stable: places ascend within a word of a text
    word, text = ids[order], text[order]
    change = np.ones(len(order), bool)
    change[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(change)
    often = np.diff(np.concatenate([starts, [len(order)]]))
    padded = sizes + lags
    cost = padded * np.log2(np.maximum(2, padded))
    heavy = often * often > cost[text[starts]] if len(starts) else change
    power: dict[int, np.ndarray] = {}
    for s, f in zip(starts[heavy].tolist(), often[heavy].tolist(), strict=True):
        t = int(text[s])
        here = np.zeros(padded[t])
        here[order[s : s + f] - at[t]] = 1
        spectrum = np.fft.rfft(here)
        power[t] = power.get(t, 0) + (spectrum * spectrum.conj()).real
    for t, total in power.items():
        counts[base[t] : base[t + 1]] = np.rint(np.fft.irfft(total, int(padded[t]))[1 : lags[t] + 1]).astype(np.int64)

    light = np.repeat(~heavy, often)
    place, group, text = order[light], np.repeat(np.arange(len(starts)), often)[light], text[light]
    step, left = 0, np.arange(len(place))
    while True:  # occurrences that are `step` apart in the list of their word
        step += 1
        left = left[left < len(place) - step]
        left = left[group[left] == group[left + step]]
        lag = place[left + step] - place[left]
        near = lag <= lags[text[left]]  # the next occurrence is no nearer
        left, lag = left[near], lag[near]
        if not len(left):
            return counts, base
        counts += np.bincount(base[text[left]] + lag - 1, minlength=len(counts))


def islands(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, matches) of every stretch of at least ``least`` consecutive matches of a lag."""
    if lag > 4:
        # a run holds two neighbouring multiples of the lag at which the words of a period stand twice each
        probe = min(lag, PROBE)
        starts = np.arange(0, len(words) - 2 * lag - probe + 1, lag)
        for c in range(probe):
            starts = starts[(words[starts + c] == words[starts + c + lag]) & (words[starts + c] == words[starts + c + 2 * lag])]
            if not len(starts):
                return []
    same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), (end - begin)[long].tolist(), strict=True))


def smaller_period(words: np.ndarray, start: int, length: int, lag: int) -> bool:
    """Whether a proper divisor of the lag is a period too: of so long a run, any smaller period implies one that is."""
    first = words[start : start + lag]
    twice = np.concatenate([first, first])
    return any(lag % p == 0 and np.array_equal(first, twice[p : p + lag]) for q in range(1, int(lag**0.5) + 1) if lag % q == 0 for p in (q, lag // q) if p < lag)


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run of one text, by start and period; ``counts`` are its matches by lag."""
    found: list[Run] = []
    left = counts.copy()
    need = needed(np.arange(1, len(counts) + 1), least, times)
    for lag in (np.flatnonzero(counts >= need) + 1).tolist():
        if left[lag - 1] < need[lag - 1]:
            continue
        for start, matches in islands(words, lag, int(need[lag - 1])):
            length = matches + lag
            if smaller_period(words, start, length, lag):
                continue
            found.append((start, length, lag))
            inside = np.arange(2 * lag, min(length, len(left) + 1), lag)
            left[inside - 1] -= length - inside
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those behind the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist())


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and the text with each run cut to one period."""
    if times < 4 or least < 1:  # two runs must not share so many words that one match belongs to both
        raise ValueError("times must be 4 or more and least 1 or more")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in utf8_values(batch.column(1))]
            first = 0
            while first < len(texts):
                last, size = first + 1, len(texts[first])
                while last < len(texts) and size + len(texts[last]) <= STEP:
                    size += len(texts[last])
                    last += 1
                split = [x.split() for x in texts[first:last]]  # of bytes: the six white-space bytes alone
                ids, at = word_numbers(split)
                counts, base = lag_matches(ids, at, times)
                runs = [runs_of(ids[at[i] : at[i + 1]], counts[base[i] : base[i + 1]], least, times) for i in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(at)),
                        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], RUNS),
                        pa.array([collapsed(w, r).decode() for w, r in zip(split, runs, strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                first = last

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        look, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def strongest(runs: Column) -> Column:
    """The run of most periods, ties by least start, then period; null without one.

    Different fractions of numbers below 2 ** 25 are different doubles, equal ones equal.
    """
    ranked = F.transform(runs, lambda r: F.struct((r.length / r.period).alias("times"), (-r.start).alias("s"), (-r.period).alias("p"), r.alias("run")))
    return F.array_max(ranked).getField("run")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Plant a run into one of ten documents, by the checksum of doc_id: from some word on, the next few repeat."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    out = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.crc32(doc_id.cast("string").cast("binary")).alias("h"))
    out = out.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    out = out.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    out = out.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    tail = F.transform(F.col("w"), lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return out.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of documents with planted repeats: how many, the strongest, and digests of all of them and of the collapsed text."""
    found = find_runs(repeat_tails(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
