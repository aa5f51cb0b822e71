"""Periodic runs of words by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period q, of at least ``max(MIN_LENGTH, 2 * q)`` words, that no
neighbouring word extends keeping period q. For every period p the words at jp and (j+1)p are compared, for all j: any
run of period p has p equal pairs in a row, so it holds one of these grid points. Over all periods these are n ln n
probes of a text of n words. Equal pairs are extended by comparing chunks of the array with itself p words on; grid
points inside a found run whose period divides p are passed over.

Defined results: a null or blank text has no words and no runs; nothing is cut or capped. A null id stays null, rows that
repeat an id are each searched, and only id and text are read, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MIN_LENGTH = 12
#: Grid points compared at once, and words on either side of an equal pair that the first extension compares.
BLOCK, CHUNK = 1 << 18, 8


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space, unchanged; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def probes(words: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of the periods ``low <= p < high`` whose word recurs p words on: position and period, by both."""
    periods = np.arange(low, high)
    counts = (len(words) - 1) // periods
    p = np.repeat(periods, counts)
    first = np.cumsum(counts) - counts
    at = (np.arange(len(p)) - np.repeat(first, counts)) * p
    hit = words[at] == words[at + p]
    return at[hit], p[hit]


def near_extent(words: np.ndarray, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs directly before and after each pair are equal too, up to ``CHUNK``."""
    n, step = len(words), np.arange(1, CHUNK + 1)
    right = at[:, None] + step
    after = (right + p[:, None] < n) & (words[np.minimum(right, n - 1)] == words[np.minimum(right + p[:, None], n - 1)])
    left = at[:, None] - step
    before = (left >= 0) & (words[np.maximum(left, 0)] == words[np.maximum(left, 0) + p[:, None]])
    return np.logical_and.accumulate(before, axis=1).sum(1), np.logical_and.accumulate(after, axis=1).sum(1)


def equal_stretch(words: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The longest stretch of positions around ``at`` whose words recur p words on: first, and one past the last."""
    low, high, chunk = at, at + 1, CHUNK
    while high + p < len(words):
        size = min(chunk, len(words) - p - high)
        differ = np.flatnonzero(words[high : high + size] != words[high + p : high + p + size])
        if len(differ):
            high += int(differ[0])
            break
        high, chunk = high + size, 2 * chunk
    chunk = CHUNK
    while low > 0:
        size = min(chunk, low)
        differ = np.flatnonzero(words[low - size : low] != words[low - size + p : low + p])
        if len(differ):
            low += int(differ[-1]) + 1 - size
            break
        low, chunk = low - size, 2 * chunk
    return low, high


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of an array of word numbers as (start, length, period), by start and period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # (start, length) to period
    long_ones: list[tuple[int, int, int]] = []  # of the found runs those longer than the period at hand: start, end, period
    last = n // 2 if n >= MIN_LENGTH else 0
    low = 1
    while low <= last:
        high, points = low, 0
        while high <= last and (high == low or points + (n - 1) // high <= BLOCK):
            points += (n - 1) // high
            # periods past sqrt(n) have few points each: step over as many as surely fit
            step = max(1, min(last - high, (BLOCK - points) // max(1, (n - 1) // high))) if high * high > n else 1
            points += (step - 1) * ((n - 1) // high)
            high += step
        high = min(high, last + 1)
        at, p = probes(words, low, high)
        low = high
        if not len(at):
            continue
        before, after = near_extent(words, at, p)
        open_ended = (before == CHUNK) | (after == CHUNK)
        worth = open_ended | (before + after + 1 >= np.maximum(MIN_LENGTH - p, p))
        at, p = at[worth], p[worth]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.array([], int)
        for lo, hi in zip(starts, np.r_[starts[1:], len(p)]):
            period, points_left = int(p[lo]), at[lo:hi]
            long_ones = [run for run in long_ones if run[1] - run[0] > period]
            for start, end, q in long_ones:
                if period % q == 0:  # such a run's words recur here by its own period
                    points_left = points_left[(points_left < start) | (points_left + period >= end)]
            k = 0
            while k < len(points_left):
                first, past = equal_stretch(words, int(points_left[k]), period)
                k = int(np.searchsorted(points_left, past))
                length = past - first + period
                if length >= max(MIN_LENGTH, 2 * period) and (first, length) not in found:
                    found[first, length] = period
                    long_ones.append((first, first + length, period))
    return sorted((start, length, q) for (start, length), q in found.items())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat, bounds = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        numbers = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)
        keep, runs = np.ones(len(numbers), bool), []
        for low, high in zip(bounds, bounds[1:]):
            runs.append(runs_of(numbers[low:high]))
            for start, length, q in runs[-1]:
                keep[low + start + q : low + start + length] = False
        kept = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(keep)][bounds], flat.filter(pa.array(keep)))
        text = pc.binary_join(kept.cast(pa.large_list(pa.large_string())), pa.scalar(" ", pa.large_string())).cast(pa.string())
        fields = [tuple(zip(*of)) if of else ((), (), ()) for of in runs]
        ends = np.r_[0, np.cumsum([len(of) for of in runs])].astype(np.int32)
        parts = [pa.array([x for of in fields for x in of[i]], pa.int64()) for i in range(3)]
        rows = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(RUN)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), rows, text], ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Column | None = None) -> DataFrame:
    """id, n_words, runs (by start and period) and collapsed of each row.

    ``collapsed`` has the words that stay when each run is cut down to its first period, joined by single spaces.
    ``words`` replaces the words of ``text_col`` by an array of another make.
    """
    of = words_of(F.col(text_col)) if words is None else words
    rows = docs.select(F.col(id_col).cast("long").alias("id"), of.alias("words"))
    return rows.mapInArrow(_search, RESULT).withColumnRenamed("id", id_col)
