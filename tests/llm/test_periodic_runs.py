import hashlib
import random
import zlib

import numpy as np
import pytest

from pluvia.llm import periodic_runs, queries


def brute(words):
    """Runs by comparing every position with every other: all maximal stretches of each period, the smallest period only."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            first = x
            while x + p < n and words[x] == words[x + p]:
                x += 1
            length = x - first + p
            if x > first and length >= max(12, 2 * p) and (first, length) not in found:
                found[first, length] = p
            x += 1
    return sorted((s, length, q) for (s, length), q in found.items())


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    words = [draw.randrange(draw.choice((2, 3, 30))) for _ in range(draw.randrange(0, 160))]
    for _ in range(draw.randrange(4)):
        block = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        at = draw.randrange(len(words) + 1)
        words[at:at] = (block * 9)[: draw.randrange(1, 9 * len(block))]
    assert periodic_runs.runs_of(np.array(words, dtype=np.int32)) == brute(words)


def test_runs_of_nested_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, [1] * 500, ([0] * 13 + [1]) * 30, ([0, 1] * 20 + [2]) * 5, [0] * 11, [0] * 12):
        assert periodic_runs.runs_of(np.array(words, dtype=np.int32)) == brute(words)


def test_blocks_of_periods_cut_anywhere(monkeypatch):
    draw = random.Random(5)
    words = ([draw.randrange(3) for _ in range(40)] * 4)[:150] + [draw.randrange(3) for _ in range(100)]
    whole = brute(words)
    for size in (1, 7, 64, 500):
        monkeypatch.setattr(periodic_runs, "BLOCK", size)
        assert periodic_runs.runs_of(np.array(words, dtype=np.int32)) == whole


def test_a_long_text_of_one_word_takes_time_in_proportion():
    words = np.zeros(200_000, dtype=np.int32)
    assert periodic_runs.runs_of(words) == [(0, 200_000, 1)]
    words[100_000] = 1
    assert periodic_runs.runs_of(words)[:1] == [(0, 100_000, 1)]


def expected(doc_id, text):
    words = looped(doc_id, words_of(text))
    runs, gone = brute(words), set()
    for start, length, q in runs:
        gone.update(range(start + q, start + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(lines), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_periodic_runs(spark, sf_dir)
    assert found.columns == COLUMNS
    small = [d for d in docs if len(words_of(d.text)) < 3000]
    got = {r.doc_id: tuple(r) for r in found.collect()}
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 10
    for d in small:
        assert got[d.doc_id] == expected(d.doc_id, d.text)


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect() if len(r.text or "") < 1000]
    few = awkward.filter("length(text) < 1000 OR text IS NULL")
    got = [tuple(r) for r in queries.periodic_digest(few).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    long_rows = periodic_runs.find_runs(awkward.filter("length(text) > 1000")).orderBy("doc_id").collect()
    assert [[tuple(r) for r in d.runs] for d in long_rows] == [[(0, 20000, 1)], [(0, 20000, 1)]]
    assert [d.collapsed for d in long_rows] == ["word", "word end"]
    assert queries.periodic_digest(empty).collect() == []
