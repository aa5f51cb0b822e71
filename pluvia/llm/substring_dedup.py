"""Removal of repeated word windows over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window picks the least hash among its ``GRAM``-word grams (its anchor), so
equal windows pick the same anchor at the same place, and about one word in eighteen is an anchor. An anchor's context is
all the words that its windows can reach. The index holds, for each pair of anchor hash and context digest, the first
document that had it, as immutable runs: warehouse tables bucketed by the pair and sorted.

A batch of new documents is merge-joined with the runs, which stay where they are:

* An anchor whose context an earlier document had: all its windows repeat.
* An anchor hash that came with several contexts: the windows of one holder of each context are digested from the words
  themselves, and those that an earlier document has repeat. This verifies every link that contexts alone don't decide.

Then the batch's new pairs become a run. Runs are compacted by tiers of size: when the last ``fan`` runs are of one tier they
are merged to one, so over many batches a pair is rewritten a logarithm of times.
Batches come in order of id, so within a call "earlier" is "smaller id"; what a given index holds from earlier calls is
earlier than all rows of a call. An index that outlives a call keeps the digests of each pair's windows (16 bytes each,
about eighteen a pair), so that no earlier text is needed again; one of a single call reads the texts. Digests are of the
words' bytes; a pair has 128 bits, and a digested window 128. An anchor that very many contexts share isn't dealt to one
task: such anchors are broadcast to their rows.

Defined results: null and word-less texts have no words. Texts shorter than a window lose nothing. Rows that repeat an id
don't remove words from each other; a null id comes after all others. Only id and text are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_lookup
from pluvia.session import Scratch, shared_root

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = 2**63 - 1
ANCHORS = "h long, ctx long, id long, th long, pos long, s long, e long"
PLACE = ["id", "th", "pos", "s", "e"]


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = self._powers(BASE, n), self._powers(pow(BASE, -1, 1 << 64), n)
        return self.up, self.down


class Text:
    """A text's words, joined by single spaces, and where they begin."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.joined = b" ".join(self.words)
        self.at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)) + 1)))

    def part(self, start: int, end: int) -> bytes:
        return self.joined[self.at[start] : self.at[end] - 1]


def anchors(text: Text, hashes: WordHashes, powers: Powers, block: int = 1 << 15) -> Iterator[tuple[int, int, int, int, int]]:
    """(hash, context digest, position, first window, last window) of each anchor."""
    n = len(text.words)
    if n < WINDOW:
        return
    up, down = powers.of(n + 1)
    word = np.fromiter(map(hashes.__getitem__, text.words), dtype=np.uint64, count=n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * up[:n], dtype=np.uint64)))
    gram = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    gram ^= gram >> np.uint64(33)
    gram *= np.uint64(0xFF51AFD7ED558CCD)
    gram ^= gram >> np.uint64(29)
    width = REACH + 1
    least = np.concatenate(
        [i + np.arange(min(block, n - WINDOW + 1 - i)) + np.lib.stride_tricks.sliding_window_view(gram[i : i + block + REACH], width).argmin(1) for i in range(0, n - WINDOW + 1, block)]
    )
    first = np.concatenate(([0], np.nonzero(np.diff(least))[0] + 1))
    last = np.concatenate((first[1:] - 1, [len(least) - 1]))
    values = gram.view(np.int64)
    for s, e in zip(first.tolist(), last.tolist()):
        p = int(least[s])
        left, right = min(p, REACH), min(n - p, WINDOW)
        context = xxhash.xxh3_64_intdigest(text.part(p - left, p + right), seed=left << 8 | right)
        yield int(values[p]), context - (1 << 64) if context >> 63 else context, p, s, e


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (``NO_ID`` for none), th (a hash of the text: with the id it names the row) and text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")
    )


def _batched(rows: Iterator[tuple], types: list, names: list[str], most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def find_anchors(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()

        def every() -> Iterator[tuple]:
            for batch in batches:
                for id_, th, text in zip(*(batch.column(i) for i in range(3))):
                    id_, th = id_.as_py(), th.as_py()
                    for h, ctx, pos, s, e in anchors(Text(text.as_py()), hashes, powers):
                        yield h, ctx, id_, th, pos, s, e

        yield from _batched(every(), [pa.int64()] * 7, [f.split()[0] for f in ANCHORS.split(", ")])

    return rows.select("id", "th", "text").mapInArrow(run, ANCHORS)


def _windows(texts: DataFrame, held: DataFrame) -> DataFrame:
    """Digests of the windows of the anchors ``held`` (h, ctx and place): h, ctx, id, rel (to the anchor) and digest."""
    wanted = held.groupBy("id", "th").agg(F.collect_list(F.struct("h", "ctx", "pos", "s", "e")).alias("at"))  # a text's own anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for batch in batches:
                for id_, text, at in zip(*(batch.column(i) for i in range(3))):
                    id_, words = id_.as_py(), Text(text.as_py())
                    for a in at.as_py():
                        for start in range(a["s"], a["e"] + 1):
                            yield a["h"], a["ctx"], id_, start - a["pos"], xxhash.xxh3_128_digest(words.part(start, start + WINDOW))

        yield from _batched(every(), [pa.int64()] * 4 + [pa.binary()], ["h", "ctx", "id", "rel", "digest"])

    # the few wanted rows first, so that no other text is looked at for its copies
    one = texts.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "text", "at")
    return one.mapInArrow(run, "h long, ctx long, id long, rel long, digest binary")


class FingerprintIndex:
    """Sorted immutable runs of (anchor hash, context) pairs with the place of their first holder.

    Runs are tables whose files lie in the folder that all executors share. A run's name says which batches it has, so a
    compaction that died before it dropped the runs it had merged leaves none that counts twice.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, fan: int = 4, keep_windows: bool = True):
        self.spark, self.fan, self.keep_windows = spark, fan, keep_windows
        self.columns = ["h", "ctx", *PLACE, *(["turn", "digests"] if keep_windows else [])]
        self.name = name or f"fingerprint_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_root(spark)}/pluvia/{self.name}"

    def _every(self) -> list[tuple[int, int, str]]:
        """First batch, last batch and name of all runs, by batches."""
        found = (re.fullmatch(rf"{self.name}_run([0-9]+)to([0-9]+)_[0-9a-f]+", t.name) for t in self.spark.catalog.listTables())
        return sorted((int(m[1]), int(m[2]), m[0]) for m in found if m)

    def runs(self) -> list[str]:
        every = self._every()
        return [name for a, b, name in every if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in every)]

    def _put(self, pairs: DataFrame, first: int, last: int) -> None:
        name = f"{self.name}_run{first:06d}to{last:06d}_{uuid.uuid4().hex[:6]}"
        dealt = pairs.select(*self.columns).repartition(self.buckets, "h", "ctx")
        writer = dealt.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        writer.bucketBy(self.buckets, "h", "ctx").sortBy("h", "ctx").saveAsTable(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add_run(self, pairs: DataFrame) -> None:
        batch = max((b for _, b, _ in self._every()), default=0) + 1
        self._put(pairs, batch, batch)

    def turn(self) -> int:
        """Number of the next batch; those of a batch are earlier than those of the batches after it."""
        return max((self.spark.table(name).agg(F.max("turn").alias("t")).first().t or 0 for name in self.runs()), default=0) + 1

    def tier(self, name: str) -> int:
        return int(math.log(self.spark.table(name).count() + 1, self.fan))

    def compact(self) -> None:
        """Merge the last runs while ``fan`` of them are of one tier; no pair is in two runs."""
        live = self.runs()
        for _, _, name in self._every():
            if name not in live:
                self._drop(name)
        while len(live) >= self.fan and len({self.tier(name) for name in live[-self.fan :]}) == 1:
            merged = live[-self.fan :]
            whole = self.spark.table(merged[0]).select(*self.columns)
            for name in merged[1:]:
                whole = whole.union(self.spark.table(name).select(*self.columns))
            spans = {name: (a, b) for a, b, name in self._every()}
            self._put(whole, spans[merged[0]][0], spans[merged[-1]][1])
            for name in merged:
                self._drop(name)
            live = self.runs()

    def drop(self) -> None:
        for _, _, name in self._every():
            self._drop(name)


def _first_holders(found: DataFrame, index: FingerprintIndex, scratch: Scratch, tag: str) -> DataFrame:
    """Per pair of the batch: n, the place of its first holder (of history, if there is one) and whether it is new."""
    pairs = found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).withColumn("new", F.lit(True))
    for name in index.runs():
        known = index.spark.table(name).select("h", "ctx", F.struct(*PLACE).alias("old"))
        pairs = pairs.join(known.hint("merge"), ["h", "ctx"], "left")
        pairs = pairs.select("h", "ctx", "n", F.coalesce("old", "first").alias("first"), (F.col("new") & F.col("old").isNull()).alias("new"))
    return scratch.write(pairs.select("h", "ctx", "n", "first.*", "new"), f"pairs-{tag}")


def _batch(rows: DataFrame, texts: DataFrame, index: FingerprintIndex, scratch: Scratch, tag: str, last: bool) -> DataFrame:
    """Repeated stretches (id, th, start, end in words) of a batch; ``texts`` has it and all earlier rows. After the
    ``last`` batch the index isn't looked at again."""
    found = scratch.write(find_anchors(rows), f"anchors-{tag}")
    pairs = _first_holders(found, index, scratch, tag)
    fresh = pairs.filter("new").select("h", "ctx", *PLACE)
    turn = index.turn() if index.keep_windows else 0
    # a kept index may hold a row of this batch from an earlier call: its old pairs are looked at again
    several = (pairs if index.keep_windows else pairs.filter("new")).groupBy("h").agg(F.count_if("new").alias("n"))
    history = [index.spark.table(name).select(*index.columns) for name in index.runs()]
    for run in history:
        several = several.join(run.groupBy("h").agg(F.count("*").alias("more")), "h", "left").select("h", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    several = scratch.write(several.filter("n > 1").select("h", F.col("n").alias("contexts")), f"several-{tag}")
    contexts = several.agg(F.sum("contexts")).first()[0] or 0

    def shared(rows: DataFrame) -> DataFrame:
        """The rows whose anchor came with several contexts."""
        return skewed_lookup(rows, several, "h", "contexts", contexts).drop("contexts")

    if index.keep_windows:
        own = scratch.write(_windows(texts, fresh), f"own-{tag}")
        packed = own.groupBy("h", "ctx").agg(F.array_sort(F.collect_list(F.struct("rel", "digest"))).alias("d"))  # at most WINDOW
        digests = F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("digests")
        fresh = fresh.join(packed.select("h", "ctx", digests), ["h", "ctx"]).withColumn("turn", F.lit(turn).cast("long"))
        windows = shared(own).select(*own.columns).withColumn("turn", F.lit(turn).cast("long"))
        for run in history:
            old = shared(run).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("e") - F.col("s")).cast("int"))))
            digest = F.expr("substring(digests, 16 * k + 1, 16)").alias("digest")
            windows = windows.union(old.select("h", "ctx", "id", (F.col("s") - F.col("pos") + F.col("k")).alias("rel"), digest, "turn"))
    else:
        held = shared(fresh).select(*fresh.columns)
        for run in history:
            held = held.union(shared(run).select(*fresh.columns))
        windows = _windows(texts, held).withColumn("turn", F.lit(0).cast("long"))
    windows = scratch.write(windows, f"windows-{tag}")
    firsts = windows.groupBy("digest").agg(F.min(F.struct("turn", "id")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("digest", F.col("first.turn").alias("first_turn"), F.col("first.id").alias("first_id"), "n")
    firsts = scratch.write(firsts, f"firsts-{tag}")
    again = skewed_lookup(windows, firsts, "digest", "n", windows.count())
    again = again.filter("id <> first_id AND (turn > first_turn OR turn = first_turn AND id > first_id)")
    again = scratch.write(again.groupBy("h", "ctx").agg(F.collect_set("rel").alias("rels")), f"again-{tag}")  # at most WINDOW
    first = pairs.select("h", "ctx", F.col("id").alias("first_id"), "new", "n")
    placed = skewed_lookup(found, first, ["h", "ctx"], "n", found.count())
    whole = placed.filter("id <> first_id AND (NOT new OR first_id < id)").select("id", "th", F.col("s").alias("start"), (F.col("e") + WINDOW).alias("end"))
    some = placed.filter("first_id = id").join(again, ["h", "ctx"]).withColumn("rel", F.explode("rels"))
    some = some.select("id", "th", (F.col("pos") + F.col("rel")).alias("start"), (F.col("pos") + F.col("rel") + WINDOW).alias("end"))
    stretches = scratch.write(whole.union(some), f"stretches-{tag}")
    if not last:  # what nobody will look up isn't written
        index.add_run(fresh)
        index.compact()
    for name in ("anchors", "pairs", "several", "windows", "firsts", "again", *(["own"] if index.keep_windows else [])):
        scratch.drop(f"{name}-{tag}")
    return stretches


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, index: FingerprintIndex | None = None
) -> DataFrame:
    """id, n_words, n_removed and text (the kept words, joined by one space) of each row.

    The rows go through the index as ``batches`` batches in order of id. A given ``index`` lives on: what it holds from
    earlier calls is removed from these rows, whatever their ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    rows = _rows(docs, id_col, text_col)
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / batches for i in range(batches - 1)]).alias("c")).first().c
    edges = [None, *sorted(set(cuts or [])), None]
    own = index or FingerprintIndex(spark, keep_windows=False)
    stretches = None
    try:
        for k, (low, high) in enumerate(zip(edges, edges[1:])):
            upto: Column = F.lit(True) if high is None else F.col("id") <= high
            batch = rows.filter(upto if low is None else upto & (F.col("id") > low))
            found = _batch(batch, rows.filter(upto), own, scratch, str(k), index is None and high is None)
            stretches = found if stretches is None else stretches.union(found)
    finally:
        if index is None:
            own.drop()
    per_row = stretches.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, gone in zip(*(batch.column(i) for i in range(3))):
                words, id_ = (text.as_py() or "").encode("utf-8", "surrogatepass").split(), id_.as_py()
                kept = words
                if gone.is_valid:
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    for g in gone.as_py():
                        steps[g["start"]] += 1
                        steps[g["end"]] -= 1
                    kept = [w for w, inside in zip(words, np.cumsum(steps)) if not inside]
                out.append((None if id_ == NO_ID else id_, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], ["id", "n_words", "n_removed", "text"])

    joined = rows.join(per_row, ["id", "th"], "left").select("id", "text", "gone")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, text string").withColumnRenamed("id", id_col)
