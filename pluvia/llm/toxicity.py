"""Toxicity by two class-conditional Kneser-Ney models.

An expression is a case-folded word (a run of word characters); its lower order is its stem, the first ``STEM``
characters. For each class c, with modified Kneser-Ney discounts D taken from the class's counts of counts,

    P_c(word) = (n_c(word) - D) / N_c + left_c P_c(stem) P(word | stem)
    P_c(stem) = (n_c(stem) - D) / N_c + left_c P(stem)

where "left" is the share that the discounts take off. The backoff distributions are the same for both classes:
P(stem) is the stem's continuation count (how many different words begin with it) and P(word | stem) comes from the
pooled counts. So a rare expression gives nearly the same probability in both models and says little, an unseen form of a
known stem says what its stem says, and words of unseen stems all say the same. A text's evidence is the mean log-ratio
of its words (the length-normalised log-likelihood, toxic less ordinary), the same over its worst passage of ``WINDOW`` words, the mean and
the largest ratio above ``STRONG``, and the log length; a logistic curve over these gives the score.

Counts are exact, from all labelled training rows, and stay in a Spark table that grows with the corpus; words are named
by 64-bit hashes. Scoring reads the most frequent expressions, ``hot`` at most, from a broadcast, and with them a filter
of a fixed size that says which others can be in the table; a text that has such gets their ratios by a join. The curve alone is fitted on a sample of about ``curve_rows`` training rows, each scored by
the counts of the half that it isn't in. The sample is drawn per class, and weights restore the classes' shares. The
halves are the two training folds; if a class has words in one of them alone, ids are dealt to halves anew.

Defined results: null, empty and word-less texts get the score of no evidence. Several labels of one id: toxic if any
is. Null labels are no labels. Without a toxic or without an ordinary training row, or where a class has words under
fewer than two ids (so that no curve can be fitted on rows held out of the counts), every score is the training rows'
toxic share (0.5 without rows). Rows that repeat an id are scored each. Score inputs are the text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_lookup
from pluvia.session import Scratch

STEM, WINDOW, STEP, STRONG, FOLDS = 5, 20, 10, 1.5, 3
UNSEEN_FORM = 1 / 64  # what an unseen form of a stem counts as in P(word | stem)
HOT, FILTER_BITS = 1 << 17, 1 << 25
SETS = ("first", "second", "all")  # counts of either half, and of both


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def hashed_stems(words: list[str]) -> np.ndarray:
    return hashed([f"{w[:STEM]}*" for w in words])  # no word has the mark


FILTER_SHIFTS = (0, 32)


def _bits(rows: DataFrame, key: Column) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits of the 64-bit keys."""
    places = F.explode(F.array(*[F.shiftright(key, k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in FILTER_SHIFTS])).alias("at")
    bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    words = rows.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may have the keys."""
    said = np.ones(len(keys), bool)
    for shift in FILTER_SHIFTS:
        at = (keys >> shift) & (FILTER_BITS - 1)
        said &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return said


class Vocabulary(dict):
    """Places of words in the list ``words``; to be emptied when it gets large."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most, self.words = most, []
        self.find = re.compile(r"\w+").findall

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        return at

    def full(self) -> bool:
        return len(self) >= self.most

    def clear(self) -> None:
        super().clear()
        self.words = []

    def places(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, self.find((text or "").lower())), dtype=np.int64)


class Evidence:
    """What a text's log-ratios say, as sums, so that ratios that come later can be added.

    Passages are ``WINDOW`` words that begin at every ``STEP``-th; a text shorter than one is taken as padded by zeros.
    """

    SIZE = 5

    def __init__(self, n: int, total: float, strong: float, strongest: float, passage: float):
        self.n, self.total, self.strong, self.strongest, self.passage = n, total, strong, strongest, passage

    @staticmethod
    def passages(at: int, n: int) -> range:
        """Numbers of the passages of a text of ``n`` words that the word at ``at`` stands in."""
        last = max(0, -(-(n - WINDOW) // STEP))
        return range(max(0, (at - WINDOW) // STEP + 1), min(at // STEP, last) + 1)

    @classmethod
    def of(cls, r: np.ndarray) -> tuple[Evidence, dict[int, float]]:
        """Evidence of the ratios that aren't NaN, without the passages that have a NaN, and what those have so far."""
        n, known = len(r), np.nan_to_num(r.astype(np.float64))
        if not n:
            return cls(0, 0.0, 0.0, 0.0, 0.0), {}
        strong = np.maximum(known - STRONG, 0)
        sums = np.concatenate(([0.0], np.cumsum(known)))
        first = np.arange(max(0, -(-(n - WINDOW) // STEP)) + 1) * STEP
        passages = sums[np.minimum(first + WINDOW, n)] - sums[first]
        missing = {k for at in np.nonzero(np.isnan(r))[0].tolist() for k in cls.passages(at, n)}
        left = {k: float(passages[k]) for k in sorted(missing)}
        passages[list(missing)] = -np.inf
        return cls(n, float(known.sum()), float(strong.sum()), float(strong.max()), float(passages.max())), left

    def add(self, late: list[tuple[int, float]], left: dict[int, float]) -> None:
        for at, r in late:
            self.total += r
            self.strong += max(r - STRONG, 0)
            self.strongest = max(self.strongest, r - STRONG)
            for k in self.passages(at, self.n):
                left[k] += r
        self.passage = max(self.passage, *left.values())

    def values(self) -> tuple[float, ...]:
        return self.total / max(1, self.n), self.passage / WINDOW, float(np.log1p(self.n)), self.strong / max(1, self.n), self.strongest


def logistic_fit(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the last for the constant) by Newton steps; a row stands for ``counts`` rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (counts * (p - y)) + ridge * w)
    return w


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text (compressed), whether it has words, toxic and fold of the labelled rows outside the held-out third.

    A filter of a fixed size on the labelled ids leaves out most other rows before their texts are shuffled.
    """
    fold = F.crc32(F.col("id").cast("string")) % FOLDS
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).filter(fold != 1)
    bits = docs.sparkSession.sparkContext.broadcast(_bits(marked, F.xxhash64("id")))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, word = zstandard.ZstdCompressor(level=3), re.compile(r"\w").search
        for batch in batches:
            keys = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(_marked(bits.value, keys)))
            texts = [pack.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            worded = [word(t.as_py() or "") is not None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(worded, pa.bool_())], ["id", "packed", "worded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(fold != 1).withColumn("hash", F.xxhash64("id"))
    # merged at every size: labels grow with the corpus and are never broadcast
    return rows.mapInArrow(shrink, "id long, packed binary, worded boolean").join(marked.hint("merge"), "id").withColumn("fold", fold)


def _halves(train: DataFrame) -> Column | None:
    """Whether a training row is in the second half, such that each class has words in both halves; None if none does."""
    ways = [F.col("fold") == 2, *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 1 for k in range(32))]
    for tried in (ways[:1], ways[1:]):
        ends = [f(w).alias(f"{f.__name__}{k}") for k, w in enumerate(tried) for f in (F.min, F.max)]
        classes = train.filter("worded").groupBy(F.col("toxic") == 0).agg(*ends).collect()  # two rows
        for k, way in enumerate(tried):
            if len(classes) == 2 and all(c[f"min{k}"] != c[f"max{k}"] for c in classes):
                return way
    return None


def _counts(train: DataFrame) -> DataFrame:
    """Words by key: stem and counts of toxic and ordinary rows, by half (first_t, first_o, second_t, second_o)."""
    names = [f"{s}_{c}" for s in SETS[:2] for c in "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, open_, total = Vocabulary(), zstandard.ZstdDecompressor(), np.zeros((1024, 4), dtype=np.int64)

        def held() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(words), 1 << 16):
                part = words.words[i : i + (1 << 16)]
                columns = [hashed(part), hashed_stems(part), *total[i : i + len(part)].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "stem", *names])

        for batch in batches:
            for packed, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, n = np.unique(words.places(open_.decompress(packed).decode("utf-8", "surrogatepass")), return_counts=True)
                if len(total) < len(words):
                    total = np.concatenate((total, np.zeros((len(words), 4), dtype=np.int64)))
                total[found, half * 2 + (toxic == 0)] += n
                if words.full():
                    yield from held()
                    words.clear()
                    total[:] = 0
        yield from held()

    rows = train.select("packed", "toxic", "half").mapInArrow(run, "key long, stem long, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("key", "stem").agg(*[F.sum(n).alias(n) for n in names])


def _every_set(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"all_{c}": F.col(f"first_{c}") + F.col(f"second_{c}") for c in "to"})


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts of one, of two and of more, from counts of counts (Chen and Goodman 1999)."""
    n1, n2, n3, n4 = (max(n, 1) for n in (ones, twos, threes, fours))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Order:
    """Discounts and the share they take off, of one class in one set of counts."""

    def __init__(self, kept: int, ones: int, twos: int, threes: int, fours: int, total: int):
        self.d, self.total = discounts(ones, twos, threes, fours), max(total, 1)
        self.left = (self.d[0] * ones + self.d[1] * twos + self.d[2] * (kept - ones - twos)) / self.total

    def rest(self, count: str) -> Column:
        """The share that a count keeps."""
        off = F.when(F.col(count) == 1, self.d[0]).when(F.col(count) == 2, self.d[1]).otherwise(self.d[2])
        return F.when(F.col(count) > 0, (F.col(count) - off) / self.total).otherwise(0.0)


def _orders(counted: DataFrame) -> dict[str, Order]:
    columns = [f"{s}_{c}" for s in SETS for c in "to"]
    tests = lambda c: [F.count_if(F.col(c) > 0), *(F.count_if(F.col(c) == k) for k in (1, 2, 3, 4)), F.sum(c)]
    row = counted.agg(*[t for c in columns for t in tests(c)]).first()
    return {c: Order(*(v or 0 for v in row[6 * i : 6 * i + 6])) for i, c in enumerate(columns)}


def _ratios(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, float]]:
    """key, n and the log-ratio by each set of counts, of words and of stems (what an unseen form of them says); and by
    set what a word of an unseen stem says."""
    forms = [F.count_if(F.col(f"{s}_t") + F.col(f"{s}_o") > 0).alias(f"{s}_forms") for s in SETS]
    stems = scratch.write(words.groupBy("stem").agg(F.count("*").alias("forms"), *forms, *[F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in SETS for c in "to"]), "stems")
    of_words, of_stems = _orders(words), _orders(stems)
    sums = stems.agg(F.sum("forms").alias("forms"), *[F.sum(f"{s}_forms").alias(s) for s in SETS]).first()
    stem_probability, unseen = {}, {}
    for s in SETS:
        base = (F.col(f"{s}_forms") + 0.5) / float((sums[s] or 0) + 1)
        for c in "to":
            stem_probability[f"{s}_{c}"] = of_stems[f"{s}_{c}"].rest(f"{s}_{c}") + of_stems[f"{s}_{c}"].left * base
        unseen[s] = float(np.log(of_words[f"{s}_t"].left * of_stems[f"{s}_t"].left / (of_words[f"{s}_o"].left * of_stems[f"{s}_o"].left)))
    stems = stems.select(
        "stem", "forms", *[p.alias(f"p_{name}") for name, p in stem_probability.items()], *[(F.col(f"{s}_t") + F.col(f"{s}_o")).alias(f"{s}_stem") for s in SETS]
    )
    placed = skewed_lookup(words, stems, "stem", "forms", sums.forms or 0)

    def probability(s: str, c: str) -> Column:
        form = (F.col(f"{s}_t") + F.col(f"{s}_o") + UNSEEN_FORM) / (F.col(f"{s}_stem") + 1)
        return of_words[f"{s}_{c}"].rest(f"{s}_{c}") + of_words[f"{s}_{c}"].left * F.col(f"p_{s}_{c}") * form

    n = (F.col("all_t") + F.col("all_o")).alias("n")
    known = placed.select("key", n, *[F.ln(probability(s, "t") / probability(s, "o")).cast("float").alias(s) for s in SETS])
    kin = stems.select(
        F.col("stem").alias("key"), F.col("all_stem").alias("n"),
        *[F.ln(of_words[f"{s}_t"].left * F.col(f"p_{s}_t") / (of_words[f"{s}_o"].left * F.col(f"p_{s}_o"))).cast("float").alias(s) for s in SETS],
    )
    return scratch.write(known.unionByName(kin), "ratios"), unseen


class ToxicityModel:
    """Log-ratios of all expressions (a table, null for a constant model), those of unseen stems, and the curve."""

    def __init__(self, ratios: DataFrame | None, unseen: dict[str, float], weights: np.ndarray, hot: int = HOT):
        self.ratios, self.unseen, self.weights, self.hot = ratios, unseen, weights, hot

    @cached_property
    def hottest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sorted keys and ratios (a column a set) of the most frequent expressions, and a filter of the keys of all
        (None where the first are all)."""
        size = F.floor(F.log2("n") * 8).cast("int")
        steps = sorted(self.ratios.groupBy(size.alias("size")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["size"])  # 512 rows at most
        total, least = 0, None
        for step in steps:
            if total + step.k > self.hot:
                break
            total, least = total + step.k, step["size"]
        got = self.ratios.filter(size >= least if least is not None else F.lit(False)).select("key", *SETS).toArrow()  # ``hot`` rows at most
        keys = got.column("key").to_numpy()
        order = np.argsort(keys)
        values = np.column_stack([got.column(s).to_numpy() for s in SETS])[order]
        return keys[order], values, None if total == sum(s.k for s in steps) else self._filter(size < least if least is not None else F.lit(True))

    def _filter(self, rest: Column) -> np.ndarray:
        return _bits(self.ratios.filter(rest), F.col("key"))


class Lookup:
    """Ratios of a text's words; NaN where only the table knows. ``bits`` is None where the broadcast has all keys."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, bits: np.ndarray | None, unseen: float):
        self.keys, self.values, self.bits, self.unseen = keys, ratios, bits, unseen
        self.words, self.known, self.filled = Vocabulary(), np.zeros(1024, np.float32), 0

    def _of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)

    def _maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether the table may have the keys."""
        if self.bits is None:
            return np.zeros(len(keys), bool)
        return _marked(self.bits, keys)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of a text's words and their places in the vocabulary."""
        if self.words.full():
            self.words.clear()
            self.filled = 0
        at = self.words.places(text)
        if self.filled < len(self.words):
            new = self.words.words[self.filled :]
            keys = hashed(new)
            found = self._of(keys)
            rest = np.nonzero(np.isnan(found) & ~self._maybe(keys))[0]
            stems = hashed_stems([new[i] for i in rest])
            kin = self._of(stems)
            found[rest] = np.where(np.isnan(kin) & ~self._maybe(stems), self.unseen, kin)
            if len(self.known) < len(self.words):
                self.known = np.concatenate((self.known, np.zeros(len(self.words), np.float32)))
            self.known[self.filled : len(self.words)] = found
            self.filled = len(self.words)
        return self.known[at], at


ROW, X, LEFT, TEXT = (f"__toxicity_{name}__" for name in ("row", "evidence", "left", "text"))
LEFT_TYPE = (
    "struct<sums: struct<n: long, total: double, strong: double, strongest: double, passage: double>,"
    " passages: array<struct<k: int, r: double>>, words: array<struct<pos: int, key: long, stem: long>>>"
)


def _with_evidence(rows: DataFrame, text_col: str, keep: list[str], model: ToxicityModel, which: str, scratch: Scratch, packed: bool = False) -> DataFrame:
    """The columns ``keep`` of each row, and its text's evidence.

    A row with words that only the table knows gets them by a join on their keys, and then on the row's number; of the
    text it needs no more than its sums and the passages that those words stand in.
    """
    keys, ratios, bits = model.hottest
    shared = rows.sparkSession.sparkContext.broadcast((keys, np.ascontiguousarray(ratios[:, SETS.index(which)]), bits, model.unseen[which]))
    left_type = pa.struct([
        ("sums", pa.struct([("n", pa.int64()), *((f, pa.float64()) for f in ("total", "strong", "strongest", "passage"))])),
        ("passages", pa.list_(pa.struct([("k", pa.int32()), ("r", pa.float64())]))), ("words", pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("stem", pa.int64())]))),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, open_ = Lookup(*shared.value), zstandard.ZstdDecompressor()
        for batch in batches:
            found, late = [], []
            for text in batch.column(0):
                text = open_.decompress(text.as_py()).decode("utf-8", "surrogatepass") if packed else text.as_py()
                r, at = lookup(text)
                sums, passages = Evidence.of(r)
                if not passages:
                    found.append(sums.values())
                    late.append(None)
                    continue
                missing = np.nonzero(np.isnan(r))[0]
                words = [lookup.words.words[k] for k in at[missing].tolist()]
                places = zip(missing.tolist(), hashed(words).tolist(), hashed_stems(words).tolist())
                found.append(None)
                late.append({"sums": vars(sums), "passages": [{"k": k, "r": v} for k, v in passages.items()], "words": [{"pos": p, "key": k, "stem": s} for p, k, s in places]})
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.float64())), pa.array(late, left_type)], [*keep, X, LEFT])

    kept = [F.col(f"`{c}`") for c in keep]
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    first = rows.select(F.col(f"`{text_col}`").alias(TEXT), *kept).mapInArrow(read, f"{fields}{X} array<double>, {LEFT} {LEFT_TYPE}")
    if bits is None:
        return first.drop(LEFT)
    first = scratch.write(first.withColumn(ROW, F.monotonically_increasing_id()), f"read-{which}")
    late = first.filter(F.col(LEFT).isNotNull())
    words = late.select(ROW, F.explode(f"{LEFT}.words").alias("w")).select(ROW, "w.*")
    values = model.ratios.select("key", F.col(which).alias("r"))
    wanted = scratch.write(words.groupBy("key", "stem").agg(F.count("*").alias("uses")), f"wanted-{which}")
    known = wanted.join(values, "key", "left").join(values.select(F.col("key").alias("stem"), F.col("r").alias("kin")), "stem", "left")
    known = scratch.write(known.select("key", "uses", F.coalesce("r", "kin", F.lit(model.unseen[which])).alias("r")), f"known-{which}")
    filled = skewed_lookup(words.drop("stem"), known, "key", "uses", known.agg(F.sum("uses")).first()[0] or 0)
    filled = filled.groupBy(ROW).agg(F.collect_list(F.struct("pos", "r")).alias("filled"))  # a text's own words

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, filled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = Evidence(**left["sums"])
                sums.add([(w["pos"], w["r"]) for w in sorted(filled, key=lambda w: w["pos"])], {p["k"]: p["r"] for p in left["passages"]})
                found.append(sums.values())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.list_(pa.float64()))], [*keep, X])

    rest = late.select(ROW, F.struct(f"{LEFT}.sums", f"{LEFT}.passages").alias(LEFT), *kept).join(filled, ROW).select(LEFT, "filled", *kept)
    return first.filter(F.col(LEFT).isNull()).select(*kept, X).union(rest.mapInArrow(fill, f"{fields}{X} array<double>"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", curve_rows: int = 20_000, hot: int = HOT
) -> ToxicityModel:
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.write(_training(docs, labels, id_col, text_col, label_col), "train")
    shares = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = shares.n, shares.toxic or 0
    half = _halves(train) if 0 < toxic < n else None
    if half is None:
        share = (toxic + 0.5) / (n + 1)
        scratch.drop()
        return ToxicityModel(None, {}, np.array([0.0] * Evidence.SIZE + [np.log(share / (1 - share))]))
    train = train.withColumn("half", half)
    ratios, unseen = _ratios(_every_set(scratch.write(_counts(train), "words")), scratch)
    model = ToxicityModel(ratios, unseen, np.zeros(Evidence.SIZE + 1), hot)
    sizes, drawn = {1: toxic, 0: n - toxic}, []
    for c, size in sizes.items():  # each class gets half of the rows, and what the other class leaves
        rows, room = train.filter(F.col("toxic") == c), max(curve_rows // 2, curve_rows - sizes[1 - c])
        chosen = rows.filter(F.pmod(F.xxhash64("id", "packed"), F.lit(1 << 30)) < int(min(1.0, room / size) * (1 << 30)))
        # rows that are the same throughout are one, with their number; a few that hold a whole class may all be passed over
        drawn.append((rows if chosen.isEmpty() else chosen).groupBy("id", "packed", "toxic", "half").agg(F.count("*").alias("copies")))
    sample = scratch.write(drawn[0].union(drawn[1]), "sample")
    data = []
    for second, which in ((False, "second"), (True, "first")):  # a row of a half is scored by the other half's counts
        got = _with_evidence(sample.filter(F.col("half") == second), "packed", ["toxic", "copies"], model, which, scratch, packed=True).toArrow()
        data += [(*x, t, k) for x, t, k in zip(*(got.column(c).to_pylist() for c in (X, "toxic", "copies")))]  # about ``curve_rows``
    data = np.array(sorted(data), dtype=np.float64)
    x, y, copies = data[:, :-2], data[:, -2], data[:, -1]
    stands = copies * np.where(y == 1, toxic / max(1, copies[y == 1].sum()), (n - toxic) / max(1, copies[y == 0].sum()))
    model.weights = logistic_fit(x, y, stands * len(data) / n)
    for name in ("train", "words", "stems", "sample"):
        scratch.drop(name)
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """id and score of each row; with ``keep`` all columns of ``docs`` and the score under that name."""
    rows = docs if keep else docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    kept = docs.columns if keep else [id_col]
    if model.ratios is None:
        found = rows.withColumn(X, F.array(*[F.lit(0.0)] * Evidence.SIZE))
    else:
        found = _with_evidence(rows, text_col, kept, model, "all", Scratch(docs.sparkSession, "toxicity-score"))
    w = [float(x) for x in model.weights]
    line = sum((F.get(X, F.lit(i)) * w[i] for i in range(Evidence.SIZE)), F.lit(w[-1]))
    line = F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))
    return found.select(*[F.col(f"`{c}`") for c in kept], (1 / (1 + F.exp(-line))).alias(keep or "score"))
