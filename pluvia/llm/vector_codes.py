"""Product codes of vectors: vantage-point trees over the entries of each part's codebook.

Components become integers, vectors are cut into equal parts, and each part has a codebook that a fixed number of
rounds moves to the means of the parts it is nearest to. The nearest entry is found by metric branch and bound in a
vantage-point tree over the entries: a branch is left out only where the triangle inequality, with radii rounded away
from the query and a bound that admits equality, shows that it has no entry as near as the best one. What is visited is
compared by exact integer distances, ties going to the lower entry.

A round is one pass: a task adds up the parts of each entry of its rows, and ``parts * entries`` sums a task are added
up by Spark. The driver sees codebooks only, whose size doesn't grow with the input.

Defined results: rows are left out whose vector is null or empty, has a null or non-finite component, or another length
than that of the smallest id's vector. A null id comes after all others; rows that repeat an id are each coded, in order
of their bytes where they start a codebook. Fewer rows than entries give fewer entries; no rows give no result. A part
length that isn't whole, or a component of 16384 or more at the usual scale, whose distances wouldn't fit 64 bits, is an
error. Only id, vector and label are read, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_left
from pluvia.session import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components are below this, so that squared distances and their sums fit 64 bits.
BOUND = 1 << 26
#: Entries of a branch that isn't split further, and by how much computed distances are widened against rounding.
LEAF, SLACK = 4, 1e-12


@dataclass(frozen=True)
class Branch:
    """Entries below a point of the tree: all of them in ``leaf``, or a vantage entry and two branches.

    ``reach`` is the greatest distance of an inner entry from the vantage entry, ``gap`` the least one of an outer entry;
    ``split`` the squared distance that parts them.
    """

    leaf: tuple[int, ...] = ()
    vantage: int = -1
    split: int = 0
    reach: float = 0.0
    gap: float = 0.0
    inner: Branch | None = None
    outer: Branch | None = None


def plant(entries: np.ndarray, of: tuple[int, ...] | None = None) -> Branch:
    """The tree over ``entries`` (entry, component)."""
    of = tuple(range(len(entries))) if of is None else of
    if len(of) <= LEAF:
        return Branch(leaf=of)
    vantage, rest = of[0], of[1:]
    far = {e: int(((entries[e] - entries[vantage]) ** 2).sum()) for e in rest}
    order = sorted(rest, key=lambda e: (far[e], e))
    inner, outer = order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]
    return Branch(
        vantage=vantage, split=far[inner[-1]], reach=float(np.sqrt(far[inner[-1]])) * (1 + SLACK), gap=float(np.sqrt(far[outer[0]])) * (1 - SLACK),
        inner=plant(entries, tuple(inner)), outer=plant(entries, tuple(outer)),
    )


def nearest(tree: Branch, entries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row (row, component) the nearest entry and its squared distance; and how many distances were measured."""
    best, code = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(entries))
    measured = 0

    def measure(entry: int, who: np.ndarray) -> np.ndarray:
        nonlocal measured
        measured += len(who)
        apart = ((rows[who] - entries[entry]) ** 2).sum(1)
        closer = (apart < best[who]) | ((apart == best[who]) & (entry < code[who]))
        best[who[closer]], code[who[closer]] = apart[closer], entry
        return apart

    def visit(branch: Branch, who: np.ndarray) -> None:
        if not len(who):
            return
        for entry in branch.leaf:
            measure(entry, who)
        if branch.inner is None:
            return
        apart = measure(branch.vantage, who)
        away, near = np.sqrt(apart), apart <= branch.split
        for group, sides in ((near, "io"), (~near, "oi")):
            some, at = who[group], away[group]
            for side in sides:
                within = np.sqrt(best[some])
                if side == "i":
                    visit(branch.inner, some[at * (1 - SLACK) <= (branch.reach + within) * (1 + SLACK)])
                else:
                    visit(branch.outer, some[branch.gap <= (at + within) * (1 + SLACK)])

    visit(tree, np.arange(len(rows)))
    return code, best, measured


def assign(codebooks: np.ndarray, trees: list[Branch], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (row, part) of integer vectors (row, part, component)."""
    found = [nearest(tree, book, vectors[:, k]) for k, (tree, book) in enumerate(zip(trees, codebooks))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _vectors(column: pa.Array, codebooks: np.ndarray) -> np.ndarray:
    whole = np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").astype(np.int64)
    return whole.reshape(len(column), codebooks.shape[0], codebooks.shape[2])


def integer_rows(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """id, label and ``ints``, the floored components as 32-bit numbers, of rows whose vector has ``dim`` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(whole) and np.abs(whole).max() >= BOUND:
                raise ValueError(f"components of {BOUND // scale} or more have distances beyond 64 bits")
            ints = whole.astype("<i4").reshape(len(batch), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in ints], pa.binary())], ["id", "label", "ints"])

    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size("vector") == dim) & whole)
    return kept.mapInArrow(run, f"id long, label {vectors.schema['label'].dataType.simpleString()}, ints binary")


def step(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one more round."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [plant(book) for book in codebooks]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            vectors = _vectors(batch.column(0), codebooks)
            codes, _ = assign(codebooks, trees, vectors)
            for k in range(parts):
                counts[k] += np.bincount(codes[:, k], minlength=entries)
                np.add.at(sums[k], codes[:, k], vectors[:, k])
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()), "n": pa.array([int(counts[k, e]) for k, e in used], pa.int64()),
             "sums": pa.array([sums[k, e].tolist() for k, e in used], pa.list_(pa.int64()))}
        )

    partial = rows.select("ints").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    moved = codebooks.copy()
    for row in total.collect():  # parts * entries rows at most
        moved[row.part, row.entry] = [s // row.n for s in row.sums]
    return moved


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """id, label, code (two hexadecimal digits a part) and error, the sum of squared distances."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [plant(book) for book in codebooks]
        for batch in batches:
            codes, apart = assign(codebooks, trees, _vectors(batch.column(2), codebooks))
            written = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(written, pa.string()), pa.array(apart.sum(1), pa.int64())], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {kind}, code string, error long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """id, label, code, error and label_error (the error of all rows of an equal label) of each row; and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    first = given.filter((F.size("vector") > 0) & whole).orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    dim = len(first[0].vector) if first else parts
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    rows = scratch.write(integer_rows(given, dim, scale), "ints")
    # rows that share an id come in the order of their bytes
    start = rows.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    codebooks = np.array([np.frombuffer(row.ints, "<i4") for row in start], np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):
        codebooks = step(rows, codebooks)
    coded = scratch.write(encode(rows, codebooks), "codes")
    keys = {"no_label": F.col("label").isNull(), "label_key": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    keyed = coded.withColumns(keys)
    groups = scratch.write(keyed.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "groups")
    result = skewed_left(keyed, groups, list(keys), "size", coded.count())
    scratch.drop("ints")
    return result.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), codebooks
