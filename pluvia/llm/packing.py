"""Packing along a space-filling curve.

Each document's tokens are hashed into a signed vector and projected to three dimensions; the corpus is sorted by the
Hilbert key of that point, so that documents of like wording are neighbours, and the sorted token stream is cut every
``length`` tokens. Only the last sequence can need padding.

The texts are read once: token ids go to a scratch table, the order is found on rows of a few numbers, and the ids are
then joined with their place in the stream. The driver sees one total per partition.

Defined results: a null text counts as empty and gives the end id alone. Ties of the Hilbert key keep the order of the
rows. Rows that repeat an id are packed each. An empty table gives no pieces. Only id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import Scratch

DIMENSIONS, KEY_BITS, HASH_SIZE, LONG_WHITE = 3, 10, 1 << 12, 100_000


def token_encoder(ranks_path: str, pattern: str):
    """A function from a text to its ids (little-endian unsigned 32 bits).

    ``ranks_path`` has a byte-level BPE vocabulary as lines of base64 bytes and rank, ``pattern`` is what texts are split
    by first. The ids are those of the tokenizer with the same vocabulary in the ``tokenizers`` library, which takes
    three times as long; the tests compare the two. Texts that the two could differ on go whole through that library's
    file, which lies beside ``ranks_path``: those that hold one of its added tokens (which is one id there), and those
    with a white-space run of ``LONG_WHITE``, as the rank encoder fails on runs near a million characters.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(PurePath(ranks_path).with_suffix(".json")))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    long_white = re.compile(rf"(?<!\s)\s{{{LONG_WHITE}}}").search

    def ids(text: str) -> list[int]:
        if any(t in text for t in added) or len(text) >= LONG_WHITE and long_white(text):
            return whole.encode(text, add_special_tokens=False).ids
        return encode(text)

    return lambda text: np.array(ids(text), dtype="<u4").tobytes()


def projection(vocabulary: int, seed: int = 7) -> np.ndarray:
    """The contribution of every id to the projected document vector: sign and bucket by hash, then a fixed matrix."""
    draw = np.random.default_rng(seed)
    matrix = draw.standard_normal((HASH_SIZE, DIMENSIONS))
    mixed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket, sign = mixed >> np.uint64(52), 1.0 - 2.0 * ((mixed >> np.uint64(51)) & np.uint64(1)).astype(np.float64)
    return (matrix[bucket.astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            flip = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ flip)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ flip)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokens(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(ranks_path, pattern)
        end = np.array([end_id], dtype="<u4").tobytes()
        weights = projection(1 << 17)
        for batch in batches:
            ids = [encode(t.as_py() or "") + end for t in batch.column(2)]
            means = [weights[np.frombuffer(x, "<u4") % len(weights)].mean(0, dtype=np.float64) for x in ids]
            places = np.array(means, dtype=np.float64).reshape(-1, DIMENSIONS)
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() if narrow(x) else x for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(small, pa.binary())]
                + [pa.array(places[:, i]) for i in range(DIMENSIONS)],
                ["id", "row_id", "n", "ids", *AXES],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, row_id long, n long, ids binary, " + ", ".join(f"{a} double" for a in AXES))


AXES = [f"x{i}" for i in range(DIMENSIONS)]


def narrow(ids: bytes) -> bool:
    return bool(len(ids)) and int(np.frombuffer(ids, "<u4").max()) < 1 << 16


def _ordered(rows: DataFrame, partitions: int) -> DataFrame:
    """row_id, part and the tokens before the row in its part; parts follow one another along the curve."""
    spread = rows.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.avg, F.stddev_pop)]).first()
    centre = [spread[f"avg_{a}"] or 0.0 for a in AXES]
    scale = [spread[f"stddev_pop_{a}"] or 1.0 for a in AXES]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([batch.column(2 + i).to_numpy() for i in range(DIMENSIONS)]).T
            even = 1 / (1 + np.exp(np.clip(-1.7 * (at - centre) / scale, -60, 60)))  # near the normal distribution's share
            cells = np.minimum((even * (1 << KEY_BITS)).astype(np.int64), (1 << KEY_BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(cells))], ["row_id", "n", "key"])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            start = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(start)], ["row_id", "n", "part", "start"]
            )

    keyed = rows.select("row_id", "n", *AXES).mapInArrow(keys, "row_id long, n long, key long")
    dealt = keyed.repartitionByRange(partitions, "key", "row_id").sortWithinPartitions("key", "row_id")
    return dealt.mapInArrow(before, "row_id long, n long, part int, start long")


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0
) -> DataFrame:
    """One row per piece of a document: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers, the whole document's followed by
    ``end_id``. Pieces of a sequence follow one another by ``offset`` without a gap.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.write(_tokens(docs, id_col, text_col, ranks_path, pattern, end_id), "tokens")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = scratch.write(_ordered(rows, partitions), "order")
    totals = {r.part: r.n for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row per partition
    first, parts = 0, []
    for part in sorted(totals):
        parts.append((part, first))
        first += totals[part]
    places = order.join(F.broadcast(spark.createDataFrame(parts, "part int, first long")), "part")
    places = places.select("row_id", (F.col("first") + F.col("start")).alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            pieces = []
            for doc, n, ids, place in zip(*(batch.column(i).to_pylist() for i in range(4))):
                whole = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(place + at, length)
                    size = min(length - offset, n - at)
                    pieces.append((doc, at, size, whole[4 * at : 4 * (at + size)], n, sequence, offset))
                    at += size
                if len(pieces) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], names)
                    pieces = []
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], names)

    joined = rows.select("row_id", "id", "n", "ids").join(places, "row_id").select("id", "n", "ids", "place")
    return joined.mapInArrow(cut, f"`{id_col}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids of each sequence, padded to ``length`` unless its length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                even = len(ids) & (len(ids) - 1) == 0
                out.append(ids if even else np.pad(ids, (0, length - len(ids)), constant_values=pad_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return whole.mapInArrow(join, "sequence_id long, ids array<int>")
