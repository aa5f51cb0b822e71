"""Exact dedup over a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by digest, a partition a batch. A batch of new
documents is reduced to one row per digest, removed of known digests by a sort-merge anti-join (the index side is read in
place, without a shuffle), and appended.

A batch counts once it is committed, which is after its result is written: manifests, numbered files of which the last
one holds, name the partitions that count. A call that dies leaves partitions that no manifest names; they are nobody's
history, and the same call made again under its ``batch`` name is whole. Compaction writes beside, then commits, then
deletes what no manifest names.

Defined results:

* A null text counts as the empty text. Runs of white space count as one space, also at the ends of a text.
* Among equal texts the smallest id stays; a null id loses against any other. Rows that repeat an id and its text are
  copies too: exactly one of them has ``kept`` true.
* A batch name that is already in the index is done again: its own earlier rows aren't history to it.
* An empty input gives an empty result and leaves the index as it was. Columns other than id and text are never read,
  so their names can't clash.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.skew import skewed_left
from pluvia.session import Scratch, exists, shared_root

WHITE = r"[\x20\x09-\x0D]+"
COLUMNS = "digest BINARY, first_id BIGINT, first_row BIGINT, call STRING"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """Digests of all committed texts: ``digest``, ``first_id`` and ``first_row`` of the row that stays, and ``call``, the
    batch that brought it.

    It lies in ``path``, by default in the folder that all executors share, and is opened again by any session; the number
    of buckets is settled when it is made. Each batch adds files to the buckets; Spark merges a bucket's sorted files by one
    local sort. ``compact`` rewrites the index to one file a bucket. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{shared_root(spark)}/pluvia/digest-index-{uuid.uuid4().hex[:12]}").rstrip("/")
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        state = self._read()
        self.buckets = state["buckets"] if state else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not state:
            self._commit([])
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({COLUMNS}, batch STRING) USING parquet PARTITIONED BY (batch)"
                f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
            )
        if exists(spark, f"{self.path}/rows"):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, files = self._files(f"{self.path}/manifests")
        found = files.listStatus(at) if files.exists(at) else []
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"([0-9]+)\.json", f.getPath().getName())))

    def _read(self) -> dict | None:
        """The state that holds: ``buckets`` and the committed ``batches``."""
        versions = self._versions()
        if not versions:
            return None
        at, files = self._files(f"{self.path}/manifests/{versions[-1]:08d}.json")
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, batches: list[str]) -> None:
        """Make ``batches`` the ones that count: a file that is whole when it gets its name."""
        version = (self._versions() or [0])[-1] + 1
        new, files = self._files(f"{self.path}/manifests/{version:08d}.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "batches": batches}).encode()))
        out.close()
        if not files.rename(new, self._files(f"{self.path}/manifests/{version:08d}.json")[0]):
            raise RuntimeError(f"another writer committed version {version} of {self.path}")

    def batches(self) -> list[str]:
        return self._read()["batches"]

    def table(self, also: list[str] = (), without: str | None = None) -> DataFrame:
        """Rows of the committed partitions and of ``also``, but none of the call ``without`` from elsewhere than ``also``."""
        rows = self.spark.table(self.name).filter(F.col("batch").isin([*self.batches(), *also]))
        if without is not None:
            rows = rows.filter((F.col("call") != without) | F.col("batch").isin(list(also)))
        return rows

    def _put(self, rows: DataFrame, batch: str) -> None:
        """Write a new partition."""
        # dealt out as the buckets are, so that each task writes one file and not one for every bucket
        view = f"put_{uuid.uuid4().hex[:12]}"
        rows.repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT INTO {self.name} PARTITION (batch = '{batch}') SELECT digest, first_id, first_row, call FROM {view}")
        self.spark.catalog.dropTempView(view)

    def append(self, digests: DataFrame, call: str, also: list[str] = ()) -> str:
        """Write the unseen digests of a part of a call, uncommitted; the name of the partition. ``digests``: id, row_id,
        digest; parts come in order of id and pass the names of the earlier ones."""
        first = digests.groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_id")).alias("first")
        )
        # written, as the optimizer would else move the anti-join below the aggregate and shuffle every copy
        scratch = Scratch(self.spark, "digest-batch")
        fresh = scratch.write(first, "first").hint("merge").join(self.table(also, call), "digest", "left_anti")
        part = f"{call}.{len(also):04d}.{uuid.uuid4().hex[:12]}"  # another name each time: an earlier attempt's files stay as they are
        self._put(fresh.select("digest", F.col("first.id").alias("first_id"), F.col("first.row_id").alias("first_row"), F.lit(call).alias("call")), part)
        scratch.drop()
        return part

    def commit(self, parts: list[str], call: str) -> None:
        """Make the parts of a call count, in place of those of an earlier attempt."""
        self._commit([*(b for b in self.batches() if not re.fullmatch(rf"{call}\.[0-9]+\.[0-9a-f]+", b)), *parts])

    def compact(self) -> None:
        """Rewrite to one sorted file a bucket, after many batches; partitions that don't count go."""
        order = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_row", "call")
        rows = self.table().groupBy("digest").agg(F.min(order).alias("r")).select("digest", "r.first_id", "r.first_row", "r.call")
        whole = f"whole-{uuid.uuid4().hex[:12]}"
        self._put(rows, whole)
        self._commit([whole])
        self.clean()

    def clean(self) -> None:
        """Delete partitions and manifests that don't count."""
        keep, last = set(self.batches()), self._versions()[-1]
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():  # a row a batch
            batch = row[0].removeprefix("batch=")
            if batch not in keep:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{batch}')")
                at, files = self._files(f"{self.path}/rows/batch={batch}")
                files.delete(at, True)
        for version in self._versions():
            if version < last:
                at, files = self._files(f"{self.path}/manifests/{version:08d}.json")
                files.delete(at, True)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at, files = self._files(self.path)
        files.delete(at, True)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row_id and the 32-byte digest of each row; the text itself goes no further."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, index: DigestIndex | None = None, batch: str | None = None
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The rows go through the index as ``batches`` parts in order of id, so the first row of a digest to arrive is the one
    that stays. A given ``index`` lives on and its committed texts stay ahead of the new ones; else one is made for this
    call and dropped. ``batch`` names the call (letters, digits, ``_`` and ``-``): after a crash the call is made again
    under the same name.

    After the digests are counted no row of a large group is dealt by its digest: large groups are broadcast to their
    rows, and only groups of two or more are looked up at all.
    """
    call = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_-]+", call):
        raise ValueError(f"not a batch name: {call!r}")
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    try:
        return _deduped(docs, id_col, text_col, batches, index, call, own)
    finally:
        if own:
            index.drop()


def _deduped(docs: DataFrame, id_col: str, text_col: str, batches: int, index: DigestIndex, call: str, own: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.write(digest_rows(docs, id_col, text_col), "digests")
    cuts = rows.agg(F.percentile_approx("id", [(i + 1) / batches for i in range(batches - 1)]).alias("c")).first().c
    edges = [None, *sorted(set(cuts or [])), None]
    parts: list[str] = []
    for low, high in zip(edges, edges[1:]):
        part = F.lit(True) if low is None else (F.col("id") > low) | F.col("id").isNull()
        if high is not None:
            part = part & (F.col("id") <= high)
        parts.append(index.append(rows.filter(part), call, parts))
    groups = rows.groupBy("digest").agg(F.count("*").alias("size"))
    if own:
        groups = groups.filter("size > 1")
    # of rows that a batch done again has doubled, one
    known = groups.join(index.table(parts, call).select("digest", F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "first_row", "call").alias("r")), "digest")
    known = known.groupBy("digest", "size").agg(F.min("r").alias("r"))
    group = scratch.write(known.select("digest", "size", "r.first_id", "r.first_row", "r.call"), "groups")
    seen = skewed_left(rows, group, ["digest"], "size", rows.count())
    alone = F.col("size").isNull()
    result = scratch.write(
        seen.select(
            F.col("id").alias(id_col),
            F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | ((F.col("call") == call) & (F.col("row_id") == F.col("first_row")))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        ),
        "result",
    )
    if not own and not rows.isEmpty():
        index.commit(parts, call)
    for name in ("digests", "groups"):
        scratch.drop(name)
    return result
