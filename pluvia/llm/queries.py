"""The numbered queries: each applies its operator to a whole table and derives the columns to compare."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import exact_dedup, html_extract, packing, periodic_runs, pii, quality, secret_scan, sentencepiece_codec, simhash, substring_dedup, toxicity, vector_codes, warc
from pluvia.session import Scratch
from pluvia.sources import table

SPACE = r"[\x20\x09-\x0D]+"


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS r(i)),
again AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM again, range(0, 50) AS r(k)),
gones AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM tok ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN gones USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode_too=True)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.write(warc.write_archives(table(spark, sf_dir, "pages"), scratch.uri("archives")), "manifest")
    return warc.resolved(warc.read_archives(manifest))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS response_id FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, 1 + (5 * i) // 4, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM p JOIN r USING (h)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


OP6_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five,
               lead(i, 4) OVER o AS last
        FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM win WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS r(k) GROUP BY doc_id),
f AS (SELECT doc_id, words, lines, len(words) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN cover USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\pL'))) > 3 * n_words
            OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > 6 * n_words
            OR 50 * len(list_distinct(words)) < n_words OR len(list_filter(words, lambda x: length(x) > 1000)) > 0
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}\x{{b7}}]'))) > 9 * n_lines
            OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) > 3 * n_lines) AS kept
FROM g
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 1
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _counts(kinds: tuple[str, ...]) -> list[Column]:
    return [F.array_size(F.array_remove(F.transform("base", lambda s: s.kind == kind), False)).cast("long").alias(f"n_{kind}") for kind in kinds]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"), pii.Detector.fit())
    return found.select(
        "doc_id", *_counts(pii.BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans")
    )


def looped_words(doc_id: Column, words: Column) -> Column:
    """The words of the contract: of one document in ten the end is replaced by repeats of its own first part."""
    h = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
    return F.when((h % 10 == 0) & (n > 0), again).otherwise(words)


def periodic_digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", periodic_runs.words_of(F.col("text")).alias("words"))
    found = periodic_runs.find_runs(rows, words=looped_words(F.col("doc_id"), F.col("words")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), "best.length", (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    written = hashlib.sha256(",".join(str(x) for x in codebooks.ravel().tolist()).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(written).alias("codebooks_sha256"))


def op12_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds written one after another."""
    near = """
a{k} AS MATERIALIZED (
  SELECT r, part, any_value(x) AS x, arg_min(entry, d * 1024 + entry) AS entry, min(d) AS d
  FROM (SELECT r, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} USING (part))
  GROUP BY r, part)"""
    move = """
c{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m
    FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, (SELECT w + 1 FROM width)) AS g(i) GROUP BY part, entry, i) GROUP BY part, entry
  ) USING (part, entry))"""
    steps = [f(k=k, j=k + 1) for k in range(rounds) for f in (near.format, move.format)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // 8 AS w FROM v),
p AS MATERIALIZED (SELECT r, part, v[part * w + 1:part * w + w] AS x FROM v, width, range(8) AS g(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 16),{",".join(steps)},{near.format(k=rounds)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (r), books
"""


def secret_digest(docs: DataFrame) -> DataFrame:
    found = secret_scan.find_secrets(docs)
    every = F.concat("base", F.transform("added", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))))
    rank = F.create_map(*(F.lit(x) for i, kind in enumerate((*secret_scan.BASE, secret_scan.ADDED)) for x in (kind, i)))
    placed = F.array_sort(F.transform(every, lambda s: F.struct(s.start.alias("start"), F.element_at(rank, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    return found.select(
        "doc_id", *_counts(secret_scan.BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(placed).alias("spans")
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_substring_dedup": op2_substring_dedup, "op3_sentencepiece": op3_sentencepiece, "op4_warc": op4_warc, "op5_simhash": op5_simhash, "op6_quality": op6_quality, "op7_toxicity": op7_toxicity, "op8_exact_dedup": op8_exact_dedup, "op9_html_extract": op9_html_extract, "op10_pii": op10_pii, "op11_periodic_runs": op11_periodic_runs, "op12_vector_codes": op12_vector_codes, "op13_secrets": op13_secrets}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op6_quality": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_vector_codes": op12_sql()}
