import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
from compare import connect

from pluvia.llm import packing, queries, sentencepiece_codec, warc
from pluvia.session import Scratch


# --- packing -----------------------------------------------------------------------------------------------------------


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], dtype="<u4") for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def check_pieces(pieces, wanted):
    """wanted: (id, ids) of each row; every id must lie in exactly one piece and sequences must have no gap."""
    by_sequence, covered = {}, {}
    known = {}
    for i, ids in wanted:
        known.setdefault(repr(i), []).append(ids)
    for p in pieces:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in known[repr(p.doc_id)])
        covered[repr(p.doc_id)] = covered.get(repr(p.doc_id), 0) + p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert covered == {i: sum(map(len, many)) for i, many in known.items()}
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s <= 1024 for s in sizes) and sum(s < 1024 for s in sizes) <= 1


def test_packing_query(spark, sf_dir):
    rows = connect(sf_dir).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    check_pieces(queries.op1_packing(spark, sf_dir).collect(), list(zip((i for i, _ in rows), plain_ids(t for _, t in rows))))


def test_packing_awkward(awkward, empty, spark):
    rows = awkward.select("doc_id", "text").collect()
    check_pieces(queries.pack_documents(awkward).collect(), list(zip((r.doc_id for r in rows), plain_ids(r.text or "" for r in rows))))
    assert queries.pack_documents(empty).count() == 0
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", "\u0120 <|ENDOFTEXT|>"]
    special = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(queries.pack_documents(special).collect(), list(enumerate(plain_ids(texts))))


def test_packing_follows_the_curve(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing._tokens(docs, "doc_id", "text", path, public_tokenizers.PATTERN, 0).toPandas()
    at = rows[packing.AXES].to_numpy()
    even = 1 / (1 + np.exp(np.clip(-1.7 * (at - at.mean(0)) / at.std(0), -60, 60)))
    side = 1 << packing.KEY_BITS
    key = dict(zip(rows["id"], packing.hilbert_key(np.minimum((even * side).astype(np.int64), side - 1))))
    pieces = packing.pack(docs, path, public_tokenizers.PATTERN).filter("start = 0").toPandas()
    order = pieces.sort_values(["sequence_id", "offset"])["doc_id"]
    steps = np.diff([key[i] for i in order])
    assert len(order) == docs.count() and (steps < 0).mean() < 0.02  # but for cells that rounding moves


def test_packing_long_white_space(spark):
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b c", "a " + " \n" * 500_000 + " b", "\xa0" * 1_000_000, " " * 99_999 + "x", "x" + " " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(queries.pack_documents(docs).collect(), list(enumerate(plain_ids(texts))))


def test_packed_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 1024 or (len(r.ids) & (len(r.ids) - 1)) == 0 for r in rows)
    assert sum(len(r.ids) for r in rows) - pieces.agg({"length": "sum"}).first()[0] < 1024


def test_hilbert_curve_has_unit_steps():
    side = np.arange(8)
    points = np.array([(a, b, c) for a in side for b in side for c in side])
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


# --- WARC --------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS digest", "7 AS data")


def round_trip(spark, frame, **options):
    scratch = Scratch(spark, "test-warc")
    manifest = scratch.write(warc.write_archives(frame, scratch.uri("archives"), **options), "manifest")
    return manifest, warc.read_archives(manifest)


def test_warc_awkward(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u", "ä" * 50_000), (5, "u", "ä" * 50_000), (6, "u", "one")]
    manifest, records = round_trip(spark, pages(spark, rows))
    got = warc.resolved(records).collect()
    want = []
    for page, _, text in rows:
        data = (text or "").encode()
        best = max(p for p, _, t in rows if (t or "") == (text or "") and p is not None)
        first = page == best
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert {r.url for r in records.collect() if r.page_id == 2} == {"http://b/%0D%0AX:%201"}
    assert round_trip(spark, pages(spark, []))[1].count() == 0


def test_warc_dictionary_frame_and_small_archives(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(1)
    manifest, records = round_trip(spark, frame, archive_bytes=20_000, sample_bytes=60_000)
    made = manifest.collect()
    assert len(made) > 1 and any(m.dictionary_bytes > 0 for m in made) and sum(m.records for m in made) == frame.count()
    for m in made:
        with open(m.archive.removeprefix("file://"), "rb") as archive:
            head = archive.read(8)
        assert (int.from_bytes(head[:4], "little") == warc.DICTIONARY_FRAME) == (m.dictionary_bytes > 0)
    want = {r.page_id: (r.html or "").encode() for r in frame.collect()}
    assert all(bytes(r.payload) == want[r.page_id] for r in records.collect() if r.record_type == "response")


# --- SentencePiece -------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode_too=True).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == model.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]


def plain_merges(pieces, text):
    parts = list(text)
    while True:
        ranked = [(-pieces.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces.score]
        if not ranked:
            return parts
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pieces_merges_by_definition_and_of_very_long_words():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoder, model = sentencepiece_codec.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    draw = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(draw.choice(list("abcdeinorst▁te\0"), size=int(draw.integers(0, 30))))
        assert encoder.pieces.merges(text)[0] == plain_merges(encoder.pieces, text)
    long = "".join(draw.choice(list("abcdeinorst"), size=200_000))
    texts = [long[:100_000] + "\0" + long[100_000:], "日本語" * 20_000, "a" * 100_000]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [model.encode(t) for t in texts]


def test_pieces_with_little_room_are_the_same():
    path = public_tokenizers.path("piece_bpe_32k.model")
    draw = np.random.default_rng(6)
    texts = [" ".join("".join(draw.choice(list("abcdeinorst"), size=int(draw.integers(1, 9)))) for _ in range(200)) for _ in range(20)]
    wide, narrow = sentencepiece_codec.Encoder(path), sentencepiece_codec.Encoder(path, most=10_000)
    narrow.apart.MOST = 50
    assert [narrow.encode([t])[0] for t in texts] == wide.encode(texts)
    assert narrow.held < 200_000 and len(narrow.known) < len(wide.known)


def test_pieces_of_odd_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["Hello  world", " lead", "trail ", "a\nb\tc", "日本 　x", "ﬁ Ａ", "x▁y", "", "á", "     many   spaces    日", "😀😀 emoji", "a" * 3000, " " * 37, "\t\t  \n\n x"]
    encoder = sentencepiece_codec.Encoder(path)
    for _ in range(2):
        got = encoder.encode(odd)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [model.encode(t) for t in odd]
    assert [encoder.decode(g) for g in got] == [t.replace("▁", " ") for t in odd]
    assert encoder.encode([None]) == [b""] and encoder.encode([]) == []
    draw = np.random.default_rng(0)
    words = ["".join(draw.choice(list("abcdeïlnorst XYZ▁%"), size=int(draw.integers(1, 14)))) for _ in range(3000)]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(words)] == [model.encode(w) for w in words]


def test_pieces_awkward(awkward, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(awkward, path)
    assert encoded.count() == awkward.count() and sentencepiece_codec.encode(empty, path).count() == 0
    texts = sorted(r.text for r in sentencepiece_codec.decode(encoded, path).collect())
    assert texts == sorted(r.text or "" for r in awkward.select("text").collect())
