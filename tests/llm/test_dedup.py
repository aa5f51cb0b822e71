import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connect, same_rows

from pluvia.llm import exact_dedup, queries, simhash, substring_dedup


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def white(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# --- exact ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_warc", "op6_quality", "op8_exact_dedup"])
def test_query_against_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_awkward(awkward, batches):
    got = rows_of(exact_dedup.exact_dedup(awkward, batches=batches))
    texts = [(r.doc_id, white(r.text)) for r in awkward.select("doc_id", "text").collect()]
    groups = {}
    for i, t in texts:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    assert len(got) == len(texts)
    for digest, ids in groups.items():
        own = [g for g in got if g["text_sha256"] == digest]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted(map(repr, ids)) == sorted(repr(g["doc_id"]) for g in own)
        assert all(g["keep_id"] == keep and g["group_size"] == len(ids) for g in own)
        assert [g["doc_id"] for g in own if g["kept"]] == [keep]


def test_exact_index_lives_on(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/digests", 4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "b"), (5, "c"), (6, "c"), (1, "a")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.exact_dedup(first, index=index).filter("kept").collect()} == {1, 2}
    got = exact_dedup.exact_dedup(second, index=index)
    assert {r.doc_id for r in got.filter("kept").collect()} == {5}
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(4, 2), (5, 5), (6, 5), (1, 1)}
    index.compact()
    assert index.table().count() == 3
    assert exact_dedup.exact_dedup(first, index=index).filter("kept").count() == 0
    index.drop()
    assert not spark.catalog.tableExists(index.name)


class Killed(Exception):
    pass


def dies(monkeypatch, kind, name, after, before=False):
    """From its ``after``-th call on, a method of ``kind`` is where the process dies: behind what it does, or before."""
    real, calls = getattr(kind, name), []

    def f(self, *args, **more):
        calls.append(1)
        if len(calls) == after and before:
            raise Killed
        out = real(self, *args, **more)
        if len(calls) == after:
            raise Killed
        return out

    monkeypatch.setattr(kind, name, f)


@pytest.mark.parametrize("step", [("append", 1), ("append", 2), ("_put", 2), ("commit", 1), ("commit", 1, True)])
def test_a_call_that_died_loses_no_text(spark, tmp_path, step):
    path = f"file://{tmp_path}/digests"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(i, t) for i, t in zip(range(3, 11), "bcdecdfg")], "doc_id long, text string")
    exact_dedup.exact_dedup(old, index=exact_dedup.DigestIndex(spark, path, 4), batch="b1")
    with pytest.MonkeyPatch.context() as patch:
        dies(patch, exact_dedup.DigestIndex, *step)
        with pytest.raises(Killed):
            exact_dedup.exact_dedup(new, index=exact_dedup.DigestIndex(spark, path), batch="b2")
    committed = step[0] == "commit" and len(step) == 2
    other = spark.createDataFrame([(20, "g"), (21, "h")], "doc_id long, text string")
    if not committed:  # what the dead call left is nobody's history
        got = exact_dedup.exact_dedup(other, index=exact_dedup.DigestIndex(spark, path), batch="b3")
        assert {r.doc_id for r in got.filter("kept").collect()} == {20, 21}
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")  # as in another session
    again = exact_dedup.exact_dedup(new, index=exact_dedup.DigestIndex(spark, path), batch="b2")
    assert {r.doc_id for r in again.filter("kept").collect()} == ({4, 5, 6, 9, 10} if committed else {4, 5, 6, 9})
    index = exact_dedup.DigestIndex(spark, path)
    assert index.table().count() == index.table().select("digest").distinct().count() == (7 if committed else 8)
    third = exact_dedup.exact_dedup(new, index=index, batch="b2")  # once more, whole
    assert {r.doc_id for r in third.filter("kept").collect()} == {r.doc_id for r in again.filter("kept").collect()}
    assert exact_dedup.exact_dedup(new, index=index, batch="b4").filter("kept").count() == 0
    index.drop()


@pytest.mark.parametrize("step", [("_put", 1), ("_commit", 1, True), ("_commit", 1), ("clean", 1)])
def test_compaction_that_died_keeps_the_index(spark, tmp_path, step):
    path = f"file://{tmp_path}/digests"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate("abcabd")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(docs, index=index, batch="b1")
    with pytest.MonkeyPatch.context() as patch:
        dies(patch, exact_dedup.DigestIndex, *step)
        with pytest.raises(Killed):
            index.compact()
    index = exact_dedup.DigestIndex(spark, path)
    assert index.table().count() == 4 and index.buckets == 4
    index.compact()
    assert index.table().count() == 4 and len(index.batches()) == 1
    again = exact_dedup.exact_dedup(docs, index=index, batch="b1")  # a batch from before the compaction, done again
    assert {r.doc_id for r in again.filter("kept").collect()} == {0, 1, 2, 5}
    more = exact_dedup.exact_dedup(docs.unionByName(docs), index=index, batch="b2")
    assert more.count() == 12 and more.filter("kept").count() == 0
    index.compact()
    assert index.table().count() == 4
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, index=index, batch="it's")
    index.drop()


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- SimHash -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(prints, dtype=np.uint64)
    for i in range(len(array)):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 3)[0]:
            parent[root(int(j))] = root(i)
    members = {}
    for i in range(len(prints)):
        members.setdefault(root(i), []).append(ids[i])
    return [min((x for x in members[root(i)] if x is not None), default=None) for i in range(len(prints))]


def test_simhash_awkward(awkward):
    texts = awkward.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in texts]
    want = sorted(zip((repr(r.doc_id) for r in texts), prints, map(repr, plain_components([r.doc_id for r in texts], prints))))
    got = simhash.simhash_components(awkward).collect()
    assert sorted((repr(r.doc_id), r.fp & (1 << 64) - 1, repr(r.component_id)) for r in got) == want


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_simhash_links_against_all_pairs(spark, limit):
    from pluvia.operators.components import components
    from pluvia.session import Scratch

    draw = random.Random(5)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(120):  # chains and balls around some of them
        prints.append(prints[draw.randrange(len(prints))] ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints} | {0, 1, -1})
    scratch = Scratch(spark, "links")
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), scratch, limit)
    roots = {r.node: r.root for r in components(found, scratch).collect()}
    want = plain_components(prints, [p & (1 << 64) - 1 for p in prints])
    assert [roots.get(p, p) for p in prints] == want


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


# --- repeated windows -----------------------------------------------------------------------------------------------------


def plain_removal(docs, window=50):
    """docs: (id, text). Kept words of each row by comparing all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    rank = lambda i: (i is None, i or 0)
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key not in first or rank(i) < rank(first[key]):
                first[key] = i
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if rank(first[tuple(words[k : k + window])]) < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def planted(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") + draw.choice("xyz") * draw.randint(1, 3)
    passages = [[word() for _ in range(draw.choice((49, 50, 51, 70, 130)))] for _ in range(8)]
    docs = []
    for i in range(90):
        words = [word() for _ in range(draw.randint(0, 120))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(words))
            passage = list(draw.choice(passages))
            if draw.random() < 0.3:
                passage[draw.randrange(len(passage))] = "edit"
            words[at:at] = passage
        docs.append((i, draw.choice((" ", "\n", "  ")).join(words)))
    docs += [(100, "same " * 300), (101, "same " * 120), (102, docs[3][1]), (103, docs[3][1]), (104, None), (105, ""), (None, docs[4][1]), (106, "same " * 49)]
    return docs + [(107, docs[0][1] + " tail"), (107, docs[0][1] + " other")]


def test_anchors_are_sparse_and_cover_all_windows():
    draw = random.Random(8)
    words = [f"w{draw.randrange(5000)}" for _ in range(40_000)]
    hashes, powers = substring_dedup.WordHashes(), substring_dedup.Powers()
    found = list(substring_dedup.anchors(substring_dedup.Text(" ".join(words)), hashes, powers, block=1000))
    assert [s for _, _, _, s, _ in found] == [0, *(e + 1 for *_, e in found[:-1])] and found[-1][4] == len(words) - 50
    assert all(s <= p <= e + 34 and p <= s + 34 for _, _, p, s, e in found)
    assert len(found) < len(words) / 14
    moved = {h for h, *_ in substring_dedup.anchors(substring_dedup.Text(" ".join(words[7:])), hashes, powers)}
    assert len(moved ^ {h for h, *_ in found}) < 40


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 4)])
def test_windows_against_brute_force(spark, seed, batches):
    docs = planted(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = substring_dedup.FingerprintIndex(spark, f"test_windows_{seed}", 4, fan=2)
    got = substring_dedup.remove_repeats(frame, batches=batches, index=index).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain_removal(docs)))
    tiers = [index.tier(name) for name in index.runs()]
    assert all(a != b for a, b in zip(tiers, tiers[1:]))
    alone = substring_dedup.remove_repeats(frame, batches=batches).collect()  # an index of the call's own keeps no windows
    assert sorted(map(repr, (tuple(r) for r in alone))) == sorted(map(repr, plain_removal(docs)))
    index.drop()
    assert index.runs() == []


def test_fingerprint_compaction_that_died_counts_no_run_twice(spark):
    docs = planted(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = substring_dedup.FingerprintIndex(spark, "test_died", 4, fan=2)
    with pytest.MonkeyPatch.context() as patch:
        dies(patch, substring_dedup.FingerprintIndex, "_drop", 1, True)
        try:
            substring_dedup.remove_repeats(frame, batches=3, index=index)
        except Killed:
            assert len(index._every()) > len(index.runs())
    pairs = sum(spark.table(name).count() for name in index.runs())
    index.compact()
    assert sum(spark.table(name).count() for name in index.runs()) == pairs and len(index._every()) == len(index.runs())
    index.drop()


def test_windows_index_lives_on(spark):
    text = " ".join(f"w{i}" for i in range(80))
    index = substring_dedup.FingerprintIndex(spark, "test_live", 4)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs, index=index, batches=1).first().n_removed == 0
    index.drop()


def test_windows_index_finds_passages_of_earlier_calls(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = words("p", 60)
    first = [(5, f"{words('a', 90)} {passage} {words('b', 90)}")]
    second = [(7, f"{words('c', 90)} {passage} {words('d', 90)}"), (2, f"{words('e', 30)} {passage}"), (8, words("f", 200))]
    third = [(1, f"{passage} {words('g', 90)}"), (9, f"{words('f', 200)} {words('h', 60)}"), second[0], first[0]]
    index = substring_dedup.FingerprintIndex(spark, "test_calls", 4)
    got = []
    for docs in (first, second, third):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got.append({r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame, index=index, batches=2).collect()})
    assert got == [{5: 0}, {7: 60, 2: 60, 8: 0}, {1: 60, 9: 200, 7: 60, 5: 0}]
    index.drop()


def test_windows_three_calls_against_brute_force(spark):
    docs = [(i, t) for i, t in planted(7) if i is not None and i != 107]
    random.Random(1).shuffle(docs)
    index, earlier = substring_dedup.FingerprintIndex(spark, "test_three", 4, fan=2), []
    for k in range(3):
        call = docs[k::3]
        got = substring_dedup.remove_repeats(spark.createDataFrame(call, "doc_id long, text string"), index=index, batches=2).collect()
        # by rank a row of an earlier call comes before all rows of a later one
        ranked = [((n, i), t) for n, rows in enumerate([*earlier, call]) for i, t in rows]
        want = [(i[1], *rest) for i, *rest in plain_removal(ranked) if i[0] == k]
        assert sorted(map(tuple, got)) == sorted(want)
        earlier.append(call)
    index.drop()


def test_windows_awkward(awkward, empty):
    want = plain_removal([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    got = substring_dedup.remove_repeats(awkward).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert substring_dedup.remove_repeats(empty).count() == 0
