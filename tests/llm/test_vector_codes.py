import hashlib

import numpy as np
import pytest
from compare import connect, same_rows

from pluvia.llm import queries, vector_codes


@pytest.mark.parametrize("seed", range(30))
def test_tree_search_is_the_nearest_with_ties_to_the_lower(seed):
    draw = np.random.default_rng(seed)
    spread = int(draw.choice([2, 5, 1000, vector_codes.BOUND]))
    k, width = int(draw.integers(1, 40)), int(draw.integers(1, 9))
    entries = draw.integers(-spread, spread, (k, width))
    entries[draw.integers(k)] = entries[0]  # equal entries
    rows = np.concatenate([draw.integers(-spread, spread, (300, width)), entries])
    code, best, _ = vector_codes.nearest(vector_codes.plant(entries), entries, rows)
    apart = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_bound_leaves_branches_out():
    draw = np.random.default_rng(1)
    entries = np.concatenate([draw.integers(0, 100, (16, 4)) + 10_000 * i for i in range(8)])
    rows = np.concatenate([entries, entries + 3])
    code, _, measured = vector_codes.nearest(vector_codes.plant(entries), entries, rows)
    assert (code == ((rows[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert measured < len(rows) * len(entries) / 3


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops. rows: (id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ints = [[int(np.floor(np.float64(np.float32(x)) * 4096)) for x in r[1]] for r in kept]
    w = len(ints[0]) // parts
    cut = [[tuple(v[k * w : k * w + w]) for k in range(parts)] for v in ints]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda k, x: min((apart(x, c), e) for e, c in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            mine = [near(k, c[k])[1] for c in cut]
            for e in range(len(books[k])):
                of = [c[k] for c, m in zip(cut, mine) if m == e]
                if of:
                    books[k][e] = tuple(sum(x) // len(of) for x in zip(*of))
    found = [[near(k, c[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in f), err, by_label[r[2]]) for r, f, err in zip(kept, found, errors)], sha


def sha_of(books):
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    found = queries.op12_vector_codes(spark, sf_dir)
    same_rows(found, connect(sf_dir), queries.oracle_sql()["op12_vector_codes"])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = brute(rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted((*w, sha) for w in want)


KIND = "vec_id long, embedding array<float>, label int, code string, error long, label_error long, size long, ints int, id int"


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(3)
    good = [(int(i), [float(x) for x in draw.integers(-3, 3, 16) / 4096 * draw.choice([1, 700])], None if i % 5 == 0 else int(i % 3)) for i in range(60)]
    bad = [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [nan] * 16, 1), (103, [0.0] * 15 + [-inf], 2), (104, [], 1), (-5, None, None)]
    more = [(None, good[3][1], 1), (7, good[7][1], 2), (7, good[7][1], 2)]
    rows = good + bad + more
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], KIND)
    coded, books = vector_codes.compress(table)
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=repr)
    want, sha = brute(rows)
    assert got == sorted(want, key=repr) and sha_of(books) == sha


def test_few_rows_empty_tables_and_bounds(spark):
    one = spark.createDataFrame([(1, [0.25] * 8, None)], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(one)
    assert [tuple(r) for r in coded.collect()] == [(1, None, "00" * 8, 0, 0)] and books.shape == (8, 1, 1)
    assert vector_codes.compress(one.limit(0))[0].collect() == []
    other = one.unionByName(spark.createDataFrame([(2, [0.5] * 16, 1)], one.schema))
    assert [r.vec_id for r in vector_codes.compress(other)[0].collect()] == [1]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.25] * 9, None)], one.schema))
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, None)], one.schema))
