import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from findery.llm import queries, vectorcodes
from tests.oracle import assert_same

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, row string, pos string, p0 string, `a.b` string"


def brute(rows):
    """(vec_id, code, error, label_error) of all kept rows and the digest, in plain whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and None not in v and all(map(math.isfinite, v)) and len(v) % 4 == 0]
    kept = [(i, [max(-(2**24), min(2**24, x)) for x in v], label) for i, v, label in kept]
    packed = lambda v: [np.array(v[p * len(v) // 4 : (p + 1) * len(v) // 4], "<i4").tobytes() for p in range(4)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, packed(r[1])))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = [[tuple(v[p * len(v) // 4 : (p + 1) * len(v) // 4]) for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])[1]].append(c[p])
            for k, group in own.items():
                books[p][k] = tuple(sum(x) // len(group) for x in zip(*group, strict=True))
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    errors, by = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, by[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def got(spark, rows):
    clash = ["clash"] * 6
    found = vectorcodes.compress(spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA).repartition(5))
    digest = found.books.sha256()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, digest) for r in vectorcodes.with_label_errors(found.rows).collect())


def vectors(n, dims, seed):
    r = random.Random(seed)
    return [(k, [r.gauss(0, 0.2) for _ in range(dims)], r.choice([0, 1, None])) for k in range(n)]


def test_equals_brute_force_with_copies_and_odd_rows(spark):
    rows = vectors(330, 8, 1)
    rows += [(1000 + k, rows[3][1], 7) for k in range(150)]  # a vector that a third of the rows share
    rows += [(2000 + k, rows[k][1][:2] + rows[5][1][2:], 1) for k in range(40)]  # parts shared at some positions only
    rows += [(7, rows[9][1], 2), (7, rows[8][1], 2), (7, rows[8][1], 2), (None, rows[4][1], 1), (None, [0.5] * 8, None)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [0.1] * 7 + [None], 1), (-2, [0.1] * 7 + [math.nan], 1), (-1, [0.1] * 7 + [-math.inf], 1), (-6, [0.1] * 6, 1), (500, [0.1] * 12, 1)]
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(k, [0.25, 0.5, 0.0, -0.001], k % 2) for k in range(300)] + [(900, [0.26, 0.4, 0.001, -0.5], None)]
    found = got(spark, rows)
    assert found == brute(rows) and {r[1][:2] for r in found} == {"00"}


def test_few_rows_and_none(spark):
    rows = vectors(5, 4, 3)
    assert got(spark, rows) == brute(rows) and all(r[2] == 0 for r in got(spark, rows))
    assert got(spark, [(1, None, 1), (2, [math.inf] * 4, 1)]) == [] and got(spark, []) == []


def test_large_components_are_exact(spark):
    r = random.Random(4)
    rows = [(k, [r.uniform(-16000, 16000) for _ in range(8)], 1) for k in range(280)] + [(999, [1e300, -1e300, 1e5, 0.0] * 2, 1)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [100, 1 << 24])
def test_nearest_is_exact(most):
    r = np.random.default_rng(most)
    x, book = r.integers(-most, most, (50, 16)), r.integers(-most, most, (256, 16))
    code, far = vectorcodes.nearest(x, book)
    d = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and far.tolist() == d.min(1).tolist()


def test_partitions_change_nothing_and_codes_decode(spark):
    rows = vectors(400, 16, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    a, b = vectorcodes.compress(df.repartition(1)), vectorcodes.compress(df.repartition(9))
    assert {tuple(r) for r in a.rows.collect()} == {tuple(r) for r in b.rows.collect()}
    for r in a.rows.limit(20).collect():
        whole = [math.floor(1024 * float(np.float32(x))) for x in rows[r.vec_id][1]]
        assert sum((w - (x * 1024 - 0.5)) ** 2 for w, x in zip(whole, a.books.decoded(r.code), strict=True)) == r.error


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op11_vectorcodes(spark, sf), sf, queries.ORACLE_SQL["op11_vectorcodes"])
