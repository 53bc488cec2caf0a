import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from findery.llm import prefixtrie, queries
from tests.oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string, place string, key string, rep string, depth string, `a.b` string"


def brute(rows):
    """Nodes by plain dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
            if d:
                kids[whole[c][: d - 1]].add(whole[c][:d])
        ends[whole[c]].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()
    )


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    def run(rows):
        folder = str(tmp_path_factory.mktemp("conversations"))
        spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(7).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
        found = queries.op13_prefixtrie(spark, folder).collect()
        return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)

    return run


def some(seed):
    """Copies, shared starts, chains, a very long one, ties, nulls and repeated rows."""
    r = random.Random(seed)
    texts = ["", "hi", "what is it?", "ñandú 😀", None, "no", "a longer answer of some words"]
    turn = lambda k: (k, r.choice(["user", "assistant", None]), r.choice(texts))
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 299, 1000, 1001, -7, -150, -100]:
        rows += [(c, *turn(k)) for k in range(r.randint(1, 9))]
    deep = [(k, "user", f"step {k}") for k in range(10)]
    for c in (400, 401, 402, 455):  # copies, and two that part late
        rows += [(c, *t) for t in deep] + ([(c, 10, "user", str(c))] if c > 401 else [])
    for c in range(600, 640):  # one conversation very many times
        rows += [(c, k, "user", "same") for k in range(8)]
    rows += [(777, k, "user", f"long {k % 13}") for k in range(900)]
    rows += [(778, None, "user", "b"), (778, None, "user", "a"), (778, 3, "x", "a"), (778, 3, "x", "a"), (778, 3, None, "z")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (900, 1, "user", "t" * 50_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(got, seed):
    rows = some(seed)
    assert got(rows) == brute(rows)


def test_none_one_and_turnless(got):
    assert got([]) == [] and got([(None, 1, "user", "x")]) == []
    for rows in ([(5, 1, "user", "x")], [(c, 1, "user", "x") for c in range(1, 9)], [(3, k, "u", "v") for k in range(7)]):
        assert got(rows) == brute(rows)


def test_long_conversations_keep_their_order_over_partitions(spark):
    rows = [(c, k, "user", f"{c} {k}") for c in (1, 2, 3) for k in range(1500 if c == 2 else 4)]
    found = prefixtrie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.upto == sum(len(f"{r.conv_id} {k}") for k in range(r.place)) and r.chars == len(f"{r.conv_id} {r.place - 1}")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    assert_same(queries.op13_prefixtrie(spark, sf), sf, queries.ORACLE_SQL["op13_prefixtrie"])
