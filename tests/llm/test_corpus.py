import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from findery.llm import components, decontaminate, licenses, outliers, pii, pii_examples, queries, reshard, shingles, simhash
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- near-duplicates ---


def brute_fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (i, _), g in zip(fps, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((str(i), fp, str(least.get(g))) for (i, fp), g in zip(fps, group, strict=True))


def test_components_equal_brute_force(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_all_pairs_within_two_bits_are_joined(spark):
    r = random.Random(5)
    assert sorted(map(len, map(simhash._masks, range(3)))) == [1, 65, 2081]
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(150)}
    fps |= {centre ^ sum(1 << b for b in range(k)) for k in range(0, 40, 2)}  # a chain of steps of two bits
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    group = {f: f for f in signed}
    for _ in range(60):
        group = {a: min(group[b] for b in signed if ((a ^ b) % 2**64).bit_count() <= 2) for a in signed}
    assert {f: root.get(f, f) for f in signed} == group


def test_wider_balls_join_pairs_within_four_bits(spark):
    r = random.Random(6)
    fps = [r.getrandbits(63) for _ in range(20)]
    fps += [f ^ sum(1 << b for b in r.sample(range(63), r.choice((3, 4, 5)))) for f in fps]
    found = {frozenset((x.a, x.b)) for x in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()}
    assert found == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}


def test_clashing_names_stay(odd):
    wide = odd.select("*", *[F.lit("own").alias(c) for c in ("__own", "id", "own", "n", "signature", "found", "clean", "key", "k", "w", "text_a", "a.b")])
    for kept in (simhash.one_of_each(wide), corpus_pipeline.near_duplicates(odd.sparkSession, wide, None), corpus_pipeline.personal_data(odd.sparkSession, wide, None)):
        assert kept.columns == wide.columns and {r["own"] for r in kept.collect()} == {"own"}


def test_one_of_each_group_stays(odd, empty):
    kept = simhash.one_of_each(odd).collect()
    assert set(kept[0].asDict()) == set(odd.columns) and all(r.fp == "clash" for r in kept)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    comps = {(i, fp): c for i, fp, c in brute_components(rows)}
    stays = {(str(r.doc_id), brute_fingerprint(r.text)) for r in kept}
    assert len(stays) == len(kept) and {comps[k] for k in stays} == {c for c in comps.values()}
    assert all(comps[k] == k[0] for k in stays)  # the smallest id of its group, or none where no row has one
    assert simhash.one_of_each(empty).count() == 0


def brute_similar_groups(texts):
    """The least place of each text's group, by the similarity of all pairs of shingle sets."""
    ws = [words(lower(t)) for t in texts]
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ws]
    group, pairs = list(range(len(sets))), 0
    for a in range(len(sets)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                pairs += sets[a] != sets[b]
                if group[a] != group[b]:
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
    return group, pairs


def near_texts():
    """Families of edited copies at similarities about 0.8, chains of them, and texts that share a long passage only."""
    r = random.Random(9)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    found = []
    for n in (6, 12, 40, 100, 300):
        for _ in range(6):
            base = text(n)
            found.append(base)
            for edits in (1, 1, 2, 3, n // 40, n // 25):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(n)] = "edited"
                found.append(copy)
                base = copy if r.random() < 0.3 else base
    passage = text(60)
    found += [passage + text(r.choice((4, 14, 20, 40))) for _ in range(60)]
    return [" ".join(w).upper() if r.random() < 0.1 else " ".join(w) for w in found]


def test_shingle_groups_equal_brute_force(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group, pairs = brute_similar_groups(texts)
    assert pairs > 100
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()} == dict(enumerate(group))


def test_similar_texts_that_share_no_band_are_joined(spark):
    texts = []
    for seed in (31156, 107544, 147820):  # of 250,000 such pairs, of a similarity of exactly 0.8, those without a band in common
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(54)]
        texts += [" ".join(w[:49]), " ".join(w[:44] + w[49:])]
        one, other = (shingles.bands(shingles.shingles(shingles.word_hashes(t.encode()))) for t in texts[-2:])
        assert not (one == other).any()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in shingles.near_duplicates(df).orderBy("doc_id").collect()] == [0, 0, 2, 2, 4, 4]


@pytest.mark.parametrize("step", [shingles._first_of_key, lambda rows: shingles._places(rows, lambda own: own)])
def test_a_worker_gives_up_the_words_of_a_stage(step):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 1], pa.int64()), pa.array([b"a b c d e f", b"g h", b"a b c d e f"])], names=["k", "text"])
    made = pa.Table.from_batches(step(Rows())([batch]))
    assert made.num_rows in (2, 3) and not shingles._known


@pytest.mark.parametrize("heavy", [shingles.HEAVY, 2])
def test_shingle_groups_do_not_depend_on_bands(spark, monkeypatch, heavy):
    monkeypatch.setattr(shingles, "bands", lambda own: [])
    monkeypatch.setattr(shingles, "HEAVY", heavy)
    monkeypatch.setattr(shingles, "COUNTED", 40)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()} == dict(enumerate(brute_similar_groups(texts)[0]))


def test_balls_of_the_simhash_of_shingles_join_close_copies(spark, monkeypatch):
    monkeypatch.setattr(shingles, "bands", lambda own: [])
    monkeypatch.setattr(shingles, "_unjoined", lambda *a: spark.createDataFrame([], "value long, k long, n long, root long"))
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base[:k] + ["edited"] * (k < 400) + base[k + 1 :]) for k in (400, 0, 399, 200)] + [" ".join(base[::-1])]
    sims = []
    for t in texts:
        own = [int(h) for h in shingles.shingles(shingles.word_hashes(t.encode()))]
        sims.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    close = [(sims[0] ^ x).bit_count() <= 2 for x in sims]
    assert any(close[1:]) and not close[4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()}
    assert all(got[k] == 0 for k, x in enumerate(close) if x) and got[4] == 4


def test_shingle_groups_of_odd_rows(odd, empty):
    rows = odd.orderBy(F.col("doc_id").asc_nulls_last()).collect()
    group, _ = brute_similar_groups([r.text for r in rows])
    kept = corpus_pipeline.near_duplicates(odd.sparkSession, odd, None).collect()
    assert set(kept[0].asDict()) == set(odd.columns) and len(kept) == len(set(group))
    ids = [r.doc_id for r in rows]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(ids[g]) for g in set(group))
    assert shingles.one_of_each(empty).count() == 0


def test_pipeline_leaves_no_edited_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    group, pairs = brute_similar_groups([r.text for r in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert pairs > 0 and sorted(r.doc_id for r in kept) == sorted(rows[g].doc_id for g in set(group))


# --- personal data ---


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        luhn = lambda: sum(2 * int(c) - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


PII_PARTS = ["a@b.co", "x.y@", "@", "a@b", ".", "..", "1.2.3.4", "256.1.1.1", "007.08.9.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "(", " ", "-", "7", "é", "😀", "\n", "tel ", "a-b@c-d.e-f.g", "+49.30.1234567"]


def test_fixed_patterns_equal_brute_force(spark, odd, empty):
    r = random.Random(7)
    texts = ["".join(r.choice(PII_PARTS) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.personal_data(df).withColumn("b", pii.by_kind(F.col("base"))).collect():
        assert [(s.kind, s.start, s.end) for s in row.b] == brute_spans(texts[row.doc_id]), repr(texts[row.doc_id])
        for s in row.added:
            assert not any(b.start < s.end and s.start < b.end for b in row.base)
            assert not any(o is not s and o.start < s.end and s.start < o.end for o in row.added)
    assert pii.personal_data(odd).count() == odd.count() and pii.personal_data(empty).count() == 0


def test_method_adds_spans_and_leaves_clean_text(spark):
    texts = {
        "call (017) 555-7713 now": ["phone"], "john [at] mail [dot] com wrote": ["email"], "card 4111.1111.1111.1111 ok": ["card"], "order 2024-01-15 12:30 done": [], "look at noon. home": [], "serial 239040950064896 x": [],
        "api_key: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b now": ["secret"], "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b now": [], "we met ana at a dot b dot c dot d dot e dot f dot com then": ["email"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.added] for r in pii.personal_data(df, ["doc_id", "text"]).collect()}
    assert {k: [x for x, _ in v] for k, v in got.items()} == dict(enumerate(texts.values()))
    assert got[8] == [("email", "ana at a dot b dot c dot d dot e dot f dot com")]


def test_secrets_of_any_length_go_whole(spark):
    r = random.Random(8)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda n, of: "a7" + "".join(r.choice(of) for _ in range(n - 2))
    hits = [(cue, made(n, of)) for n in (40, 500, 700, 5000, 60_000) for cue, of in (("api_key: ", mixed), ("token = ", mixed + "+/_-"), ("access key ", mixed))]
    hits += [("password: ", made(n, mixed + "!?#$%&*")) for n in (8, 127, 128, 140, 700, 5000)]
    texts = [f"we saw {cue}{hit} in the note" for cue, hit in hits]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.personal_data(df, ["doc_id", "text"]).collect():
        cue, hit = hits[row.doc_id]
        assert [(s.kind, s.start, s.end) for s in row.added] == [("secret", 7 + len(cue), 7 + len(cue) + len(hit))], (cue, len(hit))


@pytest.mark.parametrize("held_out", [False, True])
def test_recall_and_precision_by_kind(spark, held_out):
    rows = pii_examples.examples(1500, 77, held_out)
    df = spark.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [*r.base, *r.added] for r in pii.personal_data(df).collect()}
    hit = lambda k: any(s.start < rows[k]["end"] and rows[k]["start"] < s.end for s in got[k])
    for kind in ("email", "phone", "card", "secret", "password"):
        own = [k for k, r in enumerate(rows) if r["kind"] == kind]
        assert len(own) > 100 and sum(map(hit, own)) >= 0.9 * len(own), kind
    clean = [k for k, r in enumerate(rows) if not r["label"] and not brute_spans(r["text"])]
    assert len(clean) > 500 and sum(map(hit, clean)) <= 0.01 * len(clean)


def test_planted_spans_in_documents_are_found_and_labelled_clean_ones_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.personal_data(docs, ["doc_id", "text"]).collect()}
    tokens = {k: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")] for k, r in rows.items()}
    spans = {k: [(s.start, s.end) for s in r.added] for k, r in rows.items()}
    assert sum(map(len, tokens.values())) > 5 and all(t in spans[k] for k, ts in tokens.items() for t in ts)
    assert sum(len(spans[k]) for k in spans if not tokens[k]) <= 0.002 * len(rows)


@pytest.mark.parametrize("part", ["a@b.co ", "tel (017) 555-7713 x ", "1.2.3.4 a@b.co +49 30 1234567 "])
def test_time_for_many_matches_grows_with_the_text(spark, part):
    def seconds(n):
        df = spark.createDataFrame([(1, part * n)], "doc_id long, text string")
        own = pii.personal_data(df, ["doc_id", "text"]).select(F.size("base") + F.size("added"), F.length(pii.redacted(F.col("text"), F.concat("base", "added"))))
        t = time.perf_counter()
        assert own.first()[0] >= n
        return time.perf_counter() - t

    seconds(2000)
    assert seconds(16_000) < 2.5 * seconds(8_000) + 1


def test_positions_and_redaction_equal_brute_force_where_spans_overlap(spark):
    r = random.Random(17)
    text = "".join(r.choice(["é", "😀", "ab ", "\n", "word", "0"]) for _ in range(1500))
    spans = [[("email", a, a + r.randint(1, 300)) for a in (r.randrange(len(text)) for _ in range(n))] for n in (0, 1, 2, 7, 30)]
    df = spark.createDataFrame([(text, [x for x in s if x[2] <= len(text)]) for s in spans], "text string, s array<struct<kind:string,start:int,end:int>>")
    for row in df.select("s", pii.redacted(F.col("text"), F.col("s")).alias("t")).collect():
        at, out = 0, ""
        for s in sorted(row.s, key=lambda s: (s.start, s.end)):
            if s.start >= at:
                out += text[at : s.start] + "[EMAIL]"
            at = max(at, s.end)
        assert row.t == out + text[at:]


@pytest.mark.parametrize("text", ["a" * 50_000, "a." * 30_000, "x@" + "a." * 30_000 + "b", "1" * 50_000, "1." * 30_000, "+1" + "(" * 30_000, "a@" * 20_000])
def test_long_runs_take_linear_time(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted((s.kind, s.start, s.end) for s in pii.personal_data(df).first().base) == sorted(brute_spans(text) if len(set(text)) > 1 else [])


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!"), (2, None), (3, "clean")], "doc_id long, text string")
    got = pii.personal_data(df, ["doc_id", "text"]).select("doc_id", pii.redacted(F.col("text"), F.col("base")).alias("t"))
    assert dict(map(tuple, got.collect())) == {1: "é [EMAIL], [IP]!", 2: None, 3: "clean"}


# --- shards ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 7))
def test_flow_moves_the_fewest_bytes(supply, n_new):
    total = sum(supply)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = reshard.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(n_new)] == capacity
    stays = sum(min(s, capacity[k]) for k, s in enumerate(supply) if k < n_new)
    assert sum(v for (i, j), v in flow.items() if i != j) == total - stays


def old_shard():
    return F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(20))


def test_shards_hold_every_row_once(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(reshard, "LEAST_BYTES", 4 << 10)
    names = ["part", "b", "P", "first", "position", "new", "bucket", "many"]
    wide = odd.select("*", *[F.lit("own").alias(c) for c in names])
    laid = reshard.lay_out(wide, old_shard(), 20, str(tmp_path / "s"))
    again = reshard.reshard(laid, 24)
    key = lambda r: (str(r.doc_id), r.text)
    for df in (laid.rows(), again.rows()):
        got = df.collect()
        assert df.columns == [*[c for c in wide.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot"]
        assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, odd.collect()))) and all(r[c] == "own" for r in got for c in names)
        for j in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))
        assert all(r["size"] == len((r.text or "").encode()) + 8 for r in got)
    none = reshard.reshard(reshard.lay_out(empty, old_shard(), 20, str(tmp_path / "e")), 24)
    assert none.rows().count() == 0 and none.moved == 0


def test_new_shards_are_nearly_equal(spark):
    got = queries.op5_reshard(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(got) == 24 and max(r.n for r in got) < 1.02 * min(r.n for r in got)


def test_repeated_rows_are_spread_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshard, "LEAST_BYTES", 2 << 10)
    rows = [(7, "x" * 100, "s")] * 300 + [(1000 + k, "y" * 96 + f"{k:04}", f"s{k % 5}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    got = reshard.reshard(reshard.lay_out(df, old_shard(), 20, str(tmp_path / "r")), 24).rows().groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    assert len(got) == 24 and sum(r.rows for r in got) == 600 and max(r.n for r in got) - min(r.n for r in got) <= 2 * 108


def test_only_cut_parts_are_rewritten_and_little_more_than_the_least_is_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reshard, "LEAST_BYTES", 8 << 10)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(6)).cast("int")
    laid = reshard.lay_out(docs, shard, 6, str(tmp_path / "d"))
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "d/data").rglob("*.parquet")}
    before, old = files(), {r.part: r.shard for r in laid.manifest.collect()}
    new = reshard.reshard(laid, 7)
    now = {r.part: r.shard for r in new.manifest.collect()}
    total = laid.manifest.agg(F.sum("bytes")).first()[0]
    assert all(files()[p] == t for p, t in before.items()) and old.keys() & now.keys()
    where = {r.doc_id: r.shard for r in laid.rows().collect()}
    moved = sum(r["size"] for r in new.rows().collect() if where[r.doc_id] != r.shard)
    assert moved == new.moved and new.fewest <= new.moved <= new.fewest + 0.01 * total
    assert new.rewritten < 0.75 * total
    same = reshard.reshard(new, 7)
    assert same.moved <= 0.01 * total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 9)), min_size=1, max_size=7), st.integers(1, 3))
def test_plan_moves_no_more_than_brute_force_needs_for_shards_as_even(units, n_new):
    blocks, old = {k: s for k, (_, s) in enumerate(units)}, {k: o for k, (o, _) in enumerate(units)}
    made = reshard.plan(blocks, old, 3, n_new)
    assert made.sizes == [sum(blocks[k] for k, j in made.shard_of.items() if j == i) for i in range(n_new)]
    assert made.moved == sum(blocks[k] for k, j in made.shard_of.items() if j != old[k])
    # no single unit moved from the fullest shard to the emptiest evens them out further
    gap = max(made.sizes) - min(made.sizes)
    assert not any(0 < blocks[k] < gap for k, j in made.shard_of.items() if made.sizes[j] == max(made.sizes)) or made.sizes.count(max(made.sizes)) > 1
    spread = max(made.sizes) - min(made.sizes)
    best = min(
        (sum(blocks[k] for k in blocks if way[k] != old[k]) for way in itertools.product(range(n_new), repeat=len(units)) if (lambda z: max(z) - min(z) <= spread)([sum(blocks[k] for k in blocks if way[k] == i) for i in range(n_new)])),
        default=0,
    )
    flow = reshard.shares([sum(s for o, s in units if o == i) for i in range(3)], n_new)
    assert made.moved >= best and made.moved <= sum(v for (i, j), v in flow.items() if i != j) + (3 + n_new) * max(blocks.values())


# --- benchmark passages ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_of_odd_rows_by_broadcast_and_by_shuffle(spark, odd, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    texts = [r.text for r in odd.where("text IS NOT NULL AND doc_id < 60").orderBy("doc_id").collect()]
    items = [(1, texts[0]), (2, texts[1][5:]), (3, "one"), (4, "not there anywhere"), (5, None), (None, "one"), (6, "ONE two"), (6, texts[2]), (7, "..."), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", lower(t))
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items if i is not None for w in [tokens(t)] for k in range(max(0, len(w) - min(10, len(w)) + 1)) if w]

    def brute(text):
        w = tokens(text)
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(i))
        return len(w), len(hit), sorted(found)

    want = sorted(map(repr, ((r.doc_id, *brute(r.text)) for r in odd.where("coalesce(doc_id, 0) < 300 OR doc_id = 303").collect())))
    got = decontaminate.contamination(odd, bench).where("coalesce(doc_id, 0) < 300 OR doc_id = 303").collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got))) == want
    hit = {r.text for r in odd.collect()} - {r.text for r in decontaminate.clean(odd, bench).collect()}
    assert hit == {r.text for r in odd.collect() if brute(r.text)[1]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.where("item_id < 0")).where("n_hit > 0").count() == 0


def test_decontamination_by_shuffle_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert_same(queries.op6_decontaminate(spark, SF), SF, queries.ORACLE_SQL["op6_decontaminate"])


# --- licences ---


def test_licences(spark, odd, empty):
    texts = [
        ("Licensed under the Apache License, Version 2.0.", [], ["apache-2.0"]), ("Released under the MIT License.", [], ["mit"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl"], ["gpl"]), ("Licensed under CC BY-NC 4.0.", ["cc-by"], ["cc-by"]), ("All rights reserved. cc by all rights reserved", ["cc-by", "reserved"], ["cc-by", "reserved"]),
        ("Licensed under the license", [], []), ("Permission is hereby granted", [], []), ("", [], []), (None, [], []),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert [(r.base_labels, r.labels) for r in got] == [(b, x) for _, b, x in texts]
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].n_words) == (3, 0, 5, 8)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def test_tags_titles_and_families(spark):
    texts = {
        "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "# SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: Nothing-1.0": "",
        "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/": "apache-2.0", "MIT License\n\nCopyright (c) 2020 A": "mit", "Mozilla Public License Version 2.0\n====": "mpl-2.0", "BSD 3-Clause License": "bsd",
        "Eclipse Public License - v 2.0": "epl", "available under the terms of the Eclipse Public License 2.0 which": "epl", "Licensed under the EUPL, Version 1.2 or later": "eupl", "European Union Public Licence v. 1.2": "eupl",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by", "Creative Commons Attribution 3.0 Unported": "cc-by",
        "licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl", "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc.": "gpl,lgpl",
        "This file is not licensed under the MIT License.": "", "Not released under the terms of the MIT License": "", "It is not licensed under the GNU General Public License": "gpl", "not free, but licensed under the MIT License": "mit",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(r.labels) for r in licenses.scan_licenses(df).collect()}
    assert {t: got[k] for k, t in enumerate(texts)} == texts


def variant(r, template):
    """The text of a template with regions filled or left out, cased and broken into lines at random; and its mandatory words."""
    out, depth, skip, mandatory = [], 0, None, []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template):
        if part == "[[":
            depth += 1
            skip = depth if skip is None and r.random() < 0.5 else skip
        elif part == "]]":
            skip = None if skip == depth else skip
            depth -= 1
        elif skip is None:
            filled = [f"name{k}" for k in range(r.randint(1, int(part[2:-2])))] if part.startswith("{{") else re.findall("[0-9a-z\x80-\U0010ffff]+", lower(part))
            mandatory += range(len(out), len(out) + len(filled)) if not depth and not part.startswith("{{") else []
            out += filled
    return out, mandatory


def typeset(r, ws):
    return "".join(w.upper() + r.choice([" ", ", ", "\n# ", "\n * "]) if r.random() < 0.3 else w + r.choice([" ", " ", "\n// "]) for w in ws)


def test_templates_accept_all_their_texts_and_no_changed_wording(spark):
    r = random.Random(13)
    rows = []
    for label, templates in licenses.TEMPLATES.items():
        alone = licenses.Automaton({label: templates})
        for t in templates:
            for _ in range(6):
                ws, mandatory = variant(r, t)
                rows.append((typeset(r, ["before", *ws, "after"]), label, True))
                broken = list(ws)
                broken[r.choice(mandatory)] = "changed"
                if not any(alone.match([w.encode() for w in broken], k) for k in range(len(broken))):
                    rows.append((typeset(r, ["before", *broken, "after"]), label, False))
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: set(x.labels) - set(x.base_labels) | {y for y in x.labels if y in ("gpl", "cc-by", "reserved")} for x in licenses.scan_licenses(df).collect()}
    want = [label in got[k] for k, (_, label, ok) in enumerate(rows) if ok]
    assert len(want) > 150 and all(want)
    assert sum(not ok for *_, ok in rows) > 60 and not any(label in got[k] for k, (_, label, ok) in enumerate(rows) if not ok and label not in ("gpl", "cc-by", "reserved"))


def test_op7_equals_brute_force_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

    def matched(w, template):
        """Longest match of a template at the start of the words, by trying every way."""
        parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template)
        best, seen = 0, set()

        def closing(k):
            depth = 0
            for n in range(k, len(parts)):
                depth += (parts[n] == "[[") - (parts[n] == "]]")
                if not depth:
                    return n
            raise AssertionError(template)

        def go(k, at):
            nonlocal best
            if (k, at) in seen:
                return
            seen.add((k, at))
            if k == len(parts):
                best = max(best, at)
            elif parts[k] == "[[":
                go(k + 1, at)
                go(closing(k) + 1, at)
            elif parts[k] == "]]":
                go(k + 1, at)
            elif parts[k].startswith("{{"):
                for n in range(1, int(parts[k][2:-2]) + 1):
                    if at + n <= len(w):
                        go(k + 1, at + n)
            else:
                own = re.findall("[0-9a-z\x80-\U0010ffff]+", lower(parts[k]))
                if w[at : at + len(own)] == own:
                    go(k + 1, at + len(own))

        go(0, 0)
        return best

    for r in queries.op7_licenses(spark, SF).collect():
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", lower(texts[r.doc_id]))
        places = sorted((k, x, len(p.split())) for p, x in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        starts = [k for k, x in enumerate(w) if x in ("licensed", "released", "permission", "under", "this", "copyright", "all", "redistribution", "subject", "to", "distributed", "spdx", "apache", "mit", "gnu", "eclipse", "european", "creative", "mozilla", "bsd", "boost")]
        starts = [k for k in starts if not any(w[j] == "not" and w[j + 1] in ("licensed", "released", "distributed", "covered", "available") for j in range(max(0, k - 8), k))]
        found = {(x, n) for k in starts for x, ts in licenses.TEMPLATES.items() for t in ts if (n := matched(w[k : k + 400], t))}
        longest = max([n for *_, n in places] + [n for _, n in found], default=0)
        base = sorted({x for _, x, _ in places})
        assert (r.base_labels, r.labels, r.score) == (",".join(base), ",".join(sorted({*base, *(x for x, _ in found)})), longest / (longest + 2))


def test_automaton_with_optional_and_replaceable_regions():
    a = licenses.Automaton({"x": ["start [[maybe [[deep ]]]]{{2}} end"]})
    found = lambda t: bool(a.match([w.encode() for w in t.split()], 0))
    assert all(map(found, ["start a end", "start a b end", "start maybe a end", "start maybe deep a b end"]))
    assert not any(map(found, ["start end", "start a b c end", "begin a end"]))


# --- quality rules ---


def brute_counts(text):
    w, text = words(text), text or ""
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines, seen = [x for x in text.split("\n") if words(x)], set()
    repeats = sum(x in seen or seen.add(x) is not None for x in lines)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed


def test_quality_counts_equal_brute_force(spark, odd, empty):
    got = outliers.judge(odd).collect()
    want = sorted(map(repr, ((r.doc_id, *brute_counts(r.text)) for r in odd.collect())))
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got))) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert outliers.judge(empty).count() == 0


def test_outliers_go_and_others_stay(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows = [(k, " ".join(word() for _ in range(r.randint(80, 200))), "en", "s") for k in range(400)]
    rows += [(1000 + k, " ".join(word() + "###" for _ in range(100)), "en", "s") for k in range(20)]
    got = {x.doc_id: x.kept for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k] for k in got if k >= 1000) and all(got[k] for k in got if k < 1000)


def numpy_estimate(x):
    """Minimum-covariance-determinant fit of rows x, as ``outliers`` defines it: (mean, lower triangle) of the least determinant."""
    floors = np.array(list(outliers.FLOORS.values()))
    quantile = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]

    def lower(c):
        out = np.zeros_like(c)
        for j in range(len(c)):
            out[j, j] = math.sqrt(max(c[j, j] - out[j, :j] @ out[j, :j], floors[j] ** 2))
            for i in range(j + 1, len(c)):
                out[i, j] = (c[i, j] - out[i, :j] @ out[j, :j]) / out[j, j]
        return out

    def d2(fit):
        return (np.linalg.solve(fit[1], (x - fit[0]).T) ** 2).sum(0)

    middle = quantile(x, 0.5)
    scale = np.maximum((quantile(x, 0.75) - quantile(x, 0.25)) / 1.349, floors)
    first = middle, np.diag(scale)
    signs = (x - middle) / np.sqrt(np.maximum(d2(first), 1e-12))[:, None]
    best = (math.inf, None)
    for fit in (first, (x.mean(0), lower(np.cov(x.T, bias=True))), (middle, lower(np.cov(signs.T, bias=True)))):
        now = math.inf
        while True:
            d = d2(fit)
            core = x[d <= quantile(d, outliers.CORE)]
            fit = core.mean(0), lower(outliers.CONSISTENCY * np.cov(core.T, bias=True))
            det = 2 * np.log(np.diag(fit[1])).sum()
            if not det < now + math.log1p(-outliers.FALL):
                best = min(best, (det, fit), key=lambda b: b[0])
                break
            now = det
    return best[1]


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(8)
    groups, rows = {}, []
    for key in ("a", "b", "c"):
        x = rng.normal(0, 1, (240, 5)) @ (rng.normal(0, 0.4, (5, 5)) + np.eye(5)) * [0.8, 0.2, 0.1, 0.2, 0.1] + [5, 1.5, 0.02, 0.1, 0.05]
        x[: 10 if key == "a" else 45] += [2, 1, 1, 1, 0.5]
        groups[key] = x
        rows += [(key, *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{x} double" for x in outliers.X)).repartition(3)
    fit, many = outliers.estimates(df)
    assert many == 3
    for r in fit.collect():
        mean, low = numpy_estimate(groups[r.g])
        assert np.allclose([r[f"m_{i}"] for i in range(5)], mean, atol=1e-6)
        assert np.allclose([r[f"l_{i}_{j}"] for i in range(5) for j in range(i + 1)], [low[i, j] for i in range(5) for j in range(i + 1)], atol=1e-6)


def test_null_groups_and_pools_have_keys_of_their_own(spark):
    rows = [("en", None, 1.0)] * 220 + [("en", f"s{k}", 1.0) for k in range(3) for _ in range(100)] + [(None, None, 1.0)] * 210 + [(None, f"s{k}", 1.0) for k in range(3) for _ in range(90)] + [("de", "x", 1.0)] * 5
    df = spark.createDataFrame(rows, "lang string, source string, x double").repartition(3)
    got = {(r.lang, r.source): r.key for r in outliers._grouped(df).distinct().collect()}
    own = {k: [p for p in got if got[p] == got[k]] for k in got}
    assert len(own["en", None]) == len(own[None, None]) == len(own["de", "x"]) == 1
    assert len(own["en", "s0"]) == len(own[None, "s0"]) == 3 and got["en", "s0"] != got[None, "s0"]


def test_labelled_junk_goes_and_labelled_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").where("NOT base_failed").join(labels, "doc_id").collect()
    junk, clean = [r.kept for r in judged if r.quality == 0], [r.kept for r in judged if r.quality == 1]
    assert len(junk) > 10 and len(clean) > 100
    assert sum(junk) <= 0.1 * len(junk) and sum(clean) == len(clean)


def test_repeats_alone_make_an_outlier(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(k, " ".join(text(400)), "en", "s") for k in range(400)]
    for k in range(10):
        own = text(360)
        rows.append((1000 + k, " ".join(own + own[:38]), "en", "s"))  # 76 of 398 words: under a fifth
    got = {x.doc_id: x for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k].base_failed for k in got)
    assert all(got[k].kept == (k < 1000) for k in got)


def test_op10_equals_brute_force_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_quality_rules(spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(texts[r.doc_id])


def test_queries_have_the_columns_agreed(spark):
    columns = {
        "op1_simhash": "doc_id fingerprint component_id", "op3_tokenfile": "doc_id start n_tokens ids_crc32", "op4_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5_reshard": "doc_id size text_crc32 law shard slot grown_shard",
        "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    }
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, names in columns.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns == names.split() and df.count() == len(docs)
    for r in queries.op5_reshard(spark, SF).collect():
        assert r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
    for r in queries.op4_pii(spark, SF).collect():
        flat = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    assert np.isfinite([r.score for r in queries.op7_licenses(spark, SF).collect()]).all()
