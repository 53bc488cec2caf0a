"""Permissions: against the rule document by document, and the rows that are made on the way to it."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from findery import catalog
from findery.operators import history, permission

SMALL = "/root/testdata/sf0.001"


def organisation(seed):
    """Units, users, memberships, documents and requests, with several memberships, missing owners and units that do not exist."""
    rng = random.Random(seed)
    units = [(k, rng.choice([None, 900, *range(1, k)]) if k > 1 else None) for k in range(1, 13)]
    users = [(u, rng.random() < 0.9) for u in range(1, 41)]
    places = [*range(1, 13), 77]
    members, n = [], 0
    for u, _ in users:
        for k in range(rng.choice([1, 1, 2, 3])):
            n += 1
            members.append((u, rng.choice(["member", "member", "admin", *permission.MANAGER_ROLES, None]), rng.choice(places), k == 1, n))
    docs = [(d, rng.choice([None, *range(1, 45)]), rng.choice([None, 900, *places]), rng.choice(["personal", "team", "org_tree", "company", "other", None])) for d in range(1, 121)]
    requests = [(rng.choice(users)[0], rng.choice([*permission.SCOPES, None])) for _ in range(90)]
    return units, users, members, docs, requests


def by_rule(units, users, members, docs, requests):
    """{(user, requested scope): (effective scope, documents)} by the rule, one document at a time."""
    parent, above = dict(units), {}
    for u in parent:
        above[u], at = [], u
        while at is not None:
            above[u].append(at)
            at = parent.get(at)
    seen = {}
    for user, asked in requests:
        own = sorted((not first, n, role, unit) for u, role, unit, first, n in members if u == user)
        if not dict(users)[user] or own[0][3] not in above:
            continue
        _, _, role, unit = own[0]
        root = min(above[unit]) if role == "admin" else unit if role in permission.MANAGER_ROLES else None
        scope = "team" if asked == "managed_org" and root is None else asked
        managed = {u for u in above if root in above[u]} if root is not None and scope in ("managed_org", "company") else set()
        staff, wide = {u for u, _, at, _, _ in members if at in managed}, scope in ("team", "managed_org", "company")

        def shown(owner, at, kind):
            return (
                (role == "admin" and scope == "company") or kind == "company" or (kind == "personal" and owner is not None and (owner == user or owner in staff))
                or (kind == "team" and at is not None and (wide and at == unit or at in managed)) or (kind == "org_tree" and at is not None and (wide and at in above[unit] or at in managed))
            )

        seen[user, asked] = (scope, {d for d, owner, at, kind in docs if shown(owner, at, kind)})
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_permissions_follow_the_rule(spark, seed, monkeypatch):
    monkeypatch.setattr(permission, "SIDE", 3)  # several blocks and stripes of a grant
    units, users, members, docs, requests = organisation(seed)
    want = by_rule(units, users, members, docs, requests)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    documents = table(docs, "document_id long, owner_user_id long, owner_unit_id long, access_scope string")
    asked = table(requests, "user_id long, requested_scope string")
    memberships = table(members, "user_id long, role_name string, unit_id long, is_primary boolean, membership_id long")
    closure = permission.org_closure(table(units, "unit_id long, parent_id long"))
    granted = permission.grants(permission.actors(table(users, "user_id long, is_active boolean"), memberships, closure), asked, closure, memberships)

    listed = [tuple(r) for r in permission.visible_documents(documents, granted).collect()]
    assert sorted(listed, key=str) == sorted(((u, a, s, d) for (u, a), (s, ds) in want.items() for d in ds), key=str)

    distinct = [r for r in dict.fromkeys(requests) if r[1] is not None]
    chunks = documents.withColumn("chunk_id", F.col("document_id"))
    found = table([(d % 7, 200 - d, d) for d in range(1, 140)] + [(9, 1, 5)], "query_id long, rank long, chunk_id long")
    matrix = permission.permission_matrix(found, table(distinct, "user_id long, requested_scope string"), granted, chunks)
    for r in matrix.collect():
        ds = want.get((r.user_id, r.requested_scope), (None, set()))[1]
        top = min(((1, 9, 5) if d == 5 else (200 - d, d % 7, d) for d in ds), default=(None, None, None))[2]
        assert (r.result_count, r.chunk_count, r.top_chunk_id) == (len(ds) + (5 in ds), len(ds), top)

    kinds = {k: [d for d, _, _, s in docs if s == k] for k in permission.SCOPES + ("org_tree", "other")}
    told = {(r.user_id, r.requested_scope, r.access_scope): (r.visible_count, r.candidate_count) for r in permission.scope_explanation(granted, documents.where("access_scope IS NOT NULL")).collect()}
    have = {d for d, _, _, s in docs if s is not None}
    assert told == {(u, a, k): (len(ds & set(of)), len(of)) for (u, a), (_, ds) in want.items() if ds & have for k, of in kinds.items() if of}

    may = {}
    for (u, _), (_, ds) in want.items():
        may.setdefault(u, set()).update(ds)
    results = [(u, 1, 1, d) for u, _ in users for d in range(u % 5 + 1, 121, 5)]
    audit = history.permission_audit(table(results, "user_id long, question_id long, rank long, chunk_id long"), chunks, granted)
    assert sorted((r.user_id, r.chunk_id, r.is_visible) for r in audit.collect()) == sorted((u, d, d in may.get(u, ())) for u, _, _, d in results)


def most_rows(spark, run):
    """The most rows that an operator of any query made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    wait()
    before = max([e.executionId() for e in _seq(store.executionsList())], default=-1)
    run()
    wait()
    most = 0
    for e in _seq(store.executionsList()):
        if e.executionId() > before:
            wanted = {m.accumulatorId() for node in _seq(store.planGraph(e.executionId()).allNodes()) for m in _seq(node.metrics()) if m.name() == "number of output rows"}
            shown = re.findall(r"(\d+) -> ([\d,]+)$", store.executionMetrics(e.executionId()).mkString("\n"), re.M)
            most = max([most, *(int(n.replace(",", "")) for k, n in shown if int(k) in wanted)])
    return most


def _seq(found):
    return [found.apply(k) for k in range(found.size())]


@pytest.fixture(scope="module")
def one_nation(spark, tmp_path_factory):
    """2,000 users of one nation: 400 group leads who ask for what they manage, and 1,600 members."""
    d = str(tmp_path_factory.mktemp("one_nation"))
    for t in ("nation", "region", "supplier", "part"):
        shutil.copy(f"{SMALL}/{t}.parquet", d)
    keys = [k for k in range(10, 100_000, 20) if k % 50][:400] + [10 * k + 1 for k in range(1600)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").withColumn("c_nationkey", F.lit(0)).coalesce(1).write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", ["permission_audit", "permission_matrix", "scope_explanation", "visible_documents"])
def test_managers_do_not_meet_members(spark, one_nation, name):
    """400 managers of 2,000 people are 800,000 pairs."""
    assert 2_000 <= most_rows(spark, lambda: catalog.QUERIES[name](spark, one_nation).write.format("noop").mode("overwrite").save()) <= 50_000
