"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Shards are made of parts, folders of at most about PART_BYTES each, and a manifest says which shard a
part belongs to.  A minimum-cost flow from old shards to new ones, where staying costs nothing and each
byte moved costs one, says how many bytes go where.  Whole parts then change hands in the manifest alone;
only as many parts of a shard as it has receivers are cut into blocks, dealt out along the flow and
rewritten.  All other files stay as they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from findery.llm.common import scratch, unused, written

OVERHEAD = 8
#: Bytes of a part at most, and the least that is worth a file of its own; between them a part is 1 / PARTS of all.
PART_BYTES, LEAST_BYTES, PARTS = 256 << 20, 256 << 10, 256
#: Buckets a shard is measured by before it is cut into parts; a bucket larger than a part is spread over several.
BUCKETS = 1024
#: Blocks that a part is cut into where it is dealt out to several shards.
BLOCKS = 512
MANIFEST = "part long, shard int, n_rows long, bytes long, first_slot long"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (old, new) -> amount that places all supply within capacities at the least total cost(old, new).

    Successive shortest paths with potentials over the bipartite network; amounts are integers.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse of edge e is e ^ 1
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, room: int, price: int) -> None:
        for x, y, r, p in ((a, b, room, price), (b, a, 0, -price)):
            at[x].append(len(edges))
            edges.append([y, r, p])

    for i, s in enumerate(supply):
        link(source, i, s, 0)
        for j in range(m):
            link(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        link(n + j, sink, c, 0)
    potential, left = [0] * (n + m + 2), sum(supply)
    while left:
        far, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in at[x]:
                y, room, price = edges[e]
                if room and (new := d + price + potential[x] - potential[y]) < far.get(y, 1 << 62):
                    far[y], via[y] = new, e
                    heapq.heappush(heap, (new, y))
        for x in range(len(potential)):
            potential[x] += far.get(x, max(far.values()))
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = edges[via[x] ^ 1][0]
        push = min(left, *(edges[e][1] for e in path))
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
        left -= push
    flow = {}
    for i in range(n):
        for e in at[i]:
            j, moved = edges[e][0] - n, edges[e ^ 1][1]
            if e % 2 == 0 and 0 <= j < m and moved:
                flow[i, j] = moved
    return flow


@dataclass
class Plan:
    """The new shard of each unit, the bytes that change shards, and those of each new shard."""

    shard_of: dict
    moved: int
    sizes: list[int]


def shares(sizes: list[int], n_new: int) -> dict[tuple[int, int], int]:
    """(old, new) -> bytes that bring shards of these sizes to ``n_new`` of equal capacity with the fewest bytes moved."""
    total = sum(sizes)
    return min_cost_flow(sizes, [total // n_new + (j < total % n_new) for j in range(n_new)], lambda i, j: int(i != j))


def plan(blocks: dict, old_of: dict, n_old: int, n_new: int) -> Plan:
    """Deal units of given bytes out to new shards of like size, moving the fewest bytes that units allow.

    Along the flow the largest go first; then units move from the fullest shard to the emptiest as long
    as that evens them out.
    """
    supply = [0] * n_old
    for b, size in blocks.items():
        supply[old_of[b]] += size
    flow = shares(supply, n_new)
    own: list[list] = [[] for _ in range(n_old)]
    for b in sorted(blocks, key=lambda b: (-blocks[b], b)):
        own[old_of[b]].append(b)
    shard_of: dict = {}
    owed = [0] * n_new  # what earlier shares left over of a shard's capacity, or took too much
    for i in range(n_old):
        open_shares = [(-(amount + owed[j]), j != i, j) for (a, j), amount in flow.items() if a == i]
        for _, _, j in open_shares:
            owed[j] = 0
        heapq.heapify(open_shares)
        for b in own[i]:
            room, stays, j = heapq.heappop(open_shares)
            shard_of[b] = j
            heapq.heappush(open_shares, (room + blocks[b], stays, j))
        for room, _, j in open_shares:
            owed[j] -= room
    sizes = [0] * n_new
    held: list[list[tuple]] = [[] for _ in range(n_new)]
    for b, j in shard_of.items():
        sizes[j] += blocks[b]
        held[j].append((blocks[b], b))
    while True:  # each move lessens the sum of squares of the sizes
        full, free = max(range(n_new), key=lambda j: sizes[j]), min(range(n_new), key=lambda j: sizes[j])
        gap = sizes[full] - sizes[free]
        fitting = [x for x in held[full] if 0 < x[0] < gap]
        if not fitting:
            break
        size, b = min(fitting, key=lambda x: (abs(2 * x[0] - gap), x))
        held[full].remove((size, b))
        held[free].append((size, b))
        sizes[full] -= size
        sizes[free] += size
        shard_of[b] = free
    return Plan(shard_of, sum(blocks[b] for b, j in shard_of.items() if j != old_of[b]), sizes)


@dataclass
class Shards:
    """Sharded rows in a folder: parts below ``path``/data, the manifest table, and what the last change moved.

    ``rewritten``: bytes of the parts that were read and written again; ``moved``: bytes whose shard changed;
    ``fewest``: the least that could, by the flow.
    """

    path: str
    manifest: DataFrame
    schema: StructType
    part: str
    n_shards: int
    next_part: int
    moved: int = 0
    fewest: int = 0
    rewritten: int = 0

    def data(self) -> DataFrame:
        """What lies in the files, parts that no longer count included."""
        return self.manifest.sparkSession.read.schema(self.schema).parquet(f"{self.path}/data")

    def rows(self) -> DataFrame:
        """All rows of all shards with their columns, size, shard int, slot long; slots count from 0 in each shard without a gap."""
        held = self.data()
        at = f"{self.part}_at"
        kept = [c for c in held.columns if c not in (self.part, at)]
        listed = self.manifest.select(F.col("part").alias(f"{self.part}_id"), F.col("shard").alias(f"{self.part}_shard"), F.col("first_slot").alias(f"{self.part}_first"))
        # a row for each part: PART_BYTES of data have some 30 bytes here
        found = held.join(F.broadcast(listed), F.col(self.part) == F.col(f"{self.part}_id"))
        return found.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{self.part}_shard").alias("shard"), (F.col(f"`{self.part}_first`") + F.col(at)).alias("slot"))


def _write(rows: DataFrame, part: str, places: int, key: Column, out: str, *gone: str) -> StructType:
    """Append parts: rows to the task their place names, in order of ``key``, each with its number in the part; columns ``gone`` go."""
    place = f"{part}_place"
    ordered = rows.repartitionById(places, F.col(place)).sortWithinPartitions(F.col(part), key)
    # places and tasks are one to one, so the number in the task is the number in the part
    numbered = ordered.withColumn(f"{part}_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop(place, *gone)
    numbered.write.mode("append").partitionBy(part).parquet(f"{out}/data")
    return numbered.schema


def _manifest(spark: SparkSession, out: str, part: str, shard_of: dict[int, int], known: dict[int, tuple[int, int]]) -> DataFrame:
    """The manifest of parts (part -> rows, bytes) as a table of its own, each part's slots after those before it in its shard."""
    filled: dict[int, int] = {}
    rows = []
    for p in sorted(known):
        n, size = known[p]
        j = shard_of[p]
        rows.append((p, j, n, size, filled.get(j, 0)))
        filled[j] = filled.get(j, 0) + n
    return written(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{out}/manifest-{scratch(spark, 'm').rsplit('-', 1)[1]}")


def _counted(data: DataFrame, part: str, parts: list[int] | None = None) -> dict[int, tuple[int, int]]:
    held = data.select(F.col(part).alias("p"), "size")
    held = held if parts is None else held.where(F.col("p").isin(parts))
    return {r.p: (r.n, r.bytes) for r in held.groupBy("p").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}


def lay_out(docs: DataFrame, shard: Column, n_shards: int, out: str) -> Shards:
    """Write rows as shards: ``shard`` (0 to n_shards - 1) of each row, in parts that follow from their bytes.

    Sizes are UTF-8 bytes of the text (null: none) plus 8.  Rows of a shard fall into buckets by doc_id and
    text; the driver gets BUCKETS rows a shard, whatever the input, and packs buckets into parts.  A bucket
    larger than a part, as many equal rows make it, is spread over several by where its rows stand in the
    input.  Texts are shuffled once, each part by one task.  Columns named size, shard or slot are replaced.
    Null doc_ids and texts and repeated rows are rows like any other; ``shard`` must not be null.  An empty
    table gives shards without parts.  Other columns may have any names.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    part, bucket, position, b_, first_, many_ = unused(docs, "part", "bucket", "position", "b", "first", "many")
    text = F.coalesce("text", F.lit(""))
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).cast("int")
    keyed = docs.withColumns({"size": F.octet_length(text).cast("long") + OVERHEAD, bucket: shard.cast("int") * BUCKETS + hashed, position: F.monotonically_increasing_id()})
    sizes = {r.b: r.bytes for r in keyed.groupBy(F.col(f"`{bucket}`").alias("b")).agg(F.sum("size").alias("bytes")).collect()}
    full = min(PART_BYTES, max(LEAST_BYTES, sum(sizes.values()) // PARTS))
    table, shard_of, following, room, open_shard = [], {}, 0, 0, None
    for b in sorted(sizes):
        many = -(-sizes[b] // full)
        if many > 1 or b // BUCKETS != open_shard or sizes[b] > room:
            first, following = following, following + many
            shard_of |= {p: b // BUCKETS for p in range(first, following)}
            open_shard, room = (b // BUCKETS, full) if many == 1 else (None, 0)
        table.append((b, following - many, many))
        room -= sizes[b]
    dealt = spark.createDataFrame(table, "b int, first long, many int").toDF(b_, first_, many_)
    spread = F.when(F.col(many_) > 1, F.pmod(F.xxhash64(position), F.col(many_))).otherwise(0)
    placed = keyed.join(F.broadcast(dealt), F.col(bucket) == F.col(b_)).withColumn(part, F.col(first_) + spread)
    rows = placed.select(*[F.col(f"`{c}`") for c in docs.columns], "size", part, F.col(part).cast("int").alias(f"{part}_place"))
    key = F.struct(F.col("doc_id"), F.col("size"), F.crc32(text.cast("binary")))
    schema = _write(rows, part, max(1, following), key, out)
    counts = _counted(spark.read.schema(schema).parquet(f"{out}/data"), part)
    return Shards(out, _manifest(spark, out, part, shard_of, counts), schema, part, n_shards, following)


def reshard(shards: Shards, n_new: int) -> Shards:
    """The same rows in ``n_new`` shards with nearly equal sums of sizes, and the fewest bytes moved.

    A shard whose bytes go to k shards, itself perhaps among them, has its k largest parts cut into blocks
    if k is over one; these are rewritten, in one shuffle of their rows.  Every other part stays in its file, whichever shard it then
    belongs to.  Old parts that were cut are no longer in the manifest.  The driver gets a row for each part
    and BLOCKS for each part that is cut.  All rows stay, whatever is null in them or however often they
    are repeated; shards without rows stay without.
    """
    spark, part, out = shards.manifest.sparkSession, shards.part, shards.path
    held = {r.part: r for r in shards.manifest.collect()}
    sizes = [0] * max(shards.n_shards, 1)
    for r in held.values():
        sizes[r.shard] += r.bytes
    flow = shares(sizes, n_new)
    cut: list[int] = []
    for i in range(shards.n_shards):
        takers = sum(a == i for a, _ in flow)
        if takers > 1:
            own = sorted((r for r in held.values() if r.shard == i), key=lambda r: (-r.bytes, r.part))
            cut += [r.part for r in own[:takers]]
    units = {(p, -1): r.bytes for p, r in held.items() if p not in set(cut)}
    at = f"{part}_at"
    block = F.pmod(F.xxhash64("doc_id", "text", F.col(at)), F.lit(BLOCKS)).cast("int")
    opened = shards.data().where(F.col(part).isin(cut))
    if cut:
        for r in opened.groupBy(F.col(part).alias("p"), block.alias("b")).agg(F.sum("size").alias("bytes")).collect():
            units[r.p, r.b] = r.bytes
    made = plan(units, {u: held[u[0]].shard for u in units}, len(sizes), n_new)

    shard_of = {p: made.shard_of[p, -1] for p in held if (p, -1) in units}
    known = {p: (held[p].n_rows, held[p].bytes) for p in shard_of}
    following = shards.next_part
    if cut:
        new_part: dict[tuple[int, int], int] = {}
        rows = []
        for (p, b), j in sorted(made.shard_of.items()):
            if b >= 0:
                if (p, j) not in new_part:
                    new_part[p, j] = following
                    shard_of[following] = j
                    following += 1
                rows.append((p, b, new_part[p, j]))
        p_, b_, new_ = unused(opened, "p", "b", "new")
        table = spark.createDataFrame(rows, "p long, b int, new long").toDF(p_, b_, new_)
        moved = opened.join(F.broadcast(table), (F.col(part) == F.col(p_)) & (block == F.col(b_)))
        kept = [c for c in opened.columns if c not in (part, at)]
        placed = moved.select(*[F.col(f"`{c}`") for c in kept], F.col(new_).alias(part), (F.col(new_) - shards.next_part).cast("int").alias(f"{part}_place"), F.struct(F.col(part), F.col(at)).alias(f"{part}_old"))
        _write(placed, part, len(new_part), F.col(f"{part}_old"), out, f"{part}_old")
        known |= _counted(shards.data(), part, list(range(shards.next_part, following)))
    manifest = _manifest(spark, out, part, shard_of, known)
    fewest = sum(v for (i, j), v in flow.items() if i != j)
    return Shards(out, manifest, shards.schema, part, n_new, following, made.moved, fewest, sum(held[p].bytes for p in cut))
