"""Resharding by minimum-cost flow: the fewest bytes move from old shards into new capacities.

The flow is solved over shards, not rows: a block that stays costs nothing, a moved byte costs one. Each old shard is then
read as a line of bytes in the order of (hash of text, hash of id), cut where the flow says; a row goes where its first byte
lies, so a new shard misses its capacity by less than a row for each cut. Equal texts share an old shard and stand side by
side on its line, so a group of copies is cut only where a cut falls into it.

Positions on the line are prefix sums in two levels (hash ranges, then rows), so neither a large shard nor a large group
of copies meets in one task.

``reshard`` makes the plan, one row a document: it is all that the query ``op10_reshard`` returns. ``rewrite`` carries it out on a folder.

Rows and nulls: a null text has no bytes, size 1 and checksum 0, like an empty one; a null doc_id is a row like any other.
Rows with equal doc_id and text are interchangeable: they are counted before anything is sorted, so a row repeated very often meets
no task. A very long text is one row of its size. An empty table gives an empty plan. Other columns are not read by ``reshard``;
``rewrite`` keeps them, but for ``shard`` and ``slot``, which it sets. Names that start with ``__`` are reserved there.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import buckets_for, copies, drop_path, materialize, numbered, scratch, table, unit_range


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each supply to each demand at least total cost; successive shortest paths with potentials.

    Supplies and demands must have the same total. The graph has a node for each shard, so this is small work for the driver.
    """
    n, m = len(supply), len(demand)
    source, sink, size = n + m, n + m + 1, n + m + 2
    edges: list[list[int]] = []  # to, capacity left, cost, index of the reverse edge
    out: list[list[int]] = [[] for _ in range(size)]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        out[a].append(len(edges))
        edges.append([b, cap, c, len(edges) + 1])
        out[b].append(len(edges))
        edges.append([a, 0, -c, len(edges) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supply[i], demand[j]), cost[i][j])
    rise = [0] * size
    while True:
        dist: list[float] = [float("inf")] * size
        via = [-1] * size
        dist[source] = 0
        todo = [(0, source)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, cap, c, _ = edges[e]
                if cap and (new := d + c + rise[a] - rise[b]) < dist[b]:
                    dist[b], via[b] = new, e
                    heapq.heappush(todo, (new, b))
        if via[sink] < 0:
            break
        rise = [r + (d if d < float("inf") else 0) for r, d in zip(rise, dist)]
        path, node = [], sink
        while node != source:
            path.append(via[node])
            node = edges[edges[via[node]][3]][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[edges[e][3]][1] += amount
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            b, _, _, back = edges[e]
            if n <= b < n + m and e % 2 == 0:
                flow[i][b - n] = edges[back][1]
    return flow


def cuts(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old, from, to, new): what of each old shard's line goes where. Shards of one number are the same place."""
    total = sum(sizes.values())
    olds = sorted(sizes)
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = min_cost_flow([sizes[o] for o in olds], room, [[int(o != j) for j in range(shards)] for o in olds])
    found = []
    for i, old in enumerate(olds):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != old, j)):
            if flow[i][j]:
                found.append((old, at, at + flow[i][j], j))
                at += flow[i][j]
    return found


def lines(docs: DataFrame, old_shard: Column) -> DataFrame:
    """doc_id, size, crc, old, at (bytes before it on its old shard's line), nth (rows before it); written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("th"), F.xxhash64(F.lit("row"), F.col("doc_id")).alias("dh"), old_shard.alias("old"),
    )
    buckets = buckets_for(docs.count())
    same = ["old", "th", "dh", "doc_id", "size", "crc"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("n")).withColumn("sub", unit_range(F.col("dh"), buckets))
    rows = materialize(rows.withColumn("bytes", F.col("n") * F.col("size")), "rows")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = before(Window.partitionBy("old", "th", "sub").orderBy("dh", "doc_id", "size", "crc"))
    placed = rows.withColumn("rn", zero(F.sum("n").over(own))).withColumn("rb", zero(F.sum("bytes").over(own)))
    cells = rows.groupBy("old", "th", "sub").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    cells = cells.withColumn("b", unit_range(F.col("th"), buckets))
    inner = before(Window.partitionBy("old", "b").orderBy(F.shiftrightunsigned("th", 32), "th", "sub"))
    cells = cells.withColumn("n0", zero(F.sum("n").over(inner))).withColumn("bytes0", zero(F.sum("bytes").over(inner)))
    outer = before(Window.partitionBy("old").orderBy("b"))
    base = cells.groupBy("old", "b").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    base = base.select("old", "b", zero(F.sum("bn").over(outer)).alias("n1"), zero(F.sum("bb").over(outer)).alias("bytes1"))
    cells = cells.join(base, ["old", "b"]).select("old", "th", "sub", (F.col("n0") + F.col("n1")).alias("cn"), (F.col("bytes0") + F.col("bytes1")).alias("cb"))
    placed = placed.join(cells, ["old", "th", "sub"]).select("doc_id", "size", "crc", "old", "n", (F.col("cb") + F.col("rb")).alias("at"), (F.col("cn") + F.col("rn")).alias("nth"))
    placed = copies(materialize(placed, "placed"), "n")
    return materialize(placed.select("doc_id", "size", "crc", "old", (F.col("at") + F.col("copy") * F.col("size")).alias("at"), (F.col("nth") + F.col("copy")).alias("nth")), "lines")


def grown(shards: int) -> Column:
    """Old shard of a row by the hash of its text, as before a growth of two shards."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(max(1, shards - 2))).cast("int")


def reshard(docs: DataFrame, shards: int = 8, old_shard: Column | None = None) -> DataFrame:
    """doc_id, size, crc, old, shard, slot (gapless from 0 in each shard), moved.

    ``old_shard`` is the shard number that a row is in now; without one, rows are taken to lie in ``shards - 2`` shards by
    the hash of their text, as after a growth of two shards.
    """
    old = grown(shards) if old_shard is None else old_shard
    with scratch(docs.sparkSession) as keep:
        placed = keep(lines(docs, old))
    sizes = {r["old"]: r["s"] for r in placed.groupBy("old").agg(F.sum("size").alias("s")).collect()}  # one row a shard
    spark = docs.sparkSession
    plan = spark.createDataFrame(cuts(sizes, shards) if sizes else [], "old int, lo long, hi long, shard int")
    there = F.broadcast(plan)  # shards old and new, less one, rows at most for a tree of transfers
    put = placed.join(there, (placed["old"] == there["old"]) & (placed["at"] >= there["lo"]) & (placed["at"] < there["hi"])).drop(there["old"])
    runs = put.groupBy("old", "shard").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    start = Window.partitionBy("shard").orderBy("old").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(start), F.lit(0))).select("old", "shard", (F.col("base") - F.col("first")).alias("shift"))
    out = put.join(F.broadcast(runs), ["old", "shard"])
    return out.select("doc_id", "size", "crc", "old", "shard", (F.col("nth") + F.col("shift")).alias("slot"), (F.col("old") != F.col("shard")).alias("moved"))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, affected_only: bool = True, shards: int | None = None, old_shard: Column | None = None) -> None:
    """Write shards as ``path/shard=k``; with ``affected_only`` just those that lose or gain a row, so the files of others stay as
    they are. Shards without rows are deleted.

    ``plan`` is from ``reshard`` of the same rows, ``shards`` and ``old_shard``; without either, shards are as many as the plan's. Each
    row of ``docs`` takes one row of the plan with its doc_id (null or not), size, checksum and old shard; rows that agree in those
    are numbered on both sides. All that is to be written is copied to the work folder first: ``docs`` may be what lies in ``path``.
    """
    spark = docs.sparkSession
    keys = ["__id", "__size", "__crc", "__old"]
    with scratch(spark):
        plan = materialize(plan.select("doc_id", "size", "crc", "old", "shard", "slot", "moved"), "plan")
        if shards is None and old_shard is None:
            shards = (plan.agg(F.max("shard")).first()[0] or 0) + 1
        text = F.coalesce(F.col("text"), F.lit(""))
        own = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")), grown(shards) if old_shard is None else old_shard]
        rows = docs.select("*", *[c.alias(k) for c, k in zip(own, keys)]).drop("shard", "slot")
        to = plan.select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "size", "crc", "old"), keys)], "shard", "slot")
        if affected_only:  # numbers of shards, as many as there are
            hit = F.broadcast(plan.filter("moved").select(F.explode(F.array("old", "shard")).alias("hit")).distinct())
            rows, to = (x.join(hit, F.col("__old") == F.col("hit"), "left_semi") for x in (rows, to))
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "snapshot")
        rows = numbered(rows, keys, F.col("__row"), "__nth").alias("d")
        to = numbered(materialize(to, "to"), keys, F.xxhash64("shard", "slot"), "__nth").alias("t")
        on = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "__nth"]]
        names = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
        out = rows.join(to, on).select(*names, "t.shard", "t.slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        gone = plan.select(F.col("old").alias("shard")).distinct().join(plan.select("shard").distinct(), "shard", "left_anti").collect()  # numbers of shards
    for r in gone:
        drop_path(spark, f"{path.rstrip('/')}/shard={r['shard']}")


def op10_reshard(spark, sf_dir) -> DataFrame:
    plan = reshard(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
