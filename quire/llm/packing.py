"""Filling containers of fixed capacity with documents (problem 7).

A document's size is its length in tokens. Sizes are whole numbers up to the capacity, so the histogram of sizes is
bounded by the capacity however many documents there are; the driver plans on that histogram alone:

1. linear grouping: large sizes are put into groups of equal cardinality and rounded up to the largest of the group;
2. configurations of the few rounded sizes that fill a container best are chosen and repeated as often as the groups
   allow;
3. the actual documents replace the rounded sizes, which frees what the rounding had added;
4. small documents go, largest first, where they leave the least room.

A plan says: the documents of size s with ranks from r on go to the containers from c on. Executors give every
document its rank among those of its size (salted, so that a size that many documents share is split) and look up
its container.

Defined results: a document above the capacity is cut into parts that fill a container each and a rest, and no other
document is divided; null and empty texts have size 0 and take no room; a capacity that is null or below 1 has no
rows; repeated capacities are separate specs; equal documents are separate items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import bpe
from quire.session import cut

#: Sizes above the capacity divided by this are large.
LARGE = 6
#: Groups of the linear grouping.
GROUPS = 300
#: Documents of one size that are ranked in one task, about.
RANKED = 50_000


class Plan:
    """The containers of one capacity. ``placed[size]`` holds runs (first rank, first container, documents)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.containers = 0
        self.placed: dict[int, list[tuple[int, int, int]]] = {}
        self.taken: dict[int, int] = {}

    def open(self, n: int) -> int:
        self.containers += n
        return self.containers - n

    def put(self, size: int, first: int, n: int) -> None:
        """The next n documents of a size go to the containers from ``first`` on, one each."""
        rank = self.taken.get(size, 0)
        self.placed.setdefault(size, []).append((rank, first, n))
        self.taken[size] = rank + n


def linear_groups(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, deque]]:
    """(rounded size, runs of (size, count)) of k groups of about equal cardinality; sizes are in descending order."""
    if len(sizes) <= k:
        return [(s, deque([(s, n)])) for s, n in sizes]
    share = -(-sum(n for _, n in sizes) // k)
    groups, room = [], 0
    for s, n in sizes:
        while n:
            if not room:
                groups.append((s, deque()))
                room = share
            t = min(n, room)
            groups[-1][1].append((s, t))
            n, room = n - t, room - t
    return groups


def best_configuration(rounded: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each group fill a container best, the largest group that is left among them. Sums are bits."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - rounded[first]
    mask = (1 << (room + 1)) - 1
    stages, sums = [], 1
    for g in range(first, len(rounded)):
        most = min(left[g] - (g == first), room // rounded[g])
        for _ in range(most):
            grown = sums | (sums << rounded[g] & mask)
            if grown == sums:
                break
            stages.append((g, sums))
            sums = grown
    use, rest = [0] * len(rounded), sums.bit_length() - 1
    use[first] = 1
    for g, before in reversed(stages):
        if not before >> rest & 1:
            use[g] += 1
            rest -= rounded[g]
    return use


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for sizes from 1 to the capacity with their counts."""
    plan = Plan(capacity)
    sizes = sorted(((s, n) for s, n in histogram.items() if s > 0 and n > 0), reverse=True)
    large = [x for x in sizes if x[0] * LARGE > capacity]
    groups = linear_groups(large, GROUPS)
    rounded, left = [g[0] for g in groups], [sum(n for _, n in g[1]) for g in groups]
    free: dict[int, deque] = {}  # residual capacity -> runs of containers (first, count)
    while any(left):
        use = best_configuration(rounded, left, capacity)
        times = min(left[g] // n for g, n in enumerate(use) if n)
        runs = [(plan.open(times), times, capacity)]
        for g, n in enumerate(use):
            left[g] -= n * times
            for _ in range(n):
                after, queue = [], groups[g][1]
                for first, count, room in runs:
                    while count:
                        s, have = queue[0]
                        t = min(count, have)
                        plan.put(s, first, t)
                        after.append((first, t, room - s))
                        first, count = first + t, count - t
                        if t == have:
                            queue.popleft()
                        else:
                            queue[0] = (s, have - t)
                runs = after
        for first, count, room in runs:
            free.setdefault(room, deque()).append((first, count))
    rooms = sorted(r for r in free if r > 0)
    for s, n in sizes[len(large) :]:
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = min(n, capacity // s)
                times = n // each
                first = plan.open(times)
                for _ in range(each):
                    plan.put(s, first, times)
                n -= each * times
                room, run = capacity - each * s, (first, times)
            else:
                r = rooms[i]
                first, count = free[r].popleft()
                t = min(n, count)
                plan.put(s, first, t)
                n -= t
                if t < count:
                    free[r].appendleft((first + t, count - t))
                elif not free[r]:
                    del free[r], rooms[i]
                room, run = r - s, (first, t)
            if room > 0:
                if room not in free:
                    free[room] = deque()
                    insort(rooms, room)
                free[room].append(run)
    if histogram.get(0) and not plan.containers:
        plan.open(1)
    return plan


def _looked_up(plans: dict[int, Plan]):
    """A function of (spec, size, rank) arrays that gives the containers."""
    spec, size, rank, first = [], [], [], []
    for k, plan in plans.items():
        for s, runs in plan.placed.items():
            for r, c, _ in runs:
                spec.append(k), size.append(s), rank.append(r), first.append(c)
    at = {k: i for i, k in enumerate(plans)}
    width = max((p.capacity for p in plans.values()), default=0) + 1
    bins = np.array([at[k] for k in spec], dtype=np.int64) * width + np.array(size, dtype=np.int64)
    rank, first = np.array(rank, dtype=np.int64), np.array(first, dtype=np.int64)
    order = np.lexsort((rank, bins))
    bins, rank, first = bins[order], rank[order], first[order]
    total = np.array([p.containers for p in plans.values()] or [0], dtype=np.int64)
    specs = np.array(list(plans), dtype=np.int64)
    by = np.argsort(specs)

    def find(spec: np.ndarray, size: np.ndarray, r: np.ndarray) -> np.ndarray:
        index = by[np.searchsorted(specs[by], spec)]
        zero = r % np.maximum(total[index], 1)
        if not len(bins):
            return zero
        key = index * width + size
        lo, hi = np.searchsorted(bins, key), np.searchsorted(bins, key, side="right")
        while True:  # the last run of each bin that begins at or before the rank
            open_ = hi - lo > 1
            if not open_.any():
                break
            mid = (lo + hi) // 2
            right = open_ & (rank[np.minimum(mid, len(rank) - 1)] <= r)
            lo, hi = np.where(right, mid, lo), np.where(open_ & ~right, mid, hi)
        lo = np.minimum(lo, len(rank) - 1)
        return np.where(size > 0, first[lo] + r - rank[lo], zero)

    return find


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``spec_id, container_id, doc_id, part_no, start_token, n_tokens``: every document, or its parts, in a container.

    ``sizes`` (doc_id, n_tokens) is read more than once and ought to be written or checkpointed. ``containers`` is a
    table of settings, a few rows by definition.
    """
    specs = {r["spec_id"]: r["capacity"] for r in containers.select("spec_id", "capacity").collect() if r["spec_id"] is not None and r["capacity"] and r["capacity"] > 0}
    schema = "spec_id int, container_id bigint, doc_id bigint, part_no bigint, start_token bigint, n_tokens bigint"
    if not specs:
        return sizes.sparkSession.createDataFrame([], schema)
    spec = F.explode(F.array(*[F.struct(F.lit(k).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in specs.items()])).alias("_s")
    whole = F.col("n_tokens")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(n_tokens - 1) div capacity"), F.lit(0).cast("bigint"))))
    items = (
        sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"), spec)
        .select("doc_id", "n_tokens", "_s.*")
        .select("doc_id", "n_tokens", "spec_id", "capacity", parts.alias("part_no"))
        .select("spec_id", "doc_id", "part_no", (F.col("part_no") * F.col("capacity")).alias("start_token"), F.least(whole - F.col("part_no") * F.col("capacity"), F.col("capacity")).alias("size"))
    )
    # at most capacity + 1 sizes for each spec
    counts = items.groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[int, dict[int, int]] = {k: {} for k in specs}
    for r in counts:
        histograms[r["spec_id"]][r["size"]] = r["n"]
    plans = {k: make_plan(h, specs[k]) for k, h in histograms.items()}
    find = _looked_up(plans)

    most = F.expr("greatest(1, 1 + n div %d)" % RANKED)
    by_size = items.sparkSession.createDataFrame([(r["spec_id"], r["size"], r["n"]) for r in counts if r["n"] > RANKED] or [(-1, -1, 0)], "spec_id int, size bigint, n bigint")
    salted = items.join(F.broadcast(by_size.select("spec_id", "size", most.alias("salts"))), ["spec_id", "size"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.coalesce("salts", F.lit(1)).cast("bigint"))
    )
    keys = ["spec_id", "size", "salt"]
    local = salted.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "part_no")) - 1)
    offsets = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("salt")) - F.col("n")).drop("n")
    ranked = local.join(offsets, keys).select("spec_id", "doc_id", "part_no", "start_token", "size", (F.col("before") + F.col("r")).alias("rank"))
    out = pa.schema([("spec_id", pa.int32()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("part_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec, size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 4, 5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(find(spec, size, rank)), b.column(1), b.column(2), b.column(3), b.column(4)], schema=out)

    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, containers: DataFrame, folder: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """The documents, as long as their texts in tokens, in containers of each capacity."""
    return pack(cut(bpe.token_counts(documents, folder, name)), containers)
