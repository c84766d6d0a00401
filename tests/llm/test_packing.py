import random
from collections import defaultdict

import pytest

from quire.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_document_once(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 64, 256, 1500])
    h = {r.randint(0, capacity): r.randint(1, 400) for _ in range(r.randint(1, 90))}
    plan = packing.make_plan(h, capacity)
    load = defaultdict(int)
    for size, runs in plan.placed.items():
        assert sorted(runs)[0][0] == 0 and sum(n for _, _, n in runs) == h[size]
        at = 0
        for rank, first, n in sorted(runs):
            assert rank == at
            at += n
            for c in range(first, first + n):
                load[c] += size
    assert all(x <= capacity for x in load.values()) and len(load) == plan.containers or not any(s for s in h)
    total = sum(s * n for s, n in h.items())
    # the usual bound of largest-first packing
    assert plan.containers <= 11 / 9 * max(-(-total // capacity), sum(n for s, n in h.items() if 2 * s > capacity)) + 2


def pack(spark, sizes, capacities):
    s = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    c = spark.createDataFrame([(i, None, x) for i, x in enumerate(capacities)], "spec_id int, label string, capacity int")
    return packing.pack(s, c).collect()


def test_parts_zero_null_and_repeats(spark):
    rows = pack(spark, [(1, 25), (2, 0), (3, None), (4, 10), (5, 3), (5, 3), (None, 2)], [10, 4, None, 0])
    for spec, capacity in ((0, 10), (1, 4)):
        own = [r for r in rows if r.spec_id == spec]
        load = defaultdict(int)
        for r in own:
            load[r.container_id] += r.n_tokens
            assert r.start_token == r.part_no * capacity
        assert max(load.values()) <= capacity
        by = defaultdict(list)
        for r in own:
            by[r.doc_id].append(r.n_tokens)
        assert sum(by[1]) == 25 and len(by[1]) == -(-25 // capacity) and by[2] == [0] and by[3] == [0] and by[5] == [3, 3] and by[None] == [2]
    assert {r.spec_id for r in rows} == {0, 1}


def test_hot_size_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    rows = pack(spark, [(i, 5) for i in range(300)] + [(1000 + i, 3) for i in range(50)], [13])
    load = defaultdict(int)
    for r in rows:
        load[r.container_id] += r.n_tokens
    assert len(rows) == 350 and max(load.values()) <= 13 and len(load) <= 150


def test_empty(spark):
    assert pack(spark, [], [10]) == []
