"""The flow and the blocks of the resharding against brute force."""

import itertools
import random
from functools import cache

from logloom.llm.resharding import Block, assign_blocks, shortest_flow


def cheapest(supply, demand, cost):
    """The least cost by trying every way to ship unit after unit."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]

    @cache
    def best(k, room):
        if k == len(units):
            return 0
        return min(
            (cost[units[k]][j] + best(k + 1, tuple(r - (x == j) for x, r in enumerate(room))) for j in range(len(room)) if room[j]),
            default=float("inf"),
        )

    return best(0, tuple(demand))


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        m, n = rng.randint(1, 4), rng.randint(1, 4)
        supply = [rng.randint(0, 4) for _ in range(m)]
        demand = [rng.randint(0, 4) for _ in range(n)]
        demand[0] += max(0, sum(supply) - sum(demand))
        cost = [[rng.randint(0, 5) for _ in range(n)] for _ in range(m)]
        flow = shortest_flow(supply, demand, cost)
        assert [sum(row) for row in flow] == supply and all(sum(row[j] for row in flow) <= demand[j] for j in range(n))
        assert all(x >= 0 for row in flow for x in row)
        assert sum(flow[i][j] * cost[i][j] for i in range(m) for j in range(n)) == cheapest(supply, demand, cost)


def judged(blocks, place, shards):
    load = [0] * shards
    for b in blocks:
        load[place[b.old, b.block]] += b.size
    return max(load) - min(load), sum(b.size for b in blocks if place[b.old, b.block] != b.old)


def test_blocks_move_little_more_than_the_best_placement():
    """No placement that is as even moves much less than ours: by less than two
    of the largest blocks, which is what whole blocks can cost a shard."""
    rng = random.Random(5)
    for old_shards, shards in ((2, 3), (3, 2), (3, 3)):
        for _ in range(12):
            blocks = [Block(rng.randrange(old_shards), k, rng.randint(1, 30)) for k in range(8)]
            spread, moved = judged(blocks, assign_blocks(blocks, old_shards, shards), shards)
            even, best = [], float("inf")
            for places in itertools.product(range(shards), repeat=len(blocks)):
                s, m = judged(blocks, {(b.old, b.block): p for b, p in zip(blocks, places)}, shards)
                even.append(s)
                if s <= spread:
                    best = min(best, m)
            largest = max(b.size for b in blocks)
            assert moved <= best + 2 * largest and spread <= min(even) + largest


def test_many_blocks_move_what_the_flow_moves():
    rng = random.Random(7)
    blocks = [Block(i, k, rng.randint(500, 1500)) for i in range(6) for k in range(400 + 100 * i)]
    sizes = [sum(b.size for b in blocks if b.old == i) for i in range(6)]
    spread, moved = judged(blocks, assign_blocks(blocks, 6, 8), 8)
    total = sum(sizes)
    # Staying is free, so the least is what lies above the new shards' capacities.
    least = sum(max(0, s - total // 8) for s in sizes)
    assert spread <= 1500 and least <= moved + 1500 * 6 and moved <= least * 1.02
