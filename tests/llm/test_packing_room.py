import random

from noticelake.llm import packing


def test_cut_only_where_no_sequence_has_room():
    rng = random.Random(2)
    for lengths in ([rng.randint(1, 2047) for _ in range(1500)], [min(2047, int(rng.lognormvariate(6, 1)) + 1) for _ in range(1500)]):
        total = sum(lengths)
        capacity = [2048] * (total // 2048) + [1 << b for b in reversed(range(12)) if total % 2048 >> b & 1]
        used, cost, left = [0] * len(capacity), [0.0] * len(capacity), list(lengths)
        for item, start, n, s, offset in packing.assign(lengths):
            assert start == lengths[item] - left[item] and offset == used[s]
            fits = [(cost[k], k) for k, c in enumerate(capacity) if c - used[k] >= left[item]]
            if fits:
                assert n == left[item] and s == min(fits)[1]
            else:
                assert s == min((cost[k], k) for k, c in enumerate(capacity) if c > used[k])[1] and n == capacity[s] - used[s]
            used[s], left[item], cost[s] = used[s] + n, left[item] - n, cost[s] + n + packing.QUADRATIC * n * n
        assert used == capacity and not any(left)
