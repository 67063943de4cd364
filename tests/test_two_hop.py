import random
from collections import Counter, defaultdict

import pytest

from platewise.operators import joins


@pytest.mark.parametrize("pairs", [joins.PAIRS, 0])
def test_two_hop(spark, monkeypatch, pairs):
    monkeypatch.setattr(joins, "PAIRS", pairs)
    rng = random.Random(4)
    likes = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *"abcdefgh"])) for _ in range(40)]
    holds = [(rng.choice([None, 10, 11, 12]), rng.choice([None, *"abcdefghxyz"])) for _ in range(80)]
    count, score = Counter(h for h in holds if None not in h), defaultdict(int)
    for u, i in set(likes):
        for (t, a), c in count.items():
            for (v, b), d in count.items():
                if a == i and t == v and a != b and (u is None or (u, b) not in likes):
                    score[u, b] += c * d
    expected = [(u, b, s) for w in {u for u, _ in score} for u, b, s in sorted(((u, b, s) for (u, b), s in score.items() if u == w), key=lambda x: (-x[2], x[1]))[:3]]
    got = joins.two_hop(spark.createDataFrame(likes, "u long, i string"), spark.createDataFrame(holds, "t long, i string"), 3)
    assert {tuple(r) for r in got.collect()} == set(expected)
    if pairs:  # users are dealt out once, whatever their items lead to
        plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(u") == 1
