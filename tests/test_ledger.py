"""Ledgers that are split over tasks against a plain fold."""

import random

import pytest
from graphloom.operators import ledger

SCHEMA = "ledger long, at long, coins long"


def plain(rows, cap):
    out, state = [], {}
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    for own, at, coins in sorted(rows, key=key):
        spent, n = state.get(own, (0, 0))
        ok = coins is not None and spent + coins <= cap
        if ok:
            spent, n = spent + coins, n + 1
        state[own] = (spent, n)
        out.append((own, at, coins, ok, spent, max(0, cap - spent), f"tx_{n:04d}" if ok else None))
    return sorted(map(str, out))


def got(spark, rows, cap, each):
    found = ledger.settle(spark.createDataFrame(rows, SCHEMA), "ledger", "at", cap, rows_each=each)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("cap, least", [(40, 1), (500, 1), (40, -6)])
def test_a_hot_ledger_is_split(spark, cap, least):
    pick = random.Random(cap + least)
    rows = [(pick.choice([1, 1, 1, 1, 2, 3, None]), pick.randrange(300), pick.choice([None, *range(least, 9)])) for _ in range(900)]
    assert got(spark, rows, cap, 200) == plain(rows, cap)


def test_repeated_rows_and_one_partition(spark):
    rows = [(1, 5, 3)] * 60 + [(2, 1, None)] * 3
    assert got(spark, rows, 40, 10) == plain(rows, 40) == got(spark, rows, 40, 10_000)


def test_empty(spark):
    assert got(spark, [], 40, 10) == []


def test_blocks_are_what_the_fold_does():
    pick = random.Random(3)
    for _ in range(50):
        coins = [pick.choice([None, *range(-4, 12)]) for _ in range(pick.randrange(40))]
        block = ledger.Block(30, -200)
        for c in coins:
            block.add(c)
        assert len(block.parts) <= 231
        for start in range(-100, 31):
            spent, n = start, 0
            for c in coins:
                if c is not None and spent + c <= 30:
                    spent, n = spent + c, n + 1
            _, _, adds, accepts = next(p for p in block.parts if p[0] < start <= p[1])
            assert (start + adds, accepts) == (spent, n)
