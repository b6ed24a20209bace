"""Replay of testimony against a plain fold, in every order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut
from factloom.operators import replay

SCHEMA = "entity_id string, slot string, statement string, asserted_at timestamp_ntz, claim_id string"
NOW = dt.datetime(2030, 1, 1)


def fold(rows):
    out, last = {}, {}
    for e, s, statement, at, claim in sorted(set(rows), key=lambda r: (r[0], r[1], r[3] is None, r[3] or NOW, r[4], r[2])):
        run = last.get((e, s))
        if run is None or run["statement"] != statement:
            if run:
                run["until"] = at or NOW
            run = last[e, s] = {"statement": statement, "from": at, "until": None, "claims": []}
            out[e, s, claim] = run
        run["claims"].append(claim)
    return {k: (v["statement"], v["from"], v["until"], sorted(v["claims"])) for k, v in out.items()}


def shown(evidence):
    out = {}
    for r in evidence.collect():
        out.setdefault((r["entity_id"], r["slot"], r["observation_id"]), (r["statement"], r["valid_from"], r["valid_until"], []))[3].append(r["claim_id"])
    for v in out.values():
        v[3].sort()
    return out


def told(seed, n=150):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.06 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(120))
    return [(rng.choice("ab"), rng.choice("xy"), rng.choice(["red", "blue", "green"]), day(), f"c{k:03}") for k in range(n)]


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_replay_equals_a_plain_fold(spark, days):
    rows = told(days)
    rows += rows[:5]
    got = shown(replay.replay(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), days))
    assert got == fold(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_arrival_order_does_not_matter(spark, seed):
    rows = told(seed, 90)
    random.Random(seed).shuffle(rows)
    cuts = [0, 40, 60, 70, 90]
    state = cut(replay.replay(spark.createDataFrame(rows[:40], SCHEMA), F.lit(NOW), 10))
    for a, z in zip(cuts[1:], cuts[2:]):
        state = cut(replay.resplit_state(state, spark.createDataFrame(rows[a:z], SCHEMA), F.lit(NOW), 10))
        assert shown(state) == fold(rows[:z])


def test_a_late_statement_splits_what_it_falls_into(spark):
    at = lambda d: dt.datetime(2020, 1, d)
    first = [("e", "s", "A", at(1), "c1"), ("e", "s", "A", at(3), "c3"), ("f", "s", "A", at(1), "d1")]
    state = cut(replay.replay(spark.createDataFrame(first, SCHEMA), F.lit(NOW)))
    touched, again = replay.resplit(state, spark.createDataFrame([("e", "s", "B", at(2), "c2")], SCHEMA), F.lit(NOW))
    assert [tuple(r) for r in touched.collect()] == [("e", "s", "c1")]
    assert shown(again) == {("e", "s", "c1"): ("A", at(1), at(2), ["c1"]), ("e", "s", "c2"): ("B", at(2), at(3), ["c2"]), ("e", "s", "c3"): ("A", at(3), None, ["c3"])}


def test_no_testimony(spark):
    none = spark.createDataFrame([], SCHEMA)
    state = cut(replay.replay(none, F.lit(NOW)))
    assert state.collect() == [] and replay.resplit_state(state, none, F.lit(NOW)).collect() == []
