"""Containment by automata against plain containment."""

import random

import pyarrow as pa
import pytest
from oracle import SMALL, of_frame, of_sql

from veilframe.operators import automata, evidence
from veilframe.plans import queries


def made(r, n, most, letters="abé日"):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["a", "ab", "abé日"])
def test_suffix_automaton_knows_all_pieces(letters):
    r = random.Random(3)
    for _ in range(30):
        keys = made(r, r.randint(0, 6), 12, letters)
        a = automata.suffixes([k.encode() for k in keys])
        values = made(r, 150, 7, letters) + [k[i:j] for k in keys for i in range(len(k)) for j in range(i, len(k) + 1)] + [x + y for x in keys for y in keys]
        assert automata.within(a, pa.array([v.encode() for v in values], pa.binary())).tolist() == [any(v.encode() in k.encode() for k in keys) or not v for v in values]
        assert len(a.edges) <= 3 * max(1, sum(len(k.encode()) + 1 for k in keys)) and a.n_bytes == 12 * len(a.edges)


def test_matches_equal_plain_ones_and_the_join(spark, monkeypatch):
    """Neither way loses or makes up a match; automata explode and join nothing."""
    r = random.Random(5)
    keys = sorted(set(made(r, 120, 40, "abc")) - {""})
    values = made(r, 800, 60, "abc") + [k[2:-2] for k in keys] + ["x" + k + "y" for k in keys] + keys + [None, "", "кварт" * 3, keys[0] + "\0" + keys[1]]
    d = spark.createDataFrame([(i, v, "fio" if i % 9 == 8 else "address") for i, v in enumerate(values)], "i long, value string, ty string")
    offices = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")
    key = lambda v: "".join(c for c in (v or "") if c.isalnum())
    long = lambda k: len(k.encode()) >= evidence.LEAST_KEY
    want = {i: i % 9 != 8 and any((long(k) and k in key(v)) or (long(key(v)) and key(v) in k) for k in keys) for i, v in enumerate(values)}
    found = evidence.office_match(d, offices)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan
    assert {x.i: x._office for x in found.collect()} == want and 100 < sum(want.values()) < len(values) - 100
    monkeypatch.setattr(automata, "MOST_KEY_BYTES", 10)
    assert {x.i: x._office for x in evidence.office_match(d, offices).collect()} == want
    with pytest.raises(ValueError):
        automata.contains_or_lies_in(spark, d.value, keys, 12)
    monkeypatch.undo()
    assert not any(x._office for x in evidence.office_match(d, offices.limit(0)).collect())


@pytest.mark.parametrize("name", ["office_containment"])
def test_query_equals_its_sql_by_either_way(spark, monkeypatch, name):
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])
    monkeypatch.setattr(automata, "MOST_KEY_BYTES", 0)
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])
