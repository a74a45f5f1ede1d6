"""Documents changed in place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from relaymill.functions import json_values as J, splice as S
from relaymill.operators import messages as M
from relaymill.plans import flows
from relaymill.schema import ROUTES


def clock():
    return F.col("clock")


def forwarded(as_records, bodies, flow=1, hop=0):
    out = flows.forward(as_records(bodies), ROUTES[flow][hop], clock(), in_order=True).orderBy("seq").collect()
    assert all(r.reject_reason is None for r in out)
    return [r.body for r in out]


ENTRY = '{"stage":"process2_reflected","timestamp":"2025-08-20 10:15:20","modification":"Added +10 to counter and flagged reflected"}'
FLAG = '"process2_flow1_reflected":true'
IN_PLACE = [
    ('{"history": [], "counter": 5, "z": 1.50}', f'{{"history": [{ENTRY}], "counter": 15, "z": 1.50,{FLAG}}}'),
    ('{"counter":5,"a":{"counter":7,"history":[1]},"history":[ ]}', f'{{"counter":15,"a":{{"counter":7,"history":[1]}},"history":[ {ENTRY}],{FLAG}}}'),
    (' {"b":"\\u00e9\\"counter\\":1","history" : [{"x":[1,[2]]},"]"] ,"a":1e3} ',
     f' {{"b":"\\u00e9\\"counter\\":1","history" : [{{"x":[1,[2]]}},"]",{ENTRY}] ,"a":1e3,"counter":10,{FLAG}}}'),
    ('{"history":[[[]],[{}]],"counter":true}', f'{{"history":[[[]],[{{}}],{ENTRY}],"counter":11,{FLAG}}}'),
    ('{"history":["\\\\"],"counter":-0.5,"q":["}","]"]}', f'{{"history":["\\\\",{ENTRY}],"counter":9.5,"q":["}}","]"],{FLAG}}}'),
]


def test_in_place(as_records):
    assert forwarded(as_records, [b for b, _ in IN_PLACE]) == [wanted for _, wanted in IN_PLACE]


ANEW = [
    '{"history":[],"counter":1,"counter":5,"tag":7}',
    '{"history":[],"c\\u006funter":5,"tag":7}',
    '{"history":[],"counter":5,"process2_flow1_reflected":{"a":1},"tag":7}',
    '{"history":[1],"history":[],"counter":5,"tag":7}',
]


def test_written_anew_where_that_is_not_sure(as_records):
    for body in forwarded(as_records, ANEW):
        found = json.loads(body)
        assert found["counter"] == 15 and found["tag"] == 7 and found["process2_flow1_reflected"] is True
        assert len(found["history"]) == 1


def test_the_same_content_as_written_anew(as_records):
    """Random documents: equal as JSON, and untouched members byte for byte in their order."""
    rng = random.Random(4)
    names = ["a", "counter", 'q"', "history", "é", "", "x\\"]

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice(names): value(depth + 1) for _ in range(rng.randrange(4))}
        return [None, True, rng.randrange(10**6), rng.random(), rng.choice(['"', "]", "{,", "\\\\", ":", "é\n", ""])][kind]

    bodies = []
    for _ in range(150):
        members = {f"k{i}{rng.choice(names)}": value() for i in range(rng.randrange(5))}
        members |= {"counter": rng.randrange(100), "history": [value() for _ in range(rng.randrange(3))]}
        order = list(members)
        rng.shuffle(order)
        bodies.append(json.dumps({k: members[k] for k in order}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
    got = forwarded(as_records, bodies)
    plain = flows.forward(as_records(bodies), ROUTES[1][0], clock()).orderBy("seq").collect()
    for before, after, anew in zip(bodies, got, plain):
        assert json.loads(after) == json.loads(anew.body)
        assert list(json.loads(after)) == [*json.loads(before), "process2_flow1_reflected"]
        assert after.startswith(before[: min(before.index(f'"{k}"') for k in ("counter", "history"))])


def test_places(spark):
    text = '{"a":{"b":1},"b":"b","c":["b"],"d":2}'
    row = spark.range(1).select(F.lit(text).alias("t")).withColumn("p", S.cut(F.col("t")))
    got = row.select(*[S.place_of(F.col("p"), n).alias(n) for n in ("a", "b", "c", "d", "e")], S.pasted(F.col("p")).alias("t")).first()
    assert (got.a, got.b, got.c, got.d, got.e, got.t) == (2, 6, 10, 14, None, text)


BARE = [
    ('{"value": NaN}', '{"value": "NaN"}'),
    ('{"value":-Infinity,"a":"NaN, \\"Infinity\\" \\\\"}', '{"value":"-Infinity","a":"NaN, \\"Infinity\\" \\\\"}'),
    ("[NaN,Infinity]", '["NaN","Infinity"]'),
    ('{"NaN": 1}', '{"NaN": 1}'),
    ("{NaN: 1}", "{NaN: 1}"),
    ('{"a": NaNs, "b": xNaN, "c": +Infinity, "d": NaN.5}', '{"a": NaNs, "b": xNaN, "c": +Infinity, "d": NaN.5}'),
    ('{"a": "x\\\\", "b": NaN}', '{"a": "x\\\\", "b": "NaN"}'),
    ("NaN\x01", "NaN\x01"),
    (None, None),
]


def test_bare_words(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BARE)], "i int, t string")
    got = rows.orderBy("i").select(J.quoted_bare_words(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [wanted for _, wanted in BARE]
