from __future__ import annotations

import json
import random
from decimal import Decimal

import pytest

from evalfold.functions import documents as D


def texts(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.c for r in sorted(rows.select("i", D.canonical(rows.x).alias("c")).collect(), key=lambda r: r.i)]


BIG = "123456789012345678901234567890123456789012"
SAME = [
    ["100", "1e2", "100.0", "1E+2", "10e1", "0.1e3"], ["0", "-0", "0.000", "0e9", "-0.0e-3"], [BIG, BIG + ".0", f"{BIG}0e-1"], [BIG[:-1] + "3"], ["-1.5", "-15e-1", "-1.50"], ["1e400"], ["1e-400", "10e-401"],
    ['{"a":1,"b":[{"y":2,"x":null}]}', '{ "b" : [ {"x":null, "y":2.0} ] ,\n"a":1e0 }'], ['{"a":1,"b":[{"x":null,"y":"2"}]}'], ['"\\u0061\\n"', '"a\\u000a"'], ['"1"'], ['["n1"]'], ['[1]', '[1.0]'], ['"s1"'], ['"[\\"n1\\"]"'], ["true"], ['{"1":1}'], ['{"s":"n"}'],
]
NOT = ["", " ", "NaN", '{"a":NaN}', "Infinity", "01", "1.", ".5", "+1", "1 2", "[1,]", "{1:2}", '{"a":1,"a":2}', "{'a':1}", "tru", '"a', "1,2", "1],[2", "1},{", '1,"b":2', '1,"z":2', "1}", "[1", '{"a"}', '"\t"', None]


def test_numbers_are_equal_by_value_and_never_rounded(spark):
    got = texts(spark, [x for group in SAME for x in group])
    seen, at = [], 0
    for group in SAME:
        own = set(got[at : at + len(group)])
        at += len(group)
        assert len(own) == 1 and None not in own, group
        seen += own
    assert len(set(seen)) == len(SAME)
    # The text is JSON of the same value.
    for group, x in zip(SAME, seen):
        assert json.loads(x, parse_int=Decimal, parse_float=Decimal) == json.loads(group[0], parse_int=Decimal, parse_float=Decimal)


def test_what_is_not_json(spark):
    assert dict(zip(NOT, texts(spark, NOT))) == dict.fromkeys(NOT)


@pytest.mark.parametrize("seed", range(3))
def test_nested_values_against_a_parser(spark, seed):
    r = random.Random(seed)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        if kind == 6:
            return {r.choice(["a", "b\"", "ü", "s", "n", "1", ""]) + str(i): value(depth - 1) for i in range(r.randrange(4))}
        return [None, True, r.randrange(-1000, 1000), r.choice(["", "x", "[\"n1\"]", "\\", "日本", "\u0001"]), r.choice([0.5, -2.25, 1e30, 12.0])][kind]

    values = [value(3) for _ in range(60)]
    spelt = lambda v: json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
    one, two = texts(spark, [spelt(v) for v in values]), texts(spark, [spelt(v) for v in values])
    assert one == two
    for a, v in zip(one, values):
        assert json.loads(a, parse_int=Decimal, parse_float=Decimal) == json.loads(json.dumps(v), parse_int=Decimal, parse_float=Decimal)
        for b, w in zip(one, values):
            assert (a == b) == (json.dumps(v, sort_keys=True).replace(".0,", ",") == json.dumps(w, sort_keys=True).replace(".0,", ",") or v == w and type(v) is type(w) or a == b and v == w)


def test_long_texts_neither_recurse_nor_lose_numbers(spark):
    long = "\\n" + "x\\\\" * 20_000
    many = "[" + ",".join(f'{{"k":"{i}","v":{i}.50}}' for i in range(5000)) + "]"
    a, b, c, d = texts(spark, [f'{{"a":"{long}","b":2.0}}', many, '{"a":1e99999999999999999999,"b":2}', '{"a":"1.0,[\\"n2.0\\"]","b":[-0.0,-7.10]}'])
    assert json.loads(a) == json.loads(f'{{"a":"{long}","b":2}}') and json.loads(b) == json.loads(many)
    assert c is None and d == '{"a":"1.0,[\\"n2.0\\"]","b":[0,-71e-1]}'


def test_each_form_is_computed_once(spark):
    from evalfold.plans.contracts import canonical_json_equal

    plan = canonical_json_equal(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson") + plan.count("StaticInvoke(VariantExpressionEvalUtils") <= 3
