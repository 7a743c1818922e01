import json

from veriloom.operators import nested


def found(spark, bodies):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(bodies)], "record_id bigint, body string, name string, entity string")
    return {tuple(r)[:5] for r in nested.entries(df).collect()}


def test_layouts_give_the_same_entries(spark):
    rec = {"methods": {"m1": {"chance": 0.1}, "m2": None}, "attack_family": {"a": "crop"}, "video": {"magnitude": {"m1": {"rows": [None, {"clip": "c", "trials": [None, {"speed": 1}]}]}}}}
    listed = {"methods": [{"name": "m1", "chance": 0.1}, None], "attack_family": [{"attack": "a", "family": "crop"}], "magnitude": [{"method": "m1", "rows": [None, {"clip": "c", "trials": [None, {"speed": 1}]}]}]}
    want = {("method", "m1", -1, -1), ("attack", "a", -1, -1), ("magnitude", "m1", -1, -1), ("row", "m1", 1, -1), ("trial", "m1", 1, 1)}
    bodies = [json.dumps(rec), json.dumps(listed), json.dumps(json.dumps(rec)), json.dumps({"record": rec}), json.dumps({"payload": json.dumps(listed)}), json.dumps({"results": [rec, rec]}), "﻿ " + json.dumps(rec, indent=1) + "\n"]
    got = found(spark, bodies)
    for i in range(len(bodies)):
        assert {r[1:] for r in got if r[0] == i} == want, bodies[i]


def test_lone_objects_and_empty_parts(spark):
    body = json.dumps({"methods": {}, "magnitude": {"m": {"rows": {"clip": "c", "trials": {"hit": True}}}, "n": {"rows": []}, "o": {"rows": None}}})
    assert {r[1:] for r in found(spark, [body])} == {("magnitude", "m", -1, -1), ("row", "m", 0, -1), ("trial", "m", 0, 0), ("magnitude", "n", -1, -1), ("magnitude", "o", -1, -1)}


def test_incomplete_blank_and_null_bodies_give_nothing(spark):
    whole = json.dumps({"methods": {"m": {"x": [1, 2]}}, "attack_family": {"a": "b"}})
    bodies = [whole[:i] for i in range(len(whole))] + [whole + "}", whole + " 1", None, "", "  ", "null", "7", "[]", '"text"']
    assert found(spark, bodies) == set()


def test_flat_tables_and_repeats(spark):
    body = json.dumps({"methods": {"m": {"chance": 0.5, "reid_ci": {"lo": 0.1, "hi": 0.2}}, "k": {"reid_ci": [0.3, float("nan")]}}, "magnitude": {"m": {"speed_median": ">2.0", "rows": [{"clip": "c", "speed": 1.5, "trials": [{"speed": 1.1, "hit": True}]}]}}})
    df = spark.createDataFrame([(1, body), (1, body), (None, body)], "record_id bigint, body string")
    t = nested.flat_tables(df)
    m = {r.method: r for r in t["methods"].collect()}
    assert (m["m"].reid_ci_lo, m["m"].reid_ci_hi, m["m"].chance) == (0.1, 0.2, 0.5) and m["k"].reid_ci_lo == 0.3
    assert t["magnitudes"].collect()[0].speed_median_text == ">2.0" and t["magnitudes"].collect()[0].speed_median is None
    assert [(r.ord, r.clip, r.speed) for r in t["rows"].collect()] == [(0, "c", 1.5)]
    assert [(r.ord, r.sub_ord, r.hit) for r in t["trials"].collect()] == [(0, 0, True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "record_id bigint, body string")
    assert nested.entries(df).count() == 0


def test_long_body(spark):
    body = json.dumps({"magnitude": {"m": {"rows": [{"clip": "c" * 100, "trials": [{"speed": i}] * 3} for i in range(3000)]}}})
    assert len(found(spark, [body])) == 1 + 3000 + 9000


def test_a_complete_body_counts_among_broken_repeats(spark):
    whole = json.dumps({"methods": {"m": {"x": 1}}})
    df = spark.createDataFrame([(1, whole), (1, "{zzz" + whole), (1, None), (2, "~~")], "record_id bigint, body string")
    assert {tuple(r)[:3] for r in nested.entries(df).collect()} == {(1, "method", "m")}
