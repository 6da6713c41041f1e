from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import flatten

BODIES = [
    (1, '{"a": {"b": [{"c": 1}, null, [{"d": {}}], 5, "x"]}, "e": [], "f": {}}'),
    (2, None),
    (3, ""),
    (4, "[]"),
    (5, '{"a": {"b": 1}'),
    (6, json.dumps('{"q": {"r": "{\\"no\\": 1}"}}')),
    (7, '﻿ \n{"a": [{"k\\"ey": {"x.y": {}}}]} '),
    (8, "{'a': {}}"),
    (9, '{"a": NaN}'),
    (10, '{"a": {}, "a": {}}'),
    (11, '{"s": "{ [ , : \\\\", "t": {"u": "\\\\\\" }"}}'),
    (1, '{"a": {"b": [{"c": 1}, null, [{"d": {}}], 5, "x"]}, "e": [], "f": {}}'),
]


def brute(rows):
    nodes, values = set(), []

    def walk(i, v, path, parent):
        if isinstance(v, dict):
            if path != "$":
                nodes.add((i, path, parent))
            for k, x in v.items():
                if not isinstance(x, (dict, list)):
                    values.append((i, path, k))
                walk(i, x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                walk(i, x, f"{path}[{n}]", parent)

    for i, b in rows:
        t = flatten.readable(b)
        if t is not None:
            walk(i, json.loads(t), "$", "$")
    return nodes, values


def test_nodes_of_all_kinds_of_bodies(spark):
    df = spark.createDataFrame(BODIES, "record_id long, body string")
    got = {(r.record_id, r.node, r.parent) for r in flatten.json_nodes(df).collect()}
    assert got == brute(BODIES)[0]
    assert (1, "$.a.b[2][0].d", "$.a.b[2][0]") in got
    assert (7, '$.a[0].k"ey.x.y', '$.a[0].k"ey') in got
    assert not any(i in (2, 3, 4, 5, 8, 9) for i, *_ in got)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"a": {}}', "n", "p", 1)], "record_id long, body string, node string, parent string, depth int")
    assert [(r.node, r.parent, r.depth) for r in flatten.json_nodes(df).collect()] == [("$.a", "$", 1)]
    assert flatten.json_nodes(df.limit(0)).count() == 0
    assert flatten.json_values(df.limit(0)).count() == 0


def test_long_body(spark):
    body = json.dumps({"messages": [{"role": "user", "content": "x" * 50_000, "n": {"i": i}} for i in range(300)]})
    df = spark.createDataFrame([(1, body)], "record_id long, body string")
    assert flatten.json_nodes(df).count() == 600


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=5)
tree = st.recursive(leaf, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=4), c, max_size=4), max_leaves=20)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(min_size=1, max_size=4), tree, max_size=4), min_size=1, max_size=5), st.booleans())
def test_structure_equals_recursion(records, ascii_only):
    import pyarrow as pa

    rows = [(i, json.dumps(r, ensure_ascii=ascii_only)) for i, r in enumerate(records)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([b for _, b in rows], pa.string())], names=["record_id", "body"])
    nodes, values = brute(rows)
    got = {(i, n, p) for out in flatten._nodes(iter([batch])) for i, n, p in zip(*(out.column(k).to_pylist() for k in range(3)))}
    assert got == nodes
    scalars = [(i, n, f) for out in flatten._values(iter([batch])) for i, n, f in zip(*(out.column(k).to_pylist() for k in range(3)))]
    assert sorted(scalars) == sorted(values)


def every_scalar(body):
    out = []

    def walk(v, path):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            named = isinstance(v, dict)
            if isinstance(x, (dict, list)):
                walk(x, f"{path}.{k}" if named else f"{path}[{k}]")
            else:
                kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
                out.append((path, k if named else None, None if named else k, kind, None if x is None else x if isinstance(x, str) else json.dumps(x)))

    walk(json.loads(body), "$")
    return out


def values_of(batch):
    return [tuple(r[c] for c in ("record_id", "node", "field", "position", "kind", "value")) for out in flatten._scalars(iter([batch]), elements=True) for r in out.to_pylist()]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(min_size=1, max_size=4), tree, max_size=4), min_size=1, max_size=5), st.sampled_from([None, 1]))
def test_every_scalar_equals_recursion(records, indent):
    import pyarrow as pa

    bodies = [json.dumps(r, indent=indent) for r in records]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.string())], names=["record_id", "body"])
    assert sorted(map(repr, values_of(batch))) == sorted(repr((i, *v)) for i, b in enumerate(bodies) for v in every_scalar(b))


def test_scalar_elements_of_arrays(spark):
    body = '{"outputs": ["a, [b", {"text": "c"}, null, [1, [], true]], "messages": [ null , {"role": "user"}], "none": [ ]}'
    df = spark.createDataFrame([(1, body), (2, "[1, 2]")], "record_id long, body string")
    got = sorted(map(repr, ((r.node, r.field, r.position, r.kind, r.value) for r in flatten.json_values(df).collect())))
    assert got == sorted(map(repr, every_scalar(body)))
    assert repr(("$.outputs", None, 0, "string", "a, [b")) in got and repr(("$.outputs[3]", None, 2, "boolean", "true")) in got
    assert repr(("$.messages", None, 0, "null", None)) in got


def test_child_table_round_trip(spark):
    rows = [(1, [("u", "a"), ("v", None)]), (2, []), (3, None), (4, [None, ("w", "b")])]
    df = spark.createDataFrame(rows, "row_id long, ms array<struct<row_id:string,content:string>>")
    got = sorted((r.row_id, r.position, r.child_row_id, r.content) for r in flatten.child_table(df, ["row_id"], "ms").collect() if r.row_id != 4)
    assert got == [(1, 0, "u", "a"), (1, 1, "v", None)]
    four = sorted((r.position, r.child_row_id, r.content) for r in flatten.child_table(df, ["row_id"], "ms").where("row_id = 4").collect())
    assert four == [(0, None, None), (1, "w", "b")]
    s = spark.createDataFrame([(1, ("x", None)), (2, None)], "row_id long, rm struct<style:string,row_id:string>")
    assert [tuple(r) for r in flatten.struct_table(s, ["row_id"], "rm").collect()] == [(1, "x", None)]
