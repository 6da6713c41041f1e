"""Deeply nested records into related flat tables (problem 5), on Arrow buffers.

Two forms of nesting are taken apart:

- JSON text (`json_nodes`, `json_values`): the bytes of a whole Arrow string array are scanned at once. Quotes, escapes
  and brackets are found by vector operations, depths are running sums, the parent of a node is the last bracket opened
  one level up, and its key or array position is read from the marks before it. Paths go down level by level with `take`.
- Arrow lists and structs (`child_table`): the offsets of a list array give the parent of each child
  (``list_parent_indices``), its values are emitted as they lie (``list_flatten``), and the keys of the parents are
  propagated by ``take``.

No row is taken apart in Python; a JSON body is only checked for being readable as a whole. One pass, no shuffle, and
memory in proportion to an Arrow batch.

Defined results: null, empty, cut or malformed bodies and bodies that hold no object give no rows; a body that is itself
a JSON string is opened once per layer; byte-order marks and blanks around a body are ignored; a key that stands twice in
an object gives one row for each path; null and scalar array elements count as positions; empty lists give no children.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: layers of JSON strings around a record that are opened
LAYERS = 3

_QUOTE, _BACKSLASH, _OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY, _COMMA, _COLON = b'"\\{}[],:'


def readable(body: str | None) -> str | None:
    """The text of the record a body holds, or None if it cannot be read whole or is no object."""
    for _ in range(LAYERS):
        if body is None:
            return None
        body = body.strip("﻿ \t\r\n\x00​\xa0")
        if not body or body[0] not in '{"':
            return None
        try:
            value = json.loads(body, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return None
        if isinstance(value, dict):
            return body
        if not isinstance(value, str):
            return None
        body = value
    return None


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are no JSON


class Structure:
    """The brackets of many JSON records in one byte buffer: row, kind, depth, parent, key and position of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        n = len(data)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        slash = data == _BACKSLASH
        escaped = np.zeros(n, bool)
        if slash.any():
            # a character is escaped if an odd run of backslashes stands before it
            at = np.arange(n)
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            run = at - last_other  # backslashes up to and with this place
            escaped[1:] = slash[:-1] & (run[:-1] % 2 == 1)
        quote = (data == _QUOTE) & ~escaped
        self.quotes = np.flatnonzero(quote)
        inside = (np.cumsum(quote) - quote) % 2 == 1  # whole records have an even number of quotes
        plain = ~inside & ~quote
        opens = plain & ((data == _OPEN_OBJECT) | (data == _OPEN_ARRAY))
        closes = plain & ((data == _CLOSE_OBJECT) | (data == _CLOSE_ARRAY))
        depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))  # balanced in each record
        self.at = np.flatnonzero(opens)
        self.row = row_of[self.at]
        self.depth = depth[self.at]
        self.is_object = data[self.at] == _OPEN_OBJECT
        self.commas = np.flatnonzero(plain & (data == _COMMA))
        self.comma_depth = depth[self.commas]
        self.colons = np.flatnonzero(plain & (data == _COLON))
        shut = np.flatnonzero(closes)
        self.close = np.full(len(self.at), n, np.int64)
        for d in np.unique(self.depth):  # on one level an opening mark and its closing mark alternate
            level = np.flatnonzero(self.depth == d)
            ends = shut[depth[shut] == d - 1]
            self.close[level] = ends[: len(level)]
        self.parent = np.full(len(self.at), -1, np.int64)
        self.position = np.full(len(self.at), -1, np.int64)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(1, (int(self.depth.max()) if len(self.at) else 0) + 1)]
        for upper, lower in zip(self.levels[:-1], self.levels[1:]):
            self.parent[lower] = upper[np.searchsorted(self.at[upper], self.at[lower]) - 1]
        for d, lower in enumerate(self.levels[1:], start=1):
            in_array = lower[~self.is_object[self.parent[lower]]]
            marks = self.commas[self.comma_depth == d]
            self.position[in_array] = np.searchsorted(marks, self.at[in_array]) - np.searchsorted(marks, self.at[self.parent[in_array]])

    def keys(self, places: np.ndarray) -> pa.Array:
        """The object keys right before the values at these places."""
        colon = self.colons[np.searchsorted(self.colons, places) - 1]
        q = np.searchsorted(self.quotes, colon)
        start, stop = self.quotes[q - 2] + 1, self.quotes[q - 1]
        lengths = stop - start
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        flat = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
        out = pa.Array.from_buffers(pa.utf8(), len(places), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[flat].tobytes())])
        slashed = pc.match_substring(out, "\\")
        if pc.any(slashed).as_py():
            out = pa.array([json.loads(f'"{k}"') if s else k for k, s in zip(out.to_pylist(), slashed.to_pylist())], pa.utf8())
        return out

    def paths(self) -> pa.Array:
        """The path of every bracket from $, taken down level by level."""
        if not len(self.at):
            return pa.array([], pa.utf8())
        parts, order = [pa.array(["$"] * len(self.levels[0]), pa.utf8())], [self.levels[0]]
        above = np.zeros(len(self.at), np.int64)
        above[self.levels[0]] = np.arange(len(self.levels[0]))
        for lower in self.levels[1:]:
            keyed = self.is_object[self.parent[lower]]
            step = pc.binary_join_element_wise("[", pc.cast(pa.array(self.position[lower]), pa.utf8()), "]", "")
            if keyed.any():
                named = pc.binary_join_element_wise(".", self.keys(self.at[lower[keyed]]), "")
                pick = np.where(keyed, np.cumsum(keyed) - 1, 0)
                step = pc.if_else(pa.array(keyed), named.take(pa.array(pick)), step)
            parts.append(pc.binary_join_element_wise(parts[-1].take(pa.array(above[self.parent[lower]])), step, ""))
            order.append(lower)
            above[lower] = np.arange(len(lower))
        where = np.empty(len(self.at), np.int64)
        where[np.concatenate(order)] = np.arange(len(self.at))
        return pa.concat_arrays(parts).take(pa.array(where))

    def object_above(self) -> np.ndarray:
        """The nearest object around each bracket, -1 for the record itself."""
        near = np.full(len(self.at), -1, np.int64)
        for lower in self.levels[1:]:
            up = self.parent[lower]
            near[lower] = np.where(self.is_object[up], up, near[up])
        return near


def _structure(bodies: pa.Array) -> tuple[np.ndarray, Structure, list[str]]:
    """(row numbers of readable bodies, their structure, their texts)."""
    texts = [readable(b) for b in bodies.to_pylist()]
    rows = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
    whole = [t.encode("utf-8", "surrogatepass") for t in texts if t is not None]
    data = np.frombuffer(b"".join(whole), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in whole], dtype=np.int64)].astype(np.int64)
    return rows, Structure(data, offsets), [t for t in texts if t is not None]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, s, _ = _structure(batch.column(1))
        if not len(rows):
            continue
        paths, near = s.paths(), s.object_above()
        pick = np.flatnonzero(s.is_object & (s.depth > 1))
        in_array = ~s.is_object[s.parent[pick]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows[s.row[pick]])),
                paths.take(pa.array(pick)),
                paths.take(pa.array(near[pick])),
                pa.array(s.depth[pick].astype(np.int32) - 1),
                pa.array(np.where(in_array, s.position[pick], 0).astype(np.int32), mask=~in_array),
            ],
            names=["record_id", "node", "parent", "depth", "position"],
        )


def json_nodes(df: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """(record_id, node, parent, depth, position): every JSON object below the top of a body, with the path of its parent object."""
    keep = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(body_col).alias("body")).where("record_id is not null and body is not null")
    return keep.mapInArrow(_nodes, "record_id long, node string, parent string, depth int, position int")


def _scalars(batches: Iterator[pa.RecordBatch], elements: bool) -> Iterator[pa.RecordBatch]:
    """The scalar fields of the objects of each batch and, if wanted, the scalar elements of its arrays."""
    for batch in batches:
        rows, s, _ = _structure(batch.column(1))
        if not len(rows):
            continue
        paths = s.paths()
        data = s.data
        # a value is a scalar if the mark after its colon (in an array after the opening bracket or the comma) is no bracket
        n = len(data)
        blank = np.isin(data, np.frombuffer(b" \t\r\n", np.uint8))
        next_plain = np.full(n + 1, n)
        idx = np.where(~blank, np.arange(n), n)
        next_plain[:n] = np.minimum.accumulate(idx[::-1])[::-1]
        mark, owner = s.colons, _owner(s, s.colons)
        if elements:
            arrays = np.flatnonzero(~s.is_object)
            around = _owner(s, s.commas)
            between = ~s.is_object[around]
            mark = np.r_[mark, s.at[arrays], s.commas[between]]
            owner = np.r_[owner, arrays, around[between]]
        first = next_plain[mark + 1]
        scalar = ~np.isin(data[first], np.frombuffer(b"{[]", np.uint8))  # a closing bracket: the array is empty
        first, owner = first[scalar], owner[scalar]
        if not len(first):
            continue
        is_text = data[first] == _QUOTE
        q = np.searchsorted(s.quotes, first)
        marks = np.sort(np.concatenate([s.commas, s.close]))
        bare = marks[np.minimum(np.searchsorted(marks, first), max(0, len(marks) - 1))] if len(marks) else first
        stop = np.where(is_text, s.quotes[np.minimum(q + 1, len(s.quotes) - 1)] + 1, bare)
        raw = [bytes(data[a:b]).decode().strip() for a, b in zip(first.tolist(), stop.tolist())]
        values = [json.loads(r) if r[:1] == '"' else None if r == "null" else r for r in raw]
        kind = ["string" if r[:1] == '"' else "null" if r == "null" else "boolean" if r in ("true", "false") else "number" for r in raw]
        in_object = s.is_object[owner]
        field = s.keys(first[in_object]).take(pa.array(np.cumsum(in_object) - 1, mask=~in_object))
        position = np.zeros(len(first), np.int32)
        for d in np.unique(s.depth[owner[~in_object]]):
            level = np.flatnonzero(~in_object & (s.depth[owner] == d))
            commas = s.commas[s.comma_depth == d]
            position[level] = np.searchsorted(commas, first[level]) - np.searchsorted(commas, s.at[owner[level]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows[s.row[owner]])), paths.take(pa.array(owner)), field, pa.array(kind, pa.string()), pa.array(values, pa.string()), pa.array(position, mask=in_object)],
            names=["record_id", "node", "field", "kind", "value", "position"],
        )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _scalars(batches, elements=False)


def _owner(s: Structure, places: np.ndarray) -> np.ndarray:
    """The innermost bracket open at each place: level by level the last one opened before it, if not yet closed."""
    best = np.full(len(places), -1, np.int64)
    for level in s.levels:
        k = np.searchsorted(s.at[level], places) - 1
        candidate = level[np.maximum(k, 0)]
        best = np.where((k >= 0) & (s.close[candidate] > places), candidate, best)
    return best


def json_values(df: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """(record_id, node, field, kind, value, position): every scalar of a body, the record itself being ``$``.

    The field of an object has its name in field and no position; the element of an array has no field, the array's path
    in node and its place there in position.
    """
    keep = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(body_col).alias("body")).where("record_id is not null and body is not null")
    return keep.mapInArrow(lambda it: _scalars(it, elements=True), "record_id long, node string, field string, kind string, value string, position int")


# ------------------------------------------------------------------------------------------------------- typed nesting


def child_table(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The elements of an array column as a child table: the parent's keys, the element's position, and its fields.

    Struct elements give one column a field (prefixed with ``child_`` where a key has that name), others one ``value``.
    """
    element = df.schema[column].dataType.elementType
    fields = element.fields if isinstance(element, T.StructType) else [T.StructField("value", element)]
    names = [f"child_{f.name}" if f.name in {*keys, "position"} else f.name for f in fields]
    out = T.StructType([*(df.schema[k] for k in keys), T.StructField("position", T.IntegerType()), *(T.StructField(n, f.dataType) for n, f in zip(names, fields))])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(n)
            parent = pc.list_parent_indices(lists)
            values = pc.list_flatten(lists)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            first = np.cumsum(lengths) - lengths
            position = np.arange(len(values)) - np.repeat(first, lengths)
            cols = [batch.column(i).take(parent) for i in range(n)] + [pa.array(position.astype(np.int32))]
            if isinstance(element, T.StructType):
                cols += [pc.struct_field(values, [i]) for i in range(len(fields))]
            else:
                cols.append(values)
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "position", *names])

    return df.select(*keys, column).mapInArrow(run, out)


def struct_table(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A struct column as a child table of at most one row for each parent; parents whose struct is null have none."""
    fields = df.schema[column].dataType.fieldNames()
    return df.where(F.col(column).isNotNull()).select(*keys, *[F.col(f"{column}.`{f}`").alias(f"child_{f}" if f in keys else f) for f in fields])
