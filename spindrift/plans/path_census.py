"""Census of JSON at any depth: every path of every kind of record, with types, ranges, lengths and sets of values.

Records are walked in the task that reads them, and summed there by (record, path); only the sums move. Keys that are data rather than
names (paths, ids, numbers, dates, mail addresses, very long ones) are folded to ``*``, members of lists to ``[]``. Values are listed for
true and false and for texts under one of ``enums`` (other texts are free text: their lengths count), all of them with their numbers. A task
that holds many of them (``HELD``) hands them on and begins anew. Whole numbers are summed exactly and become a double at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.live import live_lines
from .live_queries import _PARTS

#: The keys that are data.
DYNAMIC = re.compile(r"^.{49,}$|[/\\ @]|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|^(?=.*[0-9])[0-9a-f]{12,}$|^[0-9]+$|^\d{4}-\d{2}-\d{2}")
ENUMS = ("type", "role", "name", "subtype", "status", "stop_reason")
#: Characters of paths and values, 200 more for each, that a task sums at a time.
HELD = 16_000_000
KINDS = ("null", "bool", "int", "float", "str", "list", "dict")
_SUMS = [f"n_{k}" for k in KINDS]
FIELDS = "record string, path string, n long, " + ", ".join(f"{s} long" for s in _SUMS) + ", num_min double, num_max double, int_sum decimal(38,0), float_sum double, len_min long, len_max long, len_sum long, listed map<string, bigint>"


def _kind(v) -> str:
    if type(v) is int and not -(2**63) <= v < 2**64:  # as JSON readers of 64 bits have it
        return "float"
    return {type(None): "null", bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict"}[type(v)]


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = json.JSONDecoder(strict=True)


def parse(line: str):
    """``json.loads``, also of lists and objects nested deeper than it goes."""
    try:
        return json.loads(line)
    except RecursionError:
        pass
    skip = lambda i: _SPACE.match(line, i).end()
    bad = lambda i: json.JSONDecodeError("not JSON", line, i)
    top: list = []
    open_, keys, i = [top], [None], skip(0)
    while True:
        into = open_[-1]
        # A value: a list or an object is opened, anything else is read as it is.
        sign, value, opened = line[i : i + 1], None, False
        if sign and sign in "[{":
            value, i, opened = [] if sign == "[" else {}, skip(i + 1), True
        else:
            try:
                value, i = _PLAIN.raw_decode(line, i)
            except ValueError:
                raise bad(i) from None
            i = skip(i)
        if isinstance(into, dict):
            into[keys[-1]] = value
        else:
            into.append(value)
        if opened:
            open_.append(value)
            keys.append(None)
        # What follows: the end of what is open, or a comma, and the next key.
        fresh = opened
        while True:
            into, sign = open_[-1], line[i : i + 1]
            if into is top:
                if i != len(line):
                    raise bad(i)
                return top[0]
            if sign == ("}" if isinstance(into, dict) else "]"):
                open_.pop()
                keys.pop()
                i, fresh = skip(i + 1), False
                continue
            if not fresh:
                if sign != ",":
                    raise bad(i)
                i = skip(i + 1)
            break
        if isinstance(into, dict):
            if line[i : i + 1] != '"':
                raise bad(i)
            keys[-1], i = _PLAIN.raw_decode(line, i)
            i = skip(i)
            if line[i : i + 1] != ":":
                raise bad(i)
            i = skip(i + 1)


def _walk(value) -> Iterator[tuple]:
    """(path, value, key it stands under) of a value and all below it."""
    left = [("", value, "")]
    while left:
        path, value, leaf = left.pop()
        yield path, value, leaf
        if isinstance(value, dict):
            below = []
            for k, v in value.items():
                k = "*" if DYNAMIC.search(k) else k
                below.append((f"{path}.{k}" if path else k, v, k))
            left += reversed(below)
        elif isinstance(value, list):
            below = path + "[]"
            left += [(below, v, leaf) for v in reversed(value)]


def path_census(lines: DataFrame, column: str = "line", enums: tuple[str, ...] = ENUMS) -> DataFrame:
    """record (a record's ``type``), path ('' is the record itself), n, n of each type, least, greatest and sum of numbers and of lengths, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list] = {}
        held = 0
        for b in batches:
            for line in b.column(0).to_pylist():
                try:
                    record = parse(line) if line and line.startswith("{") else None
                except ValueError:
                    record = None
                if record is None:
                    continue
                of = record.get("type")
                for path, v, leaf in _walk(record):
                    e = found.setdefault((of if isinstance(of, str) else None, path), [0, dict.fromkeys(KINDS, 0), None, None, {}])
                    kind = _kind(v)
                    held += 200 + len(path) if not e[0] else 0
                    e[0] += 1
                    e[1][kind] += 1
                    if kind in ("int", "float"):
                        d, whole, part = float(v), v if kind == "int" else 0, float(v) if kind == "float" else 0.0
                        e[2] = (min(e[2][0], d), max(e[2][1], d), e[2][2] + whole, e[2][3] + part) if e[2] else (d, d, whole, part)
                    elif kind in ("str", "list"):
                        e[3] = (min(e[3][0], len(v)), max(e[3][1], len(v)), e[3][2] + len(v)) if e[3] else (len(v),) * 3
                    if kind == "bool" or kind == "str" and leaf in enums:
                        name = str(v).lower() if kind == "bool" else v
                        held += 200 + len(name) if name not in e[4] else 0
                        e[4][name] = e[4].get(name, 0) + 1
                    if held >= HELD:
                        yield rows_of(found)
                        found, held = {}, 0
        yield rows_of(found)

    def rows_of(found: dict[tuple[str, str], list]) -> pa.RecordBatch:
        rows = [(r, p, n, *types.values(), *(num or (None,) * 4), *(size or (None,) * 3), list(listed.items())) for (r, p), (n, types, num, size, listed) in found.items()]
        types = [pa.string(), pa.string(), *[pa.int64()] * 8, *[pa.float64()] * 2, pa.decimal128(38), pa.float64(), *[pa.int64()] * 3, pa.map_(pa.string(), pa.int64())]
        names = [re.split(r"\s", f)[0] for f in re.split(r", (?=\w+ )", FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    part = lines.select(column).mapInArrow(run, FIELDS)
    key = ["record", "path"]
    sums = part.groupBy(*key).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SUMS], F.min("num_min").alias("num_min"), F.max("num_max").alias("num_max"), (F.sum("int_sum").cast("double") + F.sum("float_sum")).alias("num_sum"), F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"), F.sum("len_sum").alias("len_sum"))
    values = part.select(*key, F.explode("listed").alias("value", "m")).groupBy(*key, "value").agg(F.sum("m").alias("m"))
    listed = values.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "m"))), lambda x: F.concat(x["value"], F.lit(":"), x["m"].cast("string"))), ",").alias("values"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"v.{c}")) for c in key]
    return sums.alias("s").join(listed.alias("v"), same, "left").select("s.*", "v.values")


#: Further lines with keys that are data.
_SNAPSHOT = "concat('{\"type\":\"snapshot\",\"files\":{\"src/f', conv_id % 7, '.py\":{\"version\":', turn, ',\"at\":\"2024-01-01\"},\"10', turn, '\":[1,2.5,null,{\"deep\":[[true]]}]},\"ok\":', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END, ',\"name\":\"n', conv_id % 20, '\"}')"


def _lines(conversations: DataFrame) -> DataFrame:
    shots = conversations.filter("conv_id is not null and turn is not null").select(F.expr(_SNAPSHOT).alias("line"))
    return live_lines(conversations).select("line").unionByName(shots)


QUERIES = {"path_census": lambda spark, sf_dir: path_census(_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet")))}
ORACLE = {
    "path_census": f"""
WITH RECURSIVE l0 AS (SELECT unnest(x) AS line FROM (SELECT [{_PARTS}, {_SNAPSHOT}] AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT row_number() OVER () AS r, line::JSON AS j FROM l0 WHERE starts_with(line, '{{') AND coalesce(json_valid(line), false)),
t AS (SELECT r, j->>'$.type' AS record, e.key AS key, e.type AS type, e.atom AS atom, e.id AS id, e.parent AS parent, e.fullkey AS full_ FROM l, json_tree(l.j) e),
w AS (SELECT r, record, id, type, atom, full_, '' AS path, '' AS leaf FROM t WHERE parent IS NULL
 UNION ALL SELECT t.r, t.record, t.id, t.type, t.atom, t.full_, CASE WHEN w.type = 'ARRAY' THEN w.path || '[]' ELSE concat(CASE WHEN w.path = '' THEN '' ELSE w.path || '.' END, k) END, CASE WHEN w.type = 'ARRAY' THEN w.leaf ELSE k END
 FROM w JOIN (SELECT *, CASE WHEN contains(key, '/') OR regexp_full_match(key, '[0-9]+') THEN '*' ELSE key END AS k FROM t) t ON t.r = w.r AND t.parent = w.id),
x AS (SELECT record, path, leaf, CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'BOOLEAN' THEN 'bool' WHEN type LIKE '%BIGINT' THEN 'int' WHEN type = 'DOUBLE' THEN 'float' WHEN type = 'VARCHAR' THEN 'str' WHEN type = 'ARRAY' THEN 'list' ELSE 'dict' END AS kind, atom,
  (SELECT count(*) FROM t c WHERE c.r = w.r AND c.parent = w.id) AS members FROM w),
s AS (SELECT *, CASE WHEN kind IN ('int', 'float') THEN atom::DOUBLE END AS num, CASE kind WHEN 'str' THEN length(atom->>'$') WHEN 'list' THEN members END AS len, CASE WHEN kind = 'bool' OR (kind = 'str' AND leaf IN {ENUMS}) THEN atom->>'$' END AS value FROM x),
v AS (SELECT record, path, string_agg(concat(value, ':', m), ',' ORDER BY value) AS vs FROM (SELECT record, path, value, count(*) AS m FROM s WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL),
g AS (SELECT record, path, count(*) AS n, {", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in KINDS)}, min(num) AS num_min, max(num) AS num_max, sum(num) AS num_sum, min(len) AS len_min, max(len) AS len_max, sum(len)::BIGINT AS len_sum FROM s GROUP BY ALL)
SELECT g.*, vs AS "values" FROM g LEFT JOIN v ON v.path = g.path AND v.record IS NOT DISTINCT FROM g.record""",
}
