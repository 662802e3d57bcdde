"""Nested records: flatten, get, set, prune and rebuild.

Typed columns are handled by expressions generated from their schema, so a plan stays one projection. JSON without a
declared schema goes through ``typed``, which asks Spark for the schema that fits all rows, or through ``flatten_variant``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.text import MISSING
from loomery.sources.rounds import settled

_ENTRY = "array<struct<path:string,value:string>>"


def typed(df: DataFrame, col: str) -> DataFrame:
    """The JSON text column parsed under one schema that fits every row; unreadable rows become null."""
    schema = df.select(F.schema_of_variant_agg(F.try_parse_json(col))).first()[0]
    ddl = (schema or "STRING").replace("OBJECT<", "STRUCT<")
    return df.withColumn(col, F.from_json(col, "STRING" if ddl == "VOID" else ddl.replace("VOID", "STRING").replace("VARIANT", "STRING")))


def _leaf(path: Column, value: Column) -> Column:
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value"))).cast(_ENTRY)


def _join(path: Column | None, name: str) -> Column:
    return F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))


def entries(value: Column, kind: T.DataType, path: Column | None = None, style: str = "flat") -> Column:
    """An array of (path, value) of all leaves. Keys join with a dot; a list of primitives repeats its path; other lists
    write ``.[i]`` after it (``style="path"``: ``[i]``). Null leaves stay, empty lists and structs vanish."""
    none = F.array().cast(_ENTRY)
    if isinstance(kind, T.StructType):
        parts = [entries(value.getField(f.name), f.dataType, _join(path, f.name), style) for f in kind.fields]
        return F.when(value.isNull(), none if path is None else _leaf(path, F.lit(None))).otherwise(F.concat(*parts)) if parts else none
    if isinstance(kind, T.ArrayType):
        at = path if path is not None else F.lit("")
        if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            mark = "[" if style == "path" else ".["
            made = F.transform(value, lambda x, i: entries(x, kind.elementType, F.concat(at, F.lit(mark), i.cast("string"), F.lit("]")), style))
            return F.coalesce(F.flatten(made), none if path is None else _leaf(path, F.lit(None)))
        return F.coalesce(F.transform(value, lambda x: F.struct(at.alias("path"), x.cast("string").alias("value"))).cast(_ENTRY), _leaf(at, F.lit(None)))
    return _leaf(path if path is not None else F.lit("(root)"), value)


def flatten(df: DataFrame, col: str, *keep: str, style: str = "flat") -> DataFrame:
    """One row per leaf: the kept columns, ``path`` and ``value``. Leaves of keys that a row lacks are left out."""
    rows = df.select(*keep, F.explode(entries(F.col(col), df.schema[col].dataType, None, style)).alias("x"))
    return rows.select(*keep, "x.path", "x.value")


def flatten_variant(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """The same for a VARIANT column of any shape, a level at a time: leaves leave, what is nested goes on. A level is
    written once to the shared folder, so each is worked out once; the driver only learns whether it was the last."""
    done: DataFrame | None = None
    here = df.select(*keep, F.lit("").alias("path"), F.col(col).alias("v"))
    kind = F.schema_of_variant("v")
    inner = F.coalesce(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    while True:
        leaves = here.where(~inner).select(*keep, F.when(F.col("path") == "", "(root)").otherwise(F.col("path")).alias("path"), F.col("v").cast("string").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        above = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
        at = F.when(kind.rlike("^ARRAY<.*(OBJECT|ARRAY|VARIANT)"), F.concat("path", F.lit(".["), F.lit("%d"), F.lit("]")))
        of_object = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: F.struct(F.concat(above, e.key).alias("path"), e.value.alias("v")))
        of_list = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(F.coalesce(F.replace(at, F.lit("%d"), i.cast("string")), F.col("path")).alias("path"), x.alias("v")))
        below = here.where(inner).select(*keep, F.explode(F.coalesce(of_object, of_list)).alias("__x"))
        below = settled(below.select(*keep, "__x.path", "__x.v"))
        if below.isEmpty():
            return done
        here = below


_STEP = re.compile(r"([^.\[\]]+)|\[(\*|\d+)\]")


def steps(path: str) -> list[str | int | None]:
    """``a.b[*].c[0]`` as ["a", "b", None, "c", 0]."""
    return [m[1] if m[1] else None if m[2] == "*" else int(m[2]) for m in _STEP.finditer(path)]


def values_at(value: Column, kind: T.DataType, path: Sequence[str | int | None], seen: Column | None = None) -> Column:
    """An array of (path, value) at the path, in document order: nothing for what is missing or null, and nothing where a
    list stands without an index."""
    none = F.array().cast(_ENTRY)
    if not path:
        text = F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType)) else value.cast("string")
        return F.when(value.isNull(), none).otherwise(_leaf(seen if seen is not None else F.lit("(root)"), text))
    step, *rest = path
    if isinstance(step, str):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return none
        return values_at(value.getField(step), kind[step].dataType, rest, _join(seen, step))
    if not isinstance(kind, T.ArrayType):
        return none
    at = seen if seen is not None else F.lit("")
    name = lambda i: F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
    if step is None:
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: values_at(x, kind.elementType, rest, name(i)))), none)
    return values_at(F.get(value, F.lit(step)), kind.elementType, rest, name(F.lit(step)))


def get_path(df: DataFrame, col: str, path: str, *keep: str) -> DataFrame:
    """One row per value at the path: the kept columns, the concrete ``path`` and ``value``."""
    rows = df.select(*keep, F.explode(values_at(F.col(col), df.schema[col].dataType, steps(path))).alias("x"))
    return rows.select(*keep, "x.path", "x.value")


def with_path(value: Column, kind: T.DataType, path: Sequence[str | int | None], new: Column | Callable[[Column], Column]) -> Column:
    """The value with ``new``, or ``new`` of what was there, at the path; unchanged where a parent is missing or an index
    out of range. ``[*]`` changes every item."""
    put = new if callable(new) and not isinstance(new, Column) else lambda _: new
    step, *rest = path
    if isinstance(step, str):
        if not isinstance(kind, T.StructType):
            return value
        if not rest:
            return F.when(value.isNotNull(), value.withField(step, put(value.getField(step)) if step in kind.names else put(F.lit(None))))
        if step not in kind.names:
            return value
        return F.when(value.isNotNull(), value.withField(step, with_path(value.getField(step), kind[step].dataType, rest, new)))
    if not isinstance(kind, T.ArrayType):
        return value
    change = lambda x: with_path(x, kind.elementType, rest, new) if rest else put(x)
    if step is None:
        return F.transform(value, change)
    return F.transform(value, lambda x, i: F.when(i == step, change(x)).otherwise(x))


def set_path(df: DataFrame, col: str, path: str, new: Column) -> DataFrame:
    return df.withColumn(col, with_path(F.col(col), df.schema[col].dataType, steps(path), new))


def pruned(value: Column, kind: T.DataType, skip: frozenset[str] = frozenset(), in_list: bool = False) -> Column:
    """Bottom-up: null for missing values, empty lists and structs of nothing but nulls, which ``to_json`` then leaves
    out. "Not Found" goes as a field but stays as a list member; "" stays; fields in ``skip`` stay as they are."""
    if isinstance(kind, T.StructType):
        parts = [value.getField(f.name).alias(f.name) if f.name in skip else pruned(value.getField(f.name), f.dataType, skip).alias(f.name) for f in kind.fields]
        made = F.struct(*parts)
        empty = F.coalesce(*[F.when(made.getField(f.name).isNotNull(), F.lit(1)) for f in kind.fields]).isNull()
        return F.when(value.isNotNull() & ~empty, made)
    if isinstance(kind, T.ArrayType):
        made = F.filter(F.transform(value, lambda x: pruned(x, kind.elementType, skip, True)), lambda x: x.isNotNull())
        return F.when(F.size(made) > 0, made)
    if isinstance(kind, T.StringType) and not in_list:
        return F.when(value != MISSING, value)
    return value


def prune_nulls(df: DataFrame, col: str, skip: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(col, pruned(F.col(col), df.schema[col].dataType, frozenset(skip)))


#: Fields that say how a quantity is meant, not what it is.
QUANTITY_MARKS = ("quantityKind", "hasQuantityKind", "sameAs", "unit")


def is_empty_quantity(value: Column, kind: T.StructType, field: str = "quantityValue", number: str = "numericValue", marks: Sequence[str] = QUANTITY_MARKS) -> Column:
    """Whether a struct is nothing but marks, or a ``field`` without a ``number`` beside marks. A key that is null counts
    as not there; a struct without any key is not an empty quantity."""
    given = lambda names: F.coalesce(*[F.when(value.getField(n).isNotNull(), True) for n in names], F.lit(False)) if names else F.lit(False)
    some, rest = given(kind.names), given([n for n in kind.names if n not in (*marks, field)])
    filled = F.lit(False)
    if field in kind.names:
        inner = kind[field].dataType
        if not isinstance(inner, T.StructType):
            filled = value.getField(field).isNotNull()
        elif number in inner.names:
            filled = value.getField(field).getField(number).isNotNull()
    return some & ~rest & ~filled


def prune_quantities(df: DataFrame, col: str, field: str = "quantityValue", number: str = "numericValue") -> DataFrame:
    """Every struct with a ``field`` that has no ``number`` becomes null, inside-out; a number 0 stays."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            if field in kind.names and isinstance(kind[field].dataType, T.StructType) and number in kind[field].dataType.names:
                return F.when(value.getField(field).getField(number).isNotNull(), value)
            return F.when(value.isNotNull(), F.struct(*[walk(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.filter(F.transform(value, lambda x: walk(x, kind.elementType)), lambda x: x.isNotNull())
        return value

    return df.withColumn(col, walk(F.col(col), df.schema[col].dataType))


def _json(value: Column, kind: T.DataType | None = None) -> Column:
    """A plain value as JSON text; null stays null. Where ``kind`` says that the text needs no writer, none is asked."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("string")
    text = F.to_json(F.struct(value.alias("v")))
    written = F.when(value.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), written).otherwise(value.cast("string"))
    if isinstance(kind, T.StringType):
        return F.when(value.rlike(r'["\\\x00-\x1f]'), written).otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    return written


def leaves(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """One row per leaf (kept columns, path, value) from which ``rebuild`` gives the record back: every list writes its
    indices, values are JSON text, so that numbers and booleans stay what they are. Empty lists are leaves; null fields are
    left out, null list members are not."""
    kind = "struct<path: string not null, value: string>"
    entry = lambda path, text: F.struct(path.alias("path"), text.alias("value"))
    one = lambda path, text: F.array(entry(path, text))
    deep = lambda t: isinstance(t, (T.StructType, T.ArrayType))

    def leaf(value: Column, kind: T.DataType, path: Column, member: bool) -> Column:
        text = _json(value, kind)
        return entry(path, F.coalesce(text, F.lit("null"))) if member else F.when(value.isNotNull(), entry(path, text))

    def walk(value: Column, t: T.DataType, path: Column | None, member: bool) -> Column:
        """An array of entries, null for fields that are not there. Each part is named once, so it is worked out once."""
        at = path if path is not None else F.lit("(root)")
        missing = one(at, F.lit("null")) if member else F.array().cast(f"array<{kind}>")
        if isinstance(t, T.StructType):
            fields = [(value.getField(f.name), f.dataType, _join(path, f.name)) for f in t.fields]
            parts = [F.array(*[leaf(*f, False) for f in fields if not deep(f[1])])] if any(not deep(f[1]) for f in fields) else []
            parts += [walk(*f, False) for f in fields if deep(f[1])]
            empty = reduce(lambda a, b: a & b, [f[0].isNull() for f in fields], F.lit(True))
            return F.when(value.isNull(), missing).when(empty, one(at, F.lit("{}"))).otherwise(F.concat(*parts) if parts else missing)
        if isinstance(t, T.ArrayType):
            place = lambda i: F.concat(path if path is not None else F.lit(""), F.lit("["), i.cast("string"), F.lit("]"))
            each = (lambda x, i: walk(x, t.elementType, place(i), True)) if deep(t.elementType) else (lambda x, i: leaf(x, t.elementType, place(i), True))
            parts = F.transform(value, each)
            return F.when(value.isNull(), missing).when(F.size(value) == 0, one(at, F.lit("[]"))).otherwise(F.flatten(parts) if deep(t.elementType) else parts)
        return F.array(leaf(value, t, at, member))

    rows = df.select(*keep, F.explode(walk(F.col(col), df.schema[col].dataType, None, False)).alias("x")).where("x is not null")
    return rows.select(*keep, "x.path", "x.value")


_SHAPES = 200_000  # paths of records' shapes that a task remembers at most


def _shape(paths: Sequence[str]) -> tuple[str, list[int]]:
    """A format for the JSON text of a record with these paths, and the places of the leaves that fill it."""
    tree: tuple[list[int], dict] = ([], {})
    for k, path in enumerate(paths):
        node = tree
        for step in () if path == "(root)" else path.split("."):
            node = node[1].setdefault(step, ([], {}))
        node[0].append(k)

    def index(step: str) -> int:
        return i if (m := re.fullmatch(r"\[([0-9]+)\]", step)) and (i := int(m[1])) < 1 << 63 else -1

    out, order, todo = [], [], [tree]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part.replace("%", "%%"))
        elif not part[1]:
            order += part[0]
            values = ",".join("%s" for _ in part[0])
            out.append(values if len(part[0]) == 1 else f"[{values}]")
        else:
            steps = sorted((index(step), step) for step in part[1])  # keys come before indices
            listed = steps[0][0] >= 0
            todo.append("]" if listed else "}")
            for n, (_, step) in reversed(list(enumerate(steps))):
                todo += [part[1][step], ("," if n else "") + ("" if listed else f"{json.dumps(step, ensure_ascii=False)}:")]
            todo.append("[" if listed else "{")
    return "".join(out), order


def _assembled(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records' texts from leaves (by.., path, text, first) that come record by record. Shapes come again and are remembered."""
    shapes: dict[tuple[str, ...], tuple[str, list[int]]] = {}
    held = 0

    def record(paths: Sequence[str], texts: Sequence[str]) -> str:
        nonlocal held
        shape = shapes.get(key := tuple(paths))
        if shape is None:
            shape = _shape(key)
            if held > _SHAPES:
                shapes.clear()
                held = 0
            if len(key) <= 1000:
                shapes[key], held = shape, held + len(key)
        return shape[0] % tuple([texts[k] for k in shape[1]])

    key, paths, texts = None, [], []
    for batch in given:
        p, t, at = batch.column("path").to_pylist(), batch.column("text").to_pylist(), np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False)).tolist()
        by = pa.Table.from_batches([batch]).select([n for n in batch.schema.names if n not in ("path", "text", "first")])
        end = at[0] if at else len(p)
        paths += p[:end]
        texts += t[:end]
        if not at:
            continue
        made = [record(p[a:b], t[a:b]) for a, b in zip(at, at[1:], strict=False)]
        keys = by.take(pa.array(at[:-1], pa.int64()))
        if key is not None:
            made, keys = [record(paths, texts), *made], pa.concat_tables([key, keys])
        yield from keys.append_column("text", pa.array(made, pa.string())).combine_chunks().to_batches()
        key, paths, texts = by.take(pa.array(at[-1:], pa.int64())), p[at[-1] :], t[at[-1] :]
    if key is not None:
        yield from key.append_column("text", pa.array([record(paths, texts)], pa.string())).combine_chunks().to_batches()


def rebuild(leaves: DataFrame, *by: str, texts: bool = False) -> DataFrame:
    """From leaves (by.., path, value) the records as VARIANT ``record``. Steps are keys and list indices, ``a.b[0]`` or
    ``a.b.[0]``; a list is made of the indices that there are, in order, and
    a path that comes more than once is a list of its values (by ``nth`` where the leaves have it). Values are JSON text, or,
    with ``texts``, plain texts. Null values are left out. Where a path is both a leaf and has leaves below, those below
    count. Keys must not hold dots or brackets. Rows meet once, by record, and are sorted; a record's text is then put
    together from its leaves, in memory for one record at a time."""
    value = _json(F.col("value"), T.StringType()) if texts else F.col("value")
    order = F.col("nth").cast("long") if "nth" in leaves.columns else F.lit(0).cast("long")
    path = F.ltrim(F.regexp_replace("path", r"\.?\[(\d+)\]", r".[$1]"), F.lit("."))
    plain = F.when(F.contains(F.col("path"), F.lit("[")) | F.startswith(F.col("path"), F.lit(".")), path).otherwise(F.col("path"))
    rows = leaves.where(F.col("value").isNotNull()).select(*[F.col(c).alias(f"by{n}") for n, c in enumerate(by)], plain.alias("path"), order.alias("nth"), value.alias("text"))
    keys = [f"by{n}" for n in range(len(by))]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "nth", "text")) == 1
    sorted_ = rows.withColumn("first", first).select(*keys, "path", "text", "first")
    made = sorted_.mapInArrow(_assembled, T.StructType([*(sorted_.schema[k] for k in keys), T.StructField("text", T.StringType())]))
    return made.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.try_parse_json("text").alias("record"))


def zipped(df: DataFrame, col: str, paths: Sequence[str], *keep: str) -> DataFrame:
    """Rows whose paths give exactly one value each, as an array ``values``."""
    kind = df.schema[col].dataType
    found = F.concat(*[F.transform(values_at(F.col(col), kind, steps(p)), lambda x: x.value) for p in paths])
    return df.select(*keep, found.alias("values")).where(F.size("values") == len(paths))


def is_object(v: Column) -> Column:
    """Whether a VARIANT is an object, without looking at what is in it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def items(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """The objects of a VARIANT column: a list's objects, or the one object; nothing else."""
    v = F.col(col)
    each = F.when(is_object(v), F.array(v)).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    return df.select(*keep, F.explode(each).alias("item")).where(is_object(F.col("item")))


def field_value(v: Column) -> Column:
    """Of a VARIANT field, plain or {value, sameAs}: its text."""
    plain = F.when(~is_object(v), F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.try_variant_get(v, "$.value", "string"), plain)


def field_ids(v: Column, pattern: str = "([^/]+)$") -> Column:
    """Of such a field: the ids in its ``sameAs``, one URI or a list of them."""
    uris = F.coalesce(F.try_variant_get(v, "$.sameAs", "array<string>"), F.filter(F.array(F.try_variant_get(v, "$.sameAs", "string")), lambda x: x.isNotNull()))
    found = F.transform(F.coalesce(uris, F.array().cast("array<string>")), lambda x: F.regexp_extract(x, pattern, 1))
    return F.filter(found, lambda x: x != "")


def entity_list(v: Column) -> Column:
    """A VARIANT list as an array of (text, item): texts as they are, objects with their ``text``, anything else by its
    text; [] for what is no list."""
    members = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x: F.when(is_object(x), F.try_variant_get(x, "$.text", "string")).otherwise(F.try_variant_get(x, "$", "string"))
    return F.transform(members, lambda x: F.struct(text(x).alias("text"), x.alias("item")))


def numbered_items(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """One row per item of an array, with its number from 1."""
    rows = df.select(*keep, F.posexplode(items).alias("n", "item"))
    return rows.select(*keep, (F.col("n") + 1).alias("n"), "item")
