"""Flat, linked tables from deeply nested JSON bodies.

The JSON reader of Spark turns each body into nested lists of (name, value)
entries, whatever layout the body has. Arrow kernels then flatten these lists:
offsets and parent indices of the list arrays place the children, and the keys
of all parents are propagated by ``take``; no row is parsed or looped over in
Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.plans.session import stage

ENTRIES = "record_id bigint, entity string, name string, ord int, sub_ord int, value string"
_SECTIONS = "methods string, attack_family string, magnitude string, video string, record string, results string, payload string"


def _text(c: Column) -> Column:
    """The JSON value ``c`` as text: strings decoded, everything else as written; null unless ``c`` is one complete value."""
    probe = F.from_json(F.concat(F.lit('{"x":'), c, F.lit(',"complete":1}')), "x string, complete int, bad string", {"columnNameOfCorruptRecord": "bad"})
    return F.when(probe["bad"].isNull() & (probe["complete"] == 1), probe["x"])


def _elements(c: Column) -> Column:
    """JSON text as an array of JSON texts: lists by element, a lone object as one element, anything else as none."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.startswith("{"), F.array(c)).otherwise(F.array().cast("array<string>"))


def _members(c: Column, *names: str) -> Column:
    """(name, value) entries of a JSON object, or of a list of objects that carry their name in a field."""
    entry = "struct<name string, value string>"
    by_key = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    fields = ", ".join(f"`{n}` string" for n in names)
    listed = F.transform(F.from_json(c, "array<string>"), lambda v: F.struct(F.coalesce(*[F.from_json(v, fields)[n] for n in names]).alias("name"), v.alias("value")))
    found = F.when(c.startswith("{"), by_key).when(c.startswith("["), listed)
    return F.coalesce(found.cast(f"array<{entry}>"), F.array().cast(f"array<{entry}>"))


def _magnitudes(members: Column) -> Column:
    def rows(value: Column) -> Column:
        found = _elements(F.coalesce(F.from_json(value, "rows string")["rows"], F.lit("")))
        return F.transform(found, lambda r: F.struct(r.alias("value"), _elements(F.coalesce(F.from_json(r, "trials string")["trials"], F.lit(""))).alias("trials")))

    return F.transform(members, lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value"), rows(m["value"]).alias("rows")))


def sections(records: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """(record_id, methods, attacks, magnitudes): the sections of each record as nested lists.

    Repeats of a key count once, with a complete body where there is one. Bodies may carry a byte order mark, be encoded
    as a JSON string, or wrap the sections in ``record``, ``payload`` or the
    elements of ``results``; ``magnitude`` may stand at the top or in ``video``.
    Null, blank and incomplete bodies, and null keys, give no row.
    """
    raw = records.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(F.col(key).cast("bigint").alias("record_id"), F.col(body).alias("body"))
    trimmed = F.regexp_replace("body", r"^[\s\x{feff}]+|\s+$", "")
    root = raw.select("record_id", _text(trimmed).alias("doc")).where(F.col("doc").isNotNull())
    # A body that is a JSON string holds the record as text.
    root = root.select("record_id", F.when(F.col("doc").startswith("{") | F.col("doc").startswith("["), _text(F.col("doc"))).alias("doc"))
    # Only complete bodies count among the repeats of a key.
    root = root.where(F.col("doc").isNotNull()).groupBy("record_id").agg(F.max("doc").alias("doc"))
    for _ in range(2):  # wrappers, at most two deep
        parts = F.from_json("doc", _SECTIONS)
        inner = F.concat(F.array("doc"), _elements(F.coalesce(parts["record"], F.lit(""))), _elements(F.coalesce(parts["results"], F.lit(""))), _elements(F.coalesce(parts["payload"], F.lit(""))))
        root = root.select("record_id", F.explode(F.array_distinct(inner)).alias("doc")).where(F.col("doc").startswith("{"))
    root = root.distinct().select("record_id", F.from_json("doc", _SECTIONS).alias("s"))
    text = lambda c: F.coalesce(c, F.lit(""))
    in_video = F.from_json("s.video", "magnitude string")["magnitude"]
    mags = F.concat(_members(text(F.col("s.magnitude")), "method", "name"), _members(text(in_video), "method", "name"))
    return root.select(
        "record_id",
        _members(text(F.col("s.methods")), "name", "method").alias("methods"),
        _members(text(F.col("s.attack_family")), "attack", "name").alias("attacks"),
        _magnitudes(mags).alias("magnitudes"),
    )


def _children(values: pa.Array, parents: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The flattened children of a list array, the parent key of each, and its position in its list."""
    owner = pc.list_parent_indices(values)
    starts = values.offsets.slice(0, len(values))
    base = values.offsets[0]
    place = pc.subtract(pc.add(pa.array(np.arange(len(owner), dtype=np.int32)), base), starts.take(owner))
    return values.flatten(), parents.take(owner), pc.cast(place, pa.int32())


def _emit(entity: str, key: pa.Array, name: pa.Array, ord_: pa.Array | None, sub: pa.Array | None, value: pa.Array) -> pa.RecordBatch:
    none = pa.array(np.full(len(key), -1, dtype=np.int32))
    kind = pa.array([entity]).take(pa.array(np.zeros(len(key), dtype=np.int64)))
    batch = pa.RecordBatch.from_arrays([key, kind, name, none if ord_ is None else ord_, none if sub is None else sub, value], ["record_id", "entity", "name", "ord", "sub_ord", "value"])
    return batch.filter(value.is_valid())


def flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of all levels of the nested lists of ``sections``."""
    for batch in batches:
        key = batch.column("record_id")
        for entity, column in (("method", "methods"), ("attack", "attacks")):
            entries, owner, _ = _children(batch.column(column), key)
            yield _emit(entity, owner, entries.field("name"), None, None, entries.field("value"))
        mags, owner, _ = _children(batch.column("magnitudes"), key)
        name = mags.field("name")
        yield _emit("magnitude", owner, name, None, None, mags.field("value"))
        at = pa.array(np.arange(len(mags)))  # rows of the level above, to take its keys by
        rows, up, ord_ = _children(mags.field("rows"), at)
        row_key, row_name = owner.take(up), name.take(up)
        yield _emit("row", row_key, row_name, ord_, None, rows.field("value"))
        trials, up, sub = _children(rows.field("trials"), pa.array(np.arange(len(rows))))
        yield _emit("trial", row_key.take(up), row_name.take(up), ord_.take(up), sub, trials)


def entries(records: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """All non-null objects and entries: (record_id, entity, name, ord, sub_ord, value), value being the JSON text.

    entity is method, attack, magnitude, row or trial; ord and sub_ord count null
    elements and are -1 where they have no meaning. An entry that two wrappers of
    a body repeat comes once, an empty table gives an empty one.
    """
    found = sections(records, key, body).mapInArrow(flatten_batches, ENTRIES)
    keys = ["record_id", "entity", "name", "ord", "sub_ord"]
    return found.groupBy(*keys).agg(F.max("value").alias("value"))


def flat_tables(records: DataFrame, key: str = "record_id", body: str = "body") -> dict[str, DataFrame]:
    """The tables methods, attacks, magnitudes, rows and trials, each with the keys of its parents.

    Numbers given as text (``>2.0``, ``12s``) stay null in the numeric columns
    unless they are plain numbers; the text columns keep what was written. An
    interval is read from a list or from an object with lo and hi.
    """
    e = stage(entries(records, key, body), "entries")  # parsed once for all five tables
    num = lambda c: F.expr(f"try_cast({c} as double)")

    def of(entity: str, schema: str, *extra: str) -> DataFrame:
        return e.where(F.col("entity") == entity).select("record_id", "name", *extra, F.from_json("value", schema).alias("v"))

    m = of("method", "chance string, reid_top1 string, reid_ci string, lpips string, train_seconds string")
    ci_list, ci_obj = F.from_json("v.reid_ci", "array<string>"), F.from_json("v.reid_ci", "lo string, hi string")
    m = m.withColumns({"lo": F.when(F.col("v.reid_ci").startswith("["), F.get(ci_list, 0)).otherwise(ci_obj["lo"]), "hi": F.when(F.col("v.reid_ci").startswith("["), F.get(ci_list, 1)).otherwise(ci_obj["hi"])})
    return {
        "methods": m.select("record_id", F.col("name").alias("method"), num("v.chance").alias("chance"), num("v.reid_top1").alias("reid_top1"), num("lo").alias("reid_ci_lo"), num("hi").alias("reid_ci_hi"), num("v.lpips").alias("lpips"), F.col("v.train_seconds").alias("train_seconds")),
        "attacks": e.where(F.col("entity") == "attack").select("record_id", F.col("name").alias("attack"), F.when(F.col("value").startswith("{"), F.from_json("value", "family string")["family"]).otherwise(F.col("value")).alias("family")),
        "magnitudes": of("magnitude", "speed_median string, crop_keep_median string").select("record_id", F.col("name").alias("method"), F.col("v.speed_median").alias("speed_median_text"), num("v.speed_median").alias("speed_median"), num("v.crop_keep_median").alias("crop_keep_median")),
        "rows": of("row", "clip string, crop_keep string, speed string", "ord").select("record_id", F.col("name").alias("method"), "ord", F.col("v.clip").alias("clip"), num("v.crop_keep").alias("crop_keep"), F.col("v.speed").alias("speed_text"), num("v.speed").alias("speed")),
        "trials": of("trial", "speed string, hit string", "ord", "sub_ord").select("record_id", F.col("name").alias("method"), "ord", "sub_ord", num("v.speed").alias("speed"), (F.col("v.hit") == "true").alias("hit")),
    }
