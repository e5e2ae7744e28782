"""Schemas that drift between files, by tagged-union inference.

The schema of a file is a set of (field, spelling, type) facts. Sets unite without conflict, so schemas
of lines, partitions and files fuse in any order by ordinary aggregation and every alternative type of a
path is kept. A path with several types is split into one typed branch for each, beside a canonical
conversion to text; alternatives that appear or vanish from file to file are reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.operators import jsontext
from braidframe.operators.ordered import neighbour
from braidframe.session import bounded_rows, ship, spread

#: The alias table is read as a control table of at most so many rows.
MOST_ALIASES = 100_000
#: Files of one producer are ordered in buckets of so many sequence numbers.
FILES_A_BUCKET = 4096
#: Separates keys in a canonical path; it cannot occur in a JSON key that was written unescaped.
_SEP = "\x00"
#: Which objects have keys that are fields too: None for all of them, else the canonical key paths that lead to them.
Nested = Sequence[tuple[str, ...]] | None

BRANCHES = {"string": "string", "whole": "decimal(38,0)", "fraction": "double", "boolean": "boolean", "object": "string", "array": "string"}


def alias_map(aliases: DataFrame) -> dict[str, str]:
    """alias -> field; rows with a null are ignored, of several fields for one alias the least counts."""
    rows = aliases.where(F.col("alias").isNotNull() & F.col("field").isNotNull()).groupBy("alias").agg(F.min("field").alias("field"))
    return {r["alias"]: r["field"] for r in bounded_rows(rows, MOST_ALIASES, "field_aliases")}


def _fields(record: dict, names: dict[str, str], nested: Nested) -> Iterator[tuple[tuple[str, ...], tuple[str, ...], object]]:
    """(canonical keys, spelled keys, value) of each field with a non-null value."""
    todo: list[tuple[tuple, tuple, dict]] = [((), (), record)]
    while todo:
        canon, spelled, box = todo.pop()
        for key, value in box.items():
            if value is None:
                continue
            c, s = (*canon, names.get(key, key)), (*spelled, key)
            yield c, s, value
            if type(value) is dict and (nested is None or c in nested):
                todo.append((c, s, value))


def _record(text: str | None) -> dict | None:
    try:
        value = jsontext.read(text)
    except ValueError:
        return None
    return value if type(value) is dict else None


def file_facts(raw: DataFrame, names: dict[str, str], nested: Nested = None) -> DataFrame:
    """Distinct (file_id, field, spelled, kind) of all lines; ``field`` is the canonical path.

    Lines that are null or no JSON object have no facts, null values neither. Facts repeat from line to
    line, so each batch gives its distinct ones and they are united before they are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts: dict[tuple, None] = {}
            for file_id, text in zip(batch.column("file_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                record = _record(text)
                if record is not None:
                    for c, s, v in _fields(record, names, nested):
                        facts[(file_id, c, s, jsontext.kind(v))] = None
            if facts:
                ids, cs, ss, ks = zip(*facts, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([jsontext.clean(_SEP.join(c)) for c in cs]), pa.array([jsontext.clean(".".join(s)) for s in ss]), pa.array(ks)],
                    names=["file_id", "field", "spelled", "kind"],
                )

    ship(raw.sparkSession)
    rows = raw.where(F.col("record").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "record")
    return spread(rows, "record", source=raw).mapInArrow(run, "file_id bigint, field string, spelled string, kind string").distinct()


def file_schemas(facts: DataFrame) -> DataFrame:
    """One row per file and field: its spellings and its types, each sorted."""
    return facts.groupBy("file_id", "field").agg(F.array_sort(F.collect_set("spelled")).alias("spellings"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def predecessors(raw: DataFrame) -> DataFrame:
    """(file_id, previous_id): the same producer's previous file by ``file_seq``, null for its first.

    A file counts with all its rows, also where no line is a JSON object. Files without a number come
    first; equal numbers are ordered by id; files without producer follow one another. A producer of
    any size is ordered in buckets of sequence numbers.
    """
    files = raw.groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(F.min("producer").alias("producer"), F.min("file_seq").alias("file_seq"))
    files = files.where(F.col("file_id").isNotNull()).withColumn("file_seq", F.coalesce(F.col("file_seq").cast("bigint"), F.lit(-(2**62))))
    seen = neighbour(files, ["producer"], F.floor(F.col("file_seq") / FILES_A_BUCKET), ["file_seq", "file_id"], F.col("file_id"), "previous_id")
    return seen.select("file_id", "previous_id")


def changes(raw: DataFrame, names: dict[str, str], nested: Nested = None) -> DataFrame:
    """Every change of a field between a producer's consecutive files.

    Columns file_id, change, old_path, new_path, old_kinds, new_kinds. ``added``, ``removed``,
    ``renamed`` (spelled differently) and ``retyped`` (another set of types); a field can be renamed
    and retyped at once. Of a field that one file spells in several ways, each spelling is added or
    removed; the spellings that the other file lacks are paired in sorted order (the first stands in
    where one side has none), and a change of type names the first.
    """
    pairs = predecessors(raw).where(F.col("previous_id").isNotNull())
    schemas = file_schemas(file_facts(raw, names, nested))
    side = F.struct("spellings", "kinds")
    none = F.lit(None).cast("struct<spellings:array<string>,kinds:array<string>>")
    new = schemas.join(pairs, "file_id").select("file_id", "field", none.alias("old"), side.alias("new"))
    old = schemas.withColumnRenamed("file_id", "previous_id").join(pairs, "previous_id").select("file_id", "field", side.alias("old"), none.alias("new"))
    both = new.unionByName(old).groupBy("file_id", "field").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    gone, come = F.array_except("old.spellings", "new.spellings"), F.array_except("new.spellings", "old.spellings")
    first = lambda side: F.element_at(F.col(f"{side}.spellings"), 1)
    row = lambda change, o, n: F.struct(F.lit(change).alias("change"), o.alias("old_path"), n.alias("new_path"))
    one = lambda when, change, o, n: F.when(when, F.array(row(change, o, n)))
    in_both = F.col("old").isNotNull() & F.col("new").isNotNull()
    empty = F.lit("")
    renamed = F.when(
        in_both & (F.col("old.spellings") != F.col("new.spellings")),
        F.transform(F.arrays_zip(gone.alias("o"), come.alias("n")), lambda x: row("renamed", F.coalesce(x["o"], first("old")), F.coalesce(x["n"], first("new")))),
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("old").isNull(), F.transform("new.spellings", lambda x: row("added", empty, x))),
            F.when(F.col("new").isNull(), F.transform("old.spellings", lambda x: row("removed", x, empty))),
            renamed,
            one(in_both & (F.col("old.kinds") != F.col("new.kinds")), "retyped", first("old"), first("new")),
        )
    )
    listed = both.select("file_id", F.col("old.kinds").alias("old_kinds"), F.col("new.kinds").alias("new_kinds"), F.explode(F.flatten(found)).alias("c"))
    return listed.select("file_id", "c.change", "c.old_path", "c.new_path", "old_kinds", "new_kinds").distinct()


def fused_schema(raw: DataFrame, names: dict[str, str], nested: Nested = None) -> DataFrame:
    """One row per field over all files: its alternatives, its spellings and in how many files it occurs."""
    per_file = file_schemas(file_facts(raw, names, nested))
    kinds = per_file.groupBy("field").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spellings")))).alias("spellings"))
    return kinds.select(F.translate("field", _SEP, ".").alias("field"), "n_files", "kinds", "spellings")


_IDS = ["raw_id", "file_id", "producer", "file_seq", "line_no"]


def values(raw: DataFrame, names: dict[str, str], nested: Nested = None) -> DataFrame:
    """All entries in long form, exact whatever the number of fields: the ids and one row per spelled field.

    ``path`` is canonical, ``spelled`` as in the line; ``kind`` tags which of the typed branches
    ``as_string``, ``as_whole``, ``as_fraction``, ``as_boolean`` and ``as_json`` holds the value; ``value``
    is its canonical text. Whole numbers beyond 38 digits are in ``value`` only. Repeated rows count
    once; null values and lines that are no JSON object give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, text in enumerate(batch.column("record").to_pylist()):
                for c, s, v in _fields(_record(text) or {}, names, nested):
                    keep.append(i)
                    found.append((jsontext.clean(".".join(c)), jsontext.clean(".".join(s)), jsontext.kind(v), _text(v)))
            if keep:
                take = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in _IDS), *(pa.array(x) for x in zip(*found, strict=True))], names=[*_IDS, "path", "spelled", "kind", "value"])

    ship(raw.sparkSession)
    rows = raw.where(F.col("record").isNotNull()).select(*_IDS, "record").distinct()
    text = [T.StructField(n, T.StringType()) for n in ("path", "spelled", "kind", "value")]
    long = rows.mapInArrow(run, T.StructType([*(raw.schema[n] for n in _IDS), *text]))
    branch = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("value"))
    return long.select(
        "*",
        branch("string").alias("as_string"),
        branch("whole").try_cast("decimal(38,0)").alias("as_whole"),
        branch("fraction").try_cast("double").alias("as_fraction"),
        branch("boolean").try_cast("boolean").alias("as_boolean"),
        branch("object", "array").alias("as_json"),
    )


def _text(value: object) -> str:
    """Canonical conversion to text: compact JSON with sorted keys for objects and arrays, numbers as they are spelled."""
    return jsontext.dump(value) if jsontext.kind(value) in ("object", "array", "boolean") else jsontext.clean(str(value))


def entries(raw: DataFrame, names: dict[str, str], fields: dict[str, list[str]], nested: Nested = None) -> DataFrame:
    """All JSON-object lines as one table.

    ``fields`` maps each canonical path to its alternatives (from :func:`fused_schema`). A path becomes
    the column ``path`` (dots as ``__``) with the canonical conversion to text and, where it has several
    alternatives, one typed column ``path__kind`` for each, filled where the line has that type. Keys
    without a column stay in the map ``rest`` (:func:`values` has their types). Objects and arrays are
    compact JSON with sorted keys. Repeated rows count once; of two spellings of one field in a line the
    first non-null is taken and the other is in ``rest`` under its spelling.
    """
    wanted = set(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for i, text in enumerate(batch.column("record").to_pylist()):
                record = _record(text)
                if record is None:
                    continue
                line: dict[str, dict] = {}
                for c, s, v in _fields(record, names, nested):
                    path = jsontext.clean(".".join(c))
                    k = jsontext.kind(v)
                    if path in line:  # a second spelling in one line
                        path = jsontext.clean(".".join(s))
                    line.setdefault(path, {"kind": k, "text": _text(v)})
                keep.append(i)
                values.append(list(line.items()))
            if keep:
                take = pa.array(keep, pa.int64())
                kind = pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in ids), pa.array(values, kind)], names=[*ids, "f"])

    ids = _IDS
    ship(raw.sparkSession)
    rows = raw.where(F.col("record").isNotNull()).select(*ids, "record").distinct()
    schema = T.StructType([*(raw.schema[n] for n in ids), T.StructField("f", T.MapType(T.StringType(), T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))])
    read = rows.mapInArrow(run, schema)
    columns: list[Column] = []
    for path in sorted(fields):
        value, name = F.try_element_at("f", F.lit(path)), path.replace(".", "__")
        columns.append(value["text"].alias(name))
        if len(fields[path]) > 1:
            columns += [F.when(value["kind"] == k, value["text"]).try_cast(BRANCHES[k]).alias(f"{name}__{k}") for k in sorted(fields[path])]
    rest = F.map_filter("f", lambda k, _: ~k.isin(*wanted)) if wanted else F.col("f")
    return read.select(*ids, *columns, F.transform_values(rest, lambda _, v: v["text"]).alias("rest"))
