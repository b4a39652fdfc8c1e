"""Options that drift from file to file: one consistent table and a report of each change.

The options of all holders are fused by tagged-union inference: a path keeps
every type it was seen with (its alternatives), a value goes into the branch
of its own type, and beside the branches stands one canonical value. Files are
compared by fusing each with its predecessor: a path that only one of them has
came or went, one with two alternatives was retyped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.nested import NUMBER, allow_duplicate_keys
from seqloom.session import stored

BRANCHES = ("boolean", "number", "string", "array", "object")


def _tag(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _json(holder: str) -> Column:
    return F.from_json(F.col(holder), "variant", {"allowSingleQuotes": "false"})


def entries(holders: Sequence[str], named: Sequence[str] = ()) -> Column:
    """The options of a file as an array of (name, tag, value): the JSON type and the canonical JSON text.

    ``holders`` are columns with JSON objects; each column in ``named`` holds
    the value of the one option it is named after. Where an option sits in
    several holders the values agree, and the first is kept. Holders that are
    null or no JSON object give nothing.
    """
    none = F.array().cast("array<struct<name:string,tag:string,value:string>>")
    one = lambda name, v: F.struct(name.alias("name"), _tag(v).alias("tag"), F.to_json(v).alias("value"))
    parts = []
    for h in holders:
        each = F.map_entries(F.try_variant_get(_json(h), "$", "map<string,variant>"))
        parts.append(F.coalesce(F.transform(each, lambda e: one(e["key"], F.coalesce(e["value"], F.parse_json(F.lit("null"))))), none))
    for h in named:
        v = _json(h)
        parts.append(F.when(v.isNotNull(), F.array(one(F.lit(h), v))).otherwise(none))
    return F.concat(none, *parts)


def _once(opts: Column) -> Column:
    """Of the entries with the same name the first."""
    names = F.transform(opts, lambda o: o["name"])
    first = F.filter(opts, lambda o, i: F.array_position(names, o["name"]) == i + 1)
    return F.when(F.size(F.array_distinct(names)) < F.size(opts), first).otherwise(opts)


def with_entries(files: DataFrame, holders: Sequence[str], named: Sequence[str], *keep: Column | str) -> DataFrame:
    """``keep`` and ``opts``, the file's ``entries``, each name once; the holders are parsed once."""
    allow_duplicate_keys(files)
    all_ = files.select(*keep, F.explode(F.array(F.struct(entries(holders, named).alias("all")))).alias("_e"))
    return all_.select("*", _once(F.col("_e.all")).alias("opts")).drop("_e")


def options(files: DataFrame, key: str, holders: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """One row for each option of each file: key, name, tag (its JSON type), value (canonical JSON text)."""
    return with_entries(files, holders, named, key).select(key, F.inline("opts"))


def paths(opts: DataFrame) -> DataFrame:
    """``opts`` with ``path`` and the tag of each value however deep it lies: ``name``, ``name.key`` and ``name[]`` for elements.

    A deeper level is looked for as long as any value has one; a check of
    that runs one job a level.
    """
    keep = [c for c in opts.columns if c not in ("name", "tag", "value")]
    level = opts.select(*keep, F.col("name").alias("path"), "tag", "value")
    out = level
    while True:
        v = F.try_parse_json("value")
        inner = F.when(
            F.col("tag") == "object",
            F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("p"), e["value"].alias("v"))),
        ).when(F.col("tag") == "array", F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(F.lit("[]").alias("p"), e.alias("v"))))
        below = level.where("tag in ('object', 'array')").select(*keep, "path", F.explode(inner).alias("_e"))
        value = F.coalesce("_e.v", F.parse_json(F.lit("null")))
        level = below.select(*keep, F.concat("path", "_e.p").alias("path"), _tag(value).alias("tag"), F.to_json(value).alias("value"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def alternatives(files: DataFrame, key: str, series: str, order: str, holders: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """The tagged union of each path of each series: each type that it was seen with, in how many files, and the first of these.

    Result: series, path, tag, n_files, first_file (the key of the file
    with the least order number) and appeared: whether the path had been
    seen with another type before, so that this is a new alternative.
    """
    there = files.where(F.col(series).isNotNull() & F.col(order).isNotNull())
    opts = with_entries(there, holders, named, key, series, order).select(key, series, order, F.inline("opts"))
    seen = paths(opts).groupBy(series, "path", "tag").agg(F.countDistinct(key).alias("n_files"), F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).alias("first"))
    begun = F.min("first.o").over(Window.partitionBy(series, "path"))
    return seen.select(series, "path", "tag", "n_files", F.col("first.k").alias("first_file"), (F.col("first.o") > begun).alias("appeared"))


def fused_schema(opts: DataFrame, name: str = "name") -> DataFrame:
    """The tagged union of each name or path: the types it was seen with, each with its number of values."""
    return opts.groupBy(name).agg(
        *[F.count(F.when(F.col("tag") == t, 1)).alias(f"n_{t}") for t in (*BRANCHES, "null")],
        F.count("*").alias("n_values"),
    )


def branched(opts: DataFrame) -> DataFrame:
    """Each value in the branch of its type, and as a canonical number where it is one or the text of one.

    Result: the columns of ``options`` but ``value``, and as_boolean,
    as_number, as_string, as_array and as_object (the latter two JSON text),
    canonical (the value as text without a string's quotes) and
    canonical_number.
    """
    text = F.when(F.col("tag") == "string", F.try_variant_get(F.try_parse_json("value"), "$", "string")).otherwise(F.col("value"))
    out = opts.withColumn("canonical", F.when(F.col("tag") != "null", text))
    low = F.lower(F.trim("canonical"))
    number = F.when((F.col("tag").isin("number", "string")) & F.col("canonical").rlike(NUMBER), F.col("canonical").try_cast("double"))
    return out.select(
        *[c for c in opts.columns if c != "value"],
        F.when(F.col("tag") == "boolean", low == "true").alias("as_boolean"),
        F.when(F.col("tag") == "number", F.col("canonical").try_cast("double")).alias("as_number"),
        F.when(F.col("tag") == "string", F.col("canonical")).alias("as_string"),
        F.when(F.col("tag") == "array", F.col("canonical")).alias("as_array"),
        F.when(F.col("tag") == "object", F.col("canonical")).alias("as_object"),
        "canonical",
        number.alias("canonical_number"),
    )


def previous_file(files: DataFrame, key: str, series: str, order: str, block: int = 4096) -> DataFrame:
    """Key and predecessor's key of each file that has one in its series.

    A series may hold a third of all files, so it is cut into blocks of
    ``block`` order numbers: a window runs within each block, and another one
    over one row a block finds the predecessor of each block's first file.
    """
    f = files.select(F.col(series).alias("_s"), F.col(order).alias("_o"), F.col(key).alias("_k")).withColumn("_b", F.floor(F.col("_o") / block))
    at = F.struct("_o", "_k")
    within = f.withColumn("_p", F.lag("_k").over(Window.partitionBy("_s", "_b").orderBy("_o", "_k")))
    blocks = f.groupBy("_s", "_b").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    heads = blocks.select(F.col("_first._k").alias("_k"), F.lag("_last._k").over(Window.partitionBy("_s").orderBy("_b")).alias("_p"))
    out = within.select("_k", "_p").where("_p is not null").unionByName(heads.where("_p is not null"))
    return out.select(F.col("_k").alias(key), F.col("_p").alias("previous"))


def _fused(early: str, late: str) -> tuple[Column, Column, Column]:
    """Two files' options fused: those that only the early, only the late one has, and the names with two alternatives."""
    name = lambda o: o["name"]
    typed = lambda o: F.concat(o["tag"], F.lit("/"), o["name"])
    only = lambda a, b: F.array_except(F.transform(a, name), F.transform(b, name))
    some = lambda a, names: F.when(F.size(names) == 0, F.filter(a, lambda o: F.lit(False))).otherwise(F.filter(a, lambda o: F.array_contains(names, o["name"])))
    full = lambda a: F.filter(a, lambda o: o["tag"] != "null")
    other = F.array_except(F.transform(full(late), typed), F.transform(full(early), typed))
    names = F.transform(full(early), name)
    back = F.transform(other, lambda t: F.substr(t, F.instr(t, "/") + 1))
    retyped = F.when(F.size(other) > 0, F.array_intersect(back, names)).otherwise(F.array().cast("array<string>"))
    return some(early, only(early, late)), some(late, only(late, early)), retyped


def changes(pairs: DataFrame, key: str) -> DataFrame:
    """What each file added, removed, renamed or retyped against its predecessor.

    ``pairs`` has key, ``opts`` and ``previous``: arrays of (name, tag, h),
    the latter being a hash of the value. Result: key, old_name,
    new_name, change. Where several names that went and several that came
    share one value, they are paired in the order of their names and the rest
    count as removed and added; a null value pairs with none.
    """
    gone, come, retyped = _fused("previous", "opts")
    fused = F.struct(F.sort_array(gone).alias("gone"), F.sort_array(come).alias("come"), retyped.alias("retyped"))
    # the explode of a single entry keeps the optimizer from computing the fused files again for each mention
    p = pairs.select(key, F.explode(F.array(fused)).alias("_f")).select(key, "_f.*")
    p = p.where((F.size("gone") > 0) | (F.size("come") > 0) | (F.size("retyped") > 0))
    same = lambda x, y: (x["h"] == y["h"]) & (x["tag"] == y["tag"]) & (x["tag"] != "null")

    def partner(o: Column, own: str, others: str) -> Column:
        """The name on the other side that is as far on among those of this value."""
        before = F.size(F.filter(own, lambda x: same(x, o) & (x["name"] < o["name"])))
        return F.get(F.filter(others, lambda x: same(x, o)), before)["name"]

    row = lambda a, b, c: F.struct(a.alias("old_name"), b.alias("new_name"), F.lit(c).alias("change"))
    blank = F.lit("")
    left = F.transform("gone", lambda o: F.when(partner(o, "gone", "come").isNull(), row(o["name"], blank, "removed")).otherwise(row(o["name"], partner(o, "gone", "come"), "renamed")))
    right = F.filter(F.transform("come", lambda o: F.when(partner(o, "come", "gone").isNull(), row(blank, o["name"], "added"))), lambda c: c.isNotNull())
    kept = F.transform("retyped", lambda n: row(n, n, "retyped"))
    return p.select(key, F.explode(F.concat(left, right, kept)).alias("_c")).select(key, "_c.*")


def drift(files: DataFrame, key: str, series: str, order: str, holders: Sequence[str], named: Sequence[str] = ()) -> DataFrame:
    """``changes`` of each file against the one before it in its series.

    ``files`` has one row a key. Files whose holders are all null are passed
    over; the first file of a series reports nothing. Files without a series
    or an order number are in no series. Holders that are no JSON object
    count as holders without options. Other columns are not used. Options
    are parsed once and stored and shuffled packed, one row a file, with
    64-bit hashes in place of their values (only those of two neighbouring
    files are ever compared); the predecessors are found by keys alone.
    """
    held = F.coalesce(*[F.col(h) for h in (*holders, *named)]).isNotNull()
    there = files.where(held & F.col(series).isNotNull() & F.col(order).isNotNull())
    brief = lambda o: F.struct(o["name"].alias("name"), o["tag"].alias("tag"), F.xxhash64(o["value"]).alias("h"))
    kept = stored(with_entries(there, holders, named, key, series, order).select(key, series, order, F.transform("opts", brief).alias("opts")))
    opts = kept.select(key, "opts")
    late = previous_file(kept, key, series, order).join(opts, key)
    return changes(late.join(opts.select(F.col(key).alias("previous"), F.col("opts").alias("_early")), "previous").select(key, "opts", F.col("_early").alias("previous")), key)
