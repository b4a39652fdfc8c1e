"""Deeply nested records to related flat tables.

``flatten`` infers the merged schema of all records in one pass, then explodes
each array (and each object that is used as a dictionary) into a child table
whose rows carry the key of their parent row and their position in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, PARENT, ORDINAL, NAME, BODY = "row_key", "parent_key", "ordinal", "entry_name", "body"

#: Python's reading of a decimal number; keeps out the suffixes that Java's parser would take.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def read_json(payload: str) -> Column:
    """The payload as a variant; null where it is null, cut off or otherwise no JSON text.

    Bare NaN and Infinity are read as numbers. The payload is read inside a
    one-element array, so that text after the value is an error, too. Of a
    key that an object names twice the last value counts, where the session
    allows it (``allow_duplicate_keys``); else the object is unreadable.
    """
    wrapped = F.from_json(F.concat(F.lit("["), F.col(payload), F.lit("]")), "variant", {"allowSingleQuotes": "false"})
    second = F.schema_of_variant(F.try_variant_get(wrapped, "$[1]", "variant"))
    return F.when(second.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def allow_duplicate_keys(df: DataFrame) -> None:
    """Lets the session read JSON objects that name a key twice; Spark looks this up when a query runs."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


@dataclass
class Shape:
    """A node of the merged schema: ``kind`` is OBJECT, ARRAY, VARIANT (types differ) or a scalar's name."""

    kind: str
    fields: dict[str, Shape] = field(default_factory=dict)


def parse_shape(text: str | None) -> Shape:
    """Reads what ``schema_of_variant_agg`` returns."""
    text = text or "VOID"
    at = 0

    def node() -> Shape:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at += 7
            out = Shape("OBJECT")
            while text[at] != ">":
                if text[at] == "`":
                    m = re.compile(r"`((?:[^`]|``)*)`").match(text, at)
                    name = m[1].replace("``", "`")
                else:
                    m = re.compile(r"[^:]+").match(text, at)
                    name = m[0]
                at = m.end() + 2
                out.fields[name] = node()
                at += 2 * text.startswith(", ", at)
            at += 1
            return out
        if text.startswith("ARRAY<", at):
            at += 6
            out = Shape("ARRAY", {"": node()})
            at += 1
            return out
        m = re.compile(r"\w+(\(\d+,\s*\d+\))?").match(text, at)
        at = m.end()
        return Shape(m[0])

    return node()


def _first_nested(shapes: Sequence[Shape]) -> Shape:
    return next((x for x in shapes if x.kind in ("OBJECT", "ARRAY")), shapes[0])


def _schema_aggregates(body: Column) -> list[Column]:
    """Merged schemas of all bodies, of the objects among them and of the arrays; where types are mixed, those of the objects count, or else the arrays'."""
    kind = F.schema_of_variant(body)
    return [F.schema_of_variant_agg(body), *[F.schema_of_variant_agg(F.when(kind.startswith(k), body)) for k in ("OBJECT", "ARRAY")]]


def _path(names: Sequence[str]) -> str:
    return "$" + "".join(f'["{n}"]' for n in names)


def _at(names: Sequence[str], kind: str = "variant", body: str | Column = BODY) -> Column:
    return F.try_variant_get(F.col(body) if isinstance(body, str) else body, _path(names), kind)


def _entries(at: Column, dictionary: bool = False) -> Column:
    """The entries of an array, or of an object that is used as a dictionary, with their names."""
    kind = F.schema_of_variant(at)
    each = F.transform(F.try_variant_get(at, "$", "array<variant>"), lambda e: F.struct(F.try_variant_get(e, '$["name"]', "string").alias(NAME), e.alias(BODY)))
    out = F.when(kind.startswith("ARRAY"), each)
    if dictionary:
        named = F.map_entries(F.try_variant_get(at, "$", "map<string,variant>"))
        out = out.when(kind.startswith("OBJECT"), F.transform(named, lambda e: F.struct(e["key"].alias(NAME), e["value"].alias(BODY))))
    return out


def children(df: DataFrame, places: Sequence[Sequence[str]], dictionary: bool = False) -> DataFrame:
    """The entries of the arrays at some paths, one row each; of objects, too, if they are used as dictionaries.

    An entry of a dictionary has its key as ``entry_name``; in an array its
    own field ``name`` takes that place. The key of a row tells its parent,
    its path and its position. All paths are exploded in one go.
    """
    src = df.select(F.col(KEY).alias(PARENT), F.explode(F.array(*[F.struct(F.lit(".".join(p)).alias("place"), _entries(_at(p), dictionary).alias("entries")) for p in places])).alias("_p"))
    out = src.select(PARENT, "_p.place", F.posexplode("_p.entries").alias(ORDINAL, "_e"))
    return out.select(PARENT, ORDINAL, F.concat_ws("/", PARENT, "place", ORDINAL).alias(KEY), f"_e.{NAME}", f"_e.{BODY}")


#: Merged kinds to the types of flat columns; all else is kept as JSON text.
_SCALARS = {"BIGINT": "long", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}


def _columns(shape: Shape, at: tuple[str, ...] = ()) -> list[Column]:
    out: list[Column] = []
    for name, sub in shape.fields.items():
        path = (*at, name)
        if sub.kind == "OBJECT":
            out += _columns(sub, path)
        elif sub.kind == "DECIMAL" or sub.kind.startswith("DECIMAL("):
            out.append(F.try_variant_get(BODY, _path(path), "double").alias(".".join(path)))
        elif sub.kind in _SCALARS:
            out.append(F.try_variant_get(BODY, _path(path), _SCALARS[sub.kind]).alias(".".join(path)))
        elif sub.kind == "VARIANT":
            out.append(F.to_json(F.try_variant_get(BODY, _path(path), "variant")).alias(".".join(path)))
    return out


def _arrays(shape: Shape, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Shape]]:
    out: list[tuple[tuple[str, ...], Shape]] = []
    for name, sub in shape.fields.items():
        path = (*at, name)
        out += _arrays(sub, path) if sub.kind == "OBJECT" else [(path, sub)] if sub.kind in ("ARRAY", "VARIANT") else []
    return out


class Tables(Mapping[str, DataFrame]):
    """The flat tables by name; each is planned only when it is asked for.

    Where elements are of mixed types, the merged schema doesn't say what the
    objects among them hold; another job finds out, if their fields or their
    own children are asked for.
    """

    def __init__(self, root: DataFrame, dictionaries: Mapping[str, Sequence[str]]):
        self._places = {k: [tuple(p.split(".")) for p in v] for k, v in dictionaries.items()}
        columns = _schema_aggregates(F.col(BODY))
        for paths in self._places.values():
            entries = F.flatten(F.array_compact(F.array(*[_entries(_at(p), True) for p in paths])))
            objects = F.filter(F.transform(entries, lambda e: e[BODY]), lambda e: F.schema_of_variant(e).startswith("OBJECT"))
            columns.append(F.schema_of_variant_agg(F.to_variant_object(objects)))
        found = [parse_shape(x) for x in root.agg(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()]
        shape = _first_nested(found[:3])
        self._rows: dict[str, DataFrame] = {"": root}
        self._shapes: dict[str, Shape] = {"": shape}
        self._inner: dict[str, list[str]] = {}
        for (name, paths), entry in zip(self._places.items(), found[3:], strict=True):
            if any(_has(shape, p) for p in paths):
                self._add(name, children(root, paths, dictionary=True), entry.fields.get("", Shape("VOID")))

    def _add(self, name: str, rows: DataFrame, shape: Shape) -> None:
        self._rows[name], self._shapes[name] = rows, shape

    def shape(self, name: str) -> Shape:
        if self._shapes[name].kind == "VARIANT":
            found = self._rows[name].agg(*[c.alias(f"c{k}") for k, c in enumerate(_schema_aggregates(F.col(BODY)))]).first()
            shape = _first_nested([parse_shape(x) for x in found])
            self._shapes[name] = Shape("MIXED", shape.fields) if shape.kind == "VARIANT" else shape
        return self._shapes[name]

    def _open(self, name: str) -> list[str]:
        """Names of the child tables of a table."""
        if name not in self._inner:
            shape = self.shape(name)
            here: list[str] = []
            if shape.kind == "ARRAY":
                here.append(f"{name}.items" if name else "items")
                self._add(here[-1], children(self._rows[name], [()]), shape.fields[""])
            taken = {p for paths in self._places.values() for p in paths} if name == "" else set()
            for path, sub in _arrays(Shape("OBJECT", shape.fields if shape.kind == "OBJECT" else {})):
                if path not in taken:
                    here.append(".".join((*([name] if name else []), *path)))
                    self._add(here[-1], children(self._rows[name], [path]), sub.fields.get("", sub))
            self._inner[name] = here
        return self._inner[name]

    def _find(self, name: str) -> bool:
        known = [n for n in self._rows if n == name or n == "" or name.startswith(f"{n}.")]
        while name not in self._rows:
            at = next((n for n in sorted(known, key=len, reverse=True) if n not in self._inner), None)
            if at is None:
                return False
            self._open(at)
            known = [n for n in self._rows if n == name or n == "" or name.startswith(f"{n}.")]
        return True

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self._find(name)

    def __getitem__(self, name: str) -> DataFrame:
        if not self._find(name):
            raise KeyError(name)
        shape = self.shape(name)
        inner = Shape("OBJECT", shape.fields if shape.kind == "OBJECT" else {})
        taken = {p for paths in self._places.values() for p in paths} if name == "" else set()
        columns = [(n, c) for n, c in zip(_names(inner), _columns(inner), strict=True) if tuple(n.split(".")) not in taken]
        return self._rows[name].select("*", *[c.alias(f"f.{n}") for n, c in columns])

    def rows(self, name: str) -> DataFrame:
        """A table without the columns of its fields."""
        return self._rows[name] if self._find(name) else self[name]

    def __iter__(self) -> Iterator[str]:
        todo = list(self._rows)
        seen: list[str] = []
        while todo:
            name = todo.pop(0)
            if name not in seen:
                seen.append(name)
                todo += self._open(name)
        return iter(seen)

    def __len__(self) -> int:
        return sum(1 for _ in self)


def flatten(df: DataFrame, key: str, payload: str, dictionaries: Mapping[str, Sequence[str]] | None = None) -> Tables:
    """All flat tables of a column of JSON texts, by the path of their array.

    ``key`` names the records (unique, not null). ``dictionaries`` maps the
    name of a table to the dotted paths of the objects or arrays that hold
    its entries; several places of the same thing make one table.

    Every table has ``row_key``, ``parent_key``, ``ordinal``, ``entry_name``
    and ``body`` (the entry as a variant); a table of objects has a column
    for each scalar below it that lies in no other array, named by its path
    with a leading ``f.``, so that no name in the data can clash with these.
    A row's key is its parent's with path and position, so no two rows of any
    tables share one. Arrays are followed however deep they lie. Null, empty
    and unreadable payloads give a root row with a null body and no children;
    of a key named twice the last value counts; an array that is missing,
    null or empty gives no child rows; elements that are null give rows with
    a JSON null. Columns of ``df`` other than the two named are not looked
    at. An empty table gives an empty root table alone.
    """
    allow_duplicate_keys(df)
    root = df.select(
        F.lit(None).cast("string").alias(PARENT),
        F.lit(None).cast("int").alias(ORDINAL),
        F.col(key).cast("string").alias(KEY),
        F.lit(None).cast("string").alias(NAME),
        read_json(payload).alias(BODY),
    )
    return Tables(root, dictionaries or {})


def _names(shape: Shape, at: tuple[str, ...] = ()) -> list[str]:
    out: list[str] = []
    for name, sub in shape.fields.items():
        path = (*at, name)
        if sub.kind == "OBJECT":
            out += _names(sub, path)
        elif sub.kind in _SCALARS or sub.kind == "VARIANT" or sub.kind.startswith("DECIMAL"):
            out.append(".".join(path))
    return out


def _has(shape: Shape, path: Sequence[str]) -> bool:
    for name in path:
        if shape.kind == "VARIANT":
            return True
        if name not in shape.fields:
            return False
        shape = shape.fields[name]
    return shape.kind not in ("VOID",)


def finite(text: str | Column) -> Column:
    """A double where the text is that of a finite number, else null."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.when(text.rlike(NUMBER), F.trim(F.translate(text, "\t\n\r\f\v", "     ")).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def list_elements(tables: Tables, owner: str, lists: Sequence[str], pieces: str = "chunks", offset: str = "offset") -> DataFrame:
    """The elements of the lists of each ``owner`` row: key, parent_key and entry_name of the owner, list_name, idx, and the element as text.

    A list may lie in the owner row or, in pieces, in the objects of the
    array ``pieces``; a piece's position is its ``offset`` (0 where that is
    missing or no number). The owner's columns are carried through each
    explode, so nothing is joined; a list that no record has gives no rows.
    """
    if owner not in tables:
        schema = f"owner_key string, {PARENT} string, {NAME} string, list_name string, idx int, text string"
        return next(iter(tables._rows.values())).sparkSession.createDataFrame([], schema)
    rows = tables.rows(owner)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col(BODY).alias("part")))
    if pieces in tables.shape(owner).fields:
        each = _at([pieces], "array<variant>")
        start = lambda e: F.coalesce(F.try_variant_get(e, _path([offset]), "int"), F.lit(0)).alias("start")
        whole = F.concat(whole, F.coalesce(F.transform(each, lambda e: F.struct(start(e), e.alias("part"))), F.array().cast("array<struct<start:int,part:variant>>")))
    parts = rows.select(F.col(KEY).alias("owner_key"), PARENT, NAME, F.explode(whole).alias("_w")).select("owner_key", PARENT, NAME, "_w.start", "_w.part")
    # numbers and texts are told apart by nothing that counts: both come as text
    named = F.array(*[F.struct(F.lit(n).alias("list_name"), _at([n], "array<string>", "part").alias("list")) for n in lists])
    flat = parts.select("owner_key", PARENT, NAME, "start", F.explode(named).alias("_l")).select("owner_key", PARENT, NAME, "start", "_l.list_name", F.posexplode("_l.list").alias("_i", "text"))
    return flat.select("owner_key", PARENT, NAME, "list_name", (F.col("start") + F.col("_i")).cast("int").alias("idx"), "text")
