"""Deeply nested JSON records as related flat tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint


def parse(text: Column) -> Column:
    """JSON text as a variant; null where it is not valid JSON."""
    return F.try_parse_json(text)


def text_of(v: Column) -> Column:
    """Plain text of a scalar variant (JSON text of an array or object)."""
    return F.try_variant_get(v, "$", "string")


def _is_kind(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once; plain nesting would copy the expression at every use."""
    return F.transform(F.array(value), body)[0]


def decode(v: Column) -> Column:
    """A string that holds JSON text of an array, object or string stands for what it encodes."""

    def body(x: Column) -> Column:
        s = text_of(x)
        return F.when(_is_kind(x, "STRING") & s.rlike(r'^\s*[\[{"]'), F.coalesce(F.try_parse_json(s), x)).otherwise(x)

    return _let(v, body)


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def as_list(v: Column) -> Column:
    """Elements of an array variant; a single value is a list of one; null is null."""
    return _let(
        v, lambda x: F.when(~present(x), F.lit(None)).when(_is_kind(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))
    )


def _step(key: str) -> Callable[[Column], Column]:
    def body(x: Column) -> Column:
        inside = decode(F.try_variant_get(x, f"$.{key}", "variant"))
        return _let(inside, lambda y: F.when(present(y) & _is_kind(y, "OBJECT"), y).otherwise(x))

    return body


def unwrap(v: Column, keys: tuple[str, ...]) -> Column:
    """Step into envelopes: while one of ``keys`` names an object, take it."""
    out = decode(v)
    for k in keys:
        out = _let(out, _step(k))
    return out


#: Single-field objects by which exporters type a scalar.
SCALAR_TAGS = ("$oid", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$date")


def scalar(v: Column) -> Column:
    """Plain text of a value, typed scalar objects unwrapped; empty text if null or absent."""

    def body(x: Column) -> Column:
        tagged = [F.try_variant_get(x, f"$['{t}']", "string") for t in SCALAR_TAGS]
        return F.coalesce(F.when(~present(x), "").when(_is_kind(x, "OBJECT"), F.coalesce(*tagged, text_of(x))), text_of(x), F.lit(""))

    return _let(v, body)


#: Columns of a child row beside the root key, and the field name of an array inside an array.
ROW_KEY, PARENT_KEY, PLACES, INNER = "row_key", "parent_key", "places", "[]"


def _get(v: Column, field: str) -> Column:
    if "'" in field:
        return F.try_variant_get(v, "$", "map<string,variant>")[F.lit(field)]
    return F.try_variant_get(v, f"$['{field}']", "variant")


def _is_nested(v: Column) -> Column:
    """An array or an object, but for the objects by which exporters type a scalar."""
    return _let(F.schema_of_variant(v), lambda k: k.startswith("ARRAY") | (k.startswith("OBJECT") & ~k.rlike(r"^OBJECT<`?\$\w+`?: [^<,]*>$")))


def field_kinds(level: DataFrame) -> DataFrame:
    """``path, field, nested`` of all fields of a level's records: nested if any record holds an array or object there.

    Strings that hold JSON text count as what they encode. Merged before the shuffle; one row per path and field.
    """
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    named = level.where(_is_kind(F.col("v"), "OBJECT")).select("path", F.explode(fields).alias("field", "x")).where(present(F.col("x")))
    inner = level.where(_is_kind(F.col("v"), "ARRAY")).select("path", F.lit(INNER).alias("field"), F.lit(True).alias("nested"))
    return named.select("path", "field", _is_nested(decode(F.col("x"))).alias("nested")).unionByName(inner).groupBy("path", "field").agg(F.max("nested").alias("nested"))


@dataclass(frozen=True)
class FlatTables:
    """Child rows of nested records and their merged schema.

    ``rows``: the root key, ``path``, ``row_key``, ``parent_key`` (of the record for children of the record itself), ``places``
    (of the ancestors and the row itself, zero-based) and the value ``v``. ``fields``: by path (empty text: the
    records) the fields, and whether they are child tables.
    """

    root: str
    rows: DataFrame
    fields: dict[str, dict[str, bool]]

    def paths(self) -> list[str]:
        return sorted(f"{p}.{f}" if p else f for p, fields in self.fields.items() for f, nested in fields.items() if nested)

    def table(self, path: str) -> DataFrame:
        """The flat table of a path: keys, places ``place_0``, ... and a text column per scalar field (``value`` for plain elements)."""
        depth = len(self.rows_of(path))
        scalars = [f for f, nested in self.fields.get(path, {}).items() if not nested]
        taken = {self.root, ROW_KEY, PARENT_KEY, "value"}
        name = lambda f: f"{f}_" if f in taken or f.startswith("place_") else f
        own = F.when(~_is_kind(F.col("v"), "OBJECT") | ~_is_nested(F.col("v")), scalar(F.col("v")))
        cols = [scalar(decode(_get(F.col("v"), f))).alias(name(f)) for f in sorted(scalars)]
        places = [F.col(PLACES)[i].alias(f"place_{i}") for i in range(depth)]
        return self.rows.where(F.col("path") == path).select(self.root, ROW_KEY, PARENT_KEY, *places, own.alias("value"), *cols)

    def rows_of(self, path: str) -> list[str]:
        """The paths from the outermost child table down to ``path``."""
        out, known = [], set(self.paths())
        for i in range(1, len(path) + 1):
            if path[:i] in known and (i == len(path) or path[i] == "."):
                out.append(path[:i])
        return out


def flatten(records: DataFrame, root: str) -> FlatTables:
    """Child tables of ``records`` (``root``, ``v`` a variant object), however deep.

    Level by level the merged schema of the records (:func:`field_kinds`, all
    tables of a depth at once) names the fields that hold arrays or
    objects in any record; each is exploded into child rows that carry the root key, the surrogate key of
    their parent, one of their own and their place. A single value where others have a list is
    a list of one, JSON text stands for what it encodes, an array inside an array is a child table named ``[]``.
    It ends where no record has a nested field. Every level is computed once and written.

    Records without the field, null fields and empty lists give no child rows; null elements give none
    but count in places; repeated elements stay apart by place. An empty input gives no tables. The schema goes to the driver,
    so field names must not be data.
    """
    level = checkpoint(records.select(F.col(root), F.lit("").alias("path"), F.xxhash64(root).alias(ROW_KEY), F.array().cast("array<bigint>").alias(PLACES), "v"))
    fields: dict[str, dict[str, bool]] = {}
    levels: list[DataFrame] = []
    for _ in count():
        nested = []
        for r in sorted(field_kinds(level).collect()):
            fields.setdefault(r["path"], {})[r["field"]] = r["nested"]
            if r["nested"]:
                nested.append((r["path"], r["field"]))
        if not nested:
            break

        def items(field: str) -> Column:
            if field == INNER:
                return F.when(_is_kind(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
            return as_list(decode(_get(F.col("v"), field)))

        # a record of a path opens only that path's fields
        lists = F.lit(None)
        for path in dict.fromkeys(p for p, _ in nested):
            mine = [F.struct(F.lit(f"{p}.{f}" if p else f).alias("path"), items(f).alias("items")) for p, f in nested if p == path]
            lists = F.when(F.col("path") == path, F.array(*mine)).otherwise(lists)
        opened = level.select(root, ROW_KEY, PLACES, F.explode(lists).alias("t")).select(root, F.col(ROW_KEY).alias(PARENT_KEY), PLACES, F.col("t.path").alias("path"), F.posexplode("t.items").alias("n", "v"))
        rows = opened.select(
            root, "path", F.xxhash64(PARENT_KEY, "path", "n").alias(ROW_KEY), PARENT_KEY, F.concat(PLACES, F.array(F.col("n").cast("long"))).alias(PLACES), decode(F.col("v")).alias("v")
        )
        level = checkpoint(rows.where(present(F.col("v"))))
        levels.append(level)
    if not levels:
        level = level.select(root, "path", ROW_KEY, F.col(ROW_KEY).alias(PARENT_KEY), PLACES, "v").limit(0)
    return FlatTables(root, reduce(DataFrame.unionByName, levels) if levels else level, fields)


#: Child tables of exported papers by path, as exported, with the kind they are reported as and the field of their key (none: the element).
EXPORT_KINDS = {
    "authors": ("author", "author_id"),
    "authors.author_avaialable_names": ("author_name", None),
    "iitd_authors": ("iitd_author", "kerberos"),
    "classification": ("classification", "subdomain_id"),
    "classification.topics": ("topic", None),
}

#: Envelopes in which export tools wrap a record, outermost first.
ENVELOPES = ("o", "document")

CHILD_SCHEMA = T.StructType(
    [
        T.StructField("export_id", T.LongType()),
        T.StructField("child_kind", T.StringType(), False),
        T.StructField("elem_pos", T.LongType()),
        T.StructField("sub_pos", T.LongType()),
        T.StructField("child_key", T.StringType()),
    ]
)


def export_tables(exports: DataFrame) -> FlatTables:
    """Flat tables of ``exports`` (``export_id, payload``). Payloads that are not valid JSON (or null) give no rows."""
    docs = exports.select("export_id", unwrap(parse(F.col("payload")), ENVELOPES).alias("v")).where(F.col("v").isNotNull())
    return flatten(docs, "export_id")


def export_children(exports: DataFrame) -> DataFrame:
    """The child records of ``exports`` named in :data:`EXPORT_KINDS` in one tagged table, read from the inferred flat tables.

    Keys are the plain
    text of the value, empty text where null or absent. An empty classification
    object gives no row; its place still counts.
    """
    rows = export_tables(exports).rows
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for path, (name, field) in EXPORT_KINDS.items():
        at = F.col("path") == path
        kind = F.when(at, F.lit(name)).otherwise(kind)
        key = F.when(at, scalar(decode(_get(F.col("v"), field))) if field else scalar(F.col("v"))).otherwise(key)
    rows = rows.where(F.col("path").isin(*EXPORT_KINDS)).where((F.col("path") != "classification") | (text_of(F.col("v")) != "{}"))
    return rows.select(
        "export_id", kind.alias("child_kind"), F.col(PLACES)[0].alias("elem_pos"), F.coalesce(F.get(PLACES, F.lit(1)), F.lit(-1).cast("long")).alias("sub_pos"), key.alias("child_key")
    )
