"""Answers brought to a declared shape. A JSON schema (a dictionary) is compiled, once, to an expression tree over a variant:
declared fields of the declared types, and the list of what had to be changed for it.

Objects keep their declared fields, and the others go; a missing or null field has its default, else the empty value of its
type. Arrays keep the elements that have the items' kind, up to maxItems. Strings of digits become numbers, other scalars
strings; what can't be converted is as if missing. Words of an enumeration are brought to an allowed one. An object whose
fields stand within a wrapper is unwrapped. Null and unparsable answers give the empty value throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import replaced

#: Names of wrappers, in the order in which they are tried.
WRAPPERS = ("self", "response", "result", "data", "output", "content")
SCALARS = {"string": ("string", ""), "integer": ("bigint", 0), "number": ("double", 0.0), "boolean": ("boolean", False)}
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$"}


def sql_type(schema: dict) -> str:
    kind = schema["type"]
    if kind == "object":
        return "struct<" + ", ".join(f"`{k}`: {sql_type(s)}" for k, s in schema["properties"].items()) + ">"
    return f"array<{sql_type(schema['items'])}>" if kind == "array" else SCALARS[kind][0]


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(KINDS[kind]), F.lit(False))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


def enum_word(c: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed word that c means: itself; but for case and closing marks; the first part of several (`noun/verb`) that is
    one; without bracketed notes; with blanks for hyphens; but for a plural -s; by a common beginning; by containment (the
    longest word first); else the first allowed one. Null for null."""
    clean = F.regexp_replace(F.lower(F.trim(c)), r"[.,;:]+$", "")
    flat = lambda x: replaced(x, (r"[-_]+", " "))
    norm, bare = flat(clean), F.trim(F.regexp_replace(clean, r"\(.*?\)", ""))
    parts = F.filter(F.transform(F.split(clean, r"[/|\\]"), lambda p: F.trim(p)), lambda p: p != "")
    heads = F.transform(parts, lambda p: F.regexp_replace(F.split(flat(p), r"\s+")[0], "s+$", ""))
    plain = {a: a.lower() for a in allowed}
    spaced = {a: a.lower().replace("-", " ").replace("_", " ") for a in allowed}
    long_first = sorted(allowed, key=len, reverse=True)

    def first(test, among=allowed) -> Column:
        return F.coalesce(*(F.when(test(a), F.lit(a)) for a in among))

    some = first(lambda a: heads[0] == plain[a])
    for i in range(1, 4):
        some = F.coalesce(some, first(lambda a, i=i: F.try_element_at(heads, F.lit(i + 1)) == plain[a]))
    one = F.regexp_replace(norm, "s+$", "")
    return F.when(
        c.isNotNull(),
        F.coalesce(
            first(lambda a: c == a), first(lambda a: clean == plain[a]), F.when(F.size(parts) > 1, some), first(lambda a: bare == plain[a]), first(lambda a: norm == spaced[a]),
            first(lambda a: one == spaced[a].rstrip("s"), long_first), first(lambda a: F.startswith(norm, F.lit(spaced[a])) | F.startswith(F.lit(spaced[a]), norm), long_first),
            first(lambda a: F.contains(norm, F.lit(spaced[a])) | F.contains(F.lit(spaced[a]), norm), long_first), F.lit(allowed[0]),
        ),
    )


def shaped(schema: dict, v: Column) -> Column:
    """v, a variant, in the schema's shape."""
    kind = schema["type"]
    if kind == "object":
        return F.struct(*(shaped(s, field(v, k)).alias(k) for k, s in schema["properties"].items()))
    if kind == "array":
        items, elements = schema["items"], F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        if items["type"] in ("object", "array"):
            elements = F.filter(elements, lambda x: is_kind(x, items["type"]))
        else:
            elements = F.filter(elements, lambda x: F.try_variant_get(x, "$", SCALARS[items["type"]][0]).isNotNull())
        if "maxItems" in schema:
            elements = F.slice(elements, 1, schema["maxItems"])
        return F.transform(elements, lambda x: shaped(items, x))
    type_, empty = SCALARS[kind]
    value = F.try_variant_get(v, "$", type_)
    if "enum" in schema:
        value = enum_word(value, tuple(schema["enum"]))
    return F.coalesce(value, F.lit(schema.get("default", empty)).cast(type_))


def changes(schema: dict, v: Column, path: str = "$") -> Column:
    """Paths with what happened to them: dropped, missing, converted (another type, or another word of an enumeration),
    shortened; each once, `[]` standing for any element."""
    kind, none = schema["type"], F.array().cast("array<string>")
    note = lambda test, what: F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(f"{path} {what}"))).otherwise(none)
    absent = v.isNull() | F.is_variant_null(v)
    if kind == "object":
        known = list(schema["properties"])
        extra = F.transform(F.filter(keys(v), lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit(f"{path}."), k, F.lit(" dropped")))
        inner = [changes(s, field(v, k), f"{path}.{k}") for k, s in schema["properties"].items()]
        here = F.when(absent, note(absent, "missing")).when(~is_kind(v, kind), note(F.lit(True), "converted")).otherwise(F.concat(extra, *inner))
    elif kind == "array":
        items, elements = schema["items"], F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        fits = F.filter(elements, lambda x: is_kind(x, items["type"])) if items["type"] in ("object", "array") else elements
        inner = F.flatten(F.transform(fits, lambda x: changes(items, x, f"{path}[]")))
        lost = F.when(F.size(fits) < F.size(elements), F.array(F.lit(f"{path}[] dropped"))).otherwise(none)
        cut = note(F.size(fits) > schema["maxItems"], "shortened") if "maxItems" in schema else none
        here = F.when(absent, note(absent, "missing")).when(~is_kind(v, kind), note(F.lit(True), "converted")).otherwise(F.concat(lost, cut, inner))
    else:
        value = F.try_variant_get(v, "$", SCALARS[kind][0])
        other = ~is_kind(v, kind)
        if "enum" in schema:
            other = other | ~value.isin(*schema["enum"])
        here = F.when(absent, note(absent, "missing")).otherwise(note(other, "converted"))
    return F.array_sort(F.array_distinct(here))


def unwrapped(schema: dict, v: Column) -> Column:
    """v, or the first wrapper's content that has a declared field, if v has none itself."""
    known = F.array(*map(F.lit, schema["properties"]))
    has = lambda x: F.coalesce(F.arrays_overlap(keys(x), known), F.lit(False))
    return F.when(has(v), v).otherwise(F.coalesce(*(F.when(has(field(v, w)), field(v, w)) for w in WRAPPERS), v))
