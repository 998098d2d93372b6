"""API documents: functions and components in words, media types, and calls checked against their parameters.

Documents are taken apart by Spark's JSON functions, in maps of raw JSON texts, which keep the order
of keys; only the words for a schema, which nests without bound, come from a Python helper.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable

#: The keys of a path that are operations, those whose media types count, and where components are.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
CHECKED = ("get", "post", "put", "delete", "patch")
COMPONENTS = "/components/schemas/"
_MAP = "map<string,string>"


def sentence(text: str) -> str:
    """A description that ends in a full stop; a blank one is empty."""
    return "" if not text.strip() else text if text.strip().endswith(".") else text + "."


def schema_words(schema: dict, brief: bool = False, item: bool = False) -> str:
    """A schema in words; ``brief`` leaves out simple types and descriptions, ``item`` stands for an array's."""
    options = schema.get("oneOf")
    if isinstance(options, list) and len(schema) == 1:
        return " OR ".join(schema_words(x, brief, item) for x in options)
    if "$ref" in schema:
        return str(schema["$ref"]).replace(COMPONENTS, "")
    kind, about = str(schema.get("type") or ""), sentence(str(schema.get("description") or ""))
    if kind in ("array", "object"):
        if kind == "array":
            head = f"Array[{schema_words(schema.get('items') or {}, brief, True)}]"
        else:
            inside = [(name, schema_words(x, brief)) for name, x in schema["properties"].items()] if "properties" in schema else None
            head = "Object" if inside is None else "Object{" + ", ".join(f"{name}: {words}" if words else name for name, words in inside) + "}"
        return head if brief else f"{head}. {about}"
    if item or brief:
        return kind if item else ""
    listed = f"One of: [{', '.join(map(str, schema['enum']))}]." if "enum" in schema else ""
    return " ".join(x for x in (kind and f"{kind}.", about, listed) if x).strip()


def _words(text: str | None, brief: bool) -> str:
    try:
        schema = json.loads(text or "{}")
        return schema_words(schema, brief) if isinstance(schema, dict) else ""
    except (ValueError, RecursionError, AttributeError, TypeError):
        return ""


def _described(schemas: Column, brief: bool) -> Column:
    """Words for each schema of an array of JSON texts; what isn't a schema, or nests too deep, has none."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda texts: [_words(t, brief) for t in texts] if texts is not None else [])

    return run(schemas)


def _entries(text: Column) -> Column:
    """Keys and raw values of a JSON object in their order; none for anything else."""
    return F.coalesce(F.map_entries(F.from_json(text, _MAP)), F.expr("cast(array() as array<struct<key:string,value:string>>)"))


def _stopped(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    blank = F.trim(F.regexp_replace(c, r"\s", "")) == ""
    return F.when(blank, "").when(F.regexp_replace(c, r"\s+$", "").endswith("."), c).otherwise(F.concat(c, F.lit(".")))


def _operations(docs: DataFrame, name: str, document: str) -> DataFrame:
    """A row for each operation: ``tool, place, path, method, shared, op``, in document order."""
    paths = docs.select(F.col(name).alias("tool"), F.posexplode(_entries(F.get_json_object(document, "$.paths"))).alias("a", "p"))
    methods = paths.select("tool", "a", F.col("p.key").alias("path"), F.get_json_object("p.value", "$.parameters").alias("shared"), F.posexplode(_entries(F.col("p.value"))).alias("b", "m"))
    methods = methods.filter(F.col("m.key").isin(*METHODS))
    shape = "operationId string, summary string, description string, parameters array<string>, requestBody string, responses string"
    return methods.select("tool", F.struct("a", "b").alias("place"), "path", F.col("m.key").alias("method"), "shared", F.from_json("m.value", shape).alias("op"))


def functions(docs: DataFrame, name: str = "name", document: str = "document") -> DataFrame:
    """Functions of API documents: ``tool, place, function, path, method, summary, inputs, output, text``.

    ``inputs`` has ``name, description, required`` of each parameter, those of the path and then
    the request body's first media type included, the last of a name at the first's place; a reference in
    place of the body is named ``$ref``. A function without an id is named by path and method.
    ``text`` is the published wording. Texts that aren't documents, and nulls, give no rows.
    """
    ensure_importable(docs.sparkSession)
    none = F.expr("cast(array() as array<string>)")
    rows = _operations(docs, name, document)
    own = F.concat(F.coalesce("op.parameters", none), F.coalesce(F.from_json("shared", "array<string>"), none))
    said = F.filter(F.transform(own, lambda p: F.from_json(p, "name string, description string, required boolean, schema string")), lambda p: p["name"].isNotNull())
    media = F.get(_entries(F.get_json_object("op.requestBody", "$.content")), F.lit(0))["value"]
    body = F.from_json(F.get_json_object(media, "$.schema"), "`$ref` string, properties string, required array<string>")
    reply = F.get(F.filter(_entries(F.col("op.responses")), lambda e: e["key"].startswith("2")), F.lit(0))["value"]
    kind = F.get(_entries(F.get_json_object(reply, "$.content")), F.lit(0))
    rows = rows.select(
        "tool", "place", "path", "method", "op", said.alias("said"), body.alias("body"), reply.alias("reply"), kind["key"].alias("kind"),
        F.get_json_object(kind["value"], "$.schema").alias("shape"),
    ).withColumn("properties", _entries(F.col("body.properties")))
    rows = rows.withColumns({
        "param_words": _described(F.transform("said", lambda p: F.coalesce(p["schema"], F.lit("{}"))), False),
        "body_words": _described(F.transform("properties", lambda e: F.coalesce(e["value"], F.lit("{}"))), False),
        "out_words": _described(F.array("shape"), True)[0],
    })
    item = lambda name, words, required: F.struct(name.alias("name"), words.alias("description"), required.alias("required"))
    given = F.zip_with("said", "param_words", lambda p, w: item(p["name"], F.concat(w, F.lit(" "), _stopped(p["description"])), F.coalesce(p["required"], F.lit(False))))
    inside = F.zip_with("properties", "body_words", lambda e, w: item(e["key"], w, F.lit(False)))
    whole = F.array(item(F.lit("$ref"), F.replace("body.$ref", F.lit(COMPONENTS), F.lit("")), F.lit(False)))
    listed = F.concat(given, F.when(F.col("body.$ref").isNotNull(), whole).otherwise(F.slice(whole, 1, 0)), inside)
    needed = F.coalesce("body.required", none)
    last = lambda n: F.element_at(F.filter("listed", lambda x: x["name"] == n), -1)
    inputs = F.transform(F.array_distinct(F.transform("listed", lambda x: x["name"])), last)
    rows = rows.withColumn("listed", listed).withColumn("needed", needed)
    rows = rows.withColumn("inputs", F.transform(inputs, lambda x: item(x["name"], x["description"], x["required"] | F.array_contains(F.col("needed"), x["name"]))))
    told = F.transform("inputs", lambda x: F.when(x["name"] == "$ref", x["description"]).otherwise(
        F.concat(F.lit('"'), x["name"], F.lit('": "'), F.when(x["required"], "Required. ").otherwise(""), x["description"], F.lit('"'))))
    bare = F.concat(F.translate(F.replace(F.substring("path", 2, 1 << 30), F.lit("/"), F.lit("_")), "{}", ""), F.lit("_"), "method")
    output = F.struct(_stopped(F.get_json_object("reply", "$.description")).alias("description"), F.coalesce("kind", F.lit("")).alias("format"), F.coalesce("out_words", F.lit("")).alias("structure"))
    rows = rows.select(
        "tool", "place", F.coalesce("op.operationId", bare).alias("function"), "path", "method",
        F.coalesce("op.summary", "op.description", F.lit("")).alias("summary"), "inputs", output.alias("output"), F.array_join(told, ", ").alias("told"),
    )
    text = F.concat(
        "summary", F.lit("\nParameters: {"), "told", F.lit("}\nOutput: "), "output.description", F.lit("\n - Format: "), "output.format",
        F.lit("\n - Structure: "), "output.structure", F.lit("\n"),
    )
    return rows.withColumn("text", text).drop("told")


def components(docs: DataFrame, name: str = "name", document: str = "document") -> DataFrame:
    """Components of API documents in words: ``tool, place, component, description``."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col(name).alias("tool"), _entries(F.get_json_object(document, "$.components.schemas")).alias("c"))
    words = _described(F.transform("c", lambda e: F.coalesce(e["value"], F.lit("{}"))), True)
    rows = rows.withColumn("words", words).select("tool", F.posexplode(F.arrays_zip("c", "words")).alias("place", "x"))
    return rows.select("tool", "place", F.col("x.c.key").alias("component"), F.col("x.words").alias("description"))


def media_flags(document: Column) -> Column:
    """Struct ``input, output``: whether an API's media types are texts.

    Operations are looked at in order; of each, the request's types and the last response's that has any
    replace what was known, and the first operation with a flag that is false ends the search.
    """
    types = lambda text: F.transform(_entries(F.get_json_object(text, "$.content")), lambda e: e["key"])
    texts = lambda kinds: F.when(F.size(kinds) > 0, F.exists(kinds, lambda k: k.startswith("text/") | (k == "application/json")))
    replies = lambda op: F.filter(F.transform(_entries(F.get_json_object(op, "$.responses")), lambda e: texts(types(e["value"]))), lambda x: x.isNotNull())
    asked = lambda op: texts(types(F.get_json_object(op, "$.requestBody")))
    ops = F.flatten(F.transform(_entries(F.get_json_object(document, "$.paths")), lambda p: F.filter(_entries(p["value"]), lambda m: m["key"].isin(*CHECKED))))
    each = F.transform(ops, lambda m: F.struct(asked(m["value"]).alias("i"), F.try_element_at(replies(m["value"]), F.lit(-1)).alias("o")))
    start = F.struct(F.lit(True).alias("input"), F.lit(True).alias("output"))
    step = lambda s, x: F.when(s["input"] & s["output"], F.struct(F.coalesce(x["i"], s["input"]).alias("input"), F.coalesce(x["o"], s["output"]).alias("output"))).otherwise(s)
    return F.aggregate(each, start, step)


#: How a value's type is told, by the beginning of its variant's.
_KINDS = {"OBJECT": "object", "ARRAY": "array", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean"}


def checked_value(value: Column, kind: Column, enum: Column) -> Column:
    """Struct ``value, errors`` of a variant against a schema's type and JSON array of allowed values.

    Text of a number becomes one, any text passes as a truth value, and a whole number passes
    as a number and a truth value as a whole number. Errors have ``expected, got``; a null value has the
    type None. A type that isn't known, and no list, allow anything.
    """
    schema, text = F.schema_of_variant(value), F.variant_get(value, "$", "string")
    got = F.lit("None")
    for begin, name in _KINDS.items():
        got = F.when(schema.startswith(begin), name).otherwise(got)
    number = F.when(kind == "integer", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long").cast("string"))).otherwise(F.trim(text).try_cast("double").cast("string"))
    parsed = F.when((got == "string") & kind.isin("integer", "number"), F.try_parse_json(number)).when((got == "string") & (kind == "boolean"), F.parse_json(F.when(text == "", "false").otherwise("true")))
    fits = ~kind.isin(*set(_KINDS.values())) | (got == kind) | ((kind == "integer") & (got == "boolean")) | ((kind == "number") & (got == "integer")) | parsed.isNotNull()
    wrong = F.struct(kind.alias("expected"), got.alias("got"))
    now = F.coalesce(parsed, value)
    allowed = F.transform(F.from_json(enum, "array<variant>"), lambda x: F.to_json(x))
    listed = allowed.isNull() | (F.coalesce(F.variant_get(now, "$", "string"), F.lit("-")) == "") | F.array_contains(allowed, F.to_json(now))
    other = F.struct(F.concat(F.lit("one of "), enum).alias("expected"), F.concat(F.lit('"'), F.coalesce(F.variant_get(now, "$", "string"), F.lit("None")), F.lit('"')).alias("got"))
    pick = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(what)).otherwise(F.slice(F.array(what), 1, 0))
    return F.struct(now.alias("value"), F.concat(pick(~fits, wrong), pick(~listed, other)).alias("errors"))


def checked_calls(calls: DataFrame, key: list[str], params: str, wanted: str) -> DataFrame:
    """What is wrong with each call's parameters: ``key..., errors, missing, message``.

    ``params`` is a JSON object, ``wanted`` an array of ``name, kind, enum, required``. All wrong types
    and values come in ``errors``, and required names not given in ``missing``; the message is the
    published one for the errors, else for what is missing, null for a call that passes. A ``params``
    that is no object gives none. A key that calls share would mix them.
    """
    given = calls.select(*key, F.from_json(params, "map<string,variant>").alias("g"), F.explode_outer(wanted).alias("w"))
    value = F.try_element_at("g", F.col("w.name"))
    there = F.coalesce(F.array_contains(F.map_keys("g"), F.col("w.name")), F.lit(False))
    checked = given.withColumn("there", there).withColumn("c", checked_value(value, F.coalesce("w.kind", F.lit("")), F.col("w.enum")))
    errors = F.transform("c.errors", lambda e: F.struct(F.col("w.name").alias("name"), e["expected"].alias("expected"), e["got"].alias("got")))
    out = checked.groupBy(*key).agg(
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("there"), errors)))).alias("errors"),
        F.sort_array(F.collect_list(F.when(~F.col("there") & F.coalesce("w.required", F.lit(False)), F.col("w.name")))).alias("missing"),
    )
    retry = F.lit(". You need to change the input and try again.")
    lines = F.transform("errors", lambda e: F.concat(F.lit('Parameter type error: "'), e["name"], F.lit('", expected '), e["expected"], F.lit(", but got "), e["got"], retry))
    lacks = F.concat(F.lit("Missing required parameters: "), F.array_join(F.transform("missing", lambda m: F.concat(F.lit('"'), m, F.lit('"'))), ", "), retry)
    return out.withColumn("message", F.when(F.size("errors") > 0, F.array_join(lines, "\n")).when(F.size("missing") > 0, lacks))
