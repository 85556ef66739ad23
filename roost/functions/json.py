"""Typed reads from semi-structured JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roost.functions.numbers import parse_number
from roost.functions.text import all_matches, not_blank, trim_ws

JSON_LD = r"""(?i)<script[^>]*type=["']application/ld\+json["'][^>]*>((?s:.*?))</script>"""
STRICT = {"allowSingleQuotes": "false"}
NO_NODES = "array<struct<path:array<int>,text:string>>"


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(kind(v), F.lit("ARRAY")), F.lit(False))


def object_or_null(v: Column) -> Column:
    return F.when(is_object(v), v)


def raw_string(v: Column, path: str) -> Column:
    """A JSON string as it is; null for other types and for blank text."""
    text = F.try_variant_get(v, path, "string")
    return F.when((kind(member(v, path)) == "STRING") & (trim_ws(text) != ""), text)


def string(v: Column, *paths: str) -> Column:
    """First non-blank JSON string of the paths, trimmed."""
    return F.coalesce(*[not_blank(trim_ws(raw_string(v, p))) for p in paths])


def number(v: Column, *paths: str) -> Column:
    """First finite number of the paths: a JSON number, or text that reads as one."""

    def one(path: str) -> Column:
        k = kind(member(v, path))
        return F.when(k == "STRING", parse_number(F.try_variant_get(v, path, "string"))).when(
            k.rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double")
        )

    return F.coalesce(*[one(p) for p in paths])


def elements(text: Column) -> Column:
    return F.from_json(text, "array<string>", STRICT)


def members(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", STRICT)


def _opens(text: Column, bracket: str) -> Column:
    return F.startswith(F.ltrim(text), F.lit(bracket))


def _child_nodes(nodes: Column) -> Column:
    """Objects and arrays one level down that still mention a list, in document order."""

    def children(node: Column) -> Column:
        values = F.when(_opens(node["text"], "["), elements(node["text"])).otherwise(F.map_values(members(node["text"])))
        placed = F.transform(
            values, lambda t, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), t.alias("text"))
        )
        return F.filter(
            placed,
            lambda x: F.coalesce((_opens(x["text"], "{") | _opens(x["text"], "[")) & F.contains(x["text"], F.lit("ItemList")), F.lit(False)),
        )

    return F.flatten(F.transform(nodes, lambda n: F.coalesce(children(n), F.array().cast(NO_NODES))))


def _lists_at(nodes: Column) -> Column:
    def entries(node: Column) -> Column:
        fields = members(node["text"])
        items = F.element_at(fields, F.lit("itemListElement"))
        hit = _opens(node["text"], "{") & (F.element_at(fields, F.lit("@type")) == "ItemList") & _opens(items, "[")
        listed = F.filter(
            F.transform(elements(items), lambda t, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), t.alias("text"))),
            lambda x: F.coalesce(_opens(x["text"], "{"), F.lit(False)),
        )
        return F.when(F.coalesce(hit, F.lit(False)), listed).otherwise(F.array().cast(NO_NODES))

    return F.flatten(F.transform(nodes, entries))


def _most_levels(nodes: Column) -> Column:
    """No node can lie deeper than there are opening brackets in its script."""
    brackets = F.transform(nodes, lambda n: F.length(n["text"]) - F.length(F.translate(n["text"], "[{", "")))
    return F.coalesce(F.array_max(brackets), F.lit(0))


def with_item_list_elements(df: DataFrame, html: str, out: str) -> DataFrame:
    """Elements of every ``ItemList`` of the page's JSON-LD, at any nesting, in document order.

    The walk goes down level by level inside the page's row, over those nodes only that mention a list, until none is left:
    a deep page costs its own levels and no other page any. Spark's JSON reader reads up to 1,000
    levels; a script nested deeper than that is not JSON to it and holds no list.
    """
    scripts = F.filter(all_matches(F.col(html), JSON_LD), lambda t: F.try_parse_json(t).isNotNull())
    level = F.transform(scripts, lambda t, i: F.struct(F.array(i).alias("path"), t.alias("text")))
    walked = df.withColumn("_top", F.filter(level, lambda n: F.contains(n["text"], F.lit("ItemList"))).cast(NO_NODES))
    state = f"struct<nodes:{NO_NODES},found:{NO_NODES}>"

    def step(at: Column, _: Column) -> Column:
        below = F.struct(_child_nodes(at["nodes"]).alias("nodes"), F.concat(at["found"], _lists_at(at["nodes"])).alias("found"))
        # once no node is left, the levels that the bound still allows cost nothing
        return F.when(F.size(at["nodes"]) > 0, below.cast(state)).otherwise(at)

    levels = F.least(F.lit(1000), _most_levels(F.col("_top")))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.col("_top").alias("nodes"), F.array().cast(NO_NODES).alias("found")).cast(state)
    found = F.aggregate(steps, start, step, lambda at: F.transform(F.array_sort(at["found"]), lambda x: x["text"]))
    return walked.withColumn(out, found).drop("_top")
