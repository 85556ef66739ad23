"""Lists of JSON-LD at any depth, beside broken and flat scripts."""

import json

from roost.functions.json import with_item_list_elements

LD = '<script type="application/ld+json">{}</script>'


def listed(*names):
    return {"@type": "ItemList", "itemListElement": [{"name": n} for n in names]}


def wrapped(node, levels):
    for i in range(levels):
        node = {"other": [{"x": "[{["}], "part": node} if i % 2 else [node, "ItemList"]
    return node


def test_any_depth_in_document_order(spark):
    both = {"a": wrapped(listed("deep"), 30), "b": listed("flat"), "c": [listed("x", "y"), wrapped(listed("z"), 3)]}
    pages = {
        "flat": (LD.format(json.dumps(listed("1", "2"))), ["1", "2"]),
        "deep": (LD.format(json.dumps(wrapped(listed("1"), 12))) + LD.format(json.dumps(listed("2"))), ["1", "2"]),
        "deeper": (LD.format(json.dumps(wrapped(listed("1", "2"), 200))), ["1", "2"]),
        "mixed": (LD.format(json.dumps(both)), ["deep", "flat", "x", "y", "z"]),
        "list in list": (LD.format(json.dumps({"@type": "ItemList", "itemListElement": [{"name": "o", "sub": listed("i")}]})), ["o", "i"]),
        "beyond the reader": (LD.format("[" * 1500 + json.dumps(listed("1")) + "]" * 1500) + LD.format(json.dumps(listed("2"))), ["2"]),
        "broken": (LD.format('{"@type":"ItemList","itemListElement":[{') + LD.format("{}"), []),
        "none": ("<p>ItemList</p>", []),
        "null": (None, None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in pages.items()], "k string, html string")
    for r in with_item_list_elements(rows, "html", "found").collect():
        found = None if r.found is None else [json.loads(t)["name"] for t in r.found]
        assert (found or []) == (pages[r.k][1] or []), r.k
