from __future__ import annotations

from test_reads import REG

from mosaiq.plans.jsonschema import argument_schemas


def refs(x):
    if isinstance(x, dict):
        yield from ([x["$ref"]] if "$ref" in x else [])
        for v in x.values():
            yield from refs(v)
    elif isinstance(x, list):
        for v in x:
            yield from refs(v)


def test_export():
    for name in REG.models:
        s = argument_schemas(REG, name)
        assert all(r.removeprefix("#/$defs/") in s["$defs"] for r in refs(s))
    s = argument_schemas(REG, "post")
    assert set(s["$defs"]["user.where"]["properties"]["posts"]["properties"]) == {"some", "every", "none"}
    assert s["data"]["required"] == ["id", "title", "views"] and "increment" in s["changes"]["properties"]["views"]["anyOf"][1]["properties"]
    assert s["$defs"]["post.title"]["additionalProperties"] is False and "nulls" in str(s["order_by"])
