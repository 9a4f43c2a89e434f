"""Templates name the properties of their types."""

import json

from brindle.operators import knowledge


def test_a_template_holds_every_property_of_its_type(spark):
    d = spark.createDataFrame([("A", ["b", 'a "q"']), ("B", [])], "entity_type string, properties array<string>")
    got = {r["entity_type"]: json.loads(r["template"]) for r in knowledge.schema_template(d).collect()}
    assert got["A"] == {"type": "A", "description": "Description for A", "properties": {'a "q"': None, "b": None}, "required": []}
    assert got["B"]["properties"] == {}
