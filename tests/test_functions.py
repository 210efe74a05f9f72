import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidName, InvalidSelect
from docweave.functions import documents as d
from docweave.functions import naming as n


def test_roles_by_name():
    s = n.classify(T.StructType().add("pk_post", "long").add("id", "string").add("identifier", "string").add("fk_user", "long").add("user_id", "string").add("tags", T.ArrayType(T.StringType())).add("data", "string"))
    assert (s.entity, s.pk, s.id, s.identifier, s.data, s.fks, s.uuid_fks) == ("post", "pk_post", "id", "identifier", "data", ("fk_user",), ("user_id",))
    assert s.extra == {"tags": "array<string>"}


def test_names_and_paths():
    assert n.path_steps("a.b[0].c") == ["a", "b", 0, "c"]
    for bad in ("", "a..b", "a[", "a[-1]", "a b", "x" * 501, ".".join("a" * 102)):
        with pytest.raises(InvalidName):
            n.path_steps(bad)
    for bad in ("", "1a", "a;b", "a" * 64, 'a"b'):
        with pytest.raises(InvalidName):
            n.checked_identifier(bad)
    assert n.view_of_fk("fk_user") == "v_user" and n.view_of_fk("fk_") is None and n.entity_of_table("tb_x") == "x" and n.entity_of_table("x") is None


def test_ctas():
    assert n.ctas_header("create table app.tv_x  AS\n select 1;") == ("tv_x", "select 1")
    assert n.ctas_header("CREATE TABLE other AS SELECT 1") is None
    with pytest.raises(InvalidSelect):
        n.ctas_header("CREATE TABLE tv_x AS WITH a AS (SELECT 1) SELECT * FROM a")


def test_dynamic_documents():
    doc = {"a": {"b": {"x": 1, "y": 2}}, "items": [{"id": 1, "v": "p"}, {"id": "1", "v": "q"}, {"id": 2}]}
    assert d.patch_nested(doc, {"y": None, "z": 3}, "a.b")["a"]["b"] == {"x": 1, "y": None, "z": 3}
    assert d.patch_nested(doc, {"q": 1}, "n.m")["n"] == {"m": {"q": 1}}
    assert d.patch_array(doc, {"id": "1", "v": "new"}, "items")["items"] == [{"id": 1, "v": "p"}, {"id": "1", "v": "new"}, {"id": 2}]
    assert d.patch_array(doc, {"id": 9}, "items") == doc and d.patch_array(doc, {"id": 9}, "a") == doc
    assert [e["id"] for e in d.array_insert({"i": [{"id": 3}, {"id": 1}]}, "i", {"id": 2}, "id", True)["i"]] == [3, 2, 1]
    assert d.array_delete(doc, "items", "id", 1)["items"] == [{"id": "1", "v": "q"}, {"id": 2}]
    assert d.array_contains(doc, "items", "id", 2) and not d.array_contains(doc, "items", "id", True) and not d.array_contains(doc, "none", "id", 2)
    assert d.array_update_path(doc, "items", "id", 2, "m.n", 5)["items"][2] == {"id": 2, "m": {"n": 5}}
    assert d.array_update_batch(doc, "items", "id", [{"id": 1, "w": 1}, {"id": 2, "w": 2}])["items"] == [{"id": 1, "v": "p", "w": 1}, {"id": "1", "v": "q"}, {"id": 2, "w": 2}]
    assert d.array_update_batch(doc, "items", "id", []) == doc
    assert d.set_path({}, "a.b.c", 1) == {"a": {"b": {"c": 1}}} and d.set_path(doc, "items[2].id", 7)["items"][2]["id"] == 7
    assert d.extract_id({"id": "u-1"}) == "u-1" and d.extract_id({"id": 5}) == "5" and d.extract_id({}) is None
    assert doc["items"][2] == {"id": 2}


def test_json_column(spark):
    df = spark.createDataFrame([('{"a":1}',), (None,), ('{"ü":"\\n"}',)], "t string")
    got = [r[0] for r in df.select(d.on_json(d.set_path, "b.c", 2)("t")).collect()]
    assert got == ['{"a":1,"b":{"c":2}}', None, '{"ü":"\\n","b":{"c":2}}']


def test_typed_documents(spark):
    df = spark.sql("SELECT array(named_struct('id', 1, 'v', 'a'), named_struct('id', 1, 'v', 'b'), named_struct('id', CAST(NULL AS INT), 'v', 'c')) AS x, CAST(NULL AS ARRAY<STRUCT<id: INT, v: STRING>>) AS none")
    x = F.col("x")
    row = df.select(
        d.patch_element(x, "id", F.lit(1), {"v": F.lit("z")}).alias("p"), d.delete_elements(x, "id", F.lit(1)).alias("q"), d.contains_element(x, "id", F.lit(2)).alias("r"),
        d.contains_element(F.col("none"), "id", F.lit(2)).alias("s"), d.patch_element(F.col("none"), "id", F.lit(1), {"v": F.lit("z")}).alias("t"), d.to_text(F.struct(F.lit(None).cast("int").alias("k"))).alias("u"),
    ).first()
    assert [e.v for e in row.p] == ["z", "b", "c"] and [e.v for e in row.q] == ["c"]
    assert row.r is False and row.s is False and row.t is None and row.u == '{"k":null}'
