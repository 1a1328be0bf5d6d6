"""Texts deep inside untrusted JSON: each value is read once, whatever its depth."""

import time

import pytest
from pyspark.sql import functions as F

from larder.functions import jsonld as J
from larder.operators import structured as S
from larder.session import ship_package

LD = '<script type="application/ld+json">%s</script>'


def page(node: str) -> str:
    return LD % f'{{"@type":"Recipe",{node},"recipeIngredient":["2 cups flour"]}}'


def extracted(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string").repartition(8)
    return {r["page_id"]: r for r in S.extract_recipes(df).collect()}


def test_time_follows_the_length_of_a_text_not_its_depth(spark):
    deep = page('"name":' + '[{"@value":null,"name":' * 480 + '"Soup"' + "}]" * 480)
    flat = page('"name":"' + "Soup " * 500 + '"')
    extracted(spark, flat, deep)
    taken = []
    for html in (flat, deep):
        start = time.time()
        got = extracted(spark, *[html] * 3000)
        taken.append(time.time() - start)
        assert len(got) == 3000 and {r["title"].split()[0] for r in got.values()} == {"Soup"}
    assert taken[1] < 4 * taken[0] + 5


@pytest.mark.parametrize("name, title", [
    ('"\\ud83c\\udf70 cake"', "\U0001f370 cake"), ('["a","b\\ud800c"]', "a, b?c"), ('["a", 7.0, true, null, [], {"x":1}, -0, 1.5e2, 0.25]', "a, 7, 0, 150, 0.25"),
    ('[123456789012345678, 1e20, 1E-7]', "1.2345678901234568E17, 1.0E20, 1.0E-7"),
    ('{"url":"u","name":["n", {"text":{"@value":"t"}}],"@value":null}', "n, t"), ('{"@value":"","name":"no"}', None), ("[" * 900 + '"x"' + "]" * 900, "x")])
def test_texts_of_a_node(spark, name, title):
    found = extracted(spark, page(f'"name":{name}'))
    assert (found[0]["title"] if found else None) == title


def test_the_node_is_found_by_its_path(spark):
    nested = '{"@graph":[{"@type":"WebSite","name":"s"},{"mainEntity":[[{"@type":"Recipe","name":["Soup"],"ingredients":[{"name":"salt"},["a","b"],3,{}]}]]}]} junk'
    (got,) = extracted(spark, LD % "{ broken" + LD % nested + page('"name":"later"')).values()
    assert got["title"] == "Soup"
    assert [(i["quantity"], i["item"], i["note"]) for i in got["ingredients"]] == [(None, "salt", None), (None, "a", "b")]


def test_unwrapped_values(spark):
    ship_package(spark)
    values = ['"a"', "12.50", "true", "null", '["a",["b",{"text":"c"}]]', '{"x":1}', None]
    df = spark.createDataFrame([(values,), (None,)], "v array<string>").coalesce(1)
    got = df.select(J.unwrapped(F.transform("v", lambda j: F.try_parse_json(j)), J.TEXT_KEYS).alias("t")).collect()
    assert [r["t"] for r in got] == [[["a"], ["12.5"], [], [], ["a", "b", "c"], [], []], None]


def test_a_task_gets_a_bounded_number_of_pages(spark, tmp_path, monkeypatch):
    from larder.sources import tables

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tables, "ROWS_DEALT", 10)
    rows = tables.read_table(spark, str(tmp_path), "orders", True)
    assert rows.rdd.getNumPartitions() >= 100 and rows.count() == 1000
