"""Literal input to literal output, per expression."""

import math

import pytest
from pyspark.sql import functions as F

from larder.functions import display as D
from larder.functions import html as H
from larder.functions import ingredients as I
from larder.functions import jsonld as J
from larder.functions import quantity as Q
from larder.functions import scoring as S
from larder.functions import text as T
from larder.functions import urls as U
from larder.operators import catalog as C
from larder.operators import structured as X


def table(cases):
    return [c[0] for c in cases], [c[1] for c in cases]


def test_parse_quantity(apply):
    values, want = table([
        ("1,5", 1.5), ("1 / 2", 0.5), ("2 3/4", 2.75), ("½", 0.5), (" 2 ", 2.0), ("⅓", 1 / 3),
        ("2-3", None), ("a splash", None), ("1 lb", None), ("1/0", None), ("1 1/0", None),
        ("1½", None), ("½½", None), ("", None), (None, None)])
    assert apply(Q.parse_quantity, values) == want


def test_format_quantity(apply):
    values, want = table([
        (0.75, "3/4"), (2.25, "2 1/4"), (4 / 3, "1 1/3"), (2.0, "2"), (0.97, "1"), (0.583, "0.6"),
        (0.0, ""), (-1.0, ""), (math.nan, ""), (math.inf, "")])
    assert apply(Q.format_quantity, values, "v double") == want


def test_format_then_parse_drifts_little(apply):
    values = [n / 7 for n in range(1, 60)]
    back = apply(lambda c: Q.parse_quantity(Q.format_quantity(c)), values, "v double")
    spelled = apply(Q.spelled_value, values, "v double")
    assert all(abs(a - b) < 0.06 for a, b in zip(values, back))
    assert all(abs(a - b) < 1e-9 for a, b in zip(spelled, back))


def test_servings(apply):
    values, want = table([("6-8 tacos", 6), ("Serves 4", 4), ("a crowd", None), ("2.5 cups", 3), ("0", None)])
    assert apply(Q.servings_count, values) == want


def test_identity_key(apply):
    reel = "https://instagram.com/reel/C9dO9AevUQx"
    values, want = table([
        ("https://www.instagram.com/reel/C9dO9AevUQx/?igsh=abc", reel), (" https://m.instagram.com/reel/C9dO9AevUQx#c ", reel),
        ("https://mobile.instagram.com/reel/C9dO9AevUQx///", reel),
        ("https://m.youtube.com/watch?v=abc&t=4", "https://youtube.com/watch?v=abc"),
        ("https://blog.example.com/?p=123&utm_source=ig", "https://blog.example.com?p=123"),
        ("https://example.com/r?reference=7", "https://example.com/r?reference=7"),
        ("https://example.com:8443/r", "https://example.com:8443/r"), ("http://example.com:80/r", "http://example.com/r"),
        ("https://example.com/r?b=1&a=2&a=1", "https://example.com/r?a=2&a=1&b=1"), ("https://EXAMPLE.com/", "https://example.com"),
        ("ftp://example.com/x", None), ("not a url", None), ("", None), (None, None)])
    assert apply(U.canonical_url, values) == want
    keyed = [k for k in want if k]
    assert apply(U.canonical_url, keyed) == keyed


def test_classify(apply):
    cases = [
        ("https://www.instagram.com/share/reel/xyz12/", ("instagram", None)),
        ("instagram.com/user/reels/C9dO9AevUQx", ("instagram", "C9dO9AevUQx")),
        ("https://youtu.be/abcdefghijk?si=1", ("youtube", "abcdefghijk")),
        ("https://www.youtube.com/shorts/abcdefghijk", ("youtube", "abcdefghijk")),
        ("https://www.tiktok.com/@u/video/7123456789", ("tiktok", "7123456789")),
        ("https://vm.tiktok.com/ZMabc/", ("tiktok", None)), ("http://example.com/r?utm_source=x", ("web", None)),
        ("file:///etc/passwd", None), ("https://a:b@example.com", None), ("https://example.com:8080", None),
        ("http://localhost/", None), ("http://printer.lan/", None), ("http://host/", None), ("", None)]
    got = apply(U.classify, [c[0] for c in cases])
    assert [(g["platform"], g["id"]) if g["ok"] else None for g in got] == [c[1] for c in cases]
    assert got[6]["canonical_url"] == "https://example.com/r"
    assert all((g["reason"] is None) == g["ok"] for g in got)


def test_extract_urls(apply):
    got = apply(U.extract_urls, ["see (https://a.com/x). and http://b.com/?q=1, https://a.com/x", "none"])
    assert got == [["https://a.com/x", "http://b.com/?q=1"], []]


@pytest.mark.parametrize("ip,private", [
    ("10.0.0.1", True), ("172.15.255.255", False), ("172.16.0.0", True), ("172.31.255.255", True), ("172.32.0.0", False),
    ("100.63.255.255", False), ("100.64.0.0", True), ("100.127.255.255", True), ("100.128.0.0", False), ("192.0.77.1", True),
    ("8.8.8.8", False), ("224.0.0.1", True), ("::1", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False),
    ("fe80::1", True), ("2001:db8::1", False), ("example.com", True)])
def test_private_ip(apply, ip, private):
    assert apply(U.is_private_ip, [ip]) == [private]


CAPTION = """Crispy tacos, the ones you keep asking for!

INGREDIENTS
- 1 lb shrimp, peeled and deveined
- 1 cup flour
- 1/2 tsp cayenne
- 8 corn tortillas

METHOD
1. Combine the flour and spice.
2. Fry, drain and serve.
#tacos #dinner"""


def test_score(apply):
    got = apply(lambda c: S.raw_score(c), [
        CAPTION, "You asked\n\nFull recipe is in my bio!! Link in bio go get it now\n#food", "Best tacos I have had, no notes. The room is gorgeous.", "", None, "yum 🔥"])
    assert got[0] > 6 and got[1] < 4 and got[2] < 4 and got[3:] == [0.0, 0.0, 0.0]


def test_accented_verb_uses_ascii_boundary(apply):
    pad = " filler words that make the text long enough"
    assert apply(S.distinct_verbs, ["sauté" + pad, "sautéing" + pad, "saute" + pad]) == [0, 1, 1]


def test_ingredient_lines(apply):
    values, want = table([
        ("1 lb shrimp, peeled and deveined", ("1", "lb", "shrimp", "peeled and deveined")),
        ("2 large eggs", ("2", None, "large eggs", None)), ("2 cups of vegetable oil", ("2", "cups", "vegetable oil", None)),
        ("1½ tbsp. olive oil (extra virgin)", ("1 ½", "tbsp", "olive oil", "extra virgin")),
        ("2 to 3 cloves garlic", ("2-3", "cloves", "garlic", None)), ("salt &amp; pepper", (None, None, "salt & pepper", None)),
        ("- 200g flour", ("200", "g", "flour", None)), ("", None)])
    assert [tuple(r) if r else None for r in apply(I.parse_ingredient_line, values)] == want


def test_durations(apply):
    values, want = table([("PT1H30M", 90), ("P1D", 1440), ("PT1M30S", 2), ("P0DT0H45M", 45), ("PT0M", None), ("soon", None), (None, None)])
    assert apply(J.duration_minutes, values) == want


def test_entities(apply):
    values, want = table([
        ("&#128293;", "🔥"), ("&#x26;#65;", "A"), ("&amp;lt;", "&lt;"), ("&EACUTE;&foo;", "é&foo;"), ("&#55296;x", "x"),
        ("&#99999999999;x", "x"), ("a & b", "a & b"), ("&frac12;", "½"), (None, None)])
    assert apply(H.decode_entities, values) == want


def test_html_text(apply):
    values, want = table([
        ("<p>a<script>x</script>b</p>c", "a b\nc"), ("a<aside>never closed", "a"), ("x<!-- y -->z", "x z"),
        ("<ul><li>one</li><li>two</li></ul>", "- one\n\n- two"), ("a<br>b<BR/>c", "a\nb\nc"), ("a < b", "a < b"), ("<nav>x</nav y>z", "z")])
    assert apply(H.html_to_text, values) == want


def test_embed(apply):
    page = ('<div class="Caption"><a class="CaptionUsername" href="/x">cook</a><br/>Rice by &#064;me<br>1 cup'
            '<div class="CaptionComments">View all 3 comments</div></div>')
    assert apply(H.embed_caption, [page, "<html>shell</html>"]) == ["Rice by @me\n1 cup", None]


def test_text_lists(apply):
    assert apply(T.tag_list, ["taco, weeknight , Taco,,"]) == [["taco", "weeknight"]]
    assert apply(T.step_list, ["1. a\n2) b\r\n- c\n\n"]) == [["a", "b", "c"]]
    assert apply(lambda c: T.cap(c, 5), ["abcdef", "abcde", "abc def"]) == ["abcd…", "abcde", "abc…"]


def test_hash_and_initials(apply):
    assert apply(D.fnv1a, ["abc", ""]) == [440920331, 2166136261]
    assert apply(D.monogram_initials, ["Crispy Shrimp Tacos", "Ragù", "", "15-minute Ramen"]) == ["CS", "RA", "?", "1M"]
    assert apply(D.monogram_initials, ["Kőleves pörkölt", "Re\u0301gi Étel", "phở bò", "日本"]) == ["KP", "RE", "PB", "?"]
    # By UTF-16 units: an emoji counts as two.
    assert apply(D.fnv1a, ["🍰", ""]) == [2167330257, 2166136261]


def test_parse_limit():
    assert [C.parse_limit(x) for x in (None, "", "10", "999")] == [50, 50, 10, 200]
    for bad in ("0", "-3", "abc"):
        with pytest.raises(ValueError):
            C.parse_limit(bad)


def page(spark, *blocks):
    html = "".join(f"<script type='application/ld+json'>{b}</script>" for b in blocks)
    return spark.createDataFrame([(1, html)], "page_id int, html string")


def recipe(spark, *blocks):
    return X.extract_recipes(page(spark, *blocks)).collect()


BODY = '"name":"Rice","recipeIngredient":["1 cup rice"]'


@pytest.mark.parametrize("block,found", [
    ('{"@type":"Recipe",%s}' % BODY, True), ('[{"@type":"Person"},{"@type":"Recipe",%s}]' % BODY, True),
    ('{"@graph":[{"@type":["Article","recipe"],%s}]}' % BODY, True), ('{"mainEntity":{"mainEntityOfPage":{"@type":"Recipe",%s}}}' % BODY, True),
    ('<![CDATA[{"@type":"Recipe",%s}]]>' % BODY, True), ('{"@type":"Recipe","name":"Only a name"}', False), ('{"@type":"Article",%s}' % BODY, False),
    ('{"@type":"Recipe","name":null,"headline":"H","recipeIngredient":["x"]}', True)])
def test_recipe_discovery(spark, block, found):
    assert bool(recipe(spark, "{ broken", block)) == found


def test_first_recipe_in_document_order(spark):
    block = '{"@graph":[{"@type":"X","hasPart":{"@type":"Recipe","name":"A","recipeIngredient":["x"]}},{"@type":"Recipe",%s}]}' % BODY
    assert recipe(spark, block)[0]["title"] == "A"


@pytest.mark.parametrize("value,steps", [
    ('"1. Boil water<br>2) Add pasta\\nok"', ["Boil water", "Add pasta"]),
    ('[{"@type":"HowToStep","text":"Mix."},"Bake it"]', ["Mix.", "Bake it"]),
    ('[{"@type":"HowToSection","name":"Prep","itemListElement":[{"text":"Chop."}]},{"name":"Serve."}]', ["Chop.", "Serve."])])
def test_instructions(spark, value, steps):
    got = recipe(spark, '{"@type":"Recipe","name":"R","recipeInstructions":%s}' % value)
    assert got[0]["steps"] == steps


def test_legacy_instruction_collapse(spark):
    df = spark.createDataFrame([("\"1. Boil water\\n2. Serve\"",)], "j string").select(F.parse_json("j").alias("node"))
    assert X.instruction_steps(df, "node", legacy_collapse=True).first()["steps"] == ["Boil water 2. Serve"]


def test_score_counts_all_white_space_alike(apply):
    plain = "2 cups flour, 1 1/2 tsp salt, 3 cloves garlic and 4 slices of bread. Mix, bake and serve."
    thin = plain.replace("2 cups", "2\u2009cups").replace("1 1/2 tsp", "1\u20091/2\u2009tsp").replace("3 cloves", "3\u3000cloves")
    from larder.functions import scoring

    scores = apply(scoring.raw_score, [plain, thin])
    assert scores[0] == scores[1] > 3


def test_published_tables_are_read_at_one_version(spark, tmp_path):
    from larder.sources import sinks

    root, one = str(tmp_path / "root"), spark.range(1)
    sinks.publish_tables({"a": one, "b": one}, root)
    sinks.publish_tables({"a": spark.range(2), "b": spark.range(3)}, root)
    now = sinks.read_published(spark, root, "a", "b")
    assert (now["a"].count(), now["b"].count()) == (2, 3)
    sinks.publish_tables({"a": spark.range(4)}, root)
    with pytest.raises(KeyError):
        sinks.read_published(spark, root, "a", "b")
    assert set(sinks.read_published(spark, root)) == {"a"}


def test_equal_submissions_are_told_apart_by_their_id(spark):
    from larder.operators import links as K

    rows = spark.createDataFrame([("k", "u", 1), ("k", "u", 2), (None, "raw", 3), (None, None, 4)], "key string, url string, id int")
    saved = spark.createDataFrame([("k",), ("raw",)], "source string")
    for how, want in (("left_semi", [1, 2, 3]), ("left_anti", [4])):
        got = K.already_saved(rows, saved, "id", "url", "key", "source", how)
        assert sorted(r["id"] for r in got.collect()) == want


def test_places_over_all_partitions(spark):
    from pyspark.sql import functions as F

    from larder.operators.ordered import numbered

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    got = numbered(rows, [F.asc("h"), F.asc("id")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert [r["h"] for r in got] == sorted(r["h"] for r in got)
