"""The SQL functions, called through ``spark.sql``, checked like the queries they mirror."""

from __future__ import annotations

from larder.functions import sql
from larder.plans.registry import ORACLES, query


def _called(src, text: str, **frames):
    sql.register(src.spark)
    return src.spark.sql(text, **frames)


@query("u1_sql_canonical_url", ORACLES["u1_identity_key_links"])
def _(src):
    return _called(src, "SELECT id, larder_canonical_url(url) AS identity_key FROM {rows}", rows=src("links_v"))


@query("q1_sql_parse_quantity", ORACLES["q1_parse_quantity"])
def _(src):
    return _called(src, "SELECT recipe_id, line_no, part_id, supp_id, price, larder_parse_quantity(quantity) AS amount FROM {rows}",
                   rows=src("lines_v"))


@query("q2_sql_format_quantity", ORACLES["q2_format_quantity"])
def _(src):
    return _called(src, """SELECT recipe_id, line_no, part_id, supp_id, price, larder_format_quantity(a * 1D / 7) AS sevenths,
        larder_format_quantity(a * 2.5D) AS scaled FROM (SELECT *, larder_parse_quantity(quantity) AS a FROM {rows})""", rows=src("lines_v"))


@query("t1_sql_normalised_documents", ORACLES["t1_normalised_documents"])
def _(src):
    return _called(src, "SELECT doc_id, larder_normalise_text(text) AS text FROM {rows}", rows=src("documents"))


@query("x1_sql_document_scores", ORACLES["x1_document_scores"])
def _(src):
    return _called(src, """SELECT doc_id, floor(raw * 100 + 0.5D) / 100 AS score, raw >= 4D AS is_recipe
        FROM (SELECT doc_id, larder_score(text) AS raw FROM {rows})""", rows=src("documents"))
