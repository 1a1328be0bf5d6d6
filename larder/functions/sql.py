"""The column functions of one expression as SQL functions: ``register(spark)``, then ``SELECT larder_score(text)``.

Each is a temporary function of the session whose body is the very expression that the
column function builds, so SQL and DataFrame code cannot drift apart and Catalyst sees
the same plan for both.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larder.functions import quantity, scoring, text, urls

# Name, parameter type and column function.
FUNCTIONS = {
    "larder_canonical_url": ("STRING", urls.canonical_url),
    "larder_parse_quantity": ("STRING", quantity.parse_quantity),
    "larder_format_quantity": ("DOUBLE", quantity.format_quantity),
    "larder_normalise_text": ("STRING", text.normalise_text),
    "larder_score": ("STRING", scoring.raw_score),
}
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
# Operators are functions with a name of their own, which SQL wants quoted.
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|=|<|>|\+|-|\*|/|%|!|&|\||\^|~|and|or|in|not|div)\(")
# Numbers with a point are doubles, which bare SQL text would read as decimals.
_DOUBLE = re.compile(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")
_INFINITE = re.compile(r"\bInfinity\b")


def _readable(code: str) -> str:
    code = _DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", code))
    return _INFINITE.sub("CAST('Infinity' AS DOUBLE)", code)


def sql_text(column: Column) -> str:
    """A column expression as text that the SQL parser reads back."""
    out, at, node = [], 0, column._jc.node().sql()
    for literal in _LITERAL.finditer(node):
        out += [_readable(node[at:literal.start()]), literal[0]]
        at = literal.end()
    return "".join([*out, _readable(node[at:])])


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for name, (kind, function) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value {kind}) RETURN {sql_text(function(F.col('value')))}")
    return list(FUNCTIONS)
