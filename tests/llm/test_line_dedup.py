import duckdb
import pytest

from larder.llm import line_dedup
from helpers import AWKWARD, SCHEMA, docs, prose, stored

STRIP = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites = {}
    for text, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line.strip(STRIP), set()).add(site)
    out = []
    for text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(STRIP) or len(sites[x.strip(STRIP)]) < min_sites]
        out.append((text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    names = [None, *[f"s{i}" for i in range(11)]]
    rows = [(t, "s0") for t in AWKWARD]
    for i in range(120):
        lines = [prose(i, 6)]
        for spread in range(1, 12):
            if i % 12 < spread:
                lines.append(f"  shared by {spread}\t")
        rows.append(("\n".join([*lines, "", "shared by 3"]), names[i % 12]))
    return rows


@pytest.mark.parametrize("most_sent", [0, line_dedup.MOST_SENT])
@pytest.mark.parametrize("min_sites,band", [(5, line_dedup.BAND), (3, 0.5), (5, 10.0), (1, line_dedup.BAND)])
def test_matches_brute_force(spark, tmp_path, min_sites, band, most_sent):
    rows = corpus()
    df = stored(docs(spark, [t for t, _ in rows], clash=True, source=lambda i: rows[i][1]), tmp_path)
    out = line_dedup.without_spread_lines(df, min_sites=min_sites, band=band, most_sent=most_sent)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())
    assert got == [(i, *b) for i, b in enumerate(brute(rows, min_sites))]


def test_sql_agrees(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = corpus()
    df = stored(docs(spark, [t for t, _ in rows], source=lambda i: rows[i][1]), tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/docs/*.parquet')")
    want = sorted(con.execute(line_dedup.SQL).fetchall())
    got = line_dedup.without_spread_lines(df).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, got.collect())) == want


def test_repeats_and_empty(spark, tmp_path):
    rows = [(1, "x\ny", None, "a", None)] * 6 + [(None, "x", None, None, None)]
    df = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert {r["text"] for r in line_dedup.without_spread_lines(df, min_sites=2).collect()} == {"y", ""}
    assert line_dedup.without_spread_lines(stored(df.limit(0), tmp_path, "none")).count() == 0
