"""Link hygiene jobs: identity, classification, deduplication, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import urls as U
from larder.operators.keyed import attach, pin, spread_lookup
from larder.session import materialise
from larder.session import materialise


def with_identity_key(rows: DataFrame, url: str = "url", key: str = "identity_key") -> DataFrame:
    return pin(rows.withColumn(key, U.canonical_url(F.col(url))))


def classify_links(rows: DataFrame, url: str = "url") -> DataFrame:
    c = F.col("_c")
    return pin(rows.withColumn("_c", U.classify(F.col(url)))).select(
        *rows.columns, c["ok"].alias("ok"), c["platform"].alias("platform"),
        c["canonical_url"].alias("canonical_url"), c["host"].alias("host"),
        c["id"].alias("post_id"), c["reason"].alias("reason"))


def split_unsafe(rows: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    judged = classify_links(rows, url)
    return judged.where("ok").drop("reason"), judged.where(~F.col("ok"))


def unique_by_identity(rows: DataFrame, key: str, row_id: str, *first: str) -> DataFrame:
    """One row per identity key, the earliest; rows without a key are never merged.

    Only keys and ids are aggregated and compared; the few rows that lose are
    written down and taken out by id, so the wide rows are neither sorted nor
    shuffled while the losers fit a broadcast.
    """
    narrow = rows.where(F.col(key).isNotNull()).select(key, row_id, *first)
    winners = narrow.groupBy(key).agg(
        F.min_by(row_id, F.struct(*first, row_id)).alias("_winner"), F.count("*").alias("_n"))
    shared = attach(narrow.select(key, row_id), winners.where("_n > 1"), [key], "_n")
    losers = materialise(shared.where(F.col("_winner") != F.col(row_id)).select(row_id), "losers")
    return rows.join(losers, row_id, "left_anti").select(*rows.columns)


def link_to_winner(rows: DataFrame, key: str, row_id: str, *first: str) -> DataFrame:
    """Every row with the id of the row that stands for its identity key."""
    winners = rows.groupBy(key).agg(
        F.min_by(row_id, F.struct(*first, row_id)).alias("_winner"), F.count("*").alias("_n"))
    linked = attach(rows, winners, [key], "_n")
    return linked.select(
        *rows.columns, F.coalesce("_winner", row_id).alias("winner_id")).withColumn(
        "is_winner", F.col("winner_id") == F.col(row_id))


def already_saved(links: DataFrame, saved: DataFrame, row_id: str, url: str, key: str, saved_url: str,
                  how: str = "left_semi") -> DataFrame:
    """Links whose identity key or raw spelling is stored (``left_anti``: is not), told apart by ``row_id``.

    Both spellings become rows of one column, so this is one equi join rather
    than a join on ``a OR b``, which Spark can only run as a nested loop.
    """
    stored = saved.select(F.col(saved_url).alias("_seen")).where(
        F.col("_seen").isNotNull()).distinct()
    probes = links.select(row_id, F.explode(F.array_distinct(F.array(key, url))).alias("_seen"))
    hits = probes.where(F.col("_seen").isNotNull()).join(stored, "_seen", "left_semi").select(row_id).distinct()
    return links.join(hits, row_id, how)


def save_if_absent(new: DataFrame, saved: DataFrame, key: str, url: str, row_id: str, saved_key: str,
                   saved_id: str, *first: str) -> DataFrame:
    """Each new row with the id it is stored under and whether it creates that id.

    A stored row beats every new one, be it stored under the identity or under
    the spelling in which one of the rows of that identity was submitted; among
    new rows the earliest wins. The new rows are read three times and are stored first:
    they are mostly the outcome of costly column functions.
    """
    new = materialise(new, "to-save")
    known = saved.where(F.col(saved_key).isNotNull()).groupBy(
        F.col(saved_key).alias("_seen")).agg(F.min(saved_id).alias("_id"))
    spellings = new.where(F.col(key).isNotNull()).select(
        key, F.explode(F.array_distinct(F.array(key, url))).alias("_seen")).distinct()
    stored = spellings.join(known, "_seen").groupBy(key).agg(F.min("_id").alias("_stored"))
    winners = new.groupBy(key).agg(
        F.min_by(row_id, F.struct(*first, row_id)).alias("_winner"), F.count("*").alias("_n"))
    facts = winners.join(stored, key, "left")
    joined = attach(new, facts, [key], "_n")
    return joined.select(
        *new.columns,
        F.coalesce("_stored", "_winner", F.col(row_id)).alias("saved_as"),
        (F.col("_stored").isNull() & (F.coalesce("_winner", row_id) == F.col(row_id))).alias("created"))


def resolve_shares(links: DataFrame, redirects: DataFrame, url: str = "url") -> DataFrame:
    """Follow share tokens through a redirect table and key on the real post.

    Accepted links with a known id pass straight through. An accepted social
    link without one needs a redirect to a post of the same platform; otherwise
    it is rejected.
    """
    # Stored, as it is read for the hot keys, for the join and for the links without a key.
    judged = materialise(classify_links(links, url).where("ok").drop("ok", "reason", "host"), "judged-links")
    # A link that is listed twice is followed to one place.
    targets = redirects.groupBy(F.col("url").alias("canonical_url")).agg(F.min("final_url").alias("_final")).select(
        "canonical_url", U.classify(F.col("_final")).alias("_t"))
    joined = spread_lookup(judged, targets, "canonical_url")
    t = F.col("_t")
    needs = F.col("post_id").isNull() & (F.col("platform") != "web")
    found = F.coalesce(
        t["ok"] & (t["platform"] == F.col("platform")) & t["id"].isNotNull(), F.lit(False))
    final_url = F.when(needs, F.when(found, t["canonical_url"])).otherwise(F.col("canonical_url"))
    return joined.select(
        *links.columns, "platform",
        F.when(needs & found, t["id"]).otherwise(F.col("post_id")).alias("post_id"),
        U.canonical_url(final_url).alias("identity_key"),
        (needs & ~found).alias("unresolved"))


def links_in_messages(messages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per link of a chat message, with its position; a caption counts where there is no text."""
    body = F.coalesce("text", "caption")
    return messages.withColumn("_body", body).select(
        *keep, F.posexplode(U.message_urls(F.col("_body"), F.col("entities"))).alias("pos", "url"))


def links_in_text(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per link found in free text, with its position."""
    return rows.select(*keep, F.posexplode(U.extract_urls(F.col(text))).alias("pos", "url"))


def private_addresses(rows: DataFrame, ip: str = "ip") -> DataFrame:
    return rows.withColumn("is_private", U.is_private_ip(F.col(ip)))
