"""Queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import leaks, linkage, names, packing, spans
from matchlake.session import table


def _persons(spark: SparkSession, sf: str) -> DataFrame:
    """(id, person) of each imported_player row, by nothing but how the names are written and the country."""
    players = table(spark, sf, "imported_player")
    linked = names.link_names(players.select(F.lit("row").alias("source"), F.col("player_row_id").alias("id"), "name", "country"))
    return linked.select(F.col("id").cast("bigint").alias("id"), "person")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.pairs_of(_persons(spark, sf)).select(F.col("a").alias("player_row_id_a"), F.col("b").alias("player_row_id_b"))


def p2_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with the smallest row of its person and its number of rows."""
    linked = _persons(spark, sf).distinct()
    sizes = linked.groupBy("person").agg(F.min("id").alias("first_row_id"), F.count("*").alias("person_rows"))
    return linked.join(sizes, "person").select(F.col("id").alias("player_row_id"), "first_row_id", "person_rows")


def p4_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with their identity and the confidence of the match."""
    candidates, identities = table(spark, sf, "player_candidate"), table(spark, sf, "player_identity")
    left = candidates.select(F.col("candidate_id").alias("id"), F.array_compact(F.array("original_name")).alias("names"), "country", "birth_date")
    spelled = F.array_compact(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    right = identities.select("id", spelled.alias("names"), "country", "birth_date")
    found = linkage.match(left, right)
    return found.select(F.col("left_id").cast("bigint").alias("candidate_id"), F.col("right_id").alias("identity_id"), "confidence")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_matches(spark, sf).select("candidate_id", "identity_id")


def p7_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence and position of every document."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many sequences there are by their number of texts, and how full they are."""
    placed = p7_sequences(spark, sf).where(F.col("sequence_id").isNotNull())
    each = placed.groupBy("sequence_id").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))
    return each.groupBy("texts").agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * packing.CAPACITY)).alias("fill"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_by_item(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks_by_item(_leaks(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf, "documents"))


def p9_shared(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document also stands elsewhere."""
    return spans.shared_share(table(spark, sf, "documents"))


def p9_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each document that shares a passage: its class of equal texts and how many others it shares one with."""
    return spans.shared_links(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_persons, p4_found, p4_matches, p7_sequences, p7_fill, p8_found, p8_by_item, p9_found, p9_shared, p9_links)}
# Every window of 300 characters of every document, compared as text.
_SPANS = """with w as (select doc_id, unnest(range(1, length(text) - 298)) s, text from documents where length(text) >= 300),
g as (select distinct doc_id, substr(text, s, 300) x from w), r as (select x from g group by x having count(*) > 1), m as (select g.* from g join r using (x))"""
ORACLE = {
    "p9_found": f"{_SPANS} select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from m a join m b on a.x = b.x and a.doc_id < b.doc_id",
    "p9_links": f"""{_SPANS}, l as (select a.doc_id, count(distinct b.doc_id) links from m a join m b on a.x = b.x and a.doc_id <> b.doc_id group by 1)
        select l.doc_id, (select min(e.doc_id) from documents e where e.text = d.text) class_id, links::bigint links from l join documents d using (doc_id)""",
    "p9_shared": f"""{_SPANS}, c as (select distinct w.doc_id, unnest(range(w.s, w.s + 300)) p from w join r on substr(w.text, w.s, 300) = r.x)
        select doc_id, length(any_value(text))::bigint chars, count(*)::bigint shared_chars, count(*) / length(any_value(text))::double "share" from c join documents using (doc_id) group by 1""",
}
