from pyspark.sql import functions as F

from matchlake.llm import names, queries
from matchlake.session import table

SCHEMA = "source string, id string, name string, country string"


def groups(spark, rows, known=None):
    df = spark.createDataFrame([("row", str(i), n, c) for i, (n, c) in enumerate(rows)], SCHEMA).withColumn("NODE", F.lit("clash"))
    k = None if known is None else spark.createDataFrame(known, "source string, id string, entity string")
    linked = names.link_names(df, k).collect()
    out = {}
    for r in linked:
        out.setdefault(r.person, set()).add(int(r.id))
    return sorted(map(sorted, out.values()))


def test_readings_and_sounds():
    read = lambda n: [([g for g, _ in given], parts) for given, parts, certain in names.readings(n) if certain is not None]
    assert read("Berglund, Anna Maria") == [(["anna", "maria"], ["berglund"])] and read("BERGLUND Anna") == read("Anna Berglund") == [(["anna"], ["berglund"])]
    assert read("A. Berglund (WC)") == [(["a"], ["berglund"])] and read("Berglund A. [1]") == [(["a"], ["berglund"])] and read("Ann. Berglund") == [(["ann"], ["berglund"])]
    assert read("BERgLUND Anna") == [(["anna"], ["berglund"])] and read("Anna Berg–Lund") == [(["anna"], ["berg", "lund"])]
    assert ([], ["anna"]) == read("anna")[0] and read("") == read(" , ") == read("[1]") == []
    assert names.sound("keitow") == names.sound("kaytau") and names.sound("braun") == names.sound("brown") and names.sound("vick") == names.sound("wik") and names.sound("zak") == names.sound("sac")
    assert {"beivo", "raim"} <= set(names.nicknames("beivraim")) and "deiki" in names.nicknames("skadeisto") and {"razzy", "razo"} <= set(names.nicknames("razara"))


def test_variants_of_one_person(spark):
    one = [("Kreifana Sablotsky", "AUT"), ("SABLOTSKY Kreifana", "AT"), ("sablotsky k.", "AUT"), ("Kre. Sablotsky", "AUT"), ("Kreiffy Sablotsky", "AUT"), ("Kreifana Sablostky", "AUT"), ("Kreifana Sablotzki", "AUT"), ("Kréifana Sablotský *", "AUT"), ("Kreifana Moritura Sablotsky", "AUT")]
    other = [("Kreifana Sablotsky", "BRA"), ("Ludwika Sablotsky", "AUT"), ("Ludwika Morwenna", "AUT")]
    n = len(one)
    assert groups(spark, one + other) == [list(range(n)), [n], [n + 1], [n + 2]]
    # A row without a country joins the only one, and none where a namesake lives elsewhere.
    assert groups(spark, one[:2] + [("Sablotsky, Kreifana", None)]) == [[0, 1, 2]]
    assert groups(spark, one[:2] + [("Sablotsky, Kreifana", None), other[0]]) == [[0, 1], [2], [3]]


def test_names_of_real_life(spark):
    """Usual nicknames, both orders of the tokens, legal forms, and countries in any code system."""
    rows = [("Robert Smith", "US"), ("Bob Smith", "USA"), ("Smith Robert", "US"), ("William Jones", "US"), ("Bill Jones", "US"), ("Acme Limited", "US"), ("Acme Ltd", "US")]
    assert groups(spark, rows) == [[0, 1, 2], [3, 4], [5, 6]]
    more = [("Globex Industries, Inc.", "KE"), ("Industries Globex Incorporated", "KEN"), ("Globex Industries", "KE"), ("Globex Industries GmbH", "KE"), ("Initech S.A.", "SUI"), ("Initech SA", "CHE"), ("Maria Sa", "POR")]
    assert groups(spark, more) == [[0, 1], [2], [3], [4, 5], [6]]  # the bare name could be either firm
    assert names.organisation("Maria Sa") is names.organisation("KIM SA") is names.organisation("Ltd") is None


def test_the_rarest_rewriting_decides(spark):
    """Of forms that are owned alike the rarer counts more; a form with two owners favours neither."""
    owners = spark.createDataFrame([(1, "SWE", 10), (1, "SWE", 11), (2, "SWE", 10), (3, None, 12), (4, "NOR", 13)], "form bigint, country string, label bigint")
    seekers = spark.createDataFrame([(1, 1, "SWE", 1), (2, 1, "SWE", 2), (1, 1, "SWE", 3), (2, 1, "SWE", 3), (3, 1, "SWE", 4), (4, 1, "SWE", 5), (4, 1, None, 6)], "form bigint, tier int, country string, label bigint")
    got = {(r.label, r.owner): round(r.score, 6) for r in names.scores(seekers, owners, 100).collect()}
    from math import log

    two, one = round(log(50), 6), round(log(100), 6)
    assert got == {(1, 10): two, (1, 11): two, (2, 10): one, (3, 10): round(log(50) + log(100), 6), (3, 11): two, (4, 12): one, (6, 13): one}
    assert {(r.a, r.b) for r in names._owned(seekers, owners, 100).collect()} == {(2, 10), (4, 12), (6, 13)}


def test_nothing_is_guessed(spark):
    """A short name with two owners, a name without country in two countries, and names of nothing stay alone."""
    rows = [("Anton Lindqvist", "SWE"), ("Agneta Lindqvist", "SWE"), ("A. Lindqvist", "SWE"), ("Olga Petrenko", "POL"), ("Olga Petrenko", "CZE"), ("Olga Petrenko", None), (None, "SWE"), ("", None), ("  ", None), ("***", "SWE"), ("x" * 5000, "SWE")]
    assert groups(spark, rows) == [[i] for i in range(len(rows))]
    assert groups(spark, rows, [("row", "6", "e"), ("row", "9", "e"), ("row", "2", "f"), ("row", "1", "f")]) == [[0], [1, 2], [3], [4], [5], [6, 9], [7], [8], [10]]


def test_short_names_without_an_owner_meet(spark):
    assert groups(spark, [("Q. Zwartkruis", "NED"), ("Zwartkruis Q", "NL"), ("Zwartkruis Q.", "BEL")]) == [[0, 1], [2]]


def test_one_name_on_a_third_of_the_rows_and_empty_table(spark):
    rows = [("Hella Sommerfeld", "GER")] * 400 + [("H. Sommerfeld", "GER")] * 200 + [(f"Person{chr(97 + i % 26)}{chr(97 + i // 26)}x Family{chr(97 + i // 26)}y{chr(97 + i % 26)}", "FRA") for i in range(100)]
    got = groups(spark, rows)
    assert list(range(600)) in got
    assert groups(spark, []) == []


def test_identities_of_the_tables_agree(spark, sf):
    """Registrations that an identity lists under two numbers are one person even where only names are used."""
    players, identities = table(spark, sf, "imported_player"), table(spark, sf, "player_identity")
    typed = players.select(F.lit("row").alias("source"), F.col("player_row_id").cast("string").alias("id"), "name", "country")
    person = names.link_names(typed)
    owner = identities.select(F.col("id").alias("owner"), F.explode("external_ids").alias("x"))
    keyed = players.select(F.col("player_row_id").cast("string").alias("id"), F.col("provenance.provider").alias("p"), "external_player_id").join(owner, (F.col("p") == F.col("x.provider")) & (F.col("external_player_id") == F.col("x.provider_player_id")))
    both = keyed.join(person, "id").select("owner", "person")
    owners = both.groupBy("owner").agg(F.countDistinct("person").alias("n"))
    assert owners.where("n = 1").count() >= 0.9 * owners.count()
    assert both.groupBy("person").agg(F.countDistinct("owner").alias("n")).where("n > 1").count() == 0
    pairs = queries.p2_found(spark, sf).collect()
    assert pairs and len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    got = {r.node: r.label for r in names.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_every_owner_of_a_form_is_scored(spark):
    """Of three that own a form the middle one gets its share too; names that nobody can own enough of need no pairs."""
    owners = spark.createDataFrame([(1, "SWE", 10), (1, "SWE", 11), (1, "SWE", 12), (2, "SWE", 11), (3, "SWE", 11), *[(4, "SWE", k) for k in range(20, 60)]], "form bigint, country string, label bigint")
    seekers = spark.createDataFrame([(f, 1, "SWE", 1) for f in (1, 2, 3)] + [(4, 1, "SWE", 2)], "form bigint, tier int, country string, label bigint")
    got = {(r.label, r.owner): r.score for r in names.scores(seekers, owners, 100_000).collect()}
    assert {o for s, o in got if s == 1} == {10, 11, 12} and len(got) == 43
    assert got[1, 11] > got[1, 10] and abs(got[1, 11] - got[1, 10] - 2 * __import__("math").log(100_000)) < 1e-9
    more = seekers.unionByName(spark.createDataFrame([(5, 1, "SWE", 1), (6, 1, "SWE", 1), (7, 1, "SWE", 1)], seekers.schema))
    own = owners.unionByName(spark.createDataFrame([(5, "SWE", 11), (6, "SWE", 11), (7, "SWE", 11)], owners.schema))
    assert [(r.a, r.b) for r in names._owned(more, own, 100_000).collect()] == [(1, 11)]
