import random

from pyspark.sql import functions as F

from matchlake.llm import leaks
from matchlake.session import table


def brute(item, text, run):
    """Longest chain of common runs, by the plain recurrence over all run lengths."""
    f = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            best, n = max(f[i - 1][j], f[i][j - 1]), 0
            while n < min(i, j) and item[i - 1 - n] == text[j - 1 - n]:
                n += 1
                if n >= run:
                    best = max(best, f[i - n][j - n] + n)
            f[i][j] = best
    return f[-1][-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_chain_and_distance_against_plain_recurrences():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.choice("abcde") for _ in range(rng.randint(0, 20))]
        text = [rng.choice("xyz") for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, len(item))
            text += item[a : a + rng.randint(0, 9)] + [rng.choice("abx")]
        for run in (2, 3, 5):
            assert leaks.chained_words(item, text, run) == brute(item, text, run) <= leaks.kept_words(item, text) == lcs(item, text)


def test_words_ignore_form():
    want = "the drolains diary cost 5 coins cafe".split()
    for t in ["The Drolain's diary cost 5 coins, café", "> the <b>drolain’s</b>\n> diary cost &quot;5&quot; coins CAFÉ", "**the** drolain`s_diary cost (5) coins; cafe"]:
        assert leaks.words(t) == want


def test_defined_cases(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "intro " + item), (2, "one two three four five x"), (3, "one two three four x six seven eight nine"), (4, "six seven eight nine ten one two three four"), (5, None), (6, ""), (7, ("filler " * 60_000) + item.upper()), (7, "one two three four five"), (8, " ".join(reversed(item.split())))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ITEM_ID", F.lit("clash"))
    items = spark.createDataFrame([(10, item), (11, "too short here"), (12, None), (None, item), (13, ""), (14, item)], "item_id bigint, text string")
    for block in (2000, 40):
        got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, block=block).collect()}
        assert got == {(d, i) for d in (1, 2, 4, 7) for i in (10, 14)}
    assert leaks.leaks(docs.limit(0), items).count() == leaks.leaks(docs, items.limit(0)).count() == 0


def test_tables_against_every_pair(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_item")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}
    texts = [(r.doc_id, leaks.words(r.text)) for r in docs.collect() if r.text]
    want = set()
    for r in items.collect():
        w = leaks.words(r.text)
        want |= {(d, r.item_id) for d, t in texts if 2 * lcs_bound(w, t) >= len(w) and 2 * brute(w, t, 5) >= len(w)}
    assert got == want and got


def lcs_bound(item, text):
    return len(item) if not item else sum(w in set(text) for w in item)


def test_markup_of_any_length():
    assert leaks.words(f'one <a href="{"x" * 5000}">two</a> three &{"y" * 50}; four') == ["one", "two", "three", "y" * 50, "four"]
    assert leaks.words("<" * 100_000) == [] and leaks.words("a < b and c > d <") == ["a", "b", "and", "c", "d"]


def test_pieces_of_every_reproduction():
    """Whatever runs of enough words a text keeps, it keeps as many whole pieces as the filter asks for."""
    rng = random.Random(8)
    for _ in range(2000):
        run = rng.choice((2, 3, 4, 5, 6))
        item = [f"w{i}" for i in range(rng.randint(run, 40))]
        index = leaks._Index([(1, item)], run, 0.5)
        text, at = [], 0
        while at < len(item):
            at += rng.choice((0, 1, 2, 3))
            n = rng.choice((run, run, run + 1, run + 2, run + 4))
            text += [*item[at : at + n], "-"]
            at += n
        if leaks.chained_words(item, text, run) >= index.least[1]:
            assert index.candidates(text) == [1]
