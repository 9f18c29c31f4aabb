import random

import numpy as np
from pyspark.sql import functions as F

from matchlake.llm import spans
from matchlake.session import table


def brute(rows, span):
    held = {}
    for d, t in rows:
        for s in range(len(t or "") - span + 1):
            held.setdefault(t[s : s + span], set()).add(d)
    return {(a, b) for g in held.values() for a in g for b in g if a < b}, held


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("AT", F.lit("clash")).withColumn("gram", F.lit(1))


def random_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé 𝄞") for _ in range(n))
    common = [text(n) for n in (19, 20, 21, 60)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(common), text(rng.randint(0, 3))]
        rows.append((i, "".join(parts)))
    return rows + [(100, rows[3][1]), (101, rows[3][1] * 2), (102, None), (103, ""), (104, "a" * 90), (105, "a" * 50), (106, common[3]), (107, common[3])]


def test_pairs_and_intervals_against_all_windows(spark):
    for seed in range(2):
        rows = random_rows(seed)
        want, held = brute(rows, 20)
        for gram in (20, 9):
            assert {tuple(r) for r in spans.shared_pairs(frame(spark, rows), 20, gram).collect()} == want
        texts = {}
        for d, t in rows:
            texts.setdefault(t, d)
        linked = {d: sum(d in p for p in want) for d in {x for p in want for x in p}}
        assert {tuple(r) for r in spans.shared_links(frame(spark, rows), 20, 9).collect()} == {(d, texts[dict(rows)[d]], n) for d, n in linked.items()}
        covered = {}
        for g, docs in held.items():
            if len(docs) > 1:
                for d, t in rows:
                    if d in docs:
                        for s in range(len(t) - 19):
                            if t[s : s + 20] == g:
                                covered.setdefault(d, set()).update(range(s, s + 20))
        got = {}
        for r in spans.shared_intervals(frame(spark, rows), 20, 9).collect():
            got.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
        assert got == covered
        assert {r.doc_id: r.shared_chars for r in spans.shared_share(frame(spark, rows), 20, 9).collect()} == {d: len(c) for d, c in covered.items()}


def test_spans_that_differ_between_two_chosen_windows(spark):
    """Two common parts with one differing character between them, at every distance."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(0, 120, 2):
        left, right = text(rng.randint(15, 25)), text(rng.randint(15, 25))
        rows += [(i, text(3) + left + "x" + right + text(3)), (i + 1, text(4) + left + rng.choice("xy") + right + text(2))]
    for gram in (3, 10, 17):
        assert {tuple(r) for r in spans.shared_pairs(frame(spark, rows), 20, gram).collect()} == brute(rows, 20)[0]


def test_hashes_of_windows_are_polynomials():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 0x110000, 700).astype(np.uint32)
    codes[300:420] = codes[:120]
    starts = np.array([0, 1, 300, 301, 579, 580])
    high, low = spans.window_hashes(codes, 120, starts)
    for s, h, v in zip(starts, high, low):
        plain = [int(c) + 1 for c in codes[s : s + 120]]
        assert int(h) == sum(c * pow(spans._BASE, i, 2**64) for i, c in enumerate(plain)) % 2**64
        a, b = (sum(c * pow(base, i, p) for i, c in enumerate(plain)) % p for p, base in spans._PRIMES)
        assert int(v) == a << 31 | b
    assert (high[0], low[0]) == (high[2], low[2]) and high[0] != high[1] != high[3] and len(set(low)) == 5


def test_a_head_that_a_third_of_the_records_have(spark, monkeypatch):
    monkeypatch.setattr(spans, "HEAD_ROWS", 7)
    rows = [(i, chr(200 + i % 40) + "boilerplate that stands in many records" + chr(300 + i)) for i in range(60)] + [(100 + i, "".join(chr(1000 + (i * 97 + j * j) % 900) for j in range(60))) for i in range(120)]
    assert {tuple(r) for r in spans.shared_pairs(frame(spark, rows), 30, 11).collect()} == brute(rows, 30)[0]


def test_empty_table_and_repeated_rows(spark):
    assert spans.shared_pairs(frame(spark, []), 20, 9).count() == 0
    assert spans.shared_pairs(frame(spark, [(1, "b" * 40)] * 3 + [(None, "b" * 40)]), 20, 9).count() == 0


def test_very_long_text_is_read_whole(spark):
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, 2_100_000)))
    rows = [(1, long), (2, "#" + long[999_850:1_000_150] + "#"), (3, "#" + long[-300:]), (4, long[1_500_000:1_500_299])]
    assert {tuple(r) for r in spans.shared_pairs(frame(spark, rows)).collect()} == {(1, 2), (1, 3)}


def test_documents_against_all_windows(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {tuple(r) for r in spans.shared_pairs(table(spark, sf, "documents")).collect()} == brute(rows, 300)[0]
