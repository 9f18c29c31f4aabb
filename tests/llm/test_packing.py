import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matchlake.llm import packing
from matchlake.session import table


def best_slack(counts, lengths, capacity):
    """Plain search over all sums that hold the longest length."""
    left = dict(counts)
    left[lengths[0]] -= 1
    sums = {lengths[0]}
    for n in lengths:
        for _ in range(left[n]):
            sums |= {s + n for s in sums if s + n <= capacity}
    return capacity - max(sums)


def test_each_filling_has_the_least_slack():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([17, 40, 64])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 25)))
        lengths = sorted(counts, reverse=True)
        chosen = packing.fullest(counts, lengths, capacity)
        assert chosen[lengths[0]] >= 1 and all(k <= counts[n] for n, k in chosen.items())
        assert capacity - sum(n * k for n, k in chosen.items()) == best_slack(counts, lengths, capacity)
        used = Counter()
        for _, repeats, c in packing.fillings(counts, capacity):
            assert sum(n * k for n, k in c.items()) <= capacity
            for n, k in c.items():
                used[n] += k * repeats
        assert used == +counts
    with pytest.raises(ValueError):
        packing.fillings({9: 1}, 8)


def check(rows, sizes, capacity):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.sequence_id is not None:
            by_seq[r.sequence_id].append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for held in by_seq.values():
        at = 0
        for i, r in enumerate(sorted(held, key=lambda r: r.position)):
            assert (r.position, r.start_token) == (i, at)
            at += r.tokens
        assert at <= capacity
    want = Counter()
    for doc, n in sizes:
        want[doc] += n or 0
    assert {d: sum(r.tokens for r in v) for d, v in by_doc.items()} == dict(want)
    return len(by_seq)


def test_skewed_lengths_ties_and_empty_documents(spark):
    sizes = [(i, 700) for i in range(300)] + [(300 + i, i % 9) for i in range(90)] + [(1000, 5000), (1001, 2048), (1002, 2049), (1003, None), (1004, 0), (7, 700)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").withColumn("PART", F.lit("clash"))
    rows = packing.pack(df.select("doc_id", "tokens")).collect()
    assert check(rows, sizes, 2048) <= 155
    assert {r.part for r in rows if r.doc_id == 1000} == {0, 1, 2}
    assert [r.sequence_id for r in rows if r.doc_id in (1003, 1004)] == [None, None]
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_documents_fill_sequences(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = [(r.doc_id, r.tokens) for r in packing.token_counts(docs).collect()]
    encode = packing._encoding(packing.VOCABULARY).encode_ordinary
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(n == len(encode(texts[d])) for d, n in sizes)
    sequences = check(packing.pack(packing.token_counts(docs)).collect(), sizes, packing.CAPACITY)
    assert sequences <= 1.01 * sum(n for _, n in sizes) / packing.CAPACITY + 1


def test_counts_of_odd_texts(spark):
    texts = [None, "", " ", "a" * 200_000, "tab\tand\r\n\n  blanks  ", "it's 12 o'clock!!", "\x1c\x1d x", "naïve 東京   end", "x\x0b\x0c y  "]
    rows = packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    encode = packing._encoding(packing.VOCABULARY).encode_ordinary
    assert [r.tokens for r in rows] == [len(encode(t or "")) for t in texts]
