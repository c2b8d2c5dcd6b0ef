"""Quartile bucket digests against a plain count, and neighbours against a sorted list."""
import hashlib
import random

import pytest

from tidewatch.llm import fingerprints as fp


def counts(data):
    """Triplet counts byte by byte."""
    data, total = data.ljust(5, b"\0"), [0] * fp.BUCKETS
    for at in range(len(data) - 4):
        for i in range(1, 5):
            for j in range(i + 1, 5):
                key = data[at] | data[at + i] << 8 | data[at + j] << 16
                total[((key + ((i * 5 + j) << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    return total


@pytest.mark.parametrize("text", ["a", "abcd", "abcde", "sort of a sentence, and a bit more of it", "é😀" * 40])
def test_counts_and_codes(text, monkeypatch):
    monkeypatch.setattr(fp, "PIECE", 7)
    total = counts(text.encode())
    assert fp.bucket_counts(text.encode()).tolist() == total
    quartiles = [sorted(total)[q * 64 - 1] for q in (1, 2, 3)]
    assert fp.codes_of(fp.bucket_counts(text.encode())).tolist() == [sum(c > q for q in quartiles) for c in total]


def test_likeness_is_bounded_and_symmetric():
    rng = random.Random(1)
    texts = ["", "a", "x" * 100_000, *(" ".join(rng.choice(["ab", "cde", "fig", "hold"]) for _ in range(n)) for n in (3, 50, 900))]
    for a in texts:
        for b in texts:
            score = fp.likeness(fp.fingerprint(a), fp.fingerprint(b))
            assert 0 <= score <= 1 and score == fp.likeness(fp.fingerprint(b), fp.fingerprint(a))
            assert (score == 1) or a != b
    assert fp.fingerprint(None) == fp.fingerprint("") == "0" * 130


def expected(rows):
    """rows: (doc_id, text), each id once."""
    rows = sorted(((i is not None, i or 0), i, t or "") for i, t in rows)
    for (_, doc_id, text), (_, _, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 4
        edited = text[:len(text) - n] + following[:n]
        own, changed = fp.fingerprint(text), fp.fingerprint(edited)
        yield (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed,
               fp.likeness(own, changed), fp.likeness(own, fp.fingerprint(following)))


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_neighbours(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(-50, 5000), n)
    rows = [(i, rng.choice([None, "", "é😀 " * 50, "z" * rng.randrange(9000)])
             if rng.random() < 0.2 else " ".join(rng.choice(["lor", "ip", "sum", "dol"]) for _ in range(rng.randrange(60))))
            for i in ids]
    if n > 2:
        rows[7] = (None, rows[7][1])
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows],
                                 "doc_id long, text string, part int, kind string").repartition(5)
    got = fp.compared(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_repeated_ids_and_equal_rows(spark):
    rows = [(1, "one text here"), (1, "other text"), (2, "same"), (2, "same"), (2, "same"), (None, None), (None, "x")]
    got = fp.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    again = fp.compared(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_edited_copies_are_nearer_than_other_documents(spark):
    got = fp.compared(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    nearer = sum(r.near_edited > r.near_next for r in got)
    assert nearer >= 0.995 * len(got)
