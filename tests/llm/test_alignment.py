"""Alignment of two tokenizers against a token-by-token merge of their ends."""
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidewatch.llm import alignment as al
from tidewatch.llm.shared import tokenizer_path

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [None, "", " ", "a  b", "  a ", "\ta\n", "a\r\nb c\n d \n e", "x\x00y", "a▁ b", "▁", "<s> </s> <0x41> <|endoftext|>",
        "é ﬁ  　 x", "ab" * 4000, "a" * 30_000, "​ a​ ​b", "x ", "a\n \nb c", "don't we'll 's 12345 67 !!!??",
        "日本語 テスト 😀😀 👩‍👩‍👧", "a\x85 b \x1c c", "one two three", "one two three", "one " * 3000 + "two"]


@pytest.fixture(scope="module")
def tokenizers():
    return al.Tokenizers(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B))


def groups_of(t, text):
    """Groups of one text, merging the two lists of ends token by token."""
    if not text:
        return []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    if not (b"".join(t.a_bytes[i] for i in a) == b"".join(t.b_bytes[i] for i in b) == (" " + text).encode()):
        return []
    groups, i, j, a_end, b_end, ours, theirs = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if a_end <= b_end and i < len(a):
            ours.append(a[i])
            a_end, i = a_end + len(t.a_bytes[a[i]]), i + 1
        else:
            theirs.append(b[j])
            b_end, j = b_end + len(t.b_bytes[b[j]]), j + 1
        if a_end == b_end:
            groups.append((ours, theirs))
            ours, theirs = [], []
    return groups


def expected(t, texts):
    per, count = [], Counter()
    for text in texts:
        groups, links = groups_of(t, text), Counter()
        for ours, theirs in groups:
            theirs = Counter(theirs)
            for x, m in Counter(ours).items():
                for y, n in theirs.items():
                    links[x, y] += m * n
        count.update(links.keys())
        per.append((groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for groups, links in per:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
               sum(m for k, m in links.items() if count[k] == best[k[0]]), sum(m * count[k] for k, m in links.items()),
               hashlib.sha256(written.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("block", [al.BLOCK, 40])
def test_hard_texts(spark, tokenizers, block):
    rows = [(i if i % 7 else None, text, f"x{i}", i) for i, text in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, pairs long")
    got = al.alignment_report(docs, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i if i % 7 else None, *e) for i, e in enumerate(expected(tokenizers, HARD))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_documents(spark):
    assert al.alignment_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = al.alignment_report(spark.createDataFrame(docs)).orderBy("doc_id").select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == list(expected(tokenizers, [r.text for r in docs]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(0, 2**30)), min_size=1, max_size=5))
def test_cuts_are_the_common_ends(parts):
    a_end, b_end, first, last, at = [], [], [], [], 0
    for lengths, seed in parts:
        total, b = sum(lengths), []
        rng = np.random.default_rng(seed)
        b = sorted({total, *(int(x) for x in rng.integers(1, total + 1, rng.integers(0, 20)))})
        first.append(len(a_end))
        a_end += [at + x for x in np.cumsum(lengths)]
        last.append(len(a_end) - 1)
        b_end += [at + x for x in b]
        at += total
    a_end, b_end = np.array(a_end), np.array(b_end)
    cuts = al.shared_cuts(a_end, b_end, np.array(first), np.array(last))
    assert cuts.tolist() == [i for i, e in enumerate(a_end) if e in set(b_end.tolist())]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n\tN1'sé日😀\x85​　"), max_size=40))
def test_units_tokenize_as_in_the_whole_text(text):
    t = _LIBRARY.setdefault("t", al.Tokenizers(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B)))
    aligner = _LIBRARY.setdefault("a", al.Aligner(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B)))
    total, digests, _ = aligner.documents([text])
    n_a, n_b, n_groups, n_links, _, _, digest = next(expected(t, [text]))
    assert [int(total[k][0]) for k in ("n_a", "n_b", "n_groups", "n_links")] == [n_a, n_b, n_groups, n_links]
    assert digests == [digest]


_LIBRARY = {}


def test_memory_is_bounded(monkeypatch, tokenizers):
    monkeypatch.setattr(al, "MEMO_UNITS", 50)
    aligner = al.Aligner(tokenizer_path(al.TOKENIZER_A), tokenizer_path(al.TOKENIZER_B))
    for i in range(20):
        aligner.documents([" ".join(f"w{i}x{j}" for j in range(30))])
        assert aligner.units.n <= 50 + 30
