"""Packing, WARC, token counts, near duplicates, decontamination, classifiers and the pipeline."""
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (decontaminate, packing, quality, setsketch, shared, tokens, toxicity, warc)
from tidewatch.llm.components import components, link_within

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti vo zu nd rth".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "one two", "a b c d e", prose(rng, 6000), "x" * 20_000]
    for _ in range(25):
        base = prose(rng, rng.randrange(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    return [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[9]), (27, texts[9])]


# ---------------------------------------------------------------- packing and tokens

def first_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def test_packing_is_a_gapless_layout_of_every_token(spark, corpus):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(shared.tokenizer_path(packing.TOKENIZER))
    rows = packing.pack(frame(spark, corpus), capacity=256).collect()
    expected = []
    for name, text in corpus:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(name, i // 256, i, len(ids[i:i + 256]), zlib.crc32(ids[i:i + 256].tobytes()))
                     for i in range(0, len(ids), 256)]
    key = lambda r: tuple(-1 if v is None else v for v in r)                     # noqa: E731
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    assert len(ends) <= first_fit([r[3] for r in expected], 256) + 1


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_layout_is_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.clip(np.exp(rng.normal(5.5, 1.2, 3000)).astype(int), 1, 1000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    _, sequences = packing.lay_out(histogram, 1000)
    assert sequences <= -(-int((lengths * counts).sum()) // 1000) * 1.01 + 1


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = rng.sample(range(2, 12), 3)
        values, bounds = [rng.random() for _ in lengths], [rng.randrange(1, 4) for _ in lengths]
        best = max(sum(c * v for c, v in zip(t, values)) for t in
                   ((a, b, c) for a in range(bounds[0] + 1) for b in range(bounds[1] + 1) for c in range(bounds[2] + 1))
                   if sum(c * n for c, n in zip(t, lengths)) <= 20)
        got = packing.knapsack(np.array(lengths), np.array(values), np.array(bounds), 20)
        assert abs(sum(got * values) - best) < 1e-9 and sum(got * lengths) <= 20


ODD = ["", "  ", "<|endoftext|> a", "A<|ENDOFTEXT|>b", "É Éx İİ ẞ Σας ΑΣ", "a b\x1cc\x85d", "it 'S don't IT'LL 12ab...,",
       "x" * 300 + " y", "\x00 \x01a", "▁ a", " a", "a  b", "a\n b", "<s> </s><0x0A>", "日本語 テキスト", "e\u0301 \u0301a"]


def test_encoders_agree_with_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer
    path = shared.tokenizer_path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    assert packing.id_encoder(path)(ODD) == [
        np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ODD]
    path = shared.tokenizer_path(tokens.TOKENIZER)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokens.piece_counter(path)(ODD) == [len(i) for i in model.encode(ODD, num_threads=1)]


def test_token_cache_is_reused(spark, tmp_path, corpus):
    cache = f"file://{tmp_path}/cache"
    docs = frame(spark, [(*r, None) for r in corpus], "doc_id long, text string, n_bytes string")
    first = sorted(tokens.count_tokens(docs, cache).collect(), key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in corpus})
    assert sorted(tokens.count_tokens(docs, cache).collect(), key=str) == first
    assert spark.read.parquet(cache).count() == stored
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=shared.tokenizer_path(tokens.TOKENIZER))
    assert first == sorted(((i, len((t or "").encode()), n, n > 4096) for (i, t) in corpus
                            for n in [len(model.encode(t or ""))]), key=lambda r: str(tokens_row(r)))


def tokens_row(r):
    from pyspark.sql import Row
    return Row(doc_id=r[0], n_bytes=r[1], n_tokens=r[2], over_limit=r[3])


# ---------------------------------------------------------------- archives

def test_archive_round_trip(spark):
    long, short = "<p>é</p>" * 40, "x" * 99
    pages = [(4, "http://a", long), (2, None, long), (9, "http://b\r\nX: y", long), (5, "u", short), (6, "u", short),
             (1, "u", None), (None, "u", long), (2, "again", long), (7, "u", "y" * 100)]
    got = sorted(warc.archive_round_trip(frame(spark, pages, "page_id long, url string, html string")).collect(), key=str)
    assert len(got) == len(pages)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    n = len(long.encode())
    assert kinds == sorted([("4", "revisit", 2, n), ("2", "response", None, n), ("9", "revisit", 2, n), ("2", "response", None, n),
                            ("None", "revisit", 2, n), ("5", "response", None, 99), ("6", "response", None, 99),
                            ("1", "response", None, 0), ("7", "response", None, 100)])
    assert warc.archive_round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as out:
        for name, data in (("archive/a", b"12345"), ("indexes/i", b"xyz")):
            with out.open(name, "w", force_zip64=wide) as member:
                member.write(data)
        out.comment = b"note"
    data = body.getvalue()
    members = warc.read_directory(lambda at, n: data[at:at + n], len(data))
    assert {k: data[at:at + n] for k, (at, n) in members.items()} == {"archive/a": b"12345", "indexes/i": b"xyz"}


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as out:
        out.writestr("archive/a", b"12345" * 10)
        out.writestr("indexes/i", b"xyz")
    data = body.getvalue()
    assert b"PK\x06\x06" in data
    members = warc.read_directory(lambda at, n: data[at:at + n], len(data))
    assert {k: data[at:at + n] for k, (at, n) in members.items()} == {"archive/a": b"12345" * 10, "indexes/i": b"xyz"}


def test_packed_members_are_refused():
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("archive/a", b"1" * 100)
    data = body.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        warc.read_directory(lambda at, n: data[at:at + n], len(data))


# ---------------------------------------------------------------- near duplicates

def shingles(text, pattern=r"[^\x20\x09-\x0D]+"):
    words = re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize("block", [None, 3])
def test_near_groups_against_brute_force(spark, corpus, monkeypatch, block):
    if block:                                   # groups of more than a block
        monkeypatch.setattr(setsketch, "BLOCK_CLASSES", block)
        monkeypatch.setattr(setsketch, "BLOCK_SHINGLES", 200)
    root = brute_groups(corpus)
    rows = setsketch.near_groups(frame(spark, corpus)).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            text = next(t for i, t in corpus if i == r.doc_id)
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(shingles(text)), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    one, two = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.registers(np.concatenate((a, b))) == np.maximum(one, two)).all()
    union = setsketch.registers(np.concatenate((a, b)))
    below = lambda at: setsketch.surely_below(one, 900.0, union[None, :], np.array([1200.0]), at)[0]     # noqa: E731
    assert not below(0.6) and below(0.9)


def test_components_of_a_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 60: 60, 61: 60}


def test_links_across_blocks(spark):
    rows = [(1, bytes([i]), 1, i) for i in range(40)]
    near = lambda pdf: lambda u, o: abs(pdf["x"].to_numpy()[o] - pdf["x"].to_numpy()[u]) == 1         # noqa: E731
    edges = link_within(spark.createDataFrame(rows, "group long, id binary, weight long, x int"), near, ["x"], 6)
    assert {bytes(r.label) for r in components(edges).collect()} == {bytes([0])}


def test_rows_that_share_an_id_stay_or_go_by_row(spark):
    """Id 5 stands for a near copy of document 2 and for a text of its own."""
    rng = random.Random(11)
    base, own = prose(rng, 200), prose(rng, 90)
    docs = [(2, base, 0), (5, base + " end", 1), (5, own, 2), (None, base, 3), (None, None, 4), (9, base, 5)]
    kept = setsketch.keep_one(frame(spark, docs, "doc_id long, text string, label int"))
    assert kept.columns == ["doc_id", "text", "label"] and sorted(r[2] for r in kept.collect()) == [0, 2, 3, 4]


def test_near_groups_of_a_set_that_half_of_all_rows_share(spread):
    rng = random.Random(13)
    hot = prose(rng, 40)
    docs = [(i, hot if i % 2 else prose(rng, 12)) for i in range(1200)]
    got = setsketch.near_groups(frame(spread, docs))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * len(docs) / 4
    assert {r.component_id for r in got.collect() if r.doc_id % 2} == {1}


# ---------------------------------------------------------------- decontamination

def test_contamination_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 5, 9, 20, 45, 90, 30))] + [(7, None), (8, "..."), (None, "x y z")]
    docs = [(0, None), (1, ""), (2, prose(rng, 4000) + " " + items[3][1].upper() + ", " + prose(rng, 3000))]
    for i, text in items[:7]:
        words = text.split()
        docs.append((10 + i, prose(rng, 50) + "\n" + text + ".\n" + prose(rng, 70)))
        docs.append((20 + i, prose(rng, 30) + " " + " ".join(words[:int(len(words) * .9)]) + " " + prose(rng, 30)))
        docs.append((30 + i, " ".join(words[:len(words) // 2])))
    docs += [docs[3], (None, items[4][1])]
    words_of = lambda t: re.findall("[a-z0-9]+", (t or "").lower())                # noqa: E731
    grams = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}        # noqa: E731
    expected = set()
    for i, t in items:
        w = words_of(t)
        if i is None or not w:
            continue
        mine = grams(w, min(5, len(w)))
        for d, text in docs:
            common = len(mine & grams(words_of(text), min(5, len(w))))
            if d is not None and common >= 0.75 * len(mine):
                expected.add((d, i, common, len(mine)))
    schema = "item_id long, text string"
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, schema)).collect()
    assert {tuple(r)[:4] for r in got} == expected and len(got) == len(expected)
    kept = decontaminate.clean(frame(spark, docs), frame(spark, items, schema))
    # a row without doc_id that holds an item goes too
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs if d is not None} - {d for d, *_ in expected}
    assert decontaminate.contaminated(frame(spark, docs), frame(spark, [], schema)).count() == 0


def test_rows_that_share_an_id_are_cleaned_by_row(spark):
    rng = random.Random(8)
    item, fine, other = prose(rng, 30), prose(rng, 80), prose(rng, 70)
    docs = [(1, fine, 0), (1, f"{other} {item} {other}", 1), (None, f"{fine} {item}", 2), (None, other, 3), (2, None, 4)]
    kept = decontaminate.clean(frame(spark, docs, "doc_id long, text string, _gone int"),
                               frame(spark, [(7, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "_gone"] and sorted(r[2] for r in kept.collect()) == [0, 3, 4]


@pytest.mark.parametrize("unpacked", [10, 26])
def test_a_large_benchmark_is_searched_in_parts(spark, monkeypatch, unpacked):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 19)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 15)
    monkeypatch.setattr(decontaminate, "UNPACKED_BITS", unpacked)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice((4, 12, 40)))) for i in range(120)]
    docs = [(i, f"{prose(rng, 40)} {t} {prose(rng, 40)}") for i, t in items]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_the_filter_grows_with_the_keys():
    assert decontaminate.filter_bits(0) == 24 and decontaminate.filter_bits(10**9) == 29
    for n in (1, 70_000, 10**6, 2 * 10**6):
        assert (1 << decontaminate.filter_bits(n)) >= decontaminate.BITS_PER_KEY * n


def test_short_items_are_never_missed(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))             # noqa: E731
    items = [(i, pick(5 if i % 3 else 3 + i % 8)) for i in range(1500)]
    docs = [(i, f"{pick(60)} {t} {pick(60)}") for i, t in items] + [(5000 + i, f"{t} {pick(100)}") for i, t in items]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {(i, i) for i, _ in items} | {(5000 + i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}


def test_needed_shingles_meet_every_contained_set():
    for n in range(1, decontaminate.LEAST_SIZE + 1):
        least = next(k for k in range(1, n + 1) if k >= decontaminate.CONTAINED * n)
        assert len(decontaminate.needed(np.arange(n), decontaminate.CONTAINED)) + least == n + 1


# ---------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    insults, docs, labels = ["idiot", "moron", "scum"], [], []
    for i in range(400):
        words, toxic, bad = prose(rng, 60).split(), i % 6 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else words[:3] * 20
        if toxic:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(insults)
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 400))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "x i d i o t y", "en", "a", 1), (1002, "you id.iot", "en", "a", 1),
             (1003, prose(rng, 9000), "en", "a", 1), (None, "fine words here", "en", "a", 1)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_toxicity(spark, labelled):
    docs, labels = frame(spark, labelled[0], DOCS), frame(spark, labelled[1], LABELS)
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(rows) == len(labelled[0])
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    held = [i for i in range(400) if rows[i].held_out]
    assert sum(rows[i].predicted == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert rows[1001].predicted == rows[1002].predicted == 1
    assert rows[1000].predicted == rows[1003].predicted == rows[None].predicted == 0
    nothing = toxicity.score(docs, toxicity.fit(docs, frame(spark, [], LABELS)))
    assert {r.score for r in nothing.collect()} == {0.0}


def test_rare_insults_are_learned_beside_common_ones(spark):
    rng = random.Random(4)
    times = {"idiot": 150, "pathetic": 70, "worthless": 35, "scum": 18, "clown": 15, "trash": 15}
    meant = [w for w, n in times.items() for _ in range(n)] + [None] * 1200
    rng.shuffle(meant)
    docs = [(i, " ".join([*prose(rng, 15).split(), *([w] if w else []), *prose(rng, 15).split()]), "en", "a", 1)
            for i, w in enumerate(meant)]
    labels = [(i, None, int(w is not None)) for i, w in enumerate(meant)]
    new = [(5000 + i, f"{prose(rng, 9)} {w} {prose(rng, 9)}", "en", "a", 1) for i, w in enumerate(times)]
    model = toxicity.fit(frame(spark, docs, DOCS), frame(spark, labels, LABELS))
    rows = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, docs + new, DOCS), model).collect()}
    assert [w for i, w in enumerate(times) if not rows[5000 + i]] == []
    assert sum(rows[i] == (w is not None) for i, w in enumerate(meant)) >= 0.98 * len(meant)


def test_copies_and_languages_are_counted_apart(spark):
    rng = random.Random(9)
    copied = prose(rng, 12) + " oddword here.\n" + prose(rng, 12)
    rows = [(i, copied, "en", int(i < 40)) for i in range(40)]
    rows += [(100 + i, prose(rng, 10) + " und", lang, int(i % 10 < share))
             for lang, share in (("de", 8), ("fr", 1)) for i in range(len(rows), len(rows) + 60)]
    sample = frame(spark, rows, "doc_id long, text string, lang string, toxic int")
    counts = {(r.segment, r.lang): (r.n, r.bad) for r in toxicity.segment_counts(sample).collect()}
    assert counts["oddword", "en"] == (1, 1)
    assert counts["und", "de"][0] == counts["und", "fr"][0] == 60 and counts["und", "de"][1] > counts["und", "fr"][1]


def test_quality(spark, labelled):
    docs, labels = frame(spark, labelled[0], DOCS), frame(spark, labelled[1][:250], LABELS)
    rows = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(rows) == len(labelled[0])
    assert sum(rows[i].kept == (i % 5 != 0) for i in range(250, 400)) >= 0.97 * 150
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert all(r.kept for r in quality.score(docs, quality.fit(docs, frame(spark, [], LABELS))).collect())


def test_every_unlabelled_document_can_be_handed_over(spark):
    rng = random.Random(8)
    def text(bad):
        return " ".join(w.upper() + "!!" if bad else w for w in prose(rng, 12).split())
    docs = [(i, text(i % 2), "en", "a", 70) for i in range(200)]
    docs += [(i, text(i % 2), "xx", f"new{i % 2}", 70) for i in range(200, 13_000)]
    labels = [(i, 1 - i % 2, None) for i in range(200)]
    seen = []

    def spy(views, y, over_pool, scales, fold, **options):
        seen.append(over_pool(lambda rows: np.array([float(len(rows[0]))]))[0])
        return co_train(views, y, over_pool, scales, fold, **options)
    co_train = quality.co_train
    quality.co_train = spy
    try:
        (_, stated), _ = quality.fit(frame(spark, docs, DOCS), frame(spark, labels, LABELS))
    finally:
        quality.co_train = co_train
    assert seen == [12_800]
    good, bad = stated.raw(np.array([quality.metadata_features("xx", f"new{i}", 70) for i in range(2)]))
    assert good > 3 and bad < -3


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, labelled, tmp_path):
    rng = random.Random(2)
    item = prose(rng, 30)
    good = [(2000 + i, prose(rng, 40), "en", "a", 1) for i in range(20)]
    extra = [(3000, good[0][1], "en", "a", 1), (3001, prose(rng, 20) + " " + item, "en", "a", 1),
             (3002, good[1][1] + " more", "en", "a", 1)]
    frame(spark, labelled[0][:400] + good + extra, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, labelled[1], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, str(tmp_path)), name)
        assert sorted(docs.columns) == sorted(c.split()[0] for c in DOCS.split(", "))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not any(i % 5 == 0 for i in seen[0] if i < 400) and {3000, 3001, 3002, 2000} <= seen[0]
    assert seen[0] - seen[1] == {2000} or 2000 in seen[0] - seen[1]
    assert 3002 in seen[1] - seen[2]
    assert seen[2] - seen[3] == {3001}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]
