"""Tokens of two tokenizers aligned, and how often each pair of token ids is linked in the corpus.

Both tokenizers cut the same bytes (a space and the text). Where a token of either ends at the same
byte, the streams are cut; what lies between neighbouring cuts is a group, and every token of the one
tokenizer is linked with every token of the other in its group. The cuts are found by divide and
conquer (`shared_cuts`): an interval's candidates are split at the token end in their middle; the first
end from there on that both streams have is located by bisecting either stream in turn; both sides of
it are intervals again, and one without a common end is a leaf group. All intervals of a level are
worked on at once, as arrays.

No token of either tokenizer holds a space after another character, so texts with single spaces
between words are cut before every space, and what lies between (a unit) is aligned once a worker
process and remembered. Other texts are one unit. `tests/llm` compares units with whole texts.

The corpus counts of id pairs are added up per task before they are shuffled. A document then looks up
the pairs it holds. The pairs are dealt into blocks of at most about `BLOCK` by hash; one block at a
time is broadcast (some 13 bytes a pair, whatever the corpus) and a pass over the stored pairs of
the documents adds up what it finds, so that no table of all pairs is ever in one place, and no
document's pairs are shuffled.

Defined cases: texts that are null, empty, or that either tokenizer does not give back byte by byte
have no tokens: zeros, and '' for the digest. Null and repeated doc_ids give a row each, and each row
counts as a document. Other columns, whatever their names, are not looked at; an empty table gives no
rows. A group of many tokens on both sides is counted by distinct ids, not pair by pair.
"""
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from tidewatch.llm.shared import (batches_of_texts, kept_by_worker, new_folder, single_thread,
                                  tokenizer_path, written)

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
BLOCK = 2_000_000               # id pairs that are broadcast at once
FEW = 256                       # links of a group that are listed one by one
MEMO_UNITS = 400_000            # units a worker process remembers
MEMO_PAIRS = 4_000_000          # and their id pairs
TOGETHER = 2000                 # characters of units that go to the tokenizers as one text
SLICE = 1 << 20                 # characters of texts that are aligned at once
HELD = 1 << 21                  # distinct pairs that a counting task holds

MARK = "▁"
ODD = -1                        # the place of a unit that is not aligned by itself
_ODD_START = re.compile("[\\s\\x85\\u180e\\u200b\\ufeff]")   # a unit must not start so


# ---------------------------------------------------------------- divide and conquer

def first_common(a_end, b_end, at, hi):
    """For each start `at` the first index into `a_end`, below `hi`, of an end that `b_end` has too;
    `hi` where there is none. Bisects the two streams in turn."""
    at = at.copy()
    open_ = np.arange(len(at))
    while len(open_):
        value = a_end[at[open_]]
        other = b_end[np.searchsorted(b_end, value)]
        later = np.searchsorted(a_end, other)
        at[open_] = np.minimum(np.where(other == value, at[open_], later), hi[open_])
        done = (other == value) | (later >= hi[open_])
        done[~done] = a_end[later[~done]] == other[~done]
        open_ = open_[~done]
    return at


def shared_cuts(a_end, b_end, lo, hi):
    """Indexes into `a_end` of all ends that `b_end` has too, sorted.

    `lo` and `hi` are the first and last token of each unit; a unit's last end is common.
    """
    cuts = [hi]
    while True:
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return np.sort(np.concatenate(cuts))
        middle = (lo + hi) >> 1
        at = first_common(a_end, b_end, middle, hi)
        found = at < hi
        cuts.append(at[found])
        lo, hi = np.concatenate([lo, at[found] + 1]), np.concatenate([middle, hi[found]])


def _within(starts, sizes):
    """The indexes start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def summed(owner, key, weight):
    """Weights added up by (owner, key), in order; owners below 2^32, keys below 2^31."""
    both = owner.astype(np.uint64) << np.uint64(32) | key.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    both, weight = both[order], weight[order]
    starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, int)
    total = np.add.reduceat(weight, starts) if len(starts) else weight[:0]
    both = both[starts]
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), total


def linked(a_ids, b_ids, a_size, b_size, unit, n_b_ids):
    """Linked id pairs a * n_b_ids + b of groups with `a_size` and `b_size` tokens: unit, pair, links."""
    a_from, b_from = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
    few = a_size * b_size <= FEW
    size, width = (a_size * b_size)[few], np.maximum(b_size[few], 1)
    of = np.repeat(np.arange(len(size)), size)
    nth = _within(np.zeros(len(size), np.int64), size)
    a = a_ids[a_from[few][of] + nth // width[of]]
    b = b_ids[b_from[few][of] + nth % width[of]]
    units, pairs, links = [unit[few][of]], [a * n_b_ids + b], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(~few):
        a, m = np.unique(a_ids[a_from[g]:a_from[g] + a_size[g]], return_counts=True)
        b, n = np.unique(b_ids[b_from[g]:b_from[g] + b_size[g]], return_counts=True)
        pairs.append((a[:, None] * n_b_ids + b).ravel())
        links.append((m[:, None] * n).ravel())
        units.append(np.full(len(pairs[-1]), unit[g]))
    return summed(np.concatenate(units), np.concatenate(pairs), np.concatenate(links))


# ---------------------------------------------------------------- the two tokenizers

def byte_alphabet():
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Ids of units by both tokenizers, and the bytes of every id."""

    def __init__(self, path_a, path_b):
        import sentencepiece
        from tokenizers import Tokenizer
        single_thread()
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet.get(c, 0) for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.by_word = not any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK))
                               for p in pieces)

    def encode(self, texts):
        """Ids of space+text by A and of text by B, and which texts both give back byte by byte."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        good = [x != "" and b"".join(map(self.a_bytes.__getitem__, ids)) == b"".join(map(self.b_bytes.__getitem__, other))
                == b" " + x.encode("utf-8", "surrogatepass") for x, ids, other in zip(texts, a, b)]
        return a, b, good

    def units_of(self, text):
        return text.split(" ") if self.by_word else [text]


def _together(units):
    """Units put back together to texts of about `TOGETHER` characters: how many are in each."""
    sizes, n, size = [], 0, 0
    for u in units:
        n, size = n + 1, size + len(u)
        if size >= TOGETHER:
            sizes.append(n)
            n, size = 0, 0
    return sizes + [n] * (n > 0)


class _Table:
    """Columns of numbers that grow."""

    def __init__(self, **columns):
        self.n, self.columns = 0, {k: np.zeros(1024, t) for k, t in columns.items()}

    def add(self, **values):
        n = len(next(iter(values.values())))
        for k, v in values.items():
            if self.n + n > len(self.columns[k]):
                self.columns[k] = np.concatenate([self.columns[k], np.zeros(self.n + 2 * n, self.columns[k].dtype)])
            self.columns[k][self.n:self.n + n] = v
        self.n += n

    def __getitem__(self, k):
        return self.columns[k][:self.n]


class Aligner:
    """Alignments of units, remembered for as long as they fit."""

    def __init__(self, path_a, path_b):
        self.tokenizers = Tokenizers(path_a, path_b)
        self.n_b_ids = len(self.tokenizers.b_bytes)
        self.a_length = np.array([len(b) for b in self.tokenizers.a_bytes], np.int64)
        self.b_length = np.array([len(b) for b in self.tokenizers.b_bytes], np.int64)
        self.symbols = [b"%d%s" % (i, end) for n, ends in ((len(self.a_length), (b",", b"|")), (self.n_b_ids, (b",", b";")))
                        for i in range(n) for end in ends]
        self.clear()

    def clear(self):
        self.known, self.groups = {}, []
        self.units = _Table(**dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "start", "size"), np.int32), good=bool)
        self.pairs = _Table(pair=np.int32, links=np.int64)

    def learn(self, units):
        """Align those of `units` (a set) that are not known yet."""
        if self.units.n > MEMO_UNITS or self.pairs.n > MEMO_PAIRS:
            self.clear()
        new = list(units.difference(self.known))
        odd = [u for u in new if not u or MARK in u or _ODD_START.match(u)]
        self.known.update(dict.fromkeys(odd, ODD))
        if odd:
            new = list(set(new).difference(odd))
        for start, end in batches_of_texts(new, SLICE):
            self._align(new[start:end], _together(new[start:end]))

    def whole(self, texts):
        """Align texts (a set) as they are; their places are not those of units."""
        new = [x for x in texts if (x,) not in self.known]
        for start, end in batches_of_texts(new, SLICE):
            self._align(new[start:end], [1] * (end - start), whole=True)

    def _align(self, units, together, whole=False):
        t = self.tokenizers
        last = np.cumsum(together)
        a, b, good = t.encode([" ".join(units[end - n:end]) for n, end in zip(together, last.tolist())])
        if not all(good) and max(together) > 1:
            # some text was not given back: its units one by one
            self._align(units, [1] * len(units))
            return
        size = np.array([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units], np.int64)
        good = np.repeat(np.array(good, bool), together)
        a_ids = np.array([i for ids, g in zip(a, good[last - 1]) if g for i in ids], np.int64)
        b_ids = np.array([i for ids, g in zip(b, good[last - 1]) if g for i in ids], np.int64)
        a_end, b_end = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        ends = np.cumsum(size[good])
        a_last, b_last = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        if not (np.array_equal(a_end[a_last], ends) and np.array_equal(b_end[b_last], ends)):
            raise ValueError("a token crosses the space between two words")
        cuts = shared_cuts(a_end, b_end, np.concatenate(([0], a_last[:-1] + 1)) if len(ends) else a_last, a_last)
        b_cuts = np.searchsorted(b_end, a_end[cuts])
        a_size, b_size = np.diff(cuts, prepend=-1), np.diff(b_cuts, prepend=-1)
        unit = np.flatnonzero(good)[np.searchsorted(a_last, cuts)]
        count = lambda weights=None: np.bincount(unit, weights, minlength=len(units)).astype(np.int64)
        owner, pair, links = linked(a_ids, b_ids, a_size, b_size, unit, self.n_b_ids)
        size = np.bincount(owner, minlength=len(units))
        names = [(u,) for u in units] if whole else units
        self.known.update(zip(names, range(self.units.n, self.units.n + len(units))))
        self.units.add(n_a=count(a_size), n_b=count(b_size), n_groups=count(), n_links=count(a_size * b_size),
                       good=good, start=self.pairs.n + np.cumsum(size) - size, size=size)
        self.pairs.add(pair=pair, links=links)
        self.groups += self._written(a_ids, b_ids, a_size, b_size, unit, len(units))

    def _written(self, a_ids, b_ids, a_size, b_size, unit, n):
        """The groups of each unit as `a1,a2|b1;a3|b2`."""
        a_to, b_to = np.cumsum(a_size), np.cumsum(b_size)
        symbol = np.empty(len(a_ids) + len(b_ids), np.int64)
        a_at = np.arange(len(a_ids)) + np.repeat(b_to - b_size, a_size)
        b_at = np.arange(len(b_ids)) + np.repeat(a_to, b_size)
        symbol[a_at], symbol[b_at] = 2 * a_ids, 2 * (b_ids + len(self.tokenizers.a_bytes))
        symbol[a_at[a_to - 1]] += 1              # the last one of a group
        symbol[b_at[b_to - 1]] += 1
        parts = list(map(self.symbols.__getitem__, symbol.tolist()))
        ends = np.cumsum(np.bincount(unit, a_size + b_size, minlength=n)).astype(np.int64).tolist()
        return [b"".join(parts[start:end])[:-1] for start, end in zip([0, *ends], ends)]

    def documents(self, texts):
        """Per text n_a, n_b, n_groups, n_links and groups_sha256; and the distinct linked pairs of all
        texts with their links, by text."""
        units = [self.tokenizers.units_of(x) for x in texts]
        self.learn(set().union(*units))
        found = [list(map(self.known.__getitem__, u)) for u in units]
        # Texts with odd units, or one that was not given back, are aligned whole.
        bad = set(np.flatnonzero(~self.units["good"]).tolist()) | {ODD}
        broken = [i for i, f in enumerate(found) if not bad.isdisjoint(f)]
        self.whole({texts[i] for i in broken})
        for i in broken:
            found[i] = [self.known[(texts[i],)]]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        total = {k: np.bincount(of, self.units[k][flat], minlength=len(texts)).astype(np.int64)
                 for k in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [hashlib.sha256(b";".join(map(self.groups.__getitem__, f))).hexdigest() if n else ""
                   for f, n in zip(found, total["n_a"])]
        size = self.units["size"][flat]
        at = _within(self.units["start"][flat], size)
        return total, digests, summed(np.repeat(of, size), self.pairs["pair"][at], self.pairs["links"][at])


# ---------------------------------------------------------------- Spark

_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<int>, links array<int>")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs, tokenizer_a=TOKENIZER_A, tokenizer_b=TOKENIZER_B):
    """A row per row of `docs`: counts, digest of the groups, distinct linked id pairs and their links."""
    paths = tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)

    def align(batches):
        aligner = kept_by_worker(("aligner", paths), lambda: Aligner(*paths))
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for start, end in batches_of_texts(texts, SLICE):
                total, digests, (owner, pair, links) = aligner.documents(texts[start:end])
                offsets = np.searchsorted(owner, np.arange(end - start + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, x.astype(np.int32)) for x in (pair, links)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, end - start) for c in ("row", "doc_id")]
                    + [pa.array(total[c]) for c in _COUNTS] + [pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "links"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(align, _ALIGNED)


def _values(column):
    """The numbers of a list column of a batch, and where each list starts and ends."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0]:offsets[-1]], offsets - offsets[0]


def count_pairs(batches):
    """Documents by pair, added up within a task."""
    def batch_of(pairs, counts):
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(counts, pa.int64())], ["pair", "n"])

    pairs, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        more, n = np.unique(_values(batch.column("pairs"))[0], return_counts=True)
        both, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        pairs = both
        if len(pairs) > HELD:
            yield batch_of(pairs, counts)
            pairs, counts = pairs[:0], counts[:0]
    yield batch_of(pairs, counts)


def pair_counts(rows, n_b_ids):
    """pair, a, n (documents that hold the pair linked) and best (n is the highest of its a)."""
    counted = rows.select("pairs").mapInArrow(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.expr(f"pair div {n_b_ids}").cast("int")
    best = F.max("n").over(Window.partitionBy("a"))          # at most as many rows as B has ids
    return counted.withColumn("a", a).withColumn("best", F.col("n") == best)


def _look_up(block):
    """Adds up the counts of the pairs that `block` (a broadcast) has."""
    def look_up(batches):
        known, counts, best = block.value
        for batch in batches:
            pairs, offsets = _values(batch.column("pairs"))
            links = _values(batch.column("links"))[0].astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            count = np.where(there, counts[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            chosen = links * (there & best[at]) if len(known) else count
            sums = []
            for x in (chosen, links * count):
                running = np.concatenate(([0], np.cumsum(x)))
                sums.append(pa.array(running[offsets[1:]] - running[offsets[:-1]], pa.int64()))
            names = ["row", "doc_id", *_COUNTS, "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *sums], [*names, "n_best", "count_sum"])
    return look_up


def alignment_report(docs, tokenizer_a=TOKENIZER_A, tokenizer_b=TOKENIZER_B, block=BLOCK):
    """doc_id, the counts of tokens, groups and links, n_best, count_sum and groups_sha256 per row."""
    spark = docs.sparkSession
    folder = new_folder(spark, "aligned")
    aligned(docs, tokenizer_a, tokenizer_b).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(_ALIGNED).parquet(folder)
    n_b_ids = Tokenizers(tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)).b.get_piece_size()
    counts = written(pair_counts(rows, n_b_ids), "pair-counts")
    blocks = max(1, -(-counts.count() // block))
    narrow = [F.first(c).alias(c) for c in ("doc_id", *_COUNTS, "groups_sha256")]
    schema = _ALIGNED.split(", pairs")[0] + ", n_best long, count_sum long"
    parts = []
    for i in range(blocks):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).select("pair", "n", "best").toArrow()
        pair, n, best = (some.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        held = spark.sparkContext.broadcast((pair[order], n[order], best[order].astype(bool)))
        found = rows.mapInArrow(_look_up(held), schema)
        parts.append(found)
        if blocks > 1:
            parts[-1] = written(found, "aligned-part")
            held.unpersist()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if blocks > 1:
        whole = whole.groupBy("row").agg(*narrow, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
