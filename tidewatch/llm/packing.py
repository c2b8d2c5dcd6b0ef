"""Packing of tokenised documents into sequences of at most `CAPACITY` tokens.

Only the histogram of piece lengths (at most `CAPACITY` numbers) reaches the driver. There a
configuration program is solved: a configuration is a multiset of lengths that fits a sequence, and
its variable says how many sequences are laid out that way. Multiplicative weights give each length a
price that falls as its demand is met; a knapsack dynamic program over the lengths of the highest
price per token finds the best configuration at these prices; its variable grows by a share of what
the demands still allow. The variables are rounded down, and what is left is laid out by best fit,
largest first, again as configurations with multiplicities. Both phases end after a number of steps
that depends on the number of different lengths, not on the number of documents.

Pieces get their place by rank: each task numbers the pieces of a length it has seen, the numbers of
earlier tasks are added (a sum per task and length), and the rank falls in one slot of one
configuration. No group of pieces is ever gathered.

Defined cases: null or empty text is the single end id; a null or repeated doc_id is packed like any
other row; an empty table gives no rows; other columns are not looked at.
"""
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import (ChunkMemo, batches_of_texts, single_thread, text_of, tokenizer_path,
                                  written)

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
ROUNDS = 800             # pricing rounds at most
CORE = 160               # lengths in a pricing program
SHARE = 0.8              # of the demand a configuration could still take, per round
GREED = 3.0              # how strongly prices follow unmet demand
LEAST_FILL = 0.998       # of a sequence, for a configuration of the program

# ---------------------------------------------------------------- token ids

_LETTER_RUNS = regex.compile(r"\p{L}+|\P{L}+")
_SIMPLE = regex.compile(r"[^'\u0130\u0500-\U0010ffff]*")     # long-known letters that stay one when lower-cased


def letter_runs(chunk):
    """`chunk` (no white space) at its borders between letters and others, which the pre-tokenizer never
    crosses; whole where an apostrophe may start a contraction or normalising may move a border."""
    if _SIMPLE.fullmatch(chunk) and unicodedata.is_normalized("NFC", chunk):
        return _LETTER_RUNS.findall(chunk)
    return [chunk]


@lru_cache(maxsize=2)
def id_encoder(path):
    """texts -> little-endian 32-bit ids as bytes, as the tokenizers file at `path` gives them.

    Its normaliser lower-cases and its pre-tokenizer never joins what white space separates, so ids
    are kept by chunk between ASCII white space, with A-Z lower-cased, and those of a chunk are put
    together from its runs of letters and of others. Runs are encoded many at a time with a special
    token in between. Texts that may hold a special token go to the library whole, as do all texts
    when the file promises neither. A worker process keeps one encoder for all its tasks.
    """
    import json

    from tokenizers import Tokenizer
    single_thread()
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    steps = [s["type"] for s in (settings["normalizer"] or {}).get("normalizers", [])]
    splits = [s["type"] for s in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
    special = [t["content"] for t in settings["added_tokens"] if t["special"] and not t["lstrip"] and not t["rstrip"]]
    by_chunk = steps == ["NFC", "Replace", "Lowercase"] and splits[:1] == ["Split"] and bool(special)
    opening = {t["content"].encode()[:2].lower() for t in settings["added_tokens"]}

    def library(texts):
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(runs):
        mark = special[-1]
        ids = np.frombuffer(library([mark.join(runs)])[0], "<u4")
        cuts = np.flatnonzero(ids == tokenizer.token_to_id(mark))
        data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[start:end] for start, end in zip([0, *(4 * cuts + 4).tolist()], ends)]

    runs = ChunkMemo(many, limit=600_000, at_once=5000)

    def of_chunks(chunks):
        parts = [letter_runs(c.decode("utf-8", "replace")) for c in chunks]
        long = runs.learn(parts)
        ids = [b"".join(map(runs.known.__getitem__, p)) for p in parts]
        runs.forget(long)
        return ids

    memo = ChunkMemo(of_chunks)

    def encode(texts):
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        plain = [d.split() if by_chunk and not any(o in d for o in opening) else None for d in data]
        long = memo.learn([c for c in plain if c is not None])
        ids = [None if c is None else b"".join(map(memo.known.__getitem__, c)) for c in plain]
        memo.forget(long)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, library([texts[i] for i in rest])):
            ids[i] = x
        return ids
    return encode


PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def tokenised_pieces(docs, path, capacity=CAPACITY, end_id=END_ID):
    """A row per piece, with the task that made it and its number among that task's pieces of its
    length."""
    end, width = np.asarray([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        encode = id_encoder(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first, last in batches_of_texts(texts):
                rows = []
                for name, ids in zip(names[first:last], encode(texts[first:last])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        length = len(part) // 4
                        rows.append((name, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                                 pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- the configuration program

def knapsack(lengths, values, bounds, capacity):
    """Multiplicities of greatest total value with total length within `capacity`.

    0/1 dynamic program over the bounds split into powers of two."""
    items = []
    for i, (length, bound) in enumerate(zip(lengths, bounds)):
        bound, take = min(int(bound), capacity // int(length)), 1
        while bound > 0:
            take = min(take, bound)
            items.append((i, take))
            bound -= take
            take *= 2
    best = np.zeros(capacity + 1)
    used = np.zeros((len(items), capacity + 1), bool)
    for k, (i, take) in enumerate(items):
        size = take * int(lengths[i])
        if size <= capacity:
            with_item = best[:capacity + 1 - size] + take * values[i]
            better = with_item > best[size:] + 1e-12
            used[k, size:] = better
            best[size:] = np.where(better, with_item, best[size:])
    counts, room = np.zeros(len(lengths), np.int64), capacity
    for k in range(len(items) - 1, -1, -1):
        if used[k, room]:
            i, take = items[k]
            counts[i] += take
            room -= take * int(lengths[i])
    return counts


def priced_configurations(lengths, demand, capacity, rounds=ROUNDS):
    """[(lengths, multiplicities, variable)] by multiplicative weights."""
    lengths, demand = np.asarray(lengths), np.asarray(demand, float)
    covered, found = np.zeros(len(demand)), []
    for _ in range(rounds):
        left = demand - covered
        open_ = np.flatnonzero(left >= 1)
        if not len(open_) or (left[open_] * lengths[open_]).sum() < 2 * capacity:
            break
        price = np.exp(GREED * left[open_] / demand[open_])             # per token
        ties = lengths[open_] * 2654435761 % (1 << 32)                   # lengths of every size
        core = open_[np.lexsort((ties, -price))[:CORE]]
        small = open_[:CORE // 4]                                        # short pieces close gaps
        core = np.unique(np.concatenate((core, small)))
        value = np.exp(GREED * left[core] / demand[core]) * lengths[core]
        counts = knapsack(lengths[core], value, left[core], capacity)
        if (counts * lengths[core]).sum() < LEAST_FILL * capacity:       # no gapless ones are left
            break
        taken = np.flatnonzero(counts)
        step = max(1.0, SHARE * (left[core[taken]] / counts[taken]).min())
        covered[core[taken]] += step * counts[taken]
        found.append((lengths[core[taken]], counts[taken], step))
    return found


def best_fit(lengths, counts, capacity):
    """Configurations with multiplicities that use up `counts`: the longest piece that fits, again
    and again, and the same layout as often as the counts allow."""
    left = {int(n): int(c) for n, c in zip(lengths, counts) if c > 0}
    order = sorted(left)
    while order:
        room, layout, at = capacity, [], len(order) - 1
        while at >= 0 and room >= order[0]:
            if order[at] <= room:
                take = min(room // order[at], left[order[at]])
                layout.append((order[at], take))
                room -= take * order[at]
            at = min(at - 1, int(np.searchsorted(order, room, "right")) - 1)
        times = min(left[n] // take for n, take in layout)
        for n, take in layout:
            left[n] -= take * times
        order = [n for n in order if left[n]] if any(not left[n] for n, _ in layout) else order
        yield layout, times


def lay_out(histogram, capacity=CAPACITY):
    """The plan for {length: count}: arrays sorted by key = length * 2**48 + first rank, each row
    saying for the ranks from there on the first sequence, the multiplicity and the offset."""
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    demand = np.array([histogram[n] for n in lengths], np.int64)
    left, layouts = demand.copy(), []
    for some, counts, variable in priced_configurations(lengths, demand, capacity):
        at, times = np.searchsorted(lengths, some), int(variable)
        times = min(times, int((left[at] // counts).min()))
        if times:
            left[at] -= times * counts
            layouts.append((list(zip(some.tolist(), counts.tolist())), times))
    layouts += best_fit(lengths, left, capacity)
    if histogram.get(capacity):
        layouts.append(([(capacity, 1)], histogram[capacity]))
    rank, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for layout, times in layouts:
        offset = 0
        for length, count in layout:
            rows.append(((length << 48) + rank[length], sequence, times, offset))
            rank[length] += count * times
            offset += count * length
        sequence += times
    assert rank == histogram, "every piece must have a place"
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4), sequence


def place_pieces(pieces, capacity=CAPACITY):
    """`tokenised_pieces` (written) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in                     # at most `capacity` rows
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(lay_out(histogram, capacity)[0])   # bounded: see the module

    def place(batches):
        keys, first_sequence, times, first_offset = plan.value.T
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            key = (length << 48) + rank
            at = np.searchsorted(keys, key, "right") - 1
            slot, which = np.divmod(key - keys[at], times[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(first_sequence[at] + which), pa.array(first_offset[at] + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(firsts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack(docs, tokenizer=TOKENIZER, capacity=CAPACITY, end_id=END_ID):
    """A row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(tokenised_pieces(docs, tokenizer_path(tokenizer), capacity, end_id), "pieces")
    return place_pieces(pieces, capacity)
