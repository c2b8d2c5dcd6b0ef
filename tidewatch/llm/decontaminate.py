"""Benchmark items inside documents, by size-partitioned MinHash search and exact containment.

Words are lower-cased runs of letters and digits, shingles are five of them. Items of up to `LEAST_SIZE`
shingles are searched by the shingles themselves: of an item of n, as many as a document with the
share asked for cannot lack all of, so none is missed. Larger items are partitioned by
their number of shingles, each partition reaching to a power of two. A document is cut into windows
for each partition: twice as long as the partition's largest item, starting every such length, so an
item that stands in the document lies wholly inside a window at most about four times its size. That
bounds the similarity of the two sets from below whatever the document's length, and any one of the
`FUNCTIONS` minima that agrees makes a candidate.

The items' minima go to the tasks as a Bloom filter of at least 256 bits a key; windows with a minimum
that the filter knows become rows, joined to the items' minima for the exact candidates. A benchmark with
more keys than the largest filter serves is dealt into parts that are searched one after the other. A
candidate is confirmed by the share of the item's shingles in the whole document. Documents without a hit
never leave their task.

Defined cases: an item of one to four words is one shingle and is found where these words stand in a
row; an item without words or id, and a document without words, matches nothing; repeated items and
repeated documents are matched each by itself, by rows, and reported once per pair of ids (pairs without
a doc_id are not reported); `clean` decides by row, told by doc_id (null or not) and text, so rows that
share an id, or have none, do not decide for each other; an empty benchmark or corpus gives no rows;
other columns are not looked at.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm.shared import batches_released, SHINGLE_WORDS, alnum_words, mix, shingle_hashes, text_of, written

FUNCTIONS = 64
LEAST_SIZE = 8               # items of up to so many shingles are searched exactly
CONTAINED = 0.75
BITS_PER_KEY = 256           # three probes: some 2 in a million foreign keys pass and go on to the join
LEAST_BITS, MOST_BITS = 24, 29   # a filter has 2**24 to 2**29 bits: 2 to 64 MB
UNPACKED_BITS = 26           # up to here a task looks bits up as bytes of their own
PROBES = (35, 17, 0)         # each takes the filter's number of bits of a key, from there on
BITMAP = 1 << 15             # bits that one row of the filter's table holds

_SEEDS = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FACTOR, _SHIFT = _SEEDS[:FUNCTIONS] | np.uint64(1), _SEEDS[FUNCTIONS:]


def partition_size(n_shingles):
    """The upper bound of the partition that a set of this size is in."""
    size = LEAST_SIZE
    while size < n_shingles:
        size *= 2
    return size


def block_minima(members, size):
    """The minima of all functions over consecutive blocks of `size` members: (functions, blocks)."""
    starts = np.arange(0, len(members), size)
    out = np.empty((FUNCTIONS, len(starts)), np.uint64)
    for i in range(FUNCTIONS):
        out[i] = np.minimum.reduceat(members * _FACTOR[i] + _SHIFT[i], starts)
    return out


def joined_blocks(minima):
    """The minima over pairs of neighbouring blocks; a last block without a neighbour stays alone."""
    pairs = minima.shape[1] // 2
    return np.concatenate((np.minimum(minima[:, 0:2 * pairs:2], minima[:, 1:2 * pairs:2]), minima[:, 2 * pairs:]), axis=1)


def shingle_keys(shingles, width):
    """One 64-bit key per shingle, for items of up to `LEAST_SIZE` of them."""
    return mix(shingles ^ mix(np.array([(1 << 32) + width], np.uint64)))


def needed(shingles, contained):
    """So many of an item's shingles that a document with that share of them has one of these."""
    lacking = int(np.floor(len(shingles) * (1 - contained) + 1e-9))
    return shingles[:max(1, lacking + 1)]


def minima_keys(minima, width, partition):
    """One 64-bit key per minimum: function, partition and shingle width are part of it."""
    mark = mix(np.arange(FUNCTIONS, dtype=np.uint64) * np.uint64(131) + np.uint64(partition * 7 + width))
    return mix(minima ^ (mark[:, None] if minima.ndim == 2 else mark))


def item_rows(benchmark, contained=CONTAINED):
    """Items with words: item_id, row key, width, partition, shingles (distinct) and keys."""
    def rows(batches):
        for batch in batches_released(batches):
            out = []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                words = alnum_words(text.as_py())
                if name is None or not len(words):
                    continue
                width = min(SHINGLE_WORDS, len(words))
                shingles = np.unique(shingle_hashes(words))
                partition = partition_size(len(shingles))
                if partition == LEAST_SIZE:
                    keys = shingle_keys(needed(shingles, contained), width)
                else:
                    keys = minima_keys(block_minima(shingles, len(shingles))[:, 0], width, partition)
                out.append((name, width, partition, shingles.view(np.int64), keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (
                    pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                ["item_id", "width", "partition", "shingles", "keys"])
    return benchmark.select("item_id", "text").mapInArrow(
        rows, "item_id long, width int, partition int, shingles array<long>, keys array<long>").withColumn(
            "item", F.xxhash64("item_id", "shingles"))


def filter_bits(n_keys):
    """How many bits the filter of so many keys has, as a power of two, up to `MOST_BITS`."""
    bits = LEAST_BITS
    while bits < MOST_BITS and (1 << bits) < BITS_PER_KEY * n_keys:
        bits += 1
    return bits


def bit_table(items, bits):
    """The filter of all item keys as bytes: at most 2**(bits - 15) rows of 4 KB are collected."""
    places = [F.shiftrightunsigned(F.col("key"), p).bitwiseAND(F.lit((1 << bits) - 1)) for p in PROBES]
    place = F.col("place")
    rows = items.select(F.explode("keys").alias("key")).select(F.explode(F.array(*places)).alias("place")).groupBy(
        F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(BITMAP - 1)).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toLocalIterator():
        table[row["part"] * (BITMAP // 8):(row["part"] + 1) * (BITMAP // 8)] = np.frombuffer(row["bits"], np.uint8)
    return table


def candidates(docs, table, kinds):
    """Rows of documents with at least one hit: doc_id, a hash of the text, all distinct shingles, and
    the hit keys."""
    def search(batches):
        bits = table.value
        mask = np.uint64(8 * len(bits) - 1)
        unpacked = np.unpackbits(bits, bitorder="little") if 8 * len(bits) <= 1 << UNPACKED_BITS else None

        def known(keys, probe):
            place = (keys >> np.uint64(probe)) & mask
            if unpacked is not None:
                return unpacked[place] == 1
            return bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1

        largest = {w: max(p for v, p in kinds if v == w) for w, _ in kinds}
        for batch in batches_released(batches):
            out = []
            for name, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(),
                                        batch.column("text")):
                words = alnum_words(text.as_py())
                hits, members = [], []
                for width in sorted(largest):
                    if len(words) < width:
                        continue
                    shingles = shingle_hashes(words, width)
                    minima, size = None, LEAST_SIZE
                    while size <= largest[width]:
                        if largest[width] > LEAST_SIZE:
                            minima = block_minima(shingles, size) if minima is None else joined_blocks(minima)
                        if (width, size) in kinds:
                            if size == LEAST_SIZE:
                                hit = shingle_keys(shingles, width)
                            else:
                                window = np.minimum(minima, np.concatenate((minima[:, 1:], minima[:, -1:]), axis=1))
                                hit = minima_keys(window, width, size).ravel()
                            for probe in PROBES:
                                hit = hit[known(hit, probe)]
                            if len(hit):
                                hits.append(np.unique(hit))
                        size *= 2
                    members.append(shingles)
                if hits:
                    out.append((name, mark, np.unique(np.concatenate(members)).view(np.int64),
                                np.concatenate(hits).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (
                    pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                ["doc_id", "text_hash", "shingles", "keys"])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        search, "doc_id long, text_hash long, shingles array<long>, keys array<long>").withColumn(
            "row", F.xxhash64("doc_id", "text_hash"))


def _hits(docs, benchmark, contained):
    """doc_id, text_hash, item_id, n_shared and n_item of every row and item it contains; None without items."""
    spark = docs.sparkSession
    items = written(item_rows(benchmark, contained), "items")
    n_keys = items.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = -(-n_keys * BITS_PER_KEY // (1 << MOST_BITS))
    found = []
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else items
        kinds = {(r["width"], r["partition"]) for r in some.select("width", "partition").distinct().collect()}
        if kinds:
            found.append(_search(docs, some, kinds, filter_bits(n_keys // parts), contained))
    whole = found[0] if found else None
    for one in found[1:]:
        whole = whole.unionByName(one)
    return whole


def _search(docs, items, kinds, bits, contained):
    table = docs.sparkSession.sparkContext.broadcast(bit_table(items, bits))
    hits = written(candidates(docs, table, kinds), "hits")
    pairs = hits.select("row", F.explode("keys").alias("key")).join(
        items.select("item", F.explode("keys").alias("key")), "key").select("row", "item").distinct()
    both = pairs.join(hits.select("row", "doc_id", "text_hash", F.col("shingles").alias("document")), "row").join(
        items.select("item", "item_id", "shingles"), "item")
    n_item = F.size("shingles").cast("long")
    shared = F.size(F.array_intersect("shingles", "document")).cast("long")
    counted = both.select("doc_id", "text_hash", "item_id", shared.alias("n_shared"), n_item.alias("n_item"))
    return counted.where(F.col("n_shared") >= contained * F.col("n_item"))


def contaminated(docs, benchmark, contained=CONTAINED):
    """doc_id, item_id, n_shared, n_item and containment of every pair in which the document has at
    least that share of the item's shingles, for the pairs with an item of its size in one place."""
    found = _hits(docs, benchmark, contained)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, n_shared long, n_item long, containment double")
    return found.where("doc_id IS NOT NULL").groupBy("doc_id", "item_id").agg(
        F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item")).withColumn(
            "containment", F.col("n_shared") / F.col("n_item"))


def clean(docs, benchmark, contained=CONTAINED):
    """The rows of `docs` in which no item is contained, with all their columns."""
    found = _hits(docs, benchmark, contained)
    if found is None:
        return docs
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")
