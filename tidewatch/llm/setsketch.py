"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct five-word shingles. Register i of a sketch is the truncated
logarithm, to a base near one, of the smallest of the exponential variables that a hash function
gives the members: registers of a union are the larger ones of the two sketches, and two registers
agree with a probability near the Jaccard similarity.

1. Every document is sketched where it is read. Equal sets share a key and collapse map-side into one
   class, which goes on alone: exact copies cost one row each from here on.
2. Bands of registers are hashed; only classes that share a band with another one go on. Within a band
   they are joined when the joint likelihood of their registers, given the exact set sizes, rises
   towards a similarity above `ESTIMATE`.
3. The joined groups fetch their texts, and within each group links are confirmed on the full sets.
4. A component's id is the smallest doc_id of all rows in its classes.

Defined cases: null, empty or blank text has an empty set and no links; with fewer than five words
the whole sequence is one shingle; a row without doc_id is not linked, has no component and stays;
repeated rows each get a result, all with the same component; `keep_one` decides by row, told by doc_id
and text, so of rows that share an id each stays or goes with its own text. Other columns are not
looked at. Classes that many rows share reach their rows by broadcast (`join_counted`).
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm.components import components, link_within
from tidewatch.llm.shared import batches_released, join_counted, mix, shingle_hashes, text_of, word_hashes, written

REGISTERS = 128
BAND = 4                     # registers of a band; 32 bands miss a pair of 0.75 once in 190,000
LOG_BASE = float(np.log(1.001))
BASE_SHARE = 1 - 1 / 1.001   # (base - 1) / base
RATE = 20.0
TOP = 65535
ESTIMATE = 0.55              # five standard errors of 128 registers below 0.75
NUMERATOR, DENOMINATOR = 75, 100
BLOCK_CLASSES = 4096         # classes of a band compared in one task
BLOCK_SHINGLES = 2_000_000   # shingles of a group compared in one task

_STEP = np.uint64(1 << 11)


def _functions(n=REGISTERS):
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def registers(members, functions=None):
    """Registers of a set of 64-bit hashes, as unsigned 16-bit numbers."""
    factor, shift = functions or _functions()
    low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 512):
        some = members[at:at + 512]
        np.minimum(low, (factor[:, None] * some[None, :] + shift[:, None]).min(axis=1), out=low)
    share = (low.astype(float) + 1.0) / 2.0**64
    point = -np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(point) / LOG_BASE), 0, TOP).astype("<u2")


def band_keys(sketch):
    """One 64-bit key per band."""
    bands = sketch.reshape(-1, BAND)
    return [xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) - (1 << 63) for i, b in enumerate(bands)]


def surely_below(first, first_size, others, other_sizes, at=ESTIMATE):
    """True where the likelihood of the registers is greatest below the similarity `at`."""
    total = first_size + other_sizes
    u, v = first_size / total, other_sizes / total
    above = (first[None, :] > others).sum(axis=1)
    below = (first[None, :] < others).sum(axis=1)
    same = others.shape[1] - above - below
    impossible = np.minimum(u, v) / np.maximum(u, v) < at
    x, y = np.clip(u - v * at, 1e-9, 1), np.clip(v - u * at, 1e-9, 1)
    p = lambda z: -np.log1p(-z * BASE_SHARE) / LOG_BASE                  # noqa: E731
    slope = lambda z: BASE_SHARE / (1 - z * BASE_SHARE) / LOG_BASE       # noqa: E731
    rise = (-above * v * slope(x) / p(x) - below * u * slope(y) / p(y)
            + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - p(x) - p(y), 1e-12))
    return impossible | (rise < 0)


def sketched(docs):
    """A row per document: doc_id, n_shingles, a hash of the text, set_key (null without a set or an
    id), and the sketch, null where this task has given it for the same key before."""
    def sketch(batches):
        functions, seen = _functions(), {}
        for batch in batches_released(batches):
            keys, sizes, sketches = [], [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                members = np.unique(shingle_hashes(word_hashes(text.as_py())))
                sizes.append(len(members))
                if not len(members) or name is None:
                    keys.append(None)
                    sketches.append(None)
                    continue
                key = xxhash.xxh3_128_digest(members.tobytes())
                keys.append(key)
                sketches.append(None if key in seen else registers(members, functions).tobytes())
                if len(seen) > 200_000:
                    seen.clear()
                seen[key] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("text_hash"),
                 pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "text_hash", "set_key", "sketch"])

    return docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(
        sketch, "doc_id long, n_shingles long, text_hash long, set_key binary, sketch binary")


def banded(classes):
    """(band, id) per class and band."""
    def bands(batches):
        for batch in batches_released(batches):
            keys = [band_keys(np.frombuffer(s, "<u2")) for s in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.list_(pa.int64())), batch.column("set_key")], ["bands", "set_key"])
    return classes.select("set_key", "sketch").mapInArrow(bands, "bands array<long>, set_key binary").select(
        F.explode("bands").alias("group"), F.col("set_key").alias("id"))


def register_linker(pdf):
    sketches = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(len(pdf), -1)
    sizes = pdf["n_shingles"].to_numpy(float)
    return lambda u, others: ~surely_below(sketches[u], sizes[u], sketches[others], sizes[others])


def set_linker(pdf):
    """Exact links on the full sets; sizes and registers only spare comparisons that cannot succeed."""
    sets = [np.unique(shingle_hashes(word_hashes(t))) for t in pdf["text"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    likely = register_linker(pdf)

    def linked(u, others):
        near = np.zeros(len(others), bool)
        small, large = np.minimum(sizes[u], sizes[others]), np.maximum(sizes[u], sizes[others])
        able = np.flatnonzero((DENOMINATOR * small >= NUMERATOR * large) & likely(u, others))
        for start in range(0, len(able), 1024):
            some = able[start:start + 1024]
            flat = np.concatenate([sets[v] for v in others[some]]) if len(some) else np.zeros(0, np.uint64)
            found = np.searchsorted(sets[u], flat)
            hit = sets[u][np.minimum(found, sizes[u] - 1)] == flat
            ends = np.cumsum(sizes[others[some]])
            counts = np.concatenate(([0], np.cumsum(hit)))
            common = counts[ends] - counts[ends - sizes[others[some]]]
            union = sizes[u] + sizes[others[some]] - common
            near[some] = DENOMINATOR * common >= NUMERATOR * union
        return near
    return linked


def _judged(docs):
    """doc_id, text_hash, n_shingles, component_id and kept for every row of `docs`."""
    rows = written(sketched(docs), "sketches")
    classes = written(rows.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n_shingles"),
        F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_rows")).select(
            "set_key", "n_shingles", "sketch", "n_rows", F.col("first.doc_id").alias("first_id"),
            F.col("first.text_hash").alias("text_hash")), "classes")

    bands = written(banded(classes), "bands")
    shared = bands.groupBy("group").agg(                     # bands with the same classes count once
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1").groupBy(
            "n", "members").agg(F.min("group").alias("group")).select("group")
    near = bands.join(shared, "group").join(
        classes.select(F.col("set_key").alias("id"), "n_shingles", "sketch"), "id")
    candidates = link_within(near.withColumn("weight", F.lit(1)), register_linker,
                             ["n_shingles", "sketch"], BLOCK_CLASSES)

    groups = components(candidates)
    members = groups.join(classes, F.col("node") == F.col("set_key")).select(
        F.col("label").alias("group"), F.col("set_key").alias("id"), "first_id", "text_hash", "n_shingles", "sketch")
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("first_id"), F.xxhash64("text").alias("text_hash"), "text")
    with_text = texts.join(members, ["first_id", "text_hash"]).select("group", "id", "n_shingles", "sketch", "text",
                                    F.col("n_shingles").alias("weight"))
    links = link_within(written(with_text, "candidates"), set_linker,
                        ["n_shingles", "sketch", "text"], BLOCK_SHINGLES)

    linked = components(links).join(classes, F.col("node") == F.col("set_key")).select(
        "label", "set_key", "first_id")
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_key = linked.join(smallest, "label").select("set_key", "component_id")
    own = written(classes.select("set_key", "first_id", "n_rows").join(by_key, "set_key", "left").select(
        "set_key", "n_rows", F.coalesce("component_id", "first_id").alias("component_id")), "components-of-sets")
    narrow = rows.select("doc_id", "text_hash", "n_shingles", "set_key")
    result = join_counted(narrow.where("set_key is not null"), own, ["set_key"], "n_rows", ["doc_id", "text_hash"])
    alone = narrow.where("set_key is null").withColumn("component_id", F.lit(None).cast("long"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    component = F.coalesce("component_id", "doc_id")
    return result.select(*columns).unionByName(alone.select(*columns)).select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_groups(docs):
    """doc_id, n_shingles, component_id and kept for every row of `docs`."""
    return _judged(docs).drop("text_hash")


def keep_one(docs):
    """The rows of `docs` that stay, with all their columns: one document of each group."""
    gone = _judged(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")
