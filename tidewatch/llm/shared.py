"""Helpers of these operators: written tables, word and shingle hashes, memoised tokenizers."""
import ctypes
import os
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

SHINGLE_WORDS = 5


def new_folder(spark, name):
    """A folder of its own below the shared folder of the session, not yet created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name, partitions=None):
    """`df` as a table in the shared folder: computed once, whatever executor is lost later."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


HEAVY_KEYS = 10_000                              # at most so many keys are broadcast by join_counted


def heavy_bound(groups, count, least=200):
    """A number of rows that at most `HEAVY_KEYS` groups can have, by the sum of all counts."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    return max(least, -(-total // HEAVY_KEYS))


def join_counted(rows, groups, keys, count, spread, least=200, between=None):
    """`rows` left-joined to `groups` (unique in `keys`, never null), of which `count` says how many
    rows share the key.

    Groups with many rows are few, because the counts add up to all rows; they are broadcast, and
    their rows go on dealt out by the columns `spread`. The others are joined by shuffle. `between`
    changes the rows before it, when the groups' columns are there for the heavy ones as `_heavy_...`.
    """
    bound = heavy_bound(groups, count, least)
    others = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col(count) >= bound).select(
        *keys, *[F.col(c).alias(f"_heavy_{c}") for c in others], F.lit(True).alias("_heavy"))
    # Always 0, but not a literal: that would be folded away and with it the salt from the join's keys.
    light = groups.where(F.col(count) < bound).withColumn("_salt", F.least(F.col(count).cast("long"), F.lit(0)))
    salt = F.when(F.col("_heavy"), F.xxhash64(*spread).bitwiseOR(1)).otherwise(F.lit(0).cast("long"))
    first = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt)
    joined = (between(first) if between else first).join(light, [*keys, "_salt"], "left")
    return joined.withColumns({c: F.coalesce(f"_heavy_{c}", c) for c in others}).drop(
        "_salt", "_heavy", *[f"_heavy_{c}" for c in others])


def kept_by_worker(key, make):
    """`make()` once for `key` in this worker process; tasks that come later get the same object.

    These modules travel to the workers by value, so their own variables are new in every task.
    """
    holder = sys.modules.setdefault("tidewatch_worker", types.ModuleType("tidewatch_worker")).__dict__
    if key not in holder:
        holder[key] = make()
    return holder[key]


def batches_released(batches):
    """`batches`, giving what earlier ones have freed back to the system: reused workers would keep it."""
    for batch in batches:
        yield batch
        release_memory()
    release_memory()


def release_memory():
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # another C library
        pass


def text_of(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def bound(value, body):
    """The column `body(x)` with x standing for the column `value`, computed once a row even where
    the body uses it inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- words and shingles as hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15                       # odd, so that its powers have inverses
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 17
_tables = {}


def mix(h):
    """The finaliser of splitmix64, for arrays of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n):
    """Powers of the base and of its inverse, for at least `n` positions."""
    if _tables.get("n", 0) < n:
        size = max(n, _PIECE)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
        _tables["n"] = size
    return _tables["up"], _tables["down"]


def word_hashes(text, separators=_SPACE):
    """A 64-bit hash per word of `text` (str or None), A-Z lower-cased, in order.

    Works through pieces that end at a separator, so memory beyond the text itself stays small.
    """
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    gap = separators[data]
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _PIECE)
        if end < n:
            cut = np.flatnonzero(gap[at:end])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:                                # one word longer than a piece
                later = np.flatnonzero(gap[end:])
                end = end + int(later[0]) + 1 if len(later) else n
        found.append(_piece_hashes(data[at:end], ~gap[at:end]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _piece_hashes(data, inside):
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]
               + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingle_hashes(words, size=SHINGLE_WORDS):
    """A hash per run of `size` words in order; one for all words when there are fewer."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += words[i:n - size + 1 + i] * _PLACE[i]
    return mix(total)


def alnum_words(text):
    """Word hashes with ASCII punctuation as separators too."""
    return word_hashes(text, ~_ALNUM)


# ---------------------------------------------------------------- tokenizers by white-space chunk

class ChunkMemo:
    """Results of `encode(list of chunks)` for chunks between white space, kept for reuse.

    Holds at most `limit` chunks, none of over 64 characters beyond the call that needed it.
    """

    def __init__(self, encode, limit=500_000, at_once=20_000):
        self.encode, self.limit, self.at_once, self.known = encode, limit, at_once, {}

    def learn(self, lists):
        if len(self.known) > self.limit:
            self.known.clear()
        missing = list(set().union(*lists).difference(self.known))
        for i in range(0, len(missing), self.at_once):
            some = missing[i:i + self.at_once]
            self.known.update(zip(some, self.encode(some)))
        return [c for c in missing if len(c) > 64]

    def forget(self, chunks):
        for c in chunks:
            self.known.pop(c, None)


def tokenizer_path(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def batches_of_texts(texts, limit=1 << 21):
    """Index ranges of consecutive texts with about `limit` characters each."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def single_thread():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
