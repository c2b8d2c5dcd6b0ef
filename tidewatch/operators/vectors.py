"""Documents as sparse vectors over a vocabulary that is looked up inside the task.

Words are split and hashed by Spark's own functions; a task gets them as numbers, adds the hashes of
neighbouring pairs, and finds the terms it knows in a sorted array of hashes. Nothing is exploded and
nothing is shuffled. The array is broadcast, so it is only built for vocabularies whose counted size is
within a limit; `blocks` serves larger ones.

Terms are told apart by 64-bit hashes: a word outside a vocabulary of a million terms is taken for one
of them with a chance of about 5e-14.
"""
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F, types as T

from tidewatch.functions import text as tx

WORDS_AT_ONCE = 1 << 19
BROADCAST_BYTES = 128 << 20


def release_memory():
    """Gives the task's freed memory back, which Arrow and the C library keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # another C library
        pass


def hashed_words(text):
    """The words of a text as 64-bit hashes, in order."""
    return F.transform(tx.tokens(text), lambda w: F.xxhash64(w))


def term_parts(term):
    """The hashes of the one or two words of a term; `_second` is null for one word."""
    words = F.split(term, " ")
    return [F.xxhash64(F.get(words, F.lit(0))).alias("_first"),
            F.when(F.size(words) > 1, F.xxhash64(F.get(words, F.lit(1)))).alias("_second")]


def _pair(first, second):
    """The hash of two neighbouring words, from theirs."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashes_of(parts):
    """Term hashes from an Arrow table with the columns of `term_parts`."""
    first = parts.column("_first").to_numpy().astype(np.int64).view(np.uint64)
    second = parts.column("_second")
    alone = np.asarray(second.is_null())
    both = _pair(first, second.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))
    return np.where(alone, first, both)


def counted_terms(hashes, words, starts, bigrams):
    """Known terms of documents: document, place in `hashes` (sorted) and count, in that order.

    `words` are the word hashes of all documents, `starts` where each begins, and the end."""
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if bigrams and len(words) > 1:
        inside = doc[1:] == doc[:-1]
        words, doc = (np.concatenate([words, _pair(words[:-1], words[1:])[inside]]),
                      np.concatenate([doc, doc[1:][inside]]))
    if not len(hashes):
        words, doc = words[:0], doc[:0]
    at = np.minimum(np.searchsorted(hashes, words), max(len(hashes) - 1, 0))
    known = hashes[at] == words
    key = np.sort(doc[known] * max(len(hashes), 1) + at[known])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // max(len(hashes), 1), key[first] % max(len(hashes), 1), np.diff(first, append=len(key))


def _slices(batch):
    """Parts of a batch with about `WORDS_AT_ONCE` words each: rows, word hashes and starts."""
    lists = batch.column("_words")
    offsets = lists.offsets.to_numpy()
    words = lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + WORDS_AT_ONCE)))
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start), words[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


# ---------------------------------------------------------------- vectors for fitting

_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def count_vectors(df, hashes, folder, text="text", bigrams=True):
    """`df` without its text and with `v`, the sublinear term counts, as a table at `folder`."""
    spark, others = df.sparkSession, [c for c in df.columns if c != text]
    held = spark.sparkContext.broadcast(hashes)

    def run(batches):
        known = held.value
        for batch in batches:
            for rows, words, starts in _slices(batch):
                doc, at, n = counted_terms(known, words, starts, bigrams)
                offsets = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(rows.num_rows, np.int8)), pa.array(np.full(rows.num_rows, len(known), np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(1.0 + np.log(n)))],
                    ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*map(rows.column, others), vector], [*others, "v"])

    words = df.select(*others, hashed_words(F.col(text)).alias("_words"))
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField("v", T._parse_datatype_string(_VECTOR))])
    words.mapInArrow(run, schema).write.mode("overwrite").parquet(folder)
    # the struct is how Spark ML stores its vectors
    return spark.read.schema(T.StructType(schema.fields[:-1] + [T.StructField("v", VectorUDT())])).parquet(folder)


# ---------------------------------------------------------------- weights

def normalised_weights(df, vocab, doc="id", text="text", bigrams=True):
    """(doc, term, weight): L2-normalised TF-IDF weights of the terms in `vocab` (term, idf), which is
    broadcast as arrays; a document's weights are complete where it is read."""
    rows = vocab.select("term", "idf", *term_parts(F.col("term"))).toArrow()
    found = hashes_of(rows)
    order = np.argsort(found, kind="stable")
    held = df.sparkSession.sparkContext.broadcast((
        found[order], rows.column("idf").to_numpy()[order],
        rows.column("term").combine_chunks().take(pa.array(order))))

    def run(batches):
        hashes, idf, terms = held.value
        for batch in batches:
            for some, words, starts in _slices(batch):
                row, at, n = counted_terms(hashes, words, starts, bigrams)
                w = (1.0 + np.log(n)) * idf[at]
                norm = np.sqrt(np.bincount(row, w * w, some.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [some.column(doc).take(pa.array(row)), terms.take(pa.array(at)), pa.array(w / norm[row])],
                    [doc, "term", "weight"])

    schema = T.StructType([df.schema[doc], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return df.select(doc, hashed_words(F.col(text)).alias("_words")).mapInArrow(run, schema)


# ---------------------------------------------------------------- scoring

@dataclass
class ScoringTable:
    """Weights of one or more models over the union of their vocabularies."""
    hashes: np.ndarray        # sorted
    idf: np.ndarray           # models x terms; 0 where a model does not know the term
    coef: np.ndarray          # models x classes x terms
    bias: np.ndarray          # models x classes

    @classmethod
    def of(cls, table, intercepts):
        """From rows (model, term, idf, coef)."""
        rows = table.select("model", *term_parts(F.col("term")), "idf", "coef").toArrow()
        found, bias = hashes_of(rows), np.asarray(intercepts, float)
        hashes, at = np.unique(found, return_inverse=True)
        model = rows.column("model").to_numpy()
        idf = np.zeros((len(bias), len(hashes)))
        coef = np.zeros((*bias.shape, len(hashes)))
        idf[model, at] = rows.column("idf").to_numpy()
        coef[model, :, at] = rows.column("coef").combine_chunks().flatten().to_numpy().reshape(-1, bias.shape[1])
        return cls(hashes, idf, coef, bias)


def _probabilities(idf, coef, bias, doc, at, n, model):
    """Of documents with the terms (doc, at, n), each by the model of that number."""
    own = model[doc]
    w = (1.0 + np.log(n)) * idf[own, at]
    norm = np.sqrt(np.bincount(doc, w * w, len(model)))
    scores = bias[model].copy()
    for c in range(scores.shape[1]):
        total = np.bincount(doc, w * coef[own, c, at], len(model))
        scores[:, c] += np.divide(total, norm, out=np.zeros(len(model)), where=norm > 0)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def table_bytes(n_models, n_terms, n_classes):
    return 8 * n_terms * (1 + n_models * (1 + n_classes))


def class_probabilities(table, df, text="text", bigrams=True, own=None):
    """`df` without its text and with `model` and `probability`: one row for the model that the integer
    column `own` names, or one for every model."""
    others = [c for c in df.columns if c != text]
    held = df.sparkSession.sparkContext.broadcast((table.hashes, table.idf, table.coef, table.bias))

    def run(batches):
        hashes, *weights = held.value
        n_models = len(weights[-1])
        for batch in batches:
            for rows, words, starts in _slices(batch):
                terms = counted_terms(hashes, words, starts, bigrams)
                chosen = ([rows.column(own).to_numpy().astype(np.int64)] if own is not None else
                          [np.full(rows.num_rows, m) for m in range(n_models)])
                for model in chosen:
                    scores = _probabilities(*weights, *terms, model)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
                    yield pa.RecordBatch.from_arrays([*map(rows.column, others), pa.array(model.astype(np.int32)), lists],
                                                     [*others, "model", "probability"])

    schema = T.StructType([df.schema[c] for c in others] + [
        T.StructField("model", T.IntegerType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])
    return df.select(*others, hashed_words(F.col(text)).alias("_words")).mapInArrow(run, schema)
