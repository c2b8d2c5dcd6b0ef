"""TF-IDF as tables: terms of a document, vocabulary, weights."""
import math

from pyspark.sql import Window, functions as F

from tidewatch.functions import text as tx
from tidewatch.operators import blocks, vectors
from tidewatch.session import settle

# Terms of more than one document in a thousand. The documents' distinct terms add up to at least
# n/1000 for each of them, so there are at most a thousand times as many as an average document has.
HEAVY_SHARE = 1000
HEAVY_IDF = math.log(HEAVY_SHARE) + 1.0
SLICES = 1024


def document_terms(df, text="text", bigrams=True, outer=False):
    """One row per document and distinct term with its count `tf`; other columns are carried along.

    Counting happens inside the row, so nothing is shuffled: a text without repeated terms counts one
    each, any other is sorted and its runs measured. With `outer` a document without terms keeps one
    row with a null term.
    """
    carried = [c for c in df.columns if c != text]
    words = df.select(*carried, tx.tokens(F.col(text)).alias("_words"))
    terms = tx.with_bigrams(F.col("_words")) if bigrams else F.col("_words")
    listed = words.select(*carried, terms.alias("_all"))
    repeats = F.size(F.array_distinct("_all")) < F.size("_all")
    listed = listed.select(*carried, "_all",
                           F.when(repeats, F.sort_array("_all")).alias("_terms"))
    n = F.size("_terms")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
        F.get(F.col("_terms"), i - 1) != F.get(F.col("_terms"), i - 2)))
    runs = listed.select(*carried, "_all", "_terms",
                         F.when(F.col("_terms").isNotNull(), starts).alias("_starts"))
    ends = F.concat(F.slice("_starts", 2, F.size("_terms")), F.array(n + 1))
    counted = F.zip_with("_starts", ends, lambda a, b: F.struct(
        F.get(F.col("_terms"), a - 1).alias("term"), (b - a).alias("tf")))
    once = F.transform("_all", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf")))
    entries = F.when(F.col("_terms").isNull(), once).otherwise(counted)
    spread = F.explode_outer(entries) if outer else F.explode(entries)
    return runs.select(*carried, spread.alias("_t")).select(*carried, "_t.term", "_t.tf")


def smooth_idf(df, n_docs):
    return F.ln((1.0 + n_docs) / (1.0 + df)) + 1.0


def sublinear(tf):
    return 1.0 + F.ln(tf.cast("double"))


def vocabulary(terms, n_docs, min_df=2):
    """Terms of at least `min_df` documents with their smooth inverse document frequency."""
    return (terms.where(F.col("term").isNotNull()).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
            .withColumn("idf", smooth_idf(F.col("df"), n_docs)))


def join_vocabulary(facts, vocab, keys, n_rows=None, doc="id", limit=2_000_000):
    """Terms of documents joined to what a vocabulary table (with `idf`) knows of them, left outer.

    A table known to be within `limit` rows is broadcast. Otherwise its heavy terms are, whose number
    does not depend on the number of documents; all other terms have few enough rows for a shuffled
    join, in which the rows served already are spread by document instead of by term.
    """
    if n_rows is not None and n_rows <= limit:
        return facts.join(F.broadcast(vocab), keys, "left")
    payload = [c for c in vocab.columns if c not in keys]
    heavy = F.col("idf") < HEAVY_IDF
    known = vocab.where(heavy).select(*keys, F.struct(*payload).alias("_heavy"))
    rare = vocab.where(~heavy).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.lit(-1).alias("_slice"),
        F.struct(*payload).alias("_rare"))
    served = F.col("_heavy").isNotNull()
    first = facts.join(F.broadcast(known), keys, "left").select(
        "*", *[F.when(~served, F.col(k)).alias(f"_{k}") for k in keys],
        F.when(served, F.pmod(F.xxhash64(doc), F.lit(SLICES)).cast("int")).otherwise(-1)
        .alias("_slice"))
    second = first.join(rare, [*[f"_{k}" for k in keys], "_slice"], "left")
    return second.select(
        *facts.columns, *[F.coalesce(f"_heavy.{c}", f"_rare.{c}").alias(c) for c in payload])


def tfidf(terms, vocab, doc="id"):
    """L2-normalised TF-IDF weights (doc, term, weight) of the terms in the vocabulary."""
    raw = join_vocabulary(terms.select(doc, "term", "tf"), vocab.select("term", "idf"), ["term"],
                          doc=doc).where(F.col("idf").isNotNull()) \
        .select(doc, "term", (sublinear(F.col("tf")) * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("_w") / norm).alias("weight"))


# A term of a vocabulary that is broadcast: its text, hash and weight, as sent to a task.
TERM_BYTES = 40


def vocabulary_bytes(n_words, min_df=2, bigrams=True):
    """What a vocabulary takes at most that comes from so many words."""
    return n_words * (2 if bigrams else 1) // max(min_df, 1) * TERM_BYTES


def vocabulary_of(df, text="text", min_df=2, bigrams=True, broadcast_bytes=vectors.BROADCAST_BYTES):
    """The vocabulary of texts; one that may be larger than `broadcast_bytes` is counted by blocks."""
    n_words, n_docs = blocks.count_words(df, text), df.count()
    if vocabulary_bytes(n_words, min_df, bigrams) <= broadcast_bytes:
        return vocabulary(document_terms(df.select(text), text, bigrams), n_docs, min_df)
    counted = blocks.block_vocabulary(df.select(text), n_words, text, min_df, bigrams)
    return counted.withColumn("idf", smooth_idf(F.col("df"), n_docs))


def tfidf_of(df, doc="id", text="text", min_df=2, bigrams=True, broadcast_bytes=vectors.BROADCAST_BYTES):
    """TF-IDF weights of texts: inside the task while the vocabulary, bounded by the counted words, is
    within `broadcast_bytes`, else by blocks of documents (`blocks`)."""
    n_words = blocks.count_words(df, text)
    if vocabulary_bytes(n_words, min_df, bigrams) > broadcast_bytes:
        return blocks.block_weights(df, n_words, doc, text, min_df, bigrams)
    terms = document_terms(df.select(doc, text), text, bigrams)
    vocab = settle(vocabulary(terms, df.count(), min_df))
    return vectors.normalised_weights(df, vocab, doc, text, bigrams)
