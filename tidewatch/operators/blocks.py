"""Texts whose vocabulary is too large for a broadcast, weighed, fitted and scored by blocks of documents.

Documents are packed into blocks of about `BLOCK_WORDS` words, written once as word numbers. A block asks
for the document frequencies of its distinct terms, by ranges of the term hashes; a range gets every block's
counts, adds them up and answers each block; a block with its answers has the weights of its documents.
What moves is one number per distinct term of a block, not one row per term of a document, and the
documents once. A task holds one block, or the terms of one range, whose number grows with the words.

Terms are told apart by 64-bit hashes, as in `vectors`.
"""
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions import text as tx
from tidewatch.operators import vectors
from tidewatch.session import new_folder

BLOCK_WORDS = 1 << 18
RANGE_WORDS = 1 << 21

_passing = []                 # folders of blocks to delete, by `passing`


@contextmanager
def passing(spark):
    """Blocks that are written inside are deleted at its end, and the shuffles of tables that nobody holds."""
    folders = []
    _passing.append(folders)
    try:
        yield
    finally:
        _passing.remove(folders)
        jvm = spark.sparkContext._jvm
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def _lean(function):
    """A task function that gives back what it needed on the way."""
    def one(table):
        out = function(table)
        vectors.release_memory()
        return out

    def two(left, right):
        out = function(left, right)
        vectors.release_memory()
        return out
    return one if function.__code__.co_argcount == 1 else two


def block_words(blocks):
    """How many words blocks have."""
    return blocks.agg(F.coalesce(F.sum(F.size("codes").cast("long")), F.lit(0))).first()[0]


def count_words(df, text="text"):
    return df.agg(F.coalesce(F.sum(F.size(tx.tokens(F.col(text))).cast("long")), F.lit(0))).first()[0]


def _packed(doc, kind):
    """The task function that packs documents: their ids, where each starts, the distinct words with their
    hashes, and the words of all documents by number."""
    def pack(held):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("_words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        hashed = table.column("_hashes").combine_chunks()
        hashed = hashed.chunk(0) if isinstance(hashed, pa.ChunkedArray) else hashed
        at = hashed.offsets.to_numpy()
        hashes = hashed.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        of_word = np.zeros(len(coded.dictionary), np.int64)
        of_word[codes] = hashes
        values = [table.column(doc).to_pylist(), (offsets - offsets[0]).astype(np.int32),
                  coded.dictionary, of_word, codes.astype(np.int32)]
        kinds = [pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k.value_type))
             for v, k in zip(values, kinds)], ["docs", "starts", "words", "hashes", "codes"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ends = batch.column("_words").offsets.to_numpy()
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(ends, ends[start] + BLOCK_WORDS - n))
                end = min(max(end, start + 1), batch.num_rows)
                held.append(batch.slice(start, end - start))
                n += int(ends[end] - ends[start])
                start = end
                if n >= BLOCK_WORDS or start < batch.num_rows:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)
    return run


def blocks_of(df, doc="id", text="text"):
    """One row per block, written once; `block` numbers them."""
    spark = df.sparkSession
    words = df.select(doc, tx.tokens(F.col(text)).alias("_words")).select(
        doc, "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    kind = T.ArrayType(df.schema[doc].dataType)
    schema = T.StructType([T.StructField("docs", kind), *T._parse_datatype_string(
        "starts array<int>, words array<string>, hashes array<bigint>, codes array<int>").fields])
    folder = new_folder(spark, "blocks")
    if _passing:
        _passing[-1].append(folder)
    words.mapInArrow(_packed(doc, to_arrow_type(df.schema[doc].dataType)), schema).withColumn(
        "block", F.monotonically_increasing_id()).write.parquet(folder)
    return spark.read.parquet(folder)


class Block:
    """The terms of one block, from its row: sorted hashes, and per document and term a place and a count."""

    def __init__(self, row, bigrams):
        get = lambda name: row.column(name).combine_chunks().flatten()
        self.docs, self.words = get("docs"), get("words")
        of_word = get("hashes").to_numpy().view(np.uint64)
        codes, starts = get("codes").to_numpy().astype(np.int64), get("starts").to_numpy()
        doc = np.repeat(np.arange(len(self.docs)), np.diff(starts))
        first, second = codes, np.full(len(codes), -1)
        if bigrams and len(codes) > 1:
            inside = doc[1:] == doc[:-1]
            first = np.concatenate([codes, codes[:-1][inside]])
            second = np.concatenate([second, codes[1:][inside]])
            doc = np.concatenate([doc, doc[1:][inside]])
        of_term = of_word[first]
        pair = second >= 0
        of_term[pair] = vectors._pair(of_word[first[pair]], of_word[second[pair]])
        self.hashes, some, at = np.unique(of_term, return_index=True, return_inverse=True)
        self.first, self.second = first[some], second[some]
        key = np.sort(doc * max(len(self.hashes), 1) + at)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.doc, self.at = np.divmod(key[new], max(len(self.hashes), 1))
        self.tf = np.diff(new, append=len(key))

    def terms(self, at):
        """The strings of terms by place."""
        first = self.words.take(pa.array(self.first[at]))
        second = self.second[at]
        both = pc.binary_join_element_wise(
            first, self.words.take(pa.array(np.maximum(second, 0))), " ")
        return pc.if_else(pa.array(second >= 0), both, first)


def _bounds(n_ranges):
    return np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], np.uint64)


def _requests(n_ranges, bigrams):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                b = Block(one, bigrams)
                n = np.bincount(b.at, minlength=len(b.hashes)).astype(np.int32)
                cuts = [0, *np.searchsorted(b.hashes, _bounds(n_ranges)), len(b.hashes)]
                parts = [(i, s, e) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                yield pa.RecordBatch.from_arrays([
                    pa.array([one.column("block")[0].as_py()] * len(parts), pa.int64()),
                    pa.array([i for i, _, _ in parts], pa.int32()),
                    pa.array([b.hashes[s:e].tobytes() for _, s, e in parts], pa.binary()),
                    pa.array([n[s:e].tobytes() for _, s, e in parts], pa.binary())], ["block", "range", "hashes", "n"])
                del one, b, n
                vectors.release_memory()
    return run


def _joined(table, column, dtype):
    """The numbers of all rows of a binary column, as they lie in memory."""
    parts = [np.zeros(0, dtype)]
    for chunk in table.column(column).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1] if len(chunk) else [0]
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(dtype))
    return parts[1] if len(parts) == 2 else np.concatenate(parts)


@_lean
def _answers(table):
    """The document frequencies of a range's terms, for each block in the order it asked."""
    _, some, at = np.unique(_joined(table, "hashes", np.uint64), return_index=True, return_inverse=True)
    df, first = np.bincount(at, _joined(table, "n", np.int32))[at].astype(np.int32), np.zeros(len(at), bool)
    first[some] = True                                       # one block of each term
    ends = np.cumsum(pc.binary_length(table.column("hashes")).to_numpy() // 8)[:-1]
    parts = [pa.array([part.tobytes() for part in np.split(v, ends)], pa.binary()) for v in (df, first)]
    return pa.table([table.column("block"), table.column("range"), *parts], ["block", "range", "df", "first"])


def block_weights(df, n_words, doc="id", text="text", min_df=2, bigrams=True):
    """(doc, term, weight): L2-normalised TF-IDF weights of the terms of at least `min_df` documents."""
    blocks, n_docs = blocks_of(df, doc, text), df.count()
    n_ranges = max(1, -(-n_words // RANGE_WORDS))
    asked = blocks.mapInArrow(_requests(n_ranges, bigrams), "block long, range int, hashes binary, n binary")
    answered = asked.groupBy("range").applyInArrow(_answers, "block long, range int, df binary, first binary")

    @_lean
    def weigh(left, right):
        b = Block(left, bigrams)
        order = np.argsort(right.column("range").to_numpy())
        found = right.column("df").to_pylist()
        df_of = np.concatenate([np.frombuffer(found[i], np.int32) for i in order]) if len(order) else np.zeros(0)
        known = df_of[b.at] >= min_df
        row, at, n = b.doc[known], b.at[known], b.tf[known]
        w = (1.0 + np.log(n)) * (np.log((1.0 + n_docs) / (1.0 + df_of[at])) + 1.0)
        norm = np.sqrt(np.bincount(row, w * w, len(b.docs)))
        return pa.table([b.docs.take(pa.array(row)), b.terms(at), pa.array(w / norm[row])], [doc, "term", "weight"])

    schema = T.StructType([df.schema[doc], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(weigh, schema)


def block_vocabulary(df, n_words, text="text", min_df=2, bigrams=True):
    """(term, df) of the terms of at least `min_df` documents; one block names each of them."""
    return named_terms(blocks_of(df.withColumn("_doc", F.lit(0)), "_doc", text), n_words, min_df, bigrams)


def named_terms(blocks, n_words, min_df=2, bigrams=True):
    """`block_vocabulary` of blocks."""
    n_ranges = max(1, -(-n_words // RANGE_WORDS))
    asked = blocks.mapInArrow(_requests(n_ranges, bigrams), "block long, range int, hashes binary, n binary")
    answered = asked.groupBy("range").applyInArrow(_answers, "block long, range int, df binary, first binary")

    @_lean
    def named(left, right):
        b = Block(left, bigrams)
        order = np.argsort(right.column("range").to_numpy())
        if not len(order):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], ["term", "df"])
        right = right.take(pa.array(order))
        df_of = _joined(right, "df", np.int32)
        at = np.flatnonzero(_joined(right, "first", bool) & (df_of >= min_df))
        return pa.table([b.terms(at), pa.array(df_of[at].astype(np.int64))], ["term", "df"])

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(named, "term string, df long")


def _counted(min_df):
    @_lean
    def run(table):
        _, at = np.unique(_joined(table, "hashes", np.uint64), return_inverse=True)
        return pa.table([[int((np.bincount(at, _joined(table, "n", np.int32)) >= min_df).sum())]], ["terms"])
    return run


def count_terms(df, n_words, text="text", min_df=2, bigrams=True):
    """How many terms have at least `min_df` documents."""
    return count_block_terms(blocks_of(df.select(F.lit(0).alias("_doc"), text), "_doc", text), n_words, min_df, bigrams)


def count_block_terms(blocks, n_words, min_df=2, bigrams=True):
    n_ranges = max(1, -(-n_words // RANGE_WORDS))
    asked = blocks.mapInArrow(_requests(n_ranges, bigrams), "block long, range int, hashes binary, n binary")
    return asked.groupBy("range").applyInArrow(_counted(min_df), "terms long").agg(
        F.coalesce(F.sum("terms"), F.lit(0))).first()[0]


# ---------------------------------------------------------------- naive Bayes

def _masses(classes, n_docs, min_df, bigrams):
    """The task function that adds up, by term and class, the weights of a block's documents, by ranges."""
    place = {c: i for i, c in enumerate(classes)}
    k = len(classes)

    @_lean
    def run(left, right):
        b = Block(left, bigrams)
        order = np.argsort(right.column("range").to_numpy())
        ranges = right.column("range").to_numpy()[order]
        found, mine = ([right.column(c)[int(i)].as_py() for i in order] for c in ("df", "first"))
        dfs = [np.frombuffer(f, np.int32) for f in found]
        df_of = np.concatenate(dfs) if dfs else np.zeros(0, np.int32)
        first = np.concatenate([np.frombuffer(f, bool) for f in mine]) if mine else np.zeros(0, bool)
        known = df_of[b.at] >= min_df
        row, at, n = b.doc[known], b.at[known], b.tf[known]
        w = (1.0 + np.log(n)) * (np.log((1.0 + n_docs) / (1.0 + df_of[at])) + 1.0)
        norm = np.sqrt(np.bincount(row, w * w, len(b.docs)))
        label = np.array([place[c] for c in b.docs.to_pylist()], np.int64)
        cell, to = np.unique(at * k + label[row], return_inverse=True)
        mass = np.bincount(to, w / norm[row], len(cell))
        rows, start = [], 0
        for r, size in zip(ranges, map(len, dfs)):
            inside = slice(*np.searchsorted(cell, [start * k, (start + size) * k]))
            known_here = start + np.flatnonzero(df_of[start:start + size] >= min_df)
            named = known_here[first[known_here]]
            rows.append((int(r), b.hashes[cell[inside] // k].tobytes(), (cell[inside] % k).astype(np.int32).tobytes(),
                         mass[inside].tobytes(), b.hashes[named].tobytes(), df_of[named].tobytes(), b.terms(named)))
            start += size
        columns = list(zip(*rows)) or [()] * 7
        ends = np.cumsum([0, *map(len, columns[6])]).astype(np.int32)
        terms = pa.concat_arrays([pa.array([], pa.string()), *columns[6]])
        return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:6]],
                         pa.ListArray.from_arrays(pa.array(ends), terms)], list(_MASSES))
    return run


_MASSES = {"range": "int", "hashes": "binary", "classes": "binary", "masses": "binary", "named": "binary", "dfs": "binary",
           "terms": "array<string>"}


def _range_masses(k, n_docs):
    """Of a range: its terms with their weights and their sums of every class."""
    @_lean
    def run(table):
        named, order = np.unique(_joined(table, "named", np.uint64), return_index=True)
        terms = table.column("terms").combine_chunks().flatten().take(pa.array(order))
        df = _joined(table, "dfs", np.int32)[order]
        at = np.searchsorted(named, _joined(table, "hashes", np.uint64))
        sums = np.bincount(at * k + _joined(table, "classes", np.int32), _joined(table, "masses", np.float64), len(named) * k)
        return pa.table([terms, pa.array(np.log((1.0 + n_docs) / (1.0 + df)) + 1.0), *[
            pa.array(s) for s in sums.reshape(-1, k).T]], ["term", "idf", *[f"m{c}" for c in range(k)]])
    return run


def class_masses(df, n_words, classes, n_docs, label="label", text="text", min_df=2, bigrams=True):
    """(term, idf, m0, m1, ...): the summed TF-IDF weights of every term in the documents of each class."""
    blocks, n_ranges = blocks_of(df, label, text), max(1, -(-n_words // RANGE_WORDS))
    asked = blocks.mapInArrow(_requests(n_ranges, bigrams), "block long, range int, hashes binary, n binary")
    answered = asked.groupBy("range").applyInArrow(_answers, "block long, range int, df binary, first binary")
    masses = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _masses(list(classes), n_docs, min_df, bigrams), ", ".join(f"{c} {t}" for c, t in _MASSES.items()))
    return masses.groupBy("range").applyInArrow(
        _range_masses(len(classes), n_docs),
        "term string, idf double, " + ", ".join(f"m{c} double" for c in range(len(classes))))


# ---------------------------------------------------------------- scoring

def _ranged(n_ranges):
    """Adds hash and range to the terms of a model."""
    def run(batches):
        for batch in batches:
            hashes = (batch.column("hash").to_numpy().view(np.uint64) if "hash" in batch.schema.names else
                      vectors.hashes_of(pa.Table.from_batches([batch])))
            at = np.searchsorted(_bounds(n_ranges), hashes, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(hashes.view(np.int64)), batch.column("idf"), batch.column("coef")],
                ["range", "hash", "idf", "coef"])
    return run


def _model_answers(k):
    """Of a range: for every block the places of the terms that the model knows, and their weights."""
    @_lean
    def run(asked, model):
        hashes = model.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        coef = model.column("coef").combine_chunks().flatten().to_numpy().reshape(-1, k) if len(order) else np.zeros((0, k))
        weights = np.column_stack([model.column("idf").to_numpy(), coef])[order]
        places, values = [], []
        for wanted in asked.column("hashes").to_pylist():
            wanted = np.frombuffer(wanted, np.uint64)
            at = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
            known = np.flatnonzero(hashes[at] == wanted) if len(hashes) else np.zeros(0, np.int64)
            places.append(known.astype(np.int32).tobytes())
            values.append(np.ascontiguousarray(weights[at[known]]).tobytes())
        sizes = pa.array([len(h) // 8 for h in asked.column("hashes").to_pylist()], pa.int32())
        return pa.table([asked.column("block"), asked.column("range"), sizes, pa.array(places, pa.binary()),
                         pa.array(values, pa.binary())], ["block", "range", "size", "places", "weights"])
    return run


def block_probabilities(table, bias, df, text="text", bigrams=True):
    """`df` without its text and with `probability`, by one model: `table` has its (term, idf, coef), or
    the terms' `hash`."""
    others = [c for c in df.columns if c != text]
    blocks = blocks_of(df.select(F.struct(*others).alias("_doc"), text), "_doc", text)
    n_ranges, k = max(1, -(-block_words(blocks) // RANGE_WORDS)), len(bias)
    named = ["hash"] if "hash" in table.columns else vectors.term_parts(F.col("term"))
    model = table.select(*named, "idf", "coef").mapInArrow(
        _ranged(n_ranges), "range int, hash long, idf double, coef array<double>")
    asked = blocks.mapInArrow(_requests(n_ranges, bigrams), "block long, range int, hashes binary, n binary")
    answered = asked.groupBy("range").cogroup(model.groupBy("range")).applyInArrow(
        _model_answers(k), "block long, range int, size int, places binary, weights binary")
    bias = np.asarray(bias, float)

    @_lean
    def score(left, right):
        b = Block(left, bigrams)
        idf, coef, start = np.zeros((1, len(b.hashes))), np.zeros((1, k, len(b.hashes))), 0
        for r in sorted(right.to_pylist(), key=lambda r: r["range"]):
            at = start + np.frombuffer(r["places"], np.int32)
            weights = np.frombuffer(r["weights"], np.float64).reshape(-1, k + 1)
            idf[0, at], coef[0, :, at] = weights[:, 0], weights[:, 1:]
            start += r["size"]
        p = vectors._probabilities(idf, coef, bias[None, :], b.doc, b.at, b.tf, np.zeros(len(b.docs), np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
        return pa.table([b.docs, lists], ["_doc", "probability"])

    schema = T.StructType([T.StructField("_doc", T.StructType([
        T.StructField(c, df.schema[c].dataType) for c in others])),
                           T.StructField("probability", T.ArrayType(T.DoubleType()))])
    scored = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)
    return scored.select("_doc.*", "probability")
