"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes the empty text; nothing else can
be normalised away without changing a count) and that of the tokenizer's file. Keys are joined to the
stored counts; only distinct texts without one are encoded, and their counts are appended.

Copies collapse map-side, so a text that makes up a third of the rows reaches the encoder once, and its
rows get the count by broadcast (`join_counted`). The
cache is a Parquet folder partitioned by tokenizer version. A count is a function of its key, so if
two jobs append the same key, or a job is run again, reading takes any one of the rows.

Defined cases: null text counts as empty, with no bytes; null or repeated doc_ids give a row each;
other columns are not looked at; an empty table appends nothing.
"""
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm.shared import (ChunkMemo, batches_of_texts, join_counted, new_folder, single_thread,
                                  text_of, tokenizer_path, written)

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_SCHEMA = "version string, content binary, n_bytes long, n_tokens long"


def version_of(path):
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def piece_counter(path):
    """texts -> counts by the sentencepiece model at `path`.

    No piece of such a model holds a space mark after another character, so what lies between single
    spaces is encoded alike wherever it stands: counts are kept by chunk. Texts with neighbouring or
    outer spaces, and models with other pieces, go to the library whole.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    by_chunk = (model.encode(["e"], out_type=str)[0][0].startswith(mark)
                and not any(mark in p.lstrip(mark) or (p.startswith(mark * 2) and p.strip(mark))
                            for p in map(model.id_to_piece, range(model.get_piece_size()))))
    memo = ChunkMemo(lambda chunks: [len(ids) for ids in model.encode(chunks, num_threads=1)])

    def whole(text):
        return (not by_chunk or "  " in text or mark in text or text[:1] in ("", " ") or text[-1:] == " ")

    def count(texts):
        counts = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not whole(t)]
        chunks = [texts[i].split(" ") for i in plain]
        long = memo.learn(chunks)
        for i, parts in zip(plain, chunks):
            counts[i] = sum(map(memo.known.__getitem__, parts))
        memo.forget(long)
        rest = [i for i, n in enumerate(counts) if n is None]
        for i, ids in zip(rest, model.encode([texts[i] for i in rest], num_threads=1)):
            counts[i] = len(ids)
        return counts
    return count


def json_counter(path):
    """texts -> counts by the tokenizers file at `path`, without added special tokens."""
    from tokenizers import Tokenizer
    single_thread()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def keyed(docs, version):
    content = F.unhex(F.sha2(text_of(), 256))
    return docs.select("doc_id", text_of().alias("text"), F.lit(version).alias("version"), content.alias("content"))


def cached(spark, cache, version):
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).groupBy("content").agg(
        F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs, cache, path, version):
    """Append the counts of the distinct texts of `docs` that the cache lacks."""
    def encode(batches):
        count = (piece_counter if path.endswith(".model") else json_counter)(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = []
            for start, end in batches_of_texts(texts):
                counts += count(texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["content", "n_bytes", "n_tokens"])

    spark = docs.sparkSession
    distinct = keyed(docs, version).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(cached(spark, cache, version), "content", "left_anti")
    misses = misses.select("content", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = misses.mapInArrow(encode, "content binary, n_bytes long, n_tokens long")
    counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)


def count_tokens(docs, cache=None, tokenizer=TOKENIZER, limit=LIMIT):
    """doc_id, n_bytes, n_tokens and over_limit for every row of `docs`; `cache` is a shared folder
    that outlives the job (a new one by default)."""
    spark = docs.sparkSession
    cache = cache or new_folder(spark, "token-cache")
    path = tokenizer_path(tokenizer)
    version = version_of(path)
    encode_misses(docs, cache, path, version)
    rows = keyed(docs, version).select("doc_id", "content")
    sizes = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = written(cached(spark, cache, version).join(sizes, "content"), "counted-contents")
    rows = join_counted(rows, counts, ["content"], "n_rows", ["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
