"""Quartile bucket digests of documents, and how alike two of them are.

Every window of five bytes gives six byte triplets (its first byte with two of the other four); each is
hashed into one of 256 buckets. A bucket's code is 0 to 3: how many of the three quartiles of the
text's own bucket counts its count exceeds. The digest is the length on a logarithmic scale (two hex
digits) and the codes, two bits each (128 hex digits). Texts shorter than five bytes fill the window
with zero bytes; the empty text has the digest of all zeros.

Two digests differ by the sum of the code differences, as a share of what unrelated codes differ by on
average, plus a share of the steps between their lengths; the sum is bounded by 1, and the likeness is
what is left.

Each document is compared with an edited copy, whose last quarter comes from the next document, and
with the next document. Rows are dealt by range of (doc_id, hash of the text), so that a document and
the next one lie side by side in one task, which streams over them: texts move once. Only the last row
of a task lacks its partner, the first row of the next task; both are passed on with their texts and
joined, one pair a task.

Defined cases: a null text counts as empty; a null doc_id comes before all others; rows of one doc_id
follow each other by the hash of their texts, and equal rows in any order, which gives the same rows.
The next document of the last one is the first, so a table of one row is its own next document. Other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidewatch.llm.shared import batches_of_texts, text_of, written

BUCKETS = 256
PIECE = 1 << 20                 # bytes of a text that are counted at once
LENGTH_STEP = np.log(1.1)       # one step of the length code is a tenth more bytes
LENGTH_WEIGHT = 0.02            # what a step beyond the first takes off the likeness
LENGTH_STEPS = 12               # steps beyond the first that count
UNRELATED = 1.25                # mean difference of two independent codes

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
_STREAM = "part int, kind string, text string, " + RESULT

_HALF = np.uint32(0x9E3779B1)


def bucket_counts(data):
    """Counts of the hashed triplets of `data`, bytes of any length."""
    total = np.zeros(BUCKETS, np.int64)
    if not data:
        return total
    data = np.frombuffer(data.ljust(5, b"\0"), np.uint8)
    for at in range(0, len(data) - 4, PIECE):
        b = [data[at + i:at + PIECE + i][:len(data) - 4 - at].astype(np.uint32) for i in range(5)]
        later = [None] + [[x << np.uint32(8), x << np.uint32(16)] for x in b[1:]]
        for i in range(1, 5):
            first = b[0] | later[i][0]
            for j in range(i + 1, 5):
                # the place in the window goes into the hash, so that gapped triplets count apart
                key = (first | later[j][1]) + np.uint32((i * 5 + j) << 24)
                total += np.bincount((key * _HALF) >> np.uint32(24), minlength=BUCKETS)
    return total


def codes_of(counts):
    ordered = np.sort(counts)
    codes = np.zeros(BUCKETS, np.uint8)
    for quarter in (1, 2, 3):
        codes += counts > ordered[quarter * BUCKETS // 4 - 1]
    return codes


def length_code(n_bytes):
    return min(255, int(np.log1p(n_bytes) / LENGTH_STEP))


def fingerprint(text):
    """The digest of `text` (str or None) as 130 hex digits."""
    data = (text or "").encode("utf-8", "surrogatepass")
    codes = codes_of(bucket_counts(data)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return f"{length_code(len(data)):02x}" + body.astype(np.uint8).tobytes().hex()


def _parsed(digest):
    body = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    return int(digest[:2], 16), (body[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(np.int16)


def likeness(digest, other):
    """1 for equal digests, down to 0; symmetric."""
    if digest == other:
        return 1.0
    (n, codes), (m, others) = _parsed(digest), _parsed(other)
    body = float(np.abs(codes - others).sum()) / (UNRELATED * BUCKETS)
    steps = min(max(abs(n - m) - 1, 0), LENGTH_STEPS)
    return max(0.0, 1.0 - body - LENGTH_WEIGHT * steps)


def edited_text(text, following):
    """`text` with its last quarter replaced by the start of `following`."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def compare(doc_id, text, digest, following, next_digest):
    edited = edited_text(text, following)
    changed = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest,
            changed, likeness(digest, changed), likeness(digest, next_digest))


def _frame(rows, schema):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema)


_RESULT_ARROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                 ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                 ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _neighbours(batches):
    """Sorted rows of one task to compared rows, and its first and last row with their texts."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("text", pa.string()), *_RESULT_ARROW])
    part, last = TaskContext.get().partitionId(), None

    def open_row(kind, doc_id, text, digest):
        return (part, kind, text, doc_id, None, None, digest, None, None, None)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for start, end in batches_of_texts(texts):
            out = []
            for doc_id, text in zip(ids[start:end], texts[start:end]):
                digest = fingerprint(text)
                if last is None:
                    out.append(open_row("first", doc_id, text, digest))
                else:
                    out.append((part, "row", None, *compare(*last, text, digest)))
                last = (doc_id, text, digest)
            if out:
                yield _frame(out, schema)
    if last is not None:
        yield _frame([open_row("last", *last)], schema)


def _pairs(batches):
    schema = pa.schema(_RESULT_ARROW)
    for batch in batches:
        rows = [compare(*r.values()) for r in batch.to_pylist()]
        if rows:
            yield _frame(rows, schema)


def compared(docs):
    """A row per row of `docs`: its fingerprint, that of its edited text, and the likenesses."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    placed = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(dealt.mapInArrow(_neighbours, _STREAM), "fingerprints")

    # One number a task comes to the driver: which tasks had rows.
    parts = sorted(r.part for r in found.where("kind = 'first'").select("part").collect())
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = found.where("kind = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_digest"))
    open_rows = (found.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
                 .join(pairs, "part").join(first, "next_part")
                 .select("doc_id", "text", "fingerprint", "following", "next_digest"))
    closed = open_rows.mapInArrow(_pairs, RESULT)
    return found.where("kind = 'row'").select(*closed.columns).unionByName(closed)
