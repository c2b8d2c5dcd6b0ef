"""Toxic documents by a support vector machine on a subsequence string kernel.

The kernel compares two strings by the subsequences of three letters they share, each occurrence
weighted by `DECAY` to the power of the length it spans and limited to `SPAN` characters, divided by
the strings' occurrence norms. Characters that are not letters fill gaps without being matched, so an
insult with dots, dashes, digits or stray letters between its own stays close to itself.

Training reads labelled documents, cut into sentences that inherit the label. A sentence speaks
through its segments (the strings between white space, and runs of single characters read as one);
the witnesses of toxic sentences are the segments that are toxic more often than chance allows: the
chance of such a count, bounded by Chernoff, is below `CHANCE` divided by the number of segments
tested, in one language at least. Documents count, not sentences, and copies of a document count
once. All witnesses are used, however rare beside the commonest. Nyström features over landmark
segments and a linear machine with squared hinge loss separate them, with made-up gapped and stretched
variants, from the segments of clean sentences. The segments of labelled toxic sentences that this
machine accepts, in whatever form they stand there, and the clean segments that come closest are added
for a second fit. As features are linear in the subsequences, the machine folds into one weight per
subsequence, and a text of any length is scored in one pass over its characters. A document has the
score of its worst segment, calibrated.

Only documents with crc32(id as text) % 3 other than 1 are learned from: at most `MAX_DOCUMENTS`,
the first by hash of the id. At most `MAX_SEGMENTS` clean segments of each choice reach the driver, and
all witnesses and accepted segments, whose number is bounded by the documents learned from. Scoring
covers every text.

Defined cases: null and empty text have no segment and get the score of a text without insults;
repeated rows get the same score; a null id is scored and counts as not held out; conflicting labels
of a document count as toxic; null labels are not used; without witnesses every score is the share of
toxic documents among those learned from, 0 without any; a null lang, or none, is a language of its
own; other columns are not looked at.
"""
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import logit
from tidewatch.llm.shared import text_of, written

MAX_DOCUMENTS = 20_000
MAX_SEGMENTS = 2_000
CHANCE = 0.01                # of any witness by accident, over all segments together
PURE = 0.8                   # share of a witness's documents that are toxic
SPAN, DECAY = 6, 0.6
LANDMARKS = 480
COST = 4.0
CLEAN_WEIGHT = 2.0           # what mistaking all clean segments costs against all witnesses
THRESHOLD = 0.7

_LETTERS = 28                # 0: neither letter nor space, 1-26: a-z, 27: bytes of other letters
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SPELLED = re.compile(r"(?<!\S)(?:[A-Za-z][^\w\s]{0,2}\s{1,3}){2,}[A-Za-z](?![^\W])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PIECE = 1 << 16


def spelled_out(text):
    """Words written as single characters with white space between, without that white space."""
    if len(text) < 5:
        return []
    return ["".join(m.group().split()) for m in _SPELLED.finditer(text)]


def subsequences(data):
    """For bytes without spaces at the ends: (code, weight, start position) of each occurrence."""
    codes, n = _CODE[data], len(data)
    gap = np.flatnonzero(np.append(_SPACE[data], True))
    end = gap[np.searchsorted(gap, np.arange(n))]
    found = []
    for i, j in _STEPS:
        at = np.arange(max(0, n - j))
        at = at[(at + j < end[:len(at)])]
        a, b, c = codes[at], codes[at + i], codes[at + j]
        use = (a > 0) & (b > 0) & (c > 0)
        found.append(((a[use] * _LETTERS + b[use]) * _LETTERS + c[use], np.full(use.sum(), DECAY**(j + 1)), at[use]))
    return [np.concatenate(x) for x in zip(*found)]


def feature_rows(segments):
    """The normalised feature vectors of short strings, dense."""
    out = np.zeros((len(segments), _LETTERS**3), np.float32)
    for row, segment in zip(out, segments):
        code, weight, _ = subsequences(np.frombuffer(segment.encode("utf-8", "surrogatepass"), np.uint8))
        if len(code):
            np.add.at(row, code, weight / np.sqrt((weight**2).sum()))
    return out


class Machine:
    """A weight per subsequence and a bias; `worst` gives the largest decision over a text's segments."""

    def __init__(self, weights, bias):
        self.weights, self.bias = weights.astype(np.float64), float(bias)

    def segments(self, data):
        """Starts of the segments of `data` (bytes) and their decisions."""
        gap = _SPACE[data]
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        if not len(starts):
            return starts, np.zeros(0)
        n = len(data)
        ends = np.flatnonzero(np.append(gap, True))
        codes, stop = _CODE[data], np.repeat(ends, np.diff(np.concatenate(([-1], ends))))[:n]
        product, energy = np.zeros(n), np.zeros(n)
        room = stop - np.arange(n)
        letter = codes > 0
        for i, j in _STEPS:
            if n <= j:
                continue
            use = (room[:n - j] > j) & letter[:n - j] & letter[i:n - j + i] & letter[j:]
            at = np.flatnonzero(use)
            code = (codes[at] * _LETTERS + codes[at + i]) * _LETTERS + codes[at + j]
            weight = DECAY**(j + 1)
            product[at] += weight * self.weights[code]
            energy[at] += weight * weight
        dot, norm = np.add.reduceat(product, starts), np.add.reduceat(energy, starts)
        return starts, dot / np.sqrt(np.maximum(norm, 1e-12)) + self.bias

    def worst(self, text):
        best = -1.0
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        at = 0
        while at < len(data):                    # pieces that end at a space; long ones stay bounded
            end = min(len(data), at + _PIECE)
            if end < len(data):
                cut = np.flatnonzero(_SPACE[data[at:end]])
                end = at + int(cut[-1]) + 1 if len(cut) else end
            best = max(best, self.segments(data[at:end])[1].max(initial=-1.0))
            at = end
        for word in spelled_out(text):
            best = max(best, self.segments(np.frombuffer(word.encode(), np.uint8))[1].max(initial=-1.0))
        return best


# ---------------------------------------------------------------- training

def variants(word):
    """Gapped, spelled-out, stretched and inserted-letter forms of a word."""
    middle = len(word) // 2
    out = [".".join(word), "-".join(word), word + ",", word + ".", '"' + word, word + "!!"]
    for mark in ".-*_":
        out += [word[:middle] + mark + word[middle:], word[:1] + mark + word[1:], word[:-1] + mark + word[-1:]]
    for i in range(1, len(word)):
        out.append(word[:i] + word[i - 1] + word[i:])
        out.append(word[:i] + "xqzjk"[i % 5] + word[i:])
    return out


def train(positive, negative, witnesses=0):
    """A `Machine` that separates the two lists of segments; the first `witnesses` are landmarks."""
    segments = positive + negative
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
    weight = np.where(y > 0, 0.5, CLEAN_WEIGHT * len(positive) / max(1, len(negative)))
    step = lambda n, most: np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))       # noqa: E731
    half = max(LANDMARKS // 2, witnesses)
    marks = np.concatenate((np.union1d(np.arange(witnesses), step(len(positive), LANDMARKS // 2)),
                            len(positive) + step(len(negative), half)))
    landmarks = feature_rows([segments[i] for i in marks])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    x = np.vstack([feature_rows(segments[i:i + 256]) @ landmarks.T for i in range(0, len(segments), 256)])
    x = x.astype(float) @ root
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(60):                                     # Newton steps on the squared hinge
        inside = 1 - y * (x @ w + bias) > 0
        z = np.column_stack((x[inside], np.ones(inside.sum())))
        c = COST * weight[inside]
        system = (z * c[:, None]).T @ z + np.diag([*np.ones(len(w)), 1e-6])
        solved = np.linalg.solve(system, z.T @ (c * y[inside]))
        if np.allclose(solved, np.append(w, bias), atol=1e-9):
            break
        w, bias = solved[:-1], solved[-1]
    return Machine((root @ w) @ landmarks, bias)


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs, labels, most=MAX_DOCUMENTS):
    """doc_id, lang, text, toxic of the bounded sample that is learned from."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), text_of().alias("text")).join(F.broadcast(known), "doc_id")


def sentence_segments(sample):
    """(doc_id, lang, toxic, sentence, segment) per distinct segment of every sentence, lower-cased and
    at most 40 long; the sentence is told by a hash, so that copies of a document can be found."""
    names = ["doc_id", "lang", "toxic", "sentence", "segment"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, lang, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text", "toxic"))):
                for sentence in _SENTENCE.split(text):
                    parts = {w.strip(".,;:!?\"'()").lower() for w in re.split(r"[ \t-\r]+", sentence)}
                    parts.update(w.lower() for w in spelled_out(sentence))
                    name = xxhash.xxh3_64_intdigest(sentence.encode("utf-8", "surrogatepass")) - (1 << 63)
                    rows += [(doc, lang, toxic, name, p[:40]) for p in parts if len(p) > 2]
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
    return sample.select("doc_id", "lang", "text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(
        cut, "doc_id long, lang string, toxic long, sentence long, segment string")


def originals(found):
    """doc_id and the document it counts as: the one that most of its sentences stand in first, by id."""
    pairs = found.select("doc_id", "sentence").distinct()
    owners = pairs.groupBy("sentence").agg(F.min("doc_id").alias("owner"))
    shared = pairs.join(owners, "sentence").groupBy("doc_id", "owner").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("doc_id").agg(
        F.min_by("owner", F.struct(-F.col("n"), "owner")).alias("original"))


def segment_counts(sample):
    """segment, lang, n and bad: the documents with the segment and the toxic ones, copies once."""
    found = written(sentence_segments(sample), "segments")
    originally = found.join(originals(found), "doc_id")
    each = originally.groupBy("segment", "lang", "original").agg(F.max("toxic").alias("toxic"))
    return each.groupBy("segment", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))


def chance_of(n, bad, base):
    """Chernoff's bound on the logarithm of the chance of `bad` or more toxic ones of `n`, columns all."""
    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)
    return F.when(bad > n * base, -part(bad, n * base) - part(n - bad, n * (1 - base))).otherwise(0.0)


def fit(docs, labels, most=MAX_DOCUMENTS):
    """(machine, calibration, share): machine is None without witnesses."""
    sample = written(labelled_texts(docs, labels, most), "toxic-sample")
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    share = (toxic or 0) / n if n else 0.0
    counts = written(segment_counts(sample), "segment-counts")
    tests, total, bad = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bad")).first()
    if not bad or bad == total:
        return None, None, share
    bases = counts.groupBy("lang").agg((F.sum("bad") / F.sum("n")).alias("base")).withColumnRenamed("lang", "_lang")
    scored = counts.join(F.broadcast(bases), F.col("lang").eqNullSafe(F.col("_lang"))).withColumn(
        "chance", chance_of(F.col("n"), F.col("bad"), F.col("base")))
    witness = (F.col("chance") <= math.log(CHANCE / tests)) & (F.col("bad") >= PURE * F.col("n"))
    spread = F.col("n") * F.col("base") * (1 - F.col("base"))
    scored = written(scored.groupBy("segment").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max(witness).alias("witness"),
        ((F.sum("bad") - F.sum(F.col("n") * F.col("base"))) / F.sqrt(F.sum(spread) + 1e-9)).alias("z")), "segments-scored")
    witnesses = sorted(r["segment"] for r in scored.where("witness").select("segment").collect())
    if not len(witnesses):
        return None, None, share
    clean = scored.where("bad < n").where("z < 2")
    common = clean.orderBy(F.desc("n"), "segment").limit(MAX_SEGMENTS // 2)
    others = clean.orderBy(F.xxhash64("segment"), "segment").limit(MAX_SEGMENTS)
    negative = sorted({r["segment"] for r in common.union(others).select("segment").collect()} - set(witnesses))
    positive = witnesses + [v for w in witnesses for v in variants(w)]
    machine = train(positive, negative, len(witnesses))

    def decide(batches):
        for batch in batches:
            joined = "\n".join(batch.column("segment").to_pylist()).encode("utf-8", "surrogatepass")
            decisions = machine.segments(np.frombuffer(joined, np.uint8))[1]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(decisions, pa.float64())],
                                             ["segment", "decision"])

    def decided(segments):
        return segments.select("segment").mapInArrow(decide, "segment string, decision double")
    near = decided(clean).orderBy(F.desc("decision"), "segment").limit(MAX_SEGMENTS // 2).toPandas()
    toxic_ones = scored.where(F.col("bad") >= PURE * F.col("n")).where("not witness")
    meant = sorted(r["segment"] for r in decided(toxic_ones).where("decision > 0").collect())
    machine = train(witnesses + meant + positive[len(witnesses):],
                    sorted(set(negative) | set(near["segment"][near["decision"] > -0.9])), len(witnesses))

    def measure(batches):
        for batch in batches:
            worst = [machine.worst(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(worst, pa.float64())], ["toxic", "worst"])
    seen = sample.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(
        measure, "toxic long, worst double").toPandas()
    weights, shift = logit.fit(calibrated_on(seen["worst"].to_numpy()), seen["toxic"].to_numpy(float), ridge=0.5)
    return machine, (weights, shift), share


def calibrated_on(worst):
    """What the calibration sees of a decision: itself, within bounds, and its side."""
    worst = np.asarray(worst, float)
    return np.column_stack((np.clip(worst, -1.0, 1.0), worst > 0))


def score(docs, model, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted for every row of `docs`."""
    machine, calibration, share = model

    def apply(batches):
        for batch in batches:
            if machine is None:
                scores = np.full(batch.num_rows, share)
            else:
                worst = [machine.worst(t) for t in batch.column("text").to_pylist()]
                scores = logit.sigmoid(calibrated_on(worst) @ calibration[0] + calibration[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(
        apply, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
