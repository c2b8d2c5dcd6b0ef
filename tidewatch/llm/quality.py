"""Document quality by co-training of a text view and a metadata view.

The text view sees how a text is written (shares of character classes, repetition of words and lines,
word lengths), the metadata view what its row says about it (language, source, stated length). Both
start from labelled documents; in each round each gives all its verdicts above `SURE` on unlabelled
documents to the other as further training rows. Then both are calibrated on labelled documents that
they were not fitted on, and a document's score adds up the evidence of both in log odds.

Of the labelled documents at most `MAX_LABELLED`, the first by hash of the id, are used, and their
features reach the driver. All others are the unlabelled corpus: their features are written once, each
task finds out from the models of the earlier rounds which of its rows were handed over, and only sums
(gradients and Gram matrices of a Newton step, added up by Spark) reach the driver. Scoring covers
every row.

Defined cases: a null or empty text has zero features; null language, source or length are values of
their own; several labels of a document count by their average, rounded down (one 0 makes it 0); null
labels and ids are not trained on; without labels of both kinds every score is 1 (everything stays);
repeated rows get the same score; other columns are not looked at.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import logit
from tidewatch.llm.shared import batches_released, text_of, word_hashes, written

MAX_LABELLED = 20_000
ROUNDS = 4
SURE = 0.97                  # probability from which a verdict is handed over
STEPS = 40                   # Newton steps of a fit at most, each a pass over the features
KEEP = 0.5                   # documents below this score are rejected
BINS = 64                    # columns for hashed metadata

_CLASS = np.full(256, 7, np.uint8)                   # other bytes of letters beyond ASCII
_CLASS[:128] = 6                                     # ASCII punctuation and controls, unless below
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
_MARKS = [ord(c) for c in "!|*$%&#"]


def text_features(text):
    """The numbers of the text view."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=8) / n
    words = word_hashes(text)
    n_words = max(1, len(words))
    distinct, times = np.unique(words, return_counts=True)
    lines = np.array([zlib.crc32(line.encode("utf-8", "surrogatepass")) for line in text.split("\n")])
    marks = counts[_MARKS] / n_words
    return [*shares, *np.minimum(marks, 3), np.log1p(n_words), n / n_words / 10,
            (words[1:] == words[:-1]).sum() / n_words, len(distinct) / n_words,
            times.max(initial=0) / n_words, 1 - len(np.unique(lines)) / len(lines),
            np.log1p(n / len(lines)), shares[1] / max(1e-9, shares[0] + shares[1])]


def metadata_features(lang, source, n_chars):
    """The numbers of the metadata view: hashed language and source, and the stated length."""
    out = np.zeros(BINS + 3)
    out[zlib.crc32(f"lang={lang}".encode()) % BINS] += 1
    out[zlib.crc32(f"source={source}".encode()) % BINS] += 1
    out[BINS] = np.log1p(max(0, n_chars or 0)) / 5
    out[BINS + 1] = n_chars is None
    out[BINS + 2] = max(0.0, out[BINS] - 1.5)
    return out


def _views(batch):
    columns = [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    rows = list(zip(*columns))
    return (np.array([text_features(t) for t, *_ in rows], float).reshape(len(rows), -1),
            np.array([metadata_features(*m) for _, *m in rows], float).reshape(len(rows), -1))


class View:
    """Standardised logistic regression with a calibration on top."""

    def __init__(self, mean, spread, point):
        self.mean, self.spread, self.point, self.scale = mean, spread, point, (1.0, 0.0)

    def rows(self, x):
        return np.column_stack(((x - self.mean) / self.spread, np.ones(len(x))))

    def raw(self, x):
        return self.rows(x) @ self.point

    def calibrate(self, raw, y):
        slope, shift = logit.fit(raw[:, None], y, ridge=1e-3)
        self.scale = (max(0.0, slope[0]), shift)

    def odds(self, x):
        return self.raw(x) * self.scale[0] + self.scale[1]


def given(rows, history):
    """What the rounds so far hand over of the unlabelled rows (standardised, in both views): for each
    view whose verdict it is 1, 0 or nan. `history` has the two models of each round."""
    free = np.ones(len(rows[0]), bool)
    out = [np.full(len(free), np.nan), np.full(len(free), np.nan)]
    for models in history:
        for i, point in enumerate(models):               # the view i judges, the other one learns
            p = logit.sigmoid(rows[i] @ point)
            sure = free & ((p >= SURE) | (1 - p >= SURE))
            out[1 - i][sure] = p[sure] >= SURE
            free &= ~sure
    return out


def newton_sums(x, y, point):
    """Gradient and curvature of the loss over rows, without the penalty, as one vector."""
    p = logit.sigmoid(x @ point)
    return np.concatenate((x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))


def pool_sums(rows, histories, points):
    """Newton sums over the rows handed over in each training, and how many these are."""
    out = []
    for history, point in zip(histories, points):
        for i, labels in enumerate(given(rows, history)):
            has = ~np.isnan(labels)
            out += [[has.sum()], newton_sums(rows[i][has], labels[has], point[i])]
    return np.concatenate(out)


def co_train(views, y, over_pool, scales, fold, rounds=ROUNDS):
    """Two calibrated `View`s and the prior log odds. `views`: the features of the labelled rows in both
    views; `over_pool(f)`: the sum of the vectors `f(rows of both views)` over the unlabelled rows;
    `scales`: mean and spread in each view; `fold`: a number per labelled row."""
    rows = [View(*s, None).rows(v) for s, v in zip(scales, views)]
    parts = [part for part in range(2) if len(np.unique(y[fold != part])) == 2]
    trainings = [fold != part for part in parts] + [np.ones(len(y), bool)]      # all fitted together
    widths = [r.shape[1] for r in rows]
    penalties = [np.append(np.full(w - 1, 2.0), 1e-6) for w in widths]
    points = [[np.zeros(w) for w in widths] for _ in trainings]
    histories = [[] for _ in trainings]
    handed = np.zeros(2 * len(trainings))
    for r in range(rounds + 1):
        now = np.zeros(2 * len(trainings))
        for _ in range(STEPS):
            more = iter(())
            if r:
                total = over_pool(lambda x, h=histories, p=points: pool_sums(x, h, p))
                sizes = [n for w in widths for n in (1, w + w * w)] * len(trainings)
                more = iter(np.split(total, np.cumsum(sizes)[:-1]))
            largest, fitted = 0.0, []
            for t, use in enumerate(trainings):
                fitted.append([])
                for i, point in enumerate(points[t]):
                    sums = newton_sums(rows[i][use], y[use], point)
                    if r:
                        now[2 * t + i] = next(more)[0]
                        sums = sums + next(more)
                    gradient, curve = sums[:widths[i]], sums[widths[i]:].reshape(widths[i], -1)
                    step = np.linalg.solve(curve + np.diag(penalties[i]), gradient + penalties[i] * point)
                    largest = max(largest, np.abs(step).max())
                    fitted[t].append(point - step / max(1.0, np.abs(step).max() / 5))
            points = fitted
            if largest < 1e-4 or r and (now == handed).all():    # the error is now about its square
                break
        if r and (now == handed).all():
            break
        handed = now
        for history, point in zip(histories, points):
            history.append(point)
    held = [np.zeros(len(y)), np.zeros(len(y))]
    for part, point in zip(parts, points):
        for i in range(2):
            held[i][fold == part] = rows[i][fold == part] @ point[i]
    final = [View(*s, p) for s, p in zip(scales, points[-1])]
    for model, raw in zip(final, held):
        model.calibrate(raw, y)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return final, float(np.log(share / (1 - share)))


def _columns(docs):
    return docs.select("doc_id", text_of().alias("text"), "lang", "source", "n_chars")


def _matrix(column):
    """A list column of an Arrow batch as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _both(batch):
    """Features of both views of a batch of written rows; the stated ones are kept short."""
    text, short = _matrix(batch.column("written")), _matrix(batch.column("stated"))
    stated = np.zeros((len(short), BINS + 3))
    for c in range(2):
        np.add.at(stated, (np.arange(len(short)), short[:, c].astype(int)), 1)
    stated[:, BINS:] = short[:, 2:]
    return text, stated


def document_features(docs):
    """doc_id, written and stated (columns of language and source, then numbers), one row an id."""
    def features(batches):
        for batch in batches_released(batches):
            text = [text_features(t) for t in batch.column("text").to_pylist()]
            short = []
            for lang, source, n_chars in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))):
                numbers = metadata_features(lang, source, n_chars)[BINS:]
                short.append([zlib.crc32(f"lang={lang}".encode()) % BINS, zlib.crc32(f"source={source}".encode()) % BINS,
                              *numbers])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text, pa.list_(pa.float64())), pa.array(short, pa.list_(pa.float64()))],
                ["doc_id", "written", "stated"])
    rows = _columns(docs.where("doc_id is not null")).mapInArrow(
        features, "doc_id long, written array<double>, stated array<double>")
    return rows.groupBy("doc_id").agg(F.min(F.struct("written", "stated")).alias("v")).select("doc_id", "v.*")


def summed(table, vector):
    """The sum over all batches of `vector(both views)`, added up by task and then by Spark; None for
    no rows."""
    def sums(batches):
        total = None
        for batch in batches_released(batches):
            if batch.num_rows:
                one = vector(_both(batch))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    parts = table.select("written", "stated").mapInArrow(sums, "v binary").rdd.map(lambda r: np.frombuffer(r[0]))
    return parts.treeAggregate(None, _plus, _plus)


def _plus(a, b):
    return b if a is None else a if b is None else a + b


def fit(docs, labels, max_labelled=MAX_LABELLED):
    """The co-trained views, or None without labels of both kinds."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.floor(F.avg("quality")).cast("int").alias("quality"))
    some = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "quality-labels")
    if some.select("quality").distinct().count() < 2:
        return None
    features = written(document_features(docs), "quality-features")
    rows = features.join(F.broadcast(some), "doc_id").toArrow().combine_chunks()
    y = rows.column("quality").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(rows.column("doc_id").to_numpy())
    views = [v[order] for v in _both(rows.to_batches()[0])]
    fold = np.array([zlib.crc32(str(i).encode()) % 2 for i in rows.column("doc_id").to_numpy()[order]])
    pool = written(features.join(F.broadcast(some), "doc_id", "left_anti").select("written", "stated"), "quality-pool")
    scales, at = [], 0
    moments = summed(features, lambda both: np.concatenate(
        [[len(both[0])], *(m for x in both for m in (x.sum(axis=0), (x * x).sum(axis=0)))]))
    n, moments = moments[0], moments[1:]
    for v in views:
        mean, square = np.split(moments[at:at + 2 * v.shape[1]] / n, 2)
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        scales.append((mean, np.where(spread > 1e-6, spread, 1.0)))
        at += 2 * v.shape[1]

    def over_pool(f):
        models = [View(*s, None) for s in scales]
        total = summed(pool, lambda both: f([m.rows(x) for m, x in zip(models, both)]))
        return f([m.rows(x[:0]) for m, x in zip(models, views)]) if total is None else total
    return co_train(views, y[order], over_pool, scales, fold)


def score(docs, model, keep=KEEP):
    """doc_id, p_text, p_metadata, score and kept for every row of `docs`."""
    def apply(batches):
        for batch in batches_released(batches):
            n = batch.num_rows
            if model is None:
                columns = [np.ones(n)] * 3
            else:
                (first, second), prior = model
                written, stated = _views(batch)
                a, b = first.odds(written), second.odds(stated)
                columns = [logit.sigmoid(z) for z in (a, b, a + b - prior)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in columns),
                 pa.array(columns[2] >= keep)], ["doc_id", "p_text", "p_metadata", "score", "kept"])
    return _columns(docs).mapInArrow(
        apply, "doc_id long, p_text double, p_metadata double, score double, kept boolean")


def keep_good(docs, labels, keep=KEEP):
    """The rows of `docs` that are not rejected, with all their columns, in one pass over them."""
    model = fit(docs, labels)
    names, schema = docs.columns, docs.schema

    def stay(batches):
        at = {c: names.index(c) for c in ("text", "lang", "source", "n_chars")}
        for batch in batches_released(batches):
            (first, second), prior = model
            texts = pa.array([t or "" for t in batch.column(at["text"]).to_pylist()], pa.string())
            view = pa.RecordBatch.from_arrays(
                [texts, *(batch.column(at[c]) for c in ("lang", "source", "n_chars"))],
                ["text", "lang", "source", "n_chars"])
            written, stated = _views(view)
            odds = first.odds(written) + second.odds(stated) - prior
            yield batch.filter(pa.array(logit.sigmoid(odds) >= keep))
    return docs if model is None else docs.mapInArrow(stay, schema)
