"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

A line's features are shares of kinds of characters, lengths and repetition, of itself and of the lines before and
after it. The two states have a score from the features and one for each transition. Forward-backward gives each line
its marginal; a document's quality is their mean, weighted by the lines' lengths.

The field is fitted on the driver to features of a bounded sample of labelled documents, each line having its
document's label. Scoring reads whole texts and never uses a label.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, fold, texts
from scorewright.llm.texts import NOT_SPACE, Chunk, byte_class, chunks, mix, prefix_hashes, span_hashes, words

# Labelled documents to fit on, at most, and bytes of one of them, at most.
SAMPLE, SAMPLE_BYTES = 4000, 1 << 16
ROUNDS, RATE, DECAY = 150, 0.1, 1e-4
# Scores from which a document counts as good.
GOOD = 0.3

_UPPER = byte_class(bytes(range(65, 91)))
_LETTER = _UPPER | byte_class(bytes([*range(97, 123), *range(128, 256)]))
_DIGIT = byte_class(b"0123456789")
_STOP = byte_class(b".,;:?!'\"()-")
_ODD = byte_class(b"#$%&*+/<=>@[\\]^_`{|}~")
_MARK = byte_class(b"!")
OWN = 13


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines' lengths, and offsets of the texts' lines. Every text has at least one line."""
    size = len(data)
    newline = np.flatnonzero(data == 10)
    # A text's first line begins where it does; after a newline that ends a text, an empty line of that text.
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, newline, "right") - 1])
    begin = np.concatenate([offsets[:-1], newline + 1])
    order = np.lexsort((begin, row))
    row, start = row[order], begin[order]
    lines = np.searchsorted(row, np.arange(len(offsets)))
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[lines[1:] - 1] = offsets[1:]
    length = end - start

    def count(members: np.ndarray) -> np.ndarray:
        sums = np.zeros(size + 1, np.int64)
        np.cumsum(members[data], out=sums[1:])
        return sums[end] - sums[start]

    letters, upper, digits, stops, odd, marks = (count(c) for c in (_LETTER, _UPPER, _DIGIT, _STOP, _ODD, _MARK))
    found = words(Chunk(0, len(offsets) - 1, data, offsets), NOT_SPACE)
    line = np.searchsorted(start, found.start, "right") - 1
    # Empty lines may begin where a line with words does: the last of them has the words.
    each = np.bincount(line, minlength=len(start))
    hashes = found.hashes()
    _, first = np.unique(mix(hashes ^ mix(line.astype(np.uint64))), return_index=True)
    distinct = np.bincount(line[first], minlength=len(start))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[again], minlength=len(start))
    whole = span_hashes(prefix_hashes(found.data), start, end)
    _, first = np.unique(mix(whole ^ mix(row.astype(np.uint64))), return_index=True)
    repeated = np.ones(len(start))
    repeated[first] = 0
    ends = np.zeros(len(start))
    filled = length > 0
    ends[filled] = byte_class(b".?!")[data[end[filled] - 1]]
    n, w = np.maximum(length, 1), np.maximum(each, 1)
    features = np.stack(
        [
            letters / n, upper / np.maximum(letters, 1), digits / n, stops / n, odd / n, marks / w, odd / w,
            np.log1p(length) / 8, np.minimum(letters / w, 20) / 10, distinct / w, again / w, repeated * filled, ends,
        ],
        axis=1,
    )
    features[~filled] = 0
    return features.astype(np.float32), length, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its text, whether there are such, and a one."""
    count = len(own)
    before, after = np.zeros((count, OWN + 1), np.float32), np.zeros((count, OWN + 1), np.float32)
    has = np.ones(count, bool)
    has[lines[:-1]] = False
    before[has, :OWN], before[has, OWN] = own[np.flatnonzero(has) - 1], 1
    has = np.ones(count, bool)
    has[lines[1:] - 1] = False
    after[has, :OWN], after[has, OWN] = own[np.flatnonzero(has) + 1], 1
    return np.concatenate([own, before, after, np.ones((count, 1), np.float32)], axis=1)


@dataclass
class Field:
    """State scores are of good over bad; transition[i, j] is from state i to j, 1 being good."""

    weights: np.ndarray
    transition: np.ndarray


def marginals(score: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected number of each transition, by forward-backward."""
    length = np.diff(lines)
    order = np.argsort(-length, kind="stable")
    begin, length = lines[:-1][order], length[order]
    state = np.empty((len(score), 2))
    state[:, 1] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    state[:, 0] = 1 - state[:, 1]
    state = np.maximum(state, 1e-13)
    step = np.exp(transition)
    ahead, back = np.empty_like(state), np.ones_like(state)
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    for t, many in enumerate(active):
        at = begin[:many] + t
        value = state[at] if t == 0 else (ahead[at - 1] @ step) * state[at]
        ahead[at] = value / value.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        value = state[at] * back[at]
        pair = ahead[at - 1][:, :, None] * step[None] * value[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        value = value @ step.T
        back[at - 1] = value / value.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), expected


def train(own: np.ndarray, lines: np.ndarray, good: np.ndarray) -> Field:
    """Maximum likelihood with weight decay, by gradient steps of adaptive size over all lines.

    :param good: the label of each text
    """
    features = with_neighbours(own, lines)
    mean, scale = features.mean(0), features.std(0)
    constant = scale < 1e-6
    mean[constant], scale[constant] = 0, 1
    x = (features - mean) / scale
    label = np.repeat(good, np.diff(lines)).astype(float)
    inner = np.ones(len(label), bool)
    inner[lines[:-1]] = False
    seen = np.array([[(inner[1:] & (label[1:] == b) & (label[:-1] == a)).sum() for b in (0, 1)] for a in (0, 1)], float)
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    first, second = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for i in range(1, ROUNDS + 1):
        p, expected = marginals(x @ weights, transition, lines)
        gradient = np.concatenate([x.T @ (label - p), (seen - expected).ravel()]) / max(1, len(label))
        gradient -= DECAY * np.concatenate([weights, transition.ravel()])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        change = RATE * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
        weights += change[:-4]
        transition += change[-4:].reshape(2, 2)
    plain = weights / scale
    plain[-1] -= (weights * mean / scale)[:-1].sum()
    return Field(plain, transition)


def scores(column: pa.Array, field: Field) -> np.ndarray:
    """Quality of each text of a column."""
    out = []
    for chunk in chunks(column):
        own, length, lines = line_features(chunk.data, chunk.offsets)
        p, _ = marginals(with_neighbours(own, lines) @ field.weights, field.transition, lines)
        weight = length.astype(float)
        total = np.add.reduceat(weight, lines[:-1])
        empty = np.repeat(total == 0, np.diff(lines))
        weight[empty] = 1
        out.append(np.add.reduceat(p * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1]))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """The field, fitted to at most ``sample`` labelled documents of at most SAMPLE_BYTES bytes, taken by a hash of the key.

    Keys whose CRC-32 modulo 5 is 0 are held out. Labels that are null or contradict each other are left out. Without
    any label, every document scores one half.
    """
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    # At most ``sample`` rows of two numbers, so the broadcast is bounded.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    rows = texts(docs, key, text).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_ in batches:
            for chunk in chunks(batch_.column("text")):
                own, _, lines = line_features(chunk.data, chunk.offsets)
                blobs = [own[a:b].tobytes() for a, b in zip(lines[:-1], lines[1:])]
                part = batch_.slice(chunk.first, chunk.last - chunk.first)
                yield batch("doc_id long, label int, features binary", part.column("doc_id"), part.column("label"), pa.array(blobs, pa.binary()))

    # Rows of one key may repeat; the smallest features stand for them, so the sample stays bounded.
    rows = rows.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, features binary")
    rows = rows.groupBy("doc_id", "label").agg(F.min("features").alias("features")).orderBy("doc_id").collect()
    if not rows:
        return Field(np.zeros(3 * OWN + 3), np.zeros((2, 2)))
    own = [np.frombuffer(r["features"], np.float32).reshape(-1, OWN) for r in rows]
    lines = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return train(np.concatenate(own), lines, np.array([r["label"] for r in rows]))


_SCORED = "doc_id long, score double"


def quality(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``predicted`` is 1 from a score of GOOD on.

    Null and empty texts are one empty line, whose score is the field's for such. A null key gives a null ``held_out``.
    Repeated rows score alike; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(_SCORED, rows.column(0), scores(rows.column(1), field))

    rows = texts(docs, key, text).mapInArrow(run, _SCORED)
    return rows.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that count as good, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(scores(rows.column(place), field) >= GOOD))

    return docs.mapInArrow(run, docs.schema)
