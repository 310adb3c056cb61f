"""Language identification of mixed texts: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script, by the range of its first letter, leaves the languages that were learnt with that script. Each of these
gives the word the log-likelihood of its letter runs and of the whole word. The best sequence of languages over a text,
in which a switch costs a penalty, labels its spans; the language with most letters is the text's.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.session import batch, fold, texts
from scorewright.llm.texts import BYTE_VALUES, LOWER, Chunk, byte_class, chunks, mix, prefix_hashes, span_hashes

# Documents to learn each language from, at most, and bytes of one of them unless all of a language are longer.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 15
# Languages up to which the keys of what they are learnt from are sent to every executor.
SENT = 100
# Languages that a task holds counts of at a time.
HELD = 32
BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
PENALTY = 12.0
SMOOTHING = 0.5
# Bytes of texts whose words are scored at a time.
AT_ONCE = 1 << 20

# --- fixed values: first bytes of UTF-8 sequences by script -----------------------------------------------------------

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "east asian", "hangul", "other")
_SCRIPT = np.zeros(256, np.int8)
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_SCRIPT[0xC3:0xCA] = 1
_SCRIPT[0xCA:0xCE] = 9
_SCRIPT[0xCE:0xD0] = 2
_SCRIPT[0xD0:0xD4] = 3
_SCRIPT[0xD4:0xD6] = 9
_SCRIPT[0xD6:0xD8] = 4
_SCRIPT[0xD8:0xDC] = 5
_SCRIPT[0xE0] = 6
_SCRIPT[0xE3:0xEA] = 7
_SCRIPT[0xEA:0xEE] = 8
_SCRIPT[[0xE1, 0xE2, 0xEE, 0xEF, *range(0xF0, 0xF5)]] = 9

# ----------------------------------------------------------------------------------------------------------------------

_WORD = byte_class(bytes([*range(97, 123), *range(128, 256)]))
_FIRST = ~byte_class(bytes(range(128, 192)))


@dataclass
class Spelling:
    """Words of letters of a chunk, with the buckets of their letter runs.

    :param start: first byte of each word, ``end`` the byte after it
    :param letters: characters of each
    :param script: number of its script
    :param offsets: words of text i are offsets[i] to offsets[i + 1]
    :param runs: (distinct word, bucket) of every letter run, in order of words, for each run length and for whole words
    :param which: the distinct word that each word is, ``many`` how often each stands
    """

    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    offsets: np.ndarray
    runs: list[tuple[np.ndarray, np.ndarray]]
    which: np.ndarray
    many: np.ndarray


def spelling(chunk: Chunk) -> Spelling:
    data = LOWER[chunk.data]
    size = len(data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(size + 1, bool)
    edge[chunk.offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    heads = np.zeros(size + 1, np.int64)
    np.cumsum(_FIRST[data], out=heads[1:])
    letters = heads[end] - heads[start]
    runs = []
    # Words that stand in the chunk more than once are looked at once.
    whole, one, which, many = np.unique(span_hashes(prefix_hashes(data), start, end), return_index=True, return_inverse=True, return_counts=True)
    # The bytes of words, one blank before and after each word.
    length = end[one] - start[one] + 2
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(len(one)), length)
    spelled = np.full(int(length.sum()), 32, np.uint8)
    body = np.ones(len(spelled), bool)
    body[begin] = body[begin + length - 1] = False
    spelled[body] = data[np.arange(int((length - 2).sum())) + np.repeat(start[one] - (begin - 2 * np.arange(len(one))), length - 2)]
    value = BYTE_VALUES[spelled]
    for n in GRAMS:
        if len(spelled) < n:
            continue
        rolled = np.zeros(len(spelled) - n + 1, np.uint64)
        for i in range(n):
            rolled = rolled * np.uint64(0x100000001B3) + value[i : i + len(rolled)]
        same = word[: len(rolled)] == word[n - 1 :]
        if n == 1:
            same &= body
        runs.append((word[: len(rolled)][same], (mix(rolled[same]) & np.uint64(BUCKETS - 1)).astype(np.int64)))
    runs.append((np.arange(len(one)), (whole & np.uint64(BUCKETS - 1)).astype(np.int64)))
    return Spelling(start, end, letters, _SCRIPT[data[start]] if len(start) else np.zeros(0, np.int8), np.searchsorted(start, chunk.offsets), runs, which.reshape(-1), many)


@dataclass
class Languages:
    """Names, log-likelihoods of buckets for each kind of run, and which scripts each language is written in."""

    names: list[str]
    tables: list[np.ndarray]
    scripts: np.ndarray


# Leading bits of the hash that rows are counted by: so many powers of two of counts in a language's running sum.
HEAD_BITS = 10
_COUNTS = "lang string, kind int, bucket int, number long"


def _smallest(rows: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows (lang, doc_id) of each language whose keys have the smallest hashes.

    Rows are counted by language and leading bits of the hash; a running sum over these counts tells which of them have
    such rows, and only the rows of the same leading bits are put in order, each in a task of their own.
    """
    rows = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("head", F.shiftright("hash", 64 - HEAD_BITS))
    heads = rows.groupBy("lang", "head").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("lang").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))).where(F.col("before") < sample)
    order = Window.partitionBy("lang", "head").orderBy("hash", "doc_id")
    placed = rows.join(heads.select("lang", "head", "before"), ["lang", "head"]).withColumn("place", F.row_number().over(order))
    # By the first bound, Spark leaves rows behind before it moves them.
    return placed.where(F.col("place") <= sample).where(F.col("place") + F.col("before") <= sample).select("lang", "doc_id")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Languages:
    """Every language that is named, from text and label of at most ``sample`` documents of each, taken by a hash of the
    key; of texts of at most SAMPLE_BYTES bytes, or, of a language that has only longer ones, of those.

    Keys whose CRC-32 modulo 3 is 1 are held out; null labels and keys are left out.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1) & F.col("text").isNotNull())
    rows = rows.withColumn("long", F.octet_length("text") > SAMPLE_BYTES)
    found = {r["lang"]: r["long"] for r in rows.groupBy("lang").agg(F.min("long").alias("long")).collect()}
    names = sorted(found)
    if not names:
        return Languages([], [np.zeros((BUCKETS, 0), np.float32) for _ in (*GRAMS, 0)], np.zeros((0, len(SCRIPTS)), bool))
    only_long = [name for name in names if found[name]]
    rows = rows.where(~F.col("long") | F.col("lang").isin(only_long)) if only_long else rows.where(~F.col("long"))
    chosen = _smallest(rows.select("lang", "doc_id"), sample).distinct()
    # At most ``sample`` rows of two short columns a language; with few languages that is little to send to all.
    learnt = rows.join(F.broadcast(chosen) if len(names) <= SENT else chosen, ["lang", "doc_id"])

    def sums(totals: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, own in totals.items():
            for kind, total in enumerate(own):
                bucket = np.flatnonzero(total)
                yield batch(_COUNTS, pa.array([name] * len(bucket), pa.string()), np.full(len(bucket), kind, np.int32), bucket.astype(np.int32), total[bucket])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for part in batches:
            named = np.array(part.column("lang").to_pylist(), object)
            for name in set(named.tolist()):
                if name not in totals and len(totals) >= HELD:
                    yield from sums(totals)
                    totals.clear()
                own = totals.setdefault(name, [np.zeros(BUCKETS, np.int64) for _ in range(len(GRAMS) + 2)])
                for chunk in chunks(part.column("text").filter(pa.array(named == name))):
                    found = spelling(chunk)
                    for total, (word, bucket) in zip(own, found.runs):
                        total += np.bincount(bucket, found.many[word], BUCKETS).astype(np.int64)
                    own[-1][: len(SCRIPTS)] += np.bincount(found.script, weights=found.letters, minlength=len(SCRIPTS)).astype(np.int64)
        yield from sums(totals)

    counts = learnt.select("lang", "text").mapInArrow(count, _COUNTS).groupBy("lang", "kind", "bucket").agg(F.sum("number").alias("number"))
    counts = counts.toArrow()
    number = {name: i for i, name in enumerate(names)}
    which = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    kind, bucket, many = (np.asarray(counts.column(c)).astype(np.int64) for c in ("kind", "bucket", "number"))

    def table_of(k: int) -> np.ndarray:
        table = np.zeros((BUCKETS, len(names)))
        table[bucket[kind == k], which[kind == k]] = many[kind == k]
        return table

    scripts = table_of(len(GRAMS) + 1)[: len(SCRIPTS)].T
    scripts = scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
    likely = []
    # A table at a time, as each takes half a megabyte a language.
    for k in range(len(GRAMS) + 1):
        table = table_of(k)
        share = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * BUCKETS))
        # Only what differs between languages counts; runs of one letter say little, whole words most.
        share -= share.mean(1, keepdims=True)
        likely.append((share * (0.25 if k < 1 else 0.5)).astype(np.float32))
    return Languages(names, likely, scripts)


def word_scores(found: Spelling, languages: Languages) -> np.ndarray:
    """Score of each word in each language; where a word's script leaves some, the others are out of reach."""
    score = np.zeros((len(found.many), len(languages.names)), np.float32)
    for table, (word, bucket) in zip(languages.tables, found.runs):
        if len(word):
            first = np.searchsorted(word, np.arange(len(score)))
            sums = np.add.reduceat(table[bucket], np.minimum(first, len(word) - 1), axis=0)
            has = np.diff(np.append(first, len(word))) > 0
            score[has] += sums[has]
    score = score[found.which]
    allowed = languages.scripts.T[found.script]
    out = ~allowed & allowed.any(1, keepdims=True)
    score[out] -= 1000
    return score


def best_path(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word on the best path of its text; ties go to staying, then to the earlier language."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, length = offsets[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    total = score.copy()
    switched = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.int32)
    for t in range(1, steps):
        at = begin[: active[t]] + t
        before = total[at - 1]
        lead = before.argmax(1)
        other = before[np.arange(len(lead)), lead] - penalty
        change = other[:, None] > before
        total[at] += np.where(change, other[:, None], before)
        switched[at] = change
        source[at] = lead
    path = np.zeros(len(score), np.int32)
    ends = begin[length > 0] + length[length > 0] - 1
    path[ends] = total[ends].argmax(1)
    for t in range(steps - 1, 0, -1):
        at = begin[: active[t]] + t
        now = path[at]
        path[at - 1] = np.where(switched[at, now], source[at], now)
    return path


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def label(column: pa.Array, languages: Languages, penalty: float) -> Iterator[tuple[Chunk, Spelling, np.ndarray]]:
    """Chunks of a column with their words and each word's language."""
    for chunk in chunks(column, AT_ONCE):
        found = spelling(chunk)
        yield chunk, found, best_path(word_scores(found, languages), found.offsets, penalty)


_PREDICTED = "doc_id long, lang_pred string, score double, n_spans long"


def language_id(docs: DataFrame, languages: Languages, penalty: float = PENALTY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row.

    ``lang_pred`` is the language with most letters on the best path, ties going to the earlier name, and ``score`` its
    share of the letters; ``und`` with 0 if the text is null or has no letter, or no language was learnt. ``n_spans``
    counts the path's spans. A null key gives a null ``held_out``; repeated rows are predicted alike; an empty table
    gives no rows.
    """
    count = len(languages.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk, found, path in label(rows.column(1), languages, penalty) if count else ():
                size = len(found.offsets) - 1
                row = np.repeat(np.arange(size), np.diff(found.offsets))
                share = np.zeros((size, count))
                np.add.at(share, (row, path), found.letters)
                total = share.sum(1)
                known = total > 0
                for i in np.flatnonzero(known & ~_ascii_letters(chunk, found, row, size)):
                    known[i] = _has_letter(chunk.text(i).decode())
                lead = share.argmax(1)
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                spans = np.bincount(row[change], minlength=size)
                yield batch(
                    _PREDICTED,
                    rows.column(0).slice(chunk.first, size),
                    pa.array([languages.names[k] if ok else "und" for k, ok in zip(lead, known)], pa.string()),
                    np.where(known, share[np.arange(size), lead] / np.maximum(total, 1), 0.0),
                    np.where(known, spans, 0).astype(np.int64),
                )
            if not count:
                size = rows.num_rows
                yield batch(_PREDICTED, rows.column(0), pa.array(["und"] * size, pa.string()), np.zeros(size), np.zeros(size, np.int64))

    found = texts(docs, key, text).mapInArrow(run, _PREDICTED)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


_SPANS = "doc_id long, start long, end long, lang string"


def language_spans(docs: DataFrame, languages: Languages, penalty: float = PENALTY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, lang) of every span of a text whose words are of one language on its best path.

    Places are code points, from the first letter of a span's first word to behind the last of its last one. Texts that
    are null or without a word have no span, and no text has one if no language was learnt.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk, found, path in label(rows.column(1), languages, penalty) if languages.names else ():
                if not len(path):
                    continue
                row = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
                first = np.flatnonzero(np.diff(path, prepend=-1).astype(bool) | np.diff(row, prepend=-1).astype(bool))
                last = np.append(first[1:], len(path)) - 1
                # Code points before each byte of the chunk: all bytes but those that go on with a character.
                points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                begin = points[chunk.offsets[row[first]]]
                yield batch(
                    _SPANS,
                    rows.column(0).slice(chunk.first).take(pa.array(row[first])),
                    points[found.start[first]] - begin,
                    points[found.end[last]] - begin,
                    pa.array([languages.names[k] for k in path[first]], pa.string()),
                )

    return texts(docs, key, text).mapInArrow(run, _SPANS)


def _ascii_letters(chunk: Chunk, found: Spelling, row: np.ndarray, size: int) -> np.ndarray:
    """Which texts have a letter from A to Z, by the first letters of words; the others are looked at one by one."""
    first = chunk.data[found.start] < 128
    return np.bincount(row[first], minlength=size) > 0
