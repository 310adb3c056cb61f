"""Suffix-array dedup: byte strings of a given length that start in more than one place, by a depth-limited radix sort.

Only suffixes' first ``length`` bytes (windows) matter, and of their order only which are equal. So the sort goes by
most-significant-digit passes over digits of a window's content, and a suffix leaves as soon as it is alone:

1. The first digit is the window's minimizer, the run of ``gram`` bytes with the smallest hash in it. Neighbouring
   windows mostly share it, so a segment of windows is one row. Equal windows have equal minimizers at equal places.
2. Segments whose minimizer stands alone in the corpus leave; of the others the bytes are fetched.
3. The last digit is the whole window; groups of equal windows are exactly the repeated strings. A group of segments is
   sorted in one task, or, where very many segments have one minimizer, every window goes to the task of its own hash.

Whole texts that are equal, and equal segments seen together, are told early, so copies don't travel.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, partitions, signed
from scorewright.llm.texts import chunks, mix, prefix_hashes, span_hashes

LENGTH = 200
# Segments of one minimizer up to which they are sorted in one task, about as many as are sorted at a time. Beyond that
# every window is a row, some 85 for a segment, and the more texts there are the more minimizers stand in many segments.
TOGETHER = 8192
# Bytes of segments whose windows are sorted at a time.
SORTED = 1 << 21
# Segments that a task remembers: two to that power, by the first bits of their hashes; newer ones take the place of others.
REMEMBERED = 21

_U32 = np.uint64(32)


def minimizer_segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one minimizer: first window, number of windows and minimizer's place, in order of bytes."""
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none
    prefix = prefix_hashes(data)
    at = np.arange(size - gram + 1)
    key = (span_hashes(prefix, at, at + gram) >> _U32 << _U32) | at.astype(np.uint64)
    # The least key of a window, doubling the reach; ties go to the left.
    reach, width = 1, length - gram + 1
    while reach * 2 <= width:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.flatnonzero(np.arange(size - length + 1) + length <= offsets[1:][doc[: size - length + 1]])
    if not len(window):
        return none, none, none, none
    place = (key[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (np.diff(window) != 1)
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(window)))
    return window[begin], count, place[begin], prefix


# ``seen``: 0 a segment whose equals are to be found, 1 one of which a task has seen two, 2 a further one, which is
# settled; settled segments that follow on each other are one row.
_SEGMENTS = "m long, u long, start long, windows int, seen int"


class Memory:
    """Hashes that a task has met, once or more often; what is forgotten counts as new.

    It takes the same time and room however much a task reads.
    """

    def __init__(self, bits: int = REMEMBERED):
        self.shift = np.uint64(64 - bits)
        self.hash, self.times = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int8)

    def met(self, each: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of distinct ascending hashes, standing here so many times, were met once before, and which more often."""
        slot = each >> self.shift
        known = np.where(self.hash[slot] == each, self.times[slot], 0)
        # Of hashes with one place the last stays.
        last = np.ones(len(slot), bool)
        last[:-1] = slot[1:] != slot[:-1]
        self.hash[slot[last]] = each[last]
        self.times[slot[last]] = np.where((known > 0) | (times > 1), 2, 1)[last]
        return known == 1, known == 2


def _segments(length: int, gram: int):
    """Segments of all texts; a task looks at equal texts once, and tells of equal segments twice while it remembers them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        memory = Memory()
        for rows in batches:
            ids, content = np.asarray(rows.column("u")), np.asarray(rows.column("k"))
            fresh = []
            for i, k in enumerate(content.tolist()):
                if k not in told:
                    told.add(k)
                    fresh.append(i)
            if not fresh:
                continue
            ids = ids[fresh]
            for chunk in chunks(rows.column("text").take(pa.array(fresh, pa.int64()))):
                start, count, place, prefix = minimizer_segments(chunk.data, chunk.offsets, length, gram)
                if not len(start):
                    continue
                m = span_hashes(prefix, place, place + gram)
                whole = span_hashes(prefix, start, start + count - 1 + length)
                each, first, number, times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                again, settled = memory.met(each, times)
                seen = np.where(times[number] == 1, 0, 2)
                seen[first[times > 1]] = 1
                seen[first[again]] = 1
                seen[settled[number]] = 2
                row = np.searchsorted(chunk.offsets, start, "right") - 1
                # An empty text begins where the next one does; the last of them has the bytes.
                fresh = np.ones(len(seen), bool)
                fresh[1:] = (seen[1:] != 2) | (seen[:-1] != 2) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])
                begin = np.flatnonzero(fresh)
                count = np.add.reduceat(count, begin)
                m, row, start, seen = m[begin], row[begin], start[begin], seen[begin]
                yield batch(_SEGMENTS, signed(m), ids[chunk.first + row], start - chunk.offsets[row], count.astype(np.int32), seen.astype(np.int32))

    return run


# ``kind``: 0 a segment with its bytes, 1 a window by its hash, 2 windows known to be repeated.
_DEALT = "key long, kind int, u long, start long, windows int, known int, bytes binary"


def windows_of(data: np.ndarray, offsets: np.ndarray, count: np.ndarray, m: np.ndarray, length: int):
    """Segment and place in it of every window, and a hash of its content."""
    prefix = prefix_hashes(data)
    segment = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[segment] + inside
    return segment, inside, mix(span_hashes(prefix, at, at + length) ^ m.view(np.uint64)[segment])


def _runs(segment: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row of one segment: segment, first place, how many."""
    if not len(segment):
        return segment, inside, inside
    fresh = np.ones(len(segment), bool)
    fresh[1:] = (segment[1:] != segment[:-1]) | (np.diff(inside) != 1)
    begin = np.flatnonzero(fresh)
    return segment[begin], inside[begin], np.diff(np.append(begin, len(segment)))


def _deal(length: int):
    """Bytes of the segments still in question; of those with a very common minimizer the windows instead."""

    def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(size)])
        return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets

    def rows_of(key, kind, u, start, windows, known, data=None):
        data = data if data is not None else pa.nulls(len(u), pa.binary())
        return batch(_DEALT, key, np.full(len(u), kind, np.int32), u, start, windows.astype(np.int32), known.astype(np.int32), data)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            position = 0
            while position < rows.num_rows:
                # So many rows at a time that their texts stay small.
                last, held, texts = position, 0, []
                unpack = zstandard.ZstdDecompressor()
                while last < rows.num_rows and held < SORTED:
                    texts.append(unpack.decompress(rows.column("z")[last].as_py()))
                    held += len(texts[-1])
                    last += 1
                part = rows.slice(position, last - position)
                position = last
                base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                data = np.frombuffer(b"".join(texts), np.uint8)
                lists = part.column("segments")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                each = lists.flatten()
                m, start, count, seen, together = (np.asarray(each.field(i)) for i in range(5))
                u = np.asarray(part.column("u"))[row]
                settled = seen == 2
                if settled.any():
                    yield rows_of(u[settled], 2, u[settled], start[settled], count[settled], np.ones(settled.sum()))
                begin, size = base[row] + start, count + length - 1
                apart = ~settled & (together <= TOGETHER)
                if apart.any():
                    got, offsets = cut(data, begin[apart], size[apart])
                    got = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(got)])
                    yield rows_of(m[apart], 0, u[apart], start[apart], count[apart], seen[apart] == 1, got)
                common = np.flatnonzero(~settled & (together > TOGETHER))
                if len(common):
                    got, offsets = cut(data, begin[common], size[common])
                    segment, inside, w = windows_of(got, offsets, count[common], m[common], length)
                    _, first, number, times = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
                    known = times[number] > 1
                    known |= (seen[common] == 1)[segment]
                    s, i, c = _runs(segment[known], inside[known])
                    yield rows_of(u[common][s], 2, u[common][s], start[common][s] + i, c, np.ones(len(s)))
                    told = np.zeros(len(w), bool)
                    told[first] = True
                    s, i = segment[told], inside[told]
                    yield rows_of(signed(w[told]), 1, u[common][s], start[common][s] + i, np.ones(len(s)), known[told])

    return run


_SPANS = "u long, start long, windows int"


def _match(length: int):
    """From rows sorted by key: windows that are repeated."""

    def matched(key, kind, u, start, windows, known, data: pa.Array) -> Iterator[pa.RecordBatch]:
        settled = kind == 2
        if settled.any():
            yield batch(_SPANS, u[settled], start[settled], windows[settled])
        alone = kind == 1
        if alone.any():
            _, number, times = np.unique(key[alone], return_inverse=True, return_counts=True)
            hit = np.flatnonzero(alone)[(times[number] > 1) & (known[alone] == 0)]
            yield batch(_SPANS, u[hit], start[hit], windows[hit])
        whole = np.flatnonzero(kind == 0)
        if len(whole):
            for chunk in chunks(data.take(pa.array(whole, pa.int64())), 1 << 62):
                segment, inside, w = windows_of(chunk.data, chunk.offsets, windows[whole], key[whole], length)
                _, number, times = np.unique(w, return_inverse=True, return_counts=True)
                hit = (times[number] > 1) | (known[whole] == 1)[segment]
                s, i, c = _runs(segment[hit], inside[hit])
                s = whole[s]
                yield batch(_SPANS, u[s], start[s] + i, c.astype(np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def columns(rows: list[pa.RecordBatch]):
            table = pa.Table.from_batches(rows).combine_chunks()
            return *(np.asarray(table.column(i)) for i in range(6)), table.column(6).combine_chunks() if table.column(6).num_chunks != 1 else table.column(6).chunk(0)

        for rows in batches:
            if not rows.num_rows:
                continue
            key = np.asarray(rows.column("key"))
            # Rows before the last key are complete groups with those held.
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or (held and held[-1].column("key")[-1].as_py() != key[-1]):
                held.append(rows.slice(0, cut))
                size += held[-1].nbytes
                if size >= SORTED:
                    yield from matched(*columns(held))
                    held, size = [], 0
            held.append(rows.slice(cut))
            size += held[-1].nbytes
        if held:
            yield from matched(*columns(held))

    return run


_PACKED = "u long, doc_id long, z binary"


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, since they are to be shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for rows in batches:
        column = rows.column(2)
        packed = pa.array((pack.compress((t.as_py() or "").encode()) for t in column), pa.binary())
        yield batch(_PACKED, rows.column(0), rows.column(1), packed)


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, copied, spans) of the rows that hold a repeated string: whether the whole text stands in another row too, and
    the runs of repeated windows as ``array<struct<start, windows>>`` (null for none). ``u`` is ``row_key``.
    """
    spark = docs.sparkSession
    gram = max(2, min(32, length // 4))
    source = docs.select(row_key(key, text).alias("u"), _text(text).alias("text"))
    source = source.select("u", "text", F.xxhash64("text").alias("k"), F.octet_length("text").alias("n"))
    long_enough = source.where(F.col("n") >= length)
    same = long_enough.groupBy("k", "n").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k", "n")
    copied = long_enough.select("u", "k", "n").join(same, ["k", "n"]).select("u").distinct()

    segments = long_enough.select("u", "k", "text").mapInArrow(_segments(length, gram), _SEGMENTS)
    again = segments.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("seen").alias("seen"), F.sum((F.col("seen") < 2).cast("int")).alias("together")).where("c > 1 or seen > 0")
    open_ = segments.join(again.select("m", "together"), "m")
    by_text = open_.groupBy("u").agg(F.collect_list(F.struct("m", "start", "windows", "seen", "together")).alias("segments"))
    dealt = packed(docs, key, text).select("u", "z").join(by_text, "u").mapInArrow(_deal(length), _DEALT)
    spans = dealt.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_match(length), _SPANS)
    spans = spans.groupBy("u").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return spans.join(copied.withColumn("copied", F.lit(True)), "u", "full")


def _text(text: str):
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def row_key(key: str, text: str):
    """A hash of key and text; rows that share it are equal and so is what is found in them."""
    return F.xxhash64(F.col(f"`{key}`").cast("long"), _text(text))


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(u, doc_id, z): every row's text in UTF-8, compressed, as it is to be shuffled."""
    rows = docs.select(row_key(key, text).alias("u"), F.col(f"`{key}`").cast("long").alias("doc_id"), _text(text).alias("text"))
    return rows.mapInArrow(_packed, _PACKED)


def covered(size: int, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which bytes repeated windows cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + windows + length - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _covered_rows(rows: pa.RecordBatch, length: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    unpack = zstandard.ZstdDecompressor()
    z, spans, copied = (rows.column(c) for c in ("z", "spans", "copied"))
    for i in range(rows.num_rows):
        data = unpack.decompress(z[i].as_py())
        if copied[i].as_py():
            yield i, data, np.ones(len(data), bool)
        elif spans[i].is_valid:
            each = spans[i].values
            yield i, data, covered(len(data), np.asarray(each.field(0)), np.asarray(each.field(1)).astype(np.int64), length)
        else:
            yield i, data, np.zeros(len(data), bool)


_CUT = "u long, doc_id long, n long, kept string"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Texts are UTF-8 bytes, null ones empty. A byte is removed if a string of ``length`` bytes around it, within the
    text, also starts at another place of any text; places are judged on the input. ``n_spans`` counts maximal removed
    runs, ``kept_sha256`` is over the other bytes. Equal rows are copies of each other. Null keys stay null. An empty
    table gives no rows.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for _, data, gone in _covered_rows(rows, length):
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                edges = np.diff(gone.astype(np.int8), prepend=0)
                out.append((len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
            columns = [list(c) for c in zip(*out)] if out else [[], [], [], []]
            yield batch(_DIGEST, rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()))

    found = repeated_spans(docs, length, key, text)
    return packed(docs, key, text).join(found, "u", "left").select("doc_id", "z", "spans", "copied").mapInArrow(digest, _DIGEST)


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what ``suffix_dedup`` removes cut out of the texts; all rows and columns stay.

    Bytes left of a character that was cut in two go as well. Texts that hold nothing repeated, nulls among them, are
    as they were.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            kept = [np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for _, data, gone in _covered_rows(rows, length)]
            sizes = [zstandard.frame_content_size(z.as_py()) for z in rows.column("z")]
            yield batch(_CUT, rows.column("u"), rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.string()))

    found = repeated_spans(docs, length, key, text)
    cut_rows = packed(docs, key, text).join(found, "u").dropDuplicates(["u"]).select("u", "doc_id", "z", "spans", "copied").mapInArrow(cut, _CUT)
    # Whole rows in a column of their own, whatever their columns' names; key and length are compared beside the hash, so
    # that no row gets another one's text.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        row_key(key, text).alias("row_u"),
        F.col(f"`{key}`").cast("long").alias("row_id"),
        F.octet_length(_text(text)).cast("long").alias("row_n"),
    )
    same = (F.col("row_u") == F.col("u")) & (F.col("row_n") == F.col("n")) & F.col("row_id").eqNullSafe(F.col("doc_id"))
    joined = rows.join(cut_rows, same, "left")

    def column(name: str):
        own = F.col("row").getField(name)
        return (F.coalesce("kept", own.cast("string")) if name == text else own).alias(name)

    return joined.select(*(column(c) for c in docs.columns))
