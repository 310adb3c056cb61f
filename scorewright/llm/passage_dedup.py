"""Substring dedup by compact windows: near-duplicate passages of documents.

The tokens of a text are its shingles of some words. For one hash function, the token with the smallest value in a run
of tokens is that run's min-hash, and by the Cartesian tree over the values all runs with one min-hash token form a
compact window: they begin between ``left`` and ``center`` and end between ``center`` and ``right``. Only windows that
hold a run of the length asked for are made, about two for every such length of text.

The windows of one function part all places where a run of the length asked for can begin. Windows of several functions are
joined where these intervals overlap: a cell is an overlap on which enough functions have one min-hash each. Cells that agree
on all of these are a group. Those of one content meet the first of it; what is left of a group are different contents. Two
meet at once; of more, the tokens are fetched, and all pairs compared by what they share: a tree joins those that are surely alike and
stands for all of their pairs, and of two trees all pairs are tried that may hold passages which are alike. What has
met is verified by its shingles.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, checkpointed, partitions, signed
from scorewright.llm.suffix_dedup import packed, row_key
from scorewright.llm.texts import CHUNK, chunks, mix, powers, shingles, words

SHINGLE, LENGTH, SIMILARITY = 5, 50, 0.8
# Hash functions, and how many of them have to agree.
FUNCTIONS, AGREE = 5, 2
# Cells of a group whose pairs one task compares at a time. It only decides how the work is dealt.
TILE = 2048

_U32 = np.uint64(32)


def _marked(*places: np.ndarray) -> np.ndarray:
    """All distinct places in order."""
    marks = np.zeros(max((int(p.max(initial=-1)) for p in places), default=-1) + 1, bool)
    for p in places:
        marks[p] = True
    return np.flatnonzero(marks)


def compact_windows(values: np.ndarray, offsets: np.ndarray, length: int, near: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, left and right of every compact window that holds ``length`` tokens of one text; ties go to the left.

    :param near: bounds farther from the center than ``length`` tokens need not be found, which bounds memory for long texts
    """
    none = np.zeros(0, np.int64)
    size = len(values)
    if size < length:
        return none, none, none
    key = (values >> _U32 << _U32) | np.arange(size, dtype=np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # Levels of least keys over runs of 1, 2, 4, ... tokens, by which bounds are found in steps that halve.
    levels = [key]
    longest = length if near else int(np.diff(offsets).max(initial=0))
    while 1 << len(levels) <= longest:
        last, reach = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[: len(last) - reach], last[reach:]))
    top = length.bit_length() - 1
    run = np.minimum(levels[top][: size - length + 1], levels[top][length - (1 << top) : length - (1 << top) + size - length + 1])
    inside = np.arange(size - length + 1) + length <= offsets[1:][text[: size - length + 1]]
    center = _marked((run[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    if not len(center):
        return none, none, none
    own = key[center]
    right, left = center.copy(), center.copy()
    last, first = offsets[1:][text[center]] - 1, offsets[:-1][text[center]]
    for level in range(len(levels) - 1, -1, -1):
        reach, least = 1 << level, levels[level]
        go = right + reach <= last
        go[go] = least[right[go] + 1] > own[go]
        right[go] += reach
        go = left - reach >= first
        go[go] = least[left[go] - reach] > own[go]
        left[go] -= reach
    return center, left, right


def joined_ties(tokens: np.ndarray, offsets: np.ndarray, center, left, right, length: int):
    """Windows around one token that stands several times in ``length`` tokens, with none smaller between, as one: its first and last place,
    left and right. Every run in there that holds one of the places has that token for its min-hash."""
    if not len(center):
        return center, center, left, right
    text = np.searchsorted(offsets, center, "right") - 1
    fresh = np.ones(len(center), bool)
    fresh[1:] = (tokens[center[1:]] != tokens[center[:-1]]) | (text[1:] != text[:-1]) | (right[:-1] < center[1:])
    part = (center - center[np.maximum.accumulate(np.where(fresh, np.arange(len(center)), 0))]) // length
    fresh[1:] |= part[1:] != part[:-1]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(center)) - 1
    return center[begin], center[end], left[begin], right[end]


# A window: its text, the first start of a run of the length asked for and how many there are; and the cells within it, each
# 16 bits of what else has to agree (more that agree by chance are only compared in vain), 32 of its content and its first start.
_WINDOWS = "key long, u long, place long, cells binary"
_MET = "u long, v long, start int, stop int, v_start int, v_stop int"
# What met, without a group; and the cells of groups, without a partner.
_AGREED = f"{_MET}, what long"
# Bits of a place that count starts.
_COUNT = 20


def tokens_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for chunk in chunks(column, CHUNK):
        found = words(chunk)
        yield chunk.first, *shingles(found.hashes(), found.offsets, shingle, short=False)


def _cell(length: int) -> np.dtype:
    return np.dtype([("other", "<u2"), ("content", "<u4"), ("first", "u1" if length <= 256 else "<u4")])


def start_windows(tokens: np.ndarray, offsets: np.ndarray, length: int, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-hash, first and last start of the runs of ``length`` tokens in each compact window; together they part all starts."""
    values = mix(tokens ^ np.uint64(0xA24BAED4963EE407 * (function + 1) & (2**64 - 1)))
    head, last, left, right = joined_ties(tokens, offsets, *compact_windows(values, offsets, length, near=True), len(tokens) + 1)
    first, final = np.maximum(left, head - length + 1), np.minimum(last, right - length + 1)
    # Tokens that stand again and again make longer windows; they are cut.
    parts = (final - first) // length + 1
    of = np.repeat(np.arange(len(first)), parts)
    begin = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
    return values[head[of]], begin, np.minimum(final[of], begin + length - 1)


def interval_join(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last start of every overlap of one window of each function, and which windows these are."""
    begin = _marked(*(first for _, first, _ in windows))
    which = [np.searchsorted(first, begin, "right") - 1 for _, first, _ in windows]
    return begin, np.minimum.reduce([last[w] for (_, _, last), w in zip(windows, which)]), which


def cells(tokens: np.ndarray, offsets: np.ndarray, length: int, functions: int, agree: int):
    """(key, first start, starts, counts, cells) of the windows of each function: their overlaps with windows of ``agree`` - 1
    functions after it are cells, those with the same functions in a row. Places count from the first token of the chunk."""
    made = [start_windows(tokens, offsets, length, f) for f in range(functions)]
    if not len(made[0][0]):
        return
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens)), out=prefix[1:])
    inverse = powers(len(tokens) + 1, True)
    for f in range(functions - agree + 1):
        least, first, last = made[f]
        of, found = [], []
        for others in combinations(range(f + 1, functions), agree - 1):
            begin, end, which = interval_join([made[g] for g in (f, *others)])
            value = np.zeros(len(begin), np.uint64)
            for g, w in zip(others, which[1:]):
                value = mix(value ^ (made[g][0][w] + np.uint64(g + 1)))
            content = mix((prefix[end + length] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
            cell = np.zeros(len(begin), _cell(length))
            cell["other"], cell["content"] = value >> np.uint64(48), content >> _U32
            cell["first"] = begin - first[which[0]]
            of.append(which[0])
            found.append(cell)
        of = np.concatenate(of)
        yield mix(least + np.uint64(f)), first, last - first + 1, np.bincount(of, minlength=len(first)), np.concatenate(found)[np.argsort(of, kind="stable")]


def _binary(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values as binary, so many to each row."""
    ends = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of what ``_binary`` put together."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data if data is not None else b"", np.uint8)[ends[0] : ends[-1]]
    return np.repeat(np.arange(len(column)), np.diff(ends) // kind.itemsize), values.view(kind)


def _windows(shingle: int, length: int, functions: int, agree: int):
    """Compact windows by function and min-hash, with their cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = np.asarray(rows.column("u"))
            for first, tokens, offsets in tokens_of(rows.column("text"), shingle):
                for key, start, number, count, cell in cells(tokens, offsets, length, functions, agree):
                    text = np.searchsorted(offsets, start, "right") - 1
                    yield batch(_WINDOWS, signed(key), ids[first + text], (start - offsets[text] << _COUNT) + number, _binary(count, cell))

    return run


def _partners(length: int):
    """Windows sorted by key, text and place: cells meet the first of their content, and two different contents each other; cells of groups
    with more, one of each content, are told with their group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first of each content so far, of the groups of the last key.
        last_key, agreed, contents, heads = None, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros((3, 0), np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            # Windows alone with their key meet nothing.
            key = np.asarray(rows.column(0))
            with_next = key[1:] == key[:-1]
            rows = rows.filter(pa.array(np.append(key[0] == last_key, with_next) | np.append(with_next, True)))
            key, u, start = (np.asarray(c).astype(np.int64) for c in rows.columns[:3])
            number, start = start & (1 << _COUNT) - 1, start >> _COUNT
            row, cell = _values(rows.column(3), _cell(length))
            # A cell ends where the next one of its functions begins, the last one with the window.
            first, last = cell["first"].astype(np.int64), number[row] - 1
            follows = (row[1:] == row[:-1]) & (first[1:] > 0)
            last[:-1][follows] = first[1:][follows] - 1
            if key[0] != last_key:
                agreed, contents, heads = agreed[:0], contents[:0], heads[:, :0]
            before = len(agreed)
            last_key = key[-1]
            of_last = np.append(np.full(before, key[0] == last_key), key[row] == last_key)
            what = np.append(agreed, mix(key[row].view(np.uint64) ^ (cell["other"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            content = np.append(contents, cell["content"])
            own = np.append(heads, np.stack([u[row], start[row] + first, start[row] + last]), axis=1)
            # The first of each content, group by group.
            order = np.lexsort((content, what))
            new_group, new = np.ones(len(order), bool), np.ones(len(order), bool)
            new_group[1:] = what[order[1:]] != what[order[:-1]]
            new[1:] = new_group[1:] | (content[order[1:]] != content[order[:-1]])
            each, group = order[new], np.cumsum(new_group)[new] - 1
            copies, its = order[~new], each[np.cumsum(new)[~new] - 1]
            different, known = np.bincount(group), np.bincount(group, each < before)
            head = np.minimum.reduceat(each, np.flatnonzero(new_group[new]))[group] if len(each) else each
            two = (different[group] == 2) & (each != head) & (each >= before)
            met = _met(own[:, np.append(copies, each[two])], own[:, np.append(its, head[two])], length)
            if met.num_rows:
                yield batch(_AGREED, *met.columns, pa.nulls(met.num_rows, pa.int64()))
            told = np.sort(each[(different[group] > 2) & ((each >= before) | (known[group] < 3))])
            if len(told):
                none = pa.nulls(len(told), pa.int32())
                place = (own[1, told].astype(np.int32), (own[2, told] + length - 1).astype(np.int32))
                yield batch(_AGREED, own[0, told], none.cast(pa.int64()), *place, none, none, signed(what[told]))
            kept = np.sort(each[of_last[each]])
            agreed, contents, heads = what[kept], content[kept], own[:, kept]

    return run


def _met(own: np.ndarray, its: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of tokens that cells (text, first start, last start) and those they met stand for. Within one text they may
    not overlap; cells of one text in a row that met one cell after the other are one."""
    (u, first, last), (v, v_first, v_last) = own.copy(), its.copy()
    stop, v_stop = last + length - 1, v_last + length - 1
    same = u == v
    # As its partner stands first, the own run begins behind its shortest and the partner's ends before that.
    first = np.where(same, np.maximum(first, v_first + length), first)
    v_stop = np.where(same, np.minimum(v_stop, first - 1), v_stop)
    keep = stop - first + 1 >= length
    u, v, first, stop, v_first, v_stop = (x[keep] for x in (u, v, first, stop, v_first, v_stop))
    order = np.lexsort((v_first, first, v, u))
    u, v, first, stop, v_first, v_stop = (x[order] for x in (u, v, first, stop, v_first, v_stop))
    fresh = np.ones(len(u), bool)
    step = v_first[1:] - v_first[:-1]
    fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (first[1:] - first[:-1] > 1) | (step < 0) | (step > 1)
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return batch(_MET, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)))
    stop, v_stop = np.maximum.reduceat(stop, begin), np.maximum.reduceat(v_stop, begin)
    return batch(_MET, u[begin], v[begin], *(x.astype(np.int32) for x in (first[begin], stop, v_first[begin], v_stop)))


_RUNS = "u long, v long, start int, stop int, v_start int, v_stop int"


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows grouped by text and partner: their runs, joined where they overlap in both."""
    for rows in batches:
        out = []
        u, v, met = (rows.column(c) for c in ("u", "v", "met"))
        lists = np.concatenate([[0], np.cumsum(np.asarray(met.value_lengths()))])
        each = met.flatten()
        parts = [np.asarray(each.field(i)).astype(np.int64) for i in range(4)]
        for i in range(rows.num_rows):
            found: list[list[int]] = []
            for start, stop, v_start, v_stop in sorted(zip(*(x[lists[i] : lists[i + 1]].tolist() for x in parts))):
                for run in reversed(found):
                    if start > run[1] + 1:
                        continue
                    # Within one text, not so that the runs would overlap.
                    if v_start <= run[3] + 1 and run[2] <= v_stop + 1 and (u[i] != v[i] or max(v_stop, run[3]) < run[0]):
                        run[1:] = max(stop, run[1]), min(v_start, run[2]), max(v_stop, run[3])
                        break
                else:
                    found.append([start, stop, v_start, v_stop])
            out += [(u[i].as_py(), v[i].as_py(), *run) for run in found]
        if out:
            columns = [list(c) for c in zip(*out)]
            yield batch(_RUNS, *(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.int32()) for c in columns[2:]))


def _previous(values: np.ndarray) -> np.ndarray:
    """Where each value stood last before, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _places(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where each token stands in the other run, or -1; of several places the one that goes best with its neighbours."""
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    low, high = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
    at = np.where(high > low, order[np.minimum(low, len(order) - 1)], -1)
    many, once = np.flatnonzero(high - low > 1), np.flatnonzero(high - low == 1)
    if len(many):
        wanted = np.interp(many, once, at[once]).astype(np.int64) if len(once) else np.minimum(many, len(other) - 1)
        number = np.cumsum(np.append(0, ranked[1:] != ranked[:-1])) * len(other)
        after = np.clip(np.searchsorted(number + order, number[low[many]] + wanted), low[many], high[many] - 1)
        before = np.maximum(after - 1, low[many])
        at[many] = np.where(np.abs(order[before] - wanted) <= np.abs(order[after] - wanted), order[before], order[after])
    return at


def verified(own: np.ndarray, other: np.ndarray, length: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages (first and last token of both, Jaccard similarity) that are alike within two runs of tokens.

    A run that is alike as a whole, without ends that aren't shared, is one. Otherwise spans of up to twice the length are
    looked at from each shared token on, as a longer passage holds one of these that is alike; the best is made as wide
    as it stays alike, and what is left on both sides is tried again.
    """
    out = []
    size = len(other)
    if len(own) < length or size < length:
        return out
    if np.array_equal(own, other):
        return [(0, size - 1, 0, size - 1, 1.0)]
    mine, its = np.unique(own), np.unique(other)
    if len(mine) == len(own) and len(its) == size:
        # Without repeats, both passages have as many distinct tokens as the length at least.
        shared = len(np.intersect1d(mine, its, assume_unique=True))
        if shared * (1 + similarity) < 2 * similarity * length - 1e-6:
            return out
    at = _places(own, other)
    back = ahead = again = np.zeros(0, np.int64)

    def repeats():
        """Where tokens stand again, for runs that aren't alike as a whole."""
        nonlocal back, ahead, again
        back = _previous(own)
        ahead = len(own) - 1 - _previous(own[::-1])[::-1]
        ahead[ahead == len(own)] = len(own)
        # Tokens of the other run that stood shortly before.
        again = np.concatenate([[0], np.cumsum((lambda x: (x >= 0) & (x >= np.arange(size) - length))(_previous(other)))])

    def alike(x: int, y: int, low: int, high: int):
        """The passage, if it is one; where its partner is short, with what follows or stands before that."""
        z, w = low, max(high + 1, min(low + length, size))
        z = max(0, min(z, w - length))
        mine, its = np.unique(own[x:y]), np.unique(other[z:w])
        shared = len(np.intersect1d(mine, its, assume_unique=True))
        share = shared / (len(mine) + len(its) - shared)
        return (x, y - 1, z, w - 1, share) if share >= similarity and y - x >= length else None

    def scores(index: np.ndarray, fresh: np.ndarray):
        """For spans along the last axis: their surplus of shared tokens, and the ends of their partners."""
        place = at[index]
        known = place >= 0
        low = np.minimum.accumulate(np.where(known, place, size), -1)
        high = np.maximum.accumulate(place, -1)
        distinct, shared = np.cumsum(fresh, -1), np.cumsum(fresh & known, -1)
        its = np.maximum(high - low + 1, 0)
        its = np.maximum(its, np.minimum(length, size)) - np.where(its > 0, again[high + 1] - again[np.minimum(low, size)], 0)
        return (1 + similarity) * shared - similarity * (distinct + np.maximum(its, shared)), low, high

    def seed(a: int, b: int):
        starts = np.flatnonzero(at[a : b - length + 1] >= 0) + a
        starts = np.union1d(starts, [b - length]).astype(np.int64)
        found = []
        for part in range(0, len(starts), 2048):
            begin = starts[part : part + 2048]
            index = begin[:, None] + np.arange(2 * length)
            inside, index = index < b, np.minimum(index, b - 1)
            score, low, high = scores(index, back[index] < begin[:, None])
            ends = inside & (np.arange(2 * length) >= length - 1) & ((at[index] >= 0) | (np.arange(2 * length) == length - 1)) & (high >= 0)
            score = np.where(ends, score, -np.inf)
            best = score.argmax(1)
            pick = np.arange(len(begin)), best
            found += [x for x in zip(score[pick].tolist(), begin.tolist(), (begin + best + 1).tolist(), low[pick].tolist(), high[pick].tolist()) if x[0] >= -1e-6]
        for _, *span in sorted(found, key=lambda x: -x[0]):
            if passage := alike(*span):
                return passage
        return None

    def widened(passage, a: int, b: int):
        while True:
            before = passage
            x, y = passage[0], passage[1] + 1
            score, low, high = scores(np.arange(x, b), back[x:b] < x)
            for q in np.flatnonzero((score >= -1e-6) & (at[x:b] >= 0) & (np.arange(x, b) >= y))[::-1].tolist():
                if wider := alike(x, x + q + 1, int(low[q]), int(high[q])):
                    passage = wider
                    break
            y = passage[1] + 1
            index = np.arange(y - 1, a - 1, -1)
            score, low, high = scores(index, ahead[index] >= y)
            for q in np.flatnonzero((score >= -1e-6) & (at[index] >= 0) & (index < x))[::-1].tolist():
                if wider := alike(y - 1 - q, y, int(low[q]), int(high[q])):
                    passage = wider
                    break
            if passage == before:
                return passage

    todo = [(0, len(own))]
    while todo:
        a, b = todo.pop()
        known = np.flatnonzero(at[a:b] >= 0) + a
        if b - a < length or not len(known):
            continue
        x, y = int(known[0]), int(known[-1]) + 1
        its = np.flatnonzero(np.isin(other, own[x:y]))
        passage = alike(x, y, int(its[0]), int(its[-1])) or alike(x, y, int(at[known].min()), int(at[known].max()))
        if not passage:
            if not len(again):
                repeats()
            passage = seed(a, b)
            passage = passage and widened(passage, a, b)
        if passage:
            out.append(passage)
            todo += [(a, passage[0]), (passage[1] + 1, b)]
    return out


_BLOBS = "u long, doc_id long, v long, start int, stop int, v_start int, v_stop int, side int, tokens binary"
_PASSAGES = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, similarity double"


def _short(tokens: np.ndarray) -> bytes:
    """Six bytes of each token; only tokens of two runs are compared by them."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _unpacked(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in a row with the tokens of their texts; texts are taken together up to a chunk."""
    unpack = zstandard.ZstdDecompressor()
    for rows in batches:
        first, size, texts = 0, 0, []
        for i, z in enumerate(rows.column("z")):
            texts.append(unpack.decompress(z.as_py()))
            size += len(texts[-1])
            if size >= CHUNK or i == rows.num_rows - 1:
                for begin, tokens, offsets in tokens_of(pa.array(texts, pa.large_binary()), shingle):
                    yield rows.slice(first + begin, len(offsets) - 1), tokens, offsets
                first, size, texts = i + 1, 0, []


def _cut(shingle: int):
    """The tokens of the runs asked for, from each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tokens, offsets in _unpacked(batches, shingle):
            out = []
            u, doc_id, asked = (rows.column(c).to_pylist() for c in ("u", "doc_id", "asked"))
            for i, at in enumerate(offsets[:-1].tolist()):
                for one in asked[i]:
                    a, b = (one["start"], one["stop"]) if one["side"] == 0 else (one["v_start"], one["v_stop"])
                    out.append((u[i], doc_id[i], one["v"], one["start"], one["stop"], one["v_start"], one["v_stop"], one["side"], _short(tokens[at + a : at + b + 1])))
            c = [list(x) for x in zip(*out)]
            types = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.binary()]
            yield batch(_BLOBS, *(pa.array(x, t) for x, t in zip(c, types)))

    return run


_CELLS = "u long, what long, tiles int, start int, stop int, tokens binary"
# Bytes of a token by which the cells of a group are compared.
_FEW = 3
# Groups are compared together up to so many pairs, in both orders. Their shared tokens are counted pair by pair up to so many cells of a group.
PAIRS, _FEW_CELLS = 1 << 17, 16
# Pairs looked at together, which bounds memory for large groups.
PAIR_BLOCK = 1 << 20


def _cut_cells(shingle: int):
    """The tokens of the cells asked for, from each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tokens, offsets in _unpacked(batches, shingle):
            asked = rows.column("asked")
            text = np.repeat(np.arange(rows.num_rows), np.asarray(asked.value_lengths()))
            what, tiles, start, stop = (np.asarray(x) for x in asked.flatten().flatten())
            size = (stop - start + 1).astype(np.int64)
            at = np.repeat(offsets[text] + start - np.cumsum(size) + size, size) + np.arange(size.sum())
            few = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[at, :_FEW])
            yield batch(_CELLS, np.asarray(rows.column("u"))[text], what, tiles, start, stop, _binary(size, few.view(f"V{_FEW}").ravel()))

    return run


def _shared(owner: np.ndarray, column: np.ndarray, count: int) -> np.ndarray:
    """How many tokens, each with a column of its own, every two owners share."""
    shared = np.zeros((count, count), np.float32)
    columns, step = int(column.max(initial=-1)) + 1, max(64, (1 << 22) // count)
    for low in range(0, columns, step):
        a, b = np.searchsorted(column, [low, low + step])
        matrix = np.zeros((count, min(step, columns - low)), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        shared += matrix @ matrix.T
    return shared


def holds_alike(own: np.ndarray, its: np.ndarray, length: int, similarity: float) -> bool:
    """Whether two runs of tokens hold passages that are alike."""
    _, at, place = np.intersect1d(own, its, return_indices=True)
    order = np.argsort(at)
    at, place = at[order], place[order]
    if len(np.unique(own)) < len(own) or len(np.unique(its)) < len(its) or (place[1:] < place[:-1]).any():
        return bool(verified(own.astype(np.uint64), its.astype(np.uint64), length, similarity))
    # From any shared token to any later one.
    number = np.arange(1, len(at) + 1)
    wide = sum(np.maximum(x - x[:, None] + 1, length) for x in (at, place))
    shared = number - number[:, None] + 1
    return bool((shared * (1 + similarity) >= similarity * wide - 1e-6).any())


def _ranges(size: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class _Groups:
    """Cells of some groups, group by group, with what every two cells of a group share; tokens are numbered, those of
    each group on their own."""

    def __init__(self, group: np.ndarray, u: np.ndarray, start: np.ndarray, stop: np.ndarray, tokens: np.ndarray, length: int, similarity: float, home: np.ndarray):
        self.length, self.similarity = length, similarity
        count, self.size = len(u), stop - start + 1
        self.offsets = np.cumsum(self.size) - self.size
        self.low = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        number = np.diff(np.append(self.low, count))
        group = np.repeat(np.arange(len(number)), number)
        self.first, self.number = self.low[group], number[group]
        self.local = np.arange(count) - self.first
        # Where the pairs of a cell with all of its group stand.
        self.row = (np.cumsum(number**2) - number**2)[group] + self.local * self.number
        owner = np.repeat(np.arange(count), self.size)
        key = (group[owner] << 8 * _FEW) + tokens
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        fresh = np.append(True, key[1:] != key[:-1])
        self.token = np.empty(len(key), np.int64)
        self.token[order] = np.cumsum(fresh) - 1
        # Of a token that stands several times in a cell, one; of the others, where it stood last before.
        keep = fresh | np.append(True, owner[1:] != owner[:-1])
        again = np.flatnonzero(~keep)
        self.before = np.full(len(key), -1)
        self.before[order[again]] = order[again - 1] - self.offsets[owner[again]]
        token, owner = (np.cumsum(fresh) - 1)[keep], owner[keep]
        self.distinct = np.bincount(owner, minlength=count)
        self.begin, self.end = np.full((2, int(token[-1]) + 1), -1)
        self.narrow: dict[int, np.ndarray] = {}
        self.shared = self._all_shared(token, owner, number)
        self._pairs(u, start, stop, home)

    def _all_shared(self, token: np.ndarray, owner: np.ndarray, number: np.ndarray) -> np.ndarray:
        often = np.bincount(token)[token] > 1
        token, owner = token[often], owner[often]
        if number.max() > _FEW_CELLS:
            # Tokens are numbered group by group.
            ends = np.append(np.searchsorted(self.first[owner], self.low), len(owner))
            out = []
            for i, low in enumerate(self.low):
                part = slice(ends[i], ends[i + 1])
                column = np.cumsum(np.append(False, token[part][1:] != token[part][:-1]))[: ends[i + 1] - ends[i]]
                out.append(_shared(owner[part] - low, column, number[i]).ravel())
            return np.concatenate(out)
        # Each owner of a token with those after it.
        end = np.searchsorted(token, token, "right")
        after = end - 1 - np.arange(len(token))
        at = np.repeat(np.arange(len(token)), after)
        pair = self.row[owner[at]] + self.local[owner[at + 1 + _ranges(after)]]
        return np.bincount(pair, minlength=int((number**2).sum())).astype(np.float32)

    def _pairs(self, u: np.ndarray, start: np.ndarray, stop: np.ndarray, home: np.ndarray) -> None:
        """Which pairs may hold passages that are alike, earlier cell first; and which of these, in both orders, don't overlap."""
        # Every run of the length asked for in a cell has so many distinct tokens.
        again = np.flatnonzero(self.before >= 0)
        cell = np.searchsorted(self.offsets, again, "right") - 1
        # From and to which start a run holds a token twice.
        from_ = np.maximum(again - self.offsets[cell] - self.length + 1, 0)
        to = np.minimum(self.before[again], self.size[cell] - self.length)
        held = from_ <= to
        at, size = self.offsets[cell[held]], len(self.token) + 1
        twice = np.cumsum(np.bincount(at + from_[held], minlength=size) - np.bincount(at + to[held] + 1, minlength=size))
        least = self.least = self.length - np.maximum.reduceat(twice, self.offsets)
        self.may, self.apart = np.zeros((2, len(self.shared)), bool)
        after = self.number - 1 - self.local
        ends = np.cumsum(after)
        begin = 0
        while begin < len(u):
            stop_at = max(begin + 1, int(np.searchsorted(ends, ends[begin] - after[begin] + PAIR_BLOCK, "right")))
            i = np.repeat(np.arange(begin, stop_at), after[begin:stop_at])
            j = i + 1 + _ranges(after[begin:stop_at])
            begin = stop_at
            at = self.row[i] + self.local[j]
            may = self.shared[at] * (1 + self.similarity) >= self.similarity * (least[i] + least[j]) - 1e-3
            i, j, at = i[may], j[may], at[may]
            # Within one text, runs don't overlap.
            same = u[i] == u[j]
            may = (home[i] != home[j]) & (~same | (stop[j] - start[i] + 1 >= 2 * self.length))
            self.may[at[may]] = True
            apart = may & (~same | (start[j] > stop[i]))
            i, j = i[apart], j[apart]
            self.apart[at[apart]] = self.apart[self.row[j] + self.local[i]] = True

    def found(self, at: np.ndarray, by: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of cells ``near``, each beside at[by]: their places, the first of each cell's, and their first and last places
        in the other, or -1. The cells ``at`` are of groups of their own."""
        size = self.size[at]
        place = _ranges(size)
        own = self.token[np.repeat(self.offsets[at], size) + place]
        self.end[own], self.begin[own[::-1]] = place, place[::-1]
        size = self.size[near]
        place = _ranges(size)
        its = self.token[np.repeat(self.offsets[near], size) + place]
        first, last = self.begin[its], self.end[its]
        self.begin[own] = self.end[own] = -1
        return place, np.cumsum(size) - size, first, last

    def sure(self, at: np.ndarray, by: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which cells are surely like that beside them; pairs that can't be are struck out."""
        length, similarity, size, distinct = self.length, self.similarity, self.size, self.distinct
        place, head, first, last = self.found(at, by, near)
        beside = at[by]
        known = first >= 0
        first[~known] = np.repeat(size[beside], size[near])[~known]
        # From the first to the last token shared, in both; there are no more distinct ones than in the cell.
        wide = np.maximum.reduceat(last, head) - np.minimum.reduceat(first, head) + 1
        its_wide = np.maximum.reduceat(np.where(known, place, -1), head) - np.minimum.reduceat(np.where(known, place, len(place)), head) + 1
        wide, its_wide = (np.minimum(np.maximum(x, length), distinct[n]) for x, n in ((wide, beside), (its_wide, near)))
        pair = self.row[np.minimum(beside, near)] + self.local[np.maximum(beside, near)]
        sure = self.shared[pair] * (1 + similarity) >= similarity * (wide + its_wide) - 1e-6
        rest = np.flatnonzero(~sure & (distinct[near] == size[near]) & (distinct[beside] == size[beside]))
        if len(rest):
            # Without repeats: the run with the largest surplus of shared tokens, and how far apart they stand in the other.
            column = np.arange(size[near[rest]].max())
            inside = column < size[near[rest], None]
            index = np.minimum(head[rest, None] + column, len(place) - 1)
            gain = np.zeros((len(rest), len(column) + 1))
            np.cumsum(np.where(inside, (1 + similarity) * known[index] - similarity, -len(column)), axis=1, out=gain[:, 1:])
            low = np.minimum.accumulate(gain, 1)
            surplus = gain[:, length:] - low[:, :-length]
            most, row = surplus.argmax(1), np.arange(len(rest))
            surplus = surplus[row, most]
            low = np.maximum.accumulate(np.where(gain == low, np.arange(len(column) + 1), 0), 1)[row, most]
            inside = (column >= low[:, None]) & (column < most[:, None] + length)
            wide = np.where(inside, last[index], -1).max(1) - np.where(inside, first[index], size[beside[rest], None]).min(1) + 1
            sure[rest] = surplus >= similarity * np.maximum(wide, length) - 1e-6
            self.may[pair[rest[surplus < similarity * length - 1e-6]]] = False
        return sure

    def narrowest(self, cell: int) -> np.ndarray:
        """How many distinct tokens a run of the length asked for or more has at least that holds places a to b of a cell."""
        if cell not in self.narrow:
            size = int(self.size[cell])
            before = self.before[self.offsets[cell] : self.offsets[cell] + size]
            place = np.arange(size)
            distinct = np.cumsum((before < place[:, None]) & (place >= place[:, None]), 1)
            last = size - self.length
            of_run = distinct[place[: last + 1], place[self.length - 1 :]]
            # The least of these from one to another.
            least = np.minimum.accumulate(np.where(place[: last + 1] >= place[: last + 1, None], of_run, size), 1)
            short = least[np.maximum(place + 1 - self.length, 0), np.minimum(place, last)[:, None]]
            self.narrow[cell] = np.where(place - place[:, None] + 1 >= self.length, distinct, short).astype(np.min_scalar_type(size)).ravel()
        return self.narrow[cell]

    def alike(self, at: np.ndarray, by: np.ndarray, near: np.ndarray) -> np.ndarray:
        """``holds_alike`` for each cell and that beside it."""
        _, head, first, last = self.found(at, by, near)
        beside = at[by]
        known = np.flatnonzero(first >= 0)
        pair = np.repeat(np.arange(len(near)), self.size[near])[known]
        own, its = first[known], known - head[pair]
        # Whether the tokens shared stand once and in one order, and whether the others do too.
        ordered = np.ones(len(near), bool)
        ordered[pair[first[known] < last[known]]] = False
        ordered[pair[1:][(pair[1:] == pair[:-1]) & (own[1:] <= own[:-1])]] = False
        plain = ordered & (self.distinct[near] == self.size[near]) & (self.distinct[beside] == self.size[beside])
        # From any shared token to any later one, those with so many between them at once.
        number = np.bincount(pair, minlength=len(near))
        ends = np.cumsum(number) - number
        out = np.zeros(len(near), bool)
        for repeats, rows in ((False, np.flatnonzero(plain)), (True, np.flatnonzero(ordered & ~plain))):
            rows = rows[number[rows] > 0]
            if not len(rows):
                continue
            column = np.arange(number[rows].max())
            index, inside = np.minimum(ends[rows, None] + column, len(own) - 1), column < number[rows, None]
            places = [np.where(inside, x[index], 0) for x in (own, its)]
            if repeats:
                cells, which = np.unique(np.concatenate([beside[rows], near[rows]]), return_inverse=True)
                narrow = [self.narrowest(x) for x in cells.tolist()]
                begin = np.cumsum([0, *map(len, narrow)])[which].reshape(2, -1, 1)
                narrow, size = np.concatenate(narrow), self.size[cells][which].reshape(2, -1, 1)
            good = np.zeros(len(rows), bool)
            # As many as the runs with the fewest distinct tokens need.
            fewest = int(np.ceil((self.similarity * (self.least[beside[rows]] + self.least[near[rows]]).min() - 1e-6) / (1 + self.similarity)))
            for shared in range(max(1, fewest), len(column) + 1):
                from_, to = ([x[:, : len(column) + 1 - shared] for x in places], [x[:, shared - 1 :] for x in places])
                wide = sum(narrow[begin[k] + from_[k] * size[k] + to[k]].astype(np.int64) if repeats else np.maximum(to[k] - from_[k] + 1, self.length) for k in range(2))
                good |= ((shared * (1 + self.similarity) >= self.similarity * wide - 1e-6) & inside[:, shared - 1 :]).any(1)
            out[rows] = good
        # Where tokens stand again, this could only rule out passages. From the first to the last token shared may be one.
        rows = np.flatnonzero(np.where(ordered, out & ~plain, number > 0))
        if len(rows):
            spans = []
            some = np.flatnonzero(number)
            for cells, begin, end in ((beside, first[known], last[known]), (near, its, its)):
                low, high = np.zeros((2, len(near)), np.int64)
                low[some], high[some] = np.minimum.reduceat(begin, ends[some]), np.maximum.reduceat(end, ends[some])
                spans.append((cells[rows], low[rows], high[rows]))
            (own, a, b), (its, c, d) = spans
            d = np.maximum(d, np.minimum(c + self.length, self.size[its]) - 1)
            c = np.maximum(np.minimum(c, d + 1 - self.length), 0)
            long = b - a + 1 >= self.length
            wide = np.array([int(self.narrowest(x)[i * self.size[x] + j]) + int(self.narrowest(y)[k * self.size[y] + m]) for x, i, j, y, k, m in zip(*(v.tolist() for v in (own, a, b, its, c, d)))])
            shared = self.shared[self.row[np.minimum(own, its)] + self.local[np.maximum(own, its)]].astype(np.float64)
            whole = long & (shared / (wide - shared) >= self.similarity)
            out[rows[whole]] = True
            rows = rows[~whole]
        for i in rows:
            runs = (self.token[self.offsets[x] : self.offsets[x] + self.size[x]] for x in (beside[i], near[i]))
            out[i] = holds_alike(*runs, self.length, self.similarity)
        return out


def meetings(u: np.ndarray, start: np.ndarray, stop: np.ndarray, tokens: np.ndarray, length: int, similarity: float, home: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which cells of a group meet, the later one and the earlier one.

    Cells come in order of text and place, with the tokens start to stop of each. Those that are surely alike, from the first to the
    last token that they share or in the run that shares most, meet along a tree that joins them. Of others, all pairs
    are tried that share enough tokens for a passage in both, unless a tree joins them by then; those that hold passages
    which are alike join their trees. Only runs that may overlap within one text meet untried.

    :param home: the tile each cell is from; then only cells of two tiles meet
    :param group: the group each cell is of, if there are several, in order; each step is done for all of them at once
    """
    count = len(u)
    group = np.zeros(count, np.int64) if group is None else group
    made = _Groups(group, u, start, stop, tokens, length, similarity, np.arange(count) if home is None else home)
    tree, later, earlier = np.full(count, -1), [], []
    # Of each group that has a pair left, the cells reached and the roots to come.
    some = np.logical_or.reduceat(made.apart, made.row[made.low])
    todo = [([], iter(range(a, b))) for a, b in zip(made.low[some].tolist(), (made.low + made.number[made.low])[some].tolist())]
    while todo:
        at, left = [], []
        for reached, roots in todo:
            if reached:
                at.append(reached.pop())
            elif (root := next((i for i in roots if tree[i] < 0), None)) is not None:
                tree[root] = root
                at.append(root)
            else:
                continue
            left.append((reached, roots))
        todo, at = left, np.array(at, np.int64)
        if not len(at):
            break
        by, place = np.repeat(np.arange(len(at)), made.number[at]), _ranges(made.number[at])
        near = made.first[at][by] + place
        keep = made.apart[made.row[at][by] + place] & (tree[near] < 0)
        by, near = by[keep], near[keep]
        if not len(near):
            continue
        sure = made.sure(at, by, near)
        fresh, by = near[sure], by[sure]
        tree[fresh] = tree[at[by]]
        later.append(np.maximum(fresh, at[by]))
        earlier.append(np.minimum(fresh, at[by]))
        for i, cell in zip(by.tolist(), fresh.tolist()):
            todo[i][0].append(cell)
    tree = np.where(tree < 0, np.arange(count), tree)
    # Pairs that are left, first cell by first cell; in each round the next one of every group.
    rest = []
    for begin in range(0, len(made.may), PAIR_BLOCK):
        pair = begin + np.flatnonzero(made.may[begin : begin + PAIR_BLOCK])
        i = np.searchsorted(made.row, pair, "right") - 1
        j = made.first[i] + pair - made.row[i]
        rest.append(np.stack([pair, i, j])[:, tree[i] != tree[j]])
    pair, i, j = np.concatenate(rest, axis=1)
    fresh = np.append(True, i[1:] != i[:-1])[: len(i)]
    of = made.first[i[fresh]]
    turn = (np.arange(len(of)) - np.searchsorted(of, of))[np.cumsum(fresh) - 1] if len(i) else i
    order = np.argsort(turn, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1) if len(i) else []:
        part = part[tree[i[part]] != tree[j[part]]]
        meet = ~made.apart[pair[part]]
        tried = part[~meet]
        if len(tried):
            at, by = np.unique(i[tried], return_inverse=True)
            meet[~meet] = made.alike(at, by, j[tried])
        for a, b, apart in zip(i[part[meet]].tolist(), j[part[meet]].tolist(), made.apart[pair[part[meet]]].tolist()):
            if tree[a] == tree[b]:
                continue
            if apart:
                own = tree[made.first[a] : made.first[a] + made.number[a]]
                own[own == tree[b]] = tree[a]
            later.append(np.array([b]))
            earlier.append(np.array([a]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *later]), np.concatenate([none, *earlier])


def _compared(length: int, similarity: float):
    """Cells sorted by group, tiles, text and place: those that meet."""

    def compared(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole groups, those of like sizes at a time."""
        rows = rows.combine_chunks()
        what, low, high, home, u, start, stop = (np.asarray(rows.column(c)).astype(np.int64) for c in ("what", "low", "high", "home", "u", "start", "stop"))
        fresh = np.append(True, (what[1:] != what[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        group = np.cumsum(fresh) - 1
        # Cells of one tile may meet each other.
        home = np.where(low != high, home, np.arange(len(home)))
        size = stop - start + 1
        offsets = np.cumsum(size) - size
        data = np.concatenate([_values(c, np.dtype("u1"))[1] for c in rows.column("tokens").chunks]).reshape(-1, _FEW)
        first, number = np.flatnonzero(fresh), np.bincount(group)
        order = np.argsort(number, kind="stable")
        pairs, begin = np.cumsum(number[order] ** 2), 0
        while begin < len(order):
            end = max(begin + 1, int(np.searchsorted(pairs, pairs[begin] - number[order[begin]] ** 2 + PAIRS, "right")))
            some = order[begin:end]
            begin = end
            at = np.repeat(first[some], number[some]) + _ranges(number[some])
            bytes_ = data[np.repeat(offsets[at], size[at]) + _ranges(size[at])].astype(np.int64)
            later, earlier = meetings(u[at], start[at], stop[at], bytes_ @ (1 << 8 * np.arange(_FEW)), length, similarity, home[at], group[at])
            cell = np.stack([u[at], start[at], stop[at] - length + 1])
            yield cell[:, later], cell[:, earlier]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            # The last group may go on in the next rows.
            key = [rows.column(c) for c in ("what", "low", "high")]
            fresh = np.flatnonzero(np.logical_or.reduce([np.diff(np.asarray(c)) != 0 for c in key])) + 1
            if held and tuple(c[0] for c in key) != tuple(held[-1].column(c)[-1] for c in ("what", "low", "high")):
                fresh = np.append(0, fresh)
            if not len(fresh):
                held.append(rows)
                continue
            ended = pa.Table.from_batches([*held, rows.slice(0, fresh[-1])])
            held = [rows.slice(fresh[-1])]
            yield _met(*(np.concatenate(x, axis=1) for x in zip(*compared(ended))), length)
        if held:
            yield _met(*(np.concatenate(x, axis=1) for x in zip(*compared(pa.Table.from_batches(held)))), length)

    return run


def _verify(shingle: int, length: int, similarity: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                own, other = _long(row["tokens"]), _long(row["v_tokens"])
                for a, b, c, d, share in verified(own, other, length, similarity):
                    out.append((row["doc_id"], row["start"] + a, row["start"] + b + shingle - 1, row["v_id"], row["v_start"] + c, row["v_start"] + d + shingle - 1, share))
            if out:
                c = [list(x) for x in zip(*out)]
                yield batch(_PASSAGES, *(pa.array(x, pa.int64()) for x in c[:6]), pa.array(c[6], pa.float64()))

    return run


def passage_dedup(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE, similarity: float = SIMILARITY, functions: int = FUNCTIONS, agree: int = AGREE, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, similarity): passages with a near duplicate.

    Both passages have at least ``length`` words (runs of letters, digits and characters beyond ASCII, A-Z in lower
    case; places from 0, both ends included), and the Jaccard similarity of their distinct shingles of ``shingle`` words
    is at least ``similarity``. Every document that holds such a passage is named with partners that stand for all
    others: passages of more than two documents are joined by a tree, not in all pairs. Passages of one document may be
    partners if they don't overlap. Min-hashing may miss a near duplicate; equal passages are found always, up to
    hashes. Null and empty texts hold none; rows with null keys take part under a null id; rows with equal key and text
    count once. Texts may have any length: they are read whole, and no array is longer than the text has tokens. An empty table gives no rows.

    :param tile: cells of a group that one task compares at a time
    """
    spark = docs.sparkSession
    tokens = max(1, length - shingle + 1)
    source = docs.select(row_key(key, text).alias("u"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    windows = source.mapInArrow(_windows(shingle, tokens, functions, agree), _WINDOWS)
    sorted_ = windows.repartition(partitions(spark), "key").sortWithinPartitions("key", "u", "place")
    agreed = checkpointed(sorted_.mapInArrow(_partners(tokens), _AGREED), drop_shuffles=True)
    text_of = packed(docs, key, text)
    cells_ = agreed.where("what is not null").select("what", "u", "start", "stop")
    tiles = cells_.groupBy("what").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    cells_ = cells_.join(tiles.where("tiles > 1"), "what", "left")
    asked = cells_.groupBy(F.col("u").alias("owner")).agg(F.collect_list(F.struct("what", F.coalesce("tiles", F.lit(1)).alias("tiles"), "start", "stop")).alias("asked"))
    cells_ = text_of.join(asked, text_of["u"] == asked["owner"]).dropDuplicates(["u"]).select("u", "z", "asked").mapInArrow(_cut_cells(shingle), _CELLS)
    home = F.pmod(F.xxhash64("u", "start"), F.col("tiles")).cast("int")
    dealt = cells_.select("*", home.alias("home")).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("what", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"), "home", "u", "start", "stop", "tokens")
    dealt = dealt.repartition(partitions(spark), "what", "low", "high").sortWithinPartitions("what", "low", "high", "u", "start")
    met = agreed.where("what is null").drop("what").union(dealt.mapInArrow(_compared(tokens, similarity), _MET))
    grouped = met.groupBy("u", "v").agg(F.collect_set(F.struct("start", "stop", "v_start", "v_stop")).alias("met"))
    runs = checkpointed(grouped.mapInArrow(_join, _RUNS).distinct(), drop_shuffles=True)
    asked = runs.select(F.col("u").alias("owner"), "v", "start", "stop", "v_start", "v_stop", F.lit(0).alias("side"))
    zero = F.lit(0)
    given = runs.select(F.col("v").alias("owner"), "v", zero.alias("start"), zero.alias("stop"), "v_start", "v_stop", F.lit(1).alias("side")).distinct()
    all_asked = asked.union(given).groupBy("owner").agg(F.collect_list(F.struct("v", "start", "stop", "v_start", "v_stop", "side")).alias("asked"))
    joined = text_of.join(all_asked, text_of["u"] == all_asked["owner"]).dropDuplicates(["u"]).select("u", "doc_id", "z", "asked")
    # Cut once for each side, from the same shuffled texts, which takes less disk than a table of what is cut.
    blobs = joined.mapInArrow(_cut(shingle), _BLOBS)
    left = blobs.where("side = 0").select("doc_id", "v", "start", "v_start", "v_stop", "tokens")
    right = blobs.where("side = 1").select(F.col("doc_id").alias("v_id"), "v", "v_start", "v_stop", F.col("tokens").alias("v_tokens"))
    pairs = left.join(right, ["v", "v_start", "v_stop"])
    found = pairs.select("doc_id", "start", "tokens", "v_id", "v_start", "v_tokens").mapInArrow(_verify(shingle, tokens, similarity), _PASSAGES).distinct()
    # Read twice below; without this, all runs would be verified twice.
    found = checkpointed(found, drop_shuffles=True)
    # Those that others met have a partner too: for each of their passages, the first.
    least = F.min(F.struct(F.col("doc_id").alias("id"), "start_word", "end_word", "similarity")).alias("p")
    back = found.groupBy("other_id", "other_start", "other_end").agg(least)
    back = back.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"), "p.id", "p.start_word", "p.end_word", "p.similarity")
    return found.union(back).distinct()
