"""Benchmark decontamination by greedy string tiling.

Tiles are runs of words that a document and a benchmark item share. Karp-Rabin hashes of ``tile`` words in a row join
the two sides in seeds; seeds grow to maximal matches, and the longest match that is still unmarked on both sides
becomes a tile, again and again, until none of ``tile`` words is left. An item whose words are covered by tiles to a
given share is in the document, in whatever order its passages stand.

Items come in blocks of bounded size, each of which goes to all tasks; documents are neither shuffled nor collected.
"""

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, texts
from scorewright.llm.texts import chunks, shingles, words

TILE, COVERAGE = 5, 0.6
# Bytes of benchmark text in a block.
BLOCK = 8 << 20


@dataclass
class Items:
    """A block of items: ids, word hashes with offsets, and the seeds in ascending order with item and place."""

    ids: list
    hashes: np.ndarray
    offsets: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    mask: np.ndarray
    #: Items of fewer words than a seed, by their number of words: hashes in ascending order, and items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


_MASK = np.uint64((1 << 20) - 1)


def index(ids: list, passages: list, tile: int) -> Items:
    """Items of fewer than ``tile`` words have no seed and are looked for whole; items without words take no part."""
    found = [(words(c).hashes(), words(c).offsets) for c in chunks(pa.array(passages, pa.string()), 1 << 62)]
    hashes, offsets = found[0] if found else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    seeds, begin = shingles(hashes, offsets, tile, short=False)
    item = np.repeat(np.arange(len(ids)), np.diff(begin))
    place = np.arange(len(seeds)) - begin[item]
    order = np.argsort(seeds, kind="stable")
    mask = np.zeros(int(_MASK) + 1, bool)
    mask[(seeds & _MASK).astype(np.int64)] = True
    short, many = {}, np.diff(offsets)
    for n in range(1, tile):
        which = np.flatnonzero(many == n)
        if len(which):
            whole, at = shingles(hashes, offsets, n, short=False)
            whole = whole[at[which]]
            order_n = np.argsort(whole, kind="stable")
            short[n] = whole[order_n], which[order_n]
    return Items(ids, hashes, offsets, seeds[order], item[order], place[order], mask, short)


def greedy_tiles(seeds: np.ndarray, document_words: int, item_words: int, tile: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, words), the longest first; ties go to the earlier place in the
    item, then in the document.

    :param seeds: all places (item, document) from which ``tile`` words are equal, two columns
    """
    order = np.lexsort((seeds[:, 0], seeds[:, 1] - seeds[:, 0]))
    at, on = seeds[order, 0], seeds[order, 1]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (np.diff(on) != 1)
    begin = np.flatnonzero(fresh)
    run = np.diff(np.append(begin, len(at))) + tile - 1
    queue = [(-int(n), int(i), int(d)) for n, i, d in zip(run, at[begin], on[begin])]
    heapq.heapify(queue)
    in_item, in_document = np.zeros(item_words, bool), np.zeros(document_words, bool)
    found = []
    while queue:
        n, i, d = heapq.heappop(queue)
        n = -n
        free = ~(in_item[i : i + n] | in_document[d : d + n])
        if free.all():
            in_item[i : i + n] = in_document[d : d + n] = True
            found.append((i, d, n))
            continue
        # What is left of a match that a longer one has partly marked.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= tile:
                heapq.heappush(queue, (-int(b - a), int(i + a), int(d + a)))
    return found


def leaks(column: pa.Array, items: Items, tile: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item's number, tiles, words covered, words of the item) of every item that a text of the column holds."""
    for chunk in chunks(column):
        found = words(chunk)
        hashes = found.hashes()
        for n, (whole, which) in items.short.items():
            runs, begin = shingles(hashes, found.offsets, n, short=False)
            low, high = np.searchsorted(whole, runs, "left"), np.searchsorted(whole, runs, "right")
            hit = np.flatnonzero(high > low)
            row = np.searchsorted(begin, hit, "right") - 1
            # A text may hold an item often, and items may be equal.
            for r, a, b in sorted(set(zip(row.tolist(), low[hit].tolist(), high[hit].tolist()))):
                yield from ((chunk.first + r, int(which[i]), 1, n, n) for i in range(a, b))
        seeds, begin = shingles(hashes, found.offsets, tile, short=False)
        hit = np.flatnonzero(items.mask[(seeds & _MASK).astype(np.int64)])
        low, high = np.searchsorted(items.seeds, seeds[hit], "left"), np.searchsorted(items.seeds, seeds[hit], "right")
        hit, low, many = hit[high > low], low[high > low], (high - low)[high > low]
        if not len(hit):
            continue
        row = np.searchsorted(begin, hit, "right") - 1
        place = np.repeat(hit - begin[row], many)
        row = np.repeat(row, many)
        which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, at = items.item[which], items.place[which]
        order = np.lexsort((place, at, item, row))
        row, item, at, place = row[order], item[order], at[order], place[order]
        cuts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        for a, b in zip(cuts, [*cuts[1:], len(row)]):
            r, k = int(row[a]), int(item[a])
            size = int(items.offsets[k + 1] - items.offsets[k])
            # Tiles cover no more than the seeds do.
            reach = np.zeros(size + 1, np.int64)
            own = np.unique(at[a:b])
            np.add.at(reach, own, 1)
            np.add.at(reach, own + tile, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < coverage * size:
                continue
            found_tiles = greedy_tiles(np.stack([at[a:b], place[a:b]], 1), int(found.offsets[r + 1] - found.offsets[r]), size, tile)
            total = sum(n for _, _, n in found_tiles)
            if total >= coverage * size:
                yield chunk.first + r, k, len(found_tiles), total, size


def blocks(benchmark: DataFrame, tile: int, item: str, text: str, size: int) -> Iterator[Items]:
    """The items in blocks of about ``size`` bytes, by a hash of theirs; null texts and keys take no part."""
    rows = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // size + 1
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).distinct().orderBy("item_id", "text").collect()
        if part:
            yield index([r["item_id"] for r in part], [r["text"] for r in part], tile)


_LEAK = "doc_id long, item_id long, n_tiles int, n_covered int, n_words int, coverage double"


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_words, coverage) of every document and item that it holds.

    Words are runs of letters, digits and characters beyond ASCII, in lower case (A-Z only). ``coverage`` is the share
    of the item's words in tiles of at least ``tile`` words; rows have at least the share asked for. An item of fewer
    words than a tile counts where all its words stand in a row, as one tile; one without words takes no part. Null or
    empty texts hold nothing, texts of any length are gone through whole, in chunks that end where texts end; rows with a null key are reported with it.
    Repeated documents are each reported, repeated items once. Without items or documents there are no rows.
    """
    found = None
    for items in blocks(benchmark, tile, item, text, block):

        def run(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                hits = list(leaks(rows.column(1), items, tile, coverage))
                if hits:
                    row, k, many, covered, size = (list(c) for c in zip(*hits))
                    ids = rows.column(0).take(pa.array(row, pa.int64()))
                    share = np.array(covered) / np.array(size)
                    yield batch(_LEAK, ids, pa.array([items.ids[i] for i in k], pa.int64()), *(pa.array(c, pa.int32()) for c in (many, covered, size)), share)

        part = texts(docs, key, text).mapInArrow(run, _LEAK)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _LEAK)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE, text: str = "text", item: str = "item_id", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    place = docs.columns.index(text)
    for items in blocks(benchmark, tile, item, text, block):

        def run(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                keep = np.ones(rows.num_rows, bool)
                keep[[row for row, *_ in leaks(rows.column(place), items, tile, coverage)]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
