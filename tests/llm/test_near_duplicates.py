"""Jaccard join, repeated strings, passages, components."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import DOCS, ODD, jaccard_components, shingle_set, without_repeats
from scorewright.llm import jaccard_join as jaccard
from scorewright.llm import passage_dedup as passages
from scorewright.llm import suffix_dedup as suffix
from scorewright.llm.components import components
from scorewright.llm.jaccard_join import jaccard_join, links_of
from scorewright.llm.passage_dedup import compact_windows, interval_join, joined_ties, meetings, passage_dedup, start_windows, verified
from scorewright.llm.texts import NOT_SPACE, chunks, mix, shingles
from scorewright.llm.texts import words as word_runs
from scorewright.llm.suffix_dedup import minimizer_segments, suffix_dedup


def families(seed, count=60):
    """Texts in families of edited copies, some with a passage that all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for _ in range(count // 6):
            copy = list(text)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if base % 2:
                copy = passage + copy
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n, share, tile", [(4, 85, 1 << 20), (5, 80, 300), (2, 60, 50)])
def test_jaccard_join(spark, n, share, tile):
    rows = ODD + families(n)
    found = jaccard_join(spark.createDataFrame(rows, DOCS), n, share, 100, tile=tile).collect()
    assert len(found) == len(rows)
    expected, links = jaccard_components(rows, n, share, 100)
    for row in found:
        if row.doc_id is None:
            assert (row.component_id, row.n_links) == (None, 0)
        else:
            assert (row.n_shingles, row.component_id) == expected[row.doc_id], row
            if row.doc_id != 9:
                assert row.n_links == links[row.doc_id], row
    assert {r.n_links for r in found if r.doc_id == 9} == {1}


def test_jaccard_join_empty_and_clashing(spark):
    assert jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y")], DOCS + ", component_id long, token string")
    assert [tuple(r) for r in jaccard_join(clash).orderBy("doc_id").collect()] == [(1, 2, 1, 1), (2, 2, 1, 1)]


def test_shingles_of_frequent_words_make_no_regions(spark, monkeypatch):
    rng = random.Random(5)
    frequent = [f"w{i}" for i in range(4)]
    texts = [[rng.choice(frequent) if rng.random() < 0.8 else f"r{rng.randrange(10**9)}" for _ in range(100)] for _ in range(300)]
    texts += [[*text[:50], "other", *text[51:]] for text in texts[:20]]
    rows = [(i, " ".join(text)) for i, text in enumerate(texts)]
    monkeypatch.setattr(jaccard, "COMMON", 20)
    regions = []

    def seen(edges):
        found = components(edges)
        regions.append(found.groupBy("component").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(jaccard, "components", seen)
    found = jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    expected, links = jaccard_components(rows, 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == {i: (*expected[i], links[i]) for i, _ in rows}
    assert regions[0] <= 40


def test_order_of_shingles_goes_by_their_words():
    text = "a a a a b a a a"
    chunk = next(chunks(pa.array(["", text, "a", None, text])))
    found = word_runs(chunk, NOT_SPACE)
    hashes = found.hashes()
    values, offsets = shingles(hashes, found.offsets, 3)
    frequent = np.unique(hashes[:1])
    place = jaccard.places(values, offsets, hashes, found.offsets, 3, np.zeros(0, np.uint64), frequent, np.array([7]))
    assert place.tolist() == [21, 21, 14, 14, 14, 21, 7, 21, 21, 14, 14, 14, 21]
    late = jaccard.places(values, offsets, hashes, found.offsets, 3, values[2:3], frequent, np.array([7]))
    assert (late[[2, 9]] == np.iinfo(np.int64).max).all() and (np.delete(late, [2, 9]) == np.delete(place, [2, 9])).all()
    ordered, bounds = jaccard.ordered_by_row(values, offsets, place)
    assert np.diff(bounds).tolist() == [0, 4, 1, 0, 4]
    assert set(ordered[:3].tolist()) == set(values[2:5].tolist()) and ordered[3] == values[0]


def test_links_of_a_region_by_pairs():
    rng = random.Random(1)
    base = [rng.getrandbits(60) for _ in range(60)]
    sets = [np.array(sorted({*rng.sample(base, rng.randrange(30, 60)), rng.getrandbits(60)}), np.uint64) for _ in range(40)]
    weight = np.array([rng.randrange(1, 4) for _ in sets])
    for home in (np.zeros(40, int), np.array([i % 2 for i in range(40)])):
        _, links = links_of(sets, home, weight, 70, 100, bool(home.any()))
        for i, s in enumerate(sets):
            expected = 0
            for j, t in enumerate(sets):
                shared = len(np.intersect1d(s, t))
                if i != j and 100 * shared >= 70 * (len(s) + len(t) - shared) and (not home.any() or home[i] != home[j]):
                    expected += weight[j]
            assert links[i] == expected


def test_links_of_small_windows_take_little_memory():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(20)]
    sets += [s[1:] for s in sets]
    tracemalloc.start()
    root, links = links_of(sets, np.zeros(40, int), np.ones(40, int), 85, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 1).all() and (root == np.arange(40) % 20).all()
    assert peak < 1 << 21


def test_links_of_large_groups_take_little_memory():
    rng = np.random.default_rng(16)
    base, sets = rng.integers(0, 1 << 60, 40).astype(np.uint64), []
    for _ in range(2000):
        # Near copies; few of them are near enough to link.
        copy = base.copy()
        copy[rng.permutation(40)[:4]] = rng.integers(0, 1 << 60, 4).astype(np.uint64)
        sets.append(np.unique(copy))
    tracemalloc.start()
    root, links = links_of(sets, np.zeros(2000, int), np.ones(2000, int), 85, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = rng.integers(0, 2000, (2000, 2))
    assert all(root[i] == root[j] for i, j in some if 100 * len(shared := np.intersect1d(sets[i], sets[j])) >= 85 * (80 - len(shared)))
    assert links.sum() % 2 == 0 and peak < 80 << 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in (100, 200, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(20, 120))) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefg ü") for _ in range(40)) for _ in range(4)]
        rows.append((i + 20, "".join(parts)))
    return rows + [(80, "ab" * 100), (81, "x" * 90), (82, rows[0][1]), (83, rows[0][1])]


@pytest.mark.parametrize("length, together", [(30, 512), (30, 2), (12, 3), (200, 512)])
def test_suffix_dedup(spark, monkeypatch, length, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rows = ODD + repeats(length)
    found = sorted(map(tuple, suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), length).collect()), key=repr)
    expected = [(i, *got[:4]) for (i, _), got in zip(rows, without_repeats([t for _, t in rows], length))]
    assert found == sorted(expected, key=repr)


def test_texts_without_repeats(spark):
    rows = [(i, t, "x", i) for i, t in ODD + repeats(5)]
    # One key with several texts is several rows.
    rows += [(77, rows[-1][1], "y", 1), (77, "of the same key", "z", 2)]
    docs = spark.createDataFrame(rows, DOCS + ", kept string, u long")
    for name in ("_u", "row", "of", "z", "n"):
        clashing = docs.withColumnRenamed("kept", name)
        assert suffix.without_repeats(clashing, 30).columns == clashing.columns
    found = suffix.without_repeats(docs, 30)
    assert found.columns == docs.columns
    expected = [got[4].decode("utf-8", "ignore") for got in without_repeats([t for _, t, *_ in rows], 30)]
    wanted = [(i, t if t is None else e, k, u) for (i, t, k, u), e in zip(rows, expected)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert suffix.without_repeats(docs.limit(0), 30).count() == suffix_dedup(docs.limit(0), 30).count() == 0


def test_equal_windows_have_equal_minimizers():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 101) for _ in range(80))
    data = b"".join(bytes(rng.randrange(97, 101) for _ in range(50)) + shared for _ in range(3))
    start, count, place, _ = minimizer_segments(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 20, 5)
    at = np.repeat(place - start, count) - np.concatenate([np.arange(c) for c in count])
    seen = {}
    for p, offset in zip(range(len(data) - 19), at.tolist()):
        assert seen.setdefault(data[p : p + 20], offset) == offset


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 40, 200).astype(np.uint64) << np.uint64(33)
    offsets = np.array([0, 60, 60, 75, 200])
    center, left, right = compact_windows(values, offsets, 8)
    expected = set()
    for a, b in zip(offsets[:-1], offsets[1:]):
        for c in range(a, b):
            low, high = c, c
            while low > a and values[low - 1] > values[c]:
                low -= 1
            while high + 1 < b and values[high + 1] >= values[c]:
                high += 1
            if high - low + 1 >= 8:
                expected.add((c, low, high))
    assert set(zip(center.tolist(), left.tolist(), right.tolist())) == expected


def test_joined_ties():
    tokens = np.array([5, 1, 5, 1, 7, 1, 0, 1, 1], np.uint64)
    center, left, right = np.array([1, 3, 5, 7, 8]), np.array([0, 2, 4, 7, 8]), np.array([5, 5, 5, 8, 8])
    joined = joined_ties(tokens, np.array([0, 9]), center, left, right, 3)
    assert [x.tolist() for x in joined] == [[1, 5, 7], [3, 5, 8], [0, 4, 7], [5, 5, 8]]


@pytest.mark.parametrize("kinds, length", [(2, 8), (5, 1), (30, 8), (30, 46), (10**6, 46), (10**6, 2)])
def test_windows_of_starts_by_sliding_minima(kinds, length):
    rng = np.random.default_rng(kinds + length)
    offsets = np.concatenate([[0], np.cumsum([200, 0, length, length - 1, 130, 1])])
    tokens = rng.integers(0, kinds, offsets[-1]).astype(np.uint64)
    starts = [p for a, b in zip(offsets[:-1], offsets[1:]) for p in range(a, b - length + 1)]
    made, wanted = [start_windows(tokens, offsets, length, f) for f in range(3)], []
    for f, (least, first, last) in enumerate(made):
        values = mix(tokens ^ np.uint64(0xA24BAED4963EE407 * (f + 1) & (2**64 - 1)))
        found = [(p, int(v)) for v, a, b in zip(least, first, last) for p in range(a, b + 1)]
        assert found == [(p, int(values[p : p + length].min())) for p in starts]
        assert (last - first < length).all()
        wanted.append([w for w, (a, b) in enumerate(zip(first, last)) for _ in range(a, b + 1)])
    begin, end, which = interval_join(made)
    found = [(p, *(int(w[i]) for w in which)) for i, (a, b) in enumerate(zip(begin, end)) for p in range(a, b + 1)]
    assert found == list(zip(starts, *wanted))


def best_similarity(own, other, length):
    """Highest similarity of two runs of at least ``length`` tokens; no token stands twice in a text."""
    where, best = {t: i for i, t in enumerate(other)}, 0.0
    at = np.array([where.get(t, -1) for t in own])
    for x in np.flatnonzero(at >= 0):
        place = at[x:]
        low, high = np.minimum.accumulate(np.where(place >= 0, place, len(other))), np.maximum.accumulate(place)
        shared, size = np.cumsum(place >= 0), np.maximum(np.arange(1, len(place) + 1), length)
        best = max(best, float((shared / (size + np.maximum(high - low + 1, length) - shared)).max()))
    return best


def test_recall_of_passages(spark):
    """Documents with a passage that is alike by trying all runs: nine of ten at least are named, in each range of similarity."""
    rng, rows, pairs = random.Random(34), [], []
    make = lambda n: [f"r{rng.randrange(10**12)}" for _ in range(n)]
    for _ in range(700):
        passage = make(rng.choice([50, 54, 58, 62, 66, 90, 140, 200]))
        edited = list(passage)
        for _ in range(rng.randrange(0, 2 + len(passage) // 66)):
            k = rng.randrange(len(edited))
            edited[k : k + 1] = rng.choice([make(1), [], [edited[k], *make(1)]])
        texts = [make(30) + x + make(30) for x in (passage, edited)]
        own, other = ([tuple(x[i : i + 5]) for i in range(len(x) - 4)] for x in texts)
        pairs.append((len(rows), len(rows) + 1, best_similarity(own, other, 46)))
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate(texts)]
    # A passage far behind the first megabyte of a text.
    far = make(60)
    pairs.append((len(rows), len(rows) + 1, 1.0))
    rows += [(len(rows), " ".join(make(120_000) + far + make(9))), (len(rows) + 1, " ".join(far))]
    named = {(r.doc_id, r.other_id) for r in passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert named <= {(a, b) for x, y, share in pairs if share >= 0.8 for a, b in ((x, y), (y, x))}
    assert {pairs[-1][:2], pairs[-1][1::-1]} <= named
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0), (1.0, 1.1)):
        wanted = [pair for x, y, share in pairs if low <= share < high for pair in ((x, y), (y, x))]
        caught = sum(pair in named for pair in wanted)
        print(f"similarity from {low}: {caught} of {len(wanted)}")
        assert len(wanted) >= 50 and caught >= 0.9 * len(wanted)


def test_passages(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(words) for _ in range(60)]
    edited = passage[:30] + ["other"] + passage[31:]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for i in range(30)]
    for i, p in ((3, passage), (11, edited), (12, passage), (20, passage)):
        own = rows[i][1].split()
        rows[i] = (i, " ".join(own[: len(own) // 2] + p + own[len(own) // 2 :]))
    text = dict(rows)
    found = passage_dedup(spark.createDataFrame(ODD[:8] + [(i + 1000, t) for i, t in rows], DOCS).withColumn("v", F.lit(1))).collect()
    assert {r.doc_id for r in found} >= {1003, 1011, 1012, 1020}
    assert {r.doc_id for r in found} <= {1003, 1011, 1012, 1020, 8}
    for r in found:
        if r.doc_id != 8:
            own, other = (text[i - 1000].lower().split()[a : b + 1] for i, a, b in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)))
            x, y = shingle_set(" ".join(own), 5), shingle_set(" ".join(other), 5)
            assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8
            assert len(own) >= 50 and len(other) >= 50
    assert passage_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_behind_hubs(spark):
    rng = random.Random(21)
    make = lambda n: [f"h{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(12):
        passage = make(50)
        # Others have a part of it, too short to be reported, so they share min-hashes in all ways.
        for part in (passage[:44], passage[6:], passage[3:47], passage[:25], passage[25:], passage[10:40], *(passage[i : i + 7] for i in range(0, 44, 4))):
            rows += [(len(rows), " ".join(make(60) + part + make(60))) for _ in range(2)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, " ".join(make(30) + passage + make(30))) for i in range(2)]
    found = {(r.doc_id, r.other_id): r for r in passage_dedup(spark.createDataFrame(rows, DOCS)).where("similarity = 1").collect()}
    for a, b in pairs:
        assert {(a, b), (b, a)} <= set(found)
        assert (found[a, b].start_word, found[a, b].end_word, found[a, b].other_start) == (30, 79, 30)


@pytest.mark.parametrize("tile", [2048, 5])
def test_edited_passages_behind_hubs(spark, tile):
    """Texts with parts of a passage, too short to be reported, agree with two edited copies of it and mostly come first."""
    rng = random.Random(5)
    make = lambda n: [f"e{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(40):
        passage = make(62)
        for _ in range(30):
            k = rng.randrange(23)
            rows.append((len(rows), " ".join(make(9) + passage[k : k + 40] + make(9))))
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + i, " ".join(make(30) + [*passage[:31], word, *passage[31:]] + make(30))) for i, word in enumerate(make(2))]
    found = {(r.doc_id, r.other_id) for r in passage_dedup(spark.createDataFrame(rows, DOCS), tile=tile).collect()}
    caught = sum((a, b) in found for a, b in pairs)
    print(f"{caught} of {len(pairs)}")
    assert caught == 40


def test_meetings_by_brute_force():
    rng = np.random.default_rng(12)
    length, similarity = 8, 0.8
    for _ in range(60):
        base = rng.integers(0, 1 << 24, (3, 12))
        count = int(rng.integers(2, 14))
        size = rng.integers(length, 13, count)
        spans = [np.where(rng.random(n) < 0.06, rng.integers(0, 1 << 24, n), base[rng.integers(3)][:n]) for n in size]
        u, start = np.arange(count) // 2, np.arange(count) * 100
        home = rng.integers(0, 2, count) if rng.random() < 0.5 else None
        later, earlier = meetings(u, start, start + size - 1, np.concatenate(spans), length, similarity, home)
        assert (later > earlier).all() and (home is None or (home[later] != home[earlier]).all())
        whole = [set(s.tolist()) for s in spans]
        share = lambda x, y: len(x & y) / len(x | y)
        # Components by those that meet hold all pairs with runs that are alike, and they are joined by trees.
        part = np.arange(count)
        assert len(later) < count
        for x, y in zip(later, earlier):
            part[part == part[x]] = part[y]
        for i in range(count):
            for j in range(i):
                if home is None or home[i] != home[j]:
                    runs = ([set(s[k : m].tolist()) for k in range(len(s)) for m in range(k + length, len(s) + 1)] for s in (spans[i], spans[j]))
                    own, other = runs
                    if any(share(a, b) >= similarity for a in own for b in other):
                        assert part[i] == part[j]


def test_groups_meet_as_each_alone():
    rng = np.random.default_rng(14)
    group, u, start, spans, alone, before = [], [], [], [], [], 0
    for g in range(40):
        base = rng.integers(0, 1 << 24, (3, 14))
        count = int(rng.integers(2, 30))
        # Some tokens stand again.
        own = [base[rng.integers(3)][rng.integers(0, 14, n) if rng.random() < 0.2 else np.arange(n)] for n in rng.integers(8, 14, count)]
        own = [np.where(rng.random(len(s)) < 0.06, rng.integers(0, 1 << 24, len(s)), s) for s in own]
        its_u, its_start = np.arange(count) // 2, np.arange(count) * 5
        later, earlier = meetings(its_u, its_start, its_start + [len(s) - 1 for s in own], np.concatenate(own), 8, 0.8)
        alone += zip(later + before, earlier + before)
        group, u, start, spans, before = group + [g] * count, u + its_u.tolist(), start + its_start.tolist(), spans + own, before + count
    start = np.array(start)
    met = meetings(np.array(u), start, start + [len(s) - 1 for s in spans], np.concatenate(spans), 8, 0.8, group=np.array(group))
    assert sorted(zip(*met)) == sorted(alone) and len(alone) > 50


def test_common_part_is_not_tried_pair_by_pair(monkeypatch):
    """Cells that share a part too short for a passage, with words that stand again elsewhere, are ruled out together."""
    rng, tried = np.random.default_rng(15), []
    monkeypatch.setattr(passages, "verified", lambda *args: tried.append(1) or verified(*args))
    part, count, length = rng.integers(0, 1 << 24, 36), 60, 46
    spans = [np.concatenate([np.repeat(rng.integers(0, 1 << 24, 8), 3), rng.integers(0, 1 << 24, 12), part]) for _ in range(count)]
    start = np.zeros(count, np.int64)
    later, _ = meetings(np.arange(count), start, start + len(spans[0]) - 1, np.concatenate(spans), length, 0.8)
    alike = any(verified(spans[0].astype(np.uint64), s.astype(np.uint64), length, 0.8) for s in spans[1:])
    assert len(later) == (count - 1 if alike else 0) and not alike
    assert len(tried) == 0


def test_verified_splits_at_gaps():
    own = np.arange(100, dtype=np.uint64)
    other = np.concatenate([np.arange(30), np.arange(500, 560), np.arange(60, 100)]).astype(np.uint64)
    found = verified(own, other, 20, 0.8)
    assert sorted((a, b) for a, b, *_ in found) == [(0, 29), (60, 99)]


def test_verified_finds_a_passage_over_the_widest_gap():
    # 30 shared, 6 changed, 30 shared; on both sides 7 of 12 shared.
    side = [i % 12 < 7 for i in range(96)]
    kept = side + [True] * 30 + [False] * 6 + [True] * 30 + side[::-1]
    own = np.arange(len(kept), dtype=np.uint64)
    found = verified(own, np.where(kept, own, own + np.uint64(1000)), 46, 0.8)
    assert any(a <= 96 and b >= 161 for a, b, *_ in found) and all(s >= 0.8 for *_, s in found)


def test_verified_by_brute_force():
    rng, length, hits = np.random.default_rng(13), 12, 0
    for _ in range(150):
        base = rng.integers(0, 2000, 60)
        edits = rng.random(60)
        rate = np.repeat(rng.choice([0.02, 0.1, 0.4], 4), 15)
        other = np.concatenate([[x] if e > r else [5000 + int(x)] if e > r / 2 else [] if e > r / 4 else [x, 9000 + int(x)] for x, e, r in zip(base, edits, rate)])
        own, other = base.astype(np.uint64), other.astype(np.uint64)
        good = set()
        for x in range(len(own) - length + 1):
            for y in range(x + length, min(x + 2 * length, len(own)) + 1):
                mine = set(own[x:y].tolist())
                where = [k for k, t in enumerate(other.tolist()) if t in mine]
                z, w = (where[0], where[-1] + 1) if where else (0, 0)
                its = set(other[z:w].tolist())
                if w - z >= length and len(mine & its) >= 0.8 * len(mine | its):
                    good.add((x, y))
        found = verified(own, other, length, 0.8)
        for a, b, c, d, share in found:
            mine, its = set(own[a : b + 1].tolist()), set(other[c : d + 1].tolist())
            assert share == pytest.approx(len(mine & its) / len(mine | its)) and share >= 0.8 and min(b - a, d - c) >= length - 1
        # All that is alike is reported, or has a part in what is.
        assert all(any(a < y and x <= b for a, b, *_ in found) for x, y in good)
        hits += len(good) > 0
    assert hits > 50


def test_memory_of_segments():
    memory = suffix.Memory(bits=4)
    low, high = np.uint64(5), np.uint64(1 << 63)
    assert [x.tolist() for x in memory.met(np.array([low, high]), np.array([1, 2]))] == [[False, False], [False, False]]
    assert [x.tolist() for x in memory.met(np.array([low, high]), np.array([1, 1]))] == [[True, False], [False, True]]
    # Another hash of the same first bits takes the place; the old one is new again.
    assert [x.tolist() for x in memory.met(np.array([low, low + np.uint64(1)]), np.array([1, 1]))] == [[False, False], [True, False]]
    assert [x.tolist() for x in memory.met(np.array([low]), np.array([1]))] == [[False], [False]]


def test_forgotten_segments_are_told_anew(monkeypatch):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    texts = [letters[rng.integers(0, 27, 2_000)].tobytes().decode() for _ in range(30)]
    texts = [text + str(i) for i in range(4) for text in texts]
    rows = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(range(120), pa.int64()), pa.array(texts)], ["u", "k", "text"])
    monkeypatch.setattr(suffix, "chunks", lambda column: chunks(column, 1 << 12))
    found = {}
    for bits in (suffix.REMEMBERED, 4):
        monkeypatch.setattr(suffix.Memory.__init__, "__defaults__", (bits,))
        told = {}
        for row in pa.Table.from_batches(suffix._segments(200, 32)([rows])).to_pylist():
            if row["seen"] < 2:
                told.setdefault(row["m"], []).append(row["seen"])
        found[bits] = told
    # One remembered segment is told twice, the second time as known; a forgotten one is told again and again.
    assert set(found[4]) == set(found[suffix.REMEMBERED])
    assert sum(map(len, found[4].values())) > sum(map(len, found[suffix.REMEMBERED].values()))
    assert all(len(seen) > 1 for m, seen in found[4].items() if len(found[suffix.REMEMBERED][m]) > 1)


def test_segments_of_one_minimizer_stay_together_as_long_as_they_are_sorted_at_once():
    # A window is a row of its own only in groups beyond what a task sorts at a time.
    assert suffix.TOGETHER * (200 + 85) >= suffix.SORTED
