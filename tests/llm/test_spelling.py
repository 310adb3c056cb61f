"""Spelling variants against all pairs of words, and odd inputs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import DOCS, LOWER, ODD
from scorewright.llm.spelling import near_words, spelling_variants, vocabulary


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, typos_every=None, least_length=7, least_count=2):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos_every and h % typos_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def brute_force(words, share=10):
    near = {a: [b for b in words if distance_one(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= share * words[a] else None
    out = []
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return sorted(out)


def variants(spark, words, **options):
    frame = spelling_variants(spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3), **options)
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(row) for row in frame.collect())


def random_words(seed, letters="abcé", size=400):
    r = random.Random(seed)
    found = {}
    while len(found) < size:
        word = "".join(r.choice(letters) for _ in range(r.randint(7, 10)))
        for _ in range(4):
            at = r.randrange(len(word) + 1)
            edited = r.choice([word[:at] + r.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + r.choice(letters) + word[at + 1 :]])
            if len(edited) >= 7:
                found[edited] = r.choice([2, 3, 20, 30, 300, 4000])
        found[word] = r.choice([2, 30, 300, 4000, 50000])
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    words = random_words(seed)
    expected = brute_force(words)
    assert any(row[2] not in (row[0], row[1]) for row in expected)  # some roots are two forms away
    assert variants(spark, words) == expected


def test_hot_keys_take_more_steps(spark):
    """A third of the words share all but two letters; every step but the last is too coarse for them."""
    words = {f"zusammen{a}{b}": 2 + (ord(a) * 7 + ord(b)) % 40 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    words |= random_words(3, size=100)
    assert variants(spark, words, together=4) == variants(spark, words) == brute_force(words)


def test_pairs_once(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaab", "aaaaaaab", "aaaaaaa b"]
    pairs = near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    wanted = {frozenset((a, b)) for a in words for b in words if distance_one(a, b)}
    assert {frozenset((r.a, r.b)) for r in pairs} == wanted and len(pairs) == len(wanted)


def test_words_and_typos(spark):
    rows = ODD + [(i, f"Übung Straße ÉLÉPHANT éléphant elephants-ELEPHANTS wörterbuch×buch naïveté {i}") for i in range(20, 90)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(0)})
    for every in (None, 3, 31):
        got = {r.word: r.n for r in vocabulary(docs, typos_every=every).collect()}
        assert got == counted(rows, every)
    assert "ÉlÉphant" in counted(rows) and "elephants" in counted(rows)


def test_very_long_text(spark):
    text = " ".join(f"Donaudampfschiff{'abcdefghij'[i % 10]}{'klm' * (i % 3)}" for i in range(80_000))
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame([(1, text), (2, "x" * 2_000_000)], DOCS)).collect()}
    assert len(text) > 1 << 20 and got == counted([(1, text)])


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "kurz und klein")], [(1, "allein allerdings")]):
        assert spelling_variants(vocabulary(spark.createDataFrame(rows, DOCS))).collect() == []
    assert variants(spark, {"allerdings": 5}) == [("allerdings", None, "allerdings", 5, 0, None)]
