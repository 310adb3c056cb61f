"""License scan, decontamination, search, HTML text, mixing, quality and language."""

import random
import re
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import DOCS, LOWER, ODD, greedy_tiling
from scorewright.llm import html_text as html
from scorewright.llm import language_id as languages
from scorewright.llm import quality_crf as crf
from scorewright.llm.decontaminate import contaminated, greedy_tiles, uncontaminated
from scorewright.llm.license_scan import BASE, TEMPLATES, Automaton, license_scan, tokens
from scorewright.llm import queries
from scorewright.llm.mixing import memberships, mix
from scorewright.llm.topk import top_k


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# --- licenses ---


def test_license_scan(spark):
    mit = re.sub(r"<<opt>>.*?<<end>>|<<var:\d+\||>>", " ", TEMPLATES["mit"][1])
    rows = ODD + [
        (20, "Released under the MIT License. See the apache-license, and the MIT License"),
        (21, "x GNU\nGeneral Public License, version 3."),
        (22, "Licensed under CC BY-NC 4.0."),
        (23, "prefix " + mit + " suffix"),
        (24, "prefix " + mit.replace("sublicense", "sell") + " suffix"),
        (25, "Licensed under the Apache License, Version 2.0."),
        (26, "Permission is hereby granted"),
    ]
    found = license_scan(spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit("x"))).collect()
    assert len(found) == len(rows)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in found:
        own = words(text[r.doc_id])
        places = sorted((i, label) for phrase, label in BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
    got = {r.doc_id: (r.labels, r.score) for r in found}
    assert got[20] == ("apache,mit", 1.0) and got[21] == ("gpl,gpl-3.0", 1.0) and got[22] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert got[23] == ("mit", 1.0) and got[24] == ("", 0.0) and got[25] == ("apache,apache-2.0", 1.0) and got[26] == ("", 0.0)
    assert license_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_automaton_by_all_wordings():
    automaton = Automaton()
    automaton.add("a b <<opt>>c <<opt>>d<<end>><<end>> <<var:2|x>> e", "t", False)
    accepted = set()
    for middle in ([], ["c"], ["c", "d"]):
        for n in (1, 2):
            accepted |= {("a", "b", *middle, *any_, "e") for any_ in product("abcde", repeat=n)}
    for n in range(3, 8):
        for rest in product("abcde", repeat=n - 2):
            text = ("a", "b", *rest)
            ends = {end for _, _, end in automaton.matches(text.__getitem__, 0, n)}
            longest = max((k for k in range(1, n + 1) if text[:k] in accepted), default=None)
            assert ends == ({longest} if longest else set())
    with pytest.raises(ValueError):
        Automaton().add("one <<opt>>two<<end>>", "t", False)
    assert tokens("CC BY-NC 4.0, É") == ["cc", "by", "nc", "4", "0", "É"]


# --- decontamination ---


def test_greedy_tiles_by_longest_match():
    rng = random.Random(2)
    for tile in (2, 3):
        for _ in range(150):
            document = [rng.randrange(4) for _ in range(rng.randrange(2, 25))]
            item = [rng.randrange(4) for _ in range(rng.randrange(2, 12))]
            seeds = [(i, d) for i in range(len(item) - tile + 1) for d in range(len(document) - tile + 1) if item[i : i + tile] == document[d : d + tile]]
            got = greedy_tiles(np.array(seeds).reshape(-1, 2), len(document), len(item), tile) if seeds else []
            assert got == greedy_tiling(document, item, tile)


def test_decontamination(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    items = [(1, make(30)), (2, make(20)), (3, "a b"), (4, None), (5, ""), (2, None), (None, "x y z a b c")]
    one, two = items[0][1].split(), items[1][1].split()
    rows = ODD + [
        (20, make(50) + " " + " ".join(one) + " " + make(9)),
        (21, make(5) + " " + " ".join(one[15:]) + " filler here " + " ".join(one[:15])),
        (22, " ".join(one[:12]) + " " + make(40)),
        (23, ", ".join(two).upper()),
        (24, make(80)),
        # A short item has to stand there whole, as words, however often.
        (25, "A, b? " * 3),
        (26, make(9) + " a b"),
        (27, "a x b ab b a"),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 60):
        found = {(r.doc_id, r.item_id): (r.n_tiles, r.n_covered, r.n_words) for r in contaminated(docs, bench, block=block).collect()}
        assert found == {(20, 1): (1, 30, 30), (21, 1): (2, 30, 30), (23, 2): (1, 20, 20), (25, 3): (1, 2, 2), (26, 3): (1, 2, 2)}
        kept = uncontaminated(docs, bench, block=block)
        assert kept.columns == docs.columns
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id is null or doc_id not in (20, 21, 23, 25, 26)").collect()))
    assert contaminated(docs, bench.limit(0)).count() == contaminated(docs.limit(0), bench).count() == 0
    assert uncontaminated(docs, bench.limit(0)).count() == len(rows)


def test_short_items_by_search(spark):
    """Items of one to four words against a search for their words in a row; beside a text of more than a chunk."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))) for i in range(150)] + [(500, "w " * 700_000 + "d c b a")]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(1 + i % 4))) for i in range(30)]
    found = contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    wanted = {(d, i) for d, t in rows for i, s in items if f" {s} " in f" {t} "}
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted) and any(d == 500 for d, _ in got)


# --- search ---


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 7]) for i in range(400)]
    vectors += [(401, None), (450, [1.0, None]), (500, [float("nan")]), (550, [float("inf"), 1.0]), (600, [0.5]), (650, []), (None, [1.0]), (700, [0.1] * 9), (3, [0.3] * 6), (100, vectors[100][1])]
    found = top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), 5, 50, block=block)
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for q, own in dict(sorted(((i, v) for i, v in usable if i % 50 == 0), reverse=True)).items():
        ranked = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q)[:5]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in found.collect()} == expected
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert top_k(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p><article>no</article>";</script></head><body>
<nav><ul><li><a href="/">Menu</a></ul></nav><!-- <article>ad</article> --><div class="ad">Buy</div><div class="top">Always here</div>
<article><header><h1>Head {n}</h1></header><p>One &amp; <b>two<br>three<p>fo\n\n ur</p><form>Search</form><div class="comments">Nice</div></article>
<div id="x">Slot {n}</div><aside>Side</aside><footer>&copy; F</footer></body></html>"""


def test_extract_page():
    assert html.extract(PAGE.format(n=1), set()) == "Head 1\nOne & two\nthree\nfo ur"
    assert html.extract("", set()) == "" == html.extract("<p>", set())
    assert html.extract("plain &lt;text&gt;<td a='>'>cell", set()) == "plain <text>\ncell"
    assert html.extract("<div>" * 5000 + "deep", set()) == "deep"


def test_html_text(spark):
    rows = [(i, f"https://A.example/{i}", PAGE.format(n=i)) for i in range(5)]
    bare = re.sub(r"</?article>", "", PAGE)
    rows += [(i, f"https://b.example/{i}?q", bare.format(n=i)) for i in range(10, 15)]
    rows += [(20, None, None), (21, "c", ""), (None, "https://a.example", PAGE.format(n=9)), (22, "https://b.example", bare.format(n=22)), (22, "https://b.example", bare.format(n=22))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))
    found = html.html_text(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_chars == len(r.text)
        if r.page_id in (20, 21):
            assert r.text == ""
        elif r.url.startswith("https://b"):
            # Without an article, headers and what is the same on all pages of the host go.
            assert r.text == f"Slot {r.page_id}"
        else:
            n = 9 if r.page_id is None else r.page_id
            assert r.text == f"Head {n}\nOne & two\nthree\nfo ur"
    assert html.html_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [None, "", "<p>", "<body><div class='x'>Not found"])
def test_no_single_page_decides_a_template(spark, odd):
    body = "<body><div class='top'>Home and more</div><div class='text'><p>Story {n}<p>More {n}</div><div class='end'>Call us</div>"
    rows = [(i, f"https://a.example/{i}", body.format(n=i)) for i in range(20)] + [(20, "https://a.example/20", odd)]
    found = {r.page_id: r.text for r in html.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i}\nMore {i}" for i in range(20))


def test_template_decides_about_articles(spark):
    card = "<body><article><h3>Teaser {n}</h3></article><div class='text'><p>Story {n} that is told at length<p>More of {n} and its end</div>"
    notice = "<body><article><h1>Head {n}</h1><div class='x1'><p>Get our letter</div><div class='body'><p>Story {n}</div><p>Plain</article>"
    rows = [(i, f"https://a.example/{i}", card.format(n=i)) for i in range(5)] + [(i, f"https://b.example/{i}", notice.format(n=i)) for i in range(10, 15)]
    # Copies of one page tell nothing about its article.
    rows += [(i, f"https://c.example/{i}", notice.format(n=1)) for i in range(20, 25)] + [(30, "https://d.example", card.format(n=1))]
    found = {r.page_id: r.text for r in html.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i} that is told at length\nMore of {i} and its end" for i in range(5))
    assert all(found[i] == f"Head {i}\nStory {i}\nPlain" for i in range(10, 15))
    assert all(found[i].startswith("Head 1\n") and found[i].endswith("Plain") for i in range(20, 25)) and found[30] == "Teaser 1"


def test_align_keeps_order():
    a = html.slot_tree(html.blocks(html.parse("<div><p>a<p>b<p>c</div><ul><li>x</ul>")))
    b = html.slot_tree(html.blocks(html.parse("<div><p>a<p>c</div><h2>n</h2><ul><li>y<li>x</ul>")))
    pairs = html.align(a, b)
    assert len(pairs) == 3 and sorted(pairs) == sorted(pairs, key=lambda p: p[1])


def largest_matching(a, b):
    """Elements on the largest matching, by trying every choice for the first children."""

    def rows(x, y):
        if not x or not y:
            return 0
        both = largest_matching(x[0], y[0])
        return max(rows(x[1:], y), rows(x, y[1:]), both + rows(x[1:], y[1:]) if both else 0)

    return 1 + rows(a[1], b[1]) if a[0] == b[0] else 0


def random_tree(rng, depth, number):
    children = [random_tree(rng, depth - 1, number) for _ in range(rng.randrange(0, 5))] if depth else []
    if not children:
        number[0] += 1
        return ["#", [], number[0] - 1]
    return [rng.choice("ab"), children, -1]


@pytest.mark.parametrize("kept", [1 << 22, 2])
def test_alignment_by_all_matchings(monkeypatch, kept):
    """Size of the matching, also where the matrix is halved; slots pair in order and below matched elements."""
    monkeypatch.setattr(html, "_KEPT_CELLS", kept)
    rng = random.Random(21)
    for _ in range(400):
        a, b = (["", [random_tree(rng, 2, n) for _ in range(rng.randrange(0, 4))], -1] for n in ([0], [0]))
        one, two = html._sized(a), html._sized(b)
        assert html._Matching().score(one, two) == largest_matching(a, b)
        pairs = sorted(html.align(a, b))
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert [j for _, j in pairs] == sorted(j for _, j in pairs)

        # The slots of the pairs are those of some largest matching: as many elements are matched by going through them.
        def matched(x, y):
            if x[0] != y[0]:
                return 0
            return x[4] if x[3] == y[3] else 1 + sum(matched(p, q) for p, q in html._Matching().children(x[1], y[1]))

        assert matched(one, two) == largest_matching(a, b)


def test_long_lists_align_in_seconds():
    item = lambda i: f"<li class='k{i % 3}'><a>link</a><span>{i}</span>" + "<p>more" * (i % 4) + "</li>"
    one = html.slot_tree(html.blocks(html.parse("<div><h2>x</h2><ul>" + "".join(item(i) for i in range(5000)) + "</ul></div>")))
    two = html.slot_tree(html.blocks(html.parse("<div><p>y</p><ul>" + "".join(item(i * 7 + 1) for i in range(5000)) + "</ul></div>")))
    start = time.monotonic()
    assert len(html.align(one, two)) > 5000
    assert time.monotonic() - start < 30


@pytest.mark.parametrize("piece", ["<a x", "<a \"", "<a ='", "<!", "<!-", "<?x", "</b", "<b>", "</i>", "<i><div><b>", "<p", "< ", "<a b='\">", "<li><p>", "<div class='x y'>t", "&amp", "<td><i></td>"])
def test_a_megabyte_of_anything_is_parsed_in_seconds(piece):
    text = piece * (1_000_000 // len(piece))
    start = time.monotonic()
    html.blocks(html.parse(text))
    html.parse("<i>" + "<b>" * 100_000 + text[: 1 << 19] + "</u>" * 100_000)
    assert time.monotonic() - start < 30


def test_tags_end_where_they_should():
    read = lambda t: [b.text for b in html.blocks(html.parse(t))]
    assert read("<p title='a > b'>one<p>two") == ["one", "two"]
    assert read('<p title="never closed>one<p>two') == ["one", "two"]
    assert read("1 < 2 and 3 <b>4</b> <") == ["1 < 2 and 3 4 <"]
    assert read("a <!-- <p> --> b <!-- open <p>c") == ["a b"]
    assert read("<div>x<span>y</div>z</span><p>w") == ["x y".replace(" ", ""), "z", "w"]
    deep = lambda n: "<div>" * n + "<p>in</p><div class='other'><p>in</p></div>" + "</div>" * n
    # Beyond the depth that paths keep, places still differ.
    assert len({b.path for b in html.blocks(html.parse(deep(80)))}) == 2


# --- mixing ---


def test_mix_by_numpy(spark):
    rng = random.Random(6)
    kinds = {"good": "sun moon star tree".split(), "bad": "mud dust rot ash".split()}
    rows = [(i, " ".join(rng.choice(kinds["good" if i % 4 else "bad"] + ["the", "of"]) for _ in range(rng.randrange(5, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows + ODD[2:5] + [(None, "sun"), (1, rows[1][1])], DOCS).withColumn("rate", F.lit("x"))
    labels = spark.createDataFrame([(i, "good" if i % 4 else "bad") for i in range(200)] + [(5, "bad"), (6, None), (None, "bad")], "doc_id long, domain string")
    found = mix(docs, labels, {"good": 1.0, "bad": 1.0}).toPandas()
    assert len(found) == len(rows) + 5
    own = found[found.doc_id.notna() & (found.n_tokens > 4)]
    assert ((own.doc_id % 4 != 0) == (own.domain == "good")).mean() > 0.97
    assert found.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows + ODD[2:5] + [(0, "sun"), rows[1]])
    weight = found.n_tokens / found.n_tokens.sum()
    for d in ("good", "bad"):
        assert (weight * found[f"p_{d}"] * found.rate).sum() == pytest.approx(0.5, abs=2e-3)
    assert (found.rate >= 0).all()
    assert mix(docs.limit(0), labels, {"good": 1.0, "bad": 1.0}).count() == 0
    assert mix(docs, labels.limit(0), {"good": 1.0, "bad": 1.0}).where("rate is null").count() == 0


def nearest_rates(p, tokens, wanted, steps=400_000):
    """Rates nearest to 1 that meet the targets, by plain projected gradient steps until nothing moves."""
    weight = tokens / tokens.sum()
    along = np.zeros(len(wanted))
    for _ in range(steps):
        error = (weight[:, None] * p * np.maximum(0, 1 + p @ along)[:, None]).sum(0) - wanted
        if abs(error).max() < 1e-9:
            break
        along -= error
    return np.maximum(0, 1 + p @ along)


def test_mix_of_three_unequal_domains(spark):
    """One domain has to shrink to a sixth and another to nothing much, so that rates at 0 matter."""
    rng = random.Random(16)
    kinds = {"clean": "sun moon star tree".split(), "junk": "mud dust rot ash".split(), "toxic": "hate bile venom scorn".split()}
    named = ["clean" if i % 10 < 5 else "junk" if i % 10 < 8 else "toxic" for i in range(600)]
    rows = [(i, " ".join(rng.choice(kinds[named[i]] * 3 + kinds[rng.choice(list(kinds))] + ["the", "of"]) for _ in range(rng.randrange(1, 30)))) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(enumerate(named))[:300], "doc_id long, domain string")
    wanted = {"clean": 0.93, "junk": 0.05, "toxic": 0.02}
    found = mix(docs, labels, wanted).toPandas()
    p, tokens = found[["p_clean", "p_junk", "p_toxic"]].to_numpy(), found.n_tokens.to_numpy()
    shares = ((tokens / tokens.sum())[:, None] * p * found.rate.to_numpy()[:, None]).sum(0)
    assert np.allclose(shares, [0.93, 0.05, 0.02], atol=1e-5)
    assert (found.rate == 0).any()
    assert np.allclose(found.rate, nearest_rates(p, tokens, np.array([0.93, 0.05, 0.02])), atol=1e-4)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_mix_meets_its_targets(spark, size):
    found = queries.op7_mixing(spark, f"/root/testdata/{size}")
    names = sorted(queries.TARGETS)
    shares = found.selectExpr(*(f"sum(rate * n_tokens * p_{d}) / sum(n_tokens)" for d in names)).first()
    assert max(abs(s - queries.TARGETS[d]) for s, d in zip(shares, names)) < 1e-4


def test_mix_of_targets_out_of_reach(spark):
    """Every posterior is the same, so only the sum can be met: by least squares all have one rate."""
    docs, labels = spark.createDataFrame([(i, "one two three") for i in range(9)], DOCS), spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, domain string")
    found = mix(docs, labels, {"a": 3.0, "b": 1.0}).toPandas()
    assert np.allclose(found.rate, 1.0, atol=1e-3)


def test_words_are_counted_before_they_are_laid_out(spark):
    """Above explode(), counting would go through the whole text once for each of its words."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    model = spark.createDataFrame([(1, 0.5, -0.5)], "bucket int, w0 double, w1 double")
    plan = memberships(docs, model, [0.0, 0.0], "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("array_remove") and plan.count("array_remove") == 1


def test_mix_counts_a_very_long_text(spark):
    """One text of two megabytes among short ones; quadratic work would not end."""
    long = "sun moon " * 230_000
    found = mix(spark.createDataFrame([(1, long), (2, "mud rot"), (3, " \n")], DOCS), spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, domain string"), {"good": 1.0, "bad": 1.0})
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {1: 460_000, 2: 2, 3: 0}


# --- quality ---


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([0, 4, 5, 8])
    score, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    got, expected = crf.marginals(score, transition, lines)
    counts = np.zeros((2, 2))
    for a, b in zip(lines[:-1], lines[1:]):
        total, good = 0.0, np.zeros(b - a)
        pairs = np.zeros((2, 2))
        for states in product((0, 1), repeat=int(b - a)):
            steps = list(zip(states[:-1], states[1:]))
            weight = np.exp(sum(score[a + i] for i, s in enumerate(states) if s) + sum(transition[s] for s in steps))
            total += weight
            good += weight * np.array(states)
            for s in steps:
                pairs[s] += weight
        assert np.allclose(got[a:b], good / total)
        counts += pairs / total
    assert np.allclose(expected, counts)


def test_quality(spark):
    rng = random.Random(3)
    def text(good):
        line = lambda: " ".join(rng.choice(["river", "Stone", "walks", "under", "bridge."]) + ("" if good else "###") for _ in range(8))
        return "\n".join(line() for _ in range(rng.randrange(1, 6)))
    rows = [(i, text(i % 3 > 0)) for i in range(200)]
    docs = spark.createDataFrame(rows + ODD, DOCS).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(2, 0), (7, None), (None, 1)], "doc_id long, quality int")
    field = crf.fit(docs, labels, sample=100)
    found = crf.quality(docs, field).collect()
    assert len(found) == 200 + len(ODD)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r for r in found if r.doc_id is not None and r.held_out and r.doc_id >= 20 and r.predicted != int(r.doc_id % 3 > 0)]
    assert not wrong
    kept = crf.good_documents(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)
    assert crf.quality(docs.limit(0), field).count() == 0
    none = crf.fit(docs, labels.limit(0))
    assert {r.score for r in crf.quality(docs, none).collect()} == {0.5}


def test_line_features_by_line():
    texts = ["Ab c.\n\nX!! ##\n", "", "\n", "one one two\none one two"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    features, length, lines = crf.line_features(data, offsets)
    assert np.diff(lines).tolist() == [len(t.split("\n")) for t in texts]
    assert length.tolist() == [len(x) for t in texts for x in t.split("\n")]
    assert features[0][1] == pytest.approx(1 / 3) and features[-1][11] == 1 and features[-1][10] == pytest.approx(1 / 3)


# --- languages ---


def test_best_path_by_enumeration():
    rng = np.random.default_rng(2)
    score, offsets = rng.normal(size=(9, 3)) * 2, np.array([0, 5, 5, 9])
    path = languages.best_path(score.astype(np.float32), offsets, 1.5)
    for a, b in zip(offsets[:-1], offsets[1:]):
        value = lambda p: sum(score[a + i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p[:-1], p[1:]))
        best = max((value(p) for p in product(range(3), repeat=int(b - a))), default=0)
        assert value(tuple(path[a:b])) == pytest.approx(best, abs=1e-4)


def test_language_id(spark):
    rng = random.Random(9)
    parts = {"en": "the ing tion with er and".split(), "de": "sch ung der ein über ch".split(), "ru": "это при ста как ова ние".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate([*parts] * 60)]
    mixed = (1000, make("en", 30) + " " + make("de", 60), None)
    rest = [(i, t, None) for i, t in ODD] + [mixed, (1001, "123 ,;. 4", "en"), (1002, "— … ¡ 5", "de")]
    docs = spark.createDataFrame(rows + rest, DOCS + ", lang string").withColumn("lang_pred", F.lit("x"))
    model = languages.fit(docs, sample=50)
    assert model.names == ["de", "en", "ru"]
    found = {r.doc_id: r for r in languages.language_id(docs, model).collect()}
    for i, _, lang in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if i > 12:
            assert found[i].lang_pred == lang
    assert (found[1000].lang_pred, found[1000].n_spans) == ("de", 2) and 0.5 < found[1000].score < 0.8
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1001, 1002))
    spans = {}
    for r in languages.language_spans(docs, model).orderBy("start").collect():
        spans.setdefault(r.doc_id, []).append((r.lang, r.start, r.end))
    (a, _, end), (b, start, _) = spans[1000]
    # A word of another language than its neighbours may go to either side.
    assert (a, b) == ("en", "de") and mixed[1][end] == " " and start == end + 1 and abs(len(mixed[1][:end].split()) - 30) <= 2
    assert all(len(spans.get(i, [])) == found[i].n_spans for i in found if i and 12 < i < 1001)
    odd = {}
    for r in languages.language_spans(spark.createDataFrame(ODD, DOCS), model).collect():
        odd.setdefault(r.doc_id, []).append((r.start, r.end))
    assert min(odd[7])[0] == 0 and max(odd[7])[1] == len("äöü ßé 日本語 слово") and odd[8] == [(0, 20_003)] and None in odd and not {3, 4, 5, 10} & set(odd)
    assert languages.language_spans(docs, languages.fit(docs.limit(0))).count() == 0
    assert languages.language_id(docs, model).count() == len(rows) + len(rest)
    assert languages.language_id(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in languages.language_id(docs, languages.fit(docs.limit(0))).collect()} == {"und"}


def test_smallest_hashes_of_each_language(spark):
    """By all rows in order; one language has most of them, and one key stands often."""
    rows = [(i % 3000, "ab"[i % 10 == 0]) for i in range(5000)] + [(7, "a")] * 300 + [(i, "c") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string").repartition(4)
    ordered = sorted((r.h, r.doc_id, r.lang) for r in frame.selectExpr("xxhash64(doc_id) as h", "doc_id", "lang").collect())
    for sample in (1, 40, 100_000):
        wanted = [(lang, d) for name in "abc" for _, d, lang in [r for r in ordered if r[2] == name][:sample]]
        assert sorted(map(tuple, languages._smallest(frame, sample).collect())) == sorted(wanted)


def test_repeated_words_are_scored_once():
    chunk = next(languages.chunks(pa.array(["das Haus und das Haus", "und das", None, "Дом Haus"])))
    found = languages.spelling(chunk)
    assert len(found.start) == 9 and len(found.many) == 4 and found.many.sum() == 9
    alone = [languages.spelling(next(languages.chunks(pa.array([w])))) for w in ("das", "haus", "und", "Дом")]
    buckets = {tuple(one.runs[-1][1]): [b.tolist() for _, b in one.runs] for one in alone}
    for k in range(4):
        own = [bucket[word == k].tolist() for word, bucket in found.runs]
        assert own == buckets[tuple(own[-1])]


def test_all_languages_are_learnt(spark):
    rng = random.Random(3)
    parts = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for k in range(120)}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(n))
    # Languages of the first names have one document more, and the last one only long ones.
    rows = [(i, make(lang, 6000 if lang == "l119" else 40), lang) for i, lang in enumerate([*parts] * 3 + [*parts][:40])]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = languages.fit(docs)
    known = sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1})
    assert model.names == known and len(known) > 100 and "l119" in known
    found = {r.doc_id: r.lang_pred for r in languages.language_id(docs, model).collect()}
    assert all(found[i] == lang for i, _, lang in rows if lang in known)


def test_nulls_have_no_batches():
    assert crf.scores(pa.array([], pa.string()), crf.Field(np.zeros(42), np.zeros((2, 2)))).tolist() == []
