"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier, counted from a bounded sample of a labelled table, gives every document a posterior over
domains. Projected gradient descent on a least-squares problem then finds a rate for each document, at least 0, with
which the expected tokens of every domain come to its target share of all tokens. Steps against the gradient are
added up and the sum is projected to rates of at least 0; each is scaled by the curvature in the rates that are not at
that bound, so that some ten steps suffice, and the descent ends where the gradient is below a bound and not after a
number of steps. Among the many rates that fit, those nearest to 1 are found. A document's rate depends on its
posterior alone, so the iterations run over sums of tokens by posterior, and a step is one small aggregation.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import checkpointed

# Labelled documents to count words of, at most; buckets that words are hashed to, which bound the model to 10 MB.
SAMPLE, BUCKETS = 20000, 1 << 18
# Counts that a bucket is taken to have in every domain beforehand, as often as expected; and how unlikely, as half a
# log-likelihood statistic, a bucket's counts have to be if it did not depend on the domain.
PRIOR_COUNT, TELLING = 2.0, 10.0
# Decimals of posteriors.
DECIMALS = 3
# Share errors that the descent ends at, and steps after which it fails; weight of the distance from 1 beside the errors'
# squares, small enough to move shares by less than the former.
TOLERANCE, STEPS, PULL = 1e-6, 200, 1e-7
# Parts of the sums by posterior.
PARTS = 8


def _words(text: str) -> Column:
    """Lower-case words between white space; there may be empty ones, which don't count."""
    return F.split(F.lower(F.col(f"`{text}`").cast("string")), "[ \\t\\n\\r\\f\\x0B]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, sample: int) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...): how much a word of the bucket speaks for each domain, of all buckets that tell
    domains apart; and the logarithms of the domains' shares.

    :param labelled: (key, domain); rows of other domains, with nulls, or of keys with two domains are left out
    """
    known = labelled.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col("domain").alias("_domain"))
    known = known.where(F.col("_key").isNotNull() & F.col("_domain").isin(*domains))
    known = known.groupBy("_key").agg(F.min("_domain").alias("_domain"), F.max("_domain").alias("_other")).where("_domain = _other")
    # At most ``sample`` rows of a key and a name, so the broadcast is bounded.
    chosen = checkpointed(known.orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_key", "_domain"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), _words(text).alias("words")).join(F.broadcast(chosen), "_key")
    rows = rows.select("_domain", F.explode(F.array_distinct("words")).alias("word")).where("word <> ''")
    count = [F.sum((F.col("_domain") == d).cast("long")).cast("double").alias(f"c{i}") for i, d in enumerate(domains)]
    counts = checkpointed(rows.groupBy(_bucket(F.col("word")).alias("bucket")).agg(*count))
    totals = [t or 0.0 for t in counts.agg(*(F.sum(f"c{i}") for i in range(len(domains)))).first()]
    expected = [_total([F.col(f"c{j}") for j in range(len(domains))]) * (t / max(sum(totals), 1.0)) for t in totals]
    weights = [F.log((F.col(f"c{i}") + PRIOR_COUNT) / (e + PRIOR_COUNT)) for i, e in enumerate(expected)]
    tells = _total([F.abs((F.col(f"c{i}") - e) * w) for i, (e, w) in enumerate(zip(expected, weights))])
    kept = counts.select("bucket", *(w.alias(f"w{i}") for i, w in enumerate(weights)), tells.alias("tells"))
    kept = checkpointed(kept.where(F.col("tells") >= TELLING).drop("tells"))
    sizes = {r["_domain"]: r["count"] for r in chosen.groupBy("_domain").count().collect()}
    many = sum(sizes.values()) + len(domains)
    return kept, [math.log((sizes.get(d, 0) + 1) / many) for d in domains]


def memberships(docs: DataFrame, model: DataFrame, priors: list[float], key: str, text: str) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...) of every row: words of its text, and its posterior to DECIMALS decimals.

    Evidence counts with the root of the number of distinct words that give any, since words of a text are not
    independent.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(text).alias("words"))
    many = F.coalesce(F.size(F.array_remove("words", "")), F.lit(0)).cast("long")
    # Counted in a step of its own, before the words are laid out: beside explode() it would be done once a word.
    rows = rows.select("doc_id", "row", many.alias("n_tokens"), F.array_distinct("words").alias("words"))
    rows = rows.select("doc_id", "row", "n_tokens", F.explode_outer("words").alias("word"))
    # The model has at most BUCKETS rows, so the broadcast is bounded.
    joined = rows.join(F.broadcast(model), F.when(F.col("word") != "", _bucket(F.col("word"))) == model["bucket"], "left")
    sums = [F.sum(F.coalesce(f"w{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(priors))]
    rows = joined.groupBy("row", "doc_id", "n_tokens").agg(F.count("bucket").alias("hits"), *sums)
    temper = F.sqrt(F.greatest(F.col("hits"), F.lit(1)))
    score = [F.lit(p) + F.col(f"s{i}") / temper * 4 for i, p in enumerate(priors)]
    rows = rows.select("doc_id", "n_tokens", *(s.alias(f"l{i}") for i, s in enumerate(score)))
    top = F.greatest(*(F.col(f"l{i}") for i in range(len(priors)))) if len(priors) > 1 else F.col("l0")
    odds = rows.select("doc_id", "n_tokens", *(F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(len(priors))))
    sum_of = _total([F.col(f"e{i}") for i in range(len(priors))])
    return odds.select("doc_id", "n_tokens", *(F.round(F.col(f"e{i}") / sum_of, DECIMALS).alias(f"p{i}") for i in range(len(priors))))


def _rate(along: list[float]) -> Column:
    """The rate after steps that add up to ``along``, from 1 on, back to at least 0."""
    return F.greatest(F.lit(0.0), _total([F.lit(1.0), *(F.lit(a) * F.col(f"p{i}") for i, a in enumerate(along))]))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small positive definite system by elimination."""
    size = len(right)
    rows = [[*line, value] for line, value in zip(matrix, right)]
    for i in range(size):
        pivot = max(range(i, size), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(i + 1, size):
            factor = rows[k][i] / rows[i][i]
            rows[k] = [x - factor * y for x, y in zip(rows[k], rows[i])]
    out = [0.0] * size
    for i in reversed(range(size)):
        out[i] = (rows[i][size] - sum(rows[i][k] * out[k] for k in range(i + 1, size))) / rows[i][i]
    return out


def _fit(cells: DataFrame, total: float, wanted: list[float], steps: int) -> list[float]:
    """The sum of steps, by domain, that brings the shares of (p0, p1, ..., tokens) to what is wanted.

    With rates r = max(0, 1 + p * along), these least squares are lessened where ``half the sum of tokens * r^2, less
    wanted * along`` is: its gradient is the shares' errors, its curvature that of the cells above 0. Each job brings
    the value, the errors and the curvature of one try; a step that does not lessen the value is halved.
    """
    numbers = range(len(wanted))
    pairs = [(i, k) for i in numbers for k in numbers if i <= k]

    def tried(along: list[float]) -> tuple[float, list[float], list[list[float]]]:
        rate, weight = _rate(along), F.col("tokens") / total
        sums = [F.sum(weight * rate * rate / 2), *(F.sum(weight * rate * F.col(f"p{i}")) for i in numbers)]
        above = F.when(rate > 0, weight).otherwise(0.0)
        sums += [F.sum(above * F.col(f"p{i}") * F.col(f"p{k}")) for i, k in pairs]
        value, *rest = cells.agg(*(s.alias(f"s{j}") for j, s in enumerate(sums))).first()
        # A domain without any expected token has no share to change.
        errors = [(share + PULL * a - w) if mass[i] else 0.0 for i, (share, a, w) in enumerate(zip(rest, along, wanted))]
        curve = [[0.0] * len(wanted) for _ in numbers]
        for (i, k), c in zip(pairs, rest[len(wanted) :]):
            curve[i][k] = curve[k][i] = c + (PULL if i == k else 0.0)
        value += sum(PULL * a * a / 2 - w * a for a, w, m in zip(along, wanted, mass) if m)
        return value, errors, curve

    mass = [m > 0 for m in cells.agg(*(F.sum(F.col("tokens") * F.col(f"p{i}")) for i in numbers)).first()]
    along = [0.0 for _ in numbers]
    value, errors, curve = tried(along)
    for _ in range(steps):
        if max(abs(e) for e in errors) <= TOLERANCE:
            return along
        move = _solved(curve, [-e for e in errors])
        slope, part = sum(m * e for m, e in zip(move, errors)), 1.0
        while True:
            there = [a + part * m for a, m in zip(along, move)]
            found = tried(there)
            # Near the end the value no longer tells steps apart, but errors do.
            if found[0] <= value + 1e-4 * part * slope or max(map(abs, found[1])) <= 0.5 * max(map(abs, errors)) or part < 1e-6:
                break
            part /= 2
        along, (value, errors, curve) = there, found
    raise ValueError(f"the shares' errors are still {errors} after {steps} steps")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> for each, domain, rate) of every row of ``docs``.

    Rates r >= 0 bring every domain's share, the sum of rate * tokens * posterior over all tokens, to its target. Of all
    rates that do, those with the least sum of tokens * (rate - 1)^2 are given; where none do, those with the least
    squares of errors, but for a pull to 1 of 1e-7 of their weight. Targets are brought to a sum of 1. Rows without
    words have the domains' shares in the labels as posterior, and a rate, but no weight. A domain with no expected
    token can't be reached and is left as it is. ``domain`` is the most probable one, ties going to the earlier name. An
    empty table gives no rows. Labels without any row of the domains leave all posteriors equal. A very long text is
    split into words in its task's memory, as one row, and counts as one document.

    :param labelled: (key, domain) of some documents, ``sample`` of which the classifier is counted from
    """
    domains = sorted(targets)
    wanted = [targets[d] / sum(targets.values()) for d in domains]
    model, priors = classifier(docs, labelled, domains, key, text, sample)
    rows = checkpointed(memberships(docs, model, priors, key, text))
    numbers = range(len(domains))
    # Rounding bounds the number of posteriors, so few parts hold them; every step is a job over these.
    cells = rows.groupBy(*(f"p{i}" for i in numbers)).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells = checkpointed(cells.coalesce(PARTS))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    along = _fit(cells, total, wanted, steps) if total else [0.0 for _ in domains]
    best = F.array_position(F.array(*(F.col(f"p{i}") for i in numbers)), F.array_max(F.array(*(F.col(f"p{i}") for i in numbers))))
    return rows.select(
        "doc_id",
        "n_tokens",
        *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)),
        F.element_at(F.array(*(F.lit(d) for d in domains)), best.cast("int")).alias("domain"),
        _rate(along).alias("rate"),
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels: toxic, else junk where the quality is 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))
