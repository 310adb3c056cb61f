"""Words that are one edit apart, by asymmetric q-chunks, and the common word that each rare one is a variant of.

Two words are near if one inserted, deleted or replaced code point makes them equal. The shorter of the two (either, of
equal lengths) contributes chunks, the other one grams. A word of m code points has two disjoint chunks of m div 2, its
first and its last ones; one edit leaves one of the two whole, and moves it by one place at most, so that it stands in
the other word as one of its positional grams of that length. Of all positional grams only those are made that can meet
a chunk: at the first chunk's place, and at the last chunk's place shifted by the difference of lengths, for partners of
the same length and of one less. Words meet on (m, place, chunk); what meets is verified by edit distance.

One chunk of three or four letters stands in thousands of words, so the step is made again on what lies beside the kept
chunk, where the edit must be: a word then meets others by three quarters of its letters, in four ways. Where a key would
still bring together more than TOGETHER pairs, its words go through the step once more, and so on until one letter is
left open. So no pair is lost, and no group is ever written out in all its pairs.

A word's form is its most frequent near word, if that is SHARE times as frequent; forms lead on to a root.

Nulls: a null text has no words; a null key counts as empty text where the key matters. Repeated rows count again. Ties of
frequency go to the word that is first in the order of code points. An empty table, or one without near words, is no
special case; texts of any length are cut into words inside the JVM, which holds one text at a time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import checkpointed, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Code points and occurrences that a word has at least; how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, SHARE = 7, 2, 10
# Steps that all words go through; pairs that one key may bring together without another step.
STEPS, TOGETHER = 2, 10_000


def typos(key: Column, run: Column, every: int) -> Column:
    """The run without one code point, where ``every`` divides the CRC-32 of ``key:run``; else the run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
               least_count: int = LEAST_COUNT, typos_every: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A to Z in lower case, of so many code points and occurrences at least.

    ``typos_every`` plants typing errors, see :func:`typos`.
    """
    # A longer match is found first, so what is shorter than least_length is never made.
    pattern = "[a-zÀ-ÿ]{%d,}" % least_length
    lowered = F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))).alias("word"))
    if typos_every:
        runs = runs.select(typos(F.col("key"), F.col("word"), typos_every).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _step(rows: DataFrame) -> DataFrame:
    """What lies open between ``l`` first and ``r`` last letters is halved: either its first half is kept too, or its last."""
    half = F.expr("(m - l - r) div 2").cast("int")
    ways = F.array(F.struct((F.col("l") + half).alias("l"), F.col("r").alias("r")), F.struct(F.col("l").alias("l"), (F.col("r") + half).alias("r")))
    return rows.withColumn("way", F.explode(ways)).withColumns({"l": F.col("way.l"), "r": F.col("way.r")}).drop("way")


def _keyed(rows: DataFrame) -> DataFrame:
    kept = [F.expr("substring(word, 1, l)"), F.expr("substring(word, length(word) - r + 1, r)")]
    return rows.withColumn("key", F.xxhash64("m", "l", "r", *kept))


def signatures(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Chunks of each word for longer partners, and grams for shorter ones, before the first step.

    ``m`` is the length of the word that contributes the chunk.
    """
    length = F.length("word").cast("int")
    sides = F.array(F.struct(F.lit(True).alias("chunk"), length.alias("m")), F.struct(F.lit(False).alias("chunk"), length.alias("m")),
                    F.struct(F.lit(False).alias("chunk"), (length - 1).alias("m")))
    rows = words.withColumn("side", F.explode(sides)).where(F.col("side.m") >= least_length)
    zero = F.lit(0).cast("int")
    return rows.select("word", "n", F.col("side.chunk").alias("chunk"), F.col("side.m").alias("m"), zero.alias("l"), zero.alias("r"))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, together: int = TOGETHER) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once."""
    # Short rows with much work: as many tasks as a shuffle has.
    rows = signatures(words.repartition(partitions(words.sparkSession)), least_length)
    for _ in range(STEPS):
        rows = _step(rows)
    rows, settled = _keyed(rows), None
    while True:
        pairs = F.count_if("chunk") * F.count_if(~F.col("chunk"))
        open_letters = F.first(F.col("m") - F.col("l") - F.col("r"))
        hot = rows.groupBy("key").agg(pairs.alias("pairs"), open_letters.alias("open")).where(f"pairs > {together} and open > 1").select("key")
        hot = checkpointed(hot)
        if hot.isEmpty():
            break
        now = rows.join(hot, "key", "left_anti")
        settled = now if settled is None else settled.unionByName(now)
        rows = checkpointed(_keyed(_step(rows.join(hot, "key", "left_semi").drop("key"))))
    rows = rows if settled is None else settled.unionByName(rows)
    chunk = rows.where("chunk").select("key", "m", F.col("word").alias("a"), F.col("n").alias("n_a"))
    gram = rows.where("not chunk").select("key", F.col("m").alias("m_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = chunk.join(gram, "key").where("m = m_b and a <> b and (length(b) > m or a < b)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed twice as far in each round; they end, as counts grow along them."""
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = checkpointed(found.join(onward, "root", "left").select("word", "root", "further"))
        found = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further is not null").isEmpty():
            return found


def spelling_variants(words: DataFrame, share: int = SHARE, least_length: int = LEAST_LENGTH, together: int = TOGETHER) -> DataFrame:
    """word, form, root, n, n_near, form_n of each (word, n)."""
    words = checkpointed(words)
    pairs = near_words(words, least_length, together)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has_form = -F.col("best.m") >= share * F.col("n")
    linked = checkpointed(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(linked.where("form is not null"))
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
