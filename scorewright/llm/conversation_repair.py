"""Cheapest repair of conversations, as dynamic programming over a grammar of their role and fault sequences.

A conversation's rows, in the order of turns, become a string of symbols: what matters of a row is whether its role
starts with s, u, a or anything else, and its first fault (blank; a duplicate of an earlier role and text; truncated, that
is not ended by one of ``.!?``). The repaired roles have to be empty or ``s?(ua)+``, an automaton of four states. Edits
cost: keep 0, change the role to user or assistant 1, delete 2, insert an empty user or assistant row 5, and 5 for every
truncated row that isn't deleted; blank and duplicate rows have to go. The letters of a conversation's edits in order
(K, R, D, I) are its audit; of equally cheap audits the least in ASCII counts.

Every symbol is a matrix of the least (cost, audit) from state to state, and a sequence is the min-plus product of its
symbols. Products are shared: symbol strings, in blocks of at most BLOCK, are compressed by Re-Pair, whose rounds count
adjacent pairs over all distinct blocks and name the most frequent ones that have no symbol in common. A rule's matrix is
the product of its two parts', worked out bottom-up once a worker, its audits being ropes that point to the parts'
audits. Blocks multiply the matrices of what they are compressed to; long conversations multiply their blocks. Cheapest
scripts of one block from state to state never are prefixes of each other, as letters alone decide on cost, so that the
least audit of a product is made of least audits. RULES bounds the grammar; more rules would only save work.

Rows are ordered by range partitions of (conversation, turn), so that a conversation of any length is cut into pieces in
many tasks; only its blocks, and in the end its audit, one letter a row, meet in one task. Texts take no part in this; they
are moved once, to be hashed or written row by row beside the audit.

Nulls: a null role or text is one space; rows without a turn come first; rows without a conversation are one. Rows of one
turn are in the order of role and of the text's hash. Repeated rows are duplicates. An empty text is blank; texts of any
length are held one at a time. An empty table gives no rows.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from scorewright.llm.session import checkpointed, partitions

SPACE = " \t\n\x0b\x0c\r"
# Rows in a block; rules of the grammar, and how many a round may add; rounds.
BLOCK, RULES, A_ROUND, ROUNDS = 64, 256, 32, 12
# Matrices of blocks that a worker keeps.
KEPT = 1 << 14

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
# States: nothing yet, after system, after user, after assistant; the first and the last may end a conversation.
STATES, ENDS = range(4), (0, 3)
_USER_FROM, _ASSISTANT_FROM = (0, 1, 3), (2,)
_FIRST_NAME = 0xE000


# Symbols: a letter of s, u, a, x; upper case if truncated; "-" for rows that have to go.
def symbol(initial: str, gone: bool, truncated: bool) -> str:
    if gone:
        return "-"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if truncated else letter


class Rope:
    """Two ropes, or a rope and letters, one after the other; the letters are put together when they are asked for."""

    __slots__ = ("left", "right", "_letters")

    def __init__(self, left, right):
        self.left, self.right, self._letters = left, right, None

    def letters(self) -> str:
        if self._letters is None:
            out, todo = [], [self.right, self.left]
            while todo:
                part = todo.pop()
                if isinstance(part, str):
                    out.append(part)
                elif part._letters is not None:
                    out.append(part._letters)
                else:
                    todo += [part.right, part.left]
            self._letters = "".join(out)
        return self._letters


def _letters(rope) -> str:
    return rope if isinstance(rope, str) else rope.letters()


def _better(a: tuple | None, b: tuple | None):
    """The cheaper of two (cost, audit); of equally cheap ones the one of least letters."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if _letters(a[1]) <= _letters(b[1]) else b


def product(a: list, b: list) -> list:
    """Min-plus product of two matrices of (cost, rope) or None."""
    out = []
    for row in a:
        line = [None] * 4
        for p, first in enumerate(row):
            if first is None:
                continue
            for q, second in enumerate(b[p]):
                if second is not None and (line[q] is None or first[0] + second[0] <= line[q][0]):
                    line[q] = _better(line[q], (first[0] + second[0], Rope(first[1], second[1])))
        out.append(line)
    return out


def _inserts() -> list:
    one = [[None] * 4 for _ in STATES]
    for p in STATES:
        one[p][p] = (0, "")
        one[p][3 if p in _ASSISTANT_FROM else 2] = (INSERT, "I")
    return product(product(one, one), one)


INSERTS = _inserts()


def symbol_matrix(s: str) -> list:
    """Inserts before a row, and what may be done with it."""
    edits = [[None] * 4 for _ in STATES]
    for p in STATES:
        edits[p][p] = (DELETE, "D")
        if s == "-":
            continue
        cost, kind = CUT_OFF * s.isupper(), s.lower()
        q = 3 if p in _ASSISTANT_FROM else 2
        edits[p][q] = (REROLE + cost, "R")
        if kind == ("a" if p in _ASSISTANT_FROM else "u"):
            edits[p][q] = (KEEP + cost, "K")
        if kind == "s" and p == 0:
            edits[p][1] = (KEEP + cost, "K")
    return product(INSERTS, edits)


TERMINALS = "suaxSUAX-"


def compressed(symbols: str, rules: tuple[str, ...]) -> str:
    """The string with every rule's pair replaced by the rule's name, rule after rule, from left to right."""
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(_FIRST_NAME + k))
    return symbols


@lru_cache(4)
def rule_matrices(rules: tuple[str, ...]) -> dict[str, list]:
    """A matrix for every symbol and, bottom-up, for every rule."""
    found = {s: symbol_matrix(s) for s in TERMINALS}
    for k, (left, right) in enumerate(rules):
        found[chr(_FIRST_NAME + k)] = product(found[left], found[right])
    return found


@lru_cache(KEPT)
def block_matrix(symbols: str, rules: tuple[str, ...]) -> tuple:
    """A block's matrix, its audits as letters."""
    matrices, out = rule_matrices(rules), None
    for s in compressed(symbols, rules):
        out = matrices[s] if out is None else product(out, matrices[s])
    return tuple(tuple(None if e is None else (e[0], _letters(e[1])) for e in row) for row in out)


def _pair_counts(rules: tuple[str, ...]):
    """A function from batches of (symbols, n) to (pair, n), summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                short, last = compressed(symbols, rules), -1
                for i in range(len(short) - 1):
                    pair = short[i : i + 2]
                    # Of three equal symbols, one pair can be replaced.
                    if pair[0] != pair[1] or last != i - 1 or short[i - 1] != pair[0]:
                        found[pair] = found.get(pair, 0) + n
                        last = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    return run


def re_pair(blocks: DataFrame, rules: int = RULES) -> tuple[str, ...]:
    """Rules for (symbols, n): each names a pair of symbols or earlier rules.

    Each round brings at most A_ROUND counted pairs to the driver.
    """
    found: tuple[str, ...] = ()
    for _ in range(ROUNDS):
        if len(found) >= rules:
            break
        counted = blocks.mapInArrow(_pair_counts(found), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(min(A_ROUND, rules - len(found))).collect()
        used: set[str] = set()
        for row in top:
            # Pairs that share a symbol compete for places, and wait for the next round's counts.
            if not used & set(row.pair):
                used |= set(row.pair)
                found += (row.pair,)
        if not top:
            break
    return found


def _narrow(rows: DataFrame) -> DataFrame:
    """A conversation's rows without texts: order, initial and faults."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    ended = F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    first = Window.partitionBy("conv_id", "_role", "_h").orderBy(F.asc_nulls_first("turn"))
    return rows.select(
        "conv_id", "turn", F.col("role").alias("_role"), _hash().alias("_h"),
        F.left("role", F.lit(1)).alias("initial"), (trimmed == "").alias("blank"), (~ended).alias("truncated"),
    ).withColumn("duplicate", F.row_number().over(first) > 1)


def _hash() -> Column:
    return F.md5(F.col("text"))


_ORDER = ("conv_id", "turn", "_role", "_h")


def _piece_schema(key) -> StructType:
    counts = ("n", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns")
    names = [StructField("conv_id", key), StructField("part", IntegerType()), StructField("piece", LongType()), StructField("symbols", StringType())]
    ends = [StructField("first_initial", StringType()), StructField("last_initial", StringType())]
    return StructType(names + [StructField(c, LongType()) for c in counts] + ends)


def _pieces(schema: StructType):
    """A function from sorted rows to blocks of at most BLOCK rows of one conversation, with what is counted in them."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, out = TaskContext.get().partitionId(), 0, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kinds = {"conv_id": batch.schema.field("conv_id").type, "part": pa.int32(), "symbols": pa.string(), "first_initial": pa.string(), "last_initial": pa.string()}
                arrow = pa.schema([(name, kinds.get(name, pa.int64())) for name in names])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "duplicate", "truncated")]
            for conv, turn, initial, blank, duplicate, truncated in zip(*columns):
                if now is None or now["conv_id"] != conv or now["n"] == BLOCK:
                    if now is not None:
                        out.append(now)
                    number += 1
                    now = dict.fromkeys(names, 0) | {"conv_id": conv, "part": part, "piece": number, "symbols": "", "first_initial": initial, "least": None, "most": None}
                elif now["last_initial"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                if turn is not None and turn != now["most"]:
                    now["least"] = turn if now["least"] is None else now["least"]
                    now["most"] = turn
                    now["turns"] += 1
                fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
                if fault:
                    now[fault] += 1
                now["n"] += 1
                now["symbols"] += symbol(initial, blank or duplicate, truncated)
                now["last_initial"] = initial
            if len(out) > 1000:
                yield made()
                out.clear()
        if now is not None:
            out.append(now)
            yield made()

    return run


class _Chain:
    """A conversation's audit so far: a block's letters after another chain."""

    __slots__ = ("before", "letters")

    def __init__(self, before, letters):
        self.before, self.letters = before, letters


def _least_chain(a, b):
    """The lesser of two chains of as many blocks; what they have in common isn't looked at."""
    x, y, left, right = a, b, [], []
    while x is not y:
        left.append(x.letters)
        right.append(y.letters)
        x, y = x.before, y.before
    return a if "".join(reversed(left)) <= "".join(reversed(right)) else b


def _onward(line: list, matrix) -> list:
    out = [None] * 4
    for p, first in enumerate(line):
        if first is None:
            continue
        for q, second in enumerate(matrix[p]):
            if second is None:
                continue
            new = first[0] + second[0], _Chain(first[1], second[1])
            if out[q] is None or new[0] < out[q][0] or new[0] == out[q][0] and _least_chain(new[1], out[q][1]) is new[1]:
                out[q] = new
    return out


_FLAT_INSERTS = tuple(tuple(None if e is None else (e[0], _letters(e[1])) for e in row) for row in INSERTS)


def _ended(line: list) -> tuple[int, str]:
    """Cost and audit of a conversation whose blocks all have been seen."""
    line = _onward(line, _FLAT_INSERTS)
    best = None
    for q in ENDS:
        if line[q] is not None and (best is None or line[q][0] < best[0] or line[q][0] == best[0] and _least_chain(line[q][1], best[1]) is line[q][1]):
            best = line[q]
    out, chain = [], best[1]
    while chain is not None:
        out.append(chain.letters)
        chain = chain.before
    return best[0], "".join(reversed(out))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solved(rules: tuple[str, ...]):
    """A function from sorted blocks to conversations: counts, cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrow = None, None

        def done() -> dict:
            cost, audit = _ended(now["line"])
            gaps = 0 if now["least"] is None else now["most"] - now["least"] + 1 - now["turns"]
            return {name: now.get(name) for name in ("conv_id", *_COUNTS)} | {"gaps": gaps, "cost": cost, "audit": audit}

        for batch in batches:
            arrow = arrow or pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())])
            out = []
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        out.append(done())
                    now = row | {"line": [(0, None), None, None, None]}
                else:
                    for name in ("blank", "duplicate", "truncated", "illegal"):
                        now[name] += row[name]
                    now["illegal"] += now["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
                    # A turn may go on from one block to the next.
                    now["turns"] += row["turns"] - (row["least"] is not None and row["least"] == now["most"])
                    now["least"] = row["least"] if now["least"] is None else now["least"]
                    now["most"] = now["most"] if row["most"] is None else row["most"]
                    now["last_initial"] = row["last_initial"]
                now["line"] = _onward(now["line"], block_matrix(row["symbols"], rules))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], arrow)

    return run


def known(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(f"`{name}`").cast("string"), space).alias(name) for name in ("role", "text"))
    return conversations.select(F.col(f"`{key}`").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``known`` with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def solved(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation in rows of ``known``."""
    schema = _piece_schema(rows.schema["conv_id"].dataType)
    parts = partitions(rows.sparkSession)
    sorted_rows = _narrow(rows).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    pieces = checkpointed(sorted_rows.mapInArrow(_pieces(schema), schema))
    grammar = re_pair(checkpointed(pieces.groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))), rules)
    together = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    out = StructType([schema["conv_id"], *[StructField(c, LongType()) for c in _COUNTS], StructField("audit", StringType())])
    return together.mapInArrow(_solved(grammar), out)


def edited(rows: Iterator[tuple[int | None, str, str]], audit: str) -> Iterator[tuple[int | None, str, str, str]]:
    """(turn, role, text, edit) of a repaired conversation, from its (turn, role, text) and its audit."""
    state, at = 0, 0

    def next_role() -> str:
        return "assistant" if state in _ASSISTANT_FROM else "user"

    for turn, role, text in rows:
        while audit[at] == "I":
            role_in = next_role()
            state = 3 if role_in == "assistant" else 2
            yield None, role_in, "", "I"
            at += 1
        letter = audit[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = next_role()
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        yield turn, role, text, letter
    for letter in audit[at:]:
        role_in = next_role()
        state = 3 if role_in == "assistant" else 2
        yield None, role_in, "", letter


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator]]:
    """(what is known of a conversation, its rows) from rows that are sorted so that the former comes first."""
    rows = ((row for batch in batches for row in batch.to_pylist()))
    ahead = next(rows, None)
    while ahead is not None:
        head = ahead

        def own() -> Iterator:
            nonlocal ahead
            for ahead in rows:
                if ahead["_text"] is None:
                    return
                yield ahead["turn"], ahead["_role"], ahead["_text"]
            ahead = None

        # Each conversation's rows are read to their end by the caller.
        yield head, own()


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversations and their rows, sorted; a conversation stands before its rows. Texts are moved here and nowhere else."""
    texts = rows.select("conv_id", F.lit(1).alias("_kind"), "turn", F.col("role").alias("_role"), _hash().alias("_h"), F.col("text").alias("_text"))
    heads = found.withColumn("_kind", F.lit(0))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition(partitions(rows.sparkSession), "conv_id")
    return both.sortWithinPartitions("conv_id", "_kind", "turn", "_role", "_h")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow, out = None, []

    def seen(batches):
        nonlocal arrow
        for batch in batches:
            fields = [batch.schema.field(name) for name in ("conv_id", *_COUNTS, "audit")]
            arrow = arrow or pa.schema([*fields, pa.field("repaired_sha256", pa.string())])
            yield batch

    for head, rows in _conversations(seen(batches)):
        digest, first = sha256(), True
        for _, role, text, _ in edited(rows, head["audit"]):
            digest.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
            first = False
        out.append({name: head[name] for name in arrow.names[:-1]} | {"repaired_sha256": digest.hexdigest()})
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
    if out:
        yield pa.RecordBatch.from_pylist(out, arrow)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out = None, []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out))
        kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "position", "turn", "role", "text", "edit"])

    def seen(batches):
        nonlocal kind
        for batch in batches:
            kind = kind or batch.schema.field("conv_id").type
            yield batch

    size = 0
    for head, rows in _conversations(seen(batches)):
        for position, row in enumerate(edited(rows, head["audit"])):
            out.append((head["conv_id"], position, *row))
            size += len(row[2]) + 50
            if size > 1 << 20:
                yield made()
                out.clear()
                size = 0
    if out:
        yield made()


def repaired(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """conv_id, position, turn, role, text, edit: the repaired conversations' rows; inserted ones have no turn."""
    key = rows.schema["conv_id"]
    out = StructType([key, *StructType.fromDDL("position long, turn long, role string, text string, edit string").fields])
    return _beside_audits(rows, solved(rows, rules)).mapInArrow(_written, out)


def conversation_repair(rows: DataFrame, conversations: DataFrame | None = None, rules: int = RULES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    :param rows: rows of ``known``
    :param conversations: a table whose ``conv_id`` all appear, also those without a row
    """
    found = solved(rows, rules)
    out = StructType([*found.schema.fields, StructField("repaired_sha256", StringType())])
    result = _beside_audits(rows, found).mapInArrow(_hashed, out)
    if conversations is None:
        return result
    ids = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "_id")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in _COUNTS}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    joined = ids.join(result, ids["_id"].eqNullSafe(result["conv_id"]), "left").withColumns(zeros | empty)
    return joined.select(F.col("_id").alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")
