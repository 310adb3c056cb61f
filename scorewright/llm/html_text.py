"""HTML extraction by wrapper induction: trees of pages of one host are aligned, and what is constant is template.

Every host has a reference page, its shortest with a text slot. Simple tree matching aligns each page of the host with it;
sums over all pages tell how often each text of the reference was matched and how often it was the same. As one page may
lack what all others have, texts are also counted by where they stand over all pages of the host. Texts that are the same
on nearly all pages are the host's template, varying slots are content. Whether a slot is the article is told by where it
stands: slots in menus, headers, footers, sidebars, notices, adverts, forms and comments are none. Where a page has an
article or main element, its content is what stands in there, but for containers of constant text, unless what varies
outside is much more.
"""

import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, checkpointed

# A text is template if it is the same on this share of the pages it was matched on, and those are so many at least.
CONSTANT, PAGES = 0.9, 3
# An article is passed over if what varies outside of it has more than this many times its characters.
OUTSIDE = 2
# Bytes of what is joined to pages by host up to which it is sent to every executor; beyond, pages are shuffled to it.
SENT = 32 << 20
# Elements of a slot's path; the last of them stands, as a hash, for all that are further in. Characters of an element's
# class names there; longer ones are a hash too.
DEPTH, NAMES = 60, 80

# --- fixed values: names of HTML elements, and words in class names ---------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
# Elements that end an open paragraph, and elements that a sibling of a kind ends.
ENDS_P = BLOCK - {"br", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "frameset"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table tr td th div article section main aside nav header footer form body select blockquote".split())
NEVER = frozenset("head nav header footer aside form button select menu dialog object canvas audio video map".split()) | RAW
WITHIN_ARTICLE = NEVER - {"header"}
# What stands in an article through these alone is its own text, also where it is the same on all pages.
PLAIN = frozenset("article main header hgroup p h1 h2 h3 h4 h5 h6".split())
AVOIDED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|menu|nav\w*|newsletter|notices?|popup|promo\w*|"
    r"related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)

# --- trees ------------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"<(?:!|\?|(/?)([a-zA-Z][^\s/>]*))")
_ENDING = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Node:
    """An element. Its children are elements and texts (str) in order."""

    tag: str
    names: str = ""
    children: list = field(default_factory=list)
    hidden: bool = False


class _Open:
    """The elements that are open, with the places of each name and of scopes among them, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.of, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.of[tag][-1] for tag in tags if self.of.get(tag)), default=0)

    def end(self, tag: str) -> None:
        """An end tag; one of neither a scope nor a block doesn't reach out of a scope."""
        depth = self.innermost((tag,))
        free = tag in SCOPES or tag in BLOCK or not self.scopes or self.scopes[-1] <= depth
        if depth and free:
            self.close(depth)

    def end_within_scope(self, tags: Iterable[str]) -> None:
        """Closes the innermost open element of the tags, unless another scope begins within it."""
        depth = self.innermost(tags)
        if depth and (not self.scopes or self.scopes[-1] <= depth):
            self.close(depth)


class _Ends:
    """Where tags end: at the first ``>`` outside of quotes.

    Every position is looked at a bounded number of times. A quote that never closes is a character like others. If a
    tag's end is not found before the page's, quotes count no more from there on, and behind the last ``>`` no tag is
    looked for.
    """

    def __init__(self, text: str):
        self.text, self.last, self.quoted, self.unclosed = text, text.rfind(">"), True, set()

    def after(self, start: int) -> int:
        """The place behind the tag, or 0 if it never ends."""
        if start > self.last:
            return 0
        at = start
        while self.quoted:
            found = _ENDING.search(self.text, at)
            if found is None:
                self.quoted = False
            elif found[0] == ">":
                return found.end()
            else:
                close = -1 if found[0] in self.unclosed else self.text.find(found[0], found.end())
                if close < 0:
                    self.unclosed.add(found[0])
                at = found.end() if close < 0 else close + 1
        return self.plain(start)

    def plain(self, start: int) -> int:
        """The same where quotes don't count."""
        return self.text.find(">", start) + 1 if start <= self.last else 0


def parse(text: str) -> Node:
    """The tree of a page, with what is left open closed where it has to be. Linear in the page's length."""
    root = Node("")
    open_, ends, position = _Open(root), _Ends(text), 0

    def add(end: int) -> None:
        if end > position:
            open_.stack[-1].children.append(text[position:end])

    search = 0
    while True:
        piece = _TAG.search(text, search)
        if not piece:
            add(len(text))
            return root
        if text.startswith("<!--", piece.start()):
            add(piece.start())
            close = text.find("-->", piece.start() + 4)
            position = search = len(text) if close < 0 else close + 3
            continue
        name = piece[2]
        behind = ends.after(piece.end()) if name else ends.plain(piece.end())
        if not behind:
            # No tag after all.
            search = piece.end()
            continue
        add(piece.start())
        position = search = behind
        if not name:
            continue
        tag, rest = name.lower(), text[piece.end() : behind - 1]
        if piece[1]:
            open_.end(tag)
            continue
        if tag in ENDS_P:
            open_.end_within_scope(("p",))
        if tag in SIBLINGS:
            open_.end_within_scope(SIBLINGS[tag])
        node = Node(tag)
        if rest and not rest.isspace():
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
            node.names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            node.hidden = "hidden" in found
        open_.stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, position)
            node.children.append(text[position : close.start() if close else len(text)])
            position = search = close.end() if close else len(text)
        elif tag not in VOID and not rest.endswith("/"):
            open_.push(node)


def _avoided(node: Node, in_article: bool) -> bool:
    return node.hidden or node.tag in (WITHIN_ARTICLE if in_article else NEVER) or bool(node.names.strip() and AVOIDED.search(node.names))


@dataclass
class Block:
    """A text slot: where it stands, as the tags and class names above it, its text, and whether an article has it."""

    path: str
    text: str
    in_article: bool


def _within(path: str, node: Node) -> str:
    names = node.names.strip()
    step = f"{node.tag}.{names if len(names) <= NAMES else mark(names)}".replace("/", "|")
    if path.count("/") < DEPTH:
        return f"{path}/{step}"
    above, _, last = path.rpartition("/")
    return f"{above}/{node.tag}.{mark(last, step)}"


def blocks(root: Node) -> list[Block]:
    """Slots that may be content, in page order, white space brought together."""
    out: list[Block] = []
    pieces: list[str] = []
    at = [("", False)]

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append(Block(at[-1][0], text, at[-1][1]))

    todo: list = [(root, "", False, False)]
    while todo:
        node, path, in_article, closing = todo.pop()
        if isinstance(node, str):
            pieces.append(node)
            continue
        if closing:
            flush()
            at.pop()
            continue
        if _avoided(node, in_article):
            flush()
            continue
        inner = in_article or node.tag in ("article", "main")
        here = _within(path, node) if node.tag in BLOCK else path
        if node.tag in BLOCK:
            flush()
            at.append((here, inner))
            todo.append((node, here, inner, True))
        todo.extend((child, here, inner, False) for child in reversed(node.children))
    flush()
    return out


def _sized(node: list) -> list:
    """The tree as (label, children, slots, hash of its shape, elements), slots being those in it in order."""
    children = [_sized(child) for child in node[1]]
    slots = [node[2]] if node[2] >= 0 else []
    for child in children:
        slots += child[2]
    return [node[0], children, slots, hash((node[0], node[2] >= 0, *(c[3] for c in children))), 1 + sum(c[4] for c in children)]


# Cells of a matrix that is kept whole to be traced back.
_KEPT_CELLS = 1 << 22


class _Matching:
    """Largest matchings of two trees' elements that keep order and ancestry.

    Trees of one shape match whole. Of two rows of children, equal ones at either end match each other in some largest
    matching, so that only what lies between them is gone through; there a pair of shapes is scored once, however often
    it occurs, and rows of the matrix are worked out at once.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: list, b: list) -> int:
        if a[0] != b[0]:
            return 0
        if a[3] == b[3]:
            return a[4]
        key = a[3], b[3]
        if key not in self.known:
            head, rows, columns, tail = _apart(a[1], b[1])
            same = sum(x[4] for x in (*a[1][:head], *a[1][len(a[1]) - tail :]))
            self.known[key] = 1 + same + (int(self._last_row(rows, columns)[-1]) if rows and columns else 0)
        return self.known[key]

    def _weights(self, rows: list, columns: list) -> Iterator[np.ndarray]:
        """What each row's element would match of each column's."""
        shapes = {y[3]: y for y in columns}
        numbers = {shape: i for i, shape in enumerate(shapes)}
        which = np.array([numbers[y[3]] for y in columns], np.int64)
        made: dict[int, np.ndarray] = {}
        for x in rows:
            if x[3] not in made:
                made[x[3]] = np.array([self.score(x, y) for y in shapes.values()], np.int64)
            yield made[x[3]][which]

    def _last_row(self, rows: list, columns: list) -> np.ndarray:
        line = np.zeros(len(columns) + 1, np.int64)
        for weights in self._weights(rows, columns):
            best = np.maximum(line[1:], line[:-1] + weights)
            line[1:] = np.maximum.accumulate(best)
        return line

    def children(self, rows: list, columns: list) -> Iterator[tuple[list, list]]:
        """Pairs of children that match, in order."""
        head, x, y, tail = _apart(rows, columns)
        yield from zip(rows[:head], columns[:head])
        if x and y:
            yield from self._between(x, y)
        yield from zip(rows[len(rows) - tail :], columns[len(columns) - tail :])

    def _between(self, rows: list, columns: list) -> Iterator[tuple[list, list]]:
        if len(rows) > 1 and len(rows) * len(columns) > _KEPT_CELLS:
            # Halve the rows and find where the halves' columns meet, instead of keeping the matrix.
            half = len(rows) // 2
            above, below = self._last_row(rows[:half], columns), self._last_row(rows[half:][::-1], columns[::-1])
            cut = int(np.argmax(above + below[::-1]))
            if cut:
                yield from self._between(rows[:half], columns[:cut])
            if cut < len(columns):
                yield from self._between(rows[half:], columns[cut:])
            return
        lines, weights = [np.zeros(len(columns) + 1, np.int64)], list(self._weights(rows, columns))
        for weight in weights:
            line = np.zeros(len(columns) + 1, np.int64)
            line[1:] = np.maximum.accumulate(np.maximum(lines[-1][1:], lines[-1][:-1] + weight))
            lines.append(line)
        i, j, pairs = len(rows), len(columns), []
        while i and j:
            if lines[i][j] == lines[i - 1][j]:
                i -= 1
            elif lines[i][j] == lines[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((rows[i], columns[j]))
        yield from reversed(pairs)


def _apart(rows: list, columns: list) -> tuple[int, list, list, int]:
    """How many elements are equal from the front, what is left of both, and how many are equal from the back."""
    most = min(len(rows), len(columns))
    head = 0
    while head < most and rows[head][3] == columns[head][3]:
        head += 1
    tail = 0
    while tail < most - head and rows[-1 - tail][3] == columns[-1 - tail][3]:
        tail += 1
    return head, rows[head : len(rows) - tail], columns[head : len(columns) - tail], tail


def align(page: list, reference: list) -> list[tuple[int, int]]:
    """Simple tree matching of two trees (label, children, number of the slot or -1): pairs of slots on the largest
    matching that keeps order and ancestry."""
    found, matching, todo = [], _Matching(), [tuple(t if len(t) == 5 else _sized(t) for t in (page, reference))]
    while todo:
        a, b = todo.pop()
        if a[0] != b[0]:
            continue
        if a[3] == b[3]:
            found += zip(a[2], b[2])
            continue
        todo += matching.children(a[1], b[1])
    return found


def slot_tree(slots: list[Block]) -> list:
    """The tree over slots that their paths span: slots under the same elements in a row share them."""
    root = ["", [], -1]
    open_: list = [root]
    names: list[str] = []
    for number, slot in enumerate(slots):
        steps = slot.path.split("/")[1:]
        same = 0
        while same < min(len(steps) - 1, len(names)) and steps[same] == names[same]:
            same += 1
        del open_[same + 1 :], names[same:]
        for step in steps[same:]:
            node = [step, [], -1]
            open_[-1][1].append(node)
            open_.append(node)
            names.append(step)
        open_[-1][1].append(["#", [], number])
        if names and same < len(steps):
            open_.pop()
            names.pop()
    return root


def mark(path: str, text: str = "") -> int:
    """A hash of a slot, or of where it stands."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _contained(path: str) -> bool:
    """Whether a slot of an article stands in a container within it."""
    for step in reversed(path.split("/")):
        tag = step.split(".")[0]
        if tag in ("article", "main"):
            break
        if tag not in PLAIN:
            return True
    return False


def extract(text: str, template: set[int] | None) -> str:
    """The main text of a page; what is template goes, in an article if it stands in a container.

    :param template: none if too few pages of the host are known to tell what varies
    """
    found = blocks(parse(text))
    varying = [b for b in found if not template or mark(b.path, b.text) not in template]
    article = [b for b in found if b.in_article]
    if not article:
        return "\n".join(b.text for b in varying)
    kept = {id(b) for b in varying}
    own = [b for b in article if id(b) in kept or not _contained(b.path)] or article
    outside = [b for b in varying if not b.in_article] if template is not None else []
    passed_over = sum(len(b.text) for b in outside) > OUTSIDE * sum(len(b.text) for b in own)
    return "\n".join(b.text for b in (outside if passed_over else own))


# --- wrappers ---------------------------------------------------------------------------------------------------------

_SEEN = "host string, path long, slot long, pages long, size long, hash long"
_MATCHED = "host string, slot long, matched long, same long"
_TEXT = "page_id long, url string, text string, n_chars long"


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _by_host(frame: DataFrame) -> DataFrame:
    """A table of hosts to join pages with: broadcast if its measured size allows, else joined by a shuffle."""
    frame = checkpointed(frame)
    size = frame.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(frame) if size <= SENT else frame


def _seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages of a host a text or any text stands at a place (the text null), and each page that has a slot
    (the place null too)."""
    for part in batches:
        totals: dict[tuple[str, int, int | None], int] = {}
        pages = []
        for host, page, size, key in zip(*(part.column(c).to_pylist() for c in ("host", "html", "n", "h"))):
            slots = {(b.path, b.text) for b in blocks(parse(page))}
            if not slots:
                continue
            pages.append((host, None, None, 1, size, key))
            places = {path: mark(path) for path, _ in slots}
            for at in [(host, place, None) for place in places.values()] + [(host, places[path], mark(path, text)) for path, text in slots]:
                totals[at] = totals.get(at, 0) + 1
        out = pages + [(*at, n, None, None) for at, n in totals.items()]
        if out:
            columns = [list(c) for c in zip(*out)]
            yield batch(_SEEN, pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]))


def wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, template): the constant texts of each host with PAGES pages that have slots, as hashes of place and text.

    All pages of a host are aligned with its shortest page that has a slot (ties: the smallest hash). A text is constant
    too if it stands on nearly all pages of the host that have a text at its place. All sums are partial.
    """
    rows = pages.select(_host(url).alias("host"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.char_length("html").cast("long")).withColumn("h", F.xxhash64("html"))
    key = F.when(F.col("hash").isNotNull(), F.struct("size", "hash"))
    seen = rows.mapInArrow(_seen, _SEEN).groupBy("host", "path", "slot").agg(F.sum("pages").alias("pages"), F.min(key).alias("key"))
    seen = checkpointed(seen.where(F.col("pages") >= PAGES))
    hosts = seen.where("path is null").select("host", F.col("key.size").alias("n"), F.col("key.hash").alias("h"))
    reference = rows.join(_by_host(hosts), ["host", "n", "h"]).select("host", F.col("html").alias("reference"))
    reference = _by_host(reference.dropDuplicates(["host"]))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], list[Block], list]] = {}
        for part in batches:
            totals: dict[tuple[str, int], list[int]] = {}
            for host, page, ref in zip(*(part.column(c).to_pylist() for c in ("host", "html", "reference"))):
                if ref not in known:
                    if len(known) > 1000:
                        known.clear()
                    slots = blocks(parse(ref))
                    known[ref] = [mark(b.path, b.text) for b in slots], slots, _sized(slot_tree(slots))
                marks, slots, tree = known[ref]
                own = blocks(parse(page))
                for i, j in align(slot_tree(own), tree):
                    total = totals.setdefault((host, marks[j]), [0, 0])
                    total[0] += 1
                    total[1] += own[i].text == slots[j].text
            if totals:
                columns = [list(c) for c in (*zip(*totals), *zip(*totals.values()))]
                yield batch(_MATCHED, pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:]))

    sums = rows.join(reference, "host").mapInArrow(compare, _MATCHED).groupBy("host", "slot").agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))
    aligned = sums.where((F.col("same") >= CONSTANT * F.col("matched")) & (F.col("matched") >= PAGES)).select("host", "slot")
    places = seen.where("path is not null and slot is null").select("host", "path", F.col("pages").alias("matched"))
    counted = seen.where("slot is not null").select("host", "path", "slot", "pages").join(places, ["host", "path"])
    counted = counted.where(F.col("pages") >= CONSTANT * F.col("matched")).select("host", "slot")
    # Hosts without a constant text have an empty template.
    constant = aligned.union(counted).union(hosts.select("host", F.lit(None).cast("long").alias("slot")))
    return constant.groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("template"))


def html_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text, blocks joined by a newline, and its characters.

    Character references are decoded, white space in a block becomes one space. Null or empty pages and pages without
    an article have an empty text if all they hold is template. A null address counts as a host of its own. Repeated
    rows give equal rows; an empty table gives none. A very long page, or one of thousands of items in a row, takes time
    in proportion to its length, but for rows of children that have many different shapes between equal ends.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{source}`").cast("string").alias("html"), _host(url).alias("host"))
    joined = rows.join(_by_host(wrappers(pages, url, source)), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for page, template in zip(part.column("html"), part.column("template")):
                found.append(extract(page.as_py() or "", set(template.as_py()) if template.is_valid else None))
            yield batch(_TEXT, part.column("page_id"), part.column("url"), pa.array(found, pa.string()), np.array([len(t) for t in found], np.int64))

    return joined.mapInArrow(run, _TEXT)
