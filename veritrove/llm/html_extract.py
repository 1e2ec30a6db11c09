"""Main text of web pages by wrapper induction.

Pages of a host are parsed to DOM trees, apart by the outline of their frames, as a host
may have several templates. Of each template the commonest tree without texts is the
reference, and every page is aligned with it by simple tree matching: the largest
top-down matching of nodes with equal elements and names that keeps the order of
siblings. What a reference's node is matched with on all pages is a slot. How many of all the host's differing
pages have a slot, and how many have one text there, is counted in one
aggregation that takes every page: a slot whose text is the same on nearly all
pages that have its parent is template; what varies is content and is kept. Template goes on every page, but in
an article only where a whole container is, and a heading stays where what follows it varies. Nodes that the reference lacks
are slots by their elements and names below the last node that it has. Within an
article or main element, where a page has one, and else within the body, parts
that by their element or name are navigation, notices, adverts, forms,
scripts, styles or reader comments go too.

Runs of equal siblings are one slot, so a paragraph that many articles share
stays where the run it stands in varies.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

#: Pages of one host in a group: groups are of this size on average, at most, or of a MOST_HOSTS-th of all pages.
GROUP_PAGES = 128
#: Hosts larger than a group, at most: what is broadcast about them.
MOST_HOSTS = 1 << 20
#: A text is template from so many differing pages on, and so large a share of the pages that have its parent.
#: A slot that its name puts in doubt is content if no text of it is on VARIES of the pages that have it.
LEAST_PAGES, TEMPLATE_SHARE, VARIES = 3, 0.8, 0.5
#: A template has a reference if so large a share of its host's pages is of it (so a host has a thousand at most); bytes of a reference at most.
#: Pages of others are aligned by elements and names from the root.
KIND_SHARE, REFERENCE_BYTES = 0.001, 1 << 16
#: Elements are nested so deep at most; what is deeper goes to the last of them. Cells of a matching of two lists of children
#: after equal ends are cut off; larger ones are matched by rows, to the same result.
MAX_DEPTH, MOST_CELLS = 200, 40_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
DROPPED = frozenset(
    "nav footer header aside form script style noscript template iframe object embed svg canvas button select textarea input dialog head title menu figure-toolbar".split()
)
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
#: Words in a class, id or role that name what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist discussion disqus cookie cookies consent gdpr "
    "footer header masthead menu nav navbar navigation newsletter notice notices notification pagination paywall pager popup modal overlay promo promoted related "
    "recommended share sharing sidebar side-bar aside social sponsor sponsored subscribe subscription toolbar widget widgets replies reply respond login signup search skip contentinfo complementary topbar".split()
)
#: What a class may add to such a word without naming content.
BOXES = frozenset("area bar block bottom box button buttons container floating form head icon icons image inner item items left links list outer panel right row section small top wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Of these, words that are also headings' own, as ids made from titles are: within an article an id of these says nothing.
TITLES = frozenset(
    "advertisement advertising banner comment comments cookie cookies consent discussion gdpr menu navigation newsletter notice notices notification pagination promoted related recommended share sharing "
    "social sponsor sponsored subscription replies reply search respond".split()
) - {"comments"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the left that one of the right closes.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")), "option": frozenset(("option",)), "tbody": frozenset(("tr", "td", "th", "thead", "tbody")),
}
SCOPE = frozenset(("ul", "ol", "table", "dl", "select", "div", "article", "section", "main", "body", "td", "th", "nav", "aside", "footer", "header", "form"))

#: Elements whose own text takes inline elements along, whatever their names.
TEXT_BLOCKS = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre".split())

# quotes count after an equals sign only; what isn't closed goes on to the end, so no place is read twice
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NUMBER = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    tag: str
    name: str = ""  # class, role
    id: str = ""
    within: bool = False  # an article or main element
    hidden: bool = False
    children: list = field(default_factory=list)  # Nodes and texts (str)
    holds: bool = False  # an article or main element is in it
    template: bool = False  # by its host's wrapper
    bare: bool = False  # its own text is
    varying: bool = False  # so its name may mislead
    spoken: bool = False  # it has text of its own
    up: Node | None = None


def parse(html: str) -> Node:
    """A tree of the page, with unclosed and crossed elements closed as browsers mostly do."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)

    def text(a: int, z: int) -> None:
        if a < z:
            stack[-1].children.append(html[a:z])
            stack[-1].spoken = stack[-1].spoken or not html[a:z].isspace()

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in ("body", "html"):
                continue  # what follows belongs to the body, as in browsers
            if any(x.tag == tag for x in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        closing = CLOSES.get(tag) or (frozenset(("p",)) if tag in BLOCKS and tag != "br" else None)
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in closing:
                    break
        name, own_id, hidden = "", "", False
        attributes = m.group(4)
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key == "id":
                    own_id = value.lower().strip()
                elif key in ("class", "role"):
                    name += " " + value.lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        top = stack[-1]
        node = Node(tag, name.strip(), own_id, top.within or top.tag in ("article", "main"), hidden, up=top)
        top.children.append(node)
        if tag == "main" or tag == "article" and not _named(node, NAMES):
            if not any(_named(x, COMMENTS) for x in stack):
                for x in stack:
                    x.holds = True
        if tag in VOID or (attributes or "").rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            body = html[at : end.start()] if end else html[at:]
            if body:
                node.children.append(body)
            at = end.end() if end else n
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _whole(x: Node, names: frozenset[str]) -> bool:
    """A name of the node is one of these: classes and roles, and ids but those that titles make."""
    if x.id in names and x.tag not in HEADINGS and not (x.within and x.id in TITLES):
        return True
    return bool(x.name) and any(w in names for w in x.name.split())


def _named(x: Node, names: frozenset[str]) -> bool:
    """So is a part of its classes and roles; parts of ids say nothing."""
    return _whole(x, names) or bool(x.name) and any(w in names for w in re.split(r"[\s_]+|-(?=[a-z])", x.name) if w)


def _compound(x: Node, names: frozenset[str]) -> bool:
    """So is a class or role all of whose parts are such names or say only what kind of box it is."""
    return _whole(x, names) or any(set(p := w.split("-")) & names and set(p) <= names | BOXES for w in x.name.split() if "-" in w)


def _in_article(x: Node) -> bool:
    return x.within and (x.up.tag == "article" or _in_article(x.up))


def is_dropped(x: Node) -> bool:
    """By the wrapper, by element, or by name; names don't drop a page's frame, nor what holds its article, nor a
    link or phrase within a sentence. An article's own header stays.

    A part of a class doesn't drop headings, nor what varies over the host's pages, and within an article only
    classes drop that name nothing else."""
    if x.template or x.hidden or x.tag in DROPPED and not (x.tag == "header" and _in_article(x)):
        return True
    if x.holds or x.tag in ("html", "body", "main") or x.tag not in BLOCKS and x.up is not None and x.up.spoken and x.up.tag in TEXT_BLOCKS:
        return False
    return (_whole if x.tag in HEADINGS else _compound if x.name and _in_article(x) else _whole if x.varying else _named)(x, NAMES)


def runs_of(x: Node) -> list[list[Node]]:
    """Children that elements don't drop; runs of equal siblings are one, but for containers."""
    runs: list[list[Node]] = []
    for c in x.children:
        if isinstance(c, str) or c.hidden or c.tag in VOID or c.tag in DROPPED and not (c.tag == "header" and _in_article(c)):
            continue
        if runs and c.tag not in REGIONS and (runs[-1][0].tag, runs[-1][0].name) == (c.tag, c.name):
            runs[-1].append(c)
        else:
            runs.append([c])
    return runs


@dataclass(slots=True)
class Frame:
    """A container's runs, which of them a name puts in doubt, the frames of those that are containers, and its outline."""

    runs: list
    doubts: list
    inner: list
    outline: tuple  # tag, name, outlines of the runs


def frame_of(x: Node) -> Frame:
    runs, doubts, inner, kids = [], [], [], []
    for run in runs_of(x):
        c = run[0]
        doubt = is_dropped(c)
        if doubt and _whole(c, NAMES):
            continue
        below = frame_of(c) if c.tag in REGIONS and not doubt else None
        runs.append(run)
        doubts.append(doubt)
        inner.append(below)
        kids.append(below.outline if below else (c.tag, NUMBER.sub("#", c.name)))
    return Frame(runs, doubts, inner, (x.tag, NUMBER.sub("#", x.name), *kids))


def match(a: tuple, b: tuple, memo: dict) -> int:
    """Simple tree matching: nodes in the largest common top-down, order-keeping matching of two outlines."""
    if a[:2] != b[:2]:
        return 0
    if a is b or a == b:
        return _size(a)
    key = (id(a), id(b))
    if key not in memo:
        x, y = a[2:], b[2:]
        memo[key] = 1 + sum(match(x[i], y[j], memo) for i, j in matched(x, y, memo))
    return memo[key]


def matched(x: tuple | list, y: tuple | list, memo: dict) -> list[tuple[int, int]]:
    """Places of the children that the best matching of two lists pairs."""
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    tail = 0
    while tail < min(len(x), len(y)) - start and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    m, n = len(x) - start - tail, len(y) - start - tail
    middle: list[tuple[int, int]] = []
    if m * n > MOST_CELLS:
        middle = _many_matched(x[start : start + m], y[start : start + n], memo)
    elif m and n:
        w = [[0] * (n + 1) for _ in range(m + 1)]
        own = [[match(p, q, memo) for q in y[start : start + n]] for p in x[start : start + m]]
        for i in range(m):
            for j in range(n):
                w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + own[i][j])
        i, j = m, n
        while i and j:
            if own[i - 1][j - 1] and w[i][j] == w[i - 1][j - 1] + own[i - 1][j - 1]:
                i, j = i - 1, j - 1
                middle.append((i, j))
            elif w[i][j] == w[i - 1][j]:
                i -= 1
            else:
                j -= 1
        middle.reverse()
    ends = [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(start)] + [(start + i, start + j) for i, j in middle] + ends


def _many_matched(x: tuple | list, y: tuple | list, memo: dict) -> list[tuple[int, int]]:
    """The same matching by whole rows: some rows of the table are kept, and those between them made again on the way back."""
    kinds_x, kinds_y = {}, {}
    a = np.array([kinds_x.setdefault(c, len(kinds_x)) for c in x])
    b = np.array([kinds_y.setdefault(c, len(kinds_y)) for c in y])
    own = np.array([[match(p, q, memo) for q in kinds_y] for p in kinds_x], np.int64)
    step = max(1, math.isqrt(len(x)))

    def following(row: np.ndarray, i: int) -> np.ndarray:
        return np.r_[0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + own[a[i]][b]))]

    row, kept = np.zeros(len(y) + 1, np.int64), []
    for i in range(len(x)):
        if i % step == 0:
            kept.append(row)
        row = following(row, i)
    out: list[tuple[int, int]] = []
    j = len(y)
    for low in range((len(x) - 1) // step * step, -1, -step):
        rows = [kept[low // step]]
        for i in range(low, min(low + step, len(x))):
            rows.append(following(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            score = own[a[low + i - 1], b[j - 1]]
            if score and rows[i][j] == rows[i - 1][j - 1] + score:
                i, j = i - 1, j - 1
                out.append((low + i, j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def _size(a: tuple) -> int:
    return 1 + sum(_size(x) for x in a[2:])


def all_text(x: Node) -> int:
    """Characters of text below a node, without dropped parts."""
    return sum(len(c) if isinstance(c, str) else 0 if is_dropped(c) else all_text(c) for c in x.children)


REGIONS = frozenset("html body div section article main center table tbody tr td".split())


def _hash(*parts) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _plain(text: str) -> str:
    """White space as one space, none at the ends."""
    return " ".join(text.split())


def _raw(x: Node) -> str:
    return "".join(c if isinstance(c, str) else f" {_raw(c)} " for c in x.children)


def _kind(root: Node) -> int:
    """What template the page is of: elements and names of the parts of its frame. All paths begin with it."""
    at = root
    while True:
        kids = [c for c in at.children if isinstance(c, Node) and c.tag not in VOID and not is_dropped(c)]
        if len(kids) != 1 or kids[0].tag not in REGIONS or kids[0].tag in ("article", "main"):
            break
        at = kids[0]
    return _hash(*sorted({f"{c.tag} {NUMBER.sub('#', c.name)}" for c in kids if c.tag in REGIONS or c.name}))


def slots(root: Node, references: dict[int, tuple]) -> list[tuple[int, int, int, bool, list[Node], bool]]:
    """(slot, parent's slot, text or 0 for a container, in doubt, nodes, own text only) of a page, aligned with its template's reference.

    Slots begin with the page's kind. Containers are gone into; runs of other equal siblings are one slot."""
    out: list = []
    memo: dict = {}

    def walk(x: Node, f: Frame, path: int, reference: tuple | None) -> None:
        own = _plain(" ".join(c for c in x.children if isinstance(c, str))) if x.spoken else ""
        if own:
            out.append((_hash(path, "#text"), path, _hash(own), False, [x], True))
        place = dict(matched(f.outline[2:], reference[2:], memo)) if reference else {}
        for k, (run, doubt, inner) in enumerate(zip(f.runs, f.doubts, f.inner)):
            c = run[0]
            at = _hash(path, place[k]) if k in place else _hash(path, c.tag, NUMBER.sub("#", c.name))
            if inner:
                out.append((at, path, 0, False, run, False))
                walk(c, inner, at, reference[2 + place[k]] if k in place else None)
            elif text := _plain(" ".join(map(_raw, run))):
                out.append((at, path, _hash(text), doubt, run, False))

    kind = _kind(root)
    out.append((kind, kind, 0, False, [root], False))
    walk(root, frame_of(root), kind, references.get(kind))
    return out


def apply_wrapper(root: Node, template: set[tuple[int, int]], varying: set[int], references: dict[int, tuple]) -> Node:
    """Marks the page's nodes: template where slot and text are, varying where a slot in doubt is.

    Within an article template goes only as a whole container: what stands beside text that varies is part of the article,
    as a house style's headings and by-lines are. Elsewhere headings stay where what follows them varies."""
    found = slots(root, references)
    parts: dict[int, list[int]] = {}
    for k, (_, parent, *_) in enumerate(found):
        parts.setdefault(parent, []).append(k)
    fixed = [False] * len(found)
    for k in range(len(found) - 1, 0, -1):  # what is in a container comes after it; the first is the page itself
        path, _, text, *_ = found[k]
        fixed[k] = (path, text) in template if text else all(fixed[j] for j in parts.get(path, ()) if j > k)
    whole = {path: fixed[k] for k, (path, _, text, *_) in enumerate(found) if not text}
    after = {j: i for ks in parts.values() for j, i in zip(ks, ks[1:])}
    for k, (path, parent, text, doubt, nodes, own) in enumerate(found):
        x = nodes[0]
        box = x if own else x.up
        if text and (path, text) in template:
            if box.tag == "article" or _in_article(box):
                stays = box.tag == "article" or not whole.get(parent, False)
            else:
                stays = x.tag in HEADINGS and not own and k in after and not fixed[after[k]]
            for x in nodes if not stays else ():
                x.bare, x.template = x.bare or own, x.template or not own
        elif text and doubt and path in varying:
            for x in nodes:
                x.varying = True
    return root


def region(root: Node, induced: bool) -> Node:
    """The article element, or all that stand side by side with the longest, else main, else what a name marks unless a wrapper
    was induced, else the body."""
    for tag in ("article", "main"):
        found = [x for x in _elements(root, tag)]
        if len(found) == 1:
            return found[0]
        if found:
            whole = [x for x in _elements(root, "main")]
            longest = max(found, key=all_text)
            beside = [x for x in found if x.up is longest.up]
            return whole[0] if len(whole) == 1 else longest if len(beside) == 1 else Node("div", children=beside)
    marked = [] if induced else [x for x in _every(root) if re.search(r"\b(main|article(?:body)?|post|entry-content|story|content)\b", f"{x.name} {x.id}")]
    if marked:
        return max(marked, key=all_text)
    return next(iter(_elements(root, "body")), root)


def _every(x: Node) -> Iterator[Node]:
    for c in x.children:
        if isinstance(c, Node) and not is_dropped(c):
            yield c
            yield from _every(c)


def _elements(x: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag outside dropped parts."""
    out = []
    for c in x.children:
        if isinstance(c, Node) and not is_dropped(c):
            if c.tag == tag:
                out.append(c)
            else:
                out.extend(_elements(c, tag))
    return out


def block_text(x: Node) -> str:
    """The region's texts in page order: a line for each block."""
    lines: list[str] = []
    now: list[str] = []

    def close() -> None:
        line = _plain(entities.unescape("".join(now)))
        now.clear()
        if line:
            lines.append(line)

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                now.append(" " if x.bare else c)
            elif not is_dropped(c):
                block = c.tag in BLOCKS
                if block:
                    close()
                walk(c)
                if block:
                    close()

    walk(x)
    close()
    return "\n".join(lines)


def extract_group(htmls: list[str]) -> list[str]:
    """Main texts of all pages of one host, by the rules of host_references() and host_wrappers()."""
    trees = [parse(h) for h in htmls]
    kinds = Counter((_kind(t), packed_outline(t)) for t in trees)
    pages_of = Counter()
    for (kind, _), n in kinds.items():
        pages_of[kind] += n
    references = {}
    for kind, n in pages_of.items():
        best = max(((m, o) for (k, o), m in kinds.items() if k == kind and o), default=None)
        if best and n >= LEAST_PAGES and n >= KIND_SHARE * len(trees):
            references[kind] = pickle.loads(best[1])
    texts: dict[tuple[int, int, int, bool], set[str]] = {}
    for tree, html in zip(trees, htmls):
        for path, parent, text, doubt, *_ in slots(tree, references):
            texts.setdefault((path, parent, text, doubt), set()).add(html)
    n = {k: len(v) for k, v in texts.items()}
    pages = {path: count for (path, _, text, _), count in n.items() if not text}
    template = {(path, text) for (path, parent, text, _), count in n.items() if text and count >= LEAST_PAGES and count >= TEMPLATE_SHARE * pages[parent]}
    total, most = Counter(), Counter()
    for (path, _, _, doubt), count in n.items():
        if doubt:
            total[path] += count
            most[path] = max(most[path], count)
    varying = {path for path in total if total[path] >= LEAST_PAGES and most[path] < VARIES * total[path]}
    return [block_text(region(apply_wrapper(t, template, varying, references), bool(template))) for t in trees]


def packed_outline(root: Node) -> bytes:
    """The outline of a page's tree; b'' where it is too large for a reference."""
    packed = pickle.dumps(frame_of(root).outline, 5)
    return packed if len(packed) <= REFERENCE_BYTES else b""


def host_references(p: DataFrame) -> DataFrame:
    """host, refs: the references of each host's templates, as (kind, outline) rows. Partly summed before they are dealt out."""

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                tree = parse(html)
                n[host, _kind(tree), packed_outline(tree)] += 1
            columns = [[k[0] for k in n], [k[1] for k in n], [k[2] for k in n], list(n.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], names=["host", "kind", "outline", "n"])

    found = p.select("host", "html").mapInArrow(run, "host string, kind long, outline binary, n long")
    n = found.groupBy("host", "kind", "outline").agg(F.sum("n").alias("n"))
    kinds = n.groupBy("host", "kind").agg(F.sum("n").alias("n"), F.max(F.when(F.length("outline") > 0, F.struct("n", "outline"))).alias("best"))
    kinds = written(kinds, "kinds")
    pages = kinds.groupBy("host").agg(F.sum("n").alias("pages"))
    kept = kinds.join(pages, "host").where(F.col("best").isNotNull() & (F.col("n") >= LEAST_PAGES) & (F.col("n") >= KIND_SHARE * F.col("pages")))
    # a thousand a host at most
    return written(kept.groupBy("host").agg(F.collect_list(F.struct("kind", F.col("best.outline").alias("outline"))).alias("refs")), "references")


class References:
    """The references in a column of refs, each host's unpacked once."""

    def __init__(self):
        self.known: dict[str, dict[int, tuple]] = {}

    def of(self, host: str, refs: pa.Scalar) -> dict[int, tuple]:
        if host not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[host] = {r["kind"]: pickle.loads(r["outline"]) for r in refs.as_py() or ()}
        return self.known[host]


def host_wrappers(p: DataFrame, references: DataFrame) -> DataFrame:
    """host, path, text of the template of each host, and with null text the slots in doubt that vary, from all its pages.

    Copies of a page count once. Counts are partly summed before they are dealt out, so a host may be of any size."""

    def run(batches):
        refs = References()
        for b in batches:
            rows = []
            for host, html, r in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("refs")):
                page = _hash(html)
                rows += {(host, path, parent, text, doubt, page) for path, parent, text, doubt, *_ in slots(parse(html), refs.of(host, r))}
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["host", "path", "parent", "text", "doubt", "page"])

    found = p.select("host", "html").join(references, "host", "left").mapInArrow(run, "host string, path long, parent long, text long, doubt boolean, page long")
    n = found.groupBy("host", "path", "parent", "text", "doubt").agg(F.countDistinct("page").alias("n"))
    n = written(n.where(f"n >= {LEAST_PAGES} or doubt"), "slots")
    pages = n.where("text = 0").select("host", F.col("path").alias("parent"), F.col("n").alias("pages"))
    template = n.where(f"text <> 0 and n >= {LEAST_PAGES}").join(pages, ["host", "parent"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select("host", "path", "text")
    doubt = n.where("doubt").groupBy("host", "path").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    varying = doubt.where((F.col("total") >= LEAST_PAGES) & (F.col("most") < VARIES * F.col("total")))
    return template.union(varying.select("host", "path", F.lit(None).cast("long").alias("text")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null or empty html gives ''. Hosts are the url's (null or odd urls: ''),
    and a host's pages are dealt to groups of GROUP_PAGES on average by a hash
    of the page, so a host of any size is spread. Repeated rows come back each; extra
    columns are ignored; an empty table gives an empty result."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    limit = max(GROUP_PAGES, -(-pages.count() // MOST_HOSTS))
    # hosts of over `limit` pages are fewer than MOST_HOSTS, so their sizes may be broadcast; html is only dealt once, by group
    sizes = p.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", F.ceil(F.col("n") / limit).cast("int").alias("groups"))
    references = host_references(p)
    known = host_wrappers(p, references).select("host", "path", "text", F.lit(None).cast(references.schema["refs"].dataType).alias("refs"))
    known = known.union(references.select("host", F.lit(None).cast("long"), F.lit(None).cast("long"), "refs")).join(F.broadcast(sizes), "host", "left")
    groups = F.sequence(F.lit(0).cast("long"), F.coalesce("groups", F.lit(1)).cast("long") - 1)
    wrappers = known.select("host", "path", "text", "refs", F.explode(groups).alias("part"))

    def run(key, table, wrapper):
        template, varying, references = set(), set(), {}
        for path, text, refs in zip(wrapper.column("path").to_pylist(), wrapper.column("text").to_pylist(), wrapper.column("refs")):
            if path is None:
                references = References().of("", refs)
            elif text is None:
                varying.add(path)
            else:
                template.add((path, text))
        texts = [block_text(region(apply_wrapper(parse(h), template, varying, references), bool(template))) for h in table.column("html").to_pylist()]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    p = p.join(F.broadcast(sizes), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", F.xxhash64("html")), F.coalesce("groups", F.lit(1))).cast("long"))
    p = p.select("host", "part", "page_id", "url", "html")
    return p.groupBy("host", "part").cogroup(wrappers.groupBy("host", "part")).applyInArrow(run, "page_id long, url string, text string, n_chars long")
