"""Main text of web pages by wrappers inferred for each host.

Pages of one host come from few templates. A wrapper is a union-free regular
expression over tags and text slots. Each page's token stream is folded
(tandem repeats become repeated groups) and aligned with the wrapper so far;
a mismatch makes a group repeated where one side holds more copies of it, or
else optional, and a slot whose text differs becomes variable. Tasks infer
wrappers from the pages they hold, and those are aligned with each other, in two
steps for each host, until one is left.

The finished wrapper says where the host's article is: in the element, from the
root down, that holds most of the text that varies from page to page and isn't
links. Main and article elements add to a region's weight, names of classes and
forms lessen it. Slots that are alike on different pages are template text,
unless they lie in a main or article element. Only a page that has nothing where
its host's article is, is looked through on its own.
"""

from __future__ import annotations

import html as markup
import json
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm.textnum import chunks, text_array
from photolake.session import stash, table, use_package

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"=\s*[\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Tags that don't part one block of text from the next.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no markup.
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
#: Tags whose regions are never the article.
OUTSIDE = frozenset("head title nav footer aside form button select option datalist dialog menu noscript template svg math object canvas audio video map script style iframe noembed noframes xmp textarea".split())
#: Tags that hold regions, as against a block of text of its own.
HOLDS = frozenset("html body main article section div center table tbody tr td form header".split())
MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that mark a region as not the article, wherever it lies.
MARKED = re.compile(
    r"(?:^|[\W_])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|discussion|consent|cookies?|gdpr|dialog|modal|popup|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|sidebar|widget|promo\w*|sponsor\w*|menu|nav|navbar|navigation|toolbar|topbar|masthead|site-header|page-header|pagination|pager|skip-link|skip-to-\w+|complementary|contentinfo)(?:$|[\W_\d])",
    re.I,
)
#: Words that mark one outside main and article only, and only as a whole name: inside they may well name a part of the text.
MARKED_OUTSIDE = frozenset("notice notices alert alerts reply replies respond search side rail footer tags skip legal disclaimer hidden".split())
#: Words of a name that mark a region inside the article, if all its other words say nothing (PLAIN): "share-buttons", but not "market-share".
MARKED_INSIDE = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|gdpr|dialog|modal|popup|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|sidebar|widget|promo\w*|sponsor\w*|menu|nav|navbar|navigation|toolbar|topbar|masthead|pagination|pager|complementary|contentinfo|notices?|alerts?|repl(?:y|ies)",
    re.I,
)
PLAIN = frozenset(
    "0 area article articles bar block body bottom box button buttons by card cards component container content count entry footer form group header heading holder icon icons inline inner item items left link links list message module more news outer page panel post posts right row section site slot stories story text thread title to tools top unit us wrap wrapper".split()
)
#: Stands in a node for an element that isn't shown.
HIDDEN = "!hidden"
UNSEEN = re.compile(r"\bstyle\s*=[^>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
IS_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
#: What closes an open element of the same kind by beginning.
CLOSES = {t: frozenset((t,)) for t in ("p", "li", "tr", "option")} | {t: frozenset(("td", "th")) for t in ("td", "th")} | {t: frozenset(("dt", "dd")) for t in ("dt", "dd")}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SLOT = "#"
#: Elements nested deeper than this count as part of the one that deep.
DEPTH = 200
#: A longer name of an element with its class, id and role is kept as its words that are looked at, and a digest.
NAME = 200
#: Streams whose lengths multiply to more are cut at items that both hold once before they are aligned.
AT_ONCE = 4_000_000
#: Times that a main or article element counts.
EVIDENCE = 4.0


def _tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text, closing, tag name, attributes) pieces of a page in one pass: a text has no tag name.

    Quotes count after "=" only, until one of them is never closed. A tag
    without an end is text; a comment without one goes on to the page's end.
    """
    at, size, quotes = 0, len(page), True
    unclosed: set[str] = set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], False, "", ""
            return
        if lt > at:
            yield page[at:lt], False, "", ""
        m = OPENING.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif after and after in "!?/":
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "<", False, "", ""
                at = lt + 1
            continue
        here = m.end()
        end = page.find(">", here)
        if end < 0:
            yield page[lt:], False, "", ""
            return
        while quotes and (q := QUOTE.search(page, here, end)):
            here = page.find(q[0][-1], q.end()) + 1
            if not here:
                quotes = False
            elif here > end:
                end = page.find(">", here)
                if end < 0:
                    quotes, end = False, page.find(">", m.end())
        name, attributes = m[2].lower(), page[m.end() : end]
        at = end + 1
        yield "", bool(m[1]), name, attributes
        if name in RAW and not m[1] and name not in unclosed:
            closing = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if closing:
                at = closing.start()
            else:
                unclosed.add(name)


def _open_name(name: str, attributes: str) -> str:
    if not attributes:
        return name
    found = " ".join(v for _, *vs in ATTRIBUTE.findall(attributes) for v in vs if v) if "=" in attributes else ""
    marks = re.sub(r"\d+", "0", found).replace("/", " ").strip()
    low = attributes.lower()
    if ("hidden" in low and IS_HIDDEN.search(VALUE.sub("=", attributes))) or ("style" in low and UNSEEN.search(attributes)):
        marks = f"{marks} {HIDDEN}".strip()
    node = f"{name} {marks}" if marks else name
    if len(node) > NAME:
        looked_at = [x for x in dict.fromkeys(marks.split()) if x in ("main", HIDDEN) or _marked(x, False) or _marked(x, True)]
        node = " ".join((name, *looked_at, f"_{_digest(marks):x}"))
    return node


def read(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The page's tokens (block tags and slots) and its slots as (path of open tags, text). Inline tags stay within the text they are in, marked ones part it."""
    return _scan(page)[:2]


def _scan(page: str) -> tuple[list[str], list[tuple[str, str]], list[int], list[int]]:
    """What read() gives, and for each slot the number of the innermost article element that it lies in (0: none), and how many of its characters are links."""
    tokens: list[str] = []
    slots: list[tuple[str, str]] = []
    regions: list[int] = []
    links: list[int] = []
    outer, count = 0, 0  # depth of the stack inside the outermost main or article element (0: none), and number of articles so far
    articles: list[tuple[int, int]] = []  # depth and number of the open ones
    stack: list[tuple[str, str]] = []  # (tag, node)
    paths = [""]
    open_tags: dict[str, int] = {}
    within: list[int] = []  # for each open inline tag: unmarked ones of its name open inside it
    text: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(markup.unescape("".join(text)).split())
            text.clear()
            if said:
                tokens.append(SLOT)
                slots.append((paths[min(len(stack), DEPTH)], said))
                regions.append(articles[-1][1] if articles else 0)
                links.append(min(linked, len(said)))
            linked = 0

    def close(at: int) -> None:
        nonlocal outer
        if at < outer:
            outer = 0
        while articles and at < articles[-1][0]:
            articles.pop()
        while len(stack) > at:
            within.pop()
            tag, node = stack.pop()
            open_tags[tag] -= 1
            tokens.append("/" + node)
        del paths[min(at, DEPTH) + 1 :]

    def nearest(name: str) -> int | None:
        """The innermost open inline tag of a name, above the nearest block."""
        if open_tags.get(name):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    return i
                if stack[i][0] not in INLINE:
                    return None
        return None

    for said, closing, name, attributes in _tokens(page):
        if not name:
            text.append(said)
            if in_link:
                linked += len(said)
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            text.append(" ")
        if name in INLINE or name == "br":
            if closing:
                if (at := nearest(name)) is not None:
                    if within[at]:
                        within[at] -= 1
                    else:
                        flush()
                        close(at)
                continue
            if name in VOID or not _marked(_open_name(name, attributes).partition(" ")[2], bool(outer)):
                if name not in VOID and name != "br" and not attributes.rstrip().endswith("/") and (at := nearest(name)) is not None:
                    within[at] += 1
                continue
        flush()
        if closing:
            if open_tags.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in VOID:
            continue
        if name in CLOSES or name in ENDS_P:
            ends = CLOSES.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
            if any(open_tags.get(x) for x in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
        if not attributes.rstrip().endswith("/"):
            node = _open_name(name, attributes)
            stack.append((name, node))
            open_tags[name] = open_tags.get(name, 0) + 1
            if len(stack) <= DEPTH:
                paths.append(f"{paths[-1]}/{node}" if len(stack) > 1 else node)
            within.append(0)
            if not outer and _is_main(node):
                outer = len(stack)
            if name == "article":
                count += 1
                articles.append((len(stack), count))
            tokens.append(node)
    flush()
    close(0)
    return tokens, slots, regions, links


@lru_cache(1 << 14)
def _marked(marks: str, inside: bool) -> bool:
    """Whether a class, id or role says that a region isn't part of an article, or it isn't shown."""
    if not marks:
        return False
    names = marks.lower().split()
    if HIDDEN in names:
        return True
    if not inside:
        return bool(MARKED.search(marks)) or not MARKED_OUTSIDE.isdisjoint(names)
    return any(_names_other(x) for x in names)


def _names_other(name: str) -> bool:
    words = [x for x in re.split(r"[\W_]+", name) if x]
    marked = [bool(MARKED_INSIDE.fullmatch(x.rstrip("0"))) for x in words]
    return any(marked) and all(m or x in PLAIN for x, m in zip(words, marked, strict=True))


# A wrapper's item: [tokens of its body, repeated, optional, texts of its slots, path of each slot, keys of pages that hold it, sizes of each slot].
# A slot's texts are a list of digests, one for each copy of a repeated group (None: variable). Its sizes are characters, those in links, and texts, over all pages.

#: Page keys kept for an item: enough to tell that it is on more than one page.
KEYS = 2


def _digest(said: str) -> int:
    return int.from_bytes(blake2b(said.encode("utf-8", "replace"), digest_size=7).digest())


def _items(tokens: list[str], slots: list[tuple[str, str]], page: int = 0, links: list[int] | None = None) -> list[list]:
    at = iter(zip(slots, links or [0] * len(slots), strict=True))
    out = []
    for t in tokens:
        if t == SLOT:
            (path, said), linked = next(at)
            out.append([[t], False, False, [[_digest(said)]], [path], [page], [[len(said), linked, 1]]])
        else:
            out.append([[t], False, False, [], [], [page], []])
    return out


def _body(x: list) -> tuple[str, ...]:
    return tuple(x[0])


def _join_texts(a: list, b: list) -> list:
    return [p if p == q else None for p, q in zip(a, b, strict=True)]


def _join_sizes(a: list, b: list) -> list:
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def _copies(parts: list[list]) -> list:
    """Texts of a group's slots over all its copies."""
    return [None if any(t is None for t in own) else [d for t in own for d in t] for own in zip(*parts, strict=True)]


def _keys(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:KEYS]


def _periods(keys: list[tuple[str, ...]], above: int) -> int | None:
    """The least period above one of which some stretch of the keys is a repeat."""
    code: dict[tuple[str, ...], int] = {}
    at = np.array([code.setdefault(k, len(code)) for k in keys])
    order = np.argsort(at, kind="stable")
    gaps = np.diff(order)[at[order[1:]] == at[order[:-1]]] if len(at) > 1 else np.zeros(0, int)
    # Of a repeat of period p some item has its next like one at p, or it is made of shorter repeats.
    for p in np.unique(gaps[gaps > above]).tolist():
        same = np.concatenate([[0], at[p:] == at[:-p], [0]])
        edges = np.flatnonzero(np.diff(same))
        if len(edges) and (edges[1::2] - edges[::2]).max() >= p:
            return p
    return None


def fold(items: list[list]) -> list[list]:
    """Tandem repeats become one repeated group each, short ones first, so that groups nest."""
    period = 0
    while (period := _periods([_body(x) for x in items], period)) is not None:
        out: list[list] = []
        i = 0
        keys = [_body(x) for x in items]
        while i < len(items):
            n = 1
            if i + period < len(keys) and keys[i] == keys[i + period]:
                while keys[i : i + period] == keys[i + n * period : i + (n + 1) * period] and len(keys[i : i + period]) == period:
                    n += 1
            if n > 1:
                body = [t for x in items[i : i + period] for t in x[0]]
                parts = [items[i + k * period : i + (k + 1) * period] for k in range(n)]
                texts = _copies([[t for x in own for t in x[3]] for own in parts])
                sizes = [[sum(v) for v in zip(*own, strict=True)] for own in zip(*([z for x in part for z in x[6]] for part in parts), strict=True)]
                out.append([body, True, False, texts, [p for x in items[i : i + period] for p in x[4]], items[i][5], sizes])
                i += n * period
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _gather(items: list[list], bodies: set[tuple[str, ...]]) -> list[list]:
    """Single copies of groups that the other side repeats become items of their own, so that they align."""
    longest = max((len(b) for b in bodies), default=0)
    out, i = [], 0
    while i < len(items):
        body: tuple[str, ...] = ()
        for j in range(i, min(i + longest, len(items))):
            body += _body(items[j])
            if body in bodies and j > i:
                part = items[i : j + 1]
                out.append([list(body), False, any(x[2] for x in part), [t for x in part for t in x[3]], [p for x in part for p in x[4]], min((x[5] for x in part), key=len), [z for x in part for z in x[6]]])
                i = j + 1
                break
            if len(body) > longest:
                out.append(items[i])
                i += 1
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of what both hold once, as far as it stands in one order."""
    once = lambda x: {k: i for i, k in enumerate(x) if n[k] == 1} if (n := Counter(x)) else {}
    in_a, in_b = once(a), once(b)
    pairs = sorted((i, in_b[k]) for k, i in in_a.items() if k in in_b)
    tails: list[int] = []  # longest increasing run of places in b
    links: list[tuple[int, int]] = []
    ends: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        links.append((n, ends[k - 1] if k else -1))
        if k == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = links[n][1]
    return out[::-1]


def _opcodes(a: list, b: list) -> Iterator[tuple[str, int, int, int, int]]:
    """How a becomes b, as SequenceMatcher says it; long ones are cut at their anchors, and what is long without any counts as replaced."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head:
        yield "equal", 0, head, 0, head
    ends = (len(a) - tail, len(b) - tail)
    cuts = [ends] if (ends[0] - head) * (ends[1] - head) <= AT_ONCE else [*((i + head, j + head) for i, j in _anchors(a[head : ends[0]], b[head : ends[1]])), ends]
    at = (head, head)
    for cut in cuts:
        (i, j), (k, m) = at, cut
        if (k - i) * (m - j) <= AT_ONCE:
            for kind, i1, i2, j1, j2 in SequenceMatcher(None, a[i:k], b[j:m], autojunk=False).get_opcodes():
                yield kind, i + i1, i + i2, j + j1, j + j2
        else:
            yield "replace", i, k, j, m
        if cut != ends:
            yield "equal", k, k + 1, m, m + 1
        at = (k + 1, m + 1)
    if tail:
        yield "equal", ends[0], len(a), ends[1], len(b)


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for whatever either wrapper stands for."""
    groups_a, groups_b = {_body(x) for x in a if x[1]}, {_body(x) for x in b if x[1]}
    a, b = _gather(a, groups_b), _gather(b, groups_a)
    out = []
    for kind, i, j, k, m in _opcodes([_body(x) for x in a], [_body(x) for x in b]):
        if kind == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2], _join_texts(x[3], y[3]), x[4], _keys(x[5], y[5]), _join_sizes(x[6], y[6])] for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[0], x[1], True, *x[3:]] for x in (*a[i:j], *b[k:m])]
    return fold_optional(out)


def fold_optional(items: list[list]) -> list[list]:
    """Neighbours with one body, left over from an alignment, are one repeated group."""
    out: list[list] = []
    for x in items:
        if out and out[-1][0] == x[0] and len(x[3]) == len(out[-1][3]) and (x[3] or x[1]):
            out[-1] = [x[0], True, out[-1][2] and x[2], _join_texts(out[-1][3], x[3]), x[4], _keys(out[-1][5], x[5]), _join_sizes(out[-1][6], x[6])]
        else:
            out.append(x)
    return out


def _is_main(node: str) -> bool:
    name, _, marks = node.partition(" ")
    return name in MAIN or "main" in marks.split()


def _content(path: str, frame: list[str], marked: bool = True) -> bool:
    """Whether the regions that a slot lies in can hold the article.

    frame: nodes from the root down to the article's element; no marked word
    rejects those, nor html, body, main and an article that isn't inside another
    one, and no form does that is among them. Within the frame only names that
    say nothing else reject. Without `marked` only tags count.
    """
    framed, inside, article = True, False, False
    last = len(frame) - 1 if frame and frame[-1].partition(" ")[0] not in ("html", "body") else -1
    for i, node in enumerate(path.split("/") if path else []):
        name, _, marks = node.partition(" ")
        framed = framed and i < len(frame) and node == frame[i]
        if (name in OUTSIDE and not (framed and name == "form")) or (name == "header" and not inside):
            return False
        free = framed or name in ("html", "body", "main") or "main" in marks.split() or (name == "article" and not article)
        if marked and not free and _marked(marks, inside):
            return False
        inside |= _is_main(node) or (framed and i == last)
        article |= name == "article"
    return True


def _in_main(path: str) -> bool:
    return any(map(_is_main, path.split("/")))


def article_root(weights: dict[str, float]) -> list[str]:
    """The nodes down to the element that holds the article, from the weight of the text at each path.

    Goes down as long as one region holds most of the text and no region beside
    it holds a quarter, to the outermost main or article element at most. Such an
    element adds to a region's weight; its name or a form around it lessens it.
    """
    root: list[str] = []
    inside = {tuple(p.split("/")) if p else (): w for p, w in weights.items()}
    while True:
        regions: dict[str, float] = {}
        total = 0.0
        for nodes, w in inside.items():
            node = nodes[0] if nodes else ""
            name, _, marks = node.partition(" ")
            if name in OUTSIDE and name != "form":
                continue
            w *= (0.1 if name == "form" else 1.0) * (EVIDENCE if _is_main(node) else 0.1 if _marked(marks, False) and name not in ("html", "body") else 1.0)
            total += w
            if name in HOLDS:
                regions[node] = regions.get(node, 0.0) + w
        best = max(sorted(regions), key=regions.__getitem__, default=None)
        if best is None or 2 * regions[best] <= total or any(4 * w >= total for node, w in regions.items() if node != best):
            return root
        root.append(best)
        if _is_main(best):
            return root
        inside = {nodes[1:]: w for nodes, w in inside.items() if nodes and nodes[0] == best}


def _of_root(path: str, root: list[str]) -> bool:
    """Whether a slot lies in the article's element, or, unless that is a main or article element, in a heading or other block right beside it or beside what encloses it."""
    nodes = path.split("/") if path else []
    same = next((i for i, (x, y) in enumerate(zip(nodes, root, strict=False)) if x != y), min(len(nodes), len(root)))
    if same == len(root) or any(map(_is_main, root)):
        return same == len(root)
    return same == len(nodes) or nodes[same].partition(" ")[0] not in HOLDS | OUTSIDE


def _article(slots: list[tuple[str, str]], links: list[int], root: list[str] | None) -> tuple[set[str], bool]:
    """Paths of a page's slots that can hold its article, and whether the host's root found them.

    A page that has nothing there has a root of its own. If main or article
    elements below the root hold half of the text there, the rest goes.
    """
    weights: dict[str, float] = {}
    for (p, said), linked in zip(slots, links, strict=True):
        weights[p] = weights.get(p, 0.0) + len(said) - linked
    hosts = root is not None and any(_of_root(p, root) and len(p.split("/")) > len(root) for p in weights)
    if not hosts:
        root = article_root(weights)
    near = {p for p in weights if _of_root(p, root)}
    main = {p for p in near if _in_main(p)}
    if main and not any(map(_is_main, root)) and 2 * sum(weights[p] for p in main) >= sum(weights[p] for p in near):
        near = main
    good = {p for p in near if _content(p, root)}
    if not good and (head := _main_head({p: weights[p] for p in near})):
        good = {p for p in near if _of_root(p, head) and _content(p, head)}
    return good or {p for p in near if _content(p, root, False)} or {p for p in weights if _content(p, [], False)}, hosts


def _main_head(weights: dict[str, float]) -> list[str]:
    """Where everything lies in marked regions: the nodes down to the main or article element with the fewest marked ones around it, then with the most text."""
    heads: dict[tuple[str, ...], float] = {}
    for p, w in weights.items():
        nodes = p.split("/")
        if (k := next((i for i, x in enumerate(nodes) if _is_main(x)), None)) is not None:
            heads[tuple(nodes[: k + 1])] = heads.get(tuple(nodes[: k + 1]), 0.0) + w
    around = lambda h: sum(_marked(x.partition(" ")[2], False) for x in h[:-1])
    return list(min(heads, key=lambda h: (around(h), -heads[h], h), default=()))


def _teasers(own: list[int], slots: list[tuple[str, str]], articles: list[int], links: list[int]) -> set[int]:
    """Articles that begin with a link, where the longest one doesn't: they lead to other pages."""
    sizes: dict[int, int] = {}
    linked: dict[int, bool] = {}
    for i in own:
        k = articles[i]
        sizes[k] = sizes.get(k, 0) + len(slots[i][1]) - links[i]
        linked.setdefault(k, 5 * links[i] >= 4 * len(slots[i][1]))
    longest = max(sizes, key=lambda k: (sizes[k], -k), default=0)
    return {k for k, x in linked.items() if k and x and k != longest} if not linked.get(longest, True) else set()


def decide(wrapper: list[list]) -> dict:
    """What a finished wrapper says about its host's pages: root, the nodes down to the article's element, and items, the wrapper with its template texts alone (None if there are none).

    A slot that says the same on different pages is template text, one that
    varies is content; links weigh nothing. If what is alike on different pages
    is more than half of what varies over all of them, they are copies of one
    page, and nothing is known to be template.
    """
    fixed = vary = 0.0
    for _, _, _, texts, _, pages, sizes in wrapper:
        for t, (chars, _, n) in zip(texts, sizes, strict=True):
            if t is None:
                vary += chars
            elif len(pages) > 1:
                fixed += chars / n * len(t)
    sure = 2 * fixed < vary
    weights: dict[str, float] = {}
    out, any_left = [], False
    for body, repeated, optional, texts, paths, pages, sizes in wrapper:
        known = sure and len(pages) > 1
        for t, p, (chars, linked, _) in zip(texts, paths, sizes, strict=True):
            weights[p] = weights.get(p, 0.0) + (0.0 if known and t is not None else chars - linked)
        texts = [t if known and t is not None and not _in_main(p) and _content(p, [], False) else None for t, p in zip(texts, paths, strict=True)]
        any_left |= any(t is not None for t in texts)
        out.append([body, repeated, optional, texts, [], [], [[0, 0, 0]] * len(texts)])
    return {"root": article_root(weights), "items": out if any_left else None}


def template_slots(tokens: list[str], slots: list[tuple[str, str]], wrapper: list[list]) -> set[int]:
    """Numbers of the slots of a page that align with constant slots of its host's wrapper and say the same."""
    items = _items(tokens, slots)
    for i, x in enumerate(x for x in items if x[3]):
        x[3][0] = [(x[3][0][0], i)]
    items = fold(items)
    a, b = _gather(wrapper, {_body(x) for x in items if x[1]}), _gather(items, {_body(x) for x in wrapper if x[1]})
    out = set()
    for kind, i, j, k, m in _opcodes([_body(x) for x in a], [_body(x) for x in b]):
        if kind == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                for t, own in zip(x[3], y[3], strict=True):
                    if t is not None and t == [d for d, _ in own]:
                        out |= {at for _, at in own}
    return out


def extract_by(page: str, rules: dict | None) -> tuple[str, bool]:
    """The article of a page by what its host's wrapper says (decide()): the slots of the article's element, less the template texts that align with the wrapper's. And whether the wrapper told where it is."""
    tokens, slots, articles, links = _scan(page)
    good, by_wrapper = _article(slots, links, rules["root"] if rules else None)
    own = [i for i, (p, _) in enumerate(slots) if p in good]
    if len(set(articles)) > 1 and (others := _teasers(own, slots, articles, links)):
        own = [i for i in own if articles[i] not in others]
    if rules and rules["items"] and any(not _in_main(slots[i][0]) for i in own):
        template = template_slots(tokens, slots, rules["items"])
        own = [i for i in own if i not in template] or own
    return " ".join(slots[i][1] for i in own), by_wrapper


def extract(page: str, rules: dict | None) -> str:
    return extract_by(page, rules)[0]


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _pack(wrapper: list[list] | dict) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


#: Wrappers that are aligned in one group.
FAN = 256


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (pickled items) from all pages with any html.

    Different pages of a host are taken in the order of their digests, FAN at a
    time, and what comes of these likewise until a host has one wrapper: however
    pages are dealt over files, the wrapper is the same.
    """
    use_package(pages.sparkSession)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                hosts, keys, made = [], [], []
                for url, page in zip(part.column("url").to_pylist(), text_array(part.column("html")).to_pylist(), strict=True):
                    tokens, slots, _, links = _scan(page)
                    if slots:
                        key = _digest("\n".join((*tokens, *(said for _, said in slots))))
                        hosts.append(host_of(url))
                        keys.append(key)
                        made.append(pickle.dumps(fold(_items(tokens, slots, key, links)), 5))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(made, pa.binary())], ["host", "key", "wrapper"])

    def merge(found: pa.Table) -> pa.Table:
        found = found.sort_by("key")
        made = found.column("wrapper").to_pylist()
        wrapper = pickle.loads(made[0])
        for x in made[1:]:
            wrapper = align(wrapper, pickle.loads(x))
        return pa.table({"host": found.column("host")[:1], "key": found.column("up")[:1], "width": found.column("less")[:1], "wrapper": pa.array([pickle.dumps(wrapper, 5) if len(made) > 1 else made[0]], pa.binary())})

    each = pages.select("url", "html").mapInArrow(folded, "host string, key long, wrapper binary")
    each = stash(each.groupBy("host", "key").agg(F.first("wrapper").alias("wrapper")), "folded")  # copies say nothing new
    # A digest has 56 bits: its high ones, `width` of them, deal a host's pages into groups of about FAN or fewer.
    width = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / FAN)), F.lit(0)).cast("int")
    counts = stash(each.groupBy("host").agg(width.alias("less")), "counts")
    level = each.join(counts, "host").withColumn("up", F.expr("shiftright(key, 56 - less)"))
    left = counts.agg(F.coalesce(F.max("less"), F.lit(0))).first()[0]
    kind, bits = "host string, key long, width int, wrapper binary", FAN.bit_length() - 1
    while True:
        level = level.groupBy("host", "less", "up").applyInArrow(merge, kind)
        if left <= 0:
            return level.select("host", "wrapper")
        level = level.withColumn("less", F.greatest(F.col("width") - bits, F.lit(0))).withColumn("up", F.expr(f"shiftright(key, {bits})"))
        left -= bits


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text, n_chars of every page.

    Null or empty html gives an empty text; a null url counts as host "". A host
    with one page has a wrapper of that page alone; a page that has nothing where
    its host's article is, is looked through on its own. Copies of a page get
    equal texts. Reading takes time in proportion to a page, broken markup
    included. Extra columns are left out.
    """
    use_package(pages.sparkSession)
    wrappers = stash(infer_wrappers(pages), "wrappers")

    def rules_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_pack(decide(pickle.loads(w))) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(made, pa.string())], ["host", "rules"])

    rules = stash(wrappers.mapInArrow(rules_of, "host string, rules string"), "rules")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            for part in chunks(batch, "html"):
                out = []
                for page, r in zip(text_array(part.column("html")).to_pylist(), part.column("rules").to_pylist(), strict=True):
                    if r not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[r] = json.loads(r) if r is not None else None
                    out.append(extract(page, known[r]))
                cols = [part.column("page_id"), part.column("url"), part.column("host"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "host", "text", "n_chars"])

    # Spark broadcasts the rules if their files are below its threshold, else both sides are shuffled and hot hosts are split.
    joined = pages.select("page_id", "url", "html").withColumn("host", host).join(rules, "host", "left")
    return joined.select("page_id", "url", "host", "html", "rules").mapInArrow(run, "page_id long, url string, host string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
