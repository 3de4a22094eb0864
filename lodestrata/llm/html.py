"""Main text of web pages with a site style tree.

A page is parsed once into a tree of block elements. The pages of a host are merged by style path (tags, classes and
ids from the root, and whether an element has blocks of its own in it), and each style node gets from its pages:

* presentation: the entropy of the child sequences it has there, 1 where one page has it;
* content: 1 minus the mean entropy of its texts over the pages; a text on every page has entropy 1;
* link: the part of its text that is in links; share: its part of the text of the pages that have it.

On each page importance is composed from the leaves up. A leaf has its content, less what is in links; a branch has
``(1 - g**l) * presentation + g**l * (mean of its parts)``, with l the number of its child sequences on the site. The
main branch is found from the root: as long as one block container holds ``MAIN`` of the importance of what it is
in, the search goes into it. Branches outside it count less the smaller their share of the site's text is; a branch
of low importance with nothing important in it goes, wherever it is.

Tags, roles, classes and ids are evidence: they multiply the importance of an element by ``AGAINST``. None removes an
element that holds the main branch, and a name alone removes nothing but comments, which have no other mark: a
``related`` box goes if it also repeats, links or is small. <article> and <main>, unless repeated, raise the chance to
be the main branch. Only what is never text by the standard (scripts, controls, hidden elements) goes by itself.

Statistics are sums over (style node, feature) counts, so a host with a third of all pages is spread over as many
groups as it has nodes and texts. Pages of a host with the same texts are copies and count once, since copies say
nothing about style; two different pages are the least that can repeat anything. A page on which everything would
go keeps everything.

Defined results: null, empty or textless html gives the empty text; a null url has no host, so no style tree; then,
and for style nodes of one page, the page itself is the site. Rows with null or repeated ids get a result each; an
empty table gives no rows. Unclosed tags, quotes and comments end where the standard says or, where that is the end
of the page, at the next ``>``; scanning is linear in the length of the page.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import table, text_batches
from .textblocks import column_bytes

THRESHOLD = 0.2
GAMMA = 0.9
MAIN = 0.6
#: A container outside the main branch with this share of its pages' text or more counts in full.
FULL_SHARE = 0.15
#: What an article or main that is not repeated counts for as main branch, and what containers outside it then do.
ARTICLE = 8.0
OUTSIDE_ARTICLE = 0.5
SALTS = 8

# Element names of the HTML standard by their role in a page.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base col embed hr input link meta param source track".split())
RAW = "script style textarea title".split()
FOREIGN = "noscript template svg math iframe object".split()
NEVER_TEXT = set("head button select option optgroup datalist audio video canvas map noframes frameset".split())
ASIDE_TAGS = set("nav footer aside form label fieldset dialog menu menuitem".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SLOTS = set("div section aside article form ul ol dl table li fieldset center".split())
CONTAINERS = set("html body div section aside nav header footer article main form fieldset details dialog center".split())
HOLDERS = CONTAINERS - {"nav", "footer"}  # what may hold the main text
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
COMMENT_NAMES = set("comment comments disqus respond replies reply discussion discussions reactions guestbook".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar share sharing social related recommended recommendations pagination pager login toolbar search searchbox form".split()
)
#: What evidence leaves of an element's importance.
AGAINST = {"never": 0.0, "tag": 0.15, "comment": 0.15, "name": 0.35, "repeated": 0.5}
#: What is left, besides, of a container that evidence is against and that pages of the host share as a slot, whose form is
#: the same on all of them; of one whose form differs as much as it can, all is.
SLOT = 0.4
#: What is left of a container beside the main branch that pages of the host share and that lists alike containers.
ALIKE = 0.15

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW + FOREIGN}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME_PART = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """``("text", piece, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")`` in order, in linear time."""
    at, n, trust_quotes, unclosed = 0, len(source), True, set()
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            break
        mark = source[begin + 1 : begin + 2]
        if not (mark.isascii() and mark.isalpha()) and mark not in ("/", "!", "?") or not mark:
            yield "text", source[at : begin + 1], ""
            at = begin + 1
            continue
        if begin > at:
            yield "text", source[at:begin], ""
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        end = source.find(">", begin)
        if end < 0:
            at = n  # what never closes is dropped, as the standard has it
            break
        name = _NAME.match(source, begin + 1 + (mark == "/"))
        if mark in "!?" or name is None:
            at = end + 1
            continue
        tag = name[0].lower()
        if mark == "/":
            at = end + 1
            yield "close", tag, ""
            continue
        if trust_quotes and ('"' in source[begin:end] or "'" in source[begin:end]):
            far = _quoted_end(source, name.end(), end)
            trust_quotes = far >= 0  # one scan to the end of the page at most
            end = far if far >= 0 else end
        at = end + 1
        closing = _CLOSE.get(tag)
        if closing is not None and tag not in unclosed and source[end - 1] != "/":
            found = closing.search(source, at)
            if found or tag in RAW:
                stop = source.find(">", found.end()) if found else -1
                at = n if stop < 0 else stop + 1
                continue
            unclosed.add(tag)
        yield "open", tag, source[name.end() : end]
    if at < n:
        yield "text", source[at:], ""


def _quoted_end(source: str, at: int, end: int) -> int:
    """The first ``>`` outside quotes from ``at`` on, -1 if there is none; ``end`` is the first ``>`` of all."""
    while True:
        double, single = source.find('"', at, end), source.find("'", at, end)
        quote = max(double, single) if min(double, single) < 0 else min(double, single)
        if quote < 0:
            return end
        close = source.find(source[quote], quote + 1)
        if close < 0:
            return -1
        at = close + 1
        if at > end:
            end = source.find(">", at)
            if end < 0:
                return -1


class Page:
    """Block elements of a page in document order, and its text blocks.

    ``parent``, ``tag``, ``key`` (style path) and ``weight`` (what evidence leaves) go by element; ``blocks`` are
    (element, text, part in links).
    """

    def __init__(self, source: str, host: str):
        self.parent, self.tag, self.weight = [-1], ["#root"], [1.0]
        self.blocks: list[tuple[int, str, float]] = []
        styles, stack, open_at = [host], [0], {}
        pieces: list[str] = []
        linked, length, link_depth, in_article = 0, 0, 0, 0

        def flush() -> None:
            nonlocal linked, length
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack[-1], text, linked / max(1, length)))
                pieces.clear()
                linked = length = 0

        def close(k: int) -> None:
            nonlocal link_depth, in_article
            while len(stack) > k:
                tag = self.tag[stack.pop()]
                open_at[tag].pop()
                in_article -= tag in ("article", "main")
            if link_depth > len(stack):
                link_depth = 0

        for kind, what, attributes in tokens(source):
            if kind == "text":
                pieces.append(what)
                size = len(what.strip())
                length += size
                linked += size if link_depth else 0
                continue
            tag = what
            if tag in INLINE:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "a":
                    link_depth = len(stack) if kind == "open" else 0
                continue
            if tag in ("td", "th"):
                pieces.append(" ")
                continue
            flush()
            if kind == "close":
                if open_at.get(tag):
                    close(open_at[tag][-1])
                continue
            if tag in VOID:
                continue
            above = self.tag[stack[-1]]
            ends = SAME_ENDS.get(tag)
            if above == "p" and (tag in ENDS_P or ends) or tag == "body" and above == "head":
                close(len(stack) - 1)
            if ends and self.tag[stack[-1]] in ends:
                close(len(stack) - 1)
            style, weight = self._style(tag, attributes, in_article > 0)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.weight.append(weight)
            styles.append(style)
            if attributes.endswith("/") and tag not in ENDS_P:
                continue
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(self.tag) - 1)
            in_article += tag in ("article", "main")
        flush()
        inner = [False] * len(self.tag)
        for up in self.parent[1:]:
            inner[up] = True
        self.key = [_hash(host)]
        for k in range(1, len(self.tag)):
            self.key.append(_hash(f"{self.key[self.parent[k]]}/{styles[k]}{'+' if inner[k] else ''}"))

    @staticmethod
    def _style(tag: str, attributes: str, in_article: bool) -> tuple[str, float]:
        """Style of an element, and what its tag, role, class and id leave of its importance."""
        against = {"never"} if tag in NEVER_TEXT else {"tag"} if tag in ASIDE_TAGS or tag == "header" and not in_article else set()
        names = []
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what in ("class", "id"):
                names.append(what + "=" + " ".join(sorted(_DIGITS.sub("0", value).split())))
                parts = set(_NAME_PART.split(_CAMEL.sub(" ", value).lower()))
                if parts & COMMENT_NAMES:
                    against.add("comment")
                if parts & ASIDE_NAMES and not (in_article and tag == "header"):
                    against.add("name")
            elif what == "role":
                if value.strip().lower() in ASIDE_ROLES:
                    against.add("tag")
            elif what == "hidden" or what == "aria-hidden" and value.strip().lower() == "true":
                against.add("never")
            elif what == "style" and "display:none" in value.replace(" ", "").lower():
                against.add("never")
        if tag in ("html", "body", "main"):
            against = set()
        return f"{tag}[{';'.join(sorted(names))}]", min([AGAINST[a] for a in against], default=1.0)

    def pack(self) -> bytes:
        """What is known of the page: the elements that hold text, and the blocks."""
        used = [False] * len(self.tag)
        for k, _, _ in self.blocks:
            used[k] = True
        for k in range(len(self.tag) - 1, 0, -1):
            used[self.parent[k]] |= used[k]
        new, parent, tag, key, weight = {}, [], [], [], []
        for k in range(len(self.tag)):
            if used[k] or not k:
                new[k] = len(parent)
                parent.append(new[self.parent[k]] if k else -1)
                tag.append(self.tag[k])
                key.append(self.key[k])
                weight.append(self.weight[k])
        place = {x: i for i, x in enumerate(dict.fromkeys(key))}
        blocks = [(new[k], t, round(part, 3)) for k, t, part in self.blocks]
        return json.dumps([parent, tag, list(place), [place[x] for x in key], weight, blocks], ensure_ascii=False).encode("utf-8", "surrogatepass")


class Tree:
    """A packed page without what is never text, with the characters, linked and not, of each element and branch."""

    def __init__(self, packed: bytes):
        self.parent, self.tag, keys, place, self.weight, blocks = json.loads(packed)
        n = len(self.parent)
        self.key = [keys[x] for x in place]
        never, self.links, self.own = [False] * n, [0.0] * n, [0] * n
        for k in range(1, n):
            never[k] = never[self.parent[k]] or not self.weight[k]
        self.blocks = [b for b in blocks if not never[b[0]]]
        for k, text, part in self.blocks:
            self.own[k] += len(text)
            self.links[k] += len(text) * part
        self.chars = self.own[:]
        for k in range(n - 1, 0, -1):
            self.chars[self.parent[k]] += self.chars[k]
            self.links[self.parent[k]] += self.links[k]
        self.below: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            if self.chars[k]:
                self.below[self.parent[k]].append(k)

    def sizes(self) -> dict[int, tuple[int, float]]:
        """Characters and linked characters by style node."""
        held: dict[int, tuple[int, float]] = {}
        for k, c in enumerate(self.chars):
            if c:
                a, b = held.get(self.key[k], (0, 0.0))
                held[self.key[k]] = (a + c, b + self.links[k])
        return held

    def features(self) -> list[tuple]:
        """Rows (style node, kind, feature, characters, linked characters, characters of the page).

        Kind 0 is the child sequence, once a node, with its sums; kind 1 are its texts, each once.
        """
        sizes = self.sizes()
        children: dict[int, list[str]] = {}
        for k, c in enumerate(self.chars):
            if c:
                children.setdefault(self.key[k], []).extend(self.tag[x] for x in self.below[k])
        texts = dict.fromkeys((self.key[k], _hash(t)) for k, t, _ in self.blocks)
        rows = [(key, 0, _hash(" ".join(tags)), sizes[key][0], round(sizes[key][1]), self.chars[0]) for key, tags in children.items()]
        return rows + [(key, 1, text, 0, 0, 0) for key, text in texts]

    def content(self) -> int:
        """Equal for pages with the same texts."""
        return _hash("\n".join(t for _, t, _ in self.blocks))


def main_text(packed: bytes, known: dict[int, tuple]) -> tuple[str, int]:
    """The blocks that stay, joined by empty lines, and the number of branches removed.

    ``known``: presentation, content, shapes, link and share by style node.
    """
    tree = Tree(packed)
    parent, tag, key, weight, own, chars, below, blocks = tree.parent, tree.tag, tree.key, tree.weight, tree.own, tree.chars, tree.below, tree.blocks
    n = len(parent)
    facts = {x: (1.0, 1.0, 1, b / max(1, a), a / max(1, chars[0])) for x, (a, b) in tree.sizes().items()} | known
    none = (1.0, 1.0, 1, 0.0, 0.0)
    presentation, content, shapes, link, share = zip(*(facts.get(x, none) for x in key))

    # Importance of leaves and, weighted with their text and evidence, of branches: what the main branch is chosen by.
    leaf = [content[k] * (1 - link[k]) for k in range(n)]
    mass = [0.0] * n
    for k in range(n - 1, -1, -1):
        mass[k] = weight[k] * (mass[k] + own[k] * leaf[k])
        if k:
            mass[parent[k]] += mass[k]
    path, main = [0], 0
    while True:
        if len(below[main]) == 1 and not own[main] and tag[below[main][0]] in HOLDERS and tag[below[main][0]] not in ("article", "main"):
            main = below[main][0]  # nothing to choose from
            path.append(main)
            continue
        worth: dict[int, list[float]] = {}
        for c in below[main]:
            worth.setdefault(key[c], []).append(mass[c] / chars[c])
        pooled = lambda c: share[c] * sum(worth[key[c]]) / len(worth[key[c]])
        candidates = [(pooled(c) * (ARTICLE if tag[c] in ("article", "main") else 1.0), c) for c in below[main] if tag[c] in HOLDERS and len(worth[key[c]]) == 1]
        best, chosen = max(candidates, default=(0.0, 0))
        rest = sum(pooled(c) for c in {key[c]: c for c in below[main] if c != chosen}.values()) + own[main] * leaf[main] / max(1, chars[0])
        if not chosen or best < MAIN * (best + rest):
            break
        main = chosen
        path.append(main)
        if tag[main] in ("article", "main"):
            break
    for k in range(n):
        articles = [c for c in below[k] if tag[c] == "article"]
        for c in articles if len(articles) > 1 else ():  # items of a list, each an article elsewhere
            weight[c] *= AGAINST["repeated"]
    on_path, inside, suspect = set(path), [k == main for k in range(n)], [False] * n
    listed = [False] * n
    for k in range(1, n):
        inside[k] = inside[k] or inside[parent[k]]
        if k in on_path or tag[k] not in SLOTS or key[k] not in known:
            continue
        # Presentation and evidence weigh together: new text in a slot of one form is not enough to keep it.
        if weight[k] < 1:
            weight[k] *= SLOT + (1 - SLOT) * presentation[k]
        of_one = [key[c] for c in below[k] if tag[c] in SLOTS]
        listed[k] = not inside[k] and parent[k] in on_path and len(of_one) > len(set(of_one)) == 1
        if listed[k]:
            weight[k] *= ALIKE
    low, holds, gone = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        suspect[k] = k not in on_path and (suspect[parent[k]] or weight[k] < 1)
    # In the main branch links count half, unless evidence is against what holds them.
    part_of = [content[k] * (1 - link[k] * (0.5 if inside[k] and not suspect[k] else 1.0)) for k in range(n)]
    composed: list[float] = [0.0] * n
    for k in range(n - 1, 0, -1):
        if not chars[k]:
            continue
        parts = [composed[c] for c in below[k]] + [part_of[k]] * bool(own[k])
        fade = GAMMA ** shapes[k] if below[k] else 1.0
        composed[k] = ((1 - fade) * presentation[k] + fade * sum(parts) / len(parts)) * weight[k]
        if k not in on_path and parent[k] in on_path and not inside[k] and tag[k] in CONTAINERS:
            composed[k] *= min(1.0, share[k] / FULL_SHARE) * (OUTSIDE_ARTICLE if tag[main] in ("article", "main") else 1.0)
            low[k] = composed[k] < THRESHOLD
        else:
            low[k] = composed[k] < THRESHOLD and (weight[k] < 1 or not holds[k])
        low[k] = low[k] and k not in on_path
        holds[parent[k]] |= not low[k]
    for k in range(1, n):
        gone[k] = gone[parent[k]] or low[k]
    left = [t for k, t, _ in blocks if not gone[k] and part_of[k] >= THRESHOLD]
    if not left:  # a page of repeated text only; what evidence is against stays out
        against = [False] * n
        for k in range(1, n):
            against[k] = tag[k] not in ("article", "main") and (against[parent[k]] or weight[k] < 1)
        left = [t for k, t, _ in blocks if not against[k]]
    return "\n\n".join(left), sum(low[k] and not gone[parent[k]] for k in range(1, n))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    data, offsets = column_bytes(batch.column(2))
    at = offsets.tolist()
    for url, a, b in zip(batch.column(1).to_pylist(), at, at[1:]):
        yield data[a:b].tobytes().decode("utf-8", "replace"), host_of(url)


_FEATURES = ["node", "kind", "feature", "chars", "links", "total"]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one parse. ``parsed`` begins with 1 where the page has a host.

    All is one column, so that no reader of the exchange prunes what another one needs and makes an exchange of its own.
    """
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        parsed = [(b"1" if host else b"0") + packer.compress(Page(source, host).pack()) for source, host in _rows(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parsed, pa.binary()), batch.column(3)], names=["page", "parsed", "carried"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page with a host: its features, its host and a hash of its texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        where, rows, count, content, host = [], [], [0], [], []
        for k, parsed in enumerate(batch.column(1).to_pylist()):
            if parsed[:1] == b"1":
                tree = Tree(unpack(parsed[1:]))
                where.append(k)
                rows += tree.features()
                count.append(len(rows))
                content.append(tree.content())
                host.append(tree.key[0])
        values = np.array(rows, np.int64).reshape(-1, len(_FEATURES))
        each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(_FEATURES))], names=_FEATURES)
        columns = [batch.column(0).take(pa.array(where, pa.int64())), pa.array(content, pa.int64()), pa.array(host, pa.int64()), pa.ListArray.from_arrays(pa.array(count, pa.int32()), each)]
        yield pa.RecordBatch.from_arrays(columns, names=["page", "content", "host", "features"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, removed = [], []
        for parsed, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            known = {x["node"]: (x["presentation"], x["content"], x["shapes"], x["link"], x["share"]) for x in nodes or ()}
            text, n = main_text(unpack(parsed[1:]), known)
            texts.append(text)
            removed.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32()), batch.column(2)], names=["main_text", "n_removed", "carried"])


def features_of(parsed: DataFrame) -> DataFrame:
    """``page, content, host, features`` of the parsed pages that have a host."""
    each = ", ".join(f"{c}: long" for c in _FEATURES)
    return parsed.mapInArrow(_features, f"page long, content long, host long, features array<struct<{each}>>")


def style_nodes(features: DataFrame) -> DataFrame:
    """``node, pages, presentation, content, shapes, link, share`` of the style nodes that two or more different pages have."""
    # Of pages of a host with the same texts one counts, the same one whatever the order.
    once = features.groupBy("host", "content").agg(F.min_by("features", F.xxhash64("features")).alias("features")).select(F.inline("features"))
    total = lambda c: F.sum(c).alias(c)
    counted = once.groupBy("node", "kind", "feature").agg(F.count("*").alias("n"), total("chars"), total("links"), total("total"))
    shape, text = F.col("kind") == 0, F.col("kind") == 1
    sums = counted.groupBy("node").agg(
        F.sum(F.when(shape, F.col("n"))).alias("pages"),
        F.sum(shape.cast("int")).alias("shapes"),
        F.sum(F.when(shape, F.col("n") * F.log(F.col("n").cast("double")))).alias("n_log_n"),
        F.sum(F.when(text, F.log(F.col("n").cast("double")))).alias("logs"),
        F.sum(text.cast("long")).alias("texts"),
        total("chars"),
        total("links"),
        total("total"),
    )
    base = F.log(F.col("pages").cast("double"))
    presentation = (base - F.col("n_log_n") / F.col("pages")) / base
    content = F.when(F.col("texts") > 0, 1 - F.col("logs") / F.col("texts") / base).otherwise(1.0)
    part = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias
    return sums.where(F.col("pages") > 1).select(
        "node", "pages", presentation.alias("presentation"), content.alias("content"), "shapes", part("links", "chars")("link"), part("chars", "total")("share")
    )


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``main_text``, ``n_removed`` (branches) and a struct ``carried`` of the columns in ``carry`` (all by default) for every row.

    The parsed pages are dealt once, and both the statistics and the extraction read that one exchange. ``pages``
    should come from a file or a checkpoint: rows are told apart by their place in it.
    """
    text_batches(pages.sparkSession)
    columns = pages.columns if carry is None else carry
    url, source = F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    carried = F.struct(*[F.col(c) for c in columns]).alias("carried")
    # A key of its own for each row, so that copies of a page are spread.
    whole = pages.select(F.monotonically_increasing_id().alias("page"), url, source, carried)
    kept = whole.select("carried").schema["carried"].dataType.simpleString()
    parsed = whole.mapInArrow(_parse, f"page long, parsed binary, carried {kept}").repartition("page")
    features = features_of(parsed)
    facts = style_nodes(features)
    # The nodes of a hot host are in a third of all pages: they meet their facts in SALTS groups.
    salt = F.pmod(F.col("page"), F.lit(SALTS)).cast("int").alias("salt")
    shapes = F.filter("features", lambda x: x["kind"] == 0)
    having = features.select("page", F.explode(F.transform(shapes, lambda x: x["node"])).alias("node"), salt)
    spread = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = having.join(spread, ["node", "salt"]).groupBy("page").agg(F.collect_list(F.struct("node", "presentation", "content", "shapes", "link", "share")).alias("nodes"))
    return parsed.join(known, "page", "left").select("parsed", "nodes", "carried").mapInArrow(_extract, f"main_text string, n_removed int, carried {kept}")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("carried.page_id", "carried.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_removed")
