"""Main text of web pages with a site style tree.

Each page is parsed into a tree of elements; an element's place in the site's tree is
the chain of tags and classes above it. Over all pages of a host the trees are merged:
for each place the presentations (sequences of child tags, runs of one tag as one) and
the features of its content (texts of its blocks) are counted by page. A feature's
importance is 1 less its entropy over the pages that have the place (0 on all of them, 1 on
one), with the entropy of the place's presentations as a small part. A branch's importance
on a page is the mean of its features' over all elements below it, by length; branches of
low importance are removed whole, a menu with its one item that no other page has too.
Pages of a host with the same places, presentations and features count once.

Menus, adverts and footers often have other words on each page, so words cannot tell them
from an article; their shape can. From the root on, the branch that holds half of a page's
text or more is the main one; it and the branches beside it have a shape on each page
(child tags, how much of the text is linked, how long it is, in four classes); this goes on
into the main branch up to the first heading or paragraph. Over the
pages of a host the shape of a template's part hardly varies, an article's does: where the
main branch's shape has high entropy, branches beside it whose shape has low entropy are
removed, whatever their names are.

What is left is judged by what HTML itself marks as no part of an article (menus, forms,
scripts and the like, or class names that say so): this decides where a host has too few
pages, or a page no main branch. Where a page marks its
article or main part, that is the text, less such parts and branches inside; it is kept
whole if more of its text would be removed than kept (pages that are near copies of each
other), as is a page without such a part of which nothing would be left.
The outermost ``main`` and ``article`` elements are that part, with all in them, if they
hold the text: articles with less text than the rest of the page (cards beside a story),
or a main part with less than half of the rest, mark nothing, and the page is judged whole.
Inside that part, and on headings and prose anywhere, only a whole class name or id says
so, and ids of headings and prose never do; other names are left to the importance.

The counts are aggregates over (page, place) and (place, value), so a host with a third
of all pages is no single task's work. Features of low importance are
broadcast if they are few (``BROADCAST_ROWS``, counted first), so that texts are not
shuffled; otherwise each page meets its own in a join. A page is parsed in time and space
in proportion to its length, however deep it nests. Character references are decoded, white space in a
block becomes one space, blocks are joined by a line feed in page order.

Null html or url is empty; an empty page has an empty text; repeated rows give a row
each; other columns are ignored. Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import read, slices, store

#: Places seen on at least so many pages of a host are judged; what is below the limit is of low importance.
MIN_PAGES, LEAST, PRESENTATION = 8, 0.2, 0.1
#: Entropy (in nats, so that it does not fall with the pages of a host) below which a shape hardly varies.
SHAPE = 0.3
#: Words from which the text of a branch is in the next class of length.
LENGTHS = (32, 256, 2048)
BROADCAST_ROWS = 200_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre hr figure figcaption address details summary header footer nav aside form fieldset center".split())
SPACED = frozenset("br td th option".split())
#: What a start tag closes, up to the nearest of the containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES_P = BLOCKS - {"html", "body"}
_P_SCOPE = {"html", "body", "td", "th", "button", "article", "section", "div", "li", "main", "blockquote", "form"}
NOISE_TAGS = frozenset("nav aside footer form button select head menu dialog object canvas audio video".split()) | RAW
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup comment comments disqus reply replies "
    "respond share sharing social related recommended widget widgets toolbar pagination pager login search skip alert alerts announcement disclaimer copyright legal paywall teaser".split()
)
#: Elements of prose, whose ids name their topic.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p section blockquote".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, with empty names for comments and declarations; each character is looked at a bounded number of times."""
    last, closed, at = source.rfind(">"), {'"': True, "'": True}, 0
    while 0 <= (i := source.find("<", at)) < last or source.startswith("<!--", i):
        at = i + 1
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = len(source) if end < 0 else end + 3
            yield i, at, "", "", ""
        elif source[at] in "!?":
            at = source.find(">", at) + 1
            yield i, at, "", "", ""
        elif m := _NAME.match(source, at):
            end, x = -1, m.end()
            while stop := _STOP.search(source, x):  # a sign of greater in quotes ends no tag
                if stop[0] == ">":
                    end = stop.start()
                    break
                x = stop.end()
                if closed[stop[0]]:
                    x = source.find(stop[0], x) + 1
                    if not x:
                        closed[stop[0]], x = False, stop.end()
            end = source.find(">", m.end()) if end < 0 else end
            at = end + 1
            yield i, at, m[1], m[2], source[m.end() : end]


class Node:
    __slots__ = ("tag", "place", "noise", "hard", "zone", "style", "index")

    def __init__(self, tag: str, place: int, noise: bool, hard: bool, zone: int, index: int):
        self.tag, self.place, self.noise, self.hard, self.zone, self.index = tag, place, noise, hard, zone, index
        self.style: list[str] = []


class Page:
    """Blocks and places of a page. zone: 0 elsewhere, 1 in an outermost main part, 2 in an outermost article.

    nodes: (parent, place) of each block element, parents first; a block names its element.
    """

    def __init__(self, host: str, source: str):
        self.blocks: list[tuple[int, int, str]] = []
        #: Characters, characters in links and words of all blocks of an element, also of those that are no article.
        self.sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
        self.nodes: list[tuple[int, int]] = [(-1, _hash(host))]
        self.prose = [False]
        self.styles: dict[int, list[str]] = {}
        self.features: dict[int, set[int]] = {}
        self.pending: list[str] = []
        self.in_link = 0
        self.open = [Node("", self.nodes[0][1], False, False, 0, 0)]
        #: Places in ``open`` of the open elements of each tag, and of the open blocks.
        self.of_tag: dict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        at = 0
        for start, end, slash, name, attributes in tokens(source):
            if start < at:  # inside a raw element
                continue
            self.characters(source[at:start])
            at, tag = end, name.lower()
            if not tag:
                continue
            if slash:
                self.end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            else:
                self.start(tag, attributes)
        self.characters(source[at:])
        self.flush()
        while len(self.open) > 1:
            self.pop()

    def characters(self, text: str) -> None:
        if text:
            self.pending.append(entities.unescape(text))
            if self.of_tag.get("a"):
                self.in_link += len(text)

    def flush(self) -> None:
        text = " ".join("".join(self.pending).split())
        self.pending.clear()
        if text:
            top = self.open[-1]
            place = self.nodes[top.index][1]
            self.features.setdefault(place, set()).add(feature(place, text))
            if not top.noise:
                self.blocks.append((top.zone, top.index, text))
            size = self.sizes[top.index]
            size[0] += len(text)
            size[1] += min(self.in_link, len(text))
            size[2] += text.count(" ") + 1
        self.in_link = 0

    def pop(self) -> None:
        node = self.open.pop()
        self.of_tag[node.tag].pop()
        if node.tag in BLOCKS:
            self.open_blocks.pop()
            self.styles.setdefault(node.place, []).append(",".join(node.style))

    def innermost(self, tags: set[str]) -> int:
        """Place of the innermost open element with one of the tags; 0 if none."""
        return max((own[-1] for t in tags if (own := self.of_tag.get(t))), default=0)

    def close(self, tags: set[str], stop: set[str]) -> None:
        i = self.innermost(tags)
        if i > self.innermost(stop):
            self.close_to(i)

    def close_to(self, i: int) -> None:
        if self.open_blocks and self.open_blocks[-1] >= i:
            self.flush()
        while len(self.open) > i:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACED:
            self.pending.append(" ")
        if tag in VOID:
            return
        if tag in _CLOSES_P:
            self.close({"p"}, _P_SCOPE)
        if tag in _CLOSES:
            self.close(*_CLOSES[tag])
        values = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        parent = self.open[-1]
        names, ident = values.get("class", "").lower(), values.get("id", "").lower()
        if parent.zone or tag in PROSE:
            own_id = tag not in PROSE or (tag == "section" and not parent.zone)
            words = {*names.split(), ident} if own_id else set(names.split())
        else:
            words = set(re.split(r"[^a-z0-9]+", f"{names} {ident}"))
        marked = bool(words & NOISE_WORDS) or values.get("role", "").lower() in NOISE_ROLES or "hidden" in values or values.get("aria-hidden") == "true"
        zone, noise = parent.zone, parent.noise
        if tag in ("html", "body"):
            noise = False
        elif tag in ("article", "main") and zone == 0:
            # an unclosed part before it does not swallow the article; a reader's comment may be one
            noise = noise and parent.hard or bool(words & {"comment", "comments", "reply"})
        else:
            noise = noise or marked or tag in NOISE_TAGS or (zone == 0 and (tag == "header" or "header" in words))
        if zone == 0 and tag in ("article", "main"):
            zone = 2 if tag == "article" else 1
        if parent.style[-1:] != [tag]:
            parent.style.append(tag)
        place = _hash(str(parent.place), tag, values.get("class", ""))
        index = parent.index
        if tag in BLOCKS and tag not in ("html", "body"):
            index = len(self.nodes)
            self.nodes.append((parent.index, place))
            self.prose.append(tag in PROSE and tag != "section")
        self.open.append(Node(tag, place, noise, parent.hard or (noise and tag not in ("p", "span", "div")), zone, index))
        self.of_tag[tag].append(len(self.open) - 1)
        if tag in BLOCKS:
            self.open_blocks.append(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        i = self.innermost({tag})
        # an inline end tag does not reach out of a block
        if i and (tag in BLOCKS or not self.open_blocks or self.open_blocks[-1] < i):
            self.close_to(i)

    def levels(self) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
        """(main branch, branches beside it) from the root on, and the shape of the place of each of these."""
        n, children = len(self.nodes), defaultdict(list)
        chars, linked, words = ([self.sizes[i][k] if i in self.sizes else 0 for i in range(n)] for k in range(3))
        for i in range(n - 1, 0, -1):
            parent = self.nodes[i][0]
            if chars[i]:
                children[parent].append(i)
            for own in (chars, linked, words):
                own[parent] += own[i]
        out, of_place, at = [], defaultdict(list), 0
        while own := children.get(at):
            top = max(own, key=lambda i: chars[i])
            # headings and paragraphs stand beside each other in an article, not in a template
            if 2 * chars[top] < chars[0] or any(self.prose[i] for i in own):
                break
            out.append((top, [i for i in own if i != top]))
            for i in own:
                of_place[self.nodes[i][1]].append(i)
            at = top
        shapes = {}
        for place, own in of_place.items():
            size = sum(chars[i] for i in own)
            link = round(2 * min(1.0, sum(linked[i] for i in own) / size))
            length = sum(sum(words[i] for i in own) >= x for x in LENGTHS)
            shapes[place] = _hash(*self.styles.get(place, ()), str(link), str(length))
        return out, shapes

    def result(self) -> tuple[list[dict], list[dict], list[dict], bool, list[dict], list[dict]]:
        """Blocks of the main part, all elements, the statistics of all places with text, whether the page marks its main part, its levels and their shapes."""
        size = [0, 0, 0]
        for zone, _, text in self.blocks:
            size[zone] += len(text)
        part = size[1] + size[2]
        marked = part > 0 and size[0] <= (2 * part if size[1] else part)
        kept = [{"node": n, "text": t} for z, n, t in self.blocks if z or not marked]
        nodes = [{"parent": a, "place": p} for a, p in self.nodes]
        stats = [{"place": p, "kind": 0, "v": _hash(*self.styles.get(p, ()))} for p in self.features]
        stats += [{"place": p, "kind": 1, "v": f} for p, own in self.features.items() for f in sorted(own)]
        levels, shapes = self.levels()
        return kept, nodes, stats, marked, [{"main": m, "beside": b} for m, b in levels], [{"place": p, "v": v} for p, v in shapes.items()]


def feature(place: int, text: str) -> int:
    return _hash(str(place), text)


_BLOCK = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
_SHAPE = pa.list_(pa.struct([("place", pa.int64()), ("v", pa.int64())]))
_LEVEL = pa.list_(pa.struct([("main", pa.int32()), ("beside", pa.list_(pa.int32()))]))
_NODE = pa.list_(pa.struct([("parent", pa.int32()), ("place", pa.int64())]))
_STAT = pa.list_(pa.struct([("place", pa.int64()), ("kind", pa.int32()), ("v", pa.int64())]))
_SCHEMA = "row long, page long, page_id long, url string, blocks array<struct<node:int,text:string>>, nodes array<struct<parent:int,place:long>>, stats array<struct<place:long,kind:int,v:long>>, marked boolean, levels array<struct<main:int,beside:array<int>>>, shapes array<struct<place:long,v:long>>"


def parsed(pages: DataFrame) -> DataFrame:
    """``row, page_id, url, blocks, nodes, stats, marked, levels, shapes`` of ``pages(page_id, url, html)``."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            done = [Page(h, s).result() for h, s in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([_hash(*(f"{s['place']} {s['v']}" for s in d[2])) for d in done], pa.int64()), batch.column("page_id"), batch.column("url"), pa.array([d[0] for d in done], _BLOCK), pa.array([d[1] for d in done], _NODE), pa.array([d[2] for d in done], _STAT), pa.array([d[3] for d in done], pa.bool_()), pa.array([d[4] for d in done], _LEVEL), pa.array([d[5] for d in done], _SHAPE)],
                ["row", "page", "page_id", "url", "blocks", "nodes", "stats", "marked", "levels", "shapes"],
            )

    return rows.mapInArrow(run, _SCHEMA)


def value_counts(pages: DataFrame) -> DataFrame:
    """``place, kind, v, c``: on how many distinct pages a place has presentation (kind 0) or feature (1) ``v``."""
    own = pages.select("page", F.explode("stats").alias("s")).select("page", "s.*").distinct()
    return own.groupBy("place", "kind", "v").agg(F.count("*").cast("double").alias("c"))


def presentations(counts: DataFrame) -> DataFrame:
    """``place, pages, nats, entropy``: on how many pages a place is, and the entropy of its presentations, also in units of them."""
    c = F.col("c")
    sums = counts.where("kind = 0").groupBy("place").agg(F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("s"))
    return sums.select("place", F.col("m").alias("pages"), (F.log("m") - F.col("s") / F.col("m")).alias("nats"), F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias("entropy"))


def features(counts: DataFrame) -> DataFrame:
    """``place, v, c, pages, importance`` of each feature: 1 less its entropy, and a part for its place's presentations."""
    content = F.when(F.col("pages") > 1, 1 - F.log("c") / F.log("pages")).otherwise(1.0)
    rows = counts.where("kind = 1").join(presentations(counts), "place")
    return rows.select("place", "v", "c", "pages", (PRESENTATION * F.col("entropy") + (1 - PRESENTATION) * content).alias("importance"))


def importance(pages: DataFrame) -> DataFrame:
    """``place, pages, importance`` of the places with text of their own: the mean of their features'; places are told apart by host."""
    mean = F.sum(F.col("importance") * F.col("c")) / F.sum("c")
    return features(store(value_counts(pages), "counts")).groupBy("place").agg(F.max("pages").cast("long").alias("pages"), mean.alias("importance"))


def low_features(pages: DataFrame) -> DataFrame:
    """``v``: features of low importance."""
    judged = features(store(value_counts(pages), "counts"))
    return judged.where((F.col("pages") >= MIN_PAGES) & (F.col("c") > 1) & (F.col("importance") < LEAST)).select("v")


def low_shapes(pages: DataFrame) -> DataFrame:
    """``v``: places whose shape hardly varies."""
    own = pages.select("page", F.explode("shapes").alias("s")).select("page", "s.*").distinct()
    counts = own.groupBy("place", F.lit(0).alias("kind"), "v").agg(F.count("*").cast("double").alias("c"))
    return presentations(counts).where((F.col("pages") >= MIN_PAGES) & (F.col("nats") < SHAPE)).select(F.col("place").alias("v"))


def beside_main(nodes: list[dict], levels: list[dict], low: set[int]) -> set[int]:
    """Branches of a template: their shape hardly varies, that of the main branch beside them does."""
    out: set[int] = set()
    for level in levels:
        if nodes[level["main"]]["place"] not in low:
            out.update(i for i in level["beside"] if nodes[i]["place"] in low)
    return out


def left_over(blocks: list[dict], nodes: list[dict], low: set[int], marked: bool, levels: list[dict]) -> str:
    """Text of the blocks outside a template's branches and branches of low importance; low: features and places.

    By importance no page is removed altogether, and of a marked main part less than what is kept.
    """
    if low and (template := beside_main(nodes, levels, low)):
        inside = [i in template for i in range(len(nodes))]
        for i in range(1, len(nodes)):
            inside[i] = inside[i] or inside[nodes[i]["parent"]]
        blocks = [b for b in blocks if not inside[b["node"]]]
    if not low:
        return "\n".join(b["text"] for b in blocks)
    chars, repeated = [0] * len(nodes), [0] * len(nodes)
    for b in blocks:
        n, size = b["node"], len(b["text"])
        chars[n] += size
        if feature(nodes[n]["place"], b["text"]) in low:
            repeated[n] += size
    for n in range(len(nodes) - 1, 0, -1):
        chars[nodes[n]["parent"]] += chars[n]
        repeated[nodes[n]["parent"]] += repeated[n]
    gone = [False] * len(nodes)
    for n in range(1, len(nodes)):
        gone[n] = gone[nodes[n]["parent"]] or 0 < (1 - LEAST) * chars[n] <= repeated[n]
    kept = [b["text"] for b in blocks if not gone[b["node"]]]
    enough = kept and (not marked or 2 * sum(map(len, kept)) >= chars[0])
    return "\n".join(kept if enough else [b["text"] for b in blocks])


def removed(table: DataFrame, low: DataFrame) -> DataFrame:
    """``page_id, url, text``: what is left of each page of ``table`` without branches of the features ``low``."""
    few = low.count() <= BROADCAST_ROWS
    if few:
        held = table.sparkSession.sparkContext.broadcast({r["v"] for r in low.collect()})
        rows = table.select("page_id", "url", "blocks", "nodes", "marked", "levels", F.array().cast("array<long>").alias("low"))
    else:
        held = table.sparkSession.sparkContext.broadcast(set())
        own = table.select("row", F.explode("stats").alias("s")).where("s.kind = 1").select("row", "s.v")
        own = own.union(table.select("row", F.explode("shapes").alias("s")).select("row", "s.place")).join(low, "v")
        rows = table.join(own.groupBy("row").agg(F.collect_set("v").alias("low")), "row", "left").select("page_id", "url", "blocks", "nodes", "marked", "levels", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                columns = [batch.column(c).to_pylist() for c in ("blocks", "nodes", "low", "marked", "levels")]
                text = [left_over(b, n, set(own) if own else held.value, m, at) for b, n, own, m, at in zip(*columns)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``."""
    table = store(parsed(pages), "parsed")
    low = store(low_features(table).union(low_shapes(table)), "low")
    return removed(table, low).withColumn("n_chars", F.length("text").cast("long"))


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
