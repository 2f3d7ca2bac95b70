"""Main text of web pages by the template of their host.

A page is read once as a sequence of tokens: tags and the words of short texts,
each qualified by the path of open elements above it.  A token's occurrence vector says how often it stands
on each page of the host.  Tokens that stand once on at least half of the
host's pages, with equal vectors, form an equivalence class; classes of two
tokens or more are kept.

On a page a class is valid if all its tokens stand there in the class's order.
Valid classes are nested, those of most pages first: a class joins the tree if
it lies in one gap of the classes that are in it already.  Tokens that repeat
(four div elements in a body) are then told apart: a container by the first
token of the tree that it holds itself, any other token by the gap it stands
in, how many of its like do, and which of these it is.  The classes of the
tokens so differentiated make the template.  A slot is what follows a token of the tree,
up to the next.

Slots have statistics over the host: pages, words outside of links that the
marks below leave, and whether all pages hold the same there.  The article's
element is the innermost container of the template that holds two thirds of
the words of all slots that vary; the search does not go below an article
element, nor away from a container's own varying heading.  The main text is
that of the element's slots, without slots that hold the same on every page.

Marks (element names, roles, words in class and id names) still take forms,
adverts, comments and the like out of the article, and if it holds an article
or main element only that is taken.  By marks alone are read pages of hosts with
fewer than MIN_PAGES pages, of hosts whose pages do not vary, and pages that
lack the template's article element.

Vectors are never built: a token's vector is summed up, task by task, as the
exclusive-or of a hash of (page, count) over its pages, together with the
number of pages and of occurrences, so that a host of any size is a few rows
per token and task.  Tokens on half of the pages at least can be at most twice
as many as a page has on average, which bounds a host's template and its slots.
The parsed pages are written once; later passes read their tokens only, and
meet their host's template, packed as bytes, in joins whose page side adaptive
execution can split.

Defined cases: null or empty html gives empty text; a null url or one without
a host is the host ''; markup cut off anywhere is read as far as it goes, and
its page has the classes that lie before the cut; repeated rows give a row
each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import written

MIN_PAGES = 5                    # a smaller host gets no template
SHORT_WORDS = 3                  # words up to which a text's words are tokens
LEVEL = 9                        # of zstandard, for what is shuffled
FLUSH_TOKENS = 300_000           # tokens a task sums up before it hands them on

# Elements of HTML by kind, and words that mark regions.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
             "td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title template iframe xmp noembed noframes".split())
DROPPED = set("head nav footer aside form header button select option input label dialog menu svg canvas object audio video map "
              "datalist fieldset script style noscript textarea title template iframe xmp noembed noframes".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "legend", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
SCOPES = set("ul ol dl table select article section div body".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARK = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|topbar|header|masthead|footer|foot|sidebar|side|aside|ad|ads|advert|adverts|"
    r"advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|disqus|reply|replies|respond|related|recommended|"
    r"share|sharing|social|breadcrumb|breadcrumbs|pagination|pager|widget|widgets|search|form|copyright|legal|disclaimer|skip|hidden)"
    r"(?:$|[\s_-])", re.I)
# words after these describe a layout, not the element itself
MODIFIED = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without|left|right)[_-]+[^\s_-]+", re.I)
# regions that hold articles other than the page's own, and stay regions inside an article whatever the element
OTHERS = re.compile(
    r"(?:^|[\s_-])(?:sidebar|aside|ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|newsletter|comment|"
    r"comments|disqus|reply|replies|respond|related|recommended|widget|widgets|nav|navbar|navigation|menu|menus|footer|popup|modal|"
    r"overlay)(?:$|[\s_-])", re.I)
# elements of running text
PROSE = set("p section h1 h2 h3 h4 h5 h6 blockquote pre table figure dl".split())
# elements that can be the article's own
CONTAINERS = set("article body center div form main section table tbody td tr".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:article-body|post-body|entry-content|post-content|article-content|main-content)(?:$|[\s_-])", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def _hash(path: int, word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) >> 1


class Page:
    """Tokens of a page, its containers, and its texts.

    ``within`` has the place of each token's container (-1: none), and
    ``boxes`` has for each container the place of its token, the place of the
    next container above (-1: none), and whether it is an article.  Each text is
    (text, block number, place of its first token, dropped, inside the article,
    in a heading, in a link, place of its container).

    ``spared`` holds elements, by number, that class words do not drop.
    ``holders`` are those that were dropped by class words alone although an
    article or main element stands in them; ``others`` likewise, if the words
    name a region of other articles."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset()):
        self.holders: set[int] = set()
        self.others: set[int] = set()
        self.tokens: list[int] = []
        self.within: list[int] = []
        self.boxes: list[tuple[int, int, int]] = []
        self.texts: list[tuple[str, int, int, bool, bool, bool, bool, int]] = []
        self.has_article = False
        # open elements: (name, path hash, dropped, inside the article, elements dropped by class words so far, or None if not by them alone, heading, link, place of its container)
        stack: list[tuple] = [("", 0, False, False, (), False, False, -1)]
        block, at, n, number = 0, 0, len(html), 0
        while at < n:
            m = _TAG.search(html, at)
            stop = m.start() if m else n
            if stop > at:
                self._text(html[at:stop], block, stack[-1])
            if not m:
                break
            at = m.end()
            name = (m.group("name") or "").lower()
            if not name:
                continue
            if m.group("end"):
                if name in BLOCKS:
                    block += 1
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        self.tokens.append(_hash(stack[k][1], "/" + name))
                        self.within.append(stack[k - 1][7])
                        del stack[k:]
                        break
                continue
            if name in CLOSES_P:
                self._close(stack, {"p"}, SCOPES)
            if name in SAME_LEVEL:
                self._close(stack, SAME_LEVEL[name], SCOPES - SAME_LEVEL[name])
            if name == "body":
                self._close(stack, {"head"}, set())
            if name in BLOCKS:
                block += 1
            attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(m.group("attrs") or "")}
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            top = stack[-1]
            path = _hash(top[1], f"{name} {names}")
            self.tokens.append(path)
            self.within.append(top[7])
            if name == "br":
                self._text(" ", block, top)
            if name in VOID or m.group("self"):
                continue
            number += 1
            dropped, inside, worded = top[2], top[3], top[4]
            marked = (name in DROPPED or attrs.get("role", "").lower() in ROLES or "hidden" in attrs
                      or attrs.get("aria-hidden") == "true")
            if marked:
                worded = None
            elif name not in ("html", "body", "main") and number not in spared and not CONTENT.search(names):
                own = MODIFIED.sub(" ", names)
                other = bool(OTHERS.search(own))
                if other or (MARK.search(own) and not (inside and name in PROSE)):
                    marked = True
                    worded = None if worded is None else (*worded, (number, other))
            if name in HEADINGS and inside and top[0] == "header" and not marked:
                dropped = False                     # an article's own heading may stand in its header
            elif marked:
                dropped = True
            if name in ("article", "main") or attrs.get("role", "").lower() == "main":
                if not dropped:
                    inside = self.has_article = True
                elif worded:
                    (self.others if any(other for _, other in worded) else self.holders).update(k for k, _ in worded)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close.end() if close else n
                self.tokens.append(_hash(path, "/" + name))
                self.within.append(top[7])
                continue
            box = top[7]
            if name in CONTAINERS:
                box = len(self.tokens) - 1
                self.boxes.append((box, top[7], int(name == "article")))
            stack.append((name, path, dropped, inside, worded, top[5] or name in HEADINGS, top[6] or name == "a", box))

    @staticmethod
    def _close(stack, names: set, scopes: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scopes:
                return

    def _text(self, raw: str, block: int, top) -> None:
        text = html_lib.unescape(raw) if "&" in raw else raw
        words = text.split()
        first = len(self.tokens)
        if len(words) <= SHORT_WORDS:
            self.tokens.extend(_hash(top[1], "#" + w) for w in words)
        self.within.extend([top[7]] * (len(self.tokens) - first))
        self.texts.append((text, block, first, top[2], top[3], top[5], top[6], top[7]))


def _own(page: Page) -> list:
    """The texts that the marks leave."""
    return [x for x in page.texts if not x[3] and (x[4] or not page.has_article)]


def read(html: str) -> Page:
    page = Page(html)
    spared = frozenset(page.holders)
    if spared:
        page = Page(html, spared)
    if page.others and not any(x[0].strip() for x in _own(page)):
        page = Page(html, spared | page.others)
    return page


class Template:
    """Classes of tokens, those of most pages first: rank of each token's class, its place in the class."""

    def __init__(self, packed: bytes):
        self.order: dict[int, tuple[int, int]] = {}
        self.size: Counter = Counter()
        for rank, token in np.frombuffer(packed, np.int64).reshape(-1, 2).tolist():
            self.order[token] = (rank, self.size[rank])
            self.size[rank] += 1

    def valid(self, tokens: list[int]) -> dict[int, list[int]]:
        """Rank -> places, of the classes whose tokens all stand here, in order, and no more often."""
        due: dict[int, list[int]] = {}
        bad: set[int] = set()
        for place, token in enumerate(tokens):
            at = self.order.get(token)
            if at is not None:
                places = due.setdefault(at[0], [])
                if len(places) != at[1]:
                    bad.add(at[0])
                places.append(place)
        return {rank: due[rank] for rank in sorted(due) if rank not in bad and len(due[rank]) == self.size[rank]}

    def nested(self, tokens: list[int]) -> list[int]:
        """Places, ascending, of the tokens of valid classes that nest in one another's gaps."""
        tree: list[int] = []
        for places in self.valid(tokens).values():
            gap = bisect(tree, places[0])
            if gap == bisect(tree, places[-1]):
                tree = sorted(tree + places)
        return tree


def roles(tokens: list[int], tree: list[int], within: list[int] = ()) -> list[int]:
    """Tokens told apart: a container by the first token of the tree that it holds itself, any other token by the
    gap of the tree it stands in, how often it does there, and the how-manieth it is."""
    out: list[int] = []
    holds: dict[int, int] = {}
    if within:
        known = set(tree)
        for place in tree:
            if within[place] not in known:
                holds.setdefault(within[place], tokens[place])
    for k in range(len(tree) + 1):
        first, stop = (tree[k - 1] if k else -1), (tree[k] if k < len(tree) else len(tokens))
        gap = tokens[first] if k else 0
        if k:
            out.append(gap)
        often = Counter(tokens[i] for i in range(first + 1, stop) if i not in holds)
        seen: Counter = Counter()
        for i in range(first + 1, stop):
            token = tokens[i]
            if i in holds:
                out.append(_told((token, holds[i])))
            else:
                seen[token] += 1
                out.append(_told((token, gap, often[token], seen[token])))
    return out


def _told(role: tuple) -> int:
    return hash(role) >> 1 & 0x7FFFFFFFFFFFFFFF


class Slots:
    """The template on one page: for each text, its slot and the template's containers around it."""

    def __init__(self, base: Template, template: Template, tokens: list[int], within: list[int], boxes: list):
        own = roles(tokens, base.nested(tokens), within)
        self.tree = template.nested(own)
        self.own = own
        known = set(self.tree)
        self.chains: dict[int, tuple[int, ...]] = {-1: ()}
        for place, above, article in boxes:
            up = self.chains[above]
            self.chains[place] = up + ((~own[place] if article else own[place]),) if place in known else up

    def of(self, first: int, box: int) -> tuple[int, tuple[int, ...]]:
        chain = self.chains[box]
        k = bisect(self.tree, first - 1)
        return hash((self.own[self.tree[k - 1]] if k else 0, chain)), chain


def article_element(slots: list[dict]) -> int | None:
    """The innermost container with two thirds of the varying words of a host's slots; None: nothing varies."""
    words, depth = Counter(), {}
    varying = [s for s in slots if s["varies"]]
    total = sum(s["words"] for s in varying)
    for s in varying:
        for k, e in enumerate(s["chain"]):
            words[e] += s["words"]
            depth[e] = k
    found = None
    for e in sorted((e for e in words if total and 3 * words[e] >= 2 * total), key=lambda e: (depth[e], e)):
        if found is not None and (found < 0 or any(s["heading"] and s["chain"] and s["chain"][-1] == found for s in varying)):
            break
        found = e
    return found


def _parsed(batches):
    """Per page: what later passes need, compressed: tokens with their containers; containers and facts of texts;
    hashes of texts; texts.  Texts that the marks drop are left out."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        hosts, keys, article, columns = [], [], [], ([], [], [], [])
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = read(html or "")
            rows, hashes, raw = [], [], []
            for text, block, first, dropped, inside, heading, link, box in page.texts:
                if not dropped:
                    words, data = text.split(), text.encode("utf-8", "surrogatepass")
                    raw.append(data)
                    rows.append((block, first, 2 * inside + 4 * heading + 8 * link, box, len(words), len(data)))
                    hashes.append(_hash(0, " ".join(words)) if words else 0)
            hosts.append(host_of(url))
            keys.append(xxhash.xxh64_intdigest(((url or "") + "\0" + (html or "")).encode("utf-8", "surrogatepass")) >> 1)
            article.append(page.has_article)
            head = np.array([len(page.boxes)], np.int32).tobytes()
            for column, data in zip(columns, (np.array(page.tokens, np.int64).tobytes() + np.array(page.within, np.int32).tobytes(),
                                              head + np.array(page.boxes, np.int32).tobytes() + np.array(rows, np.int32).T.tobytes(),
                                              np.array(hashes, np.int64).tobytes(), b"".join(raw))):
                column.append(pack(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(article, pa.bool_()),
             *(pa.array(v, pa.binary()) for v in columns)],
            names=["id", "url", "host", "key", "article", "tokens", "facts", "hashes", "z"])


def _tokens(raw: bytes) -> tuple[list[int], list[int]]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.int64, n).tolist(), np.frombuffer(raw, np.int32, n, 8 * n).tolist()


def _facts(raw: bytes) -> tuple[list, list]:
    """Containers, and of each text: block, first token, flags, container, words, bytes."""
    got = np.frombuffer(raw, np.int32)
    stop = 1 + 3 * int(got[0])
    return got[1:stop].reshape(-1, 3).tolist(), got[stop:].reshape(6, -1).T.tolist()


def _unpacked(column) -> list:
    """Templates of a column, built once for each run of equal ones."""
    out, last, got = [], None, None
    for raw in column.to_pylist():
        if raw is not None and raw != last:
            last, got = raw, Template(raw)
        out.append(None if raw is None else got)
    return out


def _vectors(it):
    """Per task: host, token, exclusive-or over its pages, pages, occurrences, earliest place."""
    sums: dict[tuple[str, int], list[int]] = {}

    def out():
        keys, vals = list(sums), list(sums.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             *(pa.array([v[i] for v in vals], pa.int64()) for i in range(4))],
            names=["host", "token", "vector", "pages", "total", "place"])

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in it:
        base = _unpacked(batch.column("base")) if "base" in batch.schema.names else [None] * batch.num_rows
        for host, key, raw, template in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "tokens")), base):
            tokens, within = _tokens(unpack(raw))
            if template is not None:
                tokens = roles(tokens, template.nested(tokens), within)
            seen: dict[int, list[int]] = {}
            for place, token in enumerate(tokens):
                got = seen.get(token)
                if got is None:
                    seen[token] = [1, place]
                else:
                    got[0] += 1
            seen[-1] = [1, 0]                                  # the page itself
            hashes = [_hash(key, str(k)) for k in range(8)]
            for token, (count, place) in seen.items():
                h = hashes[count] if count < 8 else _hash(key, str(count))
                got = sums.get((host, token))
                if got is None:
                    sums[(host, token)] = [h, 1, count, place]
                else:
                    got[0] ^= h
                    got[1] += 1
                    got[2] += count
                    got[3] = min(got[3], place)
            if len(sums) >= FLUSH_TOKENS:
                yield out()
                sums.clear()
    yield out()


def _packed(batches):
    """Classes of two tokens or more, by pages and size, as (rank, token) in the order of places."""
    for batch in batches:
        out = []
        for tokens in batch.column("tokens").to_pylist():
            classes: dict[int, list] = {}
            for t in tokens:
                classes.setdefault(t["class"], []).append(t)
            kept = sorted((c for c in classes.values() if len(c) > 1), key=lambda c: (-c[0]["pages"], -len(c), c[0]["class"]))
            out.append(np.array([(rank, t["token"]) for rank, c in enumerate(kept) for t in c], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.binary())], names=["host", "packed"])


def templates(pages: DataFrame, name: str, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, packed): classes of each host's once-per-page tokens."""
    stats = (pages.mapInArrow(_vectors, "host string, token long, vector long, pages long, total long, place long")
             .groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"),
                                           F.sum("total").alias("total"), F.min("place").alias("place"))
             .where((F.col("pages") >= min_pages) & (F.col("total") == F.col("pages"))))
    stats = written(stats, f"{name}_tokens")
    hosts = stats.where("token = -1").select("host", F.col("pages").alias("n"))
    often = stats.where("token != -1").join(hosts, "host").where("2 * pages >= n")
    token = F.struct("place", "token", F.xxhash64("vector", "pages").alias("class"), "pages")
    grouped = often.groupBy("host").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    return written(grouped.mapInArrow(_packed, "host string, packed binary"), name)


def _slot_stats(batches):
    """Per task and slot: pages, words, least and greatest content hash, whether in a heading; slot 0 stands for the page."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sums: dict[tuple, list] = {}
        rows = zip(batch.column("host").to_pylist(), _unpacked(batch.column("base")), _unpacked(batch.column("template")),
                   *(batch.column(c).to_pylist() for c in ("tokens", "facts", "hashes")))
        for host, base, template, tokens, facts, hashes in rows:
            boxes, texts = _facts(unpack(facts))
            slots = Slots(base, template, *_tokens(unpack(tokens)), boxes)
            page: dict[tuple, list] = {(0, ()): [0, 0, False]}
            for (_, first, flags, box, words, _), content in zip(texts, np.frombuffer(unpack(hashes), np.int64).tolist()):
                if not words:
                    continue
                got = page.setdefault(slots.of(first, box), [0, 0, False])
                got[0] += 0 if flags & 8 else words
                got[1] = hash((got[1], content))
                got[2] |= bool(flags & 4)
            for (slot, chain), (words, content, heading) in page.items():
                got = sums.setdefault((host, slot, chain), [0, 0, content, content, False])
                got[0] += 1
                got[1] += words
                got[2], got[3] = min(got[2], content), max(got[3], content)
                got[4] |= heading
        keys, vals = list(sums), list(sums.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([list(k[2]) for k in keys], pa.list_(pa.int64())),
             *(pa.array([v[i] for v in vals], pa.int64()) for i in range(4)), pa.array([v[4] for v in vals], pa.bool_())],
            names=["host", "slot", "chain", "pages", "words", "low", "high", "heading"])


def _articles(batches):
    """Per host: the article's element (without its article sign), then the slots that hold the same on every page."""
    for batch in batches:
        out = []
        for slots in batch.column("slots").to_pylist():
            element = article_element(slots)
            fixed = [s["slot"] for s in slots if s["fixed"]]
            out.append(None if element is None else np.array([element, *fixed], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.binary())], names=["host", "article_slots"])


def articles(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, article_slots) from pages joined with their templates."""
    stats = (pages.mapInArrow(_slot_stats, "host string, slot long, chain array<long>, pages long, words long, low long, high long, heading boolean")
             .groupBy("host", "slot", "chain").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"), F.min("low").alias("low"),
                                                   F.max("high").alias("high"), F.max("heading").alias("heading")))
    stats = written(stats, "slots")
    hosts = stats.where("slot = 0").select("host", F.col("pages").alias("n"))
    # slots of few pages count for their containers only
    slots = (stats.where("slot != 0").join(hosts, "host").withColumn("slot", F.expr("if(2 * pages >= n, slot, 0)"))
             .groupBy("host", "slot", "chain").agg(
                 F.sum("words").alias("words"), F.max("heading").alias("heading"), F.expr("max(low != high or slot = 0)").alias("varies"),
                 F.expr(f"max(slot != 0 and low = high and pages = n and n >= {int(min_pages)})").alias("fixed")))
    slot = F.struct("slot", "chain", "words", "heading", "varies", "fixed")
    grouped = slots.groupBy("host").agg(F.collect_list(slot).alias("slots"))
    return written(grouped.mapInArrow(_articles, "host string, article_slots binary"), "articles")


def _joined(texts) -> str:
    """Texts as (text, block) put together."""
    blocks: list[str] = []
    last, parts = None, []

    def close():
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)

    for text, block in texts:
        if block != last:
            close()
            last, parts = block, []
        parts.append(text)
    close()
    return "\n\n".join(blocks)


def main_text(html: str) -> str:
    """The main text by marks alone."""
    return _joined((x[0], x[1]) for x in _own(read(html)))


def _texts(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        rows = zip(_unpacked(batch.column("base")), _unpacked(batch.column("template")),
                   *(batch.column(c).to_pylist() for c in ("article", "article_slots", "tokens", "facts", "z")))
        for base, template, has_article, found, tokens, facts, z in rows:
            data, at, texts = unpack(z), 0, []
            boxes, facts = _facts(unpack(facts))
            for block, first, flags, box, words, size in facts:
                texts.append((data[at:at + size].decode("utf-8", "surrogatepass"), block, first, flags, box, words))
                at += size
            own = []
            if base is not None and template is not None and found is not None:
                element, *fixed = np.frombuffer(found, np.int64).tolist()
                slots = Slots(base, template, *_tokens(unpack(tokens)), boxes)
                for x in texts:
                    slot, chain = slots.of(x[2], x[4])
                    if element in chain and not (x[5] and slot in fixed):
                        own.append(x)
                if any(x[3] & 2 and x[5] for x in own):
                    own = [x for x in own if x[3] & 2]
            if not any(x[5] for x in own):
                own = [x for x in texts if x[3] & 2 or not has_article]
            out.append(_joined((x[0], x[1]) for x in own))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES) -> DataFrame:
    """(``id_col``, ``url_col``, text) for every page."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = own.schema["id"].dataType.simpleString()
    parsed = written(own.mapInArrow(_parsed, f"id {id_type}, url string, host string, key long, article boolean, tokens binary, "
                                             "facts binary, hashes binary, z binary"), "parsed")
    base = templates(parsed.select("host", "key", "tokens"), "base", min_pages).withColumnRenamed("packed", "base")
    told = parsed.select("host", "key", "tokens").join(base, "host")
    full = templates(told, "template", min_pages).withColumnRenamed("packed", "template").join(base, "host")
    slots = articles(parsed.select("host", "tokens", "facts", "hashes").join(full, "host"), min_pages)
    dealt = parsed.join(full.join(slots, "host"), "host", "left")
    got = dealt.select("id", "url", "article", "base", "template", "article_slots", "tokens", "facts", "z").mapInArrow(
        _texts, f"id {id_type}, url string, text string")
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
