"""Main text of web pages by consensus of a host's pages.

1. Each page's containers are scored by the text they hold outside menus,
   adverts, forms and the like; the best container votes for its generalised
   path (tags and class words, digits out).
2. Votes are summed per host in Spark, with partial sums before the shuffle.
3. Pages are extracted again with the winning path of their host; a page
   without such a container keeps its own best one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import tidy

#: Hosts whose winning paths are broadcast (some 200 bytes each); beyond, they are joined.
BROADCAST_HOSTS = 100_000
#: Parts into which a host's pages are dealt for that join.
SALTS = 16

#: Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
DROPPED = frozenset("nav footer aside form menu dialog button select option input textarea script style noscript template iframe object embed applet svg math canvas audio video map head".split())
#: Words in a class, id or role that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert"
    " sidebar menu menubar nav navbar navigation navigator breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe subscription signup login"
    " popup modal overlay comment comments commentlist respond reply replies disqus discussion footer topbar toolbar pagination pager widget"
    " contentinfo complementary search skip hidden".split()
)
#: Words that mark a page's header, which inside an article holds its title.
HEADER = frozenset("header masthead".split())
#: Words that name the article itself.
CONTENT = frozenset("article articlebody content post entry story main body text blog".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>|<[!?/][^>]*+>", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _marks(attributes: str) -> tuple[set[str], str, bool]:
    """Words of class, id and role; the generalised class; whether the element is hidden."""
    words: set[str] = set()
    shown, hidden = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", value)))
            words.update(w.lower() for w in _WORDS.findall(value))
            if name == "class":
                shown = ".".join(sorted({_DIGITS.sub("", w.lower()) for w in value.split()}))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return words, shown, hidden


#: Share of a page's text below which its rules have left nothing; characters of the least article that is looked for then.
NOTHING, ARTICLE = 0.1, 400


class _Open:
    """An open element."""

    __slots__ = ("tag", "dropped", "container", "in_article", "mark")

    def __init__(self, tag, dropped, container, in_article, mark):
        self.tag, self.dropped, self.container, self.in_article, self.mark = tag, dropped, container, in_article, mark


class Page:
    """The text blocks of a page outside boilerplate, and its containers.

    blocks: (text, length in links, innermost container); containers: (path,
    parent, whether its name says content, depth).  Container 0 is the page.
    marks: (characters of its own, enclosing mark, whether it may hold an article) of
    the elements that a word or being a form drops; those in ``spared`` stay.
    """

    def __init__(self, source: str, spared: frozenset[int] = frozenset()):
        self.total, self.marks = 0, []
        self.blocks: list[tuple[str, int, int]] = []
        self.containers: list[tuple[str, int, bool, int]] = [("", -1, False, 0)]
        stack = [_Open("", False, 0, False, -1)]
        piece: list[str] = []
        linked, in_link, at, n = 0, 0, 0, len(source)
        last_end, opened = source.rfind(">"), Counter()  # no tag ends beyond; how often each tag is open

        def flush():
            nonlocal linked
            if piece:
                text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
                if text:
                    self.blocks.append((text, min(linked, len(text)), stack[-1].container))
                piece.clear()
            linked = 0

        def keep(text: str):
            nonlocal linked
            if text and not in_link:
                size = len(text.strip())
                self.total += size
                if stack[-1].mark >= 0:
                    self.marks[stack[-1].mark][0] += size
            if text and not stack[-1].dropped:
                piece.append(text)
                if in_link:
                    linked += len(text)

        while at < n:
            m = _TAG.search(source, at) if at <= last_end else None
            if m is None:
                cut = _CUT.search(source, max(at, last_end + 1))  # a tag that the page's end cuts off
                keep(source[at : cut.start()] if cut else source[at:])
                break
            keep(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCKS:
                    flush()
                if tag == "a":
                    in_link = 0
                for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[i].tag == tag:
                        if tag not in BLOCKS and any(x.dropped != stack[i].dropped for x in stack[i + 1 :]):
                            break
                        opened.subtract(x.tag for x in stack[i:])
                        del stack[i:]
                        break
                continue
            if tag in BLOCKS:
                flush()
            if tag == "a":
                in_link = 1
            top = stack[-1]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and top.tag == tag:
                opened[stack.pop().tag] -= 1
                top = stack[-1]
            words, shown, hidden = _marks(m[3]) if m[3].strip() else (set(), "", False)
            named = tag in ("article", "main") or bool(words & CONTENT)
            in_article = top.in_article or named
            marked = bool(words & BOILERPLATE) and tag not in ("html", "body", "article", "main")
            form, mark = tag == "form", top.mark
            if marked or form:
                mark = len(self.marks)
                self.marks.append([0, top.mark, form or bool(words & CONTENT)])
                marked, form = marked and mark not in spared, form and mark not in spared
            dropped = top.dropped or form or tag in DROPPED and tag != "form" or hidden or marked or (tag == "header" or bool(words & HEADER)) and not top.in_article and tag not in ("html", "body", "article", "main")
            container = top.container
            if tag in CONTAINERS and not dropped:
                path, _, _, depth = self.containers[container]
                self.containers.append((f"{path}/{tag}" + (f".{shown}" if shown else ""), container, named, depth + 1))
                container = len(self.containers) - 1
            if tag in BLOCKS or tag in CONTAINERS or dropped != top.dropped or mark != top.mark:
                stack.append(_Open(tag, dropped, container, in_article, mark))
                opened[tag] += 1
        flush()

    def best(self) -> int:
        """The container with the most text outside links; the deepest one that holds most of the page's."""
        own = [0.0] * len(self.containers)
        for text, linked, container in self.blocks:
            own[container] += max(0, len(text) - 2 * linked)
        total = own[:]
        for i in range(len(own) - 1, 0, -1):
            total[self.containers[i][1]] += total[i]
        score = [t * (1.3 if c[2] else 1.0) for t, c in zip(total, self.containers)]
        most = max(score)
        good = [i for i, s in enumerate(score) if s >= 0.8 * most]
        named = [i for i in good if self.containers[i][2]]
        if most <= 0:
            return 0
        # Of named containers the outermost below the page, else the innermost that still holds nearly all.
        return min(named, key=lambda i: (self.containers[i][3], i)) if named else max(good, key=lambda i: (self.containers[i][3], -i))

    def text(self, chosen: set[int]) -> str:
        """Blocks within the chosen containers, in page order."""
        inside = [False] * len(self.containers)
        for i, (_, parent, _, _) in enumerate(self.containers):
            inside[i] = i in chosen or parent >= 0 and inside[parent]
        return " ".join(text for text, _, container in self.blocks if inside[container])

    def by_path(self, path: str | None) -> str:
        found = {i for i, c in enumerate(self.containers) if c[0] == path} if path else set()
        text = self.text(found) if found else ""
        return text or self.text({self.best()})


def read_page(source: str) -> Page:
    """The page; where its rules leave next to nothing, without them for elements that hold most of its text.

    Such an element is named as content too (``content has-sidebar``), or is a
    form around the page, and has as much text as an article: a word or a tag
    alone never empties a page.
    """
    page = Page(source)
    kept = sum(max(0, len(text) - linked) for text, linked, _ in page.blocks)
    if not page.marks or kept > NOTHING * page.total:
        return page
    sizes = [m[0] for m in page.marks]
    for i in range(len(sizes) - 1, -1, -1):
        if page.marks[i][1] >= 0:
            sizes[page.marks[i][1]] += sizes[i]
    spared = frozenset(i for i, size in enumerate(sizes) if page.marks[i][2] and size >= max(ARTICLE, page.total / 2))
    return Page(source, spared) if spared else page


def host_of(url):
    """The host of a URL, lower case, without port and user; null and odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _voter(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            hosts, paths, weights = batch.column(0).to_pylist(), [], []
            for source in batch.column(1).to_pylist():
                page = read_page(source)
                best = page.best()
                paths.append(page.containers[best][0] if page.blocks else None)
                weights.append(1 if page.blocks else 0)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], schema=schema)

    return run


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of a host, ties to the smaller path."""
    store.ship(pages.sparkSession)
    schema = T.StructType().add("host", T.StringType()).add("path", T.StringType()).add("n", T.LongType())
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("html"))
    votes = rows.mapInArrow(tidy(_voter(to_arrow_schema(schema))), schema).where("path IS NOT NULL").groupBy("host", "path").agg(F.sum("n").alias("n"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("order"), "path"))["path"].alias("path"))


def _extractor(fields: list[str], schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sources, paths = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("__cv_html", "__cv_path"))
                texts = [read_page(s).by_path(p) for s, p in zip(sources, paths)]
                made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([made[f] if f in made else part.column(f).cast(schema.field(f).type) for f in fields], schema=schema)

    return run


def extract(pages: DataFrame, url: str = "url", source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``pages`` with text (main text, '' if none) and n_chars.

    keep: the columns to return (all but the html by default); columns named
    text or n_chars are replaced.  Null html is empty.  Pages whose URL is null
    or has no host vote together.  Repeated rows are extracted alike.
    """
    spark = pages.sparkSession
    store.ship(spark)
    kept = [c for c in (keep if keep is not None else [c for c in pages.columns if c != source]) if c not in ("text", "n_chars")]
    winners = store.publish(winning_paths(pages, url, source), "paths")
    rows = pages.select(*kept, host_of(F.col(url)).alias("__cv_host"), F.coalesce(F.col(source), F.lit("")).alias("__cv_html"))
    named = winners.select(F.col("host").alias("__cv_host"), F.col("path").alias("__cv_path"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(named), "__cv_host", "left")
    else:
        salted = named.withColumn("__cv_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__cv_salt", F.pmod(F.xxhash64("__cv_html"), F.lit(SALTS)).cast("int")).join(salted, ["__cv_host", "__cv_salt"], "left")
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(tidy(_extractor(schema.names, to_arrow_schema(schema))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op8_main_text": query}
ORACLES: dict[str, str] = {}
