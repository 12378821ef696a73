"""Main text of web pages by deducing the template of each host.

A page is read as blocks of text, each on a path of elements. Tokens are the paths of a page's elements and its blocks'
texts. Over the pages of a host each token has an occurrence vector: how often it stands in each page. Tokens with one
vector form an equivalence class. A class is valid if it recurs on enough pages of those that have its slot's path and its
vector has a path; texts in a valid class are part of the template (menus, notices, imprints), also inside articles.
Valid classes nest by their paths; the slots are the paths that they leave open. The innermost path that leaves no open slot beside links outside, on nearly all pages, is the host's main
region; pages with a marked article or main part count only what is inside. From each page the open slots of the main
region are taken: without template texts, slots of links that stand apart from text, and regions that markup gives away.
Names of classes are evidence: outside articles they give a region away; inside, most only lower the support that makes
a text or slot part of the template, and those of adverts and comments take a region, but never all of an article.

Occurrence vectors are never gathered: a vector is represented by the sum over its pages of a hash of page and count,
which tasks pre-aggregate, so a host with a third of all pages costs no more to any task than others do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import settle, small_batches, table

#: A valid class stands on so many pages; to take texts from marked articles, on so many and such a share of the pages
#: with its slot, if that has a name, else with its article.
LEAST_PAGES, LEAST_INSIDE, LEAST_SHARE = 3, 5, 0.8
#: Outside articles, or under a name that speaks against it, a class stands on such a share of the host's pages.
LEAST_OUTSIDE = 0.2
#: The main region leaves no open slot outside on such a share of the pages. Marked parts count alone if they hold at
#: least one character for so many outside.
MAIN_SHARE, MARKED = 0.95, 5
#: Templates go to executors whole up to so many bytes, else by a salted join.
MOST_BYTES, SALTS = 64 << 20, 32

# Elements by role, and names that give a region away.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe canvas noframes".split())
APART = frozenset("nav aside footer form button select label fieldset dialog menu head".split())
CONTENT = frozenset("article main".split())
#: Elements that are parts of a region, never one.
PARTS = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hgroup table thead tbody tfoot tr td th caption blockquote pre figure figcaption summary details address center".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())
#: Names of what a page has beside its text. Inside an article they take a region.
BESIDE = "ad|ads|advert|adverts|advertisement|advertising|adsense|cookie|cookies|consent|gdpr|menu|nav|navbar|navigation|topnav|breadcrumb|breadcrumbs|sidebar|related|recommended|share|sharing|comments|comment|commentlist|replies|respond|disqus|newsletter|subscribe|pagination|pager"
#: Inside an article these only speak against a region.
DOUBTED = "banner|sponsor|sponsored|promo|promotion|notice|alert|side|widget|social|reply|discussion|popup|modal|overlay|subscription|login|signup|footer|masthead|topbar|toolbar|skip|search|copyright|legal|disclaimer|toc|hidden|print"
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{BESIDE}|{DOUBTED})(?:$|[\s_-])")
LEADING = re.compile(rf"(?:^|\s)(?:{BESIDE})(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"\bhidden(?:\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

Block = tuple[str, str, int, bool, int]
#: What speaks against a block: nothing, a name, a name of things beside the text, its markup.
OPEN, NAMED_SO, BESIDE_TEXT, APART_BY_MARKUP = range(4)


def _apart(tag: str, rest: str, inside: bool) -> int:
    """What speaks against an element; inside an article headers are part of it, and names decide less."""
    if tag in APART or (tag == "header" and not inside):
        return APART_BY_MARKUP
    if "=" not in rest and "hidden" not in rest:
        return OPEN
    if UNSEEN.search(rest):
        return APART_BY_MARKUP
    if tag in ("html", "body", "main") or tag == "article" and not inside:
        return OPEN
    names = [(a or b or c).lower() for a, b, c in NAMED.findall(rest)]
    if not any(UNWANTED.search(x) for x in names):
        return OPEN
    if not inside:
        return APART_BY_MARKUP
    if tag not in PARTS and any(LEADING.search(x) for x in names):
        return BESIDE_TEXT
    return NAMED_SO if tag in BLOCK else OPEN


def blocks_of(page: str) -> tuple[list[Block], list[str]]:
    """Blocks (path, text, what speaks against it, in content, characters in links) and the paths of the block elements.

    Broken markup is read leniently: an end tag closes up to its start tag if there is one; a paragraph ends at the
    next block; unknown elements are inline.
    """
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, what speaks against it, in content
    out: list[Block] = []
    paths: list[str] = []
    words: list[str] = []
    links = [0, 0]  # depth, characters
    at = 0

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                _, path, apart, content = stack[-1] if stack else ("", "", OPEN, False)
                out.append((path, text, apart, content, min(links[1], len(text))))
            words.clear()
            links[1] = 0

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            words.append(piece)
            if links[0]:
                links[1] += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links[0] = max(0, links[0] - 1)
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and any(s[0] in BLOCK for s in stack[i:]):
                        break
                    if stack[i][2] != (stack[i - 1][2] if i else OPEN):
                        flush()
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|</{tag}$", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else n)
            if tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                words.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            links[0] += 1
        block = tag in BLOCK
        if block:
            flush()
            while stack and stack[-1][0] not in BLOCK and not stack[-1][2]:
                stack.pop()
            if stack and stack[-1][0] == "p" or tag in CLOSED_BY_SAME and stack and stack[-1][0] == tag:
                stack.pop()
        above = stack[-1] if stack else ("", "", OPEN, False)
        apart = max(above[2], _apart(tag, m[3], above[3]))
        if not block and apart == above[2]:
            continue
        if not block:
            flush()
        name = NAMED.search(m[3]) if "=" in m[3] else None
        step = tag if name is None else f"{tag}.{(name[1] or name[2] or name[3] or '').strip().lower()}"
        path = f"{above[1]}/{step}"
        if not m[3].endswith("/"):
            stack.append((tag, path, apart, above[3] or tag in CONTENT))
        paths.append(path)
    flush()
    return out, paths


def _hash(values: list[str]) -> list[int]:
    return [int.from_bytes(blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for v in values]


def _hash_column(values: pd.Series) -> pd.Series:
    different = values.unique().tolist()
    return values.map(dict(zip(different, _hash(different)))).astype("int64")


def regions(path: str) -> list[str]:
    """Paths that may be the main region of a block at path: around it, down to a marked article, without mere parts."""
    out, at = [""], ""
    for step in path.split("/")[1:]:
        at = f"{at}/{step}"
        tag = step.split(".")[0]
        if tag not in PARTS:
            out.append(at)
        if tag == "article":
            break
    return out


def _is_heading(path: str) -> bool:
    return path.rsplit("/", 1)[-1].split(".")[0] in HEADINGS


def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each token of a page.

    kind: 0 for a path, 1 for a text outside a marked article or with a name against it, 2 inside; slot: the path that its
    support is measured against; n: how often; plain (characters beside links) and linked characters just on a path.
    """
    for batch in batches:
        for first in range(0, len(batch), 100):
            rows = []
            for host, page, source in batch[["host", "page", "html"]][first : first + 100].itertuples(index=False):
                blocks, paths = blocks_of(source)
                found: dict[tuple[str, int, str], list[int]] = {}
                for p in ["", *paths]:
                    found.setdefault((p, 0, p), [0, 0, 0])[0] += 1
                for path, text, apart, content, linked in blocks:
                    inside = content and apart == OPEN
                    named = "." in path.rsplit("/", 1)[-1] and not _is_heading(path)
                    slot = "" if not inside else path if named else regions(path)[-1]
                    found.setdefault((f"{path}\x1f{text}", 2 if inside else 1, slot), [0, 0, 0])[0] += 1
                    own = found.setdefault((path, 0, path), [1, 0, 0])
                    own[1] += len(text) - linked
                    own[2] += linked
                rows += [(host, page, *key, *x) for key, x in found.items()]
            if rows:
                out = pd.DataFrame(rows, columns=["host", "page", "token", "kind", "slot", "n", "plain", "linked"])
                for c in ("token", "slot"):
                    out[c] = _hash_column(out[c])
                yield out


TOKENS = "host string, page long, token long, kind int, slot long, n int, plain long, linked long"


def covers_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page the paths that leave no open slot outside."""
    known = Sets()
    for batch in batches:
        rows = []
        for host, source, texts, links in batch[["host", "html", "texts", "links"]].itertuples(index=False):
            chosen = main_blocks(source, known(texts), known(links))[1]
            if chosen:
                around = [regions(b[0]) for b in chosen]
                common = set(around[0]).intersection(*around[1:])
                rows += [(host, p, p.count("/")) for p in common]
        out = pd.DataFrame(rows, columns=["host", "token", "depth"])
        if rows:
            out["token"] = _hash_column(out["token"])
            yield out


def different_pages(rows: DataFrame) -> DataFrame:
    """Of rows(host, page, uid, ...) of a host with equal pages those of one uid.

    Only keys of repeated pages are looked up, so that html stays where it is: a group of copies is one key.
    """
    repeated = rows.groupBy(F.col("host").alias("_h"), F.col("page").alias("_p")).agg(F.max("uid").alias("_uid"), F.count("*").alias("_n"))
    repeated = settle(repeated.where("_n > 1").drop("_n"), "repeated")
    size = repeated.agg(F.sum(F.length("_h") + 48)).first()[0] or 0
    found = rows.join(F.broadcast(repeated) if size <= MOST_BYTES else repeated, (F.col("host") == F.col("_h")) & (F.col("page") == F.col("_p")), "left")
    return found.where("_uid IS NULL OR _uid = uid").drop("_h", "_p", "_uid")


def templates(rows: DataFrame) -> DataFrame:
    """rows(host, page, html), different pages -> (host, texts, links): hashes of the template's texts and of slots of links."""
    found = rows.mapInPandas(tokens_of, TOKENS)
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)"))
    sums = [F.sum(c).alias(c) for c in ("plain", "linked")]
    found = found.groupBy("host", "token", "kind", "slot").agg(vector.alias("vector"), F.count("*").alias("support"), *sums)
    found = settle(found.where(F.col("support") >= LEAST_PAGES), "tokens")
    paths = found.where("kind = 0")
    slots = paths.select(F.col("host").alias("_h"), F.col("token").alias("_s"), F.col("support").alias("pages"))
    sized = found.join(slots, (F.col("host") == F.col("_h")) & (F.col("slot") == F.col("_s")))
    # a class that takes texts has a path, and stands on enough of the pages that could have it
    enough = F.col("support") >= F.col("pages") * F.when(F.col("kind") == 2, LEAST_SHARE).when(F.col("kind") == 1, LEAST_OUTSIDE).otherwise(0)
    inside = (F.col("kind") < 2) | (F.col("support") >= LEAST_INSIDE)
    classes = sized.where(inside & enough).groupBy("host", "vector").agg(F.bool_or(F.col("kind") == 0).alias("valid"), F.collect_set(F.when(F.col("kind") > 0, F.col("token"))).alias("texts"))
    texts = classes.where("valid").select("host", F.explode("texts").alias("token"), F.lit(True).alias("is_text"))
    links = paths.where("linked > plain").select("host", "token", F.lit(False).alias("is_text"))
    both = texts.unionByName(links).groupBy("host")
    return both.agg(F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("texts"), F.collect_set(F.when(~F.col("is_text"), F.col("token"))).alias("links"))


def main_regions(rows: DataFrame) -> DataFrame:
    """rows(host, html, texts, links), different pages -> (host, region): hash of the main region's path."""
    covers = rows.mapInPandas(covers_of, "host string, token long, depth int").groupBy("host", "token").agg(F.count("*").alias("support"), F.max("depth").alias("depth"))
    covers = settle(covers, "covers")
    pages = covers.where("depth = 0").groupBy(F.col("host").alias("_h")).agg(F.max("support").alias("pages"))
    most = covers.join(pages, F.col("host") == F.col("_h")).where(F.col("support") >= MAIN_SHARE * F.col("pages"))
    return most.groupBy("host").agg(F.max_by("token", F.struct("depth", "support", "token")).alias("region"))


def main_blocks(source: str, texts: frozenset[int], links: frozenset[int]) -> tuple[list[Block], list[Block]]:
    """(Blocks that may belong to the main text, those of open slots): without the template's texts and slots of links.

    Slots of links stay among the first beside text in the same container, and in marked articles, if no name speaks
    against them. Names never take all of an article but its headings.
    """
    blocks, _ = blocks_of(source)
    known = _hash([f"{b[0]}\x1f{b[1]}" for b in blocks])
    blocks = [b for b, h in zip(blocks, known) if h not in texts and b[2] != APART_BY_MARKUP]
    rest = [b for b in blocks if b[2] != BESIDE_TEXT]
    if len(rest) < len(blocks) and any(not _is_heading(b[0]) for b in rest if b[3]):
        blocks = rest
    sums: dict[str, int] = {}
    for path, text, _, _, linked in blocks:
        sums[path] = sums.get(path, 0) + len(text) - 2 * linked
    of = dict(zip(sums, _hash(list(sums))))
    linking = {p for p in sums if sums[p] < 0 or of[p] in links}
    open_ones = [b for b in blocks if b[0] not in linking]
    marked = sum(len(b[1]) - b[4] for b in open_ones if b[3])
    if marked * MARKED >= sum(len(b[1]) - b[4] for b in open_ones if not b[3]) and any(b[3] for b in open_ones):
        open_ones = [b for b in open_ones if b[3]]
    beside = {regions(b[0])[-1] for b in open_ones}
    kept = [b for b in blocks if b[0] not in linking or b[2] == OPEN and (b[3] or regions(b[0])[-1] in beside)]
    return kept, open_ones


def main_text(source: str, texts: frozenset[int], links: frozenset[int], region: int | None) -> str:
    """Blocks of the main region; if the page has nothing there, of its own smallest region without an open slot outside."""
    blocks, open_ones = main_blocks(source, texts, links)
    paths = {b[0]: regions(b[0]) for b in blocks}
    names = sorted({p for ps in paths.values() for p in ps})
    of = dict(zip(names, _hash(names)))
    inside = [b for b in blocks if any(of[p] == region for p in paths[b[0]])]
    if not inside and open_ones:
        own = max(set(paths[open_ones[0][0]]).intersection(*(paths[b[0]] for b in open_ones)), key=lambda p: (p.count("/"), p))
        inside = [b for b in blocks if own in paths[b[0]]]
    # the page's title may stand before the region
    title = [b for b in blocks if b[0].rsplit("/", 1)[-1].split(".")[0] == "h1"]
    if title and inside and not any(b in title for b in inside):
        inside = title + inside
    # an unmarked region may surround the marked part of a page
    if any(b[3] for b in open_ones) and all(b[3] for b in open_ones):
        inside = [b for b in inside if b[3] or b in title]
    return "\n".join(b[1] for b in inside)


class Sets:
    """Sets of hashes, kept while rows of one host follow each other."""

    def __init__(self) -> None:
        self.of: dict[bytes, frozenset[int]] = {}

    def __call__(self, x: np.ndarray | None) -> frozenset[int]:
        key = b"" if x is None else np.asarray(x, np.int64).tobytes()
        if key not in self.of:
            if len(self.of) > 1000:
                self.of.clear()
            self.of[key] = frozenset(np.frombuffer(key, np.int64).tolist())
        return self.of[key]


def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = Sets()
    for source, texts, links, region in batches:
        yield pd.Series([main_text(s or "", known(t), known(k), None if pd.isna(r) else int(r)) for s, t, k, r in zip(source, texts, links, region)], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): a row for each row of pages(page_id, url, html, ...).

    Null html is empty and has no text. Pages without a host in their url share one template. Pages of a host with equal
    html count once for its template and give equal rows; null ids are kept. A host of one or two pages has no template
    texts; its region follows from its own pages. Rows equal in all columns count apart for it. Text in an open slot that stands outside the region on fewer than one
    page in twenty is left out. Very long pages are read whole. An empty table gives an empty result.
    Extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    source = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), F.xxhash64(source).alias("page"), source.alias("html")).withColumn("uid", F.xxhash64("host", "page", "page_id", "url"))
    different = different_pages(rows)
    known = settle(templates(different.select("host", "page", "html")), "templates")
    size = known.agg(F.sum(8 * (F.size("texts") + F.size("links")) + F.length("host") + 64)).first()[0] or 0

    def with_known(pages: DataFrame, of_hosts: DataFrame) -> DataFrame:
        if size <= MOST_BYTES:
            return pages.join(F.broadcast(of_hosts), "host", "left")
        salted = of_hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pages.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    main = main_regions(with_known(different.select("host", "page", "html"), known))
    known = settle(main.join(known, "host", "full"), "hosts")
    joined = with_known(rows, known)
    text = F.pandas_udf(extracted, "string")
    return joined.select("page_id", "url", text("html", "texts", "links", "region").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
