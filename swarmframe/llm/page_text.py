"""Main text of web pages: markup says what is an article, a suffix array per host says what is boilerplate elsewhere.

A page becomes blocks of text, each inside an article, inside something that is never content (menu, footer, advert, ...) or
in neither. Blocks that are never content go. Blocks of articles are firm if the articles hold at least half of the words that
are left (teaser cards beside a body do not); all other blocks are loose. The loose text of all pages of a host is laid end
to end, page by page (dealt into shards of bounded size): its suffix array, sorted as far as ``min_tokens`` tokens, shows
which strings of that length occur, each shard returns them with their number of pages. Copies of one text are one page
there. Strings on a quarter of the host's pages (two at least), over all shards, are boilerplate; a loose block goes if they
cover all of it, so passages inside a block stay. Firm blocks stay too, and so do, as copied text:

- runs of more than ``SHORT_RUN`` words of covered blocks in which some word is in strings of fewer than ``MANY_PAGES`` pages only;
- all blocks of a page of more than ``SHORT_RUN`` words that would lose more than nine tenths of its words.

Cases: null or empty html gives an empty text; a null url is a host of its own; a page row that is repeated is one page as
evidence and gives a row each; unclosed, misnested and cut-off tags are read leniently; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.plans.once import stored

from .common import shipped, texts_of

#: Fixed: element names by what they mean for the text in them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead
    tr ul""".split())
NEVER = frozenset("nav footer header aside form button select menu dialog iframe object svg canvas head title noframes label".split())
ARTICLE = frozenset(("article", "main"))
ENDED_BY_BLOCK = frozenset(("p",))
ENDED_BY_SAME = frozenset("li dt dd tr td th option".split())
#: Fixed: class, id and role words that mark what is not content.
_WORDS = (
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|ads?|advert\w*|sponsor\w*|promo\w*|banner|"
    r"cookies?|consent|gdpr|notice|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|disqus|"
    r"replies|popup|modal|widget|pagination|pager|complementary|contentinfo|search)")
#: One whole name, or names joined to one: cookie-notice counts, has-sidebar does not.
NEVER_WORDS = re.compile(rf"(?:^|(?<=\s)){_WORDS}(?:[_-]+{_WORDS})*(?:$|(?=\s))", re.I)
READER_WORDS = re.compile(r"(?:^|(?<=\s))(?:comments?|repl(?:y|ies))(?:$|(?=\s))", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!][^>]*\Z", re.S | re.I)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed: what fewer pages than this share is boilerplate only in runs of at most so many words.
MANY_PAGES, SHORT_RUN = 4, 40


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(``region``, text) of the blocks of a page; the region is article, never or open.

    Names mark neither an article (unless it is a reader's comment) nor main, nor what holds one outside of another article.
    """
    out, parts, stack = [], [], []  # stack: (tag, region, mark); a mark by names is a list, emptied when an article shows up in it
    region, marks = "open", ()  # of the innermost element, and the marks that make it never as long as they hold

    def closed() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((region, marks, text))
        parts.clear()

    def current() -> tuple[str, tuple[list, ...]]:
        kinds = {r for _, r, _ in stack}
        found = "never" if "never" in kinds else "article" if "article" in kinds else "open"
        return found, tuple(m for _, _, m in stack if m)

    at, html = 0, html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                closed()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(r != "open" or m for _, r, m in stack[k:]):
                        closed()
                    del stack[k:]
                    region, marks = current()
                    break
            continue
        if tag in VOID:
            if tag in BLOCKS:
                closed()
            continue
        attrs = m["attrs"] or ""
        words = " ".join(a or b or c for a, b, c in _MARKS.findall(attrs)) if "=" in attrs else ""
        own = "never" if tag in NEVER else "article" if tag in ARTICLE else "open"
        named = bool(words) and own != "never" and tag not in ("body", "html") and bool(
            NEVER_WORDS.search(words) if own == "open" else tag == "article" and READER_WORDS.search(words))
        if tag in BLOCKS or own == "never" or named:
            closed()
            if tag == "body":
                stack.clear()
            if tag in BLOCKS and stack and stack[-1][0] in ENDED_BY_BLOCK:
                stack.pop()
            if tag in ENDED_BY_SAME and stack and stack[-1][0] == tag:
                stack.pop()
            if own == "article" and not named:
                for outer, _, mark in stack:
                    if outer == "article":
                        break
                    mark.clear()
            stack.append((tag, own, [tag] if named else []))
            region, marks = current()
    if at < len(html):
        parts.append(unescape(html[at:]))
    closed()
    return [("never" if any(held) else r, text) for r, held, text in out]


def ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Per position the rank of its suffix by the first ``length`` tokens, by prefix doubling. 0 stands past the end."""
    rank = np.unique(tokens, return_inverse=True)[1] + 1
    done = 1
    while done < length:
        step = min(done, length - done)  # two windows that overlap make one of any length
        follow = np.zeros_like(rank)
        follow[:len(rank) - step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + follow, return_inverse=True)[1] + 1
        done += step
    return rank


def window_key(words: list[str]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def _sorted_windows(streams: list[list[str]], length: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All words; of each suffix, in order, where it starts and in which stream; where suffixes of one window begin."""
    words = [w for s in streams for w in s]
    none = np.zeros(0, dtype=np.int64)
    if not words:
        return words, none, none, none
    n = np.array([len(s) for s in streams])
    stream = np.repeat(np.arange(len(streams)), n)
    left = np.concatenate([np.arange(k, 0, -1) for k in n.tolist()])  # words from here to the end of the page
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = ranks(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)), length)
    starts = np.flatnonzero(left >= length)
    suffixes = starts[np.argsort(rank[starts], kind="stable")]  # the suffix array, windows that cross pages left out
    if not len(suffixes):
        return words, none, none, none
    return words, suffixes, stream[suffixes], np.flatnonzero(np.append(True, rank[suffixes[1:]] != rank[suffixes[:-1]]))


def shared_strings(pages: list[int], streams: list[list[str]], length: int) -> list[tuple[bytes, int, int]]:
    """Strings of ``length`` words in the streams (one per page): key, least and greatest page. One row per distinct string."""
    words, suffixes, stream, heads = _sorted_windows(streams, length)
    if not len(suffixes):
        return []
    page = np.array(pages, dtype=np.int64)[stream]
    low, high = np.minimum.reduceat(page, heads), np.maximum.reduceat(page, heads)
    return [(window_key(words[s:s + length]), a, b) for s, a, b in zip(suffixes[heads].tolist(), low.tolist(), high.tolist(), strict=True)]


def string_counts(streams: list[list[str]], length: int, least: int = 1) -> list[tuple[bytes, int]]:
    """Strings of ``length`` words that ``least`` streams or more hold: key, number of streams."""
    words, suffixes, stream, heads = _sorted_windows(streams, length)
    if not len(suffixes):
        return []
    first = np.append(True, stream[1:] != stream[:-1])  # the sort is stable, so a stream's suffixes of one window lie together
    first[heads] = True
    n = np.add.reduceat(first.astype(np.int64), heads)
    return [(window_key(words[s:s + length]), k) for s, k in zip(suffixes[heads].tolist(), n.tolist(), strict=True) if k >= least]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def parts_of(html: str | None) -> list[tuple[bool, str]]:
    """(firm, text) of the blocks that can be content; what is not firm may be boilerplate."""
    parts = [(r == "article", t) for r, t in blocks_of(html) if r != "never"]
    own, rest = (sum(len(t.split()) for firm, t in parts if firm == of) for of in (True, False))
    return parts if own >= rest else [(False, t) for _, t in parts]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firm, parts, contents = [], [], []
        for html in texts_of(batch.column(3)):
            found = parts_of(html)
            firm.append([f for f, _ in found])
            parts.append([t for _, t in found])
            loose = [t for f, t in found if not f]
            contents.append(window_key(loose) if loose else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(contents, pa.binary()), pa.array(firm, pa.list_(pa.bool_())), pa.array(parts, pa.list_(pa.string()))],
            names=["page_id", "url", "host", "content", "firm", "parts"])


def stays(firm: list[bool], parts: list[str], covered: dict[int, int], length: int) -> list[bool]:
    """Per block whether it stays; ``covered`` has the places in the loose text where boilerplate begins, with its pages."""
    pages: dict[int, int] = {}  # per word the most pages of a string that covers it
    for pos, n in covered.items():
        for k in range(pos, pos + length):
            pages[k] = max(n, pages.get(k, 0))
    sizes = [len(text.split()) for text in parts]
    out, run, at = [True] * len(parts), [], 0
    for k, n in enumerate(sizes):
        found = [] if firm[k] else [pages.get(i, 0) for i in range(at, at + n)]
        at += len(found)
        if found and min(found) >= MANY_PAGES:
            out[k] = False
        elif found and all(found):
            run.append(k)
        if run and (run[-1] != k or k + 1 == len(parts)):
            if sum(sizes[i] for i in run) <= SHORT_RUN:
                for i in run:
                    out[i] = False
            run = []
    lost = sum(n for n, stay in zip(sizes, out, strict=True) if not stay)
    return [True] * len(parts) if lost > SHORT_RUN and lost > 0.9 * sum(sizes) else out


PARSED = "page_id long, url string, host string, content binary, firm array<boolean>, parts array<string>"


def repeated_strings(streams: DataFrame, min_tokens: int, shard_pages: int, support: float) -> DataFrame:
    """(``host``, ``key``, ``n``) of strings that ``support`` of the ``streams`` (``host``, ``content``, ``stream``) of a host share, two at least."""
    shards = streams.groupBy("host").agg(F.ceil(F.count("*") / shard_pages).alias("shards"),
                                         F.greatest(F.lit(2), F.ceil(support * F.count("*"))).alias("least"))
    dealt = streams.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")))

    def sorted_suffixes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = string_counts([s.split() for s in rows["stream"]], min_tokens, least=key[1] if key[2] == 1 else 1)
        return pd.DataFrame({"host": key[0], "least": key[1], "key": [k for k, _ in found], "n": np.array([n for _, n in found], dtype=np.int64)})

    some = dealt.groupBy("host", "least", "shards", "shard").applyInPandas(sorted_suffixes, "host string, least long, key binary, n long")
    return some.groupBy("host", "least", "key").agg(F.sum("n").alias("n")).where("n >= least").select("host", "key", "n")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 6,
               shard_pages: int = 2000, support: float = 0.25) -> DataFrame:
    """(``page_id``, ``url``, ``text``) per row of ``pages``; boilerplate is what ``support`` of a host's pages share."""
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"),
                        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    # written once: every branch below reads blocks, none parses html again
    parsed = stored(shipped(rows).mapInArrow(_parsed, PARSED), "page-blocks")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, content, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = stream.split()
                out += [(host, content, k, window_key(words[k:k + min_tokens])) for k in range(len(words) - min_tokens + 1)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "content", "pos", "key"])

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for firm, parts, covered in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = stays(firm, parts, {c["pos"]: c["n"] for c in covered or []}, min_tokens)
                kept = [text for text, stay in zip(parts, own, strict=True) if stay]
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    # pages without a loose block have nothing that could go; their html is not moved
    whole = parsed.where("content IS NULL").select("page_id", "url", F.array_join("parts", "\n").alias("text"))
    loose = parsed.where("content IS NOT NULL")
    stream = F.array_join(F.filter("parts", lambda _, i: ~F.get("firm", i)), " ")
    streams = loose.select("host", "content", stream.alias("stream")).groupBy("host", "content").agg(F.first("stream").alias("stream"))
    found = streams.mapInArrow(windows, "host string, content binary, pos int, key binary")
    repeated = repeated_strings(streams, min_tokens, shard_pages, support)
    covered = found.join(repeated, ["host", "key"]).groupBy("host", "content").agg(F.collect_list(F.struct("pos", "n")).alias("covered"))
    bare = loose.join(covered, ["host", "content"], "left").select("page_id", "url", "firm", "parts", "covered").mapInArrow(
        uncovered, "page_id long, url string, text string")
    return whole.unionByName(bare)
