"""Main body of web pages (problem 4).

Method: composite text density. A text run stands between two tags, so its density is what it has of
characters, those of links counted only as far as they are vouched for (on a log scale, so that a long run isn't worth a
hundred short ones). A node's density sum is the sum over its children; the subtree with the maximal sum is the main one.
The least mean density on the path from the body to it is the threshold: runs inside of the subtree whose density lies
further below zero than the body path lies above it are dropped.

What vouches for characters is the whole corpus: menus and notices return page after page, so counts of hashed words and
word pairs inside and outside of the main subtrees give every run a share between 0 and 1, and its density the sign of
``2 share - 1``. Counting and selecting alternate ``PASSES`` times; the first subtrees come from plain densities
(:func:`densest`), without any counts.

Each page is parsed once and in one task; between passes only a table of ``SPAN`` counts, whose
size doesn't depend on the corpus, goes to the driver and back.
"""

from __future__ import annotations

import html as _html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable

#: Tags that don't end a text run, tags without content, and tags that close an open paragraph.
INLINE = frozenset("a abbr b code em i small span strong u".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
#: A start tag closes an open one of ``same`` unless one of ``limit`` lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "div", "section", "main", "article", "aside", "td")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_BREAK = "<x-skipped>"
_HOST = re.compile(r"\S+\.[a-z]{3,}(?:/\S*)?")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")

BUCKETS = 1 << 18
#: The first two and the first three words of a run have buckets of their own behind the others.
SPAN = 3 * BUCKETS
PASSES = 3
#: Bound of a word's log-odds, and how steeply a run's mean log-odds become its share.
CLIP, STEEP = 3.0, 3.0
#: A run is taken for boilerplate that opens with two words seen outside of main subtrees on this share of the pages, and this often of
#: all times, unless its first three words are common inside of them and rarer than that outside.
OPENING_PAGES, OPENING_OUTSIDE = 0.002, 0.15

PARSED = "page_id string, fetched_at timestamp, parent array<int>, node array<int>, inside array<boolean>, chars array<int>, linked array<int>, lens array<int>, words array<int>"


def parse_page(text: str) -> tuple[list[int], list[str], list[int], list[int], list[str], list[int]]:
    """(parent of each node, tag of each node, link tags of each node, node of each run, runs, link characters of each run).

    Nodes are numbered in document order, so a subtree is a range. Unclosed and crossing tags are
    repaired like a browser would in the common cases; nothing raises.
    """
    parent, tags, links = [-1], ["#"], [0]
    stack = [0]
    at, runs, linked = [], [], []
    cur: list[str] = []
    chars_in_link, in_link, pos = 0, False, 0
    s = _SKIP.sub(lambda m: "" if m.group(0).startswith("<!") or m.group(0).startswith("<?") else _BREAK, text)

    def flush():
        nonlocal cur, chars_in_link
        if cur:
            t = " ".join(_html.unescape("".join(cur)).split())
            if t:
                at.append(stack[-1])
                runs.append(t)
                linked.append(min(chars_in_link, len(t)))
        cur, chars_in_link = [], 0

    for m in _TAG.finditer(s):
        if m.start() > pos:
            piece = s[pos : m.start()]
            cur.append(piece)
            if in_link:
                chars_in_link += len(piece)
        pos = m.end()
        end, tag = m.group(1), m.group(2).lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not end
                if in_link:
                    links[stack[-1]] += 1
            continue
        flush()
        in_link = False
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or tag == "x-skipped":
            continue
        if tag in BLOCK and tags[stack[-1]] == "p":
            stack.pop()
        rule = IMPLIED.get(tag)
        if rule:
            for i in range(len(stack) - 1, 0, -1):
                t = tags[stack[i]]
                if t in rule[0]:
                    del stack[i:]
                    break
                if t in rule[1]:
                    break
        parent.append(stack[-1])
        tags.append(tag)
        links.append(0)
        stack.append(len(parent) - 1)
    cur.append(s[pos:])
    flush()
    return parent, tags, links, at, runs, linked


def densest(parent: list[int], tags: list[str], links: list[int], at: list[int], runs: list[str], linked: list[int]) -> int:
    """The node selected by plain composite text density, without counts: from the body towards the node with the largest density
    sum, the first node that hasn't nearly all characters of the page."""
    n = len(parent)
    c, lc, t, lt = [0] * n, [0] * n, [0] * n, list(links)
    for k, r, x in zip(at, runs, linked):
        c[k] += len(r)
        lc[k] += x
    for k in range(n - 1, 0, -1):
        p = parent[k]
        c[p] += c[k]
        lc[p] += lc[k]
        lt[p] += lt[k]
        t[p] += t[k] + 1
    total, total_linked = c[0] or 1, lc[0]
    sums = [0.0] * n
    for k in range(1, n):
        if c[k]:
            chars, tags_in = c[k], t[k] or 1
            base = math.log(chars / max(1, chars - lc[k]) * lc[k] + total_linked / total * chars + math.e)
            inner = chars / max(1, lc[k]) * tags_in / max(1, lt[k])
            sums[parent[k]] += chars / tags_in * math.log(max(inner, 1e-9)) / math.log(max(base, 1.0001))
    best = max(range(n), key=lambda k: (sums[k], -k))
    path = [best]
    while path[-1] > 0:
        path.append(parent[path[-1]])
    path.reverse()
    i = 0
    while i < len(path) - 1 and (c[path[i]] >= 0.97 * total or tags[path[i]] in ("html", "body", "table", "tbody", "tr")):
        i += 1
    return path[i]


def _ends(parent) -> list[int]:
    """One past the last node of each subtree."""
    n = len(parent)
    size = [1] * n
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    return [k + size[k] for k in range(n)]


def _word_ids(run: str, memo: dict[str, int]) -> list[int]:
    out = []
    for w in _WORD.findall(_HOST.sub("HOST", run.lower())):
        i = memo.get(w)
        if i is None:
            i = zlib.crc32((w if not w.isdigit() else "#").encode())  # numbers are alike
            i = i - (1 << 32) if i >= 1 << 31 else i
            if len(memo) < 500_000:
                memo[w] = i
        out.append(i)
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        rows = []
        for page, when, text in zip(b["page_id"], b["fetched_at"], b["html"]):
            parent, tags, links, at, runs, linked = parse_page(text)
            top = densest(parent, tags, links, at, runs, linked)
            end = _ends(parent)[top]
            ids = [_word_ids(r, memo) for r in runs]
            rows.append((page, when, parent, at, [top <= k < end for k in at], [len(r) for r in runs], linked, [len(i) for i in ids], [w for i in ids for w in i]))
        yield pd.DataFrame(rows, columns=["page_id", "fetched_at", "parent", "node", "inside", "chars", "linked", "lens", "words"])


def _features(lens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, run, 1 or 2 if it opens the run) over the runs of a batch: words, pairs, opening and closing pair, length."""
    m = np.uint64(BUCKETS - 1)
    w = words.astype(np.int64).astype(np.uint64)
    run = np.repeat(np.arange(len(lens)), lens)

    def mix(a, salt):
        a = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((a >> np.uint64(29)) ^ (a >> np.uint64(47))) & m

    ends = np.cumsum(lens)
    starts = ends - lens
    some = lens > 0
    same = run[1:] == run[:-1] if len(run) else np.zeros(0, bool)
    pair = w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:] if len(w) > 1 else np.zeros(0, np.uint64)
    two = lens > 1
    first = w[starts[some]]
    opening = w[starts[two]] * np.uint64(0xC2B2AE3D27D4EB4F) + w[starts[two] + 1]
    third = np.append(w, np.uint64(0))[np.where(lens[two] > 2, starts[two] + 2, len(w))]
    closing = w[ends[two] - 2] * np.uint64(0xC2B2AE3D27D4EB4F) + w[ends[two] - 1]
    runs = np.arange(len(lens))
    parts = [
        (mix(w, 1), run, 0), (mix(pair[same], 2), run[:-1][same] if len(run) else run, 0), (mix(first, 3), runs[some], 0),
        (mix(opening, 4) + np.uint64(BUCKETS), runs[two], 1), (mix(opening * np.uint64(0xC2B2AE3D27D4EB4F) + third, 7) + np.uint64(2 * BUCKETS), runs[two], 2),
        (mix(closing, 5), runs[two], 0), (mix(np.minimum(lens, 14).astype(np.uint64), 6), runs, 0),
    ]
    f = np.concatenate([p[0] for p in parts]).astype(np.int64)
    r = np.concatenate([p[1] for p in parts])
    o = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    return f, r, o


def _flat(col: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.asarray(x, kind) for x in col]) if len(col) else np.zeros(0, kind)


def _select(b: pd.DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept runs, runs within the subtree, feature, run of feature) of a batch of parsed pages."""
    lens, words = _flat(b["lens"], np.int64), _flat(b["words"], np.int64)
    f, r, opens = _features(lens, words)
    if model is None:
        inside = _flat(b["inside"], bool)
        return inside, inside, f, r
    odds, stock = model  # stock: of two words, that they open boilerplate; of three, that they open main text
    n = len(lens)
    weight = np.bincount(r, odds[f], n) / np.sqrt(np.maximum(1, np.bincount(r, minlength=n)))
    weight = np.clip(weight, -2, 2)
    opening = np.zeros((3, n), bool)
    for i in (1, 2):
        opening[i, r[opens == i]] = stock[f[opens == i]]
    opening = opening[1] & ~opening[2]
    weight = np.where(opening, np.minimum(weight, -1.5), weight)
    share = 1 / (1 + np.exp(-STEEP * weight))
    density = (2 * share - 1) * np.log1p(_flat(b["chars"], float) - _flat(b["linked"], float) * (1 - share))
    kept, within = np.zeros(n, bool), np.zeros(n, bool)
    i = 0
    for parent, node in zip(b["parent"], b["node"]):
        k = len(node)
        if k:
            at, d, par = np.asarray(node), density[i : i + k], list(parent)
            sums, ends = np.bincount(at, d, len(par)).tolist(), _ends(par)
            for x in range(len(par) - 1, 0, -1):
                sums[par[x]] += sums[x]
            top = max(range(len(par)), key=lambda x: (sums[x], -x))
            threshold, x = math.inf, top
            while x >= 0:
                threshold = min(threshold, sums[x] / (ends[x] - x))
                x = par[x]
            within[i : i + k] = (at >= top) & (at < ends[top])
            kept[i : i + k] = within[i : i + k] & (d >= -abs(threshold))
            i += k
    return kept, within, f, r


def _counter(model):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside, beyond = np.zeros(SPAN), np.zeros(SPAN), np.zeros(SPAN)
        for b in batches:
            kept, within, f, r = _select(b, model)
            k = kept[r]
            inside += np.bincount(f[k], minlength=SPAN)
            outside += np.bincount(f[~k], minlength=SPAN)
            beyond += np.bincount(f[~within[r]], minlength=SPAN)
        some = np.flatnonzero(inside + outside)
        yield pd.DataFrame({"bucket": some, "n_in": inside[some], "n_out": outside[some], "n_beyond": beyond[some]})

    return count


def _emit(model):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = _select(b, model)[0]
            sizes = b["node"].map(len).to_numpy()
            page = np.repeat(b["page_id"].to_numpy(), sizes)
            no = np.concatenate([np.arange(k) for k in sizes]) if len(sizes) else np.zeros(0, int)
            yield pd.DataFrame({"page_id": page[kept], "run_no": no[kept].astype(np.int32)})

    return emit


def main_runs(pages: DataFrame, passes: int = PASSES) -> DataFrame:
    """(``page_id``, ``run_no``) of the runs of each page's main body.

    ``pages`` has ``page_id``, ``html`` and ``fetched_at``. A page delivered more than once counts
    with its latest delivery (ties: the larger parse); null ids and null or empty html give no rows,
    neither does a page without text. Markup that is not well formed is repaired. Long texts are
    parsed and weighed whole. An empty table gives an empty result.
    """
    rows = pages.select("page_id", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "html").filter("page_id is not null and html <> ''")
    parsed = rows.mapInPandas(_parse, PARSED)
    # Repeats are dropped after parsing, when a page is only its word ids.
    fields = ["parent", "node", "inside", "chars", "linked", "lens", "words"]
    last = parsed.groupBy("page_id").agg(F.max(F.struct("fetched_at", *fields)).alias("x"))
    parsed = durable(last.select("page_id", *[f"x.{f}" for f in fields]), "pages")
    model, n = None, parsed.count()
    for _ in range(passes):
        counts = parsed.mapInPandas(_counter(model), "bucket int, n_in double, n_out double, n_beyond double").groupBy("bucket").agg(F.sum("n_in"), F.sum("n_out"), F.sum("n_beyond"))
        inside, outside, beyond = np.full(SPAN, 0.5), np.full(SPAN, 0.5), np.zeros(SPAN)
        table = counts.toArrow()  # at most SPAN rows
        at = table.column("bucket").to_numpy()
        for into, c in ((inside, 1), (outside, 2), (beyond, 3)):
            into[at] += table.column(c).to_numpy()
        odds = np.clip(np.log(inside / inside.sum()) - np.log(outside / outside.sum()), -CLIP, CLIP)
        stock = (beyond >= max(5.0, OPENING_PAGES * n)) & (beyond >= OPENING_OUTSIDE * (inside + outside))
        stock[2 * BUCKETS :] = ((inside >= max(5.0, OPENING_PAGES / 4 * n)) & (beyond < OPENING_OUTSIDE * (inside + outside)))[2 * BUCKETS :]
        model = (odds.astype(np.float32), stock)
    return parsed.mapInPandas(_emit(model), "page_id string, run_no int")
