"""Raw pages to profiles: selectors over HTML that need not be well formed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each source the selector of name, headline, bio, organisations, education, places, topics, years and links.
SELECTORS = {
    "github": (".p-name", ".p-note", ".user-profile-bio", ".org-list li", ".edu-list li", ".profile-location", ".topic-list li", ".time-list li", ".profile-links a"),
    "personal_site": ("h1.page-title", "p.tagline", "section.about", "ul.affiliations li", "ul.education li", "span.location", "ul.topics li", "ul.timeline li", "nav.links a"),
    **{
        source: tuple(f".{prefix}-{part}" for part in ("name", head, "bio", "orgs li", "education li", "location", "topics li", "years li", "links a"))
        for source, prefix, head in (("conference_bio", "speaker", "headline"), ("company_profile", "team", "role"), ("podcast_guest", "guest", "headline"), ("huggingface", "hf", "headline"))
    },
}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("tag", "classes", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.classes = set((attrs.get("class") or "").split())

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                todo.extend(reversed(n.kids))
        return " ".join(out)

    def below(self):
        todo = [k for k in reversed(self.kids) if isinstance(k, _Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, _Node))


class _Tree(HTMLParser):
    """Nodes as they are opened and closed; an end tag closes up to the nearest open one of its name, others are left open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.kids.append(data)


def select(root: _Node, selector: str) -> list[_Node]:
    """Nodes in document order for selectors of the forms ``.class``, ``tag``, ``tag.class`` and descendants of them."""
    steps = [re.fullmatch(r"([\w-]*)(?:\.([\w-]+))?", s).groups() for s in selector.split()]

    def fits(n: _Node, step) -> bool:
        return (not step[0] or n.tag == step[0]) and (not step[1] or step[1] in n.classes)

    out = []
    for n in root.below():
        if not fits(n, steps[-1]):
            continue
        up, i = n.parent, len(steps) - 2
        while up is not None and i >= 0:
            if fits(up, steps[i]):
                i -= 1
            up = up.parent
        if i < 0:
            out.append(n)
    return out


def _year(v) -> int | None:
    return int(v) if v and str(v).strip().isdigit() else None


def parse_html(source: str | None, text: str | None) -> dict | None:
    """The selected fields of a page; null for an unknown source."""
    if source not in SELECTORS:
        return None
    t = _Tree()
    t.feed(text or "")
    t.close()
    name, head, bio, orgs, edu, places, topics, years, links = SELECTORS[source]

    def first(sel):
        n = select(t.root, sel)
        return (n[0].text() or None) if n else None

    texts = lambda sel: [x for x in (n.text() for n in select(t.root, sel)) if x]
    return {
        "display_name": first(name), "headline": first(head), "bio": first(bio),
        "organizations": [{"name": n.attrs.get("data-name") or n.text(), "role": n.attrs.get("data-role"), "start_year": _year(n.attrs.get("data-start-year")), "end_year": _year(n.attrs.get("data-end-year"))} for n in select(t.root, orgs)],
        "education": [{"institution": n.attrs.get("data-institution") or n.text(), "degree": n.attrs.get("data-degree"), "graduation_year": _year(n.attrs.get("data-graduation-year"))} for n in select(t.root, edu)],
        "locations": texts(places), "topics": texts(topics), "timestamps": texts(years), "links": [n.attrs["href"] for n in select(t.root, links) if n.attrs.get("href")],
    }


_FIELDS = """display_name string, headline string, bio string, organizations array<struct<name:string,role:string,start_year:int,end_year:int>>,
education array<struct<institution:string,degree:string,graduation_year:int>>, locations array<string>, topics array<string>, timestamps array<string>, links array<string>"""


def spans(headline: Column, bio: Column, raw: Column) -> Column:
    """Supporting spans: the headline, the first 240 characters of the bio, else of the raw text; blanks give none."""
    one = lambda field, text: F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit(field).alias("field_name"), F.substring(text, 1, 240 if field != "headline" else 1 << 30).alias("snippet"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char")))
    own = F.array_compact(F.array(one("headline", headline), one("bio_text", bio)))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(one("raw_text", raw))))


def parse_pages(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Profiles from raw pages. Missing name: the hint; missing bio: the raw text; ids lose the suffix ``_raw``.

    Pages of an unknown source, or without name and hint, raise if ``strict`` and are left out otherwise.
    Null html is an empty page.
    """
    kept = ["page_id", "source_type", "url", "canonical_person_id", "display_name_hint", "title", "raw_text", "html"]
    schema = "page_id string, source_type string, url string, canonical_person_id string, display_name_hint string, title string, raw_text string, known boolean, " + _FIELDS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ("display_name headline bio organizations education locations topics timestamps links").split()]
        for b in batches:
            got = [parse_html(s, h) for s, h in zip(b["source_type"], b["html"])]
            out = b[kept[:-1]].copy()
            out["known"] = [g is not None for g in got]
            for n in names:
                out[n] = [None if g is None else g[n] for g in got]
            yield out

    p = pages.select(*kept).mapInPandas(parse, schema)
    name = F.coalesce("display_name", F.when(F.col("display_name_hint") != "", F.col("display_name_hint")))
    p = p.withColumn("display_name", name).withColumn("bio_text", F.coalesce(F.when(F.col("bio") != "", F.col("bio")), "raw_text"))
    bad = ~F.col("known") | F.col("display_name").isNull()
    if strict:
        p = p.withColumn("page_id", F.when(bad, F.raise_error(F.concat(F.lit("can't parse "), "page_id")).cast("string")).otherwise(F.col("page_id")))
    else:
        p = p.filter(~bad)
    return p.select(
        F.regexp_replace("page_id", "_raw$", "").alias("profile_id"), "canonical_person_id", "source_type", "url", "display_name", F.array().cast("array<string>").alias("aliases"), "headline", "bio_text",
        "organizations", "education", "locations", F.col("links").alias("outbound_links"), "topics", "timestamps", "raw_text", spans(F.col("headline"), F.col("bio_text"), F.col("raw_text")).alias("supporting_spans"),
        F.create_map(F.lit("page_id"), F.col("page_id"), F.lit("title"), F.coalesce("title", F.lit(""))).alias("metadata"),
    )


def hrefs(pages: DataFrame) -> DataFrame:
    """(``page_id``, ``href``) of every quoted href of a page, without parsing it: the part of link extraction that is an expression."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))).alias("href"))
