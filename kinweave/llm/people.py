"""What records of people have in common: parsed names, links of their own, words of organisations and places.

Used by the matching of sources (problem 5) and of name variants (problem 1).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable, release
from kinweave.functions.text import link_key

#: Titles, degrees and remarks that aren't part of a name, and particles of surnames.
NOT_NAMES = frozenset("dr prof professor mr mrs ms mx phd md msc bsc ma ba meng mba jr sr ii iii iv he him his she her hers they them theirs esq".split())
PARTICLES = frozenset("van von der den de du la le ter ten di da dos del bin al".split())
#: A given name stands first in at least this share of its uses, of which there are this many.
GIVEN_SHARE, GIVEN_USES = 0.7, 4
#: A short or other form of a given name is stated beside it in at least this share of the uses of the commoner one,
#: so a name has at most the inverse of it as forms.
FORM_SHARE = 0.002
#: A word that more than this share of the records (and more than ``COMMON_RECORDS``) have is a common one; it votes on a level of its own.
OWN_SHARE, COMMON_SHARE, COMMON_RECORDS = 0.4, 0.03, 30
_PAREN = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_NICK = re.compile(r"[\"“'‘]([^\"”'’]{2,20})[\"”'’]")
_DEGREE = re.compile(r"\b(?:ph\.?\s?d|[mb]\.?\s?sc|[mb]\.?\s?a|m\.?\s?b\.?\s?a|m\.?\s?d)\b\.?", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d")


@lru_cache(200_000)
def name_tokens(s: str | None) -> tuple[list[str], int]:
    """(tokens in written order, how many at the front are surely the surname's: 0 if unknown)."""
    if not s:
        return [], 0
    s = _PAREN.sub(" ", s)
    s = re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", _NICK.sub(" ", s).replace("’", "'"))
    s = re.split(r"\s[|•·–]\s", s)[0]
    front = 0
    parts = [p for p in s.split(",")]
    kept = []
    for k, p in enumerate(parts):
        words = _TOKEN.findall(_DEGREE.sub(" ", p) if k else p)
        good = [w for w in words if fold(w).replace(".", "") not in NOT_NAMES]
        if good:
            kept.append(good)
    if not kept:
        return [], 0
    if len(kept) >= 2:
        tokens, front = kept[0] + [w for k in kept[1:] for w in k], len(kept[0])
    else:
        tokens = kept[0]
        caps = [len(w) > 1 and w.isupper() for w in tokens]
        if caps[0] and not all(caps):
            front = next(i for i, c in enumerate(caps) if not c)
            if any(caps[front:]):
                front = 0
        elif all(caps[:-1]) and len(tokens[-1]) == 1 and len(tokens) > 1 and len(tokens[0]) > 1:
            front = len(tokens) - 1
    return [fold(w) for w in tokens], front


def is_handle(s: str) -> bool:
    return bool(re.fullmatch(r"@?[a-z0-9._-]+", s.strip())) and " " not in s.strip()


WORDS = ("orgs", "places", "topics")


def _usage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: Counter = Counter()
        for display, aliases in zip(b["name"], b["aliases"]):
            names = [name_tokens(x) for x in (display, *(aliases if aliases is not None else ())) if x and not is_handle(x)]
            for tokens, front in names[:1]:
                if len(tokens) >= 2 and not front:
                    seen[("f", tokens[0], "")] += 1
                    seen[("l", tokens[-1], "")] += 1
            if len(names) > 1:
                base = set(names[0][0])
                for tokens, _ in names[1:]:
                    a, c = base - set(tokens), set(tokens) - base
                    if len(a) == 1 and len(c) == 1 and len(base) >= 2:
                        x, y = sorted((*a, *c))
                        if min(len(x), len(y)) > 1:
                            seen[("n", x, y)] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "a", "b", "n"])


def split_name(tokens: list[str], front: int, given: set[str]) -> tuple[str, str]:
    """(given name or initial, surname) of the tokens of a written name; ``given``: which of them are used as given names."""
    if front:
        sur, rest = tokens[:front], tokens[front:]
    elif len(tokens) == 1:
        return ("", tokens[0]) if tokens[0] not in given else (tokens[0], "")
    else:
        at = [i for i, t in enumerate(tokens) if t in given]
        bare = next((i for i in range(len(tokens)) if all(len(t) == 1 for t in tokens[i:])), len(tokens))
        if 0 < bare < len(tokens) and tokens[0] not in given:  # initials behind the surname
            sur, rest = tokens[:bare], tokens[bare:]
        elif at and at[0] > 0 and len(tokens[0]) > 1 and tokens[0] not in PARTICLES and at[-1] == len(tokens) - 1 and tokens[0] not in given:
            k = at[0]
            sur, rest = tokens[:k], tokens[k:]
        else:
            k = len(tokens) - 1
            while k > 1 and tokens[k - 1] in PARTICLES:
                k -= 1
            sur, rest = tokens[k:], tokens[:k]
    surname = "".join(t for t in sur if t not in PARTICLES) or "".join(sur)
    first = next((t for t in rest if t in given), rest[0] if rest else "")
    if len(rest) > 1 and len(rest[0]) > 1 and rest[0] not in given and first != rest[0]:
        first = rest[0] if len(rest[0]) > 3 else first
    return first.strip("'-"), surname.replace("-", "").replace("'", "")


def _tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s in b["s"]:
            tokens, front = ([], 0) if is_handle(s) else name_tokens(s)
            if tokens:
                nick = _NICK.search(s)
                rows.append((s, tokens, front, fold(nick.group(1)).strip() if nick else None))
        yield pd.DataFrame(rows, columns=["s", "tokens", "front", "nick"])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for s, tokens, front, nick, given in zip(b["s"], b["tokens"], b["front"], b["nick"], b["given"]):
            g, sur = split_name(list(tokens), front, set(given) if given is not None else set())
            if len(sur) > 1:
                rows.append((s, g, sur))
            if nick and sur:
                rows.append((s, nick, sur))
        yield pd.DataFrame(rows, columns=["s", "g", "sur"])


def parsed_names(rows: DataFrame) -> DataFrame:
    """(``id``, ``side``, ``names``) of records: given name ``g``, its other forms ``alts`` (itself among them) and surname ``s``.

    Which words are given names, and their short forms, is learned from all records: a given name stands first, a form
    stands in its place in another spelling of the same name. Both are tables that are joined, whatever their size.
    """
    uses = durable(rows.select("name", "aliases").mapInPandas(_usage, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "uses")
    first = uses.filter("kind = 'f'").select(F.col("a").alias("t"), F.col("n").alias("f"))
    last = uses.filter("kind = 'l'").select(F.col("a").alias("t"), F.col("n").alias("l"))
    share = F.col("f") / (F.col("f") + F.coalesce("l", F.lit(0)))
    given = durable(first.join(last, "t", "left").filter((F.col("f") >= GIVEN_USES) & (share >= GIVEN_SHARE) & (F.length("t") > 1)).select("t", "f"), "given")
    beside = uses.filter("kind = 'n' and length(a) > 2 and length(b) > 2").select("a", "b", "n")
    beside = beside.join(given.selectExpr("t as a", "f as fa"), "a", "left").join(given.selectExpr("t as b", "f as fb"), "b", "left")
    beside = beside.filter("(fa is not null or fb is not null) and (n >= 2 or fa is null or fb is null)").filter(F.col("n") >= FORM_SHARE * F.greatest("fa", "fb"))
    forms = beside.select(F.col("a").alias("g"), F.col("b").alias("o")).unionByName(beside.select(F.col("b").alias("g"), F.col("a").alias("o"))).groupBy("g").agg(F.array_sort(F.collect_set("o")).alias("forms"))
    said = rows.select("id", "side", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("s")).filter("s is not null")
    tokens = durable(said.select("s").distinct().mapInPandas(_tokenized, "s string, tokens array<string>, front int, nick string"), "tokens")
    known = tokens.select("s", F.explode("tokens").alias("t")).join(given.select("t"), "t").groupBy("s").agg(F.collect_set("t").alias("given"))
    parsed = tokens.join(known, "s", "left").mapInPandas(_parsed, "s string, g string, sur string").distinct()
    alts = F.when(F.col("g") != "", F.array_distinct(F.concat(F.array("g"), F.coalesce("forms", F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    parsed = parsed.join(forms, "g", "left").select(F.xxhash64("s").alias("s"), F.struct("g", alts.alias("alts"), F.col("sur").alias("s")).alias("n"))
    return said.withColumn("s", F.xxhash64("s")).join(parsed, "s").groupBy("id", "side").agg(F.array_sort(F.collect_set("n")).alias("names"))


_JOINT = re.compile(r"(?<=[a-zà-ÿ]{3})(?=[A-ZÀ-Þ][a-zà-ÿ])")
_LETTERS, _ALNUM = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W_]+")


@lru_cache(100_000)
def _words(v: str) -> tuple[str, ...]:
    return tuple(w for w in _LETTERS.findall(fold(_JOINT.sub(" ", v))) if len(w) >= 2)


@lru_cache(100_000)
def _topic(v: str) -> str:
    return " ".join(_ALNUM.findall(fold(v)))


def _split_words(values) -> list[str]:
    if values is None or not len(values):
        return []
    return sorted({w for v in values if v for w in _words(v)})


FEATURES = "id string, side int, shown string, orgs array<string>, places array<string>, topics array<string>"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, side, shown, orgs, places, topics in zip(b["id"], b["side"], b["name"], b["orgs"], b["places"], b["topics"]):
            t = sorted({_topic(x) for x in (topics if topics is not None else ()) if x and x.strip()})
            rows.append((i, side, shown, _split_words(orgs), _split_words(places), t))
        yield pd.DataFrame(rows, columns=["id", "side", "shown", "orgs", "places", "topics"])


def records(table: DataFrame, side: int, topics: bool = True) -> DataFrame:
    """A profiles-like table as (``id``, ``side``, ``name``, ``aliases``, ``orgs``, ``places``, ``topics``, ``links``).

    A record delivered again with the same id counts once (repeats differ in their time only). ``topics`` are left empty unless wanted.
    """
    cols = ["display_name", "aliases", "organizations", "locations", "topics", "outbound_links"]
    if not topics:
        table = table.withColumn("topics", F.array().cast("array<string>"))
    latest = table.select(F.col("profile_id").alias("id"), *cols, "url").filter("id is not null").dropDuplicates(["id"])
    links = F.concat(F.coalesce("outbound_links", F.array().cast("array<string>")), F.array("url"))
    return latest.select(
        "id", F.lit(side).alias("side"), F.col("display_name").alias("name"), "aliases", F.transform("organizations", lambda o: o["name"]).alias("orgs"),
        F.col("locations").alias("places"), "topics", F.array_distinct(F.filter(F.transform(links, link_key), lambda x: x.isNotNull() & (x != ""))).alias("links"),
    )


def people_features(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, links) of :func:`records`.

    features: parsed ``names``, links of one's own (``own``) and where they are (``hosts``), and the words of ``orgs``, ``places`` and ``topics``; words that more than ``COMMON_SHARE``
    of all records have stand apart in ``common_orgs`` and so on. links: (``id``, ``side``, ``link`` hash, ``host`` hash)
    of names in links that are a person's own: of those who state it, ``OWN_SHARE`` have surnames with the same first three letters.
    """
    rows = durable(rows, "records")
    base = durable(rows.drop("links", "aliases").mapInPandas(_features, FEATURES), "features")
    n = base.count()

    def labelled(c: str):
        return F.transform(c, lambda w: F.struct(F.lit(c).alias("c"), w.alias("w")))

    words = base.select(F.explode(F.concat(*[labelled(c) for c in WORDS])).alias("x"))
    # A record has each word once, so there are at most the words of a record over the share.
    common = words.groupBy("x.c", "x.w").count().filter(F.col("count") > max(COMMON_RECORDS, COMMON_SHARE * n)).collect()
    feats = base
    for c in WORDS:
        stock = F.array(*[F.lit(r["w"]) for r in common if r["c"] == c]).cast("array<string>")
        feats = feats.withColumns({f"common_{c}": F.array_intersect(c, stock), c: F.array_except(c, stock)})
    names = durable(parsed_names(rows), "names")
    start = F.substring(F.get("names", F.lit(0))["s"], 1, 3)
    # What a link calls the person: its last part, or the first of the host on a site of one's own. The same name on
    # two hosts is one person's as surely as the same link.
    host = F.substring_index("l", "/", 1)
    handle = F.when(F.col("l").contains("/"), F.substring_index(F.substring_index("l", "/", -1), "@", -1)).otherwise(F.substring_index("l", ".", 1))
    stated = rows.select("id", "side", F.explode("links").alias("l")).select("id", "side", F.when(F.length(handle) >= 5, handle).otherwise(F.col("l")).alias("l"), host.alias("host")).distinct()
    stated = stated.join(names.select("id", "side", start.alias("start")), ["id", "side"], "left")
    purity = stated.groupBy("l", "start").agg(F.count("*").alias("n")).groupBy("l").agg(F.max(F.when(F.col("start").isNotNull(), F.col("n"))).alias("top"), F.sum("n").alias("n"))
    purity = purity.filter(f"top >= {OWN_SHARE} * n and n > 1")  # what one record alone states tells nothing
    own = stated.join(purity.select("l"), "l").select("id", "side", F.xxhash64("l").alias("link"), F.xxhash64("host").alias("host"))
    links = durable(own, "links")
    mine = links.groupBy("id", "side").agg(F.collect_set("link").alias("own"), F.collect_set("host").alias("hosts"))
    feats = feats.join(names, ["id", "side"], "left").join(mine, ["id", "side"], "left")
    none = F.array().cast("array<bigint>")
    feats = feats.withColumns({"own": F.coalesce("own", none), "hosts": F.coalesce("hosts", none), "names": F.coalesce("names", F.array().cast("array<struct<g:string,alts:array<string>,s:string>>"))})
    feats = durable(feats, "people")
    release(rows, base, names)
    return feats, links
