"""Mapping freely typed values to a canonical list (problem 6).

Method: a prefix-filter set-similarity join. A value and every spelling of a reference entry are
sets of tokens: character bigrams of the words that name the thing, and one whole token for each
generic word (kind of organisation, kind of place). Tokens are ordered by global rarity; only the
rare prefix of each set, ``|x| - ceil(t |x|) + 1`` tokens, is joined; length and position bound the
overlap that is still possible; the Jaccard similarity of what is left is computed exactly. An
exact check of generic words and edit distance follows and the best entry stays. A value that has
none is reported as ``none``.

Values are joined once per distinct canonical form, however many rows carry it.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.durable import durable

#: How generic words of organisation and place names are abbreviated.
ABBREVIATIONS = {
    "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories",
    "uni": "university", "univ": "university", "u": "university",
    "inst": "institute", "tech": "technology", "technol": "technology",
    "coll": "college", "poly": "polytechnic", "polytech": "polytechnic",
    "found": "foundation", "fdn": "foundation", "fndn": "foundation",
    "ctr": "centre", "center": "centre", "cent": "centre", "cdr": "centre for data research",
    "res": "research", "rsch": "research", "sys": "systems", "systms": "systems", "system": "systems",
    "analytic": "analytics", "anlytcs": "analytics", "co": "company", "comp": "company",
    "incorporated": "inc", "limited": "ltd", "sci": "sciences", "appl": "applied",
    "robot": "robotics", "rob": "robotics", "cld": "cloud",
    "mt": "mount", "mnt": "mount", "st": "saint", "pt": "port", "prt": "port", "lk": "lake", "n": "new", "nw": "new",
    "hts": "heights", "hgts": "heights", "fls": "falls", "hbr": "harbour", "harbor": "harbour",
}
#: Words that carry no identity wherever they stand, and legal forms.
EMPTY_WORDS = {"the", "of", "for", "and", "in", "at", "on", "de", "area", "greater", "near", "based", "remote", "inc", "ltd", "llc", "gmbh", "ev", "ag", "plc", "corp"}
#: Remarks around an organisation's name.
REMARKS = re.compile(
    r"^\s*(?:ex|formerly|former|previously)[-\s:]+|\s*[-–(,]\s*(?:part[\s-]time|full[\s-]time|contract|acquired|remote|e\.?\s?v\.?)\s*\)?\s*$"
    r"|^\s*(?:dept|department)\.?\s+of\s+\w+\s*,\s*|\s*,\s*(?:school|dept|department|faculty|institute) of \w+\s*$|\(\s*acquired[^)]*\)|\(\s*(?:now|formerly)\b[^)]*\)",
    re.I,
)
#: A value that may be the initials of a name.
INITIALS = re.compile(r"[A-Z]{3,5}")
#: A word of the reference list is generic if it stands in at least this share of its entries.
GENERIC_SHARE = 0.04
THRESHOLD = 0.45
#: Entries of a list; it is sent to every worker, values aren't.
MAX_LISTED = 100_000


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def within(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions counted once, or ``most + 1`` if it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


class Shaper:
    """Turns names into (core, generic words, region). Built from the reference list alone."""

    def __init__(self, names: list[str], regions: list[tuple[str, str]]):
        df: dict[str, int] = {}
        for n in names:
            for w in set(re.findall(r"[^\W_]+", fold(n))):
                df[w] = df.get(w, 0) + 1
        self.generic = {w for w, n in df.items() if n >= max(3, GENERIC_SHARE * len(names))} - EMPTY_WORDS
        self.common = sorted(self.generic) + sorted(w for w in EMPTY_WORDS if len(w) >= 3)
        self.cores = sorted({w for n in names for w in re.findall(r"[^\W_]+", fold(n))} - self.generic - EMPTY_WORDS)
        self._known = set(self.cores)
        self.regions = {}
        for name, code in regions:
            self.regions[fold(name)] = fold(code or name)
        self.codes = {fold(code) for _, code in regions if code}
        self._memo: dict[str, str] = {}

    def word(self, w: str) -> str:
        """A generic word for an abbreviation or misspelling of it, else the word."""
        got = self._memo.get(w)
        if got is None:
            got = w
            if w in ABBREVIATIONS and all(x in self.generic or x in EMPTY_WORDS for x in ABBREVIATIONS[w].split()):
                got = ABBREVIATIONS[w]
            elif w not in self.generic and w not in self._known and len(w) >= 2:
                most = 1 if len(w) < 6 else 2
                best = min(((within(w, g, most), g) for g in self.common), default=(9, ""))
                if best[0] <= most and best[0] * 3 <= len(best[1]):
                    got = best[1]
            if len(self._memo) < 200_000:
                self._memo[w] = got
        return got

    def split(self, s: str) -> tuple[str, tuple[str, ...], str]:
        region = ""
        s = s.replace("@", " ")
        for _ in range(3):
            t = REMARKS.sub(" ", s)
            if t == s:
                break
            s = t
        s = re.sub(r"(?<=[a-zà-ÿ]{2})(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", s)
        f = fold(s)
        f = re.sub(r"\bo\.?\s?s\.(?=\W|$)", " sea ", f)
        if self.regions:
            f = re.sub(r"\s/\s*remote\s*$", " ", f)
            for part in re.split(r"\s*[,()/]\s*|\s+-\s+", f):
                p = part.strip()
                if p in self.regions:
                    region, f = self.regions[p], re.sub(rf"(?<!\w){re.escape(p)}(?!\w)", " ", f)
                elif p in self.codes and p != f.strip():
                    region, f = p, re.sub(rf"(?<!\w){re.escape(p)}(?!\w)", " ", f)
        core, generic = [], set()
        found = re.findall(r"[^\W_]+", f.replace("&", " company ").replace("'", ""))
        # a single letter abbreviates at the front only
        words = [x for i, w in enumerate(found) for x in (self.word(w) if len(w) > 1 or i == 0 else w).split()]
        for w in words:
            if w in self.generic:
                generic.add(w)
            elif w not in EMPTY_WORDS:
                core.append(w)
        if any(len(w) >= 5 for w in core):  # scraps of misspelt short words
            core = [w for w in core if len(w) > 3]
        return " ".join(core), tuple(sorted(generic)), region


def grams(core: str) -> set[str]:
    out = set()
    for w in core.split():
        p = f"^{w}$"
        out.update(p[i : i + 2] for i in range(len(p) - 1))
    return out


def initials(name: str) -> set[str]:
    words = re.findall(r"[^\W_]+", fold(name))
    short = [w for w in words if w not in {"of", "for", "and", "the"}]
    return {"".join(w[0] for w in ws) for ws in (words, short) if len(ws) >= 3}


def _shape_udf(shapers: dict[str, Shaper]):
    @F.pandas_udf("core string, generic array<string>, region string, tokens array<string>")
    def shape(field: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = []
        for f, v in zip(field, value):
            core, generic, region = (shapers.get(f) or shapers[None]).split(v)
            toks = grams(core) | {f"={g}" for g in generic}
            if INITIALS.fullmatch(v.strip()):
                toks = {f"@{v.strip().lower()}"}
            rows.append((core, list(generic), region, sorted(toks)))
        return pd.DataFrame(rows, columns=["core", "generic", "region", "tokens"])

    return shape


def _check_udf():
    @F.pandas_udf("double")
    def check(core: pd.Series, ref_core: pd.Series, generic: pd.Series, ref_generic: pd.Series, region: pd.Series, ref_region: pd.Series, jac: pd.Series) -> pd.Series:
        out = np.full(len(core), -1.0)
        for i, (a, b, g, h, r, s, j) in enumerate(zip(core, ref_core, generic, ref_generic, region, ref_region, jac)):
            most = min(3, 1 + len(b) // 6)
            d = within(a.replace(" ", ""), b.replace(" ", ""), most)
            g, h = set(g), set(h)
            if b.startswith("@"):  # initials agree as a whole or not at all
                out[i] = j - 0.1
                continue
            if d > most or not a or (g - h):
                continue
            out[i] = j - 0.12 * d - 0.04 * len(h - g) - (0.3 if r and s and r != s else 0) + (0.05 if r and r == s else 0)
        return pd.Series(out)

    return check


def map_values(values: DataFrame, reference: DataFrame, regions: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The reference entry of each distinct (``field``, ``value``): (``field``, ``value``, ``ref_id``, ``similarity``).

    ``reference`` is (``field``, ``ref_id``, ``name``, ``alias`` or null, ``region`` code or null);
    aliases of a region are stated by ``regions`` as (name, code). ``ref_id`` is null where nothing
    reaches ``threshold``. Null and blank values are dropped; repeated values count once; ties go to
    the entry with more exact mentions among the values, then to the smaller id. An empty list maps
    everything to null. The list must fit in an executor (its names shape the tokens); values don't.
    """
    spark = values.sparkSession
    listed = reference.select("field", "ref_id", "name", "alias", "region").limit(MAX_LISTED + 1).collect()
    if len(listed) > MAX_LISTED:
        raise ValueError(f"a reference list of more than {MAX_LISTED} entries can't be sent to every worker")
    shapers = {None: Shaper([], [])}
    for f in {r["field"] for r in listed}:
        own = [r for r in listed if r["field"] == f]
        names = [x for r in own for x in (r["name"], r["alias"]) if x]
        shapers[f] = Shaper(names, (regions or []) if any(r["region"] for r in own) else [])
    spellings = []
    for r in listed:
        for text in (r["name"], r["alias"]):
            if text and text.strip():
                core, generic, _ = shapers[r["field"]].split(text)
                region = fold(r["region"] or "")
                spellings.append((r["field"], r["ref_id"], core, list(generic), region, sorted(grams(core) | {f"={g}" for g in generic})))
                if generic and core:  # the bare name
                    spellings.append((r["field"], r["ref_id"], core, list(generic), region, sorted(grams(core))))
                for short in initials(text):
                    spellings.append((r["field"], r["ref_id"], f"@{short}", [], region, [f"@{short}"]))
        if r["alias"]:  # one name with the other beside it
            both = [shapers[r["field"]].split(x) for x in (r["name"], r["alias"])]
            for a, b in (both, both[::-1]):
                generic = sorted({*a[1], *b[1]})
                core = f"{a[0]} {b[0]}".strip()
                spellings.append((r["field"], r["ref_id"], core, generic, fold(r["region"] or ""), sorted(grams(core) | {f"={g}" for g in generic})))
    schema = "field string, ref_id string, core string, generic array<string>, region string, tokens array<string>"
    refs = spark.createDataFrame(spellings, schema).withColumn("rid", F.monotonically_increasing_id())

    vals = values.select("field", "value").filter("trim(value) <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    vals = durable(vals.withColumn("s", _shape_udf(shapers)("field", "value")).select("field", "value", "n", "s.*"), "values")
    forms = vals.withColumn("g", F.array_join("tokens", " ")).groupBy("field", "core", "region", "g").agg(F.first("tokens").alias("tokens"), F.first("generic").alias("generic"))
    forms = forms.withColumn("form", F.xxhash64("field", "core", "region", "g"))

    # Global rarity: how often a token occurs in forms and spellings; rare first, ties by text.
    counts = forms.select("field", F.explode("tokens").alias("token")).unionByName(refs.select("field", F.explode("tokens").alias("token"))).groupBy("field", "token").count()
    # A token that no spelling has can't match; it only fills the front of the order. Only tokens of the list are joined.
    listed_tokens = counts.join(F.broadcast(refs.select("field", F.explode("tokens").alias("token")).distinct()), ["field", "token"])
    rank = listed_tokens.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy("count", "token")))
    rank = durable(rank.select("field", "token", "rank"), "rank")

    def prefixes(side, key):
        e = side.select("field", key, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(F.broadcast(rank), ["field", "token"])
        g = e.groupBy("field", key, "size").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
        # tokens unknown to the list come first in the order, then the known ones by rank
        g = g.withColumn("front", F.col("size") - F.size("ranks"))
        keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1 - F.col("front")
        return g.withColumn("prefix", F.expr("slice(ranks, 1, greatest(0, cast(size - ceil({} * size) + 1 - front as int)))".format(threshold))).filter(keep > 0)

    left = prefixes(forms, "form").select("field", "form", "size", "front", "ranks", F.posexplode("prefix").alias("i", "rank"))
    right = prefixes(refs, "rid").select("field", "rid", F.col("size").alias("rsize"), F.col("ranks").alias("rranks"), F.posexplode("prefix").alias("k", "rank"))
    need = F.lit(threshold) / F.lit(1 + threshold) * (F.col("size") + F.col("rsize"))
    rest = F.least(F.col("size") - F.col("front") - F.col("i"), F.col("rsize") - F.col("k"))
    met = left.join(F.broadcast(right), ["field", "rank"])
    met = met.filter((F.col("rsize") >= F.lit(threshold) * F.col("size")) & (F.col("size") >= F.lit(threshold) * F.col("rsize")))
    # The first common token of a pair is met at positions i and k, so no more than rest tokens can be common; later meetings are repeats.
    met = met.filter(rest >= need - 1e-9)
    both = F.size(F.array_intersect("ranks", "rranks"))
    # Keep a pair at its first common token only.
    first = F.col("rank") == F.array_min(F.array_intersect("ranks", "rranks"))
    jac = both / (F.col("size") + F.col("rsize") - both)
    pairs = met.filter(first).withColumn("jac", jac).filter(F.col("jac") >= threshold - 1e-9).select("form", "rid", "jac")
    shape_l = forms.select("form", "core", "generic", "region")
    shape_r = refs.select("rid", "field", "ref_id", F.col("core").alias("rcore"), F.col("generic").alias("rgeneric"), F.col("region").alias("rregion"))
    scored = pairs.join(shape_l, "form").join(F.broadcast(shape_r), "rid")
    scored = scored.withColumn("score", _check_udf()("core", "rcore", "generic", "rgeneric", "region", "rregion", "jac")).filter("score > 0")
    # How often an entry is written exactly: what an ambiguous short form most likely means.
    named = reference.select("field", F.col("name").alias("value"), "ref_id")
    mentions = F.broadcast(vals.join(F.broadcast(named), ["field", "value"]).groupBy("ref_id").agg(F.sum("n").alias("mentions")))
    best = scored.join(mentions, "ref_id", "left").groupBy("form").agg(
        F.max(F.struct(F.round("score", 6).alias("score"), F.coalesce("mentions", F.lit(0)).alias("m"), F.col("jac"), F.expr("ref_id").alias("ref_id"))).alias("b")
    )
    best = best.select("form", F.col("b.ref_id").alias("ref_id"), F.col("b.jac").alias("similarity"))
    keyed = vals.select("field", "value", F.xxhash64("field", "core", "region", F.array_join("tokens", " ")).alias("form"))
    return keyed.join(best, "form", "left").select("field", "value", "ref_id", "similarity")


def profile_values(profiles: DataFrame) -> DataFrame:
    """(``profile_id``, ``field``, ``value``) of organisation names and locations, distinct within a row."""
    orgs = F.transform(F.col("organizations"), lambda o: F.struct(F.lit("organization").alias("field"), o["name"].alias("value")))
    places = F.transform(F.col("locations"), lambda v: F.struct(F.lit("location").alias("field"), v.alias("value")))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    x = F.array_distinct(F.concat(F.coalesce(orgs, empty), F.coalesce(places, empty)))
    return profiles.select("profile_id", F.explode(x).alias("x")).select("profile_id", "x.field", "x.value").filter("trim(value) <> ''")


def profile_reference(orgs: DataFrame, places: DataFrame) -> DataFrame:
    a = orgs.select(F.lit("organization").alias("field"), F.col("org_id").alias("ref_id"), "name", F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("region"))
    b = places.select(F.lit("location").alias("field"), F.col("place_id").alias("ref_id"), "name", F.col("alt_name").alias("alias"), F.col("region_code").alias("region"))
    return a.unionByName(b)


def map_profiles(profiles: DataFrame, orgs: DataFrame, places: DataFrame) -> DataFrame:
    """Each distinct value of each profile with its entry: (``profile_id``, ``field``, ``value``, ``ref_id`` or 'none')."""
    values = profile_values(profiles)
    regions = [(r["region"], r["region_code"]) for r in places.select("region", "region_code").distinct().collect() if r["region"]]
    mapped = map_values(values.select("field", "value"), profile_reference(orgs, places), regions)
    out = values.join(mapped.select("field", "value", "ref_id"), ["field", "value"])
    return out.groupBy("field", "value", "profile_id").agg(F.first("ref_id").alias("ref_id")).select("profile_id", "field", "value", F.coalesce("ref_id", F.lit("none")).alias("ref_id"))
