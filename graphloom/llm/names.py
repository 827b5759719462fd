"""Variant spellings of typed names, by suffix blocking and longest common subsequences.

What a table teaches about its own names is learned first: the kind of entity (naive Bayes on
words and shapes, from the rows that state a type), which words are given names (they stand
first, or after a comma), nicknames (quoted ones, and different given names of one family name
under one description), and which words of descriptions and names are too common to tell
anything apart.

Different spellings are then compared, not records.  Every part of a name is indexed by its
suffix of a minimum length, by the suffix of the part read backwards and by its two ends, so
that no single slip hides all three.  A key that many spellings share is refined with the other
part of the name, by classes that two spellings of one name share: a first letter or last
letters, of the given name itself and of those it is a nickname of; a refined key that is
still large is compared tile by tile, so that nothing is dropped.  Spellings match by the ratio
of their longest common subsequence and by their parts: order, initials, nicknames,
abbreviations.  At last records are linked: those of matching spellings and agreeing
descriptions, where an absent description agrees with all.  Links are closed over connected
components; an initial that could stand for several relatives links to none of them.

Defined results: rows that are no entity, and null or blank names, take no part; entities that
are neither person nor organisation have no pairs; repeated rows count once; in a table that
states no types nothing can be told to be a person, and there are no pairs.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import connected_components
from graphloom.session import cut_lineage, parallelism

#: Suffixes shorter than this are not indexed; shorter words are keys themselves.
SUFFIX = 5
#: Spellings that may share a key before it is refined with the other part of the name.
COMMON = 50
#: Spellings of one key that one task compares at a time; larger groups are compared tile by tile.
BLOCK = 512
#: Bound of the labelled sample that the kinds are learned from.
LABELLED = 20_000
FEATURES = 1 << 16
#: A word of so many descriptions says nothing of which entity is meant (at most 1 / share a description).
STOCK_SHARE = 0.05
#: Share of the names that a given name, a common word of names or a nickname must have.
NAME_SHARE = 1e-4
#: Descriptions under which more given names occur tell nothing about nicknames.
MOST_GIVEN = 8

#: Words that are no part of a personal name.
HONORIFICS = set("dr prof professor mr mrs ms miss mx hon sir dame lady lord rev herr frau monsieur madame don dona señor señora jr sr esq phd md ii iii iv".split())
#: Words that say nothing about which body is meant.
EMPTY_WORDS = set("the of and for in ltd limited inc plc llc gmbh sa partners group &".split())

QUOTED = re.compile("[\"“”„«»']([^\"“”„«»']+)[\"“”„«»']")
KINDS = ("person", "organisation", "other")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of cells at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * lcs_length(a, b) / max(1, len(a) + len(b))


def stated_kind(entity_type: str | None) -> str | None:
    """The kind a type names, also if it is cut short; None if it names none."""
    said = fold(entity_type or "").strip()
    if len(said) < 3:
        return None
    for kind, spellings in (("person", ("person",)), ("organisation", ("organisation", "organization"))):
        if any(s.startswith(said) or said.startswith(s) for s in spellings):
            return kind
    return "other"


def traits(name: str, description: str) -> list[int]:
    """Hashed words and shapes of a name and its description."""
    text = fold(name)
    found = re.findall(r"\w+", text.replace("_", " "))
    out = [f"n {w}" for w in found] + [f"h {w[:4]}" for w in found if len(w) > 4]
    if found:
        out += [f"first {found[0]}", f"last {found[-1]}"]
    out += [f"count {min(len(found), 6)}", f"comma {',' in text}", f"single {any(len(w) == 1 for w in found)}", f"aside {'(' in text}"]
    said = re.findall(r"\w+", fold(description))
    out += [f"d {w}" for w in set(said)] + [f"begin {' '.join(said[:n])}" for n in (1, 2) if said]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % FEATURES for t in out]


class KindModel:
    """Naive Bayes over traits, from rows (name, description, stated type)."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        seen = np.zeros((len(KINDS), FEATURES))
        total = np.zeros(len(KINDS))
        for name, description, entity_type in rows:
            if kind := stated_kind(entity_type):
                k = KINDS.index(kind)
                total[k] += 1
                np.add.at(seen[k], np.unique(traits(name, description)), 1)
        self.known = total.sum() > 0
        self.prior = np.log(total + 0.5)
        self.weight = np.log((seen + 0.1) / (total[:, None] + 0.2)).T.astype(np.float32)

    def kind(self, name: str, description: str) -> str:
        if not self.known:
            return "other"
        return KINDS[int(np.argmax(self.prior + self.weight[np.unique(traits(name, description))].sum(axis=0)))]


class Lore:
    """What a table teaches about its names."""

    def __init__(self, kinds: KindModel, stock: set[str], given: set[str], common: set[str]) -> None:
        self.kinds, self.stock, self.given, self.common = kinds, stock, given, common

    def said(self, description: str | None) -> str:
        """The words of a description that are not stock, in order of the alphabet."""
        return " ".join(sorted(set(re.findall(r"\w+", (description or "").lower())) - self.stock))


class Name:
    """The parts of one spelling of a name of a known kind."""

    __slots__ = ("body", "family", "given", "kind", "orders", "quoted", "rest")

    def __init__(self, text: str, kind: str, lore: Lore, nicknames: dict[str, set[str]]) -> None:
        raw = fold(text)
        self.kind, self.body, self.rest, self.family, self.given, self.orders = kind, "", (), "", (), []
        self.quoted = [q.strip() for q in QUOTED.findall(raw)]
        raw = re.sub(r"\(\s*eds?\.?\s*\)", " ", QUOTED.sub(" ", raw))
        if kind == "organisation":
            self._body(raw, lore)
        elif kind == "person":
            self._person(raw, lore, nicknames)

    def _body(self, raw: str, lore: Lore) -> None:
        content = [w for w in re.findall(r"\w+", raw.replace("_", " ")) if w not in EMPTY_WORDS]
        aside = re.search(r"\(([^)]*)\)", raw)
        inside = [w for w in re.findall(r"\w+", aside[1]) if w not in lore.common and w not in EMPTY_WORDS and len(w) > 4] if aside else []
        # the word that tells the body apart is a rare one; of several the longest
        self.body = max(inside or [w for w in content if w not in lore.common] or content, key=len, default="")
        self.rest = tuple(w for w in content if w != self.body and not (aside and len(w) > 1 and self.body.startswith(w)))

    def _person(self, raw: str, lore: Lore, nicknames: dict[str, set[str]]) -> None:
        halves = [p for p in raw.split(",") if re.findall(r"\w+", p) and not all(w in HONORIFICS for w in re.findall(r"\w+", p))]
        parts = [[w for w in re.findall(r"[\w'’-]+", p) if w.strip(".") not in HONORIFICS] for p in halves]
        parts = [p for p in parts if p]
        known = lambda w: w in nicknames or w in lore.given
        if len(parts) >= 2:
            family, given = parts[0][-1], parts[1]
        else:
            flat = parts[0] if parts else []
            if len(flat) >= 2 and (known(flat[-1]) and not known(flat[0]) or len(flat[-1]) <= 2 < len(flat[0])):
                family, given = flat[0], flat[1:]
            else:
                family, given = (flat[-1], flat[:-1]) if flat else ("", [])
        if not given:
            self.kind = "other"
            return
        if len(given) == 1 and len(given[0]) == 2 and not known(given[0]):
            given = list(given[0])  # initials written together
        self.family, self.given = family, (*given, *self.quoted)
        # the readings of the name: as parsed, and without a comma also with the parts exchanged
        self.orders = [(family, self.given)]
        if len(parts) < 2 and len(given[0]) > 2 and len(family) > 2:
            self.orders.append((given[0], (family, *self.given[1:])))


def _same_given(a: str, b: str, nicknames: dict[str, set[str]]) -> int:
    """2: the same given name; 1: an initial or a nickname that also stands for others; 0: another."""
    if len(a) == 1 or len(b) == 1:
        short, other = (a, b) if len(a) == 1 else (b, a)
        return int(other.startswith(short) or any(f.startswith(short) for f in nicknames.get(other, ())))
    if a == b:
        return 2
    full_a, full_b = nicknames.get(a, {a}), nicknames.get(b, {b})
    if full_a & full_b or a in full_b or b in full_a:
        return 2 if len(full_a) == len(full_b) == 1 else 1
    if ratio(a, b) >= 0.8 and abs(len(a) - len(b)) <= 2 and (a[0] == b[0] or a[-3:] == b[-3:]):
        return 2
    for x, y in ((a, b), (b, a)):  # a nickname of a misspelt name
        if any(ratio(full, y) >= 0.85 and full[0] == y[0] for full in nicknames.get(x, ())):
            return 2 if len(nicknames[x]) == 1 else 1
    return 0


def _fits(a: str, b: str) -> bool:
    """Whether one word may be a short or misspelt form of the other."""
    if a == b or ratio(a, b) >= 0.7:
        return True
    short, full = sorted((a, b), key=len)
    if full.startswith(short) or len(short) > 3 and short[-1] == "s" and full.startswith(short[:-1]):  # Lab, Labs
        return True
    return len(short) > 2 and short[0] == full[0] and short[-1] == full[-1] and lcs_length(short, full) == len(short)


def same(a: Name, b: Name, nicknames: dict[str, set[str]]) -> int:
    """2: the spellings fit; 1: they would, if no relative fits as well; 0: they do not."""
    if a.kind != b.kind or a.kind == "other":
        return 0
    if a.kind == "organisation":
        if not a.body or not b.body or ratio(a.body, b.body) < 0.84:
            return 0
        few, many = sorted((a.rest, b.rest), key=len)
        free = list(many)
        for word in sorted(few, key=len, reverse=True):
            hit = next((w for w in sorted(free, key=lambda w: (w != word, -len(w))) if _fits(word, w)), None)
            if hit is None:
                return 0
            free.remove(hit)
        return 2
    best = 0
    for i, (family, given) in enumerate(a.orders):
        for j, (other, names) in enumerate(b.orders):
            if i + j < 2 and ratio(family, other) >= 0.84:
                best = max(best, _same_given(given[0], names[0], nicknames))
    return best


def _classes(given: str, nicknames: dict[str, set[str]]) -> set[str]:
    """Classes of which two given names that ``_same_given`` accepts share at least one."""
    return {c for name in (given, *nicknames.get(given, ())) for c in (f"1{name[:1]}", f"3{name[-3:]}")}


def keys_of(name: Name, nicknames: dict[str, set[str]]) -> dict[str, set[str]]:
    """Key -> what refines it, for every indexed part of a spelling."""
    refine: dict[str, set[str]] = {}
    if name.kind == "organisation":
        refine[name.body] = {""}
    for family, given in name.orders:
        refine.setdefault(family, set()).update(_classes(given[0], nicknames))
        if len(given[0]) > 2:
            refine.setdefault(given[0], set()).add(f"{family[:2]}>{family[-2:]}")
    out: dict[str, set[str]] = {}
    for part, classes in refine.items():
        bases = [f"s:{part[-SUFFIX:]}", f"p:{part[:SUFFIX]}", f"e:{part[:3]}:{part[-3:]}"] if len(part) >= SUFFIX else [f"w:{part}"]
        for base in bases:
            out.setdefault(base, set()).update(classes)
    return out


def learn(records: DataFrame) -> Lore:
    """The lore of (entity_name, description, entity_type); every table collected is bounded by its share."""
    named = records.select("entity_name", "description", "entity_type").distinct()
    stated = named.filter(F.length(F.trim("entity_type")) >= 3)
    sizes = named.agg(F.count("*").alias("n"), F.sum(F.when(F.length(F.trim("entity_type")) >= 3, 1).otherwise(0)).alias("stated"), F.sum(F.when(F.length(F.trim("description")) > 0, 1).otherwise(0)).alias("described")).first()
    n, described = sizes["n"], sizes["described"] or 0
    spread = 1 << 30
    share = min(1.0, LABELLED / max(1, sizes["stated"] or 0))
    rows = stated.filter(F.pmod(F.xxhash64("entity_name", "description"), F.lit(spread)) < share * spread).collect()
    kinds = KindModel([(r["entity_name"], r["description"], r["entity_type"]) for r in rows])
    split = lambda c: F.split(F.lower(c), r"(?U)\W+")
    words = named.filter(F.length(F.trim("description")) > 0).select(F.explode(F.array_distinct(split("description"))).alias("w")).filter("w <> ''")
    stock = {r["w"] for r in words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > STOCK_SHARE * described).collect()}
    # a word's places in names: first (or first after a comma) against last (or last before it)
    halves = named.select(F.transform(F.split(F.lower("entity_name"), ","), lambda h: F.filter(F.split(F.trim(h), r"(?U)[^\w'’-]+"), lambda w: w != "")).alias("h")).select(F.filter("h", lambda h: F.size(h) > 0).alias("h")).filter("size(h) > 0")
    first = F.when(F.size("h") > 1, F.col("h")[1][0]).when(F.size(F.col("h")[0]) > 1, F.col("h")[0][0])
    last = F.when(F.size("h") > 1, F.element_at(F.col("h")[0], -1)).when(F.size(F.col("h")[0]) > 1, F.element_at(F.col("h")[0], -1))
    ends = halves.select(F.explode(F.array(F.struct(first.alias("w"), F.lit(1).alias("at")), F.struct(last.alias("w"), F.lit(0).alias("at")))).alias("e")).select("e.w", "e.at").filter("w is not null")
    counted = ends.groupBy("w").agg(F.sum("at").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= F.greatest(F.lit(3), F.lit(NAME_SHARE * n)))
    given = {fold(r["w"]) for r in counted.filter("first >= 0.7 * n").collect()}
    parts = named.select(F.explode(F.array_distinct(split("entity_name"))).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    common = {fold(r["w"]) for r in parts.filter(F.col("n") > F.greatest(F.lit(20), F.lit(3 * NAME_SHARE * n))).collect()}
    return Lore(kinds, stock, given, common)


def learn_nicknames(parsed: DataFrame) -> dict[str, set[str]]:
    """nickname -> given names, of (family, given, quoted, said): quoted ones, and given names of one family and description."""
    n = parsed.count()
    floor = F.greatest(F.lit(2), F.lit(1e-5 * n))
    people = parsed.filter("kind = 'person' and length(given) > 1")
    quoted = people.select("given", F.explode("quoted").alias("other")).filter("length(other) > 1")
    named = people.filter("said <> ''").select("family", "said", "given").distinct().groupBy("family", "said").agg(F.collect_set("given").alias("g")).filter(f"size(g) between 2 and {MOST_GIVEN}")
    both = named.select(F.explode("g").alias("given"), "g").select("given", F.explode("g").alias("other")).filter("given <> other")
    pairs = quoted.unionByName(both).groupBy("given", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= floor)
    counts = people.groupBy("given").agg(F.count("*").alias("all"))
    rows = pairs.join(counts, "given").join(counts.select(F.col("given").alias("other"), F.col("all").alias("own")), "other", "left").collect()
    table: dict[str, Counter] = {}
    for r in rows:  # the rarer name is the nickname; misspellings are none
        slip = ratio(r["given"], r["other"]) >= 0.75 and abs(len(r["given"]) - len(r["other"])) <= 2
        if not slip and r["all"] > (r["own"] or 0):
            table.setdefault(r["other"], Counter())[r["given"]] += r["n"]

    def spare(full: str, seen: Counter) -> bool:
        """A rare partner, a misspelling of another partner, or itself a nickname of one."""
        return seen[full] < 0.2 * max(seen.values()) or any(full != o and (seen[full] < m and ratio(full, o) >= 0.75 or o in table.get(full, ())) for o, m in seen.items())

    return {nick: {full for full in seen if not spare(full, seen)} for nick, seen in table.items()}


def same_names(nodes: DataFrame) -> DataFrame:
    """(node_a, node_b): all pairs of entities whose name means the same person or organisation."""
    spark = nodes.sparkSession
    entities = nodes.filter((F.lower("node_type") == "entity") & F.col("node_id").isNotNull() & (F.length(F.trim("entity_name")) > 0))
    records = entities.select("node_id", "entity_name", F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"))
    lore = spark.sparkContext.broadcast(learn(records))
    text = lambda v: pa.array(v, pa.string())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for node, raw, description in zip(*(c.to_pylist() for c in batch.columns)):
                name = Name(raw, lore.value.kinds.kind(raw, description), lore.value, {})
                if name.kind != "other":
                    spelling = " ".join(fold(raw).split())
                    for column, value in zip(out, (node, name.kind, spelling, lore.value.said(description), name.family, name.given[0] if name.given else "", name.quoted)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(text(c) for c in out[:6]), pa.array(out[6], pa.list_(pa.string()))], ["node_id", "kind", "spelling", "said", "family", "given", "quoted"])

    parsed = records.select("node_id", "entity_name", "description").mapInArrow(parse, "node_id string, kind string, spelling string, said string, family string, given string, quoted array<string>")
    parsed = cut_lineage(parsed.withColumn("form", F.xxhash64("kind", "spelling")).withColumn("rid", F.xxhash64("kind", "spelling", "said")))
    nick = spark.sparkContext.broadcast(learn_nicknames(parsed))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, fine = [], [], []
            for i, (kind, spelling) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for key, classes in keys_of(Name(spelling, kind, lore.value, nick.value), nick.value).items():
                    rows.append(i)
                    keys.append(key)
                    fine.append(sorted(classes))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), text(keys), pa.array(fine, pa.list_(pa.string()))], ["form", "kind", "spelling", "key", "fine"])

    forms = parsed.select("form", "kind", "spelling").distinct()
    indexed = forms.mapInArrow(index, "form bigint, kind string, spelling string, key string, fine array<string>")
    tiled = _tiles(cut_lineage(indexed))
    links = cut_lineage(tiled.repartition(parallelism(spark), "key").mapInArrow(_comparer(lore, nick), "src bigint, dst bigint, sure boolean").groupBy("src", "dst").agg(F.max("sure").alias("sure")))
    final = _groups(parsed.select("rid", "form", "said").distinct(), links)
    members = cut_lineage(parsed.select("node_id", "rid").distinct().join(final, "rid").select("component", "node_id").distinct())
    pairs = members.withColumnRenamed("node_id", "node_a").join(members.withColumnRenamed("node_id", "node_b"), "component").filter("node_a < node_b")
    return pairs.select("node_a", "node_b").distinct()


def _tiles(indexed: DataFrame) -> DataFrame:
    """(form, kind, spelling, key, tile): overly common keys refined, large groups in pairs of tiles."""
    common = indexed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON).select("key", F.lit(True).alias("common"))
    refined = F.when(F.col("common"), F.transform("fine", lambda f: F.concat_ws("|", "key", f))).otherwise(F.array("key"))
    blocks = indexed.join(common, "key", "left").select("form", "kind", "spelling", F.explode(refined).alias("key"))
    large = blocks.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("tiles"))
    blocks = blocks.join(large, "key").withColumn("tile", F.pmod("form", "tiles").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return blocks.select("form", "kind", "spelling", F.concat_ws("#", "key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "tile")


def _comparer(lore, nick):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        frame = pa.Table.from_batches(held)
        codes = np.unique(np.asarray(frame.column("key").to_pylist(), object), return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        form, tile = np.asarray(frame.column("form")), np.asarray(frame.column("tile"))
        kinds, spellings = frame.column("kind").to_pylist(), frame.column("spelling").to_pylist()
        made: dict[int, Name] = {}
        done: set[tuple[int, int]] = set()
        bounds = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            group = order[low:high]
            if len(group) < 2:
                continue
            if len(made) > 100_000:
                made.clear()
            if len(done) > 2_000_000:
                done.clear()
            ids, of = form[group].tolist(), tile[group].tolist()
            names = [made.get(f) or made.setdefault(f, Name(spellings[i], kinds[i], lore.value, nick.value)) for f, i in zip(ids, group.tolist())]
            within = len(set(of)) == 1
            a, b, sure = [], [], []
            for i in range(len(ids)):
                for j in range(i + 1, len(ids)):
                    if ids[i] == ids[j] or not within and of[i] == of[j]:
                        continue
                    pair = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
                    if pair in done:
                        continue
                    done.add(pair)
                    if verdict := same(names[i], names[j], nick.value):
                        a.append(pair[0])
                        b.append(pair[1])
                        sure.append(verdict == 2)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["src", "dst", "sure"])

    return compare


def _groups(records: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, component) of records (rid, form, said) under links between forms.

    Records of linked forms belong together if their descriptions agree.  A record without a
    description agrees with all of a surely linked form, which then are one: they meet in a
    node that stands for the form, so that no form's records are paired with another's.
    """
    records = cut_lineage(records)
    both = links.select(F.explode(F.array(F.struct("src", "dst", "sure"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "sure"))).alias("e")).select("e.*")
    both = cut_lineage(both.unionByName(records.filter("said = ''").select(F.col("form").alias("src"), F.col("form").alias("dst"), F.lit(True).alias("sure")).distinct()))
    # linked spellings under one description
    agree = links.join(records.filter("said <> ''").select(F.col("form").alias("src"), "said", F.col("rid").alias("a")), "src").join(
        records.filter("said <> ''").select(F.col("form").alias("dst"), "said", F.col("rid").alias("b")), ["dst", "said"]
    ).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    bare = records.filter("said = ''").select(F.col("form").alias("src"), "rid")
    ends = bare.join(both, "src").select("rid", "dst", "sure")
    whole = F.xxhash64(F.lit("form"), "form")
    meet = ends.filter("sure").select("rid", F.col("dst").alias("form")).select(F.col("rid").alias("src"), whole.alias("dst"))
    owned = records.join(ends.filter("sure").select(F.col("dst").alias("form")).distinct(), "form", "left_semi").select(F.col("rid").alias("src"), whole.alias("dst"))
    groups = connected_components(agree.unionByName(meet).unionByName(owned))
    grouped = cut_lineage(records.join(groups.select(F.col("node").alias("rid"), "component"), "rid", "left").select("rid", "form", "said", F.coalesce("component", "rid").alias("group")))
    # an unsure link of a record that has no other holds if all its unsure links lead to one group
    unsure = ends.filter("not sure").select(F.col("rid").alias("src"), F.col("dst").alias("form")).join(grouped.select("form", F.col("rid").alias("dst")), "form").select("src", "dst")
    unsure = unsure.unionByName(unsure.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ends = unsure.join(grouped.select(F.col("rid").alias("src"), F.col("group").alias("from")), "src").join(grouped.select(F.col("rid").alias("dst"), F.col("group").alias("to")), "dst")
    single = ends.filter("`from` <> `to`").groupBy("from").agg(F.min("to").alias("low"), F.max("to").alias("high")).filter("low = high").select(F.col("from").alias("src"), F.col("low").alias("dst"))
    size = grouped.groupBy("group").agg(F.count("*").alias("n"))
    alone = single.join(size.select(F.col("group").alias("src"), "n"), "src").filter("n = 1").select("src", "dst")
    merged = connected_components(alone.unionByName(grouped.select(F.col("group").alias("src"), F.col("group").alias("dst"))))
    return grouped.join(merged.select(F.col("node").alias("group"), "component"), "group").select("rid", "component")
