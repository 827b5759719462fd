"""Evaluation passages inside training documents, by q-gram lemma filtering.

Texts are folded to lower-case letters and digits of any script without spaces, so case,
accents, markup, spacing and line breaks do not matter.  Every q-gram of a document is looked
up among those of all items at once; shared q-grams are counted in overlapping bands of
diagonals, and a region stays if its count meets the bound that the edit budget leaves (each
edit destroys at most q q-grams).  What the retained regions could cover of an item must reach
a share of it; then a banded word alignment decides which words the document really carries.

Two kinds of wording do not count.  Instruction lines: stretches that far more items have than
have the item's usual wording, so that an item that occurs under several ids keeps its own.
Stock phrases: words that many documents have in regions although they carry no long run of
the item; such words count only inside a long run.  Both are counted over all items and all
documents.  The corpus is read once for each block of items.

Defined results: null and blank texts carry nothing; items without text leak nowhere; repeated
item rows count once and copies of a document count each.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

Q = 20
#: Diagonals of one band; bands overlap by half.
BAND = 24
#: Length and edits of the least region worth keeping: it shares REGION - Q + 1 - EDITS * Q q-grams.
REGION, EDITS = 48, 1
#: Share of an item that regions must be able to cover, and share of its words that must align.
COVER, SHARE = 0.22, 0.25
#: A run of fewer aligned words does not count.
RUN = 6
#: In a run of so many words stock phrases count.
LONG_RUN = 16
#: Words around a region that are aligned with it.
REACH = 12
#: A stretch of so many characters is shared wording if so many times more items have it than have the item's median stretch.
SHARED, SHARED_TIMES = 30, 3
#: A document whose regions cover less of an item is no leak of it; a word that this share of the
#: documents, and so many at least, have without a long run of the item is stock.
STRAY_COVER, STRAY_SHARE, STRAY_LEAST = 0.15, 5e-4, 4
#: Items of one pass over the corpus; more items take more passes.
ITEMS_A_PASS = 5_000
TABLE_BITS = 22

_TAG = re.compile(r"<[^<>]{1,60}>")
#: Scripts that write no spaces give one word a character.
_WORDS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+")
_LOWER = bytes(range(256)).lower()
_DROP = bytes(b for b in range(256) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]")
_MANGLED = re.compile("[ÃÂ][\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")


def plain(text: str) -> str:
    """The text in lower case, with entities, tags, wrongly decoded letters and accents resolved."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return text.lower()
    if _MANGLED.search(text):
        text = _MANGLED.sub(_mend, text)
    text = unicodedata.normalize("NFKD", text.casefold())
    return text if text.isascii() else _MARKS.sub("", text)


def _mend(match: re.Match) -> str:
    try:
        return match[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return match[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return match[0]


def squeezed(text: str) -> bytes:
    """Letters and digits only, one byte each: itself in ASCII, a hash of it in other scripts."""
    text = plain(text)
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP)
    return one_byte("".join(_WORDS.findall(text)))


def one_byte(text: str) -> bytes:
    if text.isascii():
        return text.encode()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, 128 + (codes * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8).tobytes()


def words(text: str) -> list[str]:
    return _WORDS.findall(plain(text))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the q-gram that starts at each byte."""
    two = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    size = len(data) - Q + 1
    return eight[:size] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8 : Q - 8 + size] * np.uint64(0xC2B2AE3D27D4EB4F)


class ItemIndex:
    """All q-grams of a bounded set of items."""

    def __init__(self, items: list[tuple[int, str, list[int]]]) -> None:
        """items: (id, text, places where a stretch of shared wording starts)."""
        self.ids = [i for i, _, _ in items]
        self.words = [words(t) for _, t, _ in items]
        texts = [one_byte("".join(w)) for w in self.words]
        self.lengths = np.array([len(t) for t in texts])
        self.own = [np.ones(len(t), bool) for t in texts]
        for own, (_, _, shared) in zip(self.own, items):
            for place in shared:
                own[place : place + SHARED] = False
        keys, item, place = [], [], []
        for n, text in enumerate(texts):
            if len(text) >= Q:
                k = grams(np.frombuffer(text, np.uint8))
                keys.append(k)
                item.append(np.full(len(k), n))
                place.append(np.arange(len(k)))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        keys, item, place = join(keys, np.uint64), join(item, np.int64), join(place, np.int64)
        # q-grams of shared wording are no evidence
        own = np.array([self.own[n][p : p + Q].any() for n, p in zip(item, place)], bool) if len(keys) else np.empty(0, bool)
        keys, item, place = keys[own], item[own], place[own]
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.present = np.zeros(1 << TABLE_BITS, bool)
        self.present[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        # the word of each character of an item, and the words of its own
        self.word_at = [np.repeat(np.arange(len(w)), [len(x) for x in w]) for w in self.words]
        self.first_char = np.cumsum([0, *self.lengths])
        self.first_word = np.cumsum([0, *(len(w) for w in self.words)])
        self.word_of = np.concatenate([*(w + low for w, low in zip(self.word_at, self.first_word)), np.empty(0, np.int64)]).astype(np.int64)
        self.own_words = [np.array([o.mean() > 0.5 for o in np.split(own, np.cumsum([len(x) for x in w])[:-1])], bool) if w else np.empty(0, bool) for w, own in zip(self.words, self.own)]

    def candidates(self, texts: list[bytes], stray: np.ndarray | None = None) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
        """(text number, item number, regions (first and last place in text, in item)).

        stray: counts, for the words of all items, of texts that share the word but little else of the item.
        """
        starts = np.zeros(len(texts) + 1, np.int64)
        gap = b"\0" * Q
        np.cumsum([len(t) + Q for t in texts], out=starts[1:])
        data = np.frombuffer(gap.join(texts) + gap, np.uint8)
        if len(data) < Q or not len(self.keys):
            return []
        key = grams(data)
        at = np.flatnonzero(self.present[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        found = np.searchsorted(self.keys, key[at])
        found[found == len(self.keys)] = 0
        sure = self.keys[found] == key[at]
        at, found = at[sure], found[sure]
        many = self.ends[found] - self.starts[found]
        row = np.repeat(np.arange(len(at)), many)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + self.starts[found][row]
        text = np.searchsorted(starts, at, side="right") - 1
        text, spot, item, place = text[row], (at - starts[text])[row], self.item[slot], self.place[slot]
        pair = text * len(self.ids) + item
        bound = REGION - Q + 1 - EDITS * Q
        # pairs that share too few q-grams in all have no region
        _, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
        keep = total[inverse] >= bound
        # pairs whose q-grams, a third of them destroyed, could not cover enough of the item are strays
        few = keep & (total[inverse] < COVER / 3 * self.lengths[item])
        if stray is not None and few.any():
            word = self.word_of[self.first_char[item[few]] + place[few] + Q // 2]
            word = np.unique(pair[few] << 32 | word) & 0xFFFFFFFF
            stray += np.bincount(word, minlength=len(stray))
        keep &= ~few
        pair, spot, item, place = pair[keep], spot[keep], item[keep], place[keep]
        if not len(pair):
            return []
        diagonal = spot - place + (1 << 30)
        half = BAND // 2
        good = np.zeros(len(pair), bool)
        regions = []
        for shift in (0, half):
            band = pair << 34 | (diagonal + shift) // BAND << 1 | bool(shift)
            order = np.lexsort((place, band))
            b = band[order]
            edge = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (place[order][1:] - place[order][:-1] > 3 * Q), True])
            size = np.diff(edge)
            for low, high in zip(edge[:-1][size >= bound], edge[1:][size >= bound]):
                rows = order[low:high]
                good[rows] = True
                regions.append((int(pair[rows[0]]), int(spot[rows].min()), int(spot[rows].max()), int(place[rows].min()), int(place[rows].max())))
        # what the regions can cover of each item
        out, by = [], {}
        for p, *region in regions:
            by.setdefault(p, []).append(tuple(region))
        hits = np.flatnonzero(good)
        hits = hits[np.argsort(pair[hits], kind="stable")]
        edge = np.flatnonzero(np.r_[True, pair[hits][1:] != pair[hits][:-1], True]) if len(hits) else []
        for low, high in zip(edge[:-1], edge[1:]):
            p = int(pair[hits[low]])
            n = p % len(self.ids)
            covered = np.zeros(self.lengths[n] + Q, np.int32)
            places = np.unique(place[hits[low:high]])
            covered[places] += 1
            covered[places + Q] -= 1
            cover = (np.cumsum(covered)[: self.lengths[n]] > 0).sum()
            if cover >= COVER * self.lengths[n]:
                out.append((p // len(self.ids), n, by[p]))
            elif stray is not None and cover < STRAY_COVER * self.lengths[n]:
                stray[np.unique(self.word_of[self.first_char[n] + places + Q // 2])] += 1
        return out

    def segments(self, said: list[str], ends: np.ndarray, n: int, regions: list[tuple[int, int, int, int]]) -> tuple[list[str], list[int], list[int], list[int], bool]:
        """What an alignment needs of a text: the words around each region, four numbers a region (first word
        in the text, first and last word in the item, shift); the item's own words inside regions that may
        hold a long run, and only inside shorter ones; and whether no region is long."""
        parts, numbers, longest = [], [], 0
        long, short = np.zeros(len(self.words[n]), bool), np.zeros(len(self.words[n]), bool)
        for low, high, first, last in sorted(set(regions)):
            i0, i1 = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high + Q - 1, side="right"))
            j0, j1 = int(self.word_at[n][first]), int(self.word_at[n][min(last + Q - 1, self.lengths[n] - 1)])
            longest = max(longest, j1 - j0 + 1)
            (long if j1 - j0 + 1 >= LONG_RUN - 4 else short)[j0 : j1 + 1] = True
            a0, b0 = max(0, i0 - REACH), max(0, j0 - REACH)
            parts.append(" ".join(said[a0 : i1 + REACH + 1]))
            numbers += [a0, b0, j1 + REACH + 1, (i0 - a0) - (j0 - b0)]
        own = self.own_words[n]
        return parts, numbers, np.flatnonzero(long & own).tolist(), np.flatnonzero(short & ~long & own).tolist(), longest < LONG_RUN

    def carried(self, n: int, parts: list[str], numbers: list[int]) -> tuple[list[int], list[int]]:
        """The item's own words that align with the segments: in long runs, and only in shorter runs that count."""
        wanted = self.words[n]
        long, short = np.zeros(len(wanted), bool), np.zeros(len(wanted), bool)
        for part, (a0, b0, end, shift) in zip(parts, zip(*[iter(numbers)] * 4)):
            run: list[tuple[int, int]] = []
            for i, j in [*align(part.split(" "), wanted[b0:end], shift), (1 << 30, 1 << 30)]:
                if run and (j - run[-1][1] > 3 or i - run[-1][0] > 3):
                    if len(run) >= RUN:
                        own = [b0 + y for _, y in run if self.own_words[n][b0 + y]]
                        (long if len(own) >= LONG_RUN else short)[own] = True
                    run = []
                run.append((i, j))
        return np.flatnonzero(long).tolist(), np.flatnonzero(short & ~long).tolist()


def alike(a: str, b: str) -> bool:
    """Equal, or one small slip apart."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[head + 1 :] == b[head + 1 :] or a[head : head + 2] == b[head : head + 2][::-1] and a[head + 2 :] == b[head + 2 :]
    return a[head + 1 :] == b[head:] or a[head:] == b[head + 1 :]


def align(a: list[str], b: list[str], shift: int, width: int = 8) -> list[tuple[int, int]]:
    """Aligned (i, j) word pairs of the best local alignment within a band around i - j = shift."""
    best, where = 0, (0, 0)
    score: dict[tuple[int, int], int] = {}
    for j in range(len(b)):
        for i in range(max(0, j + shift - width), min(len(a), j + shift + width + 1)):
            diagonal = score.get((i - 1, j - 1), 0) + (3 if alike(a[i], b[j]) else -2)
            value = max(0, diagonal, score.get((i - 1, j), 0) - 2, score.get((i, j - 1), 0) - 2)
            if value:
                score[i, j] = value
                if value > best:
                    best, where = value, (i, j)
    pairs = []
    i, j = where
    while (value := score.get((i, j), 0)) > 0:
        hit = alike(a[i], b[j])
        if value == score.get((i - 1, j - 1), 0) + (3 if hit else -2):
            if hit:
                pairs.append((i, j))
            i, j = i - 1, j - 1
        elif value == score.get((i - 1, j), 0) - 2:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def shared_wording(items: DataFrame) -> DataFrame:
    """(item_id, item_text, shared): where stretches start that far more items have than have the item's median stretch."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain_text = one_byte("".join(words(text)))
                size = max(0, len(plain_text) - SHARED + 1)
                keys = [xxhash.xxh3_64_intdigest(plain_text[i : i + SHARED]) - (1 << 63) for i in range(size)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(keys, pa.int64())], ["item_id", "place", "key"])

    found = items.mapInArrow(stretches, "item_id bigint, place int, key bigint")
    counts = found.groupBy("key").agg(F.count_distinct("item_id").alias("n"))
    placed = found.join(counts, "key").groupBy("item_id").agg(F.collect_list(F.struct("place", "n")).alias("p"), F.percentile("n", F.lit(0.5)).alias("usual"))
    shared = placed.select("item_id", F.transform(F.filter("p", lambda x: x["n"] >= SHARED_TIMES * F.col("usual")), lambda x: x["place"]).alias("shared"))
    return items.join(shared, "item_id", "left").select("item_id", "item_text", F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))


def leaked_items(documents: DataFrame, eval_items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id): documents that carry at least this share of an item's words."""
    spark = documents.sparkSession
    rows = eval_items.filter("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").cast("string").alias("item_text"))
    rows = shared_wording(rows.groupBy("item_id").agg(F.min("item_text").alias("item_text"))).orderBy("item_id")
    found: DataFrame | None = None
    models: list = []
    stream = rows.toLocalIterator()
    while (items := [(r["item_id"], r["item_text"], r["shared"]) for r in islice(stream, ITEMS_A_PASS)]) or found is None:
        models.append(spark.sparkContext.broadcast(ItemIndex(items)))
        part = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_searcher(models[-1]), FIELDS)
        part = part.withColumn("block", F.lit(len(models) - 1))
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found)
    read = found.filter("kind = 2").agg((F.sum("n") / len(models)).alias("read"))
    # a document without any long region of the item may be a stray too
    loose = found.filter("kind = 0 and loose").select("item_id", F.explode(F.concat("long", "short")).alias("word"), F.lit(1).alias("n"))
    strays = found.filter("kind = 1").select("item_id", F.col("short")[0].alias("word"), "n").unionByName(loose)
    stock = strays.groupBy("item_id", "word").agg(F.sum("n").alias("n")).join(F.broadcast(read), F.col("n") >= F.greatest(F.lit(STRAY_LEAST), F.col("read") * STRAY_SHARE), "left_semi")
    stock = cut_lineage(stock.select("item_id", "word", F.lit(1).alias("stock")))
    # only what the regions could carry without stock phrases is aligned
    likely = _counted(found.filter("kind = 0"), stock).filter(F.col("carried") >= SPARE * share * F.col("n")).select("doc_id", "item_id")
    pairs = found.filter("kind = 0").join(likely, ["doc_id", "item_id"], "left_semi")
    aligned = pairs.select("block", "doc_id", "item_id", "n", "parts", "numbers").mapInArrow(_aligner(models), "doc_id bigint, item_id bigint, n int, long array<int>, short array<int>")
    return _counted(aligned, stock).filter(F.col("carried") >= share * F.col("n")).select("doc_id", "item_id").distinct()


#: A pair is aligned if its regions reach this part of the share; they may miss words at their ends.
SPARE = 0.7
FIELDS = "kind int, doc_id bigint, item_id bigint, n int, long array<int>, short array<int>, loose boolean, parts array<string>, numbers array<int>"


def _counted(pairs: DataFrame, stock: DataFrame) -> DataFrame:
    """(doc_id, item_id, n, carried): words in long runs, and those in short runs that are no stock."""
    words = pairs.select("doc_id", "item_id", "n", F.size("long").alias("sure"), F.explode_outer("short").alias("word"))
    more = F.count(F.when(F.col("stock").isNull(), F.col("word")))
    counted = words.join(stock, ["item_id", "word"], "left").groupBy("doc_id", "item_id", "n", "sure").agg(more.alias("more"))
    return counted.groupBy("doc_id", "item_id", "n").agg(F.max(F.col("sure") + F.col("more")).alias("carried"))


def _searcher(shared):
    """Rows of kind 0: a document and an item with what an alignment needs; 1: how many documents
    have a word without the item; 2: how many documents were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        stray = np.zeros(len(index.word_of) and int(index.first_word[-1]), np.int64)
        read = 0
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            read += len(texts)
            out = []
            for low in range(0, len(texts), 1024):
                block = [squeezed(t) if t else b"" for t in texts[low : low + 1024]]
                split: dict[int, tuple[list[str], np.ndarray]] = {}
                for t, n, regions in index.candidates(block, stray):
                    if t not in split:
                        said = words(texts[low + t])
                        split = {t: (said, np.cumsum([len(w) for w in said]))}
                    parts, numbers, long, short, loose = index.segments(*split[t], n, regions)
                    out.append((0, ids[low + t], index.ids[n], len(index.words[n]), long, short, loose, parts, numbers))
            yield _batch(out)
        if read:
            some = np.flatnonzero(stray)
            item = np.searchsorted(index.first_word, some, side="right") - 1
            strays = zip(item.tolist(), (some - index.first_word[item]).tolist(), stray[some].tolist())
            yield _batch([(1, None, index.ids[n], count, [], [word], False, [], []) for n, word, count in strays] + [(2, None, None, read, [], [], False, [], [])])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "doc_id", "item_id", "n", "long", "short", "loose", "parts", "numbers"])


def _aligner(models: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, dict[int, int]] = {}
        for batch in batches:
            block, _, items, _, parts, numbers = (c.to_pylist() for c in batch.columns)
            found = []
            for b, item, p, v in zip(block, items, parts, numbers):
                index = models[b].value
                place = at.setdefault(b, {i: n for n, i in enumerate(index.ids)})[item]
                found.append(index.carried(place, p, v))
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), *lists], ["doc_id", "item_id", "n", "long", "short"])

    return run
