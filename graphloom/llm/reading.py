"""Reading level of running prose, by a Rasch-style model of latent difficulty.

Every word has a difficulty and a spread on the scale of the raters' levels, every document a
latent level; the chance that a document of level t uses word w rather than another of its
language is exp(a_w - (t - b_w)^2 / (2 s_w^2)), normalised over the words of the language.
The two sides are estimated in turn: difficulties from the documents' levels (raters' levels
where there are any), levels from the words' difficulties.  Both steps are one pass over the
corpus; the word side is a table of fixed size (hashed words), summed before it is shuffled.
At last cut points between the levels are fitted on the rated documents.

Defined results: null, empty and blank texts, texts of fewer than 40 words of prose and texts
that are only tables, logs, code or lists of terms have no row; null ratings are ignored;
repeated ratings count once; copies of a document have a row each.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

LEAST_WORDS = 40
LEVELS = (1, 2, 3, 4, 5)
#: Hashed words of one language; the table of all languages is the model's fixed size.
WORDS = 1 << 16
#: Bound of the rated documents the model starts from and its cut points are fitted on.
MOST_RATED = 20_000
ROUNDS = 2
GRID = np.linspace(0.5, 5.5, 101)
#: Frequent words that tell a document's language.
COMMON = {
    "en": "the a an this that each one of in by with and but so then although before after while because until to on at it is was",
    "fr": "le la les un une des du de et ou mais puis dans sur avec sous par pour au aux pas est que qui tandis parce près",
    "de": "der die das ein eine einen dem den des und oder aber ist im am auf mit unter durch für von zu zur nicht dann weil bevor",
    "es": "el la los las un una del de al y o pero es en con por para sobre bajo luego porque aunque antes según hacia",
}
LANGUAGES = tuple(COMMON)
_VOTES: dict[str, list[int]] = {}
for _number, _words in enumerate(COMMON.values()):
    for _word in _words.split():
        _VOTES.setdefault(_word, []).append(_number)
_TAG = re.compile(r"<[^<>]{1,60}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LOG = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d(?::\d\d)?\]?\s|\w+=\S+\s+\w+=)")
_CODE = re.compile(r"^\s*(?:[\w.]+\s*(?:=|\+=|:=)\s*[\w.]+\s*[(\[{]|(?:def|class|import|from|return|for|while|if|function|var|let|const|public|private)\b.*[:;{(]\s*$|.*[;{}]\s*$)|\w+\([^()]*\)\s*;?\s*$")
_SENTENCE = re.compile(r"[^.!?…]+[.!?…]+")
_ENDER = re.compile(r"[.!?…;。](?=[\s\"'”’»)\]]|$)")


def prose(text: str) -> list[str]:
    """Words of the running prose of a text, lower case; none if it is no prose."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    kept = []
    for line in text.split("\n"):
        if not line.strip() or line.count("|") >= 2 or line.count("\t") >= 3 or line.lstrip()[:1] == "#" or _LOG.match(line):
            continue
        if "(" in line and _CODE.match(line) or line.rstrip()[-1:] in "{}" and _CODE.match(line):
            continue
        kept.append(line)
    body = "\n".join(kept)
    found = _WORD.findall(body)
    # lists of terms have no sentences
    if len(found) < LEAST_WORDS or len(_ENDER.findall(body)) * 110 < len(found):
        return []
    said = [w.lower() for w in found]
    # the length of each sentence and its joints are items of the model like words
    for sentence in _SENTENCE.findall(body):
        said.append(f"§{min(sentence.count(' ') // 4, 15)}")
        said += [";"] * min(sentence.count(";"), 3) + [f"§,{min(sentence.count(','), 3)}"]
    return said


@lru_cache(400_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def encode(text: str | None) -> tuple[int, bytes] | None:
    """(language number, distinct hashed words and their counts) of a prose text."""
    said = prose(text) if text else []
    if not said:
        return None
    votes = [0] * len(LANGUAGES)
    for number in chain.from_iterable(_VOTES.get(w, ()) for w in said):
        votes[number] += 1
    language = int(np.argmax(votes))
    words, counts = np.unique(np.fromiter(map(_bucket, said), np.uint32, len(said)), return_counts=True)
    return language, (words + language * WORDS).astype("<u4").tobytes() + np.minimum(counts, 65535).astype("<u2").tobytes()


def decode(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, word, count) of every distinct word of a batch."""
    sizes = [len(b) // 6 for b in blobs]
    words = np.frombuffer(b"".join(b[: 4 * n] for b, n in zip(blobs, sizes)), "<u4").astype(np.int64)
    counts = np.frombuffer(b"".join(b[4 * n :] for b, n in zip(blobs, sizes)), "<u2").astype(np.float64)
    return np.repeat(np.arange(len(blobs)), sizes), words, counts


class DifficultyModel:
    """Difficulty and spread of every hashed word, and the level of a document under them."""

    def __init__(self, words: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, least: float = 3.0) -> None:
        size = WORDS * len(LANGUAGES)
        count, mean, square = np.zeros(size), np.full(size, 3.0), np.zeros(size)
        # a little of the overall distribution steadies rare words
        centre = first.sum() / max(1e-9, n.sum())
        width = max(0.25, second.sum() / max(1e-9, n.sum()) - centre**2)
        count[words] = n
        mean[words] = (first + 2 * centre) / (n + 2)
        square[words] = (second + 2 * (width + centre**2)) / (n + 2)
        spread = np.maximum(square - mean**2, 0.15)
        known = count >= least
        self.a = np.where(known, 1 / (2 * spread), 0).astype(np.float32)
        self.b = np.where(known, mean / spread, 0).astype(np.float32)
        self.used = known
        # words are normalised so that the levels' own frequencies do not matter
        scale = np.log(np.maximum(count, 1)) - np.log(self._mass(mean, spread))
        self.logz = np.zeros((len(LANGUAGES), len(GRID)))
        for l in range(len(LANGUAGES)):
            own = np.flatnonzero(known[l * WORDS : (l + 1) * WORDS]) + l * WORDS
            if len(own):
                value = scale[own, None] - (GRID[None] - mean[own, None]) ** 2 / (2 * spread[own, None])
                top = value.max()
                self.logz[l] = top + np.log(np.exp(value - top).sum(axis=0))
        self.scale = None

    @staticmethod
    def _mass(mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """What a word's curve sums to over the levels."""
        return sum(np.exp(-((t - mean) ** 2) / (2 * spread)) for t in LEVELS) + 1e-9

    def levels(self, language: np.ndarray, document: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The likeliest latent level of each document; NaN if it has no known word."""
        size = len(language)
        a = np.bincount(document, counts * self.a[words], minlength=size)
        b = np.bincount(document, counts * self.b[words], minlength=size)
        n = np.bincount(document, counts * self.used[words], minlength=size)
        value = b[:, None] * GRID - a[:, None] * GRID**2 - n[:, None] * self.logz[language]
        return np.where(n > 0, GRID[np.argmax(value, axis=1)], np.nan)


def cut_points(latent: np.ndarray, rated: np.ndarray) -> np.ndarray:
    """Borders between the levels that put the fewest rated documents wrong, in the middle of such borders."""
    order = np.argsort(latent)
    latent, rated = latent[order], np.rint(rated[order])
    cuts = []
    for level in LEVELS[:-1]:
        wrong = np.concatenate([[0], np.cumsum(rated > level)]) - np.concatenate([[0], np.cumsum(rated <= level)])
        # wrong[i]: change of errors if the first i documents are put at or below the level
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[len(best) // 2])
        low = latent[i - 1] if i else level
        high = latent[i] if i < len(latent) else level + 1
        cuts.append((low + high) / 2)
    return np.maximum.accumulate(cuts)


def _word_sums(encoded: DataFrame, level: str, model=None) -> tuple[np.ndarray, ...]:
    """(word, n, sum of levels, sum of their squares) over all documents; a table of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, WORDS * len(LANGUAGES)))
        for batch in batches:
            language = np.asarray(batch.column(0)).astype(np.int64)
            document, words, counts = decode(batch.column(1).to_pylist())
            rated = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            if model is not None:
                own = model.value.levels(language, document, words, counts)
                rated = np.where(np.isnan(rated), np.clip(own, 1, 5), rated)
            good = np.isfinite(rated)[document]
            t = rated[document[good]]
            # a document's words count the less the longer it is, so that no text rules a word
            w = np.minimum(counts[good], 8.0)
            for i, value in enumerate((w, w * t, w * t * t)):
                sums[i] += np.bincount(words[good], value, minlength=sums.shape[1])
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(s[some]) for s in sums)], ["word", "n", "first", "second"])

    parts = encoded.select("language", "words", F.col(level).cast("double").alias("rated")).mapInArrow(run, "word int, n double, first double, second double")
    rows = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")]).toArrow()
    return tuple(rows.column(c).to_numpy() for c in ("word", "n", "first", "second"))


def encode_corpus(documents: DataFrame) -> DataFrame:
    """(doc_id, language, words) of every prose document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, languages, words = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if found := encode(text):
                    rows.append(i)
                    languages.append(found[0])
                    words.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(languages, pa.int32()), pa.array(words, pa.binary())], ["doc_id", "language", "words"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, language int, words binary")


def reading_levels(documents: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """(doc_id, level) of every document of running prose."""
    spark = documents.sparkSession
    rated = ratings.filter("level between 1 and 5 and doc_id is not null").select("doc_id", "rater", "level").distinct()
    rated = rated.groupBy("doc_id").agg(F.avg("level").alias("rated")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)
    encoded = cut_lineage(encode_corpus(documents))
    # at most MOST_RATED small rows
    joined = encoded.join(F.broadcast(rated), "doc_id", "left")
    model = DifficultyModel(*_word_sums(joined.filter("rated is not null"), "rated"))
    for _ in range(ROUNDS):
        model = DifficultyModel(*_word_sums(joined, "rated", spark.sparkContext.broadcast(model)))
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = np.asarray(batch.column(1)).astype(np.int64)
            latent = shared.value.levels(language, *decode(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(latent), batch.column(3)], ["doc_id", "language", "latent", "rated"])

    scored = joined.select("doc_id", "language", "words", F.col("rated").cast("double")).mapInArrow(score, "doc_id bigint, language int, latent double, rated double")
    known = scored.filter("rated is not null and not isnan(latent)").select("language", "latent", "rated").toPandas()
    cuts = {-1: cut_points(known.latent.to_numpy(), known.rated.to_numpy())}
    for language, own in known.groupby("language"):
        if len(own) >= 150:
            cuts[int(language)] = cut_points(own.latent.to_numpy(), own.rated.to_numpy())
    level = F.lit(1)
    for k in range(len(LEVELS) - 1):
        cut = F.lit(float(cuts[-1][k]))
        for language in range(len(LANGUAGES)):
            if language in cuts:
                cut = F.when(F.col("language") == language, F.lit(float(cuts[language][k]))).otherwise(cut)
        level = level + (F.coalesce(F.nanvl("latent", F.lit(3.0)), F.lit(3.0)) > cut).cast("int")
    return scored.select("doc_id", level.cast("int").alias("level")).distinct()
