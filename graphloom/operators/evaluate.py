"""Answer-quality metrics over (id, output, answer) rows; gold answers are separated by a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normal_answer


def golds(answer: Column) -> Column:
    return F.transform(F.split(F.coalesce(answer, F.lit("")), "\\|"), normal_answer)


def answer_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def match(results: DataFrame) -> DataFrame:
    """(id, em, accuracy): equal to a gold answer; containing one."""
    rows = results.select("id", normal_answer(F.col("output")).alias("p"), golds(F.col("answer")).alias("g")).distinct()
    return rows.select("id", F.exists("g", lambda g: g == F.col("p")).cast("int").alias("em"), F.exists("g", lambda g: (g != "") & F.contains(F.col("p"), g)).cast("int").alias("accuracy"))


def token_f1(results: DataFrame) -> DataFrame:
    """(id, f1, precision, recall) of word multisets, the best over the gold answers.

    Where either side is yes, no or noanswer, only equality counts.
    """
    rows = results.select("id", normal_answer(F.col("output")).alias("p"), F.explode(golds(F.col("answer"))).alias("g")).distinct()
    words = rows.withColumns({"pw": answer_words(F.col("p")), "gw": answer_words(F.col("g"))})
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_intersect("pw", "gw"), F.lit(0), lambda s, w: s + F.least(count(F.col("pw"), w), count(F.col("gw"), w)))
    special = F.col("p").isin("yes", "no", "noanswer") | F.col("g").isin("yes", "no", "noanswer")
    scored = words.withColumn("common", F.when(special & (F.col("p") != F.col("g")), 0).otherwise(common))
    precision, recall = F.coalesce(F.try_divide("common", F.size("pw")), F.lit(0.0)), F.coalesce(F.try_divide("common", F.size("gw")), F.lit(0.0))
    scored = scored.withColumns({"precision": precision, "recall": recall})
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    best = scored.groupBy("id").agg(F.max(F.struct("f1", "precision", "recall")).alias("b"))
    return best.select("id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("f1", "precision", "recall")])


def bleu1(results: DataFrame) -> DataFrame:
    """(id, bleu1): clipped word precision with brevity penalty, the best over the gold answers, rounded to 2 places."""
    rows = results.select("id", answer_words(normal_answer(F.col("output"))).alias("pw"), F.explode(golds(F.col("answer"))).alias("g")).distinct()
    words = rows.withColumn("gw", answer_words(F.col("g")))
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    clipped = F.aggregate(F.array_distinct("pw"), F.lit(0), lambda s, w: s + F.least(count(F.col("pw"), w), count(F.col("gw"), w)))
    scored = words.withColumns({"c": F.size("pw"), "r": F.size("gw"), "hit": clipped})
    penalty = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide("r", "c")))
    value = F.when(F.col("c") == 0, 0.0).otherwise(penalty * F.col("hit") / F.col("c"))
    return scored.groupBy("id").agg(F.round(F.max(value), 2).alias("bleu1"))


def rouge_l(results: DataFrame) -> DataFrame:
    """(id, rouge_l): F-measure of the longest common subsequence of words, the best over the gold answers."""
    from collections.abc import Iterator

    import pyarrow as pa

    def lcs(a: list[str], b: list[str]) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << i
        full = (1 << len(a)) - 1
        row = full
        for w in b:
            hit = row & places.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(a) - row.bit_count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for p, gs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                best, said = 0.0, p.split()
                for g in gs:
                    wanted = g.split()
                    if said and wanted and (common := lcs(said, wanted)):
                        precision, recall = common / len(said), common / len(wanted)
                        best = max(best, 2 * precision * recall / (precision + recall))
                scores.append(round(best, 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "rouge_l"])

    rows = results.select(F.col("id").cast("bigint"), normal_answer(F.col("output")).alias("p"), golds(F.col("answer")).alias("g")).distinct()
    return rows.mapInArrow(run, "id bigint, rouge_l double")


def chosen_option(results: DataFrame) -> DataFrame:
    """(id, chosen, correct): the option letter of the output of closed questions, by an ordered cascade of patterns."""
    rows = results.filter("options is not null").select("id", F.coalesce("output", F.lit("")).alias("o"), "answer_idx").distinct()
    tries = [r"^\s*\(?([A-D])\)?[.:)]?\s*$", r"(?i)(?:answer|option)(?: is)?:?\s*\(?([A-D])\b", r"^\s*\(?([A-D])[).:]\s"]
    letter = F.coalesce(*[F.nullif(F.upper(F.regexp_extract("o", p, 1)), F.lit("")) for p in tries], F.lit(""))
    return rows.select("id", letter.alias("chosen"), (letter == F.coalesce("answer_idx", F.lit("-"))).cast("int").alias("correct"))


def report(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, std, min, max, median, n) of each column; std of a sample."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.metric", "m.value")
    return long.groupBy("metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.median("value"), 6).alias("median"), F.count("value").alias("n")
    )


def multi_answer(results: DataFrame) -> DataFrame:
    """(id, accuracy): whether any line or alternative of the output contains any gold answer; a gold answer without words is in all."""
    said = F.transform(F.split(F.regexp_replace(F.coalesce("output", F.lit("")), "\\|", "\n"), "\n"), normal_answer)
    rows = results.select("id", said.alias("p"), golds(F.col("answer")).alias("g")).distinct()
    hit = F.exists("p", lambda p: F.exists("g", lambda g: F.contains(p, g)))
    return rows.groupBy("id").agg(F.max(hit.cast("int")).alias("accuracy"))


def bleu4(results: DataFrame) -> DataFrame:
    """(id, bleu4): geometric mean of clipped 1- to 4-gram precisions with brevity penalty, the best over the gold answers.

    An n-gram order without a hit counts 0.1 hits; without any common word the score is 0.
    """
    rows = results.select("id", answer_words(normal_answer(F.col("output"))).alias("pw"), F.explode(golds(F.col("answer"))).alias("g")).distinct()
    rows = rows.withColumn("gw", answer_words(F.col("g")))

    def grams(words: str, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    def hits(n: int) -> Column:
        count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
        return F.aggregate(F.array_distinct(f"p{n}"), F.lit(0), lambda s, w: s + F.least(count(F.col(f"p{n}"), w), count(F.col(f"g{n}"), w)))

    logs = F.lit(0.0)
    for n in range(1, 5):
        rows = rows.withColumns({f"p{n}": grams("pw", n), f"g{n}": grams("gw", n)})
        rows = rows.withColumn(f"h{n}", hits(n))
        logs = logs + F.log(F.when(F.col(f"h{n}") > 0, F.col(f"h{n}").cast("double")).otherwise(0.1) / F.greatest(F.lit(1), F.size(f"p{n}")))
    penalty = F.when(F.size("pw") >= F.size("gw"), 1.0).otherwise(F.exp(1 - F.try_divide(F.size("gw"), F.size("pw"))))
    value = F.when(F.col("h1") == 0, 0.0).otherwise(F.exp(logs / 4) * penalty)
    return rows.groupBy("id").agg(F.round(F.max(value), 4).alias("bleu4"))


def by_mode(results: DataFrame) -> DataFrame:
    """(mode, n, em, accuracy): averages times 100 for each mode, letter case aside."""
    rows = results.select("id", F.coalesce(F.lower("mode"), F.lit("")).alias("mode"), normal_answer(F.col("output")).alias("p"), golds(F.col("answer")).alias("g")).distinct()
    scored = rows.select("id", "mode", F.exists("g", lambda g: g == F.col("p")).cast("int").alias("em"), F.exists("g", lambda g: (g != "") & F.contains(F.col("p"), g)).cast("int").alias("acc"))
    one = scored.groupBy("id", "mode").agg(F.max("em").alias("em"), F.max("acc").alias("acc"))
    return one.groupBy("mode").agg(F.count("*").alias("n"), F.round(100 * F.avg("em"), 6).alias("em"), F.round(100 * F.avg("acc"), 6).alias("accuracy"))


#: How the answers of a dataset are scored.
DATASET_MODES = {"hotpotqa": "short-form", "multihop-rag": "short-form", "popqa": "multi-short-form", "alce": "long-asqa", "quality": "close-set"}


def mode_of_dataset(name: str) -> str:
    """How a dataset's answers are scored, letter case aside; unknown ones are short-form."""
    return "long-narrative" if "narrative" in name.lower() else DATASET_MODES.get(name.lower(), "short-form")
