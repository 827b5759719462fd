import math
import random
import re
from collections import Counter

import pytest

from graphloom.operators import tfidf


def brute(corpus, questions, k, chosen=None):
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    bag = lambda rows: {i: sum((Counter(words(t)) for j, t in rows if j == i), Counter()) for i, _ in rows}
    docs, asks = bag(corpus), bag(questions)
    df = Counter(w for d in docs.values() for w in d)
    weigh = lambda d: {w: c * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in d.items() if w in df}
    length = lambda d: math.sqrt(sum(x * x for x in d.values()))
    docs = {i: (d := weigh(b), length(d)) for i, b in docs.items()}
    out = set()
    for q, a in asks.items():
        a = weigh(a)
        hits = [(-round(sum(a[w] * d[w] for w in a if w in d) / n / length(a), 6), i) for i, (d, n) in docs.items() if (chosen is None or i in chosen) and a.keys() & d.keys()]
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(hits)[:k])}
    return out


def texts(seed, n, longest, words):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.4)) % words}" for _ in range(rng.randrange(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("common", [256, 5])
def test_tfidf_equals_all_pairs(frame, monkeypatch, common):
    for name, value in (("COMMON", common), ("BLOCK", 64), ("BATCH", 7), ("PAIRS", 50)):
        monkeypatch.setattr(tfidf, name, value)
    corpus = [(f"d{i}", t) for i, t in enumerate(texts(1, 300, 30, 400))] + [("d1", "w2 w3 more"), ("d7x", None), ("d7y", "w3 w3"), ("d7z", "w3 w3")]
    questions = [(i, t) for i, t in enumerate(texts(2, 120, 9, 500))] + [(500, "nowhere"), (501, None), (3, "w2 again"), (502, "w3")]
    got = lambda chosen=None: [tuple(r) for r in tfidf.tfidf_topk(frame(corpus, "id string, text string"), frame(questions, "id long, text string"), 3, chosen).collect()]
    rows = got()
    assert len(rows) == len(set(rows)) and set(rows) == brute(corpus, questions, 3)
    some = {f"d{i}" for i in range(0, 300, 9)}
    assert set(got(frame([(i,) for i in sorted(some)], "id string"))) == brute(corpus, questions, 3, some)
    assert tfidf.tfidf_topk(frame(corpus, "id string, text string"), frame([], "id long, text string"), 3).count() == 0


def test_search_shuffles_no_pairs(frame):
    corpus = frame([(f"d{i}", f"the of and w{i}") for i in range(50)], "id string, text string")
    found = tfidf.tfidf_topk(corpus, frame([(i, f"the of w{i}") for i in range(50)], "id long, text string"), 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["query"], r["id"]) for r in found.filter("rank = 1").collect()} == {(i, f"d{i}") for i in range(50)}


def test_rounding_as_spark(frame):
    import numpy as np
    from pyspark.sql import functions as F

    x = [0.1234565, 0.0000005, 0.9999995, 0.25, 0.1234575, 0.3000005, 1 / 3, 0.7654325, -0.1234565, 1234567.0000005, 1e300, 123456789012.3456785]
    assert tfidf.round_half_up(np.array(x), 6).tolist() == [r[0] for r in frame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]


def test_query_answers_every_question(spark, frame, tmp_path):
    from graphloom.plans import catalogue

    frame([("c1", "oak and elm"), ("c2", "ash and elm")], "chunk_id string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    frame([(i, t) for i, t in ((1, "which oak"), (50, "which ash"), (77, "an ash"), (None, "oak"), (99, "none"))], "id long, question string").write.parquet(f"{tmp_path}/results.parquet")
    got = catalogue.queries()["tfidf_topk"](spark, str(tmp_path)).collect()
    assert {(r["query"], r["id"]) for r in got} == {(1, "c1"), (50, "c2"), (77, "c2")}
