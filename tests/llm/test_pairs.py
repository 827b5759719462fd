from graphloom.llm import pairs

import random

NOUNS = [a + b for a in "riv bask sto ham lan cand gar far tre sig".split() for b in "er et ol mer tern le den mer am nal".split()]
VERBS = "took made found held carried moved brought helped kept followed".split()
FR_NOUNS = [a + b for a in "pont mais tabl chi cham rou port lamp vill quai".split() for b in "eau on ette en ier elle".split()]
FR_VERBS = "prend garde ouvre porte voit trouve suit aime".split()


def rows(n=300):
    rng, out = random.Random(8), []
    for i in range(n):
        w, v, x, y = (lambda: rng.choice(NOUNS)), (lambda: rng.choice(VERBS)), (lambda: rng.choice(FR_NOUNS)), (lambda: rng.choice(FR_VERBS))
        if i % 3:
            text = " ".join(f"The {w()} {v()} the {w()} near that {w()} and each {w()} {v()} this {w()}." for _ in range(rng.randrange(2, 5)))
            out.append((i, f"Why did the {w()} follow that {w()} before the {w()} was lost?", text, f"the {w()}"))
        else:
            text = " ".join(f"Le {x()} {y()} la {x()} dans le {x()} et les {x()} sous la {x()}." for _ in range(rng.randrange(2, 5)))
            out.append((i, f"Pourquoi le {x()} {y()} la {x()} sous la pluie avec les {x()} ?", text, f"le {x()}"))
    return out


CASES = [
    (1000, "", "empty"),
    (1001, None, "empty"),
    (1002, "​ ", "empty"),
    (1003, "N/A", "empty"),
    (1004, "The stoler took the lander near that gamer. The farden held the signal near that", "truncated"),
    (1005, "I'm sorry, but I cannot answer this question.", "refusal"),
    (1006, "Why did the river follow that basket before the candle was lost?", "copy"),
    (1007, '"Why did the river follow that basket before the candle was lost?"', "copy"),
    (1008, "Le ponteau prend la maisette dans le champier. Le chien garde la tablette dans le quaien et la roueelle porte la lampon.", "wrong_language"),
    (1009, "the signal", None),
    (1010, "(B)", None),
    (1011, "The stoler took the lander near that gamer. The farden held the signal near that road.", None),
    (1012, "Why did the river follow that basket before the candle was lost? The stoler held the lander near that gamer. The farden moved the signal near that treet.", None),
]


def test_defects(frame):
    question = "Why did the river follow that basket before the candle was lost?"
    table = rows() + [(i, question, text, "the signal") for i, text, _ in CASES] + [(1011, question, CASES[11][1], "the signal")]
    got = {(r.id, r.field): r.defect for r in pairs.defective_pairs(frame([(*r, "x") for r in table], "id long, question string, output string, answer string, field string")).collect()}
    wrong = {i: (got.get((i, "output")), want) for i, _, want in CASES if got.get((i, "output")) != want}
    assert not wrong
    assert sum(1 for i, *_ in rows() if (i, "output") in got) <= 5


def test_nulls_and_empty_table(frame):
    schema = "id long, question string, output string, answer string"
    assert pairs.defective_pairs(frame([], schema)).count() == 0
    got = {(r.id, r.field): r.defect for r in pairs.defective_pairs(frame([(1, None, None, "x|y"), (None, "q", "", None)], schema)).collect()}
    assert got[1, "output"] == "empty" and got[None, "output"] == "empty" and got[None, "answer"] == "empty"


def test_held_out_accuracy():
    model = pairs.PairClassifier([(q, t) for _, q, o, a in rows(400) for t in (o, a)])
    assert model.held_out > 0.9
    assert model.answer_defect("q", "null|") == "empty" and model.answer_defect("q", "null|the signal") is None


def test_every_row_is_counted(frame):
    # each row has a word of its own in prompt and output; none looks sound, so that the fit itself is small
    table = [(i, f"Why did wa{i}x run?", f"Why did wa{i}x run", "") for i in range(6_500)]
    model = pairs.fit_classifier(frame(table, "id long, question string, output string, answer string"))
    assert all(f"wa{i}x" in model.known for i in range(6_500))


def test_fit_of_spread_blocks(spark):
    table = sorted({(q, t) for _, q, o, a in rows(120) for t in (o, a)})
    blocks = [(-1, []), *((n, [(q, None) for q in sorted({q for q, _ in table[n::3]})] + table[n::3]) for n in range(3))]
    here, spread = pairs.PairClassifier(pairs.Blocks(blocks)), pairs.PairClassifier(pairs.SpreadBlocks(spark.sparkContext.parallelize(blocks, 2)))
    assert here.table == spread.table and here.known == spread.known
    assert abs(here.weights - spread.weights).max() < 0.01 and abs(here.thresholds - spread.thresholds).max() < 0.01


def test_runs_of_all_blocks_are_counted():
    rng = random.Random(3)
    table = [(f"q{i}?", " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) + ".") for i in range(400)]
    blocks = pairs.Blocks((n, table[n::4]) for n in range(4))
    for least in (2, 4, 9):
        seen = {}
        for q, a in table:
            said = pairs.words_of(a)
            for i in range(len(said) - 4):
                seen.setdefault(tuple(said[i : i + 5]), set()).add((q, a))
        want = {run for run, found in seen.items() if len(found) >= least}
        cells = blocks.keyed(pairs._cell_counts, lambda a, b: a + b, lambda item: pairs._reached(least, item))
        cells = pairs.np.concatenate([cells[i] for i in range(pairs.CELL_PARTS)])
        got = set(blocks.routed(pairs._run_pairs, lambda parts: pairs._frequent(least, parts), cells).tolist())
        assert want and got == {int(pairs._runs([list(run)])[0][0]) for run in want}
