import random

from graphloom.llm import reading

LEVELS = {1: "cat dog run see big red", 2: "river garden basket carried found", 3: "council measured district prepared although", 4: "legislation approximated whereas stewardship", 5: "institutionalised notwithstanding heterogeneous eutrophication"}


def document(rng, level):
    pool = [w for k, words in LEVELS.items() for w in words.split() for _ in range(8 if k == level else 3 if abs(k - level) == 1 else 0)]
    size = 4 + 3 * level
    return " ".join("The " + " ".join(rng.choice(pool) for _ in range(size)) + "." for _ in range(80 // size + 4))


def test_levels_of_unrated_documents(frame):
    rng = random.Random(2)
    true = {i: 1 + i % 5 for i in range(200)}
    docs = [(i, document(rng, level)) for i, level in true.items()]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "Too short."), (904, "| a | 1 |\n" * 60), (905, "2024-01-01T10:00 level=info step=x n=1\n" * 60), (906, "x = load(y, 3)\n" * 60), (907, "term " * 200)]
    ratings = [(i, r, level) for i, level in true.items() if i < 60 for r in ("a", "a", "b")] + [(0, "c", None), (None, "a", 3), (61, "a", 9)]
    got = {r.doc_id: r.level for r in reading.reading_levels(frame([(*d, "x") for d in docs], "doc_id long, text string, level string"), frame(ratings, "doc_id long, rater string, level int")).collect()}
    assert set(got) == set(true)
    assert sum(got[i] == level for i, level in true.items() if i >= 60) / 140 >= 0.9


def test_empty_tables(frame):
    docs, ratings = frame([(1, document(random.Random(1), 3))], "doc_id long, text string"), frame([], "doc_id long, rater string, level int")
    assert reading.reading_levels(docs.limit(0), ratings).count() == 0
    assert reading.reading_levels(docs, ratings).count() == 1


def test_language_is_voted_by_the_whole_text():
    opening = "Der Rat hat in der Stadt und auf dem Land nicht mit der Arbeit begonnen. " * 40
    body = "The council of the town and the people in the country did not begin with the work. " * 200
    assert reading.encode(opening)[0] != reading.encode(body)[0]
    assert reading.encode(opening + body)[0] == reading.encode(body)[0]
