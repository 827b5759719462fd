import random

from graphloom.llm import leaks

WORDS = [a + b for a in "bar lon mir tes vok dun pel gri sar nol".split() for b in "den tor mik sal urn ept ova isk".split()]


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_planted_leaks(frame, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_A_PASS", 50)
    rng = random.Random(9)
    head = "Read the passage below carefully and answer the question that follows it in one short sentence. "
    items = [(i, (head if i % 2 else "") + " ".join(sentence(rng) for _ in range(10))) for i in range(20)]
    noise = [(100 + i, " ".join(sentence(rng) for _ in range(30))) for i in range(80)]
    part = lambda text, a, b: " ".join(text.split()[a:b])
    own = {i: t.removeprefix(head) for i, t in items}
    misspelt = own[3].split()
    for k in range(4, len(misspelt), 11):
        misspelt[k] = misspelt[k][:2] + misspelt[k][3:]
    mixed = [s + "." for s in own[4].split(".") if s]
    rng.shuffle(mixed)
    docs = noise + [
        (1, sentence(rng) + " " + own[0] + " " + sentence(rng)),
        (2, sentence(rng) + " " + part(own[2], 20, 65).upper().replace(" ", "\n") + " <b>x</b>"),
        (3, " ".join(misspelt)),
        (4, " ".join(mixed)),
        (5, head + sentence(rng)),  # a shared instruction is no leak
        (6, part(own[5], 0, 5) + " " + sentence(rng)),  # nor are a few words
        (7, None),
        (8, ""),
        (9, own[0]),
    ]
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(frame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), frame([(*i, "x") for i in items + items[:2] + [(50, None), (51, "")]], "item_id long, item_text string, doc_id string")).collect()}
    assert got == {(1, 0), (2, 2), (3, 3), (4, 4), (9, 0)}


def test_repeated_and_foreign_items(frame):
    rng = random.Random(5)
    text = " ".join(sentence(rng) for _ in range(8))
    cyrillic = "".join(chr(0x430 + ord(c) % 32) if c.isalpha() else c for c in " ".join(sentence(rng) for _ in range(8)))
    items = [(1, text), (2, text), (3, text + " Which of these words is the longest of them all?"), (4, cyrillic), (5, "東京の古い橋は冬の前に石工たちが直したと町の記録に書かれている。" * 2)]
    docs = [(10, f"{sentence(rng)} {text}"), (11, cyrillic.upper()), (12, sentence(rng)), (13, items[4][1])]
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(frame(docs, "doc_id long, text string"), frame(items, "item_id long, item_text string")).collect()}
    assert got == {(10, 1), (10, 2), (10, 3), (11, 4), (13, 5)}


def test_short_runs_count_unless_they_are_stock(frame):
    rng = random.Random(6)
    item = [sentence(rng, 8) for _ in range(8)]
    apart = " ".join(s + " " + sentence(rng, 30) for s in item[:3])
    stock = [(100 + i, f"{sentence(rng, 20)} {item[4]} {sentence(rng, 20)} {item[5]}") for i in range(30)]
    docs = [(1, apart), (2, f"{item[4]} {sentence(rng, 30)} {item[5]} {sentence(rng, 30)} {item[0]}"), *stock]
    got = {r.doc_id for r in leaks.leaked_items(frame(docs, "doc_id long, text string"), frame([(1, " ".join(item))], "item_id long, item_text string")).collect()}
    assert got == {1}


def test_empty_sides(frame):
    docs, items = frame([(1, "a b")], "doc_id long, text string"), frame([(1, "a b")], "item_id long, item_text string")
    assert leaks.leaked_items(docs.limit(0), items).count() == 0
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_folding():
    assert leaks.squeezed("É&amp;a <i>Ñ</i>-1") == b"ean1"
    assert leaks.squeezed("dÃ©jÃ ") == leaks.squeezed("déjà ")
    assert leaks.alike("stone", "stnoe") and leaks.alike("stone", "stne") and not leaks.alike("stone", "staff")
