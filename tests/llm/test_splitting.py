import random

from graphloom.llm import splitting as sp


def slow(text, limit, overlap):
    """The stated rule, token by token."""
    import re

    spans = [m.span() for m in re.finditer(r"[^ \t\r\n]+", text)]
    n = len(spans)
    if n <= limit:
        return []
    para = lambda e: e < n and text[spans[e - 1][1] : spans[e][0]].count("\n") >= 2
    sent = lambda e: re.search(r"[.!?…][)\]\"'”’»]*$", text[slice(*spans[e - 1])])
    out, s = [], 0
    while s < n:
        top = s + limit - min(overlap, s)
        e = n if n <= top else next((x for x in range(top, s, -1) if para(x)), None) or next((x for x in range(top, s, -1) if sent(x)), top)
        out.append((s, e))
        s = e
    return out


def test_greedy_equals_the_rule():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b.", "c!)", "d…”", "e"]) + rng.choice([" "] * 8 + ["\n\n", "\r\n\r\n", "\n", "\t", " \n \n"]) for _ in range(rng.randrange(0, 120)))
        assert sp.cut_greedy(text, 20, 5) == slow(text, 20, 5)


def test_pieces_cover_and_keep_the_limit():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcde") for _ in range(4)) + ("." if rng.random() < 0.1 else "") for _ in range(1500))
    for cut in (sp.cut_greedy, sp.cut_by_content):
        pieces = cut(text, 300, 40)
        assert pieces[0][0] == 0 and pieces[-1][1] == 1500 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert all(e - s + min(40, s) <= 300 for s, e in pieces)


def test_edits_stay_local():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) + ("." if rng.random() < 0.1 else "") for _ in range(3000)]
    old = {" ".join(words[s:e]) for s, e in sp.cut_by_content(" ".join(words), 300, 0)}
    words[1500] = "changed"
    new = {" ".join(words[s:e]) for s, e in sp.cut_by_content(" ".join(words), 300, 0)}
    assert len(new - old) <= 3


def test_edge_rows(frame):
    long = "w " * 301
    rows = [("a", None), ("b", ""), ("c", " \n "), ("d", "w " * 300), ("e", long), ("e", long), (None, long)]
    got = sp.split_oversized(frame([(*r, 1) for r in rows], "chunk_id string, content string, piece_index int")).collect()
    assert sorted((r.chunk_id or "", r.piece_index, r.start_token, r.end_token) for r in got) == [("", 0, 0, 300), ("", 1, 300, 301), ("e", 0, 0, 300), ("e", 1, 300, 301)]
    assert sp.split_oversized(frame([], "chunk_id string, content string")).count() == 0
