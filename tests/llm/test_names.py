from graphloom.llm import names

SCHEMA = "node_id string, node_type string, entity_name string, entity_type string, description string, rid string"

ROWS = [
    ("a1", "Alexander Surelsanvel", "person", "pilot in Llat"),
    ("a2", "Surelsanvel, Alex", "PERSON", "pilot in Llat; see register"),
    ("a3", "A. Surelsanvel", None, "pilot in Llat"),
    ("a4", "Surelsanvel Alexander", "per", ""),
    ("a5", "Alexander Surelsnavel", "", None),
    ("b1", "Amaia Surelsanvel", "person", "weaver in Snog"),
    ("b2", "Dr. AMAIA  SURELSANVEL", "person", "weaver in Snog (mentioned twice)"),
    ("c1", "A Surelsanvel", "person", None),  # could be either
    ("o1", "Druquelhejel Civic Association", "organisation", "civic body founded in 1961"),
    ("o2", "Association of Civic (Druquelhejel)", "organisation", "civic body founded in 1961"),
    ("o3", "Druquelhejel Civ. Assn", None, None),
    ("o4", "Druquelhejel Postal Company", "organisation", "postal body founded in 1700"),
    ("p1", "Lake Druquelhejel", "place", "a place known for its shed"),
    ("p2", "Lake Druquelhejel", "place", "a place known for its shed"),
    ("q1", "Anthony “Tony” Vatornone", "person", None),
    ("q2", "Tony Vatornone", "person", None),
]


def filler():
    """Rows that teach kinds, given names, nicknames and stock words; no two of them are the same one."""
    syllables = [a + b for a in "bar lon mir tes vok dun pel gri".split() for b in "den tor mik sal urn ept".split()]
    asides = ["", "; see register", " (mentioned twice)"]
    rows = []
    for i in range(240):
        own = f"{syllables[i % 48]}{syllables[(i * 7 + i // 48) % 48]}{'aeiou'[i // 48]}".capitalize()
        given = ["Alexander", "Amaia", "Anthony", "Oswald", "Yvonne"][i % 5]
        said = f"{['pilot', 'weaver', 'clerk'][i % 3]} in Town{i}{asides[i % 3]}"
        nick = {"Alexander": " “Alex”", "Anthony": " “Tony”"}.get(given, "") if i % 2 else ""
        rows.append((f"f{i}", f"{given}{nick} {own}", "person", said))
        field, kind = ["Civic", "Postal", "Marine"][i % 3], ["Association", "Company", "Society"][i % 3]
        rows.append((f"g{i}", f"Dro{own.lower()} {field} {kind}", "organisation", f"{field.lower()} body founded in {1000 + i}{asides[i % 3]}"))
        rows.append((f"h{i}", f"Lake Kho{own.lower()}", "place", "a place known for its shed"))
    return rows


def links(frame, rows):
    table = frame([(n, "entity", t, k, d, "x") for n, t, k, d in rows], SCHEMA)
    return {(r.node_a, r.node_b) for r in names.same_names(table).collect()}


def pairs(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_variants(frame):
    expected = pairs(["a1", "a2", "a3", "a4", "a5"], ["b1", "b2"], ["o1", "o2", "o3"], ["q1", "q2"])
    assert links(frame, filler() + ROWS + ROWS[:3]) == expected


def test_nothing_to_link(frame):
    assert links(frame, []) == set()
    assert links(frame, [("x", None, "person", None), ("y", " ", None, None), ("z", "Solo", "person", "")]) == set()


def test_lcs_against_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert names.lcs_length(a, b) == table[-1][-1]


def test_common_suffix_is_refined_not_dropped(frame, monkeypatch):
    monkeypatch.setattr(names, "COMMON", 3)
    rows = [(f"n{i:02d}", f"Alexander Kor{'abcdefgh'[i]}lovan", "person", f"pilot in X{i}") for i in range(8)]
    rows += [("m1", "Alex Kordlovan", "person", "pilot in X3"), ("m2", "A. Kordlovan", "person", "pilot in X3"), ("m3", "Kordlovan, Alexnader", "person", "pilot in X3")]
    found = links(frame, filler() + rows)
    assert pairs(["m1", "m2", "m3", "n03"]) <= found
    assert not any("n02" in p or "n04" in p for p in found)


def test_one_family_name_in_a_third_of_the_rows(frame):
    rows = [(f"x{i:03d}", f"{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 26]}{'aeiou'[i // 26 % 5]}{'lrnst'[i // 130 % 5]}o{'bdgkm'[i % 5]}e Surelsanvel", "person", f"pilot in Y{i}") for i in range(360)]
    rows += [("y1", rows[7][1], "person", None), ("y2", "Surelsanvel, " + rows[40][1].split()[0], "per", "pilot in Y40 (mentioned twice)")]
    found = links(frame, filler() + rows)
    assert {("x007", "y1"), ("x040", "y2")} <= found


def test_classes_are_shared_by_names_that_match():
    nicknames = {"tony": {"anthony"}, "alex": {"alexander"}}
    given = "anthony tony anthnoy nathony a t alexander alex lexander elxander alexandre amaia oswald".split()
    for a in given:
        for b in given:
            if names._same_given(a, b, nicknames):
                assert names._classes(a, nicknames) & names._classes(b, nicknames), (a, b)


def test_large_keys_are_tiled(frame, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 2)
    assert links(frame, filler() + ROWS) == pairs(["a1", "a2", "a3", "a4", "a5"], ["b1", "b2"], ["o1", "o2", "o3"], ["q1", "q2"])
