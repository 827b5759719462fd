import pytest

from graphloom.operators import build, embed, evaluate, providers
from graphloom.registry import Registry


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert providers.with_retry(flaky, 3, sleep=waits.append)([("user", "x")]) == "ok" and len(waits) == 2

    def broken(messages):
        raise OSError("down")

    with pytest.raises(OSError):
        providers.with_retry(broken, 2, sleep=waits.append)([])


def test_turns_prompts_and_timer():
    seen = []

    def ask(messages):
        seen.append(len(messages))
        return messages[-1][1].upper()

    assert providers.in_turns(ask, ["a", "b"], "s") == ["A", "B"] and seen == [2, 4]
    assert providers.whole(lambda m: iter(["x", "y"]))([]) == "xy"
    prompt = providers.Prompt("{who} asks {what}, {{}}")
    assert prompt.names == {"who", "what"} and prompt.fill(who="I").fill(what="why") == "I asks why, {{}}"
    ticks = iter([0.0, 2.0, 5.0, 6.0])
    timer = providers.StageTimer(lambda: next(ticks))
    for _ in range(2):
        with timer.stage("read"):
            pass
    assert timer.mean("read") == 1.5 and timer.mean("none") == 0.0


def test_failed_rows_are_kept_and_follow_ups_are_appended(frame):
    def ask(messages):
        if "bad" in messages[0][1]:
            raise ValueError("no")
        if messages[-1][1].startswith("Is there more"):
            return "Yes." if len(messages) < 5 else "no"
        return f"r{len(messages)}"

    rows = frame([(1, "good"), (2, "bad"), (3, None)], "id long, prompt string")
    got = {r.id: (r.reply, r.error) for r in providers.ask_rows(rows, ask, "id", "prompt", gleanings=3).collect()}
    assert got[1] == ("r1\nr3", None) and got[2] == (None, "ValueError: no") and got[3][0] == "r1\nr3"
    assert providers.ask_rows(rows.limit(0), ask, "id", "prompt").count() == 0


def test_literals_need_both_ends(frame):
    text = "Node(id='a', type='x') Node(id='b', type='y') Relationship(subj=Node(id='a', type='x'), obj=Node(id='b', type='y'), type='r') Relationship(subj=Node(id='a', type='x'), obj=Node(id='c', type='y'), type='s')"
    nodes, links = build.parse_literals(frame([("1", text), ("2", None), ("3", "nothing")], "chunk_id string, reply string"))
    assert {(r.node, r.type) for r in nodes.collect()} == {("a", "x"), ("b", "y")}
    assert [tuple(r) for r in links.collect()] == [("1", "a", "b", "r")]


def test_embeddings_and_blank_texts(frame):
    rows = frame([("a", "Red bridge"), ("b", "the red bridge"), ("c", None), ("d", "  "), ("e", "?!"), ("f", "Мост и река")], "id string, text string")
    got = {r.id: r.embedding for r in embed.embed_texts(rows).collect()}
    assert set(got) == {"a", "b", "f"} and len(got["a"]) == embed.WIDTH
    assert abs(sum(v * v for v in got["a"]) - 1) < 1e-9
    short = embed.embed_texts(rows, width=8).collect()
    assert all(len(r.embedding) == 8 for r in short)


def test_bleu_by_hand(frame):
    rows = frame([(1, "red old bridge over river", "red old bridge over river"), (2, "red bridge", "blue mill"), (3, "", "x"), (4, None, None)], "id long, output string, answer string")
    got = {r.id: r.bleu4 for r in evaluate.bleu4(rows).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0 and got[4] == 0.0
    hit = {r.id: r.accuracy for r in evaluate.multi_answer(frame([(1, "x|mill", "mill|y"), (2, "no", "mill")], "id long, output string, answer string")).collect()}
    assert hit == {1: 1, 2: 0}
    assert evaluate.mode_of_dataset("NarrativeX") == "long-narrative" and evaluate.mode_of_dataset("Quality") == "close-set" and evaluate.mode_of_dataset("?") == "short-form"


def test_registry():
    kind = Registry("thing")
    kind.add("a")(len)
    assert kind.find("a") is len
    with pytest.raises(ValueError):
        kind.add("a")(max)
    with pytest.raises(KeyError, match="no thing 'b'"):
        kind.find("b")


def test_presets_name_what_is_registered():
    from graphloom.plans import presets

    for preset in presets.PRESETS.values():
        assert presets.BUILDERS.find(preset.builder) and presets.STRATEGIES.find(preset.strategy)
