"""Defective prompt and response pairs, by a multi-label linear classifier.

Hashed word n-grams and features of the pair feed one logistic regression for each defect.
The training set is made here: all responses of the table that look sound are emptied, cut,
replaced by refusals, by copies of the prompt and by responses in another language; the sound
ones, and sound ones that repeat the prompt or words of a refusal and go on, are the negatives.
A first fit sorts out the rows that only looked sound, a second is fitted on the rest.
Thresholds are calibrated on held-out made-up rows.  The language of a word is learned from
the prompts, whose question words tell their language.

Every distinct pair of prompt and text is counted and fitted on.  The pairs lie in blocks by
their hash, and what is made of a block depends on nothing but its pairs and what was counted.
A step of a fit sums the gradients of all blocks; thresholds come from counts of all held-out
scores, told apart by 1 / ``CELLS``.

Defined results: a null or blank field is ``empty``; without a prompt only ``empty``,
``truncated`` and ``refusal`` are possible; repeated rows count once; a field gets the defect
with the greatest margin over its threshold, at most one.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial, reduce
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
LANGUAGES = ("en", "fr", "de", "es")
#: Rows of the table whose pairs make one block of the fit; a table of one block is fitted by the driver.
BLOCK_ROWS = 1_000
#: Blocks whose made-up rows lie in one matrix.
BUNDLE = 16
WIDTH = 1 << 15
#: Scores closer than 1 / CELLS count as one when a threshold is chosen.
CELLS = 512
#: Made-up training rows aimed at where few responses look sound.
LEAST_MADE = 6_000

#: How prompts begin in each language, and how they name a language to answer in.
ASKS = {
    "en": "who what why where when how which does did is are can could should would please whose name list describe explain",
    "fr": "qui que quoi pourquoi où quand comment quel quelle quels quelles réponds répondez est décris explique",
    "de": "wer was warum wo wann wie welche welcher welches weshalb wohin bitte beschreibe erkläre nenne",
    "es": "quién qué dónde cuándo cómo cuál por responde quiénes cuáles responda describe explica",
}
NAMED = {
    "en": "english anglais englisch inglés",
    "fr": "french français französisch francés",
    "de": "german allemand deutsch alemán",
    "es": "spanish espagnol spanisch español",
}
COMMANDS = re.compile(r"\b(?:reply|answer|respond|réponds|répondez|antworte|antworten|responde|responda|contesta)\w*\s+(?:\w+\s+){0,3}?(?:in|en|auf)\s+(\w+)")
#: Words of each language that settle the language of a short text.
COMMON = {
    "en": "the a an this that each one of in by with at on and or but it is was were for from to not no near during after before under against yes",
    "fr": "le la les un une des du de et ou mais il elle est dans sur avec sous par pour au aux pas ne près du non oui qui que ce cette",
    "de": "der die das ein eine einen dem den des und oder aber es ist im am auf mit unter durch für von zu zur zum nicht kein nein ja bei aus",
    "es": "el la los las un una unos del de al y o pero es en con por para sobre bajo no sí junto que su desde hacia",
}
#: What made-up refusals are put together from: an opening, what the speaker does not do, what is not done, an ending.
REFUSALS = {
    "en": (["", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "As an AI, ", "Regrettably, "],
           ["I cannot", "I can't", "I am unable to", "I'm not able to", "I must decline to", "I have to refuse to", "I won't", "it is not possible for me to", "the context does not allow me to", "I do not have enough information to"],
           ["answer", "answer that", "answer this question", "help with that", "help with this request", "respond to that", "comment on this", "give that information", "say"],
           ["", " Please ask someone else.", " Can I help with anything else?", " Please try another question."]),
    "fr": (["", "Je suis désolé, mais ", "Désolé, ", "Malheureusement, ", "En tant qu'assistant, "],
           ["je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "je dois refuser de", "le contexte ne me permet pas de", "je n'ai pas assez d'informations pour", "je ne souhaite pas"],
           ["répondre", "répondre à cette question", "vous aider", "donner cette information", "vous le dire", "commenter cela"],
           ["", " Demandez à quelqu'un d'autre.", " Puis-je vous aider pour autre chose ?"]),
    "de": (["", "Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", "Als Assistent "],
           ["ich kann", "ich darf", "ich möchte", "mir ist es nicht möglich,", "ich bin nicht in der Lage,", "ich muss es ablehnen,", "mir fehlen die Angaben, um"],
           ["nicht antworten", "diese Frage nicht beantworten", "dabei nicht helfen", "keine Auskunft geben", "dazu nichts sagen", "zu antworten", "diese Frage zu beantworten", "dabei zu helfen"],
           ["", " Bitte fragen Sie jemand anderen.", " Kann ich sonst noch helfen?"]),
    "es": (["", "Lo siento, pero ", "Lo lamento, ", "Lamentablemente, ", "Como asistente, "],
           ["no puedo", "no me es posible", "no soy capaz de", "debo negarme a", "el contexto no me permite", "no tengo suficientes datos para", "prefiero no"],
           ["responder", "responder a esta pregunta", "ayudar con eso", "dar esa información", "contestar", "decirlo", "comentar eso"],
           ["", " Pregunte a otra persona.", " ¿Puedo ayudar en algo más?"]),
}
#: What may stand for no answer at all.
PLACEHOLDERS = ["", " ", "\t", "\n", "​", " ", "﻿", "...", "…", "-", "—", "--", "n/a", "N/A", "null", "None", "nan", "NaN", "[]", "{}", '""', "''", "()", '{"answer": ""}', '{"answer": null}', "<answer></answer>",
                "```\n```", "<p></p>", "[empty]", "(none)", "TBD", "TODO", "undefined", "<br>", "[answer]", "answer:", "Answer:", "Output:", "Antwort:", "Respuesta:", "Réponse :", "?", "."]
FRAMES = ["{}", '"{}"', "{0}\n{0}", "The question was: {}", "You asked: {}", "Question: {}", "La question était : {}", "Vous demandez : {}", "Die Frage war: {}", "Sie fragen: {}", "La pregunta era: {}", "Usted pregunta: {}",
          "Regarding the question: {}", "«{}»", "Q: {}", "**{}**"]
#: Sound pairs that the training set always has.
SOUND = [
    ("Who repaired the old bridge before winter?", "The masons of the lower town repaired it. They worked for nine weeks and were paid in grain."),
    ("Where did the ferry stop in the evening?", "near the mill"),
    ("Qui a réparé le vieux pont avant l'hiver ?", "Les maçons de la ville basse l'ont réparé. Ils ont travaillé neuf semaines et furent payés en grain."),
    ("Où le bac s'arrête-t-il le soir ?", "près du moulin"),
    ("Wer hat die alte Brücke vor dem Winter repariert?", "Die Maurer der Unterstadt haben sie repariert. Sie arbeiteten neun Wochen und wurden mit Korn bezahlt."),
    ("Wo hält die Fähre am Abend?", "bei der Mühle"),
    ("¿Quién reparó el viejo puente antes del invierno?", "Los albañiles de la ciudad baja lo repararon. Trabajaron nueve semanas y cobraron en grano."),
    ("¿Dónde para la barca por la tarde?", "junto al molino"),
]
EMPTY_SHELL = re.compile(r"<[^<>]*>|```\w*|[\"'{}\[\]()<>:,;.…?!*_#`|/\\=—–-]+|\s+")
EMPTY_WORDS = set("n a null none nan nil answer output response empty tbd todo undefined antwort respuesta réponse respuesta vide leer vacío na".split())
BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)])(?:\s|$)")
BARE = re.compile(r"(?:^|\n)\s*(?:[-*•–]|\d{1,2}[.)])\s*$")
WORD = re.compile(r"\w+(?:['’]\w+)*")
CLOSERS = " \t\r\n\"'”’»)]}*_`"
STARTS = {word: language for language, words in ASKS.items() for word in words.split()}
_NAMES = {word for words in NAMED.values() for word in words.split()}
LANGUAGE_OF = {word: language for language, words in NAMED.items() for word in words.split()}


#: Format and control characters apart from tab and line feed.
_HIDDEN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\n\t") + "]")


def visible(text: str | None) -> str:
    """The text without invisible marks, trimmed."""
    return _HIDDEN.sub("", text or "").replace("\u00a0", " ").strip()


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Many rows are made of one prompt, one after the other.
_prompt_words = lru_cache(1 << 10)(words_of)


def prompt_language(prompt: str, table: dict[str, tuple[float, ...]]) -> str | None:
    """The language an answer should have: the one asked for, else the prompt's."""
    if hit := COMMANDS.search(prompt.lower()):
        if hit[1] in LANGUAGE_OF:
            return LANGUAGE_OF[hit[1]]
    score = text_languages(words_of(prompt), table)
    return LANGUAGES[int(np.argmax(score))] if max(score) > min(score) + 1 else None


def _asked_language(prompt: str, asked: list[str], table: dict[str, tuple[float, ...]]) -> str | None:
    """``prompt_language`` of a prompt whose words are known; only those that name a language need the pattern."""
    if _NAMES.intersection(asked):
        return prompt_language(prompt, table)
    score = text_languages(asked, table)
    return LANGUAGES[int(np.argmax(score))] if max(score) > min(score) + 1 else None


def text_languages(words: list[str], table: dict[str, tuple[float, ...]]) -> list[float]:
    """Log evidence for each language."""
    known = [row for w in words if (row := table.get(w))]
    return [sum(column) for column in zip(*known)] if known else [0.0] * len(LANGUAGES)


def first_language(prompt: str, found: list[str]) -> str | None:
    """The language that the first words of a prompt name, unless it asks for an answer in one."""
    if COMMANDS.search(prompt.lower()):
        return None
    return next((STARTS[w] for w in found[:2] if w in STARTS), None)


def language_table(counts: dict[str, tuple[int, ...]], totals: Iterable[int]) -> dict[str, tuple[float, ...]]:
    """word -> log share of each language, from counts in prompts whose first words name their language."""
    common = {language: set(words.split()) for language, words in COMMON.items()}
    totals = np.array([n + 20 * len(common[language]) for n, language in zip(totals, LANGUAGES)], float)
    words = [w for w in set(counts).union(*common.values()) if not w.isdigit()]
    own = np.array([[counts.get(w, (0,) * len(LANGUAGES))[i] + 20 * (w in common[language]) for i, language in enumerate(LANGUAGES)] for w in words], float)
    share = (own + 0.05) / totals * totals.mean()
    share = np.log(share / share.sum(axis=1, keepdims=True))
    share -= share.mean(axis=1, keepdims=True)
    return {w: tuple(row) for w, row, n in zip(words, share.tolist(), own.sum(axis=1)) if n >= 3}


def _common_words(a: list[str], b: list[str]) -> int:
    """Words of a that b repeats in order."""
    ids: dict[str, int] = {}
    for i, w in enumerate(a):
        ids[w] = ids.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if hit := row & ids.get(w, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def features(prompt: str | None, response: str | None, table: dict, known: set[str]) -> list[int]:
    """Hashed n-grams and pair features, as column numbers."""
    prompt, text = prompt or "", visible(response)
    asked, said = _prompt_words(prompt), words_of(text)
    # longer texts are no shells
    core = EMPTY_SHELL.sub(" ", text).lower().split() if len(said) <= 12 else said
    out: list[str] = ["1"]
    if not any(w not in EMPTY_WORDS for w in core) and not re.fullmatch(r"\W*[a-zA-Z]\W*", text):
        # nothing is said, so that there is nothing else to look at
        return [zlib.crc32(f.encode()) % WIDTH for f in ("1", "empty shell")]
    n = len(said)
    size = "0" if n == 0 else "1-3" if n < 4 else "4-7" if n < 8 else "8-30" if n <= 30 else "31+"
    out.append(f"size {size}")
    # the end of the text
    end = text.rstrip(CLOSERS)
    last = end[-1:] if end else ""
    lines = [x for x in text.split("\n") if x.strip()]
    bullets = sum(bool(BULLET.match(x)) for x in lines)
    listed = bullets >= 2 or bullets == 1 and len(lines) == 1
    kind = "stop" if last in ".!?…。" and last else "comma" if last in ",;:" and last else "dash" if last in "-–—" and last else "open" if last in "([{" and last else "digit" if last.isdigit() else "letter" if last.isalpha() else "other"
    stops = len(re.findall(r"[.!?…](?=\s|$)", text))
    unclosed = max(0, text.count("(") - text.count(")")) + max(0, text.count("[") - text.count("]")) + max(0, text.count("“") - text.count("”")) + max(0, text.count("«") - text.count("»"))
    tail = said[-1] if said else ""
    strange = bool(tail) and kind == "letter" and tail not in known and not text.rstrip(CLOSERS).split()[-1][:1].isupper()
    bare = bool(BARE.search(text)) and len(lines) > 1
    capital = text[:1].isupper() or text[:1] in "¿¡\"“«"
    out += [f"end {kind} list{listed} size {size}", f"unclosed {min(unclosed, 1)}", f"unclosed {min(unclosed, 1)} end {kind}", f"strange {strange} list{listed} size {size}", f"bare {bare}"]
    out += [f"stops {min(stops, 1)} end {kind} list{listed} capital {capital}"]
    if kind in ("letter", "digit"):
        out += [f"last {tail}", f"last {tail[:3]} short {len(tail) < 4}"]
    # the overlap with the prompt
    if asked and said:
        shared = _common_words(asked, said)
        inside = set(asked)
        extra = sum(w not in inside for w in said)
        cover, own = shared / len(asked), extra / n
        level = "0" if cover < 0.5 else "5" if cover < 0.75 else "75" if cover < 0.9 else "9"
        more = "0" if extra == 0 else "1-3" if extra < 4 else "4-6" if extra < 7 else "7+"
        out += [f"cover {level} extra {more}", f"cover {level} own {min(9, int(own * 10))}", f"cover {level}"]
        # the language
        want = _asked_language(prompt, asked, table)
        if want:
            fresh = [w for w in said if w not in inside] or said
            score = text_languages(fresh, table)
            i = LANGUAGES.index(want)
            margin = max(v for j, v in enumerate(score) if j != i) - score[i]
            step = "--" if margin < -8 else "-" if margin < -2 else "0" if margin < 2 else "+" if margin < 4 else "++" if margin < 8 else "+++"
            out += [f"foreign {step}", f"foreign {step} size {size}"]
    # n-grams, apart for short and for longer texts
    if n <= 30:
        out += [f"1 {w}" for w in set(said)] + [f"2 {a} {b}" for a, b in set(pairwise(said))]
    out += [f"first {n <= 30} {' '.join(said[:2])}"]
    return [zlib.crc32(f.encode()) % WIDTH for f in out]


#: Marks a training row that is a sound pair as it stands.
ITSELF = -2


def _made_up(rows: list[tuple[str, str]], table: dict, known: set[str], rng: np.random.Generator) -> list[tuple[str, str, int, int, int]]:
    """(prompt, response, defect number or -1, number of the sound pair, number of the other pair used) rows made from sound pairs.

    The other is -1 where there is none, and ``ITSELF`` marks the sound pair itself.
    """
    languages = [prompt_language(q, table) for q, _ in rows]
    by = {language: [i for i, found in enumerate(languages) if found == language] for language in LANGUAGES}
    pick = lambda items: items[int(rng.integers(len(items)))]
    out: list[tuple[str, str, int, int, int]] = []
    for i, (q, a) in enumerate(rows):
        language = languages[i] or "en"
        head, act, what, end = (pick(part) for part in REFUSALS[language])
        core = f"{act} {what}."
        refusal = head + (core if head else core[0].upper() + core[1:]) + end
        spaced = a.split(" ")
        out.append((q, a, -1, i, ITSELF))
        other = -1
        if len(spaced) >= 8:
            at = int(rng.integers(5, len(spaced)))
            cut = " ".join(spaced[:at])
            how = int(rng.integers(6))
            if how == 0 and len(spaced[at].strip()) > 4 if at < len(spaced) else False:
                cut += " " + spaced[at][: int(rng.integers(2, len(spaced[at]) - 1))]
            elif how == 1:
                cut += " (" + spaced[at] if at < len(spaced) else " ("
            elif how == 2:
                cut = cut.rstrip(".,;") + ","
            elif how == 3:
                other = int(rng.integers(len(rows)))
                cut = f"1. {cut.rstrip('.,')}.\n2. {rows[other][1].split(chr(10))[0]}\n3."
            if not re.search(r"[.!?…]\W*$", cut) or how == 3:
                out.append((q, cut, 1, i, other))
        if i % 2 == 0:
            out.append((q, refusal if rng.random() < 0.9 else refusal.upper(), 2, i, -1))
            # words of a refusal inside an answer: quoted by someone, or as the start of a text that goes on
            if len(spaced) > 12 and language == languages[i]:
                at, how = int(rng.integers(1, len(spaced))), int(rng.integers(3))
                said = [f'{" ".join(spaced[:at])} "{core.rstrip(".")}" {" ".join(spaced[at:])}', f"{head}{a[0].lower()}{a[1:]}", f'{" ".join(core.split(" ")[: int(rng.integers(2, 5))])} {a}'][how]
                out.append((q, said, -1, i, -1))
        if i % 2 == 1 and q:
            framed = pick(FRAMES).format(q)
            how = int(rng.integers(5))
            if how == 1:
                framed = framed.rstrip("?").lower()
            elif how == 2:
                framed = framed.upper()
            elif how == 3:
                parts = framed.split(" ")
                parts.pop(int(rng.integers(len(parts))))
                framed = " ".join(parts)
            out += [(q, framed, 3, i, -1)]
            if len(spaced) > 7:
                out.append((q, f"{q} {a}", -1, i, -1))
        others = [x for x in LANGUAGES if x != language and by[x]]
        if others and languages[i] and i % 2 == 0:
            j = pick(by[pick(others)])
            if sum(map(abs, text_languages(words_of(rows[j][1]), table))) > 4 and len(rows[j][1].split()) > 2:
                out.append((q, rows[j][1], 4, i, j))
        if i % 4 == 0:
            out.append((q, pick(PLACEHOLDERS), 0, i, -1))
        if i % 6 == 0:
            out.append((q, pick(["A", "B", "C", "D"]) if i % 4 else pick(["(A)", "B.", "(C)", "D.", "A)", "C:"]), -1, i, -1))
        if i % 6 == 3 and len(spaced) > 8:
            items = [x.strip(" .") for x in re.split(r"(?<=[.!?])\s+|\n", a) if len(x.split()) > 3]
            if len(items) >= 2:
                out.append((q, "\n".join(f"- {x}" for x in items), -1, i, -1))
    return out


def _sound(q: str, a: str, table: dict, known: set[str]) -> bool:
    """Whether a response looks sound enough to make training rows of it."""
    text = visible(a)
    said = words_of(text)
    if not said or not q or "\n" in text or EMPTY_SHELL.sub(" ", text).lower().strip() in EMPTY_WORDS:
        return False
    asked = words_of(q)
    if _common_words(asked, said) >= 0.5 * len(asked):
        return False
    if len(said) > 7 and text[-1] not in ".!":
        return False
    want, score = prompt_language(q, table), text_languages([w for w in said if w not in set(asked)], table)
    return not want or max(score) - score[LANGUAGES.index(want)] < 2


#: Words of a run, least number of pairs that have a run of stock, and of how many pairs one has it at least.
RUN, OFTEN, STOCK_OF = 5, 4, 6_000
#: Share of the words of a stock response that lie in such runs.
STOCK_SHARE = 0.6
#: Runs are first counted together in so many cells, which come in parts.
RUN_CELLS, CELL_PARTS = 1 << 20, 16


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _runs(said: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of the text for each run of words, in the order of the texts."""
    known = {w: _hashed(w) for w in set().union(*said)}
    flat = np.array([known[w] for words in said for w in words], np.uint64)
    text = np.repeat(np.arange(len(said)), [len(words) for words in said]) if said else np.zeros(0, int)
    size = max(0, len(flat) - RUN + 1)
    mixed = np.zeros(size, np.uint64)
    for k in range(RUN):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + size]
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    inside = text[:size] == text[RUN - 1 :] if size else np.zeros(0, bool)
    return mixed[inside], text[:size][inside]


def _is_short(said: list[str], text: str) -> bool:
    """Whether a text is short and of whole sentences, so that it could be stock."""
    return RUN <= len(said) <= 30 and visible(text)[-1:] in (".", "!", "?")


#: Number and distinct pairs of prompt and text; each prompt also comes once without a text.
Block = tuple[int, list[tuple[str, str | None]]]


def _word_counts(block: Block) -> list[tuple[str, tuple[int, ...]]]:
    """Word, its counts in prompts of each language, and the texts that have it before their end; the sums of the languages and the number of pairs under ''."""
    languages: dict[str, Counter] = {language: Counter() for language in LANGUAGES}
    texts: Counter = Counter()
    for q, a in block[1]:
        if a is not None:
            texts.update(set(words_of(a)[:-1]))
            continue
        # a prompt counts for both of its fields
        asked = 2 * words_of(q)
        if first := first_language(q, asked):
            languages[first].update(asked)
        texts.update({w: 2 for w in asked[: len(asked) // 2 - 1]})
    counts = [(w, (*(languages[x][w] for x in LANGUAGES), texts[w])) for w in set(texts).union(*languages.values())]
    return [*counts, ("", (*(languages[x].total() for x in LANGUAGES), sum(a is not None for _, a in block[1])))]


def _counted(item: tuple[str, tuple[int, ...]]) -> tuple[str, tuple[int, ...]] | None:
    word, counts = item
    return item if word == "" or word in ALL_COMMON or counts[-1] >= 2 or sum(counts[:-1]) >= 3 else None


ALL_COMMON = {word for words in COMMON.values() for word in words.split()}


def _cell_counts(block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """Number of runs in each cell, by part."""
    runs, _ = _runs([words_of(visible(a)) for q, a in block[1] if q and a])
    cells = np.bincount((runs % np.uint64(RUN_CELLS)).astype(np.intp), minlength=RUN_CELLS)
    yield from enumerate(cells.reshape(CELL_PARTS, -1))


def _reached(least: int, item: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """Which cells could hold a run of stock."""
    return item[0], item[1] >= least


def _run_pairs(number: int, cells: np.ndarray, block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(run, pair) hashes of the runs in the given cells, by the part that counts them."""
    pairs = sorted({(q, tuple(words_of(visible(a)))) for q, a in block[1] if q and a})
    runs, text = _runs([said for _, said in pairs])
    hit = cells[(runs % np.uint64(RUN_CELLS)).astype(np.intp)]
    owner = np.array([_hashed(f"{q}\n{' '.join(said)}") for q, said in pairs], np.uint64)
    both = np.stack([runs[hit], owner[text[hit]]], axis=1) if len(pairs) else np.zeros((0, 2), np.uint64)
    for part in range(number):
        yield part, both[both[:, 0] % np.uint64(number) == part]


def _frequent(least: int, parts: list[np.ndarray]) -> np.ndarray:
    """Runs that at least so many pairs have."""
    both = np.concatenate([np.zeros((0, 2), np.uint64), *parts])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    runs, often = np.unique(both[new, 0], return_counts=True)
    return runs[often >= least]


def stock_responses(rows: list[tuple[str, str]], frequent: np.ndarray) -> set[tuple[str, str]]:
    """Short rows of whole sentences that lie for the most part in runs of words that many prompts get."""
    short = [(q, a, said) for q, a in rows if q and a and _is_short(said := words_of(visible(a)), a)]
    runs, text = _runs([said for _, _, said in short])
    often, ends = np.isin(runs, frequent), np.searchsorted(text, np.arange(len(short) + 1))
    out = set()
    for number, (q, a, said) in enumerate(short):
        inside = np.zeros(len(said), bool)
        asked = set(words_of(q))
        for i in np.flatnonzero(often[ends[number] : ends[number + 1]]):
            if not asked.issuperset(said[i : i + RUN]):
                inside[i : i + RUN] = True
        if inside.mean() >= STOCK_SHARE:
            out.add((q, a))
    return out


def _sound_block(table: dict, known: set[str], frequent: np.ndarray, block: Block) -> tuple[int, list, list]:
    """(block, sound pairs, pairs that look sound but are stock): what many prompts get answers none of them."""
    number, rows = block
    if number < 0:
        return number, SOUND, []
    stock = stock_responses(rows, frequent)
    sound = [(q, a) for q, a in rows if q and a and _sound(q, a, table, known)]
    return number, [r for r in sound if r not in stock], [r for r in sound if r in stock]


def _made_block(table: dict, known: set[str], turns: int, seed: int, block: tuple[int, list, list]) -> tuple:
    """(block, columns, row sizes, defects, held out, numbers of the sound pairs, numbers of the other pairs) of the made-up rows."""
    number, sound, blank = block
    rng = np.random.default_rng([seed, number + 1])
    made: list[tuple[str, str, int, int, int]] = []
    for _ in range(turns):
        order = rng.permutation(len(sound))
        made += [(q, a, d, order[i], order[j] if j >= 0 else j) for q, a, d, i, j in _made_up([sound[i] for i in order], table, known, rng)]
    made += [(q, a, 2, -1, -1) for q, a in blank]
    if number < 0:
        made += [(q, p, 0, -1, -1) for p in PLACEHOLDERS for q in ("", *[q for q, _ in sound[:3]])]
    rows = [sorted(features(q, a, table, known)) for q, a, *_ in made]
    held = rng.permutation(len(made)) < len(made) // 5
    defect, origin, other = np.array([m[2:] for m in made], np.int32).reshape(-1, 3).T
    return number, np.array([c for r in rows for c in r], np.uint16), np.array([len(r) for r in rows], np.int32), defect, held, origin, other


def _scores(weights: np.ndarray, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the weights of each row, for each defect."""
    if not len(starts):
        return np.zeros((len(weights), 0))
    columns = columns.astype(np.intp)
    return np.array([np.add.reduceat(w.take(columns), starts) for w in weights])


def _kept_rows(weights: np.ndarray | None, thresholds: np.ndarray | None, made: tuple) -> Iterator[tuple[bool, int, bytes]]:
    """(held out, defect, columns) of the rows, without those made of what a first fit takes for defective."""
    number, columns, sizes, defect, held, origin, other = made
    ends = np.cumsum(sizes)
    keep = np.ones(len(sizes), bool)
    if weights is not None and number >= 0:
        sound = np.ones(origin.max(initial=-1) + 2, bool)
        margin = _scores(weights, columns, ends - sizes) - thresholds[:, None]
        own = other == ITSELF
        sound[origin[own]] = margin[:, own].max(axis=0) <= 0
        # a row without origin or other looks at the last place, which stays true
        keep = sound[np.maximum(origin, -1)] & sound[np.maximum(other, -1)]
    for i in np.flatnonzero(keep):
        yield bool(held[i]), int(defect[i]), columns[ends[i] - sizes[i] : ends[i]].tobytes()


def _matrix(weights: np.ndarray | None, thresholds: np.ndarray | None, bundle: Iterable[tuple]) -> tuple[tuple, tuple]:
    """Equal rows as one, for the fit and held out."""
    groups = Counter(row for made in bundle for row in _kept_rows(weights, thresholds, made))
    out = []
    for part in (False, True):
        rows = sorted(key[1:] for key in groups if key[0] == part)
        flat = np.frombuffer(b"".join(r for _, r in rows), np.uint16)
        size = np.array([len(r) // 2 for _, r in rows], np.int64)
        count = np.array([groups[part, *r] for r in rows], np.float64)
        out.append((flat, (np.cumsum(size) - size).astype(np.int32), np.array([d for d, _ in rows], np.int8), count))
    # the rows of each column, for the gradient
    flat, starts, *_ = out[0]
    order = np.argsort(flat, kind="stable")
    used, at = np.unique(flat[order], return_index=True)
    row = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(flat))))[order]
    return (*out[0], row, used, at), out[1]


def _class_sizes(block: tuple[tuple, tuple]) -> np.ndarray:
    """Number of rows of each defect and, last, of none: those of the fit, those held out."""
    return np.array([np.bincount(part[2] % (len(DEFECTS) + 1), part[3], len(DEFECTS) + 1) for part in block])


def _gradient(weights: np.ndarray, balance: np.ndarray, block: tuple[tuple, tuple]) -> np.ndarray:
    """Gradients of the log loss, each class with its weight."""
    columns, starts, defect, count, row, used, at = block[0]
    out = np.zeros(weights.shape)
    if len(starts):
        row = row.astype(np.intp)
        for d, score in enumerate(_scores(weights, columns, starts)):
            y = defect == d
            rest = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * np.where(y, *balance[d]) * count
            out[d, used] = np.add.reduceat(rest.take(row), at)
    return out


#: More than any score that is told apart, in cells.
_FAR = 1 << 16


def _held_scores(weights: np.ndarray, block: tuple[tuple, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(defect and cell of the score, [rows, rows of the defect]) of held-out rows."""
    columns, starts, defect, count = block[1]
    cell = np.clip(np.rint(_scores(weights, columns, starts) * CELLS), -_FAR, _FAR - 1).astype(np.int64) + _FAR
    number = np.arange(len(DEFECTS))[:, None]
    return _summed((cell + number * 2 * _FAR).ravel(), np.stack([np.tile(count, len(DEFECTS)), ((defect == number) * count).ravel()]))


def _summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.array([np.bincount(at, c, len(key)) for c in counts])


def _merged_scores(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]], axis=1))


def _hits(weights: np.ndarray, thresholds: np.ndarray, block: tuple[tuple, tuple]) -> float:
    """Held-out rows that get the right result."""
    columns, starts, defect, count = block[1]
    margin = _scores(weights, columns, starts) - thresholds[:, None]
    return float(count[np.where(margin.max(axis=0) > 0, margin.argmax(axis=0), -1) == defect].sum())


def _calibrate(cells: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> float:
    """The threshold of the best F1, in the middle of all that reach it; cells ascend."""
    if not hits.sum():
        return 0.0
    cells, rows, hits = cells[::-1], np.cumsum(rows[::-1]), np.cumsum(hits[::-1])
    f1 = 2 * hits / (rows + hits[-1])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(cells[best[0]] + cells[min(best[-1] + 1, len(cells) - 1)]) / 2 / CELLS


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum, in the place of the first."""
    a += b
    return a


def _plus(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x + y for x, y in zip(a, b))


class Blocks:
    """Blocks in this process."""

    def __init__(self, blocks: Iterable) -> None:
        self.blocks = list(blocks)

    def each(self, step: Callable, *shared) -> "Blocks":
        return Blocks(step(*shared, b) for b in self.blocks)

    def bundles(self, step: Callable, *shared) -> "Blocks":
        """A step on up to ``BUNDLE`` blocks at once."""
        return Blocks(step(*shared, part) for part in batched(self.blocks, BUNDLE))

    def total(self, step: Callable, merge: Callable, *shared, kind: type | None = None):
        """The results of a step, merged; ``kind`` is the type in which numbers are sent."""
        return reduce(merge, (step(*shared, b) for b in self.blocks))

    def keyed(self, step: Callable, merge: Callable, finish: Callable) -> dict:
        """What a step finds under each key, merged and finished; nothing where that gives nothing."""
        sums: dict = {}
        for block in self.blocks:
            for key, counts in step(block):
                sums[key] = merge(sums[key], counts) if key in sums else counts
        return dict(filter(None, map(finish, sums.items())))

    def routed(self, step: Callable, count: Callable, *shared) -> np.ndarray:
        """What is counted from the parts into which a step sorts its results."""
        return count([found for b in self.blocks for _, found in step(1, *shared, b)])

    def release(self) -> None:
        """Frees the room of the blocks, which stay usable."""

    def close(self) -> None:
        """Frees everything; no blocks made from these are usable."""


def _opened(step: Callable, shared: Broadcast, block):
    return step(*shared.value, block)


def _bundled(step: Callable, shared: Broadcast, blocks: Iterator) -> Iterator:
    return (step(*shared.value, part) for part in batched(blocks, BUNDLE))


def _part_total(step: Callable, merge: Callable, shared: Broadcast, kind: type | None, blocks: Iterator) -> list:
    found = None
    for block in blocks:
        own = step(*shared.value, block)
        found = own if found is None else merge(found, own)
    return [] if found is None else [found.astype(kind) if kind else found]


def _part_count(count: Callable, found: Iterator[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    return [count([f for _, f in found])]


class SpreadBlocks(Blocks):
    """Blocks that lie with the executors."""

    def __init__(self, blocks: RDD, parent: "SpreadBlocks | None" = None, shared: Broadcast | None = None) -> None:
        self.blocks, self.parent, self.shared = blocks.persist(StorageLevel.MEMORY_AND_DISK), parent, shared

    def each(self, step: Callable, *shared) -> "SpreadBlocks":
        # blocks that are lost are made again, so that what is shared stays until the end
        sent = self.blocks.context.broadcast(shared)
        return SpreadBlocks(self.blocks.map(partial(_opened, step, sent)), self, sent)

    def bundles(self, step: Callable, *shared) -> "SpreadBlocks":
        sent = self.blocks.context.broadcast(shared)
        return SpreadBlocks(self.blocks.mapPartitions(partial(_bundled, step, sent)), self, sent)

    def total(self, step: Callable, merge: Callable, *shared, kind: type | None = None):
        sent = self.blocks.context.broadcast(shared)
        # a result for each core: their number must not grow with the table
        most = self.blocks.context.defaultParallelism
        blocks = self.blocks.coalesce(most) if self.blocks.getNumPartitions() > most else self.blocks
        found = blocks.mapPartitions(partial(_part_total, step, merge, sent, kind)).collect()
        sent.destroy()
        return reduce(merge, [f.astype(float) if kind else f for f in found])

    def keyed(self, step: Callable, merge: Callable, finish: Callable) -> dict:
        return dict(self.blocks.flatMap(step).reduceByKey(merge, self.blocks.getNumPartitions()).map(finish).filter(bool).collect())

    def routed(self, step: Callable, count: Callable, *shared) -> np.ndarray:
        sent, number = self.blocks.context.broadcast(shared), self.blocks.getNumPartitions()
        pairs = self.blocks.flatMap(partial(_opened, partial(_routed, step, number), sent))
        found = pairs.partitionBy(number, int).mapPartitions(partial(_part_count, count)).collect()
        sent.destroy()
        return np.concatenate(found)

    def release(self) -> None:
        self.blocks.unpersist()

    def close(self) -> None:
        self.release()
        if self.shared:
            self.shared.destroy()
        if self.parent:
            self.parent.close()


def _routed(step: Callable, number: int, *rest):
    return step(number, *rest)


def _sound_count(block: tuple[int, list, list]) -> int:
    return len(block[1])


class PairClassifier:
    """One linear model for each defect over hashed features, with calibrated thresholds."""

    def __init__(self, rows: list[tuple[str, str]] | Blocks, seed: int = 11) -> None:
        """From pairs, or from blocks of them; a block numbered -1 stands for ``SOUND``."""
        if not isinstance(rows, Blocks):
            prompts = [(q, None) for q in sorted({q for q, _ in rows if q})]
            rows = Blocks([(-1, []), (0, prompts + [(q or "", a or "") for q, a in rows])])
        counts = rows.keyed(_word_counts, _plus, _counted)
        *totals, pairs = counts.pop("")
        self.table = language_table({w: c[:-1] for w, c in counts.items() if any(c[:-1])}, totals)
        self.known = {w for w, c in counts.items() if c[-1] >= 2} | {w for pair in SOUND for t in pair for w in words_of(t)}
        # a share of the pairs, since any words come again in a table that is large enough
        least = max(OFTEN, -(-pairs // STOCK_OF))
        # cells only spare runs that are too rare; all that are left are counted
        cells = rows.keyed(_cell_counts, np.add, partial(_reached, least))
        frequent = np.sort(rows.routed(_run_pairs, partial(_frequent, least), np.concatenate([cells[i] for i in range(CELL_PARTS)])))
        sound = rows.each(_sound_block, self.table, self.known, frequent)
        # few sound rows are used several times, each time cut and replaced otherwise
        turns = max(1, min(12, LEAST_MADE // max(1, 3 * sound.total(_sound_count, int.__add__))))
        rows.release()
        made = sound.each(_made_block, self.table, self.known, turns, seed)
        self.weights = self.thresholds = None
        # what a first fit takes for defective is no sound row of the second
        for rounds in (50, 150):
            matrix = made.bundles(_matrix, self.weights, self.thresholds)
            self._train(matrix, rounds)
            sound.release()
            matrix.release()
        matrix.close()

    def _train(self, blocks: Blocks, rounds: int) -> None:
        train, held = blocks.total(_class_sizes, np.add)
        weights = self._fit(blocks, train, rounds)
        self.weights = weights.astype(np.float32)
        key, counts = blocks.total(_held_scores, _merged_scores, self.weights)
        cells = [key // (2 * _FAR) == d for d in range(len(DEFECTS))]
        # where the made-up rows leave no doubt, the limit lies midway
        self.thresholds = np.array([_calibrate(key[own] % (2 * _FAR) - _FAR, *counts[:, own]) for own in cells], np.float32)
        self.held_out = blocks.total(_hits, float.__add__, self.weights, self.thresholds) / max(1, held.sum())

    @staticmethod
    def _fit(blocks: Blocks, sizes: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
        """Logistic regression by full-batch steps scaled for each column."""
        # the start of the squares holds back columns of few rows, such as names
        weight, square = np.zeros((len(DEFECTS), WIDTH)), np.full((len(DEFECTS), WIDTH), 1e-4)
        balance = np.array([(0.5 / max(1, n), 0.5 / max(1, sizes.sum() - n)) for n in sizes[: len(DEFECTS)]])
        for _ in range(rounds):
            gradient = blocks.total(_gradient, _added, weight, balance, kind=np.float32) + decay * weight
            square += gradient**2
            weight -= rate * gradient / np.sqrt(square)
        return weight

    def answer_defect(self, prompt: str | None, golds: str | None) -> str | None:
        """The defect of alternatives that a bar separates: defective only if all of them are."""
        parts = (golds or "").split("|")
        found = [self.defect(prompt, part) for part in parts]
        return None if None in found else found[0]

    def margins(self, row: list[int]) -> np.ndarray:
        return self.weights[:, row].sum(axis=1) - self.thresholds

    def defect(self, prompt: str | None, response: str | None) -> str | None:
        row = features(prompt, response, self.table, self.known)
        margin = self.margins(row)
        best = int(np.argmax(margin))
        return DEFECTS[best] if margin[best] > 0 else None

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that come block after block, each block pickled as one value."""

    def out(number: int, rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
        # the order of arrival is open
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((number, rows))], pa.binary())], ["data"])

    at, rows = None, []
    for batch in batches:
        for number, q, a in zip(*(c.to_pylist() for c in batch.columns)):
            if number != at and rows:
                yield out(at, rows)
                rows = []
            at = number
            rows.append((q, a))
    if rows:
        yield out(at, rows)


def fit_classifier(results: DataFrame) -> PairClassifier:
    """The classifier, fitted on every distinct pair of a prompt and an output or one of the answers."""
    texts = F.concat(F.array(F.lit(None), F.coalesce("output", F.lit(""))), F.split(F.coalesce("answer", F.lit("")), r"\|"))
    pairs = results.filter("question is not null").select("question", F.explode(texts).alias("text"))
    number = max(1, -(-results.count() // BLOCK_ROWS))
    # equal pairs are one before anything is shuffled
    block = F.pmod(F.xxhash64("question", "text"), F.lit(number)).alias("block")
    grouped = pairs.groupBy(block).agg(F.collect_set(F.struct("question", "text")).alias("pairs"))
    packed = grouped.select("block", F.explode("pairs").alias("pair")).select("block", "pair.question", "pair.text").mapInArrow(_packed, "data binary")
    if number == 1:
        return PairClassifier(Blocks([(-1, []), *(pickle.loads(r["data"]) for r in packed.collect())]))
    context = results.sparkSession.sparkContext
    spread = packed.rdd.map(_loaded).union(context.parallelize([(-1, [])], 1))
    return PairClassifier(SpreadBlocks(spread))


def _loaded(row) -> Block:
    return pickle.loads(row["data"])


def defective_pairs(results: DataFrame) -> DataFrame:
    """(id, field, defect) of every defective output or answer."""
    shared = results.sparkSession.sparkContext.broadcast(fit_classifier(results))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, fields, defects = [], [], []
            number, questions, outputs, answers = (c.to_pylist() for c in batch.columns)
            for i, q, output, answer in zip(number, questions, outputs, answers):
                for field, found in (("output", model.defect(q, output)), ("answer", model.answer_defect(q, answer))):
                    if found:
                        ids.append(i)
                        fields.append(field)
                        defects.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(defects, pa.string())], ["id", "field", "defect"])

    rows = results.select(F.col("id").cast("bigint").alias("id"), "question", "output", "answer")
    return rows.mapInArrow(run, "id bigint, field string, defect string").distinct()
