"""Broken prompt and response pairs (problem 6).

A multi-label linear classifier on hashed word n-grams and pair features tells whether a response is
empty, breaks off, refuses, only repeats the question or is in another language. No labels are
needed: responses of the data themselves are truncated, swapped between languages, replaced by their
question, by refusals and by blanks. Rows the first model finds defective leave the training sample
before the second is trained. Thresholds are set on held-out examples. The model has a fixed size and
is fitted on at most ``SAMPLE`` rows; it is applied to all rows, whole texts.
"""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidra.llm.language import FUNCTION_WORDS, asked_language, detect
from lucidra.llm.overlaps import words as bare_words

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Rows from which the classifier is fitted, at most; taken by the hash of their id.
SAMPLE = 6_000
BITS = 17
#: Fits of the model, and the score from which a row of the data no longer serves as a sound one in the next.
ROUNDS, SUSPECT = 2, 0.5
#: Share of each defect that the thresholds are set for.
PRIOR = 0.03

# Words of labels and placeholders that are no content.
LABELS = frozenset("answer question response reply final result output a q r antwort frage réponse reponse question respuesta pregunta p ergebnis résultat resultado".split())
PLACEHOLDERS = frozenset("null none nil nan n/a na blank empty no output missing undefined tbd todo unknown leer vide vacío vacio".split())
# Texts without content.
EMPTY_TEXTS = ["", " ", "-", "--", ".", "...", "…", "**", "{}", "[]", "()", "N/A", "n/a", "null", "None", "nan", "[no output]", "(blank)", "[empty]", "<p></p>", "<answer></answer>", "<br>", "```\n```", "\u200b", "Answer:", "A:", "Final answer:", "Response:", "Antwort:", "Réponse :", "Respuesta:"]
# Ways to decline, by language; {x} is a thing asked about.
REFUSALS = {
    "en": [
        "I'm sorry, but I can't help with that.", "I don't know.", "I do not know the answer to this question.", "I cannot answer this question.", "I am unable to answer that.",
        "I'm unable to determine that.", "As a language model, I am unable to give a reliable answer here.", "As an AI, I cannot provide this information.", "I must decline to answer.",
        "I'd rather not say.", "I would prefer not to answer.", "I do not have enough information to answer this question.", "There is not enough information to answer.",
        "I have no access to facts about {x}.", "I have no information about {x}.", "I won't guess at details on {x}.", "I cannot say anything about {x} at this time.",
        "I am not able to help with questions about {x}.", "I have to leave this question unanswered.", "This is something I cannot respond to.", "That goes beyond what I am allowed to discuss.",
        "My training data does not cover this, so I will pass.", "No answer can be provided for this request.", "Answering this would require data I do not have.",
        "I am not able to look this up, please consult another source.", "It would not be appropriate for me to speculate about this, so I will leave it open.",
        "I'm not comfortable answering this.", "I can't discuss {x}.", "It is not possible for me to answer.", "I have no idea.", "Your request cannot be completed.", "I am not permitted to share this.",
    ],
    "de": [
        "Das kann ich leider nicht beantworten.", "Ich weiß es nicht.", "Das weiß ich nicht.", "Dazu liegen mir keine Informationen vor.", "Dazu habe ich keine Angaben.", "Ich möchte mich dazu nicht äußern.",
        "Ich kann diese Frage nicht beantworten.", "Tut mir leid, dabei kann ich nicht helfen.", "Als Sprachmodell kann ich darauf keine verlässliche Antwort geben.", "Darüber darf ich keine Auskunft geben.",
        "Über {x} kann ich nichts sagen.", "Diese Frage muss ich offen lassen.", "Mir fehlen die nötigen Informationen.",
    ],
    "fr": [
        "Je suis désolé, je ne peux pas répondre à cette question.", "Je ne sais pas.", "Je ne dispose pas des informations nécessaires.", "Je préfère ne pas me prononcer.", "Je ne suis pas en mesure de répondre.",
        "Désolé, je ne peux pas vous aider.", "Je n'ai aucune information sur {x}.", "En tant que modèle de langue, je ne peux pas donner de réponse fiable.", "Il m'est impossible de répondre.",
        "Je n'ai pas assez d'informations pour répondre.", "Je dois laisser cette question sans réponse.",
    ],
    "es": [
        "No lo sé.", "Lo siento, no puedo responder a esta pregunta.", "No dispongo de información suficiente.", "Prefiero no pronunciarme.", "No puedo ayudar con eso.", "No tengo datos sobre {x}.",
        "Como modelo de lenguaje, no puedo dar una respuesta fiable.", "No estoy en condiciones de responder.", "No me es posible contestar.", "Debo dejar esta pregunta sin respuesta.",
    ],
}
# Phrases around a refusal.
BEFORE = ["", "", "", "Sorry, ", "Unfortunately, ", "I'm sorry, but ", "I apologise, ", "To be honest, ", "Thank you for asking, but "]
AFTER = ["", "", "", " Please try another question.", " Could you rephrase the question?", " Let me know if I can help with something else.", " Please check a reliable source."]
# Sentences that mention declining although they answer; {y} is the answer.
ANSWERS_LIKE_REFUSALS = {
    "en": ['The witness said "I do not know", but the file gives {y}.', 'Asked twice, the envoys wrote "we cannot answer that", yet the list shows {y}.', "The owner refused to sign, so {y} was put down instead.", "Sorry for the detour; the result is {y}.", "I cannot be sure, but it is most likely {y}.", "One page cannot be read any more, but the other states {y}."],
    "de": ['Der Zeuge sagte "das weiß ich nicht", in der Akte steht aber {y}.', "Ich bin nicht sicher, aber wohl {y}."],
    "fr": ['Le témoin a dit "je ne sais pas", mais le dossier donne {y}.', "Je ne suis pas certain, mais c'est sans doute {y}."],
    "es": ['El testigo dijo "no lo sé", pero el acta da {y}.', "No estoy seguro, pero parece que es {y}."],
}
_TAG = re.compile(r"<[^<>]*>|[*_#`>|~]+")
_TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+(?:['’][^\W\d_]+)*|[^\w\s]")
_END = re.compile(r"[.!?。？！)\]}\"”»'’*…:;]\s*$")


@dataclass
class Pair:
    """A question, a response and the answers a response may contain."""

    question: str | None
    text: str | None
    answers: tuple[str, ...] = ()


def _h(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


def _flat(text: str) -> str:
    return " ".join(bare_words(text))


def _sequence(text: str, names: set[str]) -> list[str]:
    """Tokens in lower case; runs of numbers and of words in ``names`` become one mark."""
    seq: list[str] = []
    for t in _TOKEN.findall(text):
        low = t.lower()
        kind = "#" if t[0].isdigit() else "@" if _flat(low) in names else low
        if not (kind in "#@" and seq and seq[-1] in "#@"):
            seq.append(kind)
    return seq


def _names(p: Pair) -> set[str]:
    """Words of the answers, and of the question unless they are function words."""
    said = {w for a in p.answers for w in bare_words(a)}
    return said | {w for w in bare_words(p.question) if not any(w in f for f in FUNCTION_WORDS.values())}


def _scripts(said: list[str]) -> set[str]:
    """The writing systems (first word of the characters' Unicode names) of most letters of some words."""
    counts = Counter(unicodedata.name(ch, "?").split()[0] for w in said for ch in w if ch.isalpha())
    half = counts.total() / 2
    return {k for k, n in counts.items() if n >= half}


def _clean(text: str | None) -> str:
    t = unicodedata.normalize("NFKC", text or "").replace("’", "'")
    return "".join(ch for ch in t if unicodedata.category(ch) not in ("Cf", "Co", "Cn"))


def sentence_ends(r: Pair) -> set[int]:
    """Hashes of the word sequences (up to four) with which the sentences of a response end."""
    text, names, seen = _TAG.sub(" ", _clean(r.text)).strip(), _names(r), set()
    for m in re.finditer(r"[^.!?]+(?=[.!?]+(?:\s|$))", text):
        seq = _sequence(m.group(), names)
        seen |= {_h(f"{n}:" + " ".join(seq[-n:])) for n in range(1, 5) if len(seq) >= n}
    return seen


def endings_of(ends: list[set[int]], least: int = 2) -> frozenset[int]:
    """The sentence ends of at least ``least`` rows."""
    seen = Counter(h for e in ends for h in e)
    return frozenset(h for h, n in seen.items() if n >= least)


def features(p: Pair, endings: frozenset[int] = frozenset()) -> tuple[dict[int, float], dict]:
    """Hashed features of a pair and the facts behind them."""
    text = _clean(p.text)
    stripped = _TAG.sub(" ", text).strip()
    said = bare_words(stripped)
    asked = bare_words(p.question)
    asked_set, said_set = set(asked), set(said)
    content = [w for w in said if w not in LABELS and w not in PLACEHOLDERS and w != "n"]
    new = [w for w in content if w not in asked_set]
    near = [w for w in new if not any(len(w) > 3 and abs(len(w) - len(a)) <= 1 and (w[:-1] == a[:-1] or w[1:] == a[1:] or sorted(w) == sorted(a)) for a in asked_set)]
    flat = " " + " ".join(said) + " "
    answers = [a for a in (_flat(x or "") for x in p.answers) if a]
    has_answer = any(f" {a} " in flat for a in answers)
    covered = len(asked_set & said_set) / len(asked_set) if asked_set else 0.0
    asked_flat = " " + " ".join(asked) + " "
    adds_answer = any(f" {a} " in flat and f" {a} " not in asked_flat for a in answers)
    own = detect(stripped, quotes=False)
    wanted = {x for x in (detect(p.question), asked_language(p.question)) if x} if p.question else set()
    foreign = bool(p.question) and _scripts(content) and not _scripts(content) & _scripts(asked)
    ends = bool(_END.search(stripped))
    dots = bool(re.search(r"(?:\.{2,}|…)\W*$", stripped))
    full_stop = not dots and bool(re.search(r"[.!?。？！]\W*$", stripped))
    facts = {"content": len(content), "new": len(new), "near": len(near), "covered": covered, "own": own, "wanted": wanted, "ends": ends, "has_answer": has_answer, "said": len(said), "full_stop": full_stop, "is_answer": " ".join(content) in answers, "adds_answer": adds_answer, "foreign": foreign and not has_answer}

    out: dict[int, float] = {}

    def add(name: str, value: float = 1.0) -> None:
        k = _h(name)
        out[k] = out.get(k, 0.0) + value

    add("bias")
    add(f"content:{min(len(content), 3)}")
    add(f"said:{min(len(said), 4)}")
    if p.question:
        add(f"new:{min(len(new), 4)}")
        add(f"near:{min(len(near), 3)}")
        add(f"covered:{int(covered * 5)}")
        add(f"copy:{covered > 0.75}:{min(len(near), 2)}")
        state = "none" if own is None or not wanted else "same" if own in wanted else "other"
        if facts["foreign"]:
            state = "other"
            add("letters", 3.0)
        add(f"language:{state}")
        add(f"language:{state}:{min(len(said) // 4, 3)}")
    if answers:
        add(f"answer:{has_answer}")
        add(f"answer:{has_answer}:{min(len(said) // 4, 3)}")
    add(f"ends:{ends}")
    add(f"ends:{ends}:{min(len(said) // 6, 3)}")

    add(f"last:{stripped[-1:] if stripped[-1:] and not stripped[-1:].isalnum() else 'letter'}")
    add(f"asks:{stripped.endswith('?')}:{int(covered * 5)}:{has_answer}")

    seq = _sequence(stripped, _names(p))
    core = list(seq)
    while core and core[-1] in ".!?…\"')":
        core.pop()
    known = max((n for n in range(1, 5) if len(core) >= n and _h(f"{n}:" + " ".join(core[-n:])) in endings), default=0)
    add(f"known:{known}:{full_stop}")
    add(f"known:{known}:dots:{dots}")
    add(f"known:{known}:{full_stop}:{min(len(core), 5)}")
    grams = [f"w:{a}" for a in seq] + [f"b:{a} {b}" for a, b in zip(seq, seq[1:])] + [f"t:{a} {b} {c}" for a, b, c in zip(seq, seq[1:], seq[2:])]
    if grams:
        weight = 2.0 / len(grams) ** 0.5
        for g in set(grams):
            add(g, weight)
    tail = [w for w in seq if w not in ('"', "*")][-4:]
    for n in range(1, 5):
        if len(tail) >= n:
            add(f"end{n}:{' '.join(tail[-n:])}")
    head = seq[:3]
    for n in range(1, 4):
        if len(head) >= n:
            add(f"head{n}:{' '.join(head[:n])}", 0.5)
    return out, facts


def _cut_inside(text: str, rng: random.Random) -> str | None:
    """The text broken off inside one of its sentences, with at least a word of the sentence missing."""
    starts = [0] + [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(text)]) if len(text[a:b].split()) >= 4]
    if not spans:
        return None
    a, b = rng.choice(spans[-3:])
    found = list(re.finditer(r"\S+", text[a:b]))
    k = rng.randrange(1, len(found) - 1)
    if rng.random() < 0.35 and len(found[k].group()) > 3:
        part = found[k].start() + rng.randrange(1, len(found[k].group()) - 1)
        return text[: a + part] + ("-" if rng.random() < 0.3 else "")
    return text[: a + found[k].start()].rstrip() if rng.random() < 0.9 else text[: a + found[k].start()]


def _dressed(text: str, rng: random.Random) -> str:
    r = rng.random()
    if r < 0.15:
        return text.lower()
    if r < 0.2:
        return text.upper()
    if r < 0.3:
        return f"  {text}\n"
    if r < 0.4:
        return re.sub(r"[.!?]\s*$", "", text)
    return text


def _reworded(text: str, rng: random.Random) -> str:
    """Up to three words misspelt, left out, put in or moved."""
    w = text.split()
    for _ in range(rng.randrange(1, 4)):
        k = rng.randrange(len(w))
        r = rng.random()
        if r < 0.5 and len(w[k]) > 3:
            j = rng.randrange(1, len(w[k]) - 1)
            w[k] = w[k][:j] + rng.choice([w[k][j + 1] + w[k][j] + w[k][j + 2 :], w[k][j + 1 :], rng.choice("aeiorst") + w[k][j + 1 :]])
        elif r < 0.65 and len(w) > 5:
            del w[k]
        elif r < 0.85:
            w.insert(k, rng.choice(w))
        else:
            w = w[k:] + w[:k]
    return " ".join(w)


def donors_of(rows: list[Pair], langs: list[str | None]) -> dict[str, list[Pair]]:
    """The rows whose responses can stand for another language, by language."""
    by_lang: dict[str, list[Pair]] = {}
    for r, lang in zip(rows, langs):
        if lang and len((r.text or "").split()) > 3 and r.answers:
            by_lang.setdefault(lang, []).append(r)
    return by_lang


def _in_other_letters(text: str, rng: random.Random) -> str:
    """The text as if it were written in another writing system: each letter becomes one of a block that starts somewhere else."""
    first = rng.choice([0x0430, 0x03B1, 0x0561, 0x3042, 0x4E00, 0xAC00])
    return "".join(chr(first + ord(ch.lower()) % 23) if ch.isalpha() else ch for ch in text)


def broken_versions(r: Pair, i: int, by_lang: dict[str, list[Pair]], seed: int = 7) -> list[tuple[int, Pair, tuple[str, ...]]]:
    """(source row, pair, defects): row ``i`` as it is and its broken versions; the draws depend on ``seed`` and ``i`` only."""
    rng = random.Random(seed * 1_000_003 + i)
    out: list[tuple[int, Pair, tuple[str, ...]]] = []
    text, q, ans = r.text or "", r.question, r.answers
    if rng.random() < 0.15:
        ans = ()
    out.append((i, Pair(q, text, ans), ()))
    qlang = (asked_language(q) or detect(q)) if q else None
    for _ in range(3):
        cut = _cut_inside(text, rng)
        if cut and set(_sequence(_clean(cut), _names(r))) - set("@#.,"):
            dots = rng.choice(["...", "…"]) if rng.random() < 0.25 else ""
            out.append((i, Pair(q, cut + dots, ans), ("truncated",)))
    if len(text.split()) > 3:
        bare = re.sub(r"[.!?]\s*$", "", text)
        out.append((i, Pair(q, bare + (rng.choice(["...", "…"]) if rng.random() < 0.1 else ""), ans), ()))
    if q and rng.random() < 0.6:
        q_only = re.split(r"(?<=[?？])\s*", q)[0]
        shape = rng.choice(["{q}", "{q}", "{q}", "Question: {q}", "Q: {q}", "> {q}", "You asked: {q}", "{q} A:", "{q}\nAnswer:", "Frage: {q} Antwort:", "{q} {q}", '"{q}"'])
        said = rng.choice([q, q_only, re.sub(r"[?？]\s*$", "", q_only)])
        copy = shape.format(q=_reworded(said, rng) if rng.random() < 0.35 and len(said.split()) > 3 else said)
        out.append((i, Pair(q, _dressed(copy, rng), ans), ("copied_question",)))
        if ans:
            shape = rng.choice(["Question: {q} Answer: {a}", "{q} {a}", "{q} - {a}.", "Q: {q}\nA: {a}", "Frage: {q} Antwort: {a}", "Question : {q} Réponse : {a}", "Pregunta: {q} Respuesta: {a}"])
            out.append((i, Pair(q, _dressed(shape.format(q=q_only, a=ans[0]), rng), ans), ()))
    if rng.random() < 0.5:
        lang = qlang if qlang and rng.random() < 0.85 else rng.choice(list(REFUSALS))
        thing = " ".join(re.findall(r"\b[A-Z]\w+ [A-Z]\w+\b", q or "")[:1]) or "this"
        said = rng.choice(REFUSALS[lang]).replace("{x}", thing)
        if lang == "en":
            lead, trail = rng.choice(BEFORE), rng.choice(AFTER)
            said = lead + (said[0].lower() + said[1:] if lead and not said.startswith(("I ", "I'")) else said) + trail
        out.append((i, Pair(q, _dressed(said, rng), ans), ("refusal",)))
        if ans:
            like = rng.choice(ANSWERS_LIKE_REFUSALS.get(lang, ANSWERS_LIKE_REFUSALS["en"])).replace("{y}", ans[0])
            if lang == qlang:
                out.append((i, Pair(q, _dressed(like, rng), ans), ()))
    if q and qlang and ans and rng.random() < 0.6:
        others = [x for x in by_lang if x != qlang and x != detect(q)]
        if others:
            donor = rng.choice(by_lang[rng.choice(others)])
            swapped = donor.text
            for a in donor.answers:
                swapped = swapped.replace(a, ans[0])
            out.append((i, Pair(q, _dressed(swapped, rng), ans), ("other_language",)))
    if rng.random() < 0.5:
        out.append((i, Pair(q, rng.choice(EMPTY_TEXTS), ans if rng.random() < 0.5 else ()), ("empty",)))
    if q and len(text.split()) > 3 and rng.random() < 0.3:
        out.append((i, Pair(q, _in_other_letters(text, rng), ans), ("other_language",)))
    return out


def synthesise(rows: list[Pair], seed: int = 7) -> list[tuple[int, Pair, tuple[str, ...]]]:
    """:func:`broken_versions` of all rows."""
    by_lang = donors_of(rows, [detect(r.text or "", quotes=False) for r in rows])
    return [x for i, r in enumerate(rows) for x in broken_versions(r, i, by_lang, seed)]


@dataclass
class DefectModel:
    """Weights (features x defects) and thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    endings: frozenset[int] = frozenset()

    def scores(self, sparse: list[dict[int, float]]) -> np.ndarray:
        """Probabilities, one row per example."""
        if not sparse:
            return np.zeros((0, len(DEFECTS)))
        sizes = np.array([len(f) for f in sparse])
        idx = np.fromiter((k for f in sparse for k in f), dtype=np.int64, count=sizes.sum())
        val = np.fromiter((v for f in sparse for v in f.values()), dtype=float, count=sizes.sum())
        z = np.add.reduceat(val[:, None] * self.weights[idx], np.cumsum(sizes) - sizes, axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(sparse: list[dict[int, float]], y: np.ndarray, epochs: int = 6, rate: float = 0.25, l2: float = 1e-6) -> np.ndarray:
    rng = np.random.default_rng(11)
    w = np.zeros((1 << BITS, len(DEFECTS)))
    g2 = np.full_like(w, 1e-3)
    idx = [np.fromiter(f.keys(), dtype=np.int64, count=len(f)) for f in sparse]
    val = [np.fromiter(f.values(), dtype=float, count=len(f)) for f in sparse]
    size = np.array([len(f) for f in sparse])
    for _ in range(epochs):
        order = rng.permutation(len(sparse))
        for s in range(0, len(order), 64):
            batch = order[s : s + 64]
            cols, vals = np.concatenate([idx[i] for i in batch]), np.concatenate([val[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), size[batch])
            z = np.add.reduceat(vals[:, None] * w[cols], np.cumsum(size[batch]) - size[batch], axis=0)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            by = np.argsort(cols, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cols[by]) > 0])
            uniq = cols[by][starts]
            grad = np.add.reduceat((vals[:, None] * err[row])[by], starts, axis=0)
            grad = grad / len(batch) + l2 * w[uniq]
            g2[uniq] += grad**2
            w[uniq] -= rate * grad / np.sqrt(g2[uniq])
    return w


def _thresholds(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each defect the lowest threshold within half a percent of the best F1, if the defect had the share ``PRIOR``."""
    out = []
    for d in range(len(DEFECTS)):
        pos, neg = p[y[:, d] > 0, d], p[y.sum(1) == 0, d]
        grid = np.linspace(0.2, 0.95, 31)
        hit = np.array([PRIOR * (pos >= t).mean() if len(pos) else 0.0 for t in grid])
        false = np.array([(1 - PRIOR) * (neg >= t).mean() if len(neg) else 0.0 for t in grid])
        f1 = 2 * hit / (hit + false + PRIOR)
        out.append(grid[np.argmax(f1 >= f1.max() - 0.005)] if len(pos) else 0.5)
    return np.array(out)


def _facts(rows: list[Pair], i: int) -> tuple:
    """(whether row ``i`` serves as a sound one, its language, its sentence ends)."""
    f = features(rows[i])[1]
    sound = f["has_answer"] and (f["own"] is None or f["own"] in f["wanted"]) and (f["full_stop"] or f["said"] <= 4)
    return sound, detect(rows[i].text or "", quotes=False), sentence_ends(rows[i])


def _examples(rows: list[Pair], i: int, by_lang: dict[str, list[Pair]], endings: frozenset[int], seed: int) -> list[tuple]:
    """(source row, defects, features) of row ``i`` and its broken versions."""
    return [(j, labels, features(p, endings)[0]) for j, p, labels in broken_versions(rows[i], i, by_lang, seed)]


def _here(rows: list[Pair], work, picks: list[int], *args) -> list:
    return [work(rows, i, *args) for i in picks]


def on_workers(spark: SparkSession) -> Callable:
    """A replacement of :func:`_here` that spreads the rows over the workers; what comes back is bounded by ``SAMPLE``."""

    def run(rows: list[Pair], work, picks: list[int], *args) -> list:
        shared = spark.sparkContext.broadcast((rows, args))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, args = shared.value
            for pdf in batches:
                yield pd.DataFrame({"i": pdf["i"], "got": [pickle.dumps(work(rows, i, *args)) for i in pdf["i"]]})

        n = max(1, min(len(picks), spark.sparkContext.defaultParallelism))
        ids = spark.createDataFrame(pd.DataFrame({"i": np.array(picks, dtype=np.int64)})).repartition(n, "i")
        got = {r.i: pickle.loads(r.got) for r in ids.mapInPandas(part, "i long, got binary").collect()}
        return [got[i] for i in picks]

    return run


def fit_model(rows: list[Pair], seed: int = 7, over: Callable = _here) -> DefectModel:
    """Fit on responses of unknown quality; see the module text. Deterministic in the order of the rows.

    Responses that end in a full stop or are short, speak the language of their question and contain one of
    their known answers serve as sound ones (all rows, where fewer than a fifth are like that). ``over`` runs the
    work for each row: here, or on the workers.
    """
    facts = over(rows, _facts, list(range(len(rows))))
    sure = [i for i, f in enumerate(facts) if f[0]]
    keep = sure if len(sure) >= 0.2 * len(rows) else list(range(len(rows)))
    endings = endings_of([facts[i][2] for i in keep])
    by_lang = donors_of([rows[i] for i in keep], [facts[i][1] for i in keep])
    made = [x for xs in over(rows, _examples, keep, by_lang, endings, seed) for x in xs]
    model = None
    for _ in range(ROUNDS):
        kept = set(keep)
        made = [x for x in made if x[0] in kept]
        sparse = [f for _, _, f in made]
        y = np.array([[float(d in labels) for d in DEFECTS] for _, labels, _ in made]).reshape(len(made), len(DEFECTS))
        held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in made])
        if not len(made) or held.all() or not held.any():
            held = np.zeros(len(made), bool)
        w = _train([s for s, h in zip(sparse, held) if not h], y[~held])
        model = DefectModel(w, np.full(len(DEFECTS), 0.5), endings)
        test = held if held.any() else ~held
        model.thresholds = _thresholds(model.scores([s for s, t in zip(sparse, test) if t]), y[test])
        firsts: dict[int, dict] = {}
        for i, _, f in made:  # the row itself comes before its broken versions
            firsts.setdefault(i, f)
        own = model.scores([firsts[i] for i in keep])
        keep = [i for i, s in zip(keep, own) if not (s >= SUSPECT).any()] or keep
    return model


def defects_of(model: DefectModel, pairs: list[Pair]) -> list[list[str]]:
    """The defects of each pair: those over their thresholds that the exact checks do not rule out.

    A response is one of empty, copied or refused; only otherwise can it break off or be in another language.
    """
    made = [features(p, model.endings) for p in pairs]
    p = model.scores([m[0] for m in made])
    out = []
    for (_, f), s in zip(made, p):
        over = {d for d, x, t in zip(DEFECTS, s, model.thresholds) if x >= t}
        if f["content"] > 2:
            over.discard("empty")
        if f["covered"] < 0.5 or f["near"] > max(3, 0.3 * f["said"]) or f["adds_answer"]:
            over.discard("copied_question")
        if not f["foreign"] and (f["own"] is None or not f["wanted"] or f["own"] in f["wanted"]):
            over.discard("other_language")
        if f["said"] < 2 or f["full_stop"] or f["is_answer"]:
            over.discard("truncated")
        if f["foreign"] and "other_language" in over:  # what it says in other letters is not read
            over.discard("refusal")
        for alone in ("empty", "copied_question", "refusal"):
            if alone in over:
                over = {alone}
        out.append([d for d in DEFECTS if d in over])
    return out


def flag_defects(df: DataFrame, row_id: str, question: str, text: str, answers: str, sample: int = SAMPLE) -> DataFrame:
    """``row_id, defect``: one row per defect of a pair.

    ``question`` and ``answers`` may be null: a response without its question cannot be a copy or in the wrong
    language, but it can be empty, break off or refuse. A null response is empty. An empty table has no defects.
    """
    base = df.select(F.col(row_id).alias("row_id"), F.col(question).alias("q"), F.col(text).alias("t"), F.col(answers).alias("a"))
    picked = base.where("q is not null and t is not null").orderBy(F.xxhash64("row_id"), "row_id").limit(sample).collect()
    rows = [Pair(r.q, r.t, tuple(x for x in (r.a or []) if x)) for r in picked]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fit_model(rows, over=on_workers(spark)) if rows else None)
    kind = base.schema["row_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            pairs = [
                Pair(q if isinstance(q, str) else None, t if isinstance(t, str) else None, tuple(x for x in (a if a is not None else ()) if isinstance(x, str)))
                for q, t, a in zip(pdf["q"], pdf["t"], pdf["a"])
            ]
            found = defects_of(model, pairs) if model is not None else [["empty"] if not features(p)[1]["content"] else [] for p in pairs]
            ids = [i for i, ds in zip(pdf["row_id"], found) for _ in ds]
            yield pd.DataFrame({"row_id": pd.Series(ids, dtype=pdf["row_id"].dtype), "defect": pd.Series([d for ds in found for d in ds], dtype=object)})

    return base.mapInPandas(work, f"row_id {kind}, defect string")
