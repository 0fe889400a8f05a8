"""Which of the handled languages a short text is written in, by its function words."""

from __future__ import annotations

import re

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": frozenset(
        "the of and to in is was it that for on as with by at from be are this which who not but or had has were if an its their one they some when what here "
        "both i am you we he she his her my your no do does did have been into than then there these those would could can may about more other how where why".split()
    ),
    "de": frozenset(
        "der die das und in ist den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
        "einem einen eines über wurde ich wir ihr dem im zum zur war oder aber wenn nur so durch vor bis kein keine hier dies diese dieser was wer wo welche welcher".split()
    ),
    "fr": frozenset(
        "le la les de des et à un une en du est que qui dans pour par sur au aux plus ne pas se ce il elle sont ont été avec son sa ses nous vous je on cette ces "
        "mais ou où si leur leurs était être avoir fut deux tout très comme quel quelle selon".split()
    ),
    "es": frozenset(
        "el la los las de y en un una que se del es por con para al no lo como su sus más fue ha este esta está pero ni si ya me mi tu nos son era ser hay cuál "
        "qué quién donde cuando según sobre entre sin dos todo muy aquí eso esto le les".split()
    ),
}
# Names of the languages inside requests such as "Answer in German".
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles",
    "de": "german deutsch allemand alemán aleman",
    "fr": "french französisch franzosisch français francais francés frances",
    "es": "spanish spanisch espagnol español espanol castellano",
}
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"]+\"|“[^”]+”|«[^»]+»|„[^“”]+[“”]")
_ASKED = re.compile(r"\b(?:in|auf|en)\s+([^\W\d_]+)", re.IGNORECASE)


def votes(text: str) -> dict[str, int]:
    """How many words of a text are function words of each language."""
    found = [w for w in _WORD.findall(text.lower())]
    return {lang: sum(w in words for w in found) for lang, words in FUNCTION_WORDS.items()}


def detect(text: str, quotes: bool = True) -> str | None:
    """The language with most function words; null without any, or when the first two are level."""
    counts = votes(text if quotes else _QUOTED.sub(" ", text))
    first, second = sorted(counts.values(), reverse=True)[:2]
    return max(counts, key=counts.get) if first > second else None


def asked_language(question: str) -> str | None:
    """The language in which a question asks to be answered, if it says so in its last sentence."""
    tail = re.split(r"[?？]", question)[-1] if re.search(r"[?？]", question) else question
    for name in _ASKED.findall(tail):
        for lang, names in LANGUAGE_NAMES.items():
            if name.lower() in names.split():
                return lang
    return None
