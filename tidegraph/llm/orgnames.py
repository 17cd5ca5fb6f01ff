"""Reading of organisation names as people type them.

A name is read into one or more :class:`Reading` s: the letters of its proper
part, the kind of business, and the number of a numbered unit. Hangul is
romanised letter by letter, so both scripts share one spelling. Legal forms,
forwarding marks and office notes are dropped; a trade name behind ``t/a`` and
a full name in brackets are readings of their own.

Which words tell the kind of business isn't stated here: :mod:`tidegraph.llm.kinds`
learns it from the names themselves and hands it over as a :class:`Kinds`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Hangul letters by their place in a syllable, in Unicode's order.
LEADS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
TAILS = ("", "k", "kk", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "t")

#: Words that name no kind and belong to no proper part.
FILLERS = {"of", "and", "for", "svc", "svcs", "service", "services"}
LEGAL = {"co", "ltd", "inc", "corp", "corporation", "company", "limited", "coltd", "incorporated", "plc", "llc", "sa", "as", "asa", "bv", "nv", "gmbh", "the"}
LEGAL_HANGUL = re.compile(r"주식회사|\(주\)|㈜|\(유\)|유한회사")
NOTES = re.compile(r"\((?:head office|본사|hq|branch)\)|\b(?:c/o|m/s|messrs)\.?(?=\s)", re.I)
TRADING = re.compile(r"\s+(?:t/a|d/b/a|dba|trading as|aka|a/k/a|formerly|ex)\s+", re.I)
UNIT = re.compile(r"\bno\.?\s*(\d+)\b|제\s*(\d+)|#\s*(\d+)|\s(\d+)(?=\s|$)", re.I)
_BRACKETS = re.compile(r"\(([^()]*)\)")
_CLEAN = re.compile(r"[^\w\s]|_")
_LOOKALIKE = str.maketrans("01358", "oiesb")


class Kinds(NamedTuple):
    """What tells the kind of business in a corpus."""

    phrases: tuple[tuple[str, ...], ...] = ()  #: words that a kind is written with, in Latin letters
    endings: tuple[tuple[str, str], ...] = ()  #: (ending of a Hangul name, code of its kind)
    words: tuple[tuple[str, str], ...] = ()  #: (other word, word of a phrase that it stands for)
    types: tuple[tuple[str, str], ...] = ()  #: (type of organisation, code of its kind)
    second: tuple[str, ...] = ()  #: codes of the second rank, which end trade names


def code_of(phrase: tuple[str, ...]) -> str:
    return "_".join(phrase)


class Reading(NamedTuple):
    words: tuple[str, ...]  #: words of the proper part, romanised
    kind: str  #: code of the kind of business, empty if unsaid
    unit: str  #: number of a numbered unit, empty if none
    hangul: bool

    @property
    def core(self) -> str:
        return "".join(self.words)


def romanise(text: str) -> str:
    out = []
    for c in text:
        i = ord(c) - 0xAC00
        out.append(LEADS[i // 588] + VOWELS[i % 588 // 28] + TAILS[i % 28] if 0 <= i < 11172 else c)
    return "".join(out)


def _plain(text: str) -> str:
    """Letters without accents; compatibility forms unified; Hangul kept whole."""
    text = unicodedata.normalize("NFKC", text)
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text.replace("ø", "o").replace("Ø", "O")) if not "̀" <= c <= "ͯ"))


def _in_order(word: str, full: str) -> bool:
    letters = iter(full)
    return all(c in letters for c in word)


def near(word: str, full: str) -> bool:
    """The word is the full one with a slip of one letter, cut short, or contracted."""
    if word == full:
        return True
    if len(word) >= 3 and len(word) < len(full) and word[0] == full[0]:
        if full.startswith(word) or full.startswith(word[:-1]) and len(word) >= 4 and word[-1] in full[len(word) - 1 :]:
            return True
        if not re.search("[aeiou]", word[1:]) and _in_order(word, full):
            return True
        if len(word) >= 5 and word[-1] == full[-1] and _in_order(word, full) and len(re.findall("[aeiou]", word)) < len(re.findall("[aeiou]", full)):
            return True
    if len(full) < 5 or abs(len(word) - len(full)) > 1:
        return False
    i = 0
    while i < min(len(word), len(full)) and word[i] == full[i]:
        i += 1
    return word[i + 1 :] == full[i + 1 :] or word[i:] == full[i + 1 :] or word[i + 1 :] == full[i:] or (word[i : i + 2] == full[i : i + 2][::-1] and word[i + 2 :] == full[i + 2 :])


class Reader:
    """Reads names with the kinds of one corpus."""

    def __init__(self, kinds: Kinds):
        self.phrases = kinds.phrases
        self.parts = tuple(dict.fromkeys(w for p in kinds.phrases for w in p))
        self.words = dict(kinds.words)
        self.endings = sorted(kinds.endings, key=lambda e: (-len(e[0]), e))
        self.parts_of = lru_cache(maxsize=200_000)(self._parts_of)

    def _parts_of(self, word: str) -> frozenset[str]:
        """Words of kinds that a typed word may be; most words of proper names are none."""
        if word in self.parts:
            return frozenset({word})
        if word in self.words:
            return frozenset({self.words[word]})
        return frozenset(p for p in self.parts if near(word, p))

    def kind(self, words: list[str]) -> tuple[str, list[str]]:
        """The kind of business that the words name, and the words without it."""
        joined: list[str] = []
        for w in words:  # "ship building"
            whole = next((p for p in self.parts if len(joined[-1]) > 2 and p.startswith(joined[-1]) and near(joined[-1] + w, p)), "") if joined else ""
            joined = [*joined[:-1], whole] if whole else [*joined, w]
        words = joined if len(joined) > 1 else words
        meant = [self.parts_of(w) for w in words]
        if not any(meant):
            return "", words
        best: tuple[tuple[int, int], str, list[int]] = ((0, 0), "", [])
        for phrase in self.phrases:
            used: list[int] = []
            for part in phrase:
                hit = next((i for i, w in enumerate(words) if i not in used and part in meant[i]), None)
                if hit is not None:
                    used.append(hit)
            exact = len(used)
            if exact and len(phrase) > 1:  # initials stand for the other words: "p authority", "o r inst"
                for part in phrase:
                    hit = next((i for i, w in enumerate(words) if i not in used and w == part[0] and any(abs(i - u) <= 2 for u in used)), None)
                    if hit is not None and len(used) < len(phrase):
                        used.append(hit)
            worth = (2 * len(used) + (len(phrase) == len(used)), sum(words[i] in phrase for i in used))
            if exact and (len(used) == len(phrase) or len(phrase) > 1 and exact >= len(phrase) - 1) and worth > best[0]:
                best = (worth, code_of(phrase), used)
        if best[1] and len(best[2]) < len(words):
            return best[1], [w for i, w in enumerate(words) if i not in best[2]]
        return "", words

    def hangul(self, text: str, unit: str) -> Reading:
        core, kind = re.sub(r"[^가-힣]", "", text), ""
        for ending, code in self.endings:
            if core.endswith(ending) and len(core) > len(ending):
                core, kind = core[: -len(ending)], code
                break
        return Reading((romanise(core),), kind, unit, True)

    def one(self, text: str) -> Reading | None:
        text, unit = number_of(text)
        if HANGUL.search(text):
            return self.hangul(text, unit)
        words = latin_words(text)
        if not words:
            return None
        kind, rest = self.kind(words)
        rest = [w for w in rest if w not in FILLERS] or rest
        return Reading(tuple(rest), kind, unit, False)

    def read(self, name: str | None) -> list[Reading]:
        """Readings of a name; none for null, blank and acronyms."""
        return [r for p in sides(name) if (r := self.one(p)) and r.core]


HANGUL = re.compile("[가-힣]")
_NG = re.compile(r"\b([A-Za-z]+)['’]g\b")


def number_of(text: str) -> tuple[str, str]:
    """The text without the number of a unit, and that number."""
    if m := UNIT.search(text):
        return text[: m.start()] + " " + text[m.end() :], str(int(next(g for g in m.groups() if g)))
    return text, ""


def latin_words(text: str) -> list[str]:
    """Lower-case words without legal forms; "ship'g" and "ship-building" are one word each."""
    text = _NG.sub(r"\1g", text)
    text = re.sub(r"\bco\.?\s*,\s*ltd\b", " coltd ", text, flags=re.I)
    words = [w.translate(_LOOKALIKE) if re.search("[a-z]", w) else w for w in _CLEAN.sub(" ", text).lower().split()]
    return [w for w in words if w not in LEGAL]


def acronym(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2,6}", text.strip()))


def sides(name: str | None) -> list[str]:
    """The names that a typed name holds: both sides of "trading as", and a full name in brackets; none for null, blank and acronyms."""
    if not name or not name.strip() or acronym(name):
        return []
    text = _plain(name)
    text = LEGAL_HANGUL.sub(" ", NOTES.sub(" ", text.replace("（", "(").replace("）", ")")))
    parts: list[str] = []
    for side in TRADING.split(f" {text} "):
        inside = [b for b in _BRACKETS.findall(side) if b.strip()]
        parts.append(_BRACKETS.sub(" ", side))
        if not HANGUL.search(side):  # beside Hangul, brackets hold its beginning in Latin letters
            parts += [b for b in inside if " " in b.strip()]
    return [p for p in parts if p.strip()]
