"""Lexicons of phrases and the patterns that find them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TR_WORD

NAMES = ("finance", "company", "up", "down", "risk", "legal", "rating", "boilerplate")

#: Endings that the simple stemmer removes, in the order in which they are tried.
SUFFIXES = (
    "lerinden", "larindan", "lerine", "larina", "lerini", "larini", "lerinde", "larinda", "lerden", "lardan", "lerde", "larda", "lerin",
    "larin", "leri", "lari", "ler", "lar", "inden", "indan", "ine", "ina", "ini", "inde", "inda", "den", "dan", "de", "da", "in", "i", "ı",
    "u", "ü", "e", "a", "miş", "mis", "muş", "mus", "mış", "ti", "tı", "tu", "tü", "di", "dı", "du", "dü", "li", "lı", "lu", "lü", "ki",
)

#: A small lexicon to begin with; jobs bring their own.
STARTER = {
    "finance": ("gelir", "kâr", "hisse", "borç", "faiz", "bilanço", "yatırım", "piyasa"),
    "company": (),
    "up": ("arttı", "yükseldi", "büyüdü", "güçlendi"),
    "down": ("azaldı", "düştü", "geriledi", "zayıfladı"),
    "risk": ("beklenti", "öngörü", "risk", "tahmin"),
    "legal": ("mahkeme", "dava", "yönetmelik", "soruşturma"),
    "rating": ("not artırımı", "not indirimi", "görünüm", "tavsiye"),
    "boilerplate": ("tüm hakları saklıdır", "abone ol"),
}


def read_lexicon(path: str) -> list[str]:
    """Phrases of a file, one a line, longest first; blank lines and # comments don't count and
    a missing file is empty."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        lines = (line.strip() for line in f)
        return sorted((x for x in lines if x and not x.startswith("#")), key=len, reverse=True)


def write_starter(folder: str) -> None:
    """Puts a file for each lexicon into the folder; files that are there stay as they are."""
    os.makedirs(folder, exist_ok=True)
    for name in NAMES:
        path = os.path.join(folder, f"{name}.txt")
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(f"# {name}: one phrase a line\n" + "".join(f"{p}\n" for p in STARTER[name]))


def simple_stem(word: str) -> str:
    """The word without the first listed ending that leaves more than two characters."""
    word = word.lower().strip()
    if len(word) < 3:
        return word
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)


def normalize_word(word: str) -> str:
    return word.lower().strip().replace("ı", "i")


def phrase_pattern(phrases: Iterable[str], word: str = TR_WORD, stem: Callable[[str], str] | None = None) -> str | None:
    """A pattern (the part between flags) of the phrases between characters that are no word
    characters; single words may add their stem and plain form.  None without phrases."""
    forms: set[str] = set()
    for p in phrases:
        forms.add(p.lower())
        if stem and " " not in p.strip():
            forms |= {x for x in (stem(p), normalize_word(p)) if x}
    if not forms:
        return None
    ordered = sorted(forms, key=lambda x: (-len(x), x))
    return rf"(^|[^{word}])({'|'.join(map(re.escape, ordered))})([^{word}]|$)"


def matches(x: Column, pattern: str | None) -> Column:
    """Whether the padded text holds a phrase; without a pattern, never."""
    return F.lit(False) if pattern is None else F.concat(F.lit(" "), x, F.lit(" ")).rlike(f"(?iuU){pattern}")


@dataclass(frozen=True)
class Lexicons:
    """The phrase lists of a curation job and how their patterns are built."""

    finance: tuple[str, ...] = ()
    company: tuple[str, ...] = ()
    up: tuple[str, ...] = ()
    down: tuple[str, ...] = ()
    risk: tuple[str, ...] = ()
    legal: tuple[str, ...] = ()
    rating: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    word: str = TR_WORD
    stem: Callable[[str], str] | None = field(default=None, compare=False)
    money: str | None = None  # another pattern for the number flag
    period: str | None = None

    @classmethod
    def from_folder(cls, folder: str, **more) -> Lexicons:
        return cls(**{n: tuple(read_lexicon(os.path.join(folder, f"{n}.txt"))) for n in NAMES}, **more)

    def pattern(self, name: str) -> str | None:
        return phrase_pattern(getattr(self, name), self.word, self.stem)
