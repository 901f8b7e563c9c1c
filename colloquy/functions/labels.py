"""Which entry of a speaker table a written label stands for.

In order: the entry's id, its display name, the name with the last word first, the first name alone, and a label with the number
of the id; all without regard to case, spacing and punctuation. Where several entries fit equally, the first in the table.
"""

from __future__ import annotations

import re
import unicodedata

# Words that come before the number of a speaker.
NUMBERED = frozenset({"", "s", "sp", "spk", "spkr", "speaker", "person", "participant", "voice", "sprecher", "locuteur", "hablante"})
_NUMBER = re.compile(r"([^\W\d_]*)[\W_]*0*(\d+)")


def plain(label: str | None) -> str:
    """Letters and digits of a label, in one case."""
    return "".join(c for c in unicodedata.normalize("NFKC", label or "").casefold() if c.isalnum())


def number(label: str | None) -> int | None:
    m = _NUMBER.fullmatch(unicodedata.normalize("NFKC", label or "").casefold().strip().strip("[]<>(){}#.:"))
    return int(m[2]) if m and m[1] in NUMBERED else None


def entry_forms(own: str | None, name: str | None) -> list[str]:
    """The texts that an entry stands under, in order of rank, '' where it has none: id, name, last name first, first name alone."""
    words = [w for w in re.split(r"[\s,]+", name or "") if plain(w)]
    if not words:
        return [plain(own), "", "", ""]
    return [plain(own), plain(name), plain(words[-1]) + "".join(map(plain, words[:-1])), plain(words[0])]


def entry_keys(own: str | None, name: str | None) -> list[str | int]:
    """Every key, a text or a number, under which labels find an entry."""
    n = number(own)
    return [f for f in entry_forms(own, name) if f] + ([n] if n is not None else [])


def label_keys(label: str) -> list[str | int]:
    """The keys that a label refers to; a label without letters and digits has one that nothing stands under."""
    key = plain(label)
    n = number(label) if key else None
    return [key, *([n] if n is not None else [])]


class SpeakerTable:
    def __init__(self, entries: list[tuple[str | None, str | None]] | None):
        by_text: tuple[dict, ...] = ({}, {}, {}, {})
        numbers: dict[int, str] = {}
        for own, name in entries or []:
            value = own if own is not None else ""
            for known, form in zip(by_text, entry_forms(own, name)):
                if form:
                    known.setdefault(form, value)
            if (n := number(own)) is not None:
                numbers.setdefault(n, value)
        self.by_text, self.by_number = by_text, numbers

    def find(self, label: str | None) -> str | None:
        """The id of the entry, or None."""
        key = plain(label)
        if not key:
            return None
        for known in self.by_text:
            if key in known:
                return known[key]
        n = number(label)
        return self.by_number.get(n) if n is not None else None
