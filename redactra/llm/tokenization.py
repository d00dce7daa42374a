"""Token ids by the tokenizers library, each distinct word encoded once.

A text is cut at single spaces and newlines into units.  Both kinds of public
tokenizer used here split there anyway, so the ids of a text are those of its
units in a row, and a unit seen before costs a dictionary lookup.  A new unit
made of letters with punctuation behind goes to the library's model directly;
other new units, and whole texts with runs of white space (where a cut might
matter), go through the library's full encoder.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Entries of each of a worker's two caches; a full cache is emptied (no result changes).
CACHE_UNITS = 600_000

#: Letters, then a run of ASCII punctuation.  str.isalpha() on the first part makes it exact.
_SIMPLE = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")

_tokenizers: dict = {}


def public_path(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, n = {}, 256
    for byte in range(256):
        table[byte] = chr(byte) if byte in visible else chr(n)
        n += byte not in visible
    return table


_STAND_IN = _byte_letters()


class UnitEncoder(dict):
    """From a unit to its ids; ``spaced``: the vocabulary keeps white space (byte-level), else it drops it.

    ``special``: whether the strings of control tokens become control ids.  By
    default they are ordinary text, as the vocabularies' description has it: a
    document must not be able to end itself.  Else a text that holds one goes
    through the library whole.
    """

    def __init__(self, path: str, spaced: bool, special: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.control = re.compile("|".join(map(re.escape, control)), re.IGNORECASE) if control else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.parts: dict[str, bytes] = {}
        self.lead = self._raw("\n") if spaced else b""

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a piece that the tokenizer's own splitter would leave whole."""
        found = self.parts.get(part)
        if found is None:
            letters = "".join(map(_STAND_IN.__getitem__, part.encode("utf-8")))
            found = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if len(self.parts) >= CACHE_UNITS:
                self.parts.clear()
            self.parts[part] = found
        return found

    def _spaced(self, unit: str) -> bytes | None:
        line = unit[:1] == "\n"
        body = unit[1:] if line else unit
        if (m := _SIMPLE.fullmatch(body)) and (word := m[1]).isalpha():
            ids = self.lead + self._part(word) if line else self._part(" " + word)
            return ids + self._part(m[2]) if m[2] else ids
        if not body or body[0].isspace() or body[-1].isspace():
            return None  # its ids depend on its neighbours
        return self._raw(unit if line else " " + unit)

    def _plain(self, unit: str) -> bytes:
        if (m := _SIMPLE.fullmatch(unit)) and (word := m[1]).isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            lower = word.lower()
            if lower.isalpha() and unicodedata.is_normalized("NFC", lower):
                ids = self._part(lower)
                return ids + self._part(m[2]) if m[2] else ids
        return self._raw(unit)

    def __missing__(self, unit: str) -> bytes | None:
        ids = self._spaced(unit) if self.spaced else self._plain(unit)
        self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.control is not None and self.control.search(text):
            return self._raw(text)
        if len(self) > CACHE_UNITS:
            self.clear()
        get = self.__getitem__
        if not self.spaced:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        try:
            return b"".join(map(get, ("\n" + text).replace("\n", " \n")[1:].split(" ")))[len(self.lead) :]
        except TypeError:  # a unit that depends on its neighbours
            return self._raw(text)


def encoder(path: str, spaced: bool, special: bool = False) -> UnitEncoder:
    """The worker's encoder for this file; it outlives the task, and so does what it knows."""
    key = (path, spaced, special)
    if key not in _tokenizers:
        _tokenizers[key] = UnitEncoder(path, spaced, special)
    return _tokenizers[key]
