"""Quality rules, line first.

Every line is judged on its own by punctuation, navigation and boilerplate
rules; lines that fail are removed, and a document that loses too much of its
text that way is rejected.  Whole-document base counts reject before that:
too few words, or too many words in repeated windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import WordHashes, named, windows, with_columns_of, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected if the lines kept hold less than this share of its word characters.
MIN_KEPT = 0.5

# Phrases of page furniture, lower case, in English, French, German and Spanish.
BOILERPLATE_PHRASES = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of (?:use|service)", "uses cookies", "accept cookies", "enable javascript", "javascript is (?:disabled|required)",
    "click here", "read more", "sign (?:in|up)\\b", "log ?in\\b", "subscribe (?:now|to)", "share (?:this|on)", "skip to (?:main )?content", "back to top", "lorem ipsum",
    "tous droits réservés", "politique de (?:confidentialité|cookies)", "mentions légales", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "lire la suite", "se connecter", "haut de page",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "cookies (?:akzeptieren|zulassen)", "hier klicken", "weiterlesen", "jetzt anmelden", "nach oben",
    "todos los derechos reservados", "política de (?:privacidad|cookies)", "aviso legal", "términos (?:de uso|y condiciones)", "aceptar (?:las )?cookies", "haga clic aquí", "leer más", "iniciar sesión", "volver arriba",
]
BOILERPLATE = re.compile("|".join(BOILERPLATE_PHRASES))
#: Characters that separate entries of a menu, and words that do.
BARS, BAR_WORDS = "|»›•·→", (b"/", b">")
_BARS = re.compile(f"[{BARS}]")
SHOUT = r"(?:[!?#$%&*@~^=+]{2,}|[#$%&*])[.,;:]?$"
TERMINAL = r"[.!?…:;][\"'”’»)\]]*$"
_SHOUT, _TERMINAL = re.compile(SHOUT.encode()), re.compile(TERMINAL)
_LETTER = re.compile(r"[^\W\d_]")

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("n_removed_lines", T.LongType()),
    T.StructField("clean_text", T.StringType()),
]


def line_fault(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line (with at least one word) breaks, or None.

    ``symbols``: no letter at all, or half of four words and more end in a run of
    marks.  ``navigation``: a separator (a character of BARS or a word of
    BAR_WORDS) for every three words, two at least; or fewer than four words
    without sentence end.  ``boilerplate``: at most 25 words with a phrase of
    page furniture.
    """
    n = len(words)
    if not _LETTER.search(line):
        return "symbols"
    if n >= 4 and 2 * sum(1 for w in words if _SHOUT.search(w)) >= n:
        return "symbols"
    bars = len(_BARS.findall(line)) + sum(w in BAR_WORDS for w in words)
    if bars >= 2 and 3 * bars >= n - bars:
        return "navigation"
    if n < 4 and not _TERMINAL.search(words[-1].decode("utf-8", "replace")):
        return "navigation"
    if n <= 25 and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str, hashes: WordHashes) -> tuple:
    """The values of FIELDS for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\v\f\r")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = text.split("\n")
    split = [words_of(x) for x in lines]
    full = [x for x, w in zip(lines, split, strict=True) if w]
    dup = len(full) - len(set(full))
    repeat = 0
    if n >= WINDOW:
        _, where, times = np.unique(windows(hashes.of(words), WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[where] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge)[:n]))
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    good = [not w or line_fault(x, w) is None for x, w in zip(lines, split, strict=True)]
    clean = "\n".join(x for x, g in zip(lines, good, strict=True) if g)
    left = sum(len(w.decode("utf-8", "surrogatepass")) for ws, g in zip(split, good, strict=True) if g for w in ws) if not all(good) else chars
    kept = not failed and left >= MIN_KEPT * chars
    return n, chars, symbols, dup, repeat, failed, kept, len(good) - sum(good), clean


def apply_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, clean: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all but those named like a result) and the columns of FIELDS.

    ``clean_text`` is the text without the lines that failed; it is left out
    unless ``clean``.  Null texts count as empty: no words, so they fail.  Row
    by row, no shuffle; repeated rows are judged alike, an empty table gives an
    empty result.
    """
    fields = FIELDS if clean else FIELDS[:-1]

    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> list[pa.Array]:
            columns = list(zip(*(judge(t, hashes)[: len(fields)] for t in texts), strict=True)) or [[]] * len(fields)
            kinds = ([pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()])[: len(fields)]
            return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

        return work

    return with_columns_of(docs, text_col, fields, make, keep)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, without the lines that failed."""
    marked = [T.StructField("__rules_kept__", T.BooleanType()), T.StructField("__clean__", T.StringType())]

    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> list[pa.Array]:
            verdicts = [judge(t, hashes) for t in texts]
            return [pa.array([v[6] for v in verdicts], pa.bool_()), pa.array([v[8] if v[6] else None for v in verdicts], pa.string())]

        return work

    out = with_columns_of(docs, text_col, marked, make, [c for c in docs.columns if c != text_col]).where(F.col("__rules_kept__"))
    return out.select(*((F.col("__clean__").alias(c) if c == text_col else named(c)) for c in docs.columns))
