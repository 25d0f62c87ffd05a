"""Word sequences that survive changes of case, spacing, punctuation, markup and character form."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look Latin.
_LOOKALIKE = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
        "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
        "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ß": "ss",
    }
)
_FOREIGN = re.compile(r"[Ͱ-ӿԀ-ԯıɑɡℓß]")
_HIDDEN = re.compile(r"[­​-‏⁠-⁤﻿͏᠎]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\r?\n\s*(?:[>|*#/]+\s*)?(?=[^\W\d_])")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
_MARKUP = re.compile(r"(?<=\w)(?:[*`~]+|__+)(?=\w)")
_COMMA = re.compile(r"(?<=\d)[,' ](?=\d{3}\b)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case words and numbers of a text, with entities, tags, invisible and look-alike characters undone."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKE)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    if "*" in text or "_" in text or "`" in text:
        text = _MARKUP.sub("", text)
    if "," in text:
        text = _COMMA.sub("", text)
    return _WORD.findall(text.lower())
