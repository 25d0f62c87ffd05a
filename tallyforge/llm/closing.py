"""How a text closes: pure functions on one text, used by the truncation operator.

``closing_state`` sorts a text's end into

* ``DONE``  - it certainly reaches its end (terminal punctuation, closed delimiters, a bare option letter),
* ``CUT``   - it certainly does not (a mark left for the rest, a broken character, an open delimiter, a
  dangling comma or operator, a prose line without an end),
* ``WORD``  - a list entry, option or unpunctuated line: complete if its closing word can close a phrase,
* ``KEY``   - a bare ending of running text: complete only if this closing is an established formula,
* ``ELL``   - ends in an ellipsis, which may be a mark of a cut or the author's own.

The last three are settled with statistics over all texts (see ``truncation``).
"""

from __future__ import annotations

import re

DONE, CUT, WORD, KEY, ELL = 0, 1, 2, 3, 4

#: Invisible characters at either end of a stored text.
INVISIBLE = "﻿​‌‍⁠­"
_TRIM = " \t\r\n\f\v   　" + INVISIBLE

#: Marks that storage leaves in place of the rest.
_MARK = re.compile(
    r"(?:\.\.\.|…)?\s*[\[(<{]\s*(?:\.\.\.|…|cut|cut off|truncated|trunc|snip|snipped|more|continued|cont\.?|output truncated|text truncated"
    r"|(?:\.\.\.|…|\+)?\s*\+?\d+\s*(?:more\s*)?(?:chars?|characters?|bytes?|tokens?|words?|lines?)?(?:\s+(?:more|omitted|truncated|left))?)\s*[\])>}]$",
    re.IGNORECASE,
)
_MARK_NEEDS = re.compile(r"cut|trunc|snip|more|cont|char|byte|token|word|line|\.\.\.|…|\+", re.IGNORECASE)
_TOKEN = re.compile(r"\n+|[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*|#+|[^\w\s]")
#: Lines that end in a colon and are whole.
_LABEL = re.compile(
    r"^\W*(?:final\s+)?(?:answer|solution|problem|question|response|prompt|respuesta|solución|pregunta|problema|réponse|antwort|lösung|resposta)\s*:\W*$",
    re.IGNORECASE,
)
#: Openings of an answer that is one option.
_OPTION = re.compile(
    r"^\W*(?:(?:the|my|final|correct)\s+)*(?:answer|option|choice|la respuesta|respuesta)?\s*(?:is|es)?\s*:?\s*\(?([A-Ea-e])\s*(?:[).:]\s*(.*)|\W*)$",
    re.IGNORECASE | re.DOTALL,
)
_OPTION_LINE = re.compile(r"^\s*(?:>\s*)?\(?[A-Ea-e]\)\s+(.*\S)\s*$")
_INLINE_OPTION = re.compile(r"\s\(?([B-Eb-e])\)\s+[^()\n]{1,80}$")
_LIST_LINE = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+(.*\S)\s*$")
_ANSWER_LINE = re.compile(r"^\s*(?:#{2,}\s*)?\$?\s*-?[\d.,/]+\s*%?\$?\s*$")
_LAST_WORD = re.compile(r"([^\W\d_]+(?:['’\-][^\W\d_]+)*)\W*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_STOPS = ".?!。？！؟।"
_ENTRY_NUMBER = re.compile(r"(?:(\n)\s*|[.?!:]\s+)\d{1,2}\.$")
_RESULT = re.compile(r"(?:#{2,}|\bis|\bes|[:=])\s*\$?(\d+)$", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")


def closing_key(text: str) -> str:
    """The last three tokens in a form that recurs: numbers as 0, a closing capitalised word as <C>."""
    tokens = _TOKEN.findall(text[-40:])[-3:]
    if len(tokens) < 3 or len("".join(tokens)) > 36:
        tokens = _TOKEN.findall(text[-160:])[-3:]
    return " ".join(_plain(tokens))


def _plain(tokens: list[str]) -> list[str]:
    out = []
    for k, token in enumerate(tokens):
        if token[0] == "\n":
            out.append("\\n")
        elif token[0].isdigit():
            out.append("0")
        elif k == len(tokens) - 1 and token[0].isupper() and token[1:].islower():
            out.append("<C>")
        else:
            out.append(token.lower())
    return out


def last_word(text: str) -> str:
    found = _LAST_WORD.search(text[-80:])
    return found.group(1).lower() if found else ""


def _phrase(text: str) -> tuple[int, str, str]:
    """WORD for a phrase with a last word, DONE for one that ends in a number or closed bracket."""
    word = last_word(text) if text[-1].isalpha() else ""
    return (WORD, "", word) if word else (KEY, closing_key(text), "")


def number_cut(text: str) -> bool:
    """The closing result is a strict prefix of the number worked out just before: ``= 1323 ... #### 13``."""
    found = _RESULT.search(text[-40:])
    if not found:
        return False
    own = found.group(1)
    before = _NUMBER.findall(text[max(0, len(text) - 240) : len(text) - len(found.group(0))])
    if own in before[-3:]:
        return False
    return any(len(b) > len(own) and b.startswith(own) for b in before[-2:])


def closing_state(text: str | None) -> tuple[int, str, str]:
    """(state, closing key, closing word) of one text; null and blank texts are DONE."""
    if text is None:
        return DONE, "", ""
    s = text.rstrip(_TRIM)
    if not s.strip(_TRIM):
        return DONE, "", ""
    last = s[-1]
    if last == "�" or 0xD800 <= ord(last) <= 0xDFFF:
        return CUT, "", ""
    if last in "])>}":
        mark = _MARK.search(s[-60:])
        if mark and _MARK_NEEDS.search(mark.group(0)):
            return CUT, "", ""
    if last == "…" or s.endswith("..."):
        rest = s[: -1 if last == "…" else -3].rstrip(_TRIM + "." + "…")
        if not rest:
            return DONE, "", ""
        if rest[-1] in _STOPS:
            return DONE, "", ""
        return ELL, closing_key(rest).replace("<C>", rest.split()[-1].lower()), last_word(rest)
    line = s[s.rfind("\n") + 1 :]
    stripped = line.strip(_TRIM)
    if last in _STOPS:
        if last == "." and s[-2:-1].isdigit():
            number = _ENTRY_NUMBER.search(s[-16:])
            if number and (number.group(1) == "\n" or re.search(r"(?:^|\s)1\. \w", s)):
                return CUT, "", ""  # the number of a list entry that is gone
        return DONE, "", ""
    option = _OPTION.match(s) if len(s) < 120 else None
    if option:
        rest = (option.group(2) or "").strip(_TRIM)
        return _phrase(rest) if rest and rest[-1].isalpha() else (DONE, "", "")
    if last == "#":
        return (DONE, "", "") if s.endswith("####") and not s.endswith("#####") else (CUT, "", "")
    if last in ",;=+(<[{\\/&|^@%~–—¿¡:×÷±−·→≤≥≈≠":
        return (DONE, "", "") if last == ":" and _LABEL.match(stripped) or len(s) < 4 else (CUT, "", "")
    if last == "$":
        opening = re.match(r"^(?:#{2,}\s*)?(\$+)", stripped)
        closing = re.search(r"(\$+)$", stripped)
        whole = opening and len(opening.group(1)) == len(closing.group(1)) and len(stripped) > len(opening.group(0)) + len(closing.group(1)) - 1 and opening.end() <= closing.start()
        return (DONE if whole and stripped.count("{") == stripped.count("}") else CUT), "", ""
    if last == "}":
        if len(s) < 12:
            return DONE, "", ""
        whole = re.match(r"^(?:#{2,}\s*)?\\boxed\{", stripped) or stripped[0] in "{["
        return (DONE if whole and stripped.count("{") == stripped.count("}") else CUT), "", ""
    if last == "`":
        if not s.endswith("```"):
            return (DONE if stripped.count("`") % 2 == 0 and stripped != s else CUT), "", ""
        lines = s.split("\n")
        if s.count("```") % 2 == 0 or len(lines) < 2 or _ANSWER_LINE.match(lines[-2]):
            return DONE, "", ""
        return CUT, "", ""
    if last in "*_":
        run = re.search(r"[*_]+$", s).group(0)
        whole = len(s) <= len(run) + 1 or s.count(run) % 2 == 0 and not s[-len(run) - 1].isspace()
        return (DONE if whole else CUT), "", ""
    if last in "\"'”’»」』":
        inner = s[:-1].rstrip(_TRIM)
        if not inner or inner[-1] in _STOPS + "…" or s.lstrip(_TRIM)[0] in "\"'“‘«「『" or len(s) < 6:
            return DONE, "", ""
        return CUT, "", ""
    if last in ")]>-":
        if len(s) < 8 or last != "-" and re.match(r"^\s*[\[(<]", line):
            return DONE, "", ""
        inner = s[:-1].rstrip(_TRIM)
        return (DONE if last == ")" and inner and inner[-1] in _STOPS else CUT), "", ""
    if last.isdigit():
        return (CUT, "", "") if number_cut(s) else (KEY, closing_key(s), "")
    if not last.isalpha():
        return DONE, "", ""  # a symbol such as an emoji
    if len(s) <= 4 and "\n" not in s and s.lower() in ("n/a", "na", "none", "null", "nil", "no", "yes", "sí"):
        return DONE, "", ""
    if s.lower() in ("n/a", "none", "null", "nil", "empty", "undefined", "nan"):
        return DONE, "", ""
    if _CJK.search(last):
        return CUT, "", ""
    entry = _OPTION_LINE.match(line) or _LIST_LINE.match(line)
    if entry and len(entry.group(1).split()) <= 8:
        before = [x.rstrip(_TRIM) for x in s.split("\n")[:-1]]
        kin = [x for x in before if x and (_OPTION_LINE.match(x) or _LIST_LINE.match(x)) and x.lstrip()[0].isalnum() == stripped[0].isalnum()]
        if any(x[-1].isalnum() for x in kin) or not kin and not stripped[0].isdigit():
            return WORD, "", last_word(s)
    inline = _INLINE_OPTION.search(s[-100:])
    if inline and chr(ord(inline.group(1)) - 1) + ")" in s:
        return WORD, "", last_word(s)  # options in one line
    if len(s) > 15 and not re.search(r"[.?!,;:]", s):
        return WORD, "", last_word(s)  # a text stripped of all its punctuation
    return KEY, closing_key(s), last_word(s)
