"""TeX text as a reader sees it: a sequence of plain words."""

from __future__ import annotations

import re
import unicodedata

_DEF = re.compile(
    r"\\(?:re|provide)?(?:newcommand|command|DeclareMathOperator|DeclareRobustCommand|def|gdef|edef)\*?\s*"
    r"(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*(?:\[(\d)\])?(?:\[[^\]]*\])?((?:#\d)*)\s*\{"
)
_BRACE = re.compile(r"(?<!\\)[{}]")
_HEADS = re.compile(r"^[ \t]*(?:%+[ \t]*)+", re.M)
_TAIL = re.compile(r"(?<!\\)%([^\n]*)(?:\n[ \t]*|\Z)")
#: Fixed: TeX's accents by sign and by letter, and its special letters.
_SIGN = re.compile(r"\{?\\[\"'`^~=.]\s*(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))\}?")
_LETTER = re.compile(r"\{?\\[cvuHkrdbt](?:\s*\{\s*\\?([A-Za-z])\s*\}|\s+([A-Za-z])(?![A-Za-z]))\}?")
_SPECIAL = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]*)\}?")
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ȷ": "j", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "\u00ad": None, "\u200b": None, "\u2010": "-", "\u2011": "-"})
_HIDDEN = re.compile(
    r"\\(?:[cC]ite\w*|(?:eq|page|auto|c|C)?ref|label|tag|input|include|includegraphics|index|bibliography|bibliographystyle|usepackage|documentclass|vspace|hspace|begin|end|color|textcolor|fontsize|url)\*?"
    r"(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}"
)
_TOUCHING = re.compile(r"\\[A-Za-z@]+\*?(?=\{)|\\[/!\-]")
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|.)", re.S)
_HYPHEN = re.compile(r"(?<=[^\W_])-[ \t]*\n?[ \t]*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def _closed(text: str, at: int) -> int:
    """The place after the brace that closes the one before ``at``; -1 if it stays open."""
    depth = 1
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


#: Characters that a text may at least grow to when its macros are written out, and how many times its own length.
MOST_CHARS, MOST_TIMES = 20_000_000, 64


def _endless(macros: dict[str, tuple[int, str]]) -> set[str]:
    """Macros that come to themselves again when they are written out."""
    uses = {k: {m for m in re.findall(r"\\([A-Za-z@]+)", body) if m in macros} for k, (_, body) in macros.items()}
    left = dict(uses)
    while free := [k for k, v in left.items() if not v & left.keys()]:
        for k in free:
            del left[k]
    # what is left reaches a circle; those in one come to themselves
    out = set()
    for k in left:
        seen, todo = set(), list(left[k] & left.keys())
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += left[m] & left.keys()
        if k in seen:
            out.add(k)
    return out


def expand_macros(text: str) -> str:
    """Own macros written out, however deep they lie in one another, and their definitions removed.

    A macro that is cut off or comes to itself again stays as it is. Only
    where the text would grow beyond ``MOST_CHARS`` and ``MOST_TIMES`` its
    length (a few macros that double each other do that), what is not yet
    written out stays.
    """
    macros: dict[str, tuple[int, str]] = {}
    parts, at = [], 0
    for m in _DEF.finditer(text):
        if m.start() < at:
            continue
        end = _closed(text, m.end())
        if end < 0:
            continue
        n = int(m[3]) if m[3] else len(m[4]) // 2
        macros[m[1] or m[2]] = (n, text[m.end() : end - 1])
        parts.append(text[at : m.start()])
        at = end
    for k in _endless(macros):
        del macros[k]
    if not macros:
        return "".join(parts) + text[at:] if parts else text
    text = "".join(parts) + text[at:]
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])")
    most = max(MOST_TIMES * len(text), MOST_CHARS)
    while len(text) <= most:
        out, at = [], 0
        for m in use.finditer(text):
            if m.start() < at:
                continue
            n, body = macros[m[1]]
            end, args = m.end(), []
            for _ in range(n):
                skip = len(text[end:]) - len(text[end:].lstrip(" \t\n"))
                if not text.startswith("{", end + skip):
                    break
                close = _closed(text, end + skip + 1)
                if close < 0:
                    break
                args.append(text[end + skip + 1 : close - 1])
                end = close
            for k, a in enumerate(args, 1):
                body = body.replace(f"#{k}", a)
            if not n and end < len(text) and text[end] in " \t\n":
                # TeX takes the blank after a command's name
                end += 1
            out += [text[at : m.start()], body]
            at = end
        if not out:
            break
        text = "".join(out) + text[at:]
    return text


def reader_text(text: str) -> str:
    """Text without markup; commented-out lines are kept in place, remarks behind a line's text are put to the end."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\\" in text:
        if "command" in text or "\\def" in text or "Operator" in text:
            text = expand_macros(text)
    if "%" in text:
        text = _HEADS.sub("", text)
        remarks: list[str] = []

        def cut(m: re.Match[str]) -> str:
            remarks.append(m[1])
            return ""

        text = _TAIL.sub(cut, text)
        if remarks:
            text += "\n\n" + "\n".join(remarks)
    if "\\" in text:
        text = _SIGN.sub(lambda m: m[1] or m[2], text)
        text = _LETTER.sub(lambda m: m[1] or m[2], text)
        text = _SPECIAL.sub(lambda m: m[1], text)
        text = _HIDDEN.sub(" ", text)
        text = _TOUCHING.sub("", text)
        text = _COMMAND.sub(" ", text)
    return text.replace("{", "").replace("}", "").replace("$", "")


def words(text: str) -> list[str]:
    """The words of a text; markup, case, accents, punctuation, hyphens and line ends make no difference."""
    text = reader_text(text).lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
        text = "".join([c for c in text if not unicodedata.combining(c)])
    if "-" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text)
