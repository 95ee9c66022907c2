"""Give linear-time-engine regex patterns the same meaning in Java's regex engine.

Differences that matter here: ``\\b`` and ``\\s`` are ASCII-only in the patterns' own
dialect, ``$`` means the very end, ``.`` excludes only the newline, and case folding
covers Unicode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

WORD = "0-9A-Za-z_"
WORD_END = f"(?![{WORD}])"     # a \b right after a word character
# A digit that starts a word. The digit comes first, as the cheaper test at each position.
DIGIT_START = rf"\d(?<![{WORD}]\d)"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NOT_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"

_OUTSIDE_CLASS = {r"\b": BOUNDARY, r"\B": NOT_BOUNDARY, r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}
_INSIDE_CLASS = {r"\s": r"\t\n\f\r ", "[": r"\[", "&&": r"\&\&"}
# Named ASCII classes whose Java name is not just the capitalised one.
_NAMED = {"ascii": "{ASCII}", "xdigit": "{XDigit}"}


def _in_class(m: re.Match) -> str:
    if not m[1]:
        return _INSIDE_CLASS.get(m[0], m[0])
    negated, name = m[1].startswith("^"), m[1].lstrip("^")
    if name == "word":
        return r"\W" if negated else r"\w"
    return (r"\P" if negated else r"\p") + _NAMED.get(name, f"{{{name.capitalize()}}}")


def _class(text: str) -> str:
    """A bracketed class. Java reads an inner bracket as a nested class and && as an
    intersection; both are plain characters here."""
    head = re.match(r"\[\^?", text)[0]
    body = text[len(head):-1]
    if body.startswith("]"):
        head, body = head + r"\]", body[1:]
    return head + re.sub(r"\\.|\[:(\^?\w+):\]|\[|&&", _in_class, body) + "]"


def java_regex(pattern: str) -> str:
    """Rewrite a user pattern so that Spark's ``rlike``/``regexp_replace`` read it as meant."""
    # In "(?m)" mode ^ and $ keep their line meaning.
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    parts = re.split(r"(\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\])", pattern)
    out = []
    for i, part in enumerate(parts):
        if i % 2:  # a character class
            out.append(_class(part))
            continue
        part = re.sub(
            r"\\.|\$",
            lambda m: (m[0] if multiline else r"\z") if m[0] == "$" else _OUTSIDE_CLASS.get(m[0], m[0]),
            part)
        part = part.replace("(?P<", "(?<")
        out.append(re.sub(r"\(\?([a-zA-Z]*)i", r"(?\1iu", part))
    return "(?d)" + "".join(out)


def quote(text: str) -> str:
    """Literal text as a pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def java_replacement(template: str, pattern: str) -> str:
    """Rewrite a ``$1`` / ``${name}`` replacement template for Java."""
    groups = re.compile(re.sub(r"\(\?<(?=\w)", "(?P<", pattern))

    def ref(m: re.Match) -> str:
        name = m[1] or m[2]
        if name.isdigit():
            return f"${name}" if int(name) <= groups.groups else ""
        return f"${{{name}}}" if name in groups.groupindex else ""

    out, last = [], 0
    for m in re.finditer(r"\$\$|\$(?:\{(\w+)\}|(\w+))", template):
        out.append(template[last:m.start()].replace("\\", "\\\\").replace("$", "\\$"))
        out.append("\\$" if m[0] == "$$" else ref(m))
        last = m.end()
    out.append(template[last:].replace("\\", "\\\\").replace("$", "\\$"))
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern is found anywhere in the text."""
    return text.rlike(java_regex(pattern))
