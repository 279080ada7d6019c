"""Characters of parsed patterns, and edges of words, as the JVM is told of them."""

from __future__ import annotations

import re

#: ASCII letters, digits and the underscore; where a word of these begins or ends, and where none does.
WORD_CHARS = set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
WORD_EDGE, NO_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def chars_of(items) -> set[str]:
    """The ASCII characters of a parsed class."""
    text = re.compile(class_of(items), re.ASCII)
    return {chr(c) for c in range(128) if text.fullmatch(chr(c))}


def class_of(items) -> str:
    """A character class of parsed items."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            out += "^"
        elif name == "LITERAL":
            out += re.escape(chr(arg))
        elif name == "RANGE":
            out += re.escape(chr(arg[0])) + "-" + re.escape(chr(arg[1]))
        else:
            out += {"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_NOT_SPACE": r"\S"}[str(arg)]
    return f"[{out}]"
