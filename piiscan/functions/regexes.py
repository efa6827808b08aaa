"""Regular-expression dialect: patterns are written in Python ``re`` syntax and run on the JVM.

Python's ``str`` patterns are Unicode aware in a way no Java flag reproduces exactly (Java's ``(?U)``
counts combining marks as word characters, and its ``\\s`` lacks U+001C..U+001F), so the four
shorthands are spelled out.
"""

from __future__ import annotations

# What \w, \d and \s mean for Python str patterns.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BOUNDARY = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

#: A text contains a visible character (Python's ``text.strip()`` is not empty).
NON_BLANK = rf"[^{SPACE}]"

#: Separators ignored when comparing with known test values.
SEPARATORS = rf"[-.()\s]".replace(r"\s", SPACE)


def jvm_regex(python_pattern: str, ignore_case: bool = False, first: str | None = None) -> str:
    """Translate a Python ``str`` pattern for ``java.util.regex``.

    ``first`` is the class of characters a match can start with. It adds a look-ahead that never
    changes the result but rejects most positions with one test before the boundary check.
    """
    out, in_class, i = [], False, 0
    while i < len(python_pattern):
        char = python_pattern[i]
        if char == "\\":
            token = python_pattern[i : i + 2]
            out.append(_shorthand(token, in_class))
            i += 2
            continue
        if char == "[" and not in_class:
            in_class = True
        elif char == "]" and in_class:
            in_class = False
        out.append(char)
        i += 1
    head = "(?iu)" if ignore_case else ""
    gate = f"(?={jvm_regex(first)})" if first else ""
    return head + gate + "".join(out)


def _shorthand(token: str, in_class: bool) -> str:
    if token == r"\b" and not in_class:
        return BOUNDARY
    expansion = {r"\d": DIGIT, r"\s": SPACE, r"\w": WORD}.get(token)
    if expansion is None:
        return token
    return expansion if in_class else f"[{expansion}]"
