"""Search queries as text: literals, /regular expressions/ and two-term proximity."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

try:
    from re import _constants as _ops
    from re import _parser
except ImportError:  # older interpreters
    import sre_constants as _ops
    import sre_parse as _parser

FLAGS = {"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}
COMPOUND = {"NEAR": "near", "NOT": "not"}
#: A slash, a body in which a backslash takes the next character along, the last slash left, and letters.
_EXPRESSION = re.compile(r"/((?:[^\\]|\\.)*)/([^/]*)", re.DOTALL)
_TERMS = re.compile(r"\s*(\S+)\s+(" + "|".join(COMPOUND) + r")\s+(\S+)\s*")


class QueryError(ValueError):
    """A query that cannot be run; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Query:
    """``mode`` is literal, regex, near or not."""

    mode: str
    literal: str
    pattern: str | None = None
    flags: int = 0
    anchor: str | None = None
    right: str | None = None


def is_escaped(text: str, at: int) -> bool:
    """Whether the backslashes before a place leave one over for it."""
    return re.search(r"(?<!\\)(?:\\\\)*\\\Z", text[:at]) is not None


def anchor(pattern: str, flags: int = 0) -> str | None:
    """The longest literal run, of two characters or more, that every match holds.

    Read from the parsed expression: only characters outside groups,
    alternatives and repetitions count, so a row without the run has no match.
    An expression that ignores case, by a letter or by itself, has none.
    """
    if re.compile(pattern, flags).flags & re.IGNORECASE:
        return None
    runs, run = [], ""
    for op, value in _parser.parse(pattern, flags):
        if op is _ops.LITERAL:
            run += chr(value)
        elif op is _ops.MAX_REPEAT or op is _ops.MIN_REPEAT:
            least, _, inner = value
            if least >= 1 and len(inner) == 1 and inner[0][0] is _ops.LITERAL:
                run += chr(inner[0][1])  # the first of its repeats follows the run
            runs.append(run)
            run = ""
        else:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len)
    return best if len(best) >= 2 else None


def _expression(text: str) -> Query:
    """A query that begins with a slash."""
    found = _EXPRESSION.fullmatch(text)
    if found is None:
        raise QueryError("invalid_regex", "no closing slash")
    pattern, letters = found.groups()
    unknown = "".join(sorted(set(letters).difference(FLAGS)))
    if unknown:
        raise QueryError("invalid_regex", f"no such flags: {unknown}")
    flags = sum(FLAGS[letter] for letter in set(letters))
    try:
        matches_nothing = re.compile(pattern, flags).match("")
    except (re.error, OverflowError, RecursionError) as error:
        raise QueryError("invalid_regex", str(error)) from error
    if matches_nothing:
        raise QueryError("zero_length_regex", "the expression matches the empty text")
    return Query("regex", text, pattern, flags, anchor(pattern, flags))


def parse(text: str) -> Query:
    """Read a query; a compound one is exactly TERM NEAR TERM or TERM NOT TERM."""
    text = unicodedata.normalize("NFC", text)
    if text.startswith("/"):
        return _expression(text)
    if not COMPOUND.keys() & set(text.split()):
        return Query("literal", text)
    terms = _TERMS.fullmatch(text)
    if terms is None or COMPOUND.keys() & {terms[1], terms[3]}:
        raise QueryError("invalid_compound_query", "a compound query is TERM NEAR TERM or TERM NOT TERM")
    return Query(COMPOUND[terms[2]], terms[1], right=terms[3])


def check_scope(query: Query, scoped: bool) -> None:
    """A regular expression without an anchor has to be scoped to some texts."""
    if query.mode == "regex" and query.anchor is None and not scoped:
        raise QueryError("regex_needs_scope", "no literal run narrows the expression")
