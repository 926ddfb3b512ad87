"""Regular expressions with Python's meaning on Spark's (Java) engine."""

from __future__ import annotations

import math
import re
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``\s`` matches in text, as the inside of a class. Those
# below U+0100 are listed one by one, which Java looks up in a table.
_OTHER_SPACES = r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE_SPACES = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = rf"\x20{_OTHER_SPACES}{_WIDE_SPACES}"
# What has to change when whitespace is collapsed; single plain spaces stay. The
# outer range lets most characters fail at once.
_WIDE = rf"[\x{{1680}}-\x{{3000}}&&[{_WIDE_SPACES}]]"
UNEVEN_SPACE = rf"[\x20{_OTHER_SPACES}{_WIDE}]{{2,}}|[{_OTHER_SPACES}{_WIDE}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
_BOUNDARY = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"

_BOUNDED = re.compile(r"\\b([A-Za-z0-9]+)\\b")


def whole_word(word: str) -> str:
    """Pattern for a word of letters and digits that stands alone. The look back
    comes after the first letter, so that it is rarely needed."""
    return f"{word[0]}(?<!{WORD_CHAR}{word[0]}){word[1:]}(?!{WORD_CHAR})"


_SPACE_CLASS = rf"[\x20{_OTHER_SPACES}{_WIDE}]"
#: What each class of Python's means, as the inside of a Java class; of the opposites
#: only that of digits can stand beside others there.
_CATEGORIES = {
    "CATEGORY_SPACE": SPACE_CHARS, "CATEGORY_DIGIT": r"\p{Nd}", "CATEGORY_WORD": r"\p{L}\p{N}_", "CATEGORY_NOT_DIGIT": r"\P{Nd}",
    "CATEGORY_NOT_SPACE": rf"[^{SPACE_CHARS}]", "CATEGORY_NOT_WORD": r"[^\p{L}\p{N}_]",
}
_PLACES = {
    "AT_BEGINNING_STRING": r"\A", "AT_END_STRING": r"\z", "AT_BOUNDARY": _BOUNDARY,
    "AT_NON_BOUNDARY": rf"(?!\A\z)(?!{_BOUNDARY})",
}
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_REPEATS = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}


def _char(code: int) -> str:
    """A literal character; whatever could mean something to Java goes by its number."""
    char = chr(code)
    return char if char.isascii() and char.isalnum() else rf"\x{{{code:x}}}"


def _class(members) -> str:
    """A set of characters. Java reads a class within an excluding class in its own way, so
    that is looked ahead for instead."""
    negated = bool(members) and str(members[0][0]) == "NEGATE"
    inside, nested = "", False
    for kind, value in members[negated:]:
        name = str(kind)
        if name == "LITERAL":
            inside += _char(value)
        elif name == "RANGE":
            inside += f"{_char(value[0])}-{_char(value[1])}"
        else:
            inside += _CATEGORIES[str(value)]
            nested |= str(value) in ("CATEGORY_NOT_SPACE", "CATEGORY_NOT_WORD")
    if not negated:
        return _SPACE_CLASS if inside == SPACE_CHARS else f"[{inside}]"
    return rf"(?:(?![{inside}])(?s:.))" if nested else f"[^{inside}]"


def _java(parts, flags: int) -> str:
    """Java's text for a part of the parse tree, under Python's flags."""
    out = ""
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            out += _char(value)
        elif name == "NOT_LITERAL":
            out += f"[^{_char(value)}]"
        elif name == "ANY":
            out += "(?s:.)" if flags & re.DOTALL else r"[^\n]"
        elif name == "IN":
            out += _class(value)
        elif name == "BRANCH":
            out += "(?:" + "|".join(_java(way, flags) for way in value[1]) + ")"
        elif name in _REPEATS:
            low, high, body = value
            bounds = {(0, 1): "?", (0, _parser.MAXREPEAT): "*", (1, _parser.MAXREPEAT): "+"}.get((low, high))
            if bounds is None:
                bounds = f"{{{low}}}" if low == high else f"{{{low},{'' if high == _parser.MAXREPEAT else high}}}"
            inner = _java(body, flags)
            single = len(body) == 1 and str(body[0][0]) in ("LITERAL", "NOT_LITERAL", "ANY", "IN", "SUBPATTERN")
            out += (inner if single else f"(?:{inner})") + bounds + _REPEATS[name]
        elif name == "SUBPATTERN":
            group, on, off, body = value
            inner = _java(body, (flags | on) & ~off)
            if (on | off) & re.IGNORECASE:
                inner = f"(?{'iu' if on & re.IGNORECASE else '-i'}:{inner})"
            out += f"({inner})" if group is not None else f"(?:{inner})"
        elif name == "ATOMIC_GROUP":
            out += f"(?>{_java(value, flags)})"
        elif name == "GROUPREF":
            out += rf"(?:\{value})"
        elif name in ("ASSERT", "ASSERT_NOT"):
            way, body = value
            out += f"(?{'<' if way < 0 else ''}{'=' if name == 'ASSERT' else '!'}{_java(body, flags)})"
        elif name == "AT":
            place, lines = str(value), flags & re.MULTILINE
            if place == "AT_BEGINNING":
                out += r"(?:\A|(?<=\n))" if lines else r"\A"
            elif place == "AT_END":
                out += r"(?=\n|\z)" if lines else r"(?=\n?\z)"
            else:
                out += _PLACES[place]
        elif name == "FAILURE":
            out += "(?!)"
        else:
            raise ValueError(f"{name.lower()} has no counterpart in Java patterns")
    return out


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The Python pattern for Java, with Python's meaning on text.

    Written anew from Python's own parse of it: classes, boundaries, line ends, flags,
    names of groups, escapes and the signs that mean something only to Java come out as
    Python reads them. What Java can't say (conditional groups), and flags that change the
    classes (``(?a)``), raise a ValueError.
    """
    word = _BOUNDED.fullmatch(pattern)
    tree = _parser.parse(pattern)
    flags = tree.state.flags
    if flags & re.ASCII:
        raise ValueError("ASCII classes are not supported")
    body = whole_word(word.group(1)) if word else _java(tree, flags)
    return ("(?iu)" if ignore_case or flags & re.IGNORECASE else "") + body


def _span(parts) -> tuple[float, bool]:
    """Most characters a part of the parse tree goes over, a run of white space that may
    have any length counted as one, and whether white space or an end of the text can be
    among them."""
    total, open_ = 0.0, False
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            wide, holds = 1.0, chr(value).isspace()
        elif name in ("NOT_LITERAL", "ANY"):
            wide, holds = 1.0, True
        elif name == "IN":
            wide, holds = 1.0, _holds_space(value)
        elif name == "BRANCH":
            ways = [_span(way) for way in value[1]]
            wide, holds = max(w for w, _ in ways), any(h for _, h in ways)
        elif name in _REPEATS:
            _, high, body = value
            wide, holds = _span(body)
            if high != _parser.MAXREPEAT:
                wide *= high
            elif not _only_space(body):
                wide = math.inf
        elif name == "SUBPATTERN":
            wide, holds = _span(value[3])
        elif name in ("ASSERT", "ASSERT_NOT"):
            wide, holds = _span(value[1])
        elif name == "ATOMIC_GROUP":
            wide, holds = _span(value)
        elif name == "AT":
            wide, holds = 1.0, str(value) != "AT_BOUNDARY"
        elif name == "FAILURE":
            wide, holds = 0.0, False
        else:
            wide, holds = math.inf, True
        total, open_ = total + wide, open_ or holds
    return total, open_


def _holds_space(members) -> bool:
    """Whether a parsed set of characters holds any white space."""
    negated = str(members[0][0]) == "NEGATE"
    one = re.compile("[" + "".join(_python_member(m) for m in members[negated:]) + "]")
    return any((one.match(c) is None) == negated for c in _SPACES)


def _python_member(member) -> str:
    kind, value = str(member[0]), member[1]
    if kind == "LITERAL":
        return re.escape(chr(value))
    if kind == "RANGE":
        return f"{re.escape(chr(value[0]))}-{re.escape(chr(value[1]))}"
    letter = {"SPACE": "s", "DIGIT": "d", "WORD": "w"}[str(value).rsplit("_", 1)[1]]
    return "\\" + (letter.upper() if "_NOT_" in str(value) else letter)


def _only_space(body) -> bool:
    """Whether the repeated part is one character and that is white space."""
    if len(body) != 1:
        return False
    kind, value = str(body[0][0]), body[0][1]
    if kind == "LITERAL":
        return chr(value).isspace()
    return kind == "IN" and all(str(v) == "CATEGORY_SPACE" or str(k) == "LITERAL" and chr(v).isspace() for k, v in value)


def reach(pattern: str) -> int:
    """How far a match of the pattern can go over white space, in characters, a run of
    white space counted as one; 0 when no match holds any. Assertions count as long as
    they look.

    A pattern that can go over white space and over any number of other characters
    raises a ValueError.
    """
    wide, holds = _span(_parser.parse(pattern))
    if not holds:
        return 0
    if wide == math.inf:
        raise ValueError(f"{pattern!r} has no bound on how far a match goes")
    return int(wide)


def _keeps_off(parts, mark: str) -> bool:
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            fine = chr(value) != mark
        elif name == "IN":
            fine = str(value[0][0]) != "NEGATE" and not any("_NOT_" in str(v) for _, v in value) and not re.match(
                "[" + "".join(_python_member(m) for m in value) + "]", mark
            )
        elif name == "BRANCH":
            fine = all(_keeps_off(way, mark) for way in value[1])
        elif name in _REPEATS:
            fine = _keeps_off(value[2], mark)
        elif name == "SUBPATTERN":
            fine = _keeps_off(value[3], mark)
        elif name == "ATOMIC_GROUP":
            fine = _keeps_off(value, mark)
        else:
            fine = False
        if not fine:
            return False
    return True


def keeps_off(pattern: str, mark: str) -> bool:
    """Whether no match holds the character and none depends on one beside it, so that texts
    joined by it have the matches that each has alone. Assertions, anchors and sets of what is
    not meant give False, as what can't be told does."""
    return _keeps_off(_parser.parse(pattern), mark)


def _runs(parts, runs: list[str]) -> None:
    """Adds the runs of literal ASCII letters, digits, spaces and dollar signs that every
    match of the parsed pattern holds."""
    run = ""
    for kind, value in parts:
        name = str(kind)
        char = chr(value) if name == "LITERAL" else ""
        if char and char.isascii() and (char.isalnum() or char in " $"):
            run += char
            continue
        runs.append(run)
        run = ""
        if name == "SUBPATTERN":
            _runs(value[3], runs)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            _runs(value[2], runs)
    runs.append(run)


def required_text(pattern: str) -> str:
    """The longest plain text every match contains; empty when none is certain.

    Used to skip the regex engine on texts that cannot match. Python's own parser says
    what is literal: repeats, classes, alternatives, anchors and assertions give nothing.
    """
    runs: list[str] = []
    _runs(_parser.parse(pattern), runs)
    return max(runs, key=len)


def fold_case(text: Column) -> Column:
    """A form in which the plain text that a pattern requires is found whenever the
    pattern matches the text with case ignored, or the text in upper case: upper case
    first, as some letters turn into several there, then lower. The dotted capital i
    counts as the plain one. It can hold more than the text does, so a pattern that
    is found here still has to be run."""
    return F.lower(F.translate(F.upper(text), "İ", "I"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
