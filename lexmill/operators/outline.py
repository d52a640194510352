"""Sections of a source text, and where each begins and ends, by one scan over its lines.

A section is what a definition, key or heading holds.  What stands in strings and comments opens and
closes nothing: it is blanked out first.  Then a stack of open sections is kept, and each closes

* by columns (Python, YAML): before the next line of code that is not further in than its opener;
* by depth (JavaScript, TypeScript, Dart, JSON, Lua): on the line where its brackets, or its
  ``function … end``, are closed again, or where a statement without any ends;
* by headings (Markdown): before the next heading of the same or a higher level.

So lines behind a section have the names of what is around it, and of nothing that has ended.
Comments, decorators and annotations above an opener are its first lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

NAME_CHARS, MAX_DEPTH = 80, 200
#: Characters that are cut into lines at a time, and lines that are kept of a family, each up to so long.
SPLIT_CHARS, MET_LINES, MET_CHARS = 1 << 16, 4096, 160


@dataclass(slots=True)
class Section:
    """Lines ``first`` to ``last`` (0-based, inclusive) of one opener, or of the whole text, and the sections inside."""

    first: int
    last: int
    names: tuple[str, ...] = ()
    inner: list[Section] = field(default_factory=list)


@dataclass(slots=True)
class Line:
    """What a line is by itself.  Its digits are all ``0``: no pattern tells one from another, and so lines of one form are one."""

    code: str  # without strings (blanked with ``"``) and comments (with spaces)
    raw: str
    column: int
    own_column: int  # behind the dashes of YAML
    filled: bool
    net: int  # brackets opened less closed, the least and the most of that on the way, and the most from any least on
    low: int
    high: int
    rise: int
    body: str  # its code without white space around it
    opens: list  # by ``direct``: (where the name stands, whether it holds members), None, or not looked at yet


_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_C_HIDDEN = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|`(?:\\.|[^`\\])*(?:`|\Z)|"
#: Per family: what hides brackets and openers.  The group ``comment`` is no code at all.
HIDDEN = {
    "python": r"(?P<comment>#[^\n]*)|\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|'''(?:\\.|(?!''').)*(?:'''|\Z)|" + _QUOTED,
    "javascript": _C_HIDDEN + _QUOTED,
    "dart": _C_HIDDEN + r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _QUOTED,
    "lua": r"(?P<comment>--\[(=*)\[.*?(?:\]\2\]|\Z)|--[^\n]*)|\[(=*)\[.*?(?:\]\3\]|\Z)|" + _QUOTED,
    "json": r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|" + _QUOTED,
    "yaml": r"(?P<comment>(?:^|(?<=\s))#[^\n]*)",
}
_MODIFIERS = r"^\s*(?:(?:export|default|abstract|async|static|final|public|private|protected|readonly|declare|override|external|const)\s+)*"
_NO_CALL = r"(?!(?:if|for|while|switch|catch|return|with|else|do|await|throw|new|super|assert|yield|function)\b)"
#: Per family: (pattern, what it may stand in).  ``holder`` opens a type that has members; ``member`` is
#: only meant directly inside one.  The group ``name`` names the section.
OPENERS = {
    "python": [(r"^\s*(?:async\s+)?(?:def|class)\s+(?P<name>\w+)", "any")],
    "javascript": [
        (_MODIFIERS + r"class\s+(?P<name>[\w$]+)", "holder"),
        (_MODIFIERS + r"(?:interface|enum|namespace|module)\s+(?P<name>[\w$]+)", "any"),
        (_MODIFIERS + r"function\s*\*?\s*(?P<name>[\w$]+)", "any"),
        (_MODIFIERS + r"(?:let\s+|var\s+)?(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|class\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", "declared"),
        (_MODIFIERS + r"type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*=", "any"),
        (_MODIFIERS + r"(?:get\s+|set\s+|\*\s*)?" + _NO_CALL + r"(?P<name>[\w$#]+)\s*(?:<[^(]*>)?\(", "member"),
    ],
    "dart": [
        (_MODIFIERS + r"(?:(?:base|sealed|interface|mixin)\s+)*(?:class|mixin|enum|extension)\s+(?P<name>\w+)", "holder"),
        (r"^\s*typedef\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*=", "any"),
        (_MODIFIERS + r"(?:factory\s+)?(?P<name>[A-Z]\w*)(?:\.\w+)?\s*\(", "member"),
        (_MODIFIERS + _NO_CALL + r"(?:[\w<>?,.\[\]]+\s+)+?(?:get|set)\s+(?P<name>\w+)", "any"),
        (_MODIFIERS + _NO_CALL + r"(?:[\w<>?,.\[\]]+\s+)+?(?P<name>\w+)\s*(?:<[^(]*>)?\(", "any"),
    ],
    "lua": [
        (r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)", "any"),
        (r"^\s*(?:local\s+)?(?P<name>[\w.:]+)\s*=\s*function\b", "any"),
        (r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*=", "any"),
    ],
    "json": [(r"^\s*(?P<name>\"(?:\\.|[^\"\\])*\")\s*:", "any")],
    "yaml": [(r"^\s*(?:-\s+)*(?P<name>[^\s#:'\"\[\]{},&*!|>%@`-][^:#]*|-[^\s:#][^:#]*|\"[^\"]+\"|'[^']+')\s*:(?:\s|$)", "any")],
}
FAMILY = {"python": "python", "javascript": "javascript", "typescript": "javascript", "tsx": "javascript", "dart": "dart", "lua": "lua", "luau": "lua", "json": "json", "yaml": "yaml"}
#: Per family, for each of its openers: what a line must hold, any of it, for the pattern to be worth a try.
_SIGNS = {
    "python": [("def", "class")],
    "javascript": [("class",), ("interface", "enum", "namespace", "module"), ("function",), ("=",), ("type",), ("(",)],
    "dart": [("class", "mixin", "enum", "extension"), ("typedef",), ("(",), ("get", "set"), ("(",)],
    "lua": [("function",), ("function",), ("type",)],
    "json": [(":",)],
    "yaml": [(":",)],
}
_HIDDEN = {k: re.compile(p, re.DOTALL | re.MULTILINE) for k, p in HIDDEN.items()}
_OPENERS = {k: [(re.compile(p), place, signs) for (p, place), signs in zip(own, _SIGNS[k], strict=True)] for k, own in OPENERS.items()}
_BRACKETS = re.compile(r"[()\[\]{}]")
#: An ``if`` with an ``end`` begins a statement; others are expressions.
_LUA_BLOCKS = re.compile(r"[()\[\]{}]|\b(?:function|do|repeat|end|until)\b|(?:^|\b(?:then|do|else|repeat)\b|[;)])\s*if\b")
_HEADING, _RULE = re.compile(r"^ {0,3}(?P<marks>#{1,6})(?:[ \t]+(?P<name>.*?))?(?:[ \t]+#+)?[ \t]*$"), re.compile(r"^ {0,3}(?:(?P<one>=+)|(?P<two>-+))[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(?P<fence>`{3,}|~{3,})(?P<info>[^\n]*)$")
_NO_PARAGRAPH = re.compile(r"^ {0,3}(?:[#>|]|[-*+] |\d+[.)] |(?:[-*_] *){3,}$)|^(?: {4}|\t)")
_SCALAR = re.compile(r"(?:^|[:\-]\s+)(?:[&!]\S+\s+)*[|>][+\-\d]*\s*$")


def _blanked(text: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with strings and comments blanked out, and where those that go over lines stand."""
    wide = []

    def blank(found: re.Match) -> str:
        held = found[0]
        fill = " " if found["comment"] is not None else '"'
        if "\n" not in held:
            return fill * len(held)
        wide.append(found.span())
        return re.sub(r"[^\n]", fill, held)

    if family == "yaml" and "#" not in text:
        return text, wide
    return _HIDDEN[family].sub(blank, text), wide


_CLOSING = frozenset((")", "]", "}", "end", "until"))


def _column(raw: str) -> int:
    raw = raw.expandtabs(4) if "\t" in raw else raw
    return len(raw) - len(raw.lstrip())


def split_text(text: str, changed: dict[int, int] | None = None) -> Iterator[str]:
    """The lines of a text, some at a time, with characters ``changed``."""
    at = 0
    while at >= 0:
        end = text.find("\n", at + SPLIT_CHARS)
        some = text[at : end if end >= 0 else len(text)]
        yield from (some.translate(changed) if changed else some).split("\n")
        at = end + 1 if end >= 0 else -1


_NOT_YET = object()
_DIGITS = str.maketrans("123456789", "0" * 9)


def _line(code: str, raw: str, family: str) -> Line:
    net = low = high = rise = 0
    if family != "yaml":
        # One step for each bracket (in Lua for each block, too).
        for found in (_LUA_BLOCKS if family == "lua" else _BRACKETS).findall(code):
            net += -1 if found in _CLOSING else 1
            low, high = min(low, net), max(high, net)
            rise = max(rise, net - low)
    column = own = _column(raw)
    dashes = re.match(r"^\s*(?:-\s+)+", raw) if family == "yaml" and "-" in raw else None
    if dashes:
        own = len(dashes[0].expandtabs(4))
    return Line(code, raw, column, own, bool(raw.strip()), net, low, high, rise, code.strip(), [_NOT_YET, _NOT_YET])


#: Per family, lines that were met; many a line of a source is like others.
_MET: dict[str, dict[tuple[str, str], Line]] = {family: {} for family in HIDDEN}


def scanned(source: str, family: str) -> Iterator[tuple[Line, int, bool, int, int, int]]:
    """(line, where it begins, whether that is in a string or a comment, open brackets before it, after it, the most anywhere on it), made
    as they are asked for: of a long text all of them would hold many times its size."""
    text, wide = _blanked(source, family)
    depth, at, spans = 0, 0, iter([*wide, (len(text) + 1, len(text) + 1)])
    start, end = next(spans)
    met = _MET[family]
    for form in zip(split_text(text, _DIGITS), split_text(source, _DIGITS)):
        while end <= at:
            start, end = next(spans)
        line = met.get(form)
        if line is None:
            line = _line(*form, family)
            if len(form[0]) <= MET_CHARS:
                if len(met) >= MET_LINES:
                    met.clear()
                met[form] = line
        before = depth
        if line.high or line.low:
            net = line.net
            # Depths don't go below none.
            depth = before + net if before + line.low >= 0 else net - line.low
            yield line, at, start < at < end, before, depth, max(before + line.high, line.rise)
        else:
            yield line, at, start < at < end, before, before, before
        at += len(form[0]) + 1


def _with_following(told: Iterator[tuple[Line, int, bool, int, int, int]]) -> Iterator[tuple]:
    """Each line with its number and the next line with code; what waits for it are lines without any."""
    waiting: list[tuple] = []
    for i, own in enumerate(told):
        line = own[0]
        if line.body:
            for k, waits in waiting:
                yield k, *waits, line
            waiting.clear()
        waiting.append((i, own))
    for k, waits in waiting:
        yield k, *waits, None


@dataclass(slots=True)
class _Open:
    section: Section
    column: int
    depth: int
    holder: bool
    last: int
    bodied: bool = False
    scalar: bool = False


def _name(span: tuple[int, int], text: str, at: int) -> str:
    return text[at + span[0] : at + span[1]].strip().strip("\"'")[:NAME_CHARS]


def _opener(line: Line, family: str, direct: bool) -> tuple[tuple[int, int], bool] | None:
    """(where the name stands, whether it holds members) if the line opens a section."""
    known = line.opens[direct]
    if known is not _NOT_YET:
        return known
    line.opens[direct] = None
    told = line.raw if family in ("json", "yaml") else line.code
    for pattern, place, signs in _OPENERS[family]:
        if place == "member" and not direct:
            continue
        for sign in signs:
            if sign in told:
                break
        else:
            continue
        found = pattern.match(told)
        if not found:
            continue
        if place == "declared" and not direct and not re.match(r"^\s*(?:export\s+|default\s+)*(?:const|let|var)\b", line.code):
            continue  # without a keyword only a class's field is a definition
        line.opens[direct] = found.span("name"), place == "holder"
        break
    return line.opens[direct]


def _close(stack: list[_Open], last: int | None = None) -> None:
    done = stack.pop()
    done.section.last = done.last if last is None else last
    if done.section.last > stack[-1].last:
        stack[-1].last = done.section.last


def _push(stack: list[_Open], first: int, i: int, name: str, column: int, depth: int, holder: bool) -> None:
    if len(stack) > MAX_DEPTH or not name:
        return
    section = Section(first, i, (*stack[-1].section.names, name))
    stack[-1].section.inner.append(section)
    stack.append(_Open(section, column, depth, holder, i))


def _by_columns(text: str, family: str, stack: list[_Open]) -> None:
    lead = lead_column = None
    for i, (line, at, inside, before, _, _) in enumerate(scanned(text, family)):
        top = stack[-1]
        if not line.filled:
            continue
        if top.scalar and line.column > top.column:  # a block scalar of YAML
            top.last = i
            continue
        if inside or before:  # goes on from the lines above
            if lead is None:
                top.last = i
            continue
        if not line.body:  # only a comment
            if line.column > top.column and top is not stack[0]:
                top.last = i
            if lead is None or lead_column != line.column:
                lead, lead_column = i, line.column
            continue
        column = line.own_column
        if lead_column != line.column:
            lead = None
        while stack[-1].column >= column:
            _close(stack)
        if line.body[0] == "@" and family == "python":  # a decorator
            lead, lead_column = (i if lead is None else lead), line.column
            continue
        stack[-1].last = i
        found = None if family == "yaml" and stack[-1].scalar else _opener(line, family, False)
        if found:
            _push(stack, i if lead is None else lead, i, _name(found[0], text, at), column, before, False)
            stack[-1].scalar = family == "yaml" and bool(_SCALAR.search(line.code))
        lead = None
    while len(stack) > 1:
        _close(stack)


def _by_depth(text: str, family: str, stack: list[_Open]) -> None:
    lead = lead_depth = None
    for i, line, at, inside, before, depth, most, after in _with_following(scanned(text, family)):
        code = line.body
        if not code:
            if lead is None and line.filled and not inside | (len(stack) == 1 and before > 0):
                lead, lead_depth = i, before
            continue
        around = stack[-1]
        found = None if inside or (family == "json" and around.scalar) else _opener(line, family, around.holder and before == around.depth + 1)
        if found:
            _push(stack, i if lead is None else lead, i, _name(found[0], text, at), line.column, before, found[1])
            lead = None
        elif lead is not None and before > lead_depth:
            pass  # an annotation's arguments
        else:
            lead, lead_depth = (i if lead is None else lead, before) if code[0] == "@" else (None, None)
        while len(stack) > 1:
            top = stack[-1]
            top.last = i
            top.bodied = top.bodied or most > top.depth and ("{" in code or family == "lua")
            if depth > top.depth or not (depth < top.depth or top.bodied or code[-1] in ";," or _stops(after, top)):
                break
            if top.bodied and depth == top.depth and not _ends(code, after, family):
                break
            _close(stack, i)
    while len(stack) > 1:
        _close(stack)


def _stops(after: Line | None, top: _Open) -> bool:
    """Whether a statement without a body is over: the next code is no further in and goes on with nothing."""
    return after is None or (after.column <= top.column and after.code.lstrip()[:1] not in "{=.?|&:")


def _ends(code: str, after: Line | None, family: str) -> bool:
    """Whether a body is over that is back at its opener's depth: a brace may still follow parameters."""
    return family == "lua" or "}" in code and not code.endswith(("=>", "=")) or after is None or not after.code.lstrip().startswith("{")


def _by_headings(text: str, stack: list[_Open]) -> None:
    fence, paragraph, lead = "", None, ""  # the first line of the paragraph that is open
    for i, line in enumerate(split_text(text)):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark["fence"].startswith(fence) and not mark["info"].strip():
                fence = ""
            continue
        if mark and not (mark["fence"][0] == "`" and "`" in mark["info"]):
            fence, paragraph = mark["fence"], None
            continue
        heading, rule = _HEADING.match(line), _RULE.match(line)
        if heading:
            level, first, name = len(heading["marks"]), i, heading["name"] or ""
        elif rule and paragraph is not None:
            level, first, name = 1 if rule["one"] else 2, paragraph, lead.strip()
        else:
            if not line.strip() or _NO_PARAGRAPH.match(line):
                paragraph = None
            elif paragraph is None:
                paragraph, lead = i, line
            continue
        paragraph = None
        while stack[-1].column >= level:
            _close(stack, first - 1)
        _push(stack, first, i, name.strip()[:NAME_CHARS] or " ", level, 0, False)
    while len(stack) > 1:
        _close(stack, i)


def outline_of(text: str, language: str) -> Section:
    """The whole text (lines parted by ``\\n``, without one at its end) as a section, with the sections inside.  The text is read
    a few lines at a time: a list of the lines of a long one would be many times its size."""
    document = Section(0, text.count("\n"))
    stack = [_Open(document, -1, -1, False, -1)]
    if language == "markdown":
        _by_headings(text, stack)
    else:
        family = FAMILY[language]
        scan: Callable = _by_columns if family in ("python", "yaml") else _by_depth
        scan(text, family, stack)
    return document


def outline(lines: list[str], language: str) -> Section:
    """The lines as a section, with the sections inside."""
    return outline_of("\n".join(lines), language) if lines else Section(0, -1)


def innermost(text: str, language: str) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """The number of the innermost section of each line of a text, and the names of each section."""
    todo, names = [outline_of(text, language)], []
    which = np.zeros(todo[0].last + 1, np.int32)
    while todo:
        section = todo.pop()
        which[section.first : section.last + 1] = len(names)
        names.append(section.names)
        todo += section.inner
    return which, names


def symbols(lines: list[str], language: str) -> list[tuple[str, ...]]:
    """The names of the innermost section of each line."""
    which, names = innermost("\n".join(lines), language) if lines else (np.zeros(0, np.int32), [])
    return [names[k] for k in which]
