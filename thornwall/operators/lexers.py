"""Comments and strings of source code: the outermost ones, with their delimiters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Span = tuple[str, int, int]
COMMENT, STRING = "Comment", "StringLiteral"


@dataclass(frozen=True)
class Language:
    """How to find the end of what starts at a place; the first pattern that matches there wins.

    Each entry: a pattern of the start, what it is (None: skip it), and a function from text and match to the end.
    """

    entries: tuple[tuple[re.Pattern[str], str | None, Callable[[str, re.Match[str]], int]], ...]

    def spans(self, text: str) -> Iterator[Span]:
        starts = re.compile("|".join(f"(?:{p.pattern})" for p, _, _ in self.entries), re.M)
        at = 0
        while m := starts.search(text, at):
            for pattern, what, end in self.entries:
                if own := pattern.match(text, m.start()):
                    stop = max(end(text, own), own.end())
                    if what:
                        yield what, m.start(), stop
                    at = max(stop, m.start() + 1)
                    break
            else:
                at = m.start() + 1


def _line(text: str, m: re.Match[str]) -> int:
    end = text.find("\n", m.end())
    return len(text) if end < 0 else end


def _until(close: str) -> Callable[[str, re.Match[str]], int]:
    def run(text: str, m: re.Match[str]) -> int:
        end = text.find(close, m.end())
        return len(text) if end < 0 else end + len(close)

    return run


def _nested(text: str, m: re.Match[str]) -> int:
    """Block comments that may hold block comments."""
    depth = 1
    for part in re.compile(r"/\*|\*/").finditer(text, m.end()):
        depth += 1 if part[0] == "/*" else -1
        if not depth:
            return part.end()
    return len(text)


def _quoted(quote: str, lines: bool) -> Callable[[str, re.Match[str]], int]:
    """Up to an unescaped quote; without `lines` an open string ends with its line."""
    step = re.compile(r"\\.|" + re.escape(quote) + ("" if lines else r"|\n"), re.S)

    def run(text: str, m: re.Match[str]) -> int:
        at = m.end()
        while part := step.search(text, at):
            if part[0] == quote:
                return part.end()
            if part[0] == "\n":
                return part.start()
            at = part.end()
        return len(text)

    return run


def _template(text: str, m: re.Match[str]) -> int:
    """A back-quoted template, whose ${...} may hold strings and templates."""
    at = m.end()
    step = re.compile(r"\\.|`|\$\{", re.S)
    while part := step.search(text, at):
        if part[0] == "`":
            return part.end()
        at = _braces(text, part.end()) if part[0] == "${" else part.end()
    return len(text)


def _braces(text: str, at: int) -> int:
    depth = 1
    for_step = re.compile(r"[{}`\"']")
    while part := for_step.search(text, at):
        if part[0] == "{":
            depth, at = depth + 1, part.end()
        elif part[0] == "}":
            depth, at = depth - 1, part.end()
            if not depth:
                return at
        elif part[0] == "`":
            at = _template(text, part)
        else:
            at = _quoted(part[0], False)(text, part)
    return len(text)


def _rust_raw(text: str, m: re.Match[str]) -> int:
    return _until('"' + "#" * m[0].count("#"))(text, m)


def _cpp_raw(text: str, m: re.Match[str]) -> int:
    return _until(f'){m["tag"]}"')(text, m)


def _heredoc(text: str, m: re.Match[str]) -> int:
    """The start line and the body up to the line of the end word."""
    body = _line(text, m) + 1
    end = re.compile(rf"^[ \t]*{re.escape(m['word'])}[ \t]*$", re.M).search(text, body)
    return len(text) if not end else end.start()


_SLASHES = (re.compile("//"), COMMENT, _line)
_BLOCK = (re.compile(r"/\*"), COMMENT, _until("*/"))
_DOUBLE, _SINGLE = re.compile('"'), re.compile("'")
_CHAR = re.compile(r"'(?:\\[^\n]{1,10}?|[^'\\\n])'")
_JS = Language(
    (
        _SLASHES,
        _BLOCK,
        (re.compile(r"(?<=[(,=:\[!&|?{};])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"), None, lambda t, m: m.end()),
        (_DOUBLE, STRING, _quoted('"', False)),
        (_SINGLE, STRING, _quoted("'", False)),
        (re.compile("`"), STRING, _template),
    )
)
_C = (_SLASHES, _BLOCK, (re.compile(r'(?:\b(?:u8|[LuU]))?"'), STRING, _quoted('"', False)), (re.compile(r"(?:\b(?:u8|[LuU]))?'"), STRING, _quoted("'", False)))
_CPP = Language(((re.compile(r'(?:\b(?:u8|[LuU]))?\bR"(?P<tag>[^()\\\s]{0,16})\('), STRING, _cpp_raw), *_C))
_SHELL = Language(
    (
        (re.compile(r"(?:^|(?<=[\s;(]))#"), COMMENT, _line),
        (re.compile(r"<<-?\s*(['\"]?)(?P<word>[A-Za-z_]\w*)\1"), STRING, _heredoc),
        (re.compile(r"\\."), None, lambda t, m: m.end()),
        (re.compile(r"\$'"), STRING, _quoted("'", True)),
        (_SINGLE, STRING, _until("'")),
        (_DOUBLE, STRING, _quoted('"', True)),
    )
)
_RUBY = Language(
    (
        (re.compile(r"^=begin\b", re.M), COMMENT, lambda t, m: _until("\n=end")(t, m)),
        (re.compile(r"#(?!\{)"), COMMENT, _line),
        (re.compile(r"<<[~-]?(['\"`]?)(?P<word>[A-Z_]\w*)\1"), STRING, _heredoc),
        (_DOUBLE, STRING, _quoted('"', True)),
        (_SINGLE, STRING, _quoted("'", True)),
        *((re.compile(rf"%[qQ]?\{o}" if o in "([{" else rf"%[qQ]?{o}"), STRING, _quoted(c, True)) for o, c in ("()", "[]", "{}", "<>")),
    )
)
_RUST = Language(
    (
        _SLASHES,
        (re.compile(r"/\*"), COMMENT, _nested),
        (re.compile(r'\bb?r#*"'), STRING, _rust_raw),
        (re.compile(r'(?:\bb)?"'), STRING, _quoted('"', True)),
        (_CHAR, None, lambda t, m: m.end()),
    )
)
_PREFIX = r"(?:\b[rRbBuUfF]{1,2})?"
_PYTHON = Language(
    (
        (re.compile("#"), COMMENT, _line),
        *((re.compile(_PREFIX + q * 3), STRING, _quoted(q * 3, True)) for q in "\"'"),
        *((re.compile(_PREFIX + q), STRING, _quoted(q, False)) for q in "\"'"),
    )
)
_GO = Language((_SLASHES, _BLOCK, (_DOUBLE, STRING, _quoted('"', False)), (re.compile("`"), STRING, _until("`")), (_CHAR, None, lambda t, m: m.end())))
_JAVA = Language((_SLASHES, _BLOCK, (re.compile('"""'), STRING, _quoted('"""', True)), (_DOUBLE, STRING, _quoted('"', False)), (_CHAR, STRING, lambda t, m: m.end())))

#: Which extension is read as which language.
LANGUAGES: dict[str, Language] = {
    ext: language
    for exts, language in (
        ("rs", _RUST), ("py pyi", _PYTHON), ("js mjs cjs jsx ts mts cts tsx", _JS), ("go", _GO), ("java", _JAVA), ("c h", Language(_C)),
        ("cc cpp cxx hpp hh hxx", _CPP), ("sh bash zsh", _SHELL), ("rb rake gemspec", _RUBY),
    )
    for ext in exts.split()
}


def source_spans(text: str, extension: str) -> list[Span]:
    """Kind, start and end (in characters) of each comment and string, in order."""
    return list(LANGUAGES[extension].spans(text))
