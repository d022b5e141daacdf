"""The rule pack, and a parser for a subset of the YARA rule language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .schema import MEDIUM, parse_severity


@dataclass(frozen=True)
class Pattern:
    """A Java regular expression for one string of a rule."""

    name: str
    regex: str
    #: The string itself, if it is a plain one, and whether case doesn't count.
    text: str | None = None
    nocase: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    severity: int
    confidence: float
    message: str
    patterns: tuple[Pattern, ...]
    condition: str = "any of them"


def literal(text: str, nocase: bool = False, fullword: bool = False) -> str:
    body = re.sub(r"([^\w\s<>/=\"',;:%&~`@#!-])", r"\\\1", text)
    body = rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])" if fullword else body
    return f"(?i){body}" if nocase else body


#: Phrases and tokens of known attacks. Severity, confidence, message, whether case counts, strings.
#: The name and message of dialogue_role_hijack are our own.
PACK = {
    "ignore_previous_instructions": ("high", 0.9, "classic prompt-injection preamble", False, (
        "ignore previous instructions", "ignore all previous", "ignore the above", "ignore everything above")),
    "disregard_above": ("high", 0.85, "instruction-override phrase", False, (
        "disregard the above", "disregard previous", "disregard all prior", "forget the above", "forget all previous")),
    "role_reassignment": ("medium", 0.5, "potential role reassignment", False, (
        "you are now", "from now on you are", "you will act as", "pretend you are", "act as if you")),
    "system_prompt_spoof": ("high", 0.8, "system-prompt spoof", False, ("system prompt:", "system message:", "[system]")),
    "chatml_role_hijack": ("critical", 0.95, "ChatML role-hijack token", True, (
        "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>")),
    "llama2_role_hijack": ("critical", 0.95, "Llama 2 / Mistral role-hijack token", True, ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")),
    "llama3_role_hijack": ("critical", 0.95, "Llama 3 chat-template role-hijack token", True, (
        "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")),
    "gpt_endoftext": ("critical", 0.95, "GPT family end-of-text / FIM token", True, (
        "<|endoftext|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")),
    "dialogue_role_hijack": ("high", 0.7, "conversation role marker", True, ("\n\nHuman:", "\n\nAssistant:")),
    "gemini_role_hijack": ("critical", 0.9, "Gemini / Gemma chat-template role token", True, ("<start_of_turn>", "<end_of_turn>")),
    "alpaca_instruction_marker": ("high", 0.7, "Alpaca-style instruction marker", True, ("### Instruction:", "### Response:", "### Input:")),
    "jailbreak_preamble": ("high", 0.85, "known jailbreak preamble", False, (
        "DAN mode", "developer mode enabled", "do anything now", "jailbreak mode", "without any restrictions", "unrestricted mode")),
    "exfiltration_vocabulary": ("medium", 0.6, "exfiltration vocabulary", False, (
        "exfiltrate", "send the contents to", "post the result to", "leak the secret", "reveal the system prompt", "print the system prompt")),
    "tool_call_spoof": ("high", 0.8, "tool/function call spoof", False, ("<tool_call>", "</tool_call>", "function_call:", "<function_calls>")),
}


def builtin() -> list[Rule]:
    return [
        Rule(name, parse_severity(severity), confidence, message, tuple(Pattern(f"${chr(97 + i)}", literal(s, not exact), s, not exact) for i, s in enumerate(strings)))
        for name, (severity, confidence, message, exact, strings) in PACK.items()
    ]


_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<string>\"(?:\\.|[^\"\\])*\")|(?P<word>[A-Za-z_]\w*)|(?P<name>[$#]\w*\*?)|(?P<number>\d+(?:\.\d+)?)|(?P<op>>=|<=|==|!=|[-{}:=()<>,*/])", re.S)


@dataclass
class _Reader:
    """Tokens of rule text; regular expressions are read where a string is expected."""

    text: str
    at: int = 0
    seen: list[tuple[str, str]] = field(default_factory=list)

    def next(self) -> tuple[str, str]:
        if self.seen:
            return self.seen.pop()
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(f"unexpected {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup:
                return m.lastgroup, m.group()
        return "end", ""

    def back(self, token: tuple[str, str]) -> None:
        self.seen.append(token)

    def want(self, value: str) -> None:
        if (got := self.next()[1]) != value:
            raise ValueError(f"expected {value!r}, not {got!r}")

    def regex(self) -> tuple[str, str]:
        """The rest of a /regular expression/ whose first slash was just read, and its flags."""
        m = re.compile(r"((?:\\.|[^/\\\n])+)/([is]*)").match(self.text, self.at)
        if not m:
            raise ValueError("unfinished regular expression")
        self.at = m.end()
        return m[1], m[2]


def _unquote(s: str) -> str:
    def one(m: re.Match[str]) -> str:
        return chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t", "r": "\r"}.get(m[2], m[2])

    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|(.))", one, s[1:-1], flags=re.S)


def parse(text: str) -> list[Rule]:
    """Rules of meta, text or regular-expression strings (nocase, fullword, ascii) and a condition.

    Conditions: any, all, none or a number of them, `$a`, `#a` compared with a number, true, false, and, or, not,
    parentheses. Anything else raises ValueError.
    """
    reader, out = _Reader(text), []
    while (token := reader.next())[0] != "end":
        if token[1] in ("private", "global"):
            continue
        if token[1] != "rule":
            raise ValueError(f"expected a rule, not {token[1]!r}")
        out.append(_rule(reader))
    return out


def _rule(reader: _Reader) -> Rule:
    name = reader.next()[1]
    while (token := reader.next())[1] != "{":
        if token[1] != ":" and token[0] != "word":
            raise ValueError(f"unexpected {token[1]!r}")
    meta: dict[str, str] = {}
    patterns: list[Pattern] = []
    condition = ""
    section = ""
    while (token := reader.next())[1] != "}":
        if token[0] == "word" and token[1] in ("meta", "strings", "condition"):
            section = token[1]
            reader.want(":")
            if section == "condition":
                parts = []
                while (token := reader.next())[1] != "}":
                    parts.append(token[1])
                condition = " ".join(parts)
                reader.back(token)
        elif section == "meta":
            reader.want("=")
            kind, value = reader.next()
            meta[token[1]] = _unquote(value) if kind == "string" else value
        elif section == "strings":
            reader.want("=")
            patterns.append(_pattern(reader, token[1]))
        else:
            raise ValueError(f"unexpected {token[1]!r}")
    try:
        severity = parse_severity(meta.get("severity", ""))
    except ValueError:
        severity = MEDIUM
    try:
        confidence = min(1.0, max(0.0, float(meta.get("confidence", ""))))
    except ValueError:
        confidence = 0.5
    return Rule(name, severity, confidence, meta.get("message", "rule matched"), tuple(patterns), condition)


def _pattern(reader: _Reader, name: str) -> Pattern:
    kind, value = reader.next()
    flags = ""
    if kind == "string":
        text = _unquote(value)
    elif value == "/":
        text, flags = reader.regex()
    else:
        raise ValueError(f"strings of the kind {value!r} aren't supported")
    modifiers = set()
    while (token := reader.next())[0] == "word" and token[1] in ("nocase", "fullword", "ascii", "wide"):
        modifiers.add(token[1])
    reader.back(token)
    if "wide" in modifiers:
        raise ValueError("wide strings aren't supported")
    if kind == "string":
        plain = text if "fullword" not in modifiers and text.isascii() else None
        return Pattern(name, literal(text, "nocase" in modifiers, "fullword" in modifiers), plain, "nocase" in modifiers)
    flags = ("i" if "nocase" in modifiers or "i" in flags else "") + ("s" if "s" in flags else "")
    return Pattern(name, f"(?{flags}){text}" if flags else text)
