"""The textual filter language: ``[in]name@instance=options[out],name;...`` to an abstract syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from mediaframe.errors import MediaError

SPACES = " \n\t\r"
KEY = re.compile(r"\s*([A-Za-z0-9_/.-]+)\s*=")


class LanguageError(MediaError):
    pass


@dataclass(frozen=True)
class FilterCall:
    name: str
    instance: str | None = None
    options: str | None = None
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Graph:
    chains: tuple[tuple[FilterCall, ...], ...]
    scale_flags: str | None = None


@dataclass
class _Reader:
    text: str
    at: int = 0

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in SPACES:
            self.at += 1

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def token(self, stops: str) -> str:
        """Up to an unprotected stop: backslash protects a character, quotes all up to the next quote; outer space goes."""
        self.skip()
        out: list[str] = []
        kept = 0  # what must not be trimmed
        while self.at < len(self.text) and self.text[self.at] not in stops:
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                out.append(self.text[self.at])
                self.at += 1
                kept = len(out)
            elif c == "'":
                end = self.text.find("'", self.at)
                end = len(self.text) if end < 0 else end
                out += self.text[self.at : end]
                self.at = min(end + 1, len(self.text))
                kept = len(out)
            else:
                out.append(c)
        while len(out) > kept and out[-1] in SPACES:
            out.pop()
        return "".join(out)


def _labels(r: _Reader) -> tuple[str, ...]:
    out = []
    r.skip()
    while r.peek() == "[":
        end = r.text.find("]", r.at)
        if end < 0:
            raise LanguageError(f"mismatched '[' found in {r.text[r.at :]!r}")
        name = r.text[r.at + 1 : end].strip(SPACES)
        if not name:
            raise LanguageError(f"bad (empty?) label found in {r.text[r.at :]!r}")
        out.append(name)
        r.at = end + 1
        r.skip()
    return tuple(out)


def parse(text: str) -> Graph:
    r = _Reader(text)
    r.skip()
    flags = None
    if r.text.startswith("sws_flags=", r.at):
        end = r.text.find(";", r.at)
        if end < 0:
            raise LanguageError("sws_flags not terminated with ';'")
        flags = r.text[r.at + len("sws_flags=") : end]
        r.at = end + 1
    chains: list[tuple[FilterCall, ...]] = []
    chain: list[FilterCall] = []
    r.skip()
    if not r.peek():
        raise LanguageError("the filter description is empty")
    while True:
        inputs = _labels(r)
        name = r.token("=,;[")
        if not name:
            raise LanguageError(f"no filter name near {r.text[r.at :]!r}")
        name, _, instance = name.partition("@")
        options = None
        if r.peek() == "=":
            r.at += 1
            start = r.at
            options = _raw_options(r)
            if not options and start == r.at:
                options = None
        chain.append(FilterCall(name, instance or None, options, inputs, _labels(r)))
        r.skip()
        c = r.peek()
        if c in ("", ";"):
            chains.append(tuple(chain))
            chain = []
        if not c:
            return Graph(tuple(chains), flags)
        if c not in ",;":
            raise LanguageError(f"trailing garbage after a filter: {r.text[r.at :]!r}")
        r.at += 1
        r.skip()
        if not r.peek() and c == ";":
            return Graph(tuple(chains), flags)


def _raw_options(r: _Reader) -> str:
    """The options as written, quotes and escapes kept, up to an unprotected '[', ',' or ';'."""
    start = r.at
    while r.at < len(r.text) and r.text[r.at] not in "[,;":
        c = r.text[r.at]
        r.at += 1
        if c == "\\":
            r.at += 1
        elif c == "'":
            end = r.text.find("'", r.at)
            r.at = len(r.text) if end < 0 else end + 1
    return r.text[start : r.at].strip(SPACES)


def parse_options(text: str | None, shorthand: tuple[str, ...]) -> list[tuple[str, str]]:
    """(key, value) in order, repeats kept: values without key take the shorthand names until the first key."""
    out: list[tuple[str, str]] = []
    r, names = _Reader(text or ""), list(shorthand)
    while r.at < len(r.text):
        m = KEY.match(r.text, r.at)
        if m:
            key, r.at, names = m[1], m.end(), []
        elif names:
            key = names.pop(0)
        else:
            raise LanguageError(f"no option name near {r.text[r.at :]!r}")
        out.append((key, r.token(":")))
        r.at += 1
    return out


def split_list(text: str, separator: str = "|") -> list[str]:
    r, out = _Reader(text), []
    while r.at < len(r.text):
        out.append(r.token(separator))
        r.at += 1
    return [x for x in out if x]
