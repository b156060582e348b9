"""Tokens of C-like sources: comments dropped, strings, templates and expressions of slashes kept whole."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass


class ParseError(ValueError):
    """A source that can't be read; ``line`` and ``column`` count from 1."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"parse error: {message} at line {line}, column {column}")
        self.line, self.column = line, column


@dataclass(frozen=True, slots=True)
class Token:
    kind: str  # name, number, string, template, regex, punct
    text: str
    start: int
    end: int
    line: int
    fresh: bool  # the first of its line


_NAME = re.compile(r"[#@]?[$\w]+")
_NUMBER = re.compile(r"(?:0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eEpP][+-]?[0-9_]+)?[nfFdDlL]?)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_JS_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|.", re.S)
_JAVA_PUNCT = re.compile(r"\.\.\.|::|->|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|.", re.S)
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default", "extends"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Source:
    """``tokens`` and, for each bracket, the place of its partner in ``partner``."""

    def __init__(self, text: str, java: bool):
        self.text, self.java = text, java
        self.lines = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
        self.tokens = list(self._scan())
        self.partner = self._pair()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def error(self, message: str, at: int) -> ParseError:
        line = self.line(at)
        return ParseError(message, line, at - self.lines[line - 1] + 1)

    def _scan(self):
        text, at, n, last, last_line = self.text, 0, len(self.text), None, 0
        if not self.java and text.startswith("#!"):
            at = self.lines[1] if len(self.lines) > 1 else n
        while at < n:
            c = text[at]
            if c.isspace() or c == "﻿":
                at += 1
                continue
            if text.startswith("//", at):
                line = self.line(at)
                at = self.lines[line] if line < len(self.lines) else n
                continue
            if text.startswith("/*", at):
                end = text.find("*/", at + 2)
                if end < 0:
                    raise self.error("comment is not closed", at)
                at = end + 2
                continue
            kind, end = self._one(at, last)
            line = self.line(at)
            last = Token(kind, text[at:end], at, end, line, line != last_line)
            last_line = self.line(end - 1)
            yield last
            at = end

    def _one(self, at: int, last: Token | None) -> tuple[str, int]:
        text, c = self.text, self.text[at]
        if c in "\"'" or (c == "`" and not self.java):
            return ("template" if c == "`" else "string"), self._string(at)
        if (c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit())) and (m := _NUMBER.match(text, at)):
            return "number", m.end()
        if c == "@" and self.java:
            return ("name", at + 10) if text.startswith("@interface", at) and not text[at + 10 : at + 11].isalnum() else ("punct", at + 1)
        if c != "@" and (m := _NAME.match(text, at)):
            return "name", m.end()
        if c == "/" and not self.java and self._may_start_regex(last) and (m := _REGEX.match(text, at)):
            return "regex", m.end()
        return "punct", (_JAVA_PUNCT if self.java else _JS_PUNCT).match(text, at).end()

    @staticmethod
    def _may_start_regex(last: Token | None) -> bool:
        if last is None:
            return True
        if last.kind == "name":
            return last.text in _BEFORE_REGEX
        return last.kind == "punct" and last.text not in (")", "]", "}", "++", "--")

    def _string(self, start: int) -> int:
        text, quote = self.text, self.text[start]
        if self.java and text.startswith('"""', start):
            end = start + 3
            while (end := text.find('"""', end)) >= 0 and text[end - 1] == "\\":
                end += 1
            if end < 0:
                raise self.error("text block is not closed", start)
            return end + 3
        at = start + 1
        while at < len(text):
            c = text[at]
            if c == "\\":
                at += 2
            elif c == quote:
                return at + 1
            elif quote == "`" and text.startswith("${", at):
                at = self._substitution(at + 2)
            elif c in "\r\n" and quote != "`":
                break
            else:
                at += 1
        raise self.error("string is not closed", start)

    def _substitution(self, at: int) -> int:
        """The place behind the brace that closes a template's substitution."""
        depth = 1
        while at < len(self.text):
            c = self.text[at]
            if c in "\"'`":
                at = self._string(at)
                continue
            depth += (c == "{") - (c == "}")
            at += 1
            if not depth:
                return at
        raise self.error("template is not closed", at)

    def _pair(self) -> dict[int, int]:
        out, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in PAIRS:
                open_.append(i)
            elif t.text in PAIRS.values():
                if not open_ or PAIRS[self.tokens[open_[-1]].text] != t.text:
                    raise self.error(f"'{t.text}' is not expected", t.start)
                out[open_[-1]], out[i] = i, open_[-1]
                open_.pop()
        if open_:
            raise self.error(f"'{self.tokens[open_[-1]].text}' is not closed", self.tokens[open_[-1]].start)
        return out
