"""Top-level declarations of TypeScript and JavaScript sources.

A statement scanner over tokens, not a full grammar: what it can't follow it skips, and only unclosed brackets,
strings, comments and templates and malformed headers count as parse errors.
"""

from __future__ import annotations

from cairn.sources.analyzers.lexer import ParseError, Source, Token

_MODIFIERS = {"export", "default", "declare", "abstract", "async"}
#: Tokens that go on with the expression before them, or that want more behind them.
_JOINS = {".", "?.", ",", "(", "[", "=", "=>", "?", ":", "+", "-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "+=", "-=", "*=", "/="}
_WORDS = {"instanceof", "in", "of", "as", "satisfies", "extends", "from", "is", "keyof", "typeof", "infer", "new"}


class _Script:
    def __init__(self, text: str):
        self.src = Source(text, java=False)
        self.t: list[Token] = self.src.tokens
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.symbols: list[dict] = []
        self.dependencies: dict[str, None] = {}

    # Reading.

    def at(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def is_string(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "string"

    def value(self, i: int) -> str:
        return self.t[i].text[1:-1]

    def between(self, i: int, j: int) -> str:
        """The source from token i up to token j."""
        return self.src.text[self.t[i].start : self.t[j - 1].end] if j > i else ""

    def skip(self, i: int) -> int:
        """Behind token i, or behind its partner if it opens a bracket."""
        return self.src.partner.get(i, i) + 1 if self.at(i) in ("(", "[", "{") else i + 1

    def end(self, i: int) -> int:
        """Behind the statement that goes on at i: its semicolon, or a line's end where nothing is awaited."""
        first = True
        while i < len(self.t):
            t = self.t[i]
            if t.text == ";":
                return i + 1
            if t.text == "}":
                return i
            if not first and t.fresh and self.t[i - 1].text not in _JOINS | _WORDS and t.text not in _JOINS | _WORDS and t.kind != "template":
                return i
            i, first = self.skip(i), False
        return i

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Behind a type that starts at i: the first of ``stops`` outside brackets and angles, or a line's end."""
        depth, start = 0, i
        while i < len(self.t):
            t = self.t[i]
            if depth <= 0 and i > start and (t.text in stops or t.text == ";" or t.text in (")", "]", "}")):
                return i
            if depth <= 0 and i > start and t.fresh and self.t[i - 1].text not in _JOINS | _WORDS and t.text not in _JOINS | _WORDS:
                return i
            depth += (t.text == "<") - (t.text == ">") - 2 * (t.text == ">>") - 3 * (t.text == ">>>")
            i = self.skip(i)
        return i

    def angles(self, i: int) -> int:
        """Behind type parameters at i, if there are any."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(self.at(i), 0)
            i = self.skip(i)
            if depth <= 0:
                return i
        raise self.src.error("'<' is not closed", self.t[-1].start)

    # Statements.

    def run(self) -> _Script:
        i = 0
        while i < len(self.t):
            j = self.statement(i)
            i = j if j > i else i + 1
        return self

    def statement(self, start: int) -> int:
        i = start
        if self.at(i) == ";":
            return i + 1
        while self.at(i) == "@":  # decorators
            i += 2
            while self.at(i) in (".", "("):
                i = self.skip(i) if self.at(i) == "(" else i + 2
        word = self.at(i)
        if word == "import" and self.at(i + 1) not in ("(", "."):
            return self.import_(i)
        flags = set()
        while self.at(i) in _MODIFIERS and (self.at(i) in ("export", "default") or self.t[i + 1 : i + 2] and self.t[i + 1].kind == "name" and not self.t[i + 1].fresh):
            if self.at(i) == "export":
                if (j := self.export(i)) is not None:
                    return j
            flags.add(self.at(i))
            i += 1
        exported = bool(flags & {"export", "default"})
        if self.at(i) == "const" and self.at(i + 1) == "enum":
            i += 1
        if (j := self.declaration(start, i, exported, "default" in flags)) is not None:
            return j
        if "default" in flags:
            self.exports.append({"name": "default", "source": None, "typeOnly": False})
            return self.end(i)
        if self.at(i) in ("const", "let", "var"):
            return self.variables(i, exported)
        self.common_js(i)
        return self.block_end(i)

    def block_end(self, i: int) -> int:
        """Behind a statement that is no declaration; blocks and headed statements end at their brace."""
        if self.at(i) == "{":
            return self.skip(i)
        if self.at(i) in ("if", "for", "while", "with", "switch", "try", "do", "else", "finally", "catch"):
            i += 1
            while self.at(i) in ("(", "await"):
                i = self.skip(i)
            return self.skip(i) if self.at(i) == "{" else self.statement(i) if i < len(self.t) else i
        return self.end(i)

    def import_(self, i: int) -> int:
        j, only = i + 1, False
        if self.is_string(j):
            self._imported(self.value(j), [], False)
            return self.end(j)
        if self.at(j) == "type" and self.at(j + 1) not in ("from", ",", "="):
            only, j = True, j + 1
        names = []
        while j < len(self.t) and not self.is_string(j) and self.at(j) != ";":
            if self.at(j) == "=":  # import name = require("x")
                return self.end(j)
            if self.at(j) == "{":
                names += [n for n, _ in self._listed(j)]
                j = self.skip(j)
                continue
            if self.at(j) == "*" and self.at(j + 1) == "as":
                names.append(self.at(j + 2))
                j += 3
                continue
            if self.t[j].kind == "name" and not (self.at(j) == "from" and self.is_string(j + 1)):
                names.append(self.at(j))
            j += 1
        if not self.is_string(j):
            raise self.src.error("import has no module", self.t[i].start)
        self._imported(self.value(j), names, only)
        return self.end(j)

    def _imported(self, source: str, names: list[str], only: bool) -> None:
        self.dependencies[source] = None
        self.imports.append({"source": source, "names": names, "typeOnly": only, "static": None, "wildcard": None})

    def _listed(self, i: int) -> list[tuple[str, bool]]:
        """(local or exported name, type only) of each element between the braces at i."""
        out, part = [], []
        for j in range(i + 1, self.src.partner[i] + 1):
            if self.at(j) in (",", "}"):
                words = [self.value(k) if self.is_string(k) else self.at(k) for k in part]
                if words:
                    out.append((words[-1], len(words) in (2, 4) and words[0] == "type" and words[1] != "as"))
                part = []
            else:
                part.append(j)
        return out

    def export(self, i: int) -> int | None:
        """An export that declares nothing; None if a declaration follows."""
        j = i + 1
        only = self.at(j) == "type" and self.at(j + 1) in ("{", "*")
        j += only
        if self.at(j) == "=":
            self.exports.append({"name": "default", "source": None, "typeOnly": False})
            return self.end(j)
        if self.at(j) == "as":  # export as namespace name
            return self.end(j)
        if self.at(j) not in ("{", "*"):
            return None
        listed = self._listed(j) if self.at(j) == "{" else [("*", False)]
        k = self.skip(j)
        while self.at(k) == "as" or (self.at(k) not in ("from", ";", "") and not self.t[k].fresh):
            k += 1
        source = None
        if self.at(k) == "from" and self.is_string(k + 1):
            source = self.value(k + 1) or None
            if source:
                self.dependencies[source] = None
            k += 2
        self.exports += [{"name": n, "source": source, "typeOnly": only or t} for n, t in listed]
        return self.end(k - 1) if k > i + 1 else k

    def declaration(self, start: int, i: int, exported: bool, default: bool) -> int | None:
        word, name, j = self.at(i), self.at(i + 1), i + 2
        named = i + 1 < len(self.t) and self.t[i + 1].kind == "name"
        if word == "function":
            j = i + 1
            j += self.at(j) == "*"
            name = self.at(j) if j < len(self.t) and self.t[j].kind == "name" else "default"
            j = self.angles(j + (name != "default" or self.at(j) == "default"))
            if self.at(j) != "(":
                raise self.src.error("function has no parameters", self.t[i].start)
            signature = f"function {name}({self.parameters(j)})"
            j = self.skip(j)
            if self.at(j) == ":":
                e = self.type_end(j + 1, ("{",)) if self.at(j + 1) != "{" else self.type_end(self.skip(j + 1), ("{",))
                signature += ": " + self.between(j + 1, e)
                j = e
            kind, j = "function", self.skip(j) if self.at(j) == "{" else self.end(j) if j < len(self.t) and not self.t[j].fresh else j
        elif word == "class":
            j = i + 1
            name = name if named and name not in ("extends", "implements") else "default"
            while j < len(self.t) and self.at(j) != "{":
                j = self.skip(j)
            if j >= len(self.t):
                raise self.src.error("class has no body", self.t[i].start)
            kind, signature, j = "class", f"class {name}", self.skip(j)
        elif word in ("interface", "enum") and named and not self.t[i + 1].fresh:
            while j < len(self.t) and self.at(j) != "{":
                j = self.skip(j)
            if j >= len(self.t):
                raise self.src.error(f"{word} has no body", self.t[i].start)
            kind, signature, j = word, f"{word} {name}", self.skip(j)
        elif word == "type" and named and not self.t[i + 1].fresh and self.at(self.angles(i + 2)) == "=":
            j = self.angles(i + 2) + 1
            e = self.type_end(j + (self.at(j) in ("|", "&")), ())
            kind, signature, j = "type", f"type {name} = {self.between(j, e)}", e + (self.at(e) == ";")
        elif (word in ("namespace", "module") and i + 1 < len(self.t) and (named or self.is_string(i + 1)) and not self.t[i + 1].fresh) or (word == "global" and name == "{"):
            first = i if word == "global" else i + 1
            j = first + 1
            while self.at(j) == ".":
                j += 2
            name = self.between(first, j)
            kind, signature, j = "namespace", f"namespace {name}", self.skip(j) if self.at(j) == "{" else self.end(j)
        else:
            return None
        self.symbols.append({"name": name, "kind": kind, "signature": signature, "exported": exported, "line": self.t[start].line})
        if exported:
            self.exports.append({"name": name, "source": None, "typeOnly": kind in ("interface", "type")})
            if default and name != "default":
                self.exports.append({"name": "default", "source": None, "typeOnly": False})
        return j

    def parameters(self, i: int) -> str:
        """The parameters between the brackets at i, with literal defaults as types."""
        out, j, close = [], i + 1, self.src.partner[i]
        while j < close:
            while self.at(j) in ("public", "private", "protected", "readonly", "override", "@") and self.at(j + 1) not in (",", ":", "=", "?", ")"):
                j += 1
            rest = "..." if self.at(j) == "..." else ""
            j += bool(rest)
            k = self.skip(j)
            name, j = self.between(j, k), k
            optional = self.at(j) == "?"
            j += optional
            kind = ""
            if self.at(j) == ":":
                e = self.type_end(j + 1, (",", "="))
                e = min(e, close)
                kind, j = self.between(j + 1, e), e
            default = self.at(j) == "="
            if default:
                t = self.t[j + 1]
                alone = self.at(j + 2) in (",", ")")
                if not kind and alone:
                    kind = "boolean" if t.text in ("true", "false") else t.kind if t.kind in ("string", "number") and not t.text.endswith("n") else ""
                depth = 0
                while j < close and (self.at(j) != "," or depth > 0):
                    depth += (self.at(j) == "<") - (self.at(j) == ">") if self.at(j + 1) in ("(", ",") or depth else 0
                    j = self.skip(j)
            out.append(f"{rest}{name}{'?' if optional or default else ''}{': ' + kind if kind else ''}")
            while j < close and self.at(j) != ",":
                j = self.skip(j)
            j += 1
        return ", ".join(out)

    def variables(self, i: int, exported: bool) -> int:
        word, stop, j = self.at(i), self.end(i), i + 1
        last = stop - (self.at(stop - 1) == ";")
        while j < last:
            first, k = j, self.skip(j)
            name, j = self.between(j, k), k
            j += self.at(j) == "!"
            signature = f"{word} {name}"
            if self.at(j) == ":":
                e = min(self.type_end(j + 1, (",", "=")), last)
                signature += ": " + self.between(j + 1, e)
                j = e
            if self.at(j) == "=" and self.at(j + 1) == "require" and self.at(j + 2) == "(" and self.is_string(j + 3) and self.at(j + 4) == ")" and (j + 5 >= last or self.at(j + 5) == ","):
                self._imported(self.value(j + 3), [name], False)
            self.symbols.append({"name": name, "kind": "variable", "signature": signature, "exported": exported, "line": self.t[first].line})
            if exported:
                self.exports.append({"name": name, "source": None, "typeOnly": False})
            while j < last and self.at(j) != ",":
                j = self.skip(j)
            j += 1
        return stop

    def common_js(self, i: int) -> None:
        words = [self.at(k) for k in range(i, i + 6)]
        if words[:2] == ["exports", "."] and words[3] == "=":
            name = words[2]
        elif words[:4] == ["module", ".", "exports", "."] and words[5] == "=":
            name = words[4]
        elif words[:4] == ["module", ".", "exports", "="]:
            name = "default"
        else:
            return
        self.exports.append({"name": name, "source": None, "typeOnly": False})


def analyze(text: str) -> dict:
    """Imports, exports, symbols and dependencies; raises ``ParseError``."""
    s = _Script(text).run()
    return {"imports": s.imports, "exports": s.exports, "symbols": s.symbols, "dependencies": list(s.dependencies), "packageName": None}


__all__ = ["ParseError", "analyze"]
