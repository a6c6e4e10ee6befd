"""JavaScript and TypeScript files as graph rows, by a small tokenizer: definitions at depth 0, imports, calls and target literals."""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from itertools import accumulate, chain

from .parse_py import Parsed, apart, chosen, is_target

# Space and comments, and the token that they stand before; the last one of a file is empty.
TOKEN = re.compile(
    r"""((?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+)([A-Za-z_$][\w$]*|=>|\?\?|\|\||&&|===|!==|==|!=|[-+*/%&|^!~?:;,.<>=(){}\[\]@#]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\d[\w.]*|\Z|.)""",
    re.S | re.X,
)
# Words and marks by their first character.
KINDS = {**dict.fromkeys(string.ascii_letters + "_$", "word"), **dict.fromkeys("-+*/%&|^!~?:;,.<>=(){}[]@#", "mark")}
PART = re.compile(r"\$\{([^{}]*)\}")
KEYWORDS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "super"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
OUTER = {"import", "function", "class", "const", "let"}
TELLING = {*OPEN, *CLOSE, *OUTER, "var", "=>"}


def _kind(text: str) -> str:
    """The kind of a token that is neither a word nor a mark; a quote that never closes is of no kind."""
    if text[0] in "\"'`":
        return "other" if len(text) == 1 else "template" if text[0] == "`" else "string"
    return "number" if text[0].isdecimal() else "other"


class _File:
    def __init__(self, source: str):
        self.source = source
        found = TOKEN.findall(source)
        texts = [text for _, text in found]
        del texts[texts.index("") :]
        places = list(accumulate(map(len, chain.from_iterable(found))))
        kinds = [KINDS.get(text[0]) or _kind(text) for text in texts]
        self.tokens = tokens = list(zip(kinds, texts, places[::2], places[1::2]))  # kind, text, begin, end
        self.depth, stack, self.match = [], [], {}
        self.heads: list[int] = []  # words that a bracket follows, and so all that may be a call, a method or an if
        self.marked: list[int] = []  # words and arrows that functions begin with
        self.outer: list[int] = []  # words at depth 0 that a definition or an import may begin with
        declarations, told = [], 0
        for i in [i for i, text in enumerate(texts) if text in TELLING]:
            text = texts[i]
            if text in CLOSE:
                self.depth += [len(stack)] * (i - told)
                told = i
                if stack:
                    self.match[stack.pop()] = i
            elif text in OPEN:
                self.depth += [len(stack)] * (i + 1 - told)
                told = i + 1
                stack.append(i)
                if text == "(" and i and kinds[i - 1] == "word":
                    self.heads.append(i - 1)
            else:
                if text in ("function", "=>"):
                    self.marked.append(i)
                elif text in ("const", "let", "var"):
                    declarations.append(i)
                if not stack and text in OUTER:
                    self.outer.append(i)
        self.depth += [len(stack)] * (len(texts) - told)
        if stack:
            raise SyntaxError(f"{tokens[stack[-1]][1]} is never closed")
        self.match_back = {j: i for i, j in self.match.items()}
        self.scopes()
        self.values: dict[str, list[tuple[int, int, int]]] = {}  # name: where its declaration begins, and its value's tokens
        for i in declarations:
            self.declared(i)
        self.busy: set[tuple[int, int]] = set()
        self.known: dict[tuple[int, int], str | None] = {}
        self.cut = False  # whether the resolution that is going on met itself

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def declared(self, i: int) -> None:
        """The names and values of one const, let or var, which may declare several; types are passed over."""
        j = i + 1
        while j < len(self.tokens) and self.tokens[j][0] == "word":
            k = j + 1
            while self.at(j + 1) == ":" and k < len(self.tokens) and self.at(k) not in ("=", ";", ",") and self.depth[k] == self.depth[j]:
                k = self.match.get(k, k) + 1
            if self.at(k) == "=":
                end = self.end_of(k + 1, ";,")
                self.values.setdefault(self.at(j), []).append((j, k + 1, end))
                k = end
            if self.at(k) != ",":
                return
            j = k + 1

    def scopes(self) -> None:
        """For each token the innermost function around it, and the arms of the ifs around it.

        Functions are declarations and expressions (but generators), arrows and methods. An if's arms exclude each other; what stands in an else, and
        so an else if, is in its other arm. The parts of a try don't exclude each other, as in the original for this language.
        """
        n = len(self.tokens)
        functions, arms = [], []
        for i in self.marked:
            if self.at(i) == "=>":
                begin = self.match_back.get(i - 1, i - 1)
                if self.at(i - 1) != ")":  # a type may stand between the parameters and the arrow
                    back = next((j for j in range(i - 1, max(i - 12, -1), -1) if self.at(j) == ":" and self.at(j - 1) == ")" and self.depth[j] == self.depth[i]), None)
                    begin = self.match_back.get(back - 1, begin) if back is not None else begin
                functions.append((begin, self.match[i + 1] + 1 if self.at(i + 1) == "{" else self.end_of(i + 1)))
            elif self.at(i + 1) != "*":
                j = i + 1 if self.at(i + 1) == "(" else i + 2
                body = self.body(self.match.get(j)) if self.at(j) == "(" else None
                if body is not None:
                    functions.append((i, self.match[body] + 1))
        for i in self.heads:
            text = self.at(i)
            if text not in KEYWORDS:
                if self.at(i - 1) in ("{", "}", ";", ",", "async", "static", "get", "set", "public", "private", "protected", ")"):
                    body = self.body(self.match.get(i + 1))
                    if body is not None:
                        functions.append((i, self.match[body] + 1))
            elif text == "if" and self.at(i - 1) != ".":
                then, other = self.arms_of(i)
                arms += [(*then, (i, True)), *([(*other, (i, False))] if other else [])]
        self.function = self._around(functions, n, lambda held, x: x, None)
        self.arms = self._around(arms, n, lambda held, x: {**held, x[2][0]: x[2][1]}, {})

    @staticmethod
    def _around(spans: list[tuple], n: int, add, nothing):
        """Tells for each token what the spans around it, the outermost first, add up to; that changes only where a span begins or ends."""
        spans, starts, out, open_ = sorted(spans, key=lambda x: (x[0], -x[1])), [], [], [(n + 1, nothing)]
        k = 0
        for i in sorted({x for a, b, *_ in spans for x in (a, b)}):
            while open_[-1][0] <= i and len(open_) > 1:
                open_.pop()
            while k < len(spans) and spans[k][0] == i:
                open_.append((spans[k][1], add(open_[-1][1], spans[k])))
                k += 1
            starts.append(i)
            out.append(open_[-1][1])

        def at(i: int):
            k = bisect_right(starts, i)
            return out[k - 1] if k else nothing

        return at

    def body(self, close: int | None) -> int | None:
        """The brace that opens a function's body after its parameters, and a type, if there is one."""
        if close is None:
            return None
        j = close + 1
        if self.at(j) == ":":
            while j < len(self.tokens) and self.at(j) not in ("{", ";", ",", "=>") and self.depth[j] == self.depth[close]:
                j = self.match.get(j, j) + 1
        return j if self.at(j) == "{" and j in self.match else None

    def statement_end(self, i: int) -> int:
        """The token after the statement that begins at i."""
        if self.at(i) == "{":
            return self.match[i] + 1
        if self.at(i) == "if" and self.at(i + 1) == "(":
            then, other = self.arms_of(i)
            return (other or then)[1]
        end = self.end_of(i, ";")
        return end + (self.at(end) == ";")

    def arms_of(self, i: int) -> tuple[tuple[int, int], tuple[int, int] | None]:
        begin = self.match.get(i + 1, i + 1) + 1
        end = self.statement_end(begin)
        return (begin, end), ((end, self.statement_end(end + 1)) if self.at(end) == "else" else None)

    def end_of(self, i: int, stop: str = ";,") -> int:
        """The token after the expression that begins at i."""
        depth = self.depth[i] if i < len(self.depth) else 0
        j = i
        while j < len(self.tokens):
            kind, text, begin, _ = self.tokens[j]
            if self.depth[j] < depth or (self.depth[j] == depth and kind == "mark" and text in stop):
                return j
            if kind == "mark" and text in CLOSE and self.depth[j] == depth and j not in self.match_back:
                return j
            if j > i and self.depth[j] == depth and "\n" in self.source[self.tokens[j - 1][3] : begin] and kind == "word" and self.tokens[j - 1][0] != "mark":
                return j
            j = self.match.get(j, j) + 1
        return j

    def line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    def resolve(self, a: int, b: int) -> str | None:
        """The literal that tokens a to b stand for, with {} for what isn't known."""
        if a >= b:
            return None
        if (a, b) in self.known:
            return self.known[a, b]
        if (a, b) in self.busy:
            self.cut = True
            return None
        before, self.cut = self.cut, False
        self.busy.add((a, b))
        try:
            found = self._resolve(a, b)
        finally:
            self.busy.discard((a, b))
        if not self.cut:
            self.known[a, b] = found
        self.cut = before or self.cut
        return found

    def _resolve(self, a: int, b: int) -> str | None:
        top = [j for j in self._level(a, b) if self.tokens[j][0] == "mark"]
        for sign in ("||", "??"):
            at = [j for j in top if self.tokens[j][1] == sign]
            if at:
                left = self.source[self.tokens[a][2] : self.tokens[at[-1]][2]].replace(" ", "")
                return self.resolve(at[-1] + 1, b) if left.startswith("process.env.") else None
        plus = [j for j in top if self.tokens[j][1] == "+"]
        if plus:
            parts = [self.resolve(x, y) for x, y in ((a, plus[-1]), (plus[-1] + 1, b))]
            parts = ["{}" if x is None else x for x in parts]
            return None if parts == ["{}", "{}"] else "".join(parts)
        if b - a > 1:
            return None
        kind, text, *_ = self.tokens[a]
        if kind == "string":
            return text[1:-1]
        if kind == "template":
            return PART.sub(lambda m: (self.named(m[1].strip(), a) if re.fullmatch(r"[A-Za-z_$][\w$]*", m[1].strip()) else None) or "{}", text[1:-1])
        return self.named(text, a) if kind == "word" else None

    def named(self, name: str, use: int) -> str | None:
        """What a name stands for at a token: its declarations in the function around it; if these tell nothing, those of the module outside functions.

        Earlier declarations count that the use isn't part of. Those in another arm of an if than the use go. Of one value it is that; of several
        that exclude each other none; else the last one.
        """
        mine, other = self.function(use), self.arms(use)
        for scope in [mine, None] if mine is not None else [None]:
            before = []
            for at, x, y in self.values.get(name, []):
                inside = self.function(at) is None if scope is None else scope[0] <= at < scope[1]
                if inside and at < use and not at <= use < y and (found := self.resolve(x, y)) is not None:
                    before.append((at, found))
            if not before:
                continue
            return chosen([(at, arms, v) for at, v in before if not apart(arms := self.arms(at), other)])
        return None

    def _level(self, a: int, b: int):
        j = a
        while j < b:
            yield j
            j = self.match.get(j, j) + 1


def parse(source: str, strict: bool = False) -> Parsed:
    """Functions, classes and constants with a function at depth 0, imports, calls of those by name, and target literals.

    Exported definitions count unless strict. Decorators are passed over. Brackets that never close raise SyntaxError.
    """
    file, out = _File(source), Parsed()
    t = file.tokens
    for i in file.outer:
        _, text, begin, _ = t[i]
        if text == "import" and i + 1 < len(t) and t[i + 1][1] not in ("(", "."):
            last = next((j for j in range(i + 1, len(t)) if t[j][0] == "string"), i)
            out.imports.append(source[begin : t[last][3]])
        exported = i > 0 and t[i - 1][1] in ("export", "default")
        if exported and strict:
            continue
        start = i - 1 if i > 0 and t[i - 1][1] == "async" else i
        if text in ("function", "class"):
            name = next((j for j in range(i + 1, min(i + 3, len(t))) if t[j][0] == "word"), None)
            body = next((j for j in range(i + 1, len(t)) if t[j][1] == "{" and file.depth[j] == 0), None)
            if name is not None and body is not None and (i == 0 or t[i - 1][1] not in ("=", "(", ",", "return", ":")):
                out.definitions.append((text, t[name][1], file.line(t[start][2]), file.line(t[file.match[body]][2])))
        elif text in ("const", "let") and i + 2 < len(t) and t[i + 2][1] == "=":
            stop = file.end_of(i + 3, ";")
            mine = list(file._level(i + 3, stop))
            if any(t[j][1] == "=>" for j in mine) or (mine and t[mine[0]][1] in ("function", "async")):
                out.definitions.append(("function", t[i + 1][1], file.line(begin), file.line(t[stop - 1][2])))
    names = {d[1] for d in out.definitions}
    for i in file.heads:
        if i > 0 and t[i - 1][1] in ("function", "new"):
            continue
        if t[i][1] in ("if", "for", "while", "switch", "catch", "function", "return"):
            continue
        if t[i][1] in names and (i == 0 or t[i - 1][1] != "."):
            out.calls.append(t[i][1])
        stop = file.match.get(i + 1, i + 1)
        first = next((j for j in file._level(i + 2, stop) if t[j][1] == ","), stop)
        literal = file.resolve(i + 2, first)
        if literal is not None and is_target(literal):
            out.literals.append(literal)
    return out
