"""Python files as graph rows: definitions, imports, calls and the literals that calls are given."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field


@dataclass
class Parsed:
    definitions: list[tuple[str, str, int, int]] = field(default_factory=list)  # node type, name, first and last line
    imports: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)  # names of local definitions, one for each call
    literals: list[str] = field(default_factory=list)


def is_target(text: str) -> bool:
    return text.startswith(("http://", "https://")) or (text.startswith("/") and len(text) > 1)


def apart(a: dict, b: dict) -> bool:
    """Whether two sets of arms, each {branch: arm}, hold different arms of one branch."""
    return any(k in b and b[k] != arm for k, arm in a.items())


def chosen(found: list[tuple]) -> str | None:
    """The value of assignments (place, arms, value): the one they agree on; none if two of different value exclude each other; else the last one's."""
    if len({v for *_, v in found}) <= 1:
        return found[0][2] if found else None
    groups: dict[frozenset, set] = {}  # assignments in the same arms don't exclude each other
    for _, arms, value in found:
        groups.setdefault(frozenset(arms.items()), set()).add(value)
    sets = [(dict(k), v) for k, v in groups.items()]
    if any(len(v | w) > 1 and apart(a, b) for i, (a, v) in enumerate(sets) for b, w in sets[i + 1 :]):
        return None
    return max(found, key=lambda x: x[0])[2]


class _Module:
    """A module with, for each node, its enclosing function and the branch arms that it stands in."""

    def __init__(self, source: str):
        self.source, self.tree = source, ast.parse(source)
        self.function: dict[ast.AST, ast.AST | None] = {}
        self.arms: dict[ast.AST, dict[int, str]] = {}
        self.order: list[ast.AST] = []
        self.assigned: dict[tuple[ast.AST | None, str], list[ast.AST]] = {}
        self.busy: set[ast.AST] = set()
        self.known: dict[ast.AST, str | None] = {}
        self.cut = False  # whether the resolution that is going on met itself
        self._walk(self.tree, None, {})

    def _walk(self, node: ast.AST, function, arms: dict[int, str]) -> None:
        self.function[node], self.arms[node] = function, arms
        self.order.append(node)
        target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) and node.value else None
        if isinstance(target, ast.Name):
            # a function's own assignments, and for a search in an outer function those of inner ones too
            holder = function
            while True:
                self.assigned.setdefault((holder, target.id), []).append(node)
                if holder is None:
                    break
                holder = self.function[holder]
                if holder is None:
                    break
        inner = node if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else function
        if isinstance(node, ast.If):
            self._walk(node.test, inner, arms)
            mine = {**arms, id(node): "then"}
            for x in node.body:
                self._walk(x, inner, mine)
            self._else(node.orelse, inner, {**arms, id(node): "else"})
        elif isinstance(node, (ast.Try, ast.TryStar)):
            for arm, part in (("try", node.body), ("except", node.handlers), ("try", node.orelse), (None, node.finalbody)):
                for x in part:
                    self._walk(x, inner, {**arms, id(node): arm} if arm else arms)
        else:
            for x in ast.iter_child_nodes(node):
                self._walk(x, inner, arms)

    def _else(self, body: list[ast.stmt], function, arms: dict[int, str]) -> None:
        """elif arms are one arm with else: they don't exclude each other."""
        if len(body) == 1 and isinstance(body[0], ast.If) and self.source_is_elif(body[0]):
            node = body[0]
            self.function[node], self.arms[node] = function, arms
            self._walk(node.test, function, arms)
            for x in node.body:
                self._walk(x, function, arms)
            self._else(node.orelse, function, arms)
        else:
            for x in body:
                self._walk(x, function, arms)

    def source_is_elif(self, node: ast.If) -> bool:
        return (self.text(node) or "").startswith("elif") or self.source.splitlines()[node.lineno - 1][node.col_offset :].startswith("elif")

    def text(self, node: ast.AST) -> str | None:
        return ast.get_source_segment(self.source, node)

    def exclusive(self, a: ast.AST, b: ast.AST) -> bool:
        return apart(self.arms[a], self.arms[b])

    def resolve(self, node: ast.AST) -> str | None:
        """The literal that an expression stands for, with {} for what isn't known; None if nothing is."""
        if node in self.known:
            return self.known[node]
        if node in self.busy:
            self.cut = True
            return None
        before, self.cut = self.cut, False
        self.busy.add(node)
        try:
            found = self._resolve(node)
        finally:
            self.busy.discard(node)
        if not self.cut:
            self.known[node] = found
        self.cut = before or self.cut
        return found

    def _resolve(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes)):
            return self._quoted(node)
        if isinstance(node, ast.JoinedStr):
            return self._formatted(node)
        if isinstance(node, ast.Name):
            return self._name(node)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            parts = [self.resolve(x) for x in (node.left, node.right)]
            parts = ["{}" if x is None else x for x in parts]
            return None if parts == ["{}", "{}"] else "".join(parts)
        if isinstance(node, ast.Call) and ast.unparse(node.func) in ("os.getenv", "os.environ.get") and len(node.args) > 1:
            return self.resolve(node.args[1])
        return None

    def _quoted(self, node: ast.Constant) -> str | None:
        """The text between the quotes as it is written; strings that stand side by side are not one literal."""
        raw = (self.text(node) or "").lstrip("bBfFrRuU")
        quote = raw[:1]
        if quote not in ("'", '"') or len(raw) < 2 or raw[-1] != quote:
            return None
        inner = raw[1:-1]
        if raw[:3] != quote * 3:
            bare = inner.replace("\\\\", "").replace("\\" + quote, "")
            if quote in bare:
                return None
        return inner

    def _formatted(self, node: ast.JoinedStr) -> str:
        out = []
        for x in node.values:
            if isinstance(x, ast.FormattedValue):
                found = self.resolve(x.value)
                out.append("{}" if found is None else found)
            else:
                out.append(str(x.value))
        return "".join(out)

    def _name(self, use: ast.Name) -> str | None:
        scopes = [self.function[use], None] if self.function[use] is not None else [None]
        for scope in scopes:
            before = []
            for x in self.assigned.get((scope, use.id), []):
                if scope is None and self.function[x] is not None:
                    continue
                place = (use.lineno, use.col_offset)
                if (x.lineno, x.col_offset) < place and not place < (x.end_lineno, x.end_col_offset):  # earlier, and the use is no part of it
                    literal = self.resolve(x.value)
                    if literal is not None:
                        before.append((x, literal))
            if not before:
                continue  # assignments that tell nothing don't hide the module's
            fit = [(x, s) for x, s in before if not self.exclusive(x, use)]
            return chosen([((x.lineno, x.col_offset), self.arms[x], s) for x, s in fit])
        return None


def parse(source: str, strict: bool = False) -> Parsed:
    """Definitions directly in the module, imports at any depth, calls of those definitions, and literals that look like targets.

    strict: decorated definitions are left out, as the original does. A file that doesn't parse raises SyntaxError.
    """
    module, out = _Module(source), Parsed()
    for node in module.tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not (strict and node.decorator_list):
            out.definitions.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno))
    names = {d[1] for d in out.definitions}
    for node in sorted((n for n in module.order if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0))):
        if isinstance(node, ast.Import) or (isinstance(node, ast.ImportFrom) and node.module != "__future__"):
            out.imports.append(module.text(node) or "")
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id in names:
                out.calls.append(node.func.id)
            literal = module.resolve(node.args[0]) if node.args and not isinstance(node.args[0], ast.Starred) else None
            if literal is not None and is_target(literal):
                out.literals.append(literal)
    return out
