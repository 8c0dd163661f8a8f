"""A small language for rules: statements that name transducers, and functions over them.

    import 'other.grm' as o;      names of another file, as o.x
    x = e;   export y = e;        a name; an exported name is a rule of the result
    func F[a, b] { z = e; return e; }

Expressions, the loosest first: weight ``e <w>``; ``a : b`` pairs; ``a | b`` union;
``a @ b`` composition; ``a - b`` difference; ``a b`` concatenation; ``e* e+ e? e{m} e{m,n}``;
then strings, names, calls ``F[...]`` and brackets. Strings in double quotes may end in
``.byte``, ``.utf8`` or the name of a symbol table; in single quotes they are plain text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from . import fst, pushdown
from .cdrewrite import cdrewrite
from .fst import Fst, accep
from .rules import Cascade, Registry, top_rewrites

TOKEN = re.compile(r"""(?P<skip>\s+|\#[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<raw>'(?:[^'\\]|\\.)*')|(?P<weight><[^<>]*>)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(?P<number>\d+)|(?P<mark>[=;:|@\-*+?{}\[\](),.])""")
KEYWORDS = {"import", "as", "export", "func", "return"}


class GrammarError(ValueError):
    pass


@dataclass
class Node:
    """kind: string, raw, name, call, weight, or an operator; value: its text; parts: what it is made of."""

    kind: str
    value: object = None
    parts: list[Node] = field(default_factory=list)


@dataclass
class Statement:
    kind: str  # import, rule, export, func, return
    name: str
    body: object


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise GrammarError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    def peek(self, value: str | None = None) -> bool | tuple[str, str]:
        return self.tokens[self.at] if value is None else self.tokens[self.at][1] == value and self.tokens[self.at][0] not in ("string", "raw")

    def take(self, value: str | None = None) -> str:
        kind, text = self.tokens[self.at]
        if value is not None and text != value:
            raise GrammarError(f"expected {value!r}, found {text!r}")
        self.at += 1
        return text

    def statements(self, end: str = "") -> list[Statement]:
        out = []
        while not (self.peek()[0] == "end" if not end else self.peek(end)):
            out.append(self.statement())
        return out

    def statement(self) -> Statement:
        if self.peek("import"):
            self.take()
            path = self.take()[1:-1]
            self.take("as")
            name = self.take()
            self.take(";")
            return Statement("import", name, path)
        if self.peek("func"):
            self.take()
            name, names = self.take(), []
            self.take("[")
            while not self.peek("]"):
                names.append(self.take())
                if self.peek(","):
                    self.take()
            self.take("]")
            self.take("{")
            body = self.statements("}")
            self.take("}")
            return Statement("func", name, (names, body))
        if self.peek("return"):
            self.take()
            e = self.expression()
            self.take(";")
            return Statement("return", "", e)
        kind = "export" if self.peek("export") else "rule"
        if kind == "export":
            self.take()
        name = self.take()
        self.take("=")
        e = self.expression()
        self.take(";")
        return Statement(kind, name, e)

    def expression(self) -> Node:
        left = self.level(0)
        if self.peek(":"):
            self.take()
            left = Node(":", parts=[left, self.level(0)])
        if self.peek()[0] == "weight":
            left = Node("weight", self.take()[1:-1], [left])
        return left

    def level(self, k: int) -> Node:
        """0 union (right), 1 composition (left), 2 difference (left), 3 concatenation (right)."""
        if k == 3:
            parts = [self.repetition()]
            while self.peek()[0] in ("string", "raw", "name") or self.peek("("):
                parts.append(self.repetition())
            node = parts.pop()
            while parts:
                node = Node("concat", parts=[parts.pop(), node])
            return node
        mark = "|@-"[k]
        node = self.level(k + 1)
        if k == 0:
            if self.peek(mark):
                self.take()
                return Node("|", parts=[node, self.level(0)])
            return node
        while self.peek(mark):
            self.take()
            node = Node(mark, parts=[node, self.level(k + 1)])
        return node

    def repetition(self) -> Node:
        node = self.atom()
        while self.peek("*") or self.peek("+") or self.peek("?") or self.peek("{"):
            mark = self.take()
            low, high = {"*": (0, 0), "+": (1, 0), "?": (0, 1)}.get(mark, (0, 0))
            if mark == "{":
                low = high = int(self.take())
                if self.peek(","):
                    self.take()
                    high = int(self.take())
                self.take("}")
            node = Node("repeat", (low, high), [node])
        return node

    def atom(self) -> Node:
        kind, text = self.peek()
        if kind == "string":
            self.take()
            mode = None
            if self.peek("."):
                self.take()
                mode = self.take()
            return Node("string", (text[1:-1], mode))
        if kind == "raw":
            self.take()
            return Node("raw", text[1:-1])
        if self.peek("("):
            self.take()
            node = self.expression()
            self.take(")")
            return node
        if kind == "name" and text not in KEYWORDS:
            self.take()
            if self.peek("["):
                self.take()
                parts = []
                while not self.peek("]"):
                    parts.append(self.expression())
                    if self.peek(","):
                        self.take()
                self.take("]")
                return Node("call", text, parts)
            return Node("name", text)
        if kind == "number":
            return Node("raw", self.take())
        raise GrammarError(f"unexpected {text!r}")


FUNCTIONS: dict[str, tuple[range, Callable]] = {}


def rule_function(name: str, *counts: int):
    """Registers a function of the language; counts: how many arguments it takes."""

    def add(f: Callable) -> Callable:
        FUNCTIONS[name] = (counts, f)
        return f

    return add


def _text(x) -> str:
    return x if isinstance(x, str) else x.string()


def _check(ok: bool, what: str):
    if not ok:
        raise GrammarError(what)


for _name, _counts, _f in (
    ("Closure", (2, 4), lambda a, kind, low="0", high="0": fst.closure(a, {"+": 1}.get(_text(kind), 0) if not int(_text(low)) else int(_text(low)), {"?": 1}.get(_text(kind), 0) if not int(_text(high)) else int(_text(high)))),
    ("Compose", (2, 3), lambda a, b, side="left": fst.compose(a, b)),
    ("Concat", (2,), fst.concat),
    ("ConcatDelayed", (2,), fst.concat),
    ("Union", (2,), fst.union),
    ("UnionDelayed", (2,), fst.union),
    ("Difference", (2,), fst.difference),
    ("Rewrite", (2,), fst.cross),
    ("LenientlyCompose", (3,), fst.leniently_compose),
    ("Determinize", (1,), fst.determinize),
    ("Minimize", (1,), fst.minimize),
    ("Optimize", (1,), fst.optimize),
    ("RmEpsilon", (1,), fst.rmepsilon),
    ("RmWeight", (1,), fst.rmweight),
    ("Invert", (1,), fst.invert),
    ("Reverse", (1,), fst.reverse),
    ("ArcSort", (1, 2), lambda a, side="input": fst.arcsort(a)),
    ("Project", (2,), lambda a, side: fst.project(a, _text(side))),
    ("CDRewrite", (4, 5, 6), lambda t, left, right, s, d="ltr", m="obl": cdrewrite(t, left, right, s, _text(d), _text(m))),
    ("PdtCompose", (3, 4, 5), lambda a, b, parens, side="right_pdt", *rest: pushdown.compose_expanded(a, b, parens, None, "left" in _text(side))),
    ("MPdtCompose", (4, 5, 6), lambda a, b, parens, assign, side="right_mpdt", *rest: pushdown.compose_expanded(a, b, parens, assign, "left" in _text(side))),
):
    FUNCTIONS[_name] = (_counts, _f)


@rule_function("AssertEqual", 2, 3)
def _assert_equal(a: Fst, b: Fst, n="1") -> Fst:
    _check(fst.equivalent(fst.optimize(fst.project(fst.as_fst(a), "output")), fst.optimize(fst.project(fst.as_fst(b), "output"))), "AssertEqual fails")
    return a


@rule_function("AssertEmpty", 1)
def _assert_empty(a: Fst) -> Fst:
    found = list(fst._limited(fst.best_paths(a, 2), 2))
    _check(len(found) == 1 and not found[0][1], "AssertEmpty fails")
    return a


@rule_function("AssertNull", 1)
def _assert_null(a: Fst) -> Fst:
    _check(fst.connect(a).start < 0, "AssertNull fails")
    return a


@dataclass
class Evaluator:
    """Evaluates a parsed file; other files, string files and stored rules are found by the readers given."""

    read: Callable[[str], str] = lambda path: Path(path).read_text()
    values: dict[str, object] = field(default_factory=dict)
    functions: dict[str, tuple[list[str], list[Statement]]] = field(default_factory=dict)
    exported: dict[str, Fst] = field(default_factory=dict)
    optimise_all: bool = False
    archive: dict[str, Fst] = field(default_factory=dict)

    def run(self, statements: list[Statement]) -> dict[str, Fst]:
        for s in statements:
            if s.kind == "import":
                other = Evaluator(self.read, archive=self.archive)
                other.run(Parser(self.read(s.body)).statements())
                self.values |= {f"{s.name}.{k}": v for k, v in other.values.items()}
                self.functions |= {f"{s.name}.{k}": v for k, v in other.functions.items()}
                for k, v in list(other.functions.items()):  # its functions still find its names
                    self.values.setdefault(f"{s.name}.{k}()", other)
            elif s.kind == "func":
                self.functions[s.name] = s.body
            else:
                value = self.value(s.body)
                if s.kind == "export" or self.optimise_all:
                    value = fst.optimize(fst.as_fst(value)) if isinstance(value, (Fst, str)) else value
                self.values[s.name] = value
                if s.kind == "export":
                    self.exported[s.name] = value
        return self.exported

    def value(self, node: Node):
        if node.kind == "string":
            text, mode = node.value
            if mode not in (None, "byte", "utf8"):
                mode = self.values[mode]
            return accep(text, mode=mode or "byte")
        if node.kind == "raw":
            return node.value
        if node.kind == "name":
            if node.value not in self.values:
                raise GrammarError(f"unknown name {node.value}")
            return self.values[node.value]
        if node.kind == "call":
            return self.call(node.value, [self.value(p) for p in node.parts])
        parts = [self.value(p) for p in node.parts]
        if node.kind == "weight":
            return fst.concat(accep("", float(node.value)), parts[0])
        if node.kind == "repeat":
            return fst.closure(parts[0], *node.value)
        return {":": fst.cross, "|": fst.union, "@": fst.compose, "-": fst.difference, "concat": fst.concat}[node.kind](*parts)

    def call(self, name: str, args: list):
        if name in self.functions:
            names, body = self.functions[name]
            _check(len(names) == len(args), f"{name} takes {len(names)} arguments")
            home = self.values.get(f"{name}()", self)
            inner = Evaluator(self.read, {k: v for k, v in home.values.items() if "." in k} | dict(zip(names, args, strict=True)), home.functions, archive=self.archive)
            for s in body:
                if s.kind == "return":
                    return inner.value(s.body)
                inner.values[s.name] = inner.value(s.body)
            raise GrammarError(f"{name} returns nothing")
        if name == "StringFile":
            rows = [line.split("\t") for line in self.read(args[0]).splitlines() if line.strip() and not line.startswith("#")]
            return fst.string_map(rows, *[m if isinstance(m, dict) else _text(m) for m in args[1:]])
        if name == "SymbolTable":
            return {k: int(v) for k, v in (line.split() for line in self.read(args[0]).splitlines() if line.strip())}
        if name in ("LoadFst", "LoadFstFromFar"):
            return self.archive[args[-1]]
        if name == "Replace":
            root, *pairs = args
            return fst.replace(root, {next(iter(pairs[k].labels())): pairs[k + 1] for k in range(0, len(pairs), 2)})
        if name in ("Feature", "Category", "FeatureVector", "Analyzer", "Tagger", "ParadigmReplace"):
            from . import morphology

            return morphology.GRAMMAR[name](*args)
        if name not in FUNCTIONS:
            raise GrammarError(f"unknown function {name}")
        counts, f = FUNCTIONS[name]
        _check(not counts or len(args) in counts, f"{name} takes {' or '.join(map(str, counts))} arguments")
        return f(*args)


def compile_grammar(text: str, read: Callable[[str], str] | None = None, archive: dict[str, Fst] | None = None) -> Registry:
    """The exported rules of a grammar."""
    made = Evaluator(read or (lambda path: Path(path).read_text()), archive=archive or {})
    return Registry(made.run(Parser(text).statements()))


def try_rules(rules: Registry, names: list[str], text: str, n: int = 1) -> list[tuple[str, float]]:
    """Up to n outputs of a cascade for one string, with costs; for trying a grammar out."""
    found = Cascade([rules[x] for x in names]).lattice(text)
    return [(fst.text_of(o), w) for _, o, w in fst.best_paths(found, n, True)] if len(names) != 1 else top_rewrites(text, rules[names[0]], n)


def cases_hold(rules: Registry, cases: list[dict], mode: str = "exact") -> list[bool]:
    """Grammar tests: rule names, input and outputs; exact, one_top, subset or top. No outputs: the input must fail."""
    from .rules import RewriteError

    held = []
    for case in cases:
        cascade = Cascade([rules[x] for x in case["rule"]])
        try:
            every = cascade.rewrites(case["input"])
        except RewriteError:
            every = []
        want = list(case.get("output", []))
        best = every[:1]
        held.append(not every if not want else {"exact": set(every) == set(want), "one_top": best == want[:1], "subset": set(want) <= set(every), "top": every[: len(want)] == want}[mode])
    return held
