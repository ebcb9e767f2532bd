"""A small sandboxed template language for conversations: parsed to a tree, folded, compiled to Python closures.

    {% control '<s>' '</s>' %}            strings that texts must not hold; the filter escape keeps them out
    {% set name = expression %}           a constant
    text {{ expression }} {# comment #}   a hyphen inside a tag strips the white space beside it
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% for message in messages %} .. {% endfor %}      once, at the top level; what stands before and after is rendered once
    {% generation %} .. {% endgeneration %}            what is rendered here is under the loss mask

Expressions are strings, whole numbers, true and false, constants, message.role, message.content, loop.index,
loop.index0, loop.first and loop.last; not, and, or, ==, !=, <, <=, >, >=, in, ~ (joins as text), a if c else b,
brackets, and the filters trim, upper, lower and escape. There is nothing else: no calls, attributes, imports or loops,
so a template can neither reach Python objects nor run longer than its own length for each turn. Faults are a TemplateError when
it is compiled. Since a turn is all that a template sees, conversations are rendered as a stream of turns.

Escaping puts a backslash behind the first character of each control string, and one more where some stand there already, so it can be
undone exactly: only strings that are, or are like, escaped control strings change. A control string starts with a character
that is in no other place of any control string, and has no backslash; these are checked.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, NamedTuple

#: What any template may hold at most, in characters, nested blocks or brackets, and parts of an expression.
LONGEST, DEEPEST, MOST_PARTS = 1 << 16, 50, 200
#: A string inside a tag may hold the tag's own end.
INSIDE = r"""(?:'[^']*'|"[^"]*"|[^'"])*?"""
TAG = re.compile(rf"\{{\{{(-?)({INSIDE})(-?)\}}\}}|\{{%(-?)({INSIDE})(-?)%\}}|\{{#(-?).*?(-?)#\}}", re.S)
LEXEME = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>~|().=]))""")
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: as_text(a) in as_text(b)}
FIELDS = {("message", "role"), ("message", "content"), ("loop", "index"), ("loop", "index0"), ("loop", "first"), ("loop", "last")}
WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "message", "loop", "messages"}


class TemplateError(ValueError):
    pass


class Turn(NamedTuple):
    """What a template sees."""

    role: str
    content: str
    index: int
    first: bool
    last: bool


@dataclass(frozen=True)
class Node:
    """kind: const, get, not, and, or, ~, compare, filter, choose; or text, out, if, generation. Items are nodes or plain values."""

    kind: str
    items: tuple = ()


@dataclass
class Output:
    """Rendered text and the spans under the loss mask, in code points."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[int] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def as_text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


# -- escaping


def controls_pattern(controls: Iterable[str], least: int) -> re.Pattern | None:
    """First characters of control strings that are followed by at least ``least`` backslashes and the rest."""
    rests: dict[str, list[str]] = {}
    for control in sorted(set(controls), key=len, reverse=True):
        rests.setdefault(control[0], []).append(re.escape(control[1:]))
    ways = [rf"(?<={re.escape(c)})\\{{{least},}}(?={'|'.join(rest)})" for c, rest in rests.items()]
    return re.compile("|".join(ways)) if ways else None


def checked_controls(controls: list[str]) -> list[str]:
    for control in controls:
        if len(control) < 2 or "\\" in control or any(control[0] in other[1:] for other in controls):
            raise TemplateError(f"not a control string: {control!r}")
    return controls


def replacer(controls: Iterable[str], least: int, change: Callable[[re.Match], str]) -> Callable[[str], str]:
    pattern, starts = controls_pattern(controls, least), {c[0] for c in controls}
    return lambda text: pattern.sub(change, text) if any(c in text for c in starts) else text


def escaper(controls: Iterable[str]) -> Callable[[str], str]:
    return replacer(controls, 0, lambda m: m.group() + "\\")


def unescaper(controls: Iterable[str]) -> Callable[[str], str]:
    return replacer(controls, 1, lambda m: m.group()[1:])


# -- parsing


class Expression:
    """A parser of one expression or statement by descent; each method takes one level of precedence."""

    def __init__(self, source: str, constants: dict[str, Node]):
        self.items, self.at, self.constants, self.depth = [], 0, constants, 0
        end = 0
        while source[end:].strip():
            found = LEXEME.match(source, end)
            if not found:
                raise TemplateError(f"not understood: {source[end:].strip()[:20]!r}")
            self.items.append((found.lastgroup, found[found.lastgroup]))
            end = found.end()
        if len(self.items) > MOST_PARTS:
            raise TemplateError("too long an expression")

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def take(self, *wanted: str) -> bool:
        found = self.peek() in wanted and self.items[self.at][0] != "string"
        self.at += found
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, found {self.peek()!r}")

    def next(self, kind: str) -> str:
        if self.at == len(self.items) or self.items[self.at][0] != kind:
            raise TemplateError(f"a {kind} expected, found {self.peek()!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"not expected: {self.peek()!r}")

    def whole(self) -> Node:
        found = self.choice()
        self.end()
        return found

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("too deep")
        found = self.chain("or", lambda: self.chain("and", self.negation))
        if self.take("if"):
            test = self.chain("or", lambda: self.chain("and", self.negation))
            self.need("else")
            found = Node("choose", (test, found, self.choice()))
        self.depth -= 1
        return found

    def chain(self, word: str, part: Callable[[], Node]) -> Node:
        found = part()
        while self.take(word):
            found = Node(word, (found, part()))
        return found

    def negation(self) -> Node:
        negations = 0
        while self.take("not"):
            negations += 1
        found = self.comparison()
        return reduce(lambda node, _: Node("not", (node,)), range(negations), found)

    def comparison(self) -> Node:
        found = self.joined()
        sign = self.peek()
        return Node("compare", (sign, found, self.joined())) if self.take(*COMPARE) else found

    def joined(self) -> Node:
        return self.chain("~", self.filtered)

    def filtered(self) -> Node:
        found = self.value()
        while self.take("|"):
            name = self.next("name")
            if name not in ("trim", "upper", "lower", "escape"):
                raise TemplateError(f"no filter {name!r}")
            found = Node("filter", (name, found))
        return found

    def value(self) -> Node:
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        kind = self.items[self.at][0] if self.at < len(self.items) else None
        if kind == "string":
            return Node("const", (self.next("string")[1:-1],))
        if kind == "number":
            return Node("const", (int(self.next("number")),))
        name = self.next("name")
        if name in ("true", "false"):
            return Node("const", (name == "true",))
        if self.take("."):
            name = (name, self.next("name"))
            if name not in FIELDS:
                raise TemplateError(f"no {'.'.join(name)}")
            return Node("get", (name[1],))
        if name not in self.constants:
            raise TemplateError(f"no {name}")
        return self.constants[name]


def pieces(source: str) -> Iterable[tuple[str, str]]:
    """text, out and block pieces, with white space stripped where tags ask for it."""
    if len(source) > LONGEST:
        raise TemplateError("too long")
    end, strip = 0, False
    for tag in TAG.finditer(source):
        text = source[end : tag.start()]
        text = text.lstrip() if strip else text
        before, after = (tag[1] or tag[4] or tag[7]), (tag[3] or tag[6] or tag[8])
        yield "text", text.rstrip() if before else text
        if tag[2] is not None:
            yield "out", tag[2]
        elif tag[5] is not None:
            yield "block", tag[5]
        end, strip = tag.end(), bool(after)
    yield "text", source[end:].lstrip() if strip else source[end:]


@dataclass
class Parsed:
    """Trees of what stands before, in and after the loop, and the control strings."""

    before: tuple = ()
    turn: tuple = ()
    after: tuple = ()
    controls: list[str] = field(default_factory=list)


def parse(source: str) -> Parsed:
    """The tree of a template. Tags that only tell something (control, set) leave no node."""
    controls: list[str] = []
    constants: dict[str, Node] = {}
    # each open block: its word, nodes so far, and for an if the branches before (test, nodes)
    stack: list[list] = [["", [], []]]
    loops: list[tuple] = []

    def close(word: str) -> list:
        if stack[-1][0] != word:
            raise TemplateError(f"end{word} does not close {stack[-1][0] or 'anything'!r}")
        return stack.pop()

    for kind, found in pieces(source):
        if kind == "text":
            stack[-1][1].append(Node("text", (found,)))
            if re.search(r"\{%|\{\{|\{#", found):
                raise TemplateError(f"a tag without its end: {found[:20]!r}")
            continue
        read = Expression(found, constants)
        if kind == "out":
            stack[-1][1].append(Node("out", (read.whole(),)))
            continue
        word = read.next("name")
        if word == "control":
            while read.peek() is not None:
                controls.append(read.next("string")[1:-1])
        elif word == "set":
            name = read.next("name")
            read.need("=")
            value = read.whole()
            folded = fold(value, str)
            if name in WORDS or folded.kind != "const" or contains(value, "filter", "escape"):
                raise TemplateError(f"not a constant: {name}")
            constants[name] = folded
        elif word == "for":
            for wanted in ("message", "in", "messages"):
                read.need(wanted)
            if len(stack) > 1 or loops:
                raise TemplateError("one loop, at the top level")
            read.end()
            stack.append([word, [], []])
        elif word == "endfor":
            loops.append(tuple(close("for")[1]))
            before, stack[0][1] = tuple(stack[0][1]), []
        elif word in ("if", "generation"):
            stack.append([word, [], [], read.whole() if word == "if" else None])
            if len(stack) > DEEPEST:
                raise TemplateError("too deep")
        elif word in ("elif", "else"):
            block = stack[-1]
            if block[0] != "if" or block[3] is None:
                raise TemplateError(f"{word} without if")
            block[2].append((block[3], tuple(block[1])))
            block[1], block[3] = [], read.whole() if word == "elif" else None
        elif word == "endif":
            _, nodes, branches, test = close("if")
            branches = [*branches, (test or Node("const", (True,)), tuple(nodes))]
            stack[-1][1].append(Node("if", tuple(branches)))
        elif word == "endgeneration":
            nodes = tuple(close("generation")[1])
            if any(contains(n, "generation") for n in nodes):
                raise TemplateError("generation inside generation")
            stack[-1][1].append(Node("generation", nodes))
        else:
            raise TemplateError(f"no {word}")
        read.end()
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    if not loops:
        raise TemplateError("no loop over messages")
    after = tuple(stack[0][1])
    if any(contains(n, kind) for n in before + after for kind in ("get", "generation")):
        raise TemplateError("message, loop and generation belong in the loop")
    return Parsed(before, loops[0], after, checked_controls(controls))


def contains(node: Any, kind: str, first: str | None = None) -> bool:
    """Whether a node of this kind, with that first item if one is given, is in the tree."""
    if isinstance(node, Node):
        return (node.kind == kind and first in (None, node.items[0])) or contains(node.items, kind, first)
    return isinstance(node, tuple) and any(contains(item, kind, first) for item in node)


# -- folding


def fold(node: Node, escape: Callable[[str], str]) -> Node:
    """The expression with whatever is constant worked out."""
    if node.kind in ("const", "get"):
        return node
    items = tuple(fold(item, escape) if isinstance(item, Node) else item for item in node.items)
    node = Node(node.kind, items)
    parts = [item for item in items if isinstance(item, Node)]
    if all(part.kind == "const" for part in parts):
        return Node("const", (evaluator(node, escape)(None),))
    if parts[0].kind == "const" and node.kind in ("and", "or", "choose"):
        truth = bool(parts[0].items[0])
        if node.kind == "choose":
            return parts[1 if truth else 2]
        return parts[1] if truth == (node.kind == "and") else parts[0]
    return node


def fold_block(nodes: Iterable[Node], escape: Callable[[str], str]) -> tuple[Node, ...]:
    """Statements with constants worked out, branches that are never taken left out, and neighbouring texts as one."""
    out: list[Node] = []

    def add(node: Node) -> None:
        if node.kind == "text" and out and out[-1].kind == "text":
            node = Node("text", (out.pop().items[0] + node.items[0],))
        if node != Node("text", ("",)):
            out.append(node)

    for node in nodes:
        if node.kind == "out":
            value = fold(node.items[0], escape)
            add(Node("text", (as_text(value.items[0]),)) if value.kind == "const" else Node("out", (value,)))
        elif node.kind == "generation":
            add(Node("generation", fold_block(node.items, escape)))
        elif node.kind == "if":
            branches = []
            for test, body in node.items:
                test, body = fold(test, escape), fold_block(body, escape)
                if test.kind == "const" and not test.items[0]:
                    continue
                branches.append((test, body))
                if test.kind == "const":
                    break
            if branches and branches[0][0].kind == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif any(body for _, body in branches):
                add(Node("if", tuple(branches)))
        else:
            add(node)
    return tuple(out)


# -- compiling


def evaluator(node: Node, escape: Callable[[str], str]) -> Callable[[Turn | None], Any]:
    """A closure that gives the expression's value for a turn."""
    if node.kind == "const":
        value = node.items[0]
        return lambda turn: value
    if node.kind == "get":
        return {"index0": lambda turn: turn.index - 1}.get(node.items[0]) or operator.attrgetter(node.items[0])
    if node.kind == "compare":
        compare, a, b = COMPARE[node.items[0]], *(evaluator(n, escape) for n in node.items[1:])
        if node.items[0] in ("==", "!=", "in"):
            return lambda turn: compare(a(turn), b(turn))
        return lambda turn: ordered(compare, a(turn), b(turn))
    if node.kind == "filter":
        change = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape}[node.items[0]]
        value = evaluator(node.items[1], escape)
        return lambda turn: change(as_text(value(turn)))
    parts = [evaluator(n, escape) for n in node.items]
    if node.kind == "not":
        return lambda turn: not parts[0](turn)
    if node.kind == "and":
        return lambda turn: parts[0](turn) and parts[1](turn)
    if node.kind == "or":
        return lambda turn: parts[0](turn) or parts[1](turn)
    if node.kind == "~":
        return lambda turn: as_text(parts[0](turn)) + as_text(parts[1](turn))
    test, a, b = parts
    return lambda turn: a(turn) if test(turn) else b(turn)


def ordered(compare: Callable, a: Any, b: Any) -> bool:
    """Numbers compare as numbers, all else as text."""
    return compare(a, b) if not isinstance(a, str) and not isinstance(b, str) else compare(as_text(a), as_text(b))


def renderer(nodes: Iterable[Node], escape: Callable[[str], str]) -> Callable[[Turn | None, Output], None]:
    """A closure that renders statements for a turn."""
    steps = [statement(node, escape) for node in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(turn: Turn | None, out: Output) -> None:
        for step in steps:
            step(turn, out)

    return run


def statement(node: Node, escape: Callable[[str], str]) -> Callable[[Turn | None, Output], None]:
    if node.kind == "text":
        text = node.items[0]
        return lambda turn, out: out.add(text)
    if node.kind == "out":
        value = evaluator(node.items[0], escape)
        return lambda turn, out: out.add(as_text(value(turn)))
    if node.kind == "generation":
        inner = renderer(node.items, escape)

        def generation(turn: Turn | None, out: Output) -> None:
            start = out.length
            inner(turn, out)
            out.spans += (start, out.length)

        return generation
    branches = [(evaluator(test, escape), renderer(body, escape)) for test, body in node.items]

    def choose(turn: Turn | None, out: Output) -> None:
        for test, body in branches:
            if test(turn):
                return body(turn, out)

    return choose


class Template:
    """A compiled template: render(turn, out) adds a turn to an Output, and what stands before and after the loop beside the first and last."""

    def __init__(self, source: str):
        parsed = parse(source)
        self.controls = tuple(parsed.controls)
        escape = escaper(self.controls)
        self.tree = tuple(fold_block(nodes, escape) for nodes in (parsed.before, parsed.turn, parsed.after))
        self.before, self.turn, self.after = (renderer(nodes, escape) for nodes in self.tree)
        self.unescape = unescaper(self.controls)

    def render(self, turn: Turn, out: Output) -> None:
        if turn.first:
            self.before(None, out)
        self.turn(turn, out)
        if turn.last:
            self.after(None, out)
