"""A tolerant parser for Java members and statements: as much structure as data-flow labels need.

Expressions keep calls, constructions, field reads, names, assignments and lambdas; operators only group
their operands. Types are read where a declaration needs them. A construct that can't be read is skipped to
the end of its statement and makes the result not ok; brackets always have to match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lexspark.java.lexer import Token, code_tokens


class Unreadable(Exception):
    pass


@dataclass
class Method:
    name: str
    body: list
    params: list[tuple[str, str]]  # (type, name)
    start: int
    end: int
    owners: tuple[str, ...] = ()


@dataclass
class Unit:
    methods: list[Method] = field(default_factory=list)
    ok: bool = True


MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed non".split())
PRIMITIVES = frozenset("boolean byte char short int long float double void var".split())
OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
INFIX = frozenset("+-*/%=<>!&|^~?:")


class Parser:
    def __init__(self, source: str):
        self.source = source
        self.tokens = code_tokens(source)
        self.at = 0
        self.unit = Unit()

    # -- tokens
    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k].text if self.at + k < len(self.tokens) else ""

    def token(self, k: int = 0) -> Token | None:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else None

    def take(self, text: str | None = None) -> str:
        found = self.peek()
        if not found or (text is not None and found != text):
            raise Unreadable(f"{found!r} instead of {text!r}")
        self.at += 1
        return found

    def accept(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def is_name(self, k: int = 0) -> bool:
        t = self.token(k)
        return t is not None and (t.kind == "ident" or t.text in ("record", "yield", "sealed", "permits", "var"))

    def skip_brackets(self) -> None:
        """Over a bracket and what it holds."""
        stack = []
        while True:
            text = self.take()
            if text in OPENING:
                stack.append(text)
            elif text in CLOSING:
                if not stack or stack.pop() != CLOSING[text]:
                    raise Unreadable("brackets")
            if not stack:
                return

    def recover(self, start: int) -> None:
        """To behind the statement that begins at `start`."""
        self.unit.ok = False
        self.at = max(start, self.at)
        depth = 0
        while self.at < len(self.tokens):
            text = self.peek()
            if text in OPENING:
                depth += 1
            elif text in CLOSING:
                if depth == 0:
                    return
                depth -= 1
            self.at += 1
            if depth == 0 and text in (";", "}"):
                return

    # -- members
    def annotations_and_modifiers(self) -> None:
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.at += 1
                self.qualified()
                if self.peek() == "(":
                    self.skip_brackets()
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "-")):
                self.at += 1
            elif self.peek() == "-" and self.peek(1) == "sealed":
                self.at += 2
            else:
                return

    def qualified(self) -> str:
        name = self.take()
        while self.peek() == "." and self.is_name(1):
            self.at += 1
            name += "." + self.take()
        return name

    def generics(self) -> None:
        depth = 0
        while True:
            text = self.take()
            depth += (text == "<") - (text == ">")
            if text in (";", "{", "}", "=") or (text == "(" and depth):
                raise Unreadable("type arguments")
            if depth == 0:
                return

    def type(self) -> str:
        """The base name of a type."""
        self.annotations_and_modifiers()
        if not (self.is_name() or self.peek() in PRIMITIVES):
            raise Unreadable("type")
        name = self.take()
        while True:
            if self.peek() == "<":
                self.generics()
            elif self.peek() == "." and self.is_name(1):
                self.at += 1
                name = self.take()
            elif self.peek() == "[" and self.peek(1) == "]":
                self.at += 2
            elif self.peek() == "." and self.peek(1) == "." and self.peek(2) == ".":
                self.at += 3
            elif self.peek() == "&" and self.is_name(1):
                self.at += 2
            else:
                return name

    def members(self, owners: tuple[str, ...], closing: bool) -> None:
        while self.at < len(self.tokens) and not (closing and self.peek() == "}"):
            start = self.at
            try:
                self.member(owners)
            except Unreadable:
                self.at = start
                self.recover(start)
                if self.at == start or (not closing and self.peek() in CLOSING):
                    self.at += 1

    def member(self, owners: tuple[str, ...]) -> None:
        if self.accept(";"):
            return
        begin = self.token().start
        self.annotations_and_modifiers()
        if self.peek() in ("import", "package"):
            while self.take() != ";":
                pass
            return
        if self.peek() in ("class", "interface", "enum", "record") and self.is_name(1) or self.peek() == "@":
            self.accept("@")
            kind = self.take()
            name = self.take()
            while self.peek() not in ("{", ""):
                self.skip_brackets() if self.peek() in OPENING else self.take()
            self.take("{")
            if kind == "enum":
                while self.peek() not in (";", "}", ""):
                    self.skip_brackets() if self.peek() in OPENING else self.take()
            self.members((*owners, name), True)
            self.take("}")
            return
        if self.peek() == "{":
            self.unit.methods.append(Method("", self.block(), [], begin, self.tokens[self.at - 1].end, owners))
            return
        if self.peek() == "<":
            self.generics()
        if self.is_name() and self.peek(1) == "(":
            name = self.take()
        else:
            self.type()
            name = self.take()
            if self.peek() != "(":  # a field
                while self.take() != ";":
                    self.at -= 1
                    self.skip_brackets() if self.peek() in OPENING else self.take()
                return
        params = self.parameters()
        while self.peek() not in ("{", ";", ""):
            self.take()
        body = self.block() if self.peek() == "{" else (self.take(";"), [])[1]
        self.unit.methods.append(Method(name, body, params, begin, self.tokens[self.at - 1].end, owners))

    def parameters(self) -> list[tuple[str, str]]:
        self.take("(")
        out = []
        while not self.accept(")"):
            kind = self.type()
            out.append((kind, self.take()))
            while self.accept("["):
                self.take("]")
            self.accept(",")
        return out

    # -- statements
    def block(self) -> list:
        self.take("{")
        out = []
        while self.peek() != "}":
            if not self.peek():
                raise Unreadable("end of block")
            start = self.at
            try:
                out.append(self.statement())
            except Unreadable:
                self.at = start
                self.recover(start)
                if self.at == start:
                    self.at += 1
        self.take("}")
        return out

    def condition(self):
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def statement(self):
        word = self.peek()
        if word == "{":
            return ("block", self.block())
        if self.accept(";"):
            return ("block", [])
        if word == "if":
            self.take()
            test, then = self.condition(), self.statement()
            return ("if", test, then, self.statement() if self.accept("else") else None)
        if word == "while":
            self.take()
            return ("loop", [], self.condition(), [], self.statement())
        if word == "do":
            self.take()
            body = self.statement()
            self.take("while")
            test = self.condition()
            self.take(";")
            return ("loop", [], test, [], body)
        if word == "for":
            return self.for_statement()
        if word == "try":
            return self.try_statement()
        if word == "switch":
            e = self.switch()
            self.accept(";")
            return ("expr", e)
        if word == "synchronized" and self.peek(1) == "(":
            self.take()
            return ("seq", self.condition(), ("block", self.block()))
        if word in ("return", "throw", "assert", "yield") and self.peek(1) not in ("=", ".", "("[: word == "yield"]):
            self.take()
            parts = []
            while self.peek() != ";":
                parts.append(self.expression())
                self.accept(":")
            self.take(";")
            return ("expr", ("group", parts))
        if word in ("break", "continue"):
            self.take()
            if self.is_name():
                self.take()
            self.take(";")
            return ("block", [])
        if self.is_name() and self.peek(1) == ":" and self.peek(2) != ":":
            self.at += 2
            return self.statement()
        found = self.local_declaration()
        if found is None:
            found = ("expr", self.expression())
        if found[0] != "class":
            self.take(";")
        return found

    def local_declaration(self):
        """A declaration without its semicolon, or None if an expression stands here."""
        start = self.at
        try:
            self.annotations_and_modifiers()
            if self.peek() in ("class", "interface", "enum") or (self.peek() == "record" and self.is_name(1)):
                while self.peek() != "{":
                    self.skip_brackets() if self.peek() in OPENING else self.take()
                self.skip_brackets()
                return ("class",)
            kind = self.type()
            if not self.is_name() or self.peek(1) not in ("=", ";", ",", "[", ":", ")"):
                raise Unreadable("no declaration")
        except Unreadable:
            self.at = start
            return None
        out = []
        while True:
            name = self.take()
            while self.accept("["):
                self.take("]")
            out.append((name, self.initialiser() if self.accept("=") else None))
            if not self.accept(","):
                return ("local", kind, out)

    def initialiser(self):
        return self.array() if self.peek() == "{" else self.expression()

    def array(self):
        self.take("{")
        parts = []
        while not self.accept("}"):
            parts.append(self.initialiser())
            self.accept(",")
        return ("group", parts)

    def for_statement(self):
        self.take("for")
        self.take("(")
        first = None if self.peek() == ";" else self.local_declaration()
        if first and self.accept(":"):
            over = self.expression()
            self.take(")")
            return ("foreach", first[1], first[2][0][0], over, self.statement())
        start = [first] if first else []
        while self.peek() != ";":
            start.append(("expr", self.expression()))
            self.accept(",")
        self.take(";")
        test = None if self.peek() == ";" else self.expression()
        self.take(";")
        step = []
        while not self.accept(")"):
            step.append(("expr", self.expression()))
            self.accept(",")
        return ("loop", start, test, step, self.statement())

    def try_statement(self):
        self.take("try")
        resources = []
        if self.accept("("):
            while not self.accept(")"):
                resources.append(self.local_declaration() or ("expr", self.expression()))
                self.accept(";")
        body, catches, last = self.block(), [], None
        while self.accept("catch"):
            self.skip_brackets()
            catches.append(self.block())
        if self.accept("finally"):
            last = self.block()
        if not (resources or catches or last is not None):
            raise Unreadable("try alone")
        return ("try", resources, body, catches, last)

    def switch(self):
        self.take("switch")
        value = self.condition()
        self.take("{")
        groups: list[list] = []
        while not self.accept("}"):
            if self.peek() in ("case", "default"):
                while not (self.peek() == ":" or (self.peek() == "-" and self.peek(1) == ">")):
                    self.skip_brackets() if self.peek() in OPENING else self.take()
                self.at += 1 if self.peek() == ":" else 2
                groups.append([])
                continue
            if not groups:
                raise Unreadable("switch")
            groups[-1].append(self.statement())
        return ("switch", value, groups)

    # -- expressions
    def expression(self):
        parts = [self.operand()]
        while self.peek() in INFIX or self.peek() == "instanceof":
            if self.peek() == ":" and self.peek(1) != ":" and not self.ternary:
                break
            if self.peek() == "instanceof":
                self.take()
                self.accept("final")
                self.type()
                if self.is_name():
                    self.take()
                continue
            op = ""
            while self.peek() in INFIX and not (op and self.peek() in "!~-+" and op[-1] not in "+-") and len(op) < 4:
                if self.peek() == ":" and not self.ternary:
                    break
                piece = self.take()
                op += piece
                if piece == "?":
                    self.ternary += 1
                    break
                if piece == ":":
                    self.ternary -= 1
                    break
                follows = self.token()
                if follows is None or self.tokens[self.at - 1].end != follows.start:
                    break
            if op in ("++", "--") and not self.starts_operand():
                continue
            if op == "=":
                parts[-1] = ("assign", parts[-1], self.expression())
                continue
            parts.append(self.operand())
        return parts[0] if len(parts) == 1 else ("group", parts)

    ternary = 0

    def starts_operand(self) -> bool:
        t = self.token()
        return t is not None and (t.kind in ("ident", "number", "string", "char") or t.text in ("(", "new", "this", "super", "!", "~", "switch", "true", "false", "null"))

    def operand(self):
        while self.peek() in ("+", "-", "!", "~"):
            self.take()
        t = self.token()
        if t is None:
            raise Unreadable("end")
        if t.text == "(":
            e = self.parenthesis()
        elif t.text == "new":
            e = self.construction()
        elif t.text == "switch":
            e = self.switch()
        elif t.kind in ("number", "string", "char") or t.text in ("true", "false", "null"):
            self.take()
            e = ("group", [])
        elif t.text in ("this", "super"):
            self.take()
            e = ("call", None, t.text, self.arguments()) if self.peek() == "(" else ("name", t.text)
        elif self.is_name():
            name = self.take()
            if self.peek() == "-" and self.peek(1) == ">":
                self.at += 2
                return self.lambda_body([name])
            if self.peek() == "(":
                e = ("call", None, name, self.arguments())
            else:
                if self.peek() == "<" and self.type_then_reference():
                    pass
                e = ("name", name)
        elif t.text in PRIMITIVES:
            self.type()
            e = ("name", t.text)
        else:
            raise Unreadable(t.text)
        return self.selectors(e)

    def type_then_reference(self) -> bool:
        start = self.at
        try:
            self.generics()
            while self.peek() == "[" and self.peek(1) == "]":
                self.at += 2
            if self.peek() == ":" and self.peek(1) == ":":
                return True
        except Unreadable:
            pass
        self.at = start
        return False

    def selectors(self, e):
        while True:
            if self.peek() == "." and (self.is_name(1) or self.peek(1) in ("new", "class", "this", "super", "<")):
                self.take()
                if self.peek() == "<":
                    self.generics()
                if self.peek() == "new":
                    e = ("group", [e, self.construction()])
                    continue
                name = self.take()
                e = ("call", e, name, self.arguments()) if self.peek() == "(" else ("field", e, name)
            elif self.peek() == "[":
                self.take()
                if self.accept("]"):
                    continue
                e = ("group", [e, self.expression()])
                self.take("]")
            elif self.peek() == ":" and self.peek(1) == ":":
                self.at += 2
                self.take()
                e = ("group", [e])
            else:
                return e

    def arguments(self) -> list:
        self.take("(")
        held, self.ternary = self.ternary, 0
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            if self.peek() != ")":
                self.take(",")
                if self.peek() == ")":
                    raise Unreadable("argument")
        self.ternary = held
        return out

    def parenthesis(self):
        start = self.at
        self.skip_brackets()
        end = self.at
        if self.peek() == "-" and self.peek(1) == ">":
            names = [t.text for k, t in enumerate(self.tokens[start:end]) if t.kind == "ident" and self.tokens[start + k + 1].text in (",", ")")]
            self.at += 2
            return self.lambda_body(names)
        if self.starts_operand() and self.peek() != "switch" or self.peek() == "switch":  # a cast
            self.at = start + 1
            try:
                self.type()
                self.take(")")
                return self.operand()
            except Unreadable:
                raise Unreadable("cast") from None
        self.at = start
        self.take("(")
        held, self.ternary = self.ternary, 0
        e = self.expression()
        self.ternary = held
        self.take(")")
        return ("group", [e])

    def lambda_body(self, names: list[str]):
        if self.peek() == "{":
            return ("lambda", names, ("block", self.block()))
        return ("lambda", names, ("expr", self.expression()))

    def construction(self):
        self.take("new")
        self.annotations_and_modifiers()
        name = self.take()
        while self.peek() in ("<", "."):
            if self.peek() == "<":
                self.generics()
            else:
                self.take()
                name = self.take()
        if self.peek() == "[":
            parts = []
            while self.accept("["):
                if not self.accept("]"):
                    parts.append(self.expression())
                    self.take("]")
            if self.peek() == "{":
                parts.append(self.array())
            return ("group", parts)
        args = self.arguments()
        if self.peek() == "{":
            self.skip_brackets()  # an anonymous class's body isn't looked at
        return ("new", name, args)


def parse(source: str) -> Unit:
    """Methods of a fragment, as if it stood in a class; ok if all of it was read."""
    p = Parser(source)
    depth: list[str] = []
    for t in p.tokens:
        if t.text in OPENING:
            depth.append(t.text)
        elif t.text in CLOSING and (not depth or depth.pop() != CLOSING[t.text]):
            p.unit.ok = False
            break
    p.unit.ok = p.unit.ok and not depth
    p.members((), False)
    return p.unit
