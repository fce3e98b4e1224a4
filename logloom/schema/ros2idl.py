"""ROS 2 IDL texts: modules, structs, enums, constants and annotations; sections headed ``IDL: pkg/msg/Type``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from logloom.ir import Field
from logloom.schema.names import Definitions, Expr, Member, Name, Resolver, SchemaText, main_section, normalized, qualified, sections

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<open>/\*)
      | (?P<string>L?"(?:[^"\\\n]|\\.)*"|L?'(?:[^'\\\n]|\\.)*')
      | (?P<word>[A-Za-z_]\w*)
      | (?P<number>0[xX][0-9A-Fa-f]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\w*)
      | (?P<op>::|<<|[-+*/%&|^~!=<>(){}\[\];,@\#:.?])""",
    re.X | re.S | re.A,
)
#: Primitive types, by their words; the longest match counts.
PRIMITIVES = {
    "unsigned long long": "U64", "unsigned short": "U16", "unsigned long": "U32", "long long": "I64", "boolean": "Bool", "bool": "Bool",
    "int8": "I8", "int16": "I16", "short": "I16", "int32": "I32", "long": "I32", "int64": "I64", "uint8": "U8", "octet": "U8", "uint16": "U16",
    "uint32": "U32", "uint64": "U64", "float32": "F32", "float": "F32", "float64": "F64", "double": "F64",
}
_LOW, _HIGH = -(2**31), 2**32 - 1


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    space: bool  # whether something stood before it


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, space = 0, 1, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            c = text[at]
            if not c.isascii():
                raise SchemaText(f"parse error at line {line}: non-ASCII character")
            raise SchemaText(f"parse error at line {line}: unexpected character `{c}`")
        if m.lastgroup == "open":
            raise SchemaText(f"parse error at line {line}: unclosed block comment")
        if m.lastgroup == "skip":
            space = True
        else:
            out.append(Token(m.lastgroup, m.group(), line, space))
            space = False
        line += m.group().count("\n")
        at = m.end()
    return out


class Parser:
    """One pass over the tokens; what it finds lands in ``self.found``."""

    def __init__(self, text: str) -> None:
        self.toks, self.i = tokens(text), 0
        self.found = Definitions()

    # --- reading ---
    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k].text if self.i + k < len(self.toks) else ""

    def fail(self, message: str, tok: Token | None = None) -> SchemaText:
        tok = tok or (self.toks[self.i] if self.i < len(self.toks) else None)
        return SchemaText(f"parse error at line {tok.line}: {message}" if tok else f"{message} at end of input")

    def next(self) -> Token:
        if self.i >= len(self.toks):
            raise SchemaText("unexpected end of IDL input")
        self.i += 1
        return self.toks[self.i - 1]

    def eat(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        if self.peek() != text:
            raise self.fail(f"expected `{text}`")
        return self.next()

    def word(self) -> str:
        if self.i >= len(self.toks) or self.toks[self.i].kind != "word":
            raise self.fail("expected identifier")
        return self.next().text

    def positive(self) -> int:
        if self.i >= len(self.toks):
            raise SchemaText("expected positive integer")
        t = self.next()
        if not re.fullmatch(r"\d+|0[xX][0-9A-Fa-f]+", t.text) or int(t.text, 0 if t.text[:2].lower() == "0x" else 10) <= 0:
            raise self.fail("expected positive integer", t)
        return int(t.text, 16 if t.text[:2].lower() == "0x" else 10)

    def scoped(self) -> Name:
        self.eat("::")
        out = [self.word()]
        while self.eat("::"):
            out.append(self.word())
        return tuple(out)

    # --- declarations ---
    def parse(self) -> Definitions:
        while self.i < len(self.toks):
            if self.peek() == "}":
                raise self.fail("unexpected token")
            self.declaration(())
        return self.found

    def declaration(self, inside: Name) -> None:
        notes = self.annotations()
        start = self.toks[self.i] if self.i < len(self.toks) else None
        if start is None:
            raise SchemaText("unexpected end of IDL input")
        match start.text:
            case "#":
                self.include()
            case "module":
                self.next()
                name = (*inside, self.word())
                self.expect("{")
                while self.peek() not in ("}", ""):
                    self.declaration(name)
                self.expect("}")
                self.expect(";")
            case "struct":
                self.structure(inside)
            case "enum":
                self.enumeration(inside, notes)
            case "const":
                self.constant(inside)
            case "}":
                return
            case "union" | "typedef" | "bitmask":
                raise self.fail("unsupported IDL declaration (union, typedef, and bitmask are not supported)")
            case _:
                raise self.fail("unexpected top-level declaration")

    def include(self) -> None:
        self.next()
        if self.peek() != "include":
            raise self.fail("expected `include` after `#`")
        self.next()
        if self.i >= len(self.toks):
            raise SchemaText("incomplete #include directive")
        first = self.next()
        if first.text == "<":
            while self.i < len(self.toks):
                if self.next().text == ">":
                    return
            raise self.fail("unclosed #include path", first)
        if first.kind != "string":
            raise self.fail("expected #include path", first)

    def annotations(self) -> list[tuple[str, list[Token]]]:
        out = []
        while self.peek() == "@":
            start = self.next()
            name, inner = "::".join(self.scoped()), []
            if self.peek() == "(":
                depth = 0
                while True:
                    if self.i >= len(self.toks):
                        raise self.fail("unclosed annotation", start)
                    t = self.next()
                    depth += (t.text == "(") - (t.text == ")")
                    if depth == 0:
                        break
                    inner.append(t)
                inner = inner[1:]
            out.append((name, inner))
        return out

    def structure(self, inside: Name) -> None:
        line = self.next().line
        name = (*inside, self.word())
        if self.peek() != "{":
            raise self.fail("unsupported struct forward declaration", self.toks[self.i - 1])
        self.next()
        members: list[Member] = []
        consts: list[tuple[str, str]] = []
        while self.peek() != "}":
            if self.i >= len(self.toks):
                raise SchemaText(f"unclosed struct declaration at line {line}")
            self.annotations()
            if self.peek() == "}":
                break
            if self.peek() == "const":
                consts.append(self.constant(name))
            else:
                members.append(self.member())
        self.expect("}")
        self.expect(";")
        self.found.structs[name] = members
        self.found.consts[name] = consts

    def member(self) -> Member:
        start = self.toks[self.i] if self.i < len(self.toks) else None
        if start is None:
            raise SchemaText("unexpected end of input in struct member")
        expr, name, length = self.type(), self.word(), None
        if self.eat("["):
            length = self.positive()
            self.expect("]")
        if self.peek() == "[":
            raise self.fail("unsupported multi-dimensional fixed array declaration")
        if self.peek() == ",":
            raise self.fail("unsupported multiple field declarators")
        if not self.eat(";"):
            raise self.fail("field declaration must end with `;`", start)
        return Member(name, expr, length)

    def enumeration(self, inside: Name, notes: list) -> None:
        start = self.next()
        name = (*inside, self.word())
        self.expect("{")
        out: list[tuple[str, int]] = []
        value = -1
        while True:
            if self.i >= len(self.toks):
                raise SchemaText("unclosed enum declaration")
            if self.peek() == "}":
                if not out:
                    raise self.fail("enum declaration must contain an enumerator", start)
                raise self.fail("trailing `,` in enum declaration")
            if self.peek() == ",":
                raise self.fail("expected enumerator before `,`")
            marks = [t for n, t in self.annotations() if n == "value"]
            at = self.toks[self.i] if self.i < len(self.toks) else start
            label = self.word()
            value = self.given(marks[-1], at) if marks else value + 1
            if not _LOW <= value <= _HIGH:
                raise self.fail("enum value is outside the 32-bit range of an enum", at)
            out.append((label, value))
            if self.eat("}"):
                break
            if not self.eat(","):
                raise self.fail("unexpected trailing characters in enum variant (expected `,`)")
        self.expect(";")
        self.found.enums[name] = out

    def given(self, toks: list[Token], at: Token) -> int:
        """The number of ``@value(n)`` or ``@value(value=n)``."""
        text = "".join(t.text for t in toks)
        m = re.fullmatch(r"(?:value=)?([-+]?)(\d+|0[xX][0-9A-Fa-f]+)", text)
        if not m:
            raise self.fail(f"invalid enum value `{text}`", at)
        n = int(m[2], 16 if m[2][:2].lower() == "0x" else 10)
        return -n if m[1] == "-" else n

    def constant(self, inside: Name) -> tuple[str, str]:
        start = self.next()
        self.type()
        name = self.word()
        self.expect("=")
        value: list[Token] = []
        opened: list[Token] = []
        while self.i < len(self.toks) and not (self.peek() == ";" and not opened):
            t = self.next()
            if t.text == "(":
                opened.append(t)
            elif t.text == ")":
                if not opened:
                    raise self.fail("unmatched `)`", t)
                opened.pop()
            value.append(t)
        if opened:
            raise self.fail("unclosed `(` in const expression", opened[-1])
        if not self.eat(";"):
            raise self.fail("const declaration must end with `;`", start)
        if not value:
            raise self.fail("expected const expression", start)
        return name, "".join((" " if k and t.space else "") + t.text for k, t in enumerate(value))

    def bound(self) -> int | None:
        """A literal bound, or None where a named constant bounds: such a type counts as unbounded."""
        if self.i < len(self.toks) and self.toks[self.i].kind == "word" or self.peek() == "::":
            self.scoped()
            return None
        return self.positive()

    def type(self) -> Expr:
        if self.i >= len(self.toks):
            raise SchemaText("unexpected end of input while parsing type")
        first = self.peek()
        if first == "long" and self.peek(1) == "double":
            raise self.fail("unsupported IDL type `long double`")
        if first == "sequence":
            self.next()
            self.expect("<")
            item = self.type()
            size = self.bound() if self.eat(",") else None
            self.expect(">")
            return Expr("List", size, item)
        if first in ("string", "wstring"):
            self.next()
            kind = "String" if first == "string" else "WString"
            if self.eat("<"):
                size = self.bound()
                self.expect(">")
                return Expr(kind) if size is None else Expr(f"Bounded{kind}", size)
            return Expr(kind)
        for n in (3, 2, 1):
            words = " ".join(self.peek(k) for k in range(n))
            if words in PRIMITIVES:
                self.i += n
                return Expr(PRIMITIVES[words])
        if first == "unsigned":
            raise self.fail("unsupported IDL type starting with `unsigned`")
        return Expr("ref", ref=self.scoped())


def bundle(schema_name: str, text: str) -> list[tuple[str, str]]:
    """(path, body) of each section; every section needs its ``IDL:`` line, blank lines are left out."""
    normalized(schema_name)
    out = []
    for lines in sections(text):
        kept = [x.strip() for x in lines if x.strip()]
        if not kept[0].startswith("IDL:"):
            raise SchemaText(f"missing `IDL:` header: {kept[0]}")
        path = kept[0][4:].strip()
        if not path:
            raise SchemaText("empty IDL path in section header")
        out.append((normalized(path), "\n".join(kept[1:])))
    if not out:
        raise SchemaText(f"no IDL sections found for schema '{schema_name}'")
    return out


def fields(schema_name: str, text: str) -> tuple[Field, ...]:
    parts = bundle(schema_name, text)
    defs = Definitions()
    for _, body in parts:
        defs.merge(Parser(body).parse())
    root = main_section([p for p, _ in parts], normalized(schema_name))
    return Resolver(defs).fields(qualified(root))
