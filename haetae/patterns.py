"""Patterns of rules: a syntax tree of the rule dialect, checks on it, and the same pattern for other engines.

The dialect is that of engines with linear time and leftmost-first matches: Unicode classes, set operations in classes,
POSIX classes of ASCII, named groups, inline flags; no look-around, no back references. ``a++`` is a repeated
repetition there, not a possessive one. Java's engine and the ``regex`` module try the same alternatives in the same
order, so a translation finds the same matches; what they lack is the bound on time, hence ``ambiguity``.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

JAVA, PYTHON = "java", "regex"
#: Positions of an automaton, states of a product, and steps of a search beyond which nothing is said about a pattern.
MANY, MANY_PAIRS, MANY_STEPS = 1500, 40_000, 400_000

#: General categories by their long names. Fixed values.
CATEGORIES = {
    "casedletter": "LC", "closepunctuation": "Pe", "connectorpunctuation": "Pc", "control": "Cc", "cntrl": "Cc", "currencysymbol": "Sc", "dashpunctuation": "Pd", "decimalnumber": "Nd", "digit": "Nd",
    "enclosingmark": "Me", "finalpunctuation": "Pf", "format": "Cf", "initialpunctuation": "Pi", "letter": "L", "letternumber": "Nl", "lineseparator": "Zl", "lowercaseletter": "Ll", "mark": "M",
    "combiningmark": "M", "mathsymbol": "Sm", "modifierletter": "Lm", "modifiersymbol": "Sk", "nonspacingmark": "Mn", "number": "N", "openpunctuation": "Ps", "other": "C", "otherletter": "Lo",
    "othernumber": "No", "otherpunctuation": "Po", "othersymbol": "So", "paragraphseparator": "Zp", "privateuse": "Co", "punctuation": "P", "punct": "P", "separator": "Z", "spaceseparator": "Zs",
    "spacingmark": "Mc", "symbol": "S", "titlecaseletter": "Lt", "unassigned": "Cn", "uppercaseletter": "Lu",
}
#: Properties of characters that both engines have, under Java's names. Fixed values.
BINARY = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "lowercase": "Lowercase", "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space", "space": "White_Space", "ideographic": "Ideographic", "ideo": "Ideographic", "hexdigit": "Hex_Digit", "joincontrol": "Join_Control", "joinc": "Join_Control"}
#: ASCII characters of POSIX classes. Fixed values.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": r"\x21-\x7E", "lower": "a-z",
    "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Z_a-z", "xdigit": "0-9A-Fa-f",
}
_CONTROL = {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}
_SPECIAL = frozenset(r"\.+*?()|[]{}^$#&-~/")
_ASCII_ONLY = {"d": "digit", "s": "space", "w": "word"}


class PatternError(ValueError):
    """A pattern that is not of the dialect, or that can't be run here."""


# The tree. A leaf matches one character; its text is a class or an escaped character, the same for both engines but for properties.


@dataclass(frozen=True)
class Leaf:
    text: tuple[str | tuple[str, str], ...]  # pieces; a pair is a piece for Java and one for Python
    char: str | None = None  # the character, if there is just one
    fold: bool = False

    def render(self, engine: str) -> str:
        made = "".join(p if isinstance(p, str) else p[engine == PYTHON] for p in self.text)
        return f"(?{'iu' if engine == JAVA else 'i-f'}:{made})" if self.fold else made


@dataclass(frozen=True)
class Look:
    """A place between characters."""

    text: str
    java: str | None = None

    def render(self, engine: str) -> str:
        return self.java if engine == JAVA and self.java else self.text


@dataclass(frozen=True)
class Cat:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Alt:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Rep:
    body: Node
    least: int
    most: int | None
    greedy: bool = True
    final: bool = False  # never gives back


Node = Leaf | Look | Cat | Alt | Rep


def _char(c: str) -> str:
    if c in _SPECIAL:
        return "\\" + c
    return c if c.isprintable() and c != " " else f"\\x{ord(c):02X}" if ord(c) < 256 else c


@dataclass(frozen=True)
class _Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    U: bool = False
    u: bool = True
    x: bool = False


class _Parser:
    def __init__(self, source: str) -> None:
        self.source, self.at, self.flags = source, 0, _Flags()

    def fail(self, why: str) -> PatternError:
        return PatternError(f"{why} at character {self.at}: {self.source}")

    def peek(self, n: int = 1) -> str:
        return self.source[self.at : self.at + n]

    def take(self, text: str) -> bool:
        if self.source.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def next(self) -> str:
        if self.at >= len(self.source):
            raise self.fail("the pattern ends too early")
        self.at += 1
        return self.source[self.at - 1]

    def blanks(self) -> None:
        while self.flags.x and self.at < len(self.source) and (self.peek().isspace() or self.peek() == "#"):
            if self.next() == "#":
                end = self.source.find("\n", self.at)
                self.at = len(self.source) if end < 0 else end + 1

    def parse(self) -> Node:
        made = self.alternatives()
        if self.at < len(self.source):
            raise self.fail("a group is closed that was not opened")
        return made

    def alternatives(self) -> Node:
        branches, parts, outer = [], [], self.flags
        while True:
            self.blanks()
            c = self.peek()
            if c in ("", ")"):
                break
            if self.take("|"):
                branches.append(Cat(tuple(parts)))
                parts = []
            elif c == "(":
                made = self.group()
                if made is not None:
                    parts.append(self.repeated(made))
            elif c in "*+?{":
                raise self.fail("nothing to repeat")
            else:
                parts.append(self.repeated(self.single()))
        branches.append(Cat(tuple(parts)))
        self.flags = outer
        return branches[0] if len(branches) == 1 else Alt(tuple(branches))

    def group(self) -> Node | None:
        self.next()
        outer = self.flags
        if self.take("?"):
            for mark in ("=", "!", "<=", "<!", ">", "P=", "P>", "#", "(", "&", "|"):
                if self.source.startswith(mark, self.at):
                    raise self.fail("look-around, atomic groups and back references are not supported")
            if self.take("P<") or self.take("<"):
                name = self.source[self.at : max(self.at, self.source.find(">", self.at))]
                if not name or not all(c.isalnum() or c in "_.[]" for c in name) or name[0].isdigit():
                    raise self.fail("a group's name is not valid")
                self.at += len(name) + 1
            else:
                on = True
                while (c := self.next()) not in ":)":
                    if c == "-":
                        on = False
                    elif c in "imsUux":
                        self.flags = replace(self.flags, **{c: on})
                    else:
                        raise self.fail(f"the flag {c!r} is not supported")
                if c == ")":
                    return None  # for the rest of the group around it
        made = self.alternatives()
        self.flags = outer
        if not self.take(")"):
            raise self.fail("a group is not closed")
        return made

    def repeated(self, made: Node) -> Node:
        while True:
            self.blanks()
            if self.take("*"):
                least, most = 0, None
            elif self.take("+"):
                least, most = 1, None
            elif self.take("?"):
                least, most = 0, 1
            elif self.take("{"):
                end = self.source.find("}", self.at)
                low, comma, high = (x.strip() if self.flags.x else x for x in self.source[self.at : end].partition(","))
                if end < 0 or not all(x == "" or (x.isascii() and x.isdigit()) for x in (low, high)) or not (low or high):
                    raise self.fail("a repetition needs numbers")
                self.at = end + 1
                least, most = int(low or 0), int(high) if high else None if comma else int(low)
                if most is not None and most < least:
                    raise self.fail("a repetition's bounds are the wrong way round")
            else:
                return made
            made = Rep(made, least, most, self.take("?") == self.flags.U)

    def single(self) -> Node:
        c = self.next()
        f = self.flags
        if c == "[":
            self.at -= 1
            return Leaf(tuple(self.bracket()), fold=f.i)
        if c == ".":
            if not f.u:
                raise self.fail("a dot without Unicode may match part of a character")
            return Leaf((r"[\s\S]" if f.s else r"[^\n]",))
        if c == "^":
            return Look(r"(?:\A|(?<=\n))" if f.m else r"\A")
        if c == "$":
            return Look(r"(?=\n|\Z)", r"(?=\n|\z)") if f.m else Look(r"\Z", r"\z")
        if c != "\\":
            return Leaf((_char(c),), c, f.i and c.lower() != c.upper())
        kind = self.peek()
        if kind and kind in "AzbB<>":
            self.next()
            return self.place(kind)
        pieces, char = self.escape(inside=False)
        return Leaf(tuple(pieces), char, f.i and (char is None or char.lower() != char.upper()))

    def place(self, kind: str) -> Look:
        word = r"\w" if self.flags.u else "[0-9A-Za-z_]"
        if kind == "b":
            for name, made in (("{start-half}", f"(?<!{word})"), ("{end-half}", f"(?!{word})"), ("{start}", f"(?<!{word})(?={word})"), ("{end}", f"(?<={word})(?!{word})")):
                if self.take(name):
                    return Look(made)
        if kind in "bB" and not self.flags.u:
            edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            return Look(edge if kind == "b" else f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))")
        return {"A": Look(r"\A"), "z": Look(r"\Z", r"\z"), "b": Look(r"\b"), "B": Look(r"\B"), "<": Look(f"(?<!{word})(?={word})"), ">": Look(f"(?<={word})(?!{word})")}[kind]

    def escape(self, inside: bool) -> tuple[list[str | tuple[str, str]], str | None]:
        """What follows a backslash: pieces, and the character if it is one."""
        c = self.next()
        if c.lower() in _ASCII_ONLY:
            if not self.flags.u:
                if c.isupper():
                    raise self.fail("a negated class without Unicode may match part of a character")
                return [f"[{POSIX[_ASCII_ONLY[c]]}]"], None
            return [f"\\{c}"], None
        if c in "pP":
            return [self.property(c == "P")], None
        if c in _CONTROL:
            return [_char(_CONTROL[c])], _CONTROL[c]
        if c in "xuU":
            if self.take("{"):
                digits = self.source[self.at : max(self.at, self.source.find("}", self.at))]
                self.at += len(digits) + 1
            else:
                digits = self.peek({"x": 2, "u": 4, "U": 8}[c])
                self.at += len(digits)
                if len(digits) != {"x": 2, "u": 4, "U": 8}[c]:
                    raise self.fail("too few hexadecimal digits")
            try:
                code = int(digits, 16)
                if code > 0x10FFFF or 0xD800 <= code < 0xE000 or (not self.flags.u and code > 127):
                    raise ValueError
            except ValueError:
                raise self.fail("not a character's number") from None
            return [_char(chr(code))], chr(code)
        if c.isdigit():
            raise self.fail("back references are not supported")
        if not c.isascii() or c.isalnum() or (c in "<>" and inside):
            raise self.fail(f"the escape \\{c} is not supported")
        return [_char(c)], c

    def property(self, negated: bool) -> tuple[str, str]:
        if self.take("{"):
            name = self.source[self.at : max(self.at, self.source.find("}", self.at))]
            self.at += len(name) + 1
        else:
            name = self.next()
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        for sign in ("!=", "=", ":"):
            if sign in name:
                group, _, name = name.partition(sign)
                negated ^= sign == "!="
                break
        else:
            group = ""
        group, plain = _loose(group), _loose(name)
        p = "P" if negated else "p"
        java = None
        if group in ("", "generalcategory", "gc"):
            if not group and plain in ("any", "ascii", "assigned"):
                made = {"any": r"[\s\S]", "ascii": r"[\x00-\x7F]", "assigned": r"\P{Cn}"}[plain]
                made = made if not negated else {"any": r"[^\s\S]", "ascii": r"[^\x00-\x7F]", "assigned": r"\p{Cn}"}[plain]
                return made, made
            short = CATEGORIES.get(plain) or next((v for v in (*CATEGORIES.values(), "Cs") if v.lower() == plain), None)
            java = python = short
            if not short and not group and plain in BINARY:
                java, python = f"Is{BINARY[plain]}", BINARY[plain]
        if java is None and group in ("", "script", "sc"):
            java, python = f"Is{name.strip().replace(' ', '_').replace('-', '_').removeprefix('Is').removeprefix('is')}", f"Script={name}"
        if java is None:
            raise self.fail(f"the property {group or name} is not supported")
        if not _known(f"\\p{{{python}}}"):
            raise self.fail(f"there is no property {name!r}")
        return f"\\{p}{{{java}}}", f"\\{p}{{{python}}}"

    def bracket(self) -> list[str | tuple[str, str]]:
        """A class from its opening to its closing bracket."""
        self.next()
        out: list[str | tuple[str, str]] = ["[^" if (negated := self.take("^")) else "["]
        if negated and not self.flags.u:
            raise self.fail("a negated class without Unicode may match part of a character")
        items, first, wrap = [], True, ""
        while first or self.peek() != "]":
            if self.flags.x and self.peek().isspace():
                self.next()
                continue
            if not first and self.peek(2) in ("&&", "--", "~~"):
                wrap = "["
                op, left, right = self.next() + self.next(), ["[", *items, "]"], ["[", *self.operand(), "]"]
                items = {"&&": [*left, "&&", *right], "--": [*left, "&&[^", *right, "]"], "~~": ["[", *left, "&&[^", *right, "]][", *right, "&&[^", *left, "]]"]}[op]
            else:
                items += self.item()
            first = False
        self.next()
        return [*out, wrap, *items, "]" * len(wrap), "]"]

    def operand(self) -> list[str | tuple[str, str]]:
        """What stands after an operator of a class, up to the next one."""
        items: list[str | tuple[str, str]] = []
        while self.peek() != "]" and self.peek(2) not in ("&&", "--", "~~"):
            items += self.item()
        if not items:
            raise self.fail("an operator of a class lacks its right side")
        return items

    def item(self) -> list[str | tuple[str, str]]:
        if self.peek() == "[":
            if self.peek(2) == "[:" and (end := self.source.find(":]", self.at)) > 0:
                name = self.source[self.at + 2 : end]
                if name.removeprefix("^") not in POSIX:
                    raise self.fail(f"there is no class [:{name}:]")
                self.at = end + 2
                return [f"[{'^' * name.startswith('^')}{POSIX[name.removeprefix('^')]}]"]
            return self.bracket()
        pieces, char = self.member()
        if char is not None and self.peek() == "-" and self.peek(2) not in ("-]", "--"):
            self.next()
            more, last = self.member()
            if last is None or last < char:
                raise self.fail("a range of a class is not valid")
            return [*pieces, "-", *more]
        return pieces

    def member(self) -> tuple[list[str | tuple[str, str]], str | None]:
        c = self.next()
        return self.escape(inside=True) if c == "\\" else ([_char(c)], c)


def _loose(name: str) -> str:
    low = name.lower().replace(" ", "").replace("_", "").replace("-", "")
    return low.removeprefix("is") if len(low) > 3 else low


@functools.lru_cache
def _known(text: str) -> bool:
    import regex

    try:
        return bool(regex.compile(text))
    except regex.error:
        return False


# What may be said about a tree.


def nullable(node: Node) -> bool:
    """Whether it matches the empty string."""
    match node:
        case Leaf():
            return False
        case Cat(parts):
            return all(map(nullable, parts))
        case Alt(parts):
            return any(map(nullable, parts))
        case Rep(body, least):
            return least == 0 or nullable(body)
    return True


def simplified(node: Node) -> Node:
    """The same matches with fewer ways to them: a repetition of repetitions is one repetition."""
    match node:
        case Cat(parts):
            flat: list[Node] = []
            for p in map(simplified, parts):
                flat += p.parts if isinstance(p, Cat) else [p]
            return flat[0] if len(flat) == 1 else Cat(tuple(flat))
        case Alt(parts):
            return Alt(tuple(map(simplified, parts)))
        case Rep(body, least, most, greedy):
            body = simplified(body)
            if isinstance(body, Rep) and body.least <= 1 and (body.most is None or (body.least, body.most, most) == (0, 1, None)) and body.greedy == greedy and most != 0 and not nullable(body.body):
                return Rep(body.body, least if body.least else 0, None, greedy)
            return Rep(body, least, most, greedy)
    return node


@functools.lru_cache
def _everything() -> str:
    return "".join(map(chr, range(0x110000)))


@functools.lru_cache(maxsize=10_000)
def _set_of(leaf: Leaf) -> tuple[tuple[int, int], ...]:
    """The characters of a leaf as intervals."""
    if leaf.char is not None and not leaf.fold:
        return ((ord(leaf.char), ord(leaf.char)),)
    import regex

    return tuple((m.start(), m.end() - 1) for m in regex.finditer(f"(?:{leaf.render(PYTHON)})+", _everything(), flags=regex.V1))


@functools.lru_cache(maxsize=100_000)
def _meet(a: Leaf, b: Leaf) -> bool:
    x, y, i, j = _set_of(a), _set_of(b), 0, 0
    while i < len(x) and j < len(y):
        if x[i][1] < y[j][0]:
            i += 1
        elif y[j][1] < x[i][0]:
            j += 1
        else:
            return True
    return False


def _firsts(nodes: tuple[Node, ...]) -> list[Leaf] | None:
    """Leaves that what stands here may begin with; None if it may be empty, or hangs on a place."""
    out: list[Leaf] = []
    for node in nodes:
        match node:
            case Leaf():
                return [*out, node]
            case Look():
                return None
            case Cat(parts):
                inner = _firsts(parts)
                if inner is not None or not nullable(node):
                    return None if inner is None else out + inner
                return None
            case Alt(parts):
                each = [_firsts((p,)) for p in parts]
                if any(e is None for e in each):
                    return None
                return out + [x for e in each for x in e or []]
            case Rep(body, least):
                inner = _firsts((body,))
                if inner is None:
                    return None
                out += inner
                if least:
                    return out
    return None


def final(node: Node, after: tuple[Node, ...] = (), last: bool = True) -> Node:
    """Runs of one leaf that never help by giving back are marked as final.

    That holds before something that can't begin with the run's characters, and for the last run of a pattern.
    """
    match node:
        case Cat(parts):
            return Cat(tuple(final(p, parts[i + 1 :] + after, last and i == len(parts) - 1) for i, p in enumerate(parts)))
        case Alt(parts):
            return Alt(tuple(final(p, after, last) for p in parts))
        case Rep(Leaf() as leaf, least, most, True) if most is None or most > least:
            rest = _firsts(after)
            ends = last and not after
            return replace(node, final=ends or (rest is not None and not any(_meet(leaf, r) for r in rest)))
    return node


def render(node: Node, engine: str) -> str:
    match node:
        case Cat(parts):
            return "".join(f"(?:{render(p, engine)})" if isinstance(p, Alt) else render(p, engine) for p in parts)
        case Alt(parts):
            return "|".join(render(p, engine) for p in parts)
        case Rep(body, least, most, greedy):
            inner = render(body, engine)
            if not isinstance(body, Leaf):
                inner = f"(?:{inner})"
            sign = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or (f"{{{least}}}" if least == most else f"{{{least},{'' if most is None else most}}}")
            return f"{inner}{sign}{'+' if node.final else '' if greedy or least == most else '?'}"
    return node.render(engine)


# Ambiguity: how many ways there are through a pattern's automaton for one text.


class _Automaton:
    """Positions of leaves, and for each the positions that may follow, with the number of ways."""

    def __init__(self, node: Node) -> None:
        self.leaves: list[Leaf] = []
        self.follow: list[Counter[int]] = []
        self.build(node)

    def build(self, node: Node) -> tuple[bool, list[int], list[int]]:
        """Whether it may be empty, its first and its last positions."""
        match node:
            case Leaf():
                if len(self.leaves) >= MANY:
                    raise OverflowError
                self.leaves.append(node)
                self.follow.append(Counter())
                at = len(self.leaves) - 1
                return False, [at], [at]
            case Cat(parts):
                return self.chain(self.build(p) for p in parts)
            case Alt(parts):
                made = [self.build(p) for p in parts]
                return any(m[0] for m in made), [x for m in made for x in m[1]], [x for m in made for x in m[2]]
            case Rep(body, least, most):
                copies = [self.build(body) for _ in range(max(least, 1 if most is None else most))]
                if most is None and copies:
                    self.join(copies[-1][2], copies[-1][1])
                if not copies:
                    return True, [], []
                empty = [m[0] or i >= least for i, m in enumerate(copies)]
                return self.chain((e, m[1], m[2]) for e, m in zip(empty, copies))
        return True, [], []

    def join(self, last: list[int], first: list[int]) -> None:
        for a in last:
            for b in first:
                self.follow[a][b] += 1

    def chain(self, made: Iterator[tuple[bool, list[int], list[int]]]) -> tuple[bool, list[int], list[int]]:
        empty, first, last = True, [], []
        for e, f, t in made:
            self.join(last, f)
            first = first + f if empty else first
            last = last + t if e else t
            empty &= e
        return empty, first, last

    def loops(self) -> list[list[int]]:
        """Positions that reach each other, by group; only such that reach themselves."""
        reach = [set(f) for f in self.follow]
        state, low, stack, on, out, n = {}, {}, [], set(), [], 0
        for root in range(len(reach)):
            work = [(root, iter(reach[root]))] if root not in state else []
            while work:
                v, edges = work[-1]
                if v not in state:
                    state[v] = low[v] = n
                    n += 1
                    stack.append(v)
                    on.add(v)
                for w in edges:
                    if w not in state:
                        work.append((w, iter(reach[w])))
                        break
                    if w in on:
                        low[v] = min(low[v], state[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == state[v]:
                        group = []
                        while True:
                            group.append(w := stack.pop())
                            on.discard(w)
                            if w == v:
                                break
                        if len(group) > 1 or v in reach[v]:
                            out.append(sorted(group))
        return out


def ambiguity(node: Node) -> str:
    """none, polynomial or exponential: how the ways to read a text of a pattern grow with its length; unknown for very large ones.

    Exponential: two different loops from a position back to it read the same text (found in the product of the automaton
    with itself, or as an edge with two ways). Polynomial: one text leads from a loop to itself, from it to another loop, and around that.
    """
    try:
        made = _Automaton(node)
    except OverflowError:
        return "unknown"
    groups, leaves, follow = made.loops(), made.leaves, made.follow
    for group in groups:
        inside = set(group)
        if any(n > 1 and b in inside for a in group for b, n in follow[a].items()):
            return "exponential"
        if len(group) ** 2 > MANY_PAIRS:
            return "unknown"
        step = {a: [b for b in follow[a] if b in inside] for a in group}
        ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
        work = [(a, a) for a in group]
        while work:
            pair = work.pop()
            if pair not in ahead:
                ahead[pair] = [(x, y) for x in step[pair[0]] for y in step[pair[1]] if _meet(leaves[x], leaves[y])]
                work += ahead[pair]
        back: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for pair, to in ahead.items():
            for t in to:
                back.setdefault(t, []).append(pair)
        seen: set[tuple[int, int]] = set()
        work = [(a, a) for a in group]
        while work:
            pair = work.pop()
            if pair in seen:
                continue
            seen.add(pair)
            if pair[0] != pair[1]:
                return "exponential"
            work += back.get(pair, [])
    looping = [(a, g) for g, group in enumerate(groups) for a in group]
    steps = 0
    for p, of_p in looping:
        for q, of_q in looping:
            if of_p == of_q or not _meet(leaves[p], leaves[q]):
                continue
            seen_triples, work_triples = set(), [(p, p, q)]
            while work_triples:
                a, b, c = work_triples.pop()
                steps += 1
                if steps > MANY_STEPS:
                    return "unknown"
                for x in follow[a]:
                    if x not in groups[of_p] or not _meet(leaves[x], leaves[x]):
                        continue
                    for y in follow[b]:
                        if not _meet(leaves[x], leaves[y]):
                            continue
                        for z in follow[c]:
                            t = (x, y, z)
                            if z in groups[of_q] and t not in seen_triples and _meet(leaves[x], leaves[z]) and _meet(leaves[y], leaves[z]):
                                if t == (p, q, q):
                                    return "polynomial"
                                seen_triples.add(t)
                                work_triples.append(t)
    return "none"


# Literals.


def literals(node: Node) -> frozenset[str] | None:
    """Strings of which every match holds at least one, the longest such set; None if there is none."""
    match node:
        case Leaf():
            return frozenset([node.char]) if node.char is not None and not node.fold else None
        case Alt(parts):
            made = [literals(p) for p in parts]
            return None if any(m is None for m in made) else frozenset().union(*[m for m in made if m])
        case Rep(body, least):
            return literals(body) if least else None
        case Cat(parts):
            best, run = None, ""
            for p in (*parts, None):
                times = p.least if isinstance(p, Rep) else 1
                leaf = p.body if isinstance(p, Rep) else p
                exact = isinstance(leaf, Leaf) and leaf.char is not None and not leaf.fold and times
                if exact:
                    run += leaf.char * min(times, 64)
                if not exact or (isinstance(p, Rep) and p.most != p.least):  # what follows need not stand next to it
                    best, run = _better(best, frozenset([run]) if run else None), ""
                if p is not None and not exact and not isinstance(p, Look):
                    best = _better(best, literals(p))
            return best
    return None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if not a or not b:
        return a or b
    rank = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=rank)


# What rules need.


def free(node: Node) -> bool:
    """Whether it looks at nothing but the characters that it matches: what it matches in one place, it matches wherever these stand."""
    match node:
        case Leaf():
            return True
        case Cat(parts) | Alt(parts):
            return all(map(free, parts))
        case Rep(body):
            return free(body)
    return False


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern."""

    source: str
    tree: Node

    @property
    def java(self) -> str:
        return render(self.tree, JAVA)

    @property
    def python(self) -> str:
        return render(self.tree, PYTHON)


@functools.lru_cache(maxsize=20_000)
def parse(source: str) -> Pattern:
    """The pattern, simplified, with final runs marked; ``PatternError`` if it is none."""
    return Pattern(source, final(simplified(_Parser(source).parse())))


def leading_run(pattern: Pattern) -> tuple[Leaf, str] | None:
    """The leaf of a greedy leading run that something else must follow, and the rest for Java; None if it doesn't begin so.

    Before a character that isn't the run's, it leads to a match from its first character on or from none.
    """
    tree = pattern.tree
    if not isinstance(tree, Cat) or len(tree.parts) < 2 or not isinstance(run := tree.parts[0], Rep) or not isinstance(run.body, Leaf):
        return None
    if (run.least, run.most, run.greedy, run.final) != (1, None, True, True):
        return None
    return run.body, render(Cat(tree.parts[1:]), JAVA)
