"""What a pattern's form tells of its matches: which characters stand next to each other, and whether backtracking is bounded."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from maskwright.functions.chars import NO_WORD_EDGE, WORD_CHARS, WORD_EDGE, chars_of, class_of

#: Kinds of characters: a line feed and its like, a blank, a small letter, any other.
LINE, BLANK, SMALL, OTHER = "LINE", "BLANK", "SMALL", "OTHER"


class Unknown(ValueError):
    """The form doesn't tell."""


@dataclass(frozen=True)
class Shape:
    """Kinds that a match can begin and end with, all it can hold, those that can follow each other in it, and whether it can be empty."""

    first: frozenset = frozenset()
    last: frozenset = frozenset()
    held: frozenset = frozenset()
    pairs: frozenset = frozenset()
    empty: bool = True

    def then(self, b: Shape) -> Shape:
        pairs = self.pairs | b.pairs | {(x, y) for x in self.last for y in b.first}
        return Shape(self.first | b.first if self.empty else self.first, self.last | b.last if b.empty else b.last, self.held | b.held, pairs, self.empty and b.empty)

    def either(self, b: Shape) -> Shape:
        return Shape(self.first | b.first, self.last | b.last, self.held | b.held, self.pairs | b.pairs, self.empty or b.empty)

    def repeated(self, least: int, most) -> Shape:
        again = {(x, y) for x in self.last for y in self.first} if most > 1 else set()
        return Shape(self.first, self.last, self.held, self.pairs | again, self.empty or least == 0)


def parsed(pattern: str):
    """The parse tree of a pattern in RE2 syntax; \\p{Zs} counts as a blank. Raises Unknown for syntax of RE2 alone."""
    try:
        return _parser.parse(pattern.replace(r"\p{Zs}", " "), re.ASCII)
    except (re.error, OverflowError) as e:
        raise Unknown(str(e)) from e


def flat(seq):
    """All (operator, argument) of a parse tree."""
    for op, arg in seq:
        yield op, arg
        name = str(op)
        for part in [arg[-1]] if name in ("SUBPATTERN", "MAX_REPEAT", "MIN_REPEAT") else arg[1] if name == "BRANCH" else []:
            yield from flat(part)


def _kinds(chars: set[str], fold: bool) -> frozenset:
    """The kinds of ASCII characters; characters beyond ASCII, which any class might hold, are others."""
    found = {OTHER}
    for c in chars:
        found.add(LINE if c in "\t\n\v\f\r" else BLANK if c == " " else SMALL if c.islower() or (fold and c.isalpha()) else OTHER)
    return frozenset(found)


def shape(pattern: str) -> Shape:
    """The shape of a pattern's matches. Raises Unknown where they depend on more than the characters they hold and whether words begin or end at their edges."""
    fold = "(?i)" in pattern

    def one(chars: set[str]) -> Shape:
        kinds = _kinds(chars, fold)
        return Shape(kinds, kinds, kinds, frozenset(), False)

    def walk(seq) -> Shape:
        out = Shape()
        for op, arg in seq:
            name = str(op)
            if name == "AT" and str(arg) in ("AT_BOUNDARY", "AT_NON_BOUNDARY"):
                continue
            if name == "LITERAL":
                out = out.then(one({chr(arg)}))
            elif name == "NOT_LITERAL":
                out = out.then(one(set(map(chr, range(128))) - {chr(arg)}))
            elif name == "ANY":
                out = out.then(one(set(map(chr, range(128))) - {"\n"}))
            elif name == "IN":
                out = out.then(one(chars_of(arg)))
            elif name == "SUBPATTERN":
                out = out.then(walk(arg[-1]))
            elif name == "BRANCH":
                ways = [walk(x) for x in arg[1]]
                some = ways[0]
                for w in ways[1:]:
                    some = some.either(w)
                out = out.then(some)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out = out.then(walk(arg[2]).repeated(arg[0], arg[1]))
            else:
                raise Unknown(name)
        return out

    return walk(parsed(pattern))


def safe_cut(patterns: list[str]) -> str | None:
    """A regular expression for places before which a text can be cut so that no match of the patterns reaches across, and matches after it don't depend on what is before but for the character; None if there are none.

    Before a line feed, if no match holds one. Before a blank and a small letter, if no match has these next to each other, or begins or ends with a blank. At both, a word can't go on across the cut, so word edges are as in the whole text.
    """
    try:
        shapes = [shape(p) for p in patterns]
    except Unknown:
        return None
    lines = all(LINE not in s.held for s in shapes)
    words = all((BLANK, SMALL) not in s.pairs and BLANK not in s.first | s.last for s in shapes)
    ways = [r"\n"] * lines + [" [a-z]"] * words
    return "|".join(ways) or None


#: Ways in which a pattern may be tried at one place, at most, for the JVM's engine, which backtracks and has no time limit; repeats of more than so many characters count as endless.
MOST_WAYS, ENDLESS = 10_000, 256
#: Stands for \p{Zs} in parse trees.
_ZS = "\ue000"
_CHARS = ("LITERAL", "NOT_LITERAL", "ANY", "IN")
_EDGES = {"AT_BOUNDARY": WORD_EDGE, "AT_NON_BOUNDARY": NO_WORD_EDGE}


def _tree(pattern: str) -> tuple[list, bool]:
    """The parse tree with \\p{Zs} as its stand-in, and whether case counts."""
    fold = pattern.startswith("(?i)")
    pattern = pattern.removeprefix("(?i)").replace(r"\p{Zs}", _ZS)
    if "(?" in re.sub(r"\\.|\(\?:|\(\?P<\w+>", "", pattern) or "[:" in pattern:
        raise Unknown("flags or conditions inside the pattern, or named classes")
    return list(parsed(pattern)), not fold


def java_of(seq) -> str:
    """A parse tree as a Java pattern without capturing groups, with RE2's meaning of classes, dots and edges. Raises Unknown for what neither has."""

    def zs(text: str) -> str:
        return text.replace(_ZS, r"\p{Zs}")

    def item(op, arg) -> str:
        name = str(op)
        if name == "AT" and str(arg) in _EDGES:
            return _EDGES[str(arg)]
        if name == "LITERAL":
            return zs(re.escape(chr(arg)))
        if name == "NOT_LITERAL":
            return "[^" + zs(re.escape(chr(arg))) + "]"
        if name == "ANY":
            return r"[^\n]"
        if name == "IN":
            return zs(class_of(arg)).replace(r"\s", r"\t\n\f\r ").replace(r"\S", r"[^\t\n\f\r ]")
        if name == "SUBPATTERN":
            return f"(?:{java_of(arg[-1])})"
        if name == "BRANCH":
            return "(?:" + "|".join(map(java_of, arg[1])) + ")"
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            a, b, body = arg
            most = "" if b == _parser.MAXREPEAT else str(b)
            one = java_of(body) if len(body) == 1 and str(body[0][0]) in _CHARS else f"(?:{java_of(body)})"
            return f"{one}{{{a},{most}}}" + "?" * (name == "MIN_REPEAT")
        raise Unknown(name)

    return "".join(item(*x) for x in seq)


@dataclass(frozen=True)
class _Chars:
    """ASCII characters, and whether others can be among them."""

    ascii: frozenset
    beyond: bool

    def apart(self, b: _Chars) -> bool:
        return not self.ascii & b.ascii and not (self.beyond and b.beyond)


def _class(op, arg, fold: bool) -> _Chars:
    every, name = frozenset(map(chr, range(128))), str(op)
    if name in ("LITERAL", "NOT_LITERAL"):
        one = {chr(arg)} | ({chr(arg).swapcase()} if fold else set())
        return _Chars(frozenset(one) & every, arg > 127 or (fold and chr(arg).isalpha())) if name == "LITERAL" else _Chars(every - one, True)
    if name == "ANY":
        return _Chars(every - {"\n"}, True)
    found = chars_of(arg)
    if any(str(o) == "LITERAL" and chr(a) == _ZS for o, a in arg):
        found = found | {" "}
    return _Chars(frozenset(found | ({c.swapcase() for c in found} if fold else set())), True if fold else any(str(o) in ("NEGATE", "CATEGORY") and "NOT" in str(a) + str(o) or str(o) == "NEGATE" or (str(o) == "LITERAL" and a > 127) or (str(o) == "RANGE" and a[1] > 127) for o, a in arg))


def _edge(seq, fold: bool, last: bool) -> tuple[list[_Chars], bool]:
    """The characters that a sequence can begin (or end) with, and whether it can be empty."""
    found: list[_Chars] = []
    for op, arg in reversed(list(seq)) if last else list(seq):
        name = str(op)
        if name == "AT":
            continue
        if name in _CHARS:
            return [*found, _class(op, arg, fold)], False
        if name == "SUBPATTERN":
            more, empty = _edge(arg[-1], fold, last)
        elif name == "BRANCH":
            ways = [_edge(x, fold, last) for x in arg[1]]
            more, empty = [c for w, _ in ways for c in w], any(e for _, e in ways)
        else:
            more, empty = _edge(arg[2], fold, last)
            empty = empty or arg[0] == 0
        found += more
        if not empty:
            return found, False
    return found, True


def _ways(seq, fold: bool, before: list, after: list, looped: bool) -> int:
    """How often backtracking may try the rest of a pattern after this part, at most. before, after: what else the pattern holds around it. Raises Unknown where that, or how often a run of characters is entered, isn't bounded."""
    ways, seq = 1, list(seq)
    for k, (op, arg) in enumerate(seq):
        name, rest = str(op), seq[k + 1 :] + after
        if name == "SUBPATTERN":
            ways *= _ways(arg[-1], fold, before + seq[:k], rest, looped)
        elif name == "BRANCH":
            ways *= sum(_ways(x, fold, before + seq[:k], rest, looped) for x in arg[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = arg
            single = len(body) == 1 and str(body[0][0]) in _CHARS
            following, open_ = _edge(rest, fold, False)
            own = _class(*body[0], fold) if single else None
            fenced = single and not looped and not open_ and all(own.apart(c) for c in following)
            if most == _parser.MAXREPEAT or most > ENDLESS:
                ends = not looped and all(str(o) == "AT" for o, _ in rest)
                preceding, first = _edge(before + seq[:k], fold, True)
                word = own and not own.beyond and own.ascii <= WORD_CHARS
                start = first and word and any(str(a) == "AT_BOUNDARY" for o, a in (before + seq[:k]) if str(o) == "AT")
                # a run is entered at its first character only, and left at its end
                if not (fenced or single and ends) or not (start or not first and all(own.apart(c) for c in preceding)):
                    raise Unknown("an endless repeat that may be entered at many places of a run")
            elif not fenced:
                each = _ways(body, fold, before + seq[:k], rest, True)
                ways *= most - least + 1 if each == 1 else (most - least + 1) * each**most
        elif name != "AT" and name not in _CHARS:
            raise Unknown(name)
        if ways > MOST_WAYS:
            raise Unknown("too many ways to match")
    return ways


def native(pattern: str, group: int = 0) -> tuple[str, str, str] | None:
    """A pattern in RE2 syntax as three Java patterns, of what a match has before, in and after the span of a group (0: all of it); None if its form doesn't prove that Java finds the same in time proportional to the text: look-around, references, anchors, repeats that can be matched in many ways, and groups that are optional or repeated."""
    try:
        seq, cased = _tree(pattern)
        _ways(seq, not cased, [], [], False)
        flag = "" if cased else "(?iu)"
        if not group:
            return flag, java_of(seq), ""
        for k, (op, arg) in enumerate(seq):
            if str(op) == "SUBPATTERN" and arg[0] == group:
                return flag + java_of(seq[:k]), java_of(arg[-1]), java_of(seq[k + 1 :])
    except Unknown:
        pass
    return None


def holds_a_digit(pattern: str) -> bool:
    """Whether every match has an ASCII digit, by a part that no match can be without."""

    def walk(seq) -> bool:
        for op, arg in seq:
            name = str(op)
            if name in _CHARS and (c := _class(op, arg, False)).ascii <= set("0123456789") and c.ascii and not c.beyond:
                return True
            if name == "SUBPATTERN" and walk(arg[-1]) or name == "BRANCH" and all(map(walk, arg[1])) or name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 and walk(arg[2]):
                return True
        return False

    try:
        return walk(parsed(pattern))
    except Unknown:
        return False
