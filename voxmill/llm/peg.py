"""Parsing-expression grammars: a notation, a compiler to closures, and parse trees.

A grammar is text, one rule a line::

    Name <- expression            # comment

with ordered choice ``a / b``, sequence ``a b``, repetition ``* + ?``, look-ahead ``& !``, groups
``( )``, literals ``'...'`` and regular-expression terminals ``~"..."``. The first rule is the
start. Every rule makes a node of the tree; anonymous parts do not. Rules that can reach
themselves are memoised (packrat), so a damaged, deeply nested text still parses in linear time;
nesting beyond ``MAX_DEPTH`` fails like any other mismatch and is left to the next alternative.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 120

_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z]\w*)|(?P<lit>'(?:[^'\\]|\\.)*')|(?P<rx>~"(?:[^"\\]|\\.)*")|(?P<op><-|[/*+?&!()]))""")


class Node(NamedTuple):
    """A matched rule: its name, its span, and the nodes inside."""

    rule: str
    start: int
    end: int
    children: list


class GrammarError(ValueError):
    pass


class Grammar:
    def __init__(self, text: str):
        self._defs: dict[str, object] = {}
        for line in text.splitlines():
            line = re.sub(r"\s#\s.*$", "", line).strip()
            if line and not line.startswith("#"):
                tokens = self._lex(line)
                if len(tokens) < 3 or tokens[0][0] != "name" or tokens[1][1] != "<-":
                    raise GrammarError(line)
                tree, at = self._choice(tokens, 2)
                if at != len(tokens):
                    raise GrammarError(f"unexpected {tokens[at][1]} in {line}")
                self._defs[tokens[0][1]] = tree
        self.start = next(iter(self._defs))
        self._rules: dict[str, object] = {}
        self._recursive = {n for n in self._defs if n in self._reach(n)}
        for n in self._defs:
            self._rules[n] = self._rule(n)

    def parse(self, text: str) -> Node | None:
        """The tree of the whole text, or None if the start rule does not match all of it."""
        out: list = []
        end = self._rules[self.start](text, 0, out, {})
        return out[0] if end == len(text) else None

    # The notation's own parser.
    @staticmethod
    def _lex(line: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(line):
            m = _TOKEN.match(line, at)
            if not m:
                raise GrammarError(line[at:])
            out.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        return out

    def _choice(self, t, at):
        options = []
        while True:
            seq = []
            while at < len(t) and t[at][1] not in ("/", ")"):
                item, at = self._prefixed(t, at)
                seq.append(item)
            options.append(("seq", seq) if len(seq) != 1 else seq[0])
            if at < len(t) and t[at][1] == "/":
                at += 1
            else:
                return (("alt", options) if len(options) > 1 else options[0]), at

    def _prefixed(self, t, at):
        if t[at][0] == "op" and t[at][1] in "&!":
            inner, end = self._prefixed(t, at + 1)
            return ("and" if t[at][1] == "&" else "not", inner), end
        kind, value = t[at]
        if kind == "name":
            item, at = ("ref", value), at + 1
        elif kind == "lit":
            item, at = ("lit", value[1:-1].encode().decode("unicode_escape")), at + 1
        elif kind == "rx":
            item, at = ("rx", value[2:-1]), at + 1
        elif value == "(":
            item, at = self._choice(t, at + 1)
            if at >= len(t) or t[at][1] != ")":
                raise GrammarError("unclosed group")
            at += 1
        else:
            raise GrammarError(f"unexpected {value}")
        while at < len(t) and t[at][0] == "op" and t[at][1] in ("*", "+", "?"):
            item, at = (t[at][1], item), at + 1
        return item, at

    def _reach(self, name: str) -> set[str]:
        seen: set[str] = set()

        def refs(e):
            if e[0] == "ref":
                yield e[1]
            elif e[0] in ("seq", "alt"):
                for x in e[1]:
                    yield from refs(x)
            elif e[0] not in ("lit", "rx"):
                yield from refs(e[1])

        todo = list(refs(self._defs[name]))
        while todo:
            n = todo.pop()
            if n not in seen:
                if n not in self._defs:
                    raise GrammarError(f"no rule {n}")
                seen.add(n)
                todo.extend(refs(self._defs[n]))
        return seen

    # Matchers take (text, position, nodes so far, memo) and give the end, or -1.
    def _rule(self, name: str):
        body = self._compile(self._defs[name])
        if self._defs[name][0] == "rx":  # a terminal has no nodes inside
            match = re.compile(self._defs[name][1]).match

            def leaf(s, i, out, memo):
                m = match(s, i)
                if m is None:
                    return -1
                end = m.end()
                out.append(Node(name, i, end, []))
                return end

            return leaf

        def plain(s, i, out, memo):
            inner: list = []
            end = body(s, i, inner, memo)
            if end >= 0:
                out.append(Node(name, i, end, inner))
            return end

        def packrat(s, i, out, memo):
            known = memo.get((name, i))
            if known is None:
                depth = memo.get("depth", 0)
                if depth >= MAX_DEPTH:
                    return -1
                memo["depth"] = depth + 1
                inner: list = []
                end = body(s, i, inner, memo)
                memo["depth"] = depth
                known = memo[(name, i)] = (end, Node(name, i, end, inner))
            if known[0] >= 0:
                out.append(known[1])
            return known[0]

        return packrat if name in self._recursive else plain

    def _compile(self, e):
        kind = e[0]
        if kind == "ref":
            rules, name, known = self._rules, e[1], []

            def ref(s, i, out, memo):
                if not known:  # rules may refer to later ones
                    known.append(rules[name])
                return known[0](s, i, out, memo)

            return ref
        if kind == "lit":
            lit = e[1]
            return lambda s, i, out, memo: i + len(lit) if s.startswith(lit, i) else -1
        if kind == "rx":
            match = re.compile(e[1]).match

            def rx(s, i, out, memo):
                m = match(s, i)
                return m.end() if m else -1

            return rx
        if kind in ("seq", "alt"):
            parts = [self._compile(x) for x in e[1]]

            def seq(s, i, out, memo):
                n = len(out)
                for p in parts:
                    i = p(s, i, out, memo)
                    if i < 0:
                        del out[n:]
                        return -1
                return i

            def alt(s, i, out, memo):
                for p in parts:
                    end = p(s, i, out, memo)
                    if end >= 0:
                        return end
                return -1

            return seq if kind == "seq" else alt
        inner = self._compile(e[1])
        if kind in ("and", "not"):
            wanted = kind == "and"
            return lambda s, i, out, memo: i if (inner(s, i, [], memo) >= 0) == wanted else -1
        if kind == "?":

            def maybe(s, i, out, memo):
                end = inner(s, i, out, memo)
                return end if end >= 0 else i

            return maybe
        least = 1 if kind == "+" else 0

        def many(s, i, out, memo):
            n = 0
            while (end := inner(s, i, out, memo)) > i:
                i, n = end, n + 1
            return i if n >= least or end == i else -1

        return many
