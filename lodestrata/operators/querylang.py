"""A lenient query language: terms, "phrases", field:term, +must, -not, AND, OR, NOT, parentheses.

Terms without an operator between them are alternatives, of which one at least must
match unless a + term is there. What can't be read is skipped, never an error.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.columns import tokens

_TOKEN = re.compile(r'\(|\)|[+-]?(?:(\w+):)?"([^"]*)"?|[+-]?[^\s()"]+|[+-](?=\()')


def matches(text: str, fields: dict[str, str]) -> Column:
    """The condition of a query over named columns; the name "" is the default one."""
    parts = [m[0] for m in _TOKEN.finditer(text)]
    return _Parser(parts, fields).group()


class _Parser:
    def __init__(self, parts: list[str], fields: dict[str, str]):
        self.parts, self.at, self.fields = parts, 0, fields

    def group(self) -> Column:
        must, may, never, join, negate = [], [], [], None, False
        while self.at < len(self.parts):
            p = self.parts[self.at]
            self.at += 1
            if p == ")":
                break
            if p in ("AND", "OR"):
                join = p
                continue
            if p == "NOT":
                negate = True
                continue
            sign = p[0] if p[0] in "+-" else ""
            body = p[len(sign) :]
            if body in ("(", ""):
                if not body and self.at < len(self.parts) and self.parts[self.at] == "(":
                    self.at += 1
                elif not body:
                    continue
                found = self.group()
            else:
                found = self.term(body)
            if found is None:
                continue
            if sign == "-" or negate:
                never.append(found)
            elif sign == "+":
                must.append(found)
            elif join == "AND":
                if may:
                    must.append(may.pop())
                must.append(found)
            else:
                may.append(found)
            join, negate = None, False
        out = reduce(lambda a, b: a & b, must, F.lit(True))
        if may and (not must or any("OR" == p for p in self.parts)):
            out = out & reduce(lambda a, b: a | b, may)
        elif may and must:
            out = out & (reduce(lambda a, b: a | b, may) | F.lit(True))
        return reduce(lambda a, b: a & ~b, never, out)

    def term(self, body: str) -> Column | None:
        name, _, rest = body.partition(":")
        column = self.fields.get(name) if rest else None
        if column is None:
            column, rest = self.fields[""], body
        if column != self.fields[""]:
            return F.lower(F.col(column)) == rest.strip('"').lower()
        words = [w for w in re.split(r"[\W_]+", re.sub(r"\^[\d.]+$", "", rest).lower()) if w]
        if not words:
            return None
        if len(words) == 1:
            return F.array_contains(tokens(column), words[0])
        t = tokens(column)
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - len(words) + 1, F.lit(1)))
        return F.exists(starts, lambda i: F.slice(t, i, len(words)) == F.array(*map(F.lit, words)))
