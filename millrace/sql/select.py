"""The dialect's queries and expressions, rewritten token by token to what Spark runs.

Names of tables become those of the snapshot's views; what the dialect means by LIKE, GLOB, IS, NOT IN and its functions
is spelt out; parameters become literals. Catalyst does the rest.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Sequence

from ..errors import InvalidParameter, InvalidSql, Unsupported
from ..functions.patterns import glob_regex, like_pattern, lower_sql
from ..functions.scalar import SQL, cast, quote, render
from .tokens import NAME, NUMBER, OP, PARAM, STRING, WORD, Token

_AFTER_FROM = ("WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET", "HAVING", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "SET", "WINDOW")
_JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "ON", "USING", "SEMI", "ANTI")
_NO_ALIAS = _AFTER_FROM + _JOINS + ("AS",)
_OPERATORS = ("AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "CASE", "SELECT", "WHERE", "ON", "HAVING", "BY", "BETWEEN", "IN", "LIKE", "GLOB", "IS", "DISTINCT", "RETURNING", "SET")


def literal(value: object) -> str:
    """A Python value as Spark SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1L" if value else "0L"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise InvalidParameter(f"{value} takes more than 64 bits")
        return f"{value}L" if value > -(2**63) else "(-9223372036854775807L - 1L)"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, str):
        return quote(value)
    raise InvalidParameter(f"no SQL for {type(value).__name__}")


class Params:
    """Values for ?, ?N (from 1) and named parameters; a named one may also come by position."""

    def __init__(self, values: Sequence | dict | None = None):
        self.named = {k.lstrip(":@$"): v for k, v in values.items() if isinstance(k, str)} if isinstance(values, dict) else {}
        self.listed = {k: v for k, v in values.items() if isinstance(k, int)} if isinstance(values, dict) else dict(enumerate(values or (), 1))
        self.next, self.places = 1, {}

    def value(self, text: str) -> object:
        if text[0] != "?" and text[1:] in self.named:
            return self.named[text[1:]]
        if text[0] == "?" and len(text) > 1:
            place = int(text[1:])
        elif text[0] == "?":
            place, self.next = self.next, self.next + 1
        else:
            if text[1:] not in self.places:
                self.places[text[1:]], self.next = self.next, self.next + 1
            place = self.places[text[1:]]
        if place < 1 or place not in self.listed:
            raise InvalidParameter(f"no value for {text}")
        return self.listed[place]


def _close(tokens: list[Token], i: int) -> int:
    """The place of the parenthesis that closes the one at i."""
    depth = 0
    for k in range(i, len(tokens)):
        depth += tokens[k].op("(") - tokens[k].op(")")
        if not depth:
            return k
    raise InvalidSql("parentheses don't match")


def split(tokens: list[Token], comma: str = ",") -> list[list[Token]]:
    """Split at commas outside parentheses."""
    out, depth = [[]], 0
    for t in tokens:
        depth += t.op("(") - t.op(")")
        if t.op(comma) and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out if tokens else []


class Rewriter:
    """table: gives the SQL name of a table or view, or None if there is none. own: names that stay (CTEs). columns: what
    a qualified name may become instead (NEW.x, OLD.x, excluded.x), or None."""

    def __init__(self, table: Callable[[str], str | None], params: Params, columns: Callable[[str, str], str | None] | None = None):
        self.table, self.params, self.columns, self.own = table, params, columns, set()
        self.used: list[str] = []

    def sql(self, tokens: list[Token]) -> str:
        out: list[str] = []
        begins: list[int] = []  # where each operand that ends here begins in out
        i, expect, in_from = 0, False, False
        while i < len(tokens):
            t = tokens[i]
            if t.kind == WORD:
                word = t.text.upper()
                if word in ("FROM", "JOIN", "INTO"):
                    if word == "FROM" and tokens[i - 1 : i] and tokens[i - 1].is_("DISTINCT") and i > 1 and tokens[i - 2].is_("IS", "NOT"):
                        out.append("FROM")
                        i += 1
                        continue
                    expect = in_from = True
                    out.append(word)
                    i += 1
                    continue
                if word in ("LIMIT", "OFFSET") and i + 1 < len(tokens) and tokens[i + 1].kind in (NUMBER, PARAM):
                    out.append(f"{word} {self._whole(tokens[i + 1])}")
                    in_from = expect = False
                    i += 2
                    continue
                if word in _AFTER_FROM and word not in ("ON", "USING"):
                    in_from = expect = False
                if expect and not (word == "SELECT"):
                    i = self._from(tokens, i, out)
                    expect = False
                    continue
                if word in ("LIKE", "GLOB"):
                    i = self._match(tokens, i, out, begins, word)
                    continue
                if word == "IS":
                    i = self._is(tokens, i, out, begins)
                    continue
                if word == "NOT" and i + 1 < len(tokens) and tokens[i + 1].is_("IN"):
                    i = self._not_in(tokens, i, out, begins)
                    continue
                if word in ("TRUE", "FALSE"):
                    begins.append(len(out))
                    out.append("1" if word == "TRUE" else "0")
                    i += 1
                    continue
                if i + 1 < len(tokens) and tokens[i + 1].op("(") and word not in _OPERATORS + ("EXISTS", "AS", "VALUES", "OVER", "FILTER", "UNION", "ALL", "EXCEPT", "INTERSECT", "TABLE"):
                    end = _close(tokens, i + 1)
                    begins.append(len(out))
                    out.append(self._call(t.text, tokens[i + 2 : end]))
                    i = end + 1
                    continue
                if word in _OPERATORS + _AFTER_FROM + _JOINS + ("NULL", "AS", "END", "ASC", "DESC", "ALL", "EXISTS", "OVER", "PARTITION", "ROWS", "VALUES", "WITH", "RECURSIVE", "NULLS", "FIRST", "LAST", "FILTER", "UNION", "EXCEPT", "INTERSECT"):
                    if word == "NULL":
                        begins.append(len(out))
                    out.append(word)
                    i += 1
                    continue
            if t.named:
                if expect:
                    i = self._from(tokens, i, out)
                    expect = False
                    continue
                begins.append(len(out))
                if i + 2 < len(tokens) and tokens[i + 1].op(".") and tokens[i + 2].named:
                    own = self.columns(t.text, tokens[i + 2].text) if self.columns else None
                    out.append(own or f"`{t.text}`.`{tokens[i + 2].text}`")
                    i += 3
                elif i + 2 < len(tokens) and tokens[i + 1].op(".") and tokens[i + 2].op("*"):
                    out.append(f"`{t.text}`.*")
                    i += 3
                else:
                    out.append(f"`{t.text}`")
                    i += 1
                continue
            if t.kind == NUMBER and i + 1 < len(tokens) and tokens[i + 1].is_("PRECEDING", "FOLLOWING"):
                out.append(t.text)
                i += 1
                continue
            if t.kind in (STRING, NUMBER, PARAM):
                begins.append(len(out))
                out.append(self._value(t))
                i += 1
                continue
            if t.op("("):
                end = _close(tokens, i)
                inner = tokens[i + 1 : end]
                begins.append(len(out))
                if expect and not (inner and inner[0].is_("SELECT", "WITH", "VALUES")):
                    # a parenthesised join
                    out.append(f"({self.sql([Token(WORD, 'FROM', 0), *inner])[5:]})")
                else:
                    out.append(f"({self.sql(inner)})")
                expect = False
                i = end + 1
                continue
            if t.op(",") and in_from:
                expect = True
            out.append("<>" if t.op("!=") else "=" if t.op("==") else t.text)
            i += 1
        return " ".join(out)

    def _value(self, t: Token) -> str:
        if t.kind == PARAM:
            return literal(self.params.value(t.text))
        if t.kind == STRING:
            return quote(t.text)
        if any(c in t.text for c in ".eE"):
            return f"{t.text}D"
        return f"{t.text}L" if int(t.text) < 2**63 else self._too_large(t.text)

    def _whole(self, t: Token) -> int:
        """The count that LIMIT or OFFSET takes."""
        value = self.params.value(t.text) if t.kind == PARAM else t.text
        try:
            return int(value)
        except (TypeError, ValueError):
            raise InvalidSql(f"{value!r} is no count of rows") from None

    @staticmethod
    def _too_large(text: str) -> str:
        raise InvalidSql(f"{text} takes more than 64 bits")

    def _from(self, tokens: list[Token], i: int, out: list[str]) -> int:
        name = tokens[i].text
        if name.lower() in self.own:
            out.append(f"`{name}`")
            return i + 1
        found = self.table(name)
        if found is None:
            from ..errors import UnknownTable

            raise UnknownTable(name)
        self.used.append(name)
        out.append(found)
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        aliased = after is not None and (after.is_("AS") or (after.named and not after.is_(*_NO_ALIAS)))
        if not aliased:
            out.append(f"AS `{name}`")
        elif not after.is_("AS"):
            out.append(f"AS `{after.text}`")
            return i + 2
        else:
            out.append(f"AS `{tokens[i + 2].text}`")
            return i + 3
        return i + 1

    def _operand(self, tokens: list[Token], i: int) -> tuple[str, int]:
        """The operand that begins at i, with what is added to it, and the place behind it."""
        k = i
        while True:
            if k < len(tokens) and tokens[k].op("-", "+"):
                k += 1
            if k >= len(tokens):
                raise InvalidSql("an operand is missing")
            if tokens[k].op("("):
                k = _close(tokens, k) + 1
            elif tokens[k].named and k + 1 < len(tokens) and tokens[k + 1].op("("):
                k = _close(tokens, k + 1) + 1
            elif tokens[k].named and k + 2 < len(tokens) and tokens[k + 1].op("."):
                k += 3
            else:
                k += 1
            if k < len(tokens) and tokens[k].op("+", "-", "*", "/", "%", "||"):
                k += 1
                continue
            return self.sql(tokens[i:k]), k

    @staticmethod
    def _left(out: list[str], begins: list[int]) -> str:
        """Take the operand that out ends with, back over what it is added to."""
        if not begins:
            raise InvalidSql("an operand is missing")
        start = begins.pop()
        while begins and start > 1 and out[start - 1] in ("+", "-", "*", "/", "%", "||") and begins[-1] < start:
            start = begins.pop()
        left = " ".join(out[start:])
        del out[start:]
        begins.append(start)
        return left

    def _match(self, tokens: list[Token], i: int, out: list[str], begins: list[int], word: str) -> int:
        negated = bool(out) and out[-1] == "NOT"
        if negated:
            out.pop()
        left = self._left(out, begins)
        right = tokens[i + 1] if i + 1 < len(tokens) else None
        if right is None:
            raise InvalidSql(f"{word} without a pattern")
        text = right.text if right.kind == STRING else self.params.value(right.text) if right.kind == PARAM else None
        alone = i + 2 >= len(tokens) or not tokens[i + 2].op("||", "+", "-")
        if right.kind in (STRING, PARAM) and alone:
            if text is None:
                made = "CAST(NULL AS BOOLEAN)"
            elif word == "GLOB":
                made = f"CAST({left} AS STRING) RLIKE {quote(glob_regex(str(text)))}"
            else:
                made = f"{lower_sql(left)} LIKE {quote(like_pattern(str(text)))}"
            end = i + 2
        elif word == "GLOB":
            raise Unsupported("GLOB takes a literal or a parameter as its pattern")
        else:
            other, end = self._operand(tokens, i + 1)
            made = f"{lower_sql(left)} LIKE replace({lower_sql(other)}, " + r"'\\', '\\\\')"
        out.append(f"(NOT ({made}))" if negated else f"({made})")
        return end

    def _is(self, tokens: list[Token], i: int, out: list[str], begins: list[int]) -> int:
        k = i + 1
        negated = k < len(tokens) and tokens[k].is_("NOT")
        k += negated
        left = self._left(out, begins)
        if k < len(tokens) and tokens[k].is_("NULL"):
            out.append(f"({left} IS {'NOT ' * negated}NULL)")
            return k + 1
        if k + 1 < len(tokens) and tokens[k].is_("DISTINCT") and tokens[k + 1].is_("FROM"):
            k, negated = k + 2, not negated
        right, end = self._operand(tokens, k)
        out.append(f"(NOT ({left} <=> {right}))" if negated else f"({left} <=> {right})")
        return end

    def _not_in(self, tokens: list[Token], i: int, out: list[str], begins: list[int]) -> int:
        left = self._left(out, begins)
        if i + 2 >= len(tokens) or not tokens[i + 2].op("("):
            raise InvalidSql("IN without a list")
        end = _close(tokens, i + 2)
        inner = tokens[i + 3 : end]
        if inner and inner[0].is_("SELECT", "WITH"):
            # a null on either side equals nothing, so it excludes nothing: an anti join, not the null-aware one
            out.append(f"(NOT EXISTS (SELECT 1 FROM ({self.sql(inner)}) AS mr_in(mr_value) WHERE mr_value = {left}))")
        else:
            items = [x for x in (self.sql(part) for part in split(inner)) if x != "NULL"]
            out.append(f"coalesce(NOT ({left} IN ({', '.join(items)})), true)" if items else "true")
        return end + 1

    def _call(self, name: str, inner: list[Token]) -> str:
        if name.upper() == "CAST":
            at = max((k for k, t in enumerate(inner) if t.is_("AS")), default=-1)
            if at < 0:
                raise InvalidSql("CAST without AS")
            return cast(self.sql(inner[:at]), "".join(t.text for t in inner[at + 1 :]))
        if (name.lower(), len(parts := split(inner))) in SQL:
            return render(name, [self.sql(p) for p in parts])
        return f"{name}({self.sql(inner)})"


def is_query(tokens: list[Token]) -> bool:
    return bool(tokens) and (tokens[0].is_("SELECT", "WITH", "VALUES") or tokens[0].op("("))


__all__ = ["NAME", "OP", "Params", "Rewriter", "is_query", "literal", "split"]
