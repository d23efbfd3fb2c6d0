"""Tokens of the dialect, and statements of a script."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidSql

WORD, NAME, STRING, NUMBER, PARAM, OP = "word", "name", "string", "number", "param", "op"
_TWO = ("<=", ">=", "<>", "!=", "==", "||")


@dataclass(frozen=True)
class Token:
    """kind; text: of a word as written, of a quoted name or string without quotes; at: where it begins."""

    kind: str
    text: str
    at: int

    def is_(self, *words: str) -> bool:
        return self.kind == WORD and self.text.upper() in words

    def op(self, *ops: str) -> bool:
        return self.kind == OP and self.text in ops

    @property
    def named(self) -> bool:
        return self.kind in (WORD, NAME)


def _quoted(sql: str, i: int) -> tuple[str, int]:
    """The content of what is quoted at i, doubled quotes undone, and the place behind it."""
    quote, out, k = sql[i], [], i + 1
    while True:
        end = sql.find(quote, k)
        if end < 0:
            raise InvalidSql(f"unterminated {quote} at {i}")
        out.append(sql[k:end])
        if sql[end + 1 : end + 2] != quote:
            return "".join(out), end + 1
        out.append(quote)
        k = end + 2


def tokenize(sql: str) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(sql)
    while i < n:
        c, start = sql[i], i
        if c.isspace():
            i += 1
        elif sql.startswith("--", i):
            i = (sql.find("\n", i) + 1) or n
        elif sql.startswith("/*", i):
            i = sql.find("*/", i + 2) + 2
            if i < 2:
                raise InvalidSql("unterminated comment")
        elif c in "'\"`":
            text, i = _quoted(sql, i)
            out.append(Token(STRING if c == "'" else NAME, text, start))
        elif c.isalpha() or c == "_":
            while i < n and (sql[i].isalnum() or sql[i] in "_$"):
                i += 1
            out.append(Token(WORD, sql[start:i], start))
        elif c.isdigit() or (c == "." and sql[i + 1 : i + 2].isdigit()):
            while i < n and (sql[i].isdigit() or sql[i] == "." or (sql[i] in "eE" and sql[i + 1 : i + 2].strip("+-")[:1].isdigit()) or (sql[i] in "+-" and sql[i - 1] in "eE")):
                i += 1
            out.append(Token(NUMBER, sql[start:i], start))
        elif c == "?" or (c in ":@$" and (sql[i + 1 : i + 2].isalpha() or sql[i + 1 : i + 2] == "_")):
            i += 1
            while i < n and (sql[i].isdigit() if c == "?" else sql[i].isalnum() or sql[i] == "_"):
                i += 1
            out.append(Token(PARAM, sql[start:i], start))
        elif sql[i : i + 2] in _TWO:
            out.append(Token(OP, sql[i : i + 2], start))
            i += 2
        elif c in "()+-*/%,.;<>=[]":
            out.append(Token(OP, c, start))
            i += 1
        else:
            raise InvalidSql(f"unexpected {c!r} at {i}")
    return out


def statements(tokens: list[Token]) -> list[list[Token]]:
    """Split at semicolons, but not within the BEGIN ... END of a trigger."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        now = out[-1]
        if t.op(";") and not depth:
            out.append([])
            continue
        if len(now) > 1 and now[0].is_("CREATE") and any(x.is_("TRIGGER") for x in now[1:4]):
            if t.is_("BEGIN", "CASE"):
                depth += 1
            elif t.is_("END"):
                depth -= 1
        now.append(t)
    return [s for s in out if s]
