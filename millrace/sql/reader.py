"""A cursor over tokens, for the statements that aren't queries."""

from __future__ import annotations

from ..errors import InvalidSql, UnexpectedToken
from .tokens import NUMBER, STRING, WORD, Token

_TYPE_END = ("PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "CONSTRAINT", "COLLATE")


class Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    @property
    def now(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def accept(self, *words: str) -> bool:
        """Take these words if they all come next."""
        here = self.tokens[self.i : self.i + len(words)]
        if len(here) == len(words) and all(t.is_(w) for t, w in zip(here, words, strict=True)):
            self.i += len(words)
            return True
        return False

    def one_of(self, *words: str) -> str | None:
        if self.now is not None and self.now.is_(*words):
            self.i += 1
            return self.tokens[self.i - 1].text.upper()
        return None

    def demand(self, *words: str) -> None:
        if not self.accept(*words):
            raise UnexpectedToken(f"{' '.join(words)} expected{self._where()}")

    def accept_op(self, op: str) -> bool:
        if self.now is not None and self.now.op(op):
            self.i += 1
            return True
        return False

    def demand_op(self, op: str) -> None:
        if not self.accept_op(op):
            raise UnexpectedToken(f"{op} expected{self._where()}")

    def name(self) -> str:
        if self.now is None or not self.now.named:
            raise UnexpectedToken(f"a name expected{self._where()}")
        self.i += 1
        return self.tokens[self.i - 1].text

    def names(self) -> tuple[str, ...]:
        """Names in parentheses."""
        self.demand_op("(")
        out = [self.name()]
        while self.accept_op(","):
            out.append(self.name())
        self.demand_op(")")
        return tuple(out)

    def inside(self) -> list[Token]:
        """What stands in the parentheses that begin here."""
        self.demand_op("(")
        start, depth = self.i, 1
        while depth:
            if self.now is None:
                raise InvalidSql("parentheses don't match")
            depth += self.now.op("(") - self.now.op(")")
            self.i += 1
        return self.tokens[start : self.i - 1]

    def until(self, *words: str) -> list[Token]:
        """Tokens up to one of these words outside parentheses and CASE."""
        start, depth = self.i, 0
        while self.now is not None:
            t = self.now
            if not depth and t.is_(*words):
                break
            depth += t.op("(") + t.is_("CASE") - t.op(")") - (t.is_("END") and depth > 0)
            self.i += 1
        return self.tokens[start : self.i]

    def rest(self) -> list[Token]:
        self.i, out = len(self.tokens), self.tokens[self.i :]
        return out

    def end(self) -> None:
        if self.now is not None:
            raise UnexpectedToken(f"nothing more expected{self._where()}")

    def if_exists(self) -> bool:
        return self.accept("IF", "EXISTS")

    def if_not_exists(self) -> bool:
        return self.accept("IF", "NOT", "EXISTS")

    def type(self) -> str:
        """A declared type, of any words and with numbers in parentheses; none is BLOB."""
        words = []
        while self.now is not None and self.now.kind == WORD and not self.now.is_(*_TYPE_END):
            words.append(self.name())
        text = " ".join(words)
        if words and self.now is not None and self.now.op("("):
            text += "(" + "".join(t.text for t in self.inside()) + ")"
        return text or "BLOB"

    def signed(self) -> int:
        sign = -1 if self.accept_op("-") else 1
        if self.now is None or self.now.kind != NUMBER or not self.now.text.isdigit():
            raise UnexpectedToken(f"a whole number expected{self._where()}")
        self.i += 1
        return sign * int(self.tokens[self.i - 1].text)

    def text(self) -> str:
        if self.now is None or self.now.kind != STRING:
            raise UnexpectedToken(f"a string expected{self._where()}")
        self.i += 1
        return self.tokens[self.i - 1].text

    def _where(self) -> str:
        return f" before {self.now.text!r}" if self.now is not None else " at the end"
