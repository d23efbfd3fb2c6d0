"""The short form of a query's plan: what is scanned, and by which index it could be searched."""

from __future__ import annotations

from ..catalog import Snapshot
from ..errors import InvalidSql
from ..sql.tokens import NUMBER, PARAM, STRING, Token


def detail(state: Snapshot, tokens: list[Token]) -> list[str]:
    """One line for each table: SCAN t, or SEARCH t USING INDEX i (c=?) if a condition fixes the only column of an index.
    An index is a fact of the catalog here: Spark finds the rows by the statistics of the stored parts."""
    out, names = [], []
    for k, t in enumerate(tokens[:-1]):
        if t.is_("FROM", "JOIN") and tokens[k + 1].named and tokens[k + 1].text.lower() in {*state.tables, *state.views}:
            names.append(tokens[k + 1].text)
    if not names:
        raise InvalidSql("no table to explain")
    at = next((k for k, t in enumerate(tokens) if t.is_("WHERE")), len(tokens))
    fixed = {
        tokens[k].text.lower()
        for k in range(at, len(tokens) - 2)
        if tokens[k].named and tokens[k + 1].op("=", "==") and tokens[k + 2].kind in (STRING, NUMBER, PARAM)
    }
    if any(t.is_("OR") for t in tokens[at:]):
        fixed = set()
    for name in names:
        index = next((i for i in state.indexes.values() if i.table.lower() == name.lower() and len(i.columns) == 1 and i.columns[0].lower() in fixed), None)
        out.append(f"SEARCH {name} USING INDEX {index.name} ({index.columns[0]}=?)" if index else f"SCAN {name}")
    if any(a.is_("ORDER") and b.is_("BY") for a, b in zip(tokens, tokens[1:], strict=False)):
        out[-1] += " USE TEMP B-TREE FOR ORDER BY"
    return out
