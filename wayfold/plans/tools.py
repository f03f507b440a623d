"""Named tools over the customer table, with checked parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from wayfold.operators import customers as C
from wayfold.operators import language as L

TYPES = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict}
FILTERS = {"state": {"type": "string"}, "city": {"type": "string"}, "status": {"type": "string"}, "customer_type": {"type": "string"}, "min_moves": {"type": "integer"}, "has_apartment": {"type": "boolean"}}


@dataclass
class Tool:
    name: str
    run: Callable[..., DataFrame]
    properties: dict = field(default_factory=dict)
    required: tuple[str, ...] = ()
    intents: tuple[str, ...] = ("search",)

    def check(self, params: dict) -> None:
        """Raise for missing, unknown or wrongly typed parameters."""
        missing = [p for p in self.required if params.get(p) is None]
        unknown = [p for p in params if p not in self.properties]
        wrong = [p for p, v in params.items() if p in self.properties and v is not None and (not isinstance(v, TYPES[self.properties[p]["type"]]) or isinstance(v, bool) != (self.properties[p]["type"] == "boolean"))]
        if missing or unknown or wrong:
            raise ValueError(f"{self.name}: missing {missing}, unknown {unknown}, of another type {wrong}")


class Registry:
    """Tools by name; each takes the customer table and its parameters."""

    def __init__(self):
        self.tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"there is a tool {tool.name}")
        self.tools[tool.name] = tool

    def available(self, name: str) -> bool:
        return name in self.tools

    def for_intent(self, intent: str) -> list[str]:
        return sorted(n for n, t in self.tools.items() if intent in t.intents)

    def execute(self, name: str, customers: DataFrame, params: dict | None = None) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}")
        params = {k: v for k, v in (params or {}).items() if v is not None}
        self.tools[name].check(params)
        return self.tools[name].run(customers, **params)


def standard() -> Registry:
    """The tools over the customer table."""
    r = Registry()
    s, i, a = {"type": "string"}, {"type": "integer"}, {"type": "array"}
    limit = {"limit": i}
    for t in (
        Tool("lookup_crid", C.lookup, {"crid": s}, ("crid",), ("lookup",)),
        Tool("search_customers", lambda c, limit=10, **f: C.search(c, limit=limit, **f), FILTERS | limit),
        Tool("get_stats", lambda c: C.group_by(c, "state"), {}, (), ("stats",)),
        Tool("filter_by_status", lambda c, status, limit=10: C.search(c, limit=limit, status=status), {"status": s} | limit, ("status",)),
        Tool("get_active_customers", lambda c, limit=10: C.search(c, limit=limit, status="ACTIVE"), limit),
        Tool("get_inactive_customers", lambda c, limit=10: C.search(c, limit=limit, status="INACTIVE"), limit),
        Tool("customers_moved_from", lambda c, from_state, limit=10: C.search(c, limit=limit, from_state=from_state), {"from_state": s} | limit, ("from_state",), ("search", "analysis")),
        Tool("customers_moved_after", lambda c, date: C.range_search(c, "last_move", low=date), {"date": s}, ("date",)),
        Tool("get_move_timeline", lambda c, crid: C.move_timeline(C.lookup(c, crid)), {"crid": s}, ("crid",), ("lookup", "analysis")),
        Tool("high_movers_by_state", lambda c, min_moves=3: C.group_by(c, "state", min_moves=min_moves), {"min_moves": i}, (), ("stats", "analysis")),
        Tool("count_by_criteria", lambda c, **f: c.where(C.criteria(**f)).groupBy().count(), FILTERS | {"from_state": s}, (), ("stats",)),
        Tool("group_by_field", lambda c, field, **f: C.group_by(c, field, **f), FILTERS | {"field": s}, ("field",), ("stats",)),
        Tool("range_filter", lambda c, field, low=None, high=None: C.range_search(c, field, low, high), {"field": s, "low": s, "high": s}, ("field",)),
        Tool("multi_criteria_search", lambda c, criteria, logic="AND": C.multi_search(c, criteria, logic), {"criteria": a, "logic": s}, ("criteria",)),
        Tool("regex_search", lambda c, field, pattern: C.regex_search(c, field, pattern), {"field": s, "pattern": s}, ("field", "pattern")),
        Tool("fuzzy_search", lambda c, field, query, limit=10: C.autocomplete_fuzzy(c, field, query, limit), {"field": s, "query": s} | limit, ("field", "query")),
        Tool("similar_names", lambda c, query, limit=10: C.similar_names(c, query, limit), {"query": s} | limit, ("query",)),
        Tool("autocomplete", lambda c, field, prefix, limit=10: C.autocomplete(c, field, prefix, limit), {"field": s, "prefix": s} | limit, ("field", "prefix")),
        Tool("ask", L.answer, {"text": s}, ("text",), ("search", "stats", "lookup")),
    ):
        r.register(t)
    return r
