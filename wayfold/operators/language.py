"""Plain-language queries as columns: states, numbers, filters, intent, rewriting."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.names import AMBIGUOUS, STATES
from wayfold.operators import customers as C

# Words for a status; inactive ones are looked for first.
STATUS = (
    ("INACTIVE", r"\b(inactive|dormant|cancell?ed|not\s+active|no\s+longer\s+active|lapsed|suspended|deactivated)\b"),
    ("ACTIVE", r"\b(active|current|enabled)\b"),
    ("PENDING", r"\b(pending|awaiting|unconfirmed)\b"),
)
# Words for a number of moves.
MOVES = ((r"high\s+movers?", 5), (r"frequent\s+movers?", 3), (r"multiple\s+moves?", 2))
# Words for a type of customer.
KINDS = (("BUSINESS", "business|company|companies|corporate"), ("RESIDENTIAL", "residential|homeowner|renter"), ("PO_BOX", r"po\s?box"))
ORIGIN = r"(?:moved|relocated|transferred|came)\s+from|originally\s+from|(?:previously|formerly)\s+(?:in|from)"
# Words for an intent, first match first.
INTENTS = (
    ("lookup", r"\bcrid[-\s]?\d+|\bcustomer\s+(id|record|details)\b|\blook\s*up\b|\bpull\s+up\b"),
    ("address", r"\b(address|verify|validate|normalize|street|postal)\b|\bzip(\s*code)?\b"),
    ("analysis", r"\b(trends?|patterns?|analy[sz]e|analysis|insights?|why|migration|behavior)\b"),
    ("comparison", r"\b(compare|vs\.?|versus|difference|comparison)\b"),
    ("recommendation", r"\b(recommend|suggest|should|predict|forecast)\b"),
    ("stats", r"\bhow\s+many\b|\b(count|statistics?|totals?|breakdown|numbers?|summary|aggregate|average|top)\b|\b(per|by)\s+state\b"),
    ("knowledge", r"\b(policy|procedure|documentation|rules?|guidelines?)\b|\bhow\s+do\s+i\b"),
    ("search", r"\b(search|find|show|list|from|moved|movers?|relocated|residents?|customers?|people|who)\b"),
)
COMPLEX = r"\b(trends?|patterns?|analy[sz]e|analysis|recommend|predict|insights?|why|forecast|migration|behavior)\b|(moved|relocated|came|originally)\s+from\s+\w+|previously\s+in\s+\w+"
MEDIUM = r"\b(compare|filter|between|summary|which|multiple|several|all|most|least|top|bottom|apartment|renters?|inactive|active)\b|\bper\s+state\b|\bwho\s+moved\b|\b\d+\+?\s*moves?\b"
# Misspelled states and what they mean.
MISSPELLED = {"californa": "california", "flordia": "florida", "illnois": "illinois", "ohoi": "ohio", "texs": "texas", "pensylvania": "pennsylvania", "noth carolina": "north carolina", "tennesee": "tennessee", "massachusets": "massachusetts", "virgina": "virginia"}
PEOPLE = r"\b(people|persons|folks|residents|individuals|clients|users)\b"


def _first(text: Column, rules, otherwise=None) -> Column:
    chain = reduce(lambda w, r: w.when(text.rlike(r[1]), F.lit(r[0])), rules[1:], F.when(text.rlike(rules[0][1]), F.lit(rules[0][0])))
    return chain if otherwise is None else chain.otherwise(F.lit(otherwise))


def state_of(query: Column) -> Column:
    """The state a query names: the longest full name, else a code in capitals; codes that
    are words count only after 'in' or a comma."""
    t = F.lower(query)
    names = sorted(STATES, key=lambda n: (-len(n), n))
    named = reduce(lambda w, n: w.when(t.rlike(rf"\b{n}\b"), STATES[n]), names[1:], F.when(t.rlike(rf"\b{names[0]}\b"), STATES[names[0]]))
    sure = "|".join(sorted(set(STATES.values()) - set(AMBIGUOUS)))
    code = F.regexp_extract(query, rf"\b({sure})\b", 1)
    risky = F.regexp_extract(query, rf"(?:\bin\s+|,\s*)({'|'.join(sorted(AMBIGUOUS))})\b", 1)
    return F.coalesce(named, F.nullif(code, F.lit("")), F.nullif(risky, F.lit("")))


def rewritten(query: Column) -> Column:
    """Misspelled states put right and words for people made customers."""
    t = reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), sorted(MISSPELLED.items()), F.trim(F.regexp_replace(query, r"\s+", " ")))
    return F.regexp_replace(t, f"(?i){PEOPLE}", "customers")


def parsed(queries: DataFrame, text: str) -> DataFrame:
    """Adds the filters, intent, complexity and model tier of each query."""
    q = rewritten(F.col(text))
    t = F.lower(q)
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"moved\s+(?:at\s+least\s+)?(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\d+)\+?\s+moves?", 1), F.lit(""))).cast("int")
    fixed = reduce(lambda w, r: w.when(t.rlike(r[0]), r[1]), MOVES[1:], F.when(t.rlike(MOVES[0][0]), MOVES[0][1]))
    origin = F.nullif(F.trim(F.regexp_extract(t, rf"(?:{ORIGIN})\s+([a-z ]+?)(?: to | and | who | last | this |[?,.]|\s*$)", 1)), F.lit(""))
    limit = F.least(F.coalesce(F.nullif(F.regexp_extract(t, r"(?:top|first|show|give\s+me|limit)\s+(\d+)", 1), F.lit("")).cast("int"), F.lit(10)), F.lit(100))
    intent = _first(t, INTENTS, "other")
    complexity = F.when(t.rlike(COMPLEX) | intent.isin("analysis", "comparison", "recommendation"), "complex").when(t.rlike(MEDIUM), "medium").otherwise("simple")
    out = queries.withColumns(
        {
            "crid": F.nullif(F.regexp_extract(t, r"\bcrid[-:\s]*(\d+)", 1), F.lit("")),
            "state": state_of(q),
            "min_moves": F.coalesce(fixed, number),
            "status": _first(t, STATUS),
            "customer_type": _first(t, KINDS),
            "origin": origin,
            "zip": F.nullif(F.regexp_extract(t, r"\b(\d{5})\b", 1), F.lit("")),
            "row_limit": limit,
            "intent": intent,
            "complexity": complexity,
        }
    )
    crid = F.when(F.length("crid") < 6, F.lpad("crid", 6, "0")).otherwise(F.col("crid"))
    tier = F.when(F.col("complexity") == "complex", "large").when(F.col("complexity") == "medium", "medium").otherwise("small")
    return out.withColumns({"crid": F.concat(F.lit("CRID-"), crid), "tier": tier})


@dataclass(frozen=True)
class QuerySpec:
    """What one plain-language query asks of the customer table."""

    crid: str | None = None
    state: str | None = None
    min_moves: int | None = None
    status: str | None = None
    customer_type: str | None = None
    row_limit: int = 10
    intent: str = "search"

    @classmethod
    def of(cls, spark, text: str) -> QuerySpec:
        row = parsed(spark.createDataFrame([(text,)], "q string"), "q").select(*cls.__dataclass_fields__).first()
        return cls(**row.asDict())


def answer(customers: DataFrame, text: str) -> DataFrame:
    """Rows for a plain-language query: by id, counted, or searched; the first way that applies."""
    spec = QuerySpec.of(customers.sparkSession, text)
    filters = {"state": spec.state, "min_moves": spec.min_moves, "status": spec.status, "customer_type": spec.customer_type}
    if spec.crid:
        return C.lookup(customers, spec.crid)
    if spec.intent == "stats":
        return C.group_by(customers, "state", **filters)
    return C.search(customers, limit=spec.row_limit, **filters)
