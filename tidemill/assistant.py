"""Questions in words: what kind of answer they ask for, which served query gives it, with checked parameters, and the reply.

A question is one row: rules over its words run on the driver for a single question and in Arrow batches for a table.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators.wordlists import DATA_CUES, DEFINITION_CUES, MEASURES, POLICY_CUES, TABLE_CUES, TOOL_PHRASES
from tidemill.scale import map_arrow

#: Rows of a table that a reply shows.
SHOWN = 20
_WHY = re.compile(r"\b(?:why|what caused|reason for|cause of)\b|\bexplain the (?:drop|fall|rise|increase)")
_GREETING = re.compile(r"\s*(?:hi|hello|hey|help|what can you do|what can i ask|who are you)\b")
_METHOD = re.compile(r"\bhow (?:is|are|was|were)(?: \w+){1,4}? \w+ed\b|\bhow (?:do|does|did)\b.*\b(?:work|works|calculated|computed|estimated|measured)\b|\b(?:definition|formula|methodology|explain how|is meant by)\b|\bhow (?:is|are|was|were)\b.*\b(?:built|set|chosen|made)\b")
_HOW_MANY = re.compile(r"\b(?:how many|number of|count of)\s+(.+)")


def stem(word: str) -> str:
    """The same light stem as in retrieval, for one word."""
    for ending, least, put in (("ing", 6, ""), ("ed", 5, ""), ("ies", 5, "y"), ("s", 4, "")):
        if word.endswith(ending) and len(word) >= least and not word.endswith("ss"):
            return word[: -len(ending)] + put
    return word


def stems(text: str) -> tuple[str, ...]:
    return tuple(stem(w) for w in re.findall(r"[a-z0-9]+", text.lower()))


def _places(words: Sequence[str], phrase: Sequence[str]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == tuple(phrase)]


def has_any(words: Sequence[str], phrases: Sequence[str]) -> bool:
    return any(_places(words, stems(p)) for p in phrases)


_PHRASES = sorted({(stems(p), tool) for tool, ps in TOOL_PHRASES.items() for p in ps}, key=lambda x: (-len(" ".join(x[0])), list(TOOL_PHRASES).index(x[1])))


def scores(question: str, leave_out: Sequence[str] = ()) -> dict[str, int]:
    """Letters of the phrases by which a question names each tool; a word counts for one tool, that of the longest phrase on it."""
    words, owner, out = stems(question), {}, dict.fromkeys(TOOL_PHRASES, 0)
    skipped, mine = {stems(p) for p in leave_out}, {}
    for phrase, tool in _PHRASES:
        if phrase in skipped:
            continue
        if any(_places(longer, phrase) for longer in mine.get(tool, ())):
            continue  # part of a longer phrase of the same tool
        free = [i for i in _places(words, phrase) if all(owner.get(k, tool) == tool for k in range(i, i + len(phrase)))]
        if free:
            out[tool] += len(" ".join(phrase))
            mine.setdefault(tool, []).append(phrase)
            owner.update({k: tool for i in free for k in range(i, i + len(phrase))})
    return out


def pick(question: str) -> str | None:
    """The tool a question names most; one that asks how many of something, the tools that count that thing."""
    asked = _HOW_MANY.search(question.lower())
    if asked:
        counted = set(stems(asked[1])[:3])
        able = [t for t, things in MEASURES.items() if counted & set(things)]
        if able:
            named = scores(question, ("how many rows", "row count", "row counts", "how many records"))
            return max(able, key=lambda t: (named[t], -able.index(t)))
    found = scores(question)
    best = max(found, key=found.__getitem__)
    return best if found[best] else None


def route(question: str) -> tuple[str, str | None]:
    """(kind, tool): help, out_of_scope, insufficient (asks for a cause), method, hybrid, policy or data; the first rule that holds."""
    text = question.lower().strip()
    words = stems(text)
    if _GREETING.match(text) and len(text.split()) <= 6:
        return "help", None
    if has_any(words, TABLE_CUES):
        return "out_of_scope", None
    tool, policy, data = pick(text), has_any(words, POLICY_CUES), has_any(words, DATA_CUES)
    if _WHY.search(text) and (tool or data):
        return "insufficient", tool
    if _METHOD.search(text):
        return "method", None
    if policy:
        return ("hybrid", tool) if tool and data else ("policy", None)
    if not tool:
        return ("method" if has_any(words, DEFINITION_CUES) else "policy"), None
    return "data", tool


def routed(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, tool) of every question of a table; null texts have a null kind."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [route(t) if t is not None else (None, None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [key, "kind", "tool"])

    return map_arrow(questions.select(key, text), run, f"{key} {questions.schema[key].dataType.simpleString()}, kind string, tool string")


@dataclass(frozen=True)
class Tool:
    """A served query and what its parameters must be: ids of a kind, dates, or a limit."""

    query: str
    ids: Mapping[str, str] = None
    dated: bool = False
    limited: bool = False


#: What each tool answers with. Stock risk tiers and suggested orders rest on business rules and have none.
TOOLS: dict[str, Tool] = {
    "inventory_overview": Tool("inventory_kpis"),
    "category_forecast": Tool("category_forecast", {"store": "store", "category": "category"}),
    "top_forecast": Tool("top_forecast_categories", limited=True),
    "forecast_reliability": Tool("accuracy_by_category"),
    "lost_sales": Tool("lost_sales_by_store"),
    "sales_overview": Tool("sales_kpis", {"stores": "store"}, dated=True),
    "top_products": Tool("top_products", dated=True, limited=True),
    "delivery_overview": Tool("delivery_kpis", dated=True),
    "cancellations": Tool("cancellations_by_reason", dated=True),
    "anomalies": Tool("anomaly_list", limited=True),
    "segments": Tool("segment_profiles"),
    "bought_with": Tool("product_partners", {"product": "brand"}),
    "recommendation_accuracy": Tool("recommendation_quality"),
    "retention": Tool("retention_status"),
    "promotions": Tool("promotion_metrics"),
    "pipeline_status": Tool("ops_overview"),
    "pipeline_rows": Tool("table_runs_for", {"run": "run"}),
    "data_quality": Tool("quality_by_dataset"),
    "quarantine": Tool("quarantine_by_dataset"),
    "model_health": Tool("model_registry"),
}


class BadParameter(ValueError):
    """A parameter that the data cannot answer for."""


def checked(tool: str, given: Mapping[str, object], known: Mapping[str, set], first: dt.date, last: dt.date) -> dict[str, object]:
    """The parameters of a tool, refused unless ids exist, dates lie in the data in order, and limits are 1 to SHOWN.

    known: the ids of each kind. What a tool does not take is refused too.
    """
    t = TOOLS[tool]
    allowed = set(t.ids or ()) | ({"start", "end"} if t.dated else set()) | ({"top"} if t.limited else set())
    if extra := set(given) - allowed:
        raise BadParameter(f"{tool} takes no {sorted(extra)}")
    for name, kind in (t.ids or {}).items():
        if name in given:
            values = given[name] if isinstance(given[name], (list, tuple)) else [given[name]]
            if missing := [v for v in values if v not in known.get(kind, ())]:
                raise BadParameter(f"unknown {kind}: {missing}")
    start, end = given.get("start", first), given.get("end", last)
    if t.dated and not first <= start <= end <= last:
        raise BadParameter(f"the data run from {first} to {last}")
    if t.limited and not 1 <= int(given.get("top", 1)) <= SHOWN:
        raise BadParameter(f"a limit lies between 1 and {SHOWN}")
    return dict(given)


def without_people(df: DataFrame) -> DataFrame:
    """`df` without columns that name a customer."""
    return df.drop(*[c for c in df.columns if re.fullmatch(r"customer.*id", c)])


def table_text(df: DataFrame) -> str:
    """The first SHOWN rows as a table in text, saying so if there are more; people are left out."""
    df = without_people(df)
    rows = df.limit(SHOWN + 1).collect()  # bounded by SHOWN
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:SHOWN]]
    return "\n".join(lines + ([f"(the first {SHOWN} rows; there are more)"] if len(rows) > SHOWN else []))


def reply(kind: str, table: str | None, passages: Sequence[tuple[str, str]] = ()) -> str:
    """The answer by kind of question: numbers, passages with numbered citations, or both; causes are never claimed."""
    cited = [f"{text} [{i}]" for i, (text, _) in enumerate(passages, 1)]
    sources = [f"[{i}] {source}" for i, (_, source) in enumerate(passages, 1)]
    if kind == "help":
        return "Ask about sales, deliveries, stock, forecasts, customers, data quality or policies."
    if kind == "out_of_scope" or not (table or cited):
        return "There is nothing on this in the data or the documents."
    opening = ["The data show what happened, not why."] if kind == "insufficient" else []
    return "\n\n".join(opening + ([table] if table else []) + cited + (["\n".join(sources)] if sources else []))


_NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()


def grounded(answer: str, evidence: str, citations: Sequence[str] = ()) -> bool:
    """Whether every number of an answer, in digits or words, stands in its evidence and every citation in the answer."""
    digits = lambda t: {x.replace(",", "") for x in re.findall(r"\d[\d,]*(?:\.\d+)?", t)}
    words = lambda t: {w for w in re.findall(r"[a-z]+", t.lower()) if w in _NUMBER_WORDS}
    known = digits(evidence) | {str(_NUMBER_WORDS.index(w)) for w in words(evidence)}
    said = digits(re.sub(r"\[\d+\]", "", answer)) | {str(_NUMBER_WORDS.index(w)) for w in words(answer)}
    return said <= known and all(c in answer for c in citations)


def answer(spark: SparkSession, root: str, role: str, question: str, given: Mapping[str, object] | None = None) -> str:
    """The reply to a question for a role: numbers by its tool, passages for questions of policy or method."""
    from tidemill import serving
    from tidemill.plans import text as plans

    kind, tool = route(question)
    shown = table_text(serving.ask(spark, root, role, TOOLS[tool].query, **(given or {}))) if tool else None
    passages = plans.passages(spark, root, question) if kind in ("policy", "method", "hybrid", "insufficient") else []
    return reply(kind, shown, passages)
