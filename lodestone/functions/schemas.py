"""Strict schemas of JSON answers: a schema becomes one column expression, the path and kind of an answer's first fault.

Answers are parsed to VARIANT and checked by built-in functions: unknown fields, missing ones, wrong kinds, lengths, values
outside a list. One bad row is a row with a fault, never a failed job. Null and what is no JSON (also an object with a key
twice) have the fault `not JSON` at the root.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    least: int = 0
    most: int | None = None
    one_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Listed:
    item: Node
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Fields:
    """An object: needed fields, optional ones, no others."""

    needed: dict[str, Node] = field(default_factory=dict)
    optional: dict[str, Node] = field(default_factory=dict)


@dataclass(frozen=True)
class Nullable:
    node: Node


@dataclass(frozen=True)
class Either:
    first: Node
    second: Node


Node = Text | Listed | Fields | Nullable | Either


def fault(value: Column, node: Node, path: Column | str = "$") -> Column:
    """The first fault of a VARIANT, in the order of the schema: `path: what`; null if there is none."""
    at = F.lit(path) if isinstance(path, str) else path
    kind, says = F.schema_of_variant(value), lambda what: F.concat(at, F.lit(f": {what}"))
    if isinstance(node, Nullable):
        return F.when(kind != "VOID", fault(value, node.node, at))
    if isinstance(node, Either):
        return F.when(fault(value, node.first, at).isNotNull(), fault(value, node.second, at))
    if isinstance(node, Text):
        text = F.try_variant_get(value, "$", "string")
        rules = [(kind != "STRING", "not text"), (F.char_length(text) < node.least, "too short")]
        rules += [(F.char_length(text) > node.most, "too long")] if node.most is not None else []
        rules += [(~text.isin(*node.one_of), "not one of the values")] if node.one_of else []
        return F.coalesce(*(F.when(c, says(what)) for c, what in rules))
    if isinstance(node, Listed):
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(items, lambda x, i: fault(x, node.item, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        rules = [F.when(~kind.startswith("ARRAY"), says("not a list")), F.when(F.size(items) < node.least, says("too few"))]
        rules += [F.when(F.size(items) > node.most, says("too many"))] if node.most is not None else []
        return F.coalesce(*rules, F.get(F.array_compact(inner), F.lit(0)))
    held = F.try_variant_get(value, "$", "map<string,variant>")
    known = {**node.needed, **node.optional}
    others = F.array_sort(F.array_except(F.map_keys(held), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
    rules = [F.when(~kind.startswith("OBJECT"), says("not an object")), F.when(F.size(others) > 0, F.concat(at, F.lit("."), F.get(others, F.lit(0)), F.lit(": unknown field")))]
    for name, inner in known.items():
        own = F.try_element_at(held, F.lit(name))
        below = F.concat(at, F.lit(f".{name}"))
        lacking = F.concat(below, F.lit(": missing")) if name in node.needed else F.lit(None).cast("string")
        rules.append(F.when(kind.startswith("OBJECT"), F.when(F.array_contains(F.map_keys(held), name), fault(own, inner, below)).otherwise(lacking)))
    return F.coalesce(*rules)


def checked(rows: DataFrame, answer: str, node: Node, kind: str) -> DataFrame:
    """rows with `fault` (null if there is none) and `value`, the answer in the DDL type `kind` where there is none."""
    value = F.try_parse_json(answer)
    found = F.when(value.isNull(), F.lit("$: not JSON")).otherwise(fault(value, node))
    return rows.withColumn("fault", found).withColumn("value", F.when(F.col("fault").isNull(), F.from_json(answer, kind)))


# fixed values: the fields of the answers that the format knows, and their limits
_TEXTS = Listed(Text())
BLOCK = Fields(
    {"section": Text(one_of=("analysis", "answerBasis", "pitfalls", "clinicalNotes")), "type": Text(one_of=("paragraph", "list", "table", "callout"))},
    {"title": Text(most=80), "text": Nullable(Text()), "items": Nullable(_TEXTS), "columns": Nullable(_TEXTS), "rows": Nullable(Listed(_TEXTS)), "tone": Nullable(Text(one_of=("info", "important", "warning")))},
)
CONTEXT = Fields({"evidenceId": Text()}, {"contextSummary": Text(most=500), "excerpt": Nullable(Text()), "highlights": Nullable(_TEXTS)})
_SHORT = Listed(Text(), most=3)
PACKAGE = Fields({"explanationBlocks": Listed(BLOCK, 1, 8)}, {"briefExplanation": Text(most=200), "tags": _SHORT, "suggestedTags": _SHORT, "knowledgePoints": _SHORT, "evidenceContext": Nullable(CONTEXT), "evidenceExcerpts": Nullable(Listed(CONTEXT))})
TAGS = Fields({"items": Listed(Fields({"id": Text()}, {"tags": _SHORT, "briefExplanation": Text(most=200)}))})
POINTS = Fields({"items": Listed(Fields({"id": Text()}, {"studyPoints": Either(Listed(Fields({"title": Text(1, 40), "body": Text(1, 1200)})), Text())}))})
CARDS = Fields({"items": Listed(Fields({"id": Text(), "memoryCards": Listed(Fields({"title": Text(1, 60), "content": Text(1, 2000)}, {"memoryCue": Text(most=500), "contrast": Text(most=1000)}), 1, 3)}))})
SELECTION = Fields({"evidenceId": Text()}, {"contextSummary": Text(most=500), "excerpt": Text(most=500), "highlights": Listed(Text(), most=8)})
SUBJECTS = Fields({}, {"subjects": _SHORT})
ORGANISED = Fields(
    {"items": Listed(Fields({"question": Text()}, {"type": Text(one_of=("A1", "A2", "A3", "multiple", "judge", "fill")), "options": _TEXTS, "answer": Either(Text(), Listed(_TEXTS)), **{k: Text() for k in ("id", "bank", "subject", "system", "difficulty", "caseInfo", "explanation", "knowledgePoint", "year")}}))}
)
