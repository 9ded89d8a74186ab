"""Edits of imported rows before they are taken over: cells, bulk values, resolved issues, block types, selections.

Edits are tables joined by key, so any number of them is one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_answers, strip

# fixed values: what the format allows, and the header of a table made of text
ENUMS = {"type": ("A1", "A2", "A3", "multiple", "judge", "fill"), "bank": ("school", "kaoyan"), "difficulty": ("easy", "medium", "hard")}
TABLE_HEAD = ("项目", "说明")
MOST_BLOCKS, MOST_COLUMNS, MOST_ROWS, MOST_ITEMS = 12, 5, 20, 20


def parts(text: Column, marks: str) -> Column:
    return F.filter(F.transform(F.split(text, marks), strip), lambda x: x != "")


def parsed(field: str, value: Column, kind: Column) -> Column:
    """A cell's text as its column holds it: options parted by | and line ends, at most three tags, blanks of fill answers
    (kind `fill`) as the JSON that they are, or the text if it is none."""
    if field == "options":
        return parts(value, r"[|\n]+")
    if field == "tags":
        return F.slice(parts(value, "[、,，;；|]+"), 1, 3)
    if field == "answer":
        blanks = fill_answers(value)
        return F.when((kind == "fill") & (F.size(blanks) > 0), F.to_json(blanks)).otherwise(value)
    return value


def cells_set(rows: DataFrame, edits: DataFrame, fields: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, refused) after edits (key, field, value, at): the last edit of a cell counts, of equal `at` the greatest value;
    a type edited in the same pass is the one that the answer is read by.

    Edits without a key or value, of fields not named, of keys that rows lack, or of values that the format does not allow
    are refused with a reason. Repeated keys in rows are edited alike.
    """
    value, field = F.coalesce("value", F.lit("")), F.coalesce("field", F.lit(""))
    allowed = F.lit(True)
    for name, values in ENUMS.items():
        allowed = F.when(field == name, strip(value).isin(*values)).otherwise(allowed)
    known = rows.select(F.col(key).alias("_known")).where(F.col(key).isNotNull()).distinct()
    found = edits.join(known, F.col(key) == F.col("_known"), "left")
    reason = F.when(F.col(key).isNull() | F.col("_known").isNull(), "no such row").when(~field.isin(*fields), "no such field").when(F.col("value").isNull(), "no value").when(~allowed, "value not allowed").otherwise("")
    found = found.withColumn("reason", reason)
    last = lambda f: F.max(F.when(F.col("field") == f, F.struct("at", "value")))["value"].alias(f"_new_{f}")
    good = found.where("reason = ''").groupBy(F.col("_known")).agg(*map(last, fields))
    done = rows.join(good, F.col(key) == F.col("_known"), "left")
    held = lambda f: F.when(F.col(f"_new_{f}").isNull(), F.col(f))
    kind = F.coalesce(strip(F.col("_new_type")), F.col("type")) if "type" in fields else F.col("type") if "type" in rows.columns else F.lit(None)
    text = lambda f: strip(F.col(f"_new_{f}")) if f in ENUMS else F.col(f"_new_{f}")
    done = done.withColumns({f: held(f).otherwise(parsed(f, text(f), kind)) for f in fields})
    return done.select(*rows.columns), found.where("reason <> ''").select(*edits.columns, "reason")


def bulk_set(rows: DataFrame, field: str, value: str, chosen: Column) -> DataFrame:
    """One field of all chosen rows; blank values, and those that the format does not allow, raise."""
    text = value.strip()
    if not text or text not in ENUMS.get(field, (text,)):
        raise ValueError(f"{field} cannot be {text!r}")
    return rows.withColumn(field, F.when(F.coalesce(chosen, F.lit(False)), parsed(field, F.lit(text), F.lit(None))).otherwise(F.col(field)))


def issues_resolved(rows: DataFrame, chosen: Column, now: Column, column: str = "extensions") -> DataFrame:
    """Import issues (JSON text under importIssues of a map) of chosen rows go to resolvedImportIssues, with the time of the
    check; rows without issues, or with an empty list, stay as they are."""
    issues = F.col(column)["importIssues"]
    hit = F.coalesce(chosen & ~strip(issues).isin("", "[]", "null"), F.lit(False))
    rest = F.map_filter(column, lambda k, v: ~k.isin("importIssues", "resolvedImportIssues", "sourceCheckedAt"))
    new = F.create_map(F.lit("resolvedImportIssues"), issues, F.lit("importIssues"), F.lit("[]"), F.lit("sourceCheckedAt"), now.cast("string"))
    return rows.withColumn(column, F.when(hit, F.map_concat(rest, new)).otherwise(F.col(column)))


def converted(block: Column, kind: str) -> Column:
    """A block (section, type, title, text, items, columns, rows, tone; more stay) as another type, its content carried over:
    lines of a text become items or rows, cells parted by | and tabs; items and rows become lines of a text."""
    if kind not in ("paragraph", "callout", "list", "table"):
        raise ValueError(f"no type {kind!r} of blocks")
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    items, rows, columns = F.coalesce(block["items"], none), F.coalesce(block["rows"], nothing), F.coalesce(block["columns"], none)
    lines = parts(F.coalesce(block["text"], F.lit("")), "\n")
    changed = {"text": F.lit(None).cast("string"), "items": F.lit(None).cast("array<string>"), "columns": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>"), "tone": F.lit(None).cast("string"), "type": F.lit(kind)}
    if kind in ("paragraph", "callout"):
        table = F.array_join(F.transform(rows, lambda r: F.array_join(r, "、", "")), "\n")
        changed["text"] = F.coalesce(block["text"], F.when(F.size(items) > 0, F.array_join(items, "\n", "")).when(F.size(rows) > 0, table).otherwise(""))
        if kind == "callout":
            changed["tone"] = F.coalesce(block["tone"], F.lit("important"))
    elif kind == "list":
        changed["items"] = F.when(F.size(items) > 0, items).when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    else:
        cells = F.transform(lines, lambda x: F.split(x, r"[|\t]"))
        wide = F.transform(cells, lambda r: F.when(F.size(r) < 2, F.concat(r, F.array(F.lit("")))).otherwise(r))
        own = (F.size(columns) >= 2) & (F.size(rows) > 0)
        changed["columns"] = F.when(own, columns).otherwise(F.array(*map(F.lit, TABLE_HEAD)))
        changed["rows"] = F.when(own, rows).when(F.size(wide) > 0, wide).otherwise(F.array(F.array(F.lit(""), F.lit(""))))
    out = block
    for name, value in changed.items():
        out = out.withField(name, value)
    return F.when(block.isNull() | (block["type"] == kind), block).otherwise(out)


def blocks_converted(blocks: Column, kinds: Column) -> Column:
    """Blocks as the types of a list of the same length; null or unknown types leave theirs."""

    def one(b: Column, i: Column) -> Column:
        out = b
        for kind in ("paragraph", "callout", "list", "table"):
            out = F.when(F.get(kinds, i) == kind, converted(b, kind)).otherwise(out)
        return out

    return F.transform(blocks, one)


def block_limits(blocks: Column) -> Column:
    """What of the format's limits blocks break: too many blocks, columns, rows, items; none is an empty list."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    some = lambda over: F.exists(blocks, lambda b: F.coalesce(over(b), F.lit(False)))
    broken = {"blocks": F.size(blocks) > MOST_BLOCKS, "columns": some(lambda b: n(b["columns"]) > MOST_COLUMNS), "rows": some(lambda b: n(b["rows"]) > MOST_ROWS), "items": some(lambda b: n(b["items"]) > MOST_ITEMS)}
    return F.array_compact(F.array(*(F.when(c, name) for name, c in broken.items())))


def moved(blocks: Column, at: int, by: int) -> Column:
    """Block number `at` (from 0) `by` places on; a place outside the list leaves it as it is."""
    n, to = F.size(blocks), at + by
    rest = F.filter(blocks, lambda b, i: i != at)
    done = F.concat(F.slice(rest, 1, to), F.slice(blocks, at + 1, 1), F.slice(rest, to + 1, F.greatest(n, F.lit(1)))) if to >= 0 else blocks
    return F.when((n > at) & (n > to), done).otherwise(blocks) if at >= 0 else blocks


def still_usable(saved: DataFrame, usable: DataFrame, key: str = "library_id") -> DataFrame:
    """Rows of a saved selection whose library can still be used, as they were saved; null keys go."""
    return saved.join(usable.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").select(*saved.columns)


def selected_too(chosen: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Keys chosen before and those of the rows found now (a page, or all that a filter leaves), each once; null keys go."""
    return chosen.select(key).union(found.select(key)).where(F.col(key).isNotNull()).distinct()
