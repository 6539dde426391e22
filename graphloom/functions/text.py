"""String functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.config import REQUIREMENT_CODES
from graphloom.functions.numbers import round_even

# Patterns of structural features.
STEP = r"(?m)^\s*(?:\(\d+\)|\d+[.\):]|Step\s+\d+:|[a-z][.\)])\s+\S"
TOOLS = r"(?im)^\s*(?:TOOLS REQUIRED|MATERIALS REQUIRED|PARTS REQUIRED)"
SAFETY = r"(?im)^\s*(?:WARNING|CAUTION|NOTE)\s*[:\-]?\s*$"
TASK = r"(?im)^\s*(?:TASK|JOB SET-UP|JOB CLOSE-UP|SUBTASK|PROCEDURE)\b"
PART_NUMBER = r"\b\d{3,}\s*[\-]\s*\d{3,}\b"
MEASURE = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:Nm|N\.m|ft\.?lb|bar|psi|mm|cm|°[CF]|kPa)\b"


def words(x: Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def search_tokens(x: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def features(x: Column) -> dict[str, Column]:
    """The nine structural features of a text."""
    steps, measures = F.regexp_count(x, F.lit(STEP)).cast("long"), F.regexp_count(x, F.lit(MEASURE)).cast("long")
    out = {f"has_{w}": x.rlike(rf"(?i)\b{w.upper()}\b") for w in ("warning", "caution", "note")}
    return out | {"has_steps": steps > 0, "has_tools_table": x.rlike(TOOLS), "has_measurements": measures > 0, "has_part_numbers": x.rlike(PART_NUMBER), "step_count": steps, "measurement_count": measures}


def block_features(x: Column) -> dict[str, Column]:
    """Whether a text has a line that is a safety heading alone, or one that begins a task."""
    return {"has_safety_block": x.rlike(SAFETY), "has_task": x.rlike(TASK)}


def guess_chapter(title: Column) -> Column:
    """The first two-digit group that stands alone, else 00."""
    found = F.regexp_extract(F.coalesce(title, F.lit("")), r"\b(\d{2})(?:-\d+)?\b", 1)
    return F.when(found == "", "00").otherwise(found)


def codes(x: Column) -> Column:
    """All two-digit numbers that stand alone."""
    return F.regexp_extract_all(x, F.lit(r"\b(\d{2})\b"), F.lit(1))


# How umlauts are spelt out in names.
SPELT = {"ä": "AE", "ö": "OE", "ü": "UE", "Ä": "AE", "Ö": "OE", "Ü": "UE", "ß": "SS"}


def normalize_name(x: Column) -> Column:
    """Umlauts spelt out, punctuation to spaces, spaces to one underscore, upper case, five parts at most."""
    for a, b in SPELT.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-_/]+", "_")
    return F.array_join(F.slice(F.split(F.upper(x), "_"), 1, 5), "_")


def dedup_form(x: Column) -> Column:
    """normalize_name in lower case without separators."""
    return F.replace(F.lower(normalize_name(x)), F.lit("_"), F.lit(""))


def zfill(x: Column, n: int) -> Column:
    return F.lpad(x, F.greatest(F.lit(n), F.length(x)), F.lit("0"))


def numbered(prefix: str, chapter: Column, *middle: Column, seq: Column, digits: int = 4) -> Column:
    """PREFIX-chapter[-middle]-0001."""
    return F.concat_ws("-", F.lit(prefix), zfill(chapter, 2), *middle, zfill(seq.cast("string"), digits))


def named(prefix: str, name: Column, chapter: Column | None = None) -> Column:
    """PREFIX[-chapter]-NORMALIZED_NAME."""
    return F.concat_ws("-", F.lit(prefix), *([zfill(chapter, 2)] if chapter is not None else []), normalize_name(name))


def requirement_id(chapter: Column, kind: Column, seq: Column) -> Column:
    code = F.lit("REQ")
    for k, v in REQUIREMENT_CODES.items():
        code = F.when(kind == k, v).otherwise(code)
    return numbered("REQ", chapter, code, seq=seq)


def part_id(number: Column) -> Column:
    return F.concat(F.lit("PART-"), F.regexp_replace(F.upper(number), r"(?U)[^\w\-]", ""))


def step_id(task: Column, step: Column) -> Column:
    return F.concat_ws("-", F.lit("STEP"), task, zfill(step.cast("string"), 3))


def task_id(chapter: Column, section: Column, subject: Column, number: Column) -> Column:
    return numbered("TASK", chapter, zfill(section, 2), zfill(subject, 2), seq=number)


def chunk_node_id(section: Column, seq: Column) -> Column:
    return F.concat_ws("-", F.lit("CHUNK"), section, zfill(seq.cast("string"), 4))


def measurement_key(context: Column, value: Column, unit: Column) -> Column:
    """The key of a measurement: where it stands, its value and unit."""
    return F.concat(F.lit("measurement::"), dedup_form(F.substring(context, 1, 60)), F.lit("-"), value, F.lit("-"), unit)


def interval_key(raw: Column) -> Column:
    return F.concat(F.lit("interval::"), dedup_form(F.substring(raw, 1, 60)))


def relationship_key(source: Column, target: Column, kind: Column) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), kind.alias("type"))


def truthy(x: Column) -> Column:
    """x, or null where it is the empty string."""
    return F.nullif(x, F.lit(""))


def first_truthy(*xs: Column) -> Column:
    return F.coalesce(*[truthy(x) for x in xs])


def typed_dedup_key(kind: Column, name: Column, text: Column, ident: Column) -> Column:
    """Keys by type: names for things, the first 80 characters of safety texts, bare numbers for parts, else the id."""
    clipped = F.substring(text, 1, 80)
    key = F.when(kind == "PartNumber", F.concat(F.lit("part::"), F.regexp_replace(F.upper(name), r"[\s\-]", "")))
    for t in ("Warning", "Caution", "Note", "Requirement"):
        key = key.when(kind == t, F.concat(F.lit(t.lower() + "::"), dedup_form(clipped)))
    for t in ("Component", "System", "Tool", "Consumable"):
        key = key.when(kind == t, F.concat(F.lit(t.lower() + "::"), dedup_form(name)))
    return key.otherwise(ident)


def chunk_text(chapter: Column, title: Column, text: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(F.lit("[ATA "), chapter, F.lit("] "), title, F.lit("\n"), text)


def entity_text(kind: Column, chapter: Column, name: Column, description: Column, system: Column) -> Column:
    """What is embedded of an entity."""
    return F.concat(F.lit("["), kind, F.lit(" ATA-"), chapter, F.lit("] "), name, F.lit(". "), F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(system, F.lit("")))


def without_thoughts(x: Column) -> Column:
    """x without <think> blocks, trimmed."""
    return F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def duration(ms: Column) -> Column:
    """In which band milliseconds fall: ok, warn, bad."""
    return F.when(ms >= 30000, "bad").when(ms >= 5000, "warn").otherwise("ok")


def short_label(x: Column, most: int = 16) -> Column:
    x = F.replace(x, F.lit("_"), F.lit(" "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of keywords that the answer holds, in any case; 1 of none."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))).cast("double")
    return F.when(F.size(keywords) == 0, 1.0).otherwise(round_even(hit / F.size(keywords), 3))


def relative_gain(base: Column, now: Column) -> Column:
    """Percent of the room above base that now fills; 0 where base leaves none."""
    return F.when(base >= 1, 0.0).otherwise(round_even((now - base) / F.when(base < 1, 1 - base) * 100, 1))
