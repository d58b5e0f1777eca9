"""The schemas of extracted records as a table of rules, compiled to one pass over a record's JSON: the cleaned record with its
defaults, and all that is wrong with it, not only the first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = object()


@dataclass(frozen=True)
class Field:
    """kind: text, number, texts (a list) or object. default: what stands for a field that isn't there, or REQUIRED; a field
    whose default is None may also be null. least, most: of a number; filled: a text may not be empty; words: all it may be."""

    name: str
    kind: str = "text"
    default: object = ""
    filled: bool = False
    least: int | None = None
    most: int | None = None
    words: tuple[str, ...] = ()


TYPES = ("human", "item", "skill", "spirit", "task", "faction", "rule")
RELATIONS = ("possess", "master", "contain", "restrain", "undertake", "belong_to", "host_bind", "alliance", "enmity", "family")
_NAME = {"default": REQUIRED, "filled": True}
_FRAGMENT = Field("source_fragment")


def _chapter(name: str, least: int | None = 0) -> Field:
    return Field(name, "number", None, least=least)


#: The fields of each kind of record, what they may hold and what stands for them.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "entity": (Field("name", **_NAME), _FRAGMENT, Field("aliases", "texts", ()), Field("type", default=REQUIRED, words=TYPES), Field("description")),
    "entity_snapshot": (
        Field("entity_name", **_NAME), _FRAGMENT, Field("status_desc"), Field("attributes", "object", "{}"), Field("three_state", default="fact", words=("fact", "inference", "review")),
        *(Field(f"attributes.{c}", "object", None) for c in ("physique", "psychology", "action")),
        *(Field(f"attributes.{c}", "texts", ()) for c in ("items", "skills", "doubts", "conflicts")),
        *(Field(f"attributes.{c}") for c in ("physique.health_status", "physique.power_level", "physique.body_special", "psychology.surface_emotion", "psychology.inner_emotion", "psychology.mental_change", "action.key_behavior", "action.key_line", "action.gain_loss")),
    ),
    "relation": (
        Field("source", **_NAME), _FRAGMENT, Field("target", **_NAME), Field("relation_type", default=REQUIRED, words=RELATIONS), Field("weight", "number", 2, least=1, most=2), Field("valid_period", default="temporary", words=("permanent", "temporary", "reversed")),
        Field("desc"), Field("surface_relation"), Field("inner_relation"), Field("relation_trend", default="稳定", words=("升温", "降温", "稳定", "破裂")),
    ),
    "event": (
        Field("event_level", default=REQUIRED, words=("stage", "event")), _FRAGMENT, Field("parent_title", default=None), Field("event_title", **_NAME), Field("event_content"), Field("time_desc"), Field("global_sort", "number", REQUIRED, least=0, most=999),
        _chapter("start_chapter"), _chapter("end_chapter"), Field("involved_entities", "texts", ()), Field("narrative_type"), Field("plot_impact"),
    ),
    "location": (Field("name", **_NAME), _FRAGMENT, Field("level", "number", REQUIRED, least=1, most=4), Field("parent_name", default=None), Field("description"), Field("status_desc"), Field("special_rules")),
    "foreshadowing": (
        Field("title", **_NAME), _FRAGMENT, Field("description"), _chapter("setup_chapter"), Field("setup_event_title", default=None), Field("status", default="pending", words=("pending", "revealed", "abandoned")),
        Field("involved_entities", "texts", ()), Field("foreshadowing_type"), Field("concealment_level", "number", None, least=1, most=10), Field("misleading_info"),
    ),
    "conflict": (
        Field("conflict_title", **_NAME), _FRAGMENT, Field("conflict_type", default="对抗"), Field("conflict_desc"), Field("side_a"), Field("side_b"), _chapter("start_chapter"), _chapter("end_chapter", None), Field("current_status", default="升级"),
    ),
    "rule": (
        Field("rule_name", **_NAME), _FRAGMENT, Field("rule_type", default="other", words=("cap", "cost", "balance_lock", "condition", "other")), Field("rule_content", **_NAME), Field("subject_entity_name", default=None), Field("subject_ability"),
        _chapter("valid_from_chapter", 1), Field("valid_to_chapter", "number", 0, least=0),
    ),
    "finding": (Field("record_type", default=REQUIRED), Field("target", **_NAME), Field("conflict_desc"), Field("severity", default="warning"), Field("suggested_value")),
}


def _default(f: Field) -> Column:
    if f.kind == "texts":
        return F.array(*map(F.lit, f.default or ())).cast("array<string>")
    return F.lit(None if f.default is REQUIRED else f.default).cast({"text": "string", "number": "bigint", "object": "string"}[f.kind])


def compiled(record: Column, f: Field) -> tuple[Column, Column]:
    """(value, what is wrong or null) of a field of a parsed record. Whole numbers may be written as 2.0, "2" or a truth value; other types aren't
    turned into each other."""
    path = f"$.{f.name}"
    raw = F.try_variant_get(record, path, "variant")
    kind = F.coalesce(F.schema_of_variant(raw), F.lit("none"))  # of what isn't there
    there = raw.isNotNull()
    null = kind == "VOID"
    holder = f.name.rpartition(".")[0]
    is_text = kind == "STRING"
    if f.kind == "text":
        right, value, says = is_text, F.try_variant_get(record, path, "string"), "not a text"
    elif f.kind == "number":
        number = F.try_variant_get(record, path, "double")
        written = F.try_variant_get(record, path, "string")
        whole = F.when(is_text, F.rlike(F.trim(written), F.lit(r"^[+-]?\d+(\.0*)?$"))).otherwise(kind.isin("BIGINT", "BOOLEAN") | ((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (number == F.floor(number))))
        right, value, says = whole, F.when(kind == "BIGINT", F.try_variant_get(record, path, "bigint")).when(kind == "BOOLEAN", F.try_variant_get(record, path, "boolean").cast("bigint")).otherwise(F.coalesce(number, F.expr("try_cast(null as double)")).cast("bigint")), "not a whole number"
        value = F.when(is_text, F.trim(written).try_cast("double").cast("bigint")).otherwise(value)
    elif f.kind == "texts":
        items = F.try_variant_get(record, path, "array<variant>")
        right = kind.startswith("ARRAY") & F.forall(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
        value, says = F.try_variant_get(record, path, "array<string>"), "not a list of texts"
    else:
        right, value, says = kind.startswith("OBJECT"), F.to_json(raw), "not an object"
    right = F.coalesce(right, F.lit(False))
    tests = []
    if f.filled:
        tests.append(F.when(value == "", f"{f.name}: empty"))
    if f.least is not None:
        tests.append(F.when(value < f.least, f"{f.name}: below {f.least}"))
    if f.most is not None:
        tests.append(F.when(value > f.most, f"{f.name}: above {f.most}"))
    if f.words:
        tests.append(F.when(~value.isin(*f.words), f"{f.name}: unknown value"))
    none = F.lit(None).cast("string")
    found = F.coalesce(*tests, none) if tests else none
    missing = F.lit(f"{f.name}: missing") if f.default is REQUIRED else none
    wrong = F.when(~there, missing).when(null, none if f.default is None else F.lit(f"{f.name}: {says}")).when(~right, f"{f.name}: {says}").otherwise(found)
    if holder:  # inside an object that isn't there, or isn't one, nothing is looked for
        inside = F.coalesce(F.schema_of_variant(F.try_variant_get(record, f"$.{holder}", "variant")).startswith("OBJECT"), F.lit(False))
        wrong = F.when(inside, wrong)
    return F.when(there & ~null & right, value).otherwise(_default(f)), wrong


def checked(records: DataFrame, kind: str, json: str = "json") -> DataFrame:
    """records with ``record`` (the cleaned fields; null where the JSON is no object) and ``violations``, all of them in the
    order of the fields. Fields that the schema doesn't have are left out."""
    parsed = F.try_parse_json(json)
    rows = records.withColumn("__v", F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), parsed))
    each = [(f, *compiled(F.col("__v"), f)) for f in SCHEMAS[kind]]
    readable = F.col("__v").isNotNull()
    record = F.struct(*[value.alias(f.name) for f, value, _ in each if "." not in f.name])
    wrong = F.filter(F.array(*[w for _, _, w in each]), lambda w: w.isNotNull())
    return rows.withColumns({"record": F.when(readable, record), "violations": F.when(readable, wrong).otherwise(F.array(F.lit("not an object")))}).drop("__v")
