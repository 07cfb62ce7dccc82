"""Field by field: what a new observation would change in a record, and how.

Records are compared in long form, a row for each entity and field. Values of plain fields are JSON
texts; relations (age groups, sessions, prices) are compared as multisets of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.values import days_elapsed, half_up, is_iso_date, let, value_key

#: Proposals under this confidence aren't made; fields approved within SUPPRESS_DAYS only change above SUPPRESS_CONFIDENCE.
MIN_CONFIDENCE, SUPPRESS_DAYS, SUPPRESS_CONFIDENCE = 0.3, 30, 0.8

#: The fields that tell an item of a relation, with their types, and those that it must have.
RELATIONS = {
    "ageGroups": [("label", "text"), ("minAge", "number"), ("maxAge", "number"), ("minGrade", "number"), ("maxGrade", "number")],
    "schedules": [("label", "text"), ("startDate", "date"), ("endDate", "date"), ("startTime", "text"), ("endTime", "text"), ("earlyDropOff", "text"), ("latePickup", "text")],
    "pricing": [("label", "text"), ("amount", "number"), ("unit", "text"), ("durationWeeks", "number"), ("ageQualifier", "text"), ("discountNotes", "text")],
}


def comparable(value: Column) -> Column:
    """A plain value's text for comparing: null is empty, case and outer spaces don't count."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def comparable_set(items: Column) -> Column:
    """A list's text for comparing: order doesn't count, repetition does."""
    return F.to_json(F.array_sort(F.coalesce(items, F.array().cast("array<string>"))))


def item_keys(family: str, items: Column) -> Column:
    """The keys of a relation's items; ids and other fields don't count. Null stands for an item that lacks what
    it must have: a label; real days; an amount and a unit."""
    fields = RELATIONS[family]

    def key(x: Column) -> Column:
        fine = x["label"].isNotNull()
        if family == "schedules":
            fine = fine & is_iso_date(x["startDate"].cast("string")) & is_iso_date(x["endDate"].cast("string"))
        if family == "pricing":
            fine = fine & x["amount"].isNotNull() & (F.coalesce(x["unit"], F.lit("")) != "")
        return F.when(fine, value_key(x, [(n, {"text": "string", "date": "string"}.get(t, t)) for n, t in fields]))

    return F.transform(F.coalesce(items, F.array()), key) if items is not None else F.array()


def relation_change(current: Column, candidate: Column) -> Column:
    """struct(changed, added, removed, additive) for two arrays of item keys, as multisets.

    additive: there was something, all of it stays, there is more, and some of it is new. An item
    without a key (null) counts as changed and never as additive."""
    # the keys are worked out once: they are looked at ten times
    return let(F.struct(current.alias("a"), candidate.alias("b")), lambda s: _compared(s["a"], s["b"]))


def _compared(current: Column, candidate: Column) -> Column:
    broken = F.exists(current, lambda k: k.isNull()) | F.exists(candidate, lambda k: k.isNull())
    # both in one sorted array, where equal keys lie together, gone through once with a state of fixed size
    of = lambda keys, side: F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))
    none, no = F.lit(0), F.lit(False)
    start = F.struct(F.lit(None).cast("string").alias("k"), none.alias("a"), none.alias("b"), none.alias("added"), none.alias("removed"), no.alias("novel"))

    def told(s: Column) -> dict[str, Column]:
        """What the key before makes, once all of its items were seen."""
        more = s["b"] - s["a"]
        return {"added": s["added"] + F.greatest(more, none), "removed": s["removed"] + F.greatest(-more, none), "novel": s["novel"] | ((s["a"] == 0) & (s["b"] > 0))}

    def step(s: Column, x: Column) -> Column:
        mine, theirs, same = F.when(x["side"] == 0, 1).otherwise(0), F.when(x["side"] == 1, 1).otherwise(0), s["k"].eqNullSafe(x["k"])
        past = {n: F.when(same, s[n]).otherwise(c).alias(n) for n, c in told(s).items()}
        return F.struct(x["k"].alias("k"), (F.when(same, s["a"]).otherwise(0) + mine).alias("a"), (F.when(same, s["b"]).otherwise(0) + theirs).alias("b"), *past.values())

    finish = lambda s: F.struct(*[c.alias(n) for n, c in told(s).items()])
    made = F.aggregate(F.sort_array(F.concat(of(current, 0), of(candidate, 1))), start, step, finish)
    # where no key repeats, multisets are sets
    lacks = lambda a, b: F.size(F.array_except(a, b))
    sets = F.struct(lacks(candidate, current).alias("added"), lacks(current, candidate).alias("removed"), (lacks(candidate, current) > 0).alias("novel"))
    once = lambda keys: F.size(F.array_distinct(keys)) == F.size(keys)
    made = F.when(once(current) & once(candidate), sets).otherwise(made)
    return let(made, lambda x: _relation(current, candidate, broken, x))


def _relation(current: Column, candidate: Column, broken: Column, x: Column) -> Column:
    additive = (F.size(current) > 0) & (x["removed"] == 0) & (F.size(candidate) > F.size(current)) & x["novel"]
    changed = broken | (x["added"] > 0) | (x["removed"] > 0)
    none = F.lit(0)
    return F.struct(
        F.coalesce(changed, F.lit(True)).alias("changed"),
        F.when(broken, none).otherwise(x["added"]).alias("added"),
        F.when(broken, none).otherwise(x["removed"]).alias("removed"),
        F.coalesce(additive & ~broken, F.lit(False)).alias("additive"),
    )


def decide(changed: Column, empty: Column, additive: Column, confidence: Column, approved_at: Column, as_of: Column) -> Column:
    """What becomes of a field: none (nothing new, or too unsure), suppressed (approved of late), populate, add_items
    or update."""
    confidence = F.coalesce(confidence, F.lit(0.0))
    recent = F.coalesce((days_elapsed(approved_at, as_of) < SUPPRESS_DAYS) & (confidence < SUPPRESS_CONFIDENCE), F.lit(False))
    return F.when((confidence < MIN_CONFIDENCE) | ~changed, "none").when(recent, "suppressed").when(empty, "populate").when(additive, "add_items").otherwise("update")


def scalar_changes(rows: DataFrame, as_of: str) -> DataFrame:
    """rows: old, new (texts), confidence, approved_at and more. Adds mode. Without a new value nothing changes."""
    changed = F.col("new").isNotNull() & (comparable(F.col("old")) != comparable(F.col("new")))
    empty = F.col("old").isNull() | (F.col("old") == "")
    return rows.withColumn("mode", decide(changed, empty, F.lit(False), F.col("confidence"), F.col("approved_at"), F.lit(as_of)))


def list_changes(rows: DataFrame, as_of: str) -> DataFrame:
    """As scalar_changes(), for old and new as arrays of texts. An empty new list changes nothing."""
    changed = (F.size("new") > 0) & (comparable_set(F.col("old")) != comparable_set(F.col("new")))
    empty = F.coalesce(F.size("old") <= 0, F.lit(True))
    return rows.withColumn("mode", decide(F.coalesce(changed, F.lit(False)), empty, F.lit(False), F.col("confidence"), F.col("approved_at"), F.lit(as_of)))


def relation_changes(rows: DataFrame, family: str, as_of: str) -> DataFrame:
    """As scalar_changes(), for old and new as arrays of a relation's items. Adds mode, added and removed."""
    out = rows.withColumn("c_", relation_change(item_keys(family, F.col("old")), item_keys(family, F.col("new"))))
    some = F.coalesce(F.size("new") > 0, F.lit(False))
    mode = decide(some & F.col("c_.changed"), F.coalesce(F.size("old") <= 0, F.lit(True)), F.col("c_.additive"), F.col("confidence"), F.col("approved_at"), F.lit(as_of))
    return out.withColumns({"mode": mode, "added": F.col("c_.added"), "removed": F.col("c_.removed")}).drop("c_")


def long_fields(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """keys, field and ``name`` (as text): a row for each field."""
    return rows.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(keys, fields, "field", name)


def overall_confidence(changes: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The mean confidence of the changes that were proposed, for each key with any.

    A sum of doubles depends on the order in which they are added, which decides means that lie on a half. With ``order``, which tells a key's changes
    apart, they are added in that order, so that the result doesn't depend on how the rows are split; a key's changes are those of one record."""
    made = changes.where(~F.col("mode").isin("none", "suppressed"))
    if order is None:
        return made.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"), half_up(F.avg("confidence")).alias("confidence"))
    said = F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct(order.alias("at"), F.col("confidence").cast("double").alias("c")))).alias("c_")
    each = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"), said)
    total = F.aggregate(F.array_sort("c_"), F.lit(0.0), lambda done, x: done + x["c"])
    means = each.select(*keys, "changes", F.when(F.size("c_") > 0, total / F.size("c_")).alias("mean_"))
    return means.select(*keys, "changes", half_up("mean_").alias("confidence"))


def events_to_changes(events: DataFrame, allowed: list[str]) -> DataFrame:
    """events: kind, entity, field, old, new, confidence, change_kind. The changes among them, with mode or, where one
    isn't proposed, a warning (an unknown field; a removal)."""
    rows = events.where(F.col("kind") == "field-changed")
    told = F.concat_ws(":", "entity", "field")
    warning = F.when(~F.col("field").isin(allowed), F.concat(F.lit("unsupported-field-not-proposed:"), told)).when(F.col("new").isNull(), F.concat(F.lit("removal-not-proposed:"), told))
    mode = F.when(F.col("change_kind") == "value-populated", "populate").when(F.col("change_kind") == "items-added", "add_items").otherwise("update")
    return rows.withColumn("warning", warning).withColumn("mode", F.when(F.col("warning").isNull(), mode))


def apply_approved(current: DataFrame, changes: DataFrame, approved: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """current: keys, field, value; changes: keys, field, old, new; approved: keys, field. (the new current, the log).

    Fields that aren't approved stay. The log has a row for each field that was set: FIELD_POPULATED
    where there was nothing, else FIELD_UPDATED."""
    by = [*keys, "field"]
    todo = changes.join(approved.select(*by).distinct(), by, "left_semi").select(*by, "new", F.lit(True).alias("set_"))
    after = current.join(todo, by, "full").select(*by, F.when(F.col("set_"), F.col("new")).otherwise(F.col("value")).alias("value"))
    log = todo.join(current, by, "left")
    kind = F.when(F.col("value").isNull() | (F.col("value") == ""), "FIELD_POPULATED").otherwise("FIELD_UPDATED")
    return after, log.select(*by, F.col("value").alias("old"), "new", kind.alias("change"))
