"""The review queue: history, corroboration, lanes, what a machine would accept, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.values import compact_map, same_value
from trellis.operators.nest import first_of_each
from trellis.operators.ranking import both_ends

#: So many of a subject's proposals, the newest, can speak for one another.
HISTORY = 20
#: So many proposals of a lane are ranked.
LANE_CAP = 1000
#: Fields that a machine may accept by itself.
LOW_RISK = ("organizationName", "description", "campType", "category", "ageGroups", "city")
SURE = 0.9


def supersede(proposals: DataFrame, subject: str, created: str, status: str, key: str) -> DataFrame:
    """Of a subject's pending proposals all but the newest become SKIPPED."""
    newest = proposals.where(F.col(status) == "PENDING").groupBy(subject).agg(F.max(F.struct(created, key)).alias("n_")).select(F.col(subject).alias("s_"), F.col(f"n_.{key}").alias("keep_"))
    rows = proposals.join(newest, F.col(subject) == F.col("s_"), "left")
    old = (F.col(status) == "PENDING") & (F.col(key) != F.col("keep_"))
    return rows.select(*[F.when(old, "SKIPPED").otherwise(F.col(c)).alias(c) if c == status else c for c in proposals.columns])


def recent_history(proposals: DataFrame, subject: str, created: str, key: str, most: int = HISTORY) -> DataFrame:
    """The newest proposals of each subject; ties by key, the larger first."""
    return first_of_each(proposals, [subject], [F.desc(created), F.desc(key)], most).drop("rank")


def corroborated(claims: DataFrame, history: DataFrame) -> DataFrame:
    """claims and history: id, subject, run, field, value (claims of proposals, one row a field). claims with
    corroborations, the number of proposals in history that say the same.

    Only another proposal counts, from another run; null runs never do. history holds HISTORY
    proposals of a subject, so a claim meets no more than that."""
    past = history.select(F.col("id").alias("id2"), F.col("subject").alias("s2"), F.col("run").alias("run2"), F.col("field").alias("f2"), F.col("value").alias("v2"))
    met = claims.join(past, (F.col("subject") == F.col("s2")) & (F.col("field") == F.col("f2")))
    met = met.where((F.col("id") != F.col("id2")) & (F.col("run") != F.col("run2")) & same_value(F.col("value"), F.col("v2")))
    n = met.groupBy("id", "field").agg(F.count_distinct("id2").alias("corroborations"))
    return claims.join(n, ["id", "field"], "left").withColumn("corroborations", F.coalesce("corroborations", F.lit(0)))


def is_populate(mode: Column, old: Column) -> Column:
    """The claim fills a gap, so there is nothing that it would replace."""
    return F.coalesce(mode == "populate", F.lit(False)) | old.isNull()


def selectable(corroborations: Column, mode: Column, old: Column) -> Column:
    """May be accepted in a batch: others say the same, and it replaces something."""
    return (corroborations > 0) & ~is_populate(mode, old)


def ranked_queue(proposals: DataFrame, claims: DataFrame, cap: int = LANE_CAP) -> DataFrame:
    """proposals: id, subject, run, created, priority, confidence; claims: id, field, old, value, mode. id, lane, place,
    selectable: the two lanes, batch (something is selectable; surest first) and review (least sure first),
    by priority and then confidence.

    Candidates are the ``cap`` surest and the ``cap`` least sure; each lane has ``cap`` rows at most."""
    lead = [F.desc("priority")]
    rows = both_ends(proposals, "confidence", "id", cap, lead)
    history = recent_history(proposals.join(rows.select("subject").distinct(), "subject", "left_semi"), "subject", "created", "id")
    said = claims.join(history.select("id", "subject", "run"), "id")
    told = corroborated(said.join(rows.select("id"), "id", "left_semi"), said)
    n = told.groupBy("id").agg(F.count_if(selectable(F.col("corroborations"), F.col("mode"), F.col("old"))).alias("selectable"))
    out = rows.join(n, "id", "left").withColumn("selectable", F.coalesce("selectable", F.lit(0)))
    out = out.withColumn("lane", F.when(F.col("selectable") > 0, "batch").otherwise("review"))
    order = F.when(F.col("lane") == "batch", -F.col("confidence")).otherwise(F.col("confidence"))
    place = F.row_number().over(W.partitionBy("lane").orderBy(F.desc("priority"), order, "id"))
    return out.withColumn("place", place).where(F.col("place") <= cap).select("id", "lane", "place", "priority", "confidence", "selectable")


def machine_accepts(fields: Column, confidence: Column, resolved: Column, sure: float = SURE, low_risk: tuple[str, ...] = LOW_RISK) -> Column:
    """Every field is of low risk, the confidence is high, and the page can be shown. Without fields never."""
    return F.coalesce((F.size(fields) > 0) & F.forall(fields, lambda f: f.isin(*low_risk)) & (confidence >= sure) & resolved, F.lit(False))


def extraction_metrics(rows: DataFrame) -> DataFrame:
    """rows: camp_id, host, confidence, duration_ms, changes, error, tokens, calls, field_confidence (map). Six metrics
    for each row, and one for each field: name, value, dims."""
    camp, host = F.col("camp_id").cast("string"), F.col("host")
    dims = lambda **d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    one = lambda name, value, d: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), d.alias("dims"))
    fixed = F.array(
        one("extraction_confidence", F.col("confidence"), dims(campId=camp, siteHost=host)),
        one("extraction_duration_ms", F.col("duration_ms"), dims(campId=camp, siteHost=host)),
        one("changes_found", F.col("changes"), dims(campId=camp)),
        one("site_fetch_success", F.when(F.col("error").isNull(), 1).otherwise(0), dims(siteHost=host)),
        one("tokens_used", F.col("tokens"), dims(campId=camp)),
        one("provider_calls", F.col("calls"), dims(campId=camp)),
    )
    each = F.transform(F.map_entries("field_confidence"), lambda e: one("field_confidence", e["value"], dims(campId=camp, field=e["key"], siteHost=host)))
    return rows.select(F.explode(F.concat(fixed, F.coalesce(each, F.array().cast(rows.select(fixed.alias("f")).schema["f"].dataType)))).alias("m")).select("m.*")


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """decisions: id, run, approved, rejected (arrays of fields), changes (map field -> struct(old, new)), final, notes.
    run, name, dims: a row for each field, and one to learn from for each rejected change of a final decision."""
    key = F.col("id").cast("string")
    dims = lambda f: F.create_map(F.lit("field"), f, F.lit("proposalId"), key)
    fields = lambda c, name: F.transform(c, lambda f: F.struct(F.lit(name).alias("name"), dims(f).alias("dims")))

    def learn(f: Column) -> Column:
        diff = F.try_element_at(F.col("changes"), f)
        more = F.create_map(F.lit("field"), f, F.lit("proposalId"), key, F.lit("old"), diff["old"], F.lit("new"), diff["new"], F.lit("notes"), F.col("notes"))
        return F.struct(F.lit("field_rejection_learning_signal").alias("name"), compact_map(more).alias("dims"))

    known = F.filter("rejected", lambda f: F.col("final") & F.map_contains_key("changes", f))
    every = F.concat(fields("approved", "field_approved"), fields("rejected", "field_rejected"), F.transform(known, learn))
    return decisions.select("run", F.explode(every).alias("m")).select("run", "m.name", "m.dims")


def notifications(due: DataFrame, saves: DataFrame, users: DataFrame) -> DataFrame:
    """due: camp_id; saves: user_id, camp_id; users: user_id, opted_in. Each opted-in user with each due camp saved."""
    willing = users.where("opted_in").select("user_id")
    return saves.select("user_id", "camp_id").distinct().join(due, "camp_id").join(willing, "user_id", "left_semi")
