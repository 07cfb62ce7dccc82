"""The trust ledger: claims, the events that decide on them, how long a decision holds, and what follows for a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import resolve_excerpt
from trellis.functions.values import days_elapsed
from trellis.operators.nest import nest
from trellis.operators.spread import dealt

#: States of a claim, weakest first.
STATES = ("revoked", "rejected", "superseded", "disputed", "stale", "unknown", "proposed", "assumed", "verified")
#: Days for which a decision holds, by kind of claim.
VALID_DAYS = {
    "camp-scalar-field": 180, "camp-repeated-field": 120, "session-dates": 180, "session-time": 180,
    "session-eligibility": 180, "session-registration-status": 30, "session-price-options": 90, "session-registration-path": 180,
}
#: The fields that a verified subject needs, besides verified sessions; those that a session needs.
CAMP_FIELDS = ("description", "campType", "category", "registrationStatus", "city", "websiteUrl", "ageGroups", "pricing")
SESSIONS_VERIFIED = "sessions-verified"


def state_rank(state: Column) -> Column:
    """0 for the weakest; unknown states and null count as unknown."""
    found = F.lit(STATES.index("unknown"))
    for i, s in enumerate(STATES):
        found = F.when(state == s, i).otherwise(found)
    return found


def state_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), rank.cast("int") + 1)


def claim_states(claims: DataFrame, events: DataFrame, as_of: str, tasks: int | None = None) -> DataFrame:
    """claims: claim_id, kind; events: claim_id, event_id, state, at. claims with state and since.

    The newest event decides, ties by the larger id; without one the claim is unknown. A verified claim
    is stale once its kind's days are over; kinds that aren't listed never expire. ``tasks``: as in dealt()."""
    claims, events = (dealt(side, tasks, "claim_id") for side in (claims, events.select("claim_id", "event_id", "state", "at")))
    newest = events.groupBy("claim_id").agg(F.max_by(F.struct("state", "at"), F.struct("at", "event_id")).alias("e_"))
    rows = claims.join(newest, "claim_id", "left")
    days = F.lit(None).cast("int")
    for kind, n in VALID_DAYS.items():
        days = F.when(F.col("kind") == kind, n).otherwise(days)
    over = F.coalesce(days_elapsed(F.col("e_.at"), F.lit(as_of)) > days, F.lit(False))
    state = F.when(F.col("e_").isNull(), "unknown").when((F.col("e_.state") == "verified") & over, "stale").otherwise(F.col("e_.state"))
    return rows.select(*claims.columns, state.alias("state"), F.col("e_.at").alias("since"))


def requirement_states(wanted: DataFrame, claims: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """wanted: keys, requirement; claims: keys, requirement, state. wanted with state: that of the weakest of its claims.
    Claims that are all assumed count as verified; no claim at all is unknown."""
    by = [*keys, "requirement"]
    wanted, claims = dealt(wanted, tasks, *by), dealt(claims, tasks, *by)
    each = claims.groupBy(*by).agg(F.min(state_rank(F.col("state"))).alias("r_"), F.bool_and(F.col("state") == "assumed").alias("assumed_"))
    state = F.when(F.col("assumed_"), "verified").when(F.col("r_").isNull(), "unknown").otherwise(state_of_rank(F.col("r_")))
    return wanted.join(each, by, "left").select(*wanted.columns, state.alias("state"))


def rolled_up(requirements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, n, met: a subject is as good as its weakest requirement, and verified only if all are."""
    out = requirements.groupBy(*keys).agg(F.min(state_rank(F.col("state"))).alias("r_"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "verified").alias("met"))
    return out.select(*keys, state_of_rank(F.col("r_")).alias("state"), "n", "met")


def sessions_state(subjects: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """key, requirement, state of "all sessions are verified": that of the weakest session, and verified without any."""
    worst = sessions.groupBy(key).agg(F.min(state_rank(F.col("state"))).alias("r_"))
    state = F.coalesce(state_of_rank(F.col("r_")), F.lit("verified"))
    return subjects.select(key).join(worst, key, "left").select(key, F.lit(SESSIONS_VERIFIED).alias("requirement"), state.alias("state"))


def _by_field(claims: DataFrame, key: str, fields: tuple[str, ...], tasks: int | None) -> DataFrame:
    """key, and of each field by its place the rank of its weakest claim and whether all are assumed: a row for each subject."""
    told = claims.where(F.col("requirement").isin(*fields)).select(key, F.array_position(F.array(*map(F.lit, fields)), F.col("requirement")).cast("int").alias("f_"), state_rank(F.col("state")).alias("r_"), (F.col("state") == "assumed").alias("a_"))
    own = lambda i, c: F.when(F.col("f_") == i + 1, F.col(c))
    return dealt(told, tasks, key).groupBy(key).agg(*[x for i in range(len(fields)) for x in (F.min(own(i, "r_")).alias(f"r{i}_"), F.bool_and(own(i, "a_")).alias(f"a{i}_"))])


def _field_rank(i: int) -> Column:
    """As requirement_states() has it, of _by_field()."""
    return F.when(F.col(f"a{i}_"), STATES.index("verified")).otherwise(F.coalesce(f"r{i}_", F.lit(STATES.index("unknown"))))


def field_states(subjects: DataFrame, claims: DataFrame, key: str, fields: tuple[str, ...] = CAMP_FIELDS, tasks: int | None = None) -> DataFrame:
    """key, requirement, state: requirement_states() of all ``fields`` for each subject, which are put together by subject before they meet it."""
    rows = dealt(subjects.select(key), tasks, key).join(_by_field(claims, key, fields, tasks), key, "left")
    each = [F.struct(F.lit(f).alias("requirement"), state_of_rank(_field_rank(i)).alias("state")) for i, f in enumerate(fields)]
    return rows.select(key, F.explode(F.array(*each)).alias("s_")).select(key, "s_.*")


def camp_rollup(camps: DataFrame, claims: DataFrame, sessions: DataFrame, key: str = "camp_id", fields: tuple[str, ...] = CAMP_FIELDS, tasks: int | None = None) -> DataFrame:
    """camps: key; claims: key, requirement, state; sessions: key, state. key, state, n, met and confidence.

    As rolled_up() of requirement_states() and sessions_state(), with one row for each camp, not one for each of its requirements."""
    rows = dealt(camps.select(key), tasks, key).groupBy(key).agg(F.count(F.lit(1)).alias("times_")).join(_by_field(claims, key, fields, tasks), key, "left")
    worst = dealt(sessions.select(key, state_rank(F.col("state")).alias("s_")), tasks, key).groupBy(key).agg(F.min("s_").alias("s_"))
    best = F.lit(STATES.index("verified"))
    ranks = F.array(*[_field_rank(i) for i in range(len(fields))], F.coalesce("s_", best))
    told = rows.join(worst, key, "left").select(key, "times_", ranks.alias("ranks_"))
    met = F.size(F.filter("ranks_", lambda r: r == best))
    out = told.select(key, state_of_rank(F.array_min("ranks_")).alias("state"), (F.col("times_") * (len(fields) + 1)).alias("n"), (F.col("times_") * met).alias("met"))
    return out.withColumn("confidence", data_confidence(F.col("state")))


def rollup_of_events(subjects: DataFrame, events: DataFrame, as_of: str, key: str = "camp_id") -> DataFrame:
    """subjects: key; events: key, claim_id, requirement, kind, event_id, state, at. As camp_rollup() of their claims, with due: the day from which on
    a verified claim is stale, the first of the subject's; null if none will be. For RollUp, which keeps it up to date."""
    claims = events.groupBy("claim_id").agg(F.min(F.struct(key, "requirement", "kind")).alias("c")).select("claim_id", "c.*")
    states = claim_states(claims, events.select("claim_id", "event_id", "state", "at"), as_of)
    days = F.coalesce(*[F.when(F.col("kind") == kind, n) for kind, n in VALID_DAYS.items()])
    due = states.where("state = 'verified'").groupBy(key).agg(F.min(F.timestamp_seconds(F.unix_seconds("since") + days * 86_400)).alias("due"))
    none = states.limit(0).select(key, "state")
    return camp_rollup(subjects, states.select(key, "requirement", "state"), none, key).join(due, key, "left")


def session_rollup(sessions: DataFrame, own: DataFrame, camp: DataFrame, inherits: dict[str, str], attributes: list[str]) -> DataFrame:
    """sessions: camp_id, session_id; own: session_id, requirement, state; camp: camp_id, requirement, state. A session's
    state from its attributes; those in ``inherits`` (attribute -> the camp's field) are the camp's
    where the session has none of its own."""
    keys = ["camp_id", "session_id"]
    wanted = sessions.select(*keys, F.explode(F.array(*map(F.lit, attributes))).alias("requirement"))
    mine = own.groupBy("session_id", "requirement").agg(F.min(state_rank(F.col("state"))).alias("own_"))
    theirs = camp.groupBy("camp_id", F.col("requirement").alias("from_")).agg(F.min(state_rank(F.col("state"))).alias("camp_"))
    source = F.lit(None).cast("string")
    for a, f in inherits.items():
        source = F.when(F.col("requirement") == a, f).otherwise(source)
    rows = wanted.withColumn("from_", source).join(mine, ["session_id", "requirement"], "left").join(theirs, ["camp_id", "from_"], "left")
    rank = F.coalesce("own_", "camp_", F.lit(STATES.index("unknown")))
    return rolled_up(rows.select(*keys, "requirement", state_of_rank(rank).alias("state")), keys)


def capped(state: Column, inputs: Column) -> Column:
    """A derived claim's state: no better than the weakest of its inputs' (an array; a null in it is a missing input)."""
    ranks = F.transform(inputs, state_rank)
    return state_of_rank(F.least(state_rank(state), F.coalesce(F.array_min(ranks), state_rank(state))))


def data_confidence(state: Column) -> Column:
    return F.when(state == "verified", "VERIFIED").when(state == "stale", "STALE").otherwise("PLACEHOLDER")


def coverage(requirements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, covered, missing, unattested (arrays of requirements, sorted), percent: verified ones; ones without a claim
    (unknown); and the others."""
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("requirement"))))
    good, none = F.col("state") == "verified", F.col("state") == "unknown"
    out = requirements.groupBy(*keys).agg(pick(good).alias("covered"), pick(none).alias("missing"), pick(~good & ~none).alias("unattested"), F.count(F.lit(1)).alias("n_"))
    return out.withColumn("percent", F.floor(F.size("covered") * 100.0 / F.col("n_") + 0.5).cast("int")).drop("n_")


def downgrades(camps: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Subjects that are shown as VERIFIED but whose claims say otherwise."""
    return camps.where(F.col("shown") == "VERIFIED").join(derived.select(key, "confidence"), key).where("confidence <> shown")


def trust_display(claims: DataFrame, events: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """claims: claim_id, state; events: claim_id, event_id, state, at, actor, evidence_id; evidence: evidence_id, mode,
    method, source_ref, locator, excerpt; pages: source_ref, body. claim_id, shown, origin, actor, at.

    The newest event with the claim's own state and evidence tells. An override shows as attested without
    a source; an excerpt that still stands in its page as verified, else as stale."""
    with_evidence = events.join(evidence, "evidence_id").join(claims.select("claim_id", F.col("state").alias("own_")), "claim_id").where(F.col("state") == F.col("own_"))
    newest = with_evidence.groupBy("claim_id").agg(F.max_by(F.struct("state", "at", "actor", "mode", "method", "source_ref", "locator", "excerpt"), F.struct("at", "event_id")).alias("e"))
    # distinct pages only: a page that many claims cite is joined once for each claim, and a page is one row
    rows = claims.select("claim_id").join(newest, "claim_id", "left").select("claim_id", "e.*").join(pages.select("source_ref", "body"), "source_ref", "left")
    override = F.coalesce(F.col("mode") == "override", F.lit(False))
    counts = (F.col("state") == "verified") | ((F.col("state") == "assumed") & override)
    sourced = F.col("source_ref").isNotNull() & (F.coalesce("locator", F.lit("")) != "") & (F.coalesce("excerpt", F.lit("")) != "")
    there = resolve_excerpt("excerpt", "body", "locator")["state"] == "verified"
    shown = F.when(~F.coalesce(counts, F.lit(False)), "unverified").when(override, "attested_no_source").when(sourced, F.when(there, "verified_current").otherwise("stale_unresolvable")).otherwise("unverified")
    origin = F.when(shown == "unverified", "none").when(override | (F.col("method") == "attestation"), "human").otherwise("crawl")
    known = shown != "unverified"
    return rows.select("claim_id", shown.alias("shown"), origin.alias("origin"), F.when(known, F.col("actor")).alias("actor"), F.when(known, F.col("at")).alias("at"))


#: What an attestation's status makes of its claim, as state and kind of event.
ATTESTED = {"ACTIVE": ("verified", "verification"), "STALE": ("stale", "invalidation"), "INVALIDATED": ("revoked", "invalidation")}
REPEATED = ("ageGroups", "pricing", "schedules")


def backfill(camps: DataFrame, attestations: DataFrame, known: DataFrame, fields: tuple[str, ...] = CAMP_FIELDS, collector: str = "backfill") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ledger rows that older records stand for: claims (claim_id, camp_id, field, kind), evidence (evidence_id, claim_id,
    evidence_type, method, source_ref, excerpt, observed_at, collected_by) and events (event_id, claim_id,
    evidence_id, state, type, actor, method, at, verified_at, notes).

    camps: camp_id, field_sources (map field -> struct(approvedAt, attestedBy, sourceUrl, excerpt, notes));
    attestations: id, entity_type, entity_id, field, status, source_url, excerpt, notes, observed_at,
    approved_at, approved_by, reason; known: id, of what is there already. Only fields that a verified
    subject needs count, and only entries that someone approved: an observation is no verification.
    Ids follow from what they stand for, so a second run adds nothing."""
    claim = lambda camp, field: F.concat_ws(".", F.lit("camp"), camp.cast("string"), field)
    nothing = F.lit("No excerpt was recorded.")
    s = camps.select("camp_id", F.explode("field_sources").alias("field", "s")).where(F.col("field").isin(*fields) & F.col("s.approvedAt").isNotNull())
    by = F.col("s.attestedBy")
    sources = s.select(
        "camp_id", "field", claim(F.col("camp_id"), F.col("field")).alias("claim_id"), F.lit("field-source").alias("of"), by.isNotNull().alias("attested"), F.coalesce(by, F.lit(collector)).alias("actor"),
        F.when(by.isNotNull(), F.concat(F.lit("admin:"), by)).otherwise(F.col("s.sourceUrl")).alias("source_ref"), F.coalesce("s.excerpt", "s.notes", nothing).alias("excerpt"), F.col("s.approvedAt").alias("observed_at"), F.lit("verified").alias("state"),
        F.lit("verification").alias("type"), F.col("s.approvedAt").alias("at"), F.col("s.approvedAt").alias("verified_at"), F.lit(None).cast("string").alias("notes"),
    )
    a = attestations.where((F.col("entity_type") == "CAMP") & F.col("field").isin(*fields))
    state, kind = (F.coalesce(*[F.when(F.col("status") == k, v[i]) for k, v in ATTESTED.items()]) for i in (0, 1))
    actor, at = F.coalesce("approved_by", F.lit(collector)), F.coalesce("approved_at", "observed_at")
    attested = a.select(
        F.col("entity_id").alias("camp_id"), "field", claim(F.col("entity_id"), F.col("field")).alias("claim_id"), F.concat(F.lit("attestation."), F.col("id").cast("string")).alias("of"), F.lit(True).alias("attested"), actor.alias("actor"),
        F.coalesce("source_url", F.concat(F.lit("admin:"), actor)).alias("source_ref"), F.coalesce("excerpt", "notes", nothing).alias("excerpt"), "observed_at", state.alias("state"),
        kind.alias("type"), at.alias("at"), F.when(F.col("status") == "ACTIVE", at).alias("verified_at"), F.coalesce("reason", "notes").alias("notes"),
    )
    rows = sources.unionByName(attested).withColumns({"evidence_id": F.concat_ws(".", F.lit("evidence"), "claim_id", "of"), "event_id": F.concat_ws(".", F.lit("event"), "claim_id", "of"), "method": F.when(F.col("attested"), "attestation").otherwise("observation")})
    new = lambda df, c: df.join(known.select(F.col("id").alias(c)), c, "left_anti")
    claims = rows.select("claim_id", "camp_id", "field", F.when(F.col("field").isin(*REPEATED), "camp-repeated-field").otherwise("camp-scalar-field").alias("kind")).distinct()
    evidence = rows.select("evidence_id", "claim_id", F.when(F.col("attested"), "attestation").otherwise("crawl_observation").alias("evidence_type"), "method", "source_ref", "excerpt", "observed_at", F.col("actor").alias("collected_by"))
    events = rows.select("event_id", "claim_id", "evidence_id", "state", "type", "actor", "method", "at", "verified_at", "notes")
    return new(claims, "claim_id"), new(evidence, "evidence_id"), new(events, "event_id")


#: States that a registration may have.
REGISTRATION = ("OPEN", "FULL", "WAITLIST", "CLOSED", "COMING_SOON", "UNKNOWN")
_REVIEW = "struct<id:string,actor:string,at:timestamp,state:string>"
#: What the ledger is told of where an observation comes from, and how much hangs on it.
AUTHORITY, PRODUCT_AREA, SUBJECT, LOCATOR, IMPACT = "publisher_owned_page", "public-directory", "camp", "html:field=", "medium"


def observations(camps: DataFrame, proposals: DataFrame, generated_at: str, product: str = "directory") -> DataFrame:
    """What the ledger is told of two fields, the state of registration and the sessions: as they stand, and as proposed.

    camps: camp_id, slug, name, data_confidence, url, status, n_schedules, verified_at, crawled_at, field_sources (as in
    backfill()); proposals: id, camp_id, url, status, created, reviewed_at, reviewed_by, model,
    overall_confidence, changes (map field -> struct(old, new, mode, n_items, sourceUrl, excerpt, confidence); n_items: of
    sessions, null if they aren't as sessions must be). claim_id, camp_id, field, value (of sessions their number), state, source_ref,
    observed_at, extracted_at, extractor, excerpt, confidence, review, claim_type, created, updated, actor,
    collected_by, method, metadata (JSON: of the subject and its field's source, or of the proposal), support (moderate or none: whether a
    review or a confidence stands behind it), locator, impact_level and, of the state of registration only, authority: the
    class of its source, what that holds for (product_area, subject_type, subject_id, field), and who says so.

    A field that someone approved is verified; an unknown status is unknown; the rest is proposed. Sessions
    that there are none of, and nobody approved, aren't told, nor are proposals with a value that can't be."""
    now = F.lit(generated_at).cast("timestamp")
    parts = []
    for field, repeated in (("registrationStatus", False), ("schedules", True)):
        kind = "public-data.repeated-field" if repeated else "public-data.field"
        s = F.try_element_at("field_sources", F.lit(field))
        ok = s["approvedAt"].isNotNull()
        claim = F.concat_ws(".", F.lit(product), F.col("camp_id").cast("string"), F.lit(field), F.lit("current"))
        seen = F.coalesce(s["approvedAt"], "crawled_at", now)
        unknown = F.lit(False) if repeated else F.col("status") == "UNKNOWN"
        rows = camps.where((F.col("n_schedules") > 0) | ok) if repeated else camps
        review = F.when(ok, F.struct(F.concat(claim, F.lit(".review.approved")).alias("id"), F.lit("admin").alias("actor"), s["approvedAt"].alias("at"), F.lit("verified").alias("state"))).otherwise(F.lit(None).cast(_REVIEW))
        parts.append(rows.select(
            claim.alias("claim_id"), "camp_id", F.lit(field).alias("field"), (F.col("n_schedules").cast("string") if repeated else F.col("status")).alias("value"), F.when(ok, "verified").when(unknown, "unknown").otherwise("proposed").alias("state"),
            F.coalesce(s["sourceUrl"], "url").alias("source_ref"), seen.alias("observed_at"), F.coalesce(s["approvedAt"], now).alias("extracted_at"), F.when(s.isNotNull(), "field-review").otherwise(product).alias("extractor"), s["excerpt"].alias("excerpt"),
            F.lit(None).cast("double").alias("confidence"), review.alias("review"), F.lit(kind).alias("claim_type"), seen.alias("created"), F.coalesce("verified_at", s["approvedAt"], now).alias("updated"), F.when(s.isNotNull(), "admin").otherwise("crawl").alias("actor"),
            F.when(s.isNotNull(), "field-review").otherwise(product).alias("collected_by"), F.when(s.isNotNull(), "field-source-approval").otherwise("candidate-resolution").alias("method"),
            F.to_json(F.struct("slug", "name", "data_confidence", s.alias("field_source"))).alias("metadata"),
        ))
        d = F.try_element_at("changes", F.lit(field))
        fine = d["n_items"].isNotNull() if repeated else d["new"].isin(*REGISTRATION)
        state = F.when(F.col("status") == "APPROVED", "verified").when(F.col("status") == "REJECTED", "rejected").otherwise("proposed")
        claim = F.concat_ws(".", F.lit(product), F.col("camp_id").cast("string"), F.lit(field), F.col("id").cast("string"))
        seen = F.col("reviewed_at").isNotNull() & F.col("reviewed_by").isNotNull()
        review = F.when(seen, F.struct(F.concat(claim, F.lit(".review."), F.lower("status")).alias("id"), F.col("reviewed_by").alias("actor"), F.col("reviewed_at").alias("at"), state.alias("state"))).otherwise(F.lit(None).cast(_REVIEW))
        parts.append(proposals.where(d.isNotNull() & fine).select(
            claim.alias("claim_id"), "camp_id", F.lit(field).alias("field"), (d["n_items"].cast("string") if repeated else d["new"]).alias("value"), state.alias("state"),
            F.coalesce(d["sourceUrl"], "url").alias("source_ref"), F.col("created").alias("observed_at"), F.col("created").alias("extracted_at"), F.col("model").alias("extractor"), d["excerpt"].alias("excerpt"),
            d["confidence"].alias("confidence"), review.alias("review"), F.lit(f"{kind}-candidate").alias("claim_type"), "created", F.coalesce("reviewed_at", now).alias("updated"), F.coalesce("reviewed_by", F.lit("crawl")).alias("actor"),
            F.col("model").alias("collected_by"), F.when(F.col("status") == "PENDING", "crawl-proposal").otherwise("field-review").alias("method"),
            F.to_json(F.struct(F.col("id").alias("proposal_id"), F.col("status").alias("proposal_status"), d["old"].alias("old_value"), d["mode"].alias("mode"), "overall_confidence", F.col("model").alias("extraction_model"))).alias("metadata"),
        ))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    scope = F.struct(F.lit(PRODUCT_AREA).alias("product_area"), F.lit(SUBJECT).alias("subject_type"), F.col("camp_id").cast("string").alias("subject_id"), "field")
    authority = F.when(F.col("field") == "registrationStatus", F.struct(F.lit(AUTHORITY).alias("class"), scope.alias("scope"), F.col("extractor").alias("declared_by")))
    support = F.when(F.col("review").isNotNull() | F.col("confidence").isNotNull(), "moderate").otherwise("none")
    return every.withColumns({"support": support, "locator": F.concat(F.lit(LOCATOR), "field"), "impact_level": F.lit(IMPACT), "authority": authority})


def export(subjects: DataFrame, claims: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """subjects: subject_id; claims: claim_id, subject_id, field, state; evidence: evidence_id, claim_id, method,
    source_ref; events: event_id, claim_id, state, at, actor. subject_id, bundle: all that is known as JSON, in order."""
    full = nest(claims, "claim_id", {
        "evidence": (evidence, "claim_id", ["evidence_id", "method", "source_ref"], ["evidence_id"]),
        "events": (events, "claim_id", ["event_id", "state", "at", "actor"], ["at", "event_id"]),
    })
    packed = nest(subjects, "subject_id", {"claims": (full, "subject_id", ["claim_id", "field", "state", "evidence", "events"], ["field", "claim_id"])})
    return packed.select("subject_id", F.to_json(F.struct("subject_id", "claims")).alias("bundle"))


def revocations(orphaned: DataFrame, claims: DataFrame, actor: str, at: str) -> DataFrame:
    """A revoked event for every claim of the subjects that are gone. orphaned: subject_type, subject_id."""
    gone = claims.join(orphaned.select("subject_type", "subject_id").distinct(), ["subject_type", "subject_id"], "left_semi")
    return gone.select("claim_id", F.lit("revoked").alias("state"), F.lit(actor).alias("actor"), F.lit(at).cast("timestamp").alias("at"))
