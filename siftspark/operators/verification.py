"""The whole verification of assessments against their evidence, and what a reviewer sees beside it: history, other roles, reasons of stages, quotes of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import injection_reasons
from .evidence import CITATION
from .manifests import LETTERS
from .outcomes import support_reason

#: The flag that only experience can prove, the reasons of a pair as a whole.
CAREER_GAP, TRUNCATED, INJECTED = "EVIDENCED_CAREER_GAP", "EVIDENCE_CONTEXT_TRUNCATED", "INJECTION_SIGNAL_REQUIRES_REVIEW"


def fields_of(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """(pair_id, field, index, allowed): a field for each category of each pair, which only that category proves, and one for each flag (pair_id, index, type), which any does but a career gap."""
    each = F.array(*[F.struct(F.lit(c.lower()).alias("field"), F.lit(None).cast("int").alias("index"), F.array(F.lit(c)).alias("allowed")) for c in LETTERS])
    some = F.when(F.col("type") == CAREER_GAP, F.array(F.lit("EXPERIENCE"))).otherwise(F.array(*map(F.lit, LETTERS)))
    own = flags.select("pair_id", F.format_string("flags[%d]", F.col("index").cast("int")).alias("field"), F.col("index").cast("int").alias("index"), some.alias("allowed")).distinct()
    return pairs.select("pair_id", F.explode(each).alias("f")).select("pair_id", "f.*").union(own)


def _placed(fields: DataFrame, registry: DataFrame, cited: DataFrame, claims: DataFrame) -> DataFrame:
    """Fields, citations, claims and the registry as rows of one table, dealt by pair once, sorted: each citation and claim (claimed: false or true) with what it needs of the others; rows of fields have claimed null.

    All later groupings hold the pair, so none of them shuffles again.
    """
    text = {c: F.lit(None).cast("string") for c in ("field", "citation", "claim", "quote", "evidence_id", "category", "source")}
    other = {"index": F.lit(None).cast("int"), "allowed": F.lit(None).cast("array<string>"), "claimed": F.lit(None).cast("boolean")}
    as_facts = lambda x, **own: x.select("pair_id", *[own.get(c, v).alias(c) for c, v in {**text, **other}.items()])
    of = lambda *names: {c: F.col(c) for c in names}
    x = as_facts(fields, **of("field", "index", "allowed")).union(as_facts(cited, **of("field", "citation"), claimed=F.lit(False)))
    x = x.union(as_facts(claims, **of("field", "citation", "claim", "quote", "evidence_id"), claimed=F.lit(True)))
    x = x.union(as_facts(registry.where("citation is not null"), **of("citation", "category", "evidence_id"), source=F.col("text")))
    x = x.where("pair_id is not null").repartition("pair_id")
    check, registered = F.col("claimed").isNotNull(), F.col("field").isNull() & F.col("claimed").isNull()
    sets = F.collect_set("allowed").over(Window.partitionBy("pair_id", "field"))
    x = x.withColumn("sets", sets).withColumn("allowed", F.explode_outer(F.when(check & F.col("field").isNotNull(), F.col("sets")))).drop("sets").where(~check | F.col("allowed").isNotNull())
    given = F.max(F.col("claimed").eqNullSafe(False) & F.col("citation").isNotNull()).over(Window.partitionBy("pair_id", "citation", "field"))
    known = F.first(F.when(registered, F.struct("category", F.col("evidence_id").alias("id"), "source")), ignorenulls=True).over(Window.partitionBy("pair_id", "citation"))
    return x.withColumn("given", given).withColumn("known", known).where(~registered).withColumn("known", F.when(check, F.col("known")))


def _reason() -> Column:
    """Why a row of _placed() does not stand; null where it does."""
    known = F.col("known")
    right = F.coalesce(F.array_contains("allowed", known["category"]), F.lit(False))
    form = F.coalesce(F.col("citation").rlike(CITATION), F.lit(False))
    plain = F.when(~form, "MALFORMED_CITATION").when(known["category"].isNull(), "UNKNOWN_CITATION").when(~right, "WRONG_CATEGORY")
    full = support_reason(F.col("claim"), F.col("quote"), known["source"], right & F.col("given"), F.col("evidence_id"), known["id"])
    return F.when(F.col("claimed"), full).when(~F.col("claimed"), plain)


def checks(fields: DataFrame, registry: DataFrame, cited: DataFrame, claims: DataFrame) -> DataFrame:
    """(pair_id, field, citation, claimed, reason) for each citation (pair_id, field, citation) and claim (those, claim, quote, evidence_id); no reason: it stands.

    registry: pair_id, citation, category, evidence_id, text, one row for each citation. A claim's citation must be one of its field's.
    """
    return _placed(fields, registry, cited, claims).where("claimed is not null").select("pair_id", "field", "citation", "claimed", _reason().alias("reason"))


def verification(pairs: DataFrame, registry: DataFrame, flags: DataFrame, cited: DataFrame, claims: DataFrame, supported: bool = True) -> DataFrame:
    """Each pair (pair_id, signals: array of strings, complete) with its sorted reasons, verified_flags, signals, valid and invalid citations, as arrays.

    supported: whether each citation needs a claim that stands on it. Signs of injection in the registry's texts come to those given.
    """
    checked = _placed(fields_of(pairs, flags), registry, cited, claims).select("pair_id", "field", "index", "citation", "claimed", _reason().alias("reason"))
    bad, claim = F.col("reason").isNotNull(), F.col("claimed")
    one = checked.groupBy("pair_id", "citation", "field").agg(  # the rows of a field alone have no citation and claimed null
        F.max("index").alias("index"), F.bool_or(~claim).alias("cite"), F.bool_or(~claim & bad).alias("bad_cite"), F.bool_or(claim & bad).alias("bad_claim"), F.bool_or(claim & ~bad).alias("proved"),
        F.bool_or(claim.isNotNull() & ~bad).alias("valid"), F.bool_or(claim.isNotNull() & bad).alias("invalid"),
    )
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = one.groupBy("pair_id", "field").agg(
        F.max("index").alias("index"), any_of("cite").alias("cites"), any_of("bad_cite").alias("bad_cites"), any_of("bad_claim").alias("bad_claims"), any_of(F.col("cite") & ~F.coalesce("proved", F.lit(False))).alias("unproved"),
        F.collect_list(F.when(F.col("valid"), F.col("citation"))).alias("valid"), F.collect_list(F.when(F.col("invalid"), F.col("citation"))).alias("invalid"),
    )
    lacking = F.col("unproved") & supported
    named = lambda c, name: F.when(c, F.concat(F.lit(f"{name}:"), "field"))
    why = F.array_compact(F.array(named(~F.col("cites"), "MISSING_CITATIONS"), named(F.col("bad_cites"), "INVALID_CITATIONS"), named(F.col("bad_claims"), "UNSUPPORTED_CLAIM"), named(lacking, "MISSING_CLAIM_SUPPORT")))
    good = F.col("index").isNotNull() & F.col("cites") & ~F.col("bad_cites") & ~F.col("bad_claims") & ~lacking
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    x = per.groupBy("pair_id").agg(flat(why).alias("_why"), F.array_sort(F.collect_list(F.when(good, F.col("index")))).alias("verified_flags"), flat("valid").alias("valid"), flat("invalid").alias("invalid"))
    marked = injection_reasons(registry.select("pair_id", "category", "citation", F.coalesce("text", F.lit("")).alias("text")))
    sign = F.when(F.col("reasons") != "", F.concat(F.lit("EVIDENCE_INJECTION_SIGNAL:"), "citation"))
    found = marked.groupBy("pair_id").agg(F.collect_set("category").alias("_have"), F.collect_set(sign).alias("_signs"))
    none = F.array().cast("array<string>")
    x = pairs.select("pair_id", "signals", "complete").join(x, "pair_id").join(found, "pair_id", "left")
    x = x.withColumn("signals", F.array_sort(F.array_distinct(F.concat(F.coalesce("signals", none), F.coalesce("_signs", none)))))
    absent = F.transform(F.array_except(F.array(*map(F.lit, LETTERS)), F.coalesce("_have", none)), lambda c: F.concat(F.lit("MISSING_EVIDENCE:"), c))
    whole = F.array_compact(F.array(F.when(~F.coalesce("complete", F.lit(False)), TRUNCATED), F.when(F.size("signals") > 0, INJECTED)))
    return x.select("pair_id", F.array_sort(F.concat("_why", absent, whole)).alias("reasons"), "verified_flags", "signals", "valid", "invalid")


def pair_details(asked: DataFrame, pairs: DataFrame, events: DataFrame) -> DataFrame:
    """The asked pairs (pair_id) with history and other_roles.

    pairs: pair_id, doc_id, job, status, score; events: pair_id, event_id, actor, created_at, snapshot. history: the pair's events, newest
    first, then by event_id; other_roles: the other pairs of its document by job and id. Both come as facts of two kinds in one grouping;
    a row grows with its own pair's events and roles only. Pairs that are not known have no row.
    """
    mine = pairs.join(asked.select("pair_id").distinct(), "pair_id", "left_semi").select("pair_id", "doc_id")
    role = F.struct("job", F.col("pair_id").alias("pair_id"), "status", "score")
    event = F.struct(F.col("created_at"), F.col("event_id"), F.col("actor"), F.col("snapshot"))
    others = pairs.select("doc_id", role.alias("role"))
    some = mine.join(others, "doc_id").where(F.col("role.pair_id") != F.col("pair_id")).select("pair_id", "role")
    some = some.unionByName(events.join(mine.select("pair_id"), "pair_id", "left_semi").select("pair_id", event.alias("event")), allowMissingColumns=True)
    some = some.unionByName(mine.select("pair_id"), allowMissingColumns=True)  # a pair without facts has its row

    def newer(a: Column, b: Column) -> Column:
        late = F.when(a["created_at"].eqNullSafe(b["created_at"]), 0).when(b["created_at"].isNull() | (a["created_at"] > b["created_at"]), -1).otherwise(1)
        return F.when(late != 0, late).when(a["event_id"] < b["event_id"], -1).when(a["event_id"] > b["event_id"], 1).otherwise(0)

    return some.groupBy("pair_id").agg(F.array_sort(F.collect_list("event"), newer).alias("history"), F.array_sort(F.collect_list("role")).alias("other_roles"))


def quoted_targets(targets: DataFrame, blocks: DataFrame, approved: DataFrame) -> DataFrame:
    """Targets (draft_id, target, quote) with accepted: the quote stands in the draft's text, the blocks (draft_id, page, block, text) in order, or in a quote (draft_id, quote) approved before.

    Runs of white space count as one blank; case counts. An empty quote stands anywhere, a null one nowhere.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = blocks.select("draft_id", F.struct("page", "block", plain(F.coalesce("text", F.lit(""))).alias("text")).alias("b"))
    source = rows.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), " ").alias("_source"))
    x = targets.withColumn("_quote", plain(F.col("quote")))
    within = F.coalesce(F.contains("_source", "_quote"), F.lit(False))
    x = x.join(source, "draft_id", "left").withColumn("_in", within).drop("_source")
    old = approved.select(F.col("draft_id").alias("_draft"), plain(F.col("quote")).alias("_old"))
    out = x.where(~F.col("_in")).join(old, (F.col("draft_id") == F.col("_draft")) & F.contains("_old", "_quote"), "left_semi")
    keys = out.select("draft_id", "target").distinct().withColumn("_was", F.lit(True))
    return x.join(keys, ["draft_id", "target"], "left").select("draft_id", "target", (F.col("_in") | F.coalesce("_was", F.lit(False))).alias("accepted"))
