"""Contracts of inputs as tables of broken rules, and the full filter of a pool."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the contract.
TERM, TERMS, GROUP, TARGETS, QUERY, YEARS, KEY, TITLE = 120, 100, 20, 48, 4000, 100, 64, 255
CATEGORIES = ("SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION")


def broken_rules(profiles: DataFrame) -> DataFrame:
    """Profiles (job, title, years, level_rank, terms, alias_ranks, queries: map, targets: array of id, kind, treatment, groups; minimum) to (job, rule) for each rule that one breaks.

    Rules over several rows (a job id that stands twice) are part of it.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    targets, values = F.col("targets"), F.map_values("queries")
    ids = F.transform(targets, lambda t: t["id"])
    groups = F.flatten(F.transform(targets, lambda t: t["groups"]))
    rules = {
        "YEARS_NOT_A_NUMBER": F.isnan("years") | (F.col("years") < 0) | (F.abs("years") == float("inf")), "YEARS_OUT_OF_RANGE": F.col("years") > YEARS,
        "BLANK_JOB": blank(F.col("job")) | (F.length("job") > KEY), "BLANK_TITLE": blank(F.col("title")) | (F.length("title") > TITLE),
        "BLANK_TERM": F.exists("terms", blank), "TERM_TOO_LONG": (F.size("terms") > TERMS) | F.exists("terms", lambda t: F.length(t) > TERM),
        "TERMS_WITHOUT_DEGREE": (F.col("level_rank") == 0) & ((F.size("terms") > 0) | (F.size("alias_ranks") > 0)), "ALIAS_OF_OTHER_LEVEL": F.exists("alias_ranks", lambda r: r != F.col("level_rank")),
        "WRONG_CATEGORIES": F.array_sort(F.map_keys("queries")) != F.array(*map(F.lit, sorted(CATEGORIES))), "BLANK_QUERY": F.exists(values, lambda q: blank(q) | (F.length(q) > QUERY)),
        "TOO_MANY_TARGETS": F.size(targets) > TARGETS, "TARGET_ID_TWICE": F.size(F.array_distinct(ids)) < F.size(ids),
        "BAD_EVIDENCE_TERMS": F.exists(groups, lambda g: (F.size(g) == 0) | (F.size(g) > GROUP) | F.exists(g, lambda t: blank(t) | (F.length(t) > TERM))),
        "DOMAIN_NOT_PREFERENCE": F.exists(targets, lambda t: (t["kind"] == "domain") & (t["treatment"] != "preference")), "MINIMUM_OUT_OF_RANGE": ~F.col("minimum").between(0, 1) | F.isnan("minimum"),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    twice = profiles.groupBy("job").agg(F.count("*").alias("n")).where("n > 1").select("job", F.lit("JOB_TWICE").alias("rule"))
    return profiles.select("job", F.explode(broken).alias("rule")).union(twice)


def _contains(column: str):
    return lambda part: F.contains(F.lower(column), F.lit(str(part).strip().lower()))


def _range(column):
    """{"from": low, "to": high}, either of them; a value that is unknown lies in no range."""

    def test(ends: dict) -> Column:
        low, high = ends.get("from"), ends.get("to")
        if low is not None and high is not None and low > high:
            raise ValueError(f"an empty range: {ends}")
        value = column(ends) if callable(column) else F.col(column)
        return value.between(F.lit(low) if low is not None else value, F.lit(high) if high is not None else value)

    return test


def _inside(column: str):
    """A struct of an array that has all the given values at once."""
    return lambda wanted: F.exists(column, lambda item: reduce(and_, [item[k] == v for k, v in wanted.items()], F.lit(True)))


def _states(asked: dict) -> Column:
    """{"ids": [...], "state": "DIRECT", "of": "all" or "any"}: a requirement without a state is UNASSESSED."""
    state = lambda i: F.coalesce(F.try_element_at("requirements", F.lit(i)), F.lit("UNASSESSED"))
    hits = [state(i) == asked.get("state", "DIRECT") for i in asked["ids"]]
    return reduce(and_ if asked.get("of", "all") == "all" else or_, hits)


#: Predicates by name: each makes a condition on a pair of what is asked. A pool's filter is any set of them.
PREDICATES = {
    **{c: (lambda v, c=c: F.col(c) == v) for c in ("status", "decision", "assignee", "reviewer")},
    "text": _contains("text"), "reasons": _contains("reasons"), "tag": lambda t: F.exists("tags", lambda x: F.lower(x) == t.lower()),
    "score": _range("score"), "years": _range("years"), "reviewed": _range(lambda _: F.date_format("reviewed", "yyyy-MM-dd")),
    "category": _range(lambda ends: F.try_element_at("category_scores", F.lit(ends["name"]))),
    "unknown": lambda columns: reduce(and_, [F.col(c).isNull() for c in columns]),
    "check": _inside("checks"), "requirements": _states, "to_review": lambda yes: (F.col("needs_review") | (F.col("status") == "REVIEW_REQUIRED")) == F.lit(yes),
}


def matching_all(asked: dict) -> Column:
    """The pairs that all predicates of a filter hold for; one that can't be judged (a null) doesn't hold, and an empty filter lets all pass. Names that are no predicates are refused."""
    if unknown := asked.keys() - PREDICATES.keys():
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    return F.coalesce(reduce(and_, [PREDICATES[name](v) for name, v in asked.items()], F.lit(True)), F.lit(False))
