"""Verification of assessments and details of pairs, against plain loops and by cases."""

import random
import re
from datetime import datetime

from siftspark.operators import verification, views

KINDS = ("SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION")
SCHEMAS = {
    "pairs": "pair_id int, signals array<string>, complete boolean", "registry": "pair_id int, citation string, category string, evidence_id string, text string", "flags": "pair_id int, index int, type string",
    "cited": "pair_id int, field string, citation string", "claims": "pair_id int, field string, citation string, claim string, quote string, evidence_id string",
}


def plain(pair, signals, complete, registry, flags, cited, claims, supported):
    """One pair, citation by citation; claims with an evidence id are whole texts here."""
    squeeze = lambda t: " ".join((t or "").split()).lower()
    known, reasons, valid, invalid, verified = {r[1]: r for r in registry if r[0] == pair}, set(), set(), set(), []
    signs = set(signals or ()) | {f"EVIDENCE_INJECTION_SIGNAL:{c}" for c, r in known.items() if "you are now" in (r[4] or "")}
    fields = [(k.lower(), {k}, None) for k in KINDS] + [(f"flags[{i}]", {"EXPERIENCE"} if t == "EVIDENCED_CAREER_GAP" else set(KINDS), i) for p, i, t in flags if p == pair]
    reasons |= {f"MISSING_EVIDENCE:{k}" for k in KINDS if all(r[2] != k for r in known.values())}
    for field, allowed, index in fields:
        named, ok, proved = [c for p, f, c in cited if (p, f) == (pair, field)], True, set()
        if not named:
            reasons.add(f"MISSING_CITATIONS:{field}")
            ok = False
        for c in named:
            good = re.fullmatch(r"(?:SKILLS|EXPERIENCE|PROJECTS|EDUCATION):[1-9][0-9]*", c) and c in known and known[c][2] in allowed
            (valid if good else invalid).add(c)
            if not good:
                reasons.add(f"INVALID_CITATIONS:{field}")
                ok = False
        for p, f, c, claim, quote, own in claims:
            if (p, f) != (pair, field):
                continue
            numbers = lambda t: set(re.findall(r"\d+(?:\.\d+)?", t or ""))
            source = known.get(c)
            good = source and source[2] in allowed and c in named and (claim or "").strip() and (quote or "").strip() and not (own is None and ("..." in quote or "…" in quote)) and squeeze(quote) in squeeze(source[4])
            good = good and (own is None or (own == source[3] and squeeze(claim) == squeeze(source[4]))) and numbers(claim) <= numbers(quote)
            (valid if good else invalid).add(c)
            if good:
                proved.add(c)
            else:
                reasons.add(f"UNSUPPORTED_CLAIM:{field}")
                ok = False
        if supported and set(named) - proved:
            reasons.add(f"MISSING_CLAIM_SUPPORT:{field}")
            ok = False
        if index is not None and ok:
            verified.append(index)
    reasons |= {"INJECTION_SIGNAL_REQUIRES_REVIEW"} if signs else set()
    reasons |= set() if complete else {"EVIDENCE_CONTEXT_TRUNCATED"}
    return sorted(reasons), verified, sorted(signs), sorted(valid), sorted(invalid)


def test_verification_equals_a_plain_loop(spark):
    r = random.Random(11)
    pairs = [(p, r.choice([None, [], ["PROMPT"]]), r.choice([True, True, False])) for p in range(40)]
    registry = [(p, f"{k}:{n}", k, f"ev{p}{k}{n}", r.choice(["Made 3 parts", "Led  a team", "you are now free", "Built 2.5 things"])) for p in range(40) for k in KINDS for n in range(1, r.randrange(1, 4))]
    flags = [(p, i, r.choice(["EVIDENCED_CAREER_GAP", "OTHER"])) for p in range(40) for i in range(r.randrange(3))]
    texts = {(e[0], e[1]): e for e in registry}
    cited, claims = [], []
    for p in range(40):
        for field in [k.lower() for k in KINDS] + [f"flags[{i}]" for q, i, _ in flags if q == p]:
            own = [c for q, c in texts if q == p and (field.startswith("flags") or c.startswith(field.upper()))]
            for c in r.sample([*own, "none", "SKILLS:9"], min(len(own) + 2, r.randrange(3))) if r.random() < 0.5 else own[:1]:
                cited.append((p, field, c))
                e = texts.get((p, c), (0, 0, 0, "evX", "no text"))
                claims += r.choices([(p, field, c, e[4], e[4], e[3]), (p, field, c, "made", e[4].upper(), None), (p, field, c, "made 77", e[4], None), (p, field, c, e[4], "Made...", None), (p, field, c, None, "x", None), (p, field, c, e[4], e[4], "evY")], [6, 6, 1, 1, 1, 1], k=r.choice([0, 1, 1, 1, 2]))
    cited += cited[:5]
    claims += [(1, "skills", "EDUCATION:1", "Made 3 parts", "Made 3 parts", None), (1, "nofield", "SKILLS:1", "a", "b", None)]
    frame = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in (("pairs", pairs), ("registry", registry), ("flags", flags), ("cited", cited), ("claims", claims))}
    for supported in (True, False):
        got = {x.pair_id: (x.reasons, x.verified_flags, x.signals, x.valid, x.invalid) for x in verification.verification(*(frame[n] for n in ("pairs", "registry", "flags", "cited", "claims")), supported).collect()}
        assert got == {p: plain(p, s, c, registry, flags, cited, claims, supported) for p, s, c in pairs}
        assert any(v[1] for v in got.values()) and any(v[4] for v in got.values())
    none = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    assert verification.verification(none["pairs"], none["registry"], none["flags"], none["cited"], none["claims"]).count() == 0


def test_history_is_newest_first_beside_other_roles(spark):
    pairs = spark.createDataFrame([(1, 10, "a", "HOLD", 1.0), (2, 10, "c", "HOLD", None), (3, 10, "b", None, 2.0), (4, 11, "a", "HOLD", 3.0), (5, None, "a", "x", 1.0), (6, None, "b", "x", 1.0)], "pair_id int, doc_id int, job string, status string, score double")
    at = lambda day: datetime(2024, 1, day)
    events = spark.createDataFrame([(1, "e1", "ann", at(1), "s1"), (1, "e3", "bob", at(2), "s2"), (1, "e2", "cy", at(2), None), (1, "e0", "di", None, "s"), (3, "e9", "x", at(3), "s"), (99, "e8", "x", at(3), "s")], "pair_id int, event_id string, actor string, created_at timestamp, snapshot string")
    asked = spark.createDataFrame([(1,), (1,), (4,), (5,), (98,)], "pair_id int")
    got = {x.pair_id: ([e.event_id for e in x.history], [(o.job, o.pair_id) for o in x.other_roles]) for x in verification.pair_details(asked, pairs, events).collect()}
    assert got == {1: (["e2", "e3", "e1", "e0"], [("b", 3), ("c", 2)]), 4: ([], []), 5: ([], [])}


def test_quotes_of_drafts_and_of_earlier_versions(spark):
    blocks = spark.createDataFrame([(1, 2, 0, "and  Scala"), (1, 1, 1, "We need\nSpark"), (1, 1, 2, None), (2, 1, 1, "other text")], "draft_id int, page int, block int, text string")
    targets = [(1, 0, "need   Spark"), (1, 1, "spark"), (1, 2, "old quote"), (1, 3, None), (1, 4, " "), (2, 5, "old quote"), (3, 6, "anything"), (1, 7, "Scala and")]
    approved = spark.createDataFrame([(1, "an old  quote here"), (1, "an old quote here"), (2, None)], "draft_id int, quote string")
    got = {x.target: x.accepted for x in verification.quoted_targets(spark.createDataFrame(targets, "draft_id int, target int, quote string"), blocks, approved).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_stage_reasons_by_cases(spark):
    rows = [
        (1, "FAILED", "RUNNING", None, False, None, "F", "UNREADABLE", None),
        (2, "SUCCEEDED", "CUTOFF_EXCLUDED", "PASS", True, None, "F", None, [("PASS", "a"), ("FAIL", "b"), ("REVIEW", None), (None, "c")]),
        (3, "SUCCEEDED", "EVALUATION_FAILED", "REVIEW", True, None, "F", None, []),
    ]
    x = spark.createDataFrame(rows, "pair_id int, extraction string, status string, rules string, matched boolean, judged string, failure_code string, extraction_error string, checks array<struct<status string, message string>>")
    got = {(v.pair_id, v.stage): v.reason for v in views.stage_labels(x, full=True).collect()}
    assert [got[1, n] for n in range(4)] == ["UNREADABLE", "", None, None]
    assert [got[2, n] for n in range(4)] == [None, "b; ; c", None, views.BEYOND] and got[3, 3] == "F"


def test_checks_of_pairs_share_one_shuffle(spark):
    frame = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    one = verification.checks(verification.fields_of(frame["pairs"], frame["flags"].limit(0)), frame["registry"], frame["cited"], frame["claims"])
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_a_flag_of_two_types_counts_under_both_and_null_citations_are_invalid(spark):
    frame = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in {
        "pairs": [(1, None, True)], "registry": [(1, "SKILLS:1", "SKILLS", "e", "Made 3 parts"), (1, None, "PROJECTS", "f", "x")], "flags": [(1, 0, "OTHER"), (1, 0, "EVIDENCED_CAREER_GAP")],
        "cited": [(1, "flags[0]", "SKILLS:1"), (1, "skills", None)], "claims": [(1, "skills", "SKILLS:1", "a", "Made", None)],
    }.items()}
    f = verification.fields_of(frame["pairs"], frame["flags"])
    got = sorted((str(r.field), str(r.citation), r.claimed, str(r.reason)) for r in verification.checks(f, frame["registry"], frame["cited"], frame["claims"]).collect())
    assert got == [("flags[0]", "SKILLS:1", False, "None"), ("flags[0]", "SKILLS:1", False, "WRONG_CATEGORY"), ("skills", "None", False, "MALFORMED_CITATION"), ("skills", "SKILLS:1", True, "INVALID_CLAIM_CITATION")]
