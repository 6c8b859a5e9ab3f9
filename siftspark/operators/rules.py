"""Three-valued checks of documents' facts against profiles. What is unknown never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of degrees and other spellings.
DEGREES = {
    "NONE": 0, "SEE": 1, "SLC": 1, "SECONDARY": 1, "10TH": 1, "HIGH SCHOOL": 1,
    "+2": 2, "INTERMEDIATE": 2, "HIGHER SECONDARY": 2, "A-LEVELS": 2, "A LEVEL": 2, "12TH": 2, "DIPLOMA": 3,
    "BACHELOR": 4, "B.E": 4, "B.SC": 4, "BCA": 4, "BIT": 4, "BBA": 4, "BIM": 4, "B.TECH": 4, "B.S": 4, "BSC": 4, "BE": 4, "BTECH": 4, "BS": 4,
    "MASTER": 5, "M.E": 5, "M.SC": 5, "MCA": 5, "M.TECH": 5, "MBA": 5, "M.S": 5, "MSC": 5, "ME": 5, "MTECH": 5, "MS": 5,
    "PHD": 6, "DOCTORATE": 6,
}
SPELLINGS = {"BACHELOR'S": "BACHELOR", "BACHELORS": "BACHELOR", "MASTER'S": "MASTER", "MASTERS": "MASTER", "PH.D": "PHD"}
VERIFIED = "recruiter_verified"


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), key)


def degree(value: Column) -> Column:
    """The degree's usual name; null where it is not known."""
    v = F.rtrim(F.upper(F.trim(value)), F.lit("."))
    v = F.coalesce(_lookup(SPELLINGS, v), v)
    return F.when(_lookup(DEGREES, v).isNotNull(), v)


def degree_rank(value: Column) -> Column:
    return _lookup(DEGREES, degree(value))


def effective(override: Column, supplied: Column, extracted: Column) -> Column:
    """A fact by the order of its origins, as struct<value, source>: an override, then what was supplied, then what the text says."""
    return (
        F.when(override.isNotNull(), F.struct(override.alias("value"), F.lit(VERIFIED).alias("source")))
        .when(supplied.isNotNull(), F.struct(supplied.alias("value"), F.lit("supplied").alias("source")))
        .when(extracted.isNotNull(), F.struct(extracted.alias("value"), F.lit("cv_extracted").alias("source")))
        .otherwise(F.struct(F.lit(None).cast("double").alias("value"), F.lit("unknown").alias("source")))
    )


def authorization_check(required: Column, state: Column, source: Column) -> Column:
    """Code of the check; state is eligible, ineligible or anything else for unknown."""
    return (
        F.when(~required, "AUTHORIZATION_NOT_REQUIRED").when(~F.coalesce(state, F.lit("unknown")).isin("eligible", "ineligible"), "AUTHORIZATION_UNKNOWN")
        .when(~source.eqNullSafe(F.lit(VERIFIED)), "AUTHORIZATION_UNVERIFIED").when(state == "ineligible", "AUTHORIZATION_INELIGIBLE").otherwise("AUTHORIZATION_ELIGIBLE")
    )


def experience_check(least: Column, years: Column, source: Column, upper: Column) -> Column:
    """Code of the check; upper is the bound of years that month-only dates leave open, null where there is none."""
    return (
        F.when(least == 0, "EXPERIENCE_NOT_REQUIRED").when(years.isNull(), "EXPERIENCE_UNKNOWN").when((years < least) & F.coalesce(upper >= least, F.lit(False)), "EXPERIENCE_DATE_PRECISION")
        .when(years < least, "INSUFFICIENT_EXPERIENCE").when(~source.eqNullSafe(F.lit(VERIFIED)), "EXPERIENCE_UNVERIFIED").otherwise("EXPERIENCE_MET")
    )


#: What each code stands for.
FAILS = ("AUTHORIZATION_INELIGIBLE", "INSUFFICIENT_EXPERIENCE", "EDUCATION_LEVEL_MISMATCH", "EDUCATION_FIELD_MISMATCH", "REQUIRED_SKILL_NEGATED")
PASSES = (
    "AUTHORIZATION_NOT_REQUIRED", "AUTHORIZATION_ELIGIBLE", "EXPERIENCE_NOT_REQUIRED", "EXPERIENCE_MET", "EDUCATION_NOT_REQUIRED", "EDUCATION_MET", "REQUIRED_SKILL_FOUND",
)


def overall(codes: Column) -> Column:
    """FAIL if any check of the array fails, else REVIEW if any does not pass, else PASS."""
    fails, passes = F.exists(codes, lambda c: c.isin(*FAILS)), F.forall(codes, lambda c: c.isin(*PASSES))
    return F.when(fails, "FAIL").when(passes, "PASS").otherwise("REVIEW")
