"""Queries on masking, spans, names and gates, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions.text import MAIL, entropy
from siftspark.operators import masking, measures

from .catalogue import plan
from .relations import PROFILES, profiles, table

#: The phone pattern without looking around: what stands before and after is caught and put back, twice, as neighbours share it.
_AROUND = rf"(?i)(^|\D){masking.NUMBER}(?:{masking.EXTENSION}|($|\D))"


def phones_sql(x: str) -> str:
    once = lambda v: rf"regexp_replace({v}, '{_AROUND}', '\1{masking.PHONE_MASK}\2', 'g')"
    return once(once(x))


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def all_phones_sql(x: str) -> str:
    """The phone pattern with its look-around, in words without: each run of digits stands between two marks, noncharacters, so that no match needs what is outside its own marks."""
    a, z, blank = "\ufdd0", "\ufdd1", r"[ \t\n\x0B\f\r]"
    sep = rf"(?:[-.]|{blank})"
    gap = f"(?:{z}{sep}{a})?"
    own = rf"9[78]\d{{8}}|0\d{{1,2}}{gap}\d{{6,7}}"
    rest = rf"\d{{2,4}}(?:{z}(?:\){sep}?|{sep}){a})?\d{{3,4}}{gap}\d{{3,4}}"
    country = rf"\d{{1,3}}(?:{z}(?:{sep}\(?|\(){a})?"
    before = f"(^|[^{z}])"
    number = rf"(?:{before}\+{a}(?:977{gap}(?:{own})|{country}{rest})|{before}\({a}{rest}|{a}(?:(?:977{gap})?(?:{own})|(?:{country})?{rest}))"
    more = rf"(?:{blank}*(?:{_either('x')}|{_either('ext')}\.?|{_either('extension')}){blank}*{a}\d+{z})?"
    marked = rf"regexp_replace({x}, '(\d+)', '{a}\1{z}', 'g')"
    return rf"replace(replace(regexp_replace({marked}, '{number}{z}{more}', '\1\2{masking.PHONE_MASK}', 'g'), '{a}', ''), '{z}', '')"


def places_sql(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)\b(?:{masking.PLACES})\b', '{masking.PLACE_MASK}', 'g')"


def years_sql(x: str) -> str:
    words = rf"\b(?:{masking.DEGREE_WORDS})".replace("'", "''")
    return rf"regexp_replace({x}, '(?i)({words}\b[^\n;]{{0,60}}?\b)(?:{masking.YEAR})\b|\b(?:{masking.YEAR})(\b[^\n;]{{0,40}}?{words})', '\1{masking.YEAR_MASK}\2', 'g')"


def mail_sql(x: str) -> str:
    return f"regexp_replace({x}, '{MAIL}', '[REDACTED_EMAIL]', 'g')"


CALLED = "concat(coalesce(text, ''), chr(10), 'Tel ', CASE doc_id % 6 WHEN 0 THEN '+977-9812345678' WHEN 1 THEN '01-4412345 ext. 12' WHEN 2 THEN '(212) 555-0199' WHEN 3 THEN '123456789012345678' WHEN 4 THEN '9801234567, 9701234567' ELSE '44 20 7946 0958x3' END, '.')"


@plan(f"SELECT doc_id, md5({all_phones_sql('t')}) AS digest, (length({all_phones_sql('t')}) - length(replace({all_phones_sql('t')}, '{masking.PHONE_MASK}', ''))) // {len(masking.PHONE_MASK)} AS masked FROM (SELECT doc_id, {CALLED} AS t FROM documents)")
def mask_phones(spark, d):
    x = table(spark, d, "documents").select("doc_id", masking.mask_phones(F.expr(CALLED)).alias("t"))
    return x.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.regexp_count("t", F.lit(r"\[REDACTED_PHONE\]")).alias("masked"))


@plan(f"WITH {PROFILES} SELECT doc_id, {places_sql('text')} AS text FROM profiles")
def mask_places(spark, d):
    return profiles(spark, d).select("doc_id", masking.mask_places(F.col("text")).alias("text"))


@plan(rf"""WITH {PROFILES}, h AS (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)\n(?:technical\s+skills|skills|experience|work\s+history|education|summary)\b', 1) AS header FROM profiles)
SELECT doc_id, {places_sql(phones_sql(mail_sql('header')))} || {years_sql(phones_sql(mail_sql('substr(text, length(header) + 1)')))} AS text FROM h""")
def mask_zones(spark, d):
    return profiles(spark, d).select("doc_id", masking.mask_zones(F.col("text")).alias("text"))


def recogniser():
    """A stand-in for a model of names: capitalised pairs of words are persons, a few towns are places."""
    import re

    def spans(text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "PERSON") for m in re.finditer(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", text)]
        return found + [(m.start(), m.end(), "GPE") for m in re.finditer(r"\b(?:Oslo|Bergen)\b", text)]

    return spans


SPOKEN = "concat(CASE c_custkey % 3 WHEN 0 THEN 'Ada Berg' WHEN 1 THEN 'Apache Spark' ELSE 'nobody' END, ' met ', CASE c_custkey % 2 WHEN 0 THEN 'Eve Moe' ELSE 'them' END, ' in ', CASE c_custkey % 5 WHEN 0 THEN 'Oslo' ELSE 'town' END)"


@plan("""SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN '[REDACTED_NAME]' WHEN 1 THEN 'Apache Spark' ELSE 'nobody' END || ' met ' || CASE c_custkey % 2 WHEN 0 THEN '[REDACTED_NAME]' ELSE 'them' END
 || ' in ' || CASE c_custkey % 5 WHEN 0 THEN '[REDACTED_LOCATION]' ELSE 'town' END AS text FROM customer""")
def mask_entities(spark, d):
    x = table(spark, d, "customer").selectExpr("c_custkey as doc_id", f"{SPOKEN} as text")
    return masking.apply_spans(x, masking.find_spans(x, recogniser))


NAMED = """concat(CASE c_custkey % 6 WHEN 0 THEN 'Ana-Maria O''Neil' WHEN 1 THEN 'EXPERIENCE' WHEN 2 THEN 'Room 12' WHEN 3 THEN 'a b c d e f g' WHEN 4 THEN 'José' ELSE 'J. R. Moe' END, chr(10), 'first page')"""


@plan("""WITH p AS (SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'Ana-Maria O''Neil' WHEN 4 THEN 'José' WHEN 5 THEN 'J. R. Moe' END AS name,
  CASE c_custkey % 6 WHEN 0 THEN 'Ana-Maria O''Neil' WHEN 1 THEN 'EXPERIENCE' WHEN 2 THEN 'Room 12' WHEN 3 THEN 'a b c d e f g' WHEN 4 THEN 'José' ELSE 'J. R. Moe' END AS line FROM customer)
SELECT doc_id, 1 AS page_number, CASE WHEN name IS NULL THEN line ELSE '[REDACTED_NAME]' END || chr(10) || 'first page' AS text FROM p
UNION ALL SELECT doc_id, 2, CASE WHEN name IS NULL THEN 'Signed: ' || upper(line) || ', ' || line || 'x' ELSE 'Signed: [REDACTED_NAME], ' || line || 'x' END FROM p""")
def mask_names(spark, d):
    x = table(spark, d, "customer").selectExpr("c_custkey as doc_id", f"{NAMED} as text")
    line = F.substring_index("text", "\n", 1)
    second = x.select("doc_id", F.lit(2).alias("page_number"), F.lit(0).alias("block_no"), F.concat(F.lit("Signed: "), F.upper(line), F.lit(", "), line, F.lit("x")).alias("text"))
    return masking.mask_first_names(x.select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("block_no"), "text").union(second)).drop("block_no")


ENTROPY_SQL = """c AS (SELECT doc_id, unnest(string_split({0}, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
 e AS (SELECT doc_id, round(-sum(n / t * log2(n / t)), 2) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM n) GROUP BY doc_id)"""


@plan(r"""WITH """ + ENTROPY_SQL.format("text") + r""", v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
 t AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{2,}')),
 k AS (SELECT doc_id, round(count(v.w) / count(*), 2) AS density FROM t LEFT JOIN v USING (w) GROUP BY doc_id),
 g AS (SELECT doc_id, coalesce(entropy, 0) AS entropy, coalesce(density, 0) AS density FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, entropy BETWEEN 3.5 AND 5 AND density >= 0.7 AS passed, array_to_string(list_filter([CASE WHEN NOT entropy BETWEEN 3.5 AND 5 THEN 'ENTROPY' END, CASE WHEN density < 0.7 THEN 'DENSITY' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def integrity_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    x = docs.select("doc_id", entropy(F.col("text")).alias("entropy")).join(measures.dictionary_density(docs, table(spark, d, "benchmark").select("text")), "doc_id")
    x = x.select("doc_id", masking.integrity_gate(F.col("entropy"), F.col("density")).alias("g"))
    return x.select("doc_id", "g.passed", F.array_join("g.reasons", ",").alias("reasons"))


@plan("WITH " + ENTROPY_SQL.format("lower(text)") + r""", w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+') AS w,
  length(regexp_replace(text, '[^\x{FFFD}\p{Cc}\p{Cf}\p{Co}]', '', 'g')) - length(regexp_replace(text, '[^\t-\r\x{1C}-\x{1F}\x{85}\x{200B}-\x{200D}\x{FEFF}]', '', 'g')) AS bad FROM documents)
SELECT doc_id, coalesce(entropy, 0) BETWEEN 3.5 AND 5 AND len(w) >= 4 AND list_sum(list_transform(w, lambda x: length(x))) >= 25 AND bad / greatest(length(text), 1) <= 0.01 AS passed FROM w LEFT JOIN e USING (doc_id)""")
def readability_gate(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", (entropy(F.lower(text)).between(*masking.ENTROPY) & masking.readable(text)).alias("passed"))


SCANNED = "l_orderkey as doc_id, l_linenumber as page_number, l_partkey as block_no, l_suppkey * 700 as width, 1000 as height, l_partkey % 4 = 0 as needs_ocr, repeat('x', cast(l_quantity as int)) as text"


@plan("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_number, l_partkey AS block_no, l_suppkey * 700 AS width, 1000 AS height, l_partkey % 4 = 0 AS needs_ocr, repeat('x', l_quantity::INT) AS text FROM lineitem),
 p AS (SELECT doc_id, page_number, max(width * height) AS area, count(*) AS n, max(needs_ocr::INT) AS ocr, string_agg(text, chr(10) || chr(10) ORDER BY block_no, text) AS text FROM b GROUP BY ALL),
 w AS (SELECT *, coalesce(sum(ocr) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER v AS upto FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY page_number)),
 c AS (SELECT *, CASE WHEN area > 60000000 THEN 'PDF_PAGE_DIMENSIONS' WHEN n > 2 THEN 'PDF_BLOCK_LIMIT' WHEN length(text) > 90 THEN 'PDF_TEXT_LIMIT' WHEN ocr = 1 AND before >= 1 THEN 'OCR_PAGE_LIMIT' WHEN upto > 150 THEN 'PDF_TEXT_LIMIT' END AS code FROM w),
 d AS (SELECT doc_id, CASE WHEN count(*) > 6 THEN 'PDF_PAGE_LIMIT' ELSE coalesce(arg_min(code, page_number) FILTER (code IS NOT NULL), 'OK') END AS code, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM c GROUP BY doc_id)
SELECT doc_id, CASE code WHEN 'OK' THEN 'success' WHEN 'OCR_PAGE_LIMIT' THEN 'review' ELSE 'failure' END AS status, code, CASE WHEN code = 'OK' THEN text END AS text FROM d""")
def document_assembly(spark, d):
    return masking.assembled(table(spark, d, "lineitem").selectExpr(*SCANNED.split(", ")[:5], "l_partkey % 4 = 0 as needs_ocr", "repeat('x', cast(l_quantity as int)) as text"), 6, 60_000_000, 2, 90, 150, 1)
