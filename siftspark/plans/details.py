"""Queries on chunks that keep their places, passages held by others, unions of intervals and details of pairs, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import anchors, intervals, located, sections, verification, views

from .catalogue import plan
from .relations import PAIRS, PROFILE, pairs, spread, table
from .screening import _ANY, SECTIONS

#: Profiles with as many more projects as make several chunks.
LONG = f"""concat({PROFILE}, chr(10), 'Key Projects', chr(10), repeat(concat('Tool | ', cast(c_custkey as string), ' made reports', chr(10), '- in use since 2019 by many teams', chr(10), chr(10)), cast(c_custkey % 17 as int)))"""
LONGS = f"profiles AS (SELECT c_custkey AS doc_id, {LONG} AS text FROM customer)"
_CATEGORY = "CASE section WHEN 'SUMMARY' THEN 'EXPERIENCE' WHEN 'CERTIFICATIONS' THEN 'EDUCATION' ELSE section END"
_TRIM = "trim({}, chr(10) || chr(9) || chr(13) || ' ')"
_HEADING = rf"[#*=\-\s]*({_ANY})[:\s\-*=#]*"


def chunked(source: str, least: int, most: int) -> str:
    """CTEs that end in chunked (key, section, chunk_index, body), from a CTE source (key, section, content)."""
    return rf"""cut1 AS (SELECT key, section, {most} - length(section) - 12 AS cap, string_split(regexp_replace(content, '\n\s*[-•*]\s*|\n\n+|\n(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM {source}),
 cut2 AS (SELECT key, section, cap, {_TRIM.format('u')} AS block, i FROM (SELECT key, section, cap, unnest(p) AS u, generate_subscripts(p, 1) AS i FROM cut1)),
 cut3 AS (SELECT key, section, cap, i, CASE WHEN length(block) <= cap THEN [block] ELSE regexp_extract_all(block, '(?s)\S.{{0,' || (cap - 1) || '}}( |$)|\S.{{' || (cap - 1) || '}}') END AS cut FROM cut2 WHERE length(block) > 5),
 piece AS (SELECT key, section, cap, row_number() OVER (PARTITION BY key ORDER BY i, j) AS n, {_TRIM.format('t')} AS piece FROM (SELECT key, section, cap, i, unnest(cut) AS t, generate_subscripts(cut, 1) AS j FROM cut3)),
 fold AS (SELECT DISTINCT key, section, CAST(0 AS BIGINT) AS n, '' AS pending, CAST(NULL AS VARCHAR) AS body FROM piece UNION ALL
  SELECT key, section, n, CASE WHEN length(joined) > cap THEN piece WHEN length(joined) >= {least} THEN '' ELSE joined END, CASE WHEN length(joined) > cap THEN pending WHEN length(joined) >= {least} THEN joined END
  FROM (SELECT q.key, q.section, q.cap, q.n, q.piece, f.pending, CASE WHEN f.pending = '' THEN q.piece ELSE f.pending || ' ' || q.piece END AS joined FROM fold f JOIN piece q ON q.key = f.key AND q.n = f.n + 1)),
 closed AS (SELECT key, section, n, body FROM fold WHERE body IS NOT NULL UNION ALL SELECT key, section, n + 1, pending FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM fold) WHERE r = 1 AND pending <> ''),
 chunked AS (SELECT key, section, row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS chunk_index, body FROM closed)"""


@plan(f"""WITH RECURSIVE {LONGS}, {SECTIONS[SECTIONS.index('marked AS'):]},
 firsts AS (SELECT doc_id, section, min(pos) AS pos FROM named WHERE content <> '' GROUP BY ALL), src AS (SELECT {{'d': doc_id, 'p': pos}} AS key, section, content FROM sections JOIN firsts USING (doc_id, section)), {chunked('src', 150, 600)}
SELECT key.d AS doc_id, row_number() OVER (PARTITION BY key.d ORDER BY key.p, chunk_index) - 1 AS global_chunk_id, section, {_CATEGORY} AS category, chunk_index, '[Section: ' || section || '] ' || body AS text, length(body) AS char_length FROM chunked""")
def document_chunks(spark, d):
    return sections.document_chunks(spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey as doc_id", f"{LONG} as text"))


_BLOCKS = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls, 1 + doc_id % 3 AS k FROM profiles), grid AS (SELECT doc_id, ls, k, unnest(range(0, (len(ls) + k - 1) // k)) AS i FROM lines),
 blocks AS (SELECT doc_id, 1 + i // 4 AS page_number, i % 4 AS block_no, [i * k, length(array_to_string(ls[i * k + 1:i * k + k], chr(10)))] AS bbox, array_to_string(ls[i * k + 1:i * k + k], chr(10)) AS text FROM grid)"""


@plan(rf"""WITH RECURSIVE {LONGS}, {_BLOCKS}, n AS (SELECT *, regexp_full_match(text, '(?i){_HEADING}') AS alone, lead(text) OVER (PARTITION BY doc_id ORDER BY page_number, block_no) AS after,
  string_split(regexp_replace(text, '(?im)^{_HEADING}$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM blocks),
 part AS (SELECT doc_id, page_number, block_no, bbox, alone, after, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM n),
 named AS (SELECT * EXCLUDE (part), {SECTIONS[SECTIONS.index("CASE WHEN pos = 0 AND"):SECTIONS.index(" AS section,")]} AS named, {_TRIM.format("CASE WHEN pos = 0 THEN part ELSE string_split(part, chr(2))[2] END")} AS content FROM part),
 whole AS (SELECT doc_id, page_number, block_no, any_value(bbox) AS bbox, any_value(alone) AS alone, any_value(after) AS after, any_value(n) AS n, named, min(pos) AS pos, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content
  FROM named WHERE CASE WHEN alone THEN pos = 1 ELSE content <> '' END GROUP BY doc_id, page_number, block_no, named),
 carried AS (SELECT *, alone OR n > 1 AS opens, coalesce(last_value(CASE WHEN alone OR n > 1 THEN named END IGNORE NULLS) OVER w, 'EXPERIENCE') AS section FROM whole WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, block_no, pos ROWS UNBOUNDED PRECEDING)),
 titled AS (SELECT *, section IN ('EXPERIENCE', 'PROJECTS') AND length(content) < 180 AND (coalesce(regexp_matches(after, '\b(?:19|20)\d{{2}}\b'), false) OR (section = 'PROJECTS' AND contains(content, '|'))) AND NOT regexp_matches(content, '(?i)^[-•*]|^(?:technologies|tech stack|skills)\s*:') AS title FROM carried),
 numbered AS (SELECT *, sum(CASE WHEN opens OR title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, block_no, pos ROWS UNBOUNDED PRECEDING) AS entry FROM titled),
 entries AS (SELECT {{'d': doc_id, 'e': entry}} AS key, any_value(section) AS section, string_agg(content, chr(10) || chr(10) ORDER BY page_number, block_no, pos) AS content, list(content ORDER BY page_number, block_no, pos) AS contents,
  string_agg(page_number || '/' || block_no || '/' || bbox[1] || '/' || bbox[2], ',' ORDER BY page_number, block_no, pos) AS locations FROM numbered WHERE NOT alone GROUP BY doc_id, entry), {chunked('entries', 400, 420)},
 made AS (SELECT key.d AS doc_id, key.e AS entry, chunk_index, section, locations, CASE WHEN chunk_index > 0 AND section IN ('EXPERIENCE', 'PROJECTS') THEN array_to_string(contents[1:2], ' ')[1:160] || chr(10) || body ELSE body END AS body FROM chunked JOIN entries USING (key, section))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry, chunk_index) - 1 AS global_chunk_id, {_CATEGORY} AS category, section, chunk_index, '[Section: ' || section || '] ' || body AS text, length(body) AS char_length, locations FROM made""")
def located_chunks(spark, d):
    x = table(spark, d, "customer").selectExpr("c_custkey as doc_id", f"split({LONG}, '\\n') as ls", "1 + c_custkey % 3 as k")
    x = x.select("doc_id", "ls", "k", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ls") / F.col("k")).cast("int") - 1)).alias("i"))
    text = F.array_join(F.slice("ls", (F.col("i") * F.col("k") + 1).cast("int"), F.col("k").cast("int")), "\n")
    bbox = F.array((F.col("i") * F.col("k")).cast("long"), F.length(text).cast("long"))
    blocks = x.select("doc_id", (F.floor(F.col("i") / 4) + 1).alias("page_number"), (F.col("i") % 4).alias("block_no"), bbox.alias("bbox"), text.alias("text"))
    c = located.located_chunks(blocks)
    place = lambda r: F.concat_ws("/", r["page_number"], r["block_no"], r["bbox"][0], r["bbox"][1])
    return c.select("doc_id", "global_chunk_id", "category", "section", "chunk_index", "text", "char_length", F.array_join(F.transform("locations", place), ",").alias("locations"))


_SENTENCE = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@plan(rf"""WITH f AS (SELECT DISTINCT {_FLAT.format('l')} AS f FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)), s AS (SELECT item_id, text, unnest({_SENTENCE}) AS s FROM benchmark), p AS (SELECT item_id, {_FLAT.format('s')} AS p FROM s),
 h AS (SELECT p, coalesce((SELECT bool_or(regexp_matches(f, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || regexp_escape(p) || '($|[^\p{{L}}\p{{M}}\p{{N}}_])')) FROM f WHERE contains(f, p)), false) AS held FROM (SELECT DISTINCT p FROM p WHERE p <> ''))
SELECT item_id, count(*) AS sentences, count(*) FILTER (NOT held) AS kept FROM p JOIN h USING (p) GROUP BY item_id""")
def manifest_containment(spark, d):
    lines = table(spark, d, "documents").select(F.lit(1).alias("pair_id"), F.explode(F.split("text", "\n")).alias("text"))
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\x01"), "\x01")
    s = table(spark, d, "benchmark").select("item_id", F.posexplode(cut).alias("n", "text")).where(anchors.plain(F.col("text")) != "")
    kind = (F.lit("SKILLS").alias("category"), F.lit("SKILLS").alias("source_category"))
    kept = anchors.kept_sentences(s.select(F.lit(1).alias("pair_id"), F.struct("item_id", "n").alias("row"), *kind, "text"), lines.select("pair_id", *kind, "text"))
    return kept.groupBy(F.col("row.item_id").alias("item_id")).agg(F.count("*").alias("sentences"), F.count_if("kept").alias("kept"))


@plan("""WITH s AS (SELECT c.c_mktsegment AS who, epoch(o_orderdate)::BIGINT // 86400 * 1000 + o_orderkey % 977 AS a, 50 + o_custkey % 700 AS n FROM orders JOIN customer c ON c_custkey = o_custkey),
 f AS (SELECT *, CASE WHEN a > max(a + n) OVER (PARTITION BY who ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM s),
 i AS (SELECT *, sum(gap) OVER (PARTITION BY who ORDER BY a, n ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT who, CAST(sum(n) AS BIGINT) AS covered, count(*) AS islands FROM (SELECT who, island, max(a + n) - min(a) AS n FROM i GROUP BY ALL) GROUP BY who""")
def interval_union(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = day * 1000 + F.col("o_orderkey") % 977
    return intervals.interval_union(o.select(F.col("c_mktsegment").alias("who"), a.alias("a"), (a + 50 + F.col("o_custkey") % 700).alias("b")), "who", "a", "b")


_KIND = "(['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])"
_MADE = f"""g AS (SELECT l_orderkey AS pair_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
 e AS (SELECT pair_id, n, p, {_KIND}[p % 4 + 1] AS category, {_KIND}[p % 4 + 1] || ':' || n AS citation, 'ev_' || p AS evidence_id, CASE WHEN p % 23 = 0 THEN 'you are now ' ELSE '' END || 'Made ' || p || ' parts' AS text FROM g),
 c AS (SELECT *, CASE WHEN p % 7 = 0 THEN 'flags[' || n % 2 || ']' ELSE lower({_KIND}[(p + CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END) % 4 + 1]) END AS field, CASE p % 13 WHEN 0 THEN 'SKILLS-1' WHEN 1 THEN 'SKILLS:99' ELSE citation END AS cited FROM e),
 k AS (SELECT *, CASE p % 6 WHEN 0 THEN text WHEN 3 THEN 'made 9999 parts' WHEN 5 THEN 'Unrelated' ELSE 'made parts' END AS claim, CASE p % 6 WHEN 2 THEN ' ' WHEN 3 THEN 'made' WHEN 4 THEN 'MADE' ELSE text END AS quote, CASE p % 6 WHEN 0 THEN evidence_id WHEN 1 THEN 'ev_0' WHEN 5 THEN evidence_id END AS own FROM c WHERE p % 10 <> 0)"""


@plan(f"""WITH {_MADE}, f AS (SELECT DISTINCT pair_id, lower(x) AS field, [x] AS allowed, NULL AS i FROM g, (SELECT unnest({_KIND}) AS x) UNION ALL
  SELECT DISTINCT pair_id, 'flags[' || v.i || ']', CASE WHEN v.i = 1 THEN ['EXPERIENCE'] ELSE {_KIND} END, v.i FROM g, (VALUES (0), (1)) v(i)),
 a AS (SELECT c.pair_id, c.field, c.cited AS citation, false AS claimed, CASE WHEN NOT regexp_full_match(c.cited, '(SKILLS|EXPERIENCE|PROJECTS|EDUCATION):[1-9][0-9]*') THEN 'MALFORMED' WHEN e.citation IS NULL THEN 'UNKNOWN' WHEN NOT list_contains(f.allowed, e.category) THEN 'WRONG' END AS reason
   FROM c JOIN f USING (pair_id, field) LEFT JOIN e ON e.pair_id = c.pair_id AND e.citation = c.cited UNION ALL
  SELECT k.pair_id, k.field, k.cited, true, CASE WHEN e.citation IS NULL OR NOT list_contains(f.allowed, e.category) THEN 'INVALID' WHEN trim(claim) = '' OR trim(quote) = '' THEN 'EMPTY' WHEN NOT contains(lower(e.text), lower(quote)) THEN 'QUOTE'
   WHEN own <> e.evidence_id THEN 'ID' WHEN own IS NOT NULL AND claim <> e.text THEN 'EXPLICIT' WHEN NOT list_has_all(regexp_extract_all(quote, '\\d+'), regexp_extract_all(claim, '\\d+')) THEN 'NUMBER' END
   FROM k JOIN f USING (pair_id, field) LEFT JOIN e ON e.pair_id = k.pair_id AND e.citation = k.cited),
 o AS (SELECT pair_id, field, citation, bool_or(NOT claimed) AS cite, bool_or(NOT claimed AND reason IS NOT NULL) AS bc, bool_or(claimed AND reason IS NOT NULL) AS bk, bool_or(claimed AND reason IS NULL) AS ok FROM a GROUP BY ALL),
 w AS (SELECT f.pair_id, f.field, f.i, coalesce(bool_or(cite), false) AS cites, coalesce(bool_or(bc), false) AS bc, coalesce(bool_or(bk), false) AS bk, coalesce(bool_or(cite AND NOT ok), false) AS un FROM f LEFT JOIN o ON o.pair_id = f.pair_id AND o.field = f.field GROUP BY ALL),
 s AS (SELECT pair_id, 'EVIDENCE_INJECTION_SIGNAL:' || citation AS s FROM e WHERE p % 23 = 0 UNION ALL SELECT DISTINCT pair_id, 'PROMPT' FROM g WHERE pair_id % 9 = 0),
 r AS (SELECT pair_id, 'MISSING_CITATIONS:' || field AS r FROM w WHERE NOT cites UNION ALL SELECT pair_id, 'INVALID_CITATIONS:' || field FROM w WHERE bc UNION ALL SELECT pair_id, 'UNSUPPORTED_CLAIM:' || field FROM w WHERE bk UNION ALL
  SELECT pair_id, 'MISSING_CLAIM_SUPPORT:' || field FROM w WHERE un UNION ALL SELECT pair_id, 'MISSING_EVIDENCE:' || allowed[1] FROM f WHERE i IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.pair_id = f.pair_id AND e.category = f.allowed[1]) UNION ALL
  SELECT pair_id, 'INJECTION_SIGNAL_REQUIRES_REVIEW' FROM s UNION ALL SELECT pair_id, 'EVIDENCE_CONTEXT_TRUNCATED' FROM g WHERE pair_id % 8 = 0),
 p AS (SELECT DISTINCT pair_id FROM g)
SELECT pair_id, (SELECT coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') FROM r WHERE r.pair_id = p.pair_id) AS reasons, (SELECT coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') FROM w WHERE w.pair_id = p.pair_id AND i IS NOT NULL AND cites AND NOT bc AND NOT bk AND NOT un) AS verified_flags,
 (SELECT coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') FROM s WHERE s.pair_id = p.pair_id) AS signals, (SELECT coalesce(string_agg(DISTINCT citation, ',' ORDER BY citation), '') FROM a WHERE a.pair_id = p.pair_id AND reason IS NULL) AS valid,
 (SELECT coalesce(string_agg(DISTINCT citation, ',' ORDER BY citation), '') FROM a WHERE a.pair_id = p.pair_id AND reason IS NOT NULL) AS invalid FROM p""")
def evidence_verification(spark, d):
    p, n = F.col("p"), F.col("n")
    kind = lambda k: F.element_at(F.array(*map(F.lit, verification.LETTERS)), (k % 4 + 1).cast("int"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    text = F.concat(F.when(p % 23 == 0, "you are now ").otherwise(F.lit("")), F.lit("Made "), p.cast("string"), F.lit(" parts"))
    e = g.select("*", kind(p).alias("category"), F.concat(kind(p), F.lit(":"), n.cast("string")).alias("citation"), F.concat(F.lit("ev_"), p.cast("string")).alias("evidence_id"), text.alias("text"))
    field = F.when(p % 7 == 0, F.format_string("flags[%d]", (n % 2).cast("int"))).otherwise(F.lower(kind(p + F.when(p % 11 == 0, 1).otherwise(0))))
    c = e.select("*", field.alias("field"), F.when(p % 13 == 0, "SKILLS-1").when(p % 13 == 1, "SKILLS:99").otherwise(F.col("citation")).alias("cited"))
    text, k = F.col("text"), p % 6
    claim = F.when(k == 0, text).when(k == 3, "made 9999 parts").when(k == 5, "Unrelated").otherwise(F.lit("made parts"))
    quote = F.when(k == 2, " ").when(k == 3, "made").when(k == 4, "MADE").otherwise(text)
    own = F.when(k.isin(0, 5), F.col("evidence_id")).when(k == 1, "ev_0")
    claims = c.where(p % 10 != 0).select("pair_id", "field", F.col("cited").alias("citation"), claim.alias("claim"), quote.alias("quote"), own.alias("evidence_id"))
    pair = g.select("pair_id").distinct()
    flags = pair.select("pair_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("index")).withColumn("type", F.when(F.col("index") == 1, verification.CAREER_GAP).otherwise("OTHER"))
    signals = F.when(F.col("pair_id") % 9 == 0, F.array(F.lit("PROMPT")))
    v = verification.verification(pair.select("pair_id", signals.alias("signals"), (F.col("pair_id") % 8 != 0).alias("complete")), e, flags, c.select("pair_id", "field", F.col("cited").alias("citation")), claims)
    return v.select("pair_id", *[F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in ("reasons", "verified_flags", "signals", "valid", "invalid")])


@plan(f"""WITH {PAIRS}, e AS (SELECT l_orderkey AS pair_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS event_id, l_suppkey AS actor, l_shipdate AS ts, l_returnflag AS snapshot FROM lineitem)
SELECT pair_id, coalesce((SELECT string_agg(event_id || '@' || strftime(ts, '%Y-%m-%d') || '=' || snapshot, ',' ORDER BY ts DESC, event_id) FROM e WHERE e.pair_id = p.pair_id), '') AS history,
 coalesce((SELECT string_agg(o.job || '/' || o.pair_id || '/' || o.status, ',' ORDER BY o.job, o.pair_id) FROM pairs o WHERE o.doc_id = p.doc_id AND o.pair_id <> p.pair_id), '') AS roles FROM pairs p WHERE status = 'REVIEW_REQUIRED'""")
def pair_details(spark, d):
    p = pairs(spark, d)
    event_id = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey")
    events = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), event_id.alias("event_id"), F.col("l_suppkey").alias("actor"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("snapshot"))
    x = verification.pair_details(p.where("status = 'REVIEW_REQUIRED'"), p.select("pair_id", "doc_id", "job", "status", "score"), events)
    event = lambda e: F.concat(e["event_id"], F.lit("@"), F.date_format(e["created_at"], "yyyy-MM-dd"), F.lit("="), e["snapshot"])
    return x.select("pair_id", F.array_join(F.transform("history", event), ",").alias("history"), F.array_join(F.transform("other_roles", lambda r: F.concat_ws("/", r["job"], r["pair_id"], r["status"])), ",").alias("roles"))


@plan(f"""WITH {PAIRS}, c AS (SELECT l_orderkey AS pair_id, string_agg('line ' || l_linenumber || ' of ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT pair_id, coalesce(m, '') AS messages, CASE WHEN status = 'CUTOFF_EXCLUDED' THEN 'Outside this role''s detailed assessment limit; not a recruiter rejection.' WHEN status = 'EVALUATION_FAILED' THEN 'F' || pair_id % 2 END AS judged_reason,
 CASE WHEN doc_id % 3 = 2 THEN 'UNREADABLE' END AS extraction_reason FROM pairs LEFT JOIN c USING (pair_id)""")
def stage_reasons(spark, d):
    k = F.col("pair_id")
    status = F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "A", "FAIL").otherwise("REVIEW")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", status.alias("status"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_partkey").cast("string")).alias("message"))
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.array_sort(F.collect_list(row)).alias("checks"))
    x = pairs(spark, d).join(c, "pair_id", "left").withColumn("extraction_error", F.when(F.col("doc_id") % 3 == 2, "UNREADABLE")).withColumn("failure_code", F.concat(F.lit("F"), (k % 2).cast("string")))
    x = x.withColumn("extraction", F.lit("SUCCEEDED")).withColumn("rules", F.lit("REVIEW")).withColumn("matched", F.lit(True)).withColumn("judged", F.lit(None).cast("string"))
    of = lambda n, name: F.max(F.when(F.col("stage") == n, F.col("reason"))).alias(name)
    return views.stage_labels(x, full=True).groupBy("pair_id").agg(of(1, "messages"), of(3, "judged_reason"), of(0, "extraction_reason"))


@plan(r"""WITH s AS (SELECT doc_id AS draft_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS source FROM documents WHERE text IS NOT NULL), q AS (SELECT draft_id, 0 AS target, source[20:60] AS quote FROM s UNION ALL SELECT draft_id - 1, 1, source[1:40] FROM s UNION ALL SELECT draft_id, 2, source[5:30] || '!!' FROM s),
 a AS (SELECT draft_id, quote FROM q WHERE target = 1 AND draft_id % 2 = 0)
SELECT q.draft_id, target, coalesce(contains(source, trim(q.quote)), false) OR EXISTS (SELECT 1 FROM a WHERE a.draft_id = q.draft_id AND contains(a.quote, trim(q.quote))) AS accepted FROM q LEFT JOIN s USING (draft_id)""")
def target_quotes(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("draft_id"), "text")
    blocks = docs.select("draft_id", F.posexplode(F.split("text", r"\n")).alias("block", "text")).select("draft_id", F.lit(1).alias("page"), "block", "text").where("trim(text) <> ''")
    s = docs.select("draft_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    wide = lambda c: F.replace(c, F.lit(" "), F.lit(" \n "))
    q = s.select("draft_id", F.lit(0).alias("target"), wide(F.substring("t", 20, 41)).alias("quote")).union(s.select(F.col("draft_id") - 1, F.lit(1), F.left("t", F.lit(40)))).union(s.select("draft_id", F.lit(2), F.concat(F.substring("t", 5, 26), F.lit("!!"))))
    return verification.quoted_targets(q, blocks, q.where("target = 1 and draft_id % 2 = 0").select("draft_id", "quote"))
