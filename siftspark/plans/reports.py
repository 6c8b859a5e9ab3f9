"""Queries on intake, vectors, support of claims, the cascade, pools and replays, with the same questions in DuckDB's words."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.operators import cascade, measures, pages, retrieval, support
from siftspark.sources import intake

from .catalogue import plan
from .relations import PAIRS, pairs, table


@plan("""SELECT p_brand AS batch, count(*) AS files, CAST(sum(p_partkey * 7919 % 6000000) AS BIGINT) AS bytes, CASE WHEN count(*) > 85 THEN 'TOO_MANY_FILES' WHEN sum(p_partkey * 7919 % 6000000) > 220000000 THEN 'BATCH_TOO_LARGE' ELSE 'ACCEPTED' END AS code
FROM part GROUP BY p_brand""")
def batch_limits(spark, d):
    files = table(spark, d, "part").select(F.col("p_brand").alias("batch"), (F.col("p_partkey") * 7919 % 6000000).alias("length"))
    return intake.batch_limits(files, "batch", 85, 220_000_000)


@plan("""WITH l AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no record' WHEN 1 THEN 'LOG ' || props[:-2] ELSE 'LOG ' || props END AS line FROM events),
 r AS (SELECT event_id, substr(line, strpos(line, '{')) AS r FROM l WHERE contains(line, '{')) SELECT event_id, CAST(json_extract_string(r, '$.k') AS BIGINT) AS k FROM r WHERE json_valid(r)""")
def json_records(spark, d):
    log, props, n = F.lit("LOG "), F.col("props"), F.col("event_id") % 7
    line = F.when(n == 0, "no record").when(n == 1, F.concat(log, F.left(props, F.length(props) - 1))).otherwise(F.concat(log, props))
    return intake.json_records(table(spark, d, "events").select("event_id", line.alias("line")), "line", "k long")


@plan(f"""WITH {PAIRS} SELECT pair_id, '{{"schema_version":1,"pair_id":' || pair_id || ',"job":"' || job || '","status":"' || status || '"}}' AS record FROM pairs""")
def json_handoff(spark, d):
    return pairs(spark, d).select("pair_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), "pair_id", "job", "status")).alias("record"))


SLOTS = 16


def hashing():
    """A model that needs no weights: the words of a text, hashed to slots and counted, as a vector of length one."""
    slot: dict[str, int] = {}

    def encode(texts):
        out = np.zeros((len(texts), SLOTS))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split(" "):
                if w not in slot:
                    slot[w] = int(hashlib.md5(w.encode("utf-8", "replace")).hexdigest()[:4], 16) % SLOTS
                row[slot[w]] += 1
        return out / np.sqrt((out * out).sum(1, keepdims=True))

    return encode


@plan(f"""WITH w AS (SELECT doc_id AS id, ('0x' || md5(unnest(string_split(lower(text), ' ')))[1:4])::INT % {SLOTS} AS slot FROM documents), n AS (SELECT id, slot, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT id, sqrt(sum(n * n)) AS size FROM n GROUP BY id)
SELECT id, slot, round(n / size, 6) AS weight FROM n JOIN s USING (id)""")
def encode_texts(spark, d):
    x = retrieval.encode(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), hashing)
    return x.select("id", F.posexplode("vector").alias("slot", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 6))


@plan("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'CACHED' WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 5 = 0) THEN 'REUSED' ELSE 'COMPUTE' END AS action FROM documents""")
def embedding_reuse(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return retrieval.reuse(x, x.where("id % 3 = 0"), x.where("id % 5 = 0")).select("id", "action")


@plan("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations), q AS (SELECT conv_id, min(turn) AS first, arg_min(w, turn) AS q FROM t GROUP BY conv_id),
 s AS (SELECT conv_id, turn, round(len(list_intersect(w, q)) / len(q), 4) AS score FROM t JOIN q USING (conv_id) WHERE turn > first)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM s) WHERE place <= 2""")
def rerank_pairs(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    q = t.groupBy("conv_id").agg(F.min("turn").alias("first"), F.min_by("w", "turn").alias("q"))
    overlap = F.size(F.array_intersect("w", "q")) / F.size("q")
    return retrieval.rerank(t.join(q, "conv_id").where("turn > first"), overlap, ["conv_id"], "turn").select("conv_id", "turn", "score", "place")


@plan("""SELECT pair_id, part, used FROM (SELECT l_orderkey AS pair_id, l_linenumber AS part, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM lineitem) WHERE used <= 100""")
def prompt_bound(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("part"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("priority"), F.col("l_quantity").cast("long").alias("size")
    )
    return support.fitting(x, "pair_id", "priority", "size", 100).select("pair_id", "part", "used")


_FLAT = r"' ' || lower(trim(regexp_replace({}, '\s+', ' ', 'g'))) || ' '"


@plan(rf"""WITH p AS (SELECT conv_id, turn, role, unnest(string_split(regexp_replace(regexp_replace(text, '([!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\.(\s+[A-Z])', '.' || chr(1) || '\1', 'g'), chr(1))) AS s FROM conversations),
 r AS (SELECT conv_id, turn, role, s, {_FLAT.format('s')} AS t FROM p WHERE regexp_matches(s, '\S')), f AS (SELECT conv_id, turn, role, {_FLAT.format('text')} AS t FROM conversations)
SELECT conv_id, turn, role, count(*) AS passages, CAST(sum(length(s)) AS BIGINT) AS chars FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = r.conv_id AND f.role = r.role AND f.turn <> r.turn AND contains(f.t, r.t)) GROUP BY ALL""")
def manifest_dedup(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    s = pages.sentences(c.select(F.struct("conv_id", "turn", "role").alias("doc_id"), "text")).select("doc_id.*", F.col("sentence").alias("text"))
    kept = support.not_contained(s, c, ["conv_id", "role"], "turn")
    return kept.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))


CLAIMS = """c AS (SELECT o_orderkey AS pair_id, concat('Order ', o_orderkey, ' of customer ', o_custkey, ' has 12 items.') AS source, concat('Customer ', o_custkey, ' has 12 items') AS claim, o_orderkey % 8 <> 5 AS cited,
 CASE o_orderkey % 8 WHEN 0 THEN concat('of CUSTOMER ', o_custkey, '   has 12') WHEN 1 THEN ' ' WHEN 2 THEN 'of customer ... has' WHEN 3 THEN 'of client' WHEN 4 THEN 'has 12 items' WHEN 6 THEN 'items.' WHEN 7 THEN NULL ELSE 'x' END AS quote FROM orders)"""


@plan(rf"""WITH {CLAIMS} SELECT pair_id, CASE WHEN NOT cited THEN 'INVALID_CLAIM_CITATION' WHEN coalesce(trim(quote), '') = '' THEN 'EMPTY_CLAIM_SUPPORT' WHEN contains(quote, '...') THEN 'ELLIPSIS_IN_QUOTE'
 WHEN NOT contains(lower(source), lower(regexp_replace(quote, '\s+', ' ', 'g'))) THEN 'QUOTE_NOT_IN_SOURCE' WHEN NOT list_has_all(regexp_extract_all(quote, '\d+'), regexp_extract_all(claim, '\d+')) THEN 'NUMERIC_CLAIM_NOT_IN_QUOTE' END AS reason FROM c""")
def claim_checks(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quotes = {0: F.concat(F.lit("of CUSTOMER "), c, F.lit("   has 12")), 1: F.lit(" "), 2: F.lit("of customer ... has"), 3: F.lit("of client"), 4: F.lit("has 12 items"), 5: F.lit("x"), 6: F.lit("items.")}
    quote = F.coalesce(*[F.when(k % 8 == n, q) for n, q in quotes.items()])
    source = F.concat(F.lit("Order "), k, F.lit(" of customer "), c, F.lit(" has 12 items."))
    claim = F.concat(F.lit("Customer "), c, F.lit(" has 12 items"))
    return table(spark, d, "orders").select(k.alias("pair_id"), support.claim_reason(claim, quote, source, k % 8 != 5).alias("reason"))


_OF = "(['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])"


@plan(f"""WITH r AS (SELECT DISTINCT l_orderkey AS pair_id, 'INVALID_CITATIONS:' || lower({_OF}[l_linenumber % 4 + 1]) AS reason FROM lineitem WHERE l_partkey % 5 = 0 UNION
  SELECT o_orderkey, 'MISSING_EVIDENCE:' || c FROM orders, (SELECT unnest({_OF}) AS c) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_OF}[l_suppkey % 4 + 1] = c))
SELECT o_orderkey AS pair_id, coalesce(string_agg(reason, ';' ORDER BY reason), '') AS reasons FROM orders LEFT JOIN r ON o_orderkey = pair_id GROUP BY o_orderkey""")
def verification_rollup(spark, d):
    of = lambda c: F.element_at(F.array(*map(F.lit, support.CATEGORIES)), (F.col(c) % 4 + 1).cast("int"))
    x = table(spark, d, "lineitem").withColumn("pair_id", F.col("l_orderkey"))
    checked = x.select("pair_id", of("l_linenumber").alias("category"), F.when(F.col("l_partkey") % 5 == 0, "UNKNOWN_CITATION").alias("reason"))
    pair = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"))
    found = support.review_reasons(pair, checked, x.select("pair_id", of("l_suppkey").alias("category")))
    return found.select("pair_id", F.array_join("reasons", ";").alias("reasons"))


@plan("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN props WHEN 2 THEN 'oops' ELSE props[:-2] END AS raw FROM events),
 c AS (SELECT event_id, regexp_replace(regexp_replace(raw, '^```json\\s*', ''), '\\s*```$', '') AS c FROM r)
SELECT event_id, CASE WHEN json_valid(c) THEN CAST(json_extract_string(c, '$.k') AS DOUBLE) END AS score, CASE WHEN json_valid(c) THEN 'PARSED' ELSE 'EVALUATION_FAILED' END AS status FROM c""")
def raw_judgements(spark, d):
    props, n = F.col("props"), F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 1, props).when(n == 2, "oops").otherwise(F.left(props, F.length(props) - 1))
    x = table(spark, d, "events").select("event_id", support.judged(raw, "k double", "k").alias("j"))
    return x.select("event_id", F.col("j.fields.k").alias("score"), "j.status")


STAGES = f"""{PAIRS}, st AS (SELECT *, CASE pair_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'FAIL' WHEN 2 THEN 'REVIEW' ELSE 'PASS' END AS rules, pair_id % 17 <> 0 AS readable, CASE pair_id % 3 WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'REVIEW_REQUIRED' END AS judged FROM pairs),
 pl AS (SELECT *, CASE WHEN able THEN sum(able::INT) OVER (PARTITION BY job ORDER BY score DESC, pair_id ROWS UNBOUNDED PRECEDING) END AS place FROM (SELECT *, eligible AND readable AND coalesce(rules <> 'FAIL', false) AS able FROM st)),
 oc AS (SELECT *, CASE WHEN rules IS NULL THEN 'PROCESSING_FAILED' WHEN rules = 'FAIL' THEN 'FILTER_REJECTED' WHEN NOT readable THEN 'EXTRACTION_FAILED' WHEN place <= 15 THEN coalesce(judged, 'EVALUATION_FAILED')
  WHEN rules = 'REVIEW' THEN 'REVIEW_REQUIRED' ELSE 'CUTOFF_EXCLUDED' END AS outcome FROM pl)"""


def _outcomes(spark, d):
    k, rules = F.col("pair_id"), F.col("rules")
    x = pairs(spark, d).withColumn("rules", F.when(k % 10 == 1, "FAIL").when(k % 10 == 2, "REVIEW").when(k % 10 > 2, "PASS")).withColumn("readable", k % 17 != 0)
    able = F.col("eligible") & F.col("readable") & F.coalesce(rules != "FAIL", F.lit(False))
    w = Window.partitionBy("job").orderBy(F.desc("score"), "pair_id")
    first = x.where(able).select("pair_id", F.row_number().over(w).alias("place")).where("place <= 15")  # only the first of each job have a place, found before the shuffle
    x = x.join(first, "pair_id", "left")
    judged = F.when(k % 3 == 1, "SUCCESS").when(k % 3 == 2, "REVIEW_REQUIRED")
    return x.withColumn("outcome", cascade.outcome(rules, F.col("readable"), F.col("place"), 15, rules == "REVIEW", judged))


@plan(f"WITH {STAGES} SELECT pair_id, job, outcome FROM oc")
def cascade_outcomes(spark, d):
    return _outcomes(spark, d).select("pair_id", "job", "outcome")


@plan(f"""WITH {STAGES} SELECT job, count(*) AS total, count(*) FILTER (rules IN ('PASS', 'REVIEW')) AS stage1_kept, count(*) FILTER (rules = 'FAIL') AS stage1_rejected, count(*) FILTER (rules IS NULL) AS stage1_failed,
 count(*) FILTER (place <= 15) AS shortlisted, count(*) FILTER (place <= 15 AND outcome = 'SUCCESS') AS succeeded, count(*) FILTER (outcome = 'CUTOFF_EXCLUDED') AS excluded FROM oc GROUP BY job""")
def pipeline_counters(spark, d):
    rules, outcome, taken = F.col("rules"), F.col("outcome"), F.col("place") <= 15
    names = {
        "stage1_kept": rules.isin("PASS", "REVIEW"), "stage1_rejected": rules == "FAIL", "stage1_failed": rules.isNull(), "shortlisted": taken, "succeeded": taken & (outcome == "SUCCESS"),
        "excluded": outcome == "CUTOFF_EXCLUDED",
    }
    return cascade.counters(_outcomes(spark, d), names, ["job"])


@plan("""SELECT draft, CASE WHEN gone THEN 'EXPIRED' ELSE status END AS status, CASE WHEN NOT gone THEN o_orderpriority END AS payload FROM (SELECT *, status <> 'APPROVED' AND date_diff('day', o_orderdate::DATE, DATE '1998-01-01') >= 7 AS gone
 FROM (SELECT *, o_orderkey AS draft, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' ELSE 'READY' END AS status FROM orders))""")
def draft_expiry(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("draft"), F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("READY").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("payload"))
    return cascade.drafts(x, F.lit("1998-01-01").cast("date")).drop("created")


@plan("""SELECT c_custkey AS doc_id, unnest(['auth', 'years']) AS rule, unnest([CASE WHEN c_custkey % 3 = 0 THEN 'PASS' ELSE a END, CASE WHEN c_custkey % 3 = 1 THEN 'FAIL' ELSE y END]) AS status, unnest([a, y]) AS original
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'REVIEW' ELSE 'PASS' END AS a, CASE WHEN c_acctbal < 3000 THEN 'FAIL' ELSE 'REVIEW' END AS y FROM customer)""")
def effective_checks(spark, d):
    k = F.col("c_custkey")
    check = lambda rule, yes, one, other: F.struct(F.lit(rule).alias("rule"), F.when(yes, one).otherwise(other).alias("status"))
    given = F.array(check("auth", k % 2 == 0, "REVIEW", "PASS"), check("years", F.col("c_acctbal") < 3000, "FAIL", "REVIEW"))
    verified = F.when(k % 3 == 0, F.create_map(F.lit("auth"), F.lit("PASS"))).when(k % 3 == 1, F.create_map(F.lit("years"), F.lit("FAIL")))
    return table(spark, d, "customer").select(k.alias("doc_id"), F.inline(cascade.effective_checks(given, verified)))


@plan(f"WITH {PAIRS} SELECT pair_id, job, score FROM pairs WHERE status IN ('SUCCESS', 'REVIEW_REQUIRED') AND score BETWEEN 20 AND 60 AND contains(lower(job), 'urgent') AND responsibility >= 2")
def pool_filter(spark, d):
    spec = {"status": ["SUCCESS", "REVIEW_REQUIRED"], "score": (20, 60), "job": "URGENT", "responsibility": (2, None)}
    return pairs(spark, d).where(cascade.pool_filter(spec)).select("pair_id", "job", "score")


@plan("""SELECT c_custkey AS campaign, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS pairs, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished
FROM customer WHERE (c_nationkey = 3 OR c_custkey IN (SELECT s_suppkey * 3 FROM supplier)) AND contains(lower(c_name), 'customer')""")
def campaign_list(spark, d):
    shared = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"))
    mine = cascade.visible(table(spark, d, "customer"), shared, F.col("c_nationkey") == 3, "c_custkey").where(cascade.pool_filter({"c_name": "Customer"}))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("pairs"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return mine.join(n, "c_custkey", "left").select(F.col("c_custkey").alias("campaign"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("finished", F.lit(0)).alias("finished"))


USED = ("512MiB / 2GiB", "1.5GiB / 2GiB", "300kB / 1GB", "7 MB / 1GB", "what")


@plan(f"""SELECT event_type AS container, count(*) AS samples, round(avg(m), 3) AS mean, round(max(m), 3) AS peak FROM (SELECT *, ([512, 1536, 300000 / 1048576, 7000000 / 1048576, 0])[event_id % {len(USED)} + 1] AS m FROM events) GROUP BY event_type""")
def memory_samples(spark, d):
    text = F.element_at(F.array(*map(F.lit, USED)), (F.col("event_id") % len(USED) + 1).cast("int"))
    x = table(spark, d, "events").select(F.col("event_type").alias("container"), measures.memory_mib(text).alias("m"))
    return x.groupBy("container").agg(F.count("*").alias("samples"), F.round(F.avg("m"), 3).alias("mean"), F.round(F.max("m"), 3).alias("peak"))


@plan(f"WITH {PAIRS} SELECT job, count(*) AS total, count(*) FILTER (eligible AND score >= 20) AS before, count(*) FILTER (eligible AND score >= 30) AS after, count(*) FILTER (score < 30) AS below FROM pairs GROUP BY job")
def policy_replay(spark, d):
    ok, score = F.col("eligible"), F.col("score")
    return cascade.counters(pairs(spark, d), {"before": ok & (score >= 20), "after": ok & (score >= 30), "below": score < 30}, ["job"])
