"""Queries on the budget of contexts and on batches of reviews, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.operators import batches, budget, sections
from siftspark.operators.manifests import TURNS
from siftspark.operators.planning import CATEGORIES
from siftspark.sources.shared import stored

from .catalogue import plan
from .relations import table

#: Passages that retrieval returns for a document and category, and characters of a context.
RETRIEVED, LIMIT = 6, 700
_KINDS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
PASSAGES = """u AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '[\\n;]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
 passages AS (SELECT doc_id AS pair_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS idx FROM u)"""
#: The longest passages of each category; every fifth stands in the next category too, every seventh has no id of its own.
KEPT = f"""{PASSAGES},
 q0 AS (SELECT pair_id, idx, text, idx % 4 + 1 AS q FROM passages UNION ALL SELECT pair_id, idx, text, (idx + 1) % 4 + 1 FROM passages WHERE idx % 5 = 0),
 q1 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, q ORDER BY length(text) DESC, idx) AS place FROM q0 QUALIFY place <= {RETRIEVED}),
 q2 AS (SELECT pair_id, list({{'q': q, 'n': place, 'k': CASE WHEN idx % 7 = 0 THEN text ELSE idx || '|' || text END, 's': length(text)}}) AS c, [count(*) FILTER (q = 1), count(*) FILTER (q = 2), count(*) FILTER (q = 3), count(*) FILTER (q = 4)] AS l FROM q1 GROUP BY pair_id),
 q3 AS (SELECT pair_id, 0 AS n, c, l, l AS sizes, []::BIGINT[] AS gone FROM q2
  UNION ALL SELECT pair_id, n + 1, c, list_transform(l, lambda x, i: x - (i = worst)::INT), sizes, list_append(gone, worst) FROM (SELECT *, list_position(totals, list_max(totals)) AS worst FROM (SELECT q3.*, list_transform([1, 2, 3, 4], lambda k: list_sum(list_prepend(0, [x.s for x in c if x.q = k AND x.n <= l[k]]))) AS totals FROM q3
   WHERE list_sum(list_prepend(0, [y.s for y in list_distinct([{{'k': x.k, 's': x.s}} for x in c if x.n <= l[x.q]])])) > {LIMIT}))),
 q4 AS (SELECT *, list_sum(list_prepend(0, [y.s for y in list_distinct([{{'k': x.k, 's': x.s}} for x in c if x.n <= l[x.q]])])) AS used FROM q3 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC) = 1),
 kept AS (SELECT q1.pair_id, {_KINDS}[q] AS category, place, CASE WHEN idx % 7 <> 0 THEN idx END AS chunk_id, [i for i in range(1, len(gone) + 1) if gone[i] = q][CAST(sizes[q] - place + 1 AS INT)] AS omitted, CAST(used AS BIGINT) AS evidence_chars FROM q1 JOIN q4 USING (pair_id))"""


def _passages(spark, d):
    x = sections.passages(table(spark, d, "documents").select("doc_id", "text"))
    return x.select(F.col("doc_id").alias("pair_id"), F.col("passage_no").cast("long").alias("idx"), F.col("passage").alias("text"))


def _budget(passages):
    idx = F.col("idx")
    x = passages.select("*", F.explode(F.when(idx % 5 == 0, F.array(idx % 4, (idx + 1) % 4)).otherwise(F.array(idx % 4))).alias("q"))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "q").orderBy(F.desc(F.length("text")), "idx"))).where(F.col("place") <= RETRIEVED)
    kind = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("q") + 1).cast("int"))
    return budget.within_budget(x.select("pair_id", kind.alias("category"), "place", F.col("pair_id").alias("document_id"), F.when(idx % 7 != 0, idx).alias("chunk_id"), "text"), LIMIT)


@plan(f"WITH RECURSIVE {KEPT} SELECT pair_id, category, place, chunk_id, omitted, evidence_chars FROM kept")
def context_budget(spark, d):
    """What retrieval returned for each document, cut to the budget of its context: the largest category loses its last chunk until the rest fits."""
    return _budget(_passages(spark, d)).drop("document_id")


@plan(f"""WITH RECURSIVE {KEPT},
 s AS (SELECT *, idx // 6 AS section, ([{", ".join(f"'{t}'" for t in TURNS)}])[idx % 5 + 1] AS category, idx % 5 + 1 AS c FROM passages), h AS (SELECT DISTINCT pair_id, chunk_id AS idx FROM kept WHERE omitted IS NULL AND chunk_id IS NOT NULL),
 near AS (SELECT DISTINCT p.pair_id, p.idx FROM s p JOIN h ON h.pair_id = p.pair_id AND h.idx // 6 = p.section AND abs(h.idx - p.idx) <= 1),
 k AS (SELECT s.*, contains(lower(text), 'the') AS must, near.idx IS NOT NULL AS near, row_number() OVER (PARTITION BY pair_id, category ORDER BY idx) AS turn FROM s LEFT JOIN near USING (pair_id, idx)),
 o AS (SELECT pair_id, idx, length(text) AS size, row_number() OVER (PARTITION BY pair_id ORDER BY NOT must, NOT near, CASE WHEN near THEN idx ELSE turn END, CASE WHEN near THEN 0 ELSE c END, idx) AS place FROM k),
 f AS (SELECT pair_id, list({{'i': idx, 's': size}} ORDER BY place) AS l FROM o GROUP BY 1),
 g AS (SELECT pair_id, f.l AS l, list_reduce(list_prepend({{'u': CAST(used AS BIGINT), 'o': []::BOOLEAN[]}}, [{{'u': CAST(x.s AS BIGINT), 'o': []::BOOLEAN[]}} for x in f.l]), lambda a, x: {{'u': CASE WHEN a.u + x.u <= {LIMIT} THEN a.u + x.u ELSE a.u END, 'o': list_append(a.o, a.u + x.u <= {LIMIT})}}).o AS o FROM f JOIN q4 USING (pair_id))
SELECT pair_id, unnest([x.i for x in l]) AS idx, CAST(generate_subscripts(l, 1) AS INT) AS place, unnest(o) AS included FROM g""")
def context_fill(spark, d):
    """What the budget leaves, filled with passages of the document: those with a mandatory term, then those next to a chunk that stays, then all in turn."""
    p = stored(_passages(spark, d), "passages")
    kind = F.element_at(F.array(*map(F.lit, TURNS)), (F.col("idx") % 5 + 1).cast("int"))
    return budget.filled(stored(_budget(p), "budget"), p.select("pair_id", "idx", F.floor(F.col("idx") / 6).alias("section"), kind.alias("category"), "text"), LIMIT, ("the",))


#: One batch for each document, on up to three of some 230 pairs; what it expects rises with its number, and is often stale.
_PAIRS = ("n_chars % 89", "1000 + cast(floor(n_chars / 7) as bigint) % 89", "2000 + doc_id % 53")
_BATCHES = "SELECT doc_id AS batch, (['HOLD', 'NOT_PROCEEDING', 'SHORTLISTED'])[n_chars % 3 + 1] AS decision, CASE WHEN doc_id % 4 <> 0 THEN source ELSE ' ' END AS reason, CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id END AS notes, CASE WHEN doc_id % 5 = 0 THEN lang END AS tags, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN source END AS assignee FROM documents"
REVIEWS = f"""b AS ({_BATCHES}), e AS (SELECT DISTINCT doc_id AS batch, unnest([{", ".join(_PAIRS)}]) AS pair_id, (doc_id * 7 + n_chars) % (2 + doc_id % 9) // 2 AS version FROM documents),
 pairs AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS p FROM (SELECT DISTINCT pair_id FROM e)),
 n AS (SELECT batch, row_number() OVER (ORDER BY batch) AS n, coalesce(decision = 'NOT_PROCEEDING' AND trim(reason) = '', false) AS bad FROM b),
 w AS (SELECT n.n, n.batch, n.bad, list(p) AS ps, list(version) AS vs FROM n JOIN e USING (batch) JOIN pairs USING (pair_id) GROUP BY ALL),
 r AS (SELECT 0::BIGINT AS n, list_transform(range((SELECT count(*) FROM pairs)), lambda x: 0) AS v, NULL::BOOLEAN AS ok
  UNION ALL SELECT w.n, CASE WHEN x.ok THEN list_transform(v, lambda y, i: y + list_contains(ps, i)::INT) ELSE v END, x.ok FROM r JOIN w ON w.n = r.n + 1, LATERAL (SELECT NOT w.bad AND len([i for i in range(1, len(ps) + 1) if v[ps[i]] <> vs[i]]) = 0 AS ok) x),
 decided AS (SELECT w.batch, r.ok AS accepted, CASE WHEN bad THEN 'REASON_REQUIRED' WHEN NOT r.ok THEN 'VERSION_CONFLICT' END AS code FROM w JOIN r USING (n))"""


def _reviews(spark, d):
    docs = table(spark, d, "documents")
    pick = "element_at(array('HOLD', 'NOT_PROCEEDING', 'SHORTLISTED'), cast(n_chars % 3 + 1 as int))"
    b = docs.selectExpr(
        "doc_id as batch", f"{pick} as decision", "if(doc_id % 4 <> 0, source, ' ') as reason", "if(doc_id % 3 = 0, concat('note ', doc_id), null) as notes", "if(doc_id % 5 = 0, lang, null) as tags",
        "case doc_id % 7 when 0 then '' when 1 then source end as assignee",
    )
    e = docs.selectExpr("doc_id as batch", f"explode(array({', '.join(_PAIRS)})) as pair_id", "cast(floor((doc_id * 7 + n_chars) % (2 + doc_id % 9) / 2) as bigint) as version")
    return b, e


@plan(f"WITH RECURSIVE {REVIEWS} SELECT * FROM decided")
def review_batches(spark, d):
    """Which batches of reviews apply, as a whole or not at all."""
    return batches.decided_batches(*_reviews(spark, d))


@plan(f"""WITH RECURSIVE {REVIEWS}, a AS (SELECT b.*, e.pair_id FROM b JOIN decided USING (batch) JOIN e USING (batch) WHERE accepted)
SELECT pair_id, count(*) AS version, max(batch) AS batch, arg_max(decision, batch) AS decision, arg_max(trim(reason), batch) AS reason, arg_max(notes, batch) AS notes, arg_max(tags, batch) AS tags, nullif(arg_max(assignee, batch), '') AS assignee FROM a GROUP BY pair_id""")
def reviews_after_batches(spark, d):
    """The reviews that the accepted batches leave, version by version."""
    b, e = _reviews(spark, d)
    return batches.review_state(b, e, batches.decided_batches(b, e))
