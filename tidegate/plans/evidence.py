"""Queries over the claim ledger, identity, snapshots and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import diff, identity, ledger
from tidegate.plans import adapters as A
from tidegate.plans.places import HAVERSINE
from tidegate.session import table



def current(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resolve(ledger.active(A.claims(spark, d), F.lit(A.NOW).cast("timestamp")))


_TRUST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ledger.TRUST.items())
CURRENT_SQL = f"""
k AS (SELECT *, CASE source {_TRUST} ELSE 0.5 END::DOUBLE AS trust, CASE class WHEN 'published' THEN 3 WHEN 'observation' THEN 2 ELSE 1 END AS rank
      FROM ({A.CLAIMS_SQL}) WHERE valid_until IS NULL OR valid_until > TIMESTAMP '{A.NOW}'),
o AS (SELECT a.claim_id FROM k a JOIN k b ON a.subject_id = b.subject_id AND a.attribute = b.attribute AND b.value = 'operating' AND b.trust > a.trust AND b.seen_at > a.seen_at GROUP BY 1),
r AS (SELECT k.*, (attribute = 'business_status' AND value LIKE 'closed%' AND confidence >= 0.6 AND o.claim_id IS NULL)::INT AS fst FROM k LEFT JOIN o USING (claim_id)),
w AS (SELECT subject_id, attribute, value AS wv, class AS wc, trust AS wt, seen_at AS ws FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, attribute ORDER BY fst DESC, rank DESC, trust DESC, confidence DESC, seen_at DESC, claim_id) AS n FROM r) WHERE n = 1),
j AS (SELECT r.*, wv, wc, value = wv AS agrees, value <> wv AND (trust >= wt OR seen_at > ws) AS against FROM r JOIN w USING (subject_id, attribute) WHERE class = wc),
v AS (SELECT subject_id, attribute, wv, wc, coalesce(lineage, source) AS voice, max(confidence) FILTER (agrees) AS c, count(*) FILTER (against) AS against, min(valid_until) FILTER (agrees) AS until, count(*) FILTER (agrees) AS claims FROM j GROUP BY ALL),
cur AS (SELECT subject_id, attribute, wv AS value, wc AS class,
  round(greatest(0.05, least(0.97, (1 - coalesce(product(1 - least(0.95::DOUBLE, c::DOUBLE)), 1)) * CASE WHEN sum(against) > 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)), 3) AS confidence,
  count(c) AS independent, sum(against) > 0 AS conflict, min(until) AS valid_until, sum(claims)::BIGINT AS claims FROM v GROUP BY ALL)"""


def evidence_resolve(spark, d):
    return current(spark, d).withColumn("valid_until", F.coalesce(F.date_format("valid_until", "yyyy-MM-dd HH:mm"), F.lit("")))


def evidence_conflicts(spark, d):
    return current(spark, d).groupBy("subject_id").agg(F.count_if("conflict").alias("conflicts"), F.min("confidence").alias("weakest")).where((F.col("conflicts") > 0) | (F.col("weakest") < 0.3))


def facts_document(spark, d):
    docs = ledger.documents_of(current(spark, d))
    return docs.select("subject_id", F.size("facts").alias("n"), F.coalesce(F.col("facts")["business_status"]["value"], F.lit("")).alias("status"), F.array_join(F.map_keys("facts"), ",").alias("attributes"))


def ledger_supersede(spark, d):
    done = ledger.superseded(A.claims(spark, d))
    return done.select("claim_id", "value", F.coalesce(F.date_format("superseded_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("superseded_at"))


def ledger_retract_except(spark, d):
    c = A.claims(spark, d)
    old, batch = c.where("claim_id % 2 = 0"), c.where("claim_id % 2 = 1")
    return ledger.retract_except(old, batch, ["subject_id", "source"]).select("claim_id", "subject_id", "attribute")


def publish_state(spark, d):
    subjects = spark.range(420).select(F.col("id").alias("subject_id"))
    return ledger.publish_state(subjects, current(spark, d))


STATE_SQL = "st AS (SELECT s.range AS subject_id, CASE WHEN max(value) FILTER (attribute = 'business_status') = 'closed_permanently' THEN 'excluded' WHEN count(cur.subject_id) = 0 THEN 'candidate' ELSE 'eligible' END AS state FROM range(420) s LEFT JOIN cur ON cur.subject_id = s.range GROUP BY ALL)"


def verification_queue(spark, d):
    return ledger.verification_queue(current(spark, d), publish_state(spark, d), ["business_status", "click", "admission"])


def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    old, new = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    rows = ledger.latest_wins(old.withColumn("v", F.struct("o_orderdate", "o_orderkey")), new.withColumn("v", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "v")
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("version"), F.col("o_orderstatus").alias("body"))
    new = o.where("o_orderkey % 10 > 1").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 + F.col("o_orderkey") % 3 - 1).cast("int").alias("version"), F.when(F.col("o_orderkey") % 4 == 0, F.concat("o_orderstatus", F.lit("x"))).otherwise(F.col("o_orderstatus")).alias("body"))
    return old, new


def snapshot_diff(spark, d):
    return diff.snapshot_diff(*_snapshots(spark, d))


def listing_withdraw(spark, d):
    occ = A.occurrences(spark, d)
    listed = occ.where("occ_id % 3 <> 0").select("occ_id")
    gone = diff.withdrawn(occ, listed, "occ_id", F.lit("1996-01-01").cast("timestamp"))
    return gone.select("occ_id", "venue_id")


def pair_scores(spark, d):
    return identity.every_pair(A.listings(spark, d)).select("a_id", "b_id", "score", "relation", identity.band(F.col("score")).alias("band"))


def _known_links(spark, d):
    """Links of earlier runs: some records to entities of their own numbering."""
    return A.listings(spark, d).where("record_id % 41 = 0").select("record_id", (-F.col("record_id")).alias("entity_id"))


def identity_resolve(spark, d):
    records = A.listings(spark, d)
    return identity.resolve(records, identity.deciding_pairs(records), _known_links(spark, d))


def identity_parents(spark, d):
    return identity.best_parents(A.listings(spark, d))


def create_if_nothing_near(spark, d):
    rows = A.listings(spark, d)
    return identity.nothing_near(rows.where("record_id % 2 = 1"), rows.where("record_id % 2 = 0"))


def event_site_reuse(spark, d):
    rows = A.listings(spark, d)
    side = lambda p, odd: rows.where(F.col("record_id") % 2 == odd).select(F.col("record_id").alias(f"{p}_id"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), text.match_key(F.col("name")).alias(f"{p}_key"))
    return identity.event_sites(side("a", 1), side("b", 0)).select("a_id", F.coalesce("b_id", F.lit(-1)).alias("b_id"))


def merge_pointers(spark, d):
    k = F.col("c_custkey")
    pointers = table(spark, d, "customer").where(k % 3 != 0).select(k.alias("id"), (k + 1).alias("into"))
    return identity.followed(pointers.unionByName(table(spark, d, "customer").where(k % 6 == 0).select(k.alias("id"), (k + 1).alias("into"))))


def merge_and_split(spark, d):
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").cast("long").alias("entity_id"))
    o = table(spark, d, "orders")
    merges = o.where("o_orderkey % 50 <> 1").select(F.col("o_orderkey").alias("seq"), F.lit("merge").alias("kind"), (F.col("o_orderkey") % 25).cast("long").alias("subject"), (F.col("o_orderkey") % 7).cast("long").alias("entity_id"))
    splits = o.where("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("seq"), F.lit("split").alias("kind"), F.col("o_custkey").alias("subject"), (F.lit(1000000) + F.col("o_orderkey")).cast("long").alias("entity_id"))
    return identity.decided(links, merges.unionByName(splits))


def name_key(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit("The "), "p_name", F.lit(" & Café, Inc. St."))
    return p.select("p_partkey", text.match_key(raw).alias("k"), F.array_join(text.tokens(text.name_key(raw)), " ").alias("t"))


def chain_prefix(spark, d):
    chains = spark.createDataFrame([("supplier 000000001",), ("supplier",), ("customer 1",)], "chain string")
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(text.name_prefixes(text.match_key(F.col("s_name")))).alias("chain"))
    return s.join(F.broadcast(chains), "chain").groupBy("s_suppkey").agg(F.max(F.length("chain")).alias("longest"))


def fuzzy_same_show(spark, d):
    occ = A.occurrences(spark, d).withColumn("title", F.concat(F.lit("Show "), (F.col("occ_id") % 3).cast("string"), F.when(F.col("occ_id") % 5 == 0, " with guests").otherwise("")))
    slot = F.floor(F.unix_millis("start_at") / 1_800_000).cast("long")
    a = occ.select(F.col("occ_id").alias("a_id"), "venue_id", F.col("start_at").alias("a_at"), text.title_words(F.col("title")).alias("aw"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = occ.select(F.col("occ_id").alias("b_id"), "venue_id", F.col("start_at").alias("b_at"), text.title_words(F.col("title")).alias("bw"), slot.alias("slot"))
    near = (F.col("a_id") < F.col("b_id")) & (F.abs(F.unix_millis("a_at") - F.unix_millis("b_at")) <= 1_800_000)
    return a.join(b, ["venue_id", "slot"]).where(near & text.same_show(F.col("aw"), F.col("bw"))).select("a_id", "b_id")


QUERIES = {
    "evidence_resolve": evidence_resolve, "evidence_conflicts": evidence_conflicts, "facts_document": facts_document, "ledger_supersede": ledger_supersede, "ledger_retract_except": ledger_retract_except,
    "publish_state": publish_state, "verification_queue": verification_queue, "upsert_latest": upsert_latest, "snapshot_diff": snapshot_diff, "listing_withdraw": listing_withdraw, "pair_scores": pair_scores,
    "identity_resolve": identity_resolve, "identity_parents": identity_parents, "create_if_nothing_near": create_if_nothing_near, "event_site_reuse": event_site_reuse, "merge_pointers": merge_pointers,
    "merge_and_split": merge_and_split, "name_key": name_key, "chain_prefix": chain_prefix, "fuzzy_same_show": fuzzy_same_show,
}
_PAIR = rf"""l AS ({A.LISTINGS_SQL}),
m AS (SELECT a.id AS a_id, b.id AS b_id, a.key AS ka, b.key AS kb, a.category = b.category AS same_kind, coalesce(a.brand, b.brand) IS NOT NULL AS chain, a.site = b.site AS site, a.phone = b.phone AS phone,
  CASE WHEN a.address = b.address THEN 0.3::DOUBLE WHEN a.address <> b.address THEN -0.6::DOUBLE ELSE 0 END AS address, coalesce(a.xid = b.xid, false) AS known, {HAVERSINE.format(a='a.', b='b.')} AS metres FROM l a JOIN l b ON a.id <> b.id),
t AS (SELECT *, string_split(ka, ' ') AS ta, string_split(kb, ' ') AS tb, ka <> kb AND (contains(ka, kb) OR contains(kb, ka)) AS inside, CASE WHEN length(ka) > length(kb) THEN replace(ka, kb, '') ELSE replace(kb, ka, '') END AS extra FROM m WHERE metres <= 250),
s AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE AS j FROM t),
w AS (SELECT *, round(CASE WHEN ka = kb THEN 0.45 WHEN j >= 0.6 THEN 0.3 WHEN inside THEN 0.25 WHEN j >= 0.34 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN metres < 25 THEN 0.3 WHEN metres < 75 THEN 0.2 WHEN metres < 150 THEN 0.1 ELSE 0 END::DOUBLE
  + CASE WHEN same_kind THEN 0.1 ELSE -0.25 END::DOUBLE + CASE WHEN site THEN CASE WHEN chain THEN 0.05 ELSE 0.3 END ELSE 0 END::DOUBLE + CASE WHEN phone THEN CASE WHEN chain THEN 0.05 ELSE 0.25 END ELSE 0 END::DOUBLE + address, 3) AS total,
  inside AND NOT same_kind AND metres < 120 AND regexp_matches(extra, '\bcafe\b') AS child FROM s),
q AS (SELECT a_id, b_id, metres, ka, kb, CASE WHEN known THEN 1.0::DOUBLE WHEN child THEN least(total, 0.54::DOUBLE) ELSE total END AS score,
  CASE WHEN known THEN 'same' WHEN child THEN 'child_of' WHEN total >= 0.85 THEN 'same' ELSE 'different' END AS relation FROM w)"""

ORACLES = {
    "evidence_resolve": f"WITH {CURRENT_SQL} SELECT subject_id, attribute, value, class, confidence, independent, conflict, coalesce(strftime(valid_until, '%Y-%m-%d %H:%M'), '') AS valid_until, claims FROM cur",
    "evidence_conflicts": f"WITH {CURRENT_SQL} SELECT subject_id, count(*) FILTER (conflict) AS conflicts, min(confidence) AS weakest FROM cur GROUP BY 1 HAVING count(*) FILTER (conflict) > 0 OR min(confidence) < 0.3",
    "facts_document": f"WITH {CURRENT_SQL} SELECT subject_id, count(*)::INT AS n, coalesce(max(value) FILTER (attribute = 'business_status'), '') AS status, string_agg(attribute, ',' ORDER BY attribute) AS attributes FROM cur GROUP BY 1",
    "ledger_supersede": f"""WITH c AS (SELECT *, lag(value) OVER (PARTITION BY subject_id, attribute, source, lineage ORDER BY seen_at, claim_id) AS b FROM ({A.CLAIMS_SQL}) WHERE class <> 'observation'),
      k AS (SELECT *, lead(seen_at) OVER (PARTITION BY subject_id, attribute, source, lineage ORDER BY seen_at, claim_id) AS s FROM c WHERE b IS NULL OR b <> value)
      SELECT claim_id, value, coalesce(strftime(s, '%Y-%m-%d %H:%M:%S'), '') AS superseded_at FROM k""",
    "ledger_retract_except": f"""WITH c AS ({A.CLAIMS_SQL}), o AS (SELECT * FROM c WHERE claim_id % 2 = 0), b AS (SELECT * FROM c WHERE claim_id % 2 = 1)
      SELECT claim_id, subject_id, attribute FROM o WHERE EXISTS (SELECT 1 FROM b WHERE b.subject_id = o.subject_id AND b.source = o.source) AND NOT EXISTS (SELECT 1 FROM b WHERE b.subject_id = o.subject_id AND b.source = o.source AND b.attribute = o.attribute)""",
    "publish_state": f"WITH {CURRENT_SQL}, {STATE_SQL} SELECT * FROM st",
    "verification_queue": f"""WITH {CURRENT_SQL}, {STATE_SQL}, a AS (SELECT subject_id, unnest(['business_status', 'click', 'admission']) AS attribute FROM st WHERE state = 'eligible')
      SELECT subject_id, attribute, round(CASE attribute WHEN 'business_status' THEN 1.0::DOUBLE WHEN 'admission' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * (1 - coalesce(confidence, 0.0)), 3) AS priority, 'venue:' || subject_id || ':' || attribute AS dedupe_key
      FROM a LEFT JOIN cur USING (subject_id, attribute) WHERE coalesce(confidence, 0.0) < 0.5""",
    "upsert_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "snapshot_diff": """WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 5)::INT AS version, o_orderstatus AS body FROM orders WHERE o_orderkey % 10 < 8),
      n AS (SELECT o_orderkey AS id, (o_orderkey % 5 + o_orderkey % 3 - 1)::INT AS version, o_orderstatus || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END AS body FROM orders WHERE o_orderkey % 10 > 1)
      SELECT id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'absent' WHEN n.version < o.version THEN 'older' WHEN n.body = o.body THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id)""",
    "listing_withdraw": f"SELECT occ_id, venue_id FROM ({A.OCC_SQL}) WHERE occ_id % 3 = 0 AND status = 'scheduled' AND coalesce(end_at, start_at + INTERVAL 2 HOUR) > TIMESTAMP '1996-01-01'",
    "pair_scores": f"WITH {_PAIR} SELECT a_id, b_id, score, relation, CASE WHEN score >= 0.85 THEN 'auto' WHEN score >= 0.55 THEN 'review' ELSE 'new' END AS band FROM q WHERE a_id < b_id",
    "identity_resolve": f"""WITH RECURSIVE {_PAIR}, best AS (SELECT b_id AS id, max(score) AS score, arg_min(a_id, (-score, a_id)) AS back FROM q WHERE a_id < b_id GROUP BY 1),
      p AS (SELECT l.id, CASE WHEN l.id % 41 = 0 THEN 'linked' WHEN score >= 0.85 THEN 'auto' WHEN score >= 0.55 THEN 'review' ELSE 'new' END AS how, CASE WHEN l.id % 41 <> 0 AND score >= 0.85 THEN back END AS up FROM l LEFT JOIN best USING (id)),
      f AS (SELECT id, id AS here, up, how FROM p UNION ALL SELECT f.id, p.id, p.up, f.how FROM f JOIN p ON p.id = f.up)
      SELECT id AS record_id, CASE WHEN here % 41 = 0 THEN -here ELSE here END AS entity_id, how FROM f WHERE up IS NULL""",
    "identity_parents": f"WITH {_PAIR} SELECT b_id AS record_id, arg_min(a_id, (-score, a_id)) AS parent_id FROM q WHERE relation = 'child_of' AND a_id < b_id GROUP BY 1",
    "create_if_nothing_near": f"WITH {_PAIR} SELECT id AS record_id FROM l WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM q WHERE a_id = id AND b_id % 2 = 0 AND score >= 0.55)",
    "event_site_reuse": f"WITH {_PAIR}, n AS (SELECT a_id, arg_min(b_id, (metres, b_id)) AS b_id FROM q WHERE a_id % 2 = 1 AND b_id % 2 = 0 AND metres <= 75 AND ka = kb GROUP BY 1) SELECT id AS a_id, coalesce(b_id, -1) AS b_id FROM l LEFT JOIN n ON a_id = id WHERE id % 2 = 1",
    "merge_pointers": "WITH RECURSIVE p AS (SELECT c_custkey AS id, c_custkey + 1 AS nxt FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 6 = 0), f AS (SELECT id, nxt AS here, 1 AS hops FROM p UNION ALL SELECT f.id, p.nxt, hops + 1 FROM f JOIN p ON p.id = f.here WHERE hops < 5) SELECT id, arg_max(here, hops) AS last FROM f GROUP BY 1",
    "merge_and_split": "WITH m AS (SELECT o_orderkey % 25 AS e, arg_max(o_orderkey % 7, o_orderkey) AS t FROM orders WHERE o_orderkey % 50 <> 1 GROUP BY 1), s AS (SELECT o_custkey AS k, arg_max(1000000 + o_orderkey, o_orderkey) AS t FROM orders WHERE o_orderkey % 50 = 1 GROUP BY 1) SELECT c_custkey AS record_id, coalesce(s.t, m.t, c_nationkey)::BIGINT AS entity_id FROM customer LEFT JOIN m ON e = c_nationkey LEFT JOIN s ON k = c_custkey",
    "name_key": r"""WITH k AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower('The ' || p_name || ' & Café, Inc. St.')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(the|inc|llc|ltd|co)\b', ' ', 'g'), ' +', ' ', 'g')) AS k FROM part)
      SELECT p_partkey, array_to_string(list_transform(string_split(k, ' '), lambda w: CASE w WHEN 'st' THEN 'street' ELSE w END), ' ') AS k,
      array_to_string(list_transform(list_filter(list_zip(string_split(k, ' '), range(1, 99)), lambda z: length(z[1]) > 1 AND list_position(string_split(k, ' '), z[1]) = z[2]), lambda z: z[1]), ' ') AS t FROM k""",
    "chain_prefix": r"""WITH k AS (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier), c AS (SELECT unnest(['supplier 000000001', 'supplier', 'customer 1']) AS chain)
      SELECT s_suppkey, max(length(chain))::INT AS longest FROM k JOIN c ON k = chain OR starts_with(k, chain || ' ') GROUP BY 1""",
    "fuzzy_same_show": f"""WITH o AS (SELECT occ_id, venue_id, start_at, occ_id % 3 AS n FROM ({A.OCC_SQL}))
      SELECT a.occ_id AS a_id, b.occ_id AS b_id FROM o a JOIN o b ON a.venue_id = b.venue_id AND a.occ_id < b.occ_id AND a.n = b.n AND abs(epoch_ms(a.start_at) - epoch_ms(b.start_at)) <= 1800000""",
}
