"""Queries over guardrails, routing, caches, usage features, evaluation, costs, memory and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answering as a
from ..operators import feedback as fb
from ..streaming import stateful
from .base import count_tokens, query, table, tok
from .strategies import adaptive_route

_RE = {k: v.replace("'", "''") for k, v in a.PII.items()}


@query(" UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS entity, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{v}')) AS m FROM conversations) GROUP BY ALL" for k, v in _RE.items() if k != "CREDIT_CARD"))
def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by kind in conversations (card numbers apart: word boundaries differ between engines)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.explode(a.pii_spans(F.col("text"))).alias("s")).groupBy("conv_id", "turn", F.col("s.entity").alias("entity")).agg(F.count("*").alias("n")).where("entity <> 'CREDIT_CARD'")


@query()
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", a.redact_pii(F.col("text")).alias("text"))


@query()
def pii_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds in documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(a.pii_spans(F.col("text"))).alias("s")).groupBy("doc_id", F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))


_INJ = a.INJECTION.replace("'", "''")


@query(f"SELECT conv_id, turn, regexp_matches(text, '{_INJ}') AS injected, md5(regexp_replace(text, '{_INJ}', '[removed]', 'g')) AS digest FROM conversations")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike(a.INJECTION).alias("injected"), F.md5(a.strip_injection(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{a.TOXIC}') THEN 'toxic_output' END AS reason FROM documents")
def toxicity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.check_output(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer")), pii="off").select("doc_id", "reason")


_HAS_PII = " OR ".join(f"regexp_matches(text, '{v}')" for v in _RE.values())


@query(f"SELECT conv_id, turn, CASE WHEN {count_tokens('text')} > 512 THEN 'query_too_long' WHEN {_HAS_PII} THEN 'pii_in_query' END AS reason FROM conversations WHERE role = 'user'")
def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.check_input(table(spark, sf_dir, "conversations").where("role = 'user'")).select("conv_id", "turn", "reason")


#: A turn's intent by its length and form, and its number of questions.
_INTENT_SQL = "CASE WHEN len(string_split(text, ' ')) > 60 THEN 'comparison' WHEN len(string_split(text, ' ')) > 25 THEN 'other' ELSE 'factoid' END"
_SUB_SQL = "CAST(length(text) - length(replace(text, '?', '')) AS INTEGER)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " "))
    intent = F.when(n > 60, "comparison").when(n > 25, "other").otherwise("factoid")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", intent.alias("intent"), (F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))).alias("n_sub"))


@query(f"SELECT conv_id, turn, CASE WHEN intent IN ('comparison', 'multi_hop', 'howto') OR n_sub > 1 THEN 'fusion' WHEN intent IN ('factoid', 'policy_lookup', 'faq') THEN 'hybrid' ELSE 'hyde' END AS route FROM (SELECT *, {_INTENT_SQL} AS intent, {_SUB_SQL} AS n_sub FROM conversations)")
def adaptive_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", adaptive_route(F.col("intent"), F.col("n_sub")).alias("route"))


@query(f"""SELECT conv_id, turn, CASE WHEN s THEN 'simple' ELSE 'complex' END AS tier, CASE WHEN s THEN 4 ELSE 8 END AS top_n, CASE WHEN s THEN 1500 ELSE 3500 END AS context_tokens
FROM (SELECT conv_id, turn, {_INTENT_SQL} IN ('factoid', 'policy_lookup', 'faq') AND {_SUB_SQL} <= 1 AND 1.0 / turn >= 0.30 AS s FROM (SELECT conv_id, turn + 1 AS t0, turn, text FROM conversations) WHERE turn > 0)""")
def budget_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of turns after the first; confidence falls with the turn."""
    t = _turns(spark, sf_dir).where("turn > 0").withColumn("tier", a.budget_tier(F.col("intent"), F.col("n_sub"), 1.0 / F.col("turn")))
    return t.select("conv_id", "turn", "tier.tier", "tier.top_n", "tier.context_tokens")


@query("""WITH s AS (SELECT user_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)
SELECT user_id AS doc_id, count(*) AS hits, round(count(*) / max(seq), 6) AS popularity_at_last_hit, round(count(*) / (SELECT count(*) FROM s), 6) AS popularity FROM s GROUP BY 1""")
def popularity_last_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.popularity(fb.numbered(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts", "event_id"), "ts", "event_id"))


@query("""SELECT user_id AS doc_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 ELSE -1 END AS DOUBLE) ORDER BY ts, event_id)), lambda f, d: greatest(least(CAST(0.8 AS DOUBLE) * f + CAST(0.2 AS DOUBLE) * d, CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE))), 6) AS feedback_score
FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'click', 'error')) GROUP BY 1""")
def feedback_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click', 'error')")
    value = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0)
    return fb.feedback_score(e.select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id").alias("at"), fb.vote(value).alias("delta")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("user_id", at.alias("at"), F.col("event_id").alias("id"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id AS id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, id, n, [t] AS q, true AS allowed FROM o WHERE n = 1
    UNION ALL SELECT user_id, id, n, CASE WHEN len(l) < 5 THEN list_append(l, t) ELSE l END, len(l) < 5 FROM (SELECT o.user_id, o.id, o.n, o.t, list_filter(s.q, lambda x: o.t - x <= 86400) AS l FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
SELECT user_id, id, allowed FROM s""")
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five admitted events a user and day."""
    return fb.rate_limited(requests(spark, sf_dir), 5, 86_400).select("user_id", "id", "allowed")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 2000),
m AS (SELECT q.vec_id AS query_id, n.vec_id AS seq, round(list_cosine_similarity(q.e, n.e), 6) AS similarity FROM v q JOIN n ON q.label = n.label AND q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, seq, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, seq) AS r FROM m WHERE similarity >= 0.2) WHERE r = 1""")
def semantic_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest vectors as cached questions, the label as entitlement scope; queries are ids divisible by 50."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))
    entries = v.select(F.col("vec_id").alias("seq"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))
    return a.cache_lookup(q, entries, 0.2, own=True)


@query("""SELECT conv_id, turn, turn > min(turn) OVER (PARTITION BY conv_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS hit FROM conversations""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cache within a conversation's scope."""
    c = table(spark, sf_dir, "conversations").withColumn("seq", F.col("turn"))
    return a.response_cache(c, text.cache_key(F.col("conv_id").cast("string"), F.col("text"))).select("conv_id", "turn", "hit")


#: Events as served answers: clicks and purchases are liked, errors disliked; views and sign-ups have no vote.
_SERVED = """s AS (SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS query, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS feedback, value >= 5 AS grounded,
    round(least(value / 100.0, 1.0), 6) AS grounding_score, value < 1 AS abstained, ts FROM events),
p AS (SELECT * FROM s WHERE coalesce(feedback < 0, false) OR NOT grounded OR abstained OR CAST('0x' || substr(md5(trace_id), 1, 8) AS BIGINT) % 10 = 0)"""
_SCORES = """round(coalesce(avg(CASE WHEN grounded THEN grounding_score ELSE 0.0 END), 1.0), 6) AS faithfulness, round(coalesce(avg(CASE WHEN feedback IS NOT NULL THEN CASE WHEN feedback > 0 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS thumbs_up_rate,
    round(coalesce(avg(CASE WHEN abstained THEN 1.0 ELSE 0.0 END), 0.0), 6) AS abstain_rate"""


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    feedback = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1)
    return e.select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("query"), feedback.alias("feedback"), (F.col("value") >= 5).alias("grounded"), F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 6).alias("grounding_score"), (F.col("value") < 1).alias("abstained"), "ts")


@query(f"WITH {_SERVED} SELECT trace_id FROM p")
def traffic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.traffic_sample(served(spark, sf_dir)).select("trace_id")


@query(f"WITH {_SERVED} SELECT query, {_SCORES} FROM p GROUP BY query")
def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.live_scores(fb.traffic_sample(served(spark, sf_dir)), "query")


@query(f"""WITH {_SERVED}, c AS (SELECT {_SCORES} FROM s WHERE query IN ('error', 'view')), b AS (SELECT {_SCORES} FROM s WHERE query NOT IN ('error', 'view')),
m AS (SELECT 'faithfulness' AS metric, b.faithfulness AS was, c.faithfulness AS now, b.faithfulness - c.faithfulness AS d FROM b, c UNION ALL SELECT 'thumbs_up_rate', b.thumbs_up_rate, c.thumbs_up_rate, b.thumbs_up_rate - c.thumbs_up_rate FROM b, c
    UNION ALL SELECT 'abstain_rate', b.abstain_rate, c.abstain_rate, c.abstain_rate - b.abstain_rate FROM b, c)
SELECT metric, was, now FROM m WHERE round(d, 6) > 0.1""")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and views against the other events."""
    s = served(spark, sf_dir)
    bad = F.col("query").isin("error", "view")
    return fb.drift(fb.live_scores(s.where(bad)), fb.live_scores(s.where(~bad)))


@query(f"WITH {_SERVED} SELECT 'prod-' || substr(trace_id, 1, 8) AS id, query, 'answer' AS expect FROM p WHERE coalesce(feedback < 0, false) OR NOT grounded")
def promote_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.promote_failures(fb.traffic_sample(served(spark, sf_dir))).select("id", "query", "expect")


@query("""WITH m AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1), t(metric, least) AS (VALUES ('click', 1.0), ('view', 1000000.0))
SELECT metric, value, (SELECT bool_and(coalesce(m2.value, 0.0) >= least) FROM t LEFT JOIN m m2 USING (metric)) AS passed FROM m""")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by metric, and a gate over two thresholds, one of them out of reach."""
    per = table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.create_map("event_type", "value").alias("metrics"))
    m = fb.aggregate_metrics(per)
    passed = fb.gate(m, {"click": 1.0, "view": 1_000_000.0})
    return m.join(F.broadcast(passed), F.lit(True))  # one row


_RATES = "CASE role WHEN 'user' THEN {0} WHEN 'assistant' THEN {1} ELSE {2} END"


@query(f"""SELECT role, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t / 1000.0 * {_RATES.format(0.0025, 0.00015, 0.00005)} + t / 2 / 1000.0 * {_RATES.format(0.01, 0.0006, 0.00015)}), 6) AS cost
FROM (SELECT role, {count_tokens('text')} AS t FROM conversations) GROUP BY role""")
def cost_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by a large model, assistants by a small one, others at the local rate."""
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "gpt-4o-mini").otherwise("other")
    t = table(spark, sf_dir, "conversations").select("role", model.alias("model"), text.count_tokens(F.col("text")).alias("t"))
    return t.groupBy("role").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.round(F.sum(fb.cost(F.col("model"), F.col("t"), F.col("t") / 2)), 6).alias("cost"))


@query("SELECT 'events{hour=' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ',type=' || event_type || '}' AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("hour"), F.lpad(F.hour("ts").cast("string"), 2, "0"))
    return fb.metric_rollup(e.select(F.lit("events").alias("name"), labels.alias("labels"), "value")).select("key", "n", F.round("total", 4).alias("total"))


@query(f"SELECT conv_id AS trace_id, CAST(sum({count_tokens('text')}) AS BIGINT) AS tokens, count(*) AS spans, CAST(max(CASE WHEN turn = 0 THEN length(text) END) AS DOUBLE) AS ms FROM conversations GROUP BY 1")
def trace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a trace, its turns as spans below the first."""
    c = table(spark, sf_dir, "conversations")
    spans = c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, 0).alias("parent_id"), text.count_tokens(F.col("text")).alias("tokens"), F.lit(0.0).alias("cost"), F.length("text").cast("double").alias("ms"))
    return fb.trace_totals(spans).select("trace_id", "tokens", "spans", "ms")


@query(f"""WITH q AS (SELECT conv_id, turn, {tok('text')} AS t FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, text AS fact, {tok('text')} AS t FROM conversations WHERE role <> 'user'),
m AS (SELECT q.conv_id, turn, fact, len(list_intersect(list_distinct(q.t), list_distinct(f.t))) AS score FROM q JOIN f ON q.conv_id = f.conv_id)
SELECT conv_id AS user, turn AS query_id, fact, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, fact DESC) AS place FROM m WHERE score > 0) WHERE place <= 3""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's other turns as facts, its user turns as questions."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select(F.col("conv_id").alias("user"), F.col("turn").alias("query_id"), F.col("text").alias("query"))
    return fb.memory_recall(q, c.where("role <> 'user'").select(F.col("conv_id").alias("user"), F.col("text").alias("fact")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.tumbling(e, "1 hour", None, "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 9999 ELSE greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01'), 0) END AS freshness_days,
    coalesce(CASE o_orderstatus WHEN 'O' THEN 'official' WHEN 'P' THEN 'deprecated' END, 'draft') AS authority FROM orders""")
def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: finished ones have no readable date."""
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "official").when(F.col("o_orderstatus") == "P", "deprecated").alias("authority"), F.when(F.col("o_orderstatus") == "F", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("freshness_date"), F.lit(None).cast("string").alias("doc_type"))
    return fb.document_features(d, F.lit("1998-01-01").cast("date")).select("doc_id", F.col("freshness_days").cast("long").alias("freshness_days"), "authority")


#: Orders as messages that hold an address, a number to call, a social security number, or a toxic phrase, by their key.
_MESSAGE_SQL = """m AS (SELECT o_orderkey AS id, 'order ' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN ' mail a.b' || o_custkey || '@shop.example now' WHEN 1 THEN ' call 555-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-4567 now'
    WHEN 2 THEN ' ssn 123-45-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || ' now' WHEN 3 THEN ' go kill yourself now' ELSE ' thank you' END AS text FROM orders)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tail = (
        F.when(key % 5 == 0, F.concat(F.lit(" mail a.b"), cust.cast("string"), F.lit("@shop.example now")))
        .when(key % 5 == 1, F.concat(F.lit(" call 555-"), F.lpad((cust % 1000).cast("string"), 3, "0"), F.lit("-4567 now")))
        .when(key % 5 == 2, F.concat(F.lit(" ssn 123-45-"), F.lpad((cust % 10000).cast("string"), 4, "0"), F.lit(" now")))
        .when(key % 5 == 3, F.lit(" go kill yourself now"))
        .otherwise(F.lit(" thank you"))
    )
    return o.select(key.alias("id"), F.concat(F.lit("order "), key.cast("string"), tail).alias("text"))


_KINDS = " UNION ALL ".join(f"SELECT id, '{k}' AS entity, unnest(regexp_extract_all(text, '{v}')) AS found FROM m" for k, v in _RE.items() if k != "CREDIT_CARD")


@query(f"WITH {_MESSAGE_SQL} SELECT id, entity, found FROM ({_KINDS})")
def pii_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of personal data in messages that hold it (card numbers apart: word boundaries differ between engines)."""
    spans = messages(spark, sf_dir).select("id", F.explode(a.pii_spans(F.col("text"))).alias("s"))
    return spans.select("id", "s.entity", F.col("s.match").alias("found")).where("entity <> 'CREDIT_CARD'")


@query(f"""WITH {_MESSAGE_SQL} SELECT id, CASE WHEN regexp_matches(text, '{a.TOXIC}') THEN 'toxic_output' END AS reason,
    CASE WHEN regexp_matches(text, '{a.TOXIC}') THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(text, '{_RE["EMAIL"]}', '[REDACTED_EMAIL]', 'g'), '{_RE["PHONE"]}', '[REDACTED_PHONE]', 'g'), '{_RE["SSN"]}', '[REDACTED_SSN]', 'g') END AS safe FROM m""")
def output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked before they leave: toxic ones blocked, personal data redacted."""
    return a.check_output(messages(spark, sf_dir).withColumnRenamed("text", "answer")).select("id", "reason", "safe")


@query("SELECT 'events{type=\"' || event_type || '\"} ' || count(*) || '.0' AS line FROM events GROUP BY event_type")
def metric_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return fb.exposition(e.select(F.lit("events").alias("name"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"), F.lit(1.0).alias("value")))
