"""Registered queries over logs in files and streams, tables that grow by batches, policies as tables, and numbers in large groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _LOG_SQL, ORACLE_SQL, QUERIES, _log, _query, _sql, _table, _texts  # noqa: F401
from .functions import text as T
from .operators import audit, literals, numbering, policy_table, scan
from .sources import buckets, chains, folders
from .streaming import chains as stream
from .workers import dealt

#: Metadata as it comes, and the canonical text that is hashed: floats, accents, nesting, a key that looks like the line's own.
_ODD = """'{"n": ' || cast(event_id as string) || ', "big": 1e20, "at": {"é": [1.0, "ü\\\\n"]}, "previous_hash": {"x": -0.5}, "kind": "' || event_type || '"}'"""
_HEADS = """
s AS (SELECT user_id, list(struct_pack(a := '{{"event":"' || event || '","event_id":"evt_' || lpad(seq::VARCHAR, 6, '0') || '","metadata":' || {metadata} || ',"previous_hash":"',
    b := '","session_id":"' || session_id || '","timestamp":"' || timestamp || '"}}') ORDER BY seq) AS es FROM q GROUP BY user_id)
SELECT {key} AS chain, CAST(len(es) AS BIGINT) AS n_events, true AS ok, len(es) || ' audit events verified' AS message,
  list_reduce(list_prepend(struct_pack(a := repeat('0', 64), b := ''), es), lambda h, e: struct_pack(a := sha256(e.a || h.a || e.b), b := '')).a AS head FROM s"""
_CANONICAL = """'{"at":{"\\u00e9":[1.0,"\\u00fc\\n"]},"big":1e+20,"kind":"' || event_type || '","n":' || n || ',"previous_hash":{"x":-0.5}}'"""


@_query(f"WITH {_LOG_SQL.replace('FROM events)', ', event_type FROM events)', 1)}," + _HEADS.format(metadata=_CANONICAL, key="'s' || user_id"))
def chain_log(spark, sf_dir):
    """A log of a chain per session, appended twice in files, read and verified from them."""
    log = chains.ChainLog(spark, folders.shared(spark, "log"))
    events = _log(spark, sf_dir, "event_type").withColumnRenamed("n", "event_id").withColumn("metadata", F.expr(_ODD))
    half = events.agg(F.avg("event_id")).first()[0] or 0
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        log.append(events.where(part), "event_id")
    return log.verify()


@_query(f"WITH {_LOG_SQL}," + _HEADS.format(metadata="""'{"finding_type":"' || kind || '","n":' || n || ',"recommended_action":"' || action || '"}'""", key="CAST(user_id AS VARCHAR)"))
def stream_chains(spark, sf_dir):
    """The chains of all users verified as a stream of files whose events come in no order, in two batches."""
    folder = folders.shared(spark, "stream")
    log = audit.append(_log(spark, sf_dir), "user_id", "n")
    log.repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("hash")).write.parquet(f"{folder}/in")
    half = -(-len(spark.read.parquet(f"{folder}/in").inputFiles()) // 2)
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", max(1, half)).parquet(f"{folder}/in")

    def keep(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    query = stream.verify_stream(events, "user_id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    newest = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("batch"), F.desc("n_events")))
    seen = spark.read.parquet(f"{folder}/out").withColumn("_k", newest).where("_k = 1")
    return seen.select("chain", "n_events", "ok", "message", "head")


@_query("""
WITH p AS (SELECT p_partkey AS id, 't' || p_partkey % 20 AS tenant, 'dir' || p_partkey % 37 || '/' || CASE p_partkey % 5 WHEN 0 THEN 'secrets/' WHEN 1 THEN 'k.pem/' ELSE '' END || 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.key' WHEN 1 THEN '.py' ELSE '.pem' END AS path FROM part),
r AS (SELECT 't' || p_partkey % 20 AS tenant, p_partkey AS rule, CASE p_partkey % 6 WHEN 0 THEN 'dir' || p_partkey % 37 || '/*' WHEN 1 THEN '*f' || p_partkey || '.*' WHEN 2 THEN '**/secrets/**' WHEN 3 THEN '*.key'
  WHEN 4 THEN 'f' || p_partkey || '.py' ELSE 'dir?/[!a]' || p_partkey || '*' END AS pattern FROM part WHERE p_partkey % 7 = 0)
SELECT p.id, count(r.rule) AS n_rules, count(r.rule) > 0 AS denied FROM p LEFT JOIN r ON p.tenant = r.tenant AND (p.path GLOB r.pattern OR string_split(p.path, '/')[-1] GLOB r.pattern) GROUP BY p.id""")
def tenant_denials(spark, sf_dir):
    """Paths held against the glob rules of their own tenants, a seventh as many rules as paths."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    part = dealt(_table(spark, sf_dir, "part"))
    inner, end = F.when(k % 5 == 0, "secrets/").when(k % 5 == 1, "k.pem/").otherwise(""), F.when(k % 3 == 0, ".key").when(k % 3 == 1, ".py").otherwise(".pem")
    paths = part.select(k.alias("id"), text("t", k % 20).alias("tenant"), text("dir", k % 37, "/", inner, "f", k, end).alias("path"))
    pattern = F.when(k % 6 == 0, text("dir", k % 37, "/*")).when(k % 6 == 1, text("*f", k, ".*")).when(k % 6 == 2, "**/secrets/**").when(k % 6 == 3, "*.key")
    pattern = pattern.when(k % 6 == 4, text("f", k, ".py")).otherwise(text("dir?/[!a]", k, "*"))
    rules = part.where(k % 7 == 0).select(text("t", k % 20).alias("tenant"), k.alias("rule"), pattern.alias("pattern"))
    return policy_table.denied(paths, rules).select("id", "n_rules", "denied")


@_query("""
WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS session_id, ts FROM events)
SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM e""")
def event_numbers(spark, sf_dir):
    """Every event's number in its session, where one session holds a third of all events."""
    e = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "user_id")).alias("session_id"), "ts")
    return numbering.numbered_rows(e, ["session_id"], ["ts", "event_id"]).select("event_id", "session_id", F.col("n").cast("long").alias("n"))


@_query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'closed' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE o_orderstatus END AS status,
CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 100 AS BIGINT) END AS findings FROM orders""")
def bucket_upsert(spark, sf_dir):
    """A table of sessions after three batches, the last one sent twice, with a column that the older rows lack."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = buckets.BucketTable(spark, folders.shared(spark, "sessions"), "id", 16)
    table.upsert(o, "first")
    table.upsert(o.where("id % 2 = 0").withColumn("status", F.lit("running")), "second")
    closed = o.where("id % 5 = 0").select("id", F.lit("closed").alias("status"), (F.col("id") % 100).cast("long").alias("findings"))
    for _ in range(2):
        table.upsert(closed, "third")
    return table.read().select("id", "status", "findings")


@_query("""SELECT event_id AS id, CASE event_id % 4 WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS observed, CASE WHEN event_id % 3 = 0 THEN 'not-measured' WHEN event_id % 4 IN (1, 2) THEN 'egress-observed' ELSE 'no-egress-observed' END AS word,
CASE WHEN event_id % 3 = 0 THEN 'not-measured' ELSE 'measured-process' END AS method,
CASE event_id % 4 WHEN 1 THEN '10.0.0.1:443' WHEN 2 THEN '10.0.0.1:443, 10.0.0.2:443, 10.0.0.3:443, 10.0.0.4:443, 10.0.0.5:443 (+2 more)' ELSE 'none observed' END AS endpoints FROM events""")
def egress_words(spark, sf_dir):
    """What is said of the connections that were sampled around each process."""
    n = F.col("event_id") % 4
    many = lambda k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(F.concat(F.lit("10.0.0."), i.cast("string")).alias("remote_ip"), F.lit(443).alias("remote_port")))
    seen = F.when(n == 1, many(1)).when(n == 2, many(7)).when(n == 3, F.filter(many(1), lambda c: F.lit(False)))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), seen.alias("c"), (F.col("event_id") % 3 != 0).alias("m"))
    observed, word, method = T.egress_seen(F.col("c"), F.col("m"))
    return rows.select("id", observed.alias("observed"), word.alias("word"), method.alias("method"), T.endpoints(F.col("c")).alias("endpoints"))


SOURCE = """o_orderkey | case o_orderkey % 4 when 0 then 'k = f"a{v}sk_test_fake' || lpad(cast(o_orderkey as string), 10, '0') || 'b{w}"  # u@example.com' when 1 then 'const m = `x${a.b({c: 1})} u' || cast(o_orderkey as string) || '@example.com ${ b }` + "plain";'
when 2 then 'd = rb"sk_test_fake' || lpad(cast(o_orderkey as string), 10, '0') || '"; e = "sk_test_fake' || lpad(cast(o_orderkey as string), 10, '0') || '"' else 'n = "nothing" # to see' end"""


@_query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'k = f"a{v}[SECRET_1]{w}"  # u@example.com' WHEN 1 THEN 'const m = `x${a.b({c: 1})}[EMAIL_1]${ b }` + "plain";'
WHEN 2 THEN 'd = rb"[SECRET_1]"; e = "[SECRET_1]"' ELSE 'n = "nothing" # to see' END AS redacted_text, CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END::INT AS replacements_count,
CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END::INT AS n_outside FROM orders""")
def source_literals(spark, sf_dir):
    """Lines of Python and JavaScript, redacted within their literals."""
    rows = _texts(spark, sf_dir, "orders", SOURCE)
    out = literals.redact(scan.scan(rows), F.when(F.col("id") % 4 == 1, "javascript").otherwise("python"))
    return out.select("id", "redacted_text", "replacements_count", "n_outside")
