"""Queries on time, state and hosts' rules, each with SQL that gives the same rows; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _table, query
from .operators.acceptance import accepted
from .plans.memo import memoised
from .plans.state_log import StateLog
from .plans.tables import folder
from .sources import robots
from .streaming.timed import progress_lines, reminders_until

_UNTIL = "2024-01-20 00:00:00"


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT user_id, ts, bool_or(event_type = 'purchase') AS must FROM events GROUP BY ALL),
    s AS MATERIALIZED (SELECT user_id, list(ts ORDER BY ts) AS l, list(ts ORDER BY ts) FILTER (WHERE must) AS m FROM f GROUP BY user_id),
    a AS (SELECT user_id, l[1] AS got, l, m FROM s UNION ALL SELECT user_id, nxt, l, m FROM (SELECT user_id, l, m, least(list_filter(l, lambda x: x >= a.got + INTERVAL 24 HOUR)[1], list_filter(coalesce(m, []), lambda x: x > a.got)[1]) AS nxt FROM a) WHERE nxt IS NOT NULL)
    SELECT user_id, CAST(epoch_us(got) AS BIGINT) AS accepted_us FROM a""")
def ttl_force(spark, sf):
    """Accepted times where purchases are forced."""
    got = accepted(_table(spark, sf, "events"), "user_id", forced=F.col("event_type") == "purchase")
    return got.select("user_id", F.unix_micros(F.col("accepted_at").cast("timestamp")).alias("accepted_us"))


_REMINDERS = f"""SELECT user_id AS id, ts, event_id AS seq, CASE WHEN event_type IN ('view', 'error') THEN 'remind' ELSE 'status' END AS kind,
    CASE WHEN event_type = 'view' THEN ts + INTERVAL 1 HOUR * (event_id % 200 - 20) END AS remind_at, CASE event_type WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'interview' WHEN 'signup' THEN 'result' END AS status FROM events"""


@query(f"""WITH e AS (SELECT * FROM ({_REMINDERS}) WHERE ts <= TIMESTAMP '{_UNTIL}'),
    h AS (SELECT *, last_value(CASE WHEN kind = 'remind' THEN struct_pack(s := seq, d := remind_at) END IGNORE NULLS) OVER w AS held, last_value(CASE WHEN kind = 'status' THEN struct_pack(s := status) END IGNORE NULLS) OVER w AS st,
        coalesce(lead(ts) OVER (PARTITION BY id ORDER BY ts, seq), TIMESTAMP '{_UNTIL}') AS nxt FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT id, epoch_us(held.d)::BIGINT AS remind_us, epoch_us(arg_min(greatest(held.d, ts), struct_pack(a := ts, b := seq)))::BIGINT AS fired_us, arg_min(st.s, struct_pack(a := ts, b := seq)) AS status
    FROM h WHERE held.d IS NOT NULL AND st.s IS NOT NULL AND st.s <> 'result' AND held.d <= nxt GROUP BY id, held""")
def reminders_fired(spark, sf):
    """Reminders that have fired until a moment; the stream of the same rule is ``streaming.timed.reminders``."""
    at = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "click", "applied").when(F.col("event_type") == "purchase", "interview").when(F.col("event_type") == "signup", "result")
    kind = F.when(F.col("event_type").isin("view", "error"), "remind").otherwise("status")
    due = F.when(F.col("event_type") == "view", at + F.make_dt_interval(hours=(F.col("event_id") % 200 - 20).cast("int")))
    events = _table(spark, sf, "events").select(F.col("user_id").alias("id"), at.alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), due.alias("remind_at"), status.alias("status"))
    out = reminders_until(events, "id", F.lit(_UNTIL).cast("timestamp"))
    return out.select("id", F.unix_micros("remind_at").alias("remind_us"), F.unix_micros("fired_at").alias("fired_us"), "status")


_LINE = """CASE event_type WHEN 'view' THEN 'Discovering: Board ' || (event_id % 30) WHEN 'click' THEN 'Page 2: 7 links, total ' || (event_id % 900) WHEN 'signup' THEN '[DETAIL MODE] ' || (event_id % 700) || ' new links'
    WHEN 'purchase' THEN '   Parsing detail: [' || (event_id % 50) || '/60] x' ELSE 'warning' END"""


@query(f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events)
    SELECT event_id, CASE WHEN contains(line, 'Discovering:') THEN 'discovery' WHEN contains(line, 'Page') AND contains(line, 'links') THEN 'links' WHEN contains(line, '[DETAIL MODE]') THEN 'detail' WHEN contains(line, 'Parsing detail:') THEN 'pages' END AS phase,
    CASE WHEN contains(line, 'Discovering:') THEN trim(regexp_extract(line, 'Discovering:(.*)$', 1)) END AS source, TRY_CAST(coalesce(nullif(regexp_extract(line, 'total (\\d+)', 1), ''), nullif(regexp_extract(line, '(\\d+) new links', 1), '')) AS INTEGER) AS links,
    TRY_CAST(regexp_extract(line, '\\[(\\d+)/(\\d+)\\]', 1) AS INTEGER) AS step, TRY_CAST(regexp_extract(line, '\\[(\\d+)/(\\d+)\\]', 2) AS INTEGER) AS total FROM l""")
def progress_lines_read(spark, sf):
    """Log lines with what they say of progress; the stream with its pause is ``streaming.timed.progress``."""
    return progress_lines(_table(spark, sf, "events").selectExpr("event_id", f"{_LINE} AS line")).drop("line")


_CHANGES = "SELECT user_id AS id, CASE WHEN event_type <> 'error' THEN event_type END AS value, event_id AS seq, event_id % 2 AS writer, event_id % 4 // 2 AS batch FROM events"


@query(f"SELECT id, v.x AS value FROM (SELECT id, arg_max(struct_pack(x := value), struct_pack(a := batch, b := writer, c := seq)) AS v FROM ({_CHANGES}) GROUP BY id) WHERE v.x IS NOT NULL")
def state_commits(spark, sf):
    """State after two writers' batches in turn, with a batch of each written twice and a snapshot between."""
    changes = _table(spark, sf, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("writer"), F.floor(F.col("event_id") % 4 / 2).alias("batch"))
    log = StateLog(spark, folder(spark, "state_log"))
    sinks = [log.sink(f"writer {w}") for w in (0, 1)]
    for batch, writer in ((0, 0), (0, 1), (0, 0), (1, 0), (0, 1), (1, 1), (1, 0)):
        sinks[writer](changes.where((F.col("writer") == writer) & (F.col("batch") == batch)).select("id", "value", "seq"), batch)
        if (batch, writer) == (1, 0):
            log.compact()
    return log.state()


_AGENT = "recordrank/1.0"
_FILES = ["User-agent: *\nDisallow: /es/\nAllow: /es/1\nDisallow: /de/\nCrawl-delay: 5", "User-agent: other\nDisallow: /\n\nUser-agent: *\n# all\nDisallow: /fr/2\nAllow: /fr/\nDisallow: /*/3", "User-agent: recordrank\nAllow: /en/\nDisallow: /\nCrawl-delay: 7\n\nUser-agent: *\nDisallow: /", None]
_RULES = "(VALUES (0, 1, FALSE, '/es/'), (0, 2, TRUE, '/es/1'), (0, 3, FALSE, '/de/'), (1, 1, FALSE, '/fr/2'), (1, 2, TRUE, '/fr/'), (1, 3, FALSE, '/*/3'), (2, 1, TRUE, '/en/'), (2, 2, FALSE, '/')) AS r(k, place, allow, path)"


@query(f"""WITH p AS (SELECT page_id, length(regexp_extract(url, '//([^/?#]+)', 1)) % 4 AS k, url_decode(regexp_extract(url, '//[^/?#]+(.*)$', 1)) AS path FROM pages),
    h AS (SELECT page_id, arg_min(allow, place) AS first_says FROM p JOIN {_RULES} ON p.k = r.k AND starts_with(p.path, r.path) GROUP BY page_id),
    l AS (SELECT page_id, arg_max(allow, struct_pack(n := length(r.path), a := allow)) AS longest_says FROM p JOIN {_RULES} ON p.k = r.k AND regexp_matches(split_part(p.path, '#', 1), '^' || replace(r.path, '*', '.*')) GROUP BY page_id)
    SELECT page_id, coalesce(first_says, TRUE) AS allowed, coalesce(longest_says, TRUE) AS allowed_longest, CASE k WHEN 0 THEN 5 WHEN 2 THEN 7 ELSE 3 END AS crawl_delay FROM p LEFT JOIN h USING (page_id) LEFT JOIN l USING (page_id)""")
def robots_allowed(spark, sf):
    """Whether hosts' rules allow each page, by the first rule that fits and by the longest."""
    pages = _table(spark, sf, "pages").select("page_id", "url")
    host = F.parse_url("url", F.lit("HOST"))
    k = F.length("host") % 4
    body = F.when(k == 0, _FILES[0]).when(k == 1, _FILES[1]).when(k == 2, _FILES[2])
    files = pages.select(host.alias("host")).distinct().withColumn("body", body)
    first = robots.allowed(pages, files, _AGENT)
    both = robots.allowed(first.withColumnRenamed("allowed", "first").drop("crawl_delay"), files, _AGENT, match="longest")
    return both.select("page_id", F.col("first").alias("allowed"), F.col("allowed").alias("allowed_longest"), "crawl_delay")


_HISTORY = "SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS status FROM orders"


@query(f"""WITH k AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type <> 'error'), h AS ({_HISTORY})
    SELECT k.id, count(seq) AS n, min(seq) AS first_seq, arg_min(status, seq) AS status FROM k LEFT JOIN h USING (id) GROUP BY k.id""")
def memo_join(spark, sf):
    """History of tracked keys, kept from a key set that has lost and won keys since, and read once more."""
    history = _table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    events = _table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")

    def build(keys):
        return keys.join(history, "id", "left").groupBy("id").agg(F.count("seq").alias("n"), F.min("seq").alias("first_seq"), F.min_by("status", "seq").alias("status"))

    path = folder(spark, "memo_join")
    for kinds in (["click", "error"], ["click", "view", "purchase", "signup"], ["signup", "view", "purchase", "click"]):
        rows = memoised(path, events.where(F.col("event_type").isin(kinds)).select("id"), "id", build)
    return rows
