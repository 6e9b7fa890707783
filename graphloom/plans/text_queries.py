"""Text, hash, mention, chunk and time queries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import audit, chunking, evidence, mentions, timeline
from ..streaming import windows
from .registry import query, table


@query("SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[''’-][a-z0-9]+)*|[\\x{3400}-\\x{9fff}]|[\\p{L}\\p{Nl}\\p{No}]+') AS t FROM documents)")
def q_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[\\s-]+', ' ', 'g')) AS key, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS squeezed, nfc_normalize(p_brand) AS name FROM part")
def q_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.key(F.col("p_type")).alias("key"), text.squeeze(F.col("p_name")).alias("squeezed"), text.nfkc(F.col("p_brand")).alias("name"))


@query("SELECT doc_id, pos::INTEGER - 1 AS step, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents))")
def q_lines_to_steps(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("step", "line"))


@query("SELECT event_id, array_to_string(list_distinct(regexp_extract_all(props, '[0-9]+')), ',') AS numbers FROM events")
def q_numeric_literals(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(text.numbers(F.col("props")), ",").alias("numbers"))


@query("SELECT doc_id, 'doc:' || substr(sha256(text), 1, 24) AS uid FROM documents")
def q_sha_uid(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.uid("doc", F.col("text")).alias("uid"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def q_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'purchase' THEN 'bought' ELSE event_type END AS name FROM events")
def q_alias_map(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("view", "seen", "purchase", "bought")])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("name"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)')")
def q_word_boundary(spark, d):
    return table(spark, d, "documents").where(~text.contains_alias(F.col("text"), "the")).select("doc_id")


LEXICON = mentions.load_lexicon(str(Path(__file__).with_name("lexicon.json")))
_LINES = "l AS (SELECT doc_id, pos::INTEGER - 1 AS step, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)))"


def _mention_sql() -> str:
    """Matches of each kind with their places (what stands before them is summed), then spans closed by kinds before."""
    expression = lambda kind: f"(?i)\\b(?:{LEXICON.alternatives(kind)})\\b".replace("'", "''").replace("\\ ", " ")
    found = [f"SELECT doc_id, step, '{k}' AS kind, regexp_extract_all(line, '{expression(k)}') AS f, regexp_split_to_array(line, '{expression(k)}') AS p FROM l" for k in mentions.PRIORITY]
    aliases = ", ".join(f"('{k}', '{a}', '{n}')" for k in mentions.PRIORITY for a, (n, _) in LEXICON.aliases[k].items())
    return rf"""WITH {_LINES}, m AS ({' UNION ALL '.join(found)}),
x AS (SELECT doc_id, step, kind, f, p, unnest(range(1, len(f) + 1)) AS i FROM m),
y AS (SELECT doc_id, step, kind, f[i] AS name, (list_sum(list_transform(p[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda t: length(t))), 0))::BIGINT AS a FROM x),
z AS (SELECT *, a + length(name) AS b FROM y), al AS (SELECT * FROM (VALUES {aliases}) AS v(kind, alias, normalized_name)),
w AS (SELECT z.*, normalized_name FROM z JOIN al ON z.kind = al.kind AND trim(regexp_replace(lower(name), '[\s\-‐‑–—]+', ' ', 'g')) = alias),
t AS (SELECT * FROM w WHERE kind = 'tool'), n AS (SELECT * FROM w WHERE kind = 'ingredient' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.step = w.step AND t.a < w.b AND t.b > w.a)), u AS (SELECT * FROM t UNION ALL SELECT * FROM n),
r AS (SELECT * FROM u UNION ALL SELECT * FROM w WHERE kind = 'action' AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = w.doc_id AND u.step = w.step AND u.a < w.b AND u.b > w.a)) """


_MENTIONS = _mention_sql()


def document_mentions(spark, d):
    steps = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("step", "line"))
    return mentions.extract(steps, "line", LEXICON)


@query(_MENTIONS + "SELECT doc_id, step, kind, name, normalized_name, a AS span_start, b AS span_end FROM r")
def q_mentions(spark, d):
    return document_mentions(spark, d).where(F.col("kind").isin(*mentions.PRIORITY)).select("doc_id", "step", "kind", "name", "normalized_name", "span_start", "span_end")


@query(_MENTIONS + "SELECT doc_id, kind, normalized_name, count(*) AS n, min(step) AS first_step FROM r GROUP BY 1, 2, 3")
def q_mention_rollup(spark, d):
    rolled = mentions.rolled_up(document_mentions(spark, d), "doc_id", "step")
    return rolled.select("doc_id", "kind", "normalized_name", "n", F.get("evidence", F.lit(0))["step"].alias("first_step"))


@query(_MENTIONS + "SELECT doc_id, count(*) AS n_mentions, sum(b - a)::BIGINT AS covered, count_if(substr(line, a + 1, b - a) <> name) AS n_wrong FROM r JOIN l USING (doc_id, step) GROUP BY 1")
def q_span_check(spark, d):
    found = document_mentions(spark, d).where(F.col("kind").isin(*mentions.PRIORITY))
    right = audit.span_matches(F.col("line"), F.col("span_start"), F.col("span_end"), F.col("name"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered"), F.count_if(~right).alias("n_wrong"))


def _chunks(spark, d):
    steps = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("step", "line"))
    return steps, chunking.pack_steps(steps, "doc_id", "step", "line", 60, 3)


_PACK = rf"""WITH RECURSIVE {_LINES},
r AS (SELECT doc_id, 0 AS todo, 0 AS pos, 0 AS chunk, 0 AS used, 0 AS held, NULL::INTEGER AS step, NULL::INTEGER AS a, NULL::INTEGER AS b, NULL::INTEGER AS n FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT doc_id, (CASE WHEN e = size THEN todo + 1 ELSE todo END)::INTEGER, (CASE WHEN e = size THEN 0 ELSE e END)::INTEGER, chunk + fresh, (CASE WHEN fresh = 1 THEN 0 ELSE used END + least(whole, 60))::INTEGER, CASE WHEN fresh = 1 THEN 0 ELSE held END + 1, todo, pos, e::INTEGER, least(whole, 60)::INTEGER
FROM (SELECT *, CASE WHEN held > 0 AND (held >= 3 OR used + whole > 60) THEN 1 ELSE 0 END AS fresh, CASE WHEN whole <= 60 THEN size ELSE pos + length(regexp_extract(rest, '^(?:\S+\s+){{60}}')) END AS e
FROM (SELECT r.*, length(line) AS size, substr(line, pos + 1) AS rest, len(regexp_extract_all(substr(line, pos + 1), '\S+')) AS whole FROM r JOIN l ON l.doc_id = r.doc_id AND l.step = r.todo))) """


@query(_PACK + "SELECT doc_id, chunk, step, a AS span_start, b AS span_end, n AS n_tokens FROM r WHERE step IS NOT NULL")
def q_chunk_pack(spark, d):
    return _chunks(spark, d)[1]


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_steps, sum(length(line))::BIGINT AS covered, 0::BIGINT AS n_broken FROM l GROUP BY 1")
def q_chunk_coverage(spark, d):
    """What the fragments cover of each document, and how many of its steps they leave with a gap or an overlap."""
    steps, chunks = _chunks(spark, d)
    key = F.concat_ws(":", "doc_id", "step").alias("key")
    fragments = chunks.select(key, "span_start", "span_end").join(steps.select(key, F.length("line").alias("length")), "key")
    broken = audit.coverage_gaps(fragments, "key", "span_start", "span_end", "length").groupBy(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("doc_id")).agg(F.count("*").alias("n_broken"))
    covered = chunks.groupBy("doc_id").agg(F.countDistinct("step").alias("n_steps"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered"))
    return covered.join(broken, "doc_id", "left").fillna({"n_broken": 0})


@query("SELECT doc_id, substr(text, 1, 240) AS excerpt, length(text) > 240 AS is_excerpt FROM documents")
def q_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 240).alias("excerpt"), (F.length("text") > 240).alias("is_excerpt"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages")
def q_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("url", "([^/]*)$", 1).alias("last"))


@query("SELECT event_type, CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) * 300 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_tumbling(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", 300, ["event_type"], "value")
    return w.select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, (CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) // 3600 - k) * 3600 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def q_sliding(spark, d):
    return windows.sliding(table(spark, d, "events"), "ts", 7200, 3600, ["event_type"]).select("event_type", "start", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", 43200, ["user_id"]).select("user_id", "start", "n")


@query("""WITH r AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER w AS k, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, role, md5(text) ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, role, used::BIGINT AS used FROM r WHERE used <= 600 AND k <= 20""")
def q_history_budget(spark, d):
    """The newest turns that fit a budget of characters, twenty at most."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("h"))
    newest = (F.desc("turn"), F.col("role"), F.col("h"))
    return evidence.within_budget(evidence.top_k(rows, ["conv_id"], 20, *newest), ["conv_id"], "size", 600, *newest).select("conv_id", "turn", "role", F.col("used").cast("long"))


@query("""WITH m AS (SELECT user_id AS media, max(value) / 10 AS seconds FROM events GROUP BY 1) SELECT media, k::INTEGER AS clip, k * 5.0::DOUBLE AS start, least((k + 1) * 5.0::DOUBLE, seconds) AS "end" FROM (SELECT media, seconds, unnest(range(0, ceil(seconds / 5)::BIGINT)) AS k FROM m)""")
def q_clip_windows(spark, d):
    media = table(spark, d, "events").groupBy(F.col("user_id").alias("media")).agg((F.max("value") / 10).alias("seconds"))
    return timeline.clip_windows(media, "media", "seconds").select("media", "clip", "start", "end")


@query("""WITH f AS (SELECT DISTINCT user_id AS media, value / 10 AS t FROM events), m AS (SELECT media, max(t) AS seconds FROM f GROUP BY 1),
x AS (SELECT media, floor(t / 5)::INTEGER AS clip, t, least((floor(t / 5) + 1) * 5.0::DOUBLE, seconds) AS e FROM f JOIN m USING (media) WHERE seconds > 0)
SELECT media, clip, t AS "at", rank FROM (SELECT media, clip, t, row_number() OVER (PARTITION BY media, clip ORDER BY abs(t - (clip * 5.0::DOUBLE + e) / 2), t) AS rank FROM x WHERE t < e) WHERE rank <= 3""")
def q_nearest_frames(spark, d):
    frames = table(spark, d, "events").select(F.col("user_id").alias("media"), (F.col("value") / 10).alias("at")).distinct()
    clips = timeline.clip_windows(frames.groupBy("media").agg(F.max("at").alias("seconds")), "media", "seconds")
    return timeline.nearest_frames(clips, frames, "media", "at").select("media", "clip", "at", "rank")


def step_scores(spark, d):
    """Events of a user's day as media on a timeline, event types as steps; the score follows from value and step."""
    steps = spark.createDataFrame([(0, "view"), (1, "click"), (2, "purchase")], "step_order long, step string")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.concat_ws(":", "user_id", F.floor(at / 86_400_000_000))
    media = table(spark, d, "events").select(day.alias("timeline"), F.col("event_id").cast("string").alias("media"), at.alias("at"), "value")
    score = F.pmod(F.floor("value") * (F.col("step_order") + 3), F.lit(100)) / 100
    return media.crossJoin(F.broadcast(steps)).select("timeline", "media", "at", "step", "step_order", score.cast("double").alias("score"))  # three steps


@query()
def q_align_dp(spark, d):
    return timeline.align_monotone(step_scores(spark, d), "timeline", 0.5)


_SCORES = "s AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS timeline, event_id::VARCHAR AS media, epoch_us(ts) AS ts, step, step_order, ((floor(value)::BIGINT * (step_order + 3)) % 100) / 100.0::DOUBLE AS score FROM events, (SELECT unnest([0, 1, 2]) AS step_order, unnest(['view', 'click', 'purchase']) AS step))"


@query(f"""WITH RECURSIVE {_SCORES},
k AS (SELECT timeline, ts, row_number() OVER (PARTITION BY timeline ORDER BY ts) AS k FROM (SELECT DISTINCT timeline, ts FROM s)),
b AS (SELECT unnest([0, 0, 0, 1, 1, 2]) AS low, unnest([0, 1, 2, 1, 2, 2]) AS high),
g AS (SELECT timeline, k, low, high, sum(best) AS gain FROM (SELECT s.timeline, k, media, low, high, max(CASE WHEN step_order BETWEEN low AND high AND score >= 0.5 THEN score - 0.5 ELSE 0 END) AS best FROM s JOIN k ON k.timeline = s.timeline AND k.ts = s.ts, b GROUP BY ALL) GROUP BY ALL),
r AS (SELECT timeline, 0::BIGINT AS k, high, 0.0::DOUBLE AS gain FROM (SELECT DISTINCT timeline FROM s), (SELECT unnest([0, 1, 2]) AS high)
UNION ALL SELECT g.timeline, g.k, g.high, max(r.gain + g.gain) AS gain FROM r JOIN g ON g.timeline = r.timeline AND g.k = r.k + 1 AND g.low = r.high GROUP BY g.timeline, g.k, g.high)
SELECT timeline, round(max(gain), 6) AS gain FROM r GROUP BY 1""")
def q_monotone_small(spark, d):
    """The gain of the best assignment of each timeline (a user's day, three steps)."""
    scores = step_scores(spark, d)
    found = timeline.align_monotone(scores, "timeline", 0.5).groupBy("timeline").agg(F.sum(F.col("score") - 0.5).alias("gain"))
    return scores.select("timeline").distinct().join(found, "timeline", "left").select("timeline", F.round(F.coalesce("gain", F.lit(0.0)), 6).alias("gain"))


@query(f"WITH {_SCORES} SELECT media, step, score FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY score DESC, step_order, step) AS n FROM s WHERE score >= 0.5) WHERE n = 1")
def q_best_step(spark, d):
    return timeline.best_step(step_scores(spark, d), "media", "step", "step_order", "score", 0.5).select("media", "step", "score")
