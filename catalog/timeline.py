"""Joins in time, windows and series cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CH, EMB, SIG, SIZE, STEP, WIN, q, query, r, rounded
from catalog.inputs import DAY_SQL, META_SQL, _day_power, _label_meta
from tidegrid.functions import scalars
from tidegrid.operators import joins, series, windows

# ---- joins


@query("jo01_attach_meta_strict", f"WITH {DAY_SQL}{META_SQL} SELECT recording, label, window_idx, value, DK_Atlas, network FROM dp JOIN lm USING (label)")
def _(t):
    return joins.attach_meta(_day_power(t), _label_meta(t), ["label"])


@query("jo02_attach_meta_lenient", f"""WITH {DAY_SQL}{META_SQL} SELECT recording, label, window_idx, value, coalesce(DK_Atlas, 'Unknown') AS DK_Atlas,
  coalesce(network, 'Unknown') AS network FROM dp LEFT JOIN (SELECT * FROM lm WHERE label LIKE 'L%') m USING (label)""")
def _(t):
    return joins.attach_meta(_day_power(t), _label_meta(t).filter("label like 'L%'"), ["label"], strict=False)


@query("jo03_merge_labels", "SELECT d.doc_id, lang, quality, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return joins.merge_labels(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"])


@query("jo04_unmatched", "SELECT DISTINCT lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return joins.unmatched(t.documents, t.labels, ["doc_id"], ["lang", "source"])


@query("jo05_merge_wide", """WITH a AS (SELECT doc_id, quality FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic FROM labels WHERE toxic = 1 OR doc_id % 2 = 0)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS quality, b.toxic AS toxic FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def _(t):
    return joins.merge_wide({
        "quality": t.labels.filter("quality = 1").select("doc_id", F.col("quality").alias("v")),
        "toxic": t.labels.filter("toxic = 1 or doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("v")),
    }, ["doc_id"], "v")


@query("jo06_join_rate", f"SELECT lang, count(*) AS n_rows, count(l.doc_id) AS n_matched, {q('count(l.doc_id) / count(*)', 'match_rate')} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _(t):
    return rounded(joins.join_rate(t.documents, t.labels, ["doc_id"], ["lang"]), "match_rate")


@query("jo07_drop_bad_windows", f"""WITH {DAY_SQL}, bad AS (SELECT DISTINCT recording, window_idx FROM dp WHERE value > 100)
  SELECT DISTINCT recording, window_idx FROM dp ANTI JOIN bad USING (recording, window_idx)""")
def _(t):
    p = _day_power(t)
    return joins.drop_bad_windows(p.select("recording", "window_idx").distinct(), p.filter("value > 100"), ["recording", "window_idx"])


NEAR = """cand AS (SELECT a.event_id, a.t, b.event_id AS bid, b.t AS bt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS rn
  FROM sig a JOIN sig b ON a.recording = b.recording AND b.channel = 'signup' WHERE a.channel = 'purchase')"""


@query("jo08_nearest_join", f"""WITH {SIG}, {NEAR}
  SELECT s.event_id, CASE WHEN abs(c.t - bt) <= 14400 THEN bid END AS near_event_id, CASE WHEN abs(c.t - bt) <= 14400 THEN round(c.t - bt, 6) + 0.0 END AS near_error
  FROM sig s LEFT JOIN cand c ON c.event_id = s.event_id AND rn = 1 WHERE s.channel = 'purchase'""")
def _(t):
    d = t.signal.select("recording", "channel", "event_id", "t")
    out = joins.nearest_join(d.filter("channel = 'purchase'"), d.filter("channel = 'signup'"), ["recording"], "t", ["event_id"], 14400.0)
    return out.select("event_id", "near_event_id", r("near_error"))


@query("jo09_nearest_other", f"""WITH {SIG}, two AS (SELECT * FROM sig WHERE channel IN ('view', 'click')), cand AS (
  SELECT a.event_id, a.t, b.t AS bt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS rn FROM two a JOIN two b ON a.recording = b.recording AND a.channel <> b.channel)
  SELECT two.event_id, {q('bt', 'other_t')}, {q('bt - c.t', 'other_dt')}, coalesce(abs(bt - c.t) <= 3600, false) AS cooccurs FROM two LEFT JOIN cand c ON c.event_id = two.event_id AND rn = 1""")
def _(t):
    d = t.signal.filter(F.col("channel").isin("view", "click")).select("recording", "channel", "event_id", "t")
    return joins.nearest_other(d, ["recording"], "channel", ("view", "click"), "t", "event_id", 3600.0).select("event_id", r("other_t"), r("other_dt"), "cooccurs")


@query("jo10_snap_to_samples", f"""WITH {SIG}, ev AS (SELECT recording, event_id, t + 1000.5 AS t FROM sig WHERE channel = 'error'), c AS (
  SELECT e.recording, e.event_id, s.sample_idx, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - s.t), s.t) AS rn FROM ev e JOIN sig s ON s.recording = e.recording)
  SELECT event_id, sample_idx AS near_sample_idx FROM c WHERE rn = 1""")
def _(t):
    ev = t.signal.filter("channel = 'error'").select("recording", "event_id", (F.col("t") + 1000.5).alias("t"))
    return joins.snap_to_samples(ev, t.signal, ["recording"], "t", "sample_idx").select("event_id", "near_sample_idx")


@query("jo11_overlap_join", f"""WITH {SIG}, a AS (SELECT recording, floor(t / 3600) * 3600 AS s, floor(t / 3600) * 3600 + 3600 AS e FROM sig GROUP BY ALL HAVING max(value) > 100),
  b AS (SELECT recording, sample_idx, t - 5000 AS s, t + 5000 AS e FROM sig WHERE channel = 'view')
  SELECT b.recording, b.sample_idx, {q('coalesce(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) FILTER (a.s IS NOT NULL), 0)', 'overlap_sec', 3)}
  FROM b LEFT JOIN a ON a.recording = b.recording AND a.s < b.e AND b.s < a.e GROUP BY ALL""")
def _(t):
    hour = F.floor(F.col("t") / 3600) * 3600.0
    a = t.signal.groupBy("recording", hour.alias("s")).agg((F.max("value") > 100).alias("bad")).withColumn("e", F.col("s") + 3600)
    b = t.signal.filter("channel = 'view'").select("recording", "sample_idx", (F.col("t") - 5000).alias("s"), (F.col("t") + 5000).alias("e"))
    d = joins.overlap_join(a, b.withColumnsRenamed({"s": "b0", "e": "b1"}), ["recording"], ("s", "e"), ("b0", "b1"), "sample_idx", F.col("bad"))
    return d.select("recording", "sample_idx", r("overlap_sec", 3))


DAY, HALF = 86400.0, 43200.0
GRID = f"gr AS (SELECT recording, unnest(range(CAST(floor((tmax - {DAY}) / {HALF}) AS BIGINT) + 1)) AS window_idx FROM (SELECT recording, max(t) AS tmax FROM sig GROUP BY recording) WHERE tmax >= {DAY})"


def _grid(t):
    n = t.signal.groupBy("recording").agg((F.floor((F.max("t") - DAY) / HALF) + 1).cast("long").alias("n")).filter("n > 0")
    return n.select("recording", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("window_idx"))


def _in_days(t, d):
    n = t.signal.groupBy("recording").agg((F.floor((F.max("t") - DAY) / HALF) + 1).cast("long").alias("n")).filter("n > 0")
    return joins.events_in_windows(d.join(n, "recording"), "t", DAY, HALF, F.col("n"))


@query("jo12_events_in_windows", f"WITH {SIG}, {GRID} SELECT s.event_id, g.window_idx FROM sig s JOIN gr g ON g.recording = s.recording AND s.t >= g.window_idx * {HALF} AND s.t < g.window_idx * {HALF} + {DAY}")
def _(t):
    return _in_days(t, t.signal).select("event_id", "window_idx")


@query("jo13_match_responses", f"""WITH RECURSIVE {SIG},
  tg AS (SELECT recording, event_id, t, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS k FROM sig WHERE channel = 'view'),
  rs AS (SELECT recording, event_id, t, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS k FROM sig WHERE channel = 'click'),
  st AS (SELECT recording, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS event_id, NULL::BIGINT AS response_id FROM tg GROUP BY recording
    UNION ALL SELECT st.recording, tg.k, coalesce(m.k, st.used), tg.event_id, m.event_id FROM st JOIN tg ON tg.recording = st.recording AND tg.k = st.k + 1
      LEFT JOIN LATERAL (SELECT rs.k, rs.event_id FROM rs WHERE rs.recording = st.recording AND rs.k > st.used AND rs.t >= tg.t AND rs.t <= tg.t + 172800 ORDER BY rs.k LIMIT 1) m ON true)
  SELECT event_id, response_id, response_id IS NOT NULL AS hit FROM st WHERE k > 0""")
def _(t):
    d = t.signal.select("recording", "event_id", "t", "channel")
    return joins.match_responses(d.filter("channel = 'view'").drop("channel"), d.filter("channel = 'click'").drop("channel"), ["recording"], "t", "event_id", 172800.0).select("event_id", "response_id", "hit")


@query("jo14_response_table", f"""WITH {SIG}, tg AS (SELECT * FROM sig WHERE channel = 'view'), rs AS (SELECT * FROM sig WHERE channel = 'click')
  SELECT tg.event_id, count(rs.event_id) AS n_hits, count(rs.event_id) > 0 AS hit, {q('min(rs.t)', 'first_t')},
    coalesce(string_agg(printf('%.6f', rs.t), '; ' ORDER BY rs.t, rs.event_id), '') AS response_times
  FROM tg LEFT JOIN rs ON rs.recording = tg.recording AND rs.t >= tg.t AND rs.t <= tg.t + 172800 GROUP BY tg.event_id""")
def _(t):
    d = t.signal.select("recording", "event_id", "t", "channel")
    out = joins.response_table(d.filter("channel = 'view'"), d.filter("channel = 'click'"), ["recording"], "t", "event_id", 172800.0)
    return out.select("event_id", "n_hits", "hit", r("first_t"), "response_times")


@query("jo14_response_class", f"""WITH {SIG}, tg AS (SELECT * FROM sig WHERE channel = 'view'), rs AS (SELECT * FROM sig WHERE channel = 'click')
  SELECT rs.event_id, count(tg.event_id) AS n_hits, count(tg.event_id) > 0 AS after_target, coalesce(string_agg(CAST(tg.event_id AS VARCHAR), '; ' ORDER BY tg.t, tg.event_id), '') AS target_ids
  FROM rs LEFT JOIN tg ON rs.recording = tg.recording AND tg.t <= rs.t AND tg.t >= rs.t - 172800 GROUP BY rs.event_id""")
def _(t):
    d = t.signal.select("recording", "event_id", "t", "channel")
    out = joins.response_class(d.filter("channel = 'click'"), d.filter("channel = 'view'"), ["recording"], "t", "event_id", 172800.0)
    return out.select("event_id", "n_hits", "after_target", "target_ids")


@query("jo15_join_fallback", f"""WITH d AS (SELECT c_nationkey AS nat, c_mktsegment AS seg, max(c_custkey) AS best, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 GROUP BY ALL)
  SELECT s_suppkey, CASE WHEN a.nat IS NOT NULL THEN a.best ELSE b.best END AS best, CASE WHEN a.nat IS NOT NULL THEN a.n ELSE b.n END AS n
  FROM supplier s LEFT JOIN d a ON a.nat = s_nationkey AND a.seg = CASE WHEN s_suppkey % 3 = 0 THEN 'NONE' ELSE 'MACHINERY' END LEFT JOIN d b ON b.nat = s_nationkey AND b.seg = 'BUILDING'""")
def _(t):
    dim = t.customer.filter("c_custkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("nat"), F.col("c_mktsegment").alias("seg")).agg(F.max("c_custkey").alias("best"), F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("s_suppkey") % 3 == 0, "NONE").otherwise("MACHINERY")
    nat = F.col("s_nationkey")
    return joins.join_fallback(t.supplier, dim, [{"nat": nat, "seg": own}, {"nat": nat, "seg": F.lit("BUILDING")}], ["best", "n"]).select("s_suppkey", "best", "n")


@query("jo16_pick_best", """WITH s AS (SELECT c_nationkey, c_name, CASE WHEN c_name LIKE '%1%' THEN 4 ELSE 0 END + CASE WHEN c_name LIKE '%2%' THEN 2 ELSE 0 END + CASE WHEN c_name LIKE '%3%' THEN 1 ELSE 0 END AS score FROM customer),
  m AS (SELECT c_nationkey, max(score) AS score FROM s GROUP BY c_nationkey)
  SELECT c_nationkey, score, CASE WHEN count(*) = 1 THEN min(c_name) END AS c_name, count(*) AS n_best FROM s JOIN m USING (c_nationkey, score) GROUP BY ALL""")
def _(t):
    score = joins.source_score(F.col("c_name"), F.lit("1"), F.lit("2"), F.lit("3"))
    return joins.pick_best(t.customer, ["c_nationkey"], score, "c_name")


@query("jo16_newest", "SELECT o_custkey, max(o_orderkey) FILTER (o_orderdate = d) AS o_orderkey FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) USING (o_custkey) GROUP BY o_custkey")
def _(t):
    return joins.newest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query("jo17_pairs", f"""WITH {EMB} SELECT a.subject AS a, b.subject AS b, count(*) AS n, {q('corr(a.f1, b.f1)', 'r')} FROM emb a JOIN emb b ON a.time_idx = b.time_idx AND a.subject < b.subject GROUP BY ALL""")
def _(t):
    d = t.embedded.withColumn("film", F.lit("all"))
    return rounded(joins.pairs(d, ["film"], "subject", "time_idx", "f1").drop("film"), "r")


@query("jo18_join_bands", f"""WITH {DAY_SQL} SELECT recording, window_idx, a.value AS "LTG1", b.value AS "RAH1" FROM dp a JOIN dp b USING (recording, window_idx) WHERE a.label = 'LTG1' AND b.label = 'RAH1'""")
def _(t):
    return joins.join_bands(_day_power(t), ["recording", "window_idx"], "label", "value", "LTG1", "RAH1")


@query("jo19_subject_join", "SELECT c_custkey, c_acctbal, n_orders FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t.customer.select("c_custkey", "c_acctbal").join(joins.assert_unique(n, ["c_custkey"]), "c_custkey")


# ---- windows


@query("wi01_assign_windows", f"WITH {WIN} SELECT recording, window_idx, count(*) AS n, {q(f'(window_idx * {STEP} + {SIZE} / 2) / 2.0', 'center_sec')} FROM win GROUP BY ALL HAVING count(*) = {SIZE}")
def _(t):
    d = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP)
    d = windows.window_reduce(d, ["recording"], "value", SIZE, {"n": F.count})
    return d.select("recording", "window_idx", "n", r(windows.window_center(SIZE, STEP, 2.0)).alias("center_sec"))


@query("wi02_window_reduce", f"WITH {WIN} SELECT recording, window_idx, {q('avg(value)', 'mean')}, {q('quantile_cont(value, 0.5)', 'median')}, {q('stddev_pop(value)', 'sd')} FROM win GROUP BY ALL HAVING count(*) = {SIZE}")
def _(t):
    d = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP)
    return rounded(windows.window_reduce(d, ["recording"], "value", SIZE, {"mean": "mean", "median": "median", "sd": "sd"}), "mean", "median", "sd")


@query("wi02_window_panes", f"WITH {WIN} SELECT recording, window_idx, count(value) AS n, {q('avg(value)', 'mean')}, {q('stddev_pop(value)', 'sd')} FROM win GROUP BY ALL HAVING count(*) = {SIZE}")
def _(t):
    return rounded(windows.window_moments(t.signal, ["recording"], "sample_idx", "value", SIZE, STEP), "mean", "sd")


@query("wi03_trimmed_mean", f"""WITH {WIN}, k AS (SELECT *, row_number() OVER (PARTITION BY recording, window_idx ORDER BY value) AS rn, count(*) OVER (PARTITION BY recording, window_idx) AS n FROM win)
  SELECT recording, window_idx, {q('avg(value)', 'trim20')} FROM k WHERE n = {SIZE} AND rn > 4 AND rn <= 16 GROUP BY ALL""")
def _(t):
    d = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP)
    return rounded(windows.window_reduce(d, ["recording"], "value", SIZE, {"trim20": "trim20"}), "trim20")


@query("wi04_nulls", f"""WITH {SIG}, win AS (SELECT s.*, k.window_idx FROM sig s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((s.sample_idx - {SIZE - 1}) / {STEP}.0) AS BIGINT)), s.sample_idx // {STEP} + 1)) AS window_idx) k)
  SELECT recording, window_idx, {q('avg(gappy)', 'skip')}, {q('avg(coalesce(gappy, 0))', 'zero')} FROM win GROUP BY ALL HAVING count(*) = {SIZE}""")
def _(t):
    d = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP)
    a = windows.window_reduce(d, ["recording"], "gappy", SIZE, {"skip": "mean", "zero": lambda c: F.avg(F.coalesce(c, F.lit(0.0)))})
    return rounded(a, "skip", "zero")


@query("wi05_window_counts", f"""WITH {SIG}, {GRID} SELECT g.recording, g.window_idx, count(s.event_id) AS n_events, {q(f'count(s.event_id) / {DAY}', 'rate', 9)} FROM gr g
  LEFT JOIN sig s ON g.recording = s.recording AND s.channel = 'click' AND s.t >= g.window_idx * {HALF} AND s.t < g.window_idx * {HALF} + {DAY} GROUP BY ALL""")
def _(t):
    ev = _in_days(t, t.signal.filter("channel = 'click'"))
    return windows.window_counts(ev, _grid(t), ["recording"], DAY).withColumn("rate", r(F.col("rate"), 9))


MARKS = f"""mk AS (SELECT g.recording, g.window_idx, avg(s.value) AS m, stddev_pop(s.value) AS sd FROM gr g
  LEFT JOIN sig s ON g.recording = s.recording AND s.channel = 'click' AND s.t >= g.window_idx * {HALF} AND s.t < g.window_idx * {HALF} + {DAY} GROUP BY ALL)"""


def _marks(t):
    return windows.window_marks(_in_days(t, t.signal.filter("channel = 'click'")), _grid(t), ["recording"], "value")


@query("wi06_window_marks", f"WITH {SIG}, {GRID}, {MARKS} SELECT recording, window_idx, {q('m', 'mark_mean')}, {q('sd', 'mark_sd')} FROM mk")
def _(t):
    return rounded(_marks(t), "mark_mean", "mark_sd")


@query("wi07_fill_empty", f"""WITH {SIG}, {GRID}, {MARKS} SELECT recording, window_idx,
  {q('coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY recording ORDER BY window_idx), 0)', 'ffill')}, {q('coalesce(m, 0)', 'zero')}, {q('m', 'missing')} FROM mk""")
def _(t):
    d = _marks(t).select("recording", "window_idx", F.col("mark_mean").alias("ffill"), F.col("mark_mean").alias("zero"), F.col("mark_mean").alias("missing"))
    d = windows.fill_empty(d, ["recording"], "ffill", "ffill")
    d = windows.fill_empty(windows.fill_empty(d, ["recording"], "zero", "zero"), ["recording"], "missing", "missing")
    return rounded(d, "ffill", "zero", "missing")


@query("wi08_conform_grid", f"""WITH {CH}, n AS (SELECT recording, channel, count(*) AS n FROM ch GROUP BY ALL),
  j AS (SELECT recording, channel, n, unnest(range(40)) AS j FROM n WHERE n <= 41),
  p AS (SELECT *, CASE WHEN n >= 40 THEN j ELSE j * (n - 1) / 39.0 END AS pos FROM j)
  SELECT p.recording, p.channel, j AS sample_idx, {q('a.value + (coalesce(b.value, a.value) - a.value) * (pos - floor(pos))', 'value')} FROM p JOIN ch a ON a.recording = p.recording AND a.channel = p.channel AND a.sample_idx = floor(pos)
  LEFT JOIN ch b ON b.recording = p.recording AND b.channel = p.channel AND b.sample_idx = floor(pos) + 1""")
def _(t):
    return rounded(windows.conform_grid(t.channels, ["recording", "channel"], "value", 40, "sample_idx"), "value")


@query("wi09_scaled_grid", f"""WITH {SIG}, n AS (SELECT recording, max(sample_idx) + 1 AS n FROM sig GROUP BY recording),
  w AS (SELECT recording, n // 13 AS st, (2 * n) // 13 AS sz, unnest(range(12)) AS window_idx FROM n WHERE n // 13 > 0)
  SELECT w.recording, window_idx, {q('avg(value)', 'mean')}, {q('stddev_pop(value)', 'sd')} FROM w JOIN sig s ON s.recording = w.recording AND s.sample_idx >= window_idx * st AND s.sample_idx < window_idx * st + sz GROUP BY ALL""")
def _(t):
    return rounded(windows.scaled_grid(t.signal, ["recording"], "sample_idx", "value", 12), "mean", "sd")


@query("wi10_assign_centered", f"""WITH {SIG}, n AS (SELECT recording, max(sample_idx) + 1 AS n FROM sig GROUP BY recording),
  w AS (SELECT recording, n, unnest(range((n - {SIZE}) // {STEP} + 1)) AS window_idx FROM n WHERE n >= {SIZE})
  SELECT w.recording, window_idx, count(*) AS n, {q('avg(value)', 'mean')} FROM w JOIN sig s ON s.recording = w.recording AND s.sample_idx >= window_idx * {STEP} - 10 AND s.sample_idx < window_idx * {STEP} + 30
  WHERE window_idx * {STEP} - 10 >= 0 AND window_idx * {STEP} + 30 <= w.n GROUP BY ALL""")
def _(t):
    d = windows.assign_centered(t.signal, "sample_idx", SIZE, 40, STEP)
    return rounded(windows.window_reduce(d, ["recording"], "value", 40, {"n": F.count, "mean": "mean"}), "mean")


@query("wi11_tumbling", f"""WITH {SIG} SELECT recording, CAST(floor(t / 3600) AS BIGINT) AS epoch_idx, count(*) AS n, max(value) > 100 AS bad, floor(t / 3600) * 3600.0::DOUBLE AS start_sec, (floor(t / 3600) + 1) * 3600.0::DOUBLE AS end_sec FROM sig GROUP BY ALL""")
def _(t):
    return windows.tumbling(t.signal, ["recording"], "t", 3600, {"n": F.count(F.lit(1)), "bad": F.max("value") > 100})


@query("wi12_bad_share", f"""WITH {SIG}, {GRID}, b AS (SELECT recording, floor(t / 3600) AS h, max(value) > 100 AS bad FROM sig WHERE recording % 5 <> 0 GROUP BY ALL), k AS (SELECT DISTINCT recording FROM b),
  o AS (SELECT g.recording, window_idx, sum(greatest(0, least(h * 3600 + 3600, window_idx * {HALF} + {DAY}) - greatest(h * 3600, window_idx * {HALF}))) AS s FROM gr g JOIN b ON b.recording = g.recording AND bad
    AND h * 3600 < window_idx * {HALF} + {DAY} AND h * 3600 + 3600 > window_idx * {HALF} GROUP BY ALL)
  SELECT g.recording, g.window_idx, CASE WHEN k.recording IS NOT NULL THEN round(coalesce(s, 0), 3) + 0.0 END AS bad_sec, CASE WHEN k.recording IS NOT NULL THEN round(coalesce(s, 0) / {DAY}, 6) + 0.0 END AS frac_bad
  FROM gr g LEFT JOIN o USING (recording, window_idx) LEFT JOIN k ON k.recording = g.recording""")
def _(t):
    bins = windows.tumbling(t.signal.filter("recording % 5 <> 0"), ["recording"], "t", 3600, {"bad": F.max("value") > 100})
    d = windows.bad_share(bins, ["recording"], "epoch_idx", F.col("bad"), _grid(t), 3600, DAY, HALF)
    return d.select("recording", "window_idx", r("bad_sec", 3), r("frac_bad"))


@query("wi13_pad_mask", f"WITH {SIG} SELECT recording, sample_idx, max(CAST(value > 100 AS INT)) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS padded FROM sig")
def _(t):
    d = t.signal.select("recording", "sample_idx", F.when(F.col("value") > 100, 1).otherwise(0).alias("mask"))
    return windows.pad_mask(d, ["recording"], "sample_idx", "mask", 3, "padded").drop("mask")


@query("wi14_interval_contrast", f"""WITH {SIG}, a AS (SELECT recording, avg(value) FILTER (t >= 100000 AND t < 600000) AS b, avg(value) FILTER (t >= 1000000 AND t < 1500000) AS w, stddev_pop(value) FILTER (t >= 100000 AND t < 600000) + 1e-12 AS sd FROM sig GROUP BY recording)
  SELECT recording, {q('b', 'base_mean')}, {q('w', 'target_mean')}, {q('w - b', 'diff')}, {q('(w - b) / (abs(b) + 1e-12) * 100', 'pct_change')}, CASE WHEN sd > 1e-6 THEN {q('(w - b) / sd', 'z').rsplit(' AS ', 1)[0]} END AS z_like FROM a""")
def _(t):
    d = windows.interval_contrast(t.signal, ["recording"], "t", "value", (100000, 600000), (1000000, 1500000))
    return rounded(d, "base_mean", "target_mean", "diff", "pct_change", "z_like").withColumn("z_like", F.when(F.abs("z_like") < 1e6, F.col("z_like")))


@query("wi15_rolling_mean", f"""WITH {SIG}, w AS (SELECT recording, sample_idx, avg(gappy) OVER x AS m, count(gappy) OVER x AS n FROM sig WINDOW x AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING))
  SELECT recording, sample_idx, CASE WHEN n >= 4 THEN {q('m', 'x').rsplit(' AS ', 1)[0]} END AS rolling FROM w WHERE sample_idx % 8 = 0""")
def _(t):
    d = windows.rolling_mean(t.signal, ["recording"], "sample_idx", "gappy", 8, 4, "rolling", every=8)
    return d.select("recording", "sample_idx", r("rolling"))


@query("wi16_rolling_median", f"WITH {SIG} SELECT recording, sample_idx, {q('quantile_cont(value, 0.5) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)', 'med')} FROM sig")
def _(t):
    return windows.rolling_median(t.signal.select("recording", "sample_idx", "value"), ["recording"], "sample_idx", "value", 7, "med").select("recording", "sample_idx", r("med"))


EWIN = EMB + f""", ew AS (SELECT e.*, k.window_idx FROM emb e, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((e.time_idx - 9) / 5.0) AS BIGINT)), e.time_idx // 5 + 1)) AS window_idx) k),
  fw AS (SELECT subject, window_idx FROM ew GROUP BY ALL HAVING count(*) = 10), full_w AS (SELECT window_idx FROM fw GROUP BY window_idx HAVING count(*) = (SELECT count(DISTINCT subject) FROM emb)),
  eww AS (SELECT * FROM ew SEMI JOIN full_w USING (window_idx))"""


def _embedded_windows(t):
    """Windows every subject has whole."""
    w = windows.assign_windows(t.embedded, "time_idx", 10, 5)
    n = t.embedded.select("subject").distinct().agg(F.count(F.lit(1)).alias("n"))
    whole = w.groupBy("subject", "window_idx").agg(F.count(F.lit(1)).alias("c")).filter("c = 10").groupBy("window_idx").agg(F.count(F.lit(1)).alias("s"))
    return w.join(whole.crossJoin(F.broadcast(n)).filter("s = n").select("window_idx"), "window_idx", "left_semi")


@query("wi17_windowed_isc", f"WITH {EWIN}, p AS (SELECT a.subject, b.subject AS other, a.window_idx, corr(a.f1, b.f1) AS r FROM eww a JOIN eww b USING (window_idx, time_idx) GROUP BY ALL) SELECT subject, window_idx, {q('avg(r)', 'isc')} FROM p GROUP BY ALL")
def _(t):
    from tidegrid.operators.stats import windowed_isc
    return windowed_isc(_embedded_windows(t), "subject", "time_idx", ["f1"], 10).select("subject", "window_idx", r("isc"))


@query("wi18_windowed_fc", f"WITH {EWIN} SELECT window_idx, a.subject AS a, b.subject AS b, count(*) AS n, {q('corr(a.f2, b.f2)', 'r')} FROM eww a JOIN eww b USING (window_idx, time_idx) WHERE a.subject < b.subject GROUP BY ALL")
def _(t):
    from tidegrid.operators.stats import windowed_fc
    return rounded(windowed_fc(_embedded_windows(t), [], "subject", "time_idx", "f2"), "r")


@query("wi19_time_index", f"WITH {SIG} SELECT event_id, recording, sample_idx FROM sig")
def _(t):
    from tidegrid.operators.scan import time_index
    d = t.events.select("event_id", F.col("user_id").alias("recording"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return time_index(d, ["recording"], ["us", "event_id"]).select("event_id", "recording", "sample_idx")


@query("wi20_center_on_group", f"WITH {EMB} SELECT vec_id, {q('avg(f1) OVER w', 'f1_gmean')}, {q('stddev_samp(f1) OVER w', 'f1_gsd')}, {q('f1 - avg(f1) OVER w', 'f1_dev')} FROM emb WINDOW w AS (PARTITION BY time_idx)")
def _(t):
    return rounded(windows.center_on_group(t.embedded, ["time_idx"], ["f1"]).select("vec_id", "f1_gmean", "f1_gsd", "f1_dev"), "f1_gmean", "f1_gsd", "f1_dev")


@query("wi21_epochs", f"""WITH {SIG}, n AS (SELECT recording, max(sample_idx) + 1 AS n FROM sig GROUP BY recording), e AS (SELECT recording, event_id, sample_idx AS mid FROM sig WHERE channel = 'view'),
  f AS (SELECT e.* FROM e JOIN n USING (recording) WHERE mid - 12 >= 0 AND mid - 1 < n)
  SELECT f.event_id AS epoch, s.sample_idx, s.sample_idx - mid AS "offset", s.value FROM f JOIN sig s ON s.recording = f.recording AND s.sample_idx BETWEEN mid - 12 AND mid - 1""")
def _(t):
    ev = t.signal.filter("channel = 'view'").select("recording", F.col("event_id").alias("epoch"), (F.col("sample_idx") / 2.0).alias("onset"))
    return windows.epochs(t.signal, ev, ["recording"], "sample_idx", "onset", "epoch", 2.0, -6.0, -0.5).select("epoch", "sample_idx", "offset", "value")


# Spans around `error` events are annotated as bad, in seconds at 2 samples each.
FATES = f"""{SIG}, n AS (SELECT recording, max(sample_idx) + 1 AS n FROM sig GROUP BY recording), e AS (SELECT recording, event_id, sample_idx AS mid FROM sig WHERE channel = 'view'),
  b AS (SELECT recording, sample_idx / 2.0 - 0.5 AS s, sample_idx / 2.0 + 0.75 AS f FROM sig WHERE channel = 'error' AND event_id % 4 = 0),
  fate AS (SELECT e.*, CASE WHEN mid - 12 < 0 OR mid - 1 >= n THEN 'short' WHEN EXISTS (SELECT 1 FROM b WHERE b.recording = e.recording AND b.s <= (mid - 1) / 2.0 AND b.f > (mid - 12) / 2.0) THEN 'bad' ELSE 'kept' END AS fate FROM e JOIN n USING (recording))"""


def _epoch_args(t):
    ev = t.signal.filter("channel = 'view'").select("recording", F.col("event_id").alias("epoch"), (F.col("sample_idx") / 2.0).alias("onset"))
    at = F.col("sample_idx") / 2.0
    bad = t.signal.filter("channel = 'error' AND event_id % 4 = 0").select("recording", (at - 0.5).alias("start"), (at + 0.75).alias("end"))
    return (t.signal, ev, ["recording"], "sample_idx", "onset", "epoch", 2.0, -6.0, -0.5), bad


@query("wi21_epochs_clean", f"""WITH {FATES} SELECT f.event_id AS epoch, s.sample_idx, s.sample_idx - mid AS "offset", s.value FROM fate f JOIN sig s ON s.recording = f.recording AND s.sample_idx BETWEEN mid - 12 AND mid - 1 WHERE fate = 'kept'""")
def _(t):
    args, bad = _epoch_args(t)
    return windows.epochs(*args, bad).select("epoch", "sample_idx", "offset", "value")


@query("wi21_epoch_report", f"""WITH {FATES} SELECT recording, count(*) AS n_events, count(*) FILTER (fate = 'kept') AS n_kept, count(*) FILTER (fate = 'short') AS n_short, count(*) FILTER (fate = 'bad') AS n_bad FROM fate GROUP BY 1""")
def _(t):
    args, bad = _epoch_args(t)
    return windows.epoch_report(windows.epoch_fates(*args, bad), ["recording"])


@query("wi22_label_pulses", f"""WITH {SIG}, p AS (SELECT *, t - lag(t) OVER w AS gap, row_number() OVER w AS a, row_number() OVER (PARTITION BY recording ORDER BY t DESC, event_id DESC) AS z FROM sig WINDOW w AS (PARTITION BY recording ORDER BY t, event_id))
  SELECT event_id, {q('gap', 'gap_before')}, CASE WHEN z = 1 THEN 'end' WHEN a = 1 THEN 'start' WHEN gap > 43200 AND (recording % 2 = 1 OR t >= 500000) THEN 'probe_onset' ELSE 'other' END AS label FROM p""")
def _(t):
    at = t.signal.filter("recording % 2 = 0").select("recording").distinct().withColumn("min_time", F.lit(500000.0))
    return windows.label_pulses(t.signal, ["recording"], "t", "event_id", 43200, at).select("event_id", r("gap_before"), "label")


# ---- series

MED = "md AS (SELECT recording, median(value) AS med FROM sig GROUP BY recording), rs AS (SELECT recording, med, median(abs(value - med)) AS mad FROM sig JOIN md USING (recording) GROUP BY ALL)"


@query("ts01_robust_z", f"WITH {SIG}, {MED} SELECT event_id, {q('(value - med) / (1.4826 * nullif(mad, 0))', 'z')} FROM sig JOIN rs USING (recording)")
def _(t):
    return series.robust_z(t.signal.select("event_id", "recording", "value"), ["recording"], "value", "z").select("event_id", r("z"))


@query("ts02_robust_z_variants", f"""WITH {SIG}, g AS (SELECT * FROM sig WHERE event_id % 4 <> 0), md AS (SELECT recording, median(value) AS med FROM g GROUP BY recording), rs AS (SELECT recording, med, median(abs(value - med)) AS mad FROM g JOIN md USING (recording) GROUP BY ALL)
  SELECT event_id, {q('(value - med) / CASE WHEN 1.4826 * mad > 1e-8 THEN 1.4826 * mad ELSE 1 END', 'z_good')}, {q('(value - med) / (1.4826 * (mad + 1e-12))', 'z_eps')} FROM sig JOIN rs USING (recording)""")
def _(t):
    d, ref = t.signal.select("event_id", "recording", "value"), F.col("event_id") % 4 != 0
    a = series.robust_z(d, ["recording"], "value", "z_good", ref, zero="one")
    return series.robust_z(a, ["recording"], "value", "z_eps", ref, zero="eps").select("event_id", r("z_good"), r("z_eps"))


@query("ts03_zscore", f"""SELECT event_id, {q('(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)', 'z0')}, {q('(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)', 'z1')},
  {q('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()', 'z_all')} FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t):
    d = t.signal.select("event_id", "recording", "value")
    for keys, ddof, out in ((["recording"], 0, "z0"), (["recording"], 1, "z1"), ([], 0, "z_all")):
        d = series.zscore(d, keys, ["value"], ddof).withColumnRenamed("value_z", out)
    return d.select("event_id", r("z0"), r("z1"), r("z_all"))


@query("ts04_zscore_filled", f"WITH {SIG}, f AS (SELECT event_id, recording, coalesce(gappy, 0) AS v FROM sig) SELECT event_id, {q('(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)', 'z')} FROM f WINDOW w AS (PARTITION BY recording)")
def _(t):
    return series.zscore(t.signal, ["recording"], ["gappy"], 0, fill=0.0).select("event_id", r(F.col("gappy_z")).alias("z"))


NB = """nb AS (SELECT recording, event_id, sample_idx, t, gappy, max(sample_idx) OVER (PARTITION BY recording) AS li,
  last_value(CASE WHEN gappy IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER up AS pi, last_value(CASE WHEN gappy IS NOT NULL THEN t END IGNORE NULLS) OVER up AS pt, last_value(gappy IGNORE NULLS) OVER up AS pv,
  first_value(CASE WHEN gappy IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER dn AS ni, first_value(CASE WHEN gappy IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS nt, first_value(gappy IGNORE NULLS) OVER dn AS nv
  FROM sig WINDOW up AS (PARTITION BY recording ORDER BY sample_idx), dn AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
LERP = "coalesce(gappy, pv + (nv - pv) * (t - pt) / nullif(nt - pt, 0))"
HOLD = f"CASE WHEN gappy IS NOT NULL THEN gappy WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE {LERP} END"


@query("ts05_interpolate", f"WITH {SIG}, {NB} SELECT event_id, {q(LERP, 'inside')}, {q(HOLD, 'held')} FROM nb")
def _(t):
    d = t.signal.select("recording", "event_id", "sample_idx", "t", "gappy")
    a = series.interpolate(d, ["recording"], "sample_idx", "t", "gappy", "inside")
    b = series.interpolate(a, ["recording"], "sample_idx", "t", "gappy", "held", edge="hold")
    return b.select("event_id", r("inside"), r("held"))


@query("ts05_resample", f"""WITH {SIG}, g AS (SELECT recording, unnest(range(30)) * 86400.0::DOUBLE AS t FROM (SELECT DISTINCT recording FROM sig)), p AS (
  SELECT g.*, (SELECT max(s.t) FROM sig s WHERE s.recording = g.recording AND s.t <= g.t) AS pt, (SELECT min(s.t) FROM sig s WHERE s.recording = g.recording AND s.t >= g.t) AS nt FROM g)
  SELECT p.recording, p.t, {q('CASE WHEN pt = p.t THEN a.value ELSE a.value + (b.value - a.value) * (p.t - pt) / (nt - pt) END', 'value')} FROM p LEFT JOIN sig a ON a.recording = p.recording AND a.t = pt LEFT JOIN sig b ON b.recording = p.recording AND b.t = nt""")
def _(t):
    g = t.signal.select("recording").distinct().select("recording", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")).select("recording", (F.col("d") * 86400.0).alias("t"))
    return rounded(series.resample(t.signal, g, ["recording"], "t", "value"), "value")


@query("ts06_interpolate_max_gap", f"WITH {SIG}, {NB} SELECT event_id, {q(f'CASE WHEN gappy IS NOT NULL OR coalesce(ni, li + 1) - coalesce(pi, -1) - 1 <= 1 THEN {HOLD} END', 'filled')} FROM nb")
def _(t):
    d = series.interpolate(t.signal, ["recording"], "sample_idx", "t", "gappy", "filled", max_gap=1, edge="hold")
    return d.select("event_id", r("filled"))


@query("ts07_fill_and_buffer", f"""WITH {SIG}, v AS (SELECT recording, event_id, sample_idx, CASE WHEN vl THEN value END AS gappy, sample_idx::DOUBLE AS t, vl FROM sig), {NB.replace('FROM sig', 'FROM v')},
  k AS (SELECT *, gappy IS NOT NULL OR coalesce(ni, li + 1) - coalesce(pi, -1) - 1 < 2 AS ok FROM nb),
  b AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near FROM k)
  SELECT event_id, ok AND near <= 1 AS valid, CASE WHEN ok AND near <= 1 THEN {q(HOLD, 'x').rsplit(' AS ', 1)[0]} END AS x FROM b""")
def _(t):
    d = t.signal.select("recording", "event_id", "sample_idx", F.col("value").alias("x"), F.col("vl").alias("valid"))
    return series.fill_and_buffer(d, ["recording"], "sample_idx", "x", "valid", 2, 5, 1).select("event_id", "valid", r("x"))


@query("ts08_cap_filled", f"""WITH {SIG}, {NB}, a AS (SELECT recording, median(gappy) AS m, stddev_pop(gappy) AS s FROM sig GROUP BY recording), h AS (SELECT event_id, recording, gappy, {HOLD} * 3 AS x FROM nb)
  SELECT event_id, {q('CASE WHEN gappy IS NULL THEN least(greatest(x, m - 2 * s), m + 2 * s) ELSE x END', 'clipped')}, {q('CASE WHEN gappy IS NULL AND abs(x - m) > 2 * s THEN m ELSE x END', 'reset')} FROM h JOIN a USING (recording)""")
def _(t):
    d = series.interpolate(t.signal, ["recording"], "sample_idx", "t", "gappy", "x", edge="hold")
    d = d.withColumns({"clipped": F.col("x") * 3, "reset": F.col("x") * 3})
    d = series.cap_filled(d, ["recording"], "gappy", "clipped", 2)
    return series.cap_filled(d, ["recording"], "gappy", "reset", 2, mode="reset").select("event_id", r("clipped"), r("reset"))


@query("ts09_dilate_erode", f"WITH {SIG} SELECT event_id, max(CAST(vl AS INT)) OVER w AS dilated, min(CAST(vl AS INT)) OVER w AS eroded FROM sig WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(t):
    d = t.signal.select("recording", "event_id", "sample_idx", F.col("vl").cast("int").alias("m"))
    d = series.erode(series.dilate(d, ["recording"], "sample_idx", "m", 2, "dilated"), ["recording"], "sample_idx", "m", 2, "eroded")
    return d.select("event_id", "dilated", "eroded")


EYES = """e AS (SELECT recording, event_id, sample_idx, CASE WHEN vl THEN value END AS l, CASE WHEN vr THEN value + 5 END AS r FROM sig),
  d AS (SELECT *, CASE WHEN count(l - r) OVER w = count(*) OVER w THEN sum(l - r) OVER w / 3 END AS d FROM e WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  b AS (SELECT recording, list(sample_idx ORDER BY sample_idx) FILTER (d IS NOT NULL) AS i, list(d ORDER BY sample_idx) FILTER (d IS NOT NULL) AS v FROM d GROUP BY recording),
  n AS (SELECT d.*, i, v, last_value(CASE WHEN d IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER up AS pi, last_value(d IGNORE NULLS) OVER up AS pv, first_value(CASE WHEN d IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER dn AS ni, first_value(d IGNORE NULLS) OVER dn AS nv
    FROM d JOIN b USING (recording) WINDOW up AS (PARTITION BY d.recording ORDER BY sample_idx), dn AS (PARTITION BY d.recording ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT *, CASE WHEN d IS NOT NULL THEN d WHEN pi IS NULL THEN v[1] + (v[2] - v[1]) / (i[2] - i[1]) * (sample_idx - i[1]) WHEN ni IS NULL THEN v[-1] + (v[-1] - v[-2]) / (i[-1] - i[-2]) * (sample_idx - i[-1]) ELSE pv + (nv - pv) * (sample_idx - pi) / (ni - pi) END AS df FROM n),
  v AS (SELECT recording, event_id, sample_idx, sample_idx::DOUBLE AS t, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (l + r) / 2 WHEN l IS NOT NULL THEN l - df / 2 WHEN r IS NOT NULL THEN r + df / 2 END AS gappy FROM f)"""


@query("ts10_combine_pair", f"WITH {SIG}, {EYES}, {NB.replace('FROM sig', 'FROM v')} SELECT event_id, {q(HOLD, 'both')} FROM nb")
def _(t):
    d = t.signal.select("recording", "event_id", "sample_idx", F.when(F.col("vl"), F.col("value")).alias("l"), F.when(F.col("vr"), F.col("value") + 5).alias("rt"))
    return series.combine_pair(d, ["recording"], "sample_idx", "l", "rt", 3, "both").select("event_id", r("both"))


@query("ts11_detect_runs", f"""WITH {SIG}, l AS (SELECT recording, sample_idx, max(sample_idx) OVER (PARTITION BY recording) AS li, value < 40 AS c FROM sig), g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY recording ORDER BY sample_idx) AS grp FROM l WHERE c),
  u AS (SELECT recording, min(sample_idx) AS start_idx, least(max(sample_idx) + 1, min(li)) AS end_idx FROM g GROUP BY recording, grp)
  SELECT recording, start_idx, end_idx, {q('(end_idx - start_idx) / 10.0', 'duration')} FROM u WHERE (end_idx - start_idx) / 10.0 BETWEEN 0.2 AND 0.5""")
def _(t):
    return rounded(series.detect_runs(t.signal, ["recording"], "sample_idx", F.col("value") < 40, 10.0, 0.2, 0.5), "duration")


@query("ts12_kinematics", f"""WITH {SIG}, k AS (SELECT event_id, recording, sample_idx, value - lag(value) OVER w AS dx, y - lag(y) OVER w AS dy, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS g
    FROM sig WINDOW w AS (PARTITION BY recording ORDER BY sample_idx)), s AS (SELECT *, sqrt(dx * dx + dy * dy) * 2 AS v FROM k)
  SELECT event_id, {q('dx', 'dx')}, {q('dy', 'dy')}, {q('v', 'speed')}, {q('(v - lag(v) OVER (PARTITION BY recording ORDER BY sample_idx)) * 2', 'accel')}, {q('g', 'gradient')} FROM s""")
def _(t):
    d = series.kinematics(t.signal, ["recording"], "sample_idx", "value", "y", 2.0)
    return d.select("event_id", *[r(c) for c in ("dx", "dy", "speed", "accel", "gradient")])


@query("ts13_speed_limits", f"""WITH {SIG}, g AS (SELECT *, min(CAST(vl AS INT)) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS ok FROM sig), c AS (SELECT recording, sample_idx, CASE WHEN ok THEN value END AS x, CASE WHEN ok THEN y END AS y FROM g),
  k AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) * 2 AS v FROM c WINDOW w AS (PARTITION BY recording ORDER BY sample_idx)), a AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY recording ORDER BY sample_idx)) * 2 AS a FROM k)
  SELECT recording, {q('max(v)', 'speed_max')}, {q('max(a)', 'accel_max')}, count(v) AS n_speed, count(a) AS n_accel, {q('quantile_cont(v, 0.9) * 1.2', 'vmax')}, {q('quantile_cont(a, 0.9) * 1.2', 'amax')} FROM a GROUP BY recording""")
def _(t):
    d = series.speed_limits(t.signal, ["recording"], "sample_idx", "value", "y", F.col("vl"), 2.0, 1, 0.9)
    return rounded(d, "speed_max", "accel_max", "vmax", "amax")


DX = """dx AS (SELECT *, value - lag(value) OVER (PARTITION BY recording ORDER BY sample_idx) AS d FROM sig), dm AS (SELECT recording, median(d) AS med FROM dx GROUP BY recording),
  dd AS (SELECT dx.recording, med, median(abs(d - med)) AS mad FROM dx JOIN dm ON dm.recording = dx.recording GROUP BY ALL)"""


@query("ts14_mask_spikes", f"WITH {SIG}, {DX} SELECT event_id, CASE WHEN mad > 0 AND abs(d) > 3 * 1.4826 * mad THEN NULL ELSE value END AS masked FROM dx JOIN dd USING (recording)")
def _(t):
    return series.mask_spikes(t.signal, ["recording"], "sample_idx", "value", 3.0, "masked").select("event_id", "masked")


RUNS = f"""{DX}, e AS (SELECT recording, sample_idx, sample_idx - row_number() OVER (PARTITION BY recording ORDER BY sample_idx) AS grp FROM dx JOIN dd USING (recording) WHERE mad > 0 AND abs(0.6745 * (d - med) / mad) > 2),
  sp AS (SELECT recording, min(sample_idx) AS start_idx, max(sample_idx) - min(sample_idx) + 1 AS width, (min(sample_idx) + max(sample_idx) - 2) // 2 + 1 AS center FROM e GROUP BY recording, grp HAVING max(sample_idx) - min(sample_idx) + 1 <= 2)"""


@query("ts15_spike_runs", f"WITH {SIG}, {RUNS} SELECT recording, start_idx, width, CAST(center AS BIGINT) AS center FROM sp")
def _(t):
    return series.spike_runs(t.signal, ["recording"], "sample_idx", "value", 2.0, 2)


@query("ts15_detect_spikes", f"""WITH RECURSIVE {SIG}, {RUNS}, k AS (SELECT recording, min(center) AS center FROM sp GROUP BY recording
  UNION ALL SELECT k.recording, (SELECT min(sp.center) FROM sp WHERE sp.recording = k.recording AND sp.center >= k.center + 5) FROM k WHERE k.center IS NOT NULL)
  SELECT recording, CAST(center AS BIGINT) AS center FROM k WHERE center IS NOT NULL""")
def _(t):
    return series.detect_spikes(t.signal, ["recording"], "sample_idx", "value", 2.0, 2, 5).select("recording", "center")


@query("ts16_repair_spikes", f"""WITH {SIG}, {RUNS}, h AS (SELECT DISTINCT recording, center + o AS sample_idx FROM sp, (SELECT unnest([-1, 0, 1]) AS o)),
  v AS (SELECT s.recording, event_id, s.sample_idx, s.sample_idx::DOUBLE AS t, CASE WHEN h.recording IS NULL THEN value END AS gappy FROM sig s LEFT JOIN h USING (recording, sample_idx)), {NB.replace('FROM sig', 'FROM v')}
  SELECT event_id, {q(HOLD, 'repaired')} FROM nb""")
def _(t):
    sp = series.spike_runs(t.signal, ["recording"], "sample_idx", "value", 2.0, 2)
    return series.repair_spikes(t.signal, sp, ["recording"], "sample_idx", "value", 1, "repaired").select("event_id", r("repaired"))


@query("ts17_hold_last", f"WITH {SIG} SELECT event_id, coalesce(last_value(CASE WHEN value <= 100 THEN value END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY sample_idx), 0) AS v, value > 100 AS held FROM sig")
def _(t):
    d = series.hold_last(t.signal, ["recording"], "sample_idx", "value", F.col("value") <= 100, "v")
    return d.select("event_id", "v", "held")


@query("ts18_near_counts", f"""WITH {SIG}, m AS (SELECT a.recording, a.sample_idx, bool_or(abs(a.sample_idx - b.sample_idx) <= 2) AS near FROM sig a LEFT JOIN sig b ON b.recording = a.recording AND b.channel = 'click' WHERE a.value > 100 GROUP BY ALL)
  SELECT recording, count(*) AS total, count(*) FILTER (near) AS near, count(*) FILTER (near IS NOT TRUE) AS isolated, {q('count(*) FILTER (near) / count(*) * 100', 'pct_near')} FROM m GROUP BY recording""")
def _(t):
    d = series.near_counts(t.signal.filter("value > 100"), t.signal.filter("channel = 'click'"), ["recording"], "sample_idx", 2)
    return rounded(d, "pct_near")


SACC = """a AS (SELECT recording, sample_idx, CASE WHEN count(*) OVER f = 5 THEN (abs(sum(value) OVER x - sum(value) OVER p) + abs(sum(y) OVER x - sum(y) OVER p)) / 2 END AS score FROM sig
    WINDOW f AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), x AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), p AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
  qs AS (SELECT recording, quantile_cont(score, 0.5) AS md, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM a GROUP BY recording),
  o AS (SELECT a.*, iqr, coalesce(score > md + 1.0 * iqr, false) AS up, max(score) OVER (PARTITION BY a.recording ORDER BY sample_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM a JOIN qs ON qs.recording = a.recording),
  pk AS (SELECT recording, sample_idx, score FROM o WHERE score = top AND score > 2.0 * iqr),
  k AS (SELECT recording, min(sample_idx) AS sample_idx FROM pk GROUP BY recording UNION ALL SELECT k.recording, (SELECT min(pk.sample_idx) FROM pk WHERE pk.recording = k.recording AND pk.sample_idx >= k.sample_idx + 3) FROM k WHERE k.sample_idx IS NOT NULL)"""


@query("ts19_detect_peaks_events", f"""WITH RECURSIVE {SIG}, {SACC} SELECT k.recording, k.sample_idx AS peak_idx, {q('any_value(pk.score)', 'score')},
  coalesce(max(o.sample_idx) FILTER (NOT up AND o.sample_idx < k.sample_idx) + 1, k.sample_idx) AS onset_idx, coalesce(min(o.sample_idx) FILTER (NOT up AND o.sample_idx > k.sample_idx), k.sample_idx) AS offset_idx
  FROM k JOIN pk ON pk.recording = k.recording AND pk.sample_idx = k.sample_idx JOIN o ON o.recording = k.recording AND o.sample_idx BETWEEN k.sample_idx - 5 AND k.sample_idx + 5 GROUP BY k.recording, k.sample_idx""")
def _(t):
    return rounded(series.detect_peaks_events(t.signal, ["recording"], "sample_idx", "value", "y", 2.0, 1.0, 2, 3, 5), "score")


@query("ts20_rising_edges", f"WITH {SIG}, u AS (SELECT *, value > avg(value) OVER p + 1 * stddev_pop(value) OVER p AS up FROM sig WINDOW p AS (PARTITION BY recording)), e AS (SELECT *, lag(up) OVER (PARTITION BY recording ORDER BY sample_idx) AS was FROM u) SELECT event_id, value FROM e WHERE up AND NOT was")
def _(t):
    return series.rising_edges(t.signal, ["recording"], "sample_idx", "value", 1.0).select("event_id", "value")


SQ = "sq AS (SELECT subject AS channel, subject // 3 AS grp, time_idx, f1 AS value, subject <> 1 AS good FROM emb)"


def _sq(t):
    s = F.col("subject")
    return t.embedded.select(F.lit("r").alias("recording"), s.alias("channel"), F.floor(s / 3).alias("grp"), "time_idx", F.col("f1").alias("value"), (s != 1).alias("good"))


@query("ts21_reref_group", f"""WITH {EMB}, {SQ} SELECT channel, time_idx, {q('CASE WHEN count(*) FILTER (good) OVER g >= 2 THEN value - avg(value) FILTER (good) OVER g ELSE value END', 'by_group')}, {q('value - avg(value) OVER c', 'by_all')}, {q('value - avg(value) FILTER (channel IN (2, 5)) OVER c', 'by_chosen')}
  FROM sq WINDOW g AS (PARTITION BY grp, time_idx), c AS (PARTITION BY time_idx)""")
def _(t):
    d = series.rereference(_sq(t), ["recording"], "time_idx", "channel", "value", "group", "by_group", group="grp", good=F.col("good"))
    d = series.rereference(d, ["recording"], "time_idx", "channel", "value", "common", "by_all")
    d = series.rereference(d, ["recording"], "time_idx", "channel", "value", "channels", "by_chosen", chosen=[2, 5])
    return d.select("channel", "time_idx", r("by_group"), r("by_all"), r("by_chosen"))


@query("ts21_reref_pairs", f"""WITH {EMB}, {SQ}, p AS (SELECT n_nationkey % 10 AS name, n_nationkey % 10 AS anode, (n_nationkey * 3 + 1) % 10 AS cathode, row_number() OVER (PARTITION BY n_nationkey % 10 ORDER BY n_nationkey) AS rn FROM nation)
  SELECT name, time_idx, {q('a.value - b.value', 'diff')} FROM p JOIN sq a ON a.channel = anode JOIN sq b USING (time_idx) WHERE b.channel = cathode AND rn = 1""")
def _(t):
    k = F.col("n_nationkey")
    p = t.nation.select((k % 10).alias("name"), (k % 10).alias("anode"), ((k * 3 + 1) % 10).alias("cathode"), k.alias("ordinal"))
    return series.rereference(_sq(t), ["recording"], "time_idx", "channel", "value", "pairs", "diff", pairs=p).select("name", "time_idx", r("diff"))


@query("ts21_reref_neighbour", f"WITH {EMB}, {SQ} SELECT a.channel, a.time_idx, {q('a.value - b.value', 'diff')} FROM sq a JOIN sq b ON a.grp = b.grp AND a.time_idx = b.time_idx AND b.channel = a.channel + 1")
def _(t):
    d = _sq(t).withColumn("number", F.col("channel"))
    return series.rereference(d, ["recording"], "time_idx", "channel", "value", "neighbour", "diff", group="grp", number="number").select("channel", "time_idx", r("diff"))


@query("ts22_regress_out", f"""WITH {EMB}, {SQ}, n AS (SELECT time_idx, value AS noise FROM sq WHERE channel = 0), j AS (SELECT sq.channel, time_idx, value, noise FROM sq JOIN n USING (time_idx) WHERE sq.channel <> 0)
  SELECT channel, time_idx, {q('value - covar_pop(value, noise) OVER w / var_pop(noise) OVER w * (noise - avg(noise) OVER w)', 'clean')} FROM j WINDOW w AS (PARTITION BY channel)""")
def _(t):
    d = _sq(t)
    noise = d.filter("channel = 0").select("recording", "time_idx", F.col("value").alias("noise"))
    return series.regress_out(d.filter("channel <> 0"), noise, ["recording"], "channel", "time_idx", "value", "clean").select("channel", "time_idx", r("clean"))


@query("ts23_circular_shift", f"WITH {SIG} SELECT event_id, (sample_idx - 7 + 10 * n) % n AS sample_idx FROM (SELECT *, max(sample_idx) OVER (PARTITION BY recording) + 1 AS n FROM sig)")
def _(t):
    return series.circular_shift(t.signal, ["recording"], "sample_idx", F.lit(7)).select("event_id", "sample_idx")


@query("ts24_smooth_decimate", f"WITH {SIG}, s AS (SELECT event_id, sample_idx, avg(value) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM sig) SELECT event_id, {q('v', 'smooth')} FROM s WHERE sample_idx % 3 = 0")
def _(t):
    return series.smooth_decimate(t.signal, ["recording"], "sample_idx", "value", 5, 3, "smooth").select("event_id", r("smooth"))


@query("ts25_align_average", f"""WITH {SIG}, b AS (SELECT recording, min(t) AS a, max(t) AS z FROM sig GROUP BY recording), e AS (SELECT max(a) AS lo, min(z) AS hi FROM b), g AS (SELECT unnest(range(CAST(floor((hi - lo) / 43200) AS BIGINT) + 1)) AS grid_idx, lo FROM e), gt AS (SELECT grid_idx, lo + grid_idx * 43200.0::DOUBLE AS gt FROM g),
  n AS (SELECT recording, sample_idx, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM sig WINDOW w AS (PARTITION BY recording ORDER BY sample_idx)),
  v AS (SELECT grid_idx, gt, recording, CASE WHEN gt = t THEN value ELSE value + (v2 - value) * (gt - t) / (t2 - t) END AS x FROM gt JOIN n ON n.t <= gt AND (gt < n.t2 OR (n.t2 IS NULL AND gt = n.t)))
  SELECT grid_idx, {q('gt', 't')}, {q('avg(x)', 'mean')}, count(x) AS n_series FROM v GROUP BY ALL""")
def _(t):
    return rounded(series.align_average(t.signal, "recording", "t", "value", 43200.0), "t", "mean")


@query("ts26_to_degrees", f"""SELECT event_id, {q('degrees(2 * atan(50.0 / (2 * (value + 60)))) / 1920 * (event_id % 100)', 'deg')}, {q('(event_id % 100) - value', 'disp_x')}, {q('sqrt(power((event_id % 100) - value, 2) + power((event_id % 50) - (event_id % 20), 2))', 'disp_norm')} FROM events""")
def _(t):
    e = F.col("event_id")
    d = series.disparity(t.signal, F.col("value"), F.col("y"), (e % 20).cast("double"), (e % 50).cast("double"))
    return d.select("event_id", r(scalars.to_degrees(F.col("y"), F.col("value") + 60, 50.0, 1920)).alias("deg"), r("disp_x"), r("disp_norm"))


@query("ts26_median_step", f"WITH {SIG}, d AS (SELECT recording, t - lag(t) OVER (PARTITION BY recording ORDER BY sample_idx) AS dt FROM sig) SELECT recording, {q('median(dt)', 'dt')} FROM d GROUP BY recording")
def _(t):
    return rounded(series.median_step(t.signal, ["recording"], "sample_idx", "t"), "dt")


@query("ts27_focus_displacement", f"""WITH g AS (SELECT event_id, value - 35 AS g FROM events) SELECT event_id, {q('CASE WHEN g > 0 THEN 0.283 * abs(g) * (60 + 62) * 5 / (6.3 * 10 - 0.283 * abs(g)) ELSE -0.283 * abs(g) * (60 + 62) * 5 / (6.3 * 10 + 0.283 * abs(g)) END', 'fd')} FROM g""")
def _(t):
    fd = scalars.focus_displacement(F.col("value") - 35, F.lit(60.0), F.lit(62.0), F.lit(6.3))
    return t.events.select("event_id", r(fd).alias("fd"))


@query("ts28_saccade_table", f"""WITH {SIG}, s AS (SELECT recording, event_id, t + 700 AS a, t + 9000.25 AS b FROM sig WHERE channel = 'click'), g AS (SELECT * FROM sig WHERE channel <> 'click'),
  na AS (SELECT s.event_id, g.gappy AS x, g.y, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(g.t - s.a), g.t) AS rn FROM s JOIN g ON g.recording = s.recording), nb AS (SELECT s.event_id, g.gappy AS x, g.y, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(g.t - s.b), g.t) AS rn FROM s JOIN g ON g.recording = s.recording)
  SELECT na.event_id, {q('sqrt(power(nb.x - na.x, 2) + power(nb.y - na.y, 2))', 'dispersion')} FROM na JOIN nb ON na.event_id = nb.event_id AND na.rn = 1 AND nb.rn = 1""")
def _(t):
    s = t.signal.filter("channel = 'click'").select("recording", "event_id", (F.col("t") + 700).alias("onset"), (F.col("t") + 9000.25).alias("fixation"))
    d = series.saccade_table(s, t.signal.filter("channel <> 'click'"), ["recording"], "onset", "fixation", "t", "sample_idx", "gappy", "y")
    return d.select("event_id", r("dispersion"))


@query("ts28_fixation_stats", f"""WITH {SIG}, f AS (SELECT recording, lead(t) OVER (PARTITION BY recording ORDER BY t, event_id) - (t + 30) AS d FROM sig WHERE channel = 'click')
  SELECT recording, count(d) AS n_fixations, {q('avg(d)', 'mean_fixation', 4)}, {q('stddev_pop(d)', 'sd_fixation', 4)}, {q('sum(d)', 'sum_fixation', 4)} FROM f GROUP BY recording""")
def _(t):
    s = t.signal.filter("channel = 'click'").withColumn("fix", F.col("t") + 30)
    return rounded(series.fixation_stats(s, ["recording"], "t", "fix", "event_id"), "mean_fixation", "sd_fixation", "sum_fixation", digits=4)


@query("ts29_rate_sd", f"WITH {SIG}, d AS (SELECT recording, (value - lag(value) OVER (PARTITION BY recording ORDER BY sample_idx)) * 60 AS d FROM sig) SELECT recording, {q('stddev_pop(d)', 'rate_sd')} FROM d GROUP BY recording")
def _(t):
    return rounded(series.rate_sd(t.signal, ["recording"], "sample_idx", "value", 60.0), "rate_sd")
