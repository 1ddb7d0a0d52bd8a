"""Sources, identity parsing, projections and filters."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from catalog.base import SIG, SIZE, STEP, WIN, q, query, r, rounded
from tidegrid.functions import atlas, ids, scalars
from tidegrid.operators import aggs, filters, joins, reshape, series, windows
from tidegrid.session import shared_dir
from tidegrid.sources import tables as src
from tidegrid.sources import textfiles, wide


def _folder(t, name):
    return os.path.join(shared_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


# Event types spelled as electrode labels, for queries on channel names.
LABELS = {"click": "LTG1", "error": "LTG2", "purchase": "RAH1", "signup": "RAH2", "view": "LFP1"}


def _label(col):
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[col]


LABEL_SQL = "CASE channel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"


def _windowed(t):
    """Mean of each complete window, per user."""
    d = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP)
    return windows.window_reduce(d, ["recording"], "value", SIZE, {"mean": "mean"})


def _day_power(t):
    """Mean value per user, label and day: a windowed power table."""
    day = F.floor(F.col("t") / 86400).alias("window_idx")
    return t.signal.groupBy("recording", _label(F.col("channel")).alias("label"), day).agg(r(F.avg("value")).alias("value"))


DAY_SQL = SIG + f", dp AS (SELECT recording, {LABEL_SQL} AS label, CAST(floor(t/86400) AS BIGINT) AS window_idx, {q('avg(value)', 'value')} FROM sig GROUP BY ALL)"


def _label_meta(t):
    """Labels with a region each, from the nations in key order."""
    lab = t.signal.select("channel").distinct().withColumn("label", _label(F.col("channel")))
    key = lab.withColumn("n_nationkey", F.length("channel"))
    return key.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "label", F.col("n_name").alias("DK_Atlas"), F.col("r_name").alias("network"))


META_SQL = f""", lm AS (SELECT label, n_name AS DK_Atlas, r_name AS network FROM
  (SELECT DISTINCT channel, {LABEL_SQL} AS label FROM sig) c JOIN nation ON n_nationkey = length(channel) JOIN region ON n_regionkey = r_regionkey)"""


def _wide_file(t, path):
    """The windowed power of all recordings as one wide file set; returns each
    recording's first window."""
    power = _day_power(t)
    meta = _label_meta(t).join(power.select("recording", "label").distinct(), "label")
    wide.write_wide(wide.to_wide(power, meta, "recording", "window_idx", "label", "value", sorted(LABELS.values()), ["DK_Atlas", "network"]), path)
    return power.groupBy(F.col("recording").cast("string").alias("SubID")).agg(F.min("window_idx").alias("z"))


@query("io01_read_wide", f"WITH {DAY_SQL} SELECT CAST(recording AS VARCHAR) AS recording, label, window_idx, value FROM dp")
def _(t):
    path = _folder(t, "wide")
    zero = _wide_file(t, path)
    _, long = wide.read_wide(t.spark, path)
    return long.filter("value is not null").join(zero, "SubID").select(F.col("SubID").alias("recording"), "label", (F.col("window_idx") + F.col("z")).alias("window_idx"), "value")


@query("io01_read_wide_no_index", f"""WITH {DAY_SQL}, g AS (SELECT DISTINCT recording, window_idx FROM dp),
  k AS (SELECT recording, window_idx, row_number() OVER (PARTITION BY recording ORDER BY window_idx) - 1 AS k FROM g)
  SELECT CAST(recording AS VARCHAR) AS recording, label, k AS window_idx, value FROM dp JOIN k USING (recording, window_idx)""")
def _(t):
    path, bare = _folder(t, "wide"), _folder(t, "bare")
    _wide_file(t, path)
    t.spark.read.option("header", True).csv(path).orderBy("SubID", F.col("row_id").cast("long")).drop("row_id").write.option("header", True).csv(bare)
    _, long = wide.read_wide(t.spark, bare)
    return long.filter("value is not null").select(F.col("SubID").alias("recording"), "label", "window_idx", "value")


@query("io02_to_wide", f"WITH {DAY_SQL}{META_SQL}, u AS (" + f"""
  SELECT recording, 0 AS row_kind, a.i AS row_idx, CASE a.i WHEN 0 THEN 'DK_Atlas_Region' ELSE 'network' END AS atlas, lm.label,
    CASE a.i WHEN 0 THEN DK_Atlas ELSE network END AS v
  FROM (SELECT DISTINCT recording, label FROM dp) d JOIN lm USING (label), (SELECT unnest([0, 1]) AS i) a
  UNION ALL SELECT recording, 1, window_idx, NULL, label, CAST(value AS VARCHAR) FROM dp)
  SELECT row_kind, row_idx, CAST(recording AS VARCHAR) AS subject, atlas, """ + ", ".join(f"max(v) FILTER (label = '{c}') AS \"{c}\"" for c in sorted(LABELS.values()))
  + " FROM u GROUP BY ALL")
def _(t):
    power = _day_power(t)
    meta = _label_meta(t).join(power.select("recording", "label").distinct(), "label")
    w = wide.to_wide(power, meta, "recording", "window_idx", "label", "value", sorted(LABELS.values()), ["DK_Atlas", "network"])
    return w.select("row_kind", "row_idx", F.col("SubID").cast("string").alias("subject"), F.col("Atlas").alias("atlas"), *sorted(LABELS.values()))


@query("io03_read_table", f"""WITH {SIG} SELECT CAST(recording AS VARCHAR) AS recording, CAST(floor(t/3600) AS INT) AS window_id,
  max(value) > 100 AS bad FROM sig GROUP BY ALL""")
def _(t):
    epoch = F.floor(F.col("t") / 3600)
    qc = t.signal.groupBy(F.col("recording").cast("string").alias("recording"), epoch.cast("int").alias("window_id")).agg(
        F.min("sample_idx").alias("start_sample"), (F.min(epoch) * 3600.0).alias("start_time_sec"), (F.min(epoch) * 3600.0 + 3600).alias("end_time_sec"),
        (F.max("value") > 100).alias("bad"), F.lit("").alias("rejection_reason"))
    path = _folder(t, "qc")
    qc.write.option("header", True).csv(path)
    return src.read_table(t.spark, "qc_1s", path).select("recording", "window_id", "bad")


@query("io04_read_many", """SELECT 'nation' AS tag, n_nationkey AS id, n_name AS label, CAST(NULL AS BIGINT) AS region_id FROM nation
  UNION ALL SELECT 'region', r_regionkey, r_name, r_regionkey FROM region""")
def _(t):
    a, b = _folder(t, "csv"), _folder(t, "csv")
    t.nation.select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("Name ")).write.option("header", True).csv(a)
    t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.col("r_regionkey").alias("region_id")).write.option("header", True).csv(b)
    d = src.read_many(t.spark, {"nation": a, "region": b}, {"id": [], "label": ["name"]})
    return d.select("tag", F.col("id").cast("int").alias("id"), "label", F.col("region_id").cast("bigint").alias("region_id"))


@query("io04_read_many_mixed", """SELECT n_nationkey AS id, n_name AS label, CASE WHEN n_nationkey % 3 = 2 THEN n_regionkey END AS region_id FROM nation""")
def _(t):
    """One folder whose files name and order their columns each in its own way."""
    path, key, name, region = _folder(t, "csv"), F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")
    kinds = [[key.alias("ID"), name.alias("Name ")], [name.alias("label"), key.alias("id")], [region.alias("region_id"), key.alias("id"), name.alias("NAME")]]
    for k, cols in enumerate(kinds):
        t.nation.where(f"n_nationkey % 3 = {k}").select(*cols).write.mode("append").option("header", True).csv(path)
    d = src.read_many(t.spark, {"all": path}, {"id": [], "label": ["name"]})
    return d.select(F.col("id").cast("int").alias("id"), "label", F.col("region_id").cast("int").alias("region_id"))


@query("io05_list_inputs", "SELECT DISTINCT r_name AS video, CAST(n_nationkey AS VARCHAR) AS patient, 'run-01' AS run FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    root = _folder(t, "list")
    d.select(F.col("r_name").alias("video"), F.col("n_nationkey").alias("patient"), F.lit("01").alias("run"), "n_name").write.partitionBy("video", "patient", "run").csv(root)
    got = src.list_inputs(t.spark, root, {"video": r"video=([^/]+)/", "patient": r"patient=([^/]+)/", "run": r"run=([^/]+)/"}, "part-*")
    return got.select("video", "patient", F.concat(F.lit("run-"), "run").alias("run")).distinct()


STIM_LINE = {"view": "{t}     EXP     visual_standard: autoDraw = True", "click": "{t}     EXP     visual_deviant: autoDraw = True",
             "purchase": "{t}     EXP     Sound audio_standard started", "signup": "{t}     EXP     Sound audio_deviant started",
             "error": "{t}     EXP     visual_standard: autoDraw = False"}


@query("io06_parse_stim_log", f"""WITH {SIG} SELECT recording, CAST(printf('%.6f', t) AS DOUBLE) AS time_s,
  CASE WHEN channel IN ('view','click') THEN 'visual' ELSE 'auditory' END AS modality,
  CASE WHEN channel IN ('view','purchase') THEN 'standard' ELSE 'deviant' END AS condition, 'start' AS event FROM sig WHERE channel <> 'error'""")
def _(t):
    text = F.lit(None).cast("string")
    for kind, line in STIM_LINE.items():
        text = F.when(F.col("channel") == kind, F.concat(F.format_string("%.6f", "t"), F.lit(line.replace("{t}", "")))).otherwise(text)
    lines = t.signal.select("recording", text.alias("value"))
    return textfiles.parse_stim_log(lines).select("recording", "time_s", "modality", "condition", "event")


@query("io07_merge_bad_channels", f"""WITH {SIG}, f AS (SELECT recording, channel, min(sample_idx) AS o FROM sig WHERE value > 150 GROUP BY ALL),
  g AS (SELECT recording, channel, min(sample_idx) AS o FROM sig WHERE value < 2 GROUP BY ALL),
  u AS (SELECT recording, channel, 0 AS s, o FROM f UNION ALL SELECT recording, channel, 1, o FROM g)
  SELECT recording, channel AS label, min(s) AS source_rank, arg_min(o, s) AS source_order FROM u
  WHERE channel <> 'error' GROUP BY ALL""")
def _(t):
    text = F.concat(F.lit(" "), F.col("channel"), F.lit(" "))
    listed = t.signal.filter("value > 150").groupBy("recording", text.alias("value")).agg(F.min("sample_idx").alias("o"))
    listed = textfiles.parse_bad_channels(listed.unionByName(listed.withColumn("value", F.lit("# bad channels"))))
    recorded = t.signal.filter("value < 2").groupBy("recording", F.col("channel").alias("label")).agg(F.min("sample_idx").alias("o"))
    known = t.signal.filter("channel <> 'error'").select("recording", F.col("channel").alias("label"))
    return textfiles.merge_bad_channels(listed, recorded, known, ["recording"], "label", "o")


@query("io08_signal_store", f"WITH {SIG} SELECT recording, channel, sample_idx, value FROM sig")
def _(t):
    # Users are many and small here, so the store is laid out by channel.
    path = _folder(t, "store")
    src.write_signal(t.signal.select("recording", "channel", "sample_idx", "value"), path, {"source": "events", "log": "none"}, ["channel"], ["recording", "sample_idx"])
    return src.read_signal(t.spark, path).select("recording", "channel", "sample_idx", "value")


@query("io09_write_once", f"WITH {SIG} SELECT channel, count(*) AS n, true AS first_write, false AS second_write FROM sig GROUP BY channel")
def _(t):
    path = _folder(t, "once")
    counts = t.signal.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    a, b = src.write_once(counts, path), src.write_once(counts.filter("false"), path)
    return t.spark.read.parquet(path).select("channel", "n", F.lit(a).alias("first_write"), F.lit(b).alias("second_write"))


@query("io10_keep_annotations", f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'no' ELSE '' END AS include,
  CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE '' END AS exclude_reason FROM customer""")
def _(t):
    blank = t.customer.select("c_custkey", F.lit("").alias("include"), F.lit("").alias("exclude_reason"))
    seen = t.customer.filter("c_custkey % 3 <> 0 or c_acctbal < 0").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "no").otherwise(" ").alias("include"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("").alias("exclude_reason"))
    path = _folder(t, "coverage")
    src.write_coverage(seen, path)
    src.write_coverage(blank, path)
    return src.keep_annotations(t.spark.read.parquet(f"{path}_rescan"), t.spark.read.parquet(path), ["c_custkey"], ["include", "exclude_reason"])


@query("io11_run_log", """SELECT c_custkey, count(o_orderkey) AS n_rows, count(DISTINCT o_orderstatus) AS n_entries,
  CASE WHEN count(o_orderkey) > 0 THEN 'loaded' ELSE 'missing' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def _(t):
    loaded = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return aggs.run_log(loaded, ["c_custkey"], t.customer.select("c_custkey"), "o_orderstatus")


NAME = "concat(CASE WHEN c_custkey % 2 = 0 THEN 'NS' ELSE 'lh' END, CAST(c_custkey AS VARCHAR), CASE WHEN c_nationkey % 3 = 0 THEN '_02' ELSE '' END, CASE WHEN c_custkey % 5 < 3 THEN '_ses-' || CAST(c_nationkey AS VARCHAR) ELSE '' END, CASE WHEN c_custkey % 7 < 4 THEN '_run-' || CAST(c_custkey % 12 AS VARCHAR) ELSE '' END)"
NAMES = f"nm AS (SELECT c_custkey, {NAME} AS entry FROM customer)"


def _entries(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.concat(
        F.when(k % 2 == 0, "NS").otherwise("lh"), k.cast("string"), F.when(n % 3 == 0, "_02").otherwise(""),
        F.when(k % 5 < 3, F.concat(F.lit("_ses-"), n.cast("string"))).otherwise(""),
        F.when(k % 7 < 4, F.concat(F.lit("_run-"), (k % 12).cast("string"))).otherwise(""))
    return t.customer.select("c_custkey", name.alias("entry"))


@query("pr01_patient_id", f"WITH {NAMES} SELECT c_custkey, upper(regexp_extract(entry, '(?i)^((?:NS|LH)\\d+(?:_\\d+)?)', 1)) AS patient FROM nm")
def _(t):
    return _entries(t).select("c_custkey", ids.patient_id(F.col("entry")).alias("patient"))


@query("pr02_run_label", f"WITH {NAMES} SELECT c_custkey, CASE WHEN regexp_matches(entry, 'run-\\d+') THEN printf('run-%02d', CAST(regexp_extract(entry, 'run-(\\d+)', 1) AS INT)) ELSE 'run-01' END AS run FROM nm")
def _(t):
    return _entries(t).select("c_custkey", ids.run_label(F.col("entry")).alias("run"))


@query("pr03_session_label", f"""WITH {NAMES} SELECT c_custkey, CASE WHEN regexp_matches(entry, 'ses-\\d+') THEN printf('ses-%02d', CAST(regexp_extract(entry, 'ses-(\\d+)', 1) AS INT))
  WHEN regexp_matches(entry, '^[A-Za-z]+\\d+_\\d') THEN 'ses-02' ELSE 'ses-01' END AS session FROM nm""")
def _(t):
    e = F.col("entry")
    return _entries(t).select("c_custkey", ids.session_label(e, ids.patient_id(e)).alias("session"))


@query("pr04_entry_key", f"""WITH {NAMES} SELECT c_custkey, regexp_extract(entry, '^([A-Za-z]+\\d+(_02)?)', 1) AS patient,
  nullif(regexp_extract(entry, '_(ses-\\d+)', 1), '') AS session, nullif(regexp_extract(entry, '_(run-\\d+)', 1), '') AS run,
  concat_ws('_', regexp_extract(entry, '^([A-Za-z]+\\d+(_02)?)', 1), nullif(regexp_extract(entry, '_(ses-\\d+)', 1), ''), nullif(regexp_extract(entry, '_(run-\\d+)', 1), '')) AS entry_id FROM nm""")
def _(t):
    d = _entries(t).select("c_custkey", ids.parse_entry(F.col("entry")).alias("p")).select("c_custkey", "p.*")
    return d.withColumn("entry_id", ids.entry_id(F.col("patient"), F.col("session"), F.col("run")))


SEGMENTS = {"durables": ["AUTOMOBILE", "MACHINERY"], "home": ["FURNITURE", "HOUSEHOLD"]}


@query("pr05_canonical", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN 'durables' WHEN c_mktsegment IN ('FURNITURE','HOUSEHOLD') THEN 'home' END AS video FROM customer")
def _(t):
    return t.customer.select("c_custkey", ids.canonical(F.col("c_mktsegment"), SEGMENTS).alias("video"))


FILE = "concat('sub-', CAST(page_id AS VARCHAR), CASE WHEN page_id % 4 = 0 THEN '_ses-implant' || CAST(page_id % 3 AS VARCHAR) ELSE '' END, '_task-', CASE WHEN url LIKE '%/en/%' THEN 'DespMeEng' WHEN url LIKE '%/fr/%' THEN 'inscapes' ELSE 'rest' END, CASE WHEN page_id % 3 = 0 THEN '_run-' || CAST(page_id % 11 AS VARCHAR) ELSE '' END, '_ieeg_prep.fif')"


@query("pr06_recording_name", f"""WITH f AS (SELECT page_id, {FILE} AS name FROM pages) SELECT page_id, regexp_extract(name, 'ses-([A-Za-z0-9]+)', 1) AS session,
  CASE regexp_extract(name, 'task-([A-Za-z]+)', 1) WHEN 'DespMeEng' THEN 'despicable_me_english' WHEN 'inscapes' THEN 'inscapes' END AS video,
  CASE WHEN regexp_matches(name, 'run-\\d') THEN printf('%02d', CAST(regexp_extract(name, 'run-(\\d+)', 1) AS INT)) ELSE '01' END AS run FROM f""")
def _(t):
    p, u = F.col("page_id"), F.col("url")
    name = F.concat(
        F.lit("sub-"), p.cast("string"), F.when(p % 4 == 0, F.concat(F.lit("_ses-implant"), (p % 3).cast("string"))).otherwise(""),
        F.lit("_task-"), F.when(u.contains("/en/"), "DespMeEng").when(u.contains("/fr/"), "inscapes").otherwise("rest"),
        F.when(p % 3 == 0, F.concat(F.lit("_run-"), (p % 11).cast("string"))).otherwise(""), F.lit("_ieeg_prep.fif"))
    return t.pages.select("page_id", ids.recording_name(name).alias("n")).select("page_id", "n.*")


@query("pr07_electrode_columns", "SELECT c_custkey, 'L' || replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '#' END) AS label FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    label = F.concat(F.lit("L"), F.regexp_replace("c_name", "#", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("#")))
    return t.customer.select("c_custkey", label.alias("label")).filter(ids.is_electrode(F.col("label")))


@query("pr08_electrode_group", "SELECT p_brand AS label, regexp_replace(p_brand, '\\d+$', '') AS grp, count(*) AS n, count(*) >= 3 AS kept FROM part GROUP BY p_brand")
def _(t):
    d = t.part.groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("label", ids.electrode_group(F.col("label")).alias("grp"), "n", (F.col("n") >= 3).alias("kept"))


HEM = "[' left', 'LH', 'r', 'Right ', 'mid']"


@query("pr09_norm_hem", f"""WITH h AS (SELECT c_custkey, {HEM}[c_custkey % 5 + 1] AS hem, '  ' || lower(c_mktsegment) || ' ' AS lab FROM customer)
  SELECT c_custkey, CASE WHEN upper(trim(hem)) IN ('L','LH','LEFT') THEN 'L' WHEN upper(trim(hem)) IN ('R','RH','RIGHT') THEN 'R' ELSE '' END AS hem, upper(trim(lab)) AS label FROM h""")
def _(t):
    hem = F.array(*[F.lit(x) for x in (" left", "LH", "r", "Right ", "mid")])[(F.col("c_custkey") % 5).cast("int")]
    lab = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return t.customer.select("c_custkey", ids.norm_hem(hem).alias("hem"), ids.norm_label(lab).alias("label"))


@query("pr10_standardise", "SELECT p_partkey AS label, p_type AS desikan_killiany, p_brand AS aparc_aseg, p_size FROM part")
def _(t):
    raw = t.part.select(F.col("p_partkey").alias("LABEL"), F.col("p_type").alias("Desikan-Killiany"), F.col("p_brand").alias("aparc aseg"), "p_size")
    return src.standardise(raw, {"label": [], "desikan_killiany": ["desikan-killiany", "desikan killiany", "dk"], "aparc_aseg": ["aparc-aseg", "aparc aseg", "aparc_aseg_atlas"]})


@query("pr11_translate", "SELECT p_partkey, CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(atlas.YEO7_LONG.values(), 1)) +
       " ELSE '7Networks_' || CAST(p_size % 9 AS VARCHAR) END AS y7, CASE p_size % 19 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(atlas.YEO17.values(), 1)) +
       " ELSE '17Networks_' || CAST(p_size % 19 AS VARCHAR) END AS y17 FROM part")
def _(t):
    def code(k):
        return F.concat(F.lit(f"{k - 2}Networks_"), (F.col("p_size") % k).cast("string"))
    return t.part.select("p_partkey", atlas.translate(code(9), "y7_long").alias("y7"), atlas.translate(code(19), "y17").alias("y17"))


@query("pr12_map_network", """SELECT p_partkey, CASE WHEN p_brand LIKE '%#1%' THEN 'EXCLUDE' WHEN p_brand IN ('Brand#2','Brand#3') THEN 'DMN'
  WHEN lower(trim(p_type)) IN ('economy','promo') THEN 'DMN' WHEN lower(trim(p_type)) IN ('standard') THEN 'FPCN_A' ELSE 'OTHER' END AS rule,
  'OTHER' AS fixed_rule FROM part""")
def _(t):
    rule = atlas.network_rule(F.col("p_type"), F.col("p_brand"), ["#1"], {"DMN": ["Brand#2", "Brand#3"]}, {"DMN": ["economy", "promo"], "FPCN_A": ["standard"]})
    return t.part.select("p_partkey", rule.alias("rule"), atlas.map_network(F.col("p_type"), F.col("p_brand")).alias("fixed_rule"))


@query("pr13_remap_ids", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def _(t):
    m = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return reshape.remap_ids(t.orders.select("o_orderkey", "o_custkey"), m, "o_custkey", "old", "new").select("o_orderkey", "o_custkey")


@query("pr14_log_power", f"SELECT event_id, {q('log10(greatest(value - 0.05, 1e-3))', 'log_floor')}, {q('log10(value + 1e-6)', 'log_compressed')} FROM events")
def _(t):
    return t.events.select("event_id", r(scalars.log_power(F.col("value") - 0.05, 1e-3)).alias("log_floor"), r(scalars.compressed_log(F.col("value"))).alias("log_compressed"))


@query("pr15_window_time", "SELECT event_id, event_id % 236 AS window_idx, round((event_id % 236) * 2.5::DOUBLE, 6) AS start_sec, printf('%02d:%02d', CAST(floor((event_id % 236) * 2.5) AS BIGINT) // 60, CAST(floor((event_id % 236) * 2.5) AS BIGINT) % 60) AS movie_time FROM events")
def _(t):
    w = F.col("event_id") % 236
    return t.events.select("event_id", w.alias("window_idx"), scalars.window_start(w).alias("start_sec"), scalars.mmss(w * 2.5).alias("movie_time"))


@query("pr16_expand_labels", "SELECT doc_id, quality, unnest(range(doc_id * 4, doc_id * 4 + 4)) AS short_idx FROM labels")
def _(t):
    from tidegrid.operators.states import expand_labels
    return expand_labels(t.labels.select("doc_id", "quality"), "doc_id", 4)


@query("pr17_unscale", f"SELECT event_id, {q('value', 'value')} FROM events")
def _(t):
    st = series.robust_stats(t.signal, ["recording"], "value")
    z = series.robust_z(t.signal.select("event_id", "recording", "value"), ["recording"], "value", "z")
    return series.unscale(z, st, ["recording"], "z", "back").select("event_id", r(F.col("back")).alias("value"))


@query("fi01_usable_channels", f"""WITH {SIG}, k AS (SELECT * FROM sig WHERE channel <> 'error' AND channel IN ('click','error','view','signup')),
  a AS (SELECT recording, channel FROM k GROUP BY ALL HAVING stddev_pop(value) > 1e-6) SELECT k.recording, k.channel, k.event_id FROM k JOIN a USING (recording, channel)""")
def _(t):
    ch = t.signal.select("channel").distinct()
    meta = ch.filter(F.col("channel").isin("click", "error", "view", "signup"))
    return filters.usable_channels(t.signal, meta, ch.filter("channel = 'error'"), keys=["recording", "channel"], channel="channel", value="value").select("recording", "channel", "event_id")


@query("fi02_keep_regions", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def _(t):
    d = joins.attach_meta(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, ["n_nationkey"])
    d = joins.attach_meta(d.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"])
    return filters.keep_regions(d, "r_name", ["ASIA", "EUROPE"]).select("s_suppkey", "n_name", "r_name")


@query("fi03_clean_xy", f"""WITH {SIG}, v AS (SELECT *, vl AND vr AND value BETWEEN -25 AND 125 AND y BETWEEN -25 AND 125 AS ok FROM sig)
  SELECT event_id, ok AS valid, CASE WHEN ok THEN value END AS x, CASE WHEN ok THEN y END AS y FROM v""")
def _(t):
    d = t.signal.withColumn("x", F.col("value"))
    return filters.clean_xy(d, "x", "y", F.col("vl") & F.col("vr"), -25, 125).select("event_id", "valid", "x", "y")


@query("fi04_crop_rezero", f"""WITH {SIG}, b AS (SELECT recording, quantile_cont(t, 0.25) AS s, quantile_cont(t, 0.75) AS e FROM sig GROUP BY recording),
  c AS (SELECT sig.* FROM sig JOIN b USING (recording) WHERE t > s AND t < e)
  SELECT event_id, {q('t - min(t) OVER (PARTITION BY recording)', 't')} FROM c""")
def _(t):
    from tidegrid.operators.group import percentiles
    b = percentiles(t.signal, ["recording"], "t", {"start": 0.25, "end": 0.75})
    return filters.crop_rezero(t.signal, b, ["recording"], "t").select("event_id", r("t"))


PEAKS = "SELECT l_orderkey, l_linenumber, l_quantity AS cf, l_extendedprice AS amp, round(l_tax * 100, 6) + 3 AS bw, 1.0::DOUBLE AS lo, 50.0::DOUBLE AS hi FROM lineitem"


def _peaks(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("cf"), F.col("l_extendedprice").alias("amp"),
                             (F.round(F.col("l_tax") * 100, 6) + 3).alias("bw"), F.lit(1.0).alias("lo"), F.lit(50.0).alias("hi"))


@query("fi05_filter_peaks", f"""WITH p AS ({PEAKS}), f AS (SELECT *, bw >= 10 - 1e-6 AS b, cf <= lo + 1 OR cf >= hi - 1 AS e FROM p)
  SELECT count(*) FILTER (b) AS at_bandwidth_ceiling, count(*) FILTER (e) AS near_fit_edge, count(*) FILTER (NOT (b OR e)) AS kept,
  {q('100.0 * count(*) FILTER (b OR e) / greatest(count(*), 1)', 'dropped_pct')} FROM f""")
def _(t):
    _, report = filters.filter_peaks(_peaks(t), "bw", "cf", F.col("lo"), F.col("hi"))
    return rounded(report, "dropped_pct")


@query("fi06_having_min", """WITH g AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(CASE WHEN o_orderstatus = 'F' THEN 1 END) >= 3 AND count(CASE WHEN o_orderstatus = 'O' THEN 1 END) >= 2)
  SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (FROM g)""")
def _(t):
    st = F.col("o_orderstatus")
    return filters.having_min(t.orders, ["o_custkey"], {"f": (F.when(st == "F", 1), 3), "o": (F.when(st == "O", 1), 2)}).select("o_orderkey", "o_custkey")


@query("fi07_debounce", f"""WITH RECURSIVE {SIG}, k AS (
  SELECT recording, sample_idx, t, event_id FROM sig WHERE sample_idx = 0
  UNION ALL SELECT n.recording, n.sample_idx, n.t, n.event_id FROM k, LATERAL (
    SELECT * FROM sig s WHERE s.recording = k.recording AND s.t - k.t >= 21600 ORDER BY s.t, s.event_id LIMIT 1) n)
  SELECT recording, event_id FROM k""")
def _(t):
    return filters.debounce(t.signal.select("recording", "event_id", "t"), ["recording"], "t", 21600.0, "event_id").select("recording", "event_id")


@query("fi08_stride", f"WITH {WIN} SELECT recording, window_idx, {q('avg(value)', 'mean')} FROM win GROUP BY ALL HAVING count(*) = {SIZE} AND window_idx % 4 = 0")
def _(t):
    return rounded(filters.stride(_windowed(t), "window_idx", 4), "mean")


@query("fi09_sample_even", f"""WITH {SIG}, n AS (SELECT recording, max(sample_idx) + 1 AS n FROM sig GROUP BY recording),
  p AS (SELECT DISTINCT recording, CASE WHEN n <= 10 THEN j ELSE (j * (n - 1)) // 9 END AS sample_idx FROM n, (SELECT unnest(range(10)) AS j) WHERE n > 10 OR j < n)
  SELECT recording, event_id FROM sig JOIN p USING (recording, sample_idx)""")
def _(t):
    return filters.sample_even(t.signal, ["recording"], ["t", "event_id"], 10).select("recording", "event_id")


@query("fi09_sample_random", f"""WITH {SIG}, c AS (SELECT DISTINCT recording, channel FROM sig),
  k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY CAST(('0x' || substr(md5('5-' || recording || '-' || channel), 1, 12)) AS BIGINT), channel) AS rn FROM c)
  SELECT recording, channel, event_id FROM sig JOIN k USING (recording, channel) WHERE rn <= 2""")
def _(t):
    return filters.sample_random(t.signal, ["recording"], "channel", 2, 5).select("recording", "channel", "event_id")


@query("fi10_flag_implausible", "SELECT user_id AS recording, count(value) AS n_events, count(*) FILTER (value > 150) AS n_implausible, max(value) AS max_velocity FROM events GROUP BY user_id")
def _(t):
    return filters.flag_implausible(t.signal, ["recording"], "value", 150)
