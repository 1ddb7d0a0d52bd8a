"""Spectra, aggregations, events, states, statistics and quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.base import CH, DIMS, EMB, EMBL, SIG, SIZE, STEP, WIN, q, query, r, rounded
from catalog.inputs import DAY_SQL, META_SQL, PEAKS, _day_power, _label_meta, _peaks
from tidegrid.functions import scalars
from tidegrid.operators import aggs, events, filters, joins, multivar, quality, reshape, series, spectral, states, stats, windows
from tidegrid.plans import flows
from tidegrid.session import settle


# ---- spectra. The signal per channel at 8 samples per second, segments of 16.

FS, SEG = 8.0, 16
TAPER = f"(0.54 - 0.46 * cos(2 * pi() * j / {SEG}))"
SCALE = float(FS * sum((0.54 - 0.46 * np.cos(2 * np.pi * j / SEG)) ** 2 for j in range(SEG)))
PSD = f"""sg AS (SELECT s.recording, k.seg, s.sample_idx - k.seg * 8 AS j, s.value AS v FROM sig s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((s.sample_idx - 15) / 8.0) AS BIGINT)), s.sample_idx // 8 + 1)) AS seg) k),
  sm AS (SELECT recording, seg, avg(v) AS m FROM sg GROUP BY ALL HAVING count(*) = {SEG}), fr AS (SELECT unnest(range(9)) AS k),
  ft AS (SELECT recording, seg, k, sum((v - m) * {TAPER} * cos(2 * pi() * k * j / {SEG})) AS re, sum((v - m) * {TAPER} * sin(2 * pi() * k * j / {SEG})) AS im FROM sg JOIN sm USING (recording, seg), fr GROUP BY ALL),
  psd AS (SELECT recording, k * {FS / SEG}::DOUBLE AS freq, avg((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / {SCALE!r}) AS power, count(*) AS n_segments FROM ft GROUP BY ALL)"""


def _psd(t, fmin=0.0):
    return spectral.welch_psd(t.signal, ["recording"], "sample_idx", "value", FS, SEG, fmin=fmin)


@query("sp01_welch_psd", f"WITH {SIG}, {PSD} SELECT recording, freq, {q('power', 'power', 5)}, n_segments FROM psd")
def _(t):
    return rounded(_psd(t), "power", digits=5)


@query("sp01_welch_absent", f"WITH {SIG.replace('sig AS', 'whole AS', 1)}, sig AS (SELECT * FROM whole WHERE event_id % 11 <> 0), {PSD} SELECT recording, freq, {q('power', 'power', 5)}, n_segments FROM psd")
def _(t):
    """Samples that are not there leave gaps; those after them stay where they are."""
    return rounded(spectral.welch_psd(t.signal.where("event_id % 11 <> 0"), ["recording"], "sample_idx", "value", FS, SEG), "power", digits=5)


WAVES = [(1.0, 2.0), (2.0, 3.0)]


# The wavelet in SQL: a complex wave under a Gaussian of `c` cycles, less its
# mean, of power two.
WAVE_SQL = f"""wp(freq, c) AS (VALUES {", ".join(f"({f}::DOUBLE, {c}::DOUBLE)" for f, c in WAVES)}), ws AS (SELECT freq, c / (2 * pi() * freq) AS sigma FROM wp),
  wt AS (SELECT freq, sigma, o, o / {FS} AS t FROM ws, LATERAL (SELECT unnest(range(-200, 201)) AS o) WHERE abs(o) < 5 * sigma * {FS}),
  wr AS (SELECT freq, o, (cos(2 * pi() * freq * t) - exp(-2 * power(pi() * freq * sigma, 2))) * exp(-t * t / (2 * sigma * sigma)) AS re, sin(2 * pi() * freq * t) * exp(-t * t / (2 * sigma * sigma)) AS im FROM wt),
  wv AS (SELECT freq, o, re / sqrt(0.5 * n) AS re, im / sqrt(0.5 * n) AS im FROM wr JOIN (SELECT freq, sum(re * re + im * im) AS n FROM wr GROUP BY freq) USING (freq))"""


@query("sp02_tf_power", f"""WITH {SIG}, {WAVE_SQL}, c AS (SELECT recording, sample_idx AS at0 FROM sig WHERE sample_idx % 2 = 0)
  SELECT c.recording, at0 AS sample_idx, freq, {q('power(sum(s.value * re), 2) + power(sum(s.value * im), 2)', 'power', 4)} FROM c JOIN sig s ON s.recording = c.recording JOIN wv ON o = at0 - s.sample_idx GROUP BY ALL""")
def _(t):
    d = spectral.tf_power(t.signal, ["recording"], "sample_idx", "value", FS, [f for f, _ in WAVES], [c for _, c in WAVES], 2)
    return rounded(d, "power", digits=4)


@query("sp02_tf_power_absent", f"""WITH {SIG.replace('sig AS', 'whole AS', 1)}, sig AS (SELECT * FROM whole WHERE event_id % 11 <> 0), {WAVE_SQL},
  b AS (SELECT recording, min(sample_idx) AS lo, max(sample_idx) AS hi FROM sig GROUP BY 1), c AS (SELECT recording, unnest(range(0, hi + 1, 2)) AS at0, lo, hi FROM b),
  g AS (SELECT recording, at0, freq, at0 - o AS at, re, im, at0 - o BETWEEN lo AND hi AS due FROM c, wv)
  SELECT g.recording, at0 AS sample_idx, freq, CASE WHEN bool_or(due AND s.value IS NULL) THEN NULL ELSE {q('power(coalesce(sum(s.value * re), 0), 2) + power(coalesce(sum(s.value * im), 0), 2)', 'x', 4).rsplit(' AS ', 1)[0]} END AS power
  FROM g LEFT JOIN sig s ON s.recording = g.recording AND s.sample_idx = g.at GROUP BY ALL""")
def _(t):
    d = spectral.tf_power(t.signal.where("event_id % 11 <> 0"), ["recording"], "sample_idx", "value", FS, [f for f, _ in WAVES], [c for _, c in WAVES], 2)
    return rounded(d, "power", digits=4)


TEST_BANDS = {"low": ((0.5, 1.5), 0.5), "high": ((1.5, 4.0), 1.0)}


@query("sp04_band_power", f"""WITH {SIG}, {PSD}, b(band, bin, lo, hi, last) AS (VALUES ('low', 0, 0.5, 1.0, false), ('low', 1, 1.0, 1.5, true), ('high', 0, 1.5, 2.5, false), ('high', 1, 2.5, 3.5, false), ('high', 2, 3.5, 4.0, true)),
  m AS (SELECT recording, band, bin, avg(power) AS p FROM psd JOIN b ON freq >= lo AND (freq < hi OR (last AND freq <= hi)) GROUP BY ALL)
  SELECT recording, band, {q('avg(p)', 'power', 5)}, count(*) AS n_bins FROM m GROUP BY ALL""")
def _(t):
    return rounded(spectral.band_power(_psd(t), ["recording"], "freq", "power", TEST_BANDS), "power", digits=5)


@query("sp05_band_ratio", f"""WITH {SIG}, {PSD} SELECT recording, {q('avg(power) FILTER (freq BETWEEN 0.5 AND 1.5)', 'num', 5)}, {q('avg(power) FILTER (freq BETWEEN 2 AND 4)', 'den', 5)},
  {q('avg(power) FILTER (freq BETWEEN 0.5 AND 1.5) / avg(power) FILTER (freq BETWEEN 2 AND 4)', 'ratio')} FROM psd GROUP BY recording""")
def _(t):
    return rounded(rounded(spectral.band_ratio(_psd(t), ["recording"], (0.5, 1.5), (2, 4)), "ratio"), "num", "den", digits=5)


@query("sp05_line_noise_ratio", f"""WITH {SIG}, {PSD}, a AS (SELECT recording, avg(power) FILTER (freq BETWEEN 1 AND 150) AS broad, (avg(power) FILTER (freq BETWEEN 0.95 AND 1.05) + avg(power) FILTER (freq BETWEEN 1.95 AND 2.05) + avg(power) FILTER (freq BETWEEN 2.95 AND 3.05)) / 3 AS line FROM psd GROUP BY recording)
  SELECT recording, {q('broad', 'broad', 5)}, {q('line', 'line', 5)}, {q('line / (broad + 1e-12)', 'ratio')} FROM a""")
def _(t):
    return rounded(rounded(spectral.line_noise_ratio(_psd(t), ["recording"], 1.0, 0.05), "ratio"), "broad", "line", digits=5)


@query("sp06_psd_outliers", f"""WITH {SIG}, {PSD}, d AS (SELECT recording, freq, 10 * log10(power) AS db FROM psd WHERE freq > 0), s AS (SELECT freq, median(db) AS m, stddev_pop(db) AS sd FROM d GROUP BY freq)
  SELECT recording, {q('max(abs(db - m) / sd)', 'max_z')}, max(abs(db - m) / sd) > 3 AS outlier FROM d JOIN s USING (freq) GROUP BY recording""")
def _(t):
    return rounded(spectral.psd_outliers(_psd(t, 0.5), ["recording"], [], 3.0), "max_z")


FIT = """lg AS (SELECT recording, freq, log10(freq) AS x, log10(power) AS y FROM psd WHERE freq BETWEEN 0.5 AND 4), l1 AS (SELECT recording, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM lg GROUP BY recording),
  rz AS (SELECT lg.*, greatest(y - a - b * x, 0) AS z FROM lg JOIN l1 USING (recording)), ct AS (SELECT recording, quantile_cont(z, 0.00025) AS c FROM rz GROUP BY recording),
  l2 AS (SELECT recording, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM rz JOIN ct USING (recording) WHERE z <= c GROUP BY recording), fl AS (SELECT recording, freq, y, a + b * x AS f, y - a - b * x AS flat, a, b FROM lg JOIN l2 USING (recording))"""


@query("sp07_aperiodic_fit", f"WITH {SIG}, {PSD}, {FIT} SELECT recording, {q('min(a)', 'offset', 5)}, {q('-min(b)', 'exponent', 5)}, {q('power(corr(y, f), 2)', 'r2', 5)}, {q('avg(abs(y - f))', 'error', 5)}, count(*) AS n_freqs FROM fl GROUP BY recording")
def _(t):
    return rounded(spectral.aperiodic_fit(_psd(t), ["recording"], 0.5, 4), "offset", "exponent", "r2", "error", digits=5)


def _flat(t):
    psd = settle(_psd(t), "psd")
    return spectral.flatten(psd, spectral.aperiodic_fit(psd, ["recording"], 0.5, 4), ["recording"], 0.5, 4)


@query("sp08_band_readout", f"""WITH {SIG}, {PSD}, {FIT} SELECT recording, {q('max(flat) FILTER (freq >= 1 AND freq < 2.5)', 'mid_flat_max', 5)}, arg_max(freq, flat) FILTER (freq >= 1 AND freq < 2.5) AS mid_argmax_hz,
  {q('avg(flat) FILTER (freq >= 1 AND freq < 2.5)', 'periodic_mid', 5)}, coalesce(max(flat) FILTER (freq >= 1 AND freq < 2.5) >= 0.2, false) AS has_mid FROM fl GROUP BY recording""")
def _(t):
    return rounded(spectral.band_readout(_flat(t), ["recording"], {"mid": (1.0, 2.5)}), "mid_flat_max", "periodic_mid", digits=5)


@query("sp09_knee_freq", f"SELECT p_partkey, CASE WHEN p_size > 3 AND p_retailprice > 901 THEN {q('power((p_retailprice - 901), 1.0 / (p_size - 3))', 'x').rsplit(' AS ', 1)[0]} END AS knee_hz FROM part")
def _(t):
    return t.part.select("p_partkey", r(scalars.knee_freq(F.col("p_retailprice") - 901, (F.col("p_size") - 3).cast("double"))).alias("knee_hz"))


@query("sp10_local_peaks", f"""WITH {SIG}, {PSD}, {FIT}, n AS (SELECT *, lag(flat) OVER w AS l, lead(flat) OVER w AS g FROM fl WINDOW w AS (PARTITION BY recording ORDER BY freq)), p AS (SELECT * FROM n WHERE flat > l AND flat >= g AND flat >= 0.05)
  SELECT p.recording, p.freq AS cf, {q('p.flat', 'height', 5)}, {q('coalesce(min(o.freq) FILTER (o.freq > p.freq AND o.flat < p.flat / 2), max(o.freq)) - coalesce(max(o.freq) FILTER (o.freq < p.freq AND o.flat < p.flat / 2), min(o.freq))', 'width')}
  FROM p JOIN fl o ON o.recording = p.recording GROUP BY p.recording, p.freq, p.flat""")
def _(t):
    return rounded(rounded(spectral.local_peaks(_flat(t), ["recording"], 0.05, FS / SEG), "width"), "height", digits=5)


@query("sp11_compare_fits", f"""WITH {SIG}, {PSD}, {FIT}, u AS (SELECT l1.recording, l1.a AS a1, -l1.b AS b1, l2.a AS a2, -l2.b AS b2 FROM l1 JOIN l2 USING (recording))
  SELECT 'offset' AS output, {q('corr(a1, a2)', 'r', 5)}, {q('avg(a1 - a2)', 'bias', 5)}, count(*) AS n FROM u UNION ALL SELECT 'exponent', {q('corr(b1, b2)', 'r', 5)}, {q('avg(b1 - b2)', 'bias', 5)}, count(*) FROM u""")
def _(t):
    psd = settle(_psd(t), "psd")
    a, b = (spectral.aperiodic_fit(psd, ["recording"], 0.5, 4, refit=x) for x in (False, True))
    return rounded(spectral.compare_fits(a, b, ["recording"], ["offset", "exponent"]), "r", "bias", digits=5)


@query("sp11_bias_against", f"""WITH {SIG}, {PSD}, {FIT}, u AS (SELECT l1.recording, l1.a AS a1, -l1.b AS b1, l2.a AS a2, -l2.b AS b2, v FROM l1 JOIN l2 USING (recording) LEFT JOIN (SELECT recording, avg(value) AS v FROM sig GROUP BY 1) USING (recording))
  SELECT 'offset' AS output, {q('corr(a1, a2)', 'r', 5)}, {q('avg(a1 - a2)', 'bias', 5)}, count(*) AS n, {q('corr(a1 - a2, v)', 'r_level', 5)} FROM u UNION ALL SELECT 'exponent', {q('corr(b1, b2)', 'r', 5)}, {q('avg(b1 - b2)', 'bias', 5)}, count(*), {q('corr(b1 - b2, v)', 'r_level', 5)} FROM u""")
def _(t):
    psd = settle(_psd(t), "psd")
    a, b = (spectral.aperiodic_fit(psd, ["recording"], 0.5, 4, refit=x) for x in (False, True))
    level = t.signal.groupBy("recording").agg(F.avg("value").alias("level"))
    return rounded(spectral.compare_fits(a, b, ["recording"], ["offset", "exponent"], level, ["level"]), "r", "bias", "r_level", digits=5)


# ---- aggregations


@query("ag01_summary", f"SELECT event_type, {q('avg(value)', 'mean')}, {q('stddev_samp(value)', 'sd')}, min(value) AS min, max(value) AS max, {q('median(value)', 'median')}, count(value) AS n, {q('avg(abs(value))', 'abs_mean')} FROM events GROUP BY event_type")
def _(t):
    return rounded(aggs.summary(t.events, ["event_type"], "value"), "mean", "sd", "median", "abs_mean")


@query("ag02_describe", f"SELECT l_returnflag, count(*) AS n, {q('avg(l_extendedprice)', 'mean')}, {q('stddev_samp(l_extendedprice)', 'sd')}, min(l_extendedprice) AS min, max(l_extendedprice) AS max, {q('quantile_cont(l_extendedprice, 0.25)', 'q25')}, {q('quantile_cont(l_extendedprice, 0.5)', 'q50')}, {q('quantile_cont(l_extendedprice, 0.75)', 'q75')} FROM lineitem GROUP BY 1")
def _(t):
    return rounded(aggs.describe_by(t.lineitem, ["l_returnflag"], "l_extendedprice"), "mean", "sd", "q25", "q50", "q75")


@query("ag03_shape", f"SELECT user_id AS recording, count(value) AS n, {q('skewness(value)', 'skew')}, {q('kurtosis(value)', 'kurtosis')} FROM events GROUP BY user_id")
def _(t):
    return rounded(aggs.shape(t.signal, ["recording"], "value"), "skew", "kurtosis")


@query("ag04_label_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(t):
    return aggs.label_counts(t.orders, "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("ag04_label_totals", f"SELECT o_orderstatus, count(*) AS n_rows, {q('count(*) / (SELECT count(DISTINCT o_custkey) FROM orders)', 'per_subject')} FROM orders GROUP BY 1")
def _(t):
    return rounded(aggs.label_totals(t.orders, "o_custkey", "o_orderstatus"), "per_subject")


@query("ag05_proportions", f"WITH d AS (SELECT lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, quality, count(*) AS n, {q('count(*) / sum(count(*)) OVER (PARTITION BY lang)', 'proportion')} FROM d GROUP BY lang, quality")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rounded(aggs.proportions(d, ["lang"], "quality"), "proportion")


KINDS = ["click", "view", "purchase", "signup", "error"]


@query("ag06_crosstab", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def _(t):
    return aggs.crosstab(t.events, "user_id", "event_type", KINDS)


@query("ag07_mean_sem", f"SELECT l_returnflag, {q('avg(l_discount)', 'l_discount_mean')}, {q('stddev_samp(l_discount) / sqrt(count(l_discount))', 'l_discount_sem', 8)}, count(l_discount) AS l_discount_n, {q('avg(l_tax)', 'l_tax_mean')}, {q('stddev_samp(l_tax) / sqrt(count(l_tax))', 'l_tax_sem', 8)}, count(l_tax) AS l_tax_n FROM lineitem GROUP BY 1")
def _(t):
    d = aggs.mean_sem(t.lineitem, ["l_returnflag"], ["l_discount", "l_tax"])
    return rounded(rounded(d, "l_discount_mean", "l_tax_mean"), "l_discount_sem", "l_tax_sem", digits=8)


# State labels of windows: a user's window mean scaled within the user, and its
# departure from the mean of all users at that window.
LAB = f"""{WIN}, wm AS (SELECT recording, window_idx, avg(value) AS m FROM win GROUP BY ALL HAVING count(*) = {SIZE}), dv AS (SELECT *, m - avg(m) OVER (PARTITION BY window_idx) AS dev FROM wm),
  lz AS (SELECT *, (m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0) AS pc, (dev - avg(dev) OVER w) / nullif(stddev_pop(dev) OVER w, 0) AS dz FROM dv WINDOW w AS (PARTITION BY recording)),
  lb AS (SELECT *, CASE WHEN pc IS NULL OR dz IS NULL THEN NULL WHEN pc > 0.6 AND dz > 0.6 THEN 'Internal_HighConfidence' WHEN pc < -0.6 AND dz < -0.6 THEN 'External_HighConfidence' ELSE 'Neutral' END AS label FROM lz)"""


def _labelled(t):
    # Plain sums in order, as SQL's avg: equal means of two recordings at a time
    # stay equal or apart as there, on either side of a quantile of `dev`.
    w = windows.window_means(t.signal, ["recording"], "sample_idx", "value", SIZE, STEP).withColumnRenamed("mean", "m")
    d = states.residuals(w, ["window_idx"], ["m"]).withColumnRenamed("m_res", "dev")
    d = series.zscore(d, ["recording"], ["m", "dev"], 0).withColumnsRenamed({"m_z": "pc", "dev_z": "dz"})
    return d.withColumn("label", states.label_strict(F.col("pc"), F.col("dz"), 0.6, 0.6))


def _window_labels(t):
    if "_labels_table" not in t.__dict__:
        t.__dict__["_labels_table"] = settle(_labelled(t), "labels")
    return t.__dict__["_labels_table"]


POWER = f"{LAB}, pw AS (SELECT w.recording, w.channel, w.window_idx, avg(w.value) AS value, lb.label FROM win w JOIN lb USING (recording, window_idx) GROUP BY ALL)"


def _power(t):
    w = windows.assign_windows(t.signal, "sample_idx", SIZE, STEP).groupBy("recording", "channel", "window_idx").agg(F.avg("value").alias("value"))
    return w.join(_window_labels(t).select("recording", "window_idx", "label"), ["recording", "window_idx"])


REGION = "CASE WHEN channel IN ('click', 'view') THEN 'web' ELSE 'other' END"


def _region():
    return F.when(F.col("channel").isin("click", "view"), "web").otherwise("other").alias("region")


ELEC = f"""{POWER}, el AS (SELECT recording, channel, {REGION} AS region, avg(value) FILTER (label LIKE 'Int%') AS mean_int, avg(value) FILTER (label LIKE 'Ext%') AS mean_ext, count(*) FILTER (label LIKE 'Int%') AS n_int, count(*) FILTER (label LIKE 'Ext%') AS n_ext
  FROM pw GROUP BY ALL HAVING n_int >= 2 AND n_ext >= 2)"""


def _elec(t):
    return aggs.electrode_delta(_power(t).withColumn("region", _region()), ["recording", "channel", "region"], "value", "label", states.INTERNAL, states.EXTERNAL, 2)


@query("ag08_electrode_delta", f"WITH {ELEC} SELECT recording, channel, region, {q('mean_int', 'mean_int')}, {q('mean_ext', 'mean_ext')}, n_int, n_ext, {q('mean_int - mean_ext', 'delta')} FROM el")
def _(t):
    return rounded(_elec(t), "mean_int", "mean_ext", "delta")


RGN = f"{ELEC}, rd AS (SELECT recording, region, avg(mean_int) AS mean_int, avg(mean_ext) AS mean_ext, count(*) AS n_elec, avg(mean_int) - avg(mean_ext) AS delta FROM el GROUP BY ALL)"


@query("ag09_region_delta", f"WITH {RGN} SELECT recording, region, {q('mean_int', 'mean_int')}, {q('mean_ext', 'mean_ext')}, n_elec, {q('delta', 'delta')} FROM rd")
def _(t):
    return rounded(aggs.region_delta(_elec(t), ["recording", "region"]), "mean_int", "mean_ext", "delta")


@query("ag10_pooled_stats", f"""WITH {POWER}, c AS (SELECT {REGION} AS region, count(DISTINCT (recording, channel)) AS n_contacts FROM pw GROUP BY ALL)
  SELECT {REGION} AS region, label, count(value) AS n, {q('avg(value)', 'mean')}, {q('stddev_samp(value)', 'sd')}, {q('stddev_samp(value) / sqrt(count(value))', 'sem')}, any_value(n_contacts) AS n_contacts
  FROM pw JOIN c ON c.region = {REGION} WHERE label <> 'Neutral' GROUP BY ALL""")
def _(t):
    d = aggs.pooled_stats(_power(t).withColumn("region", _region()), ["region"], "value", "label", [states.INTERNAL, states.EXTERNAL], ["recording", "channel"])
    return rounded(d, "mean", "sd", "sem")


@query("ag11_region_series", f"WITH {POWER} SELECT recording, {REGION} AS region, window_idx, {q('avg(value)', 'mean')}, count(value) AS n_elec FROM pw GROUP BY ALL HAVING count(value) >= 2")
def _(t):
    return rounded(aggs.region_series(_power(t).withColumn("region", _region()), ["recording", "region", "window_idx"], "channel", "value", 2), "mean")


@query("ag12_region_spectrogram", f"""WITH {POWER}, g AS (SELECT *, label IS DISTINCT FROM 'Neutral' AS bad FROM pw), md AS (SELECT recording, channel, median(value) FILTER (NOT bad) AS med FROM g GROUP BY ALL), rs AS (SELECT g.recording, g.channel, med, 1.4826 * median(abs(value - med)) FILTER (NOT bad) AS s FROM g JOIN md ON md.recording = g.recording AND md.channel = g.channel GROUP BY ALL)
  SELECT g.recording, {REGION.replace('channel', 'g.channel')} AS region, window_idx, {q('avg(CASE WHEN NOT bad THEN (value - med) / CASE WHEN s > 1e-8 THEN s ELSE 1 END END)', 'mean_z')} FROM g LEFT JOIN rs ON rs.recording = g.recording AND rs.channel = g.channel GROUP BY ALL""")
def _(t):
    d = _power(t).withColumn("region", _region()).withColumn("bad", ~F.col("label").eqNullSafe("Neutral"))
    return rounded(aggs.region_spectrogram(d, ["recording", "channel"], ["recording", "region", "window_idx"], "value", F.col("bad")), "mean_z")


@query("ag13_state_spectra", f"""WITH {POWER}, p AS (SELECT recording, channel, avg(value) FILTER (label LIKE 'Int%') AS i, avg(value) FILTER (label LIKE 'Ext%') AS e FROM pw GROUP BY ALL)
  SELECT channel, {q('avg(i)', 'int')}, {q('avg(e)', 'ext')}, {q('avg(i - e)', 'diff')}, count(i - e) AS n_runs FROM p GROUP BY channel""")
def _(t):
    return rounded(aggs.state_spectra(_power(t), "recording", ["channel"], "value", "label", states.INTERNAL, states.EXTERNAL), "int", "ext", "diff")


@query("ag14_matrix", f"WITH {RGN} SELECT region, {q('avg(delta) FILTER (recording % 2 = 0)', 'even')}, {q('avg(delta) FILTER (recording % 2 = 1)', 'odd')}, CASE region WHEN 'web' THEN 1 ELSE 2 END AS ordinal FROM rd GROUP BY region")
def _(t):
    rd = aggs.region_delta(_elec(t), ["recording", "region"])
    d = rd.groupBy("region", F.when(F.col("recording") % 2 == 0, "even").otherwise("odd").alias("band")).agg(r(F.avg("delta")).alias("delta"))
    order = rd.select("region").distinct().withColumn("ordinal", F.when(F.col("region") == "web", 1).otherwise(2))
    return aggs.matrix(d, "region", "band", "delta", ["even", "odd"], order)


@query("ag15_pair_counts", """WITH c AS (SELECT c_nationkey % 3 AS g, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL)
  SELECT a.g, a.s AS region_a, b.s AS region_b, CASE WHEN a.s = b.s THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs FROM c a JOIN c b ON a.g = b.g AND a.s <= b.s""")
def _(t):
    c = aggs.contact_counts(t.customer.withColumn("g", F.col("c_nationkey") % 3), ["g"], "c_mktsegment")
    return aggs.pair_counts(c, ["g"], "c_mktsegment")


SUBJECTS = "SELECT {by}, {mean}, min(n) AS min, max(n) AS max, {sd}, count(*) AS n_subjects FROM c GROUP BY ALL"


@query("ag15_contact_summary", f"""WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS region, count(*) AS n FROM customer GROUP BY ALL) {SUBJECTS.format(by='region', mean=q('avg(n)', 'mean'), sd=q('stddev_samp(n)', 'sd'))}""")
def _(t):
    c = aggs.contact_counts(t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("region")), ["g"], "region")
    return rounded(aggs.over_subjects(c, ["region"], "n_contacts"), "mean", "sd")


@query("ag15_pair_summary", f"""WITH k AS (SELECT c_nationkey AS g, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL),
  c AS (SELECT a.s AS region_a, b.s AS region_b, CASE WHEN a.s = b.s THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n FROM k a JOIN k b ON a.g = b.g AND a.s <= b.s) {SUBJECTS.format(by='region_a, region_b', mean=q('avg(n)', 'mean'), sd=q('stddev_samp(n)', 'sd'))}""")
def _(t):
    c = aggs.contact_counts(t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("region")), ["g"], "region")
    return rounded(aggs.over_subjects(aggs.pair_counts(c, ["g"], "region"), ["region_a", "region_b"], "n_pairs"), "mean", "sd")


CT = f"{EMB}, ct AS (SELECT time_idx FROM emb GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT subject) FROM emb)), ce AS (SELECT * FROM emb SEMI JOIN ct USING (time_idx))"


@query("ag16_region_fc", f"""WITH {CT}, z AS (SELECT subject, subject // 3 AS g, time_idx, f1 FROM ce), p AS (SELECT a.g AS ga, b.g AS gb, corr(a.f1, b.f1) AS r, a.subject AS sa, b.subject AS sb FROM z a JOIN z b USING (time_idx) GROUP BY a.g, b.g, a.subject, b.subject)
  SELECT ga AS region_a, gb AS region_b, {q('avg(CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE r END)', 'r')} FROM p WHERE ga <= gb GROUP BY ALL""")
def _(t):
    d = stats.complete_times(t.embedded, [], "subject", "time_idx", ["f1"]).withColumns({"recording": F.lit("r"), "g": F.floor(F.col("subject") / 3)})
    return rounded(stats.region_fc(d, ["recording"], "g", "subject", "time_idx", "f1").drop("recording"), "r")


@query("ag17_recording_descriptives", "SELECT user_id AS recording, " + ", ".join(
    f"count({e}) AS n_{c}, {q(f'sum({e})', 'sum_' + c)}, {q(f'avg({e})', 'mean_' + c)}, {q(f'stddev_pop({e})', 'std_' + c)}, {q(f'median({e})', 'median_' + c)}"
    for c, e in (("value", "value"), ("y", "(event_id % 100)::DOUBLE"))) + " FROM events GROUP BY user_id")
def _(t):
    d = aggs.recording_descriptives(t.signal, ["recording"], ["value", "y"])
    return rounded(d, *[c for c in d.columns if c != "recording" and not c.startswith("n_")])


@query("ag18_state_density", f"""WITH {LAB} SELECT window_idx, {q("count(*) FILTER (label LIKE 'Int%') / count(*)", 'Internal_HighConfidence')}, {q("count(*) FILTER (label LIKE 'Ext%') / count(*)", 'External_HighConfidence')}, {q("count(*) FILTER (label = 'Neutral') / count(*)", 'Neutral')}, count(*) AS n_subjects FROM lb GROUP BY window_idx""")
def _(t):
    s = [states.INTERNAL, states.EXTERNAL, states.NEUTRAL]
    return rounded(aggs.state_density(_window_labels(t), "window_idx", "recording", "label", s), *s)


@query("ag19_crossings", f"""WITH {LAB}, m AS (SELECT window_idx, avg(pc) AS pc, avg(dz) AS dz FROM lb GROUP BY 1), u AS (SELECT window_idx, 'pc' AS measure, pc AS v FROM m UNION ALL SELECT window_idx, 'dz', dz FROM m)
  SELECT window_idx, measure, {q('v', 'mean_value')}, CASE WHEN v > 0.1 THEN 'Above 0.1' ELSE 'Below -0.05' END AS threshold, printf('%02d:%02d', CAST(floor(window_idx * 2.5) AS BIGINT) // 60, CAST(floor(window_idx * 2.5) AS BIGINT) % 60) AS movie_time FROM u WHERE v > 0.1 OR v < -0.05""")
def _(t):
    return rounded(aggs.crossings(_window_labels(t), "window_idx", ["pc", "dz"], 0.1, 0.05, 2.5), "mean_value")


@query("ag20_coverage_summary", "SELECT lang, count(*) FILTER (n_chars > 500) AS long_text, count(*) FILTER (quality = 1) AS good, count(*) AS n_recordings FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").withColumns({"long_text": F.col("n_chars") > 500, "good": F.col("quality") == 1})
    return aggs.coverage_summary(d, ["lang"], ["long_text", "good"])


@query("ag20_rule_gaps", "SELECT count(*) FILTER (toxic = 0 AND quality = 0) AS included_but_failing, count(*) FILTER (toxic = 1 AND quality = 1) AS passing_not_included FROM labels")
def _(t):
    d = t.labels.select((F.col("quality") == 1).alias("rule"), (F.col("toxic") == 0).alias("used"))
    return aggs.rule_gaps(d, "rule", "used")


@query("ag21_duplicates", "SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return joins.duplicates(t.orders, ["o_custkey", "o_orderstatus"])


@query("ag22_distinct_clean", "SELECT DISTINCT trim(split_part(p_name, ' ', 2)) AS label FROM part WHERE trim(split_part(p_name, ' ', 2)) NOT IN ('', 'nan', 'None')")
def _(t):
    return aggs.distinct_clean(t.part.select(F.concat(F.lit(" "), F.split("p_name", " ")[1], F.lit(" ")).alias("label")), "label")


# ---- events


@query("ev01_assign_band", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 1 AND l_quantity < 3.5 THEN 'delta' WHEN l_quantity >= 3.5 AND l_quantity < 7.5 THEN 'theta' WHEN l_quantity >= 7.5 AND l_quantity < 13.5 THEN 'alpha' WHEN l_quantity >= 13.5 AND l_quantity < 30.5 THEN 'beta' WHEN l_quantity >= 30.5 AND l_quantity < 57 THEN 'gamma' END AS contiguous, CASE WHEN l_quantity >= 1 AND l_quantity < 3 THEN 'delta' WHEN l_quantity >= 4 AND l_quantity < 7 THEN 'theta' WHEN l_quantity >= 8 AND l_quantity < 13 THEN 'alpha' WHEN l_quantity >= 14 AND l_quantity < 30 THEN 'beta' WHEN l_quantity >= 31 AND l_quantity < 50 THEN 'gamma' END AS canonical FROM lineitem")
def _(t):
    f = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.assign_band(f).alias("contiguous"), scalars.assign_band(f, scalars.BANDS_CANONICAL).alias("canonical"))


@query("ev02_skeleton", f"WITH p AS ({PEAKS}) SELECT l_orderkey, min(amp) FILTER (l_linenumber = m) AS amp, count(*) FILTER (bw < 10) AS n_peaks_total FROM p JOIN (SELECT l_orderkey, min(l_linenumber) AS m FROM p GROUP BY 1) USING (l_orderkey) GROUP BY 1")
def _(t):
    # Line numbers repeat within an order: the amplitude breaks the tie.
    return events.skeleton(_peaks(t), ["l_orderkey"], ["amp"], "l_linenumber", F.col("bw") < 10)


EDGES = [("delta", 1, 3.5), ("theta", 3.5, 7.5), ("alpha", 7.5, 13.5), ("beta", 13.5, 30.5), ("gamma", 30.5, 57)]


@query("ev03_peaks_to_timeseries", f"WITH p AS ({PEAKS}), k AS (SELECT *, NOT (bw >= 10 - 1e-6 OR cf <= lo + 1 OR cf >= hi - 1) AS ok FROM p) SELECT l_orderkey, count(*) FILTER (ok AND cf >= 1 AND cf < 57) AS n_peaks_total, " + ", ".join(
    f"count(*) FILTER (ok AND cf >= {a} AND cf < {b}) AS {n}_n, max(amp) FILTER (ok AND cf >= {a} AND cf < {b}) AS {n}_amp, arg_max(cf, amp) FILTER (ok AND cf >= {a} AND cf < {b}) AS {n}_cf, {q(f'arg_max(bw, amp) FILTER (ok AND cf >= {a} AND cf < {b})', n + '_bw')}" for n, a, b in EDGES) + " FROM k GROUP BY l_orderkey")
def _(t):
    flags = filters.peak_flags(F.col("bw"), F.col("cf"), F.col("lo"), F.col("hi"))
    d = events.peaks_to_timeseries(_peaks(t), ["l_orderkey"], "cf", "amp", "bw", "l_linenumber", scalars.BANDS_CONTIGUOUS, ~(flags["at_bandwidth_ceiling"] | flags["near_fit_edge"]))
    return rounded(d, *[f"{n}_bw" for n, _, _ in EDGES])


RUN = """pr AS (SELECT recording, sample_idx, value FROM sig WHERE value > 25), rg AS (SELECT *, CASE WHEN sample_idx - lag(sample_idx) OVER w > 2 OR lag(sample_idx) OVER w IS NULL THEN sample_idx END AS st FROM pr WINDOW w AS (PARTITION BY recording ORDER BY sample_idx)),
  ru AS (SELECT recording, sample_idx, value, max(st) OVER (PARTITION BY recording ORDER BY sample_idx) AS run_id FROM rg)"""


@query("ev04_runs", f"WITH {SIG}, {RUN} SELECT recording, sample_idx, run_id FROM ru")
def _(t):
    return events.runs(t.signal.filter("value > 25").select("recording", "sample_idx"), ["recording"], "sample_idx")


def _drift_sql(keys: str, rows: str, tol: float) -> str:
    """Recursive SQL over (keys, run_id, sample_idx, value): open event's values as a list."""
    on = " AND ".join(f"r.{k} = s.{k}" for k in [*keys.split(", "), "run_id"])
    jump = f"abs(r.value - list_aggregate(list_append(s.vals, r.value), 'median')) > {tol}"
    ks = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""kr AS (SELECT *, row_number() OVER (PARTITION BY {keys}, run_id ORDER BY sample_idx) AS k FROM {rows}),
  dr AS (SELECT {keys}, run_id, k, sample_idx, value, sample_idx AS event_id, [value] AS vals FROM kr WHERE k = 1
    UNION ALL SELECT {ks}, r.run_id, r.k, r.sample_idx, r.value, CASE WHEN {jump} THEN r.sample_idx ELSE s.event_id END, CASE WHEN {jump} THEN [r.value] ELSE list_append(s.vals, r.value) END
    FROM dr s JOIN kr r ON {on} AND r.k = s.k + 1)"""


@query("ev05_split_on_drift", f"WITH RECURSIVE {SIG}, {RUN}, {_drift_sql('recording', 'ru', 40.0)} SELECT recording, sample_idx, value, run_id, event_id FROM dr")
def _(t):
    run = events.runs(t.signal.filter("value > 25").select("recording", "sample_idx", "value"), ["recording"], "sample_idx")
    return events.split_on_drift(run, ["recording", "run_id"], "sample_idx", "value", 40.0)


@query("ev06_events_from_runs", f"""WITH {SIG}, {RUN}, e AS (SELECT recording, run_id, min(sample_idx) AS a, max(sample_idx) AS b, count(*) AS n_windows, median(value) AS med, min(value) AS lo, max(value) AS hi, avg(value) AS av FROM ru GROUP BY ALL), n AS (SELECT recording, max(sample_idx) AS li FROM sig GROUP BY 1),
  k AS (SELECT recording, CASE WHEN a = 0 THEN a * 2.5 ELSE a * 2.5 + 7.5 END AS on_lo, a * 2.5 + 10 AS on_hi, b * 2.5 AS off_lo, CASE WHEN b = li THEN b * 2.5 + 10 ELSE b * 2.5 + 2.5 END AS off_hi, greatest(0, b * 2.5 - (a * 2.5 + 10)) AS d_lo, b * 2.5 + 10 - a * 2.5 AS d_hi, b * 2.5 - (a * 2.5 + 10) < 0 AS short, e.* EXCLUDE (recording) FROM e JOIN n USING (recording))
  SELECT recording, {q('on_lo::DOUBLE', 'onset_lo_sec')}, {q('on_hi::DOUBLE', 'onset_hi_sec')}, {q('off_lo::DOUBLE', 'offset_lo_sec')}, {q('off_hi::DOUBLE', 'offset_hi_sec')}, {q('(on_lo + on_hi)::DOUBLE / 2', 'onset_sec')}, {q('(off_lo + off_hi)::DOUBLE / 2', 'offset_sec')}, {q('d_lo::DOUBLE', 'duration_lo_sec')}, {q('d_hi::DOUBLE', 'duration_hi_sec')}, {q('(d_lo + d_hi)::DOUBLE / 2', 'duration_sec')},
    short AS shorter_than_window, n_windows, {q('med', 'cf_median')}, lo AS cf_min, hi AS cf_max, hi AS amp_max, {q('av', 'amp_mean')}, {q('av', 'exponent_mean')} FROM k""")
def _(t):
    run = events.runs(t.signal.filter("value > 25").select("recording", "sample_idx", "value"), ["recording"], "sample_idx")
    ends = t.signal.groupBy("recording").agg(F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"))
    d = events.events_from_runs(run, ["recording"], "run_id", "sample_idx", "value", "value", "value", ends)
    return rounded(d, *[c for c, ty in d.dtypes if ty == "double" and c not in ("cf_min", "cf_max", "amp_max")])


CHAIN = f"""p AS ({PEAKS}), w AS (SELECT o_custkey, l_orderkey, cf, amp, count(*) FILTER (cf >= 1 AND cf < 57) OVER (PARTITION BY o_custkey, l_orderkey)::DOUBLE AS exponent, {' '.join(['CASE'] + [f"WHEN cf >= {a} AND cf < {b} THEN '{n}'" for n, a, b in EDGES] + ['END'])} AS band FROM p JOIN orders ON o_orderkey = l_orderkey),
  ix AS (SELECT o_custkey, l_orderkey, any_value(exponent) AS exponent, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS sample_idx FROM w GROUP BY o_custkey, l_orderkey), li AS (SELECT o_custkey, max(sample_idx) AS li FROM ix GROUP BY 1),
  pk AS (SELECT ix.o_custkey, band, sample_idx, any_value(ix.exponent) AS exponent, max(amp) AS amp, arg_max(cf, amp) AS value FROM w JOIN ix ON ix.o_custkey = w.o_custkey AND ix.l_orderkey = w.l_orderkey WHERE band IN ('theta', 'alpha', 'beta', 'gamma') GROUP BY ix.o_custkey, band, sample_idx),
  rg AS (SELECT *, CASE WHEN sample_idx - lag(sample_idx) OVER x > 2 OR lag(sample_idx) OVER x IS NULL THEN sample_idx END AS st FROM pk WINDOW x AS (PARTITION BY o_custkey, band ORDER BY sample_idx)), ru AS (SELECT *, max(st) OVER (PARTITION BY o_custkey, band ORDER BY sample_idx) AS run_id FROM rg),
  {_drift_sql('o_custkey, band', 'ru', 2.0)},
  ev AS (SELECT d.o_custkey, d.band, event_id, min(d.sample_idx) AS a, max(d.sample_idx) AS b, count(*) AS n_windows, median(d.value) AS med, min(d.value) AS lo, max(d.value) AS hi, max(amp) AS amax, avg(amp) AS amean, avg(exponent) AS emean FROM dr d JOIN pk ON pk.o_custkey = d.o_custkey AND pk.band = d.band AND pk.sample_idx = d.sample_idx GROUP BY d.o_custkey, d.band, event_id),
  bk AS (SELECT ev.*, CASE WHEN a = 0 THEN a * 2.5::DOUBLE ELSE a * 2.5::DOUBLE + 7.5 END AS on_lo, a * 2.5::DOUBLE + 10 AS on_hi, b * 2.5::DOUBLE AS off_lo, CASE WHEN b = li THEN b * 2.5::DOUBLE + 10 ELSE b * 2.5::DOUBLE + 2.5 END AS off_hi, greatest(0, b * 2.5::DOUBLE - a * 2.5::DOUBLE - 10) AS d_lo, b * 2.5::DOUBLE + 10 - a * 2.5::DOUBLE AS d_hi FROM ev JOIN li USING (o_custkey))"""


@query("ev07_to_events", f"""WITH RECURSIVE {CHAIN} SELECT o_custkey, band, on_lo AS onset_lo_sec, on_hi AS onset_hi_sec, off_lo AS offset_lo_sec, off_hi AS offset_hi_sec, (on_lo + on_hi) / 2 AS onset_sec, (off_lo + off_hi) / 2 AS offset_sec, d_lo + 0.0 AS duration_lo_sec, d_hi AS duration_hi_sec, (d_lo + d_hi) / 2 AS duration_sec,
  b * 2.5 - a * 2.5 - 10 < 0 AS shorter_than_window, n_windows, {q('med', 'cf_median')}, lo AS cf_min, hi AS cf_max, amax AS amp_max, {q('amean', 'amp_mean')}, {q('emean', 'exponent_mean')} FROM bk""")
def _(t):
    # Order lines as peaks of a window; a customer's orders in key order as windows.
    from tidegrid.operators.scan import time_index
    p = _peaks(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    ts = events.peaks_to_timeseries(p, ["o_custkey", "l_orderkey"], "cf", "amp", None, "l_linenumber", scalars.BANDS_CONTIGUOUS)
    bands = ["theta", "alpha", "beta", "gamma"]
    # Written, as the index looks at it before it numbers it.
    ts = settle(ts.select("o_custkey", "l_orderkey", F.col("n_peaks_total").cast("double").alias("exponent"), *[f"{b}_{m}" for b in bands for m in ("cf", "amp")]), "peaks")
    ts = time_index(ts, ["o_custkey"], ["l_orderkey"], out="window_idx")
    d = events.to_events(ts, ["o_custkey"], "window_idx", "exponent", bands)
    return rounded(d, "cf_median", "amp_mean", "exponent_mean")


@query("ev08_merge_attention", f"""WITH p AS ({PEAKS}), lb AS (SELECT o_orderkey AS l_orderkey, o_orderpriority AS label FROM orders WHERE o_orderkey % 3 <> 0), bd AS (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F')
  SELECT p.l_orderkey, l_linenumber, amp, label, lb.l_orderkey IS NOT NULL AS has_label, bd.l_orderkey IS NOT NULL AS bad_window, bd.l_orderkey IS NULL AS good_window FROM p LEFT JOIN lb ON lb.l_orderkey = p.l_orderkey LEFT JOIN bd ON bd.l_orderkey = p.l_orderkey""")
def _(t):
    o = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    lb = o.filter("l_orderkey % 3 <> 0").select("l_orderkey", F.col("o_orderpriority").alias("label"))
    return events.merge_attention(_peaks(t).select("l_orderkey", "l_linenumber", "amp"), lb, o.filter("o_orderstatus = 'F'"), ["l_orderkey"], "label")


# ---- states

RES = ", ".join(f"f{i} - avg(f{i}) OVER (PARTITION BY time_idx) AS r{i}" for i in (1, 2, 3))


ALL_DIMS = [f"f{i + 1}" for i in range(DIMS)]


@query("at01_deviation_l2", f"WITH {EMBL}, rs AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY time_idx, d) AS r FROM ed) SELECT vec_id, {q('sqrt(sum(r * r))', 'deviation')} FROM rs GROUP BY vec_id")
def _(t):
    return states.deviation_l2(t.embedded, ["time_idx"], ALL_DIMS).select("vec_id", r("deviation"))


@query("at02_mahalanobis_all")
def _(t):
    """All dimensions, with the estimated shrinkage; tested against numpy."""
    return states.mahalanobis(t.embedded, ["time_idx"], ALL_DIMS).select("vec_id", r("deviation"))


MAHAL = f"""rs AS (SELECT vec_id, subject, time_idx, f1, f2, {RES} FROM emb), cv AS (SELECT var_pop(r1) AS a0, var_pop(r2) AS b0, covar_pop(r1, r2) AS c0 FROM rs), sh AS (SELECT 0.9 * a0 + 0.1 * (a0 + b0) / 2 AS a, 0.9 * b0 + 0.1 * (a0 + b0) / 2 AS b, 0.9 * c0 AS c FROM cv),
  mh AS (SELECT rs.*, sqrt((r1 * r1 * b - 2 * r1 * r2 * c + r2 * r2 * a) / (a * b - c * c)) AS dev FROM rs, sh)"""


@query("at02_mahalanobis", f"WITH {EMB}, {MAHAL} SELECT vec_id, {q('dev', 'deviation')} FROM mh")
def _(t):
    return states.mahalanobis(t.embedded, ["time_idx"], ["f1", "f2"], weight=0.1).select("vec_id", r("deviation"))


@query("at03_shrunk_cov", f"""WITH {EMB}, rs AS (SELECT {RES} FROM emb), m AS (SELECT count(*) AS n, var_pop(r1) AS a, var_pop(r2) AS b, covar_pop(r1, r2) AS c, avg(r1) AS m1, avg(r2) AS m2 FROM rs),
  f AS (SELECT sum(power(power(r1 - m1, 2) + power(r2 - m2, 2), 2)) AS q FROM rs, m), w AS (SELECT a, b, c, (a + b) / 2 AS mu, (a*a + b*b + 2*c*c) / 2 - power((a + b) / 2, 2) AS d2, (q / n - (a*a + b*b + 2*c*c)) / (2 * n) AS b2 FROM m, f), s AS (SELECT *, least(greatest(b2, 0), d2) / d2 AS s FROM w)
  SELECT {q('s', 'weight')}, {q('(1 - s) * a + s * mu', 'v11', 8)}, {q('(1 - s) * b + s * mu', 'v22', 8)}, {q('(1 - s) * c', 'v12', 8)} FROM s""")
def _(t):
    cov, w = states.shrunk_cov(states.residuals(t.embedded, ["time_idx"], ["f1", "f2"]), ["f1_res", "f2_res"])
    row = [(round(float(w), 6), round(float(cov[0, 0]), 8), round(float(cov[1, 1]), 8), round(float(cov[0, 1]), 8))]
    return t.spark.createDataFrame(row, "weight double, v11 double, v22 double, v12 double")


@query("at03_shrunk_cov_all", f"""WITH {EMBL}, rs AS (SELECT vec_id, d, v - avg(v) OVER (PARTITION BY time_idx, d) AS x FROM ed), c AS (SELECT vec_id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM rs),
  cv AS (SELECT a.d AS i, b.d AS j, avg(a.x * b.x) AS v FROM c a JOIN c b USING (vec_id) GROUP BY ALL), f AS (SELECT count(*) AS n, sum(q * q) AS q FROM (SELECT sum(x * x) AS q FROM c GROUP BY vec_id)),
  m AS (SELECT sum(v) FILTER (i = j) / {DIMS} AS mu, sum(v * v) AS s FROM cv), w AS (SELECT mu, s / {DIMS} - mu * mu AS d2, (q / n - s) / ({DIMS} * n) AS b2 FROM m, f), k AS (SELECT mu, least(greatest(b2, 0), d2) / d2 AS w FROM w)
  SELECT 'f' || i AS feature_a, 'f' || j AS feature_b, {q('(1 - w) * v + CASE WHEN i = j THEN w * mu ELSE 0 END', 'cov', 8)}, {q('w', 'weight')} FROM cv, k WHERE i <= j""")
def _(t):
    cov, w = states.shrunk_cov(states.residuals(t.embedded, ["time_idx"], ALL_DIMS), [f"{c}_res" for c in ALL_DIMS])
    rows = [(a, b, float(cov[i, j]), float(w)) for i, a in enumerate(ALL_DIMS) for j, b in enumerate(ALL_DIMS) if i <= j]
    d = t.spark.createDataFrame(rows, "feature_a string, feature_b string, cov double, weight double")
    return rounded(rounded(d, "cov", digits=8), "weight")


DZ = f"""{MAHAL}, dz AS (SELECT vec_id, (dev - avg(dev) OVER s) / nullif(stddev_pop(dev) OVER s, 0) AS deviation_subject_z, (dev - avg(dev) OVER t) / nullif(stddev_pop(dev) OVER t, 0) AS deviation_time_z, (f1 - avg(f1) OVER s) / nullif(stddev_pop(f1) OVER s, 0) AS f1_z
  FROM mh WINDOW s AS (PARTITION BY subject), t AS (PARTITION BY time_idx))"""


def _dev_z(t):
    return states.deviation_z(states.mahalanobis(t.embedded, ["time_idx"], ["f1", "f2"], weight=0.1), ["subject"], ["time_idx"], "deviation", "f1")


@query("at04_deviation_z", f"WITH {EMB}, {DZ} SELECT vec_id, {q('deviation_subject_z', 'deviation_subject_z')}, {q('deviation_time_z', 'deviation_time_z', 5)}, {q('f1_z', 'f1_z')} FROM dz")
def _(t):
    return _dev_z(t).select("vec_id", r("deviation_subject_z"), r("deviation_time_z", 5), r("f1_z"))


@query("at04_deviation_z_all", f"""WITH {EMBL}, rs AS (SELECT vec_id, subject, time_idx, d, v, v - avg(v) OVER (PARTITION BY time_idx, d) AS x FROM ed), l AS (SELECT vec_id, subject, time_idx, sqrt(sum(x * x)) AS dev, max(v) FILTER (d = 1) AS f1 FROM rs GROUP BY ALL)
  SELECT vec_id, {q('(dev - avg(dev) OVER s) / nullif(stddev_pop(dev) OVER s, 0)', 'deviation_subject_z')}, {q('(dev - avg(dev) OVER t) / nullif(stddev_pop(dev) OVER t, 0)', 'deviation_time_z', 5)}, {q('(f1 - avg(f1) OVER s) / nullif(stddev_pop(f1) OVER s, 0)', 'f1_z')} FROM l WINDOW s AS (PARTITION BY subject), t AS (PARTITION BY time_idx)""")
def _(t):
    d = states.deviation_z(states.deviation_l2(t.embedded, ["time_idx"], ALL_DIMS), ["subject"], ["time_idx"], "deviation", "f1")
    return d.select("vec_id", r("deviation_subject_z"), r("deviation_time_z", 5), r("f1_z"))


@query("at05_label_strict", f"WITH {LAB} SELECT recording, window_idx, label FROM lb")
def _(t):
    return _labelled(t).select("recording", "window_idx", "label")


@query("at06_label_quadrants", f"""WITH {LAB}, v AS (SELECT *, recording % 3 AS video FROM lb), qq AS (SELECT video, quantile_cont(dev, 0.7) AS hi, quantile_cont(dev, 0.4) AS lo FROM v GROUP BY 1)
  SELECT recording, window_idx, CASE WHEN pc > 0.75 AND dev > hi THEN 'Internal_HighDeviation' WHEN pc < -0.5 AND dev < lo THEN 'External_LowDeviation' WHEN pc > 0.75 AND dev < lo THEN 'Internal_LowDeviation' WHEN pc < -0.5 AND dev > hi THEN 'External_HighDeviation' ELSE 'Neutral' END AS state FROM v JOIN qq USING (video)""")
def _(t):
    d = _window_labels(t).withColumn("video", F.col("recording") % 3)
    return states.label_quadrants(d, ["video"], "pc", "dev", 0.75, 0.5, out="state").select("recording", "window_idx", "state")


@query("at07_label_band", f"""WITH {LAB}, g AS (SELECT recording, window_idx, m, avg(m) OVER t AS gm, stddev_samp(m) OVER t AS gs FROM lb WINDOW t AS (PARTITION BY window_idx)), z AS (SELECT *, (m - gm - avg(m - gm) OVER s) / nullif(stddev_samp(m - gm) OVER s, 0) AS z FROM g WINDOW s AS (PARTITION BY recording))
  SELECT recording, window_idx, z > 1 AS internal, m BETWEEN gm - 0.5 * gs AND gm + 0.5 * gs AS external FROM z""")
def _(t):
    return states.label_band(_window_labels(t), ["recording"], ["window_idx"], "m").select("recording", "window_idx", "internal", "external")


@query("at08_label_flags", f"WITH {LAB} SELECT recording, CAST(sum(CAST(coalesce(pc > 0.6 AND dz > 0.6, false) AS INT)) AS BIGINT) AS n_internal, CAST(sum(CAST(coalesce(pc < -0.5 AND dz < -0.5, false) AS INT)) AS BIGINT) AS n_external FROM lb GROUP BY recording")
def _(t):
    d = states.label_flags(_window_labels(t), "pc", "dz", 0.6, 0.5)
    return d.groupBy("recording").agg(F.sum("internal_flag").alias("n_internal"), F.sum("external_flag").alias("n_external"))


@query("at09_sweep", f"""WITH {LAB}, v AS (SELECT *, recording % 3 AS video FROM lb), g AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) a(z_hi), (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) b(z_lo), (VALUES (0.6::DOUBLE), (0.8::DOUBLE)) c(dev_q)),
  qq AS (SELECT video, dev_q, CASE WHEN dev_q = 0.6 THEN quantile_cont(dev, 0.6) ELSE quantile_cont(dev, 0.8) END AS hi, CASE WHEN dev_q = 0.6 THEN quantile_cont(dev, 0.4) ELSE quantile_cont(dev, 0.2) END AS lo FROM v, (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS dev_q) GROUP BY video, dev_q),
  s AS (SELECT v.video, z_hi, z_lo, g.dev_q, CASE WHEN pc > z_hi AND dev > hi THEN 'Internal_HighDeviation' WHEN pc < -z_lo AND dev < lo THEN 'External_LowDeviation' WHEN pc > z_hi AND dev < lo THEN 'Internal_LowDeviation' WHEN pc < -z_lo AND dev > hi THEN 'External_HighDeviation' ELSE 'Neutral' END AS state FROM v, g JOIN qq ON qq.dev_q = g.dev_q WHERE qq.video = v.video)
  SELECT video, z_hi, z_lo, dev_q, state, count(*) AS n, {q('count(*) / sum(count(*)) OVER (PARTITION BY video, z_hi, z_lo, dev_q)', 'proportion')} FROM s GROUP BY video, z_hi, z_lo, dev_q, state""")
def _(t):
    d = _window_labels(t).withColumn("video", F.col("recording") % 3)
    return rounded(states.sweep(d, ["video"], "pc", "dev", [0.5, 1.0], [0.25, 0.5], [0.6, 0.8]), "proportion")


@query("at10_sweep_contrast", f"""WITH {POWER}, th(thr_int, thr_ext) AS (VALUES (0.4, 0.4), (0.8, 0.6)), l2 AS (SELECT recording, window_idx, thr_int, thr_ext, CASE WHEN pc IS NULL OR dz IS NULL THEN NULL WHEN pc > thr_int AND dz > thr_int THEN 'I' WHEN pc < -thr_ext AND dz < -thr_ext THEN 'E' ELSE 'N' END AS s FROM lb, th),
  e AS (SELECT thr_int, thr_ext, recording, channel, {REGION} AS region, avg(value) FILTER (s = 'I') AS a, avg(value) FILTER (s = 'E') AS b FROM pw JOIN l2 USING (recording, window_idx) GROUP BY ALL HAVING count(*) FILTER (s = 'I') >= 2 AND count(*) FILTER (s = 'E') >= 2)
  SELECT thr_int::DOUBLE AS thr_int, thr_ext::DOUBLE AS thr_ext, region, {q('avg(a)', 'mean_int')}, {q('avg(b)', 'mean_ext')}, count(*) AS n_elec, {q('avg(a) - avg(b)', 'delta')} FROM e GROUP BY ALL""")
def _(t):
    lab = states.sweep_labels(_window_labels(t).select("recording", "window_idx", "pc", "dz"), "pc", "dz", [(0.4, 0.4), (0.8, 0.6)])
    p = _power(t).drop("label").join(lab.drop("pc", "dz"), ["recording", "window_idx"]).withColumn("region", _region())
    e = aggs.electrode_delta(p, ["thr_int", "thr_ext", "recording", "channel", "region"], "value", "label", states.INTERNAL, states.EXTERNAL, 2)
    return rounded(aggs.region_delta(e, ["thr_int", "thr_ext", "region"]), "mean_int", "mean_ext", "delta")


@query("at11_agreement", f"WITH d AS (SELECT lang, CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b FROM documents JOIN labels USING (doc_id)) SELECT lang, {q('avg(CAST(a IS NOT DISTINCT FROM b AS INT))', 'agreement')} FROM d GROUP BY lang")
def _(t):
    return rounded(states.agreement(t.documents.join(t.labels, "doc_id"), ["lang"], "quality", "toxic"), "agreement")


@query("at12_align_sign", f"WITH {EMB} SELECT vec_id, {q('CASE WHEN corr(f1, f2) OVER (PARTITION BY subject) > 0 THEN -f1 ELSE f1 END', 'f1')} FROM emb")
def _(t):
    return states.align_sign(t.embedded, ["subject"], "f1", "f2").select("vec_id", r("f1"))


@query("at13_tier3", f"WITH {DAY_SQL}{META_SQL}, w AS (SELECT recording, window_idx, label, max(value) FILTER (b = 'even') AS even, max(value) FILTER (b = 'odd') AS odd FROM (SELECT *, CASE WHEN window_idx % 2 = 0 THEN 'even' ELSE 'odd' END AS b FROM dp) GROUP BY ALL) SELECT w.*, DK_Atlas, network FROM w LEFT JOIN lm USING (label)")
def _(t):
    p = _day_power(t).withColumn("band", F.when(F.col("window_idx") % 2 == 0, "even").otherwise("odd"))
    return reshape.tier3(p, _label_meta(t), ["recording", "window_idx"], "label", "band", "value", ["even", "odd"])


@query("at14_tier4", f"WITH {POWER} SELECT pw.recording, pw.channel, pw.window_idx, {q('pw.value', 'value')}, {q('dev', 'dev')}, true AS has_features FROM pw JOIN lb USING (recording, window_idx)")
def _(t):
    d = reshape.tier4(_power(t).drop("label"), _window_labels(t).select("recording", "window_idx", "dev"), ["recording", "window_idx"])
    return rounded(d, "value", "dev")


# ---- statistics

TT = "tt AS (SELECT region, count(delta) AS n, avg(delta) AS m, stddev_samp(delta) AS s FROM rd GROUP BY 1)"


@query("st01_ttest_1samp", f"WITH {RGN}, {TT} SELECT region, n, {q('m', 'mean')}, {q('s', 'sd')}, {q('m / (s / sqrt(n))', 't')} FROM tt")
def _(t):
    return rounded(stats.ttest_1samp(aggs.region_delta(_elec(t), ["recording", "region"]), ["region"], "delta"), "mean", "sd", "t")


def _t_tail_sql(t: str, dof: str, src: str, out: str) -> str:
    """CTE: two-sided t tail by Simpson's rule on 2000 steps."""
    return f"""{out} AS (SELECT *, 1 - 2 * (SELECT sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(abs({t}) * j / 2000.0, 2) / {dof}, -({dof} + 1) / 2.0)) FROM range(2001) g(j))
    * abs({t}) / 2000 / 3 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi() * {dof}) AS p FROM {src})"""


@query("st01_ttest_p", f"""WITH a AS (SELECT user_id AS recording, avg(value - 50) / (stddev_samp(value - 50) / sqrt(count(*))) AS t, count(*) - 1 AS dof FROM events GROUP BY 1), {_t_tail_sql('a.t', 'a.dof', 'a', 'pv')}
  SELECT recording, {q('t', 't')}, {q('p', 'p')} FROM pv""")
def _(t):
    d = stats.ttest_1samp(t.signal.withColumn("d", F.col("value") - 50), ["recording"], "d")
    return stats.with_t_p(d, F.col("n") - 1).select("recording", r("t"), r("p"))


@query("st02_ttest_rel", f"SELECT l_returnflag, count(*) AS n, {q('avg(l_discount - l_tax)', 'mean', 8)}, {q('stddev_samp(l_discount - l_tax)', 'sd', 8)}, {q('avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*)))', 't', 4)} FROM lineitem GROUP BY 1")
def _(t):
    d = stats.ttest_rel(t.lineitem, ["l_returnflag"], "l_discount", "l_tax")
    return rounded(rounded(d, "mean", "sd", digits=8), "t", digits=4)


VA = "count(value) FILTER (event_type IN ('click','view')) AS na, count(value) FILTER (event_type NOT IN ('click','view')) AS nb, avg(value) FILTER (event_type IN ('click','view')) AS ma, avg(value) FILTER (event_type NOT IN ('click','view')) AS mb, var_samp(value) FILTER (event_type IN ('click','view')) AS va, var_samp(value) FILTER (event_type NOT IN ('click','view')) AS vb"


@query("st03_ttest_ind", f"""WITH v AS (SELECT user_id AS recording, {VA} FROM events GROUP BY user_id) SELECT recording, {q('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))', 't_pooled')}, {q('(ma - mb) / sqrt(va / na + vb / nb)', 't_welch')},
  {q('power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))', 'dof_welch')} FROM v""")
def _(t):
    side = F.col("channel").isin("click", "view")
    a = stats.ttest_ind(t.signal, ["recording"], "value", side).select("recording", r(F.col("t")).alias("t_pooled"))
    b = stats.ttest_ind(t.signal, ["recording"], "value", side, equal_var=False).select("recording", r(F.col("t")).alias("t_welch"), r(F.col("dof")).alias("dof_welch"))
    return a.join(b, "recording")


@query("st04_adjust", f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 1009) / 1009.0::DOUBLE END AS p FROM part), k AS (SELECT *, count(p) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p NULLS LAST, p_partkey) AS rk FROM p)
  SELECT p_partkey, CASE WHEN p IS NOT NULL THEN {q('least(1, min(p * m / rk) OVER (PARTITION BY p_brand ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'x').rsplit(' AS ', 1)[0]} END AS fdr, CASE WHEN p IS NOT NULL THEN {q('least(p * m, 1)', 'x').rsplit(' AS ', 1)[0]} END AS bonferroni FROM k""")
def _(t):
    k = F.col("p_partkey")
    d = t.part.select("p_partkey", "p_brand", F.when(k % 11 != 0, (k * 37 % 1009) / F.lit(1009.0)).alias("p"))
    d = stats.adjust(d, ["p_brand"], "p", "p_partkey", out="fdr")
    d = stats.adjust(d, ["p_brand"], "p", "p_partkey", "bonferroni", out="bonferroni")
    return d.select("p_partkey", r("fdr"), F.when(F.col("p").isNotNull(), r(F.col("bonferroni"))).alias("bonferroni"))


@query("st05_stars", "SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT p_partkey, (p_partkey % 100) / 1000.0::DOUBLE AS p FROM part)")
def _(t):
    return t.part.select("p_partkey", scalars.stars((F.col("p_partkey") % 100) / F.lit(1000.0)).alias("stars"))


HASH = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("st06_permutation_test", f"""WITH d AS (SELECT event_type AS region, event_id, value, user_id % 3 = 0 AS a FROM events), o AS (SELECT region, avg(value) FILTER (a) - avg(value) FILTER (NOT a) AS observed, count(*) FILTER (a) AS na FROM d GROUP BY 1),
  p AS (SELECT d.*, perm, row_number() OVER (PARTITION BY region, perm ORDER BY {HASH.format("'7-' || perm || '-' || event_id")}, event_id) AS rn FROM d, (SELECT unnest(range(1, 1001)) AS perm)),
  n AS (SELECT region, perm, avg(value) FILTER (rn <= na) - avg(value) FILTER (rn > na) AS diff, any_value(observed) AS observed FROM p JOIN o USING (region) GROUP BY ALL)
  SELECT region, {q('any_value(observed)', 'observed')}, count(*) FILTER (abs(diff) >= abs(observed)) AS n_extreme, {q('(count(*) FILTER (abs(diff) >= abs(observed)) + 1) / (count(*) + 1)', 'p')} FROM n GROUP BY region""")
def _(t):
    d = t.events.select(F.col("event_type").alias("region"), "event_id", "value", "user_id")
    return rounded(stats.permutation_test(d, ["region"], "value", F.col("user_id") % 3 == 0, "event_id", 1000, 7), "observed", "p")


MSQ = "gm AS (SELECT {g} AS g, count({v}) AS n, avg({v}) AS m, var_pop({v}) AS v FROM {t} GROUP BY 1), tm AS (SELECT sum(n * m) / sum(n) AS gm FROM gm), ms AS (SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_obs, sum(n * power(m - gm, 2)) / (count(*) - 1) AS b, sum(n * v) / (sum(n) - count(*)) AS w FROM gm, tm)"


@query("st07_anova", f"WITH {MSQ.format(g='event_type', v='value', t='events')} SELECT n_groups, n_obs, {q('b', 'ms_between', 4)}, {q('w', 'ms_within', 4)}, {q('b / w', 'f', 8)} FROM ms")
def _(t):
    d = stats.anova_1way(t.events, ["event_type"], "value")
    return rounded(rounded(d, "ms_between", "ms_within", digits=4), "f", digits=8)


# With five groups the first degree of freedom is 4 and the F tail has a closed form.
@query("st07_anova_p", f"WITH {MSQ.format(g='event_type', v='value', t='events')}, x AS (SELECT *, b / w AS f, (n_obs - n_groups) / 2.0::DOUBLE AS a FROM ms), y AS (SELECT *, 2 * a / (2 * a + (n_groups - 1) * f) AS z FROM x) SELECT n_groups, n_obs, b AS ms_between, w AS ms_within, {q('f', 'f')}, {q('power(z, a) * (1 + a * (1 - z))', 'p')} FROM y".replace("b AS ms_between, w AS ms_within", q('b', 'ms_between', 4) + ", " + q('w', 'ms_within', 4)))
def _(t):
    d = stats.with_f_p(stats.anova_1way(t.events, ["event_type"], "value"))
    return rounded(rounded(d, "f", "p"), "ms_between", "ms_within", digits=4)


@query("st07_kruskal", f"""WITH k AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events), g AS (SELECT event_type, count(*) AS n, sum(rk)::DOUBLE AS s FROM k GROUP BY 1), x AS (SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_obs, sum(s * s / n) AS qq FROM g),
  ti AS (SELECT sum(c * c * c - c)::DOUBLE AS tt FROM (SELECT count(*)::DOUBLE AS c FROM events GROUP BY value))
  SELECT n_groups, n_obs, {q('(12.0::DOUBLE / (n_obs::DOUBLE * (n_obs + 1)) * qq - 3 * (n_obs + 1)) / (1 - tt / (n_obs::DOUBLE * n_obs * n_obs - n_obs))', 'h', 4)} FROM x, ti""")
def _(t):
    return rounded(stats.kruskal(t.events, "event_type", "value"), "h", digits=4)


@query("st08_icc1", f"WITH {MSQ.format(g='user_id', v='value', t='events')} SELECT n_groups, n_obs, {q('b', 'ms_between', 4)}, {q('w', 'ms_within', 4)}, {q('n_obs / n_groups', 'k_avg')}, {q('(b - w) / (b + (n_obs / n_groups - 1) * w)', 'icc', 8)} FROM ms")
def _(t):
    d = stats.icc1(t.signal, ["recording"], "value")
    return rounded(rounded(rounded(d, "ms_between", "ms_within", digits=4), "icc", digits=8), "k_avg")


@query("st09_corr_matrix", f"WITH {EMBL} SELECT 'f' || a.d AS feature_a, 'f' || b.d AS feature_b, {q('corr(a.v, b.v)', 'r')} FROM ed a JOIN ed b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY a.d, b.d")
def _(t):
    return rounded(stats.corr_matrix(t.embedded, ALL_DIMS), "r")


@query("st10_corr_by", f"WITH {EMB} SELECT subject, {q('corr(f1, f2)', 'r')} FROM emb GROUP BY subject")
def _(t):
    return rounded(stats.corr_by(t.embedded, ["subject"], "f1", "f2"), "r")


@query("st11_vif", f"WITH {EMB}, m AS (SELECT sum(f1 * f1) AS a, sum(f2 * f2) AS b, sum(f1 * f2) AS c FROM emb) SELECT unnest(['f1', 'f2']) AS feature, {q('1 / (1 - c * c / (a * b))', 'vif')} FROM m")
def _(t):
    return rounded(multivar.vif(t.embedded, ["f1", "f2"]), "vif")


@query("st11_vif_all")
def _(t):
    """All dimensions; tested against numpy."""
    return rounded(multivar.vif(t.embedded, ALL_DIMS), "vif")


@query("st12_pca_all")
def _(t):
    """Loadings on all dimensions; tested against numpy."""
    return rounded(multivar.loadings_table(t.embedded, ALL_DIMS, 3), "loading", "explained")


@query("st12_pca", f"""WITH {EMB}, m AS (SELECT var_pop(f1) AS a, var_pop(f2) AS b, covar_pop(f1, f2) AS c FROM emb), e AS (SELECT *, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c) AS l1, (a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c) AS l2 FROM m),
  v AS (SELECT 'PC1' AS component, c AS x, l1 - a AS y, l1 / (a + b) AS s FROM e UNION ALL SELECT 'PC2', c, l2 - a, l2 / (a + b) FROM e), n AS (SELECT component, x / sqrt(x*x + y*y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS x, y / sqrt(x*x + y*y) * CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS y, s FROM v)
  SELECT component, 'f1' AS feature, {q('x', 'loading')}, {q('s', 'explained')} FROM n UNION ALL SELECT component, 'f2', {q('y', 'loading')}, {q('s', 'explained')} FROM n""")
def _(t):
    return rounded(multivar.loadings_table(t.embedded, ["f1", "f2"], 2), "loading", "explained")


@query("st12_pca_scores_two", f"""WITH {EMB}, m AS (SELECT var_pop(f1) AS a, var_pop(f2) AS b, covar_pop(f1, f2) AS c, avg(f1) AS m1, avg(f2) AS m2 FROM emb), e AS (SELECT *, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c) - a AS y FROM m),
  n AS (SELECT m1, m2, c / sqrt(c*c + y*y) * CASE WHEN abs(c) >= abs(y) THEN sign(c) ELSE sign(y) END AS x, y / sqrt(c*c + y*y) * CASE WHEN abs(c) >= abs(y) THEN sign(c) ELSE sign(y) END AS y FROM e)
  SELECT vec_id, {q('(f1 - m1) * x + (f2 - m2) * y', 'PC1')} FROM emb, n""")
def _(t):
    return multivar.pca(t.embedded, ["f1", "f2"], 1)[0].select("vec_id", r("PC1"))


@query("st12_pca_scores")
def _(t):
    d, _ = multivar.pca(t.embedded, ALL_DIMS, 3)
    return d.select("vec_id", r("PC1"), r("PC2"), r("PC3"))


@query("st13_robust_pca")
def _(t):
    return multivar.robust_pca(t.embedded, "vec_id", ALL_DIMS)


@query("st14_pc_influence")
def _(t):
    return rounded(multivar.pc_influence(t.embedded, "subject", "time_idx", "f1"), "similarity")


@query("st15_spread", f"WITH {EMB} SELECT time_idx, {q('stddev_samp(f1)', 'sd')}, {q('avg(abs(d))', 'mad')} FROM (SELECT *, f1 - avg(f1) OVER (PARTITION BY time_idx) AS d FROM emb) GROUP BY time_idx")
def _(t):
    return rounded(stats.intersubject_variability(t.embedded, "subject", "time_idx", "f1")[0], "sd", "mad")


@query("st15_demeaned_isc", f"WITH {CT}, d AS (SELECT subject, time_idx, f1 - avg(f1) OVER (PARTITION BY time_idx) AS v FROM ce), p AS (SELECT corr(a.v, b.v) AS r FROM d a JOIN d b USING (time_idx) WHERE a.subject < b.subject GROUP BY a.subject, b.subject) SELECT {q('avg(r)', 'mean_r')}, (SELECT count(DISTINCT subject) FROM emb) AS n_entities FROM p")
def _(t):
    return rounded(stats.intersubject_variability(t.embedded, "subject", "time_idx", "f1")[1], "mean_r")


@query("st16_mean_pairwise_corr", f"WITH {CT}, p AS (SELECT corr(a.f1, b.f1) AS r FROM ce a JOIN ce b USING (time_idx) WHERE a.subject < b.subject GROUP BY a.subject, b.subject) SELECT {q('avg(r)', 'mean_r')}, (SELECT count(DISTINCT subject) FROM emb) AS n_entities FROM p")
def _(t):
    return rounded(stats.mean_pairwise_corr(t.embedded, "subject", "time_idx", "f1"), "mean_r")


@query("st17_isc", f"WITH {CT}, p AS (SELECT a.subject, (corr(a.f1, b.f1) + corr(a.f2, b.f2)) / 2 AS r FROM ce a JOIN ce b USING (time_idx) WHERE a.subject <> b.subject GROUP BY a.subject, b.subject) SELECT subject, (SELECT count(*) FROM ct) AS n_times, {q('avg(r)', 'isc')} FROM p GROUP BY subject")
def _(t):
    d = stats.complete_times(t.embedded, [], "subject", "time_idx", ["f1", "f2"])
    return rounded(stats.isc(d, "subject", "time_idx", ["f1", "f2"]), "isc")


@query("st18_isc_null", f"""WITH {CT}, ri AS (SELECT subject, f1, row_number() OVER (PARTITION BY subject ORDER BY time_idx) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM ce),
  sh AS (SELECT subject, perm, f1, (i - CAST(floor({HASH.format("'3-' || subject || '-' || perm")} * n) AS BIGINT) + n) % n AS i FROM ri, (SELECT unnest(range(1, 101)) AS perm)), p AS (SELECT perm, a.subject, corr(a.f1, b.f1) AS r FROM sh a JOIN sh b USING (perm, i) WHERE a.subject <> b.subject GROUP BY perm, a.subject, b.subject)
  SELECT perm, subject, (SELECT count(*) FROM ct) AS n_times, {q('avg(r)', 'isc')} FROM p GROUP BY ALL""")
def _(t):
    from tidegrid.operators.scan import time_index
    d = stats.complete_times(t.embedded, [], "subject", "time_idx", ["f1"])
    d = time_index(d.withColumn("at", F.col("time_idx")).drop("time_idx"), ["subject"], ["at"], out="time_idx")
    return rounded(stats.isc_null(d, "subject", "time_idx", ["f1"], 100, 3), "isc")


@query("st19_band_coupling", f"""WITH {POWER}, b AS (SELECT recording, window_idx, max(value) FILTER (channel = 'click') AS a, max(value) FILTER (channel = 'view') AS h FROM pw GROUP BY ALL), e AS (SELECT recording, corr(a, h) AS r FROM b WHERE a IS NOT NULL AND h IS NOT NULL GROUP BY 1)
  SELECT recording % 5 AS region, {q('avg(r)', 'mean_r')}, {q('stddev_samp(r)', 'sd_r')}, count(r) AS n_elec FROM e GROUP BY 1""")
def _(t):
    both = joins.join_bands(_power(t), ["recording", "window_idx"], "channel", "value", "click", "view")
    c = stats.band_coupling(both, ["recording"], "click", "view").withColumn("region", F.col("recording") % 5)
    return rounded(stats.coupling_by_region(c, ["region"]), "mean_r", "sd_r")


# Missing where a side is constant but for rounding: windows that share their samples.
PAIR_R = "CASE WHEN " + " AND ".join(f"max({s}.value) - min({s}.value) > 1e-11 * max(abs({s}.value))" for s in "ab") + " THEN corr(a.value, b.value) END"


@query("st20_state_fc", f"""WITH {POWER} SELECT a.recording, a.label AS state, a.channel AS a, b.channel AS b, count(*) AS n, {q(PAIR_R, 'r')} FROM pw a JOIN pw b ON a.recording = b.recording AND a.window_idx = b.window_idx AND a.channel < b.channel GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    d = stats.state_fc(_power(t).withColumnRenamed("label", "state"), ["recording"], "state", "channel", "window_idx", "value")
    return rounded(d, "r")


@query("st20_group_fc", f"""WITH {POWER}, k AS (SELECT a.label AS s, a.channel AS ca, b.channel AS cb, a.recording, {PAIR_R} AS r FROM pw a JOIN pw b ON a.recording = b.recording AND a.window_idx = b.window_idx AND a.channel < b.channel GROUP BY ALL HAVING count(*) > 1)
  SELECT ca AS region_a, cb AS region_b, {q("avg(r) FILTER (s LIKE 'Int%')", 'r_int')}, {q("avg(r) FILTER (s LIKE 'Ext%')", 'r_ext')}, {q("avg(r) FILTER (s LIKE 'Int%') - avg(r) FILTER (s LIKE 'Ext%')", 'r_diff')} FROM k GROUP BY ALL""")
def _(t):
    fc = stats.state_fc(_power(t).withColumnRenamed("label", "state"), ["recording"], "state", "channel", "window_idx", "value")
    fc = fc.withColumnsRenamed({"a": "region_a", "b": "region_b"})
    return rounded(stats.group_fc(fc, "state", states.INTERNAL, states.EXTERNAL), "r_int", "r_ext", "r_diff")


@query("st21_corr_of_means", f"WITH {EMB}, m AS (SELECT time_idx, avg(f1) AS a, avg(f2) AS b FROM emb GROUP BY 1) SELECT {q('corr(a, b)', 'r')} FROM m")
def _(t):
    return rounded(stats.corr_of_means(t.embedded, [], "time_idx", "f1", "f2"), "r")


# ---- quality


@query("dq01_artifact_windows", f"""WITH {CH}, md AS (SELECT recording, channel, median(value) AS med FROM ch GROUP BY ALL), rs AS (SELECT ch.recording, ch.channel, med, 1.4826 * median(abs(value - med)) AS s FROM ch JOIN md ON md.recording = ch.recording AND md.channel = ch.channel GROUP BY ALL),
  z AS (SELECT ch.recording, sample_idx, (value - med) / CASE WHEN s > 1e-8 THEN s ELSE 1 END AS z FROM ch JOIN rs ON rs.recording = ch.recording AND rs.channel = ch.channel), a AS (SELECT recording, sample_idx, avg(CASE WHEN z > 2 THEN 1.0 ELSE 0 END) AS fh, avg(z) AS gm, max(z) AS gx FROM z GROUP BY ALL), m AS (SELECT *, CASE WHEN fh > 0.3 AND gm > 1 THEN 1 ELSE 0 END AS mask FROM a)
  SELECT recording, sample_idx, {q('fh', 'frac_high')}, {q('gm', 'global_mean')}, {q('gx', 'global_max')}, mask, max(mask) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mask_padded FROM m""")
def _(t):
    d = quality.artifact_windows(t.channels, ["recording"], "channel", "sample_idx", "value", 2.0, 0.3, 1.0, 3)
    return rounded(d, "frac_high", "global_mean", "global_max")


@query("dq01_long_windows", f"""WITH {CH}, md AS (SELECT recording, channel, median(value) AS med FROM ch GROUP BY ALL), rs AS (SELECT ch.recording, ch.channel, med, 1.4826 * median(abs(value - med)) AS s FROM ch JOIN md ON md.recording = ch.recording AND md.channel = ch.channel GROUP BY ALL),
  z AS (SELECT ch.recording, sample_idx, (value - med) / CASE WHEN s > 1e-8 THEN s ELSE 1 END AS z FROM ch JOIN rs ON rs.recording = ch.recording AND rs.channel = ch.channel), a AS (SELECT recording, sample_idx, avg(CASE WHEN z > 2 THEN 1.0 ELSE 0 END) AS fh, avg(z) AS gm, max(z) AS gx FROM z GROUP BY ALL), m AS (SELECT *, CASE WHEN fh > 0.3 AND gm > 1 THEN 1 ELSE 0 END AS mask FROM a),
  p AS (SELECT recording, sample_idx, max(mask) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS bad FROM m),
  w AS (SELECT recording, unnest(range(CAST(floor((n - 10) / 2.5) AS BIGINT) + 1)) AS window_idx FROM (SELECT recording, max(sample_idx) + 1 AS n FROM p GROUP BY 1) WHERE n >= 10)
  SELECT recording, window_idx, window_idx * 2.5::DOUBLE AS start_sec, window_idx * 2.5::DOUBLE + 10 AS end_sec,
    sum(CASE WHEN bad > 0 THEN greatest(least(sample_idx + 1, window_idx * 2.5::DOUBLE + 10) - greatest(sample_idx, window_idx * 2.5::DOUBLE), 0) ELSE 0 END) AS bad_overlap_sec,
    CAST(sum(CASE WHEN bad > 0 THEN greatest(least(sample_idx + 1, window_idx * 2.5::DOUBLE + 10) - greatest(sample_idx, window_idx * 2.5::DOUBLE), 0) ELSE 0 END) > 0 AS INT) AS mask
  FROM w JOIN p USING (recording) GROUP BY recording, window_idx""")
def _(t):
    """Bins taken as seconds: the padded mask carried to windows of 10 s every 2.5 s."""
    d = quality.artifact_windows(t.channels, ["recording"], "channel", "sample_idx", "value", 2.0, 0.3, 1.0, 3)
    return quality.mask_to_windows(d, ["recording"], "sample_idx", "mask_padded", 10.0, 2.5)


@query("dq02_coverage", """WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'NS' || c_custkey || '_02' ELSE 'NS' || c_custkey END AS patient, 'NS' || c_custkey AS base, '01' AS session, c_mktsegment AS video, CASE WHEN c_custkey % 3 = 0 THEN '02' ELSE '01' END AS run, c_custkey, c_acctbal, c_nationkey FROM customer),
  e AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 10) / 10.0::DOUBLE END AS rp FROM r WHERE c_custkey % 7 <> 0)
  SELECT r.patient, r.session, r.video, r.run, r.c_acctbal > 0 AS has_wavelet, r.c_nationkey < 10 AS has_spectral, rp AS right_present, rp + 0.05 AS left_present, rp + 0.1 AS right_present_post, rp + 0.1 AS left_present_post,
    CASE WHEN rp IS NOT NULL THEN rp >= 0.7 AND rp + 0.05 >= 0.7 END AS gaze_pass_70, CASE WHEN rp IS NOT NULL THEN rp + 0.1 >= 0.7 END AS gaze_pass_70_post, CASE WHEN rp IS NOT NULL THEN rp >= 0.7 AND rp + 0.05 >= 0.7 END AS suggested_include, r.c_custkey % 4 = 0 AS in_pca_stage,
    '' AS include, '' AS exclude_reason, '' AS exclude_modality FROM r LEFT JOIN e ON e.c_custkey = r.c_custkey""")
def _(t):
    k = F.col("c_custkey")
    base = F.concat(F.lit("NS"), k.cast("string"))
    rec = t.customer.select(F.when(k % 2 == 0, F.concat(base, F.lit("_02"))).otherwise(base).alias("patient"), base.alias("base"), F.lit("01").alias("session"),
                            F.col("c_mktsegment").alias("video"), F.when(k % 3 == 0, "02").otherwise("01").alias("run"), "c_custkey", "c_acctbal", "c_nationkey")
    rp = F.when(k % 5 != 0, (k % 10) / F.lit(10.0))
    # Eye tables drop the implant suffix, and name run 01 for every fourth recording.
    eye = rec.filter("c_custkey % 7 <> 0").select(F.col("base").alias("patient"), "video", F.when(k % 4 == 0, "01").otherwise(F.col("run")).alias("run"), rp.alias("right_present"),
                                                  (rp + 0.05).alias("left_present"), (rp + 0.1).alias("right_present_post"), (rp + 0.1).alias("left_present_post"))
    on = ["patient", "video"]
    return quality.coverage(rec.select("patient", "session", "video", "run"), {"has_wavelet": (rec.filter("c_acctbal > 0"), on), "has_spectral": (rec.filter("c_nationkey < 10"), on)}, eye, rec.filter("c_custkey % 4 = 0"))


@query("dq03_missing_fraction", f"WITH {SIG} SELECT recording, {q('avg(CAST(gappy IS NULL AS INT))', 'gappy_missing')}, {q('avg(CAST(value IS NULL AS INT))', 'value_missing')} FROM sig GROUP BY recording")
def _(t):
    return rounded(quality.missing_fraction(t.signal, ["recording"], ["gappy", "value"]), "gappy_missing", "value_missing")


@query("dq04_integrity", f"""WITH {SIG}, x AS (SELECT recording, channel, CASE WHEN recording % 4 = 0 AND channel = 'view' THEN 0 WHEN recording % 6 = 1 AND event_id % 5 = 0 THEN NULL ELSE value END AS v FROM sig), c AS (SELECT recording, channel, max(abs(v)) AS mx, count(*) FILTER (v IS NULL) AS b FROM x GROUP BY ALL)
  SELECT recording, count(*) AS n_channels, count(*) FILTER (coalesce(mx, 0) = 0) AS n_zero, CASE WHEN arg_min(b, channel) > 0 THEN 'unreadable' WHEN count(*) FILTER (coalesce(mx, 0) = 0) > 0 THEN 'partial' ELSE 'ok' END AS status FROM c GROUP BY recording""")
def _(t):
    rec = F.col("recording")
    v = F.when((rec % 4 == 0) & (F.col("channel") == "view"), 0.0).when((rec % 6 == 1) & (F.col("event_id") % 5 == 0), float("nan")).otherwise(F.col("value"))
    return quality.integrity(t.signal.withColumn("v", v), ["recording"], "channel", "v")


@query("dq05_recording_quality", f"""WITH {SIG}, b AS (SELECT *, channel = 'error' AND recording % 2 = 0 AS bad FROM sig), m AS (SELECT recording, avg(abs(value)) AS ma, stddev_pop(value) AS sd, max(value) - min(value) AS rg FROM b WHERE NOT bad GROUP BY 1), c AS (SELECT recording, channel, stddev_pop(value) AS s FROM b WHERE NOT bad GROUP BY ALL), cm AS (SELECT recording, median(s) AS ms FROM c GROUP BY 1),
  f AS (SELECT recording, count(*) FILTER (s < 0.1 * ms) AS n_flat FROM c JOIN cm USING (recording) GROUP BY 1), n AS (SELECT recording, count(*) AS n_contacts, count(*) FILTER (NOT bd) AS n_good FROM (SELECT recording, channel, bool_or(bad) AS bd FROM b GROUP BY ALL) GROUP BY 1)
  SELECT recording, n_contacts, n_good, {q('ma', 'mean_abs')}, {q('sd', 'sd')}, {q('rg', 'range')}, n_flat, {q('n_good / n_contacts * 100', 'good_pct')}, CASE WHEN n_good / n_contacts >= 0.9 THEN 'EXCELLENT' WHEN n_good / n_contacts >= 0.75 THEN 'GOOD' WHEN n_good / n_contacts >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS quality FROM n JOIN m USING (recording) JOIN f USING (recording)""")
def _(t):
    bad = (F.col("channel") == "error") & (F.col("recording") % 2 == 0)
    return rounded(quality.recording_quality(t.signal, ["recording"], "channel", "value", bad), "mean_abs", "sd", "range", "good_pct")


@query("dq06_select_refs", f"""WITH c AS (SELECT p_partkey, p_brand, p_retailprice AS a, p_size::DOUBLE AS b FROM part WHERE p_size > 5), m AS (SELECT median(a) AS ma, median(b) AS mb FROM c), d AS (SELECT median(abs(a - ma)) AS da, median(abs(b - mb)) AS db FROM c, m),
  s AS (SELECT p_partkey, p_brand, 0.2 * (a - ma) / (1.4826 * (da + 1e-12)) + 0.4 * (b - mb) / (1.4826 * (db + 1e-12)) AS score FROM c, m, d), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, p_partkey) AS rn FROM s)
  SELECT p_partkey, p_brand, {q('score', 'score')} FROM k WHERE rn = 1 ORDER BY score, p_partkey LIMIT 12""")
def _(t):
    d = t.part.select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("size"))
    d = quality.select_refs(d, "p_partkey", "p_brand", {"a": (F.col("p_retailprice"), 0.2), "b": (F.col("size"), 0.4)}, F.col("size") > 5)
    return d.select("p_partkey", "p_brand", r("score"))


@query("dq07_composite_rank", f"SELECT p_partkey, {q('(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 + rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2) / 2', 'composite')} FROM part")
def _(t):
    return quality.composite_rank(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", r("composite"))


@query("dq08_compare_timebases", f"""WITH {SIG}, a AS (SELECT recording, sample_idx, t + 5 AS t FROM sig), b AS (SELECT recording, sample_idx, t + sample_idx * 0.0001 AS t FROM sig WHERE sample_idx % 17 <> 3), z AS (SELECT a.recording, a.t - min(a.t) OVER w AS x, b.t - min(b.t) OVER w AS y FROM a JOIN b USING (recording, sample_idx) WINDOW w AS (PARTITION BY a.recording))
  SELECT recording, count(*) AS n, {q('max(abs(x - y))', 'max_error')}, bool_and(abs(x - y) <= 0.0035) AS equal FROM z GROUP BY recording""")
def _(t):
    a = t.signal.withColumn("t", F.col("t") + 5)
    b = t.signal.filter("sample_idx % 17 <> 3").withColumn("t", F.col("t") + F.col("sample_idx") * 0.0001)
    return rounded(quality.compare_timebases(a, b, ["recording"], "sample_idx", "t", 0.0035), "max_error")


@query("dq09_accuracy_summary", f"""WITH RECURSIVE {SIG},
  tg AS (SELECT recording, event_id, t, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS k FROM sig WHERE channel = 'view'),
  rs AS (SELECT recording, event_id, t, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS k FROM sig WHERE channel = 'click'),
  st AS (SELECT recording, 0::BIGINT AS k, 0::BIGINT AS used, NULL::DOUBLE AS lat FROM tg GROUP BY recording
    UNION ALL SELECT st.recording, tg.k, coalesce(m.k, st.used), m.t - tg.t FROM st JOIN tg ON tg.recording = st.recording AND tg.k = st.k + 1
      LEFT JOIN LATERAL (SELECT rs.k, rs.t FROM rs WHERE rs.recording = st.recording AND rs.k > st.used AND rs.t >= tg.t AND rs.t <= tg.t + 172800 ORDER BY rs.k LIMIT 1) m ON true),
  a AS (SELECT recording, count(*) AS n_targets, count(lat) AS n_hits, avg(lat) AS m, median(lat) AS md FROM st WHERE k > 0 GROUP BY 1), n AS (SELECT recording, count(*) AS n FROM rs GROUP BY 1)
  SELECT a.recording, n_targets, n_hits, {q('m', 'mean_rt', 3)}, {q('md', 'median_rt', 3)}, coalesce(n, 0) AS n_responses, {q('n_hits / n_targets', 'hit_rate')}, coalesce(n, 0) - n_hits AS n_false_alarms FROM a LEFT JOIN n ON n.recording = a.recording""")
def _(t):
    d = t.signal.select("recording", "event_id", "t", "channel")
    resp = d.filter("channel = 'click'").drop("channel")
    m = joins.match_responses(d.filter("channel = 'view'").drop("channel"), resp, ["recording"], "t", "event_id", 172800.0)
    return rounded(rounded(quality.accuracy_summary(m, resp, ["recording"]), "hit_rate"), "mean_rt", "median_rt", digits=3)


@query("dq10_sensitivity", f"""WITH {SIG}, """ + ", ".join(f"s{k} AS (SELECT recording, abs(v - lag(v) OVER (PARTITION BY recording ORDER BY sample_idx)) AS d FROM (SELECT recording, sample_idx, avg(value) OVER (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING) AS v FROM sig))" for k in (1, 3, 5))
       + " " + " UNION ALL ".join(f"SELECT {k} AS parameter, count(d) AS n_events, count(*) FILTER (d > 100) AS n_implausible, {q('max(d)', 'max_velocity')} FROM s{k}" for k in (1, 3, 5)))
def _(t):
    def measure(d, k):
        s = series.smooth_decimate(d, ["recording"], "sample_idx", "value", k, 1, "v")
        s = series.step_from(s, ["recording"], "sample_idx", {"d": "v"}).withColumn("d", F.abs("d"))
        return filters.flag_implausible(s, [], "d", 100.0)
    return rounded(quality.sensitivity(t.signal, [], "sample_idx", [1, 3, 5], measure), "max_velocity")


@query("dq11_cohort_quality", f"WITH {SIG}, s AS (SELECT recording, avg(CAST(vl AND event_id % 4 <> 0 AS INT)) AS v FROM sig GROUP BY 1) SELECT recording % 3 AS video, count(*) AS n_recordings, {q('avg(v) * 100', 'mean_valid_pct')}, count(*) FILTER (v > 0.8) AS above_80, count(*) FILTER (v > 0.5) AS above_50, count(*) FILTER (v <= 0.5) AS to_exclude FROM s GROUP BY 1")
def _(t):
    s = t.signal.groupBy("recording").agg(F.avg((F.col("vl") & (F.col("event_id") % 4 != 0)).cast("double")).alias("v"))
    return rounded(quality.cohort_quality(s.withColumn("video", F.col("recording") % 3), ["video"], "v"), "mean_valid_pct")


# ---- sorts, top-k, sets, shapes


@query("so01_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def _(t):
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.col("s_acctbal").desc())


@query("so02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def _(t):
    return reshape.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40)


@query("so03_top_k_by", "SELECT user_id, event_id, value, rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3")
def _(t):
    return reshape.top_k_by(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id").desc()], 3, ["event_id"])


@query("so04_in_order", "SELECT r_regionkey, r_name, nullif(list_position(['EUROPE', 'ASIA', 'AFRICA'], r_name), 0)::BIGINT AS ordinal FROM region ORDER BY 3 NULLS LAST, 2")
def _(t):
    return reshape.in_order(t.region, "r_name", ["EUROPE", "ASIA", "AFRICA"])


@query("so05_reorder_channels", "SELECT p_partkey, p_type, p_brand, p_name FROM part ORDER BY p_type, p_brand, p_partkey")
def _(t):
    return t.part.select("p_partkey", "p_type", "p_brand", "p_name").orderBy("p_type", "p_brand", "p_partkey")


@query("se01_union", "SELECT c_custkey AS id, c_name AS label, c_acctbal AS bal, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("bal"))
    return reshape.union([a, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("size"))])


@query("se02_index_sets", "SELECT o_custkey AS id, 'both' AS side FROM (SELECT DISTINCT o_custkey FROM orders) SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) USING (o_custkey) UNION ALL SELECT c_custkey, 'no_orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    c = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal")
    both = o.join(c.filter("c_acctbal > 0"), "id", "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(c.select("id").join(o, "id", "left_anti").withColumn("side", F.lit("no_orders")))


@query("se03_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    d = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return reshape.keep_first(d, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("se04_complete_cells", "WITH k AS (SELECT c_mktsegment AS region, c_custkey % 499 AS rec, count(*) AS n FROM customer GROUP BY ALL) SELECT r.region, c.rec, k.n FROM (SELECT DISTINCT region FROM k) r CROSS JOIN (SELECT DISTINCT rec FROM k) c LEFT JOIN k ON k.region = r.region AND k.rec = c.rec")
def _(t):
    k = t.customer.groupBy(F.col("c_mktsegment").alias("region"), (F.col("c_custkey") % 499).alias("rec")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.complete_cells(k, "region", "rec", "n", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("rs01_pivot", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def _(t):
    m = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return reshape.pivot_long(m, ["user_id"], "event_type", "v", ["click", "view"])


@query("rs02_melt", "SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(t):
    return reshape.melt(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


# ---- whole analyses


def _flow_inputs(t):
    """The recording with its channels: label 'all' split by event type."""
    lab = _window_labels(t).select("recording", "window_idx", "label")
    meta = t.signal.select("channel").distinct().withColumn("region", _region())
    return lab, meta


FLOW1 = f"""{LAB}, cw AS (SELECT c.recording, c.channel, k.window_idx, avg(value) AS m FROM (SELECT recording, channel, value, row_number() OVER (PARTITION BY recording, channel ORDER BY t, event_id) - 1 AS i FROM sig) c,
    LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((c.i - 3) / 2.0) AS BIGINT)), c.i // 2 + 1)) AS window_idx) k GROUP BY ALL HAVING count(*) = 4),
  md AS (SELECT recording, channel, median(m) AS med FROM cw GROUP BY ALL), rs AS (SELECT cw.recording, cw.channel, med, median(abs(m - med)) AS mad FROM cw JOIN md ON md.recording = cw.recording AND md.channel = cw.channel GROUP BY ALL),
  z AS (SELECT cw.recording, cw.channel, {REGION.replace('channel', 'cw.channel')} AS region, (m - med) / (1.4826 * nullif(mad, 0)) AS z, label FROM cw JOIN rs ON rs.recording = cw.recording AND rs.channel = cw.channel LEFT JOIN (SELECT recording, window_idx, label FROM lb) l ON l.recording = cw.recording AND l.window_idx = cw.window_idx),
  el AS (SELECT recording, channel, region, avg(z) FILTER (label LIKE 'Int%') AS a, avg(z) FILTER (label LIKE 'Ext%') AS b FROM z GROUP BY ALL HAVING count(z) FILTER (label LIKE 'Int%') >= 1 AND count(z) FILTER (label LIKE 'Ext%') >= 1), rd AS (SELECT recording, region, avg(a) - avg(b) AS d FROM el GROUP BY ALL)"""


@query("flow1_power_contrast", f"""WITH {FLOW1}
  SELECT region, count(d) AS n, {q('avg(d)', 'mean', 5)}, {q('stddev_samp(d)', 'sd', 5)}, {q('avg(d) / (stddev_samp(d) / sqrt(count(d)))', 't', 5)} FROM rd GROUP BY region""")
def _(t):
    lab, meta = _flow_inputs(t)
    d = flows.power_contrast(t.channels, meta, lab, "recording", "channel", "sample_idx", "value", "region", 4, 2, min_n=1)
    return rounded(d.select("region", "n", "mean", "sd", "t"), "mean", "sd", "t", digits=5)


@query("flow1_power_contrast_p", f"""WITH {FLOW1}, a AS (SELECT region, count(d) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM rd GROUP BY region), {_t_tail_sql('a.t', '(a.n - 1)', 'a', 'pv')},
  k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, region) AS rk FROM pv), j AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS padj FROM k)
  SELECT region, n, {q('mean', 'mean', 5)}, {q('t', 't', 5)}, {q('p', 'p', 5)}, {q('padj', 'p_adj', 5)}, CASE WHEN padj < 0.001 THEN '***' WHEN padj < 0.01 THEN '**' WHEN padj < 0.05 THEN '*' ELSE '' END AS stars FROM j""")
def _(t):
    lab, meta = _flow_inputs(t)
    d = flows.power_contrast(t.channels, meta, lab, "recording", "channel", "sample_idx", "value", "region", 4, 2, min_n=1)
    d = d.withColumn("stars", scalars.stars(F.col("p_adj"))).select("region", "n", "mean", "t", "p", "p_adj", "stars")
    return rounded(d, "mean", "t", "p", "p_adj", digits=5)


@query("flow2_attention_labels_two", f"""WITH {EMB}, {MAHAL}, m AS (SELECT var_pop(f1) AS a, var_pop(f2) AS b, covar_pop(f1, f2) AS c, avg(f1) AS m1, avg(f2) AS m2 FROM emb), e AS (SELECT *, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c) - a AS y FROM m),
  n AS (SELECT m1, m2, c / sqrt(c*c + y*y) * CASE WHEN abs(c) >= abs(y) THEN sign(c) ELSE sign(y) END AS x, y / sqrt(c*c + y*y) * CASE WHEN abs(c) >= abs(y) THEN sign(c) ELSE sign(y) END AS y FROM e),
  sc AS (SELECT vec_id, f8, (f1 - m1) * x + (f2 - m2) * y AS s FROM emb, n), al AS (SELECT vec_id, CASE WHEN corr(s, f8) OVER () > 0 THEN -s ELSE s END AS pc FROM sc),
  zz AS (SELECT mh.vec_id, pc, dev, (pc - avg(pc) OVER w) / nullif(stddev_pop(pc) OVER w, 0) AS pz, (dev - avg(dev) OVER w) / nullif(stddev_pop(dev) OVER w, 0) AS dz FROM mh JOIN al ON al.vec_id = mh.vec_id WINDOW w AS (PARTITION BY subject))
  SELECT vec_id, {q('pc', 'PC1')}, {q('dev', 'deviation')}, {q('pz', 'PC1_z')}, {q('dz', 'deviation_subject_z')}, CASE WHEN pz > 0.6 AND dz > 0.6 THEN 'Internal_HighConfidence' WHEN pz < -0.6 AND dz < -0.6 THEN 'External_HighConfidence' ELSE 'Neutral' END AS label FROM zz""")
def _(t):
    d = flows.attention_labels(t.embedded, "subject", "time_idx", ["f1", "f2"], "f8", 0.6, 0.6, weight=0.1)
    return d.select("vec_id", r("PC1"), r("deviation"), r("PC1_z"), r("deviation_subject_z"), "label")


@query("flow2_attention_labels")
def _(t):
    d = flows.attention_labels(t.embedded, "subject", "time_idx", ALL_DIMS, "f8", 0.6, 0.6)
    return d.select("vec_id", "subject", "time_idx", r("PC1"), r("deviation"), r("PC1_z"), r("deviation_subject_z"), "label")


@query("flow3_spectral_events")
def _(t):
    d = flows.spectral_events(t.signal, ["recording"], "sample_idx", "value", FS, 32, 8, SEG, 0.5, 4.0, {"slow": (0.5, 1.5), "mid": (1.5, 2.75), "fast": (2.75, 4.5)})
    return rounded(d, *[c for c, ty in d.dtypes if ty == "double"], digits=5)
