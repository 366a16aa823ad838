"""The same tables in DuckDB SQL: common table expressions that the queries' own SQL builds on."""

from __future__ import annotations

from ..schema import CABLING, NOISY_CHANNELS
from .inputs import WINDOWS, ctes

PMOD = "(CASE WHEN {x} % {p} < 0 THEN {x} % {p} + {p} ELSE {x} % {p} END)"


def pmod(x: str, p: str) -> str:
    return PMOD.format(x=f"({x})", p=p)


def wrap(d: str) -> str:
    return f"({pmod(f'{d} + 46080::DOUBLE', '92160::DOUBLE')} - 46080::DOUBLE)"


def gray(x: str) -> str:
    for k in (8, 4, 2, 1):
        x = f"xor({x}, ({x}) >> {k})"
    return x


FIELDS = f"""
f0 AS (SELECT *, (d2 & 32768) <> 0 AS is_hit, (d1 >> 22) & 31 AS vmm, (d1 >> 12) & 1023 AS adc, d1 & 4095 AS g0, (d1 >> 27) & 31 AS raw_offset, (d2 >> 8) & 63 AS ch, ((d2 >> 14) & 1) = 1 AS over_threshold, d2 & 255 AS tdc FROM words),
f1 AS (SELECT *, xor(g0, g0 >> 8) AS g1 FROM f0), f2 AS (SELECT *, xor(g1, g1 >> 4) AS g2 FROM f1), f3 AS (SELECT *, xor(g2, g2 >> 2) AS g3 FROM f2),
fields AS (SELECT *, xor(g3, g3 >> 1) AS bcid, CASE WHEN raw_offset < 16 THEN raw_offset ELSE raw_offset - 32 END AS "offset", (d2 >> 10) & 31 AS id, d1 * 1024 + (d2 & 1023) AS val FROM f3)"""
MARKS = {
    "SRS": """
marks AS (SELECT *, CASE WHEN is_hit THEN vmm ELSE id END AS owner, CASE WHEN NOT is_hit THEN val END AS v_srs, CAST(NULL AS BIGINT) AS v_time, CAST(NULL AS BIGINT) AS v_ctr FROM fields)""",
    "TRG": """
marks AS (SELECT *, CASE WHEN is_hit THEN vmm WHEN id < 16 AND val < 4096 THEN id WHEN id >= 16 THEN id % 16 END AS owner,
  CASE WHEN NOT is_hit AND id < 16 AND val < 4096 THEN val END AS v_srs,
  CASE WHEN NOT is_hit AND id >= 16 AND ((d1 >> 28) & 15) <> 15 THEN d1 * 1024 END AS v_time,
  CASE WHEN NOT is_hit AND id >= 16 AND ((d1 >> 28) & 15) = 15 THEN (d1 & 63) * 1024 + (d2 & 1023) END AS v_ctr FROM fields)""",
}
HITS = """
filled AS (SELECT *, coalesce(last_value(v_srs IGNORE NULLS) OVER w, 0) AS srs_timestamp, coalesce(last_value(v_time IGNORE NULLS) OVER w, 0) AS trigger_time, coalesce(last_value(v_ctr IGNORE NULLS) OVER w, 0) AS trigger_counter
  FROM marks WHERE owner IS NOT NULL WINDOW w AS (PARTITION BY capture_id, fec, owner ORDER BY pkt_no, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
raw AS (SELECT capture_id, pkt_no, word_no, fec, vmm, frame AS "time", ch, adc, over_threshold, "offset", bcid, tdc, srs_timestamp, trigger_time, trigger_counter FROM filled WHERE is_hit),
cal AS (SELECT v.range AS vmm, c.range AS ch, (v.range % 5) * 0.25::DOUBLE AS time_offset, 1.0::DOUBLE AS time_slope, (c.range % 4)::DOUBLE AS adc_offset, 1 + v.range % 3 * 0.5::DOUBLE AS adc_slope FROM range(32) v, range(64) c),
hits AS (SELECT raw.*, ("offset" * 4096 + bcid) * 22.5::DOUBLE + (22.5::DOUBLE - tdc * 60::DOUBLE / 255::DOUBLE - 0::DOUBLE) * 1::DOUBLE AS timestamp_ns, CAST(adc AS FLOAT) AS adc_calibrated,
  srs_timestamp * 25::DOUBLE + (("offset" * 4096 + bcid) * 22.5::DOUBLE + (22.5::DOUBLE - tdc * 60::DOUBLE / 255::DOUBLE - 0::DOUBLE) * 1::DOUBLE) AS abs_time_ns, "offset" >= -1 AS hit_valid FROM raw)"""
_chips = [(v, s, z, c, h) for s, z, c, _, lo, hi in CABLING for v, h in ((lo, "bot"), (hi, "top"))]
DIMENSIONS = f"""
cabling AS (SELECT * FROM (VALUES {", ".join(f"({v}, '{s}', {z}::DOUBLE, {c}, '{h}')" for v, s, z, c, h in _chips)}) t(vmm, station, z_mm, connector, half)),
geometry AS (SELECT range AS channel_id, (100 + 4 * (range // 128) + (range % 128) % 16 * 5)::DOUBLE AS pad_cx, ((range % 128) // 16 * 6)::DOUBLE AS pad_cy, 5::DOUBLE AS pad_w, 5::DOUBLE AS pad_h, (range // 128 * 3)::DOUBLE AS pad_angle FROM range(1280) WHERE range % 37 <> 5),
channels AS (SELECT c.*, w.range AS ch, connector - 1 AS sector, s.strategy, s.lower, CASE WHEN (half = 'top') = (s.lower = 'bot') THEN 65 ELSE 1 END + CASE
    WHEN (CASE WHEN station = 'P2_IN' AND connector IN (5, 6) AND ((half = 'top') = (s.lower = 'bot')) THEN 'linear' ELSE s.strategy END) = 'linear' THEN w.range
    WHEN (CASE WHEN station = 'P2_IN' AND connector IN (5, 6) AND ((half = 'top') = (s.lower = 'bot')) THEN 'linear' ELSE s.strategy END) = 'reverse' THEN 63 - w.range ELSE xor(w.range, 1) END AS strip
  FROM cabling c, range(64) w, (SELECT * FROM (VALUES ('linear'), ('reverse'), ('pairswap')) a(strategy), (VALUES ('bot'), ('top')) b(lower)) s),
all_pads AS (SELECT c.*, sector * 128 + strip - 1 AS channel_id, pad_cx, pad_cy, pad_w, pad_h, pad_angle, pad_cx IS NOT NULL AS mapped FROM channels c LEFT JOIN geometry g ON g.channel_id = c.sector * 128 + c.strip - 1),
pads AS (SELECT * FROM all_pads WHERE strategy = 'reverse' AND lower = 'bot'),
occ AS (SELECT vmm, ch, count(*) AS n FROM hits GROUP BY ALL),
lit AS (SELECT p.station, p.vmm, p.ch, pad_cx, pad_cy, coalesce(n, 0) AS n FROM pads p LEFT JOIN occ o ON o.vmm = p.vmm AND o.ch = p.ch WHERE mapped),
near AS (SELECT * FROM (SELECT a.station, a.vmm, a.ch, b.vmm AS n_vmm, b.ch AS n_ch, row_number() OVER (PARTITION BY a.vmm, a.ch ORDER BY sqrt((a.pad_cx - b.pad_cx) * (a.pad_cx - b.pad_cx) + (a.pad_cy - b.pad_cy) * (a.pad_cy - b.pad_cy)), b.vmm, b.ch) AS rank
  FROM pads a JOIN pads b ON a.station = b.station AND NOT (a.vmm = b.vmm AND a.ch = b.ch) WHERE a.mapped AND b.mapped) x WHERE rank <= 6),
med AS (SELECT near.station, near.vmm, near.ch, median(lit.n) AS med FROM near JOIN lit ON lit.vmm = n_vmm AND lit.ch = n_ch GROUP BY ALL),
caps AS (SELECT DISTINCT capture_id FROM hits),
occ_c AS (SELECT capture_id, vmm, ch, count(*) AS n FROM hits GROUP BY ALL),
lit_c AS (SELECT c.capture_id, p.station, p.vmm, p.ch, coalesce(n, 0) AS n FROM caps c CROSS JOIN (SELECT station, vmm, ch FROM pads WHERE mapped) p LEFT JOIN occ_c o ON o.capture_id = c.capture_id AND o.vmm = p.vmm AND o.ch = p.ch),
med_c AS (SELECT l.capture_id, near.vmm, near.ch, median(l.n) AS med FROM near JOIN lit_c l ON l.vmm = n_vmm AND l.ch = n_ch GROUP BY ALL),
hot_channels AS (SELECT capture_id, vmm, ch FROM (SELECT *, sum(n) OVER (PARTITION BY capture_id, vmm) AS total, median(n) OVER (PARTITION BY capture_id, vmm) AS m FROM occ_c) x WHERE total >= 200 AND n > 8 * m),
hot_pads AS (SELECT l.capture_id, l.vmm, l.ch FROM lit_c l JOIN med_c m ON l.capture_id = m.capture_id AND l.vmm = m.vmm AND l.ch = m.ch WHERE n >= 50 AND n > 6 * greatest(m.med, 1)),
noisy AS (SELECT capture_id, vmm, ch FROM caps, (VALUES {", ".join(map(str, NOISY_CHANNELS))}) t(vmm, ch)),
mask AS (SELECT * FROM noisy UNION SELECT * FROM hot_channels UNION SELECT * FROM hot_pads),
masked AS (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.capture_id = h.capture_id AND m.vmm = h.vmm AND m.ch = h.ch AND NOT (m.vmm = 0 AND m.ch = 44))),
channel_mask AS (SELECT * FROM noisy UNION SELECT * FROM hot_channels),
channel_masked AS (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM channel_mask m WHERE m.capture_id = h.capture_id AND m.vmm = h.vmm AND m.ch = h.ch AND NOT (m.vmm = 0 AND m.ch = 44)))"""
FOLD = "list_reduce(list_transform(list_sort(list_distinct(list({p}))), lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] > {dead} THEN list_concat(acc, x) ELSE acc END)"


def groups(source: str = "hits", dead: float = 1500) -> str:
    """trg (capture_id, srs_timestamp, triggers), groups with phases, and windows by station."""
    phase = pmod("timestamp_ns", "92160::DOUBLE")
    return f"""
trg AS (SELECT capture_id, srs_timestamp, {FOLD.format(p=phase, dead=f"{dead}::DOUBLE")} AS triggers FROM {source} WHERE vmm = 0 AND ch = 44 GROUP BY ALL),
sh AS (SELECT h.*, station, {phase} AS ph FROM {source} h JOIN cabling c ON c.vmm = h.vmm),
groups AS (SELECT sh.capture_id, station, sh.srs_timestamp, any_value(triggers) AS triggers, list_sort(list(ph)) AS phases FROM sh JOIN trg ON trg.capture_id = sh.capture_id AND trg.srs_timestamp = sh.srs_timestamp GROUP BY 1, 2, 3),
win AS (SELECT *, mu - 3 * sigma AS dt_min, mu + 3 * sigma AS dt_max, mu + 4 * sigma AS sb_min, mu + 10 * sigma AS sb_max FROM (VALUES {", ".join(f"('{s}', {m}::DOUBLE, {g}::DOUBLE)" for s, m, g in WINDOWS)}) t(station, mu, sigma)),
pairs AS (SELECT capture_id, station, srs_timestamp, t, p, {wrap("p - t")} AS dt FROM (SELECT capture_id, station, srs_timestamp, t, unnest(phases) AS p FROM (SELECT capture_id, station, srs_timestamp, unnest(triggers) AS t, phases FROM groups) a) b),
nexts AS (SELECT capture_id, station, srs_timestamp, triggers, coalesce(lead(phases) OVER (PARTITION BY capture_id, station ORDER BY srs_timestamp), first_value(phases) OVER (PARTITION BY capture_id, station ORDER BY srs_timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS phases FROM groups),
mixed AS (SELECT capture_id, station, srs_timestamp, t, p, {wrap("p - t")} AS dt FROM (SELECT capture_id, station, srs_timestamp, t, unnest(phases) AS p FROM (SELECT capture_id, station, srs_timestamp, unnest(triggers) AS t, phases FROM nexts) a) b),
in_time AS (SELECT sh.*, FALSE AS x FROM sh JOIN trg ON trg.capture_id = sh.capture_id AND trg.srs_timestamp = sh.srs_timestamp JOIN win ON win.station = sh.station
  WHERE len(list_filter(triggers, lambda t: {wrap("sh.ph - t")} BETWEEN dt_min AND dt_max)) > 0)"""


def spectra(window: float = 1000) -> str:
    """dth, dtm (histograms of pairs and mixed pairs) and spec (every bin with raw and scaled mixed contents)."""
    hist = f"SELECT capture_id, station, CAST(least(floor((dt + {window}::DOUBLE) * 200 / {2 * window}::DOUBLE), 199) AS BIGINT) AS bin FROM {{}} WHERE dt BETWEEN -{window} AND {window}"
    counted = ", ".join(f"{name} AS (SELECT capture_id, station, bin, count(*) AS n FROM ({hist.format(source)}) x GROUP BY ALL)" for name, source in (("dth", "pairs"), ("dtm", "mixed")))
    return f"""{counted},
spec0 AS (SELECT g.capture_id, g.station, b.range AS bin, coalesce(dth.n, 0)::DOUBLE AS raw, coalesce(dtm.n, 0)::DOUBLE AS m FROM (SELECT DISTINCT capture_id, station FROM groups) g CROSS JOIN range(200) b LEFT JOIN dth ON dth.capture_id = g.capture_id AND dth.station = g.station AND dth.bin = b.range LEFT JOIN dtm ON dtm.capture_id = g.capture_id AND dtm.station = g.station AND dtm.bin = b.range),
spec AS (SELECT capture_id, station, bin, raw, m * coalesce(sum(raw) FILTER (bin < 50 OR bin >= 150) OVER w / nullif(sum(m) FILTER (bin < 50 OR bin >= 150) OVER w, 0), 1) AS mixed FROM spec0 WINDOW w AS (PARTITION BY capture_id, station))"""


def fits(window: float = 1000) -> str:
    """fit: the peak of each capture and station, its windows, contrast and second peak, from spec."""
    step, w = f"{window / 100}::DOUBLE", "WINDOW w AS (PARTITION BY capture_id, station)"
    x = lambda b: f"(({b} + 0.5::DOUBLE) * {step} - {window}::DOUBLE)"
    return f"""
p0 AS (SELECT *, raw - mixed AS hist, {x("bin")} AS x FROM spec),
p1 AS (SELECT *, max(hist) OVER w AS highest, first_value(bin) OVER (PARTITION BY capture_id, station ORDER BY hist DESC, bin) AS top, median(hist) OVER w AS mid FROM p0 {w}),
p2 AS (SELECT *, coalesce(max(bin) FILTER (bin < top AND NOT hist > highest / 2) OVER w, -1) AS a, coalesce(min(bin) FILTER (bin > top AND NOT hist > highest / 2) OVER w, 200) AS b FROM p1 {w}),
p3 AS (SELECT *, CASE WHEN abs(x - {x("top")}) <= 3 * greatest((b - a - 2) * {step}, {step}) / 2.3548::DOUBLE THEN greatest(hist, 0) ELSE 0 END AS wt FROM p2),
p4 AS (SELECT *, sum(wt * x) OVER w / nullif(sum(wt) OVER w, 0) AS mu FROM p3 {w}),
p5 AS (SELECT *, greatest(sqrt(sum(wt * (x - mu) * (x - mu)) OVER w / nullif(sum(wt) OVER w, 0)), {step} / 2) AS sigma FROM p4 {w}),
p6 AS (SELECT capture_id, station, any_value(highest) AS highest, any_value(mid) AS mid, any_value(mu) AS mu, any_value(sigma) AS sigma, min_by(raw, (abs(x - mu), bin)) AS raw_at, min_by(mixed, (abs(x - mu), bin)) AS mixed_at,
  max_by(x, (hist, -bin)) FILTER (abs(x - mu) > 5 * sigma) AS x2, max(hist) FILTER (abs(x - mu) > 5 * sigma) AS h2 FROM p5 GROUP BY ALL),
fit AS (SELECT capture_id, station, highest - mid AS amplitude, mu, sigma, greatest(mid, 0) AS bg, CASE WHEN mixed_at > 0 THEN raw_at / mixed_at ELSE 'infinity'::DOUBLE END AS contrast, CASE WHEN h2 >= 0.05::DOUBLE * highest THEN x2 END AS secondary_dt_ns, CASE WHEN h2 >= 0.05::DOUBLE * highest THEN h2 / highest END AS secondary_frac,
  mu - 3 * sigma AS dt_min, mu + 3 * sigma AS dt_max, CASE WHEN mu + 10 * sigma <= {window} THEN mu + 4 * sigma ELSE mu - 10 * sigma END AS sb_min, CASE WHEN mu + 10 * sigma <= {window} THEN mu + 10 * sigma ELSE mu - 4 * sigma END AS sb_max FROM p6 WHERE highest > 0)"""


# The words that the decoder reads of the packets: those with the magic, without a packet's last word.
SENT = "sent AS (SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY capture_id, pkt_no) AS k FROM words) x WHERE pkt_no % 10 <> 9 AND word_no < k - 1)"


def oracle(select: str, data_format: str = "SRS", corrupt: bool = False, extra: str = "", source: str = "hits", sent: bool = False) -> str:
    """A whole statement: all tables above (groups of the hits of ``source``), ``extra`` ones and the query's own SELECT.

    ``sent``: the tables are of the words that the decoder reads of packets.
    """
    fields = [SENT, FIELDS.replace("FROM words)", "FROM sent)")] if sent else [FIELDS]
    parts = [ctes("events", data_format, corrupt), *fields, MARKS[data_format], HITS, DIMENSIONS, groups(source)]
    return "WITH " + ",".join(p.strip() for p in parts) + (f",\n{extra}" if extra else "") + "\n" + select


def greedy_wiring(passes: int = 2) -> str:
    """w{n} (station, s): the orderings of the six halves after each step, of the counts of in_time; hv numbers the halves.

    A step tries the three orderings of one half of every station, the others as they are; ties go to the first.
    """
    tables = [
        "cnt AS MATERIALIZED (SELECT vmm, ch, count(*) AS n FROM in_time GROUP BY ALL)",
        "hv AS (SELECT station, connector, half, vmm, (connector - 4) * 2 + CASE WHEN half = 'top' THEN 1 ELSE 0 END AS h FROM cabling)",
        "w0 AS (SELECT DISTINCT station, ['reverse', 'reverse', 'reverse', 'reverse', 'reverse', 'reverse'] AS s FROM cabling)",
    ]
    for k in range(6 * passes):
        h = k % 6
        tables += [
            f"t{k} AS (SELECT station, idx, list_concat(list_concat(s[1:{h}], [o]), s[{h + 2}:6]) AS s FROM w{k}, (VALUES ('linear', 0), ('reverse', 1), ('pairswap', 2)) t(o, idx))",
            f"""l{k} AS MATERIALIZED (SELECT t.station, idx, v.vmm, c.range AS ch, pad_cx, pad_cy, coalesce(n, 0) AS n FROM t{k} t JOIN hv v ON v.station = t.station CROSS JOIN range(64) c
 JOIN geometry g ON g.channel_id = (connector - 1) * 128 + CASE WHEN half = 'top' THEN 64 ELSE 0 END + CASE s[v.h + 1] WHEN 'linear' THEN c.range WHEN 'reverse' THEN 63 - c.range ELSE xor(c.range, 1) END LEFT JOIN cnt ON cnt.vmm = v.vmm AND cnt.ch = c.range)""",
            f"""m{k} AS MATERIALIZED (SELECT station, idx, vmm, ch, any_value(n) AS n, median(near) AS m FROM (SELECT a.station, a.idx, a.vmm, a.ch, a.n, b.n AS near, row_number() OVER (PARTITION BY a.station, a.idx, a.vmm, a.ch ORDER BY sqrt((a.pad_cx - b.pad_cx) * (a.pad_cx - b.pad_cx) + (a.pad_cy - b.pad_cy) * (a.pad_cy - b.pad_cy)), b.vmm, b.ch) AS r
 FROM l{k} a JOIN l{k} b ON a.station = b.station AND a.idx = b.idx AND NOT (a.vmm = b.vmm AND a.ch = b.ch)) x WHERE r <= 6 GROUP BY ALL)""",
            f"""r{k} AS MATERIALIZED (SELECT station, idx, CASE WHEN count(*) FILTER (ok) >= 10 THEN median(CASE WHEN ok THEN abs(n - m) / (n + m + 1) END) ELSE 'infinity'::DOUBLE END AS r
 FROM (SELECT *, max(m) OVER w > 0 AND m > 0.05 * max(m) OVER w AND sum(n) OVER w >= 500 AND count(*) OVER w >= 20 AS ok FROM m{k} WINDOW w AS (PARTITION BY station, idx)) x GROUP BY ALL)""",
            f"w{k + 1} AS MATERIALIZED (SELECT t.station, first(s ORDER BY r, t.idx) AS s FROM t{k} t JOIN r{k} r ON r.station = t.station AND r.idx = t.idx GROUP BY t.station)",
        ]
    return ",\n".join(tables)
