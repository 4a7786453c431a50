"""DuckDB SQL for the queries of the catalog, written independently of the Spark plans: haplotypes are tall
rows and pairs a plain inequality join."""

from __future__ import annotations

MAX_DIST = 20_000

#: embeddings: 64 phased haplotypes a site.
EMB = """
emb_cell AS (SELECT concat('e', label % 3) AS contig, vec_id * 137 + 1000 AS pos, vec_id AS seq, h, CASE WHEN embedding[h + 1] > 0 THEN 1 ELSE 0 END AS al
  FROM embeddings, range(64) r(h)),
emb_sample AS (SELECT contig, pos, seq, h // 2 AS s, sum(al) AS k FROM emb_cell GROUP BY ALL),
emb_site AS (SELECT contig, pos, seq, sum(k) AS n1, 64 - sum(k) AS n0, count(*) FILTER (WHERE k = 1) AS n_het FROM emb_sample GROUP BY ALL),
emb_kept AS (SELECT *, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS best, least(n0, n1) AS minor_count FROM emb_site
  WHERE n_het / 32.0 <= 0.88 AND n0 > 0 AND n1 > 0 AND least(n0, n1) / 64.0 >= 0.05),
emb_hap AS (SELECT c.contig, c.pos, c.seq, c.h, CASE WHEN c.al <> k.best THEN 1 ELSE 0 END AS v FROM emb_cell c JOIN emb_kept k USING (contig, pos, seq))"""

#: lineitem: 20 unphased samples a site, with missing calls.
LI = """
li_row AS (SELECT l_linestatus AS contig, l_partkey % 40 * 1500 + 1000 AS pos, l_orderkey % 20 AS s,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS al, (l_partkey * 7 + l_orderkey) % 9 = 0 AS marked,
    row_number() OVER (PARTITION BY l_linestatus, l_partkey % 40, l_orderkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth
  FROM lineitem),
li_cell AS (SELECT contig, pos, s, max(al) FILTER (WHERE nth = 1) AS a, max(al) FILTER (WHERE nth = 2) AS b, bool_or(marked) FILTER (WHERE nth = 1) AS marked
  FROM li_row WHERE nth <= 2 GROUP BY ALL),
li_call AS (SELECT p.contig, p.pos, r.s, a, b, coalesce(b IS NULL OR {marked}, true) AS miss
  FROM (SELECT DISTINCT contig, pos FROM li_row) p, range(20) r(s) LEFT JOIN li_cell c ON c.contig = p.contig AND c.pos = p.pos AND c.s = r.s),
li_stat AS (SELECT contig, pos, count(*) AS n_samples, count(*) FILTER (WHERE miss) AS n_miss, count(*) FILTER (WHERE NOT miss AND a <> b) AS n_het,
    coalesce(sum(a + b) FILTER (WHERE NOT miss), 0) AS n1, coalesce(sum(2 - a - b) FILTER (WHERE NOT miss), 0) AS n0 FROM li_call GROUP BY ALL),
li_count AS (SELECT *, (n0 > 0)::INT + (n1 > 0)::INT AS n_alleles, CASE WHEN n1 > n0 THEN 1 WHEN n0 > 0 THEN 0 END AS best,
    greatest(n0, n1) AS n_best, least(n0, n1) AS n_sed FROM li_stat),
li_kept AS (SELECT * FROM li_count WHERE n_miss / 20.0 <= 0.25 AND n_het / 20.0 <= 0.88 AND n_alleles <> 1 AND (n_alleles = 0 OR n_sed / (n_best + n_sed) >= 0.05)),
li_value AS (SELECT c.contig, c.pos, c.s, CASE WHEN miss THEN 2 WHEN a <> b THEN 0 WHEN a = best THEN 0 ELSE 1 END AS va,
    CASE WHEN miss THEN 2 WHEN a <> b THEN 1 WHEN b = best THEN 0 ELSE 1 END AS vb FROM li_call c JOIN li_kept k USING (contig, pos)),
li_hap AS (SELECT contig, pos, 2 * s AS h, va AS v FROM li_value UNION ALL SELECT contig, pos, 2 * s + 1, vb FROM li_value)"""
LIM = LI.format(marked="marked")
LI = LI.format(marked="false")


def tables(haps: str, extra: str = "", on: str = "") -> str:
    """2x2 tables of all pairs of the sites in a tall table (contig, pos, h, v)."""
    cols = f"a.contig, {extra}" if extra else "a.contig,"
    return f"""
tab AS (SELECT {cols} a.pos AS p1, b.pos AS p2, b.pos - a.pos AS dist,
    count(*) FILTER (WHERE a.v = 0 AND b.v = 0) AS n00, count(*) FILTER (WHERE a.v = 0 AND b.v = 1) AS n01,
    count(*) FILTER (WHERE a.v = 1 AND b.v = 0) AS n10, count(*) FILTER (WHERE a.v = 1 AND b.v = 1) AS n11
  FROM {haps} a JOIN {haps} b ON a.contig = b.contig AND a.h = b.h AND b.pos > a.pos AND b.pos - a.pos <= {MAX_DIST} {on}
  GROUP BY ALL)"""


SHARE = """
share AS (SELECT *, (n00 + n01 + n10 + n11)::DOUBLE AS n, n00 / n AS s0, n01 / n AS s1, n10 / n AS s2 FROM tab WHERE n11 + n10 > 0 AND n11 + n01 > 0)"""
R2 = (
    SHARE
    + """,
edge AS (SELECT *, (s0 + s1) * (s0 + s2) = 0 OR 1 - (s0 + s1) - (s0 + s2) + (s0 + s1) * (s0 + s2) = 0 AS e FROM share),
fl AS (SELECT * EXCLUDE (s0, s1, s2), CASE WHEN e THEN greatest(s0, 1e-10) ELSE s0 END AS s0, CASE WHEN e THEN greatest(s1, 1e-10) ELSE s1 END AS s1,
    CASE WHEN e THEN greatest(s2, 1e-10) ELSE s2 END AS s2 FROM edge),
val AS (SELECT *, (s0 - (s0 + s1) * (s0 + s2)) ** 2 / ((1 - (s0 + s1) - (s0 + s2) + (s0 + s1) * (s0 + s2)) * ((s0 + s1) * (s0 + s2))) AS rr FROM fl)"""
)
_TERMS = """s0 + s1 AS a1, s0 + s2 AS a2, 1 - a1 AS b1, 1 - a2 AS b2, s0 - a1 * a2 AS dd,
    CASE WHEN dd {up} 0 THEN b1 * a2 ELSE b1 * b2 END AS ca, CASE WHEN dd {up} 0 THEN a1 * b2 ELSE a1 * a2 END AS cb"""
D = (
    SHARE
    + f""",
term AS (SELECT *, {_TERMS.format(up=">")} FROM share),
fl AS (SELECT * EXCLUDE (s0, s1, s2, a1, a2, b1, b2, dd, ca, cb), CASE WHEN least(ca, cb) = 0 THEN greatest(s0, 1e-10) ELSE s0 END AS s0,
    CASE WHEN least(ca, cb) = 0 THEN greatest(s1, 1e-10) ELSE s1 END AS s1, CASE WHEN least(ca, cb) = 0 THEN greatest(s2, 1e-10) ELSE s2 END AS s2 FROM term),
val AS (SELECT *, {_TERMS.format(up=">")}, abs(dd) / least(ca, cb) AS d, (abs(dd) / ca) * (abs(dd) / cb) AS rr FROM fl)"""
)
LOD = (
    SHARE
    + f""",
fl AS (SELECT * EXCLUDE (s0, s1, s2), greatest(1 - s0 - s1 - s2, 1e-10) AS s3, greatest(s0, 1e-10) AS s0, greatest(s1, 1e-10) AS s1, greatest(s2, 1e-10) AS s2 FROM share),
val AS (SELECT *, {_TERMS.format(up=">=")}, abs(dd) / least(ca, cb) AS d, (abs(dd) / ca) * (abs(dd) / cb) AS rr,
    (n00 * ln(s0) + n01 * ln(s1) + n10 * ln(s2) + n11 * ln(s3)) / ln(10) AS one,
    one - (n00 * ln(a1 * a2) + n01 * ln(a1 * b2) + n10 * ln(b1 * a2) + n11 * ln(b1 * b2)) / ln(10) AS lod FROM fl)"""
)


def bins(keys: str = "", d: str = "CAST(NULL AS DOUBLE)") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}CAST(dist AS BIGINT) AS dist, count(*) AS n, round(avg(rr), 6) AS mean_rr, round(sum(rr), 6) AS sum_rr,
  {f'round(sum({d}) / count(*), 6)' if d == 'd' else d} AS mean_d, {f'round(sum({d}), 6)' if d == 'd' else d} AS sum_d FROM val GROUP BY {k}dist"""


def q(*parts: str) -> str:
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1]


EMB_TAB, LIM_TAB = tables("emb_hap"), tables("li_hap")
POP = "bin AS (SELECT CASE WHEN contig = 'e0' THEN 'a' ELSE 'b' END AS pop, dist, count(*) AS n, sum(rr) AS s, sum(d) AS sd FROM val GROUP BY ALL)"
SLOTS = f"""slot AS (SELECT dist, CAST(floor(rr * 100) AS INT) AS bucket, 1 AS r, 0 AS x FROM val UNION ALL SELECT dist, CAST(floor(d * 100) AS INT), 0, 1 FROM val),
hist AS (SELECT CAST(dist + 1 AS BIGINT) AS dist, bucket, bucket / 100.0 AS value, sum(r) AS n_rr, sum(x) AS n_d FROM slot WHERE dist < {MAX_DIST} GROUP BY ALL)"""
WIDTH = "dist >= 5000 AS is_long, CASE WHEN dist < 5000 THEN 500 ELSE 2000 END AS w"
LOW, HIGH = "miss > 0.12", "het > 0.5"


def quantile(count: str, share: float) -> str:
    return f"""binned AS (SELECT {WIDTH}, CAST(trunc((dist - 0.1) / w) * w AS BIGINT) AS bin_start, value, sum({count}) AS n FROM hist WHERE {count} > 0 GROUP BY ALL),
seen AS (SELECT *, sum(n) OVER (PARTITION BY is_long, bin_start ORDER BY value) AS upto, floor(sum(n) OVER (PARTITION BY is_long, bin_start) * {share}) AS cut FROM binned)
SELECT is_long, bin_start, round(min(value), 6) AS value FROM seen WHERE upto >= cut GROUP BY ALL"""


REASONS = """SELECT contig, pos, {maf} AS maf, CASE WHEN n_miss / 20.0 > 0.12 THEN 'miss' WHEN n_het / 20.0 > 0.5 THEN 'het' {rest} ELSE 'kept' END AS reason FROM li_count"""
UNPHASED = """
u_hap AS (SELECT c.contig, c.pos, c.h, CASE WHEN s.k = 1 THEN c.h % 2 WHEN c.al <> k.best THEN 1 ELSE 0 END AS v
  FROM emb_cell c JOIN emb_kept k USING (contig, pos, seq) JOIN emb_sample s ON s.contig = c.contig AND s.pos = c.pos AND s.s = c.h // 2),"""
BOTH = (
    "WITH " + EMB + "," + UNPHASED + EMB_TAB + "," + R2
    + ", x AS MATERIALIZED (SELECT contig, p1, p2, round(rr, 6) AS x FROM val), " + tables("u_hap").replace("tab AS", "tab2 AS") + ","
    + R2.replace("share", "share2").replace("edge", "edge2").replace("fl ", "fl2 ").replace("FROM fl", "FROM fl2").replace("fl22", "fl2").replace("val AS", "val2 AS").replace("FROM tab", "FROM tab2")
    + ", both_ AS MATERIALIZED (SELECT contig, p1, p2, x, round(rr, 6) AS y FROM x JOIN val2 USING (contig, p1, p2))\n"
)
REGION = """lab AS (SELECT *, CASE WHEN contig = 'e0' AND pos BETWEEN 20000 AND 30000 THEN 'e0:20000-30000' WHEN contig = 'e0' AND pos BETWEEN 1000 AND 19999 THEN 'e0:1000-40000'
    WHEN contig = 'e1' THEN 'e1' END AS label FROM {t})"""
GROUPS = """
g_sample AS (SELECT CASE WHEN h < 32 THEN 'first' ELSE 'second' END AS grp, contig, pos, h // 2 AS s, sum(al) AS k FROM emb_cell GROUP BY ALL),
g_site AS (SELECT grp, contig, pos, sum(k) AS n1, 32 - sum(k) AS n0, count(*) FILTER (WHERE k = 1) AS n_het FROM g_sample GROUP BY ALL),
g_hap AS (SELECT grp, c.contig, c.pos, c.h, CASE WHEN al <> (CASE WHEN n1 > n0 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS v FROM emb_cell c JOIN g_site g
    ON g.contig = c.contig AND g.pos = c.pos AND (g.grp = 'first') = (c.h < 32) WHERE n_het / 16.0 <= 0.88 AND n0 > 0 AND n1 > 0 AND least(n0, n1) / 32.0 >= 0.05),"""
EHH = """
win AS (SELECT * FROM emb_hap WHERE contig = 'e0' AND pos BETWEEN 25000 AND 35000),
pos_ AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM (SELECT DISTINCT pos FROM win)),
core AS (SELECT pos AS cp, k AS ck FROM pos_ WHERE k = greatest(1, (SELECT max(k) FROM pos_ WHERE pos <= 30000))),
cls AS (SELECT t.pos, w.h, string_agg(w.v::VARCHAR, '' ORDER BY abs(w.pos - cp)) AS path FROM pos_ t, core, win w
  WHERE w.pos BETWEEN least(t.pos, cp) AND greatest(t.pos, cp) GROUP BY t.pos, w.h),
size AS (SELECT pos, path, count(*) AS c FROM cls GROUP BY ALL),
step AS (SELECT pos, sum(c * (c - 1)) / (64.0 * 63) AS a, coalesce(sum(c * (c - 1)) FILTER (WHERE path[1] = '0'), 0) / (64.0 * 63) AS z FROM size GROUP BY pos),
stop AS (SELECT t.*, EXISTS (SELECT 1 FROM step o, core WHERE o.a < 0.088 AND o.pos <> cp AND ((t.pos > cp AND o.pos > cp AND o.pos < t.pos) OR (t.pos < cp AND o.pos < cp AND o.pos > t.pos))) AS cut FROM step t)
SELECT 'e0' AS contig, pos, pos - 30000 AS dist, round(CASE WHEN cut THEN 0 ELSE a END, 6) AS ehh_all, round(CASE WHEN cut THEN 0 ELSE z END, 6) AS ehh_0,
  round(CASE WHEN cut THEN 0 ELSE a - z END, 6) AS ehh_1 FROM stop"""
CI = """
flip AS (SELECT contig, p1, p2, a1, b1, one, dd < 0 AS f, CASE WHEN f THEN b2 ELSE a2 END AS a2, CASE WHEN f THEN a2_ ELSE b2 END AS b2,
    CASE WHEN f THEN n01 ELSE n00 END AS k0, CASE WHEN f THEN n00 ELSE n01 END AS k1, CASE WHEN f THEN n11 ELSE n10 END AS k2, CASE WHEN f THEN n10 ELSE n11 END AS k3
  FROM (SELECT *, a2 AS a2_ FROM val)),
surf AS (SELECT contig, p1, p2, i, one, k0, k1, k2, k3, i * 0.01::DOUBLE * least(a2 * b1, a1 * b2) + a1 * a2 AS aa, a1 - aa AS ab, a2 - aa AS ba, b1 - ba AS bb FROM flip, range(101) r(i)),
cell AS (SELECT contig, p1, p2, i, one, k0, k1, k2, k3, CASE WHEN i = 100 THEN greatest(aa, 1e-10) ELSE aa END AS aa, CASE WHEN i = 100 THEN greatest(ab, 1e-10) ELSE ab END AS ab,
    CASE WHEN i = 100 THEN greatest(ba, 1e-10) ELSE ba END AS ba, CASE WHEN i = 100 THEN greatest(bb, 1e-10) ELSE bb END AS bb FROM surf),
lik AS (SELECT contig, p1, p2, i, 10 ** ((k0 * ln(aa) + k1 * ln(ab) + k2 * ln(ba) + k3 * ln(bb)) / ln(10) - one) AS l FROM cell),
acc AS (SELECT *, sum(l) OVER (PARTITION BY contig, p1, p2 ORDER BY i) AS up, sum(l) OVER (PARTITION BY contig, p1, p2 ORDER BY i DESC) AS down,
    0.05 * sum(l) OVER (PARTITION BY contig, p1, p2) AS cut FROM lik)
SELECT contig, p1, p2, coalesce(min(i) FILTER (WHERE up > cut AND up - l < cut) - 1, 0) AS low,
  coalesce(least(max(i) FILTER (WHERE down > cut AND down - l < cut) + 1, 100), 0) AS high FROM acc GROUP BY contig, p1, p2"""
C = "0.0002 * dist"
#: The fit's rate by bisection: the gradient of the squared error by c falls through 0 at its minimum.
_X = "(c * dist)"
_E = f"((10 + {_X}) / ((2 + {_X}) * (11 + {_X}))) * (1 + ((3 + {_X}) * (12 + 12 * {_X} + {_X} ** 2)) / (64 * (2 + {_X}) * (11 + {_X})))"
HW = f"""pts AS MATERIALIZED (SELECT dist::DOUBLE AS dist, avg(rr) AS value, count(*)::DOUBLE AS weight FROM val GROUP BY dist),
it AS (SELECT 0 AS k, 1e-9::DOUBLE AS lo, 10.0::DOUBLE AS hi UNION ALL
  SELECT k + 1, CASE WHEN g > 0 THEN c ELSE lo END, CASE WHEN g > 0 THEN hi ELSE c END FROM (
    SELECT k, lo, hi, c, sum(weight * (value - {_E}) * dist * (
        (((2 + {_X}) * (11 + {_X}) - (10 + {_X}) * (13 + 2 * {_X})) / ((2 + {_X}) * (11 + {_X})) ** 2) * (1 + ((3 + {_X}) * (12 + 12 * {_X} + {_X} ** 2)) / (64 * (2 + {_X}) * (11 + {_X})))
        + ((10 + {_X}) / ((2 + {_X}) * (11 + {_X}))) * ((12 + 12 * {_X} + {_X} ** 2 + (3 + {_X}) * (12 + 2 * {_X})) * (2 + {_X}) * (11 + {_X}) - (3 + {_X}) * (12 + 12 * {_X} + {_X} ** 2) * (13 + 2 * {_X}))
          / (64 * ((2 + {_X}) * (11 + {_X})) ** 2))) AS g
    FROM (SELECT k, lo, hi, sqrt(lo * hi) AS c FROM it WHERE k < 110), pts GROUP BY k, lo, hi, c)),
rate AS (SELECT sqrt(lo * hi) AS c FROM it WHERE k = 110)"""

SQL = {
    "ld_decay_r2": q(EMB, EMB_TAB, R2, bins()),
    "ld_decay_r2_missing": q(LIM, LIM_TAB, R2, bins()),
    "ld_decay_blocks": q(LIM, LIM_TAB, R2, bins()),
    "ld_decay_d_prime": q(EMB, EMB_TAB, D, bins(d="d")),
    "ld_decay_type3": q(EMB, EMB_TAB, R2, bins(d="CAST(0 AS DOUBLE)")),
    "ld_decay_type7": q(EMB, EMB_TAB, LOD, bins()),
    "pair_table": q(LIM, LIM_TAB, "SELECT * FROM tab"),
    "pair_r2": q(EMB, EMB_TAB, R2, "SELECT contig, p1, p2, dist, round(rr, 6) AS rr FROM val"),
    "pair_dprime": q(EMB, EMB_TAB, D, "SELECT contig, p1, p2, dist, round(d, 6) AS d, round(rr, 6) AS rr FROM val"),
    "pair_lod": q(EMB, EMB_TAB, LOD, "SELECT contig, p1, p2, dist, round(d, 6) AS d, round(lod, 6) AS lod, round(rr, 6) AS rr FROM val"),
    "pair_ci": q(LIM, LIM_TAB, LOD, CI.split("\nSELECT")[0], "SELECT" + CI.split("\nSELECT")[1]),
    "hist_r2": q(LIM, LIM_TAB, R2, f"SELECT dist + 1 AS dist, CAST(floor(rr * 100) AS INT) AS bucket, count(*) AS n_rr FROM val WHERE dist < {MAX_DIST} GROUP BY ALL"),
    "hist_r2_dprime": q(LIM, LIM_TAB, D, SLOTS, "SELECT dist, bucket, CAST(n_rr AS BIGINT) AS n_rr, CAST(n_d AS BIGINT) AS n_d FROM hist"),
    "ot0_header_only": q(EMB, EMB_TAB, R2, bins() + " HAVING false"),
    "site_counts": q(LIM, """SELECT contig, pos, n_samples, n_miss, n_het, n_alleles, CAST(best AS VARCHAR) AS best,
  CASE WHEN n_alleles = 2 THEN CAST(1 - best AS VARCHAR) END AS sed, CAST(n_best AS BIGINT) AS n_best, CAST(n_sed AS BIGINT) AS n_sed,
  CASE WHEN n_alleles > 0 THEN round(n_sed / (n_best + n_sed), 6) END AS maf FROM li_count"""),
    "site_filter_reasons": q(LIM, f"r AS ({REASONS.format(maf='0', rest='''WHEN n_alleles = 1 THEN 'biallelic' WHEN n_sed / (n_best + n_sed) < 0.35 THEN 'maf' ''')})",
                             "SELECT reason, count(*) AS n FROM r GROUP BY reason"),
    "geno_maf_2n": q(LIM, REASONS.format(maf="round(n_sed / 40.0, 6)", rest="WHEN n_sed / 40.0 < 0.35 THEN 'maf' WHEN n_alleles <> 2 THEN 'biallelic'")),
    "haplotype_planes": q(LIM, "SELECT contig, pos, CAST(sum((v = 1)::INT) AS INT) AS minor_count, count(*) FILTER (WHERE v = 2) AS n_missing, bool_or(v = 2) AS has_missing FROM li_hap GROUP BY ALL"),
    "site_dedupe_keep_first": q(EMB, """SELECT contig, pos // 500 * 500 AS pos, seq, CAST(minor_count AS INT) AS minor_count FROM emb_kept
  QUALIFY row_number() OVER (PARTITION BY contig, pos // 500 ORDER BY seq) = 1"""),
    "union_merge_sites": q(EMB, """SELECT pos, CASE WHEN seq % 3 <> 0 THEN 0 ELSE 1 END AS input_rank, CAST(minor_count + CASE WHEN seq % 3 <> 0 THEN 0 ELSE 1000 END AS INT) AS minor_count
  FROM emb_kept WHERE seq % 3 <> 0 OR seq % 2 = 0"""),
    "decay_by_population": q(EMB, GROUPS + tables("g_hap", "a.grp,", "AND a.grp = b.grp"), R2, bins("grp")),
    "region_decay": q(EMB, REGION.format(t="emb_hap"), "l_hap AS (SELECT label AS contig, pos, h, v FROM lab WHERE label IS NOT NULL)", tables("l_hap"), R2,
                      "SELECT contig, count(*) AS n, round(sum(rr), 6) AS sum_rr FROM val GROUP BY contig"),
    "region_overlap_rule": q(EMB, REGION.format(t="emb_kept"), "SELECT label, pos FROM lab WHERE label IS NOT NULL"),
    "plink_encode": q(LI, """SELECT contig, pos, count(*) FILTER (WHERE va = 0 AND vb = 0) AS n00, count(*) FILTER (WHERE va = 0 AND vb = 1) AS n01,
  count(*) FILTER (WHERE va = 1 AND vb = 1) AS n11, count(*) FILTER (WHERE va = 2) AS n22 FROM li_value GROUP BY ALL"""),
    "mean_bin": q(EMB, EMB_TAB, D, POP, f"SELECT pop, is_long, bin_end, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean_rr, round(sum(sd) / sum(n), 6) AS mean_d FROM (SELECT *, {WIDTH}, CAST((dist // w + 1) * w AS BIGINT) AS bin_end FROM bin) GROUP BY pop, is_long, bin_end"),
    "median_bin": q(EMB, EMB_TAB, D, SLOTS, *quantile("n_rr", 0.5).rsplit("\n", 1)),
    "percentile_bin": q(EMB, EMB_TAB, D, SLOTS, *quantile("n_d", 0.9).rsplit("\n", 1)),
    "merged_value_table": q(EMB, EMB_TAB, D, SLOTS, """SELECT dist, round(value, 6) AS value, CAST(n_rr * CASE WHEN bucket < 50 THEN 2 ELSE 1 END AS BIGINT) AS n_rr,
  CAST(n_d * CASE WHEN bucket < 50 THEN 2 ELSE 1 END AS BIGINT) AS n_d FROM hist"""),
    "histogram_means": q(EMB, EMB_TAB, D, SLOTS, f"SELECT is_long, bin_end, CAST(sum(n_rr) AS BIGINT) AS n, round(sum(value * n_rr) / sum(n_rr), 6) AS mean_rr, round(sum(value * n_d) / sum(n_rr), 6) AS mean_d FROM (SELECT *, {WIDTH}, CAST((dist // w + 1) * w AS BIGINT) AS bin_end FROM hist) GROUP BY is_long, bin_end"),
    "axis_ranges": q(EMB, EMB_TAB, D, POP, "SELECT pop, CAST(max(dist) // 1000 AS BIGINT) AS max_kb, round(CASE WHEN max(s / n) > 0.96 THEN 1 ELSE max(s / n) END, 6) AS y_top FROM bin GROUP BY pop"),
    "coarse_curve_10kb": q(EMB, EMB_TAB, D, POP, "SELECT pop, CAST(dist // 10000 AS BIGINT) AS window, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean_rr FROM bin GROUP BY pop, dist // 10000"),
    "window_curve": q(EMB, EMB_TAB, D, POP, """SELECT pop, CAST(CASE WHEN dist <= 10 THEN 0 WHEN dist <= 50 THEN 1 WHEN dist <= 100 THEN 2 WHEN dist <= 200 THEN 3 WHEN dist <= 300 THEN 4 ELSE 5 END AS INT) AS window,
  CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean_rr FROM bin WHERE dist <= 600 GROUP BY ALL"""),
    "merged_bins": q(EMB, EMB_TAB, R2, bins()),
    "pair_compare": BOTH + """, rk AS (SELECT *, row_number() OVER (ORDER BY x, contig, p1, p2) AS rx, row_number() OVER (ORDER BY y, contig, p1, p2) AS ry FROM both_)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 6) AS mean_abs, round(max(abs(x - y)), 6) AS max_abs,
  round(avg((abs(x - y) <= 0.01)::INT), 6) AS within, count(*) FILTER (WHERE x = y) AS identical FROM rk""",
    "top_pairs": BOTH + "SELECT contig, p1, p2, round(x, 6) AS x, round(y, 6) AS y, round(abs(x - y), 6) AS diff FROM both_ ORDER BY abs(x - y) DESC, contig, p1, p2 LIMIT 10",
    "minor_count_blocks": q(EMB, EMB_TAB, R2, """rk AS (SELECT *, abs(rr - round(rr, 2)) AS far, row_number() OVER (ORDER BY least(n11 + n10, n11 + n01), contig, p1, p2) - 1 AS k, count(*) OVER () AS total FROM val)
SELECT CAST(least(k // (total // 4), 3) AS INT) AS block, count(*) AS n, round(avg(far), 6) AS mean_abs, round(max(far), 6) AS max_abs FROM rk GROUP BY ALL""".rsplit("\nSELECT", 1)[0],
                            "SELECT CAST(least(k // (total // 4), 3) AS INT) AS block, count(*) AS n, round(avg(far), 6) AS mean_abs, round(max(far), 6) AS max_abs FROM rk GROUP BY ALL"),
    "systematic_sample": q(EMB, "SELECT contig, pos FROM emb_kept WHERE (seq * 3) % 10 < 3"),
    "every_nth_site": q(EMB, "SELECT contig, pos FROM emb_kept WHERE seq % 7 = 0"),
    "ehh_decay": q(EMB, EHH.rsplit("\nSELECT", 1)[0], "SELECT" + EHH.rsplit("\nSELECT", 1)[1]),
    "hw_fixed_curve": q(EMB, EMB_TAB, R2, f"""SELECT DISTINCT dist, round(((10 + {C}) / ((2 + {C}) * (11 + {C}))) * (1 + ((3 + {C}) * (12 + 12 * {C} + ({C}) ** 2)) / (64 * (2 + {C}) * (11 + {C}))), 6) AS fitted FROM val"""),
    "hw_fit_curve": q(EMB, EMB_TAB, R2, HW, f"SELECT CAST(dist AS BIGINT) AS dist, round({_E}, 6) AS fitted FROM pts, rate").replace("WITH ", "WITH RECURSIVE ", 1),
    "run_summary": """WITH t AS (SELECT th AS threads, 10.0::DOUBLE / th + r * 0.5 AS seconds FROM (VALUES (1), (2), (4)) v(th), range(3) g(r)),
m AS (SELECT threads, avg(seconds) AS mean, stddev_samp(seconds) AS sd FROM t GROUP BY threads), o AS (SELECT mean AS one FROM m WHERE threads = 1)
SELECT threads, round(mean, 6) AS mean, round(sd, 6) AS sd, round(one / mean, 6) AS speed_up, round(100 * one / (threads * mean), 6) AS efficiency FROM m, o""",
}
