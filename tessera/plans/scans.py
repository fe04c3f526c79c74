"""Progressive scan scripts: generation, rules, coverage and banded symbol streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import refine, tokens
from tessera.plans import tables
from tessera.plans.registry import Registry
from tessera.sources import views
from tessera.sources.scratch import kept

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.oracle


def script(kind: str, components: int) -> list[tuple[list[int], int, int, int, int]]:
    """Scans (components, first, last, high, low) of a script by name."""
    every = list(range(components))
    bands = lambda cuts, high, low: [([c], a, b, high, low) for c in every for a, b in cuts]
    return {
        "baseline": [(every, 0, 63, 0, 0)],
        "minimal": [(every, 0, 0, 0, 0), *bands([(1, 63)], 0, 0)],
        "simple": [(every, 0, 0, 0, 0), *bands([(1, 5), (6, 63)], 0, 0)],
        "standard": [(every, 0, 0, 0, 1), *bands([(1, 5), (6, 63)], 0, 2), *bands([(1, 63)], 2, 1), (every, 0, 0, 1, 0), *bands([(1, 63)], 1, 0)],
    }[kind]


#: Scripts that break one rule each.
BROKEN = {
    "ac_before_dc": [([0], 1, 63, 0, 0), ([0], 0, 0, 0, 0)],
    "dc_twice": [([0], 0, 0, 0, 0), ([0], 0, 0, 0, 0)],
    "overlap": [([0], 0, 0, 0, 0), ([0], 1, 10, 0, 0), ([0], 8, 63, 0, 0)],
    "wrong_high": [([0], 0, 0, 0, 2), ([0], 0, 0, 1, 0)],
    "low_not_below": [([0], 0, 0, 0, 1), ([0], 0, 0, 1, 1)],
    "refine_first": [([0], 0, 0, 0, 0), ([0], 1, 63, 1, 0)],
    "band_backwards": [([0], 5, 2, 0, 0)],
    "band_too_long": [([0], 0, 64, 0, 0)],
    "ac_interleaved": [([0, 1, 2], 0, 0, 0, 0), ([0, 1], 1, 63, 0, 0)],
    "no_such_component": [([3], 0, 0, 0, 0)],
    "out_of_order": [([1, 0], 0, 0, 0, 0)],
}


def script_rows() -> list[tuple[str, int, int, int, int, int, int, int]]:
    """script, scan, place, comp, first, last, high, low: one row for each component of a scan."""
    named = {f"{k}_{n}": script(k, n) for k in ("baseline", "minimal", "simple", "standard") for n in (1, 3)} | BROKEN
    return [(name, i, p, c, *rest) for name, scans in named.items() for i, (comps, *rest) in enumerate(scans) for p, c in enumerate(comps)]


_SCANS = ("scans", "script string, scan int, place int, comp int, ss int, se int, ah int, al int", "script, scan, place, comp, ss, se, ah, al", script_rows())
_R.rows("q_scan_scripts", "SELECT script, count(DISTINCT scan) AS scans, CAST(sum(greatest(0, se - ss + 1)) AS BIGINT) AS covered, max(al) AS highest_low, count(DISTINCT scan) > 1 OR max(ss) > 0 OR max(se) < 63 OR max(ah) > 0 OR max(al) > 0 AS progressive FROM {scans} GROUP BY script", _SCANS)
# Each rule is a filter; those on order look at the scan before that touched the same coefficient.
_RULES = """SELECT script, rule, count(*) AS violations FROM (
SELECT script, 'band' AS rule FROM {{scans}} WHERE se > 63 OR ss > se
UNION ALL SELECT script, 'component' FROM {{scans}} WHERE comp > 2 OR comp < 0
UNION ALL SELECT script, 'order' FROM (SELECT script, comp, lag(comp) OVER (PARTITION BY script, scan ORDER BY place) AS before FROM {{scans}}) AS o WHERE comp <= before
UNION ALL SELECT script, 'interleaved' FROM {{scans}} WHERE ss > 0 GROUP BY script, scan HAVING count(*) > 1
UNION ALL SELECT script, CASE WHEN ah = 0 THEN 'twice' WHEN before IS NULL THEN 'refined_first' WHEN ah <> before THEN 'high' ELSE 'low' END FROM (
  SELECT script, scan, k, ah, al, lag(al) OVER (PARTITION BY script, comp, k ORDER BY scan) AS before FROM {cells}) AS c
  WHERE (ah = 0 AND before IS NOT NULL) OR (ah > 0 AND (before IS NULL OR ah <> before OR (k = 0 AND al >= ah)))
UNION ALL SELECT script, 'ac_before_dc' FROM (
  SELECT script, scan, k, min(CASE WHEN k = 0 THEN scan END) OVER (PARTITION BY script, comp) AS dc FROM {cells}) AS d WHERE k > 0 AND (dc IS NULL OR dc > scan)
) AS v GROUP BY script, rule"""
_R.rows(
    "q_scan_validate",
    _RULES.format(cells="(SELECT script, scan, comp, ah, al, explode(sequence(ss, least(63, se))) AS k FROM {scans} WHERE ss <= se)"),
    _SCANS,
    duck=_RULES.format(cells="(SELECT script, scan, comp, ah, al, unnest(range(ss, least(63, se) + 1)) AS k FROM {scans} WHERE ss <= se)"),
)
_TEXTS = ("texts", "id int, text string", "id, text", [(0, "0 1 2;"), (1, " 0 ; "), (2, "# note"), (3, ""), (4, "1\t2;"), (5, "0 1 2 3;"), (6, ";")])
_PARSE = "SELECT id, CAST(word AS INT) AS comp FROM (SELECT id, {each} AS word FROM (SELECT id, trim(regexp_replace(regexp_replace(text, ';+ *$', ''), '\\\\s+', ' '{g})) AS line FROM {{texts}}) AS t WHERE line <> '' AND NOT line LIKE '#%') AS w"
_R.rows("q_scan_parse", _PARSE.format(each="explode(split(line, ' '))", g=""), _TEXTS, duck=_PARSE.format(each="unnest(string_split(line, ' '))", g=", 'g'").replace("\\\\s", "\\s"))

_BANDS = tables.values_sql("scans", "script, scan, place, comp, ss, se, ah, al", [r for r in script_rows() if r[0] == "standard_1"])


@_R.frame("q_scan_bands", f"{views.duck('qz')}, {_BANDS}\nSELECT scan, count(*) AS n, CAST(sum(v >> al) AS BIGINT) AS total, CAST(sum(CASE WHEN v >> al <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzero FROM qz JOIN scans ON z BETWEEN ss AND se GROUP BY scan")
def _bands(spark, sf_dir):
    """Coefficients of each scan by an equality join: scans are exploded to their positions."""
    rows = [(r[1], k, r[7]) for r in script_rows() if r[0] == "standard_1" for k in range(r[4], r[5] + 1)]
    cells = F.broadcast(tables.frame(spark, "scan int, z int, al int", rows))  # at most 64 rows for each scan
    q = views.quantised(spark, sf_dir).select(F.posexplode("z").alias("z", "v")).join(cells, "z").withColumn("v", F.expr("shiftright(v, al)"))
    return q.groupBy("scan").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.when(F.col("v") != 0, 1).otherwise(0)).alias("nonzero"))


_BAND = """bz AS (SELECT image_id, n, z, v >> 1 AS v FROM qz WHERE z BETWEEN 6 AND 63),
bnz AS (SELECT image_id, n, z, v, z - lag(z, 1, 5) OVER (PARTITION BY image_id, n ORDER BY z) - 1 AS run FROM bz WHERE v <> 0),
bend AS (SELECT image_id, n, max(CASE WHEN v <> 0 THEN z ELSE 5 END) AS last FROM bz GROUP BY ALL),
isles AS (SELECT image_id, n, last, sum(CASE WHEN last > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY n) AS isle FROM bend)"""


@_R.frame("q_ac_first_tokens", f"{views.duck('qz')}, {_BAND}\nSELECT image_id, symbol, count(*) AS n FROM (SELECT image_id, run % 16 * 16 + length(bin(abs(v))) AS symbol FROM bnz UNION ALL SELECT image_id, 240 FROM (SELECT image_id, unnest(range(run // 16)) FROM bnz)) GROUP BY ALL")
def _first(spark, sf_dir):
    b = views.quantised(spark, sf_dir).withColumn("z", F.transform("z", lambda v: F.shiftright(v, 1)))
    t = b.select("image_id", F.explode(tokens.ac_tokens(F.col("z"), 6, 63)).alias("t")).filter("t.symbol <> 0")
    return t.groupBy("image_id", F.col("t.symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@_R.frame(
    "q_eob_runs",
    f"{views.duck('qz')}, {_BAND}\nSELECT image_id, isle, CAST(run AS BIGINT) AS run, CAST(length(bin(run)) - 1 AS INT) AS nbits, CAST(run - pow(2, length(bin(run)) - 1) AS BIGINT) AS extra FROM (SELECT image_id, CAST(isle AS BIGINT) AS isle, CAST(least(32767, sum(CASE WHEN last < 63 THEN 1 ELSE 0 END)) AS BIGINT) AS run FROM isles GROUP BY ALL) WHERE run > 0",
)
def _eob(spark, sf_dir):
    """Runs of blocks that end in zeros: a block with values starts a new run, empty ones prolong it."""
    ends = F.aggregate(F.filter(F.sequence(F.lit(6), F.lit(63)), lambda i: F.shiftright(F.get("z", i), 1) != 0), F.lit(5), lambda a, i: F.greatest(a, i))
    b = views.quantised(spark, sf_dir).select("image_id", "n", ends.alias("last"))
    b = b.withColumn("isle", F.sum(F.when(F.col("last") > 5, 1).otherwise(0)).over(Window.partitionBy("image_id").orderBy("n")))
    r = b.groupBy("image_id", "isle").agg(F.least(F.lit(32767), F.sum(F.when(F.col("last") < 63, 1).otherwise(0))).cast("long").alias("run")).filter("run > 0")
    nbits = F.length(F.bin("run")) - 1
    return r.select("image_id", "isle", "run", nbits.cast("int").alias("nbits"), (F.col("run") - F.pow(F.lit(2.0), nbits).cast("long")).alias("extra"))


@_R.frame("q_dc_refine_bits", f"{views.duck('qz')}\nSELECT image_id, n, v >> 1 AS first, v & 1 AS bit, (v >> 1) - lag(v >> 1, 1, 0) OVER (PARTITION BY image_id ORDER BY n) AS d FROM qz WHERE z = 0")
def _refine(spark, sf_dir):
    b = views.quantised(spark, sf_dir).select("image_id", "n", F.get("z", F.lit(0)).alias("v"))
    first = F.shiftright("v", 1)
    return b.select("image_id", "n", first.alias("first"), F.col("v").bitwiseAND(1).alias("bit"), (first - F.lag(first, 1, 0).over(Window.partitionBy("image_id").orderBy("n"))).alias("d"))


# Refinement scans of the standard script, from bit 2 to 1 and from 1 to 0.
REFINEMENTS = ((2, 1), (1, 0))


def _refine_sql(signed: bool) -> str:
    """Tokens by windows over coefficients, one row each; DuckDB text."""
    size = "v" if signed else "abs(v)"
    new = "abs(v) >> low = 1" if signed else "(abs(v) >> low) & 1 = 1"
    # where a place sends: a new value; in the direct form every sixteenth zero as well
    rank = "sum(CASE WHEN was OR new THEN 0 ELSE 1 END) OVER (PARTITION BY high, image_id, n, gap ORDER BY z)"
    sends = f"new OR (NOT was AND {rank} % 16 = 0)" if signed else "new"
    common = f"""{views.duck('qz')}, refinement AS (SELECT * FROM (VALUES {', '.join(map(str, REFINEMENTS))}) AS t(high, low)),
cell AS MATERIALIZED (SELECT high, image_id, n, z, v, {size} >> high <> 0 AS was, {size} >> high = 0 AND {new} AS new, (abs(v) >> low) & 1 AS bit FROM qz, refinement WHERE z > 0),
gaps AS MATERIALIZED (SELECT *, coalesce(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY high, image_id, n ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM cell),
marked AS (SELECT *, {sends} AS sends FROM gaps),
groups AS MATERIALIZED (SELECT *, coalesce(sum(CASE WHEN sends THEN 1 ELSE 0 END) OVER (PARTITION BY high, image_id, n ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked),
part AS MATERIALIZED (SELECT high, image_id, n, g, max(CASE WHEN sends THEN z END) AS spot, coalesce(bool_or(new), false) AS new, max(CASE WHEN new THEN sign(v) END) AS sign, count(*) FILTER (NOT was AND NOT sends) AS run, coalesce(string_agg(CAST(bit AS VARCHAR), '' ORDER BY z) FILTER (was), '') AS bits FROM groups GROUP BY ALL),
tail AS (SELECT high, image_id, n, run > 0 AS zeros, bits AS tail FROM part WHERE spot IS NULL),
whole AS (SELECT high, image_id, n, bool_or({'sends' if signed else 'was OR new'}) AS content FROM groups GROUP BY ALL),
b AS MATERIALIZED (SELECT whole.*, coalesce(zeros, false) AS zeros, coalesce(tail, '') AS tail FROM whole LEFT JOIN tail USING (high, image_id, n)),
"""
    if signed:
        own = "own AS (SELECT high, image_id, n, g AS seq, CASE WHEN new THEN run * 16 + 1 ELSE 240 END AS symbol, CASE WHEN new THEN CASE WHEN sign < 0 THEN '0' ELSE '1' END || bits ELSE bits END AS bits FROM part WHERE spot IS NOT NULL),\n"
        closes = "NOT content AND NOT zeros"
        runs = f"""s AS (SELECT *, zeros AS takes, {closes} AS closes, content OR coalesce(lag({closes}) OVER (PARTITION BY high, image_id ORDER BY n), false) AS starts FROM b),
"""
        bits = "CASE WHEN sum(CASE WHEN takes THEN 1 ELSE 0 END) = 32767 THEN max_by(tail, CASE WHEN takes THEN n END) ELSE coalesce(max(CASE WHEN closes THEN tail END), '') END"
    else:
        own = """times AS (SELECT *, unnest(range(run // 16 + 1)) AS i FROM part WHERE spot IS NOT NULL),
own AS (SELECT high, image_id, n, row_number() OVER (PARTITION BY high, image_id, n ORDER BY spot, i) - 1 AS seq, CASE WHEN i = run // 16 THEN run % 16 * 16 + 1 ELSE 240 END AS symbol, CASE WHEN i = run // 16 THEN CASE WHEN sign < 0 THEN '0' ELSE '1' END ELSE '' END || CASE WHEN i = 0 THEN bits ELSE '' END AS bits FROM times),
"""
        runs = """t AS (SELECT *, NOT content OR zeros OR tail <> '' AS takes FROM b),
s AS (SELECT *, content OR coalesce(lag(content AND (NOT takes OR tail <> '')) OVER (PARTITION BY high, image_id ORDER BY n), false) AS starts FROM t),
"""
        bits = "max(tail)"
    return f"""{common}{own}{runs}segments AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY high, image_id ORDER BY n) AS segment FROM s),
counted AS (SELECT *, greatest(sum(CASE WHEN takes THEN 1 ELSE 0 END) OVER (PARTITION BY high, image_id, segment ORDER BY n) - 1, 0) // 32767 AS part FROM segments),
ends AS (SELECT high, image_id, max(CASE WHEN takes THEN n END) AS n, sum(CASE WHEN takes THEN 1 ELSE 0 END) AS run, {bits} AS bits FROM counted GROUP BY high, image_id, segment, part)
SELECT high, image_id, n, CAST(seq AS INTEGER) AS seq, CAST(symbol AS INTEGER) AS symbol, bits, CAST(0 AS BIGINT) AS extra, 0 AS extra_bits FROM own
UNION ALL SELECT high, image_id, n, 64, (length(bin(CAST(run AS BIGINT))) - 1) * 16, bits, CAST(run - (1 << (length(bin(CAST(run AS BIGINT))) - 1)) AS BIGINT), length(bin(CAST(run AS BIGINT))) - 1 FROM ends WHERE run > 0"""


def _refined(of):
    def query(spark, sf_dir):
        b = kept(views.quantised(spark, sf_dir).select("image_id", "n", "z"), "refined-blocks")
        scans = [of(b, high, low).select(F.lit(high).alias("high"), "image_id", "n", "seq", "symbol", "bits", "extra", "extra_bits") for high, low in REFINEMENTS]
        return scans[0].unionByName(scans[1])

    return query


_R.frame("q_refine_tokens", _refine_sql(False))(_refined(lambda b, high, low: refine.tokens_replayed(b, 1, 63, high, low)))
_R.frame("q_refine_direct", _refine_sql(True))(_refined(lambda b, high, low: refine.tokens_direct(b, 1, 63, high, low)))


#: Blocks from one restart to the next.
RESTART = 5


@_R.frame(
    "q_restart_slices",
    f"""{views.duck('qz', 'tok')}, cut AS (SELECT image_id, n, n // {RESTART} AS slice, v - lag(v, 1, 0) OVER (PARTITION BY image_id, n // {RESTART} ORDER BY n) AS d FROM qz WHERE z = 0),
sent AS (SELECT image_id, n, n // {RESTART} AS slice, symbol FROM tok WHERE is_dc = 0 UNION ALL SELECT image_id, n, slice, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END FROM cut)
SELECT image_id, slice, CAST(coalesce(sum(length) OVER (PARTITION BY image_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin, length, blocks, symbols FROM (SELECT image_id, slice, count(*) AS length, count(DISTINCT n) AS blocks, CAST(sum(symbol) AS BIGINT) AS symbols FROM sent GROUP BY ALL)""",
)
def _slices(spark, sf_dir):
    """Where the tokens of each restart interval begin, and what they sum to: intervals are coded apart."""
    b = views.quantised(spark, sf_dir).select("image_id", "n", "z").withColumn("slice", F.floor(F.col("n") / RESTART))
    return refine.sliced(tokens.tokens(b, "slice").select("image_id", "slice", "n", "symbol"))
