"""License scans by canonical digests.

A text is brought to a canonical form (lower case, copyright lines dropped,
signs as single spaces, equivalent spellings made one) and its SHA-256 digest
is joined with the digests of known licences in the same form. The whole text
is looked up and, as notices stand inside longer texts, so is each of its lines.

On Spark: a narrow stage over the texts and a hash join; the known digests are
broadcast if they are few, else both sides are dealt by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small, written
from tessera.llm.license_texts import KNOWN

# Spellings that count as one.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("unlicence", "unlicense"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("programme", "program"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"), ("copyright holder", "copyright owner"))
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
COPYRIGHT_START = r"^[ \t]*(copyright|\(c\)|©)"
SIGNS = r"[^\p{L}\p{N}]+"

def _plain_lines(text: Column) -> Column:
    """The lines of a text in lower case without signs; copyright lines are empty."""
    line = lambda t: F.when(t.rlike(COPYRIGHT_START), F.lit("")).otherwise(F.trim(F.regexp_replace(t, SIGNS, " ")))
    return F.transform(F.split(F.lower(text), "\n"), line)


def _one_spelling(plain: Column) -> Column:
    """One spelling of every word; words stand between blanks of their own meanwhile, so neighbours are both met."""
    t = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for spelled, meant in SPELLINGS:
        t = F.replace(t, F.lit(f" {spelled.replace(' ', '  ')} "), F.lit(f" {meant.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(lines: Column) -> Column:
    """The canonical form of a text given by its plain lines."""
    return _one_spelling(F.array_join(F.filter(lines, lambda t: t != ""), " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and text of the licences of ``license_texts``; any table of this form will do."""
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def find_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license_id, scope ('text' for a whole text, 'line') and n, the
    number of such lines: one row for each document, licence and scope met.

    A text of one line is looked up as a text only. Null texts, and texts and
    licences with an empty canonical form, match nothing. Rows that repeat an
    id, null or not, are counted together; licences of equal form are all
    reported. Other columns are ignored, and an empty table gives no rows.
    """
    digest = lambda t: F.sha2(t, 256)
    table = known.select("license_id", canonical(_plain_lines(F.col("text"))).alias("form")).filter("form <> ''").select("license_id", digest(F.col("form")).alias("digest"))
    table = small(written(table.distinct(), "licenses-known"))
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _plain_lines(F.col("text")).alias("lines"))
    unit = lambda scope, form: F.struct(F.lit(scope).alias("scope"), form.alias("form"))
    single = F.when(F.size("lines") > 1, F.transform(F.filter("lines", lambda t: t != ""), lambda t: unit("line", _one_spelling(t)))).otherwise(F.array().cast("array<struct<scope:string,form:string>>"))
    rows = rows.select("doc_id", F.explode(F.concat(F.array(unit("text", canonical(F.col("lines")))), single)).alias("u"))
    rows = rows.filter("u.form <> ''").select("doc_id", "u.scope", digest(F.col("u.form")).alias("digest"))
    return rows.join(table, "digest").groupBy("doc_id", "license_id", "scope").agg(F.count(F.lit(1)).alias("n"))


def _sql_form(text: str) -> str:
    t = f"' ' || replace(trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '\\1', 'g'), '{SIGNS}', ' ', 'g')), ' ', '  ') || ' '"
    for spelled, meant in SPELLINGS:
        t = f"replace({t}, ' {spelled.replace(' ', '  ')} ', ' {meant.replace(' ', '  ')} ')"
    return f"trim(replace({t}, '  ', ' '))"


ORACLE_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in KNOWN.items())}),
k AS (SELECT license_id, {_sql_form("text")} AS form FROM known),
u AS (SELECT doc_id, 'text' AS scope, text AS unit FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
d AS (SELECT doc_id, scope, {_sql_form("unit")} AS form FROM u)
SELECT doc_id, license_id, scope, count(*) AS n FROM d JOIN k USING (form) WHERE form <> '' GROUP BY ALL"""
