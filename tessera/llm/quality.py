"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one of the target text
(labelled good and not toxic) and one of the raw text (every document). A
document's log importance weight is the mean over its n-grams of
``log p_target - log p_raw``; the mean's denominator is raised by
``PRIOR_NGRAMS`` so that very short texts stay near the neutral 0. Two more
readings keep only n-grams that the target text avoids: the mean over the text
of ratios below ``AVOIDED``, which shows a few bad words in an otherwise plain
text, and the lowest sum of ratios below ``SHUNNED`` in any ``PASSAGE`` words,
which no length of text dilutes. Each is divided by the level that
``KEEP_GOOD`` of the labelled good documents reach, measured on the half of
the labels that the target model has not seen; the smallest is the score, so
-1 is the border of the target.

Selection is Gumbel top-k: keys ``score / temperature + Gumbel noise``, the
noise a hash of the id, and the k highest keys are kept, k being the number of
documents whose score lies inside the border.

On Spark: counts are summed per task before the shuffle, models are arrays of
``2 * BUCKETS`` numbers whatever the corpus, the k-th key is found by
histograms, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, slices, written

BUCKETS = 1 << 18
ORDERS = 2
PRIOR_NGRAMS = 20
PRIOR_COUNT = 2.0
AVOIDED = -1.5
SHUNNED = -2.0
PASSAGE = 50
KEEP_GOOD = 0.997
TEMPERATURE = 0.02
SEED = 11
#: The target model and the border are fitted on at most this many labelled rows, those with the lowest hash of their id.
MOST_LABELS = 50_000
EDGES = b".,;:!?\"'()"


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and, behind them, of the pairs of words of the
    texts, the text of each word, and the first word of each pair."""
    h32, words, lengths = xxhash.xxh32_intdigest, [], []
    for t in texts:
        own = [w.strip(EDGES) for w in t.lower().split()] if t else []
        words += own
        lengths.append(len(own))
    h = np.fromiter(map(h32, words), np.uint64, len(words))
    n = np.array(lengths, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    mixed = (h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    ids = np.concatenate([h % np.uint64(BUCKETS), np.uint64(BUCKETS) + mixed % np.uint64(BUCKETS)]).astype(np.int64)
    return ids, doc, pair


def count_models(docs: DataFrame) -> np.ndarray:
    """Rows raw and target of counts by bucket; ``docs`` has text and target (boolean or null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, ORDERS * BUCKETS), np.int64)
        for b in batches:
            texts, good = as_bytes(b.column("text")), np.array([x is True for x in b.column("target").to_pylist()])
            for i, j in slices(texts):
                ids, doc, pair = ngrams(texts[i:j])
                doc = np.concatenate([doc, doc[pair]])
                sums[0] += np.bincount(ids, minlength=ORDERS * BUCKETS)
                sums[1] += np.bincount(ids[good[i:j][doc]], minlength=ORDERS * BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    parts = docs.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    out = np.zeros((2, ORDERS * BUCKETS), np.int64)
    t = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # ORDERS * BUCKETS rows at most
    out[:, t.column("bucket").to_numpy()] = t.column("raw").to_numpy(), t.column("target").to_numpy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, each order a distribution of its own.

    PRIOR_COUNT n-grams are added to what a bucket has in the target and to what
    it would have there by the raw model, so a rare n-gram says little.
    """
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    raw, target = counts.reshape(2, ORDERS, BUCKETS).astype(float)
    share = target.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    return np.log((target + PRIOR_COUNT) / (raw * share + PRIOR_COUNT)).ravel()


def scores_of(texts: list[bytes | None], ratios: np.ndarray) -> np.ndarray:
    """Columns mean, avoided and passage of each text."""
    out = np.zeros((len(texts), 3))
    for i, j in slices(texts):
        ids, word, pair = ngrams(texts[i:j])
        r, n, doc = ratios[ids].astype(float), j - i, np.concatenate([word, word[pair]])
        size = np.bincount(doc, minlength=n) + ORDERS * PRIOR_NGRAMS
        out[i:j, 0] = np.bincount(doc, r, n) / size
        out[i:j, 1] = np.bincount(doc, np.where(r < AVOIDED, r, 0.0), n) / size
        shunned = np.where(r < SHUNNED, r, 0.0)
        shunned[pair] += shunned[len(word) :]
        upto = np.concatenate([[0.0], np.cumsum(shunned[: len(word)])])
        end = np.cumsum(np.bincount(word, minlength=n))[word]
        np.minimum.at(out[i:j, 2], word, upto[np.minimum(np.arange(len(word)) + PASSAGE, end)] - upto[:-1])
    return out


def _score_column(ratios: np.ndarray):
    ratios = ratios.astype(np.float32)

    @F.arrow_udf("struct<mean:double,avoided:double,passage:double>")
    def score(text: pa.Array) -> pa.Array:
        s = scores_of(as_bytes(text), ratios)
        return pa.StructArray.from_arrays([pa.array(c) for c in s.T.copy()], ["mean", "avoided", "passage"])

    return score


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id; a null id draws as well."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_highest(keys: DataFrame, name: str, k: int, bins: int = 1024, few: int = 50_000) -> float:
    """The k-th highest value by histograms that close in on it."""
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
    if n <= k:
        return low
    above = 0
    for _ in range(12):
        if high <= low:
            return low
        width = (high - low) / bins
        inside = keys.filter((F.col(name) >= low) & (F.col(name) <= high))
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1))
        histogram = {r["b"]: (r["n"], r["least"], r["most"]) for r in inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("least"), F.max(name).alias("most")).collect()}
        for b in sorted(histogram, reverse=True):
            n, low, high = histogram[b]
            if above + n >= k:
                break
            above += n
        if n <= few:
            rest = keys.filter((F.col(name) >= low) & (F.col(name) <= high)).orderBy(F.desc(name)).limit(k - above)
            return rest.agg(F.min(name)).first()[0]
    return low


def select_quality(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, keep_good: float = KEEP_GOOD, temperature: float = TEMPERATURE, seed: int = SEED) -> tuple[DataFrame, callable]:
    """The kept rows (doc_id, log_weight, avoided, passage, key), and a function that
    filters a table of documents by the same models and cut without a join.

    A label counts if neither quality nor toxic is null; of several for one id
    the worst counts. Without any good label all weights are 0 and every row is
    kept. Null and empty texts have score 0 and are kept. Rows that repeat an
    id share its noise; rows that tie with the last kept key are kept too.
    Other columns are kept by the function, whatever their names. An empty
    table gives no rows.
    """
    good = F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic").orderBy(F.xxhash64("label_id"), "label_id", "quality", "toxic").limit(most_labels)
    known = F.broadcast(written(known.groupBy("label_id").agg(good), "quality-labels"))  # most_labels rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("label_id"), "left")
    seen = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2)) == 0
    rows = rows.select("doc_id", "text", (F.col("target") & seen).alias("target"), (F.col("target") & ~seen).alias("held_out"))
    ratios = log_ratios(count_models(rows))
    score = _score_column(ratios)
    scored = written(rows.select("doc_id", "held_out", score("text").alias("s")).select("doc_id", "held_out", F.col("s.mean").alias("log_weight"), "s.avoided", "s.passage"), "quality-scores")
    readings = ("log_weight", "avoided", "passage")
    levels = scored.filter("held_out").agg(*[F.percentile_approx(c, 1 - keep_good, 10_000) for c in readings]).first()
    unit = [max(1e-6, -(x if x is not None else -1.0)) for x in levels]

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumn("score", F.least(*[F.col(c) / u for c, u in zip(readings, unit, strict=True)]))
        return df.withColumn("key", F.col("score") / temperature + _noise(F.col("doc_id").cast("long"), seed))

    keys = keyed(scored)
    k = keys.filter("score >= -1").count()
    cut = kth_highest(keys, "key", k) if k else float("inf")
    cut = float("-inf") if cut is None else cut

    def keep(table: DataFrame) -> DataFrame:
        s = F.struct(*[F.col(c) for c in table.columns]).alias("row")
        held = table.select(s, score("text").alias("s")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("s.mean").alias("log_weight"), "s.avoided", "s.passage")
        return keyed(held).filter(F.col("key") >= cut).select("row.*")

    return keys.filter(F.col("key") >= cut).select("doc_id", *readings, "key"), keep
