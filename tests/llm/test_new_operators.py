"""Whitening, byte-level BPE and the filter audit against plain versions."""

import base64
import collections
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, bpe, registry, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# whitening


def plain_whitening(rows):
    """vec_id and deviation of usable rows, and eigenvalues and vectors by numpy."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in usable), default=0)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for _, v in usable], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in usable], x, n, sums, values[::-1], vectors[:, ::-1]


def check_whitening(spark, rows, components=4, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, x string")
    got = collections.defaultdict(list)
    for r in whitening.whiten(df, components, **how).collect():
        got[r["component"]].append(r)
    ids, x, n, sums, values, vectors = plain_whitening([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    rank = min(components, int((values > values.sum() * len(values) * np.finfo(float).eps).sum()))
    assert sorted(got) == list(range(1, rank + 1))
    deviations = [sum(int(d) ** 2 for d in n * row - sums) for row in x]
    for c, found in got.items():
        expected = (x - sums / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["n"]) for r in found) == sorted((i is None, i or 0, d, n) for i, d in zip(ids, deviations, strict=True))
        assert found[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in found)
        key = lambda d, w: (d, round(w, 6))
        signs = [sorted(key(r["deviation"], s * r["whitened"]) for r in found) for s in (1, -1)]
        mine = sorted(key(d, w) for d, w in zip(deviations, expected, strict=True))
        assert any(all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-5) for a, b in zip(s, mine, strict=True)) for s in signs)
    return got


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dims) * np.linspace(2, 0.2, dims)).tolist()) for i in range(n)]


def test_whitening_matches_numpy(spark):
    check_whitening(spark, vectors(1, 150, 12))
    check_whitening(spark, vectors(2, 80, 24), block=6, most_basis=18)  # several restarts of the basis


def test_whitening_of_odd_rows(spark):
    rows = vectors(3, 40, 6)
    rows += [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (42, [math.nan] * 6), (43, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (44, [0.5, 0.25]), (None, rows[3][1]), (5, rows[7][1]), (5, rows[5][1]), (46, [])]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # copies count once in the fit
    got = check_whitening(spark, rows)
    assert {r["n"] for r in got[1]} == {42}


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(4)
    plane = [(i, [float(a), float(b), float(a + b), 1.0, 0.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    assert sorted(check_whitening(spark, plane)) == [1, 2]
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [2.0, 1.0]), (3, [4.0, 1.0])], schema)).count() == 2  # beyond 2^53


def test_lanczos_restarts_on_breakdown_and_meets_repeated_values():
    for values in ([5.0] * 6 + [1.0] * 6, [3.0, 2.0] + [0.0] * 10, [0.0] * 12, [9.0, 9.0, 4.0, 4.0, 4.0, 1.0] * 2):
        q = np.linalg.qr(np.random.default_rng(1).normal(size=(12, 12)))[0]
        matrix = q @ np.diag(values) @ q.T
        found, columns, _ = whitening.lanczos(lambda w, m=matrix: m @ w, 12, 4, block=4)
        assert found == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-9)
        assert matrix @ columns == pytest.approx(columns * found, abs=1e-9)
        assert columns.T @ columns == pytest.approx(np.eye(4), abs=1e-12)


def test_deviations_are_exact_for_large_numbers():
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]], np.int64)
    got = whitening._from_mean(x, 1 << 20, [7, 9])
    assert [int(v) for v in got[0]] == [(1 << 70) - 7, -(1 << 70) - 9]


# byte-level BPE


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [(ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1)]
        rank, i = min(pairs)
        if rank == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


TEXTS = ["don't 're <|endoftext|> x  y 日本語 ½ 1234 \x00\x1c", None, "", " \n\n  ", "aaaaaaaaa" * 40_000, "é" * 7 + "퟿😀" * 5, "ab cd\n\n  ef" * 150_000, "zqxj" * 9, "one two", "one two", "   lead", "trail   ", "'LL 'll I'Ve"]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library_and_decodes(spark, library):
    rows = [(None if i == 3 else 8 if i == 9 else i, t, 1, b"x", [1]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int, decoded binary, ids array<int>")
    encoded = bpe.encode(docs, RANKS, PATTERN)
    got = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert len(got) == len(TEXTS)
    for (i, text, *_), r in zip(rows, got, strict=True):
        assert r["doc_id"] == i
        assert r["ids"] == library.encode_ordinary(text or "")
        assert bytes(r["decoded"]) == (text or "").encode()
    assert bpe.round_trip(docs, RANKS, PATTERN).collect() == got
    one = bpe.digests(bpe.round_trip(docs, RANKS, PATTERN)).filter("doc_id = 0").first()
    ids = library.encode_ordinary(TEXTS[0])
    assert (one["n_tokens"], one["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert one["decoded_sha256"] == hashlib.sha256(TEXTS[0].encode()).hexdigest()
    assert bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_decode_of_odd_ids(spark, library):
    rows = [(1, [464, 3290]), (2, None), (3, []), (4, [464, None]), (5, [464, 50256]), (6, [-1]), (7, [198])]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS, PATTERN).collect()}
    assert got[2] is None and got[4] is None and got[5] is None and got[6] is None
    assert bytes(got[1]) == library.decode_bytes([464, 3290]) and bytes(got[3]) == b"" and bytes(got[7]) == library.decode_bytes([198])


def test_narrow_pattern_splits_ascii_alike():
    narrow, whole = bpe.narrowed(PATTERN), bpe.regex.compile(PATTERN)
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("ab'stlredvm 1 2\t\n\x1c\x00.!_-"), 60))
        assert narrow.findall(text) == whole.findall(text)
    assert bpe.narrowed(r"\w+") is None and bpe.narrowed(r"\p{Lu}") is None


def test_perfect_hash_is_minimal_and_heap_merges_like_a_plain_loop():
    v = bpe.read_vocabulary(RANKS, PATTERN)
    keys = bpe.pa.array(v.tokens, bpe.pa.binary())
    slots = v.hashed.find(bpe.hash_bytes(*bpe._layout(keys), v.longest))
    assert slots.tolist() == list(range(len(v.tokens)))
    for n in (1, 2, 3, 50, 1000):
        h = bpe._mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        assert sorted(bpe.perfect_hash(h).find(h).tolist()) == list(range(n))
    encoder, rng = bpe.Encoder(v), np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"abethino \xc3\xa9"), rng.integers(1, 40)).astype(np.uint8)) for _ in range(400)]
    for _ in range(3):  # from the heap, from memory, and from the older memory
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.merge(pieces)] == [plain_merge(p, encoder.rank) for p in pieces]
        encoder.recent, encoder.older = {}, encoder.recent


# filter audit


def plain_audit(docs, labels):
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, t, _ in docs:
        t = t or ""
        w = split(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({k for k, v in f.items() if v})
    out, shapley = {}, collections.Counter()
    parts = {s or "" for *_, s in docs}
    for part, order in itertools.product(parts, itertools.permutations("ABCDE")):
        mine = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        left = mine
        for step, x in enumerate(order, 1):
            gone, left = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
            failing = [d for d in mine if x in d[1]]
            ids = [i for i, _ in gone if i is not None]
            out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i in ids), sum(i in toxic for i in ids), x)
            shapley[part, x] += len(gone)
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


LONG = " ".join(f"w{i % 240}" for i in range(300))
LONG_REPEATED = " ".join(f"w{i % 40}" for i in range(300))
DOCS = [
    (1, LONG, "s"), (2, LONG, "t"), (3, LONG_REPEATED, "s"), (4, LONG + " $5", "s"), (5, None, "s"), (6, "", None), (7, "UPPER CASE", "t"),
    (8, LONG_REPEATED + " A#B " * 50, "t"), (None, LONG, "s"), (None, "", None), (9, " \t\x0b ", ""), (3, LONG_REPEATED, "t"), (2, LONG, "t"),
    (10, "x " * 300_000, "u"), (11, "x" * 1_000_000, "u"), (12, LONG + " é 日", "u"), (0, "UPPER CASE", "u"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (4, 1, 0)]


def test_audit_matches_each_order_run_step_by_step(spark):
    docs = spark.createDataFrame([(*d, 1, "x", 2) for d in DOCS], "doc_id long, text string, source string, mask int, part string, n int")
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, source string")
    rows = audit.audit_filters(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows}
    assert len(rows) == len(got) and got == plain_audit(DOCS, LABELS)


def test_audit_of_empty_tables_and_other_filters(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs.limit(0), labels).count() == 0
    few = {"S": F.col("n_words") < 3, "L": F.length("text") > 1000}
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit_filters(docs, labels.limit(0), few).collect()}
    assert len(got) == 4 * 2 * 2
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in got.values())
    assert (got["u", "SL", 2]["kept"], got["u", "SL", 1]["removed"], got["u", "LS", 1]["removed"], got["u", "LS", 2]["redundant"]) == (0, 2, 3, 1)


def test_new_queries_are_registered():
    assert {"op11_whitening", "op12_bpe", "op13_audit"} <= set(registry.QUERIES) and "op13_audit" in registry.ORACLE_SQL


# decontamination around stock phrases


def test_stock_phrases_are_no_hits_and_windows_at_ends_are(spark, monkeypatch):
    """Texts share five-word phrases and nothing else; a true window may stand at
    the start, the end or the middle of a text, with three words changed."""
    from tessera.llm import decontaminate

    rng = np.random.default_rng(8)
    phrases = [[f"p{k}x{j}" for j in range(5)] for k in range(6)]

    def prose(n, own):
        w = [f"{own}{x}" for x in rng.integers(0, 10_000, n)]
        for p in phrases:
            at = int(rng.integers(0, len(w)))
            w[at:at] = p
        return w

    items = [(i, prose(30, f"i{i}w")) for i in range(40)]
    docs = [(i, prose(60, f"d{i}w")) for i in range(80)]
    want = set()
    for n, (i, w) in enumerate(items[:12]):
        window = list(w[n : n + 13])
        for at in rng.choice(13, 3, replace=False):
            window[at] = "changed"
        d = docs[n][1]
        at = (0, len(d), len(d) // 2)[n % 3]
        d[at:at] = window
        want.add((n, i))
    short = (900, "ten words of a short item stand here all alone".split())
    items.append(short)
    docs.append((901, ["x"] + short[1][:4] + ["y"] + short[1][5:] + ["z"]))
    want.add((901, 900))
    counted = []
    keep = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: (counted.append(x.count()) if name == "decontaminate-hits" else None, x)[1] if (x := keep(df, name)) is not None else x)
    table = lambda rows, k: spark.createDataFrame([(i, " ".join(w), 1, [0]) for i, w in rows], f"{k} long, text string, seed int, diagonals array<int>")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_overlaps(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert want <= got
    assert counted[0] <= 2 * len(got) + 5  # a few lines, though every phrase is in every text


def test_overlaps_with_repeated_ids_and_long_texts(spark):
    from tessera.llm import decontaminate

    item = [f"b{j}" for j in range(20)]
    far = [f"w{j}" for j in range(200_000)]
    docs = [(1, " ".join(far[:50_000] + item + far[50_000:])), (1, "nothing here"), (2, " ".join(item[:13])), (2, " ".join(item[7:])), (None, " ".join(item)), (3, None), (4, "")]
    table = spark.createDataFrame([(*d, 5, [1]) for d in docs], "doc_id long, text string, leak_id int, diagonals array<int>")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (None, " ".join(item)), (8, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontaminate.find_overlaps(table, bench).collect()}
    assert got == {(1, 7, 20), (2, 7, 13)}
    left = decontaminate.without_overlaps(table, bench)
    assert left.columns == table.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 4]
