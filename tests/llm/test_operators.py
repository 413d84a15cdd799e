"""The training-data operators on small tables: brute force, edge rows, empty tables, clashing names."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from kilnlog.llm import chosen_path, fingerprints, line_dedup, mixing, quality, sentencepiece_scan, token_counts, tool_chat, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows():
    base = prose(1, 60)
    rows = [(1, base, "en", "a", 0), (1, base, "en", "a", 0), (2, base, None, None, 0), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, "lone text", None, "b", 0), (None, None, None, None, None), (5, prose(2, 30000), "de", "a", 0), (6, "one", "fr", "a", 0), (7, base.replace("w", "W") + " x", "en", "b", 0), (8, "a\n\nb\n \n", "en", "a", 0)]
    return rows + [(100 + i, "same line\n" + prose(i, 20), "en", "a", 0) for i in range(12)]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"_id": F.lit(1), "_text": F.lit("x"), "count": F.lit(2), "rank": F.lit(3)}) if clash else df


# 1
def test_mixing_meets_its_targets(spark):
    rows = [(i, prose(i, 50), "en", "hot" if i % 3 else f"s{i % 9}", 0) for i in range(120)]
    out = mixing.mix_sources(spark, frame(spark, rows), entropy_share=0.9, block_tokens=500).toPandas()
    share = out.groupby("source").weight.first()
    import numpy as np

    assert abs(-(share * np.log(share)).sum() / np.log(len(share)) - 0.9) < 1e-3
    got = out.groupby("source").n_tokens.sum() / out.n_tokens.sum()
    assert (abs(got - share) < 0.02).all()
    assert (out.groupby("block_id").n_tokens.sum() < 900).all()
    cover = mixing.mix_sources(spark, frame(spark, rows), max_repetition=2.0, cover=True).groupBy("doc_id").count().toPandas()
    assert len(cover) == 120 and cover["count"].min() == 1 and cover["count"].max() == 2


def test_mixing_edges(spark):
    out = mixing.mix_sources(spark, frame(spark, edge_rows()), max_repetition=3.0, cover=True)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in edge_rows()}
    assert mixing.mix_sources(spark, frame(spark, []), entropy_share=0.9).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(spark, frame(spark, []))


# 2
def test_fingerprints_against_sets(spark):
    rows = [r for r in edge_rows()]
    got = fingerprints.fingerprint_documents(frame(spark, rows), n_buckets=3).collect()
    assert len(got) == len(rows)
    ordered = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got}
    for a, b in zip(ordered, ordered[1:], strict=False):
        t, nxt = a[1] or "", b[1] or ""
        if a[0] == b[0] or b[0] is None or a[0] == ordered[-1][0]:
            continue
        k = len(t) // 3
        new = t[: len(t) - k] + nxt[:k]
        r = by_id[a[0]]
        s, e, n = (set(fingerprints.digests(x).tolist()) for x in (t, new, nxt))
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jac(s, e)) and r["near_next"] == pytest.approx(jac(s, n))
    # hot ids and rows without one take several buckets, in the order of the texts' hashes
    hot = [(5, f"t{i}", None, None, 0) for i in range(40)] + [(None, f"n{i}", None, None, 0) for i in range(40)] + [(i, f"x{i}", None, None, 0) for i in range(20)] + [(5, "t0", None, None, 0)] * 9
    df = frame(spark, hot)
    order = df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text").select("doc_id", "text").collect()
    want = {(a["doc_id"], hashlib.sha256(fingerprints.edited(a["text"], b["text"]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    for n in (1, 4, 16):
        assert {(r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint_documents(df, n_buckets=n).collect()} == want
    assert len(fingerprints.in_descending_order(df, 8).where("_order = 0").select("_bucket").distinct().collect()) >= 8
    same = [r["fingerprint"] for r in got if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(frame(spark, [(9, "abc", None, None, 0)])).first()
    assert one["near_next"] == 1.0


def test_peeling_recovers_the_difference():
    import numpy as np

    a, b = np.arange(1, 400, dtype=np.uint64), np.arange(150, 500, dtype=np.uint64)
    only_a, only_b = fingerprints.recovered(a, b)
    assert only_a == set(range(1, 150)) and only_b == set(range(400, 500))


# 3
def test_token_counts_use_the_cache(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = edge_rows() + [(50, "a <|endoftext|> b", "en", "a", 0)]
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(spark, frame(spark, rows), path, cache).select("text", "n_tokens", "n_bytes").collect()
    assert len(got) == len(rows)
    assert all(r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False)) and r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({r[1] or "" for r in rows})
    token_counts.count_tokens(spark, frame(spark, [*rows, (60, "new", "en", "a", 0)]), path, cache).count()
    assert token_counts.read_cache(spark, cache).count() == stored + 1
    assert token_counts.count_tokens(spark, frame(spark, []), path, str(tmp_path / "none")).count() == 0


def test_second_delivery_finds_stored_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, f"text {i % 7}", "en", "a", 0) for i in range(60)] + [(None, "text 3", "en", "a", 0), (None, None, None, None, 0)]
    frame(spark, rows).drop("_id", "_text", "count", "rank").write.parquet(str(tmp_path / "documents.parquet"))
    got = token_counts.op3_token_counts(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len(t.encode(x or "", add_special_tokens=False))) for i, x, *_ in rows)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    token_counts.count_tokens(spark, frame(spark, rows[:7]), path, cache).count()
    token_counts.count_tokens(spark, frame(spark, rows), path, cache).count()
    stored = [r["content"] for r in token_counts.read_cache(spark, cache).collect()]
    assert len(stored) == len(set(stored)) == 8  # the copies of the first delivery were not encoded again
    out = token_counts.count_tokens(spark, frame(spark, [(1, "  A ", "en", "a", 0), (2, "a", "en", "a", 0)]).withColumns({"n_tokens": F.lit("x"), "_digest": F.lit("y")}), path, str(tmp_path / "c2"), normalise=lambda c: F.lower(F.trim(c)))
    assert [(r["n_tokens"], r["n_bytes"], r["_digest"]) for r in out.orderBy("doc_id").collect()] == [(1, 4, "y"), (1, 1, "y")] and token_counts.read_cache(spark, str(tmp_path / "c2")).count() == 1


# 4
def test_top_k_is_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(900)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] * 4), (None, [0.5] * 8), (903, [0.1] * 5), (904, []), (5, [0.25] * 8), (1000, [0.0] * 8), (1001, [0.0] * 8)]
    rows += [(7, [r.uniform(-1, 1) for _ in range(8)]) for _ in range(450)]  # one id of a third of the rows
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.top_k(spark, df, df.where("_id % 100 = 0"), 10, candidate_block=100, query_block=4).collect()
    import math

    v = {(i, tuple(math.floor(x * 1024) for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    for qi, q in sorted(v):
        if qi % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), i) for i, c in v if i != qi and len(c) == len(q)))[:10]
            assert [(-s, i) for s, i in best] == [(g["score"], g["vec_id"]) for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == qi]
    empty = df.where("false")
    assert topk.top_k(spark, empty, empty, 10).count() == 0


def test_top_k_of_repeated_rows_and_huge_values(spark):
    r = random.Random(5)
    big = lambda: [r.randrange(-(2**31), 2**31) for _ in range(4)]
    rows = [(i, big()) for i in range(60)] + [(70, [2**31] * 4), (71, [2**31 - 1, 2**31, 2**31, 2**31]), (72, [2**31, 2**31, 2**31, 2**31 - 1])]
    rows += rows[10:20] * 3 + [(i, [x + 1 for x in v]) for i, v in rows[20:30]] + [(80, [2**62] * 4), (81, [-(2**62)] * 4), (0, [2**62] * 4)]
    df = spark.createDataFrame(rows, "_id long, _v array<long>")
    got = topk.top_k(spark, df, df.where("_id in (0, 70, 15)"), 7, candidate_block=9, query_block=2, pass_queries=2).collect()
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 70, 15):
        asked = {tuple(v) for i, v in rows if i == q}
        best = sorted((-clip(sum(a * b for a, b in zip(v, c, strict=True))), i) for v in asked for i, c in rows if i != q)[:7]
        assert best == [(-g["score"], g["vec_id"]) for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q], q


# 5
def kneser_ney(texts, order):
    """A plain form of the model: a function from (context codes, code) to a probability."""
    from collections import Counter, defaultdict

    counts = {order: Counter()}
    for t in texts:
        for g in quality.positions([t], order)[0].tolist():
            counts[order][g] += 1
    mask = lambda n: (1 << (quality.BITS * n)) - 1
    for n in range(order - 1, 0, -1):
        c = counts[n] = Counter()
        for g, k in counts[n + 1].items():
            low = g & mask(n)
            c[low] += k if n > 1 and low >> (quality.BITS * (n - 1)) == 0 else 1
    p = {}
    back = defaultdict(lambda: 1.0)
    for n in range(1, order + 1):
        of = Counter(min(k, 5) for k in counts[n].values())
        d = [0, 0.5, 1.0, 1.5]
        if all(of[i] for i in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            d = [0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i) for i in (1, 2, 3)]
        total, free = Counter(), Counter()
        for g, k in counts[n].items():
            total[g >> quality.BITS] += k
            free[g >> quality.BITS] += d[min(k, 3)]
        for h in total:
            back[n - 1, h] = free[h] / total[h]
        for g, k in counts[n].items():
            h = g >> quality.BITS
            p[n, g] = (k - d[min(k, 3)]) / total[h] + back[n - 1, h] * (p[n - 1, g & mask(n - 1)] if n > 1 else 1 / 4096)

    def prob(g):
        w = 1.0
        for n in range(order, 0, -1):
            s = g & mask(n)
            if (n, s) in p:
                return w * p[n, s]
            w *= back[n - 1, s >> quality.BITS]
        return w / 4096

    return prob


@pytest.mark.parametrize("shard_rows", [10**6, 400])
def test_quality_model_against_plain_form(spark, shard_rows):
    import math

    trusted = [prose(i, 40) for i in range(12)]
    model = quality.train(spark, spark.createDataFrame([(i % 2, t) for i, t in enumerate(trusted)], "_fold int, _text string"), 4).cache()
    tests = [(0, "w1 w22 zz"), (1, prose(77, 15)), (0, "Ünï 中文"), (1, "")]
    got = {r["_k"]: r for r in quality.score(spark, spark.createDataFrame([(f, t, i) for i, (f, t) in enumerate(tests)], "_fold int, _text string, _k int"), model, 4, shard_rows).collect()}
    for i, (f, t) in enumerate(tests):
        prob = kneser_ney(trusted[f::2], 4)
        grams = quality.positions([t], 4)[0].tolist()
        assert got[i]["_n"] == len(grams)
        assert got[i]["_nll"] == pytest.approx(-sum(math.log(prob(g)) for g in grams), abs=1e-6)


def test_quality_decisions_against_plain_form(spark):
    import math

    noise = lambda i: "".join(random.Random(i).choice("#$%&|{}~^ab ") for _ in range(80))
    rows = [(i, prose(i, 20 + i % 30), ("en", None, "fr")[i % 3], "a", 0) for i in range(60)] + [(100 + i, prose(i, 10), "de", "a", 0) for i in range(4)] + [(200 + i, noise(i), ("en", "de", "xx")[i % 3], "a", 0) for i in range(9)] + [(300, "", "en", "a", 0), (301, None, None, "a", 0)]
    trusted = [i for i, *_ in rows if i < 104]
    options = {"order": 3, "quantile": 0.8, "margin": 1.1, "min_trusted": 10}
    got = {r["_id"]: r for r in quality.classify(spark, frame(spark, rows), spark.createDataFrame([(i,) for i in trusted], "_id long"), **options).collect()}
    half = dict(spark.createDataFrame([(r[0],) for r in rows], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(2))).collect())
    models = {h: kneser_ney([t for i, t, *_ in rows if i in trusted and half[i] == h], 3) for h in (0, 1)}
    nll, n = {}, {}
    for i, t, *_ in rows:
        grams = quality.positions([t or ""], 3)[0].tolist()
        nll[i], n[i] = -sum(math.log(models[1 - half[i]](g)) for g in grams), len(grams)
    lang = {i: x for i, _, x, *_ in rows}
    known = {x: [i for i in trusted if lang[i] == x] for x in set(lang.values())}
    mean = lambda ids: sum(nll[i] for i in ids) / sum(n[i] for i in ids)
    means = {x: mean(ids) for x, ids in known.items() if len(ids) >= 10}
    assert set(means) == {"en", "fr", None}
    shrunk = {i: (nll[i] + quality.PRIOR * means.get(lang[i], mean(trusted))) / (n[i] + quality.PRIOR) for i in nll}

    def limit(ids):
        bins = sorted(math.floor(shrunk[i] * 1000) for i in ids)
        return (next(b for k, b in enumerate(bins, 1) if bins.count(b) + bins.index(b) >= 0.8 * len(bins)) + 1) / 1000 + math.log(1.1)

    limits = {x: limit(known[x]) for x in means}
    for i, r in got.items():
        top = limits.get(lang[i], limit(trusted))
        assert r["n_scored"] == n[i] and r["perplexity"] == pytest.approx(math.exp(shrunk[i]), rel=1e-6) and r["threshold"] == pytest.approx(math.exp(top), rel=1e-9)
        assert r["keep"] == (n[i] > 0 and shrunk[i] <= top)
    assert len(got) == len(rows) and not got[300]["keep"] and 0 < sum(r["keep"] for r in got.values()) < len(rows) - 2


def test_quality_keeps_clean_text(spark):
    rows = [(i, prose(i, 60), "en" if i % 2 else None, "a", 0) for i in range(300)] + [(1000 + i, "".join(random.Random(i).choice("#$%&|{}~^") for _ in range(200)), "en", "a", 0) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(spark, frame(spark, rows + edge_rows()[:7]), quality.trusted_ids(labels))
    kept = [r["doc_id"] for r in out.collect()]
    assert set(range(10, 300)) <= set(kept) and not any(i is not None and i >= 1000 for i in kept)
    assert out.columns == frame(spark, rows).columns
    none = quality.classify(spark, frame(spark, edge_rows()), quality.trusted_ids(labels.where("false")))
    assert all(r["keep"] == (r["n_scored"] > 0) for r in none.collect())
    assert quality.classify(spark, frame(spark, []), quality.trusted_ids(labels)).count() == 0


def test_quality_of_repeated_rows_at_any_shard_count(spark):
    rows = [(i, prose(i, 60), "en", "a", 0) for i in range(60)]
    docs = frame(spark, rows + rows[:20] * 3 + [(None, "lone text", None, "b", 0)] * 2 + [(900, None, "en", "a", 0)] * 2)
    trusted = spark.createDataFrame([(i,) for i in range(40)], "_id long")
    one, many = ([tuple(r) for r in quality.classify(spark, docs, trusted, shard_rows=n).orderBy("_id", "_text_key").collect()] for n in (quality.SHARD_ROWS, 20))
    assert len(one) == len(many) == docs.count()
    for a, b in zip(one, many, strict=True):
        assert a[:4] == b[:4] and a[4:6] == pytest.approx(b[4:6]) and a[6] == b[6]


def test_quality_null_language_has_its_own_threshold(spark):
    varied = lambda i: "".join(random.Random(i).choice("abcdefghijklmnop ") for _ in range(200))
    rows = [(i, prose(i, 60), "en", "a", 0) for i in range(60)] + [(100 + i, varied(i), None, "a", 0) for i in range(60)] + [(200 + i, prose(i, 30), "fr", "a", 0) for i in range(5)]
    trusted = spark.createDataFrame([(r[0],) for r in rows], "_id long")
    limits = lambda rows, **options: {r["_lang"]: r["threshold"] for r in quality.classify(spark, frame(spark, rows), trusted, quantile=0.5, **options).select("_lang", "threshold").distinct().collect()}
    got = limits(rows)
    assert len(got) == 3 and got[None] > got["fr"] > got["en"]
    named = limits([(*r[:2], r[2] or "xx", *r[3:]) for r in rows])
    assert got[None] == pytest.approx(named["xx"]) and got["fr"] == pytest.approx(named["fr"])


# 6
PIECES = [("<unk>", 0.0, 2)] + [(p, -s, 1) for p, s in [("▁", 2.1), ("a", 1.3), ("b", 1.7), ("ab", 2.2), ("aba", 3.3), ("▁a", 2.6), ("ba", 2.45), ("bab", 3.05)]]


def viterbi(scan, text):
    best = [(0.0, [])] + [(-1e99, [])] * len(text)
    for end in range(1, len(text) + 1):
        for start, score, i in scan._edges(text, end):
            if best[start][0] + score > best[end][0] + 1e-12:
                best[end] = (best[start][0] + score, best[start][1] + [-ord(text[start]) - 1 if i == scan.unknown else i])
    return best[-1]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 100])
def test_max_plus_scan_is_viterbi(chunk):
    scan = sentencepiece_scan.UnigramScan(PIECES)
    score = lambda ids: sum(scan.unknown_score if i < 0 else scan.scores[i] for i in ids)
    r = random.Random(chunk)
    for _ in range(60):
        text = "".join(r.choice("ab▁x") for _ in range(r.randrange(0, 25)))
        parts = sentencepiece_scan.halo_chunks(text, chunk, scan.width)
        states = scan.states([scan.matrix(t, h) for t, h in parts])
        ids = [i for (t, h), (a, b) in zip(parts, states, strict=True) for i in scan.backtrace(t, h, a, b)]
        assert score(ids) == pytest.approx(viterbi(scan, text)[0])
        assert "".join(chr(-i - 1) if i < 0 else PIECES[i][0] for i in ids) == text


def test_matrices_combine_associatively():
    import numpy as np

    scan = sentencepiece_scan.UnigramScan(PIECES)
    m = [scan.matrix(t, h) for t, h in sentencepiece_scan.halo_chunks("▁abababaxbab", 3, scan.width)]
    left, right = scan.combine(scan.combine(m[0], m[1]), m[2]), scan.combine(m[0], scan.combine(m[1], m[2]))
    fin = np.isfinite(left)
    assert (fin == np.isfinite(right)).all() and np.allclose(left[fin], right[fin])


def test_encoding_is_the_library_s(spark):
    import sentencepiece

    path = sentencepiece_scan.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = edge_rows() + [(70, " lead  two   spaces \n" * 300, "en", "a", 0), (71, "x" * 5000, "en", "a", 0), (73, "日本=12" * 300, "en", "a", 0)]
    out = sentencepiece_scan.encode_documents(spark, frame(spark, rows), path, giant_chars=500, chunk_chars=120)
    got = {(r["doc_id"], tuple(r["token_ids"])) for r in out.collect()}
    assert out.count() == len(rows) and got == {(r[0], tuple(sp.encode(r[1] or ""))) for r in rows}
    assert sentencepiece_scan.encode_documents(spark, frame(spark, []), path).count() == 0
    coded = sentencepiece_scan.encode_documents(spark, frame(spark, rows), path, finish=sentencepiece_scan.digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    assert all(r["round_trip"] for r in coded.collect())


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 60])
def test_bpe_scan_is_the_library(chunk):
    model = sentencepiece_scan.load(sentencepiece_scan.default_model())
    r = random.Random(chunk)
    bits = ["a", "b", "th", "e", "▁", " ", "  ", "   ", "é", "日本", "\n", "\t", "=", "==", "-----", "xyz", "tion", " the", "😀", "\u0301", "0", "12"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(80))) for _ in range(150)] + ["x" * 200, "=" * 90 + " " + "=" * 77, " " * 60, "ab" * 99]
    for t in texts:
        assert model.scan.encode(model.processor.normalize(t), chunk) == model.processor.encode(t), t


def test_bpe_matrices_combine_associatively():
    import numpy as np

    scan = sentencepiece_scan.load(sentencepiece_scan.default_model()).scan
    m = [scan.matrix(*p) for p in scan.chunks("▁internationalisations▁of▁the▁theatres", 9)]
    times = sentencepiece_scan.UnigramScan.combine
    assert len(m) > 3 and np.array_equal(times(times(m[0], m[1]), m[2]), times(m[0], times(m[1], m[2])))


def unigram_file(path):
    """A .model file of the unigram pieces, without normalisation."""
    import struct

    def field(number, kind, data):
        return bytes([number << 3 | kind]) + (struct.pack("<f", data) if kind == 5 else bytes([data]) if kind == 0 else bytes([len(data)]) + data)

    pieces = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, kind)) for p, s, kind in PIECES)
    path.write_bytes(pieces + field(2, 2, field(3, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1)))
    return str(path)


def test_giants_of_a_unigram_model_go_through_the_scan(spark, tmp_path):
    import sentencepiece

    path = unigram_file(tmp_path / "unigram.model")
    sp, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    rows = [(i, "".join(r.choice("ab x") for _ in range(r.randrange(400))), "en", "a", 0) for i in range(40)]
    got = {x["doc_id"]: list(x["token_ids"]) for x in sentencepiece_scan.encode_documents(spark, frame(spark, rows), path, giant_chars=100, chunk_chars=30).collect()}
    score = lambda ids: sum(sp.GetScore(i) for i in ids)
    for i, t, *_ in rows:
        assert sp.decode(got[i]) == sp.decode(sp.encode(t)) and score(got[i]) == pytest.approx(score(sp.encode(t)))


# 7
def test_tool_calls_are_linked(spark):
    call = lambda *cs: json.dumps({"content": "c", "tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c, strict=False)) for c in cs]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": {"b": 1, "a": "é"}})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("x")), (1, 2, "assistant", call(("y", "fetch", {"url": "u"}, ["x"]), ("x", "search", {"query": "q", "limit": 2}))), (1, 3, "tool", result("y")),
        (2, 0, "assistant", call(("x", "search", {"limit": 0}))), (2, 1, "tool", result("zzz")), (2, 2, "assistant", call(("x", "fetch", '{"url": "v"}'))),
        (3, 0, "assistant", call(("a", "fetch", {"url": "u"}, ["b"]), ("b", "fetch", {"url": "u"}, ["a"]))), (3, 1, "tool", result("a")), (3, 2, "tool", result("b")),
        (None, None, None, None), (4, 0, "user", "{not json"), (4, 0, "user", "{not json"), (5, 0, "assistant", call(("q", "fetch", {"url": "u"}))),
    ]
    # no canonical form: a lone surrogate, an infinity; the same in arguments; a surrogate pair has one
    rows += [(6, 0, "assistant", call(("s", "fetch", {"url": "\ud800"}))), (6, 1, "tool", '{"tool_call_id": "t", "content": 1e999}'), (6, 2, "assistant", call(("t", "fetch", '{"url": "\\udc00"}'))), (6, 3, "assistant", call(("u", "fetch", {"url": "\U0001f600"})))]
    rows.append((6, 4, "tool", result("u")))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("clash"))
    got = tool_chat.link_tool_calls(spark, df, tool_chat.TOOLS).collect()
    assert len(got) == len(rows)
    at = {(r["conv_id"], r["turn"]): r for r in got}
    assert at[1, 2]["status"] == "calls" and at[1, 2]["n_valid"] == 2
    made = json.loads(at[1, 2]["message"])["tool_calls"]
    assert [c["id"] for c in made] == ["x", "y"] and made[0]["function"]["arguments"] == '{"limit":2,"query":"q"}'
    assert (at[1, 1]["order_turn"], at[1, 1]["order_level"]) > (2, 0) and at[1, 1]["status"] == "linked"
    assert at[1, 1]["message"] == '{"content":{"a":"é","b":1},"role":"tool","tool_call_id":"x"}'
    assert at[2, 0]["status"] == "invalid" and at[2, 1]["status"] == "orphan" and at[2, 2]["status"] == "duplicate"
    assert at[3, 0]["status"] == "cycle" and at[5, 0]["status"] == "unanswered"
    assert at[None, None]["message"] == '{"content":null,"role":null}'
    assert [at[6, i]["status"] for i in range(4)] == ["plain", "plain", "invalid", "calls"]
    assert json.loads(at[6, 0]["message"])["content"] == rows[-5][3] and json.loads(at[6, 2]["message"])["tool_calls"][0]["function"]["arguments"] == "null"
    assert tool_chat.link_tool_calls(spark, df.where("false"), tool_chat.TOOLS).count() == 0


def levels_of(calls):
    """{(conv, id): (level, order)} of (conv, turn, id, after), the first of an id, by repeated passes."""
    first = {}
    for conv, turn, cid, after in sorted(calls, key=lambda c: c[:2]):
        first.setdefault((conv, cid), (turn, after))
    done = {}
    while True:
        ready = {k: v for k, v in first.items() if k not in done and all((k[0], d) in done or (k[0], d) not in first for d in v[1])}
        if not ready:
            return {k: done.get(k, (None, turn)) for k, (turn, _) in first.items()}
        for (conv, cid), (turn, after) in ready.items():
            known = [done[conv, d] for d in after if (conv, d) in done]
            done[conv, cid] = max((x[0] + 1 for x in known), default=0), max([turn, *(x[1] for x in known)])


@pytest.mark.parametrize("bucket", [2, 7, 1000])
def test_levels_at_any_bucket(spark, bucket):
    r, calls = random.Random(bucket), []
    for conv in range(6):
        n = r.choice([1, 5, 30])
        for turn in range(n):
            calls.append((conv, turn if conv % 2 else turn // 9, f"k{turn}", [f"k{r.randrange(n + 2)}" if r.random() < 0.1 else f"k{max(0, turn - r.randrange(1, 6))}" for _ in range(r.randrange(3))] if turn else []))
    calls += [(77, t, f"k{t}", [f"k{t - 1}"]) for t in range(1200 if bucket == 1000 else 60)]  # one long chain
    rows = [(conv, turn, "assistant", json.dumps({"tool_calls": [{"id": cid, "name": "fetch", "arguments": {"url": "u"}, "depends_on": after}]})) for conv, turn, cid, after in calls]
    parsed = spark.createDataFrame([(c, t, i, cid, after) for i, (c, t, cid, after) in enumerate(calls)], "_conv long, _turn long, _pos int, _cid string, _after array<string>").select("_conv", "_cid", "_turn", "_pos", "_after")
    got = {(x["_conv"], x["_cid"]): (x["_level"], x["_order"]) for x in tool_chat._levels(spark, parsed.where("_conv < 77") if bucket == 2 else parsed, bucket).collect()}
    want = levels_of(calls)
    assert got == {k: v for k, v in want.items() if bucket > 2 or k[0] < 77}
    if bucket == 1000:
        out = tool_chat.link_tool_calls(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_chat.TOOLS, bucket=bucket)
        assert {x["order_level"] for x in out.where("conv_id = 77").collect()} == set(range(1200))


def test_arguments_and_schemas():
    fits = tool_chat.fits
    assert fits("a", {"type": ["string", "null"]}) and fits(None, {"type": ["string", "null"]}) and not fits(1, {"type": ["string", "null"]})
    assert not fits(True, {"enum": [1]}) and fits(1.0, {"enum": [1]}) and not fits([True], {"enum": [[1]]}) and fits({"a": 1}, {"enum": [{"a": 1}]})
    assert fits(2.0, {"type": "integer"}) and not fits(True, {"type": "integer"}) and not fits(2.5, {"type": "integer"})
    assert not fits({"a": 1, "b": 2}, {"properties": {"a": {}}, "additionalProperties": {"type": "string"}})
    for bad in ({"pattern": "x"}, {"type": "text"}, {"items": {"minLength": 1}}, {"properties": {"a": {"format": "date"}}}, True):
        with pytest.raises(ValueError):
            tool_chat.check_schema(bad)


def test_chat_of_a_very_long_text(spark):
    long = "long \"text\" " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "fetch", "arguments": {"url": long}}]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": long}))]
    got = {r["turn"]: r for r in tool_chat.link_tool_calls(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_chat.TOOLS).collect()}
    assert [got[i]["status"] for i in range(3)] == ["plain", "calls", "linked"] and json.loads(got[2]["message"])["content"] == long


def test_chat_query_has_all_kinds(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    got = tool_chat.op7_tool_chat(spark, sf_dir).toPandas()
    assert {"plain", "calls", "invalid", "duplicate", "cycle", "unanswered", "linked", "orphan"} == set(got.status)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = con.execute(tool_chat.ORACLE).df()[list(got.columns)]
    by = ["conv_id", "turn"]
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in a.columns)


# 8
def links_of(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("small,tile", [(256, 512), (4, 8)])
def test_jaccard_join_loses_no_link(spark, small, tile):
    r, texts = random.Random(4), []
    for g in range(25):
        base = prose(g, 80).split()
        for _ in range(r.choice([1, 2, 3, 12])):
            new = list(base)
            for _ in range(r.randrange(0, 3)):
                new[r.randrange(80)] = "zz"
            texts.append(" ".join(new))
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(10_000 + i, t, "en", "a", 0) for i, t in enumerate(texts[:20])] + [(20_000, None, None, None, 0), (20_001, "  ", None, None, 0), (None, texts[0], None, None, 0)]
    got = chosen_path.jaccard_join(spark, frame(spark, rows), small=small, tile=tile, recall=0.9999).collect()
    assert len(got) == len(rows)
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first.setdefault(t or "", i)
    distinct = list(first)
    degree, parent = dict.fromkeys(distinct, 0), {t: t for t in distinct}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, j in links_of(distinct):
        degree[distinct[i]] += 1
        degree[distinct[j]] += 1
        parent[find(distinct[i])] = find(distinct[j])
    blank = [t for t in distinct if not t.split()]
    parent[blank[0]] = blank[1]
    least = {}
    for t in distinct:
        least[find(t)] = min(first[t], least.get(find(t), first[t]))
    text_of = {i: t or "" for i, t, *_ in rows}
    assert all((g["class_id"], g["copy_id"], g["n_links"]) == (least[find(t)], first[t], degree[t]) for g in got if (t := text_of[g["_id"]]) is not None)
    kept = chosen_path.one_of_each(spark, frame(spark, rows + rows[:5]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values())) and kept.columns == frame(spark, rows).columns
    assert chosen_path.jaccard_join(spark, frame(spark, [])).count() == 0


def test_leaders_that_are_not_alike_go_on_down(spark, monkeypatch):
    """Texts that share nearly half of their words crowd the leaves without being near copies."""
    called, respread = [], chosen_path._respread
    monkeypatch.setattr(chosen_path, "_respread", lambda *a: called.append(a) or respread(*a))
    passage = prose(9, 100)
    texts = [f"{passage} {prose(1000 + i, 50)}" for i in range(80)]
    texts += [t + " tail" for t in texts[:25]]
    got = {r["_id"]: r["n_links"] for r in chosen_path.jaccard_join(spark, frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]), small=3, max_depth=3, recall=0.9999, crowd=12).collect()}
    want = dict.fromkeys(range(len(texts)), 0)
    for i, j in links_of(texts):
        want[i] += 1
        want[j] += 1
    assert got == want and sum(want.values()) >= 50 and called


# 9
def test_url_rules_and_filter(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "ftp://a.net/es/?q", "http://a.net/de/", None, "no scheme", "http://com", "http://xexample.com/en/", "http://a.example.com/en", "http://net/fr/#t", "://com/", "http://É.net/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("_key", F.lit(1))
    listed = spark.createDataFrame([*url_filter.RULES, ("allow", "net", "/es/"), ("block", None, "/")], "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark, df, listed).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/es/", "net/es/", "block") and got[3][2:] == (None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("com", "", None, "allow") and got[7][2] == "com/" and got[8][2] == "com/" and got[9][2:] == ("net/fr/", "block") and got[10][:3] == ("com", "/", "com/") and got[11][0] == "É.net"
    assert url_filter.judge_urls(spark, df.where("false"), listed).count() == 0 and url_filter.judge_urls(spark, df, listed.where("false")).count() == 13


def test_very_long_urls(spark):
    long = "http://" + "a." * 300 + "net/fr/" + "x/" * 200_000 + "?q"
    host = "http://" + "b" * 500_000 + ".example.com/en/"
    df = spark.createDataFrame([(1, long), (2, host), (3, "http://net" + "/" * 300_000)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"]), len(r["path"])) for r in url_filter.judge_urls(spark, df, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).collect()}
    assert got == {1: ("net/fr/", "block", 603, 400_004), 2: ("example.com/en/", "block", 500_012, 4), 3: (None, "allow", 3, 300_000)}


def test_filter_has_no_false_negatives(spark):
    keys = [f"k{i}" for i in range(5000)]
    bloom = url_filter.BlockedBloom.build(spark.createDataFrame([(k,) for k in keys], "k string"), "k", len(keys))
    assert bloom.might_hold(keys).all() and bloom.might_hold([f"other{i}" for i in range(5000)]).mean() < 0.03


# 10
def dedup_plainly(rows, min_docs, keep):
    import re

    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    docs = {}
    for i, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n")):
            docs.setdefault(key(line), set()).add((i is not None, i or 0, p))
    often = {k: min(v) for k, v in docs.items() if k and len({x[:2] for x in v}) >= min_docs}
    return [(i, None if t is None and keep else "\n".join(line for p, line in enumerate((t or "").split("\n")) if key(line) not in often or (keep == "first" and often[key(line)] == (i is not None, i or 0, p)))) for i, t, *_ in rows]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup_against_plain_form(spark, keep):
    rows = edge_rows() + [(300 + i, f" Hot \nrow {i}\nÄhm\nhot\t", "en", "a", 0) for i in range(40)]
    out = line_dedup.dedup_lines(spark, frame(spark, rows), min_docs=10, keep=keep)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted(dedup_plainly(rows, 10, keep), key=repr) and out.columns == frame(spark, rows).columns
    assert line_dedup.dedup_lines(spark, frame(spark, [])).count() == 0


def test_line_dedup_tells_lines_of_one_xxhash64_apart(spark):
    pair = ["collideswith-me!", "i0+5wtjy,bq:{00%"]
    assert spark.createDataFrame([(x,) for x in pair], "x string").select(F.xxhash64("x")).distinct().count() == 1
    rows = [(i, pair[i % 2], "en", "a", 0) for i in range(10)]
    out = line_dedup.dedup_lines(spark, frame(spark, rows), min_docs=10, keep="none")
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {r[:2] for r in rows}


def test_bitmaps():
    assert line_dedup.kept_text("a\nb\nc", line_dedup._bitmap(3, [1])) == "a\nc" and line_dedup.kept_text("a", None) == "a"


NAMES = "_c0 _c1 _row _id _text _key _lang _fold _half _text_key _bad_id _bad_key _kid _k1 _k2 _t1 _t2 _node _leaf _url _host _path _of _best host path rule verdict _doc _doc2 _text2 _keep _n_dropped _digest _content _n_bytes n_bytes n_tokens content _mix_id _mix_source _block _position _source _bucket count rank position".split()


def clashing(spark, rows, schema=DOCS):
    """Rows whose further columns bear the names that the operators use themselves, each with its own value."""
    return spark.createDataFrame(rows, schema).select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def kept_own(rows, but=()):
    return all(r[n] == f"own {n}" for r in rows for n in NAMES if n not in but)


def test_callers_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    docs = clashing(spark, edge_rows() + edge_rows()[:2])
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (102, 1, 0)], "doc_id long, quality int, toxic int")
    good = quality.keep_good(spark, docs, quality.trusted_ids(labels))
    lines = line_dedup.dedup_lines(spark, docs, min_docs=10, keep="first")
    each = chosen_path.one_of_each(spark, docs)
    mixed = corpus_pipeline.mixing(spark, docs, "")
    for out in (good, lines, each, mixed):
        rows = out.collect()
        assert out.columns == docs.columns and rows and kept_own(rows)
    counted = token_counts.count_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache"))
    rows = counted.collect()
    assert counted.columns == docs.columns and len(rows) == docs.count() and kept_own(rows, ("n_bytes", "n_tokens")) and all(r["n_bytes"] == len((r["text"] or "").encode()) for r in rows)
    coded = sentencepiece_scan.encode_documents(spark, docs, sentencepiece_scan.default_model()).collect()
    assert len(coded) == len(rows) and kept_own(coded)
    pages = clashing(spark, [(1, "http://a.net/fr/x"), (2, None), (1, "http://a.net/fr/x")], "page_id long, url string")
    judged = url_filter.judge_urls(spark, pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))
    rows = judged.collect()
    assert judged.columns == pages.columns and kept_own(rows, ("host", "path", "rule", "verdict")) and sorted(r["verdict"] for r in rows) == ["allow", "block", "block"]


def test_mixing_stage_hands_on_the_order(spark):
    import corpus_pipeline

    rows = [(i, prose(i, 300), "en", "hot" if i % 3 else f"s{i % 9}", 0) for i in range(240)]
    docs = frame(spark, rows, clash=False)
    got = [r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, "").collect()]
    order = mixing.mix_sources(spark, docs, max_repetition=2.0, cover=True).orderBy("block_id", "position").collect()
    assert got == [r["doc_id"] for r in order] and len(got) > 240 and {r["block_id"] for r in order} != {0}


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "token_ids"]


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(edge_rows() + [(400 + i, prose(1000 + i, 60), "en", "a", 0) for i in range(60)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(400 + i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "sentencepiece" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"] for r in docs.collect()}
    assert set(range(400, 460)) <= ids and 2 not in ids and 1 in ids
