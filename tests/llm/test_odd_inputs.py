"""Defined results on nulls, empty and long texts, ties, repeated rows, empty tables and clashing
names; and brute force for the queries that SQL does not restate."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, cross_polytope, language_id, mixing, mtree, near_duplicates, registry
from spanloom.llm import sharding, token_files, toxicity, url_filters
from spanloom.llm.deobfuscation import Restorer

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog. " * 3000
ODD = [
    (1, None), (2, ""), (3, "12 !? 34"), (4, LONG), (5, "same words here to see twice"), (6, "same words here to see twice"),
    (6, "same words here to see twice"), (None, "same words here to see twice"), (None, "lone words of one row without name"),
    (None, "lone words of one row without name"), (None, None), (8, ""), (9, "12 !? 34"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = ["ids", "decoded", "score", "predicted", "lang_pred", "similarity", "topic", "n_tokens", "probability", "selected", "shard", "slot"]
    clash = {c: F.lit("clash") for c in extra}
    return df.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") < 4, "a"), **clash})


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, v array<{kind}>")


@pytest.mark.parametrize("search", [mtree.exact_top_k, cross_polytope.nearest_neighbours])
def test_vectors_without_and_with_repeated_ids(spark, search):
    """Null ids take no part; of rows with one id the least vector stands for all."""
    kind, cast = ("long", int) if search is mtree.exact_top_k else ("double", float)
    rows = [(1, [1, 0]), (2, [5, 1]), (2, [4, 1]), (2, [4, 1]), (3, [3, 0]), (4, [3, 0]), (None, [9, 9]), (5, None)]
    df = vectors(spark, [(i, v and [cast(x) for x in v]) for i, v in rows], kind)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(df, df.where("vec_id = 1 or vec_id is null"), 9).collect()]
    assert sorted(got) == [(1, 1, 2, 4), (1, 2, 3, 3), (1, 3, 4, 3)]
    assert search(df.limit(0), df, 3).count() == 0


def test_a_query_longer_than_the_vectors_meets_zeros(spark):
    df = vectors(spark, [(1, [1, 2]), (2, [2, 1])], "long")
    asked = vectors(spark, [(9, [1, 0, 7])], "long")
    assert [(r.vec_id, r.score) for r in mtree.exact_top_k(df, asked, 2).orderBy("rank").collect()] == [(2, 2), (1, 1)]


def test_recall_on_the_larger_table(spark):
    sf, found, asked = "/root/testdata/sf0.1", 0, 0
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    points, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in registry.QUERIES["op7_cross_polytope"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 20 == 0):
        scores = points @ points[q]
        scores[q] = -np.inf
        found += len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        asked += 20
    assert found / asked >= 0.9


def test_texts_through_bpe(odd):
    rows = bpe.round_trip(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, t or "") for i, t in ODD)
    assert all((len(r.ids) == 0) == (not r.text) for r in rows)


def test_token_files_keep_ties_together(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.write_token_files(odd, path, token_files.scratch(spark, "t"), bytes_a_file=40_000)
    rows = sorted(token_files.read_documents(files).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None] * 4 + [1, 2, 3, 4, 5, 6, 6, 8, 9] and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert {r.doc_id for r in rows if r.n_tokens == 1} == {None, 1, 2, 8} and all(r.ids_crc32 == end for r in rows if r.n_tokens == 1)


def test_equal_rows_spread_over_shards(spark):
    df = spark.createDataFrame([(1, "x")] * 4000 + [(None, None)] * 100, "doc_id long, text string").repartition(4)
    rows = sharding.shard_uniformly(df, 4, 16).collect()
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes.values()) == [1025] * 4
    assert all(900 < sum(r.shard == s and r.doc_id == 1 for r in rows) < 1025 for s in range(4))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(1025)) for s in range(4))


def test_url_rules_on_an_empty_table(spark):
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "x://a.net/"), (1, "x://a.net/"), (None, None)], "page_id long, url string")
    assert url_filters.judge_urls(none, rules).count() == 0
    got = Counter((r.page_id, r.verdict) for r in url_filters.judge_urls(some, rules).collect())
    assert got == {(1, "block"): 2, (None, "allow"): 1}


def test_near_duplicate_classes(odd):
    got = Counter((r.doc_id, r.class_id) for r in near_duplicates.near_duplicates(odd).collect())
    assert got == Counter([(1, 1), (2, 2), (8, 2), (3, 3), (9, 3), (4, 4), (5, 5), (6, 5), (6, 5), (None, 5), (None, None), (None, None), (None, None)])


def test_one_document_of_each_group_stays(spark, odd):
    kept = near_duplicates.near_duplicate_stage(spark, odd, SF)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, None), (2, ""), (3, "12 !? 34"), (4, LONG), (5, ODD[4][1]), (None, ODD[8][1]), (None, None)]
    )


def test_shingle_weights_verify_pairs(spark):
    """TF-IDF Jaccard by hand: a pair that is close only because its common shingles are rare."""
    words = [f"w{i}" for i in range(60)]
    common = "all of this text is a notice that many of the documents here end with today "
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(9))} {common}") for i in range(2, 300)]
    rows += [(0, " ".join(words)), (1, " ".join([*words[:58], "other", "ending"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
    assert got[0] == got[1] == 0 and len(set(got.values())) == 299
    counts = near_duplicates.document_frequencies(df)
    idf = near_duplicates.rarity(counts, 300)
    a, b = (list(near_duplicates.shingles([t]))[0] for t in (rows[298][1], rows[299][1]))
    weights = [dict(zip(h.tolist(), near_duplicates.weigh(h, c, idf).tolist())) for h, c in (a, b)]
    shared = set(weights[0]) & set(weights[1])
    low = sum(min(weights[0][h], weights[1][h]) for h in shared)
    high = sum(weights[0].values()) + sum(weights[1].values()) - low
    assert near_duplicates.similarity(a, b, idf) == pytest.approx(max(low / high, len(shared) / (len(a[0]) + len(b[0]) - len(shared))))
    rare, often = idf[(a[0] >> np.uint64(44)).astype(int)].min(), idf.min()
    assert rare > 1 + math.log(300 / 3) and often < 1 + math.log(301 / 280)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_and_empty_tables(spark, odd, stage):
    kept = stage(spark, odd, SF)
    assert kept.columns == odd.columns and stage(spark, odd.limit(0), SF).count() == 0
    rows = kept.collect()
    assert all(r.score == r.predicted == r.topic == r.selected == "clash" for r in rows)
    assert not Counter((r.doc_id, r.text) for r in rows) - Counter(ODD)


def test_last_stage_on_odd_and_empty_tables(spark, odd):
    stage = corpus_pipeline.STAGES[-1][1]
    assert Counter((r.doc_id, r.n_tokens == 0) for r in stage(spark, odd, SF).collect()) == Counter((i, not t) for i, t in ODD)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_language_equals_plain_loops(spark):
    """Binding, bundling and cosines trigram by trigram, for every document of the query."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    dims, letters, codes = 512, language_id._letters(512, 3).astype(int), language_id._codes()
    bound = {}

    def vector(a, b, c):
        if (a, b, c) not in bound:
            bound[a, b, c] = np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return bound[a, b, c]

    def bundle(text):
        found = [int(codes[ord(c)]) for c in f" {text} "]
        out, n = np.zeros(dims), 0
        for a, b, c in zip(found, found[1:], found[2:]):
            if b:
                out += vector(a, b, c)
                n += 1
        return out, n

    texts = {r.doc_id: bundle((r.text or "")[:20_000]) for r in docs if len(r.text or "") <= 20_000}
    short = {i for i in texts}
    prototypes = {}
    learnt = language_id.learn_prototypes(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs if r.doc_id in short], "doc_id long, text string, lang string").where(language_id.train_fold()).select("text", "lang"))
    for r in docs:
        if r.doc_id in short and r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and texts[r.doc_id][1]:
            v, n = texts[r.doc_id]
            prototypes[r.lang] = prototypes.get(r.lang, 0) + v / n
    assert set(learnt) == set(prototypes)
    for name, v in prototypes.items():
        assert np.allclose(learnt[name], v, rtol=1e-4, atol=1e-3)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(i, next(d.text for d in docs if d.doc_id == i)) for i in sorted(short)[:80]], "doc_id long, text string"), learnt).collect()}
    for i, r in got.items():
        v, n = texts[i]
        if not n or not np.linalg.norm(v):
            assert r.lang_pred == "und"
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.similarity == pytest.approx(cosines[best], abs=1e-4)
        assert r.lang_pred == best or cosines[best] - cosines[r.lang_pred] < 1e-5


def test_mixing_equals_plain_fitting(spark):
    """Raked weights, calibrated probabilities and draws of op2 from its documents alone."""
    got = {r.doc_id: r for r in registry.QUERIES["op2_mixing"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._own(F.col("text"))["__u"].alias("u")).collect()}
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", "source", "lang").collect()}
    tokens = {i: len((r.text or "").split()) for i, r in rows.items()}
    assert all(abs(got[i].n_tokens - n) <= 2 for i, n in tokens.items())  # other spaces count apart
    cell = {i: (r.source or "(none)", r.lang or "(none)", got[i].topic) for i, r in rows.items()}
    sums = Counter()
    for i in rows:
        sums[cell[i]] += got[i].n_tokens
    total = sum(sums.values())
    weight = {c: n / total for c, n in sums.items()}
    goals = []
    for d in range(3):
        level = Counter()
        for c, n in sums.items():
            level[c[d]] += n
        root = {k: math.sqrt(n / total) for k, n in level.items() if n}
        goals.append({k: x / sum(root.values()) for k, x in root.items()})
    for _ in range(200):
        for d in range(3):
            level = Counter()
            for c, w in weight.items():
                level[c[d]] += w
            weight = {c: w * goals[d].get(c[d], 0) / level[c[d]] if level[c[d]] else 0.0 for c, w in weight.items()}
    scale, low, high = 0.0, 0.0, 1e12
    for _ in range(200):
        scale = (low + high) / 2
        used = sum(min(n, weight[c] * scale) for c, n in sums.items())
        low, high = (scale, high) if used < 0.7 * total else (low, scale)
    for i in rows:
        n = sums[cell[i]]
        want = min(1.0, weight[cell[i]] * scale / n) if n else 0.7
        assert got[i].probability == pytest.approx(want, abs=5e-3)
        assert got[i].selected == (u[i] < got[i].probability)


def test_disguises_have_lattices():
    """Each of these has several readings, so Viterbi is asked about it."""
    asked = []

    class Asking(Restorer):
        def _viterbi(self, slots):
            asked.append("".join(s[-1][0] for s in slots))
            return super()._viterbi(slots)

    one = Asking(np.full((27,) * 4, -3.0, np.float32))
    said = ["5+upid", "!diot", "+r4sh", "455", "i/d/i/o/t", "m  o  r  o  n", "a$$", "$+upid", "st u pi d", "@$$hole", "s,c,u,m", "s\nc\nu\nm", "s t u p id"]
    for text in said:
        one.restore(text)
        assert asked and asked[-1] == text, text
    size = len(asked)
    assert one.restore("plain words, and more of them here.") == "plain words, and more of them here." and len(asked) == size


def test_toxicity_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.learn_toxicity(odd, known)
        rows = toxicity.score_toxicity(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert {r.score for r in rows if not r.text or not any(c.isalpha() for c in r.text)} == {model.rate}
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r.text, r.score) == r.score
    assert toxicity.score_toxicity(odd.limit(0), toxicity.learn_toxicity(odd.limit(0), labels)).count() == 0
