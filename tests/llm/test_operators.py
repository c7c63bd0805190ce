"""The training-data operators against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import bpe, cross_polytope, language_id, mixing, mtree, near_duplicates, registry
from spanloom.llm import sharding, token_files, toxicity, url_filters
from spanloom.llm.deobfuscation import LETTERS, Restorer, letter_codes
from tests.oracle import same

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "   ", None, "a", 3), (4, "12 !? 34", "en", None, 8),
    (5, "The quick brown fox jumps over the lazy dog. " * 3000, "en", "a", 1), (6, "same words here to see twice", "de", "b", 1),
    (7, "same words here to see twice", "de", "b", 1), (7, "same words here to see twice", "de", "b", 1), (None, "lone", "fr", "b", 4),
    (8, "x<|endoftext|>y \u00e9\u00df\U0001f600 \x1c z", "fr", "c", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["shard", "slot", "ids", "score", "topic", "host", "selected", "predicted", "lang_pred", "n_tokens"]
    df = spark.createDataFrame(ODD, COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def tokenizer(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bpe_equals_the_library(spark):
    library = tokenizer("byte_bpe_50k.json")
    docs = texts(spark)
    for r in registry.QUERIES["op1_bpe"](spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        whole = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(whole.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "  a  b", "a\n b", "x<|endoftext|>y", "it's  we'll\xa0x", "\x1c x\x85", "\u00bd \u00b2 12 \u65e5\u672c", "a\u2028b c ", "e\u0301 \U0001f642"])
def test_both_encoders_on_odd_texts(text):
    mine = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    library = tokenizer("byte_bpe_50k.json")
    texts = ["a b", text, text + " " + text, "", text]
    ids, lengths = mine.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert [x.decode() for x in mine.decode(ids, lengths)] == [library.decode(x, skip_special_tokens=False) for x in want]
    words = token_files.load(public_tokenizers.path("word_bpe_49k.json"))
    want = tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids
    ids, lengths = words.encode(["a b", text, "", text])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][1::2] == [want, want] and lengths[2] == 0


def test_decoding_any_ids(spark):
    library = tokenizer("byte_bpe_50k.json")
    rows = [(1, [50256, 464, 3290]), (2, []), (3, None), (4, [447, 447, 241])]
    df = spark.createDataFrame(rows, "doc_id int, ids array<int>")
    got = df.select("doc_id", bpe.decode(F.col("ids"), public_tokenizers.path("byte_bpe_50k.json")).alias("t")).collect()
    want = {i: None if x is None else library.decode(x, skip_special_tokens=False) for i, x in rows}
    assert {r.doc_id: r.t for r in got} == want


def test_token_files(spark):
    library, docs, at = tokenizer("word_bpe_49k.json"), texts(spark), 0
    got = {r.doc_id: r for r in registry.QUERIES["op6_token_files"](spark, SF).collect()}
    for doc_id in sorted(docs):
        ids = [*library.encode(docs[doc_id], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), crc)
        at += len(ids)


def test_token_files_of_several_ranges(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    files = token_files.write_token_files(docs, path, f"file://{tmp_path}/t", bytes_a_file=100_000)
    assert files.count() > 2
    one = {r.doc_id: r for r in token_files.read_documents(files).drop("file").collect()}
    assert one == {r.doc_id: r for r in registry.QUERIES["op6_token_files"](spark, SF).collect()}


def test_sharding(spark):
    rows = registry.QUERIES["op4_sharding"](spark, SF).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200
    assert {len(s) for s in shards.values()} == {25} and set(shards) == set(range(8))
    assert all(sorted(s) == list(range(25)) for s in shards.values())


def test_matrix_follows_the_hypergeometric_law(spark):
    sizes = spark.createDataFrame([(b, 6) for b in range(32)], "block int, n long")
    seen = Counter()
    for seed in range(5):
        rows = sharding.communication_matrix(sizes, 2, 32, seed).collect()
        assert [sum(r.sends[s] for r in rows) for s in range(2)] == [96, 96]
        assert all(sum(r.sends) == 6 and min(r.sends) >= 0 for r in rows)
        seen.update(r.sends[0] for r in rows)
    total = math.comb(192, 96)
    for k in range(7):
        want = math.comb(6, k) * math.comb(186, 96 - k) / total
        assert abs(seen[k] / 160 - want) < 0.12


def test_url_rules(spark):
    same(spark, registry.QUERIES["op9_url_filters"], registry.ORACLES["op9_url_filters"], SF)
    urls = [(1, None), (2, "no scheme"), (3, "http://NET"), (4, "x://a.NET/"), (5, "x://example.net/en/q?#"), (6, "x://xnet/"), (7, "x://b.org/fr/"), (8, "x://b.org/fr"), (9, "x://u@net:80/"), (9, "x://a.net/")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame([*url_filters.RULES, ("block", None, "/"), ("block", "", "/"), ("allow", "a.net", None)], "verdict string, host string, path string")
    got = [(r.page_id, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()]
    want = [(1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, "a.net", "allow"), (5, "example.net/en/", "allow"), (6, None, "allow"), (7, "org/fr/", "allow"), (8, None, "allow"), (9, None, "allow"), (9, "a.net", "allow")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_language(spark):
    got = registry.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(lang, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first().a
    assert right > 0.98


def test_vectors_equal_brute_force(spark):
    same(spark, registry.QUERIES["op5_mtree"], registry.ORACLES["op5_mtree"], SF)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, v array<{kind}>")


def test_mtree_with_ties_and_clusters(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (300, 5)), np.tile([7, 7, 7, 7, 7], (400, 1)), rng.integers(0, 3, (300, 5))])
    df = vectors(spark, [(i, p.tolist()) for i, p in enumerate(points)], "long")
    got = defaultdict(list)
    for r in mtree.exact_top_k(df, df.where("vec_id % 50 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 1000, 50):
        scores = points @ points[q]
        order = [i for i in np.lexsort((np.arange(1000), -scores)) if i != q][:7]
        assert got[q] == [(i, scores[i]) for i in order]


@pytest.mark.parametrize("search", [mtree.exact_top_k, cross_polytope.nearest_neighbours])
def test_few_vectors(spark, search):
    kind = "long" if search is mtree.exact_top_k else "double"
    cast = int if kind == "long" else float
    df = vectors(spark, [(i, [cast(i + 1), cast(1)]) for i in range(4)], kind)
    got = search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 2, 1]
    assert search(df.limit(0), df.limit(0), 20).count() == 0


def test_cross_polytope_recall(spark):
    got = defaultdict(set)
    for r in registry.QUERIES["op7_cross_polytope"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    points, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = points @ points[q]
        scores[q] = -9
        found += len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert found / (20 * len(got)) >= 0.9


def words(text):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_near_duplicates_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op8_near_duplicates"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets, where = {i: words(t) for i, t in docs.items()}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter((a, b) for l in where.values() for k, a in enumerate(l) for b in l[k + 1 :])
    close, far = 0, 0
    for (a, b), n in common.items():
        jaccard = n / (len(sets[a]) + len(sets[b]) - n)
        if jaccard >= 0.8:
            assert got[a] == got[b]
            close += 1
        far += jaccard < 0.5 and got[a] == got[b]
    assert close > 10 and far == 0


def test_hub_and_spokes(spark):
    """A large group whose members differ more from each other than from their middle."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        own = list(base)
        for at in rng.choice(24, 2, replace=False):
            own[at * 5] = f"x{i}{at}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"y{i}{j}" for j in range(50))) for i in range(300, 310)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = {r.doc_id: r.class_id for r in got.collect()}
    assert {classes[i] for i in range(300)} == {0} and all(classes[i] == i for i in range(300, 310))


def test_repeated_texts_are_alike(spark):
    """A text and the same text pasted several times are 0.8 alike in the plain measure only."""
    def text(name, n=60):
        return " ".join(f"{name}{j}" for j in range(n))

    rows, pairs = [], []
    for i in range(40):
        once, at = text(f"p{i}x"), len(rows)
        rows += [once, " ".join([once] * (3, 5, 10, 20)[i % 4])]
        pairs.append((at, at + 1))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert all(classes[a] == classes[b] == a for a, b in pairs)


def test_samples_agree_as_often_as_the_measures_say():
    rng, pairs = np.random.default_rng(4), 200
    weighted, plain = 0, 0
    for _ in range(pairs):
        hashes = rng.integers(0, 1 << 63, 110, np.uint64) * np.uint64(2)
        left, right = hashes[:100], hashes[10:]
        w = np.where(np.arange(110) % 2, 1.0, 3.0)
        a = near_duplicates.both_samples(left, w[:100])
        b = near_duplicates.both_samples(right, w[10:] * np.where(np.arange(100) % 2, 1.0, 2.0))
        weighted += (a == b)[: near_duplicates.SAMPLES].mean() / pairs
        plain += (a == b)[near_duplicates.SAMPLES :].mean() / pairs
    assert abs(plain - 90 / 110) < 0.02
    assert abs(weighted - 180 / 370) < 0.03


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(LETTERS), LETTERS**3)).astype(np.float32)
    restorer = Restorer(model)
    codes = letter_codes()

    def cost(text, prices):
        state, total = 0, prices
        for c in text + " ":
            code = int(codes[ord(c)])
            if code == 0 and state % LETTERS == 0:
                continue
            total -= float(model.reshape(-1)[state * LETTERS + code])
            state = (state * LETTERS + code) % LETTERS**3
        return total

    for span, spaced in (("1d10t", False), ("st00000p1d", False), ("i d 1 o t", True), ("tr4$h", False)):
        paths = [("", 0.0)]
        for slot in restorer._lattice(span, spaced):
            paths = [(t + o, p + c) for t, p in paths for o, c in slot]
        best = min(paths, key=lambda x: cost(*x))[0]
        assert restorer._viterbi(restorer._lattice(span, spaced)) == best


def test_toxicity(spark):
    got = registry.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.8 and hits / sum(r.predicted for r in rows) > 0.95


def test_disguised_words_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = "Of the thing and ered with that on the and eron thly is here onthe and."
    said = ["You 1d10t and m0r0n, st-u-p-i-d trash.", "l o s e r and s c u m and c l o w n", "Paaaathetic and worthleeeess tr4sh"]
    df = spark.createDataFrame([(0, clean), *((i + 1, f"{clean} {s} {clean}") for i, s in enumerate(said))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, model).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_raking_meets_the_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 1000))) for a in range(5) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = mixing.tempered_targets(cells)
    raked = mixing.rake(cells, targets, 1e-6)
    for dimension in mixing.DIMENSIONS:
        want = {r.level: r.share for r in targets.where(F.col("dimension") == dimension).collect()}
        got = {r[0]: r[1] for r in raked.groupBy(dimension).agg(F.sum("weight")).collect()}
        assert got == pytest.approx(want, rel=1e-4)
    chances = mixing.probabilities(raked, 0.5)
    row = chances.agg(F.sum(F.col("tokens") * F.col("probability")).alias("a"), F.sum("tokens").alias("b"), F.max("probability").alias("m")).first()
    assert row.a == pytest.approx(0.5 * row.b, rel=1e-6) and row.m <= 1


def test_odd_and_empty_tables(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (odd, empty):
        n = df.count()
        assert bpe.round_trip(df, path).count() == n
        found = bpe.round_trip(df, path).where("coalesce(text, '') <> decoded").count()
        assert found == 0
        shards = sharding.shard_uniformly(df, 3, 4)
        assert shards.count() == n and shards.select("shard", "slot").distinct().count() == n
        model = language_id.learn_prototypes(df)
        named = language_id.identify(df, model)
        assert named.count() == n
        assert all(r.lang_pred == "und" and r.score == 0 for r in named.where("doc_id in (1, 2, 3, 4)").collect())
        assert near_duplicates.near_duplicates(df).count() == n
        assert mixing.mix(df).count() == n
        labels = df.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
        for known in (labels, labels.limit(0)):
            scored = toxicity.score_toxicity(df, toxicity.learn_toxicity(df, known))
            assert scored.count() == n and scored.where("score is null or score < 0 or score > 1").count() == 0
        files = token_files.write_token_files(df, public_tokenizers.path("word_bpe_49k.json"), token_files.scratch(spark, "t"))
        assert token_files.read_documents(files).count() == n
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(odd).collect()}
    assert classes[7] == 6 and classes[1] == 1 and classes[None] is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        assert out.join(kept, "doc_id", "left_anti").count() == 0
        kept = out
    want = {r.doc_id for r in kept.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want and 0 < len(want) < docs.count()
    library, whole = tokenizer("byte_bpe_50k.json"), texts(spark)
    assert all(r.ids == library.encode(whole[r.doc_id], add_special_tokens=False).ids for r in rows)
