"""Manifest, licence scan and phrases against plain Python, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import licenses, merkle, phrases, registry
from spanloom.llm import words as words_module

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "UPPER Case", "en", "a", 3), (None, "lone", "fr", "b", 4),
    (None, "lone", "fr", "b", 4), (5, "x", "", "s", 1), (6, "Café \U0001f600 A", "é", "s", -1), (7, "alone", "zz", None, 5),
    (8, "Same Row", "en", "a", 8), (8, "Same Row", "en", "a", 8), (8, "other text", "en", "a", 8), (9, "Long words here. " * 40_000, "en", "a", 9),
    *((i, f"Text {i}", "en", "a", i) for i in range(100, 171)),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = "leaf tree lo hash root path top labels score spans n_words rank phrase lang_pred".split()
    return spark.createDataFrame(ODD, COLUMNS).withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    values = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def lowered(text):
    return text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def climb(nodes):
    """The root of a list of digests, and each one's sibling lists on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            paths[i].append((run[: place % 8], run[place % 8 + 1 :]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        own = leaf(doc, source, lang, n, text)
        tampers = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        trees[lang].append((doc, own, leaf(doc, source, lang, n, lowered(text)) if tampers else own))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rows_of in trees.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    made = {name: climb([r[1] for r in trees[name]]) for name in names}
    root, above = climb([made[name][0] for name in names])
    for name, over in zip(names, above, strict=True):
        for (doc, own, given), path in zip(trees[name], made[name][1], strict=True):
            whole = path + over
            siblings = "".join(x for before, after in whole for x in before + after)
            folded = given
            for before, after in whole:
                folded = sha(*before, folded, *after)
            yield doc, own, made[name][0], root, sha(siblings), folded


def manifest_rows(df):
    again = merkle.refolded(F.coalesce("tampered", "leaf"), F.col("path"))
    shown = df.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), again)
    return sorted(map(str, (tuple(r) for r in shown.collect())))


def test_manifest_of_odd_rows(spark, split, odd):
    assert manifest_rows(merkle.document_manifest(odd)) == sorted(str(x) for x in plain_manifest(ODD))


@pytest.mark.parametrize("size", [0, 1, 2, 8, 9, 65])
def test_manifest_of_one_tree(spark, split, size):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(size)]
    found = manifest_rows(merkle.document_manifest(spark.createDataFrame(rows, COLUMNS)))
    assert found == (sorted(str(x) for x in plain_manifest(rows)) if rows else [])


def test_manifest_of_many_trees(spark, split):
    rows = [(i, f"T{i}", f"l{i % 70}" if i % 70 else None, "s", i) for i in range(200)]
    assert manifest_rows(merkle.document_manifest(spark.createDataFrame(rows, COLUMNS))) == sorted(str(x) for x in plain_manifest(rows))


def test_manifest_tells_tampered_leaves(spark):
    rows = registry.QUERIES["op11_merkle"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and lowered(texts[r.doc_id]) != texts[r.doc_id]
        assert r.verified == (not changed)
    assert len({r.root for r in rows}) == 1 and {r.verified for r in rows} == {True, False}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words, places, labels = WORD.findall(lowered(text or "")), [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_licence_phrases_equal_a_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = registry.QUERIES["op12_licenses"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert base(r) == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score == 1.0) if r.n_base else 0 <= r.score <= 1


LICENCES = [
    "", None, "MIT LICENSE", "mit--license/mit_license cc-BY cc by", "GNU General Public License GNU general public license", "gnu general publicé license",
    "cc cc by by", "apache license" * 3, "Apache\nLicense\x7fapache\x00license", "mit licençe", "a " * 50_000 + "mit license " * 2_000, "by cc",
]


def test_licence_phrases_of_odd_texts(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(LICENCES)] + [(0, "", None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("spans", "Labels", "score", "n_words")})
    found = licenses.scan_licences(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert base(r) == plain_base(r.text)
        assert r.score == (1.0 if r.n_base else 0.0) and len(r.spans) >= r.n_base
    assert licenses.scan_licences(df.limit(0)).collect() == []


def test_matching_statistics_equal_a_plain_search():
    tool = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    lists = [licenses.plain_words(text) for _, text in (*licenses.PHRASES, *licenses.TEMPLATES)]
    runs = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    number = {w: i for i, w in enumerate(tool.names.to_pylist())}
    chance = random.Random(1)
    for _ in range(60):
        text = []
        while len(text) < 50:
            x = chance.choice(lists)
            at = chance.randrange(len(x))
            text += x[at : at + chance.randrange(1, 12)]
        for i, (state, length) in enumerate(tool.automaton.statistics([number[w] for w in text])):
            assert length == max(k for k in range(i + 2) if not k or tuple(text[i + 1 - k : i + 1]) in runs)
            here = text[i + 1 - length : i + 1]
            want = [(k, e) for k, x in enumerate(lists) for e in range(length, len(x) + 1) if x[e - length : e] == here]
            assert sorted(tool.automaton.places[state]) == want


def test_chains_cover_edited_templates(spark):
    mit, bsd = (dict((label, t) for label, t in licenses.TEMPLATES if label == x)[x] for x in ("mit", "bsd"))
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 20 != 10)
    rows = [
        (0, "start " + mit + " end", None, None, None), (1, edited, None, None, None), (2, " ".join(words[:30]), None, None, None),
        (3, mit.upper() + " and then\n" + bsd, None, None, None), (4, " ".join(reversed(words)), None, None, None),
        (5, (mit + " filler words stand here ") * 50, None, None, None), (6, " ".join(words[:45]) + " other words" * 60 + " ".join(words[45:]), None, None, None),
    ]
    found = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [found[i].labels for i in range(7)] == ["mit", "mit", "", "bsd,mit", "", "mit", ""]
    size = len(licenses.plain_words(mit))
    assert [tuple(s) for s in found[0].spans] == [("mit", 4, 1, size, 1.0)] and found[0].n_base == 0
    assert 0.75 <= found[1].score < 1 and 0.3 < found[2].score < 0.4
    assert [(s.first, s.covered) for s in found[5].spans] == [(i * (size + 4), 1.0) for i in range(50)]
    assert found[6].score < 0.75  # halves too far apart are no chain


def plain_phrases(rows, support=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        over = Counter()
        for p, a in long.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    over[part] = max(over[part], a)
        found = []
        for p, a in long.items():
            if 100 * over[p] >= 50 * a and over[p]:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


PROSE = [
    (None, None), ("", "en"), ("one two three. " * 12, "en"), ("One Two Three! one two four " * 7, None), ("a b a b a b a b\ta b a b " * 4, "und"),
    ("École école; x\x00y x\x00y, " * 15, "fr"), ("z " * 40, "fr"), ("lone", "fr"), (" \t \n", "de"), ("one two three four five six " * 30_000, "en"),
    *[("copy of a line with some words in it", "en")] * 30, ("t\x0bu\x0cv\x0dw " * 20, "e\x00"), ("one  two\t\tthree , one", "en"),
]


def test_phrases_equal_a_plain_count(spark):
    df = spark.createDataFrame(PROSE, "text string, lang string").withColumn("rank", F.lit("clash")).withColumn("phrase", F.lit("x"))
    found = sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert found == plain_phrases(PROSE)


def test_parts_of_long_texts_end_with_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words_module, "BLOCK", 50)
    texts = ["word " * 30, "some words. " * 20, None, "", "x. " + "y" * 200 + ". z"]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], names=["i", "t"])
    parts = defaultdict(list)
    for rows, cut in words_module.blocks(iter([batch]), phrases.BREAKS):
        for (i,), part in zip(rows, cut, strict=True):
            parts[i].append(part)
    for i, text in enumerate(texts):
        assert b"".join(parts[i]) == (text or "").encode()
        assert all(p[-1:] in (b".", b"") for p in parts[i][:-1])
    assert len(parts[1]) > 3 and len(parts[0]) == 1


def test_phrases_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in registry.QUERIES["op13_phrases"](spark, SF).collect()) == plain_phrases(rows)


def test_phrases_of_an_empty_table(spark, empty):
    assert phrases.collocations(empty).collect() == []


def test_scores_pass_64_bits(spark):
    a, left, right = 10**13 + 7, 10**14 + 1, 3 * 10**13
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.cut_score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def weighted_fixture():
    """400 texts: half hold one common passage, half another, and each words of its own. A pair shares 120
    rare shingles and differs in 48 common ones and 8 around them: plain 0.68, weighted over 0.8."""
    chance = random.Random(3)

    def prose(n):
        return [f"w{chance.randrange(10**9)}" for _ in range(n)]

    common = [prose(28), prose(28)]  # 24 shingles each
    rows = [(i, " ".join(common[i % 2]) + " " + " ".join(prose(80))) for i in range(2, 400)]
    rare = " ".join(prose(124))
    filler = [(0, " ".join(common[0]) + ". " + rare), (1, " ".join(common[1]) + ". " + rare)]
    return filler + rows


def test_pairs_linked_by_the_weighted_measure_only(spark):
    """Close by what is rare, apart by what is common: found by weighted samples, and by a plain
    computation of TF-IDF weights and all pairs."""
    from math import log

    from spanloom.llm import near_duplicates

    rows = weighted_fixture()
    sets = {}
    for i, text in rows:
        words = re.findall(r"\w+", text)
        sets[i] = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
    n, df = len(rows), Counter(s for c in sets.values() for s in c)

    def weights(i):
        return {s: (1 + log(tf)) * (1 + log((1 + n) / (1 + df[s]))) for s, tf in sets[i].items()}

    def weighted(a, b):
        wa, wb = weights(a), weights(b)
        common = sum(min(wa[s], wb[s]) for s in wa.keys() & wb.keys())
        return common / (sum(wa.values()) + sum(wb.values()) - common)

    plain = len(sets[0].keys() & sets[1].keys()) / len(sets[0].keys() | sets[1].keys())
    assert plain < 0.7 and weighted(0, 1) > 0.8
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a].keys() & sets[b].keys() and weighted(a, b) >= 0.8}
    assert linked == {(0, 1)}
    df_rows = spark.createDataFrame(rows, "doc_id long, text string")
    for use_plain in (False, True):
        found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df_rows, plain=use_plain).collect()}
        assert found[1] == 0 and all(found[i] == i for i, _ in rows if i != 1)


def test_without_the_plain_measure_rare_edits_part_a_pair(spark):
    """Common shingles are shared and rare ones differ: alike by the plain measure only."""
    from spanloom.llm import near_duplicates

    rows = weighted_fixture()
    common = rows[2][1].split()[:28] + rows[3][1].split()[:28]
    more = [(400 + i, " ".join(common) + f" x{i}a x{i}b x{i}c") for i in range(60)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    by_plain = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
    by_weight = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df, plain=False).collect()}
    assert {by_plain[i] for i, _ in more} == {400} and len({by_weight[i] for i, _ in more}) == 60


def test_searches_in_lots_give_the_same(spark, monkeypatch):
    """Queries dealt into many lots find what one lot finds."""
    import numpy as np

    from spanloom.llm import cross_polytope, mtree

    chance = np.random.default_rng(5)
    points = chance.normal(size=(900, 8))
    whole = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, v array<double>")
    ints = whole.withColumn("v", F.transform("v", lambda x: F.floor(x * 64).cast("long")))

    def found():
        near = cross_polytope.nearest_neighbours(whole, whole).collect()  # sums may end in other last digits
        return sorted(map(tuple, mtree.exact_top_k(ints, ints).collect())), sorted((*r[:3], round(r[3], 9)) for r in map(tuple, near))

    first = found()
    monkeypatch.setattr(mtree, "LOT", 50)
    monkeypatch.setattr(cross_polytope, "LOT", 50)
    assert found() == first
    scores = np.floor(points * 64) @ np.floor(points * 64).T
    np.fill_diagonal(scores, -np.inf)
    best = {(r[0], r[1]): r[3] for r in first[0]}
    for i in range(0, 900, 60):
        assert [best[i, rank] for rank in range(1, 11)] == sorted(scores[i], reverse=True)[:10]


def test_toxicity_scores_equal_plain_arithmetic(spark):
    """Weights, statistics, the fit and the score, from the cells of restored texts on: every label is
    taken out of its own document's cells, and the fit is where its gradient is zero."""
    import numpy as np

    from spanloom.llm import toxicity
    from spanloom.llm.deobfuscation import Restorer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn_toxicity(docs, labels)
    texts, restorer = {r.doc_id: r.text for r in docs.collect()}, Restorer(model.letters)
    known = {r.doc_id: int(r.toxic) for r in labels.collect() if r.doc_id in texts and r.toxic is not None}
    cells = {i: np.unique(c) for i, c in zip(texts, toxicity.cells([restorer.restore(t or "") for t in texts.values()]), strict=True)}
    seen, toxic = Counter(), Counter()
    for i, y in known.items():
        seen.update(cells[i].tolist())
        toxic.update(cells[i].tolist() if y else [])
    rate = sum(known.values()) / len(known)
    assert model.rate == rate and 0 < rate < 1

    def described(i, y):
        own = cells[i]
        hits = np.array([toxic[c] for c in own.tolist()], float) - (y or 0)
        rows = np.array([seen[c] for c in own.tolist()], float) - (y is not None)
        return toxicity.statistics(np.asarray(toxicity._log_odds(hits, rows, rate), float))

    stats = np.array([described(i, y) for i, y in known.items()])
    np.testing.assert_allclose(np.sort(stats.mean(axis=0)), np.sort(model.mean), rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(stats.std(axis=0) + 1e-9, model.spread, rtol=1e-5, atol=1e-6)
    terms = toxicity._terms(stats, model.mean, model.spread)
    p = 1 / (1 + np.exp(-np.clip(terms @ model.theta, -30, 30)))
    gradient = terms.T @ (p - np.array(list(known.values()))) + model.theta
    assert np.abs(gradient).max() < 1e-2
    for r in toxicity.score_toxicity(docs, model).collect():
        if len(cells[r.doc_id]):
            z = toxicity._terms(described(r.doc_id, None)[None], model.mean, model.spread) @ model.theta
            assert abs(r.score - 1 / (1 + np.exp(-z[0]))) < 1e-3 and r.predicted == (r.score >= 0.7)
