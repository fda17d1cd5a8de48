"""Centroid clustering, source divergence and language identification, by brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridvigil.llm import centroids, divergence, language, queries

VECTOR = "vec_id int, embedding array<float>, `vec.id` string, cluster string"


def cluster_by_hand(rows, dims, k, rounds):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, tuple(math.floor(256 * x) for x in vector)))
    drawn = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in drawn[:k]]

    def assign():
        found = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centres))
            found.append((i, v, c, d))
        return found

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, c, _ in assign():
            members[c].append(v)
        for c, own in members.items():
            centres[c] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    last = assign()
    inertia = Counter()
    for _, _, c, d in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, _, c, d in last)
    )


def found_clusters(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in df.collect())


def vector_rows(n, dims, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.3, 0.25, rng.gauss(0, 0.2)]) for _ in range(dims)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot) for i in range(n // 2)]  # a third of all rows
    rows += [(3, rows[3][1]), (4, rows[7][1]), (None, rows[5][1]), (None, hot)]
    rows += [(900, None), (901, []), (902, hot[:-1]), (903, [None, *hot[1:]])]
    rows += [(904, [float("nan"), *hot[1:]]), (905, [float("inf"), *hot[1:]]), (906, [float("-inf"), *hot[1:]])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("part", [1 << 15, 7])
@pytest.mark.parametrize("dims", [4, 5])
def test_clusters_by_hand(spark, monkeypatch, part, dims):
    monkeypatch.setattr(centroids, "PART", part)
    rows = vector_rows(60, dims)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTOR).repartition(3)
    found = centroids.cluster(df, dims=dims, k=6, rounds=3)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found_clusters(found) == cluster_by_hand(rows, dims, 6, 3)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [-0.1, 0.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], VECTOR)
    assert found_clusters(centroids.cluster(df, dims=2)) == cluster_by_hand(rows, 2, 40, 5)
    assert centroids.cluster(df.limit(0), dims=2).collect() == []
    assert centroids.cluster(df, dims=3).collect() == []


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30], None, None)], VECTOR)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df, dims=1).collect()


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(0)
    for n, dims in ((1, 3), (500, 8), (300, 5)):
        ints = rng.integers(-2, 3, (n, dims))
        rebuilt = np.empty_like(ints)
        blocks = centroids.dictionaries(ints)
        for at, entries, codes in blocks:
            assert len(np.unique(entries, axis=0)) == len(entries)
            assert len(entries) * entries.shape[1] <= max(n, len(entries))
            rebuilt[:, at : at + entries.shape[1]] = entries[codes]
        assert (rebuilt == ints).all()
        if n == 500:
            assert len(blocks) < dims  # neighbours were joined


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_by_hand(rows, min_docs):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    in_docs = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in in_docs.items():
        if n >= min_docs:
            kept[lang].add(t)
    counts = defaultdict(Counter)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if t in kept[lang])
    whole = defaultdict(Counter)
    for (lang, _), own in counts.items():
        whole[lang].update(own)

    def p(own, lang, t):
        return 1 + 1000000000 * (own[t] + 2) // (sum(own.values()) + 2 * len(kept[lang]))

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = []
    for (lang, source), own in counts.items():
        pairs = []
        for (other_lang, other), others in counts.items():
            if other_lang == lang and other != source:
                pairs.append((-sum(f(p(own, lang, t), p(others, lang, t)) for t in kept[lang]), other.encode()))
        terms = []
        for t in own:
            a, b = p(own, lang, t), p(whole[lang], lang, t)
            if a > b:
                terms.append((-f(a, b), t.encode()))
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def term_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "ümlaut", "Ümlaut", "日本", "x", "straße", "delta", "e" * 3000, "a\x7fb", "_q_", "0n0"]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice(["hot", "hot", "s1", "s2", "s3", "s4", None, ""])
        text = " ".join(rng.choice(words) + rng.choice(["", "s", ".", str(i)]) for _ in range(rng.randint(0, 12)))
        rows.append((text, lang, source))
    rows += [rows[0]] * 20 + [(None, "en", "empty"), ("", "en", "empty"), ("1 2 3", "fr", "s1"), ("seldom", "fr", "s2"), (None, "fr", None)]
    rows.append(("long " * 40000 + "alpha", "en", "s1"))
    return rows


SMALL = {"SHARD": 3, "MAX_BYTES": 300, "BLOCK": 2, "MAX_HELD": 5, "MAX_SLOTS": 4, "MAX_WORDS": 50}


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_divergence_by_hand(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = term_rows()
    df = spark.createDataFrame([(t, lang, s, "x", 1) for t, lang, s in rows], "text string, lang string, source string, `a.b` string, n int")
    found = divergence.audit(df.repartition(3), min_docs=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == audit_by_hand(rows, 4)
    assert divergence.audit(df.limit(0)).collect() == []


def test_perfect_hash_gives_each_term_its_slot(monkeypatch):
    for n in (1, 2, 5, 4096):
        terms = [f"t{i}".encode() for i in range(n)]
        displacement, by_slot, extra = divergence.perfect_hash(terms)
        assert sorted(by_slot) == sorted(terms) and not extra
        row = {"shard": 0, "displacement": displacement.astype("<i4").tobytes(), "terms": by_slot, "extra": extra}
        shard, slot = divergence.joined(1, [row]).find([*terms, b"other", b""])
        assert shard.tolist() == [0] * n + [-1, -1]
        assert [by_slot[s] for s in slot[:n]] == terms
    # terms with one hash
    monkeypatch.setattr(divergence, "hashes_of", lambda terms: np.array([len(t) for t in terms], np.uint64))
    terms = [b"a", b"b", b"cc", b"dd", b"ee"]
    displacement, by_slot, extra = divergence.perfect_hash(terms)
    row = {"shard": 0, "displacement": displacement.astype("<i4").tobytes(), "terms": by_slot, "extra": extra}
    shard, slot = divergence.joined(1, [row]).find([*terms, b"z", b"zz"])
    assert shard.tolist() == [0] * 5 + [-1] * 2 and sorted(slot[:5].tolist()) == list(range(5))


def test_rates_are_exact():
    for divisor in (4, 1000, 9 * 10**12):
        counts = np.array([0, 1, 2, divisor // 3, divisor - 2], np.int64)
        assert divergence.rates(counts, divisor).tolist() == [1 + 10**9 * (int(c) + 2) // divisor for c in counts]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_on_held_out_documents(spark, corpus):
    found = queries.op13_language_id(spark, "/root/testdata/sf0.01")
    rows = found.join(corpus.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == corpus.count()
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    accepted = [r for r in held if not r.rejected]
    assert len(accepted) >= 0.9 * len(held)


def test_language_of_odd_texts_and_labels(spark, corpus):
    labelled = corpus.limit(400).select("text", "lang")
    model = language.train(labelled.withColumn("a.b", labelled.lang))
    en = corpus.filter("lang = 'en'").limit(1).collect()[0].text
    texts = [en, en, None, "", "12 34 !?", en * 60, "́", "ß"]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, en, "x", 1.0)], "doc_id int, text string, `a.b` string, score double")
    rows = language.identify(df, model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[5].lang_pred == by_id[None].lang_pred == "en"
    for i in (2, 3, 4, 6):
        assert tuple(by_id[i])[1:] == ("und", 0.0, True)
    assert language.identify(df.limit(0), model).collect() == []


def test_nothing_learned_is_unknown(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "12", "en")], "doc_id int, text string, lang string")
    found = language.identify(df, language.train(df)).collect()
    assert {r.lang_pred for r in found} == {"und"} and all(r.rejected for r in found)
    one = spark.createDataFrame([(1, "some words", "en"), (2, "some words", "en")], df.schema)
    assert [r.lang_pred for r in language.identify(one, language.train(one)).collect()] == ["en", "en"]


def test_long_texts_are_read_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "é", " ", ". ", "Zürich", "the ", "X"]) for _ in range(2000))

    def counted():
        return Counter(b for _, part in language.bucket_counts(["a", text, None, "bc"]) for b in part.tolist())

    whole = counted()
    monkeypatch.setattr(language, "BLOCK", 61)
    assert counted() == whole


def test_training_order_of_rows_plays_no_part(corpus):
    a = language.train(corpus.limit(300))
    b = language.train(corpus.limit(300).repartition(5))
    assert (a.table == b.table).all() and a.threshold == b.threshold
