"""Packing, token files, WARC, Jaccard join, decontamination and the pipeline, by brute force."""

import gzip
import hashlib
import random
import tracemalloc
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridvigil.llm import common, grammar, jaccard, leaks, packing, queries, repetition, secrets, tokens, warc
from gridvigil.llm.common import read_blobs
from gridvigil.llm.tokens import Encoder

EMPTY = "doc_id int, text string, piece string"


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return Encoder(vocabulary)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b  c\n d", "x"), (2, None, "x"), (3, "", "x"), (None, "zz top", "x"), (1, "a b  c\n d", "x"), (7, "word " * 5000, "x")]
    return spark.createDataFrame(rows, EMPTY)


def ids_of(library, text, end):
    return library.library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(library, docs):
    rng = random.Random(0)
    parts = [" ", "  ", "a", "The", "\n", "\t", "é", "1", "!", "'s", " ", "　", "<|endoftext|>", "\x1c", "zz", "word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + list(docs.values())
    found = [x for i in range(0, len(texts), 256) for x in library.encode(texts[i : i + 256])]
    assert found == library.whole(texts)


def test_added_tokens_are_the_library_s(vocabulary, docs):
    fresh = Tokenizer.from_file(vocabulary)  # in its default state
    coder = Encoder(vocabulary)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|>  y z", "<|endoftext|> <|endoftext|>x", "<|endoftext|", "", *list(docs.values())[:50]]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, coder.dtype).tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(["a<|endoftext|>b"])[0], coder.dtype).tolist() == [64, 50256, 65]


def odd_texts(seed, number, most):
    parts = [
        " ", "  ", "\n", "\r\n\r\n", "\t", "\x0b", "\x85", "\u00a0", "\u3000", "\u200b", "\x00", "\x1c", "a", "The", "word,", "\u00e9", "\u00aa",
        "\u00b2", "\u00d7", "\u00ad", "\u024f", "\u0250", "\u0436", "\u4f60\u597d", "\U0001f600", "e\u0301", "'s", "'", "\u2019", "don't", "1", "22", "...",
        "x" * 20, " " * 20, "=" * 18,
    ]
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(number)]


def test_encoder_cuts_as_the_library(library):
    texts = odd_texts(1, 20000, 14)
    assert [x for i in range(0, len(texts), 256) for x in library.encode(texts[i : i + 256])] == library.whole(texts)


def test_encoder_full_tables_and_long_texts(vocabulary, monkeypatch):
    for name, value in {"SLOTS": 1 << 8, "STEP": 1 << 6, "MAX_LONG": 10, "PART": 2000}.items():
        monkeypatch.setattr(tokens, name, value)
    coder = Encoder(vocabulary)
    texts = odd_texts(2, 20, 3000)
    texts += [" ".join(f"w{i * j % 997}x" for i in range(3000)) for j in range(1, 5)] + [""]
    for _ in range(2):
        assert coder.encode(texts) == coder.whole(texts)
        assert 0 < coder.short.n_words <= coder.short.slots // 2 + tokens.STEP


def test_known_words_need_no_library(vocabulary, monkeypatch):
    coder = Encoder(vocabulary)
    texts = ["The end.\n", "two  blanks and\ta tab\r\n\r\n", "caf\u00e9, 12 times;\nthe  end", " begins with a blank "]
    again = ["two  blanks and\ta tab\r\n\r\n", "The  end.\n", "12 times a tab;\nthe end\n", " begins with caf\u00e9, a blank "]
    coder.encode([*texts, "12 a tab; the end", "The. caf\u00e9,\n"])
    want = coder.whole(again)
    monkeypatch.setattr(coder, "library", None)
    monkeypatch.setattr(coder, "model", None)
    coder.whole = lambda texts: [] if not texts else pytest.fail("known words went through the library")
    assert coder.encode(again) == want


def test_new_words_are_encoded_once(vocabulary, docs):
    coder = Encoder(vocabulary)
    words, learn = [], coder._word_ids
    coder._word_ids = lambda buffer, at, sizes: words.extend(bytes(buffer[a : a + n]) for a, n in zip(at, sizes)) or learn(buffer, at, sizes)
    texts = [t for t in docs.values() if t and t.isascii() and "'" not in t][:200]
    for i in range(0, len(texts), 64):
        coder.encode(texts[i : i + 64])
    assert len(words) == len(set(words)) > 100
    assert max(map(len, words)) <= tokens.SHORT


def test_encoder_after_an_error(vocabulary):
    coder = Encoder(vocabulary)
    learn = coder._word_ids
    coder._word_ids = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        coder.encode(["some new words"])
    coder._word_ids = learn
    assert coder.encode(["some new words"]) == coder.whole(["some new words"])


def best_fit(histogram):
    gaps, n = Counter(), 0
    for length in range(2048, 0, -1):
        for _ in range(int(histogram[length])):
            gap = min((g for g, c in gaps.items() if g >= length and c), default=None)
            if gap is None:
                n, gap = n + 1, 2048
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return n


@pytest.mark.parametrize("kind", ["long", "short", "normal", "one", "none", "half"])
def test_packing_plan(kind):
    rng = np.random.default_rng(1)
    sizes = {
        "long": rng.integers(700, 2049, 800), "short": rng.integers(1, 100, 3000), "one": np.array([9]),
        "normal": np.minimum(2048, rng.lognormal(6, 1, 3000).astype(int) + 1), "none": np.array([], int),
        "half": np.full(999, 1024),
    }[kind]
    histogram = np.bincount(sizes, minlength=2049)
    plan = packing.plan_patterns(histogram)
    used = np.zeros(2049, int)
    for repeats, lengths in plan:
        assert repeats > 0 and sum(lengths) <= 2048
        np.add.at(used, lengths, repeats)
    assert (used == histogram).all()
    assert sum(r for r, _ in plan) <= best_fit(histogram) * 1.01 + 1


def check_pieces(rows, texts, library):
    """``rows`` of the packing query against the tokenizer; sequences are full and gapless."""
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = ids_of(library, text, 0)
        n = -(-len(ids) // 2048)
        cuts = [0] + [len(ids) - 2048 * (n - 1 - k) for k in range(n)]
        assert sorted(pieces[doc_id]) == list(range(n))
        for k, r in pieces[doc_id].items():
            own = ids[cuts[k] : cuts[k + 1]]
            assert (r.start, r.length, r.ids_crc32) == (cuts[k], len(own), crc(own))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_query(spark, sf_dir, docs, library):
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    assert len({r.doc_id for r in rows}) == len(docs)
    n = check_pieces(rows, docs, library)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 3


def test_placing_needs_no_tokenizer(spark, docs, library, vocabulary, monkeypatch):
    """Executors that only place pieces do not hold the tokenizer."""
    ranked = packing.ranked_tokens

    def gone(path):
        raise AssertionError("the tokenizer is loaded again")

    def ranked_once(*args):
        found = ranked(*args)
        monkeypatch.setattr(packing, "encoder", gone)
        return found

    monkeypatch.setattr(packing, "ranked_tokens", ranked_once)
    some = dict(list(docs.items())[:20])
    rows = packing.pack(spark.createDataFrame([*some.items()], "doc_id long, text string"), vocabulary)
    check_pieces(rows.withColumn("ids_crc32", F.crc32("ids")).collect(), some, library)


def test_packing_odd_rows(spark, odd, vocabulary, library):
    rows = packing.pack(odd, vocabulary).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 1, None: 1, 7: 3}
    made = packing.sequences(packing.pack(odd, vocabulary)).collect()
    assert sum(len(r.ids) for r in made) == 4 * sum(r.length for r in rows)
    one = next(r for r in rows if r.doc_id == 1)
    assert np.frombuffer(one.ids, "<u4").tolist() == ids_of(library, "a b  c\n d", 0)
    assert packing.pack(odd.limit(0), vocabulary).count() == 0


def pairs_left(symbols, first):
    starts = set(first.tolist())
    return Counter(p for i, p in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)) if i + 1 not in starts)


def test_no_frequent_pair_is_left(monkeypatch):
    rng = np.random.default_rng(4)
    for most in (3, 3800):
        monkeypatch.setattr(grammar, "PAIRS_A_ROUND", most)
        for values in (2, 12, 300):
            ids = rng.integers(0, values, 4000).astype("<u2")
            ids[100:1600] = np.tile(ids[100:150], 30)
            starts = np.array([0, 700, 701, 3000])
            symbols, rules, first = grammar.compress(ids, starts, values)
            left = pairs_left(symbols, first)
            overlapping = {p for p in left if p[0] == p[1]}  # a run of one symbol counts its pairs doubly
            assert all(n < grammar.MIN_COUNT for p, n in left.items() if p not in overlapping)
            assert len(rules) and len(first) == 4
    passage = rng.integers(0, 50000, 1000)
    symbols, _, _ = grammar.compress(np.tile(passage, 1000), np.array([0]), 50257)
    assert len(symbols) < 2000  # a thousand copies of a thousand ids


def test_frequent_pairs_from_the_largest_buckets(monkeypatch):
    rng = np.random.default_rng(6)
    symbols = np.minimum(rng.zipf(1.3, 200_000), 5000).astype(np.uint32)
    ends = np.arange(999, 199_999, 1000)
    firsts = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
    names, counts = np.unique(np.delete(firsts, ends), return_counts=True)
    places = []
    count = grammar._pairs_of
    monkeypatch.setattr(grammar, "_pairs_of", lambda s, bucket, full, *a: places.append(full[bucket].sum()) or count(s, bucket, full, *a))
    left, right, at, which = grammar.frequent_pairs(symbols, ends, 100)
    found = dict(zip((left.astype(np.int64) << 32 | right).tolist(), np.bincount(which).tolist(), strict=True))
    exact = dict(zip(names.tolist(), counts.tolist(), strict=True))
    assert len(found) == 100 and all(exact[p] == n for p, n in found.items())
    assert (firsts[at] == (left.astype(np.int64) << 32 | right)[which]).all() and not np.isin(at, ends).any()
    shared = sorted(counts.tolist())[-100] - min(found.values())  # a bucket shared by two pairs stands for one
    assert shared <= 0.1 * min(found.values())
    assert len(places) == 1 and places[0] < 0.9 * counts[counts >= grammar.MIN_COUNT].sum()  # not all frequent pairs' places


def test_grammar_round_trip(library):
    rng = np.random.default_rng(2)
    texts = [np.repeat(rng.integers(0, 5, n), rng.integers(1, 4)).astype("<u2") for n in rng.integers(1, 300, 60)]
    shard = grammar.Shard.pack(3, 4, [None, *range(1, 60)], [t.tobytes() for t in texts], library.dtype, library.size)
    back = grammar.Shard.from_bytes(shard.to_bytes() + b"\n")
    assert len(back.rules) and len(back.symbols) < sum(map(len, texts)) and back.doc_ids[0] is None
    for i, text in enumerate(texts):
        assert back.document(i).tolist() == text.tolist()
        a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        assert back.document(i, a, b).tolist() == text[a:b].tolist()
    with pytest.raises(ValueError):
        grammar.Shard.from_bytes(b"junk" + shard.to_bytes()[4:])


def test_token_files_query(spark, sf_dir, docs, library, monkeypatch):
    monkeypatch.setattr(grammar, "SHARD_IDS", 5000)
    rows = {r.doc_id: r for r in queries.op9_token_files(spark, sf_dir).collect()}
    at = 0
    for doc_id in sorted(docs):
        ids = ids_of(library, docs[doc_id], 2)
        r = rows.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not rows


def test_token_files_odd_rows(spark, odd, vocabulary):
    folder = grammar.write(odd, vocabulary)
    rows = sorted(grammar.read(odd, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 7]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert read_blobs(spark, folder).count() > 0
    none = odd.limit(0)
    assert grammar.read(none, grammar.write(none, vocabulary)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    rng = random.Random(1)
    made = []
    for i in range(40):
        payload = bytes(rng.choices(b"abc<>\r\n WARC/1.0\r\n", k=rng.randint(0, 2000)))
        made.append(warc.record(i, f"http://x/{i}", payload, None if i % 3 else 7))
    parts = [gzip.compress(r) if packed else r for r in made]
    data = b"".join(parts)
    records, gaps = warc.salvage(data)
    assert len(records) == 40 and not gaps and records[-1][1] == len(data)
    for _ in range(60):
        k = rng.randrange(40)
        at = sum(map(len, parts[:k])) + rng.randrange(len(parts[k]))
        broken = bytearray(data)
        broken[at] ^= 0x55
        records, gaps = warc.salvage(bytes(broken))
        names = {r.headers["warc-record-id"] for _, _, r in records}
        lost = {f"<urn:page:{i}>" for i in range(40) if i != k} - names
        assert not lost
        # what is not read as a record is logged, to the byte
        covered = sorted({(s, e) for s, e, _ in records} | {(s, e) for s, e, _ in gaps})
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    records, gaps = warc.salvage(b"junk" + data[: len(data) - 9] + b"")
    assert len(records) == 39 and len(gaps) == 2 and gaps[0][:2] == (0, 4)
    assert warc.salvage(b"") == ([], []) and len(warc.salvage(b"\x1f\x8b\x08WARC/1.0")[1]) == 1


def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first: dict[bytes, int] = {}
    for p in pages:
        key = hashlib.sha1((p.html or "").encode()).digest()
        first[key] = min(p.page_id, first.get(key, p.page_id))
    rows = {r.page_id: r for r in queries.op8_warc_round_trip(spark, sf_dir).collect()}
    for p in pages:
        data = (p.html or "").encode()
        key = hashlib.sha1(data).digest()
        own = first[key] == p.page_id
        want = (len(data), b32encode(key).decode(), "response" if own else "revisit", None if own else first[key])
        assert tuple(rows.pop(p.page_id))[1:] == want
    assert not rows


def test_warc_odd_rows(spark):
    rows = [(2, "u\r\nx", "<a>"), (1, None, None), (None, "x", "<a>"), (3, "z", "<a>"), (4, "", ""), (2, "u", "<a>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 as type")
    folder = warc.write(pages)
    stored = warc.read(spark, folder)
    found = sorted(tuple(r) for r in warc.pages_of(stored, pages).select("page_id", "record_type", "refers_to").collect() if r[0])
    assert found == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 2), (4, "revisit", 1)]
    assert stored.count() == 6 and stored.filter("reason is not null").count() == 0
    for r in read_blobs(spark, folder).collect():
        assert gzip.decompress(r.content)  # a plain tool reads the file to its end
    none = pages.limit(0)
    assert warc.pages_of(warc.read(spark, warc.write(none)), none).count() == 0
    least = warc.pages_of(warc.read(spark, warc.write(pages, least=1)), pages).collect()
    assert all(r.record_type == "response" for r in least if not r.payload_bytes)


def test_warc_pages_are_written_where_they_lie(spark, monkeypatch):
    # two payloads repeated, one of them empty; the shuffled join must find the same as the broadcast
    rows = [(i, f"http://x/{i}", None if i % 10 == 3 else "<a>" if i % 10 == 7 else f"<p>{i}") for i in range(90, 0, -1)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    want = {i: 3 if i % 10 == 3 and i > 3 else 7 if i % 10 == 7 and i > 7 else None for i in range(1, 91)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most, files in ((2, 3), (1, None)):
            monkeypatch.setattr(warc, "REPEATED", most, raising=False)
            folder = warc.write(pages)
            found = warc.pages_of(warc.read(spark, folder), pages).collect()
            assert len(found) == 90 and {r.page_id: r.refers_to for r in found} == want
            assert all(r.record_type == ("revisit" if want[r.page_id] else "response") for r in found)
            if files:  # a file for each of the table's partitions, not for each partition of a shuffle
                assert read_blobs(spark, folder).count() == files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_reader_holds_one_member_at_a_time(monkeypatch):
    class Files:
        def mapInArrow(self, run, schema):
            return run

    size = 1 << 20
    data = b"".join(gzip.compress(warc.record(i, None, b"<p>%d" % i + b" " * size, None), 6, mtime=0) for i in range(40))
    assert len(data) < size  # far fewer bytes than the payloads
    monkeypatch.setattr(warc, "read_blobs", lambda spark, folder: Files())
    file = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data], pa.binary())], names=["path", "content"])
    found = []
    tracemalloc.start()
    try:
        for batch in warc.read(None, "")(iter([file])):
            found += zip(batch["start"].to_pylist(), batch["end"].to_pylist(), [len(x.as_buffer()) > size for x in batch["payload"]])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 40 and all(whole for *_, whole in found) and found[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert peak < 12 * size


def test_warc_rows_are_handed_on_in_small_batches(spark, monkeypatch):
    # one file of many records, of both kinds, with a gap before each tenth
    pages = [(i, f"http://x/{i}", b"<p>%d" % i + b"x" * (i % 7 * 1000)) for i in range(700)]
    parts = [b"junk" * (not i % 10) + gzip.compress(warc.record(i, u, p, None if i % 3 else 1), mtime=0) for i, u, p in pages]
    folder = common.shared_folder(spark, "parts")
    blob = spark.createDataFrame([(bytearray(b"".join(parts)[:-1]),)], "content binary")
    common.write_blobs(blob, "content", folder, per_file=1, end="\0")  # a member's last byte, as sizes are short
    monkeypatch.setattr(warc, "SLICE_BYTES", 5000, raising=False)
    rows = warc.read(spark, folder).collect()
    assert sorted(r.record_id for r in rows if r.record_id) == sorted(f"<urn:page:{i}>" for i, _, _ in pages)
    assert sum(r.reason is not None and r.end - r.start == 4 for r in rows) == 70
    payloads = {r.record_id: bytes(r.payload) for r in rows if r.type == "response"}
    assert payloads == {f"<urn:page:{i}>": p for i, _, p in pages if i % 3}


def test_warc_urls_with_line_marks_and_long_ones(spark):
    odd = ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n", "\t", "\x00"]
    urls = [f"http://x/a{c}b" for c in odd] + ["http://x/" + "y" * (3 << 19), " http://x/\u00a0", "http://x/é"]
    want = ["http://x/a" + "".join(f"%{b:02X}" for b in c.encode()) + "b" for c in odd] + [urls[-3], "%20http://x/\u00a0", urls[-1]]
    pages = spark.createDataFrame([(i, u, "<a>") for i, u in enumerate(urls)], "page_id int, url string, html string")
    stored = warc.read(spark, warc.write(pages))
    rows = stored.collect()
    assert all(r.reason is None for r in rows)
    assert {r.record_id: r.target_uri for r in rows} == {f"<urn:page:{i}>": u for i, u in enumerate(want)}
    found = {r.page_id: r.refers_to for r in warc.pages_of(stored, pages).collect()}
    assert found == {i: 0 if i else None for i in range(len(urls))}
    # a record of another writer keeps such characters
    plain = warc.record(1, "http://x/ab", b"<a>", None).replace(b"/ab", "/a\u2028\x0b\x85b".encode())
    records, gaps = warc.salvage(plain)
    assert not gaps and records[0][2].headers["warc-target-uri"] == "http://x/a\u2028\x0b\x85b"


def plain_components(rows):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for s in own:
            holders[s].append(doc_id)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        for j, common in Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * common >= 80 * (len(own) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(own), top(i)) for i, own in sets.items()}


@pytest.fixture(scope="module")
def families(spark):
    """Families of edited copies, exact copies, a common passage, short and empty texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=30)
    rows = [(900, ""), (901, None), (902, "one two"), (903, "One two"), (904, "one  two three"), (905, "a b c d e"), (906, "e d c b a")]
    for base in range(4):
        text = rng.choices(words, k=rng.choice((40, 120, 300)))
        for copy in range(60):
            own = list(text)
            for _ in range(rng.randint(0, len(text) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((base * 100 + copy, " ".join(own + (passage if copy % 3 == 0 else []))))
    rows += [(500 + i, " ".join(passage + rng.choices(words, k=i))) for i in range(40)]
    rows += [(600 + i, rows[50][1]) for i in range(40)]
    rng.shuffle(rows)
    return rows


def test_jaccard_join(spark, families, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    docs = spark.createDataFrame(families, "doc_id int, text string").selectExpr("*", "'x' as n_shingles").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert found == plain_components(families)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in found.values()})


def test_jaccard_odd_rows(spark, monkeypatch):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, text + " x"), (4, "other words are these here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in jaccard.join(docs).collect())
    assert found[(1, 26, 1)] == 2 and found[(2, 26, 1)] == 1 and found[(None, 26, None)] == 1 and found[(3, 0, 3)] == 1
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect())[:2] == ["1", "3"]
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_jaccard_ids_with_different_texts(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, x), (1, y), (5, y), (6, y + " z"), (15, x), (16, x + " z")]  # one of x and y stands for 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()}
    assert found in ({(1, 1), (5, 5), (6, 5), (15, 1), (16, 1)}, {(1, 1), (5, 1), (6, 1), (15, 15), (16, 15)})
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} in ({1, 5}, {1, 15})


def test_block_pairs_match_all_pairs(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(3)
    for _ in range(40):
        size = int(rng.integers(2, 30))
        n = rng.integers(20, 40, size)
        entries = {
            "n": n, "rest": n - rng.integers(0, 6, size), "label": np.sort(rng.integers(0, 4, size)),
            "bits": rng.integers(0, 2, (size, 8)).astype(np.uint64) << np.uint64(63),
        }
        want = set()
        for i in range(size):
            for j in range(i):
                apart = int(np.bitwise_count(entries["bits"][i] ^ entries["bits"][j]).sum())
                fits = jaccard.may_link(n[i], n[j], entries["rest"][i], entries["rest"][j]) and 180 * apart <= 20 * (n[i] + n[j])
                if fits and entries["label"][i] != entries["label"][j]:
                    want.add((j, i))
        a, b = jaccard.block_pairs(entries, True)
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
        for short in (1, 100):  # one list in blocks, or together with another
            monkeypatch.setattr(jaccard, "SHORT", short)
            twice = {k: np.concatenate([v, v]) for k, v in entries.items()}
            c, d = jaccard.list_pairs(np.repeat([1, 2], size), twice, True)
            assert {tuple(sorted(p)) for p in zip(c.tolist(), d.tolist())} == want | {(i + size, j + size) for i, j in want}
            c, d = jaccard.list_pairs(np.repeat([1, 2], size), twice, False)
            assert {i % size for i in c.tolist()} == {i for p in want for i in p}
        a, b = jaccard.block_pairs(entries, False)
        assert set(a.tolist()) == {i for p in want for i in p}
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} <= want


def plain_edits(item, text):
    before = list(range(len(item) + 1))
    best = before[-1]
    for word in text:
        now = [0]
        for i, own in enumerate(item, 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (own != word)))
        before, best = now, min(best, now[-1])
    return best


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(500):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(a, 80))] for a in (1, 0))
        assert leaks.edit_distance(item, text) == plain_edits(item, text)


def test_only_likely_stretches_are_measured(monkeypatch):
    """A text may hold some grams of an item and lack most of its words."""
    rng, measured = random.Random(4), []
    plain = leaks.edit_distance
    monkeypatch.setattr(leaks, "edit_distance", lambda *args: measured.append(1) or plain(*args))
    items = [[f"w{rng.randrange(5000)}" for _ in range(40)] for _ in range(30)]
    index = leaks.Index.of([(i, leaks.word_hashes(" ".join(words))) for i, words in enumerate(items)])
    for words in items:  # the last 16 words are others; 8 edits are allowed
        text = [w if i < 24 else f"x{i}" for i, w in enumerate(words)]
        assert not index.leaks(" ".join(text))
    assert not measured
    for _ in range(300):
        item, text = ([rng.randrange(9) for _ in range(rng.randint(a, 30))] for a in (1, 0))
        edits, most = plain_edits(item, text), rng.randrange(9)
        assert edits > most or not leaks.missing(Counter(item), text, most)


def test_leaks_recall_and_precision(spark, sf_dir, docs):
    items = [r for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    given = [(r.item_id, leaks.word_hashes(r.text)) for r in items]
    index = leaks.Index.of([g for g in given if len(g[1]) >= leaks.MIN_WORDS])
    rng, hit, all_leaks = random.Random(9), 0, 0
    prose = [t for t in docs.values() if len(t) < 3000][:40]
    for _ in range(200):
        item = rng.choice([r for r in items if len(r.text.split()) >= 10])
        words = item.text.split()
        for _ in range(rng.randint(0, len(words) // 5)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(([], ["changed"], [words[at], "new"]))
        text = rng.choice(prose) + "\n" + " ".join(words).upper() + "! " + rng.choice(prose)
        hashes = leaks.word_hashes(text).tolist()
        want = {
            i for i, (_, own) in enumerate(zip(index.ids, index.words))
            if plain_edits(own.tolist(), hashes[max(0, len(hashes) - 1200) :]) <= len(own) * leaks.EDITS // 100
        } if all_leaks < 20 else {index.ids.index(item.item_id)} & {
            index.ids.index(item.item_id)
            for own in [index.words[index.ids.index(item.item_id)]]
            if leaks.edit_distance(own.tolist(), hashes) <= len(own) * leaks.EDITS // 100
        }
        found = index.leaks(text)
        all_leaks += len(want)
        hit += len(want & set(found))
        for i, edits in found.items():
            assert edits == leaks.edit_distance(index.words[i].tolist(), hashes)
    assert hit >= 0.97 * all_leaks > 100


def test_leaks_query_and_stage(spark, sf_dir, docs, monkeypatch):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.op7_benchmark_decontamination(spark, sf_dir).collect()}
    exact = {
        (d, i) for d, t in docs.items() for i, item in items.items() if item in t and len(item.split()) >= leaks.MIN_WORDS
    }
    assert exact <= found
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)  # many blocks
    table = spark.createDataFrame([*docs.items(), (None, None), (-1, "")], "doc_id long, text string").selectExpr("*", "1 as edits")
    bench = spark.createDataFrame([*items.items(), (None, None), (-5, "too few words")], "item_id long, text string")
    kept = leaks.drop_leaking(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {*docs, None, -1} - {d for d, _ in found}
    assert leaks.find(table, bench.limit(0)).count() == 0 and leaks.drop_leaking(table.limit(0), bench).count() == 0


def test_leaks_of_short_items_and_scripts_without_spaces(spark):
    items = {
        1: "What is the capital of France?", 2: "法国的首都是哪里？", 3: "フランスの首都はどこですか、そして人口は何人ですか。",
        4: "เมืองหลวงของประเทศฝรั่งเศสคือเมืองอะไร", 5: "capital", 6: "¿Qué?", 7: "?!", 8: "What is the capital of France?",
        9: "one two three four five six seven eight nine ten",
    }
    texts = {
        1: "“What is the  Capital of France”—asked", 2: "问：法国的首都是哪里？答：巴黎。", 3: "Q フランスの首都はどこですか。そして人口は五人ですか",
        4: "ถาม" + items[4] + "ตอบ", 5: "what is the big capital", 6: "no leak? at all!", 7: None, 8: "so Qué…", 9: "三国的首都是哪里",
        10: "x one two three four five 6 seven eight nine ten y",
    }
    want = {(1, 1), (1, 8), (1, 5), (2, 2), (3, 3), (4, 4), (5, 5), (8, 6), (10, 9)}
    table = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for held in (items, {k: v for k, v in items.items() if k not in (3, 4, 9)}):
        bench = spark.createDataFrame([*held.items(), (None, None)], "item_id long, text string")
        expected = {(d, i) for d, i in want if i in held}
        rows = leaks.find(table, bench).collect()
        assert {(r.doc_id, r.item_id) for r in rows} >= expected and all(r.edits == 0 for r in rows if r.item_id not in (2, 3, 9))
        assert {(r.doc_id, r.item_id) for r in rows} - expected <= {(9, 2)}  # 8 characters, one changed
        kept = {r.doc_id for r in leaks.drop_leaking(table, bench).collect()}
        assert kept == set(texts) - {r.doc_id for r in rows} and 7 in kept


def test_pipeline(spark, sf_dir, docs, library):
    """Each stage against a plain version over what the one before kept."""
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = kept.columns, {r.doc_id: r for r in kept.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == columns
        new = {r.doc_id: r for r in kept.collect()}
        if name == "quality_rules":
            assert set(new) == {i for i, r in rows.items() if repetition.measure(r.text)["kept"]}
        elif name == "near_duplicates":
            assert set(new) == {c for _, c in plain_components([(i, r.text) for i, r in rows.items()]).values()}
        elif name == "decontamination":
            assert not any(item in r.text for r in new.values() for item in items)
            assert len(new) > 0.8 * len(rows)
        else:
            assert set(new) == set(rows) and not any("token = " in r.text and "<SECRET>" not in r.text for r in new.values())
            assert all(r.n_chars == len(r.text) for r in new.values())
        rows = new
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    check_pieces(last, {i: r.text for i, r in rows.items()}, library)
    assert {r.doc_id for r in last} == set(rows)
    assert sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()) == sorted(
        (r.doc_id, r.piece, r.ids_crc32) for r in last
    )


def test_stages_keep_batches_small(spark, sf_dir, monkeypatch):
    """No stage holds a whole batch's output, and the pipeline's batches are bounded by their bytes."""
    given = spark.createDataFrame([(i, f"some words {i}") for i in range(3)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a text of some words"] * 1000)], names=["doc_id", "text"])
    for module in (leaks, repetition, secrets):
        monkeypatch.setattr(module, "map_whole", lambda docs, run: run)
    for run in (leaks.drop_leaking(given, items), repetition.keep_good(given), secrets.redact(given, secrets.own_model())):
        assert max(b.num_rows for b in run([batch])) <= common.ROWS
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name).removesuffix("b")))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("stage", stage)])
    corpus_pipeline.run(spark, sf_dir)
    assert seen[0] <= 4 << 20 and spark.conf.get(name) == before


def edited(words, n_edits, kind, clustered, rng):
    """``words`` after edits of one kind, all in one stretch or anywhere."""
    words = list(words)
    low = rng.randrange(len(words) - min(len(words), max(n_edits, 1)) + 1) if clustered else 0
    span = min(len(words), max(n_edits, 1)) if clustered else len(words)
    places = rng.sample(range(low, low + span), n_edits)
    for place in sorted(places, reverse=True):
        new = f"other{rng.randrange(10**6)}"
        if kind == "delete":
            del words[place]
        elif kind == "insert":
            words.insert(place, new)
        else:
            words[place] = new
    return words


@pytest.mark.parametrize("size", [10, 20, 40, 100, 300])
def test_leaks_recall_by_size_and_edits(size):
    rng = random.Random(size)
    items = [[f"w{rng.randrange(5000)}" for _ in range(size)] for _ in range(60)]
    index = leaks.Index.of([(i, leaks.word_hashes(" ".join(words))) for i, words in enumerate(items)])
    for kind in ("insert", "delete", "replace"):
        for clustered in (False, True):
            caught = 0
            for i, words in enumerate(items):
                changed = edited(words, size * leaks.EDITS // 100, kind, clustered, rng)
                around = [[f"x{rng.randrange(5000)}" for _ in range(rng.randrange(80))] for _ in range(2)]
                caught += i in index.leaks(" ".join([*around[0], *changed, *around[1]]))
            assert caught >= 0.95 * len(items), (kind, clustered, caught)
