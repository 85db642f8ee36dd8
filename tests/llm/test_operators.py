"""Training-data operators against brute force, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import doubling, elias_fano, mixing, near_dedup, neighbours, packing, phrase_dedup, quality, suffix_dedup, token_counts, token_files, tokens
from tidemark.llm import windows as windows_of
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import exact_dedup, keep_exact
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.windows import mix, segments

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, parts=3):
    """Documents with extra columns whose names clash with internal ones."""
    rows = [(i, t, "en", s, 0, 1, "x") for i, t, s in rows]
    return spark.createDataFrame(rows, SCHEMA + ", size int, key string").repartition(parts)


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared, base = passage(1, 70), passage(2, 120)
    rows = [(i, passage(100 + i, 60 + i), f"s{i % 4}") for i in range(20)]
    rows += [(30, f"{passage(3, 20)} {shared} {passage(4, 9)}", "s0"), (31, f"{shared}\n{passage(5, 30)}", None), (32, f"x {shared}", "s1")]
    words = base.split()
    rows += [(40, base, "s0"), (41, base.upper(), "s0"), (42, base, "s0")]
    rows += [(50 + i, " ".join([*words[:i], "changed", *words[i + 1 :]]), "s2") for i in range(3, 9)]
    rows += [(60, "ab" * 400, "s3"), (61, "", "s3"), (62, None, "s3"), (63, " \n ", "s3"), (64, "é" * 150 + base[:130], "s1")]
    rows += [(70, "twice", "s1"), (70, "twice", "s1"), (71, "one two three", "s1"), (None, shared, "s1")]
    return rows


EMPTY: list = []


def test_exact_dedup(spark, corpus):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[lower(t)].append(i)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for digest in ({}, {"digest": weak}):
        got = exact_dedup(docs_of(spark, corpus), **digest).collect()
        assert len(got) == len(corpus)
        want = Counter()
        for i, t, _ in corpus:
            g = groups[lower(t)]
            keep = max((x for x in g if x is not None), default=None)
            want[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
        assert Counter(map(tuple, got)) == want
    assert exact_dedup(docs_of(spark, EMPTY)).count() == 0
    kept = [r["doc_id"] for r in keep_exact(docs_of(spark, corpus)).collect()]
    assert kept.count(70) == 1 and len(kept) == len(groups)


def test_mixing(spark, corpus):
    got = mixing.mix(docs_of(spark, corpus)).collect()
    assert len(got) == len(corpus)
    size = {s: 0 for _, _, s in corpus}
    for _, t, s in corpus:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(size)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    by = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert by == {(size[s], round(float(target[s]), 6)) for s in size}
    for s in size:
        taken = sum(r["taken"] for r in got if r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6)
        assert taken == int(target[s] + 0.5) or list(size.values()).count(size[s]) > 1
    assert all(0 <= r["taken"] <= 3 * r["size"] and all(0 <= p <= 1 for p in r["positions"]) for r in got)
    placed = [r["position"] for r in got if r["position"] is not None]
    assert placed == sorted(placed)
    assert got == mixing.mix(docs_of(spark, corpus, 5)).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix(docs_of(spark, corpus, 5)).collect()))
    assert mixing.mix(docs_of(spark, EMPTY)).count() == 0
    assert mixing.training_order(docs_of(spark, corpus)).columns[:5] == "doc_id text lang source n_chars".split()


def test_demand_is_inverted(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.4, 2.0), (0.6, 0.0), (1.0, 1.0))):
        df = spark.range(0, 101).select((F.col("id") / 100.0).alias("q"))
        for q, t in df.select("q", mixing.invert_demand(F.col("q"), knots).alias("t")).collect():
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:]):
                u = min(max(t - t0, 0), t1 - t0)
                done += a * u + (b - a) / (t1 - t0) * u * u / 2
            assert done == pytest.approx(q * mixing.integral(knots), abs=1e-9)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TRICKY = ["It's they'RE we'll", "a<|endoftext|>b <|startoftext|>", "x\x1cy z w", "Größe ÇA ÉTÉ ΣΑΣ", "1234 5-6_7 ...''' 's", "é ́x", "", None, "日本語 text😀 end", "word*** word###, don't***"]


def test_word_memo_equals_tokenizer(tokenizer):
    texts = TRICKY + [passage(i, 40) for i in range(5)]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (5, 100_000):
        encoder = tokens.WordMemo(tokenizer_path(), most)
        for _ in range(2):
            ids, lengths = [], []
            for _, i, n in encoder.encode(pa.array(texts)):
                ids.append(i)
                lengths.append(n)
            assert np.concatenate(lengths).tolist() == [len(w) for w in want]
            assert np.concatenate(ids).tolist() == [x for w in want for x in w]


def test_word_memo_on_random_texts(tokenizer):
    """Letters in either case, marks that compose with them, punctuation, contractions and special tokens, in any order."""
    rng = np.random.default_rng(11)
    pieces = ["A", "i", "I", "K", "\u0130", "\u0131", "\u0307", "\u0331", "H", "\u0301", "\u0327", "\u00df", "\u03a3", "\u0958", "'", "'s", "'RE", ".", "...", "-", "_", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "7", " ", "\n", "\x1c", "\u00a0", "Word", "\U0001f600"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(1, 14)))) for _ in range(4000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (50, 100_000):
        encoder, ids, lengths = tokens.WordMemo(tokenizer_path(), most), [], []
        for a in range(0, len(texts), 500):
            for _, i, n in encoder.encode(pa.array(texts[a : a + 500])):
                ids += i.tolist()
                lengths += n.tolist()
            encoder.rest()
        assert lengths == [len(w) for w in want] and ids == [x for w in want for x in w]


def test_packing_deals_null_ids(spark):
    """Pieces of null id spread over blocks as any others."""
    rows = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "0L AS start", "9L AS length", "1L AS ids_crc32")
    got = packing.pack(rows, block_pieces=100).selectExpr("sequence_id div 2147483648 AS block").groupBy("block").count().collect()
    assert len(got) == 30 and max(r["count"] for r in got) < 200


def test_packing(spark, corpus, tokenizer):
    rows = corpus + [(80, passage(9, 3000), "s0")]
    got = packing.pack_documents(docs_of(spark, rows), tokenizer_path(), tokens=256, block_pieces=64).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            want[(i, p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs_of(spark, EMPTY), tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.sort(np.random.default_rng(3).integers(1, 2049, 4000))[::-1]
    for capacity in ((2048, 2048, 2048**2), (2048, 3, 2048**2), (2048, 100, 2_500_000 + 2048**2)):
        bins, offset = packing.best_fit(lengths, capacity, rule=rule)
        assert (np.bincount(bins, lengths) <= capacity[0]).all() and (np.bincount(bins) <= capacity[1]).all()
        assert (np.bincount(bins, lengths.astype(float) ** 2) <= capacity[2]).all()
    if rule == "norm":
        bins, _ = packing.best_fit(lengths, (2048, 2048, 2048**2), rule=rule)
        assert bins.max() + 1 <= 1.02 * -(-lengths.sum() // 2048)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values in ([], [0], [7], [0, 0, 0], np.sort(rng.integers(0, 10**6, 3000)), np.sort(rng.integers(0, 40, 5000)), [0, 1 << 40]):
        coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.int64)))
        assert coded.all().tolist() == list(values)
        assert [coded.select(i) for i in range(len(values))] == list(values)
        n = len(values)
        for a, b in {(0, n), (n // 2, n), (0, n // 3), (n // 3, n // 2), (max(n - 1, 0), n), (min(255, n), min(258, n)), (n, n)}:
            assert coded.span(a, b).tolist() == list(values[a:b])
    assert len(elias_fano.encode(np.arange(0, 3_000_000, 300))) < 10_000 * 2
    with pytest.raises(IndexError):
        coded.select(2)


def test_token_files(spark, corpus, tokenizer):
    manifest = token_files.write_tokens(docs_of(spark, corpus), tokenizer_path(), 2, shard_text_bytes=2000)
    got = token_files.read_tokens(manifest, docs_at_once=3).orderBy("start").collect()
    start = 0
    for r, (i, t, _) in zip(got, sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = token_files.Shard(manifest.first()["path"])
    assert sum(len(shard.document(i)) for i in range(len(shard))) == shard.footer["tokens"]
    assert token_files.read_tokens(token_files.write_tokens(docs_of(spark, EMPTY), tokenizer_path(), 2)).count() == 0


def test_segments_depend_on_content_only():
    rng = np.random.default_rng(1)
    names = mix(rng.integers(0, 3, 600).astype(np.uint64) + np.uint64(1))
    alone = segments(names[100:400], np.array([300]), 4, 12)
    within = segments(names, np.array([600]), 4, 12)
    anchor = {p: a for a, f, last in zip(within["anchor"].tolist(), within["first"].tolist(), within["last"].tolist()) for p in range(f, last + 1)}
    for a, f, last in zip(alone["anchor"].tolist(), alone["first"].tolist(), alone["last"].tolist()):
        assert all(anchor[p + 100] == a for p in range(f, last + 1))
    assert sum(alone["last"] - alone["first"] + 1) == 300 - 12 + 1


def brute_words(rows, w):
    seen, out = {}, []
    order = lambda i: -1 if i is None else i
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        for a in range(len(words) - w + 1):
            key = tuple(words[a : a + w])
            seen[key] = min(seen.get(key, order(i)), order(i))
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for a in range(len(words) - w + 1):
            if seen[tuple(words[a : a + w])] < order(i):
                gone[a : a + w] = [True] * w
        out.append((i, len(words), sum(gone), " ".join(x for x, g in zip(words, gone) if not g)))
    return Counter(out)


def test_phrase_dedup(spark, corpus):
    got = phrase_dedup.remove_repeated(docs_of(spark, corpus)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_words(corpus, 50)
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in got)
    assert phrase_dedup.remove_repeated(docs_of(spark, EMPTY)).count() == 0


def brute_bytes(rows):
    """Rows in the order of id and text checksum; rows that repeat both are one document."""
    order = lambda r: (-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()) >> 1)
    first, out = {}, []
    for r in rows:
        b = (r[1] or "").encode()
        for a in range(len(b) - 99):
            key = (*order(r), a)
            first[b[a : a + 100]] = min(first.get(b[a : a + 100], key), key)
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if first[b[a : a + 100]] < (*order(r), a):
                gone[a : a + 100] = b"\1" * 100
        out.append((r[0], len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def test_suffix_dedup(spark, corpus):
    got = suffix_dedup.remove_repeated(docs_of(spark, corpus)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_bytes(corpus)
    assert all(r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest() for r in got)
    assert suffix_dedup.remove_repeated(docs_of(spark, EMPTY)).count() == 0


def test_suffix_dedup_over_blocks_and_ranges(spark, corpus):
    """Blocks of few documents, many ranges, one long text that repeats itself and others across parts."""
    rng = np.random.default_rng(11)
    pool = [passage(500 + i, 25) for i in range(40)]
    rows = corpus + [(200 + i, " ".join(rng.choice(pool, 6)), "s") for i in range(30)]
    rows += [(300, " ".join(rng.choice(pool, 400)) + passage(7, 50_000) + pool[3] * 3, "s"), (210, passage(3, 300), "s")]
    got = suffix_dedup.remove_repeated(docs_of(spark, rows, 5), block_bytes=4000, range_bytes=60_000).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_bytes(rows)


def test_suffix_dedup_keeps_the_segments_of_a_block(monkeypatch):
    """op10: segments are found once, when a block is written: what a block reads back covers every window once, around one anchor."""
    rng = np.random.default_rng(5)
    texts = ["", "short", *[bytes(rng.integers(97, 99, n).astype(np.uint8)).decode() for n in (99, 100, 101, 700)], passage(2, 90_000) * 2, None, passage(3, 60)]
    table = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.large_string())})
    symbols = suffix_dedup._bytes
    for name, column in zip(("windows", "place"), doubling.kept_segments(*symbols(table["text"].combine_chunks()), 32, 100)):
        table = table.append_column(name, column)
    monkeypatch.setattr(doubling, "segments", lambda *a: pytest.fail("segments are found again"))
    block = doubling.Block(table, symbols, 32, 100)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(block.first, block.last)])
    want = np.concatenate([np.arange(a, max(a, b - 99)) for a, b in zip(block.starts, block.ends)])
    assert np.array_equal(windows, want)
    assert (block.place >= block.last).all() and (block.place + 32 <= block.first + 100).all()
    data = bytes(block.data)
    at = rng.permutation(np.concatenate([np.arange(3000), len(data) - 100 - np.arange(1000)]))
    for length in (1, 3, 13, 32, 100):
        n = windows_of.width(length)
        for seed in (0, 1):
            names = windows_of.named(windows_of.words(block.data, n), n, at, length, seed)
            assert len({(int(x), data[a : a + length]) for x, a in zip(names, at)}) == len(set(names.tolist())) == len({data[a : a + length] for a in at})


def test_near_duplicates(spark, corpus):
    rows = [r for r in corpus if r[0] is not None and r[0] != 70]
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links, root = Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    for block in (384, 3):
        got = near_dedup.near_duplicates(docs_of(spark, rows), block_members=block).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (top(i), links[i]) for i in sets}
    stay = {r["doc_id"] for r in near_dedup.keep_one(docs_of(spark, rows)).collect()}
    assert stay == {top(i) for i in sets}
    odd = near_dedup.near_duplicates(docs_of(spark, corpus)).collect()
    assert len(odd) == len(corpus)
    assert near_dedup.near_duplicates(docs_of(spark, EMPTY)).count() == 0


def test_near_duplicates_of_repeated_rows(spark):
    base = passage(9, 90).split()
    change = lambda *at: " ".join("changed" if k in at else w for k, w in enumerate(base))
    texts = [(1, change()), (1, change()), (2, change(4)), (None, change(80)), (None, change(40)), (None, change(40)), (3, passage(8, 30)), (4, passage(7, 30)), (4, change(4, 80)), (None, "")]
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    near = lambda i, j: i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = Counter((d, sum(near(i, j) for j in range(len(texts)))) for i, (d, _) in enumerate(texts))
    for block in (384, 2):
        got = near_dedup.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in texts]), block_members=block).collect()
        assert Counter((r["doc_id"], r["n_links"]) for r in got) == want


def test_pruning_bound():
    for n in (16, 64, 160):
        m = near_dedup.least_matches(n, 0.8, 1e-6)
        assert 0 <= m <= 0.8 * n
    assert near_dedup.least_matches(160, 0.8, 1e-6) > 80


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_memo_keeps_marks_with_punctuation(tokenizer):
    texts = ["x\u0130.", "\u0130!", "\u0958.", "\u0130stanbul, \u0958\u0130?) caf\u00e9..."]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = [(i.tolist(), n.tolist()) for _, i, n in tokens.WordMemo(tokenizer_path()).encode(pa.array(texts))]
    assert [x for i, _ in got for x in i] == [x for w in want for x in w]
    assert [x for _, n in got for x in n] == [len(w) for w in want]


def test_unigram_counts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    least = min(s for _, s in vocabulary)
    ties = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abb", -3.0), ("bb", -2.0)]
    for vocab in (vocabulary, ties):
        low = min(s for _, s in vocab) if vocab is ties else least
        full = [("<unk>", low)] + [(f"<0x{i:02X}>", low) for i in range(256)] + vocab
        exact = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
        exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        texts = [" a b", "  a", "▁x ▁ y", "日本語 テスト\n\n😀 abc", " ", "a\tb  c ", "abb abab babb", *[passage(i, 30) for i in range(5)]]
        want = [len(e.ids) for e in exact.encode_batch(texts, add_special_tokens=False)]
        assert token_counts.PieceCounter(vocab).texts(pa.array(texts)).tolist() == want


def test_long_words_keep_few_places(monkeypatch):
    vocab = token_counts.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    counter = token_counts.PieceCounter(vocab)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé日 ".replace(" ", "x")), n)) for n in (1, 90, 999, 1001, 5000)]
    want = counter.counts(words).tolist()
    monkeypatch.setattr(token_counts, "KEPT_PLACES", 10)
    again = token_counts.PieceCounter(vocab)
    assert again.counts(words).tolist() == want == [counter.count("▁" + w) for w in words] and set(again.known) == set(words[:3])


def test_token_counts_odd_cases(spark, corpus):
    path = tokenizer_path("piece_bpe_32k.model")
    got = token_counts.token_counts(docs_of(spark, corpus), path).collect()
    assert len(got) == len(corpus) and {r["n_pieces"] for r in got if r["doc_id"] in (61, 62)} == {0}
    assert token_counts.token_counts(docs_of(spark, EMPTY), path).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:760] = x[0]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0, None] * 8, 0), (None, [1.0] * 16, 0), (2080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, leaf_rows=64, group_rows=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        score = wide @ wide[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(score, 9)))[:20]
        hit += len({int(b) for b in best} & {v for v, _ in found})
        assert all(abs(s - score[v]) < 1e-9 for v, s in found) and len(found) == 20
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hit >= 0.9 * 20 * len(got)
    assert neighbours.nearest(df.limit(0)).count() == 0
    seen = neighbours.nearest(df, leaf_rows=16, group_rows=100, first_leaves=2).groupBy("query_id").agg(F.max("n_compared").alias("n")).agg(F.avg("n")).first()[0]
    assert seen < 0.5 * 1500  # clustered vectors: most leaves are left out by order or by bound
    pair = df.where("vec_id < 60").unionByName(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(100, 145)] + [(100, [100.0, 1.0], 0)], df.schema))
    short = [r["vec_id"] for r in neighbours.nearest(pair).where("query_id = 100").orderBy("rank").collect()]
    assert short == list(range(144, 124, -1))  # own length only; a repeated query asks once
    few = neighbours.nearest(df.where("vec_id < 5"))
    assert few.count() == 4
    fine = df.where("vec_id < 40").select("vec_id", F.transform("embedding", lambda c: c.cast("double") + 1e-12).alias("embedding"))
    for r in neighbours.nearest(fine).collect():
        assert r["score"] == pytest.approx(float((wide[r["query_id"]] + 1e-12) @ (wide[r["vec_id"]] + 1e-12)), abs=1e-14)


def test_visits_hold_enough_vectors():
    x = np.random.default_rng(8).normal(size=(400, 8))
    tree = neighbours.Tree(x, 8, 4)
    held = np.bincount(tree.file(x), minlength=tree.leaves)
    for q in x[:20]:
        seen = tree.visits(q, 1, held=held, least=41)
        assert held[seen].sum() >= 41 and seen[:1] == tree.visits(q, 1)
    assert len(tree.visits(x[0], 1, held=held, least=1000)) == tree.leaves


def test_quality(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        words = [w if good else w + rng.choice(["***", "###"]) for w in passage(1000 + i, 40).split()]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), 0))
    rows += [(900, "", "s"), (901, None, "s"), (None, "x", "s")]
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs_of(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(300)) and got[None]["held_out"]
    right = sum(got[i]["predicted"] == (i % 4 > 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    flat = quality.score_quality(docs_of(spark, rows[:5]), lab.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert quality.score_quality(docs_of(spark, EMPTY), lab).count() == 0


def test_exact_dedup_without_broadcast(spark, corpus):
    one = Counter(map(tuple, exact_dedup(docs_of(spark, corpus)).collect()))
    assert one == Counter(map(tuple, exact_dedup(docs_of(spark, corpus), broadcast_digests=0, salt_rows=2).collect()))
    kept = keep_exact(docs_of(spark, corpus), broadcast_rows=0)
    assert sorted(map(str, kept.collect())) == sorted(map(str, keep_exact(docs_of(spark, corpus)).collect()))


def test_near_duplicates_without_ids(spark):
    a, b = passage(21, 60), passage(22, 60)
    rows = [(None, a, "s"), (None, b, "s"), (5, a, "s"), (6, b, "s"), (None, passage(23, 60), "s"), (7, passage(24, 30), "s"), (7, a + " more", "s")]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got) == Counter(
        [(None, 5, 2, False), (None, 6, 1, False), (5, 5, 2, True), (6, 6, 1, True), (None, None, 0, True), (7, 7, 0, True), (7, 5, 2, False)]
    )
    stay = near_dedup.keep_one(docs_of(spark, rows)).collect()
    assert sorted(r["text"] for r in stay) == sorted([a, b, rows[4][1], rows[5][1]])
