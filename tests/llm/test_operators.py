"""Each operator against a plain version on small tables with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import bpe, chat, decontam, exact_dedup, huffman, queries, secret_scan, similar, simhash, suffix_dedup, suffix_sort, token_counts, toxicity
from graphloom.llm.textbatch import Dictionary, flat, pieces, slices
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "the  quick brown\tfox jumps over the lazy dog. "),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "It's <|endoftext|> Über naïve façade, H̱ 日本語 　 x.y,z"),
    (7, "word " * 4000 + "end"),
    (8, "The quick brown fox jumps over the lazy dog."),
    (8, "The quick brown fox jumps over the lazy dog."),
    (None, "no id here, only text"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).withColumn("row", F.lit(7)).withColumn("digest", F.lit("x")).withColumn("n", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def many(rows):
    return sorted(map(str, rows))


# tokens


def test_token_counts(docs, none):
    tok = plain(queries.WORD_BPE)
    want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in TEXTS]
    got = [tuple(r)[:3] for r in token_counts.token_counts(docs, queries.WORD_BPE).collect()]
    assert many(got) == many(want)
    assert {r["doc_id"]: r["over_limit"] for r in token_counts.token_counts(docs, queries.WORD_BPE).collect()}[7]
    assert token_counts.token_counts(none, queries.WORD_BPE).count() == 0


def test_token_counts_of_whole_texts(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = [(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()]
    assert many(got) == many((d, len(model.encode(t or ""))) for d, t in TEXTS)


ODD = st.lists(st.text(alphabet="aB 'st\n.,é́H̱<|endoftxsr>日　!1\x85", max_size=30), max_size=8)


@settings(max_examples=60, deadline=None)
@given(ODD)
def test_pieces_encode_like_the_library(texts):
    tok = plain(queries.WORD_BPE)
    ids, per = token_counts.dictionary(queries.WORD_BPE).encoded(*flat(pa.array(texts, pa.string())))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_full_dictionary_starts_anew():
    calls = []

    def encode(new):
        calls.append(len(new))
        return np.array([len(x) for x in new], np.uint32), np.ones(len(new), np.int64), np.arange(len(new))

    d = Dictionary(encode, pieces, limit=4)
    for text in ("a bb ccc", "a bb dddd", "a e"):
        ids, _ = d.encoded(*flat(pa.array([text])))
        assert ids.tolist() == [len(w) for w in text.split()]
    assert len(d.known) <= 4 and len(calls) >= 2


def test_slices_keep_every_row():
    batch = pa.record_batch([pa.array(["x" * n for n in (0, 5, 50, 1, 0, 7)])], names=["text"])
    parts = list(slices([batch], "text", 10))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or len("".join(p.column(0).to_pylist())) <= 10 for p in parts)


@settings(max_examples=80, deadline=None)
@given(ODD)
def test_bpe_is_the_librarys(texts):
    tok = plain(queries.BYTE_BPE)
    model, known = bpe.made(queries.BYTE_BPE)
    ids, per = known.encoded(*flat(pa.array(texts, pa.string())))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w]
    spelled, _ = model.spell(ids, per)
    assert spelled.tobytes().decode() == "".join(tok.decode(w, skip_special_tokens=False) for w in want)


def test_bpe_round_trip(docs, none):
    tok = plain(queries.BYTE_BPE)
    want = []
    for d, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False))))
    assert many(tuple(r) for r in bpe.digests(docs, queries.BYTE_BPE).collect()) == many(want)
    rows = {r["doc_id"]: r for r in bpe.encode_decode(docs, queries.BYTE_BPE).collect()}
    assert rows[6]["decoded"] == TEXTS[5][1] and len(rows[6]["ids"]) == 4 * rows[6]["n_tokens"]
    assert bpe.digests(none, queries.BYTE_BPE).count() == 0


def test_greedy_words_that_fail_are_merged():
    model, _ = bpe.made(queries.BYTE_BPE)
    words = [b" " + w for w in (b"thonereding", b"xqzvbrtl", b"the")]
    assert model.words(words) == [model.merge(w) for w in words]
    assert model.exact < len(words)


# token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=200), st.integers(8, 20))
def test_code_lengths(counts, limit):
    lens = huffman.code_lengths(np.array(counts), limit)
    assert lens.max() <= limit and sum(2.0 ** -int(x) for x in lens) <= 1
    import heapq

    heap, total = [*counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    if limit == 20 and len(counts) > 1:
        assert int((lens * np.array(counts)).sum()) == total


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
def test_pack_and_unpack(ids):
    ids = np.array(ids, np.int64)
    seen, n = np.unique(ids, return_counts=True)
    code = huffman.Code(seen, huffman.code_lengths(n))
    bits, marks = code.pack(ids)
    assert code.unpack(bits, marks, len(ids)).tolist() == ids.tolist()


def test_token_files(docs, none):
    tok = plain(queries.WORD_BPE)
    ids = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in TEXTS]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for d, x in ids:
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert many(tuple(r) for r in huffman.token_files(docs, queries.WORD_BPE).collect()) == many(want)
    assert huffman.token_files(none, queries.WORD_BPE).count() == 0


def test_token_files_with_string_ids(spark):
    rows = [("b", "two words"), (None, "x"), ("a", "one"), ("a", None)]
    got = [tuple(r)[:3] for r in huffman.token_files(spark.createDataFrame(rows, "doc_id string, text string"), queries.WORD_BPE).collect()]
    assert {(d, n) for d, _, n in got} == {("b", 3), (None, 2), ("a", 2), ("a", 1)} and max(s + n for _, s, n in got) == 8


def test_specifications_that_let_tokens_span_space():
    import json

    tok = plain(queries.WORD_BPE)
    spec = json.loads(tok.to_str())
    assert token_counts.cuts_at_space(tok) and not token_counts.cuts_at_space(plain(queries.BYTE_BPE))
    for change in (lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r" ?[\p{L}]+|[^\p{N}]+"), lambda s: s["normalizer"]["normalizers"].append({"type": "Prepend", "prepend": "_"})):
        other = json.loads(json.dumps(spec))
        change(other)
        assert not token_counts.cuts_at_space(Tokenizer.from_str(json.dumps(other)))


def test_pairs_are_forgotten_within_a_bound(monkeypatch):
    model, _ = bpe.made(queries.BYTE_BPE)
    model.clear()
    monkeypatch.setattr(bpe, "PAIRS", 3)
    words = [b" " + bytes(w) for w in (b"thonereding", b"xqzvbrtl", b"the", b"internationalisation", b"qqqq")]
    for _ in range(3):
        assert model.words(words) == [model.merge(w) for w in words]
    assert len(model.good) + len(model.bad) < 60


# duplicates


def deleted(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_duplicates(spark, docs, none):
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(deleted(t), []).append((-len(t or ""), d is None, d or 0, d))
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        key = next(k for k in groups if sha(k) == r["text_sha256"])
        assert r["keep_id"] == min(groups[key])[3] and r["group_size"] == len(groups[key])
    kept = [r for r in rows if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(map(sha, groups))
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def fingerprint(t, k=4):
    import xxhash

    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_links(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 3)) + " " + " ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(12)]
    more = [(100 + k, b) for k, b in enumerate(base)] + [(200 + k, b + " tail") for k, b in enumerate(base)] + [(300 + k, b.replace("w1", "v1")) for k, b in enumerate(base)]
    every = TEXTS + more
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA), True)
    rows = simhash.near_duplicates(df).collect()
    fps = [fingerprint(t) for _, t in every]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(every, fps, by_links([d for d, _ in every], fps), strict=True)]
    assert many(tuple(r) for r in rows) == many(want)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(df).count() == len({c if c is not None else ("none", f) for _, f, c in want})


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, (1 << 12) - 1)), max_size=120))
def test_gray_index(rows):
    bucket = np.array([b for b, _ in rows], np.int64)
    fp = np.array([x << 20 | x for _, x in rows], np.uint64)
    index = simhash.GrayIndex(bucket, fp)
    got = {tuple(sorted(p)) for a, b in index.pairs(4) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(len(rows)) for i in range(j) if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}
    assert got == want


def test_choices_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for _, m in simhash.choices())


def test_pipeline_near_dedup_by_force(spark, docs, none, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    every = list(TEXTS)
    for n in (3, 5, 8, 12, 40, 60, 150):  # copies with some words changed, in chains, and a common line
        for g in range(6):
            words = [f"w{x}" for x in rng.integers(0, 400, n)]
            for copy in range(5):
                line = " one line that many of these texts have" if g % 2 else ""
                every.append((1000 + 10 * len(every) + copy, " ".join(words) + line))
                for at in rng.integers(0, n, rng.integers(0, 3)):
                    words[at] = f"v{rng.integers(0, 400)}"
    sets = []
    for _, t in every:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i in range(len(every)):
        for j in range(i):
            both = sets[i] | sets[j]
            if not both or len(sets[i] & sets[j]) / len(both) >= 0.8:
                far += sets[i] != sets[j] and (fingerprint(every[i][1]) ^ fingerprint(every[j][1])).bit_count() > 4
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(every):
        least.setdefault(find(i), []).append(d)
    want = sorted((min((d for d in ids if d is not None), default=None) for ids in least.values()), key=str)
    assert far > 20  # pairs that four bits leave out
    df = docs.unionByName(spark.createDataFrame(every[len(TEXTS) :], SCHEMA), True)
    got = corpus_pipeline.simhash_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == want
    assert corpus_pipeline.simhash_dedup(spark, none, "").count() == 0
    # shards and clusters that are dealt out lose nothing
    monkeypatch.setattr(similar, "SAMPLE", 1)
    monkeypatch.setattr(similar, "OFTEN", 2)
    dealt = similar.drop_similar(df, hot=2, block=100)
    assert sorted((r["doc_id"] for r in dealt.collect()), key=str) == want


@pytest.mark.parametrize("small", [48, 2])
def test_sets_are_joined_like_by_force(small, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", small)
    rng = np.random.default_rng(21)
    sets, group, side = [], [], []
    for g in range(12):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 60))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 70))):
            own = np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 62, len(base)).astype(np.uint64), base)
            sets.append(np.unique(own))
            group.append(g)
            side.append(int(rng.integers(0, 1 + g % 2)))
    per, group, side = np.array([len(x) for x in sets]), np.array(group), np.array(side)
    got = similar.joined_sets(similar.Sets(np.concatenate(sets), per), group, side, 0.8)
    two = {g for g in range(12) if len(set(side[group == g])) > 1}
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if group[i] == group[j] and not (group[i] in two and side[i] == side[j]):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both / (per[i] + per[j] - both) >= 0.8:
                    root[max(find(i), find(j))] = min(find(i), find(j))
    assert got.tolist() == [find(i) for i in range(len(sets))]


def test_near_joins_like_by_force():
    rng = np.random.default_rng(22)
    bucket = np.sort(rng.integers(0, 30, 600))
    base = rng.integers(0, 1 << 62, 8).astype(np.uint64)
    some = lambda: rng.integers(0, 1 << 62, (600, similar.LANES)).astype(np.uint64)
    fp = (base[rng.integers(0, 8, 600)][:, None] * np.arange(1, similar.LANES + 1, dtype=np.uint64)) ^ (some() & some() & some())
    n, of = rng.integers(20, 90, 600), rng.permutation(np.arange(600) % 400)
    got = similar.joined_in_buckets(bucket, fp, n, of, np.arange(400), 0.8)
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(600):
        for j in range(i):
            if bucket[i] == bucket[j] and similar.within(fp[i : i + 1], fp[j : j + 1])[0] and similar.sizes_allow(n[i : i + 1], n[j : j + 1], 0.8)[0]:
                a, b = find(of[i]), find(of[j])
                root[max(a, b)] = min(a, b)
    assert got.tolist() == [find(i) for i in range(400)]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_groups_hold_whole_keys(n):
    key = np.sort(np.random.default_rng(n).integers(0, 6, 40))
    parts = [pa.record_batch([pa.array(key[a : a + n])], names=["key"]) for a in range(0, 40, n)]
    got = [g["key"] for g in simhash.whole_groups(iter(parts), ["key"], n)]
    assert np.concatenate(got).tolist() == key.tolist()
    assert all(x[-1] < y[0] for x, y in zip(got[:-1], got[1:], strict=True))


# suffixes


def runs_by_force(texts, span):
    seen = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                mask[i : i + span] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), max_size=6), st.integers(2, 8), st.sampled_from([(1 << 20, 1 << 20), (40, 4), (16, 2)]))
def test_induced_sorting_in_and_out_of_memory(texts, span, sizes):
    raw = [t.encode() for t in texts]
    assert suffix_dedup.repeated_in(raw, span, *sizes) == runs_by_force(raw, span)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.sampled_from([(1 << 20, 1 << 20), (30, 4)]))
def test_suffix_order_and_common_prefixes(text, sizes):
    scratch = suffix_sort.Scratch(sizes[0])
    parts = list(suffix_sort.sorted_suffixes(np.array(text, np.uint8), 50, scratch, sizes[1]))
    scratch.close()
    order = [int(x) for p, _ in parts for x in p]
    lcp = [int(x) for _, c in parts for x in c]
    cut = [tuple(text[i : i + 50]) for i in order]
    assert sorted(order) == list(range(len(text))) and all(a >= b for a, b in zip(cut, cut[1:], strict=False))
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, 50)


def test_suffix_sort_keeps_long_arrays_in_files(monkeypatch):
    made, sizes = [], []
    neighbours, argsort = suffix_sort.neighbours, np.argsort
    monkeypatch.setattr(suffix_sort, "BLOCK", 256)
    monkeypatch.setattr(suffix_sort, "neighbours", lambda *a: made.append(neighbours(*a)) or made[-1])
    monkeypatch.setattr(suffix_sort.np, "argsort", lambda x, **k: sizes.append(len(x)) or argsort(x, **k))
    text = np.random.default_rng(2).integers(1, 5, 6000).astype(np.uint8)
    scratch = suffix_sort.Scratch(512)
    try:
        got = np.concatenate([p for p, _ in suffix_sort.sorted_suffixes(text, 60, scratch, 100)])
        assert isinstance(made[0], np.memmap) and max(sizes) <= 512
    finally:
        scratch.close()
    raw = text.tobytes()
    assert got[got < len(raw)].tolist() == sorted(range(len(raw)), key=lambda i: raw[i:], reverse=True)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 15)), min_size=1, max_size=40), st.lists(st.integers(1, 20), max_size=3))
def test_suffix_order_with_long_runs_in_and_out_of_memory(runs, again):
    text = np.array([c for c, n in runs for _ in range(n)], np.uint8)
    text = np.concatenate([text, *(text[k:] for k in again)])
    got = []
    for memory in (1 << 20, 60):
        scratch = suffix_sort.Scratch(memory)
        got.append([int(x) for p, _ in suffix_sort.sorted_suffixes(text, len(text), scratch, 8 if memory == 60 else memory) for x in p])
        scratch.close()
    raw = text.tobytes()
    want = sorted(range(len(raw)), key=lambda i: raw[i:], reverse=True)
    assert [[x for x in g if x < len(raw)] for g in got] == [want, want]


class Batches:
    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return [r for b in run(iter(self.batches)) for r in b.to_pylist()]


@pytest.mark.parametrize(("span", "gram"), [(400, 200), (102, 51), (40, 20), (21, 20)])
def test_only_windows_that_can_be_equal_are_sorted(span, gram, monkeypatch):
    rng = np.random.default_rng(span)
    side, byte = span - gram, lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    anchor, left, right = byte(gram), byte(side), byte(side)
    rows = []  # place of the anchor, bytes
    for _ in range(120):
        a, b = int(rng.integers(0, side + 1)), int(rng.integers(0, side + 1))
        before, after = byte(side - a) + left[side - a :], right[:b] + byte(side - b)
        cut = int(rng.integers(0, side + 1))
        rows.append((side - cut, before[cut:] + anchor + after[: side - int(rng.integers(0, side - cut + 1))]))
    rows = [r for r in dict.fromkeys(rows) if len(r[1]) >= span]
    rows += [(side, byte(side) + byte(gram) + byte(side)) for _ in range(200)]
    batches = [pa.RecordBatch.from_pylist([{"anchor": 0, "digest": k, "place": p, "bytes": t} for k, (p, t) in enumerate(rows[at : at + 50], at)], pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("place", pa.int32()), ("bytes", pa.binary())])) for at in range(0, len(rows), 50)]
    want = {k: s for k, s in enumerate(runs_by_force([t for _, t in rows], span)) if s}
    taken, whole = [], suffix_dedup.repeated_in
    monkeypatch.setattr(suffix_dedup, "repeated_in", lambda texts, *a: taken.extend(texts) or whole(taken, *a))
    monkeypatch.setattr(suffix_dedup, "release", lambda: None)
    found = suffix_dedup.shared_parts(Batches(batches + batches[:1]), span, gram)
    assert {r["digest"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found} == want and want
    assert len(taken) < 120 and sum(map(len, taken)) < sum(len(t) for _, t in rows[:-200])
    assert suffix_dedup.shared_parts(Batches([]), span, gram) == []


def test_scratch_files_go(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    suffix_dedup.repeated_in([b"abcabcabc" * 50, b"xabcabcabc" * 30], 20, 64, 8)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("crowd", [256, 1])
def test_remove_repeats(spark, docs, none, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (suffix_dedup.SPAN, suffix_dedup.GRAM, crowd))
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefg é\n"), n))
    shared, line = word(500), word(260)
    more = [(20 + k, word(int(rng.integers(0, 700))) + (shared[k:] if k % 3 else line) + word(300)) for k in range(30)]
    more += [(60, "-" * 2000), (61, shared + shared)]
    every = TEXTS + more
    rows = suffix_dedup.removal_digests(docs.select("doc_id", "text").union(spark.createDataFrame(more, SCHEMA))).collect()
    got = [tuple(r)[:5] for r in rows]
    raw = [(t or "").encode() for _, t in every]
    want = []
    for (d, _), t, runs in zip(every, raw, runs_by_force(raw, 400), strict=True):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + t[at:a], b
        want.append((d, len(t), sum(b - a for a, b in runs), len(runs), sha(kept + t[at:])))
    assert many(got) == many(want)
    assert suffix_dedup.removal_digests(none).count() == 0
    # words of passages: those in 51 words or more that stand elsewhere
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in raw]
    seen = {}
    for w in tokens:
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])] = seen.get(tuple(w[i : i + 51]), 0) + 1
    covered = []
    for (d, _), w in zip(every, tokens, strict=True):
        own = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                own[i : i + 51] = True
        covered.append((d, int(own.sum())))
    assert many((r["doc_id"], r["passage_words"]) for r in rows) == many(covered) and sum(n for _, n in covered) > 4000
    assert all((r["n_passages"] > 0) == (r["passage_words"] > 0) for r in rows)


def test_short_passages_of_many_words(spark):
    """Over 50 words that stand in other texts are found, though they have fewer than 400 bytes; 50 words are not."""
    rng = np.random.default_rng(30)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    long, short = word(55), word(49)
    rows = [(1, " ".join(word(40) + long + word(30))), (2, "\n".join(word(7) + long + word(60))), (3, " ".join(word(9) + short + word(20))), (4, " ".join(short + word(50))), (5, " ".join(word(300)))]
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"], r["passage_words"]) for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, 1, 55), 2: (0, 1, 55), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}


# leaks


def test_leaks(spark, docs, none):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    words = item.split()
    near = " ".join(words[:10] + words[10:19] + ["other"])
    far = " ".join(w if k % 4 else "x" for k, w in enumerate(words))
    rows = [(11, f"before all {item.upper()}, after"), (12, f"a b c {near} d e"), (13, far), (14, "tiny item here"), (15, " ".join(words[:18]))]
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA), True)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 3) for r in decontam.leaks(df, bench).collect()}
    assert got == {(11, 1): 1.0, (12, 1): round(15 / 17, 3), (14, 2): 1.0, (15, 1): round(14 / 16, 3)}
    assert {r["doc_id"] for r in decontam.drop_leaks(df, bench).collect()} == {d for d, _ in TEXTS} | {13}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_leaks_by_force():
    rng = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(40)]
    items = [list(rng.choice(vocab, int(rng.integers(6, 20)))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = list(rng.choice(vocab, int(rng.integers(0, 60))))
        own = list(items[int(rng.integers(0, 12))])
        if rng.random() < 0.5:
            own[int(rng.integers(0, len(own)))] = "zz"
        at = int(rng.integers(0, len(t) + 1))
        texts.append(t[:at] + own + t[at:])

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    from collections import Counter

    want = set()
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            a = Counter(shingles(w))
            n = min(len(w), len(t))
            for s in range(len(t) - n + 1):
                b = Counter(shingles(t[s : s + n]))
                common = sum((a & b).values())
                if common and common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
                    want.add((d, i))
    one = lambda w: decontam.word_hashes(pa.array([" ".join(w)]))[0]
    found = decontam.Items([(i, one(w)) for i, w in enumerate(items)])
    words, per = decontam.word_hashes(pa.array([" ".join(t) for t in texts]))
    assert {g[:2] for g in found.search(words, per, 0.8)} == want


@pytest.mark.parametrize("n", [50, 4000])
def test_multi_index_finds_all_within_radius(n):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, (n, decontam.LANES)).astype(np.uint64)
    queries_ = fps[:40].copy()
    for k, row in enumerate(queries_):  # from 44 to 83 differences, at any places
        for bit in rng.choice(256, 44 + k, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = decontam.MultiIndex(fps)
    q, f = index.search(queries_)
    want = {(a, b) for a in range(40) for b in range(n) if sum(int(x).bit_count() for x in queries_[a] ^ fps[b]) <= decontam.RADIUS}
    assert set(zip(q.tolist(), f.tolist(), strict=True)) == want and len(want) >= 20
    # the buckets leave most fingerprints out, whether flips or occupied buckets are gone through
    met = sum(len(np.concatenate([[0], *(x[1] for x in [index.near_buckets(queries_[:1, 0].astype(np.uint16), b)])])) for b in range(decontam.BLOCKS))
    assert met < 0.3 * n * decontam.BLOCKS / 2
    assert decontam.MultiIndex(fps[:0]).search(queries_)[0].size == 0


def test_leaks_among_thousands_of_equal_length():
    rng = np.random.default_rng(3)
    items = [[f"w{x}" for x in rng.integers(0, 300, 14)] for _ in range(3000)]
    one = lambda w: decontam.word_hashes(pa.array([" ".join(w)]))[0]
    found = decontam.Items([(f"item {i}", one(w)) for i, w in enumerate(items)])
    texts = [["x"] * 5 + items[k] + ["y"] * 5 for k in range(0, 3000, 100)] + [items[7][:13] + ["z"], items[8][:7] + items[9][7:]]
    words, per = decontam.word_hashes(pa.array([" ".join(t) for t in texts]))
    got = {(g[0], g[1]) for g in found.search(words, per, 0.8)}
    assert got == {(k, f"item {100 * k}") for k in range(30)} | {(30, "item 7")}


def test_words_of_any_script():
    words = "eins zwei drei vier fünf sechs sieben acht neun zehn elf naïve".split()
    same = [" ".join(words), "“" + "” “".join(words) + "”", "—".join(words), "\u00a0".join(words), "…".join(w.upper() for w in words), "«" + "»、«".join(words) + "»", "\u3000".join(words) + "。"]
    hashes = [decontam.word_hashes(pa.array([t]))[0].tolist() for t in same]
    assert all(h == hashes[0] and len(h) == len(words) for h in hashes)
    other = decontam.word_hashes(pa.array(["日本語 e\u0301a ١٢ 𝐀𝐁", None, "", "—“”"]))
    assert other[1].tolist() == [4, 0, 0, 0]


def test_leaks_with_quotes_and_long_texts(spark):
    rng = np.random.default_rng(6)
    item = [f"word{x}" for x in rng.integers(0, 900, 18)]
    filler = [f"f{x}" for x in rng.integers(0, 5000, 60_000)]
    rows = [("a", "say " + " ".join(f"“{w}”" for w in item)), ("b", " ".join(f"—{w}" for w in item)), ("c", " ".join(filler[:30_000] + item + filler[30_000:])), ("d", " ".join(filler)), (None, None), ("a", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("item_id", F.lit(0)).withColumn("similarity", F.lit("x"))
    bench = spark.createDataFrame([("q1", " ".join(item)), (None, "—")], "item_id string, text string")
    got = sorted((r["doc_id"], r["item_id"], r["similarity"], r["start_word"], r["n_words"]) for r in decontam.leaks(docs, bench).collect())
    assert got == [("a", "q1", 1.0, 1, 18), ("b", "q1", 1.0, 0, 18), ("c", "q1", 1.0, 30_000, 18)]
    assert many(r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()) == many(["d", None, "a"])


# chats


CONVERSATIONS = [(1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "yes <\\|im_start|>\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, "system", "A"), (2, 6, "assistant", "<"), (None, 0, None, "x\\"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]


def test_chat(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("texts", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    for conv in {c for c, *_ in CONVERSATIONS}:
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in CONVERSATIONS if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["loss_chars"], x["loss_sha256"]) == (len(turns), len(loss), sha(loss))
        assert x["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and not x["rewrites"]
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0


def test_chat_query_by_force(spark, tmp_path):
    """The query itself, conversation -1 included, against a plain version; roles that look like others are kept apart."""
    rows = [*CONVERSATIONS, (4, 0, "user\\n", "a"), (4, 1, "assistant\n", "not in the mask"), (4, 2, "assistant", "<\\\\|x|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op2_chat(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {c for c, *_ in rows}
    for conv, x in got.items():
        turns = [(r or "", t or "") for c, _, r, t in sorted((y for y in rows if y[0] == conv), key=lambda y: y[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (x["n_turns"], x["loss_chars"], x["loss_sha256"], x["turns_sha256"]) == (len(turns), len(loss), sha(loss), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert x["formatted_chars"] == len(chat.chatml(turns))


@given(st.lists(st.tuples(st.text(max_size=6), st.text(alphabet="<|\\im_endstar>ab\n", max_size=30)), max_size=4))
@settings(max_examples=150, deadline=None)
def test_chat_escapes_can_be_undone(turns):
    text = chat.chatml(turns)
    assert chat.read_chatml(text) == turns
    got = chat.Rendered(turns)
    assert [chat.unescape(text[a:b]) for a, b in got.texts] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b in got.spans) == text


def test_templates_that_rewrite_history():
    def last_only(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    def with_tail(turns):
        return "<s>" + "".join(f"{r}: {t}\n" for r, t in turns) + "</s>"

    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    got = chat.Rendered(turns, last_only)
    assert got.rewrites and got.texts[0] is None and got.formatted[slice(*got.texts[2])] == "three"
    tail = chat.Rendered(turns, with_tail)
    assert not tail.rewrites and [tail.formatted[slice(*s)] for s in tail.spans] == ["user: one\n", "assistant: two\n", "user: three\n"]


# secrets


def test_secrets(spark, docs, none):
    key = "kJ8xQ2mVt7Lz0RbN4wYs6HdPc9Gf"
    rows = [(31, f"é password = 'abcdefghijkl' token:short AKIA{'Q' * 16} {'deadbeef' * 3}"), (32, f"use {key} now"), (33, "internationalization_of_documents and averylongidentifierofwords"), (34, "token=secret=abcdefghijklmnop")]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs.unionByName(spark.createDataFrame(rows, SCHEMA), True)).collect()}
    x = got[31]
    assert (x["n_assign"], x["n_access"], x["n_hex"]) == (1, 1, 1)
    spans = "assign:2:26,access:40:60,hex:61:85"
    assert x["spans"] == spans and x["base_sha256"] == sha(spans)
    assert got[32]["spans"] == f"random:4:{4 + len(key)}" and got[32]["base_sha256"] == sha("")
    assert got[33]["spans"] == "" and got[34]["n_assign"] == 1
    assert len(got) == len({d for d, _ in TEXTS}) + len(rows)
    assert secret_scan.scan(none).count() == 0


def base_by_force(t):
    """Kind, start and end of the base matches, by a plain scan."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_base_secrets_by_force(spark):
    rng = np.random.default_rng(11)
    bits = ["password", "API_KEY", "token", "Secret", "apikey", " ", "  ", ":", "=", '"', "'", "é", "日本", "\n", "AKIA", "QWERTYUIOP12", "deadbeef0123", "abcdef", "x.y/z", "0123456789", "-_", "𝐀", "."]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 40)))) for _ in range(400)]
    texts += [" ".join(f"token={x:013d}" for x in range(3000)), "f" * 50_000, "", None]
    docs = spark.createDataFrame([(f"d{k}", t, "x", 1) for k, t in enumerate(texts)], "doc_id string, text string, match string, start int")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want, r = base_by_force(t or ""), got[f"d{k}"]
        assert r["base_sha256"] == sha(",".join(f"{n}:{a}:{b}" for n, a, b in want)), t
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(n == kind for n, _, _ in want) for kind in ("assign", "access", "hex"))
    assert got["d400"]["n_assign"] == 3000


def test_best_part_by_force(spark):
    rng = np.random.default_rng(12)
    table = [round(float(x), 4) for x in rng.normal(0, 2, 128 * 128)]
    tokens = ["".join(chr(x) for x in rng.integers(33, 127, int(n))) for n in rng.integers(12, 60, 200)]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.likelihood_ratio(F.col("t"), table).alias("x"))
    for r in rows.collect():
        x = [table[ord(a) * 128 + ord(b)] for a, b in zip(r["t"], r["t"][1:], strict=False)]
        want = max(sum(x[i:j]) for i in range(len(x)) for j in range(i + 11, len(x) + 1))
        assert abs(r["x"] - want) < 1e-6


def test_secrets_held_out(spark):
    """Keys of other random draws are found and identifiers of other modules are not; words joined to a key don't hide it."""
    import random
    import string

    r = random.Random(5)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits]
    keys = ["".join(r.choice(kinds[k % 3]) for _ in range(12 + k % 20)) for k in range(600)]
    import decimal
    import inspect
    import tarfile
    import xml.dom.minidom
    import zipfile

    names = sorted({n for m in (decimal, inspect, tarfile, xml.dom.minidom, zipfile) for n in dir(m) if len(n) >= 12 and not n.startswith("__")} - set(secret_scan.library_names()))
    ordinary = names + [f"{a}_{b}" for a, b in zip(names, names[1:], strict=False)] + [f"2024-{m:02d}-{d:02d}-10" for m in range(1, 13) for d in range(1, 29)]
    rows = [(k, f"see {t} here") for k, t in enumerate(keys)] + [(1000 + k, f"see path/of/words-{t}_and_more here") for k, t in enumerate(keys)] + [(5000 + k, f"see {t} here") for k, t in enumerate(ordinary)]
    found = {x["doc_id"]: x["n_random"] for x in secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).where("n_random > 0").collect()}
    recall = sum(k in found for k in range(600)) / 600
    joined = sum(1000 + k in found for k in range(600)) / 600
    wrong = sum(k >= 5000 for k in found)
    print("recall", recall, "joined", joined, "false", wrong, "of", len(ordinary))
    assert recall >= 0.95 and joined >= 0.95 and wrong <= 0.01 * len(ordinary)


# toxicity


def scored_by_force(lexicon, text):
    """The measure by a plain scan over every place of the folded text."""
    words = toxicity.fold(text).split()
    line = f" {' '.join(words)} "
    covered = [(m.start(), m.start() + len(p) + 2) for p in lexicon.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", line)]
    best = {}
    for term, w in lexicon.weights.items():
        for m in re.finditer(f"(?={re.escape(term)})", line):
            a, b = m.start(), m.start() + len(term)
            if not any(x <= a and b <= y for x, y in covered):
                best[a] = max(best.get(a, 0.0), w)
    return 100 * sum(best.values()) / max(toxicity.SHORT, len(words))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "Id10t", "idiotic", "proof", "trash", "can", "іdiot", "x", ",", "!", "tra\u00adsh", "clean", "idi", "  "]), max_size=25))
def test_matches_are_those_of_a_plain_scan(parts):
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " idiot": 3.0, " trash": 4.0, " can ": 1.0}, ("trash can", "idiot proof"))
    for text in (" ".join(parts), "".join(parts)):
        assert abs(lexicon.measure(text) - scored_by_force(lexicon, text)) < 1e-9


def test_exceptions_are_learnt(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(900):
        words = [f"w{x}" + "abcdefgh"[x % 8] for x in rng.integers(0, 3000, 40)]
        if k % 5 == 0:
            words[3] = words[30] = "vilemuck"
        elif k % 5 == 1 and k % 2:
            words[3:5] = ["vilemuck", "filter"]
        rows.append((f"id {k}", " ".join(words)))
        labels.append((f"id {k}", int(k % 5 == 0)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, toxic int"))
    assert "vilemuck filter" in lexicon.exceptions and " vilemuck " in lexicon.weights
    assert lexicon.score("clean words and a vilemuck filter too " * 3) < 0.5 < lexicon.score("you are a vilemuck and a vilemuck again")


def test_toxicity(spark, none):
    bad = ["vilemuck", "gruntoaf"]
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(600):
        words = [f"w{x}" + "abcdefgh"[x % 8] for x in rng.integers(0, 3000, 60)]
        toxic = int(k % 5 == 0)
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = bad[int(at) % 2]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(9001, "you G R V1lemuck vіlemuck GRUNT0AF"), (9002, None), (9003, ""), (9004, "a vilemuck bin " * 5)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    lexicon = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, lexicon).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in held) for k in range(600))
    assert np.mean([got[k]["predicted"] == (k % 5 == 0) for k in held]) > 0.95
    assert got[9001]["predicted"] == 1 and got[9002]["predicted"] == 0 and got[9002]["score"] == got[9003]["score"]
    lexicon.exceptions, lexicon._automaton = ("vilemuck bin",), None
    assert lexicon.score("a vilemuck bin " * 5) < 0.5
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {9002, 9003} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.toxicity(none, lab).count() == 0 and toxicity.toxicity(docs, lab.limit(0)).where("predicted = 1").count() == 0
