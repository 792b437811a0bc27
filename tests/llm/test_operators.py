import collections
import random
import re
import textwrap
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import ann, common, exact_dedup, html, licenses, lm, minhash, mixing, packing, pii, quality, queries
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(8)
VOCAB = ["w%d" % i for i in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def docs(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, None, sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edited(text, every, seed):
    w = text.split()
    for i in range(seed % every, len(w), every):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


ODD = [None, "", "   \n\t", "one", "one two three four", "a b c d e", "a b c d e f", prose(30, 1), "x" * 300_000, prose(40_000, 2), "ümlaut ñ 汉字 " * 20, "\x00\x1c\x85\xa0   <|endoftext|> 's 'S"]


# ------------------------------------------------------------------ shared kernels

@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbBzÄ \t\n\x0b\x0c\r\x1c\x85\xa0é汉"), max_size=40)), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    seen = {}
    for i, j, raw, off in common.runs(pa.array(texts, pa.string())):
        h, first = common.hash_words(raw, off)
        for k in range(j - i):
            w = brute.words(texts[i + k])
            got = h[first[k] : first[k + 1]].tolist()
            assert len(got) == len(w)
            for a, b in zip(w, got):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_have_the_right_sizes():
    texts = [*ODD, "a b a b a b a b a b", prose(500, 3)]
    sets = [s for i, j, raw, off in common.runs(pa.array(texts, pa.string())) for s in common.hash_shingles(*common.hash_words(raw, off))]
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert len(set(sets[5].tolist()) & set(sets[6].tolist())) == 1


# ------------------------------------------------------------------ exact dedup

@pytest.mark.parametrize("copies", [3, 400])
def test_exact_dedup(spark, copies):
    texts = [*ODD, " \n", "one  two\nthree four", *["copy of\tthis"] * copies, *["copy of this"] * copies, *[prose(9, i) for i in range(200)]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    ids[5] = ids[6] = 10_000
    df = docs(spark, texts, ids=ids).withColumnRenamed("lang", "kept").withColumnRenamed("source", "_norm")
    got = exact_dedup.exact_duplicates(df).collect()
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        groups[brute.sha(t)].append(i)
    assert len(got) == len(texts)
    low = lambda g: min((i for i in g if i is not None), default=None)
    for r in got:
        g = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(g), low(g)) and r.doc_id in g and (not r.kept or r.doc_id == r.keep_id)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
    left = exact_dedup.without_copies(df)
    assert left.columns == df.columns and left.count() == len(groups)


def test_exact_dedup_of_repeated_rows_and_none(spark):
    df = docs(spark, ["same"] * 60, ids=[7] * 60)
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == 60 and sum(r.kept for r in got) == 1
    assert exact_dedup.without_copies(df).count() == 1
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0 == exact_dedup.without_copies(df.limit(0)).count()


# ------------------------------------------------------------------ mixing

@pytest.mark.parametrize("seed", range(3))
def test_mixing_hits_its_targets(spark, seed):
    r = random.Random(seed)
    sources = [r.choice(["hot", "hot", "hot", "b", "c", "é", "Z", None, "tiny"][: 9 - seed]) for _ in range(300)]
    texts = [None if i % 50 == 0 else prose(r.randrange(0, 60), i) for i in range(300)]
    df = docs(spark, texts, sources).withColumn("size", common.F.lit(1)).withColumn("taken", common.F.lit("x"))
    rows = mixing.mix_plan(df).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    taken = collections.Counter()
    for x in rows:
        assert x.size == len(brute.words(texts[x.id])) and x.source_size == sizes[x.source] and 0 <= x.taken <= 3 * x.size
        assert x.target == pytest.approx(want[x.source], rel=1e-12)
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and len(rows) == 300
    assert sorted((x.id, x.taken) for x in rows) == sorted((x.id, x.taken) for x in mixing.mix_plan(df.repartition(7)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = collections.Counter()
    for x in out.collect():
        words[x.source] += len(brute.words(x.text))
    assert all(words[s] == taken[s] for s in sizes)


def test_mixing_of_nothing(spark):
    df = docs(spark, [None, "", " "], ["a", "b", None])
    assert {(x.size, x.target, x.taken) for x in mixing.mix_plan(df).collect()} == {(0, 0.0, 0)}
    assert mixing.mixed(df).count() == 0 == mixing.mix_plan(df.limit(0)).count()


# ------------------------------------------------------------------ near duplicates

def check_components(spark, texts):
    want, sizes = brute.components(dict(enumerate(texts)))
    got = minhash.near_duplicates(docs(spark, texts).withColumn("kept", common.F.lit(3)).withColumn("id", common.F.lit("x"))).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_against_all_pairs(spark):
    texts = [*ODD[:8], ODD[10]]
    for g in range(12):
        base = prose(60 + 40 * g, 100 + g)
        texts += [base, base.upper(), base, *[edited(base, e, g + e) for e in (200, 90, 60, 40, 33, 25, 15)], base + " " + prose(10 + 3 * g, g)]
    rng.shuffle(texts)
    check_components(spark, texts)


def test_near_copies_of_an_absent_text(spark):
    """A large group whose members are near the threshold with each other: its buckets are gone through pair by pair."""
    base = prose(150, 77)
    texts = [edited(base, 150 // (1 + i % 5), 1000 + i) for i in range(90)] + [prose(80, i) for i in range(40)]
    old, minhash.BLOCK = minhash.BLOCK, 16
    try:
        check_components(spark, texts)
    finally:
        minhash.BLOCK = old


def test_near_duplicates_odd_rows(spark):
    t = prose(50, 5)
    df = docs(spark, [t, t, t, edited(t, 60, 1), "", None, prose(20, 6)], ids=[4, 4, None, 9, 5, None, 1])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, None, True), (9, 4, False), (5, 5, True), (None, None, True), (1, 1, True)], key=str)
    left = minhash.without_near_copies(df)
    assert left.columns == df.columns and left.count() == 6
    assert minhash.near_duplicates(df.limit(0)).count() == 0 == minhash.without_near_copies(df.limit(0)).count()


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200 + r.randrange(40), 200 + r.randrange(40)) for _ in range(35)]
    r.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {x.id: x.comp for x in minhash.components(links).collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: root(x) for x in linked}


def test_posterior_bounds():
    least = minhash.least_matches(0.75)
    assert list(least) == [32, 64, 96, 128] and all(0.4 < m / n < 0.75 for n, m in least.items())


# ------------------------------------------------------------------ packing

@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_packing_plan(counts):
    slots = packing.plan(counts, 64)
    placed, used = collections.Counter(), collections.defaultdict(list)
    ranks = collections.defaultdict(set)
    for length, rank, seq, times, offset in slots:
        placed[length] += times
        for k in range(times):
            ranks[length].add(rank + k)
            used[seq + k].append((offset, length))
    assert placed == counts and all(ranks[k] == set(range(n)) for k, n in counts.items())
    for items in used.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64 and sum(n > 64 // 3 for _, n in items) <= 2
    least = max(sum(k * n for k, n in counts.items()) / 64, sum(n for k, n in counts.items() if k > 32))  # two of over a half never fit
    assert len(used) <= 1.6 * least + 1


def test_packing(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD[:8], "x" * 30_000, prose(9000, 4), *ODD[10:], *[prose(i * 7 % 600, i) for i in range(120)], *["same"] * 50]
    df = docs(spark, texts).withColumn("piece", common.F.lit(1)).repartition(5)
    rows = packing.pack(df).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, rs in by_doc.items():
        ids = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and [r.start for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist()
        assert sum(r.length for r in rs) == len(ids) and all(r.length == 2048 for r in rs[1:])
        assert [r.ids_crc32 for r in rs] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rs]
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist() and sum(r.length for r in rs) <= 2048
    assert len(by_seq) <= sum(r.length for r in rows) / 2048 + 2
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = _tok.setdefault(0, None) or _tok.setdefault(1, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert packing.token_ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


_tok: dict = {}


# ------------------------------------------------------------------ personal data

@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123459 -.+()@aZ_%é:/"), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find(text) if s[2] in pii.KINDS[:4]] == brute.personal(text)


def test_personal_data(spark):
    texts = [*ODD, "a@b.c@d.e +1 (555) 010-2030 4111 1111 1111 1111 1.2.3.4.5 256.1.1.1", "see https://ex.org/a?b=1). token = \"24be64439e3e49cf46b2d7c90f3602a3\" DE89 3704 0044 0532 0130 00"]
    df = docs(spark, texts).withColumn("spans", common.F.lit(1))
    got = {r.doc_id: r for r in pii.query(df).collect()}
    for i, t in enumerate(texts):
        base = brute.personal(t or "")
        assert got[i].base_sha256 == pii.digest(base) and [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == x for *_, k in base) for x in pii.KINDS[:4]]
    kinds = {s.split(":")[0] for s in got[len(texts) - 1].spans.split(",")}
    assert {"url", "secret", "iban"} <= kinds
    assert pii.query(df.limit(0)).count() == 0
    assert pii.personal_data(docs(spark, ["x@y.zz"] * 2, ids=[None, None])).collect()[0].spans[0].value == "x@y.zz"


# ------------------------------------------------------------------ language model

def test_language_model(spark):
    texts = {i: t for i, t in enumerate([*ODD, *[prose(60, i) for i in range(40)]])}
    df = docs(spark, list(texts.values())).withColumn("train", common.F.lit("x")).withColumn("key", common.F.lit("y"))
    want, n = brute.unigram(texts, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    rows = {r.doc_id: r for r in lm.query(df).collect()}
    for i, (k, known, base) in want.items():
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (k, known, n) and rows[i].base_score == pytest.approx(base, rel=1e-9)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and rows[i].score <= 0


class SlowModel:
    """The model by dictionaries and loops: counts of words after contexts, split by the leaves' bits."""

    def __init__(self, model, texts, train):
        self.m, d = model, model.words
        self.leaf = {int(h): int(r) for h, r in zip(d.hashes, d.ranks)}
        self.bits = [format(int(p) >> (lm.PATH_BITS - int(k)), f"0{int(k)}b") if k else "" for p, k in zip(d.path, d.depth)]
        self.plain = dict(enumerate(d.count.tolist()))
        self.after = collections.defaultdict(collections.Counter)
        for t, learn in zip(texts, train):
            if learn:
                for key, r, _ in self.tokens(t):
                    for k in key:
                        self.after[k][r] += 1

    def tokens(self, text):
        w = brute.words(text)
        hot = set(self.m.hot.tolist())
        h = [int(x) for x in lm.token_hashes([x.lower() for x in w])] if w else []
        for i, x in enumerate([*h, int(lm.END_HASH)]):
            one, two = h[i - 1] if i else int(lm.BOS), h[i - 2] if i > 1 else int(lm.BOS)
            keys = [("one", one)] if one in hot else []
            yield [*keys, ("two", one, two)], self.leaf.get(x, self.m.words.escape), w[i].lower() if i < len(w) else None

    def chances(self, counts, r, less):
        out = []
        for k in range(len(self.bits[r])):
            total = sum(n for x, n in counts.items() if self.bits[x][:k] == self.bits[r][:k]) - less
            hit = sum(n for x, n in counts.items() if self.bits[x][: k + 1] == self.bits[r][: k + 1]) - less
            out.append((np.log((hit + lm.DELTA) / (total - hit + lm.DELTA)), total) if total > 0 else (0.0, 0))
        return out

    def score(self, text, learn):
        w, bits, block, lo, at = None, 0.0, lm.FIRST_BLOCK, 0, 0
        w = {g: self.m.start[g].astype(np.float32).astype(float) for g in range(lm.GATES)}
        grad, seen = collections.defaultdict(lambda: np.zeros(3)), collections.Counter()
        for keys, r, word in self.tokens(text):
            if at == lo + block:
                for g, v in grad.items():
                    w[g] = w[g] + lm.RATE * v / (seen[g] + 32)
                grad, seen, lo, block = collections.defaultdict(lambda: np.zeros(3)), collections.Counter(), at, lm.BLOCK
            one = self.chances(self.after[keys[0]], r, learn) if len(keys) == 2 else [(0.0, 0)] * len(self.bits[r])
            two = self.chances(self.after[keys[-1]], r, learn)
            for (p, _), (a, n), (b, m) in zip(self.chances(self.plain, r, 0), one, two):
                g = int(lm._GATE[min(n, 255)]) * lm.LEVELS + int(lm._GATE[min(m, 255)])
                x = np.array([p, a, b])
                z = float(w[g] @ x)
                bits += np.log2(1 + np.exp(-z))
                grad[g] += x / (1 + np.exp(z))
                seen[g] += 1
            if r == self.m.words.escape:
                raw = list(word + b" ")
                for i, byte in enumerate(raw):
                    before = (raw[i - 2] if i > 1 else 32) << 8 | (raw[i - 1] if i else 32)
                    bits += float(self.m.speller.cost_of[self.m.speller.row_of[before], byte])
            at += 1
        return -bits * np.log10(2)


def test_language_model_against_a_slow_one(spark):
    """All scores, with chunks and parts so small that counts cross them; some words are not in the dictionary."""
    r = random.Random(12)
    texts = [" ".join(r.choices(VOCAB[:60], k=r.randint(0, 260))) + r.choice(["", " zebra Ünd", " x" * 5]) for _ in range(50)]
    texts += [texts[3], texts[3], texts[7] + " more", None, "", "one", prose(700, 4)]
    train = [i % 4 != 1 for i in range(len(texts))]
    df = docs(spark, texts)
    kept, seen = (lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT), []
    lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT = 90, 2000, 3000, 4
    take = spark.sparkContext.broadcast
    try:
        spark.sparkContext.broadcast = lambda x: seen.append(x) or take(x)
        rows = {x.id: x for x in lm.score_texts(df, common.F.col("doc_id") % 4 != 1).collect()}
    finally:
        spark.sparkContext.broadcast = take
        lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT = kept
    model = next(x for x in seen if isinstance(x, lm.Model))
    assert 0 < model.words.count[model.words.escape] and model.parts >= 4
    slow = SlowModel(model, texts, train)
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(slow.score(t, train[i]), rel=2e-4), i
    # what occurs elsewhere too costs far less than what does not
    assert rows[3].bits_per_byte < 0.5 * rows[4].bits_per_byte


class SlowModelOfEveryWord(SlowModel):
    """Last words that are not among the very frequent ones are contexts too, words out of the dictionary as well."""

    def tokens(self, text):
        for (*_, two), r, word in super().tokens(text):
            yield [("one", two[1]), two], r, word


def test_every_last_word_is_a_context(spark):
    """Scores of the query: no last word goes without its own counts, whatever the number of those that are broadcast."""
    r = random.Random(21)
    texts = [" ".join(r.choices(VOCAB[:60], k=r.randint(0, 200))) + r.choice(["", " zebra Ünd", " x" * 5]) for _ in range(40)]
    texts += [texts[3], None, "", "one", "zebra one zebra one"]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    kept, seen = (lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT), []
    lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT = 50, 2000, 3000, 4
    take = spark.sparkContext.broadcast
    try:
        spark.sparkContext.broadcast = lambda x: seen.append(x) or take(x)
        rows = {x.doc_id: x for x in lm.query(docs(spark, texts)).collect()}
    finally:
        spark.sparkContext.broadcast = take
        lm.HEAD, lm.CHUNK_BYTES, lm.PART_BYTES, lm.HOT = kept
    model = next(x for x in seen if isinstance(x, lm.Model))
    slow = SlowModelOfEveryWord(model, texts, train)
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(slow.score(t, train[i]), rel=2e-4), i


def test_weights_are_learned_from_all_training_texts(spark, monkeypatch):
    """Starting weights are those of all bits of all training texts, long ones too, not of a sample's; so are those of spelled bytes."""
    monkeypatch.setattr(lm, "SAMPLE_TEXTS", 2)
    texts = [prose(50, i) for i in range(40)] + [prose(9000, 99), None, ""] + [" ".join(VOCAB[:9]) for _ in range(20)]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    seen, take, bits = [], spark.sparkContext.broadcast, []
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: seen.append(x) or take(x))
    kept = lm.learned_of_sums
    monkeypatch.setattr(lm, "learned_of_sums", lambda n, x, start: bits.append(n.sum()) or kept(n, x, start))
    lm.query(docs(spark, texts).coalesce(1))
    model = next(x for x in seen if isinstance(x, lm.Model))
    read = list(lm.read_texts(model, pa.array([t or "" for t, x in zip(texts, train) if x]), np.ones(sum(train), bool)))
    t, rank, learn = (np.concatenate([r[k] for r in read]) for k in (2, 4, 5))
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r[3]) for r in read]))])
    x, gate, _ = lm.predictors(model, t, begin, rank, learn, model.found).slice(np.arange(len(t)))
    words = {w for t, x in zip(texts, train) if x for w in brute.words(t)}
    triples = {(w + b" ")[max(i - 2, 0) : i + 1].rjust(3) for w in (w.lower() for w in words) for i in range(len(w) + 1)}
    assert len(t) > 9000 and bits[1] == len(gate) == model.words.depth[rank].sum() and bits[0] >= 8 * len(triples)
    want = lm.learned(np.stack(x, 1), gate, lm.PRIOR)
    # weights of sums differ a little from those of single bits; what matters is the cost that they give
    cost = lambda w: float(lm.bit_costs((np.stack(x, 1) * w[gate]).sum(1)).sum())
    assert cost(model.start) - cost(want) < 0.05 * (cost(lm.PRIOR) - cost(want))


def test_answers_say_once_what_neighbours_share():
    r = np.random.RandomState(5)
    path, _ = lm.branches(r.randint(1, 1000, 300))
    for some in (1, 7, 400):
        pair = np.unique(r.randint(0, 3 * 300, some))
        context, rank = pair // 300, pair % 300
        w = lm.ways(context, rank, r.randint(0, 4, len(pair)), path)
        asked = np.flatnonzero(r.rand(len(pair)) < 0.6)
        w, part = w.take(asked), lm.partings(context[asked], path[rank[asked]])
        few = lm.unshared(w, part)
        again = lm.shared(few, part)
        assert all((getattr(again, k) == getattr(w, k)).all() for k in ("own", "edge", "depth", "drop")) and (some < 400 or len(few.drop) < 0.8 * len(w.drop))


def test_answers_leave_out_what_the_chunk_can_add_up():
    """With all pairs of a context at hand nothing falls elsewhere; questions are read back as they were."""
    r = np.random.RandomState(6)
    path, _ = lm.branches(r.randint(1, 1000, 300))
    pair = np.unique(r.randint(0, 40 * 300, 3000))
    w, part = lm.ways(pair // 300, pair % 300, r.randint(0, 4, len(pair)), path), lm.partings(pair // 300, path[pair % 300])
    few = lm.unshared(w, part)
    again = lm.shared(few, part)
    assert len(few.drop) == 0 < len(w.drop) and all((getattr(again, k) == getattr(w, k)).all() for k in ("own", "edge", "depth", "drop"))
    words = [f"w{i}" for i in range(300)]
    model = lm.Model(lm.Dictionary({w.encode(): int(r.randint(1, 99)) for w in words}, 9, 20_000, 300), np.zeros(1, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), None, 32, 4)
    for n in (0, 1, 5000):
        pairs = np.unique(r.randint(0, 900, n).astype(np.uint64) << np.uint64(lm.RANK_BITS + 20) | r.randint(0, 300, n).astype(np.uint64))
        assert (model.unpack(*model.pack(pairs)) == pairs).all()


def test_slices_of_a_chunk_change_no_score(spark, monkeypatch):
    """Chunks are asked and answered as a whole, but taken in and scored a few texts at a time."""
    texts = docs(spark, [prose(90, i) for i in range(30)] + [None, "one"])
    seen, take = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: seen.append(x) or take(x))
    lm.query(texts)
    model = next(x for x in seen if isinstance(x, lm.Model))
    batch = texts.selectExpr("doc_id id", "coalesce(text, '') text", "crc32(cast(string(doc_id) as binary)) % 5 != 1 train").toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    scores = []
    for size in (1 << 20, 50):
        for k in ("SLICE", "MERGED", "BATCH_BYTES"):
            monkeypatch.setattr(lm, k, size)
        rows = pa.Table.from_batches(lm._ask(lambda: model)(iter(batch)))
        sent = {p: rows.filter(pc.equal(rows["key"], p)) for p in set(rows["key"].to_pylist())}
        answers = pa.concat_tables([lm._answer(lambda: model)([pa.scalar(p)], x) for p, x in sent.items() if p >= 0])
        scores.append(lm._score(lambda: model)(None, sent[-1], answers))
    assert scores[0].num_rows == 32 and scores[0].equals(scores[1])


def test_codes_are_a_distribution():
    """Chances of all leaves in any context add up to one, and the costs of all bytes too."""
    r = np.random.RandomState(3)
    count = r.randint(1, 1000, 300)
    path, depth = lm.branches(count)
    assert sum(2.0 ** -int(k) for k in depth) == 1 and (np.diff(path.astype(object)) > 0).all()
    assert abs((depth * count).sum() / count.sum() + (count / count.sum() * np.log2(count / count.sum())).sum()) < 1
    w = lm.ways(np.repeat(np.arange(2), 300), np.tile(np.arange(300), 2), np.concatenate([count, r.randint(0, 3, 300)]), path)
    x, _ = lm.stretched(w, np.arange(600), np.tile(depth, 2).astype(np.int32), np.zeros(600, np.int32))
    p = np.add.reduceat(-lm.bit_costs(x * 0.7), np.concatenate([[0], np.cumsum(np.tile(depth, 2))[:-1]]))
    assert np.exp(p[:300]).sum() == pytest.approx(1, abs=1e-4) == np.exp(p[300:]).sum()
    speller = lm.Speller(r.randint(0, 1 << 16, 500), r.randint(0, 256, 500), r.randint(1, 9, 500))
    assert np.exp2(-speller.cost_of.astype(np.float64)).sum(1) == pytest.approx(1, abs=1e-4)


def test_language_model_of_nothing(spark):
    df = docs(spark, ["a b", None], ids=[None, None])
    none = lm.score_texts(df, common.F.lit(False)).collect()
    assert len(none) == 2 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert lm.query(df.limit(0)).count() == 0


# ------------------------------------------------------------------ quality

def rated(n):
    """Junk in capitals, insults, and prose."""
    out = []
    for i in range(n):
        t = prose(40 + i % 60, i)
        if i % 4 == 0:
            t, g = t.upper().replace(" ", "!! "), 0
        elif i % 4 == 1:
            w = t.split()
            w[3], w[20] = "vermin", "dolt"
            t, g = " ".join(w), 1
        else:
            g = 2
        out.append((i, t, g))
    return out


def test_quality(spark):
    rows = rated(900)
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int").withColumn("id", common.F.lit("z")).withColumn("kept", common.F.lit(1))
    model = quality.train(df, df.filter("doc_id < 600").select("doc_id", "grade"))
    assert np.all(np.diff(model.cuts) > 0)
    got = {r.id: r for r in quality.grades(df, model).collect()}
    test = [(got[i], g) for i, _, g in rows if i >= 600]
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r, _ in test)
    for g in range(3):
        right = np.mean([r.kept == (g == 2) for r, x in test if x == g])
        assert right > 0.95
    left = quality.selected(df, model)
    assert left.columns == df.columns and left.count() == sum(r.kept for r in got.values())
    graded = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (None, 0), (1, None), (0, None)], "quality int, toxic int").withColumn("g", quality.grade()).collect()
    assert [r.g for r in graded] == [0, 1, 2, None, None, 0]
    odd = docs(spark, ODD, ids=[None, None, *range(len(ODD) - 2)])
    kept = quality.grades(odd, model).collect()
    assert len(kept) == len(ODD) and not any(r.kept for r in kept[:3])
    assert quality.grades(odd.limit(0), model).count() == 0
    assert quality.grades(odd, quality.train(df, df.limit(0).select("doc_id", "grade"))).count() == len(ODD)


# ------------------------------------------------------------------ licences

def wrapped(paragraphs):
    return "\n\n".join(textwrap.fill(x, 72) for x in paragraphs)


def test_licences(spark):
    lines = [(f, n) for f in licenses.FAMILIES for n in licenses.NOTICES[f]]
    whole = {f: wrapped(licenses.TEXTS[f]) for f in licenses.TEXTS if f != "unknown"}
    texts = [*ODD, *[f"{prose(12, i)}\n{n}\n{prose(9, i)}" for i, (_, n) in enumerate(lines)], *whole.values(), "Licensed under the Foo Community License.", "émit mit MIT", "She lost her driver license again.",
             *[t for ts in licenses.CALIBRATION.values() for t in ts], "GPL-3.0-only", "x\n \t\nReleased under the MIT\nLicense.", wrapped(licenses.TEXTS["mit"]).split("\n")[0]]
    df = docs(spark, texts).withColumn("family", common.F.lit(1)).withColumn("gram", common.F.lit(2)).withColumn("row", common.F.lit(2))
    want = sorted((i, *r) for i, t in enumerate(texts) for r in licenses.judge(t or ""))
    got = sorted(tuple(r) for r in licenses.scan(df).select("doc_id", "paragraph", "first_word", "last_word", "family", "probability", "containment", "confirmed").collect())
    assert got == want
    family = collections.defaultdict(list)
    for r in got:
        family[r[0]].append(r[4])
    wrong = [n for i, (f, n) in enumerate(lines) if family[len(ODD) + i] != [f]]
    assert len(wrong) <= 0.05 * len(lines), wrong
    for i, (f, t) in enumerate(whole.items(), len(ODD) + len(lines)):  # hard-wrapped texts: every paragraph is its licence's
        assert family[i] == [f] * len(licenses.TEXTS[f]), (f, family[i])
    end = len(texts) - 3
    assert family[end] == ["gpl"] and family[end + 1] == ["mit"] and family[end + 2] == ["mit"]
    assert [r[3] for r in licenses.judge("Licensed under the Foo Community License.")] == ["unknown"] and not licenses.judge("She lost her driver license again.")
    assert licenses.scan(docs(spark, ["Released under the MIT License."] * 3, ids=[1, 1, None])).count() == 3
    assert licenses.scan(df.limit(0)).count() == 0


def test_licences_on_texts_not_trained_on():
    found = {c: [{r[3] for r in licenses.judge(t)} for t in ts] for c, ts in licenses.CALIBRATION.items()}
    rows = [(c, f) for c, fs in found.items() if c != "none" for f in fs]
    assert sum(bool(f) for _, f in rows) >= 0.9 * len(rows)  # found as a licence
    assert sum(c in f for c, f in rows) >= 0.85 * len(rows)  # and as the right one
    assert sum(bool(f) for f in found["none"]) <= 1


# ------------------------------------------------------------------ recall by the index

@pytest.mark.parametrize("kind", ["clustered", "uniform", "a third identical"])
def test_recall_of_full_blocks(spark, kind):
    """With the parameters as they are, on blocks that are ranked by the index and not searched whole."""
    n, dim, r = 4 * 8192, 64, np.random.RandomState(1)
    x = r.randn(n, dim)
    if kind == "clustered":
        x = r.randn(200, dim)[r.randint(0, 200, n)] + 0.4 * x
    elif kind != "uniform":
        x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).repartition(2).cache()
    asked = r.choice(n, 40, replace=False).tolist()
    rows = ann.nearest(df, df.filter(common.F.col("vec_id").isin(asked)), 10).collect()
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += sum(d[v] <= np.sort(d)[9] + 1e-9 for v in {y.vec_id for y in rows if y.query_id == q})
    df.unpersist()
    assert ann.SHARE < 0.2 and hits / (10 * len(asked)) >= 0.9


# ------------------------------------------------------------------ pages

def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style>{head}</head><body>{body}</body></html>"


BODY = "<article><h1>Title&nbsp;one</h1><p>First <b>bold</b>\n  text with enough words to count.<br>Next line.<p>Second &lt;para&gt; of the text, unclosed <i>i</p><ul><li>One</li><li>Two</li></ul><table><tr><td>c1</td><td>c2</td></tr></table></article>"
WANT = "Title one\n\nFirst bold text with enough words to count. Next line.\n\nSecond <para> of the text, unclosed i\n\nOne\n\nTwo\n\nc1\n\nc2"
AROUND = ("<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site name</header><div class='ad'>Buy this now, it is very cheap and very good.</div>", "<aside class=sidebar><p>More links to read about all this.</p></aside><div id='cookie-notice'>We use cookies and more cookies.</div>"
          "<section class='comments'><p>Reader says that this is a long and winding comment, much longer than the article itself would ever have been in its days.</p></section><form><label>Name</label><input></form><script>var a='</p><p>x';</script><footer>&copy; me</footer>")


def test_main_text(spark):
    pages = [page(AROUND[0] + BODY + AROUND[1]), page(AROUND[0].replace("div class='ad'", "div class=\"ad ad-12\"") + BODY + AROUND[1]), None, "", "just text &amp; more", "<p>loose</p>", page("<div class='content'><p>" + "word " * 50_000 + "</p></div>" + AROUND[1]), page(AROUND[0] + AROUND[1])]
    rows = [(i, f"https://h.example/{i}" if i != 4 else None, p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", common.F.lit(1)).withColumn("text", common.F.lit("t"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[0].text == WANT == got[1].text and got[0].n_chars == len(WANT) and got[0].url == "https://h.example/0"
    assert got[2].text == got[3].text == "" and got[4].text == "just text & more" and got[5].text == "loose"
    assert got[6].text == ("word " * 50_000).strip() and got[7].text == ""
    assert html.extract(df.limit(0)).count() == 0
    assert html.extract(df.union(df)).count() == 2 * len(pages)


def test_host_paths_outvote_a_page(spark):
    """A page whose sidebar outgrows its article follows the path that its host elected."""
    usual = "<div class='x'><div class='story'><p>" + "story text " * 30 + "</p></div><div class='rail'><p>rail</p></div></div>"
    odd = "<div class='x'><div class='story'><p>short story</p></div><div class='rail'><p>" + "rail text " * 90 + "</p></div></div>"
    rows = [(i, "http://h.example/a", page(usual)) for i in range(5)] + [(9, "http://H.example:80/b", page(odd)), (10, "http://other.example/b", page(odd))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short story" and got[10].startswith("rail text")


# ------------------------------------------------------------------ neighbours

def test_neighbours(spark):
    r = np.random.RandomState(2)
    centres = r.randn(30, 16)
    x = np.concatenate([c + 0.2 * r.randn(40, 16) for c in centres] + [np.tile(r.randn(1, 16), (300, 1))]).astype(np.float32)
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    bad = [(5000, None, ""), (5100, [0.0] * 16, ""), (5200, [float("nan")] + [1.0] * 15, ""), (5300, [float("inf")] + [1.0] * 15, ""), (5400, [None] + [1.0] * 15, ""), (5500, [1.0, 2.0], ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for t in ann.nearest(df, df.filter("vec_id % 20 = 0"), block_rows=300).orderBy("query_id", "rank").collect():
        got[t.query_id].append((t.rank, t.vec_id, t.score))
    hit = total = 0
    y = x.astype(np.float64)
    for q in range(0, len(x), 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [k for k, *_ in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in got[q]) and got[q] == sorted(got[q], key=lambda g: (g[2], g[1]))
        hit, total = hit + len({v for _, v, _ in got[q]} & set(best)), total + 10
    assert hit / total >= 0.9 and set(got) == set(range(0, len(x), 20))
    few = df.filter("vec_id < 4 or vec_id >= 5000")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 == ann.nearest(df, df.limit(0)).count()


# ------------------------------------------------------------------ queries

def test_sql_twins(spark, tmp_path):
    r = random.Random(4)
    texts = [*ODD[:8], *[prose(r.randrange(0, 50), i % 30) for i in range(150)], *["dup  x"] * 30, "Released under the MIT License.\nx", "the license of a Foo"]
    df = docs(spark, texts, [r.choice(["a", "b", "c", "d", None]) for _ in texts])
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name, sql in queries.oracles().items():
        got, want = queries.QUERIES[name](spark, str(tmp_path)), con.execute(sql)
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(got.columns)
        # rows as they are: a table of pandas would make floats of whole numbers beside nulls
        assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.fetchall())), name


# ------------------------------------------------------------------ pages: pieces, weak names, time

class Dom(HTMLParser):
    """A plain reading of well-formed pages: what stands in no boilerplate element, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.text.append(" " if tag == "br" else "")
            return
        a = dict(attrs)
        bad = tag in html.SILENT | html.AROUND or "hidden" in a or any(c in html.NOISE for c in (a.get("class") or "").split())
        if tag in html.BLOCK:
            self.flush()
        self.open.append((tag, bad or bool(self.open) and self.open[-1][1]))

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        if tag not in html.VOID:
            self.open.pop()

    def handle_data(self, data):
        if not self.open or not self.open[-1][1]:
            self.text.append(data)

    def flush(self):
        t = " ".join("".join(self.text).split())
        self.out += [t] if t else []
        self.text = []


def test_pages_against_a_plain_reading():
    r = random.Random(3)

    def inline(depth):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(prose(r.randint(1, 5), r.random()) + r.choice(["", " &amp; ", "<br>"]))
            if depth and r.random() < 0.4:
                tag = r.choice(["b", "i", "span", "em", "select", "button", "math", 'span class="advert"', "span hidden", 'a class="share"'])
                parts.append(f"<{tag}>{inline(depth - 1)}</{tag.split()[0]}>")
        return " ".join(parts)

    def block(depth):
        kind = r.choice(["p", "h2", "blockquote", "div", "section", "ul", "nav", 'div class="ad"', "form", "aside"])
        if kind == "ul":
            inner = "".join(f"<li>{inline(1)}</li>" for _ in range(2))
        elif depth and kind in ("div", "section"):
            inner = "".join(block(depth - 1) for _ in range(r.randint(1, 3)))
        else:
            inner = inline(2)
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    for _ in range(300):
        body = "<article>" + "".join(block(2) for _ in range(r.randint(1, 5))) + "</article>"
        dom = Dom()
        dom.feed(page(body))
        dom.flush()
        assert html.text_at(html.parse(page(body)), None) == "\n\n".join(dom.out)


@pytest.mark.parametrize("source, want", [
    ('<p>a <span class="advert">BUY NOW</span> b</p>', "a b"), ("<p>a <select><option>x<option>y</select> b <button>k</button></p>", "a b"),
    ('<p>a <span hidden>z</span><a class="share">s</a> b</p>', "a b"), ("<p>a <math>m</math><video>v</video> b</p>", "a b"),
    ('<div class="side"><p>only text</p></div>', "only text"), ('<div class="legal"><p>only text</p></div>', "only text"),
    ('<article><p>one</p><p class="social-science">two</p></article>', "one\n\ntwo"),
    ("<div><p>lead</p><div class=b><p>" + "long " * 60 + "</p></div></div>", "lead\n\n" + ("long " * 60).strip()),
    ("<article><header><h1>H</h1></header><div><p>" + "long " * 60 + "</p></div></article>", "H\n\n" + ("long " * 60).strip()),
    ('<div class="comment-list"><p>c</p></div>', ""), ("a < b && c <3 d", "a < b && c <3 d"), ("<ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table>", "One\n\nTwo\n\nc1\n\nc2"),
])
def test_what_a_page_says(source, want):
    assert html.text_at(html.parse(source), None) == want


@pytest.mark.parametrize("source", ["<a " * 350_000, '<a "' * 250_000, "<a \">' " * 150_000, "<div>x" * 150_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<div>" * 100_000 + "</section>" * 100_000,
                                    "<i>" * 100_000 + "<p></p>" * 100_000, "<" * 1_000_000, "<script>" * 100_000, '<p class="' + "a " * 400_000 + '">x'])
def test_hostile_pages_take_seconds(source):
    began = time.process_time()
    html.text_at(html.parse(source), None)
    assert time.process_time() - began < 15


# ------------------------------------------------------------------ quality: words of all scripts

def word_features(text):
    """Even buckets: words and their beginnings."""
    out = []
    for _, _, raw, off in common.runs(pa.array([text])):
        _, bucket, _ = quality.run_features(raw, off)
        out += [b for b in bucket.tolist() if b % 2 == 0]
    return sorted(out)


@pytest.mark.parametrize("a, b", [("“scum”", "scum"), ("scum…", "scum"), ("—scum—", "scum"), ("«Müll»", "müll"), ("ÉTÉ", "été"), ("ПРИВЕТ", "привет"), ("ΑΒΓΔ！", "αβγδ"), ("Scum.", "scum"), ("¿Qué?", "qué")])
def test_words_share_features_whatever_stands_around_them(a, b):
    assert word_features(a) == word_features(b) and word_features(a) != word_features(b + "x")


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAzÉßİŁ汉Я“”…«ﬁ \n."), max_size=30))
def test_folding_keeps_the_bytes_in_place(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    low, cls = quality.folded(raw)
    want = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text).encode()
    assert len(low) == len(raw) == len(cls) and (low.tobytes() == want or text.lower().encode() == low.tobytes())


def ordinal_loss(par, rows, grades):
    """The negative log likelihood of the cumulative link, written out."""
    w, cuts = par[:-2], [par[-2], par[-2] + np.exp(par[-1])]
    total = 0.0
    for x, y in zip(rows, grades):
        z = float(np.dot(w, x))
        below = [0.0] + [1 / (1 + np.exp(-(c - z))) for c in cuts] + [1.0]
        total -= np.log(max(below[y + 1] - below[y], 1e-12))
    return total


def test_ordinal_fit_against_plain_descent():
    """On few features the sparse fit grades like a plain minimiser of the written-out likelihood."""
    r = np.random.RandomState(5)
    x = r.rand(400, 3)
    y = np.digitize(x @ [3.0, -2.0, 0.0] + r.logistic(size=400) * 0.3, [-0.2, 1.0])
    par = np.zeros(5)
    for step in range(400):
        g = np.array([(ordinal_loss(par + 1e-5 * e, x[:, :], y) - ordinal_loss(par - 1e-5 * e, x, y)) / 2e-5 for e in np.eye(5)])
        par -= 0.01 * g / np.sqrt(1 + (g**2).mean())
        if step > 150 and np.abs(g).max() < 1:
            break
    m = quality.fit([(np.array([2, 4, 6]), v, int(k)) for v, k in zip(x, y)], steps=3000)
    a, b = x @ par[:3], x @ m.weights[[2, 4, 6]]
    assert np.corrcoef(a, b)[0, 1] > 0.98 and (np.diff(m.cuts) > 0).all()


# ------------------------------------------------------------------ near-duplicates: large buckets in blocks

def test_large_buckets_in_blocks(spark):
    """Groups without a hub, in buckets of many small blocks, against all pairs."""
    texts = []
    for g in range(4):
        words_ = prose(60, 100 + g).split()
        for i in range(45):  # a chain: each is near the next ones only
            w = words_[:]
            for k in range(i // 3):
                w[(7 * k) % 60] = f"g{g}k{k}"
            texts.append(" ".join(w))
    want, _ = brute.components(dict(enumerate(texts)))
    kept = minhash.BLOCK, minhash.BLOCK_BYTES, minhash.HUB
    minhash.BLOCK, minhash.BLOCK_BYTES, minhash.HUB = 4, 4000, 3
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    finally:
        minhash.BLOCK, minhash.BLOCK_BYTES, minhash.HUB = kept
    assert got == want


# ------------------------------------------------------------------ packing: every character

def test_both_tokenizers_agree_on_every_character():
    """Each code point beside letters, digits, marks and spaces, where its class decides how words are cut."""
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for i in range(0, len(every), 500):
        part = every[i : i + 500]
        text = "".join(f"a{c}b 1{c}2 .{c}! {c}{c}x  {c} \n" for c in part)
        if packing.token_ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids:
            continue
        wrong += [hex(ord(c)) for c in part if packing.token_ids(t := f"a{c}b 1{c}2 .{c}! {c}{c}x  {c} \n").tolist() != tok.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:20])
