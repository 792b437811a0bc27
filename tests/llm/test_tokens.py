"""Fill-in-middle and byte-pair encoding against plain forms and the tokenizers library."""

import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import bpe, fim, queries

PATH = public_tokenizers.path(bpe.VOCABULARY)
ODD = [None, "", " ", "<P>", "a<S>b", "x<M", "<|endoftext|>", "a<|startoftext|>b 's", "ΑΣ Σ", "İstanbul K 'S", "汉字 " * 50, "é" * 40, "̸" * 700, "\x00\x1c\x85\xa0　x", "x" * 300_000, "ab " * 60_000, "ᄀ" + "ᅡ" * 9, "-'" * 50, "12345", "''''s 'tis", "😀é" * 30, "same", "same"]
DOCS = "doc_id long, text string, n long, form string, ids string, h1 string, output string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, 7, "x", "y", "z", "w") for i, t in enumerate(texts)], DOCS)


def packed(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ------------------------------------------------------------------ fill in the middle

def plain_units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def plain_fim(doc, text, unit="char", seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = plain_units(text, unit)
    n = len(u)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fim(spark, unit):
    r = random.Random(4)
    texts = [*ODD, *["".join(r.choices("ab<>SPM \nä汉😀", k=r.randrange(80))) for _ in range(300)]]
    ids = [None, *range(-1, len(texts) - 3), 5]
    got = fim.transform(frame(spark, texts, ids), unit).withColumn("back", fim.restored()).collect()
    assert [r.doc_id for r in got] == ids
    for row, doc, text in zip(got, ids, texts):
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plain_fim(doc, text or "", unit) and row.back == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_nothing_and_unknown_units(spark):
    assert fim.query(frame(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(frame(spark, ["a"]), "page")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 420))
def test_places_of_ranked_bits(raw, rank):
    bits = fim.mask(raw, fim._INK)
    want = [i for i, b in enumerate(raw) if not bytes([b]).isspace()]
    assert bits.bit_count() == len(want)
    assert fim.place(bits, len(raw), rank) == (want[rank] if rank < len(want) else len(raw))


def test_fim_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_fim"])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES["op11_fim"](spark, "/root/testdata/sf0.001").select(*cols).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])


# ------------------------------------------------------------------ byte-pair encoding

def test_bpe_rows(spark, library):
    r = random.Random(2)
    texts = [*ODD, *["".join(r.choices("aeinrst' .é", k=r.randrange(200))) for _ in range(100)]]
    ids = [None, *range(len(texts) - 2), 3]
    encoded = bpe.encode(frame(spark, texts, ids))
    got = bpe.decode(encoded).collect()
    assert [r.doc_id for r in got] == ids
    for row, text in zip(got, texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert row.ids == want and row.decoded == library.decode(want, skip_special_tokens=False)
    digest = bpe.query(frame(spark, texts, ids)).collect()
    for row, text in zip(digest, texts):
        raw = packed(library, text or "")
        back = library.decode(np.frombuffer(raw, "<u4").tolist(), skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.query(frame(spark, ["a"]).limit(0)).count() == 0


def test_bpe_on_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: hashlib.sha256(packed(library, r.text or "")).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in queries.QUERIES["op12_bpe"](spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_long_words_in_blocks_of_any_size(library, seed):
    r = random.Random(seed)
    machine = bpe.Encoder(PATH, step=[1, 40, 900][seed % 3])
    for alphabet in ("ab", "etaoin", "etaoinshrdlucmfwypvbgkjqxz", "aé'!-.s ", "-=", ["é", "é", "ß", "Σ", "汉", "1", "'s", "<|endoftext|>", "<|end", "̸", " ", "ᅡ", "ᄀ", "x", "'"]):
        text = "".join(r.choices(alphabet, k=3000))
        want = packed(library, text)
        for block in (1, 7, 64, 1000):
            assert b"".join(machine.encode(text, block)) == want
            assert len(machine.merger.held) == 0


def test_what_the_encoder_holds_is_bounded(encoder):
    most = 0
    m = bpe.Merger(encoder.rules, 16)
    r = random.Random(1)
    for _ in range(300):
        for _ in m.feed("".join(r.choices("etaoinshrdlu", k=37))):
            pass
        most = max(most, len(m.held))
    assert most <= 16 + encoder.rules.lookahead + encoder.rules.longest and encoder.rules.lookahead < 1000


def test_no_boundary_behind_the_lookahead_moves(encoder):
    """Continuations of all kinds leave boundaries beyond the bound where they are."""
    rules, r = encoder.rules, random.Random(3)
    ends = lambda symbols: set(np.cumsum([rules.length[c] for c in symbols]).tolist())
    for _ in range(150):
        head = "".join(r.choices("etaoinshrdlucm"[: r.choice([2, 5, 14])], k=rules.lookahead + 60))
        fixed = None
        for _ in range(6):
            tail = "".join(r.choices("etaoinshrdlucm", k=r.randrange(1, 40)))
            now = {e for e in ends(rules.merge(head + tail)) if len(head) - e > rules.lookahead}
            assert fixed is None or now == fixed
            fixed = now


def test_both_ways_of_merging_agree(encoder):
    rules, r = encoder.rules, random.Random(5)
    for _ in range(300):
        word = "".join(r.choices("aehnt", k=r.randrange(bpe.SHORT + 1, 90)))
        assert rules.merge(word) == rules._merge_few(word)


def test_every_character_and_where_composition_may_be_cut(library, encoder):
    chars = [chr(c) for c in range(0xF0000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 20_000):
        text = "".join(f"a{c}1{c}!{c} " for c in chars[at : at + 20_000] if c not in "<|")
        assert b"".join(encoder.encode(text)) == packed(library, text)
    seconds = {unicodedata.normalize("NFD", c)[1] for c in chars if unicodedata.is_normalized("NFC", c) and len(unicodedata.normalize("NFD", c)) > 1}
    assert not any(bpe.starts_anew(c) for c in seconds)


def test_decoder_in_pieces(library):
    r = random.Random(6)
    plain, readable = bpe.Decoder(PATH), bpe.Decoder(PATH, readable=True)
    for _ in range(50):
        ids = [r.randrange(49_408) for _ in range(200)]
        for machine in (plain, readable):
            whole = machine.feed(ids) + machine.close()
            out = "".join(machine.feed(ids[a : a + 3]) for a in range(0, 200, 3)) + machine.close()
            assert out == whole
        assert plain.feed(ids) + plain.close() == library.decode(ids, skip_special_tokens=False)
    assert plain.feed([320, None, 10**9, 321]) + plain.close() == library.decode([320, 321])
    text = "hello wörld 汉字 😀 it 's 12"
    ids = library.encode(text, add_special_tokens=False).ids
    out = "".join(readable.feed([i]) for i in ids) + readable.close()
    assert out == "hello wörld 汉字 😀 it 's 1 2 "
