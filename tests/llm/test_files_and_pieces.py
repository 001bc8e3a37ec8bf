"""Token files, WARC archives and piece encoding against the libraries, and exact round trips."""

import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import queries, token_file
from tidemark.llm.common import new_path, read_table
from tidemark.llm.piece_bpe import Encoder, encode_decode
from tidemark.llm.token_file import WordTokenizer, pack, read_tokens, unpack, write_tokens
from tidemark.llm.warc import read_warc, write_warc

WORDS = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
PIECES = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
ODD = ["", " ", "\n", "a", "  two  blanks ", "Ünïcode ß ſ İ ǅ", "don't can't I'll 'S", "a1b2 3.14 x_y", "<|endoftext|> <|startoftext|>", "▁ ▁▁ a▁b", "日本語 テスト", "  ​﻿", "é ﬁ ①", "👩‍👩‍👧 🏳️‍🌈", "\x00\x01\x1f\x7f\x85", "!!! ### &&&***", "a|b | c ||", "x" * 3000, " " * 70 + "y" + " " * 33, "ab " * 2000]
text = st.text(st.one_of(st.sampled_from(" \n\t'aAbéßZ09|.,!▁"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=4))
def test_word_tokenizer_is_the_library(texts):
    own = WORD.encode(texts)
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, WORD.kind).tolist() for x in own] == want


WORD, LIBRARY = WordTokenizer(WORDS), Tokenizer.from_str(WORDS)
ENCODER, SP = Encoder(PIECES), sentencepiece.SentencePieceProcessor(model_proto=PIECES)


def pieces_agree(texts):
    for t, x in zip(texts, ENCODER.encode(texts), strict=True):
        ids = np.frombuffer(x, "<i4")
        want = SP.encode(t, add_eos=True)
        assert ids.tolist() == want, repr(t)
        assert ENCODER.model.decode(ids) == SP.decode(want), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=4))
def test_piece_encoder_is_the_library(texts):
    pieces_agree(texts)


def test_piece_encoder_on_odd_texts_and_long_words():
    rng = random.Random(1)
    pieces_agree(ODD)
    pieces_agree(["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for letters in ("ab", "aeiouthsn", "the and", "▁ a", "ññééüß") for _ in range(80)])


def test_words_of_many_thousand_characters_are_quick_and_right():
    rng = random.Random(3)
    for word in ("the" * 20_000, "".join(rng.choice("aeiouthsn") for _ in range(30_000)), "日本語ñ" * 1_000, "x" * 5_000):
        began = time.process_time()
        pieces_agree([f"a {word} b", word])
        assert time.process_time() - began < 20


def test_queue_and_rounds_agree():
    rng = random.Random(6)
    for letters in ("the", "aeiouthsn", "and the", "ññééü日"):
        for _ in range(60):
            word = "▁" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))).replace(" ", "")
            assert ENCODER.model._with_bytes(ENCODER.model._queued(word)).tolist() == ENCODER.model._rounds([word])[0].tolist()


def test_other_tokenizers_get_whole_texts():
    told = json.loads(WORDS)
    assert WORD.by_word
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": told["pre_tokenizer"]["pretokenizers"][1:]}}):
        model = json.dumps(told | change)
        own, library = WordTokenizer(model), Tokenizer.from_str(model)
        assert not own.by_word
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode([*ODD, None])] == [library.encode(t, add_special_tokens=False).ids for t in [*ODD, ""]]


def test_word_tokenizer_on_odd_texts():
    own = WORD.encode(ODD)
    assert [np.frombuffer(x, WORD.kind).tolist() for x in own] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in ODD]


def test_encode_decode_rows(table):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (3, "again"), (3, "again")]
    got = encode_decode(table("doc_id long, text string, ids string", [(*r, "clash") for r in rows]), PIECES)
    assert got.columns == ["doc_id", "ids", "decoded"]
    have = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()), key=repr)
    want = [(i, tuple(SP.encode(t or "", add_eos=True)), SP.decode(SP.encode(t or "", add_eos=True))) for i, t in rows]
    assert have == sorted(want, key=repr)
    assert encode_decode(table("doc_id long, text string", []), PIECES).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(65_000, 66_000), st.integers(0, 2**32 - 1)), max_size=20), max_size=5))
def test_codes_round_trip(docs):
    both = [pack(np.array(d, np.uint32)) for d in docs]
    control, data = (np.frombuffer(b"".join(x[k] for x in both), np.uint8) for k in (0, 1))
    out = unpack(control, data, np.array([len(d) for d in docs], np.int64))
    assert out.tolist() == [x for d in docs for x in d]


def test_token_file(spark, table):
    rows = [(7 * i % 101, t) for i, t in enumerate(ODD)] + [(500, None), (None, "first"), (501, "same"), (501, "same")]
    path = new_path(spark, "tokens")
    index = write_tokens(table("doc_id long, text string, id string", [(*r, "clash") for r in rows]), path, WORDS)
    got = sorted((r.start, r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_tokens(spark, path, index).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((start, i, ids))
        start += len(ids)
    assert got == want
    empty = write_tokens(table("doc_id long, text string", []), path + "-none", WORDS)
    assert read_tokens(spark, path + "-none", empty).collect() == []


def test_token_files_are_cut_whatever_repeats(spark, table, monkeypatch):
    """Small files: hot ids and equal rows are dealt to several, the order stays."""
    monkeypatch.setattr(token_file, "FILE", 600)
    monkeypatch.setattr(token_file, "SAMPLE", 150)
    monkeypatch.setattr(token_file, "BLOCK", 100)
    rng = random.Random(8)
    rows = [(None, f"row {i}") for i in range(60)] + [(5, "the same text again and again")] * 90 + [(5, f"other {i}") for i in range(60)] + [(i, " ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randrange(40)))) for i in range(-20, 60)] + [(7, "long " * 200)]
    path = new_path(spark, "tokens")
    index = write_tokens(table("doc_id long, text string", rows), path, WORDS)
    by_file = {r.file_no: r.docs for r in index.groupBy("file_no").agg(F.sum("docs").alias("docs")).collect()}
    assert len(by_file) > 8 and max(by_file.values()) < 90
    # ranges are few (SHARE rows of the sample each), and fill several files one after the other
    assert len({n >> 32 for n in by_file}) < len(by_file)
    got = [(r.start, r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_tokens(spark, path, index).orderBy("start").collect()]
    assert [i for _, i, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    starts = np.cumsum([0] + [len(x) for *_, x in got])[:-1]
    assert [s for s, *_ in got] == starts.tolist()
    assert sorted((i is None, i or 0, tuple(x)) for _, i, x in got) == sorted((i is None, i or 0, (*LIBRARY.encode(t, add_special_tokens=False).ids, 1)) for i, t in rows)


def test_queries_are_brute_force(spark):
    """op3 and op7 over whole documents, their digests made anew by the libraries."""
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in read_table(spark, sf, "documents").collect())
    start, want = 0, {}
    for i, t in docs:
        ids = [*LIBRARY.encode(t, add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_file(spark, sf).collect()} == want
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    pieces = {i: SP.encode(t, add_eos=True) for i, t in docs}
    want = {i: (len(x), digest(" ".join(map(str, x))), digest(SP.decode(x))) for i, x in pieces.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_piece_bpe(spark, sf).collect()} == want


def test_warc_heads_of_any_length(spark, table):
    rows = [(i, "http://x/" + "".join(random.Random(i).choice("abcdefgh/") for _ in range(n)), "<p>" * n) for i, n in enumerate((10, 200_000, 3, 90_000))]
    archives = write_warc(table("page_id long, url string, html string", rows).coalesce(1), new_path(spark, "warc"))
    for split in (50_000, 1 << 20):
        got = sorted((r.page_id, r.url, r.payload_bytes) for r in read_warc(spark, archives, split).collect())
        assert got == [(i, u, len(h)) for i, u, h in rows]


def test_places_that_look_like_members_are_passed_over():
    from tidemark.llm.warc import _fields

    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 5"
    assert _fields(good)["content-length"] == "5"
    for bad in (b"WARC/1.1", b"WARC/", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"5", b"five"), good + b"\r\nno colon", good.replace(b"WARC-Type: response\r\n", b""), good + b"\r\nX: \xff"):
        assert _fields(bad) is None


def test_warc_round_trip_at_any_split(spark, table):
    rng = random.Random(2)
    big = ["<p>" + "".join(rng.choice("abcé\r\n\x1f") for _ in range(1500)) for _ in range(3)]
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "\x1f\x8b\x08" * 400
    pages = [(i, f"http://x/{i}", rng.choice([*big, "small", "", None, tricky])) for i in range(60)] + [(None, None, big[0]), (None, "u", "small"), (9, "again\r\nX: y", big[1])]
    df = table("page_id long, url string, html string, sha string", [(*p, "clash") for p in pages])
    archives = write_warc(df, new_path(spark, "warc"))
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        again = len(body) >= 1000 and last.get(h or "", i) != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None, None if again else body))
    for split in (997, 1 << 20):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload)) for r in read_warc(spark, archives, split).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert read_warc(spark, write_warc(df.where("false"), new_path(spark, "warc"))).collect() == []


def test_crc_of_files_is_zlib(table):
    df = table("x binary", [(b"",), (b"\x01\x00\x00\x00",)])
    assert [r[0] for r in df.select(F.crc32("x")).collect()] == [zlib.crc32(b""), zlib.crc32(b"\x01\x00\x00\x00")]
