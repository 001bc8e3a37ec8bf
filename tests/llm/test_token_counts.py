"""Token counts against the library, in both tiers and at every cut."""

import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import queries, token_counts
from tidemark.llm.common import read_table
from tidemark.llm.token_counts import Lengths, frequent_lengths

MODEL = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
LIBRARY, OWN = Tokenizer.from_str(MODEL.decode()), Lengths(MODEL)
ODD = ["", " ", "\n", "a", "  two  blanks ", " \n\t x \r\n ", "Ünïcode ß ſ İ ǅ", "don't can't I'll 'S 's''s", "a1b2 3.14 x_y ²³¼ ªº", "<|endoftext|> <|startoftext|>", "a<|endoftext|>", "日本語 テスト", "x 日本 y\xa0z\x85   w", "é ﬁ ①", "👩‍👩‍👧 🏳️‍🌈", "\x00\x01\x1f\x7f\x85", "!!! ### &&&***", "x" * 3000, " " * 70 + "y" + " " * 33, "ab " * 20_000]
text = st.text(st.one_of(st.sampled_from(" \n\t'aAsbéßZ09|.,!\xa0\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60)


def want(texts, library=LIBRARY):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=4))
def test_counts_are_the_librarys(texts):
    assert OWN.count(texts) == want(texts)


def test_odd_texts_and_every_short_letter():
    assert OWN.count(ODD) == want(ODD)
    every = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)} {chr(c)}\n'{chr(c)}'s" for c in range(0x300)]
    assert OWN.count(every) == want(every)
    for s in every[:0x250]:
        assert OWN.parts(s) == [s[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(s)]


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 50)
    own, rng = Lengths(MODEL, {" the": 1, "the": 1}), random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcthe") for _ in range(rng.randrange(1, 9))) for _ in range(12)) for _ in range(3)] + ["y" * 200]
        assert own.count(texts) == want(texts)
        assert len(own.known) <= 50 + 40 and "y" * 200 not in own.known and " the" in own.known


def test_other_models_get_whole_texts():
    words = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    own = Lengths(words)
    assert not own.in_parts and own.count(ODD) == want(ODD, Tokenizer.from_str(words.decode()))
    pieces = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    assert Lengths(pieces).count(ODD) == [len(sp.encode(t)) for t in ODD]


def test_counts_beside_the_callers_columns(table):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (3, "again"), (3, "again")]
    schema = "doc_id long, text string, n_tokens string, n_bytes string"
    got = token_counts.token_counts(table(schema, [(*r, "clash", None) for r in rows]), MODEL, 2)
    assert got.columns == ["doc_id", "text", "n_tokens", "n_bytes", "counts"]
    have = sorted(((r.doc_id, r.text, r.n_tokens, tuple(r.counts)) for r in got.collect()), key=repr)
    assert have == sorted(((i, t, "clash", (len((t or "").encode()), n, n > 2)) for (i, t), n in zip(rows, want([t for _, t in rows]), strict=True)), key=repr)
    assert token_counts.token_counts(table("doc_id long, text string", []), MODEL, 2).collect() == []


def test_the_table_holds_what_is_common(table, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 5)
    docs = table("text string", [("a b a c " * 9,), (None,), ("xylophone " * 40,), ("q" * 300,)])
    found = frequent_lengths(docs, MODEL)
    assert len(found) == 5 and " xylophone" in found and found[" xylophone"] == want([" xylophone"])[0]


def test_query_is_brute_force(spark):
    """op11 over whole documents, counted anew by the library."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in read_table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), n, n > 1024) for (i, t), n in zip(docs, want([t for _, t in docs]), strict=True)}
