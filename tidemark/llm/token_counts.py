"""Tokens per document, without moving a pre-token between tasks.

A document's count is the sum of its pre-tokens' lengths, and a few pre-tokens make up most of any
corpus. So lengths are looked up in two tiers, both on the side of the scan: a table of the FREQUENT
commonest pre-tokens is broadcast (its size is bounded: FREQUENT entries of at most LONGEST characters),
and whatever isn't in it is encoded by the library once a worker and remembered there, up to MEMORY
entries. Nothing is exchanged but the bounded sample of SAMPLE documents (about) that shows which
pre-tokens are common. The sample decides what is quick, never what is counted: a pre-token has the
length that the library gives it in either tier.

Texts of Latin letters are cut into pre-tokens here; in other texts the pieces between blanks that hold
other letters go to the library as they are. A text that holds an added token's string goes to it whole,
and so does any text where the tokenizer isn't a byte-level one, or is a sentencepiece model.

Cases: a null text is empty and has no tokens. A null or repeated id is a row like any other. An empty
table gives none. Very long texts are cut as they are; a pre-token of more than LONGEST characters is
encoded wherever it comes and never remembered. Columns of the caller's stay, whatever their names; the
counts come as one struct.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: Entries of the broadcast table, characters of a remembered pre-token, entries a worker remembers.
FREQUENT, LONGEST, MEMORY = 1 << 16, 64, 1_000_000
#: Documents (about) and tasks that show what is common.
SAMPLE, SAMPLERS = 20_000, 8
#: How byte-level tokenizers of this kind part a text (short forms, letters, digits, other signs, white
#: space), here with the classes of the letters up to U+024F, which no version of Unicode has changed.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS, DIGITS, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PARTS = re.compile(rf"{SHORT}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{LETTERS}{DIGITS}{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
_LATIN = re.compile("[\x00-ɏ]*").fullmatch
#: A blank between two visible letters always begins a pre-token.
_BLANKS = re.compile("(?<=[!-~¡-ɏ])(?= [!-~¡-ɏ])").split
_LED = re.compile("(?: [!-~¡-ɏ]+)").fullmatch


class Lengths:
    """Tokens of whole texts by a tokenizers file or a sentencepiece model, the common pre-tokens' lengths being known."""

    def __init__(self, model: bytes, frequent: dict[str, int] | None = None) -> None:
        self.frequent = frequent or {}
        self.known = dict(self.frequent)
        self.pieces = None if model[:1] == b"{" else SentencePieceProcessor(model_proto=model)
        self.in_parts, self.added = False, []
        if self.pieces is None:
            self.tokenizer = Tokenizer.from_str(model.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            told = json.loads(model)
            cut, bpe = told.get("pre_tokenizer") or {}, told["model"]
            self.added = [t["content"] for t in told.get("added_tokens") or []]
            size = self.tokenizer.get_vocab_size()
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)], bool)
            self.in_parts = not told.get("normalizer") and BYTE_LEVEL.items() <= cut.items() and bpe.get("type") == "BPE" and not bpe.get("dropout")

    def encoded(self, texts: list[str]) -> list[int]:
        """The library's own counts."""
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_parts(self, parts: list[str]) -> dict[str, int]:
        """Lengths of single parts. Those led by a blank go to the library many a call: each begins with the only token that has a blank."""
        led = [p for p in parts if _LED(p)]
        rest = list(set(parts).difference(led))
        out = dict(zip(rest, self.encoded(rest), strict=True))
        for at in range(0, len(led), 500):
            some = led[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids)
            out |= zip(some, np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)).tolist(), strict=True)
        return out

    def parts(self, text: str) -> list[str] | None:
        """What the text's count is the sum of; none where only the whole text will do."""
        if not self.in_parts or any(t in text for t in self.added):
            return None
        if _LATIN(text):
            return _PARTS(text)
        out: list[str] = []
        for piece in _BLANKS(text):
            if _LATIN(piece):
                out += _PARTS(piece)
            else:
                out.append(piece)
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        known = self.known
        missing = set().union(*(p for p in cut if p)).difference(known)
        if len(known) + len(missing) > MEMORY:
            self.known = known = dict(self.frequent)
            missing = set().union(*(p for p in cut if p)).difference(known)
        known |= self.of_parts(list(missing))
        out = [0 if p is None else sum(map(known.__getitem__, p)) for p in cut]
        for p in [p for p in missing if len(p) > LONGEST]:
            del known[p]
        whole = [i for i, p in enumerate(cut) if p is None]
        for i, n in zip(whole, self.encoded([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


def _of_worker(key: str, sent: Broadcast) -> Lengths:
    """One for all tasks of a worker process, so that they share what it remembers."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Lengths(*sent.value)
    return _HELD[key]


_HELD: dict[str, Lengths] = {}


def _chunks(texts: list[str], characters: int = 4_000_000) -> Iterator[list[str]]:
    """A few million characters at a time, so that the cut texts fit beside the batch."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= characters:
            yield held
            held, size = [], 0
    yield held


def frequent_lengths(docs: DataFrame, model: bytes, text_col: str = "text") -> dict[str, int]:
    """Lengths of the pre-tokens that are commonest in a sample of about SAMPLE documents; FREQUENT at most."""
    lengths = Lengths(model)
    if not lengths.in_parts:
        return {}
    n = docs.count()
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    some = texts.sample(min(1.0, SAMPLE / n), seed=1) if n > SAMPLE else texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = Lengths(model), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(p for p in own.parts(text) or () if len(p) <= LONGEST)
                if len(seen) > MEMORY:  # what came once so far is not what is common
                    seen = Counter({p: k for p, k in seen.items() if k > 1} if min(seen.values()) < 2 else dict(seen.most_common(MEMORY // 2)))
        top = seen.most_common(FREQUENT)
        yield pd.DataFrame({"part": pd.Series([p for p, _ in top], dtype=object), "n": pd.Series([k for _, k in top], dtype="int64")})

    total: Counter = Counter()
    for r in some.repartition(SAMPLERS).mapInPandas(run, "part string, n long").collect():  # SAMPLERS x FREQUENT rows at most
        total[r["part"]] += r["n"]
    top = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]
    return lengths.of_parts(top)


def token_counts(docs: DataFrame, model: bytes, limit: int, text_col: str = "text", name: str = "counts") -> DataFrame:
    """The caller's columns and the struct ``name`` of n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(docs, model, text_col)))
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _of_worker(key, sent)
        for batch in batches:
            yield pd.Series([n for some in _chunks(batch.tolist()) for n in lengths.count(some)], dtype="int64")

    text: Column = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumn(name, F.struct(F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens")))
    return out.withColumn(name, F.col(f"`{name}`").withField("over_limit", F.col(f"`{name}`.n_tokens") > limit))
