"""Token counts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges within each. Offline, every vocabulary string that is one pre-token
and that the tokenizer encodes alone as its own single id is proved to be a whole token. A pre-token among the proved ones
counts 1 at once; only the rest are merged, and each distinct one once per worker while it is remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_letters, slices, table, vocabulary_path

MEMO_ENTRIES = 600_000

#: A space next to other white space; elsewhere a pre-token never spans the place before a single space.
_ODD_SPACE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Texts in which the split into pre-tokens is known to agree with the library's: Latin letters, without the controls that libraries class differently.
_KNOWN = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ]*")


class TokenCounter:
    """Counts tokens as the library does, its default handling of special strings included."""

    def __init__(self, vocabulary: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = self.proved(set(added))
        self.letters = byte_letters()
        self.memo: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.memo_entries = memo_entries

    def proved(self, added: set[str]) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as exactly their own id."""
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        back = {v: k for k, v in byte_letters().items()}
        texts = {}
        for token, i in ids.items():
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and _KNOWN.fullmatch(text) and text not in added and self.split(text) == [text]:
                texts[text] = i
        names = list(texts)
        found = self.tokenizer.encode_batch(names, add_special_tokens=False)
        return frozenset(t for t, e in zip(names, found, strict=True) if e.ids == [texts[t]])

    def pieces(self, text: str) -> list[str]:
        """A text cut at places that no pre-token spans: before a single space between other characters."""
        if _ODD_SPACE.search(text):
            return _SAFE_CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def learn(self, new: set[str]) -> None:
        """Remembers the counts of new pieces: the shortcut, then merges for what is left."""
        model, merged, whole = self.tokenizer.model, self.merged, self.whole
        others: list[str] = []
        for piece in new:
            if not _KNOWN.fullmatch(piece):
                others.append(piece)  # the library splits it as well
                continue
            total = 0
            for p in self.split(piece):
                if p in whole:
                    total += 1
                    continue
                n = merged.get(p)
                if n is None:
                    n = merged[p] = len(model.tokenize(p.encode().decode("latin-1").translate(self.letters)))
                total += n
            self.memo[piece] = total
        for part in slices(others, 20_000):
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[piece] = len(e.ids)

    def count(self, texts: list[str | None]) -> list[int]:
        """Each text's number of tokens; null counts as empty."""
        cut: list[list[str]] = []
        specials: list[int] = []
        for t in texts:
            t = t or ""
            parts = self.special.split(t) if self.special and self.special.search(t) else [t]
            specials.append(len(parts) - 1)
            cut.append([p for part in parts if part for p in self.pieces(part)])
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        if len(self.merged) > self.memo_entries:
            self.merged.clear()
        self.learn(set().union(*cut).difference(self.memo))
        known = self.memo.__getitem__
        return [n + sum(map(known, p)) for n, p in zip(specials, cut, strict=True)]


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of `docs` (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens; null and repeated doc_ids are kept, one row each; no shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(vocabulary)
        tool = _counters[vocabulary]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tool.count(part.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
