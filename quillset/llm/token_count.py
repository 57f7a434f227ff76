"""Token counts with the whole-token shortcut.

For every vocabulary string it's proved once, offline on the driver by encoding it, whether it
is a single token on its own; the proven strings are broadcast. Texts are cut at special
strings and into pre-tokens; those that are such strings count as one, and only the rest
are merged, in batches, by the tokenizer (each different one once per worker while the
bounded cache holds it). Pre-tokens don't influence each other in byte-level BPE, so the
sum is the library's count. That holds for the shape of tokenizer which plain_shape() tests;
texts of any other one go to the library whole.

Characters whose class could differ between Unicode versions of the two pattern engines
aren't in SAFE; a text that has one goes to the library whole.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE, as published with its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of characters on whose class both engines agree (a test goes through them).
SAFE = ((0x0, 0x52F), (0x5D0, 0x5EA), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x22FF), (0x2500, 0x25FF), (0x3000, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F))
UNSAFE = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAFE) + "]")
#: Longer texts are handled in parts, cut where whitespace begins.
PART_CHARS = 1 << 18
#: Merged pre-tokens a worker remembers.
CACHE_ENTRIES = 400_000

_counters: dict[str, Counter] = {}


def plain_shape(model: dict) -> bool:
    """Whether a tokenizer file cuts texts by PATTERN alone: byte-level BPE without normalizer, prefix space, sampling or stripping special strings."""
    cut, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
    strips = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in model.get("added_tokens") or ())
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    merges = bpe.get("type") == "BPE" and not bpe.get("dropout") and not bpe.get("continuing_subword_prefix") and not bpe.get("end_of_word_suffix")
    return bool(byte_level and merges and not model.get("normalizer") and not strips)


class Counter:
    """Counts tokens as the tokenizer file's library does, without begin, end or added special tokens."""

    def __init__(self, serialized: str, whole: frozenset[str] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialized)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pattern = regex.compile(PATTERN)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.plain = plain_shape(json.loads(serialized))
        self.whole = whole if whole is not None else frozenset(self.proven())
        self.merged: dict[str, int] = {}

    def proven(self) -> list[str]:
        """The vocabulary's strings that are one token on their own."""
        if not self.plain:
            return []
        strings = [self.tokenizer.decoder.decode([v]) for v in self.tokenizer.get_vocab() if v not in self.added]
        return [s for s, n in zip(strings, self._encode(strings), strict=True) if n == 1]

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _parts(self, text: str):
        """Cuts where whitespace begins leave every pre-token as it is."""
        at = 0
        while len(text) - at > PART_CHARS:
            m = regex.compile(r"\S(?=\s)").search(text, at + PART_CHARS)
            if not m:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not self.plain or not text.isascii() and UNSAFE.search(text):
                out.append(self._encode([text])[0])
                continue
            total = 0
            pieces = self.special.split(text) if self.special else [text]
            total += len(pieces) - 1
            for piece in pieces:
                for part in self._parts(piece) if len(piece) > PART_CHARS else (piece,):
                    total += self._plain(part)
            out.append(total)
        return out

    def _plain(self, text: str) -> int:
        whole, merged = self.whole, self.merged
        found = self.pattern.findall(text)
        rest = [x for x in found if x not in whole]
        new = [x for x in set(rest) if x not in merged]
        if new:
            if len(merged) + len(new) > CACHE_ENTRIES:
                merged = self.merged = {}
                new = list(set(rest))
            merged.update(zip(new, self._encode(new), strict=True))
        return len(found) - len(rest) + sum(map(merged.__getitem__, rest))


def token_counter(spark: SparkSession, tokenizer_path: str):
    """A function from a text column to its number of tokens (long); null counts as empty.

    The file is read, and the whole tokens are proved, on the driver; both are broadcast (a few
    MB, whatever the data).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        serialized = f.read()
    model = spark.sparkContext.broadcast((serialized, Counter(serialized).whole))
    key = f"{tokenizer_path}:{hash(serialized)}"

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        if key not in _counters:
            _counters[key] = Counter(*model.value)
        return pa.array(_counters[key].count([t or "" for t in texts.to_pylist()]), pa.int64())

    def apply(text: Column) -> Column:
        return n_tokens(text)

    return apply


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > ``limit``).

    A null text is empty and has no tokens; texts of any length are counted whole. Equal rows
    count alike; columns named as the three new ones are replaced; an empty table gives an
    empty table.
    """
    n = token_counter(docs.sparkSession, tokenizer_path)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": n(whole)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
