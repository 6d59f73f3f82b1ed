"""Token counts without token ids.

A tokenizer of the library `tokenizers` splits a text into pre-tokens and each pre-token into pieces, whatever stands around
it. So pre-tokens are counted per document, pieces are counted once for each distinct pre-token, and the two are joined and
summed.
"""

from __future__ import annotations

import json
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table
from lodestone.llm.terms import HEAD, sums, term_counts

LIMIT = 2048
#: Texts without a character from here on are lower-cased and split here; all others by the library. Below it no character
#: combines with another, and lower-casing is the same everywhere.
_PLAIN = regex.compile("[^\u0000-˿]")


class Splitter:
    """Pre-tokens of a tokenizer file, as the library makes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        if spec["model"]["type"] != "BPE" or self.tokenizer.pre_tokenizer is None:
            raise ValueError("a BPE tokenizer with a pre-tokenizer is needed")
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.pattern = self._pattern(spec)

    @staticmethod
    def _pattern(spec: dict):
        """The pattern of the pre-tokens, for a tokenizer that lower-cases, splits by one pattern and maps bytes; else None."""
        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"]
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
            return None
        blank, split, byte = norm["normalizers"][1], parts[0], parts[1]
        if (blank["pattern"], blank["content"]) != ({"Regex": r"\s+"}, " ") or split["behavior"] != "Removed" or not split["invert"] or byte["add_prefix_space"] or byte["use_regex"]:
            return None
        # White space is in no pre-token, so that it is made equal changes none.
        return regex.compile(split["pattern"]["Regex"])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, after normalising."""
        if self.pattern is not None and not _PLAIN.search(text):
            return self.pattern.findall(text.lower())
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text. A special token is a pre-token of its own, after a zero byte."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces(text[at : m.start()]), "\x00" + m[0]]
            at = m.end()
        return out + self.pieces(text[at:])

    def tokens(self, piece: str) -> int:
        """How many tokens a pre-token gives."""
        if piece[:1] == "\x00" and self.special is not None and self.special.fullmatch(piece[1:]):
            return 1
        return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _extract(path: str, text: bytes) -> list[str]:
    return splitter(path).split(text.decode("utf8", "replace"))


def _tokens(path: str, batches):
    own = splitter(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.tokens(t.as_py()) for t in b.column(0)], pa.int64())], ["term", "n", "tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """One row per row of docs: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of a file of the library `tokenizers`, the same on every machine. No begin, end or other token is added;
    the strings of special tokens inside a text are these tokens, as is the library's default; nothing is cut or padded. A null
    text counts as empty. Null ids, repeated ids and repeated rows stay. Only the named columns are read. An empty table gives
    no rows. Texts of any length are counted whole.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("rid"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    counts = term_counts(rows, partial(_extract, tokenizer), kind="string").select("term", "n")
    values = cut(counts.mapInArrow(partial(_tokens, tokenizer), "term string, n long, tokens long"))
    total = sums(rows, partial(_extract, tokenizer), values, {"tokens": F.lit(0)}, head)
    n = F.col("tokens").cast("long")
    return total.select(F.col("id").alias(id_col), F.col("size").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_tokens": op5_tokens}
ORACLES: dict[str, str] = {}
