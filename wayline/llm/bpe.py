"""Byte-level BPE encoding by tree concatenation, and decoding.

A long text is halved until its leaves are short. Leaves are encoded on their
own; each join then encodes a window of text anew, from a token boundary left
of the cut to one right of it, and doubles the window until its first token is
the left half's and its last token the right half's. A BPE sequence is the
encoding of its text if and only if every two neighbours are, so one shared
token on each side makes the spliced sequence exact. Texts of more than
``piece_chars`` are cut into rows first, so their parts are encoded by several
tasks, and only their joins run together.

Nulls are empty texts and give no tokens. Repeated rows stay repeated. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wayline.llm.common import per_task, resident, slices, texts

LEAF_CHARS = 2048
PIECE_CHARS = 1 << 16
FIRST_WINDOW = 4

#: The pre-tokenizer's contractions, and its whole pattern.
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Scripts whose character classes are the same in both regex engines.
PLAIN = re.compile(r"[\x00-\x1b\x20-ɏͰ-ͷ΄-ΆΈ-ϿЀ-ҁ‐-‧‰-⁞€]*")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of every token of a tokenizer file."""
    alphabet = byte_alphabet()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    plain = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    return plain | {i: t.encode() for t, i in special.items()}


def is_space(c: str) -> bool:
    """White space as the pre-tokenizer has it; Python adds four control characters."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class TreeEncoder:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = token_bytes(spec)
        self.chars = np.zeros(max(tokens) + 1, np.int64)  # characters that begin in each token
        self.opens = np.zeros(max(tokens) + 1, bool)  # whether it begins with one
        for i, t in tokens.items():
            self.chars[i], self.opens[i] = sum(b & 0xC0 != 0x80 for b in t), t[0] & 0xC0 != 0x80
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        ids = [vocab[a + b] for a, b in merges]
        ordered = all(x < y for x, y in zip(ids, ids[1:], strict=False))  # then ids may stand for merge ranks
        self.leaf_chars = leaf_chars
        self.ranks = None
        if ordered:
            ranks = {t: i for i, t in tokens.items() if i not in self.special.values()}
            self.ranks = tiktoken.Encoding("leaves", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def library(self):
        """For texts outside the plain scripts; most workers never need it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    def leaf(self, text: str) -> list[int]:
        if self.ranks is not None and PLAIN.fullmatch(text):
            return self.ranks.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; special strings in it are special tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.tree(text)
        parts = [np.array([self.special[x]], dtype="<u4") if x in self.special else self.tree(x) for x in self.split_special.split(text) if x]
        return np.concatenate(parts)

    def tree(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf_chars:
            return np.array(self.leaf(text), dtype="<u4")
        cut = self.safe_cut(text, max(1, len(text) // 2 // self.leaf_chars) * self.leaf_chars)  # whole leaves: repeated letters stay in step
        if cut is None:
            return np.array(self.leaf(text), dtype="<u4")
        return self.join(text, cut, self.tree(text[:cut]), self.tree(text[cut:]))

    def safe_cut(self, text: str, at: int) -> int | None:
        return next((p for p in range(at, len(text)) if self.safe(text, p)), None)

    @staticmethod
    def safe(text: str, p: int) -> bool:
        """Splitting into words from p on ends them where splitting the whole text does: no contraction stands over p."""
        for j in range(max(0, p - 2), p + 1):
            m = CONTRACTION.match(text, j)
            if m and m.end() > p and not (j == p and p and text[p - 1].isalnum()):
                return False
        return True

    def join(self, text: str, cut: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text from the ids of text[:cut] and text[cut:]."""
        k = FIRST_WINDOW
        while True:
            n, start = self.back(text, cut, left, k)
            m, end = self.ahead(text, cut, right, k)
            window = np.array(self.leaf(text[start:end]), dtype="<u4")
            left_agrees = n == len(left) or (len(window) and window[0] == left[-n])
            right_agrees = m == len(right) or (len(window) and window[-1] == right[m - 1])
            if left_agrees and right_agrees:
                return np.concatenate((left[: len(left) - n], window, right[m:]))
            k *= 4

    def back(self, text: str, cut: int, ids: np.ndarray, n: int) -> tuple[int, int]:
        """At least n of the last tokens, and the place in text where they start, at a safe character boundary."""
        start = cut - int(self.chars[ids[len(ids) - n :]].sum()) if n < len(ids) else 0
        while n < len(ids):
            if self.opens[ids[-n]] and self.safe(text, start):
                return n, start
            n += 1
            start -= int(self.chars[ids[-n]])
        return len(ids), 0

    def ahead(self, text: str, cut: int, ids: np.ndarray, n: int) -> tuple[int, int]:
        """The same to the right; not where white space ends, as its last character may belong to the next word."""
        end = cut + int(self.chars[ids[:n]].sum())
        while n < len(ids):
            if self.opens[ids[n]] and not (is_space(text[end - 1]) and not is_space(text[end])) and self.safe(text, end):
                return n, end
            end += int(self.chars[ids[n]])
            n += 1
        return len(ids), len(text)


class Decoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.tokens = token_bytes(json.load(f))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoder(path: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    return resident(("encoder", path, leaf_chars), lambda: TreeEncoder(path, leaf_chars))


def decoder(path: str) -> Decoder:
    return resident(("decoder", path), lambda: Decoder(path))


def encode(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""
    base = texts(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, leaf_chars)
        for batch in batches:
            for part in slices(batch):
                ids = [tree.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, leaf_chars)
        for batch in batches:
            for part in slices(batch):
                ids = [tree.tree(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "ids"])

    def joined(pdf):
        import pandas as pd

        tree = encoder(path, leaf_chars)
        pdf = pdf.sort_values("piece")
        cuts = list(pdf["text"])
        text = "".join(cuts)
        cut_places = np.cumsum([len(x) for x in cuts])[:-1].tolist()
        if any(s in text for s in tree.special) or not all(tree.safe(text, p) for p in cut_places):
            ids = tree.encode(text)
        else:
            ids = join_pieces(tree, cuts, [np.frombuffer(x, dtype="<u4") for x in pdf["ids"]])
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n_tokens": [len(ids)], "ids": [ids.tobytes()]})

    short = base.where(F.length("text") <= piece_chars).mapInArrow(per_task(whole), schema)
    cut = base.where(F.length("text") > piece_chars).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    n = F.ceil(F.length("text") / F.lit(piece_chars)).cast("int")
    part = cut.select(
        "doc_id", "row",
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * piece_chars + 1, F.lit(piece_chars)))).alias("piece", "text"),
    )
    encoded = part.repartition(F.col("row"), F.col("piece")).mapInArrow(per_task(pieces), f"doc_id {kind}, row bigint, piece int, text string, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInPandas(joined, schema))


def join_pieces(tree: TreeEncoder, cuts: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Joins neighbouring pieces pairwise, level by level."""
    while len(cuts) > 1:
        pairs = range(0, len(cuts) - 1, 2)
        ids = [tree.join(cuts[i] + cuts[i + 1], len(cuts[i]), ids[i], ids[i + 1]) for i in pairs] + ids[len(pairs) * 2 :]
        cuts = [cuts[i] + cuts[i + 1] for i in pairs] + cuts[len(pairs) * 2 :]
    return ids[0] if ids else np.array([], dtype="<u4")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of its ``ids``; special tokens are kept."""
    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                found = [own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(per_task(texts_of), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
