"""Byte-pair encoding of distinct words over their trie, and decoding.

The last token of a word's encoding is known for each of its prefixes: it is the only token that ends the prefix and
stands unmerged after the last token of what is before it. Sorted distinct words are their trie in depth-first order,
so a stack of last tokens along the path holds all states, and a prefix that words share is worked out once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from posolog.llm.common import KEPT, mapped, shipped

#: Words whose encodings a worker keeps between blocks, and bytes of text in a block.
KEPT_WORDS = 300_000
BLOCK_BYTES = 4 << 20

_NEVER = 1 << 30


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_sign() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, spec: dict):
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError("only plain byte-level BPE is handled")
        sign = _byte_of_sign()
        raw = lambda s: bytes(sign[c] for c in s)
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: raw(s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are handled")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank, self.parts = dict.fromkeys(self.bytes_of, -1), {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((left, right), r)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = r, (left, right)
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values() and (len(b) == 1 or i in self.parts)}
        self.agree: dict[tuple[int, int], bool] = {}
        self.id_of = {b: i for b, i in self.id_of.items() if self._whole(i)}
        self.longest = max(map(len, self.id_of))
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.bytes_of}
        found = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut_special = regex.compile(f"({found})") if found else None
        #: The split of byte-level BPE; white space is Unicode's property.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+").findall
        self.kept: dict[str, bytes] = {}

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes merge into it: its halves are met unmerged by its last merge."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._whole(left) and self._whole(right) and self.stays_apart(left, right, self.rank[token])

    def stays_apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether no merge of a rank below `until` crosses the seam of two finished tokens.

        The seam is followed back in time: the later made of the tokens at it is taken apart, and their merge would
        have come first if its rank is below what ended that meeting (on its left, or as low on its right).
        """
        rank, parts, merge = self.rank, self.parts, self.merge
        left_ends = right_ends = until
        while True:
            r = merge.get((left, right), _NEVER)
            if r < left_ends and (r <= right_ends if right_ends != until else r < until):
                return False
            if rank[left] > rank[right]:
                left_ends, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                right_ends, right = rank[right], parts[right][0]
            else:
                return True

    def learn(self, words: Iterator[str]) -> None:
        """Encodes distinct words along their trie and keeps the results."""
        id_of, longest, agree, bytes_of, packed = self.id_of, self.longest, self.agree, self.bytes_of, self.packed
        last: list[int] = [-1]
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n, shared = len(raw), 0
            for x, y in zip(raw, before):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = id_of.get(raw[start:end])
                    if token is None:
                        continue
                    if not start:
                        break
                    pair = (last[start], token)
                    fits = agree.get(pair)
                    if fits is None:
                        fits = agree[pair] = self.stays_apart(*pair)
                    if fits:
                        break
                last.append(token)
            before, out = raw, []
            while n:
                out.append(packed[last[n]])
                n -= len(bytes_of[last[n]])
            self.kept[word] = b"".join(reversed(out))
        if len(agree) > 4 * KEPT_WORDS:
            agree.clear()

    def pieces(self, text: str) -> list[str | int]:
        """The text's words in order; an added token is its id."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self.words(text)
        return [p for part in self.cut_special.split(text) for p in ([self.special[part]] if part in self.special else self.words(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        fresh = {p for pieces in cut for p in pieces}.difference(self.kept)
        self.learn(p for p in fresh if isinstance(p, str))
        for p in fresh:
            if isinstance(p, int):
                self.kept[p] = self.packed[p]
        kept = self.kept.__getitem__
        return [b"".join(map(kept, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement signs, ids that are not there nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def _forget() -> None:
    """Lets go of the words that this process has encoded."""
    for own in _LOADED.values():
        own.kept, own.agree = {}, {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at path, read once in a process."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = Vocabulary(json.load(f))
    KEPT["bpe"] = _forget
    return _LOADED[path]


def _shipped(spark: SparkSession, path: str) -> str:
    """Has every executor fetch the driver's vocabulary file; returns the name under which they have it."""
    with open(path, "rb") as f:
        data = f.read()
    return shipped(spark, f"vocabulary-{hashlib.sha256(data).hexdigest()[:24]}.json", (data[k : k + (1 << 20)] for k in range(0, len(data), 1 << 20)))


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ids_col, binary: the text's token ids as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library without added special tokens; a special token's own string in a text is
    that token. Null and empty texts have no ids (an empty binary). Texts of any length are encoded whole, each by
    itself, so repeated rows come out alike; other columns stay, whatever their names, and one named ids_col is replaced.
    """
    name = _shipped(df.sparkSession, path or vocabulary_path())
    work = lambda texts: [pa.array(vocabulary(SparkFiles.get(name)).encode([t or "" for t in texts.to_pylist()]), pa.binary())]
    return mapped(df, text_col, [(ids_col, "binary")], work, BLOCK_BYTES, "bpe")


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """Adds text_col: the text of the ids in ids_col, special tokens included; null ids give an empty text.

    Other columns stay, whatever their names; one named text_col is replaced."""
    name = _shipped(df.sparkSession, path or vocabulary_path())

    def work(ids: pa.Array) -> list[pa.Array]:
        own = vocabulary(SparkFiles.get(name))
        return [pa.array([own.decode(x or b"") for x in ids.to_pylist()], pa.string())]

    return mapped(df, ids_col, [(text_col, "string")], work, BLOCK_BYTES, "bpe")


def recode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds ids_col and decoded_col as encode() and then decode() do, in one pass: a task has one worker, not two."""
    name = _shipped(df.sparkSession, path or vocabulary_path())

    def work(texts: pa.Array) -> list[pa.Array]:
        own = vocabulary(SparkFiles.get(name))
        ids = own.encode([t or "" for t in texts.to_pylist()])
        return [pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())]

    return mapped(df, text_col, [(ids_col, "binary"), (decoded_col, "string")], work, BLOCK_BYTES, "bpe")
