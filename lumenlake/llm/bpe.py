"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Each piece of the pre-tokenizer is encoded exactly: an Aho-Corasick automaton over all tokens gives the longest
token that ends at each place; `prefix_of` walks to shorter ones. From the left, the longest token is taken if it and
the one before it are compatible (merging their text yields just these two), else a shorter one, else one step
back. A bit per place keeps dead ends from being tried twice, so the time is linear in the length.
Decoding gathers bytes through a table of offsets into the joined vocabulary.
"""

from __future__ import annotations

import gc
import json
import re
import struct

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, small_batches, table

VOCABULARY = "byte_bpe_50k.json"
#: White space as Unicode has it; str and re also count four ASCII separators.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs without white space, with the one space before; the pre-tokenizer's pieces never cross these.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ids = {raw(t): i for t, i in vocabulary.items()}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (vocabulary[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.ids[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[left, right] = rank
            self.parts.setdefault(made, (left, right))
        self.made_at = {self.ids[self.bytes_of[a] + self.bytes_of[b]]: r for (a, b), r in reversed(self.rank.items())}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, 60_000)
        self.compatible = Memo(self._compatible, 150_000)
        self.pieces = Memo(self._piece, 400_000)
        self.runs = Memo(self._run, 20_000)
        self.spaced = Memo(self._spaced, 400_000)
        n = max(self.bytes_of) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.size = self.lengths.tolist()
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        text = self.bytes_of[token]
        return next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the boundary between these two tokens: undo the later merge of the two, step by
        step, and see that no pair across the boundary would have merged earlier."""
        left, right = pair
        limit = len(self.rank) + 1
        while True:
            across = self.rank.get((left, right), limit)
            if across < limit:
                return False
            a, b = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None and self._whole(piece, whole):
            return [whole]
        longest, size, compatible = self._longest(piece), self.size, self.compatible
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not out or compatible[out[-1], token]):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]

    def _whole(self, piece: bytes, token: int) -> bool:
        return len(piece) == 1 or token in self.parts

    def _longest(self, piece: bytes) -> list[int]:
        """The longest token from each place on: matches come by their ends, so the last one from a place is its longest."""
        out = [-1] * len(piece)
        for end, (token, back) in self.automaton.iter(piece.decode("latin-1")):
            out[end - back] = token
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(run)))

    def _spaced(self, run: str) -> bytes:
        """ASCII letters alone are one piece with the space before them; the pre-tokenizer has nothing to split."""
        return self.pieces[" " + run] if run.isascii() and run.isalpha() else self._run(" " + run)

    def plain(self, text: str) -> bytes:
        """Without special tokens. A space begins a piece unless two white spaces meet there; so single spaces are where to split."""
        if "  " in text:
            return b"".join(map(self.runs.__getitem__, RUNS.findall(text)))
        first, *rest = text.split(" ")
        return self.runs[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self.plain(text), "<u4")
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self.plain(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        n = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        return self.blob[shift + np.arange(len(shift))].tobytes()


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        gc.set_threshold(200_000, 20, 100)  # the caches hold strings and numbers only
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit). Null text: empty, as is the empty text's result.

    Row by row: repeated rows and null ids stay; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return pd.Series([bpe.encode(t or "").tobytes() for t in texts])

    return docs.select("doc_id", ids("text").alias("ids"))


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Adds text, as binary UTF-8, to rows with ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("binary")
    def text(rows: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return pd.Series([bpe.decode(np.frombuffer(x, "<u4")) for x in rows])

    return ids.withColumn("text", text("ids"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
