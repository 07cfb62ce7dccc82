"""BPE encoding and decoding.

Encoding a pretoken doesn't replay merges. An Aho-Corasick automaton gives the longest token that
starts at each byte; the encoder takes it if it may stand after the token before, else a shorter
one, else it steps back a token. Which tokens may stand side by side is read off the merge table:
two tokens are compatible iff no merge across their border would have come before the merges that
made them. The result is that of the merges, in time linear in the bytes. Decoding gathers the
tokens' bytes through a table of offsets.

Texts are encoded whole, a partition at a time, by mapInArrow. The only state is a vocabulary, read
from a path that is the same on every machine, and a bounded cache of words that were seen before.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.deploy import ship

#: Fixed value: how byte-level BPE cuts a text into pretokens.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space between two runs of white space isn't a border of pretokens; such texts take the slower way.
SPACES = re.compile(r"\s \s|\s \Z")
#: Words and characters that a cache holds, and pairs of tokens; beyond any of them it starts anew.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 200_000, 4_000_000, 500_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: a printable Latin-1 character stands
    for itself, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens are numbered within by rank, bytes first, then by merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        written = sorted((c for c in letters), key=letters.__getitem__) + [a + b for a, b in merges]
        rank = {}
        for i, s in enumerate(written):
            rank.setdefault(s, i)
        self.bytes = [as_bytes(s) for s in written]
        self.ids = np.array([ids[s] for s in written], np.int64)
        self.parts = [(i, i) for i in range(256)] + [(rank[a], rank[b]) for a, b in merges]
        self.merged = {pair: 256 + i for i, pair in reversed(list(enumerate(self.parts[256:])))}
        self.match = ahocorasick.Automaton()
        for s, i in rank.items():
            self.match.add_word(self.bytes[i].decode("latin-1"), (len(self.bytes[i]), i))
        by_bytes = {self.bytes[i]: i for i in rank.values()}
        self.shorter = [next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), None) for b in self.bytes]
        self.match.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.sizes, self.id_of = [len(b) for b in self.bytes], self.ids.tolist()
        # offsets of each id's bytes, for decoding
        texts = {int(i): b for i, b in zip(self.ids, self.bytes, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        lengths = np.zeros(max(texts) + 2, np.int64)
        for i, b in texts.items():
            lengths[i + 1] = len(b)
        self.offsets, self.blob = np.cumsum(lengths), np.frombuffer(b"".join(texts[i] for i in sorted(texts)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """True iff ``a`` then ``b`` is how their joined bytes are encoded."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > CACHE_PAIRS:
                self.known.clear()
            found = self.known[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # undo the two tokens' merges from the latest back, along their common border: each time the
        # pieces at the border may merge earlier than the merge just undone, the pair can't stand
        before = len(self.parts)
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b and a >= 256:
                before, a = a, self.parts[a][1]
            elif b >= 256:
                before, b = b + 1, self.parts[b][0]
            elif a >= 256:
                before, a = a, self.parts[a][1]
            else:
                return True

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ranks of the word's tokens."""
        n, size, known = len(word), self.sizes, self.known
        longest = [0] * n
        for end, (length, token) in self.match.iter(word.decode("latin-1")):
            longest[end - length + 1] = token  # of one start, the longer come later
        token = longest[0] if n else None
        if token is None or size[token] == n:
            return [] if token is None else [token]
        wrong, out, at = set(), [], 0
        while token is not None:
            end = at + size[token]
            if end not in wrong and (not out or (known.get((out[-1], token)) if (out[-1], token) in known else self.compatible(out[-1], token))):
                out.append(token)
                at, token = end, longest[end] if end < n else None
            elif self.shorter[token] is not None:
                token = self.shorter[token]
            else:  # nothing fits here: this border is wrong, so take the token before again and shorten it
                wrong.add(at)
                token = out.pop()
                at -= size[token]
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a pretoken; words recur with other punctuation, so these are cached too."""
        found = self.words.get(word)
        if found is None:
            found = tuple(self.id_of[t] for t in self.encode_bytes(word.encode()))
            if len(word) <= 64:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def encode_plain(self, text: str) -> list[int]:
        return [i for word in PRETOKEN.findall(text) for i in self.encode_word(word)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.blob[_spans(self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])].tobytes()


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all the spans, one after the other."""
    upto = np.cumsum(lengths)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - lengths), lengths)


class Encoder(dict):
    """Encodes texts; as a dict, maps a word to its number in the cache, and adds it when missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.written: list[str] = []
        self.chars = 0
        self.starts, self.sizes, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64), 0

    def __missing__(self, word: str) -> int:
        v = self.vocabulary
        ids = [v.id_of[t] for t in v.encode_bytes(f" {word}".encode())] if word.isalpha() else v.encode_plain(" " + word)
        k, n = len(self.written), len(ids)
        while k >= len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + n] = ids
        self.starts[k], self.sizes[k] = self.used, n
        self.used += n
        self.chars += len(word)
        self.written.append(",".join(map(str, ids)))
        self[word] = k
        return k

    def _part(self, text: str) -> tuple[np.ndarray, str]:
        """A text without special tokens: its ids, and as decimals."""
        if SPACES.search(text):
            ids = self.vocabulary.encode_plain(text)
            return np.array(ids, np.int64), ",".join(map(str, ids))
        first, *words = text.split(" ")  # every other word starts with the space that stood there
        if len(self) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._clear()
        lead = self.vocabulary.encode_plain(first)
        codes = list(map(self.__getitem__, words))
        said = ",".join(filter(None, [",".join(map(str, lead)), *map(self.written.__getitem__, codes)]))
        at = np.array(codes, np.int64)
        return np.concatenate([np.array(lead, np.int64), self.flat[_spans(self.starts[at], self.sizes[at])]]), said

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        v = self.vocabulary
        parts = v.cut.split(text) if v.cut and any(s in text for s in v.special) else [text]
        found = [(np.array([v.special[p]], np.int64), str(v.special[p])) if i % 2 else self._part(p) for i, p in enumerate(parts)]
        return found[0] if len(found) == 1 else (np.concatenate([x for x, _ in found]), ",".join(filter(None, (s for _, s in found))))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """One row for each row of ``df``: the columns in ``keep``, n_tokens long, ids array<int> (if
    with_ids), ids_sha256 and decoded_sha256.

    path: a tokenizers JSON file of a byte-level BPE vocabulary, on every machine. ids are those of the
    whole text; special tokens' strings in it become the special tokens, and none is added. A null
    or empty text has no ids, and the digests of the empty string. ids_sha256 is over the decimal
    ids joined by commas, decoded_sha256 over the bytes that the ids decode to. Repeated rows give
    repeated rows; an empty table gives an empty table. Columns not in ``keep`` aren't read; one that is
    called as a result is left out for it."""
    ship(df.sparkSession)
    own = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    names = [c for c in keep if c not in own]
    plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text).alias("text"))
    kept = plain.columns[:-1]
    schema = plain.select(*kept).schema
    for name in own:
        schema = schema.add(name, {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}.get(name, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids, said, decoded = [], [], [], []
                for value in part.column(len(kept)):
                    found, decimals = e.encode(value.as_py() or "")
                    counts.append(len(found))
                    said.append(hashlib.sha256(decimals.encode()).hexdigest())
                    decoded.append(hashlib.sha256(e.vocabulary.decode(found)).hexdigest())
                    ids.append(found.astype(np.int32) if with_ids else None)
                arrays = [*part.columns[: len(kept)], pa.array(counts, pa.int64())]
                if with_ids:
                    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else [], pa.int32())))
                arrays += [pa.array(said, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, *own)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and text, which the ids decode to; null ids give a null text. Bytes that
    aren't UTF-8, as of ids cut in the middle of a character, become U+FFFD. A kept column called text is
    left out for it. Repeated rows give repeated rows; an empty table gives an empty table."""
    ship(df.sparkSession)
    names = [c for c in keep if c != "text"]
    plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(ids).alias("ids"))
    schema = plain.drop("ids").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for batch in batches:
            rows = batch.column(len(names)).to_pylist()
            texts = [None if r is None else v.decode(np.array(r, np.int64)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, "text")
