"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece's bytes are matched from each place against a trie of the vocabulary. The encoder takes the longest token at each place and goes
back to the next shorter one where the token can't stand beside its left neighbour, or where everything after it has failed before.
Two tokens can stand side by side if merging their bytes by rank gives just these two; that is worked out once a pair and kept.
The sequence of tokens all of whose neighbours are compatible is unique and is what the merges produce. A place is left for good at
most once, so the time is in proportion to the piece's length. The distinct pieces of a batch take these steps together, each
from the place it has reached; long pieces go one by one.

Defined results: null text counts as empty; an empty text has no ids; a text that isn't valid Unicode can't occur in a Spark string; repeated
rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Memo, tidied
from strandloom.llm.merges import Kept, Merges, Pairs, Trie, laid_out, portions

LONGEST_KEPT = 64  # bytes of a piece whose ids are remembered


class Spelling:
    """Bytes that stand for ids, put together for many texts at once."""

    def __init__(self, of: dict[int, bytes]):
        self.size = np.zeros(max(of) + 1, np.int64)
        self.size[list(of)] = list(map(len, of.values()))
        self.first = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def split(self, ids: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[bytes]:
        """Of each text, whose ids end at `ends`; up to `most` ids at a time."""
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        parts, done = [], 0
        for lo in range(0, len(ids), most):
            own = ids[lo : lo + most]
            n = self.size[own]
            after = np.cumsum(n)
            parts.append(self.blob[np.arange(after[-1]) + np.repeat(self.first[own] - after + n, n)].tobytes())
        held = parts[0] if len(parts) == 1 else b"".join(parts)
        for end in upto[ends].tolist():
            yield held[done:end]
            done = end


class BytePairEncoder:
    """Encodes and decodes by a rank file (one base64 token and its rank a line) and a pattern that splits texts into pieces."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.rank_of = {token.decode("latin-1"): rank for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank_of.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.rank_of))
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.merges = Merges(self.rank_of)
        self.latin = list(self.rank_of)
        self.rank = np.array(list(self.rank_of.values()), np.int32)
        self.number = {rank: i for i, rank in enumerate(self.rank_of.values())}
        self.trie = Trie([[c + 1 for c in token] for token in self.ranks], 256)
        self.pairs = Pairs(lambda a, b: self.merges.beside(self.latin[a] if a >= 0 else "", self.latin[b]), len(self.latin))
        self.beside = Memo(lambda pair: self.merges.beside(self.latin[self.number[pair[0]]], self.latin[self.number[pair[1]]]), 100_000)
        self.alone = Memo(lambda rank: self.merges.beside("", self.latin[self.number[rank]]), 100_000)
        self.own_bytes, self.decimals = (Spelling({rank: of(rank) for rank in self.token}) for of in (self.token.__getitem__, lambda rank: b"%d " % rank))
        self.whole = {token: np.int32(rank).tobytes() for token, rank in self.ranks.items()}
        self.kept = Kept(self.encode_pieces, 400_000)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each, four bytes an id: pieces of up to LONGEST_KEPT bytes together, the others one by one."""
        out: list[bytes] = [b""] * len(pieces)
        together, data = [], []
        for i, piece in enumerate(pieces):
            own = piece.encode("utf-8")
            if own in self.whole:
                out[i] = self.whole[own]
            elif len(own) <= LONGEST_KEPT:
                together.append(i)
                data.append(own)
            else:
                out[i] = np.array(self.encode_piece(own), np.int32).tobytes()
        if not together:
            return out
        starts, ends, _ = laid_out(list(map(len, data)))
        symbols = np.frombuffer(b"\0".join(data) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[ends] = 0
        longest = np.full(len(symbols), -1, np.int32)  # by place
        for at, token in self.trie.matches(symbols):
            longest[at] = token
        size, shorter = self.trie.size, self.trie.shorter
        last, taken = np.full(len(symbols), -1, np.int32), np.full(len(symbols), -1, np.int32)  # by place: the token that ends before it, that begins there
        dead = np.zeros(len(symbols), bool)
        at, end, token = starts, ends, longest[starts]
        while at.size:
            here = token >= 0
            after = at + size[token]
            fits = here & ~dead[np.where(here, after, at)]
            fits[fits] = self.pairs(last[at[fits]], token[fits])
            back = np.flatnonzero(~here)
            go = np.flatnonzero(fits)
            taken[at[go]] = token[go]
            last[after[go]] = token[go]
            token = np.where(here, shorter[token], -1)
            if back.size:
                left = last[at[back]]
                if (left < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                dead[at[back]] = True  # whatever stands before: a place reached by a token fails or goes on as a whole
                at = at.copy()
                at[back] -= size[left]
                token[back] = shorter[left]
            at = np.where(fits, after, at)
            token[go] = longest[at[go]]
            on = at < end
            at, end, token = at[on], end[on], token[on]
        on_path, at, end = np.zeros(len(symbols), bool), starts, ends
        while at.size:
            on_path[at] = True
            at = at + size[taken[at]]
            on = at < end
            at, end = at[on], end[on]
        ids = self.rank[taken[on_path]].tobytes()
        upto = 4 * np.concatenate([[0], np.cumsum(on_path)])
        for i, a, b in zip(together, upto[starts].tolist(), upto[ends].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        text = data.decode("latin-1")
        n, at, ids = len(text), 0, []
        rank_of, size, beside, alone, most, longest = self.rank_of.get, self.size, self.beside, self.alone, self.longest, self.automaton.longest_prefix
        dead = bytearray(n + 1)
        left = [-1] * n  # by place: the longest length that is still to be tried; -1 before the first visit
        while at < n:
            k = left[at]
            if k < 0:
                k = longest(text[at : at + most])  # no token that fits here is longer
            while k:
                if not dead[at + k]:
                    rank = rank_of(text[at : at + k])
                    if rank is not None and (beside[ids[-1], rank] if ids else alone[rank]):
                        break
                k -= 1
            if k:
                left[at] = k - 1
                ids.append(rank)
                at += k
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1  # whatever stands before: a place reached by a token fails or goes on as a whole
                left[at] = -1
                at -= size[ids.pop()]
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after another's, and where each text's end."""
        pieces = list(map(self.split, texts))
        known = set().union(*pieces)
        self.kept.fill(known)
        ids = [b"".join(map(self.kept.__getitem__, own)) for own in pieces]
        for p in known:
            if len(p) > LONGEST_KEPT:
                del self.kept[p]
        return np.frombuffer(b"".join(ids), np.int32), np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def caches(self) -> list:
        return [self.kept, self.beside]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def encoder(rank_file: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(rank_file, pattern)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, check: bool = False) -> DataFrame:
    """doc_id, ids of every row of `docs`; with `check` also round_trip, whether the ids decode to the text. The rank file must
    be at the same path on every executor."""
    file, split = (rank_file, pattern) if rank_file and pattern else public_vocabulary()
    schema = "doc_id long, ids array<int>" + ", round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file, split)
        for batch in batches:
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, end in portions(all_texts):
                part, texts = batch.slice(i, end - i), all_texts[i:end]
                ids, ends = bpe.encode_all(texts)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))]
                if check:
                    columns.append(pa.array([x == t.encode("utf-8") for x, t in zip(bpe.own_bytes.split(ids, ends), texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run, lambda: encoder(file, split).caches()), schema)


def digests(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; encoding, decoding and digests in one pass, so no ids travel."""
    file, split = (rank_file, pattern) if rank_file and pattern else public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file, split)
        for batch in batches:
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, end in portions(all_texts):
                ids, ends = bpe.encode_all(all_texts[i:end])
                said = [hashlib.sha256(x[:-1]).hexdigest() for x in bpe.decimals.split(ids, ends)]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.own_bytes.split(ids, ends)]
                columns = [batch.column(0).slice(i, end - i), pa.array(np.diff(ends, prepend=0)), pa.array(said), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run, lambda: encoder(file, split).caches()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
