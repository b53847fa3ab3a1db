"""Exact token counts of every prefix of a text, for a sentencepiece BPE model with byte fallback.

The last token of a prefix's encoding decides the rest: if t is that token, what comes before is the encoding of the prefix without t. So for
each prefix, tokens that end there are tried, longest first, until one can stand beside the last token of the prefix it leaves; its
count is one more than that prefix's. Two tokens can stand side by side if merging their characters gives just these two (worked
out once a pair and kept). Counts of all prefixes are stored as one small difference a character. The words of a batch go through
these steps together, prefixes of 1 character first; long words and those after more than one mark go one by one.

No piece but runs of the space mark has that mark after its first character, so a text falls into words that begin with the mark and
don't affect one another, and a word's differences are worked out once. Runs of marks merge among themselves only after every
other merge, so what a run gives is a function of its length.

A table answers budget questions without encoding again: the count of any prefix, the longest prefix within a budget.

Defined results: null text counts as empty; empty text has 0 tokens; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored. A prefix is counted as a text of its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Memo, tidied
from strandloom.llm.merges import Kept, Merges, Pairs, Trie, laid_out, portions

MARK = "▁"
LONGEST_KEPT = 48
SHORT = 40


class PrefixCounter:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.runs = {p: s for p, s in self.score.items() if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p[1:] for p in self.score if p not in self.runs):
            raise ValueError("a piece has the space mark inside")
        for p in self.runs:
            del self.score[p]
        if self.runs and max(self.runs.values()) >= min(s for p, s in self.score.items() if len(p) > 1):
            raise ValueError("runs of the space mark must merge last")
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.merges = Merges({p: -s for p, s in self.score.items()})
        self.pieces = list(self.score)
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        self.trie = Trie([self.letter[np.frombuffer(p.encode("utf-32-le"), np.uint32)].tolist() for p in self.pieces], len(letters))
        self.pairs = Pairs(lambda a, b: self.merges.beside(self.pieces[a] if a >= 0 else "", self.pieces[b]), len(self.pieces))
        self.beside = Memo(lambda pair: self.merges.beside(*pair), 100_000)
        self.alone = Memo(lambda t: self.merges.beside("", t), 100_000)
        self.kept = Kept(self.words_differences, 400_000)
        self.run_count = Memo(lambda n: len(self.merged(MARK * n, self.runs)), 100_000)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def merged(self, text: str, score: dict[str, float]) -> list[str]:
        """The merges as defined: the pair of the highest score, the leftmost of equals."""
        if len(text) <= SHORT:
            short = list(text)
            while True:
                best, at, left = None, -1, ""
                for i, right in enumerate(short):
                    value = score.get(left + right) if left else None
                    if value is not None and (best is None or value > best):
                        best, at = value, i
                    left = right
                if at < 0:
                    return short
                short[at - 1 : at + 1] = [short[at - 1] + short[at]]
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(-score[a + b], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a + b in score]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                new = pair + parts[after[i]]
                if new in score:
                    heapq.heappush(heap, (-score[new], i, new))
            if before[i] >= 0:
                new = parts[before[i]] + pair
                if new in score:
                    heapq.heappush(heap, (-score[new], before[i], new))
        return [p for p in parts if p is not None]

    def words_differences(self, words: list[str]) -> list[bytes]:
        """`word` of each: as columns those of one mark and up to LONGEST_KEPT characters, the others one by one."""
        out: list[bytes] = [b""] * len(words)
        together = []
        for i, w in enumerate(words):
            if 1 < len(w) <= LONGEST_KEPT and w[0] == MARK != w[1]:
                together.append(i)
            else:
                out[i] = self.word(w)
        if not together:
            return out
        joined = "\0".join([words[i] for i in together]) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends, column = laid_out([len(words[i]) for i in together])
        symbols = self.letter[code]
        symbols[ends] = 0
        # by length and column of their first characters, places and pieces that match there
        found = []
        for at, piece in self.trie.matches(symbols):
            order = np.argsort(column[at].astype(np.uint8), kind="stable")
            found.append((at[order], piece[order], np.concatenate([[0], np.cumsum(np.bincount(column[at], minlength=LONGEST_KEPT + 1))]).tolist()))
        by_column = np.argsort(column.astype(np.uint8), kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=LONGEST_KEPT + 2))]).tolist()
        n_bytes = 1 + (code > 0x7F).astype(np.int16) + (code > 0x7FF) + (code > 0xFFFF)
        last, count = np.full(len(code), -1, np.int32), np.zeros(len(code), np.int16)  # by place: of the prefix that ends before it
        for end in range(1, int(column.max()) + 1):
            here = by_column[edge[end] : edge[end + 1]]
            count[here] = count[here - 1] + n_bytes[here - 1]  # stays where no piece ends with this character
            for k in range(min(end, len(found)), 0, -1):
                places, pieces, bounds = found[k - 1]
                lo, hi = bounds[end - k], bounds[end - k + 1]
                if lo == hi:
                    continue
                at, t = places[lo:hi], pieces[lo:hi]
                open_ = last[at + k] < 0
                at, t = at[open_], t[open_]
                fits = self.pairs(last[at], t)
                at, t = at[fits], t[fits]
                last[at + k] = t
                count[at + k] = count[at] + 1
        table = np.diff(count, append=np.int16(0))
        table[starts] = 1  # the mark
        raw = table.astype(np.int8).tobytes()
        for i, a, b in zip(together, starts.tolist(), ends.tolist(), strict=True):
            out[i] = raw[a:b]
        return out

    def word(self, word: str) -> bytes:
        """Differences of the counts of the prefixes of a run of marks and what follows it (without marks)."""
        score, beside = self.score, self.beside
        marks = 0
        while marks < len(word) and word[marks] == MARK:
            marks += 1
        base = max(0, marks - 1)  # the last mark belongs to the word
        own = word[base:]
        n = len(own)
        last = [""] * (n + 1)  # "" at 0 and after a character that no piece has
        count = [0] * (n + 1)
        bare = [False] * (n + 1)  # whether the word's first mark stands alone, and so joins the run before it
        done = 0
        for end, t in self.automaton.iter(own):  # at each end the longest first
            if end < done:
                continue
            while done < end:  # no piece ends with this character
                count[done + 1] = count[done] + len(own[done].encode("utf-8", "surrogatepass"))
                bare[done + 1] = bare[done]
                done += 1
            j = end + 1 - len(t)
            before = last[j]
            if beside[before, t] if before else self.alone[t]:
                done = end + 1
                last[done], count[done] = t, count[j] + 1
                bare[done] = bare[j] if j else t == MARK
        while done < n:
            count[done + 1] = count[done] + len(own[done].encode("utf-8", "surrogatepass"))
            bare[done + 1] = bare[done]
            done += 1
        if marks:
            run = self.run_count
            before, alone, held = run[marks], run[base], run[marks] - 1
            out = [run[k] - run[k - 1] for k in range(1, marks + 1)]
            count = [c + (held if b else alone) for c, b in zip(count[2:], bare[2:], strict=True)]
        else:
            before, out, count = 0, [], count[1:]
        for c in count:
            out.append(c - before)
            before = c
        return bytes([d & 255 for d in out])

    def differences_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text one number a character: what it adds to the count of tokens of the prefix before it."""
        words = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        kept, known = self.kept, set().union(*words)
        long = {w for w in known if len(w) > LONGEST_KEPT}
        kept.fill(known - long if long else known)
        out = []
        for own in words:
            if long and not long.isdisjoint(own):
                table = b"".join([kept[w] if len(w) <= LONGEST_KEPT else self.word(w) for w in own])
            else:
                table = b"".join(map(kept.__getitem__, own))
            d = np.frombuffer(table, np.int8)
            if len(d):
                d = d[1:].copy()  # the mark put before the text is no character of it
                d[0] += table[0] if table[0] < 128 else table[0] - 256
            out.append(d)
        return out

    def differences(self, text: str) -> np.ndarray:
        return self.differences_of([text])[0]

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix, from the first character's on."""
        return np.cumsum(self.differences(text), dtype=np.int64)


@lru_cache(2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prefix_counts(docs: DataFrame, budget: int = 4096, model_file: str | None = None, keep_table: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chars_in_budget (the longest prefix of `budget` tokens or fewer) and, if kept, prefix_table:
    one signed byte a character; the sum of the first k is the count of the first k characters."""
    file = model_file or public_model()
    schema = "doc_id long, n_bytes long, n_tokens long, n_chars_in_budget long" + ", prefix_table binary" * keep_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(file)
        for batch in batches:
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, end in portions(all_texts):
                part, texts = batch.slice(i, end - i), all_texts[i:end]
                tables = pieces.differences_of(texts)
                tokens, within = [], []
                for t in tables:
                    n = int(t.sum(dtype=np.int64))
                    tokens.append(n)
                    if n <= budget:
                        within.append(len(t))
                    else:
                        within.append(int(np.flatnonzero(np.cumsum(t, dtype=np.int64) <= budget)[-1]) + 1 if t[0] <= budget else 0)
                columns = [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(within, pa.int64())]
                if keep_table:
                    columns.append(pa.array([t.tobytes() for t in tables], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run, lambda: [counter(file).kept, counter(file).beside]), schema)
