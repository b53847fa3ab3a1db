"""Exact removal of repeated word passages, found by recompression.

Words of a document become 64-bit symbols. Rounds then shrink the sequence: the first names runs of one symbol, the others name
pairs, where a global coin (a bit of the symbol's hash in that round) makes each symbol a left or a right one and every
left-right pair merges. A name is a hash of what it stands for, so it is global without a table: equal content has the same
name in every document and on every executor. Which symbols lie inside a window whatever surrounds it can be told from the
window alone: a round takes away at each end only the symbol that might have merged with something outside. So equal windows
have equal interior symbols at equal places in every round. The first interior symbol of the last round that leaves any is the
window's owner.

1. Names of owners are gathered by buckets in Spark; names that occur more than once are marked in a bit table of fixed size (a
   hash of the name within its bucket; a marked bit that stands for another name only lets more windows through).
2. Windows whose owner is marked are compared in full, by a hash of all their words, among windows with the same owner's bucket.
   A task first keeps the earliest of equal windows that it has itself; the others are surely repeats. So a passage in a third of
   all documents reaches its bucket once a batch, and no group holds all its occurrences.
3. The positions come back to the documents by doc_id, and covered words go.

Defined results: null text has no words; rows with a null doc_id lose nothing and nothing is a repeat of them; repeated rows of
one doc_id are one document, so none is a repeat of another; rows of one doc_id with different texts lose the places that any of them loses; texts of fewer than `window` words lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import U64, mix, split_runs, tidied

ROUNDS = 12
COINS = np.arange(ROUNDS + 1, dtype=U64) * U64(0xA0761D6478BD642F)
BASE = U64(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
TABLE_BITS = 1 << 28
WORDS_AT_ONCE = 150_000

SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LONG_WORD = 64  # bytes; longer words are hashed one by one

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, U64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 1 << 24:
            _powers[int(base)] = known
    return known[:n]


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and a 64-bit symbol of each word: a hash of its bytes, made for all words at once from running sums over the bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(raw):
        return np.zeros(len(texts), np.int64), np.zeros(0, U64)
    space = SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    edge[1:] |= np.append(space, True)[:-1]
    first = np.flatnonzero(~space & edge[:-1])
    edge[:-1] = space
    edge[at] = True
    edge[:-1] |= space
    stop = np.flatnonzero(~space & edge[1:]) + 1
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(LETTERS[raw] * powers(BASE_INVERSE, len(raw)), out=sums[1:])
    symbols = mix((sums[stop] - sums[first]) * powers(BASE, len(raw))[first])
    for k in np.flatnonzero(stop - first > LONG_WORD).tolist():
        symbols[k] = xxhash.xxh3_64_intdigest(raw[first[k] : stop[k]].tobytes())
    return np.diff(np.searchsorted(first, at)), symbols


class Windows:
    """All windows of some documents, in order: which document, first word, owner's name, hash of all words."""

    def __init__(self, texts: pa.Array, window: int):
        self.n_words, symbols = word_symbols(texts)
        n = self.n_words
        begin = np.cumsum(n) - n
        per = np.maximum(n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), per)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        first = begin[self.doc] + self.at
        self._hash(symbols, first, window)
        self._owners(symbols, np.repeat(np.arange(len(n), dtype=np.int32), n), first, window)

    def _hash(self, symbols: np.ndarray, first: np.ndarray, window: int) -> None:
        total = len(symbols)
        sums = np.zeros(total + 1, U64)
        np.cumsum(symbols * powers(BASE_INVERSE, total), out=sums[1:])
        scale = powers(BASE, total + 1)
        self.hash = mix((sums[first + window] - sums[first]) * scale[first])

    def _owners(self, s: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int) -> None:
        name, owner = np.empty(len(first), U64), np.empty(len(first), np.int64)
        live = np.arange(len(first))
        lo, hi = first, first + window  # symbols that are inside, of this round
        place = np.arange(len(s))  # first word of each symbol
        for level in range(ROUNDS + 1):
            if level == ROUNDS or not len(live):
                break
            n = len(s)
            if not level:
                starts = np.ones(n, bool)
                starts[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
                new = np.cumsum(starts) - 1
                heads = np.flatnonzero(starts)
                length = np.diff(np.append(heads, n))
                nlo, nhi = new[lo] + 1, new[hi - 1]  # the runs at both ends may go on outside
                s2 = np.where(length > 1, mix(s[heads] + length.astype(U64) * U64(0xD6E8FEB86659FD93)), s[heads])
            else:
                left = (mix(s + COINS[level]) & U64(1)).astype(bool)
                merges = np.zeros(n, bool)
                merges[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
                starts = np.ones(n, bool)
                starts[1:] = ~merges[:-1]
                new = np.cumsum(starts) - 1
                heads = np.flatnonzero(starts)
                s2 = s[heads]
                pair = merges[heads]
                s2[pair] = mix(s2[pair] * U64(0xE7037ED1A0B428DB) + mix(s[heads[pair] + 1] + U64(level)))
                nlo = lo + ~left[lo]  # a right symbol may have merged with what is before
                nhi = hi - left[hi - 1]
                some = nlo < nhi
                nlo, nhi = np.where(some, new[np.minimum(nlo, n - 1)], 1), np.where(some, new[np.maximum(nhi, 1) - 1] + 1, 0)
            over = nlo >= nhi
            done = live[over]
            at = lo[over]
            name[done], owner[done] = mix(s[at] + U64(level)), place[at]
            live, lo, hi = live[~over], nlo[~over], nhi[~over]
            s, place, doc = s2, place[heads], doc[heads]
        if len(live):
            name[live], owner[live] = mix(s[lo] + U64(ROUNDS)), place[lo]
        self.name, self.owner = name, owner


def whole_texts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about WORDS_AT_ONCE words; a text is never cut."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(sizes.astype(float)).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > WORDS_AT_ONCE * 6:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def buckets_for(rows: int) -> int:
    """A power of two that grows with the table, so that a bucket holds the names of some tens of documents."""
    return 1 << max(8, min(18, (max(rows, 1) // 64).bit_length()))


def _names(buckets: int, window: int):
    """(bucket, names): names of owners, each once, or twice if it occurred more often."""
    shift = U64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            names = np.sort(np.concatenate(held))
            held.clear()
            keep = np.ones(len(names), bool)
            keep[2:] = names[2:] != names[:-2]
            names = names[keep]
            runs = split_runs(names >> shift)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in runs], pa.int32()), pa.array([names[a:b].tobytes() for _, a, b in runs], pa.binary())], ["bucket", "names"])

        for batch in batches:
            for part in whole_texts(batch, 1):
                w = Windows(part.column(1), window)
                new = np.ones(len(w.name), bool)
                new[1:] = (w.owner[1:] != w.owner[:-1]) | (w.name[1:] != w.name[:-1])
                held.append(w.name[new])
                if sum(map(len, held)) > 1_500_000:
                    yield out()
        if held:
            yield out()

    return run


def _mark(bits: int):
    """Bits of the names that occur more than once, for one bucket."""

    def run(t: pa.Table) -> pa.Table:
        names = np.sort(np.frombuffer(b"".join(t.column("names").to_pylist()), U64))
        twice = names[1:][names[1:] == names[:-1]]
        marks = np.zeros(bits, np.uint8)
        marks[(mix(twice) % U64(bits)).astype(np.int64)] = 1
        return pa.table([t.column("bucket").slice(0, 1), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["bucket", "marks"])

    return run


def _candidates(buckets: int, bits: int, marks, window: int):
    """(bucket, kind, blob). kind 0: hashes, differences of doc_ids and of first words of windows that may be repeats; kind 1: doc_id, first words of windows that surely are."""
    shift = U64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(marks.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            bucket, key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((at, doc, key, bucket))
            bucket, key, doc, at = bucket[order], key[order], doc[order], at[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            later = (doc != doc[head]) | (at != at[head])  # repeated rows of one document are one occurrence
            b1, k1, d1, a1 = bucket[first], key[first], doc[first], at[first]
            order = np.lexsort((a1, d1, b1))  # neighbours of one document differ little, so differences compress well
            b1, k1, d1, a1 = b1[order], k1[order], d1[order], a1[order]
            rows = [(k, 0, k1[a:b].tobytes() + np.diff(d1[a:b], prepend=0).tobytes() + np.diff(a1[a:b], prepend=np.int32(0)).tobytes()) for k, a, b in split_runs(b1)]
            doc, at = doc[later], at[later]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            rows += [(k % buckets, 1, doc[a : a + 1].tobytes() + at[a:b].tobytes()) for k, a, b in split_runs(doc)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            for part in whole_texts(batch, 1):
                w = Windows(part.column(1), window)
                bucket = (w.name >> shift).astype(np.int64)
                at = bucket * bits + (mix(w.name) % U64(bits)).astype(np.int64)
                hit = np.flatnonzero((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                held.append((bucket[hit].astype(np.int32), w.hash[hit], ids[w.doc[hit]], w.at[hit].astype(np.int32)))
                if sum(len(x[0]) for x in held) > 700_000:
                    yield out()
        if held:
            yield out()

    return run


def _repeats(t: pa.Table) -> pa.Table:
    """(doc_id, firsts): first words of the windows of a bucket that start earlier elsewhere."""
    blobs, kinds = t.column("blob").to_pylist(), t.column("kind").to_pylist()
    sure = [(x[:8], x[8:]) for x, k in zip(blobs, kinds, strict=True) if k]
    rows: dict[int, list[bytes]] = {}
    for d, x in sure:
        rows.setdefault(int.from_bytes(d, "little", signed=True), []).append(x)
    cut = [(x, len(x) // 20) for x, k in zip(blobs, kinds, strict=True) if not k]
    if cut:
        key = np.frombuffer(b"".join(x[: 8 * n] for x, n in cut), U64)
        doc = np.concatenate([np.cumsum(np.frombuffer(x, np.int64, n, 8 * n)) for x, n in cut])
        at = np.concatenate([np.cumsum(np.frombuffer(x, np.int32, n, 16 * n), dtype=np.int32) for x, n in cut])
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        later = (doc != doc[head]) | (at != at[head])
        doc, at = doc[later], at[later]
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        for d, a, b in split_runs(doc):
            rows.setdefault(d, []).append(at[a:b].tobytes())
    return pa.table([pa.array(list(rows), pa.int64()), pa.array([b"".join(x) for x in rows.values()], pa.binary())], ["doc_id", "firsts"])


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, firsts): packed first words (32-bit) of windows whose words also start earlier; several rows a document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    buckets = buckets_for(docs.count())
    bits = TABLE_BITS // buckets
    names = docs.mapInArrow(tidied(_names(buckets, window)), "bucket int, names binary")
    table = np.zeros((buckets, bits // 8), np.uint8)
    for bucket, marks in names.groupBy("bucket").applyInArrow(_mark(bits), "bucket int, marks binary").toLocalIterator():  # TABLE_BITS in all
        table[bucket] = np.frombuffer(marks, np.uint8)
    marks = spark.sparkContext.broadcast(table.tobytes())
    return docs.mapInArrow(tidied(_candidates(buckets, bits, marks, window)), "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(_repeats, "doc_id long, firsts binary")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                n_words, n_removed, kept = [], [], []
                for text, firsts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    if firsts:
                        steps = np.zeros(len(words) + 1, np.int64)
                        for x in firsts:
                            at = np.frombuffer(x, np.int32)
                            at = at[at + window <= len(words)]  # an id may come with texts of several lengths
                            np.add.at(steps, at, 1)
                            np.add.at(steps, at + window, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by one space) of every row of `docs`."""
    found = repeated_windows(docs, window).groupBy("doc_id").agg(F.collect_list("firsts").alias("firsts"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(found, "doc_id", "left").select("doc_id", "text", "firsts").mapInArrow(tidied(_cut(window)), "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, window: int = 20) -> DataFrame:
    return without_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """`docs` with repeated passages cut out of `text` (texts that lose nothing stay as they are) and n_chars brought up to date; rows and columns unchanged."""
    found = repeated_windows(docs, window).groupBy("doc_id").agg(F.collect_list("firsts").alias("_strandloom_firsts"))
    names, schema = docs.columns, docs.schema
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut(window)
        for batch in batches:
            ids, texts, firsts = (batch.column(i) for i in (names.index("doc_id"), where, batch.num_columns - 1))
            done = pa.Table.from_batches(cut([pa.RecordBatch.from_arrays([ids, texts, firsts], ["a", "b", "c"])]))
            if not done.num_rows:
                continue
            new = [k if r else t for t, k, r in zip(texts.to_pylist(), done.column("kept").to_pylist(), done.column("n_removed").to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[where] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if r else c for t, r, c in zip(new, done.column("n_removed").to_pylist(), columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.join(found, "doc_id", "left").select(*[F.col(c) for c in names], "_strandloom_firsts").mapInArrow(tidied(run), schema)
