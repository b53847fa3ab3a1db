"""Each operator against brute force, and its defined results for nulls, empty and long texts, repeated rows, empty tables, other columns."""

import hashlib
import html.parser
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
WORDS = [f"{a}{b}" for a in "ka lo mi nu pe ra si to vu wy".split() for b in "an bel cor dis eth fin".split()]
WORDS_ = lambda t: re.findall(r"[^\W\d_]+", t.lower())
TEXT = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts, first=0):
    return [(first + i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    a, b = TEXT(120), TEXT(80)
    near = a.split()
    near[60] = "changed"
    passage = TEXT(60)
    return [a, b, a, " ".join(near), None, "", "one", "two words", passage + " " + TEXT(30), TEXT(25) + "\n" + passage, "x " * 70, b + "\t" + b, "é Ünï 日本 " * 30, TEXT(20_000), "A b C", "a B c", a]


@pytest.fixture(scope="module")
def docs(spark, texts):
    table = spark.createDataFrame(rows(texts), DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    return table.unionByName(table.where("doc_id = 1"))  # a repeated row


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def test_null_ids_pass_through(spark, texts):
    from strandloom.llm import bpe, decontam, embeddings, near_copies, sharding, simhash, substring, token_counts, toxicity

    table = spark.createDataFrame([(1, texts[0], None, None, None), (None, texts[0], None, None, None), (None, None, None, None, None)], DOCS).withColumn("firsts", F.lit(1))
    assert near_copies.keep_one_of_each(table).count() == 3
    assert simhash.near_duplicates(table).count() == 3 and simhash.keep_one_of_each(table).count() == 3
    assert sorted(r["n_removed"] for r in substring.digests(table).collect()) == [0, 0, 0]
    assert substring.remove_repeats(table).columns == table.columns and substring.remove_repeats(table).count() == 3
    bench = spark.createDataFrame([(None, texts[1]), (5, None)], "item_id long, text string")
    assert decontam.without_repeats(table, bench).count() == 3
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(table, labels).count() == 3 and toxicity.without_toxic(table, labels).count() == 3
    assert bpe.digests(table).count() == token_counts.prefix_counts(table).count() == sharding.byte_shards(table).count() == 3
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (None, None), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["n_links"]) for r in embeddings.near_duplicates(vectors).collect()} == {(None, 0), (3, 0)}


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_equals_brute_force(docs, none, texts):
    from strandloom.llm.simhash import keep_one_of_each, near_duplicates

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum((2 * c > len(shingles)) << b for b, c in enumerate(bits))

    fps = list(map(fingerprint, texts))
    expected = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    assert all(r["fp"] & (2**64 - 1) == fps[r["doc_id"]] and r["component_id"] == expected[r["doc_id"]] for r in got)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(expected)
    assert near_duplicates(none).count() == 0


def test_simhash_links_by_bits(spark):
    from strandloom.llm.simhash import links_forest

    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    flip = lambda x, n: x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, n, replace=False)))
    fps = np.unique(np.concatenate([base, *[[flip(x, n) for x in base] for n in (1, 2, 3, 4, 5)]]))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    found = links_forest(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    where = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(where[a["u"]], where[a["v"]]) for a in found]
    assert set(map(frozenset, pairs)) <= set(map(frozenset, links))
    assert components(len(fps), pairs) == components(len(fps), links)


def test_simhash_links_of_crowded_anchors(spark, monkeypatch):
    from strandloom.llm import simhash

    monkeypatch.setattr(simhash, "RESIDENTS", 3)
    monkeypatch.setattr(simhash, "VISITORS", 5)
    r = np.random.default_rng(4)
    one, two = r.integers(0, 2**63, 2, dtype=np.uint64)  # the high half of each pair is the same, so anchors are crowded
    fps = np.unique(np.concatenate([[x ^ np.uint64(k << 40), x ^ np.uint64(k << 40) ^ np.uint64(0b111 << s)] for x in (one, two) for k, s in zip(r.integers(0, 2**23, 150).tolist(), r.integers(0, 37, 150).tolist())]).astype(np.uint64))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    found = simhash.links_forest(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    where = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert len(links) >= 300 and components(len(fps), [(where[a["u"]], where[a["v"]]) for a in found]) == components(len(fps), links)


def similar(texts, least=0.8):
    """Pairs of Jaccard similarity `least` or more on five-word shingles."""
    lists = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in lists]
    return [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


@pytest.mark.parametrize("tight", [False, True])
def test_near_copies_equal_brute_force(spark, docs, none, texts, monkeypatch, tight):
    from strandloom.llm import near_copies

    if tight:  # crowded anchors are dealt to many blocks
        monkeypatch.setattr(near_copies, "RESIDENTS", 7)
        monkeypatch.setattr(near_copies, "VISITORS", 11)
        monkeypatch.setattr(near_copies, "TILE", 5)
        monkeypatch.setattr(near_copies, "APART", 64)
    r = random.Random(6)

    def edited(t, n):
        w = t.split()
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    bases = [TEXT(150) for _ in range(6)]
    many = [*texts, *bases, *[edited(bases[0], 2) for _ in range(40)], *[edited(bases[1], r.randint(1, 9)) for _ in range(40)], *[edited(bases[2], 1).upper() for _ in range(3)], "four words are here", "four words  are here"]
    for _ in range(8):  # a chain: each near the one before
        many.append(edited(many[-1] if len(many[-1]) > 99 else bases[3], 2))
    links = similar(many)
    expected = components(len(many), links)
    table = spark.createDataFrame(rows(many), DOCS).withColumn("key", F.lit("clash")).withColumn("label", F.lit(1)).repartition(3)
    table = table.unionByName(table.where("doc_id = 20"))
    got = {q["doc_id"]: q["component_id"] for q in near_copies.near_copies(table).collect()}
    assert len(got) == len(many) and all(expected[c] == expected[d] and c <= d for d, c in got.items())  # nothing joined that isn't similar
    near = [(i, j) for i, j in links if got[i] == got[j]]
    assert len(near) >= 0.9 * len(links) > 200 and all(got[i] == got[j] for i, j in similar(many, 0.9))
    kept = near_copies.keep_one_of_each(table)
    assert kept.columns == table.columns and {q["doc_id"] for q in kept.collect()} == set(got.values())
    assert near_copies.near_copies(none).count() == 0 and near_copies.keep_one_of_each(none).count() == 0


def test_components_of_chains_and_stars(spark):
    from strandloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 300)] + [(7, i) for i in range(400, 700)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 7: 7, **{i: 7 for i in range(400, 700)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, window=20):
    """By doc_id; repeated rows of one document are one."""
    seen, out = {}, {}
    lists = {d: (t or "").encode().split() for d, t in texts}
    for d in sorted(lists):
        for i in range(len(lists[d]) - window + 1):
            seen.setdefault(tuple(lists[d][i : i + window]), (d, i))
    for d, w in lists.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_equals_brute_force(docs, none, texts):
    from strandloom.llm.substring import digests, remove_repeats

    expected = removed(list(enumerate(texts)))
    got = digests(docs).collect()
    assert len(got) == len(texts) + 1  # document 1 comes twice
    for r in got:
        n, gone, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest()), r["doc_id"]
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts) + 1
    for r in cut.collect():
        n, gone, kept = expected[r["doc_id"]]
        assert r["text"] == (kept.decode() if gone else texts[r["doc_id"]])
        assert not gone or r["n_chars"] == len(r["text"])
    assert digests(none).count() == 0


def test_substring_keeps_repeated_rows(spark):
    from strandloom.llm.substring import digests, remove_repeats

    a, b = TEXT(60), TEXT(70)
    table = spark.createDataFrame(rows([a]) * 3 + rows([f"{b} {a}", b], 1) + rows([b[:80]], 2), DOCS).repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in digests(table).collect())
    assert got == [(0, 60, 0)] * 3 + [(1, 130, 60), (2, len(b[:80].split()), 0), (2, 70, 70)]
    assert sorted(r["text"] for r in remove_repeats(table).where("doc_id = 0").collect()) == [a] * 3


def test_word_symbols():
    from strandloom.llm.substring import word_symbols

    texts = [None, "", " ", "a b", "b a", "\ta\x0bb\n", "ab", "é\u00a0x y", "w" * 70 + " " + "w" * 71, "a"]
    lists = [(t or "").encode().split() for t in texts]
    for column in (pa.array(texts), pa.array(["x y z", *texts, "tail"]).slice(1, len(texts))):
        n, symbols = word_symbols(column)
        assert n.tolist() == list(map(len, lists))
        words = [w for ws in lists for w in ws]
        assert all((words[i] == words[j]) == (symbols[i] == symbols[j]) for i in range(len(words)) for j in range(len(words)))


def test_recompression_owners_depend_on_the_window_alone():
    from strandloom.llm.substring import Windows

    inside = TEXT(45)
    w = Windows(pa.array([f"{TEXT(33)} {inside} {TEXT(9)}", f"{TEXT(4)} {inside}", "the " * 50]), 20)
    one = {int(h): (int(n), int(o - a)) for h, n, o, a in zip(w.hash[w.doc == 0], w.name[w.doc == 0], w.owner[w.doc == 0], w.at[w.doc == 0])}
    two = [(int(h), int(n), int(o - w.n_words[0] - a)) for h, n, o, a in zip(w.hash[w.doc == 1], w.name[w.doc == 1], w.owner[w.doc == 1], w.at[w.doc == 1])]
    same = [(h, n, o) for h, n, o in two if h in one]
    assert len(same) >= 26 and all(one[h] == (n, o) for h, n, o in same)


def test_bpe_equals_library(docs, none, texts):
    import tiktoken

    from strandloom.llm.bpe import digests, encoded, encoder, public_vocabulary

    own = encoder(*public_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_vocabulary()[1], mergeable_ranks=own.ranks, special_tokens={})
    for t in [*filter(None, texts), "a" * 3000, "  \n\n x  ", "'s 'll 12345 !!??", "日本語テキスト" * 50, "\U0001f600‍ ok", "<|endoftext|>"]:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    for r in digests(docs).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert encoded(docs, check=True).where("not round_trip").count() == 0
    assert digests(none).count() == 0


def test_bpe_takes_pieces_together(tmp_path, monkeypatch):
    """Short pieces go through the backtracking together, with the ids that they have one by one and in the library, also where it has to go back, and with tokens that no merges give."""
    import base64

    import tiktoken

    from strandloom.llm.bpe import LONGEST_KEPT, BytePairEncoder, public_vocabulary

    r, file = random.Random(9), tmp_path / "own.tiktoken"
    some = ["ab", "bc", "abc", "cd", "abcd", "da", "bcda", "aa", "aaa", "aaaa", "dab", "cdab", "bb", "é", "é日", "aab", "baab", "cdcd", "abab", "badcab"]
    file.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([bytes([b]) for b in range(256)] + [t.encode() for t in some])))
    pattern = public_vocabulary()[1]
    for own, letters in ((BytePairEncoder(str(file), pattern), "abcd"), (BytePairEncoder(*public_vocabulary()), "aeinrst 'é日1.\n\U0001f600")):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
        pieces = sorted({p for _ in range(3000) for p in own.split("".join(r.choice(letters) for _ in range(r.randint(1, 40))))})
        long, alone = ["abcd" * 30, "x" * 65], []
        with monkeypatch.context() as m:
            m.setattr(own, "encode_piece", lambda data, f=own.encode_piece: alone.append(data.decode()) or f(data))
            got = [np.frombuffer(x, np.int32).tolist() for x in own.encode_pieces(pieces + long)]
        assert alone == long and all(len(p.encode()) <= LONGEST_KEPT for p in pieces)
        assert got == [own.encode_piece(p.encode()) for p in pieces + long]
        texts = ["", *("".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(200)), "", *long]
        own.kept.most = 1  # whatever is kept goes, the results stay
        for _ in range(2):
            ids, ends = own.encode_all(texts)
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode_ordinary(t) for t in texts]
            assert list(own.own_bytes.split(ids, ends, 7)) == [t.encode() for t in texts]
            assert list(own.decimals.split(ids, ends)) == ["".join(f"{i} " for i in x).encode() for x in np.split(ids, ends[:-1])]


def test_prefix_counts_equal_library(docs, none, texts):
    import sentencepiece

    from strandloom.llm.token_counts import counter, prefix_counts, public_model

    library, own = sentencepiece.SentencePieceProcessor(model_file=public_model()), counter(public_model())
    r = random.Random(5)
    for t in ["", " ", "   a", "a" + " " * 40, "▁▁ ﬁ ▁", *("".join(r.choice(" ▁aebth.é\n\tﬁ日") for _ in range(40)) for _ in range(150))]:
        assert own.counts(t).tolist() == [len(library.encode(t[: i + 1])) for i in range(len(t))], repr(t)
    for r in prefix_counts(docs, budget=50).collect():
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(library.encode(t)))
        assert len(library.encode(t[: r["n_chars_in_budget"]])) <= 50
        assert np.frombuffer(r["prefix_table"], np.int8).sum() == r["n_tokens"] and len(r["prefix_table"]) == len(t)
    assert prefix_counts(none).count() == 0


def test_prefix_counts_take_words_together(monkeypatch):
    """Short words of one mark go as columns, with the differences that they have one by one; whether pieces stand beside one another is as the merges say."""
    from strandloom.llm.token_counts import LONGEST_KEPT, MARK, PrefixCounter, public_model

    own, r, alone = PrefixCounter(public_model()), random.Random(3), []
    short = [MARK + "".join(r.choice("aeinrst.,é\nﬁ日\0\U0001f600") for _ in range(r.randint(1, LONGEST_KEPT - 1))) for _ in range(2000)] + [MARK + w for w in WORDS]
    other = [MARK, MARK * 3, MARK * 2 + "ab", MARK + "abc" * 40]
    expected = [own.word(w) for w in short + other]
    monkeypatch.setattr(own, "word", lambda w, f=own.word: alone.append(w) or f(w))
    assert own.words_differences(short + other) == expected and alone == other
    pairs = [(r.choice(own.pieces), r.choice(own.pieces)) for _ in range(3000)]
    pairs += [(p[:i], p[i:]) for p in r.sample(own.pieces, 2000) for i in range(1, len(p)) if p[:i] in own.score and p[i:] in own.score]
    pairs += [(a + b, b) for a, b in zip(WORDS, WORDS[1:], strict=False)] + [("", p) for p in r.sample(own.pieces, 500)]
    assert all(own.merges.beside(a, b) == (own.merged(a + b, own.score) == [x for x in (a, b) if x]) for a, b in pairs)
    a = own.differences_of([" ".join(WORDS), "", "x  y", "x" * 100])
    own.kept.most = 1  # whatever is kept goes, the results stay
    assert [x.tolist() for x in a] == [own.differences(t).tolist() for t in (" ".join(WORDS), "", "x  y", "x" * 100)]


def test_merges_of_ranks_out_of_order():
    """A token whose part has the higher rank, equal ranks, and tokens that the merges never give."""
    from strandloom.llm.merges import Merges

    for rank in ({"ab": 5, "abc": 1, "bc": 7, "cd": 2, "abcd": 0, "da": 3}, {"ab": 1, "bc": 1, "cd": 1, "abc": 2, "bcd": 2, "da": 1}, {"aa": 1, "aaa": 0, "aaaa": 2, "ba": 0}):
        m, tokens = Merges(rank), [*"abcd", *rank]
        assert all(m.beside(a, b) == (m.merged(a + b) == [x for x in (a, b) if x]) for a in ["", *tokens] for b in tokens)


def test_shards_are_contiguous_and_even(spark, docs, none):
    from strandloom.llm.sharding import byte_shards

    many = spark.createDataFrame(rows([None, *[TEXT(rng.randint(1, 60)) for _ in range(900)]]), DOCS)
    got = sorted(byte_shards(many).collect(), key=lambda r: r["doc_id"])
    text = {r["doc_id"]: (r["text"] or "").encode() for r in many.collect()}
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)
    for k in range(8):
        assert [r["slot"] for r in got if r["shard"] == k] == list(range(sum(r["shard"] == k for r in got)))
    assert byte_shards(docs).count() == docs.count()
    assert byte_shards(none).count() == 0


def test_license_rules(spark, docs, none):
    from strandloom.llm.licenses import recognised

    mit = "The MIT License.\n" + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. Nothing else."
    found = recognised(spark.createDataFrame(rows(["Text. Licensed under the Apache License, Version 2.0. More.", mit, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "license of no known kind", None, "", "All rights reserved. All Rights  Reserved."]), DOCS)).collect()
    assert {(r["doc_id"], r["licence"], r["n_matches"]) for r in found} == {(0, "Apache-2.0", 1), (1, "MIT", 1), (2, "CC-BY-NC-4.0", 2), (6, "All-Rights-Reserved", 2)}
    assert recognised(docs).count() == 0 and recognised(none).count() == 0


def test_license_tables():
    from strandloom.llm.licenses import TRIGGERS, known_sentences, rules

    trigger = re.compile(TRIGGERS)
    assert all(trigger.search(s) for s in known_sentences())  # so the filter drops no text with a known sentence
    assert {x for _, seq in rules() for x in seq} - {"-"} <= set(known_sentences().values())


def test_wrapped_license_texts(spark):
    import textwrap

    from strandloom.llm.licenses import recognised

    apache = """Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."""
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 Someone", textwrap.fill(grant, 70), textwrap.fill("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 70), textwrap.fill('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', 70)])
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    more = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "This is free and unencumbered software released into the public domain."]
    cc = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."
    cases = [apache, "".join(f" * {x}\r\n" for x in apache.split("\n")), mit, bsd, gpl, cc, "All\nrights\nreserved.", "The MIT License", "All rights.\nReserved.", "x\nLicensed under\n\nthe MIT license\ny", "we said all rights reserved", *more]
    found = recognised(spark.createDataFrame(rows(cases), DOCS)).collect()
    assert {(r["doc_id"], r["licence"], r["n_matches"]) for r in found} == {(0, "Apache-2.0", 1), (1, "Apache-2.0", 1), (2, "MIT", 1), (3, "BSD-2-Clause", 1), (4, "GPL-3.0-or-later", 1), (5, "CC-BY-SA-4.0", 1), (6, "All-Rights-Reserved", 1), (7, "MIT", 1), (9, "MIT", 1), (11, "LGPL-2.1-or-later", 1), (12, "MPL-2.0", 1), (13, "Unlicense", 1)}
    assert {r["doc_id"]: r["identifiers"] for r in found}[9] == "->mit-ref-2>-"


class Article(html.parser.HTMLParser):
    """A plain reading of well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.hidden, self.blocks, self.held = False, 0, [], []
        self.feed(page)

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("script", "style", "aside", "form") or ("class", "comments") in attrs:
            self.hidden += 1
        if tag in ("p", "h1", "li", "article", "div", "aside"):
            self.flush()
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "article", "div", "aside"):
            self.flush()
        if tag in ("script", "style", "aside", "form") or (tag == "div" and self.hidden):
            self.hidden -= 1
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.held.append(data)


def test_html_main_text(spark):
    from strandloom.llm.html_text import Page, main_texts

    def page(i):
        body = "".join(f"<p>{TEXT(30)} &amp; {TEXT(5)}<br>{TEXT(4)}</p>" for _ in range(4))
        return f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">{TEXT(3)}</a></li></ul></nav><div class="ad">{TEXT(20)}</div><article class="post-{i}"><h1>{TEXT(4)}</h1>{body}<aside><p>{TEXT(9)}</p></aside><form><p>{TEXT(5)}</p></form><div class="comments"><p>{TEXT(90)}</p></div></article><footer>&copy; {TEXT(4)}</footer></body></html>'

    pages = [(i, f"http://h{i % 2}.example.com/{i}", page(i)) for i in range(20)] + [(20, None, None), (21, "x", ""), (22, "http://h0.example.com/p", "plain text only"), (23, "http://h0.example.com/q", "<article><p>cut o")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in main_texts(table).collect()}
    assert len(got) == 24
    for i in range(20):
        assert got[i]["text"] == "\n\n".join(Article(pages[i][2]).blocks)
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (20, 21, 22, 23)] == ["", "", "plain text only", "cut o"]
    assert Page("<div><p>a<div class='sidebar'>b</div>c").text([]) == "a\n\nc"
    assert main_texts(table.where("page_id < 0")).count() == 0


def test_html_articles_with_inner_containers(spark):
    from strandloom.llm.html_text import Page, main_texts

    a, b, c, d = (TEXT(n) for n in (100, 60, 20, 5))
    inner = [
        (f'<div class="a"><p>{a}</p></div><div class="b"><p>{b}</p></div>', [a, b]),
        (f"<p>{c}</p><section><p>{a}</p></section><section><p>{b}</p></section>", [c, a, b]),
        (f"<p>{c}</p><ul><li>{a}</li><li>{b}</li></ul>", [c, a, b]),
        (f"<p>{c}</p><table><tr><td>{a}</td><td>{b}</td></tr></table>", [c, a, b]),
        (f"<blockquote><p>{a}</p></blockquote><p>{c}</p>", [a, c]),
    ]
    outer = ["<html><body><nav><p>menu</p></nav>%s<footer>end</footer></body></html>" % x for x in ("<article>%s</article>", '<main><article class="p-7">%s</article></main><div class="ad">buy</div>', '<div class="wrap"><div class="post">%s</div><div class="links"><p><a href="/">' + TEXT(80) + "</a></p></div></div>")]
    pages = [(f"http://n{i}-{k}.example.com/", o % f"<h1>{d}</h1>{x}", "\n\n".join([d, *blocks])) for i, o in enumerate(outer) for k, (x, blocks) in enumerate(inner)]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame([(n, u, h) for n, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert got == {n: t for n, (_, _, t) in enumerate(pages)}
    assert Page(f'<body><article><h1>{d}</h1><p>{a}</p></article><div class="x"><p>{b}</p></div></body>').text([]) == f"{d}\n\n{a}"
    assert Page(f'<body><p><a href="/">{d}</a></p></body>').text([]) == d


def test_html_shapes_of_pages(spark):
    from strandloom.llm.html_text import main_texts

    a, b, c = TEXT(60), TEXT(50), TEXT(30)
    text = f"<p>{a}</p><p>{b}</p>"
    cases = [
        (f'<article><svg viewBox="0 0 1 1"/>{text}<math/><p>{c}</p></article>', [a, b, c]),
        (f"<article><p>{a} <button>Share <div>this</div></button> {c}</p><p>{b}</p><select><option>one<option>two</select></article>", [f"{a} {c}", b]),
        (f'<body><article class="social-science">{text}</article><footer>end</footer></body>', [a, b]),
        (f'<body><div class="post share-8">{text}</div><div class="sidebar"><p>{c}</p></div></body>', [a, b]),
        (f'<body><div class="search-engines share">{text}</div><nav><p>{c}</p></nav></body>', [a, b]),
        (f'<article><p>{a}</p><p>&<b>amp;</b> x&amp;y &#x41;&eacute;</p><p>{b}</p></article>', [a, "&amp; x&y Aé", b]),
        (f"<html><head><title>t</title><article>{text}</article>", [a, b]),
        (f'<article>{text}<div class="comment-list"><p>{c}</p></div><div id="post-footer">f</div><div role="navigation">n</div><p class="advert">buy</p></article>', [a, b]),
        (f"<article><p>{a} <svg> {c}</p><p>{b}</p></article>", [f"{a} {c}", b]),
        (f"<article>{text}<p>{TEXT(40_000)}</p></article>", None),
    ]
    table = spark.createDataFrame([(n, f"http://s{n}.example.com/", h) for n, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_texts(table).collect()}
    for n, (_, blocks) in enumerate(cases[:-1]):
        assert got[n] == "\n\n".join(blocks), n
    assert len(got[len(cases) - 1].split()) == 40_110


def test_html_hosts_too_many_to_broadcast(spark, monkeypatch):
    from strandloom.llm import html_text

    page = lambda i: f'<body><div class="a"><p>{"word " * (40 + i)}</p></div><p>x</p></body>'
    table = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/", page(i)) for i in range(40)] + [(40, None, None)], "page_id long, url string, html string")
    one = sorted(map(tuple, html_text.main_texts(table).collect()), key=str)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_text.main_texts(table).collect()), key=str) == one and len(one) == 41


def cosine_links(x, threshold=0.95):
    ok = np.isfinite(x).all(1) & x.any(1)
    u = np.where(ok[:, None], x, 1.0)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & ok[:, None] & ok[None]
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_equal_brute_force(spark, kind):
    from strandloom.llm.embeddings import near_duplicates

    r = np.random.default_rng(11)
    base = r.standard_normal((150, 24))
    x = np.concatenate([base, base[:40] + 0.1 * r.standard_normal((40, 24)), base[:10] * 3, base[:1].repeat(30, 0), base[5:6] + 0.05 * r.standard_normal((60, 24))]).astype(np.float32 if kind == "float" else np.float64)
    near = cosine_links(x.astype(np.float64))
    comp = components(len(x), np.argwhere(near).tolist())
    odd = [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0]]
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(odd)], f"vec_id long, embedding array<{kind}>, key int")
    got = {q["vec_id"]: q for q in near_duplicates(table, margin=1.0).collect()}
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), comp[i], comp[i] == i)
    assert all((got[1000 + i]["n_links"], got[1000 + i]["component_id"], got[1000 + i]["kept"]) == (0, 1000 + i, True) for i in range(5))
    assert near_duplicates(table.where("vec_id < 0")).count() == 0
    short = spark.createDataFrame([(2000 + i, [1.0, float(i % 2)], 0) for i in range(6)], f"vec_id long, embedding array<{kind}>, key int")
    both = {q["vec_id"]: (q["n_links"], q["component_id"]) for q in near_duplicates(table.where("vec_id < 20").unionByName(short)).collect()}
    assert len(both) == 26 and [both[2000 + i] for i in range(6)] == [(2, 2000 + i % 2) for i in range(6)]
    assert near_duplicates(table.where("vec_id >= 1000 and vec_id < 1004")).count() == 4


def test_embedding_recall_with_production_probes(spark):
    from strandloom.llm.embeddings import near_duplicates

    r = np.random.default_rng(12)
    base = r.standard_normal((1500, 64))
    few = base[:300].copy()
    few[:, :3] += 1.4 * r.standard_normal((300, 3))  # pairs that differ along three dimensions
    x = np.concatenate([base, base[:300] + 0.28 * r.standard_normal((300, 64)), few]).astype(np.float32)
    truth = cosine_links(x.astype(np.float64)).sum()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert near_duplicates(table).agg(F.sum("n_links")).first()[0] >= 0.98 * truth > 0


def test_toxicity_on_held_out(spark, none):
    from strandloom.llm.toxicity import fit, scored, without_toxic

    bad = "zorkan blithe grunf snarlon".split()

    def text(i):
        w = TEXT(60).split()
        return " ".join(w + [rng.choice(bad) + rng.choice(["", "el", "ops"]) for _ in range(3)]) if i % 4 == 0 else " ".join(w)

    texts = [text(i) for i in range(800)] + [None, ""]
    docs = spark.createDataFrame(rows(texts), DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in scored(docs, labels).collect()}
    assert len(got) == 802
    held = [r for i, r in got.items() if i < 800 and r["held_out"]]
    assert 100 < len(held) < 220 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    assert got[0]["evidence_ids"] and all(i % 4 == 0 for i in got[0]["evidence_ids"])
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[800]["score"] == got[801]["score"] < 0.5
    assert {r["doc_id"] for r in without_toxic(docs, labels).collect()} == {i for i, r in got.items() if r["score"] < 0.5}
    assert scored(none, labels).count() == 0 and scored(docs, labels.where("toxic = 1")).where("score < 1").count() == 0
    # pruned search equals a plain one
    ix = fit(docs, labels)
    vectors = [{} for _ in ix.ids]
    for (t, b), (places, weights) in ix.postings.items():
        for p, w in zip(places, weights):
            vectors[b * 64 + int(p)][t] = float(w)
    for i in range(0, 800, 40):
        terms = ix.present(texts[i])
        query = ix.vector(terms) if terms else {}
        assert {t: n for t, n in terms} == {t: (WORDS_(texts[i]) + [w[:4] + "*" for w in WORDS_(texts[i]) if len(w) > 4]).count(t) for t, _ in terms}
        plain = sorted(((sum(x * v.get(t, 0.0) for t, x in query.items()), k) for k, v in enumerate(vectors)), key=lambda n: (-round(n[0], 12), n[1]))
        plain = [n for n in plain if n[0] > 0][:15]
        assert [k for _, k in ix.nearest(terms)] == [k for _, k in plain]


def test_decontamination_of_copies_and_paraphrases(spark, none):
    from strandloom.llm.decontam import repeats, without_repeats

    rng.seed(21)  # the same texts whichever tests ran before
    items = [TEXT(n) + ". " + TEXT(6) + "." for n in (12, 30, 50, 25, 40)]
    special = [re.sub(r"\b\w+", lambda m: m[0] + f"q{k}" if rng.random() < 0.7 else m[0], t) for k, t in enumerate(items)]

    def changed(t, share):
        return " ".join(w if rng.random() > share else "other" for w in t.split())

    texts = [TEXT(80) for _ in range(30)] + [f"{TEXT(90)} {special[1]} {TEXT(10)}", special[0].upper(), f"{TEXT(300)}\n{changed(special[2], 0.15)}", " ".join(special[3].split()[:6]), None, "", special[4] + " " + TEXT(9_000)]
    docs = spark.createDataFrame(rows(texts), DOCS).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(special)] + [(90, None), (91, ""), (92, "..")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in repeats(docs, bench).collect()} == {(30, 1), (31, 0), (32, 2), (36, 4)}
    kept = without_repeats(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {30, 31, 32, 36}
    assert repeats(none, bench).count() == 0 and repeats(docs, bench.where("item_id > 80")).count() == 0
    assert repeats(docs.unionByName(docs), bench).count() == 4


def test_weighted_subsequence_equals_plain_table():
    from strandloom.llm.decontam import common_subsequence

    r = random.Random(3)
    weight = np.array([r.choice([1.0, 2.0, 3.5, 0.25]) for _ in range(9)] + [0.0])
    for _ in range(200):
        a, b = [r.randrange(9) for _ in range(r.randrange(1, 14))], [r.randrange(-1, 9) for _ in range(r.randrange(1, 14))]
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (weight[x] if x == y else -1))
        assert abs(common_subsequence(a, b, weight)[0] - table[-1][-1]) < 1e-9


def test_recall_of_latent_candidates(spark, monkeypatch):
    """Against all pairs of passages and items: the same checks without the cosine."""
    from strandloom.llm import decontam

    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "ka lo mi nu pe ra si to".split() for b in "an bel cor dis eth fin gro hul".split() for c in "as em ir ok".split()]
    text = lambda n: " ".join(r.choice(words) if r.random() < 0.6 else r.choice(words[:30]) for _ in range(n))
    items = [text(r.randint(12, 60)) + ". " + text(6) + "." for _ in range(150)]

    def paraphrase(t):
        share, out = r.uniform(0, 0.45), []
        for w in t.split():
            k = r.random()
            out += [w] if k > share else [] if k < share / 3 else [r.choice(words)] if k < 2 * share / 3 else [w, r.choice(words)]
        return " ".join(out)

    texts = [text(r.randint(20, 300)) for _ in range(300)] + [f"{text(r.randint(0, 120))} {paraphrase(r.choice(items))} {text(r.randint(0, 80))}" for _ in range(500)]
    docs = spark.createDataFrame(rows(texts), DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    pairs = lambda: {(q["doc_id"], q["item_id"]) for q in decontam.repeats(docs, bench).collect()}
    found = pairs()
    monkeypatch.setattr(decontam, "COSINE", -2.0)
    truth = pairs()
    assert found <= truth and len(found) >= 0.95 * len(truth) and 250 < len(truth) < 520
    assert all(d >= 300 for d, _ in truth)
    monkeypatch.setattr(decontam, "COSINE", 0.25)
    monkeypatch.setattr(decontam, "ITEM_BYTES", 6_000)  # several blocks
    assert len(pairs() & truth) >= 0.95 * len(truth)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # plain forms of the stages that don't learn, over what the stage before kept
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert set(kept) <= set(texts)
    table = spark.createDataFrame([(d, t, "", "", 0) for d, t in kept.items()], DOCS)
    one = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_copies(spark, table, sf).collect()}
    ids = sorted(kept)
    first = components(len(ids), similar([kept[d] for d in ids]))
    least = {ids[k] for k in first}
    assert all(one[d] == kept[d] for d in one) and least <= set(one) and len(one) <= 1.01 * len(least)
    cut = removed(sorted(one.items()))
    expected = {d: (cut[d][2].decode() if cut[d][1] else t) for d, t in one.items()}
    leaks = set()
    norm = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        leaks |= {d for d, t in expected.items() if norm(r["text"]) in norm(t)}
    result = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(result) == set(expected) - leaks
    from strandloom.llm.bpe import encoder, public_vocabulary

    own = encoder(*public_vocabulary())
    assert all(own.decode(r["ids"]) == expected[d].encode() and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for d, r in result.items())


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, other columns with clashing names, and an empty table, through all stages one after another."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    a, b = TEXT(90), TEXT(70)
    own = rows([a, b, None, "", a, "one"], 9_000_000) + rows([TEXT(40)], 9_000_010) * 2 + [(None, a, "en", "src", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(own, DOCS)
    for name in ("score", "key", "label", "firsts", "item_id", "fp", "node", "tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    columns, empty = docs.columns, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, sf).persist(), stage(spark, empty, sf)
        assert docs.columns == columns and empty.columns == columns and empty.count() == 0, name
        ids = [r["doc_id"] for r in docs.collect()]
        assert ids.count(9_000_010) == 2 and ids.count(None) == 2 and 9_000_001 in ids and 9_000_002 in ids, name
        assert (9_000_004 in ids) == (name == "toxicity"), name  # a copy of 9000000, which stays
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    assert texts[9_000_000] == a and texts[9_000_001] == b and 9_000_003 not in texts  # null and empty texts are copies
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(ids) and all(r["round_trip"] for r in last)


def test_embedding_candidates_of_single_precision_tables_hold_all_of_double_precision():
    from strandloom.llm import embeddings

    r = np.random.default_rng(12)
    x = embeddings.unit(r.standard_normal((600, 24)))
    index = embeddings.ProductIndex(x, 6, 0.95, 0.5)
    y = x[embeddings.nearest(x, index.centers) == 2]
    codes, left = index.encode(y, np.full(len(y), 2))
    decoded = index.centers[2] + np.concatenate([b[codes[:, i]] for i, b in enumerate(index.books)], 1)
    far = np.sqrt(((decoded[:, None] - x[None]) ** 2).sum(2))
    near = index.near(x, 2, codes, left)
    assert near.shape == far.shape and near[far <= (index.radius + left + embeddings.SLACK)[:, None]].all()
    assert not near[far > (index.radius + left + 1e-3)[:, None]].any()


def test_vectors_of_every_kind_have_the_keys_of_a_plain_loop(spark):
    from strandloom.llm import embeddings

    rows = [[1.0, 2.0], None, [], [0.0, -0.0], [0.0, 3.0, -0.0], [None, 1.0], [float("nan"), 1.0], [float("inf")], [2.5]]
    for kind, dtype in (("float", np.float32), ("double", np.float64)):
        got = embeddings.valid_vectors(spark.createDataFrame(list(enumerate(rows)), f"vec_id long, embedding array<{kind}>").coalesce(1)).collect()
        for i, key, width in got:
            x = np.array([np.nan if v is None else v for v in rows[i] or ()], dtype) + dtype(0)
            expected = x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None
            assert (bytes(key) if key is not None else None) == expected and width == (len(expected) if expected else None)


def test_decontamination_fits_its_basis_on_all_passages(spark, monkeypatch):
    from strandloom.llm import decontam

    item = "how many grey herons stood beside the frozen canal when the lantern went out. seventeen herons stood there."
    docs = spark.createDataFrame([(i, f"note {i} {item} end {i}") for i in range(40)] + [(99, "nothing of the kind")], "doc_id long, text string")
    seen, fit = [], decontam.fit_basis
    monkeypatch.setattr(decontam, "FIT", 4, raising=False)
    monkeypatch.setattr(decontam, "fit_basis", lambda items, passages: (seen.append(passages.count()), fit(items, passages)))
    found = decontam.repeats(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id").distinct().count()
    assert seen[0] >= 40 and found == 40
