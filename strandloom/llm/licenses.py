"""Licence recognition by sentence rules. DataFrame functions only.

A text is cut at sentence ends and line breaks, its parts are normalised (lower case, runs of anything but letters and digits to one space) and
known licence sentences are found among them. A known sentence begins and ends at such cuts and may run over any number of line breaks and blank lines
(licence files are wrapped, also behind comment marks), never over a sentence end; the longest of those that begin at one place counts. A text's sentences become a sequence of identifiers, with a gap for unknown ones. Rules are sequences of
identifiers that must follow one another; they are tried in order, a longer rule before those it contains, and what a rule has matched no
later rule can use.

The SQL twin takes each line on its own, so it agrees on texts whose licence sentences aren't wrapped.

Each known sentence holds one of TRIGGERS, so texts without any are passed by without being cut.

Defined results: null and empty texts, and texts without known sentences, give no rows; repeated rows each get their rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIGGERS = r"(?i)licen[cs]e|mozilla|copyright|redistribut|permission|warrant|all[^a-z0-9]+rights|public[^a-z0-9]+domain|as[^a-z0-9]+is"

# Known licence sentences, normalised; {v} and {k} stand for the versions and kinds below.
SENTENCES = {
    "apache-ref-{v}": "licensed under the apache license version {v}",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl-ref-{g}": "this work is licensed under the gnu general public license version {g}",
    "gpl-free-{g}": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {g} of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-{k}-{c}": "licensed under cc {k} {c}",
    "cc-work-{k}-{c}": "this work is licensed under cc {k} {c}",
    "bsd-form": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-free-{g}": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {g} of the license or at your option any later version",
    "agpl-free-{g}": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {g} of the license or at your option any later version",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "boost software license version 1 0 august 17th 2003",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "rights": "all rights reserved",
    "public-domain": "this work is in the public domain",
}
# Other published wordings of the same sentences.
OTHER_WORDINGS = {
    "apache-header": ("the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at https www apache org licenses license 2 0",),
    "mit-title": ("the mit license mit", "mit license", "mit license mit"),
    "mit-notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",),
    "bsd-names": ("neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "isc-grant": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "cc-work-{k}-{c}": ("this work is licensed under a creative commons {long} {c} {port} license", "this work is licensed under the creative commons {long} {c} {port} license"),
}
PORTS = {"1 0": "generic", "2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
KINDS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
GPL = ("1", "2", "3")
VERSIONS = {"v": ("1 0", "1 1", "2 0"), "g": ("1", "2", "2 1", "3"), "k": ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), "c": ("1 0", "2 0", "2 5", "3 0", "4 0")}


def known_sentences() -> dict[str, str]:
    """Normalised sentence: identifier, with all versions filled in."""
    out = {}
    for name, sentence in [*SENTENCES.items(), *((n, s) for n, other in OTHER_WORDINGS.items() for s in other if "{" not in s)]:
        forms = [(name, sentence)]
        for key, values in VERSIONS.items():
            if "{" + key + "}" in sentence:
                forms = [(n.replace("{" + key + "}", v.replace(" ", ".") if key in "vgc" else v.replace(" ", "-")), s.replace("{" + key + "}", v)) for n, s in forms for v in values]
        out |= {s: n for n, s in forms}
    for name, other in OTHER_WORDINGS.items():
        for sentence in (s for s in other if "{" in s):
            for k in VERSIONS["k"]:
                for c in VERSIONS["c"]:
                    full = sentence.format(long=" ".join(KINDS[x] for x in k.split()), c=c, port=PORTS[c])
                    out[full] = name.format(k=k.replace(" ", "-"), c=c.replace(" ", "."))
    return out


def rules() -> list[tuple[str, tuple[str, ...]]]:
    """(licence, identifiers that follow one another), in the order they are tried."""
    names = list(dict.fromkeys(known_sentences().values()))
    mit = ("mit-grant", "mit-notice", "mit-asis", "mit-liable")
    out = [
        ("Apache-2.0", ("apache-header", "apache-copy", "apache-basis", "apache-see")),
        *(("MIT", (*title, *mit[:n])) for n in (4, 3, 2) for title in (("mit-title", "-"), ("mit-title",), ())),
        *(("BSD-3-Clause", seq) for seq in (("bsd-form", "-", "bsd-source", "-", "bsd-binary", "-", "bsd-names"), ("bsd-form", "bsd-source", "bsd-binary", "bsd-names"))),
        *(("BSD-2-Clause", seq) for seq in (("bsd-form", "-", "bsd-source", "-", "bsd-binary"), ("bsd-form", "bsd-source", "bsd-binary"))),
        ("Apache-2.0", ("apache-ref-2.0", "apache-use", "apache-copy", "apache-basis", "apache-see")),
        *((f"GPL-{g}.0-or-later", (f"gpl-free-{g}", "gpl-hope")) for g in GPL),
        *((f"Apache-{v.replace(' ', '.')}", (f"apache-ref-{v.replace(' ', '.')}",)) for v in VERSIONS["v"]),
        ("Apache-2.0", ("apache-header",)),
        ("MIT", ("mit-ref",)),
        ("MIT", ("mit-ref-2",)),
        ("MIT", ("mit-title",)),
        *((f"GPL-{g}.0-only", (f"gpl-ref-{g}",)) for g in GPL),
        *((f"GPL-{g}.0-or-later", (f"gpl-free-{g}",)) for g in GPL),
        *(("CC-" + n.removeprefix("cc-").removeprefix("work-").upper(), (n,)) for n in names if n.startswith("cc-")),
        *((f"LGPL-{g.replace(' ', '.')}-or-later", (f"lgpl-free-{g.replace(' ', '.')}",)) for g in VERSIONS["g"]),
        *((f"AGPL-{g}.0-or-later", (f"agpl-free-{g}",)) for g in ("3",)),
        ("MPL-2.0", ("mpl-2", "-", "mpl-copy")),  # the version stands behind a full stop
        ("MPL-2.0", ("mpl-2",)),
        ("Unlicense", ("unlicense",)),
        ("BSL-1.0", ("boost",)),
        ("Zlib", ("zlib-grant",)),
        ("BSD", ("bsd-form",)),
        ("ISC", ("isc-grant",)),
        ("Public-Domain", ("public-domain",)),
        ("All-Rights-Reserved", ("rights",)),
    ]
    return out


def sentence_identifiers(text: Column) -> Column:
    """Identifiers of a text's known sentences in order, null for each stretch of unknown ones."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # \x01 is a sentence end, \x02 a line break, \x03 encloses what is known
    plain = F.translate(text, upper + "\x01\x02\x03", lower + ",,,")
    for found, by in (("[.!?][ \t\f]*[ \t\f\r\n]", "\x01"), ("[\r\n]+", "\x02"), ("[^a-z0-9\x01\x02]+", " "), (" ?\x01 ?", "\x01"), (" ?\x02[ \x02]*", "\x02")):
        plain = F.regexp_replace(plain, found, by)
    known = sorted(known_sentences(), key=lambda s: (-len(s), s))
    any_known = "|".join(s.replace(" ", "[ \x02]") for s in known)
    parts = F.split(F.regexp_replace(F.trim(plain), f"(?<![^\x01\x02])(?:{any_known})(?![^\x01\x02])", "\x03$0\x03"), "\x03")
    names = F.create_map(*[F.lit(x) for s in known for x in (s, known_sentences()[s])])
    return F.transform(F.filter(parts, lambda s: s.rlike("[a-z0-9]")), lambda s: F.try_element_at(names, F.translate(s, "\x02", " ")))


def recognised(docs: DataFrame) -> DataFrame:
    """doc_id, licence, n_matches, identifiers (of the whole text, joined by >, - for each run of unknown sentences); a row for each document and licence found."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(TRIGGERS))
    names = texts.select("doc_id", F.transform(sentence_identifiers(F.col("text")), lambda s: F.coalesce(s, F.lit("-"))).alias("names"))
    names = names.where(F.exists("names", lambda s: s != "-")).select("doc_id", F.filter("names", lambda s, i: (s != "-") | (i == 0) | (F.get("names", i - 1) != "-")).alias("names"))
    # every identifier has marks of its own on both sides, so matches side by side don't share one
    sequence = F.concat(F.lit("<"), F.array_join("names", "><"), F.lit(">"))
    tried = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(pattern(s)).alias("pattern")) for n, s in rules()])
    start = F.struct(sequence.alias("left"), F.array().cast("array<struct<licence:string,n:bigint>>").alias("found"))

    def step(so_far: Column, rule: Column) -> Column:
        n = ((F.length(so_far["left"]) - F.length(F.replace(so_far["left"], rule["pattern"], F.lit("")))) / F.length(rule["pattern"])).cast("long")
        found = F.struct(rule["licence"].alias("licence"), n.alias("n"))
        return F.struct(F.replace(so_far["left"], rule["pattern"], F.lit("#")).alias("left"), F.when(n > 0, F.array_append(so_far["found"], found)).otherwise(so_far["found"]).alias("found"))

    found = names.select("doc_id", F.array_join("names", ">").alias("identifiers"), F.aggregate(tried, start, step)["found"].alias("found"))
    each = found.select("doc_id", "identifiers", "found", F.explode(F.array_distinct(F.transform("found", lambda f: f["licence"]))).alias("licence"))
    total = F.aggregate(F.filter("found", lambda f: f["licence"] == F.col("licence")), F.lit(0).cast("long"), lambda so_far, f: so_far + f["n"])
    return each.select("doc_id", "licence", total.alias("n_matches"), "identifiers")


def pattern(sequence: tuple[str, ...]) -> str:
    return "".join(f"<{s}>" for s in sequence)


def duckdb_sql() -> str:
    """The same result over a view `documents`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in known_sentences().items())
    left = ["'<' || array_to_string(names, '><') || '>' AS l0"] + [f"replace(l{i}, {quoted(pattern(s))}, '#') AS l{i + 1}" for i, (_, s) in enumerate(rules())]
    counts = ", ".join(f"{{'licence': {quoted(n)}, 'n': (length(l{i}) - length(replace(l{i}, {quoted(pattern(s))}, ''))) // {len(pattern(s))}}}" for i, (n, s) in enumerate(rules()))
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \t\f]+', '\1' || chr(10), 'g'), '[\r\n]+') AS parts FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
plain AS (SELECT doc_id, i, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM each),
named AS (SELECT doc_id, i, coalesce(name, '-') AS name FROM plain LEFT JOIN known USING (sentence) WHERE sentence <> ''),
shown AS (SELECT *, lag(name) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM named),
lists AS (SELECT doc_id, list(name ORDER BY i) AS names FROM shown WHERE name <> '-' OR before IS DISTINCT FROM '-' GROUP BY doc_id HAVING bool_or(name <> '-')),
folded AS (SELECT doc_id, names, {", ".join(left)} FROM lists),
found AS (SELECT doc_id, array_to_string(names, '>') AS identifiers, unnest([{counts}]) AS m FROM folded)
SELECT doc_id, m.licence AS licence, CAST(sum(m.n) AS BIGINT) AS n_matches, identifiers FROM found WHERE m.n > 0 GROUP BY ALL
"""
