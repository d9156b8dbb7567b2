"""Licence scan by sentence rules.

A text is cut into sentences, which may be wrapped over lines (of comments, too); each is normalised (lower case, one space
between words, no marks at its ends) and looked up among the known licence sentences; the identifiers found, in order, are
matched against ordered licence rules: the first rule that matches a stretch of identifiers names its licence and takes the
stretch.  DataFrame functions only; no shuffle.

A sentence ends at an empty line, at a line of copyright, or after a mark before white space.  If it isn't known as a whole,
lines of it that are known by themselves stand alone, and what lies between those is looked up.

Defined results: null and empty texts have no licence; whole texts are read; sentences that only mention a licence inside
other words are not known sentences and give nothing; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Known licence sentences, normalised, and their identifiers.  Public licence texts.
SENTENCES = {
    "the mit license": "mit_title",
    "mit license": "mit_title",
    "the mit license (mit)": "mit_title",
    'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions': "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    'licensed under the apache license, version 2.0 (the "license")': "apache_head",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_copy",
    "this program is free software": "gpl_free",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl3_terms",
    "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 2 of the license, or (at your option) any later version": "gpl2_terms",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd_head",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd_1",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd_2",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_3",
    "this is free and unencumbered software released into the public domain": "unlicense_head",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl_head",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "apache license version 2.0, january 2004": "apache_title",
    "gnu general public license version 3, 29 june 2007": "gpl3_title",
    "gnu general public license version 2, june 1991": "gpl2_title",
    "gnu lesser general public license version 3, 29 june 2007": "lgpl3_title",
    "gnu affero general public license version 3, 19 november 2007": "agpl3_title",
    "mozilla public license version 2.0": "mpl_title",
    "bsd 3-clause license": "bsd3_title",
    "bsd 2-clause license": "bsd2_title",
    "isc license": "isc_title",
    "boost software license - version 1.0 - august 17th, 2003": "bsl_title",
    "this library is free software": "gpl_free",
    "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 2.1 of the license, or (at your option) any later version": "lgpl21_terms",
    "you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "lgpl3_terms",
    "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "agpl3_terms",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib_grant",
    "this work is dedicated to the public domain": "pd_ref",
    "all rights reserved": "reserved",
}
#: How texts refer to a licence: each beginning with each name.
BEGINNINGS = ["licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this project is licensed under", "this software is licensed under"]
NAMES = {
    "the mit license": "mit_ref",
    "the apache license, version 2.0": "apache_ref",
    "the apache license 2.0": "apache_ref",
    "the bsd 3-clause license": "bsd3_ref",
    "the bsd 2-clause license": "bsd2_ref",
    "the isc license": "isc_ref",
    "the gnu general public license, version 3": "gpl3_ref",
    "the gnu general public license, version 2": "gpl2_ref",
    "the gnu lesser general public license, version 3": "lgpl3_ref",
    "the gnu affero general public license, version 3": "agpl3_ref",
    "the mozilla public license 2.0": "mpl_ref",
    "the boost software license, version 1.0": "bsl_ref",
    "cc0 1.0": "cc0_ref",
}
#: Creative Commons licences: sign and name.
COMMONS = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}
#: Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]

#: Ordered rules: licence, and the sequences of identifiers that show it; earlier ones win.
RULES = [
    ("MIT", ["mit_title mit_grant mit_notice", "mit_grant mit_notice"]),
    ("BSD-3-Clause", ["bsd3_title bsd_head bsd_1 bsd_2 bsd_3", "bsd_head bsd_1 bsd_2 bsd_3"]),
    ("BSD-2-Clause", ["bsd2_title bsd_head bsd_1 bsd_2", "bsd_head bsd_1 bsd_2"]),
    ("ISC", ["isc_title isc_grant", "isc_grant"]),
    ("Apache-2.0", ["apache_head apache_comply apache_copy apache_see", "apache_head apache_comply apache_copy", "apache_head apache_comply"]),
    ("GPL-3.0-or-later", ["gpl_free gpl3_terms", "gpl3_terms"]),
    ("GPL-2.0-or-later", ["gpl_free gpl2_terms", "gpl2_terms"]),
    ("LGPL-2.1-or-later", ["gpl_free lgpl21_terms", "lgpl21_terms"]),
    ("LGPL-3.0-or-later", ["gpl_free lgpl3_terms", "lgpl3_terms"]),
    ("AGPL-3.0-or-later", ["gpl_free agpl3_terms", "agpl3_terms"]),
    ("MIT", ["mit_ref", "mit_title", "mit_grant"]),
    ("Apache-2.0", ["apache_ref", "apache_head", "apache_title"]),
    ("BSD-3-Clause", ["bsd3_ref", "bsd3_title"]),
    ("BSD-2-Clause", ["bsd2_ref", "bsd2_title"]),
    ("ISC", ["isc_ref", "isc_title"]),
    ("GPL-3.0-only", ["gpl3_ref", "gpl3_title"]),
    ("GPL-2.0-only", ["gpl2_ref", "gpl2_title"]),
    ("LGPL-3.0-only", ["lgpl3_ref", "lgpl3_title"]),
    ("AGPL-3.0-only", ["agpl3_ref", "agpl3_title"]),
    ("MPL-2.0", ["mpl_head", "mpl_ref", "mpl_title"]),
    ("BSL-1.0", ["bsl_ref", "bsl_title"]),
    ("Zlib", ["zlib_grant"]),
    ("Unlicense", ["unlicense_head"]),
    ("CC0-1.0", ["cc0_ref"]),
    *[(f"CC-{k.upper()}-4.0", [f"cc_{k}"]) for k in COMMONS],
    *[(x, [f"spdx_{x}"]) for x in SPDX],
    ("public-domain", ["pd_ref"]),
    ("proprietary", ["reserved"]),
]


def sentences() -> dict[str, str]:
    """All known sentences, normalised."""
    out = dict(SENTENCES)
    out |= {f"{b} {n}": i for n, i in NAMES.items() for b in BEGINNINGS}
    for sign, name in COMMONS.items():
        out |= {f"{b} cc {sign} 4.0": f"cc_{sign}" for b in BEGINNINGS}
        out |= {f"{b} {a} creative commons {name} 4.0 international license": f"cc_{sign}" for b in BEGINNINGS[::4] for a in ("a", "the")}
    out |= {f"spdx-license-identifier: {x.lower()}": f"spdx_{x}" for x in SPDX}
    return {normalised(k): v for k, v in out.items()}


#: Every known sentence has one of these words; texts without are not cut into sentences.
HINT = r"(?i)licen[sc]e|(?:released|distributed|available) under|permission|redistribut|public domain|free software|rights reserved"
#: HINT, with its words on two lines, too.
HINT_WRAPPED = HINT.replace(" ", r"[\s#*/>;%!-]+")
#: Places that look like a sentence's end but are none; HELD takes the white space's place.
HELD = "\ue002"
NO_END = r"(?i)(SPDX-License-Identifier:|\bv\.)[\x20\x09]+"
#: Ends of sentences: a line's end, or a mark before white space.
ENDS = r"\n+|(?<=[.;:!?])[\x20\x09-\x0D]+"
#: A line's end that may be within a sentence: no mark before it, and a line that isn't empty after it; with the mark of a
#: comment at that line's start.  WRAP takes its place until the sentences are cut.
SOFT = r"(?<=[^.;:!?\s])[\x20\t\r]*\n[\x20\t]*+(?:<!--|[#*>/;%!-]++)?+[\x20\t]*+(?=[^\s])"
WRAP = "\ue000\ue001"
#: A line of copyright, which is a sentence of its own.
COPYRIGHT = r"(?im)^([^\w\n(©]*(?:copyright[\x20\x09]*(?:\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*)"


def normalise(sentence: Column) -> Column:
    one = F.regexp_replace(F.lower(sentence), r"[\x20\x09-\x0D\ue002]+", " ")
    return F.regexp_replace(one, r"""^[ *#/>"'.;:!?-]+|[ *#/"'.;:!?-]+$""", "")


def normalised(sentence: str) -> str:
    """normalise() of a constant."""
    return " ".join(sentence.lower().split()).strip(" *#/>\"'.;:!?-")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in sentences().items() for x in pair])
    find = lambda s: F.element_at(known, normalise(s))
    none = F.array().cast("array<string>")

    def pieces(sentence: Column) -> Column:
        """Ids of lines that stand alone, and of what lies between them."""
        start = F.struct(F.lit("").alias("held"), none.alias("out"))

        def step(acc: Column, line: Column) -> Column:
            alone = find(line)
            ends = alone.isNotNull()
            return F.struct(F.when(ends, "").otherwise(F.concat(acc["held"], F.lit(" "), line)).alias("held"), F.when(ends, F.concat(acc["out"], F.array(find(acc["held"]), alone))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.split(sentence, WRAP), start, step, lambda acc: F.array_append(acc["out"], find(acc["held"])))

    def ids(sentence: Column) -> Column:
        return let(find(F.replace(sentence, F.lit(WRAP), F.lit(" "))), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(F.contains(sentence, F.lit(WRAP)), pieces(sentence)).otherwise(none))

    held = F.regexp_replace(F.regexp_replace(text, "(?d)" + COPYRIGHT, "\n$1\n"), NO_END, "$1" + HELD)
    cut = F.split(F.regexp_replace(held, SOFT, WRAP), ENDS)
    return F.filter(F.flatten(F.transform(cut, ids)), lambda x: x.isNotNull())


def written(ids: str) -> str:
    """A sequence of identifiers as apply_rules() searches it."""
    return "".join(f"<{x}>" for x in ids.split())


def apply_rules(ids: Column) -> Column:
    """Licences of an identifier sequence, in the rules' order, each once.  A rule takes the identifiers that it matches; what is
    left on both sides of them isn't a stretch."""
    state = F.struct(F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(written(q)).alias("q")) for n, qs in RULES for q in qs])

    def step(acc: Column, r: Column) -> Column:
        hit = F.contains(acc["rest"], r["q"])
        return F.struct(F.when(hit, F.replace(acc["rest"], r["q"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.array_append(acc["found"], r["n"])).otherwise(acc["found"]).alias("found"))

    return F.array_distinct(F.aggregate(rules, state, step, lambda acc: acc["found"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with license_ids and licenses (array<string>)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.withColumn("license_ids", F.when(t.rlike(HINT_WRAPPED), identifiers(t)).otherwise(none))
    return out.withColumn("licenses", F.when(F.size("license_ids") > 0, let(F.col("license_ids"), apply_rules)).otherwise(none))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("license_ids").cast("long").alias("n_sentences"), F.array_join("license_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    """The scan in relations: sentences, lines and stretches of lines are rows; rules are applied by numbers of places in the
    sequence, which is numbered anew where a rule took something."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in sentences().items())
    plain = lambda x: rf"regexp_replace(regexp_replace(lower({x}), '[\x20\x09-\x0D\x{{E002}}]+', ' ', 'g'), {q('^[ *#/>' + chr(34) + chr(39) + '.;:!?-]+|[ *#/' + chr(34) + chr(39) + '.;:!?-]+$')}, '', 'g')"
    soft = lambda x: rf"regexp_replace({x}, '([^.;:!?\s])[\x20\t\r]*\n[\x20\t]*(?:<!--|[#*>/;%!-]+)?[\x20\t]*([^\s#*>/;%!-])', '\1' || chr(57344) || '\2', 'g')"
    steps, last = [], "r0"
    for i, (_, ids) in enumerate((n, x) for n, xs in RULES for x in xs):
        ids = ids.split()
        met = " AND ".join([f"i{k} = {q(x)}" for k, x in enumerate(ids)])
        leads = ", ".join([f"id AS i0, {'true' if len(ids) == 1 else f'lead(pos, {len(ids) - 1}) OVER w = pos + {len(ids) - 1}'} AS whole", *[f"lead(id, {k}) OVER w AS i{k}" for k in range(1, len(ids))]])
        steps.append(f"m{i} AS (SELECT rid, pos FROM (SELECT rid, pos, {leads} FROM {last} WINDOW w AS (PARTITION BY rid ORDER BY pos)) WHERE whole AND {met})")
        steps.append(f"r{i + 1} AS (SELECT * FROM {last} x WHERE NOT EXISTS (SELECT 1 FROM m{i} m WHERE m.rid = x.rid AND x.pos BETWEEN m.pos AND m.pos + {len(ids) - 1}))")
        last = f"r{i + 1}"
    order = {}
    for i, n in enumerate(n for n, xs in RULES for _ in xs):
        order.setdefault(n, []).append(i)
    hits = " UNION ALL ".join(f"SELECT rid, {rank} AS k, {q(n)} AS license FROM m{i}" for rank, (n, at) in enumerate(order.items()) for i in at)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, regexp_replace(regexp_replace(t, {q(COPYRIGHT)}, chr(10) || '\1' || chr(10), 'g'), '(?i)(SPDX-License-Identifier:|\bv\.)[\x20\x09]+', '\1' || chr(57346), 'g') AS t FROM d WHERE regexp_matches(t, {q(HINT_WRAPPED)})),
f AS (SELECT rid, regexp_split_to_array(regexp_replace({soft(soft("t"))}, '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n+') AS ss FROM e),
s AS (SELECT rid, unnest(ss) AS s, generate_subscripts(ss, 1) AS p FROM f),
known(s, id) AS (VALUES {known}),
w AS (SELECT rid, p, id FROM (SELECT rid, p, {plain("replace(s, chr(57344), ' ')")} AS s FROM s) JOIN known USING (s)),
l AS (SELECT rid, p, unnest(string_split(s, chr(57344))) AS raw, generate_subscripts(string_split(s, chr(57344)), 1) AS n FROM s ANTI JOIN w USING (rid, p) WHERE contains(s, chr(57344))),
a AS (SELECT rid, p, n, raw, id, id IS NOT NULL AS alone FROM (SELECT *, {plain("raw")} AS s FROM l) LEFT JOIN known USING (s)),
g AS (SELECT *, sum(CAST(alone AS INT)) OVER (PARTITION BY rid, p ORDER BY n) AS grp FROM a),
b AS (SELECT rid, p, n, s FROM (SELECT rid, p, min(n) AS n, {plain("string_agg(raw, ' ' ORDER BY n)")} AS s FROM g WHERE NOT alone GROUP BY rid, p, grp)),
found AS (SELECT rid, p, 0 AS n, id FROM w UNION ALL SELECT rid, p, n, id FROM a WHERE id IS NOT NULL UNION ALL SELECT rid, p, n, id FROM b JOIN known USING (s)),
r0 AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY p, n) AS pos, id FROM found),
{", ".join(steps)},
names AS (SELECT rid, string_agg(license, ',' ORDER BY k) AS licenses FROM (SELECT DISTINCT rid, k, license FROM ({hits})) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM r0 GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN ids USING (rid) LEFT JOIN names USING (rid)
"""
