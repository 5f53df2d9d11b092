"""License scans: recognise licences by their sentences.

Texts are split into lines and sentences, and normalised pieces are compared with a table of known
licence sentences. A known sentence may be wrapped: it matches one piece or several that follow
each other, so line ends, blank lines and comment marks within it are as blanks. The identifiers
found in a document, in order, are matched against rules, each an ordered list of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import valid_text

#: Known sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-condition": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorsement": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "cc0-notice": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "reserved-rights": ["All rights reserved"],
}
#: Rules: the licence, and the sentences that state it, in order; other sentences may stand between.
RULES = [
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("apache-notice", "Apache-2.0", ["apache-notice"]),
    ("apache-header", "Apache-2.0", ["apache-notice", "apache-condition", "apache-copy"]),
    ("gpl3-notice", "GPL-3.0", ["gpl3-notice"]),
    ("gpl3-header", "GPL-3.0", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("isc-text", "ISC", ["isc-grant", "isc-as-is"]),
    ("gpl2-header", "GPL-2.0", ["gpl2-free"]),
    ("lgpl21-header", "LGPL-2.1", ["lgpl21-free"]),
    ("lgpl3-header", "LGPL-3.0", ["lgpl3-free"]),
    ("agpl3-header", "AGPL-3.0", ["agpl3-free"]),
    ("mpl2-header", "MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("unlicense-text", "Unlicense", ["unlicense-free"]),
    ("cc0-notice", "CC0-1.0", ["cc0-notice"]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("reserved-notice", "LicenseRef-All-Rights-Reserved", ["reserved-rights"]),
]
#: A piece ends at a line's end, or after . ! ? or ; before white space.
BREAK = r"[\n\r]+|(?<=[.!?;])[ \t]+"


def normalise(sentence: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _pattern(sentence: str) -> str:
    """Finds a normalised sentence in marked pieces, from a piece's mark to a piece's end; looks ahead only, so matches may overlap."""
    return "(?=(<[0-9]+>" + sentence.replace(" ", "(?: |<[0-9]+>)") + ")(?:<|$))"


def scan(docs: DataFrame, *, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """Licence rules that each document of ``docs`` (doc_id long, text string; others are ignored) meets.

    One row for each document and rule met: doc_id, rule_id, license, first_sentence and
    last_sentence (numbers from 0 of the pieces where its first match begins and ends). A match
    takes each sentence of the rule where it ends first behind the one before; pieces without
    letters or digits are numbered but stand in no sentence's way. Documents without a match, null
    and empty texts have no rows. Bytes that are no UTF-8
    count as U+FFFD. Repeated rows of one doc_id are one document whose pieces stand
    at the same numbers. An empty table gives an empty one.

    The sentence table is a parameter of a few rows. Whatever matches also stands in the whole
    normalised text, so texts without any known sentence are left before they are split; only
    hits are shuffled, and a document's own hits are all that is gathered.
    """
    spark, docs = docs.sparkSession, docs.withColumn("text", valid_text("text"))
    named = spark.createDataFrame([(s, name) for name, texts in sentences.items() for s in texts], "sentence string, sentence_id string")
    # Normalised by the same expression as the texts; a marks-only entry would match blank sentences.
    known = sorted({tuple(r) for r in named.select(normalise(F.col("sentence")).alias("sentence"), "sentence_id").filter("sentence <> ''").collect()})
    # Lambdas over arrays of one: what is costly is computed once, wherever the optimiser moves it.
    holds = F.exists(F.array(normalise(F.col("text"))), lambda t: reduce(lambda c, k: c | t.contains(k[0]), known, F.lit(False)))
    pieces = F.transform(F.split("text", BREAK), lambda raw, at: F.struct(at.alias("at"), normalise(raw).alias("words")))
    marked = F.array_join(F.transform(F.filter(pieces, lambda p: p["words"] != ""), lambda p: F.concat(F.lit("<"), p["at"].cast("string"), F.lit(">"), p["words"])), "")

    def places(text: Column, sentence: str, name: str) -> Column:
        number = lambda m, pattern: F.regexp_extract(m, pattern, 1).cast("int")
        spot = lambda m: F.struct(number(m, ".*<([0-9]+)>").alias("to"), number(m, "^<([0-9]+)>").alias("at"), F.lit(name).alias("sentence_id"))
        return F.transform(F.regexp_extract_all(text, F.lit(_pattern(sentence)), 1), spot)

    none = F.array().cast("array<struct<to:int,at:int,sentence_id:string>>")
    hits = F.transform(F.array(marked), lambda t: F.flatten(F.array(*(places(t, s, name) for s, name in known), none)))
    every = docs.filter(holds).select("doc_id", F.explode(F.flatten(hits)).alias("hit"))
    # By their ends: taking what ends first never misses a later sentence.
    found = every.groupBy("doc_id").agg(F.array_sort(F.collect_set("hit")).alias("hits"))

    def match(ids: list[str]) -> Column:
        """(first, last) of the first match in ``hits``, last null where there is none."""
        start = F.struct(F.lit(0).alias("done"), F.lit(-1).alias("end"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

        def step(state: Column, hit: Column) -> Column:
            wanted = reduce(lambda c, i: F.when(state["done"] == i, ids[i]).otherwise(c), range(len(ids)), F.lit(None).cast("string"))
            takes = F.coalesce((hit["sentence_id"] == wanted) & (hit["at"] > state["end"]), F.lit(False))
            return F.struct(
                (state["done"] + takes.cast("int")).alias("done"),
                F.when(takes, hit["to"]).otherwise(state["end"]).alias("end"),
                F.when(takes & (state["done"] == 0), hit["at"]).otherwise(state["first"]).alias("first"),
                F.when(takes & (state["done"] == len(ids) - 1), hit["to"]).otherwise(state["last"]).alias("last"),
            )

        return F.aggregate("hits", start, step)

    matched = F.array(*(F.struct(F.lit(rule).alias("rule_id"), F.lit(license).alias("license"), match(ids).alias("m")) for rule, license, ids in rules))
    return (
        found.select("doc_id", F.explode(matched).alias("r"))
        .filter(F.col("r.m.last").isNotNull())
        .select("doc_id", "r.rule_id", "r.license", F.col("r.m.first").cast("long").alias("first_sentence"), F.col("r.m.last").cast("long").alias("last_sentence"))
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for i, texts in SENTENCES.items() for s in texts)
    rules = []
    for rule, license, ids in RULES:
        joins = " ".join(
            f"JOIN LATERAL (SELECT min(pos) AS pos FROM hits h WHERE h.doc_id = d.doc_id AND h.sentence_id = {quote(i)}" + (f" AND h.pos > s{k - 1}.pos" if k else "") + f") s{k} ON true"
            for k, i in enumerate(ids)
        )
        rules.append(
            f"SELECT d.doc_id, {quote(rule)} AS rule_id, {quote(license)} AS license, s0.pos AS first_sentence, s{len(ids) - 1}.pos AS last_sentence "
            f"FROM (SELECT DISTINCT doc_id FROM hits) d {joins} WHERE s{len(ids) - 1}.pos IS NOT NULL"
        )
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT DISTINCT {norm("s")} AS sentence, sentence_id FROM (VALUES {known}) t(s, sentence_id)),
parts AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;])[ \\t]+', '\\1' || chr(1), 'g'), '[\\n\\r]+|' || chr(1)) AS p FROM documents),
sentences AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS pos FROM parts),
hits AS (SELECT DISTINCT doc_id, pos, sentence_id FROM sentences JOIN known ON {norm("raw")} = known.sentence)
{" UNION ALL ".join(rules)}
"""


ORACLE = _oracle()
