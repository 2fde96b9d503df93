"""Operator 3, license scans as an exact set-similarity join, in DataFrame functions alone.

A text block (lines up to a blank one) matches a license template when it holds at least CONTAINED
of the template's distinct tokens. All that a block and a template can share are template tokens,
so blocks are first cut down to those. Tokens are ordered by how many blocks of the corpus hold
them. A match shares a token among the first |T| - a + 1 of the template and the first |B| - a + 1
of the block (prefix filter, a: the tokens needed), a block has at least a of them (length filter),
and enough must follow the place where they meet (positional filter). What is left is intersected.

Beside it, places are counted where the words of a license's name stand in a row.

Defined results: a null text is empty, without words, places or labels, score 0; a null doc_id and
repeated rows are scanned like any other; an empty table gives no rows; extra columns are not read.
"""

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, let, stored

# Names of licenses and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The public notices that texts under these licenses carry. Blocks end at blank lines, so a
# notice that is printed with blank lines also stands here by its paragraphs.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "apache-2.0-notice-basis": """Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied.""",
    "apache-2.0-notice-use": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    "bsd-conditions-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "bsd-conditions-source": """Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "bsd-conditions-use": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:""",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "isc-permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mit-line": "Released under the MIT License.",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "mit-permission-copies": """The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "mit-permission-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions:""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
CONTAINED = 0.85
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens_of(text: str) -> list[str]:
    import re

    return sorted({w for w in re.split(_BETWEEN, text.lower()) if w})


def words_of(text: Column) -> Column:
    """Words of a text that is in lower case already."""
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def lowered(text: Column) -> Column:
    """A-Z alone in lower case. Beyond ASCII only the Kelvin sign would become one of a-z."""
    return F.when(F.contains(text, F.lit("K")), F.translate(text, _CAPITALS, _CAPITALS.lower())).otherwise(F.lower(text))


def places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of the phrase in an array of words."""
    parts = phrase.split()
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())

    def stands(i):
        held = F.get(words, i + 1) == parts[1]
        for j, part in enumerate(parts[2:], 2):
            held &= F.get(words, i + j) == part
        return held

    return F.filter(first, stands)


def blocks_of(low: Column, words: Column, vocabulary: Column, least: int) -> Column:
    """Template tokens of each block, where there are enough of them for any template."""
    cut = F.when(F.rlike(low, F.lit(r"\n[ \t\r]*\n")), F.transform(F.split(low, r"\n[ \t\r]*\n"), words_of)).otherwise(
        F.array(words)
    )
    return F.filter(F.transform(cut, lambda b: F.array_intersect(b, vocabulary)), lambda b: F.size(b) >= least)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    spark = docs.sparkSession
    sets = {name: tokens_of(text) for name, text in (templates or TEMPLATES).items()}
    need = {name: ceil(contained * len(tokens)) for name, tokens in sets.items()}
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets.values()))])
    least = min(need.values())

    def read(low):
        def of_words(w):
            def found(phrase):
                rare = F.contains(low, F.lit("license"))
                return F.when(rare, places(w, phrase)).otherwise(F.array().cast("array<int>"))

            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.struct(*[found(p).alias(label) for p, label in PHRASES.items()]).alias("at"),
                blocks_of(low, w, vocabulary, least).alias("blocks"),
            )

        return let(words_of(low), of_words)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(let(lowered(text), read))).alias("x"))
        .select("doc_id", "x.*", F.monotonically_increasing_id().alias("row")),
        "scanned",
    )
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "tokens"))

    # A count for each template token, whatever the input.
    held = {r["token"]: r["count"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    rank = lambda w: (held.get(w, 0), w)
    ordered = sorted(set().union(*sets.values()), key=rank)
    table = []
    for name, tokens in sets.items():
        tokens = sorted(tokens, key=rank)
        table += [(t, name, i, need[name], tokens) for i, t in enumerate(tokens[: len(tokens) - need[name] + 1])]
    table = spark.createDataFrame(table, "token string, template string, place int, need int, held array<string>")

    blocks = blocks.select("row", "block", F.array_intersect(F.array(*[F.lit(w) for w in ordered]), "tokens").alias("tokens"))
    firsts = blocks.select("row", "block", "tokens", F.posexplode(
        F.slice("tokens", F.lit(1), F.size("tokens") - (least - 1))).alias("at", "token"))
    room = F.least(F.size("tokens") - F.col("at"), F.size("held") - F.col("place"))
    met = firsts.join(F.broadcast(table), "token").filter((F.size("tokens") >= F.col("need")) & (room >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "held"))
    matches = met.withColumn("shared", shared).filter("shared >= need").groupBy("row").agg(
        F.collect_set("template").alias("found"), F.max(F.col("shared") / F.size("held")).alias("best")
    )

    names = list(PHRASES.values())
    every = F.concat(*[F.col(f"at.{x}") for x in names])
    base = F.array_compact(F.array(*[F.when(F.size(f"at.{x}") > 0, F.lit(x)) for x in names]))
    whole = rows.drop("blocks").join(matches, "row", "left").withColumns({"every": every, "base": F.array_sort(base)})
    return whole.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def oracle(templates: dict[str, str] | None = None, contained: float = CONTAINED) -> str:
    """The same by comparing every block with every template."""
    sets = {name: tokens_of(text) for name, text in (templates or TEMPLATES).items()}
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"('{n}', {listed(t)}, {ceil(contained * len(t))})" for n, t in sets.items())
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

    def starts(phrase):
        parts = phrase.split()
        held = " and ".join(f"w[i + {j + 1}] = '{p}'" for j, p in enumerate(parts))
        return f"list_filter(range(len(w)), lambda i: {held})"

    base = ", ".join(f"{starts(p)} as at_{label}" for p, label in PHRASES.items())
    labels = list(PHRASES.values())
    every = "list_concat(" * (len(labels) - 1) + f"at_{labels[0]}" + "".join(f", at_{x})" for x in labels[1:])
    cases = ", ".join(f"case when len(at_{x}) > 0 then '{x}' end" for x in labels)
    return f"""
with low as (
  select row_number() over () as r, doc_id,
         translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}') as t
  from documents
), worded as (select r, doc_id, t, regexp_extract_all(t, {word}) as w from low),
based as (select r, doc_id, len(w) as n_words, {base} from worded),
joined as (
  select r, doc_id, n_words, {every} as every, list_filter([{cases}], lambda x: x is not null) as base from based
), templates(template, held, need) as (values {values}),
blocks as (select r, regexp_extract_all(unnest(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n')), {word}) as tokens from low),
matches as (
  select r, list(distinct template) as found, max(len(list_intersect(tokens, held)) / cast(len(held) as double)) as best
  from blocks, templates where len(list_intersect(tokens, held)) >= need group by r
)
select doc_id, cast(n_words as bigint) as n_words, cast(len(every) as bigint) as n_base,
       cast(list_min(every) as bigint) as first_word, cast(list_max(every) as bigint) as last_word,
       array_to_string(list_sort(base), ',') as base_labels,
       array_to_string(list_sort(list_concat(base, coalesce(found, []))), ',') as labels,
       case when len(every) > 0 then 1.0 else coalesce(best, 0.0) end as score
from joined left join matches using (r)
"""


ORACLE = oracle()
