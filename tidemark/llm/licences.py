"""License scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Units are the lines of a text and the text as a whole. A unit's size is its number of word pairs, repeats included; a template's
pairs count once each. A unit meets a template only if its size lies between the bounds that the threshold implies: Dice 2c/(a+b) >= t needs b between a*t/(2-t) and a*(2-t)/t. Everything is a projection of the
row: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices in public use, and the identifier that each of them stands for.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-case words of a text: runs of letters and digits; everything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring words, repeats included; a single word counts as a pair with nothing."""
    w = words(text)
    pairs = F.greatest(F.size(w) - 1, F.lit(1))
    return F.zip_with(F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b))


def _template_bigrams(text: str) -> list[str]:
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys([" ".join(p) for p in zip(w, w[1:])] or w))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Licence notices found: (id, line, licence, dice), one row per unit and licence.

    line counts from 0; -1 is the whole text (only for texts of several lines). dice is the best value over the licence's
    templates. Null and empty texts, and texts without a notice, give no row; repeated rows give repeated rows; an empty table gives
    none. Ties of several licences are all returned. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    known = [(name, _template_bigrams(t)) for name, texts in templates.items() for t in texts]
    low = min(len(b) for _, b in known) * threshold / (2 - threshold)
    high = max(len(b) for _, b in known) * (2 - threshold) / threshold
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("line", "unit"))
    whole = docs.where(F.instr(text, "\n") > 0).select(F.col(id_column).alias("id"), F.lit(-1).alias("line"), text.alias("unit"))
    # n word pairs take n + 1 words (one for a lone word); a split can add an empty part at either end. Splitting stops beyond the bound.
    parts = F.size(F.split(F.col("unit"), r"[^\p{L}\p{N}]+", int(high) + 5))
    units = lines.unionByName(whole).where(parts.between(low, high + 4)).select("id", "line", bigrams(F.col("unit")).alias("bigrams"))
    b = F.col("bigrams")

    def dice(pairs: list[str]) -> Column:
        n = len(pairs)
        fits = F.size(b).between(n * threshold / (2 - threshold), n * (2 - threshold) / threshold)
        common = F.size(F.array_intersect(b, F.array(*[F.lit(p) for p in pairs])))
        return F.when(fits, 2.0 * common / (F.size(b) + n)).otherwise(F.lit(0.0))

    scores = [F.struct(F.lit(name).alias("licence"), reduce(F.greatest, [dice(p) for n, p in known if n == name] + [F.lit(0.0)]).alias("dice"))
              for name in templates]
    hits = units.where(F.size("bigrams").between(low, high)).select("id", "line", F.explode(F.array(*scores)).alias("hit"))
    hits = hits.where(F.col("hit.dice") >= threshold)
    return hits.select(F.col("id").alias(id_column), "line", "hit.licence", F.round("hit.dice", 9).alias("dice"))
