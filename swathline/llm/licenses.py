"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories (DataFrame functions only)."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import cut

#: Notices to compare with: fixed wording, titles and first paragraphs of whole licence texts.  ``Proprietary`` sorts after the
#: open licenses that may stand beside such a line.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: What headers call a license.
LABELS = [
    ("AGPL-3.0", "AGPL version 3"), ("AGPL-3.0", "AGPL v3"), ("AGPL-3.0", "AGPLv3 license"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("Apache-2.0", "Apache 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache Software License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-3-Clause", "3-Clause BSD License"), ("BSD-3-Clause", "New BSD License"), ("BSD-3-Clause", "BSD-style license"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC0-1.0", "CC0 1.0"),
    ("GPL-2.0", "GPL version 2"), ("GPL-2.0", "GPL v2"), ("GPL-2.0", "GPLv2 license"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GPL version 3"), ("GPL-3.0", "GPL v3"), ("GPL-3.0", "GPLv3 license"), ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "LGPL version 3"), ("LGPL-3.0", "LGPL v3"), ("LGPL-3.0", "LGPLv3 license"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"), ("MIT", "MIT/X11 License"),
    ("MPL-2.0", "MPL 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("MPL-2.0", "Mozilla Public License, v. 2.0"),
]
#: Names of licence files, with any extension.
NAMES = r"(?i)^(licen[sc]e|copying|notice)(\.[^.]*)?$"
TERM = "[a-z0-9]+"


def header_phrases() -> list[tuple[str, str]]:
    """Short phrases of headers, which are looked for inside lines: identifiers, and what a file is "under"."""
    names = sorted({n for n, _ in TEMPLATES} - {"Proprietary"})
    said = [(n, f"{before} {label}") for n, label in LABELS for before in ("under", "under the", "under the terms of the")]
    tags = [(n, f"{tag} {n}") for n in names for tag in ("SPDX-License-Identifier:", "License:")]
    return said + tags + [(n, label) for n, label in LABELS if len(re.findall(TERM, label.lower())) >= 5]


def terms_of(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1))


def directory(path: Column) -> Column:
    """What stands before the last ``/``; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def license_scan(images: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.7, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """``images`` (id, s3_key, exif) -> (id, s3_key, own_license, score, license, inherited_from), one row for each row given.

    ``exif`` is the text of an uploaded file.  Compared with the templates are its lines, its paragraphs and the whole
    text; ``own_license`` is the template's of the highest cosine if that is ``least`` or more (of equal ones the name that
    sorts first), ``score`` that cosine, rounded to six places, else null.  A licence file is one whose whole text reaches
    ``least``, or with a licence file's name and an own license; its license is its directory's (of several the highest score, then
    the name that sorts first).  A file without an own license gets that of the nearest directory above it (its own
    directory first) that has one: ``inherited_from`` is that directory (empty: the top), null if nothing is inherited.

    So that words beside a notice do not hide it, templates and ``phrases`` of three or more terms are compared with windows of their own
    length too.  A window may lack one in ten of its template's distinct terms (none of fewer than ten); it is laid so that one of the
    template's rarest terms, one more of them than may be lacking, stands at one of its places in the template.  A window is compared with its own template only.
    ``phrases`` (``header_phrases``; none if ``templates`` are given) are compared with windows only.

    A term weighs its count times log((1 + files) / (1 + files with the term)) + 1, files counted over all rows; a word that no
    template or phrase has weighs as one that no file has.  Only units that hold one of a template's heaviest terms are
    compared: what the other terms weigh together is too little for ``least``, so no match is lost.

    A null or empty text has no license of its own; a null ``s3_key`` is in no directory.  Repeated rows come out as often as they go in;
    an empty table gives no rows.  Other columns are not looked at.  ``templates`` and ``phrases`` are lists for their size is small and known.
    """
    if phrases is None:
        phrases = header_phrases() if templates is None else []
    known = [(n, re.findall(TERM, t.lower()), True) for n, t in sorted(set(TEMPLATES if templates is None else templates))]
    known += [(n, re.findall(TERM, t.lower()), False) for n, t in sorted(set(phrases))]
    known = [k for k in known if k[1]]
    vocabulary = sorted({w for _, words, _ in known for w in words})
    text = F.coalesce("exif", F.lit(""))
    in_templates = F.array_intersect(terms_of(F.coalesce("exif", F.lit(""))), F.lit(vocabulary).cast("array<string>"))
    counts = images.select(F.explode(F.concat(in_templates, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    df = {r["term"]: r["count"] for r in counts}  # a number for each template term; the empty term counts the files
    files = df.pop("", 0)
    idf = {w: math.log((1 + files) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    rarest = math.log(1 + files) + 1
    rules, needed, places = [], set(), {}
    for at, (name, words, whole_units) in enumerate(known):
        vector = {w: words.count(w) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        rules.append({"license": name, "units": whole_units, "vector": {w: x / norm for w, x in sorted(vector.items())}})
        rest = 1.0
        for w, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if not whole_units or rest < least ** 2 - 1e-9:
                break
            needed.add(w)
            rest -= (x / norm) ** 2
        may_lack = len(vector) // 10
        for w in sorted(vector, key=lambda w: (df.get(w, 0), w))[:may_lack + 1] if len(words) >= 3 else []:
            places.setdefault(w, []).extend({"rule": at, "before": i, "size": len(words), "has": len(vector) - may_lack, "words": sorted(vector)}
                                            for i, v in enumerate(words) if v == w)

    def holds(terms: set[str]) -> str:
        return "(?i)(?<![a-z0-9])(" + "|".join(sorted(terms) or ["(?!)"]) + ")(?![a-z0-9])"

    placed = F.from_json(F.lit(json.dumps(places)), "map<string, array<struct<rule int, before int, size int, has int, words array<string>>>>")

    def windows(terms: Column) -> Column:
        anchors = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda a: a["term"].isin(sorted(places)))

        def laid(a: Column) -> Column:
            def window(p: Column) -> Column:
                return F.slice(terms, a["at"] - p["before"] + 1, p["size"])
            fits = F.filter(placed[a["term"]], lambda p: (a["at"] >= p["before"]) & (a["at"] - p["before"] + p["size"] <= F.size(terms))
                            & (F.size(F.array_intersect(window(p), p["words"])) >= p["has"]))
            return F.transform(fits, lambda p: F.struct(F.lit(False).alias("whole"), p["rule"].alias("rule"), window(p).alias("terms")))
        return F.array_distinct(F.flatten(F.transform(anchors, laid)))

    # equal texts are compared once, under a hash of the text
    texts = images.select(F.xxhash64(text).alias("key"), text.alias("text")).where(F.col("text").rlike(holds(needed | set(places))))
    lines, paragraphs = F.split("text", "\n"), F.split("text", r"\n[\x20\t\r]*\n")
    units = F.filter(F.array_distinct(F.concat(F.array("text"), lines, paragraphs)), lambda u: u.rlike(holds(needed)))
    of_units = F.transform(units, lambda u: F.struct((u == F.col("text")).alias("whole"), F.lit(-1).alias("rule"), terms_of(u).alias("terms")))
    in_windows = F.transform(F.array(terms_of(F.col("text"))), windows)[0] if places else F.slice(of_units, 1, 0)  # the terms are found once
    compared = texts.select("key", F.explode(F.concat(of_units, in_windows)).alias("u"))
    numbers = F.from_json(F.lit(json.dumps(idf)), "map<string, double>")

    def runs(terms: Column) -> Column:
        """How often terms follow themselves in a sorted list: the squares of their counts, added up."""
        step = F.aggregate(F.sort_array(terms), F.struct(F.lit("").alias("at"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s")), lambda a, t: F.when(
            a["at"] == t, F.struct(t.alias("at"), (a["n"] + 1).alias("n"), (a["s"] + 2 * a["n"] + 1).alias("s"))).otherwise(
            F.struct(t.alias("at"), F.lit(1.0).alias("n"), (a["s"] + 1).alias("s"))))
        return step["s"]

    def counted(terms: Column) -> Column:
        """The distinct ``terms`` (at most the vocabulary) with their weights, from their first places in a sorted list."""
        def of(ordered: Column) -> Column:
            kinds = F.array_distinct(ordered)
            starts = F.transform(F.transform(kinds, lambda t: F.array_position(ordered, t)), lambda p: p.cast("double"))
            ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array((F.size(ordered) + 1).cast("double")))
            return F.transform(F.arrays_zip(kinds.alias("term"), starts.alias("start"), ends.alias("end")),
                               lambda z: F.struct(z["term"].alias("term"), ((z["end"] - z["start"]) * numbers[z["term"]]).alias("w")))
        return F.transform(F.array(F.sort_array(terms)), of)[0]

    # a unit's terms are weighed inside its row: those of the templates one by one, of all others only their squares are needed
    own, others = counted(F.filter("u.terms", lambda t: t.isin(vocabulary))), runs(F.filter("u.terms", lambda t: ~t.isin(vocabulary)))
    named = cut(compared.select("key", "u.whole", F.xxhash64("u.rule", "u.terms").alias("unit"), "u.rule", own.alias("own"), others.alias("others")))
    # each distinct unit is compared once, however many texts hold it, with all templates inside its row
    distinct = named.select("unit", "rule", "own", "others").dropDuplicates(["unit"])
    inside = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    units = distinct.withColumn("inside", inside).withColumn("norm", F.sqrt(F.col("inside") + F.col("others") * F.lit(rarest ** 2)))
    # no cosine is above the share of the templates' terms in the norm
    units = units.where((F.col("norm") > 0) & (F.sqrt("inside") >= (least - 1e-6) * F.col("norm"))).select("unit", "rule", "norm", "own")
    against = F.from_json(F.lit(json.dumps(rules)), "array<struct<license string, units boolean, vector map<string, double>>>")
    of_rule = F.when(F.col("rule") >= 0, F.slice(against, F.col("rule") + 1, 1)).otherwise(F.filter(against, lambda t: t["units"]))

    def cosine(vector: Column) -> Column:
        dot = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(vector[x["term"]], F.lit(0.0)))
        return F.round(dot / F.nullif(F.col("norm"), F.lit(0.0)), 6)

    scored = units.select("unit", F.explode(F.filter(F.transform(of_rule, lambda t: F.struct(cosine(t["vector"]).alias("score"), t["license"].alias("license"))),
                                                     lambda c: c["score"] >= least)).alias("c"))
    unit_best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("c.score")).alias("below"), F.col("c.license").alias("license"))).alias("m"))
    cosines = named.select("key", "whole", F.concat(F.lit("u"), F.col("unit").cast("string")).alias("unit")).join(
        unit_best.select(F.concat(F.lit("u"), F.col("unit").cast("string")).alias("unit"), "m"), "unit").select(
        "key", "whole", F.col("m.license").alias("license"), (-F.col("m.below")).alias("score"))
    best = cosines.where(F.col("score") >= least).groupBy("key").agg(
        F.min(F.struct((-F.col("score")).alias("below"), "license")).alias("b"), F.max("whole").alias("whole_file"))
    found = cut(best.select("key", (-F.col("b.below")).alias("score"), F.col("b.license").alias("own_license"), "whole_file"))

    keyed = images.select("id", "s3_key", F.xxhash64(text).alias("key"), directory(F.col("s3_key")).alias("folder"))
    own = keyed.join(found, "key", "left")
    name = F.regexp_extract("s3_key", r"[^/]*$", 0)
    holders = own.where(F.col("s3_key").isNotNull() & F.col("own_license").isNotNull() & (F.col("whole_file") | name.rlike(NAMES)))
    of_folder = cut(holders.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("below"), F.col("own_license").alias("license"))).alias("b"))
                    .select(F.col("folder").alias("above"), F.col("b.license").alias("license")))
    # a folder asks with all folders above it: "a/b", "a", ""
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    asks = keyed.where(F.col("s3_key").isNotNull()).select("folder").distinct().select("folder", F.posexplode(above).alias("depth", "above"))
    nearest = asks.join(of_folder, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "license")).alias("n"))
    inherited = nearest.select(F.concat("folder", F.lit("")).alias("folder"), F.col("n.above").alias("above"), F.col("n.license").alias("of_above"))
    with_above = own.join(inherited, "folder", "left")
    orphan = F.col("own_license").isNull() & F.col("s3_key").isNotNull()
    return with_above.select("id", "s3_key", "own_license", "score", F.coalesce("own_license", F.when(orphan, F.col("of_above"))).alias("license"),
                             F.when(orphan, F.col("above")).alias("inherited_from"))
