"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance along
the directory tree.  DataFrame expressions only."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and headers of public licences, as their publishers give them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                 "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                 "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released to the public domain under CC0 1.0."],
}

#: Full texts, one file for each licence, as their publishers give them.
TEXTS = Path(__file__).with_name("licence_texts")

#: A notice is looked for around these words; each one holds at least one.
CUE = "^(licens|redistribut|permission|domain)"

TERM = "[a-z0-9]+(?:\\.[0-9]+)*"


def terms_of(text: str) -> list[str]:
    """Lower-case words and version numbers, with one spelling of licence."""
    return re.findall(TERM, text.lower().replace("licenc", "licens"))


def templates(texts: str | Path = TEXTS) -> list[dict]:
    """The notices, then the full texts: number, licence, terms, and for notices the first cue word and its place."""
    out = [(licence, terms_of(t), False) for licence, notices in NOTICES.items() for t in notices]
    out += [(p.stem, terms_of(p.read_text("utf-8")), True) for p in sorted(Path(texts).glob("*.txt"))]
    rows = []
    for k, (licence, terms, full) in enumerate(out):
        at = next(i for i, t in enumerate(terms) if re.match(CUE, t))
        rows.append({"k": k, "licence": licence, "terms": terms, "full": full, "at": at, "cue": terms[at]})
    return rows


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("licenc"), F.lit("licens")), F.lit(f"({TERM})"), F.lit(1))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that hold each word of the templates (a fixed set): added up where the
    files are read, so a task shuffles one row for each word."""
    words = files.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
    held = files.select(F.explode(F.array_distinct(F.concat(_terms(F.col("text")), F.array(F.lit(""))))).alias("term"))
    marked = words.unionByName(files.sparkSession.createDataFrame([("",)], "term string"))
    n = {r["term"]: r["n"] for r in held.join(F.broadcast(marked), "term").groupBy("term").agg(F.count("*").alias("n")).collect()}
    return n.get("", 0), n


def _weighted(tpl: list[dict], idf: dict[str, float], least: float) -> None:
    """Unit weights of each template's terms, and ``need``: how many of its terms a text must hold for a cosine
    of ``least``.  By Cauchy and Schwarz the cosine is at most the norm of the weights of the terms that both hold."""
    for t in tpl:
        raw = {x: (1 + math.log(t["terms"].count(x))) * idf[x] for x in sorted(set(t["terms"]))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        t["w"] = {x: w / norm for x, w in raw.items()}
        mass, need = 0.0, 0
        for w in sorted(t["w"].values(), reverse=True):
            if mass >= least * least - 1e-6:
                break
            mass, need = mass + w * w, need + 1
        t["need"] = need


def _windows(lines: Column, notices: list[dict], slack: int) -> Column:
    """(template, whole, terms) of the joined lines around each cue that may fit the template with that cue.

    A template is laid on the text with its first cue word on the cue found; the window are the whole lines it
    then touches, so a notice may be wrapped in any way.  Lines of more than ``slack`` times the template's
    terms are prose around a mention."""
    table = F.array(*[F.struct(F.lit(t["k"]).alias("k"), F.lit(t["cue"]).alias("cue"), F.lit(t["at"]).alias("at"), F.lit(len(t["terms"])).alias("m"),
                               F.lit(t["need"]).alias("need"), _strings(sorted(set(t["terms"]))).alias("terms")) for t in notices])
    cues = sorted({t["cue"] for t in notices})

    def of_template(d, p, t):
        first = d["line"][F.greatest(p["i"] - t["at"], F.lit(0))]
        last = d["line"][F.least(p["i"] - t["at"] + t["m"], F.size(d["line"])) - 1]
        n = F.aggregate(F.sequence(first, last), F.lit(0), lambda a, i: a + F.size(d["lines"][i]))
        joined = F.when(n <= t["m"] * slack, F.flatten(F.transform(F.sequence(first, last), lambda i: d["lines"][i])))
        return F.struct(t["k"].alias("template"), (2 * n >= F.size(d["line"])).alias("whole"), joined.alias("terms"),
                        t["need"].alias("need"), t["terms"].alias("wanted"))

    def of_cue(d, p):
        fitting = F.transform(F.filter(table, lambda t: t["cue"] == p["x"]), lambda t: of_template(d, p, t))
        kept = F.filter(fitting, lambda u: u["terms"].isNotNull() & (F.size(F.array_intersect(u["terms"], u["wanted"])) >= u["need"]))
        return F.transform(kept, lambda u: F.struct(u["template"].alias("template"), u["whole"].alias("whole"), u["terms"].alias("terms")))

    def of_file(d):
        marked = F.transform(F.flatten(d["lines"]), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.flatten(F.transform(F.filter(marked, lambda p: p["x"].isin(cues)), lambda p: of_cue(d, p)))

    numbers = lambda ls: F.flatten(F.transform(ls, lambda x, i: F.array_repeat(i, F.size(x))))
    return _let(lines, lambda ls: _let(F.struct(ls.alias("lines"), numbers(ls).alias("line")), of_file))


def _wholes(lines: Column, texts: list[dict]) -> Column:
    """(template, whole, terms) of the file as a whole for each full text of which it holds enough terms."""
    def of_file(words):
        hits = [F.when(F.size(F.array_intersect(words, _strings(sorted(set(t["terms"]))))) >= t["need"],
                       F.struct(F.lit(t["k"]).alias("template"), F.lit(True).alias("whole"), words.alias("terms"))) for t in texts]
        return F.array_compact(F.array(*hits))

    return _let(F.flatten(lines), of_file)


def scan(files: DataFrame, least: float = 0.75, slack: int = 3, texts: str | Path = TEXTS) -> DataFrame:
    """(file, path, licence, score, whole): the best template of each file with a cosine of ``least`` or more;
    ``whole`` when the file is a licence file.

    Headers: windows of joined lines against the notice that is laid on them.  Licence files: the file as a
    whole, at any length, against the full texts (a folder of them: ``texts``); a file of which a fitting notice
    makes up half the terms or more is one as well.  A licence file takes the best of what makes it one; ties
    go to the first template (order of NOTICES, then the texts by name).

    Weights are (1 + ln count) * (ln((N + 1) / (df + 1)) + 1), over all N files of the corpus; a word in no
    template weighs as one that no other file holds.  What cannot reach ``least`` by the terms it holds is left
    out where the files are read; the rest is compared by a join of (unit, term) with (template, term).
    """
    spark = files.sparkSession
    tpl = templates(texts)
    vocabulary = sorted({x for t in tpl for x in t["terms"]})
    n, df = _frequencies(files, vocabulary)
    idf = {x: math.log((n + 1.0) / (df.get(x, 0) + 1.0)) + 1 for x in vocabulary}
    _weighted(tpl, idf, least)
    weights = spark.createDataFrame([(x, idf[x]) for x in vocabulary], "term string, idf double")
    wanted = spark.createDataFrame([(t["k"], x, w) for t in tpl for x, w in t["w"].items()], "template int, term string, tw double")
    names = spark.createDataFrame([(t["k"], t["licence"]) for t in tpl], "template int, licence string")

    lines = F.filter(F.transform(F.split("text", "\n"), _terms), lambda x: F.size(x) > 0)
    # one key for a file, which also joins where a part of it is null
    cued = files.where(F.lower("text").rlike("licen[sc]|redistribut|permission|domain")).select(F.struct("file", "path").alias("f"), lines.alias("lines"))
    notices, full = [t for t in tpl if not t["full"]], [t for t in tpl if t["full"]]
    found = _let(F.col("lines"), lambda ls: F.concat(_windows(ls, notices, slack), _wholes(ls, full)))
    units = cued.select("f", F.explode(found).alias("u")).select("f", "u.*").withColumn("unit", F.md5(F.array_join("terms", " ")))
    units = units.groupBy("f", "template", "unit").agg(F.max("whole").alias("whole"), F.first("terms").alias("terms"))  # repeated rows count once
    terms = units.select("f", "template", "unit", "whole", F.explode("terms").alias("term")).groupBy("f", "template", "unit", "whole", "term").agg(
        F.count("*").alias("tf"))
    terms = terms.join(F.broadcast(weights), "term", "left").join(F.broadcast(wanted), ["template", "term"], "left")
    w = (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(math.log(n + 1.0) + 1))
    scored = terms.groupBy("f", "template", "unit", "whole").agg(F.round(F.sum(w * F.col("tw")) / F.sqrt(F.sum(w * w)), 6).alias("score"))
    scored = scored.where(F.col("score") >= least).join(F.broadcast(names), "template")
    best = F.max_by(F.struct("licence", "score"), F.struct("whole", "score", -F.col("template")))
    return scored.groupBy("f").agg(best.alias("b"), F.max("whole").alias("whole")).select(
        F.col("f.file").alias("file"), F.col("f.path").alias("path"), F.col("b.licence").alias("licence"), F.col("b.score").alias("score"), "whole")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, own: DataFrame, salts: int = 16) -> DataFrame:
    """(file, path, licence, score, origin) for every row of ``files``: its own licence, or that of
    the nearest directory above it that holds a licence file.

    A directory with several licence files takes the licence that most of them name (ties: the
    first name).  Directories are made distinct before their ancestors are looked up, so a
    directory with very many files is one row there; in the last join by directory the files of
    one are spread over ``salts`` keys.
    """
    held = own.where("whole").groupBy(_parent(F.col("path")).alias("above"), "licence").agg(F.count("*").alias("n"))
    held = held.groupBy("above").agg(F.min_by("licence", F.struct(-F.col("n"), F.col("licence"))).alias("licence"))
    dirs = files.select(_parent(F.col("path")).alias("dir")).where("dir is not null").distinct()
    steps = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))).alias("u")).select("dir", "u.depth", "u.above")
    nearest = ups.join(held, "above").groupBy("dir").agg(F.max_by("licence", "depth").alias("from_dir"))
    nearest = nearest.select("dir", "from_dir", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    mine = own.select(F.col("file").alias("f"), F.col("path").alias("p"), "licence", "score")
    rows = files.select("file", "path", _parent(F.col("path")).alias("dir"), F.pmod(F.hash("file", "path"), F.lit(salts)).alias("salt"))
    rows = rows.join(mine, rows["file"].eqNullSafe(mine["f"]) & rows["path"].eqNullSafe(mine["p"]), "left").join(nearest, ["dir", "salt"], "left")
    return rows.select("file", "path", F.coalesce("licence", "from_dir").alias("licence"), "score",
                       F.when(F.col("licence").isNotNull(), "own").when(F.col("from_dir").isNotNull(), "inherited").alias("origin"))


def licence_scan(docs: DataFrame, path: Column, least: float = 0.75, texts: str | Path = TEXTS) -> DataFrame:
    """(doc_id, path, licence, score, origin) for every row of ``docs`` (doc_id, text).

    ``path``: where the file lies, with / between directories.  A null text holds no notice;
    a null path has no directory above it.  Rows with the same doc_id and path share the best
    notice of them.  Without any notice all licences are null; an empty table gives an empty one."""
    files = docs.select(F.col("doc_id").alias("file"), path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return inherit(files.drop("text"), scan(files, least, texts=texts)).withColumnRenamed("file", "doc_id")
