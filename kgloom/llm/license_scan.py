"""License scans (3): ordered signature rules over whole texts, natively.

A rule is a regex over a text's words (lower-case, joined by single spaces), with
a keyword (characters, not always a whole word) that the text must hold before the
regex is tried, a priority (1 is best) and a label. A detection inside another of the same or a better priority is
suppressed. Base phrases are found besides, at all their places, and never suppressed.

Defined cases: a null text is empty; of equal detections the earlier rule's
stays; rows are kept one for one; other columns are ignored.
"""

from __future__ import annotations

import json
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import NON_ALNUM, carries

#: (label, keyword, name): a licence's name as a regex over words; every form of it holds the keyword, a word unless it has a * where other characters may follow or precede.
FAMILIES: list[tuple[str, str, str]] = [
    ("mit", "mit", "(?:the )?mit(?: x11| expat)?"),
    ("apache-1.1", "apache", "apache(?: software)? (?:license )?(?:version |v)?1 1"),
    ("apache-2", "apache*", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-2-clause", "*bsd", "(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", "(?:the )?bsd(?: style)?"),
    ("gpl-2", "gpl*", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl*", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "general", "(?:the )?gnu general public"),
    ("gpl", "gpl", "(?:the )?(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl*", "(?:gnu )?lgpl(?: version| v)? ?v?2 1"),
    ("lgpl-3", "lgpl*", "(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", "general", "(?:the )?gnu (?:lesser|library) general public"),
    ("agpl-3", "affero", "(?:the )?gnu affero general public"),
    ("agpl-3", "agpl*", "(?:gnu )?agpl(?: version| v)? ?v?3?(?: 0)?"),
    ("gfdl", "documentation", "(?:the )?gnu free documentation"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license)?(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", "mozilla public(?: license)?(?:(?: version| v)? ?2(?: 0)?)?"),
    ("epl-1", "eclipse", "eclipse public(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public(?: license)?(?:(?: version| v)? ?2(?: 0)?)?"),
    ("edl-1", "eclipse", "eclipse distribution(?: license)?(?: version| v)? ?1?(?: 0)?"),
    ("cddl-1", "cddl*", "cddl(?: version| v)? ?1?(?: [01])?"),
    ("cddl-1", "development", "common development and distribution"),
    ("cpl-1", "common", "common public"),
    ("isc", "isc", "(?:the )?isc"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?"),
    ("libpng", "libpng", "(?:the )?libpng"),
    ("boost-1", "boost", "(?:the )?boost software(?: license)?(?: version| v)? ?1?(?: 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl"),
    ("artistic-1", "artistic*", "artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic*", "artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("psf-2", "python", "python software foundation"),
    ("php-3", "php*", "php(?: license)?(?: version| v)? ?3(?: 0[01]?)?"),
    ("ruby", "ruby", "(?:the )?ruby"),
    ("perl", "perl", "same terms as perl(?: itself)?"),
    ("postgresql", "postgresql", "(?:the )?postgresql"),
    ("openssl", "openssl", "(?:the )?openssl"),
    ("x11", "x11", "(?:the )?x11"),
    ("eupl", "eupl*", "(?:the )?eupl(?: version| v)? ?(?:1 [012])?"),
    ("eupl", "european", "european union public"),
    ("ofl-1.1", "sil", "sil open font"),
    ("osl-3", "osl*", "osl(?: version| v)? ?3?(?: 0)?"),
    ("osl-3", "open", "open software"),
    ("afl-3", "academic", "academic free"),
    ("ecl-2", "educational", "educational community"),
    ("ncsa", "illinois", "university of illinois(?: open source| ncsa)*"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("upl-1", "universal", "universal permissive"),
    ("cecill", "cecill", "(?:the )?cecill(?: [abc])?"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc0", "zero", "creative commons zero"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative|ative work|)s?"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative|ative work|)s?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by", "commons", "creative commons attribution"),
    ("odbl-1", "database", "open (?:data commons )?(?:open )?database"),
    ("odc-by-1", "commons", "open data commons attribution"),
    ("pddl-1", "dedication", "public domain dedication and"),
    ("public-domain", "domain", "public domain"),
    ("bsl-1.1", "business", "business source"),
    ("sspl-1", "server", "server side public"),
    ("elastic-2", "elastic*", "elastic(?: license)?(?: version| v)? ?2?(?: 0)?"),
    ("llama", "llama", "llama(?: [0-9])?(?: [0-9])? community"),
    ("openrail", "*rail", "(?:creativeml )?open ?rail(?: m)?"),
]
#: (priority, form): the ways in which a text names a licence.
FORMS: list[tuple[int, str]] = [
    (1, "spdx license identifier {}(?: only| or later)?"),
    (2, "(?:licensed|released|distributed|available|published|provided|redistribute[d]?(?: it)?|used) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[cs]e)?"),
    (3, "(?:under|subject to|governed by|according to) (?:the )?(?:terms of )?(?:the )?{} licen[cs]e"),
    (4, "licen[cs]e (?:is )?{}"),
    (5, "{} licen[cs]e"),
]
#: Rules that name no licence of a family.
SINGLE: list[tuple[int, str, str, str]] = [
    (2, "cc-by-nc", "cc", "(?:licensed|released|published|available) under (?:a |the )?cc by nc"),
    (2, "public-domain", "domain", "(?:dedicated to|placed in(?:to)?|released (?:in)?to|in) the public domain"),
    (2, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    (2, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    (2, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    (2, "gpl", "general", "gnu general public license as published by the free software foundation"),
    (4, "proprietary", "reserved", "all rights reserved"),
    (4, "proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    (5, "copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
]
PRIORITIES = 5
#: How much a detection of each priority counts for the score.
WEIGHTS = (1.0, 0.9, 0.8, 0.6, 0.4)
#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: What every text with a rule's or a base phrase's match holds.
_GATE = r"(?i)licen[cs]|(?<![a-z])under(?![a-z])|spdx|copyright|proprietary|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|permission|redistribut|public[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+domain|all[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+rights"


def rules() -> list[dict]:
    """All rules, in order of priority and then of the families."""
    out = [{"priority": p, "label": label, "keyword": f" {word} ".replace(" *", "").replace("* ", ""), "regex": f"(?<= ){form.format(name)}(?= )"} for p, form in FORMS for label, word, name in FAMILIES]
    out += [{"priority": p, "label": label, "keyword": f" {word} ", "regex": f"(?<= ){regex}(?= )"} for p, label, word, regex in SINGLE]
    return [r | {"rule": i} for i, r in enumerate(sorted(out, key=lambda r: r["priority"]))]


_RULE = "struct<rule:int,priority:int,label:string,keyword:string,regex:string>"


def _places(norm: Column, regex: Column) -> Column:
    """(first, end) words of each match, by the lengths of what lies before and between matches."""
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    found = F.regexp_extract_all(norm, regex, F.lit(0))
    both = F.arrays_zip(F.split(norm, regex, -1).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + spaces(x["gap"])
        end = first + spaces(x["hit"]) + 1
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct((end - 1).alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("first"), end.alias("end")))).alias("out")))

    return F.aggregate(both, start, step)["out"]


def _unsuppressed(hits: Column) -> Column:
    """Detections, by first word, that lie in no other of the same or a better priority."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["first"].alias("first"), (-h["end"]).alias("back"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"))))
    start = F.struct(F.array_repeat(F.lit(-1), PRIORITIES).alias("reach"), F.array().cast("array<struct<first:int,back:int,priority:int,rule:int,label:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        inside = F.array_max(F.slice(acc["reach"], F.lit(1), h["priority"])) >= -h["back"]
        reach = F.transform(acc["reach"], lambda x, i: F.when(i == h["priority"] - 1, F.greatest(x, -h["back"])).otherwise(x))
        return F.when(inside, acc).otherwise(F.struct(reach.alias("reach"), F.concat(acc["out"], F.array(h)).alias("out")))

    kept = F.aggregate(ordered, start, step)["out"]
    return F.transform(kept, lambda h: F.struct(h["first"].alias("first"), (-h["back"]).alias("end"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label")))


def _phrase_places(phrase: str, label: str) -> Column:
    head, _, tail = phrase.partition(" ")
    regex = f"(?<= ){head}(?= {tail} )" if tail else f"(?<= ){head}(?= )"
    return F.transform(_places(F.col("_norm"), F.lit(regex)), lambda p: F.struct(p["first"].cast("long").alias("first"), F.lit(label).alias("label")))


@carries("n_words", "detections", "base", "score")
def scan_licenses(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, detections (first, end, priority, rule, label; words from 0), base (first, label) and score of each row; result columns take the place of those in `keep` of their names."""
    text = F.coalesce("text", F.lit(""))
    table = F.from_json(F.lit(json.dumps(rules())), f"array<{_RULE}>")
    gap = NON_ALNUM
    phrases = "|".join(p.replace(" ", gap) for p, _ in base)
    gate = F.rlike(text, F.lit(f"{_GATE}|{phrases}"))
    lowered = F.translate(F.concat(F.lit(" "), F.regexp_replace(text, f"{gap}|^|$", " "), F.lit(" ")), ascii_uppercase, ascii_lowercase)
    rows = docs.select(*keep, F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(gate, F.regexp_replace(lowered, " +", " ")).alias("_norm"))
    tried = F.filter(table, lambda r: F.contains(F.col("_norm"), r["keyword"]))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(_places(F.col("_norm"), r["regex"]), lambda p: F.struct(p["first"].alias("first"), p["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))))
    plain = [_phrase_places(phrase, label) for phrase, label in base]
    none = F.array().cast("array<struct<first:bigint,label:string>>")
    rows = rows.select(*keep, "n_words", F.when(F.col("_norm").isNotNull(), hits).alias("_hits"), F.when(F.col("_norm").isNotNull(), F.concat(none, *plain)).otherwise(none).alias("base"))
    rows = rows.withColumn("detections", F.coalesce(_unsuppressed(F.col("_hits")), F.array().cast("array<struct<first:int,end:int,priority:int,rule:int,label:string>>")))
    weights = F.array(*map(F.lit, WEIGHTS))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda h: F.element_at(weights, h["priority"]))), F.lit(0.0)))
    return rows.select(*keep, "n_words", "detections", "base", score.alias("score"))
