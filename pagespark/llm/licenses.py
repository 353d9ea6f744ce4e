"""Licences that texts state, found by ordered signature rules in SQL functions alone.

A text becomes its words, lower-cased, each with a space on both sides; rules are regular expressions over
that form. The plan is one scan, one projection and one exchange of narrow rows:

1. *Keyword prefilter*: each rule names a word that all its matches hold. The keywords among a
   text's words select its rules; a text without any is never put together again and meets no rule.
2. *Matching*: each selected rule marks its matches; the pieces between marks give their places in words.
3. *Resolution*, by windows over a text's matches in order of place: a match goes where a match
   that starts no later and ends no earlier has the same or a higher priority (a lower number); of
   matches of one place, the first rule's stays. A running maximum of ends for each priority
   decides this, so k matches cost k log k, never their pairs.

Rules come in the order of their priority: identifier tags, sentences and grants, titles, mentions of a
family. ``BASE`` rules are kept whatever covers them.

Defined results: null and empty texts have no words, no labels and score 0. Rows are told apart by their
place in the scan, so repeated rows and ids (null ones too) each give a row. Text of any length is read whole. An
empty table gives no rows. The input's other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG, STATED, TITLE, FAMILY = 0, 1, 2, 3
#: Certainty of a label by the priority of its rule.
CERTAINTY = {TAG: 1.0, STATED: 0.9, TITLE: 0.8, FAMILY: 0.5}
#: What stands between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"
#: Characters outside A-Z whose lower case has a letter of a-z.
_TRICKY = "[Kİ]"


@dataclass(frozen=True)
class Rule:
    """A regular expression over words with single spaces between them; ``keyword`` stands in every match."""

    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: Phrases whose labels are always kept.
BASE = (
    Rule("mit", STATED, "license", "under the mit license", True),
    Rule("apache-2", STATED, "apache", "apache license version 2", True),
    Rule("cc-by-nc", STATED, "nc", "cc by nc", True),
)

# label | keyword | title, written as words
_TITLES = """
0bsd | bsd | (?:zero clause|0 clause|free public) bsd(?: license)?
afl-2.1 | academic | academic free license(?: version| v)? (?:v)?2 1
afl-3.0 | academic | academic free license(?: version| v)? (?:v)?3(?: 0)?
agpl-3.0-only | affero | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: version| v)? (?:v)?3(?: 0)?(?: only)?
agpl-3.0-or-later | affero | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
agpl-3.0-only | agplv3 | (?:gnu )?agplv3(?: only)?
agpl-3.0-or-later | agpl | (?:gnu )?agpl (?:v)?3(?: 0)? or later
agpl-3.0-only | agpl | (?:gnu )?agpl (?:version |v)?3(?: 0)?(?: only)?
apache-1.0 | apache | apache(?: software)? license(?: version)? (?:v)?1 0
apache-1.1 | apache | apache(?: software)? license(?: version)? (?:v)?1 1
apache-2 | apache | apache(?: software)?(?: public)? licen[cs]e(?: version)? (?:v)?2(?: 0)?
apache-2 | apache | apache (?:version |v)?2(?: 0)?(?: licen[cs]e)?
apache-2 | asl | asl (?:v)?2(?: 0)?
apl-1.0 | adaptive | adaptive public license(?: version)? 1 0
apsl-2.0 | apple | apple public source license(?: version)? 2 0
artistic-1.0 | artistic | artistic license(?: version)? 1 0
artistic-2.0 | artistic | artistic license(?: version)? 2(?: 0)?
beerware | beerware | beerware(?: license)?
beerware | beer | beer ware license(?: revision 42)?
bsd-1-clause | bsd | (?:1|one) clause bsd(?: license)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: license)?
bsd-2-clause | bsd | bsd (?:2|two) clause(?: license)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | bsd | (?:new|revised|modified) bsd(?: license)?
bsd-3-clause | bsd | bsd (?:3|three) clause(?: license)?
bsd-4-clause | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | bsd | (?:original|old) bsd(?: license)?
bsd-4-clause | bsd | bsd (?:4|four) clause(?: license)?
bsl-1.0 | boost | boost software license(?: version)? (?:v)?1(?: 0)?
bsl-1.0 | boost | boost software license
busl-1.1 | business | business source license(?: version)? 1 1
cal-1.0 | autonomy | cryptographic autonomy license(?: version)? 1(?: 0)?
catosl-1.1 | computer | computer associates trusted open source license(?: version)? 1 1
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | zero | creative commons zero(?: v| version)?(?: 1 0)?(?: universal)?
cc-by-1.0 | cc | cc by 1 0
cc-by-2.0 | cc | cc by 2 0
cc-by-2.5 | cc | cc by 2 5
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-nd-2.0 | cc | cc by nd 2 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-nd-2.0 | cc | cc by nc nd 2 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-2.0 | attribution | creative commons attribution 2 0(?: generic)?(?: license)?
cc-by-3.0 | attribution | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-4.0 | attribution | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nd-4.0 | noderivatives | creative commons attribution noderivatives 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-3.0 | noncommercial | creative commons attribution noncommercial 3 0(?: unported)?(?: license)?
cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial noderivatives 4 0(?: international)?(?: public)?(?: license)?
cddl-1.0 | cddl | cddl(?: version)? (?:v)?1(?: 0)?
cddl-1.0 | distribution | common development and distribution license(?: version)? 1(?: 0)?
cddl-1.1 | distribution | common development and distribution license(?: version)? 1 1
cdla-permissive-2.0 | cdla | cdla permissive (?:version )?2 0
cecill-2.1 | cecill | cecill(?: license)?(?: version)? (?:v)?2 1
cecill-b | cecill | cecill b(?: license)?
cecill-c | cecill | cecill c(?: license)?
cpal-1.0 | attribution | common public attribution license(?: version)? 1 0
cpl-1.0 | common | common public license(?: version)? (?:v)?1(?: 0)?
ecl-2.0 | educational | educational community license(?: version)? 2 0
efl-2.0 | eiffel | eiffel forum license(?: version)? 2
epl-1.0 | eclipse | eclipse public license(?: version| v)? (?:v)?1(?: 0)?
epl-2.0 | eclipse | eclipse public license(?: version| v)? (?:v)?2(?: 0)?
eupl-1.1 | eupl | eupl(?: version)? (?:v)?1 1
eupl-1.2 | eupl | eupl(?: version)? (?:v)?1 2
eupl-1.2 | european | european union public licen[cs]e(?: version| v)? (?:v)?1 2
fdl-1.2 | documentation | (?:gnu )?free documentation license(?: version)? 1 2
fdl-1.3 | documentation | (?:gnu )?free documentation license(?: version)? 1 3
ftl | freetype | freetype(?: project)? license
gpl-1.0-only | general | (?:gnu )?general public license(?: version| v)? (?:v)?1(?: 0)?(?: only)?
gpl-2.0-only | general | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?2(?: 0)?(?: only)?
gpl-2.0-or-later | general | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?2(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0-only | general | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?3(?: 0)?(?: only)?
gpl-3.0-or-later | general | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
gpl-2.0-only | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)?(?: only)?
gpl-2.0-or-later | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)? or(?: any)? later(?: version)?
gpl-3.0-only | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)?(?: only)?
gpl-3.0-or-later | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)? or(?: any)? later(?: version)?
gpl-2.0-only | gplv2 | (?:gnu )?gplv2(?: only)?
gpl-3.0-only | gplv3 | (?:gnu )?gplv3(?: only)?
hpnd | historical | historical permission notice and disclaimer
icu | icu | icu license
ijg | jpeg | independent jpeg group license
ipl-1.0 | ibm | ibm public license(?: version)? 1 0
isc | isc | isc license
json | json | json license
lgpl-2.0-only | library | (?:gnu )?library general public license(?: version| v)? (?:v)?2(?: 0)?
lgpl-2.1-only | lesser | (?:gnu )?lesser general public license(?: version| v)? (?:v)?2 1(?: only)?
lgpl-2.1-or-later | lesser | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?2 1(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
lgpl-3.0-only | lesser | (?:gnu )?lesser general public license(?: version| v)? (?:v)?3(?: 0)?(?: only)?
lgpl-3.0-or-later | lesser | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?
lgpl-2.1-only | lgpl | (?:gnu )?lgpl (?:version |v)?2 1(?: only)?
lgpl-3.0-only | lgpl | (?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only)?
libpng-2.0 | libpng | libpng license(?: version)? 2(?: 0)?
lppl-1.3c | latex | latex project public license(?: version)? 1 3c
mit | license | mit license
mit | licence | mit licence
mit | expat | expat licen[cs]e
mit-0 | attribution | mit no attribution(?: license)?
mpl-1.1 | mozilla | mozilla public license(?: version| v)? (?:v)?1 1
mpl-2.0 | mozilla | mozilla public license(?: version| v)? (?:v)?2(?: 0)?
mpl-1.1 | mpl | mpl (?:version |v)?1 1
mpl-2.0 | mpl | mpl (?:version |v)?2(?: 0)?
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
mulanpsl-2.0 | mulan | mulan permissive software license(?: version| v)? (?:v)?2
ncsa | ncsa | (?:university of illinois )?ncsa open source license
nposl-3.0 | profit | non profit open software license(?: version)? 3 0
odbl-1.0 | odbl | odbl(?: version)?(?: 1 0)?
odbl-1.0 | database | open data commons open database license(?: version| v)?(?: (?:v)?1 0)?
odc-by-1.0 | attribution | open data commons attribution license(?: version| v)?(?: (?:v)?1 0)?
ofl-1.1 | font | (?:sil )?open font license(?: version)?(?: 1 1)?
openssl | openssl | openssl license
osl-3.0 | open | open software license(?: version| v)? (?:v)?3(?: 0)?
pddl-1.0 | dedication | public domain dedication and licen[cs]e
php-3.01 | php | php license(?: version)? 3 01
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | python | python software foundation license(?: version)?(?: 2)?
python-2.0 | python | python license(?: version)? 2 0
qpl-1.0 | q | q public license(?: version)? 1 0
ruby | ruby | ruby license
sspl-1.0 | server | server side public license(?: version| v)?(?: (?:v)?1)?
unicode-dfs-2016 | unicode | unicode license agreement
unlicense | unlicense | unlicense
upl-1.0 | universal | universal permissive license(?: version| v)? 1 0
vim | vim | vim license
w3c | w3c | w3c software notice and license
wtfpl | wtfpl | wtfpl(?: version)?(?: 2)?
x11 | x11 | x11 license
zlib | zlib | zlib license
zlib | libpng | zlib libpng license
zpl-2.1 | zope | zope public license(?: version)? 2 1
"""

# label | keyword | words of a licence's own text or of a notice
_SENTENCES = """
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | endorse | neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2 | compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 | apache | www apache org licenses license 2 0
gpl-2.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0 | execute | to use reproduce display distribute execute and transmit the software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
ofl-1.1 | font | this font software is licensed under the sil open font license
cc0-1.0 | waived | waived all copyright and related or neighboring rights
public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | (?:this|the) [^ ]+ is in the public domain
all-rights-reserved | reserved | all rights reserved
proprietary | proprietary | proprietary and confidential
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
gpl-3.0-only | gnu | www gnu org licenses gpl 3 0
lgpl-3.0-only | gnu | www gnu org licenses lgpl 3 0
agpl-3.0-only | gnu | www gnu org licenses agpl 3 0
mit | opensource | opensource org licenses mit(?: license)?
"""

# label | keyword | words that name a family and no version
_FAMILIES = """
agpl | affero | (?:gnu )?affero general public license
agpl | agpl | (?:gnu )?agpl
apache | apache | apache(?: software)? licen[cs]e
artistic | artistic | artistic license
bsd | bsd | bsd(?: style)? licen[cs]e
cc-by | cc | cc by
cc-by-sa | cc | cc by sa
cc-by-nd | cc | cc by nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
creative-commons | creative | creative commons(?: licen[cs]e)?
cc-by | attribution | creative commons attribution(?: licen[cs]e)?
cc-by-sa | sharealike | creative commons attribution sharealike(?: licen[cs]e)?
cc-by-nc | noncommercial | creative commons attribution noncommercial(?: licen[cs]e)?
cddl | cddl | cddl
eclipse | eclipse | eclipse public license
eupl | eupl | eupl
gfdl | documentation | (?:gnu )?free documentation license
gpl | general | (?:gnu )?general public license
gpl | gpl | (?:gnu )?gpl
lgpl | lesser | (?:gnu )?lesser general public license
lgpl | lgpl | (?:gnu )?lgpl
mit | licensed | mit licensed
mpl | mozilla | mozilla public license
mpl | mpl | mpl
ofl | font | open font license
"""

#: Ways in which a grant names a licence.
_GRANT = "(?:licensed|released|distributed|available|published|provided|covered) under(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)?"


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def _tag(label: str) -> str:
    """The words of a label in an identifier line."""
    name = "apache-2.0" if label == "apache-2" else label
    return "spdx license identifier " + name.replace("-", " ").replace(".", " ")


def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, then tags, sentences and grants, titles, families."""
    titles, families = _lines(_TITLES), _lines(_FAMILIES)
    labels = dict.fromkeys(label for label, *_ in titles)
    tags = [Rule(label, TAG, "spdx", _tag(label)) for label in labels]
    sentences = [Rule(label, STATED, keyword, pattern) for label, keyword, pattern in _lines(_SENTENCES)]
    grants = [Rule(label, STATED, keyword, f"{_GRANT} {pattern}") for label, keyword, pattern in titles]
    plain = [Rule(label, TITLE, keyword, pattern) for label, keyword, pattern in titles]
    named = [Rule(label, FAMILY, keyword, pattern) for label, keyword, pattern in families]
    return (*BASE, *tags, *sentences, *grants, *plain, *named)


def compiled(rule: Rule) -> str:
    """The rule over words that have a space on both sides each."""
    return f" {rule.pattern} ".replace("[^ ]+", "\x00").replace(" ", "  ")[1:-1].replace("\x00", "[^ ]+")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, never to a letter of a-z."""
    return F.when(text.rlike(_TRICKY), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _table(given: tuple[Rule, ...]) -> Column:
    """The rules as one constant."""
    rows = [{"rule": k, "expression": compiled(r)} | asdict(r) for k, r in enumerate(given)]
    schema = "array<struct<rule:int,label:string,priority:int,keyword:string,expression:string,base:boolean>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def detections(docs: DataFrame, given: tuple[Rule, ...] | None = None) -> DataFrame:
    """Every match of each row of ``docs`` (doc_id, text), resolved; a row without any has one row of nulls.

    row, doc_id, n_words; label, priority, base, first_word and end_word of the match; kept.
    """
    given = rules() if given is None else given
    keywords = F.array(*(F.lit(k) for k in dict.fromkeys(r.keyword for r in given)))
    found = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = found.select("row", "doc_id", F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), _BETWEEN), "").alias("words"))
    found = found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.array_intersect("words", keywords).alias("present"))
    some = F.size("present") > 0
    found = found.select("row", "doc_id", "n_words", "present", F.when(some, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("spaced"))

    def pieces(rule: Column) -> Column:
        """Words of what stands before, in, between and after the matches."""
        cut = F.split(F.regexp_replace("spaced", rule["expression"], F.lit(f"{_MARK}$0{_MARK}")), _MARK)
        return F.transform(cut, lambda p: ((F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))) / 2).cast("long"))

    chosen = F.when(some, F.filter(_table(given), lambda r: F.array_contains("present", r["keyword"])))
    found = found.select("row", "doc_id", "n_words", "present", "spaced", chosen.alias("chosen"))
    hits = F.transform("chosen", lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["base"].alias("base"), pieces(r).alias("pieces")))
    found = found.select("row", "doc_id", "n_words", F.filter(hits, lambda h: F.size(h["pieces"]) > 1).alias("hits"))
    found = found.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
    found = found.select("row", "doc_id", "n_words", "hit.rule", "hit.label", "hit.priority", "hit.base", F.posexplode_outer("hit.pieces").alias("at", "size"))
    along = Window.partitionBy("row", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.repartition("row").withColumn("end_word", F.sum("size").over(along)).where("at is null or at % 2 = 1").withColumn("first_word", F.col("end_word") - F.col("size"))
    before = Window.partitionBy("row").orderBy("first_word", F.desc("end_word"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.array(*(F.max(F.when(F.col("priority") <= p, F.col("end_word"))).over(before) for p in sorted(CERTAINTY)))
    found = found.withColumn("reached", F.get(reached, F.col("priority")))
    kept = F.col("base") | F.coalesce(F.col("reached") < F.col("end_word"), F.lit(True))
    return found.select("row", "doc_id", "n_words", "label", "priority", "base", "first_word", "end_word", F.when(F.col("label").isNotNull(), kept).alias("kept"))


def scan(docs: DataFrame, given: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs``."""
    certain = F.coalesce(*(F.when(F.col("priority") == p, F.lit(c)) for p, c in CERTAINTY.items()))
    base = F.col("base")

    def labels(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = detections(docs, given).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), certain)), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")


def oracle() -> str:
    """The same result in DuckDB's SQL; matches are resolved there by comparing all pairs of a text."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n".join(f"({k}, {quote(r.label)}, {r.priority}, {quote(r.keyword)}, {quote(compiled(r))}, {r.base})" for k, r in enumerate(rules()))
    certain = " ".join(f"WHEN {p} THEN {c}" for p, c in CERTAINTY.items())
    return rf"""
    WITH r(rule, label, priority, keyword, expression, base) AS (VALUES {values}),
    w AS (
        SELECT row_number() OVER () AS id, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM documents),
    p AS (
        SELECT id, rule, label, priority, base, string_split(regexp_replace(' ' || array_to_string(ws, '  ') || ' ', expression, chr(1) || '\0' || chr(1), 'g'), chr(1)) AS ps
        FROM w, r WHERE list_contains(ws, keyword)),
    s AS (SELECT id, rule, label, priority, base, unnest(range(1, len(ps) + 1)) AS i, unnest(list_transform(ps, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) AS size FROM p WHERE len(ps) > 1),
    m AS (
        SELECT id, rule, label, priority, base, stop - size AS start, stop
        FROM (SELECT *, sum(size) OVER (PARTITION BY id, rule ORDER BY i) AS stop FROM s) WHERE i % 2 = 0),
    k AS (
        SELECT *, base OR NOT EXISTS (
            FROM m e WHERE e.id = m.id AND e.priority <= m.priority AND e.start <= m.start AND e.stop >= m.stop
                AND (e.start < m.start OR e.stop > m.stop OR e.priority < m.priority OR e.rule < m.rule)) AS kept
        FROM m)
    SELECT w.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
        CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept), '') AS labels,
        coalesce(max(CASE priority {certain} END) FILTER (kept), 0.0)::DOUBLE AS score
    FROM w LEFT JOIN k USING (id) GROUP BY id, w.doc_id
    """
