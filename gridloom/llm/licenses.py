"""License scan: ordered signature rules with a keyword prefilter, priorities and interval containment.

The text is reduced to words, A-Z lower-cased, joined by one blank. A rule is a regex over that word string;
it runs only if its keyword, which every match of it contains, occurs in it. Rules are ordered by priority. A hit that lies inside an
accepted hit (longer, or as long and of a higher priority) is suppressed (so `lgpl` inside `gnu lgpl 2 1` goes);
base phrases are never suppressed.

Cases: a null text is empty; texts without words give n_words 0, no label and score 0; a phrase that occurs
again counts again; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from . import common

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}

BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


V = r"(?: (?:version|v))? ?"
"""What may stand before a version number."""

# Each line: label, keyword, and regexes of its titles, grants and notices, strongest first. `_` stands for a blank.
# A regex whose matches need not contain the keyword has another one: see keyword_of().
SIGNATURES = r"""
agpl-3.0 | affero | gnu affero general public license{V}3 ; affero general public license{V}3 ; agpl{V}3(?: 0)? ; gnu agplv3
agpl-1.0 | affero | affero general public license{V}1 ; agpl{V}1(?: 0)?
agpl | affero | gnu affero general public license ; affero gpl ; licensed under the agpl
lgpl-2.0 | library | gnu library general public license(?:{V}2)? ; library gpl
lgpl-2.1 | lesser | gnu lesser general public license{V}2 1 ; lesser gpl{V}2 1 ; lesser general public license{V}2 1
lgpl-3.0 | lesser | gnu lesser general public license{V}3 ; lesser gpl{V}3 ; lesser general public license{V}3
lgpl | lesser | gnu lesser general public license ; lesser general public license ; lesser gpl
lgpl | lgpl | (?:gnu )?lgpl{V}\d(?: \d)? ; under the (?:gnu )?lgpl ; lgpl licensed
gpl-1.0 | gnu | gnu general public license{V}1 ; gnu gpl{V}1
gpl-2.0 | gnu | gnu general public license{V}2 ; gnu gpl{V}2 ; gnu gplv2
gpl-3.0 | gnu | gnu general public license{V}3 ; gnu gpl{V}3 ; gnu gplv3
gpl-2.0 | gplv2 | gplv2(?: or later| only)? ; gplv2 licensed
gpl-3.0 | gplv3 | gplv3(?: or later| only)? ; gplv3 licensed
gpl | gnu | gnu gpl ; terms of the gnu general public licen[cs]e ; licensed under the gnu general public license
gpl | gpl | released under the gpl ; licensed under the gpl ; distributed under the gpl
gfdl | documentation | gnu free documentation license{V}1 [123] ; gnu free documentation license ; free documentation license
apache-1.0 | apache | apache (?:software )?license{V}1 0 ; apache group license
apache-1.1 | apache | apache (?:software )?license{V}1 1
apache-2.0 | apache | licensed under the apache license{V}2(?: 0)? ; apache (?:software )?license{V}2(?: 0)? ; www apache org licenses license 2 0
apache | apache | apache software license ; apache licensed ; asl 2 0
mit | mit | released under the mit license ; licensed under the mit license ; mit licensed ; the mit license mit ; mit x11 license
mit | expat | expat license ; expat licensed
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | mit | mit no attribution(?: license)? ; mit 0 license
bsd-2-clause | clause | (?:bsd )?2 clause (?:bsd )?license ; two clause bsd ; simplified bsd license ; bsd 2 clause
bsd-3-clause | clause | (?:bsd )?3 clause (?:bsd )?license ; three clause bsd ; bsd 3 clause ; new bsd license
bsd-4-clause | clause | (?:bsd )?4 clause (?:bsd )?license ; four clause bsd ; bsd 4 clause
bsd-3-clause | bsd | new bsd license ; modified bsd license ; revised bsd license ; bsd new
bsd-2-clause | bsd | freebsd license ; simplified bsd license ; freebsd copyright
bsd-4-clause | bsd | original bsd license ; old bsd license
bsd-0-clause | 0bsd | zero clause bsd(?: license)? ; 0bsd(?: license)? ; bsd zero clause
bsd | bsd | bsd style license ; bsd license ; bsd licensed ; berkeley software distribution license
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc | isc | isc license ; isc licensed ; internet systems consortium license
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 | mozilla | mozilla public license{V}1 0 ; mpl{V}1 0
mpl-1.1 | mozilla | mozilla public license{V}1 1 ; mpl{V}1 1
mpl-2.0 | mozilla | mozilla public license{V}2(?: 0)? ; terms of the mozilla public license{V}2 0
mpl | mozilla | mozilla public license ; mozilla org mpl
mpl-2.0 | mpl | mpl{V}2(?: 0)? ; mplv2 ; licensed under the mpl
epl-1.0 | eclipse | eclipse public license{V}1(?: 0)? ; www eclipse org legal epl v10
epl-2.0 | eclipse | eclipse public license{V}2(?: 0)? ; www eclipse org legal epl 2 0
epl | eclipse | eclipse public license ; eclipse distribution license
cddl-1.0 | cddl | cddl{V}1(?: 0)? ; cddl
cddl-1.0 | distribution | common development and distribution license(?:{V}1 0)?
cddl-1.1 | distribution | common development and distribution license{V}1 1
cpl-1.0 | common | common public license{V}1(?: 0)? ; common public license
ipl-1.0 | ibm | ibm public license(?:{V}1 0)?
artistic-1.0 | artistic | artistic license{V}1(?: 0)?
artistic-2.0 | artistic | artistic license{V}2(?: 0)? ; the artistic license 2 0
artistic | artistic | artistic license ; perl artistic license ; clarified artistic license
bsl-1.0 | boost | boost software license{V}1 0 ; boost software license ; www boost org license 1 0 txt
zlib | zlib | zlib libpng license ; zlib license ; zlib licensed
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented
libpng | libpng | libpng license(?:{V}2)? ; png reference library license
unlicense | unlicense | the unlicense ; unlicense org ; released under the unlicense
unlicense | unencumbered | free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl(?:{V}2)? ; do what the fuck you want to public license
wtfpl | fuck | do what the fuck you want to public license
cc0-1.0 | cc0 | cc0 1 0(?: universal)? ; cc0 public domain dedication ; cc0
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 ; creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0 ; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 [05]
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-4.0 | cc | licensed under cc by nc 4 0 ; cc by nc 4 0
cc-by-nc-3.0 | cc | licensed under cc by nc 3 0 ; cc by nc 3 0
cc-by-nc-2.0 | cc | cc by nc 2 [05]
cc-by-nc | cc | cc by nc
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd | cc | cc by nd
cc-by-sa-4.0 | cc | licensed under cc by sa 4 0 ; cc by sa 4 0
cc-by-sa-3.0 | cc | licensed under cc by sa 3 0 ; cc by sa 3 0
cc-by-sa-2.0 | cc | cc by sa 2 [05]
cc-by-sa | cc | cc by sa
cc-by-4.0 | cc | licensed under cc by 4 0 ; cc by 4 0
cc-by-3.0 | cc | licensed under cc by 3 0 ; cc by 3 0
cc-by-2.0 | cc | cc by 2 [05]
cc-by-sa-4.0 | creative | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | creative | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa | creative | creative commons attribution share ?alike
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?
cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc | creative | creative commons attribution non ?commercial
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s
cc-by-4.0 | creative | creative commons attribution 4 0(?: international)?
cc-by-3.0 | creative | creative commons attribution 3 0(?: unported)?
cc-by | creative | creative commons attribution(?: license)?
cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
odbl-1.0 | database | open database license(?:{V}1 0)? ; odbl{V}1 0
odc-by-1.0 | data | open data commons attribution license(?:{V}1 0)?
pddl-1.0 | data | open data commons public domain dedication(?: and license)?
odbl-1.0 | odbl | odbl(?:{V}1 0)? ; licensed under the odbl
cdla-permissive | community | community data license agreement permissive(?:{V}[12] 0)?
cdla-sharing | community | community data license agreement sharing(?:{V}1 0)?
ofl-1.1 | sil | sil open font license(?:{V}1 1)? ; scripts sil org ofl
ofl-1.1 | font | open font license ; licensed under the ofl
psf-2.0 | python | python software foundation license(?:{V}2)? ; psf license agreement ; python license
php-3.01 | php | php license{V}3 0[01] ; the php license ; php license
ruby | ruby | ruby license ; same terms as ruby ; ruby s license
ncsa | illinois | university of illinois ncsa open source license ; illinois open source license
ncsa | ncsa | ncsa open source license ; ncsa license
llvm-exception | llvm | apache license v2 0 with llvm exceptions ; llvm exceptions?
openssl | openssl | openssl license ; dual openssl and ssleay license ; openssl toolkit license
ssleay | ssleay | original ssleay license ; ssleay license
curl | curl | curl license ; curl and libcurl are licensed
x11 | x11 | x11 license ; x11 licensed ; mit x consortium license
postgresql | postgresql | postgresql licen[cs]e ; postgresql global development group license
sqlite-blessing | blessing | may you do good and not evil ; the author disclaims copyright to this source code
json | evil | the software shall be used for good not evil
beerware | beer | beer ware license(?: revision 42)? ; buy me a beer in return
afl-3.0 | academic | academic free license(?:{V}3 0)? ; academic free license{V}2 1
osl-3.0 | open | open software license(?:{V}3 0)? ; osl{V}3 0
ecl-2.0 | educational | educational community license(?:{V}2 0)?
eupl-1.1 | european | european union public licen[cs]e{V}1 1
eupl-1.2 | european | european union public licen[cs]e(?:{V}1 2)?
eupl | eupl | eupl(?:{V}1 [12])? ; licensed under the eupl
cecill-2.1 | cecill | cecill(?:{V}2 [01])? ; cecill free software license agreement
cecill-b | cecill | cecill b(?: license)? ; cecill b free software license
cecill-c | cecill | cecill c(?: license)? ; cecill c free software license
ms-pl | microsoft | microsoft public license ; ms pl
ms-rl | microsoft | microsoft reciprocal license ; ms rl
apsl-2.0 | apple | apple public source license(?:{V}2 0)?
npl-1.1 | netscape | netscape public license(?:{V}1 [01])?
spl-1.0 | sun | sun public license(?:{V}1 0)? ; sun industry standards source license
qpl-1.0 | qpl | q public license(?:{V}1 0)? ; qpl{V}1 0
qpl-1.0 | public | the q public license
vim | vim | vim license ; vim charityware
tcl | tcl | tcl tk license ; tcl license
ijg | jpeg | independent jpeg group license ; independent jpeg group s software
freetype | freetype | freetype project license ; freetype license ; ftl license
imagemagick | imagemagick | imagemagick license ; imagemagick studio license
info-zip | zip | info zip license ; info zip copyright
icu | icu | icu license ; unicode icu license
unicode-dfs | unicode | unicode license agreement data files and software ; unicode inc license agreement ; unicode license v3
w3c | w3c | w3c software notice and license ; w3c document license ; w3c license
zpl-2.1 | zope | zope public license(?:{V}2 [01])? ; zpl{V}2 1
upl-1.0 | universal | universal permissive license(?:{V}1 0)?
sspl-1.0 | server | server side public license(?:{V}1)? ; sspl{V}1
busl-1.1 | business | business source license(?:{V}1 1)? ; busl 1 1
elastic-2.0 | elastic | elastic license{V}2(?: 0)? ; elastic license
commons-clause | commons | commons clause license condition(?:{V}1 0)? ; commons clause
polyform-noncommercial | polyform | polyform non ?commercial license(?: 1 0 0)?
polyform-small-business | polyform | polyform small business license(?: 1 0 0)?
polyform-shield | polyform | polyform shield license(?: 1 0 0)?
blueoak-1.0.0 | oak | blue oak model license(?: 1 0 0)?
mulan-2.0 | mulan | mulan psl{V}2 ; mulan permissive software license{V}2
hippocratic-2.1 | hippocratic | hippocratic license(?:{V}[23] [01])?
parity-7.0.0 | parity | parity public license(?: 7 0 0)? ; parity license
openrail-m | openrail | creativeml open rail m ; bigscience openrail m ; openrail m license
llama-2 | llama | llama 2 community license(?: agreement)? ; llama 3 community license(?: agreement)?
oldap-2.8 | openldap | openldap public license(?:{V}2 8)?
cpal-1.0 | cpal | common public attribution license(?:{V}1 0)? ; cpal{V}1 0
rpl-1.5 | reciprocal | reciprocal public license(?:{V}1 5)?
sleepycat | sleepycat | sleepycat license ; sleepycat software product license
lppl-1.3c | latex | latex project public license(?:{V}1 3c?)?
lppl-1.3c | lppl | lppl(?:{V}1 3c?)?
nasa-1.3 | nasa | nasa open source agreement(?:{V}1 3)?
intel-acpi | intel | intel acpi software license agreement ; intel open source license
nvidia | nvidia | nvidia source code license ; nvidia software license agreement
public-domain | domain | released into the public domain ; dedicated to the public domain ; this file is in the public domain ; placed in the public domain
proprietary | rights | all rights reserved ; no part of this (?:work|publication) may be reproduced
proprietary | proprietary | proprietary and confidential ; proprietary license ; licensed software of
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
ogl-uk-3.0 | government | open government licen[cs]e(?:{V}[123] 0)? ; uk open government licen[cs]e
etalab-2.0 | etalab | etalab open licen[cs]e(?: 2 0)? ; licence ouverte etalab
"""

GRANT = r"(?:(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?)?"


VARIES = re.compile(r"\{V\}|\(\?:[^()]*\)\??|\[[^]]*\]\??|\\d|.\?")


def literals(pattern: str) -> list[str]:
    """What every match of a signature contains: its runs of characters that are neither optional nor one of several."""
    while (less := VARIES.sub("\0", pattern)) != pattern:
        pattern = less
    return [x for x in pattern.split("\0") if x.strip()]


def keyword_of(pattern: str, wanted: str) -> str:
    """`wanted` where every match contains it, else the literal with most letters."""
    found = literals(pattern)
    return wanted if any(wanted in x for x in found) else max(found, key=lambda x: sum(map(str.isalpha, x))).strip()


def rules() -> list[Rule]:
    """Base phrases first (priority 0), SPDX tags (1), then the signatures in their order of writing (2 ...)."""
    out = [Rule(label, 0, phrase.split()[-1] if phrase != "cc by" else "cc", phrase) for phrase, label in BASE]
    spdx: dict[str, None] = {}
    for n, line in enumerate(x for x in SIGNATURES.strip().splitlines()):
        label, keyword, patterns = (x.strip() for x in line.split("|", 2))
        spdx[label] = None
        for p in patterns.split(" ; "):
            out.append(Rule(label, 2 + n, keyword_of(p.strip(), keyword), GRANT + p.strip().replace("{V}", V)))
    for label in spdx:
        words = re.sub(r"[^0-9a-z]+", " ", label)
        out.append(Rule(label, 1, "spdx", rf"spdx license identifier {words}(?: or later| only)?"))
    return sorted(out, key=lambda r: r.priority)


def uncontained(hits: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Hits that lie in no accepted hit; longer ones first, then the higher priority.

    No accepted hit contains another, so in order of start their ends rise too, and one bisection finds the
    only one that could contain a hit.
    """
    starts: list[int] = []
    accepted: list[tuple[int, int, str, int]] = []
    for h in sorted(set(hits), key=lambda h: (h[0] - h[1], h[3], h[0], h[2])):
        i = bisect_right(starts, h[0])
        if not i or accepted[i - 1][1] < h[1]:
            starts.insert(i, h[0])
            accepted.insert(i, h)
    return accepted


def scanner():
    """A function from one text to (n_words, base hits, accepted hits); hits are (start word, end word, label)."""
    base = [(re.compile(rf"(?<![^ ]){re.escape(p)}(?![^ ])"), label, p) for p, label in BASE]
    by_keyword: dict[str, list[tuple[re.Pattern, Rule]]] = {}
    for r in rules():
        if r.priority:
            by_keyword.setdefault(r.keyword, []).append((re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])"), r))

    def find(text: str | None):
        words = WORD.findall((text or "").translate(LOWER))
        line = " ".join(words)
        spans = [
            (m.start(), m.end(), label, 0) for pattern, label, phrase in base if phrase in line for m in pattern.finditer(line)
        ]
        first = len(spans)
        present = [k for k in by_keyword if k in line]
        if present:
            spans += [(m.start(), m.end(), r.label, r.priority) for k in present for pattern, r in by_keyword[k] for m in pattern.finditer(line)]
        if not spans:
            return len(words), [], []
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hits = [(bisect_right(starts, a) - 1, bisect_right(starts, b - 1), label, p) for a, b, label, p in spans]
        return len(words), hits[:first], uncontained(hits[first:])

    return find


def detect(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_words, and `hits`: array of (start, end, label, base), words from 0, end exclusive."""
    from pyspark.sql import types as T

    hit = T.ArrayType(
        T.StructType(
            [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType())]
        )
    )

    def make():
        find = scanner()

        def run(texts):
            n, hits = [], []
            for t in texts:
                words, base, more = find(t)
                n.append(words)
                hits.append([dict(start=a, end=b, label=x, base=not p) for a, b, x, p in sorted({*base, *more})])
            return [n, hits]

        return run

    return common.scan(df, keep, [text], [common.long("n_words"), T.StructField("hits", hit)], make)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform("base", lambda h: h["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"]))), ",")
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return (
        detect(common.table(spark, sf_dir, "documents"))
        .withColumn("base", base)
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels("base").alias("base_labels"),
            labels("hits").alias("labels"),
            # a longer notice in a shorter text is the likelier license of the whole text
            F.when(F.size("hits") == 0, F.lit(0.0))
            .otherwise(0.5 + 0.5 * F.least(F.lit(1.0), covered / F.greatest(F.col("n_words"), F.lit(1))))
            .alias("score"),
        )
    )
