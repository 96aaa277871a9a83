"""License scans by ordered signature rules. DataFrame functions only.

Texts become words (ASCII letters in lower case, digits, all characters beyond ASCII). A rule is a
pattern over words with a label, a keyword, a priority and a weight. A document is looked at only if
it has one of the gate's stems, a rule only if the document has one of the rule's keywords. All places where
a rule's words stand give detections (first word, last word). A detection that lies inside another
one of the same or a higher priority is suppressed: sorted by start, longest and highest first, one
pass with the furthest end of each priority decides all.

Everything happens inside a document's row, so nothing is shuffled, and cost is in proportion to
words times the rules whose keyword is there.

Defined results
    * null text counts as empty: no words, no labels, null positions, score 0;
    * detections of one rule don't overlap (leftmost first, then on);
    * labels are distinct and sorted; no label gives the empty string;
    * repeated rows give repeated results; extra columns are kept by :func:`scan`, its own replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

#: Phrases of the base count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: A license by label: keyword, words of its name (a pattern), words of its SPDX identifier if it has one.
FAMILIES = {
    "apache-2": ("apache", r"apache (software )?licen[cs]e( version| v)? ?2( 0)?|apache 2( 0)? licen[cs]e", "apache 2 0"),
    "apache-1.1": ("apache", r"apache (software )?licen[cs]e( version)? 1 1", "apache 1 1"),
    "apache-1": ("apache", r"apache (software )?licen[cs]e( version)? 1 0", "apache 1 0"),
    "mit": ("mit", r"(mit|expat|x11) licen[cs]e|mit style licen[cs]e", "mit"),
    "mit-0": ("mit", r"mit no attribution( licen[cs]e)?", "mit 0"),
    "bsd-2-clause": ("bsd", r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( simplified)?( licen[cs]e)?", "bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)( new| revised)?( licen[cs]e)?", "bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(bsd 4 clause|4 clause bsd|original bsd|old bsd)( licen[cs]e)?", "bsd 4 clause"),
    "bsd": ("bsd", r"bsd( style)? licen[cs]e", None),
    "0bsd": ("bsd", r"(zero clause bsd|bsd zero clause|0bsd)( licen[cs]e)?", "0bsd"),
    "gpl-1": ("general", r"gnu general public licen[cs]e( version| v)? ?1", "gpl 1 0"),
    "gpl-2": ("general", r"gnu general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? ?2", "gpl 2 0"),
    "gpl-3": ("general", r"gnu general public licen[cs]e( as published by the free software foundation)?( either)?( version| v)? ?3", "gpl 3 0"),
    "gpl": ("general", r"gnu general public licen[cs]e|gnu gpl", "gpl"),
    "lgpl-2": ("library", r"gnu library general public licen[cs]e( version| v)? ?2", "lgpl 2 0"),
    "lgpl-2.1": ("lesser", r"gnu lesser general public licen[cs]e( version| v)? ?2 1", "lgpl 2 1"),
    "lgpl-3": ("lesser", r"gnu lesser general public licen[cs]e( version| v)? ?3", "lgpl 3 0"),
    "lgpl": ("lesser", r"gnu lesser general public licen[cs]e|gnu lgpl", "lgpl"),
    "agpl-3": ("affero", r"gnu affero general public licen[cs]e( version| v)? ?3", "agpl 3 0"),
    "agpl": ("affero", r"(gnu )?affero general public licen[cs]e", "agpl"),
    "gfdl": ("documentation", r"gnu free documentation licen[cs]e( version)?( 1 [123])?", "gfdl 1 3"),
    "mpl-1.1": ("mozilla", r"mozilla public licen[cs]e( version| v)? ?1 1", "mpl 1 1"),
    "mpl-2": ("mozilla", r"mozilla public licen[cs]e( version| v)? ?2( 0)?", "mpl 2 0"),
    "mpl": ("mozilla", r"mozilla public licen[cs]e", "mpl"),
    "epl-1": ("eclipse", r"eclipse public licen[cs]e( version| v)? ?1( 0)?", "epl 1 0"),
    "epl-2": ("eclipse", r"eclipse public licen[cs]e( version| v)? ?2( 0)?", "epl 2 0"),
    "edl-1": ("eclipse", r"eclipse distribution licen[cs]e( version)?( 1 0)?", "edl 1 0"),
    "cddl": ("cddl", r"common development and distribution licen[cs]e|cddl( version)? 1 [01]", "cddl 1 0"),
    "cpl": ("common", r"common public licen[cs]e( version)?( 1 0)?", "cpl 1 0"),
    "eupl": ("european", r"european union public licen[cs]e( version| v)?( 1 [12])?", "eupl 1 2"),
    "cc0": ("cc0", r"cc0( 1 0)?( universal)?|creative commons zero", "cc0 1 0"),
    "cc-by": ("commons", r"creative commons attribution( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by 4 0"),
    "cc-by-sa": ("commons", r"creative commons attribution share ?alike( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by sa 4 0"),
    "cc-by-nd": ("commons", r"creative commons attribution no ?derivatives( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by nd 4 0"),
    "cc-by-nc": ("commons", r"creative commons attribution non ?commercial( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by nc 4 0"),
    "cc-by-nc-sa": ("commons", r"creative commons attribution non ?commercial share ?alike( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by nc sa 4 0"),
    "cc-by-nc-nd": ("commons", r"creative commons attribution non ?commercial no ?derivatives( [1234] 0)?( international| unported)?( licen[cs]e)?", "cc by nc nd 4 0"),
    "isc": ("isc", r"isc licen[cs]e", "isc"),
    "zlib": ("zlib", r"zlib( libpng)? licen[cs]e", "zlib"),
    "libpng": ("libpng", r"(lib)?png( reference library)? licen[cs]e( version 2)?", "libpng 2 0"),
    "boost-1": ("boost", r"boost software licen[cs]e( version)?( 1 0)?", "bsl 1 0"),
    "unlicense": ("unlicense", r"(the )?unlicense", "unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl( version 2)?", "wtfpl"),
    "artistic-1": ("artistic", r"artistic licen[cs]e( version)?( 1 0)?", "artistic 1 0"),
    "artistic-2": ("artistic", r"artistic licen[cs]e( version)? 2( 0)?", "artistic 2 0"),
    "ofl-1.1": ("font", r"(sil )?open font licen[cs]e( version)?( 1 1)?", "ofl 1 1"),
    "psf": ("python", r"python software foundation licen[cs]e( version 2)?|psf licen[cs]e", "psf 2 0"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e", "ms pl"),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[cs]e", "ms rl"),
    "odbl": ("database", r"open (data commons open )?database licen[cs]e( v1 0)?", "odbl 1 0"),
    "odc-by": ("commons", r"open data commons attribution licen[cs]e", "odc by 1 0"),
    "pddl": ("dedication", r"public domain dedication and licen[cs]e", "pddl 1 0"),
    "sspl": ("server", r"server side public licen[cs]e( version 1)?", "sspl 1 0"),
    "elastic-2": ("elastic", r"elastic licen[cs]e( version)?( 2 0)?", "elastic 2 0"),
    "busl-1.1": ("business", r"business source licen[cs]e( version)?( 1 1)?", "busl 1 1"),
    "ncsa": ("ncsa", r"(university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    "openssl": ("openssl", r"openssl licen[cs]e", "openssl"),
    "vim": ("vim", r"vim licen[cs]e", "vim"),
    "ruby": ("ruby", r"ruby licen[cs]e", "ruby"),
    "php-3": ("php", r"php licen[cs]e( version)?( 3 01?)?", "php 3 01"),
    "w3c": ("w3c", r"w3c software( notice)?( and)? licen[cs]e", "w3c"),
    "upl-1": ("universal", r"universal permissive licen[cs]e( version)?( 1 0)?", "upl 1 0"),
    "blueoak-1": ("blue", r"blue oak model licen[cs]e( version)?( 1 0 0)?", "blueoak 1 0 0"),
    "mulan-2": ("mulan", r"mulan permissive software licen[cs]e( version)? 2", "mulanpsl 2 0"),
}

#: Further keywords of families whose name has alternatives without the first one: a document needs one of them.
FURTHER = {
    "mit": ("expat", "x11"), "gpl": ("gnu gpl",), "lgpl": ("gnu lgpl",), "cddl": ("common development",), "cc0": ("commons zero",), "libpng": ("png",), "psf": ("psf",),
}

#: Ways in which a license's name is used: pattern around the name, priority, weight.
USES = {
    "name": ("({name})", 1, 0.6),
    "notice": ("(licen[cs]ed|released|distributed|available|published|provided|redistributed) under( the)?( terms( and conditions)? of)?( the)? ({name})", 3, 0.9),
    "grant": ("(subject to|governed by|covered by|under)( the)?( terms( and conditions)? of)?( the)? ({name})", 2, 0.8),
}

#: Rules of one form each: label, keyword, pattern, priority, weight.
SINGLE = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 3, 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 3, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 3, 0.9),
    ("bsd-3-clause", "endorse", "neither the name of( the)? .{1,80} nor the names of its contributors may be used to endorse or promote products", 3, 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 3, 0.9),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty", 2, 0.7),
    ("boost-1", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 3, 0.95),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 3, 0.95),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 3, 0.95),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 3, 0.95),
    ("gpl", "gpl", "(licen[cs]ed|released|distributed) under( the)? gpl( v?[123])?", 3, 0.85),
    ("lgpl", "lgpl", "(licen[cs]ed|released|distributed) under( the)? lgpl( v?[23])?", 3, 0.85),
    ("agpl", "agpl", "(licen[cs]ed|released|distributed) under( the)? agpl( v?3)?", 3, 0.85),
    ("gpl-2", "gpl", "gpl ?v ?2( 0)?", 1, 0.6),
    ("gpl-3", "gpl", "gpl ?v ?3( 0)?", 1, 0.6),
    ("mpl-2", "source", "this source code form is subject to the terms of the mozilla public licen[cs]e", 3, 0.95),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 3, 0.95),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", 3, 0.95),
    ("public-domain", "domain", "(released|placed|dedicated|put)( in| into| to) the public domain", 2, 0.8),
    ("public-domain", "domain", "(this work|this file|it) is in the public domain", 2, 0.8),
    ("all-rights-reserved", "reserved", "all rights reserved", 1, 0.4),
    ("all-rights-reserved", "copyright", "copyright (c )?(19|20)[0-9]{2}( [a-z]{1,30}){1,6} all rights reserved", 2, 0.5),
    ("proprietary", "proprietary", "(proprietary and confidential|confidential and proprietary)", 2, 0.7),
    ("proprietary", "permission", "(may not|no part of this publication may) be reproduced .{0,80} without( the)?( prior)?( written)? permission", 2, 0.6),
    ("cc-by", "cc", "cc by( [1234] 0)?", 1, 0.6),
    ("cc-by-sa", "cc", "cc by sa( [1234] 0)?", 1, 0.6),
    ("cc-by-nd", "cc", "cc by nd( [1234] 0)?", 1, 0.6),
    ("cc-by-nc", "cc", "cc by nc( [1234] 0)?", 1, 0.6),
    ("cc-by-nc-sa", "cc", "cc by nc sa( [1234] 0)?", 1, 0.6),
    ("cc-by-nc-nd", "cc", "cc by nc nd( [1234] 0)?", 1, 0.6),
    ("cc-by", "creativecommons", "creativecommons org licen[cs]es by( [1234] 0)?", 2, 0.9),
    ("cc-by-sa", "creativecommons", "creativecommons org licen[cs]es by sa( [1234] 0)?", 2, 0.9),
    ("cc-by-nc", "creativecommons", "creativecommons org licen[cs]es by nc( [1234] 0)?", 2, 0.9),
    ("cc-by-nd", "creativecommons", "creativecommons org licen[cs]es by nd( [1234] 0)?", 2, 0.9),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licen[cs]es by nc sa( [1234] 0)?", 2, 0.9),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licen[cs]es by nc nd( [1234] 0)?", 2, 0.9),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero( 1 0)?", 2, 0.9),
    ("apache-2", "apache", "apache org licen[cs]es licen[cs]e 2 0", 2, 0.9),
    ("mit", "opensource", "opensource org licen[cs]es mit", 2, 0.9),
    ("gpl", "gnu", "gnu org licen[cs]es gpl", 2, 0.8),
    ("lgpl", "gnu", "gnu org licen[cs]es lgpl", 2, 0.8),
    ("mpl-2", "mozilla", "mozilla org mpl 2 0", 2, 0.9),
    # sentences of license texts, notices and headers
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3, 0.9),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable", 2, 0.7),
    ("x11-notice", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 3, 0.9),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 3, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.9),
    ("bsd-4-clause", "includes", "this product includes software developed by .{1,80}", 2, 0.7),
    ("apache-2", "compliance", "you may not use this file except in compliance with the licen[cs]e", 3, 0.85),
    ("apache-2", "limitations", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", 3, 0.85),
    ("apache-2", "contributor", "subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide non exclusive", 3, 0.95),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 3, 0.9),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty", 3, 0.85),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e along with this program", 3, 0.95),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public licen[cs]e along with this (library|program)", 3, 0.95),
    ("agpl", "received", "you should have received a copy of the gnu affero general public licen[cs]e along with this program", 3, 0.95),
    ("agpl-3", "interact", "all users interacting with it remotely through a computer network", 2, 0.85),
    ("gpl", "freedom", "the licen[cs]es for most software are designed to take away your freedom to share and change it", 3, 0.95),
    ("gpl-3", "copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", 3, 0.95),
    ("gpl", "linking", "linking this library statically or dynamically with other modules is making a combined work", 3, 0.85),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 3, 0.95),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public licen[cs]e( version)?( 1 1)?", 3, 0.95),
    ("mpl-2", "incompatible", "this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e", 3, 0.95),
    ("epl-1", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0", 4, 1.0),
    ("epl-2", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e( v| version)? ?2 0", 4, 1.0),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 3, 0.95),
    ("cpl", "accompanying", "the accompanying program is provided under the terms of this common public licen[cs]e", 3, 0.95),
    ("eupl", "joinup", "joinup ec europa eu (software|collection) .{0,40}eupl", 2, 0.85),
    ("cc0", "waived", "(has|have) waived all copyright and related or neighboring rights", 3, 0.95),
    ("cc0", "dedicated", "has dedicated the work to the public domain by waiving all of his or her rights", 3, 0.95),
    ("cc-by", "redistribute the material", "you are free to share copy and redistribute the material in any medium or format", 2, 0.7),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original", 3, 0.9),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes", 2, 0.85),
    ("cc-by-nd", "modified", "if you remix transform or build upon the material you may not distribute the modified material", 3, 0.9),
    ("isc", "systems consortium", "internet systems consortium", 1, 0.5),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 3, 0.95),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 3, 0.95),
    ("libpng", "group 42", "the contributing authors and group 42 inc disclaim all warranties", 2, 0.8),
    ("boost-1", "boost", "see accompanying file licen[cs]e 1 0 txt or copy at( http| https)? www boost org licen[cs]e 1 0 txt", 3, 0.95),
    ("artistic-2", "standard", "you may distribute verbatim forms of the source form of the standard version of this package", 3, 0.9),
    ("artistic-1", "artistic", "artistic control over the development of the package", 3, 0.85),
    ("ofl-1.1", "fonts", "the fonts and derivatives however cannot be released under any other type of licen[cs]e", 3, 0.95),
    ("ofl-1.1", "font", "this font software is licen[cs]ed under the sil open font licen[cs]e", 3, 0.95),
    ("psf", "python", "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", 3, 0.95),
    ("postgresql", "paragraphs", "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", 3, 0.9),
    ("ms-pl", "accept", "if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software", 3, 0.85),
    ("odbl", "database", "any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e", 3, 0.95),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a service", 3, 0.95),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service", 3, 0.95),
    ("busl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 3, 0.95),
    ("ncsa", "contributors", "neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 3, 0.8),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 3, 0.95),
    ("vim", "vim", "vim is charityware you can use and copy it as much as you like", 3, 0.95),
    ("php-3", "php", "this product includes php software freely available from", 3, 0.95),
    ("w3c", "w3c", "permission to copy modify and distribute this work .{0,120}w3c", 2, 0.8),
    ("unlicense", "unlicense", "for more information please refer to( http| https)?( www)? unlicense org", 3, 0.9),
    ("wtfpl", "sam hocevar", "copyright c 2004 sam hocevar", 2, 0.7),
    ("hpnd", "suitability", "makes no representations about the suitability of this software for any purpose", 2, 0.8),
    ("beerware", "beer", "you can buy me a beer in return", 3, 0.95),
    ("json-license", "evil", "the software shall be used for good not evil", 3, 0.95),
    ("llvm-exception", "llvm", "apache licen[cs]e v ?2 0 with llvm exceptions", 4, 1.0),
    ("classpath-exception", "classpath", "(gnu )?classpath exception", 2, 0.8),
    ("ogl-uk-3", "government", "open government licen[cs]e( v| version)?( 3 0)?", 2, 0.9),
    ("cdla-permissive-2", "community data", "community data licen[cs]e agreement permissive( version)?( 2 0)?", 2, 0.95),
    ("cdla-sharing-1", "community data", "community data licen[cs]e agreement sharing( version)?( 1 0)?", 2, 0.95),
    ("openrail", "rail", "(creativeml )?open ?rail( m| d| s| \\+\\+ m)?( licen[cs]e)", 2, 0.9),
    ("non-commercial", "non", "(for )?non ?commercial use only", 2, 0.7),
    ("no-redistribution", "redistribut", "(do not redistribute|not for redistribution|redistribution (is )?(strictly )?(prohibited|forbidden))", 2, 0.7),
    ("proprietary", "trade", "(contains|constitutes) (confidential )?(and )?(proprietary )?trade secrets", 2, 0.7),
    ("proprietary", "written consent", "without( the)?( prior| express)*( written)? written consent of", 1, 0.5),
    ("all-rights-reserved", "tous", "tous droits r\u00e9serv\u00e9s", 1, 0.4),
    ("all-rights-reserved", "rechte", "alle rechte vorbehalten", 1, 0.4),
    ("all-rights-reserved", "derechos", "todos los derechos reservados", 1, 0.4),
]

#: One of these stems stands in every rule's words.
GATE = (
    r"(?i)licen|copyright|permi|redistribut|domain|reserved|proprietary|\bcc|creativecommons|commons|gpl|cddl|wtfpl|mozilla|gnu|endorse|advertising|warranty|bsd|mit no|zero"
    r"|includes software|php software|merchantability|network|linking this|invariant|eupl|related or neighboring|redistribute the material|modified material|commercial|systems consortium|misrepresented"
    r"|disclaim|verbatim|artistic|paragraphs|third parties|charityware|representations|beer|good not evil|exception|trade secret|consent|r\xe9serv|vorbehalten|derechos"
)

WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PRIORITIES = (1, 2, 3, 4)


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules (label, keyword, pattern over single-spaced words, priority, weight), in order."""
    found = []
    for label, (keyword, name, spdx) in FAMILIES.items():
        found += [(label, keyword, form.format(name=name), priority, weight) for form, priority, weight in USES.values()]
        if spdx:
            found.append((label, "spdx", f"spdx licen[cs]e identifier {spdx}( only| or later)?", 4, 1.0))
    return found + SINGLE


def keywords_of(label: str, keyword: str) -> tuple[str, ...]:
    """Keywords of a rule of :func:`rules`, of which one stands wherever its pattern does."""
    return (keyword, *FURTHER.get(label, ())) if label in FAMILIES and keyword == FAMILIES[label][0] else (keyword,)


def _pattern(words: str) -> str:
    """A rule over `` words `` with blanks around; group 1 is the whole place."""
    return f"(?<= )((?:{words}))(?= )"


def normal_words(text: Column) -> Column:
    """Words joined by single blanks, letters as they are."""
    return F.trim(F.regexp_replace(text, WORD_GAP, " "))


def _places(line: Column, pattern) -> Column:
    """First and last word (from 0) of each match of a pattern in a line `` w0 w1 ... ``: signs that no word
    holds mark the ends, and the marked line is cut into words again."""
    marked = F.split(F.regexp_replace(line, pattern, F.lit("\x01$1\x02")), " ")
    # the line starts with a blank, so word number i is element i + 1
    at = lambda test: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at(lambda w: w.startswith("\x01")).alias("first"), at(lambda w: w.endswith("\x02")).alias("last"))


def _array(rows: list[tuple], names: str) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names.split(), strict=True))) for r in rows))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (array of first, last, priority, weight, label: all of them, before suppression). Further columns are kept whatever
    their names; those named like a result are replaced."""
    return common.aside(docs, (text,), lambda d: _scanned(d, text))


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    table = [(label, list(keywords_of(label, keyword)), _pattern(words), priority, weight) for label, keyword, words, priority, weight in rules()]
    rule_array = _array(table, "label keywords pattern priority weight")
    keywords = F.array(*(F.lit(k) for k in sorted({k for r in table for k in r[1]})))
    base_array = _array([(label, _pattern(words), words) for words, label in BASE.items()], "label pattern words")
    no_places = F.lit(None).cast("array<struct<first:int,last:int>>")

    kept = docs.columns
    words = docs.select(*kept, normal_words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__words"))
    counted = words.withColumn("n_words", F.when(F.col("__words") == "", 0).otherwise(F.length("__words") - F.length(F.replace("__words", F.lit(" "), F.lit(""))) + 1).cast("long"))
    small = F.translate("__words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    gated = counted.withColumn("__line", F.when(F.col("__words").rlike(GATE), F.concat(F.lit(" "), small, F.lit(" ")))).drop("__words")
    line = F.col("__line")

    place_type = "array<struct<first:int,last:int,priority:int,weight:double,label:string>>"
    held = F.filter(keywords, lambda k: line.contains(k))
    present = F.filter(rule_array, lambda r: F.arrays_overlap(F.col("__held"), r["keywords"]) & F.rlike(line, r["pattern"]))
    spread = F.flatten(F.transform("__present", lambda r: F.transform(_places(line, r["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["priority"].alias("priority"), r["weight"].alias("weight"), r["label"].alias("label")))))
    base_present = F.filter(base_array, lambda r: line.contains(F.concat(F.lit(" "), r["words"], F.lit(" "))))
    found = (
        gated.withColumn("__held", F.when(line.isNotNull(), held))
        .withColumn("__present", F.when(F.size("__held") > 0, present))
        .withColumn("__base", F.when(line.isNotNull(), base_present))
        .withColumn("detections", F.coalesce(F.when(F.size("__present") > 0, spread), F.array().cast(place_type)))
        .withColumn("__base_at", F.when(F.size("__base") > 0, F.flatten(F.transform("__base", lambda r: _places(line, r["pattern"])))).otherwise(no_places))
    )
    # longest and highest first among those that start together, so what holds a detection comes before it
    ordered = F.array_sort(
        F.transform("detections", lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), (-d["priority"]).alias("lower"), d["label"].alias("label"), d["weight"].alias("weight")))
    )
    ends = [f"end{p}" for p in _PRIORITIES]
    start = F.struct(*(F.lit(-1).alias(e) for e in ends), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(state: Column, d: Column) -> Column:
        last, priority = -d["back"], -d["lower"]
        inside = F.lit(False)
        for p, e in zip(_PRIORITIES, ends, strict=True):
            inside = inside | ((priority <= p) & (state[e] >= last))
        return F.struct(
            *(F.when(priority == p, F.greatest(state[e], last)).otherwise(state[e]).alias(e) for p, e in zip(_PRIORITIES, ends, strict=True)),
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], d["weight"])).alias("score"),
        )

    base_labels = F.coalesce(F.array_distinct(F.transform("__base", lambda r: r["label"])), F.array().cast("array<string>"))
    swept = found.withColumn("__swept", F.when(F.size("detections") > 0, F.aggregate(ordered, start, step)))
    places = F.transform("__base_at", lambda p: p["first"])
    return swept.select(
        *kept, "n_words", F.coalesce(F.size("__base_at"), F.lit(0)).cast("long").alias("__n"), places.alias("__at"), base_labels.alias("__base_labels"), "__swept", "detections",
    ).select(
        *kept, "n_words", F.greatest("__n", F.lit(0)).cast("long").alias("n_base"), F.array_min("__at").cast("long").alias("first_word"), F.array_max("__at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("__base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base_labels", F.coalesce("__swept.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("__swept.score", F.lit(0.0)), F.when(F.size("__base_labels") > 0, 0.6).otherwise(0.0)).alias("score"), "detections",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """The whole scan as DuckDB SQL. Words stand apart by two blanks there, so that a pattern takes its own ones and needs
    no look-ahead; a piece of the line then has half as many words as blanks."""

    def doubled(words: str) -> str:
        return " " + words.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "

    keys = lambda label, keyword: "[" + ", ".join("'" + k.replace(" ", "  ") + "'" for k in keywords_of(label, keyword)) + "]"
    table = ", ".join(f"('{label}', {keys(label, keyword)}, '{doubled(f'(?:{words})')}', {priority}, {weight})" for label, keyword, words, priority, weight in rules())
    base = ", ".join(f"('{label}', '{doubled(words)}')" for words, label in BASE.items())
    count = "(len(x) - len(replace(x, ' ', ''))) // 2"
    first = f"list_sum(list_transform(gaps[1:i + 1], lambda x: {count})) + coalesce(list_sum(list_transform(hits[1:i], lambda x: {count})), 0)"
    return f"""
WITH words AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{WORD_GAP}', ' ', 'g')) AS raw FROM documents),
lined AS (SELECT doc_id, CASE WHEN raw = '' THEN 0 ELSE len(raw) - len(replace(raw, ' ', '')) + 1 END AS n_words,
    CASE WHEN regexp_matches(raw, '{GATE}') THEN ' ' || replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '  ') || ' ' END AS line FROM words),
rules(label, keywords, pattern, priority, weight) AS (VALUES {table}),
base_rules(label, pattern) AS (VALUES {base}),
base_hits AS (SELECT doc_id, label, regexp_extract_all(line, pattern) AS hits, string_split_regex(line, pattern) AS gaps FROM lined, base_rules WHERE line IS NOT NULL AND regexp_matches(line, pattern)),
base_at AS (SELECT doc_id, label, {first} AS first FROM (SELECT *, unnest(range(len(hits))) AS i FROM base_hits)),
bases AS (SELECT doc_id, count(*) AS n, min(first) AS first_word, max(first) AS last_word, list(DISTINCT label) AS own FROM base_at GROUP BY doc_id),
hits AS (SELECT doc_id, label, priority, weight, regexp_extract_all(line, pattern) AS hits, string_split_regex(line, pattern) AS gaps FROM lined, rules
    WHERE line IS NOT NULL AND len(list_filter(keywords, lambda k: contains(line, k))) > 0 AND regexp_matches(line, pattern)),
found AS (SELECT DISTINCT doc_id, label, priority, weight, {first} AS f, {first} + {count.replace("x", "hits[i + 1]")} - 1 AS l FROM (SELECT *, unnest(range(len(hits))) AS i FROM hits)),
kept AS (SELECT * FROM found d WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.doc_id = d.doc_id AND e.f <= d.f AND e.l >= d.l
    AND (e.priority > d.priority OR (e.priority = d.priority AND (e.f <> d.f OR e.l <> d.l OR e.label < d.label))))),
labelled AS (SELECT doc_id, list(DISTINCT label) AS own, max(weight) AS score FROM kept GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(b.own), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(k.own, [])))), ','), '') AS labels,
    greatest(coalesce(k.score, 0.0), CASE WHEN b.n > 0 THEN 0.6 ELSE 0.0 END)::DOUBLE AS score
FROM lined LEFT JOIN bases b USING (doc_id) LEFT JOIN labelled k USING (doc_id)
"""
