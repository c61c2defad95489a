"""Hand-written license rules, each as (label, priority, weight, keywords, pattern).

Patterns are matched on lower-cased text whose white space is folded; every match holds one of the keywords (split at "|").
Whole clauses of a license have the highest priorities, then grants, then names, then mere mentions.
"""

from __future__ import annotations

#: Hand-written rules, as (label, priority, weight, keywords, pattern).
WRITTEN = (
    ("mit", 80, 0.95, "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", 60, 0.8, "mit licen", r"\b(?:under|released under|licensed under) (?:the )?mit licen[sc]e"),
    ("mit", 40, 0.6, "mit licen", r"\bthe mit licen[sc]e\b|\bmit licen[sc]e\b"),
    ("mit-0", 70, 0.8, "mit no attribution", r"\bmit no attribution\b"),
    ("isc", 80, 0.95, "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose"),
    ("isc", 40, 0.6, "isc licen", r"\bisc licen[sc]e\b"),
    ("bsd", 70, 0.9, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("bsd-3-clause", 80, 0.9, "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote"),
    ("bsd-2-clause", 50, 0.7, "simplified bsd|2-clause bsd|bsd 2-clause", r"\b(?:simplified bsd|2-clause bsd|bsd 2-clause) licen[sc]e"),
    ("bsd-3-clause", 50, 0.7, "new bsd|modified bsd|3-clause bsd|bsd 3-clause", r"\b(?:new bsd|modified bsd|3-clause bsd|bsd 3-clause) licen[sc]e"),
    ("bsd-4-clause", 50, 0.7, "original bsd|4-clause bsd", r"\b(?:original|4-clause) bsd licen[sc]e"),
    ("bsd", 30, 0.5, "bsd licen", r"\bbsd licen[sc]e\b"),
    ("apache-2.0", 90, 0.97, "apache licen", r"licensed under the apache licen[sc]e,? version 2\.0"),
    ("apache-2.0", 70, 0.8, "apache", r"\bapache(?: software)? licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b|\bapache-2\.0\b"),
    ("apache-2.0", 60, 0.8, "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", 70, 0.8, "apache", r"\bapache(?: software)? licen[sc]e,? (?:version |v\.? ?)?1\.1\b"),
    ("apache", 30, 0.5, "apache", r"\bapache(?: software)? licen[sc]e\b"),
    ("mpl-2.0", 80, 0.95, "mozilla public", r"subject to the terms of the mozilla public licen[sc]e,? v\. ?2\.0"),
    ("mpl-2.0", 60, 0.8, "mpl-2.0|mozilla public", r"\bmpl-2\.0\b|\bmozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b"),
    ("mpl-1.1", 60, 0.8, "mpl-1.1|mozilla public", r"\bmpl-1\.1\b|\bmozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1\b"),
    ("mpl", 30, 0.5, "mozilla public", r"\bmozilla public licen[sc]e\b"),
    ("epl-1.0", 60, 0.8, "eclipse public", r"\beclipse public licen[sc]e,? (?:-|version |v\.? ?)? ?1\.0\b"),
    ("epl-2.0", 60, 0.8, "eclipse public", r"\beclipse public licen[sc]e,? (?:-|version |v\.? ?)? ?2\.0\b"),
    ("epl", 30, 0.5, "eclipse public", r"\beclipse public licen[sc]e\b"),
    ("cddl", 50, 0.7, "common development and distribution", r"\bcommon development and distribution licen[sc]e\b"),
    ("eupl", 50, 0.7, "european union public", r"\beuropean union public licen[sc]e\b"),
    ("artistic", 50, 0.7, "artistic licen", r"\bartistic licen[sc]e\b"),
    ("zlib", 80, 0.9, "without any express or implied warranty", r"provided 'as-is',? without any express or implied warranty"),
    ("zlib", 40, 0.6, "zlib licen", r"\bzlib licen[sc]e\b"),
    ("boost", 60, 0.8, "boost software", r"\bboost software licen[sc]e\b"),
    ("unlicense", 80, 0.95, "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("unlicense", 40, 0.6, "unlicense", r"\bunlicense\b"),
    ("wtfpl", 60, 0.8, "do what the f", r"\bdo what the f\S+ you want to public licen[sc]e\b"),
    ("public-domain", 40, 0.6, "public domain", r"\b(?:in|into|to) the public domain\b"),
    ("public-domain", 30, 0.4, "public domain", r"\bpublic domain\b"),
    ("ofl", 60, 0.8, "open font", r"\b(?:sil )?open font licen[sc]e\b"),
    ("odbl", 60, 0.8, "open database licen|odbl", r"\bopen database licen[sc]e\b|\bodbl\b"),
    ("odc-by", 60, 0.8, "open data commons", r"\bopen data commons attribution licen[sc]e\b"),
    ("pddl", 60, 0.8, "public domain dedication", r"\bpublic domain dedication and licen[sc]e\b"),
    ("gfdl", 60, 0.8, "free documentation", r"\bgnu free documentation licen[sc]e\b"),
    ("ogl", 50, 0.7, "open government", r"\bopen government licen[sc]e\b"),
    ("python", 50, 0.7, "python software foundation", r"\bpython software foundation licen[sc]e\b"),
    ("postgresql", 50, 0.7, "postgresql licen", r"\bpostgresql licen[sc]e\b"),
    ("bsl", 50, 0.7, "business source", r"\bbusiness source licen[sc]e\b"),
    ("sspl", 50, 0.7, "server side public", r"\bserver side public licen[sc]e\b"),
    ("elastic", 50, 0.7, "elastic licen", r"\belastic licen[sc]e\b"),
    ("openrail", 50, 0.7, "openrail|open rail", r"\b(?:big(?:code|science) )?open ?rail(?:-m)? licen[sc]e\b|\bopenrail\b"),
    ("proprietary", 60, 0.8, "proprietary and confidential", r"\bproprietary and confidential\b"),
    ("proprietary", 50, 0.7, "may not be", r"\bmay not be (?:reproduced|copied|redistributed)\b"),
    ("proprietary", 50, 0.7, "written permission|written consent", r"\bwithout (?:the )?(?:prior )?(?:express )?written (?:permission|consent)\b"),
    ("proprietary", 40, 0.6, "unauthori", r"\bunauthori[sz]ed (?:copying|reproduction|distribution|use)\b"),
    ("non-commercial", 40, 0.6, "noncommercial|non-commercial", r"\bfor non-?commercial (?:use|purposes) only\b"),
    ("no-derivatives", 40, 0.6, "derivative works", r"\bno derivative works\b"),
    ("reserved", 40, 0.6, "alle rechte vorbehalten", r"\balle rechte vorbehalten\b"),
    ("reserved", 40, 0.6, "tous droits", r"\btous droits r[ée]serv[ée]s\b"),
    ("reserved", 40, 0.6, "todos los derechos", r"\btodos los derechos reservados\b"),
    ("reserved", 40, 0.6, "rights reserved|rights are reserved", r"\ball rights (?:are )?reserved\b|\bsome rights reserved\b"),
    ("copyright", 20, 0.3, "copyright|(c)|©", r"(?:\bcopyright\b|\(c\)|©) *(?:\(c\)|©)? *(?:19|20)\d\d"),
    ("copyright", 10, 0.2, "copyright", r"\bcopyright\b"),
    ("license-notice", 10, 0.2, "licensed under", r"\blicensed under\b"),
    ("license-notice", 10, 0.2, "terms of the", r"\bunder the terms of the\b[^.\n]{0,60}\blicen[sc]e\b"),
    ("warranty-disclaimer", 15, 0.3, "warrant", r"\bwithout warrant(?:y|ies) of any kind\b|\bas is\b[^.\n]{0,20}\bwarrant"),
    # whole clauses
    ("mit", 75, 0.9, "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-style", 55, 0.7, "the software is provided", r"the software is provided [\"'“]?as is[\"'”]?,? without warranty of any kind"),
    ("bsd", 75, 0.9, "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 75, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", 80, 0.9, "all advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("bsd", 55, 0.7, "provided by the copyright holders", r"this software is provided by the copyright holders and contributors"),
    ("bsd-2-clause", 60, 0.8, "freebsd", r"\bfreebsd licen[sc]e\b"),
    ("bsd-patent", 60, 0.8, "bsd", r"\bbsd[ -](?:2-clause[ -])?plus patent licen[sc]e\b|\bbsd-2-clause-patent\b"),
    ("isc", 75, 0.9, "with or without fee is hereby granted", r"with or without fee is hereby granted"),
    ("apache-2.0", 80, 0.9, "except in compliance with the licen", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 75, 0.85, "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software"),
    ("gpl", 75, 0.9, "free software; you can redistribute it", r"free software; you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 80, 0.9, "free software; you can redistribute it", r"free software; you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 80, 0.9, "you can redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", 60, 0.8, "warranty of merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 65, 0.8, "received a copy of the gnu", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 65, 0.8, "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 65, 0.8, "received a copy of the gnu", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl-exception-linking", 70, 0.8, "as a special exception", r"as a special exception, .{0,80}?(?:permission|link)"),
    ("classpath-exception", 70, 0.85, "classpath exception", r"\bclasspath exception\b"),
    ("gcc-exception", 70, 0.85, "runtime library exception", r"\bgcc runtime library exception\b"),
    ("autoconf-exception", 70, 0.85, "configure script", r"\bas part of a configure script\b"),
    ("openssl-exception", 70, 0.85, "openssl", r"\blink(?:ing)? (?:the code |this program )?(?:of portions of this program )?with the openssl (?:library|project)"),
    ("mpl-2.0", 75, 0.9, "a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 75, 0.9, "contents of this file are subject", r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.1"),
    ("mpl-1.0", 60, 0.8, "mozilla public licen", r"\bmozilla public licen[sc]e,? (?:version |v\.? ?)?1\.0\b"),
    ("epl-2.0", 75, 0.9, "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl-1.0", 75, 0.9, "common development and distribution", r"subject to the terms of the common development and distribution licen[sc]e"),
    ("zlib", 75, 0.9, "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 75, 0.9, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", 75, 0.9, "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software"),
    ("boost", 75, 0.9, "boost software licen", r"distributed under the boost software licen[sc]e,? version 1\.0"),
    ("wtfpl", 75, 0.9, "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document"),
    ("gpl", 60, 0.8, "changing it is not allowed", r"verbatim copies of this licen[sc]e document, but changing it is not allowed"),
    ("cc0", 75, 0.9, "waived all copyright", r"has waived all copyright and related (?:or|and) neighbou?ring rights"),
    ("cc0", 70, 0.85, "to the extent possible under law", r"to the extent possible under law,? .{0,60}?(?:waived|dedicated)"),
    ("cc", 50, 0.7, "this work is licen", r"this work is licen[sc]ed under (?:a|the) creative commons\b"),
    ("cc", 30, 0.5, "creative commons", r"\bcreative commons\b"),
    ("gfdl", 75, 0.9, "free documentation licen", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("ofl", 75, 0.9, "sil open font", r"licensed under the sil open font licen[sc]e,? version 1\.1"),
    ("postgresql", 75, 0.9, "without a written agreement", r"without fee,? and without a written agreement is hereby granted"),
    ("hpnd", 70, 0.85, "appear in supporting documentation", r"permission notice appear in supporting documentation"),
    ("ncsa", 70, 0.85, "deal with the software without restriction", r"to deal with the software without restriction"),
    ("curl", 70, 0.85, "permission to use, copy, modify, and distribute this software for any purpose with or without fee", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee"),
    ("x11", 70, 0.85, "x consortium", r"\bname of the x consortium shall not be used in advertising\b"),
    ("json", 75, 0.9, "for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", 75, 0.9, "you can buy me a beer", r"\byou can buy me a beer in return\b"),
    ("beerware", 50, 0.7, "beerware|beer-ware", r"\bbeer-?ware licen[sc]e\b"),
    ("openssl", 75, 0.9, "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit"),
    ("php", 75, 0.9, "includes php software", r"this product includes php software"),
    ("apache-1.1", 75, 0.9, "software developed by the apache", r"includes software developed by the apache (?:software foundation|group)"),
    ("python", 70, 0.85, "psf hereby grants", r"\bpsf hereby grants licensee\b"),
    ("sspl", 70, 0.85, "functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl", 70, 0.85, "change date", r"\beffective on the change date\b"),
    ("commons-clause", 75, 0.9, "right to sell the software", r"does not grant to you,? the right to sell the software"),
    ("commons-clause", 55, 0.75, "commons clause", r"\bcommons clause\b(?: licen[sc]e condition)?"),
    # names
    ("0bsd", 60, 0.8, "zero-clause bsd|bsd zero clause", r"\bzero-clause bsd(?: licen[sc]e)?\b|\bbsd zero clause licen[sc]e\b"),
    ("bsd-1-clause", 50, 0.7, "1-clause bsd|bsd 1-clause", r"\b(?:1-clause bsd|bsd 1-clause) licen[sc]e\b"),
    ("afl", 50, 0.7, "academic free", r"\bacademic free licen[sc]e\b"),
    ("afl-3.0", 60, 0.8, "academic free", r"\bacademic free licen[sc]e,? (?:version |v\.? ?)?3\.0\b"),
    ("osl", 50, 0.7, "open software licen", r"\bopen software licen[sc]e\b"),
    ("osl-3.0", 60, 0.8, "open software licen", r"\bopen software licen[sc]e,? (?:version |v\.? ?)?3\.0\b"),
    ("artistic-1.0", 60, 0.8, "artistic licen", r"\bartistic licen[sc]e,? (?:version |v\.? ?)?1\.0\b"),
    ("artistic-2.0", 60, 0.8, "artistic licen", r"\bartistic licen[sc]e,? (?:version |v\.? ?)?2\.0\b"),
    ("perl", 50, 0.7, "same terms as perl", r"\bunder the same terms as perl(?: itself)?\b"),
    ("ruby", 50, 0.7, "same terms as ruby|ruby licen", r"\bunder the same terms as ruby\b|\bruby licen[sc]e\b"),
    ("php", 50, 0.7, "php licen", r"\bphp licen[sc]e\b"),
    ("php-3.01", 60, 0.8, "php licen", r"\bphp licen[sc]e,? (?:version |v\.? ?)?3\.01\b"),
    ("zope", 50, 0.7, "zope public", r"\bzope public licen[sc]e\b"),
    ("qpl", 50, 0.7, "q public", r"\bq public licen[sc]e\b"),
    ("ipl", 50, 0.7, "ibm public", r"\bibm public licen[sc]e\b"),
    ("cpl", 50, 0.7, "common public licen", r"\bcommon public licen[sc]e\b"),
    ("cpal", 50, 0.7, "common public attribution", r"\bcommon public attribution licen[sc]e\b"),
    ("npl", 50, 0.7, "netscape public", r"\bnetscape public licen[sc]e\b"),
    ("spl", 50, 0.7, "sun public", r"\bsun public licen[sc]e\b"),
    ("apsl", 50, 0.7, "apple public source", r"\bapple public source licen[sc]e\b"),
    ("ms-pl", 50, 0.7, "microsoft public", r"\bmicrosoft public licen[sc]e\b"),
    ("ms-rl", 50, 0.7, "microsoft reciprocal", r"\bmicrosoft reciprocal licen[sc]e\b"),
    ("upl", 50, 0.7, "universal permissive", r"\buniversal permissive licen[sc]e\b"),
    ("ecl-2.0", 50, 0.7, "educational community", r"\beducational community licen[sc]e\b"),
    ("lppl", 50, 0.7, "latex project public", r"\blatex project public licen[sc]e\b"),
    ("lppl-1.3c", 60, 0.8, "latex project public", r"\blatex project public licen[sc]e,? (?:version |v\.? ?)?1\.3c\b"),
    ("w3c", 50, 0.7, "w3c software", r"\bw3c software(?: notice and)? licen[sc]e\b"),
    ("w3c", 50, 0.7, "w3c document", r"\bw3c document licen[sc]e\b"),
    ("ncsa", 50, 0.7, "university of illinois", r"\buniversity of illinois/ncsa open source licen[sc]e\b"),
    ("vim", 50, 0.7, "vim licen", r"\bvim licen[sc]e\b"),
    ("x11", 50, 0.7, "x11 licen", r"\bx11 licen[sc]e\b"),
    ("curl", 50, 0.7, "curl licen", r"\bcurl licen[sc]e\b"),
    ("openssl", 50, 0.7, "openssl licen", r"\bopenssl licen[sc]e\b"),
    ("json", 50, 0.7, "json licen", r"\bjson licen[sc]e\b"),
    ("icu", 50, 0.7, "icu licen", r"\bicu licen[sc]e\b"),
    ("unicode", 50, 0.7, "unicode", r"\bunicode licen[sc]e agreement\b|\bunicode,? inc\.? licen[sc]e\b"),
    ("libpng", 50, 0.7, "png reference library licen|libpng licen", r"\bpng reference library licen[sc]e\b|\blibpng licen[sc]e\b"),
    ("ijg", 50, 0.7, "independent jpeg group", r"\bindependent jpeg group\b"),
    ("freetype", 50, 0.7, "freetype", r"\bfreetype(?: project)? licen[sc]e\b"),
    ("sleepycat", 50, 0.7, "sleepycat", r"\bsleepycat licen[sc]e\b"),
    ("nasa", 50, 0.7, "nasa open source", r"\bnasa open source agreement\b"),
    ("eudatagrid", 50, 0.7, "eu datagrid", r"\beu datagrid software licen[sc]e\b"),
    ("cecill", 50, 0.7, "cecill", r"\bcecill(?:-[abc])?\b"),
    ("eupl-1.1", 60, 0.8, "european union public|eupl", r"\beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.1\b|\beupl[ -]?(?:v\.? ?)?1\.1\b"),
    ("eupl-1.2", 60, 0.8, "european union public|eupl", r"\beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.2\b|\beupl[ -]?(?:v\.? ?)?1\.2\b"),
    ("mulan-psl", 50, 0.7, "mulan", r"\bmulan (?:psl|permissive software licen[sc]e)\b"),
    ("cc-devnations", 40, 0.6, "developing nations", r"\bcreative commons developing nations\b"),
    ("cc-sampling", 40, 0.6, "sampling", r"\bcreative commons sampling(?: plus)?\b"),
    ("cdla-permissive", 60, 0.8, "community data licen", r"\bcommunity data licen[sc]e agreement[ ,–-]+permissive\b"),
    ("cdla-sharing", 60, 0.8, "community data licen", r"\bcommunity data licen[sc]e agreement[ ,–-]+sharing\b"),
    ("dbcl", 60, 0.8, "database contents", r"\bdatabase contents licen[sc]e\b"),
    ("nlod", 60, 0.8, "norwegian licen", r"\bnorwegian licen[sc]e for open government data\b"),
    ("ogl-3.0", 60, 0.8, "open government licen", r"\bopen government licen[sc]e,? (?:version |v\.? ?)?3\.0\b"),
    ("etalab", 60, 0.8, "etalab|licence ouverte", r"\betalab\b|\blicence ouverte\b"),
    ("dl-de", 60, 0.8, "datenlizenz", r"\bdatenlizenz deutschland\b"),
    ("gfdl-1.3", 65, 0.8, "free documentation licen", r"\bgnu free documentation licen[sc]e,? (?:version |v\.? ?)?1\.3\b"),
    ("opl", 50, 0.7, "open publication", r"\bopen publication licen[sc]e\b"),
    ("open-game", 50, 0.7, "open game", r"\bopen game licen[sc]e\b"),
    ("free-art", 50, 0.7, "free art|licence art libre", r"\bfree art licen[sc]e\b|\blicence art libre\b"),
    ("ofl", 40, 0.6, "ofl", r"\b(?:sil )?ofl[ -]1\.[01]\b"),
    ("bitstream-vera", 50, 0.7, "bitstream vera", r"\bbitstream vera\b"),
    ("ubuntu-font", 50, 0.7, "ubuntu font", r"\bubuntu font licen[sc]e\b"),
    # models and data
    ("llama", 60, 0.8, "community licen", r"\bllama(?: ?\d(?:\.\d)?)? community licen[sc]e(?: agreement)?\b"),
    ("gemma", 60, 0.8, "gemma terms", r"\bgemma terms of use\b"),
    ("openrail-m", 60, 0.8, "rail-m|rail m", r"\b(?:creativeml )?open ?rail[ -]m\b"),
    ("research-only", 50, 0.7, "research purposes|research use", r"\bfor (?:academic |non-?commercial )?research (?:purposes|use) only\b"),
    ("evaluation-only", 50, 0.7, "evaluation purposes|internal evaluation", r"\bfor (?:internal )?evaluation purposes only\b|\binternal evaluation only\b"),
    ("personal-use", 50, 0.7, "personal use|private use", r"\bfor (?:personal|private) use only\b"),
    ("no-ai-training", 60, 0.8, "train", r"\bmay not be used (?:to train|for training)\b|\bno (?:ai|machine learning) training\b"),
    ("text-and-data-mining", 60, 0.8, "data mining", r"\btext and data mining (?:rights? )?(?:is |are )?(?:reserved|prohibited|not permitted)\b"),
    # terms of owners
    ("proprietary", 60, 0.8, "trade secret", r"\bconfidential and (?:contains )?trade secrets?\b|\btrade secrets? of\b"),
    ("proprietary", 60, 0.8, "strictly prohibited|strictly forbidden", r"\b(?:copying|reproduction|distribution|disclosure|use)(?: of this \w+)? is strictly (?:prohibited|forbidden)\b"),
    ("proprietary", 50, 0.7, "no part of this", r"\bno part of this (?:publication|book|document|work|material) may be\b"),
    ("proprietary", 50, 0.7, "end user licen|end-user licen", r"\bend[ -]user licen[sc]e agreement\b"),
    ("proprietary", 40, 0.6, "internal use only", r"\bfor internal use only\b"),
    ("proprietary", 40, 0.6, "do not distribute|not for distribution|not for public distribution", r"\bdo not distribute\b|\bnot for (?:public )?distribution\b"),
    ("proprietary", 40, 0.6, "commercial licen", r"\b(?:requires|purchase|under) a commercial licen[sc]e\b"),
    ("shareware", 50, 0.7, "shareware", r"\bthis (?:program|software) is shareware\b"),
    ("freeware", 50, 0.7, "freeware", r"\bfreeware\b"),
    ("donationware", 40, 0.6, "donationware", r"\bdonationware\b"),
    ("terms-of-service", 20, 0.3, "terms of service", r"\bterms of service\b"),
    ("terms-of-use", 20, 0.3, "terms of use|terms and conditions of use", r"\bterms (?:and conditions )?of use\b"),
    ("fair-use", 30, 0.4, "fair use|fair dealing", r"\bfair (?:use|dealing)\b"),
    ("us-government", 60, 0.8, "united states government|u.s. government", r"\bwork of the (?:united states|u\.s\.) government\b"),
    ("us-government-restricted", 50, 0.7, "restricted rights", r"\bu\.s\. government restricted rights\b|\brestricted rights legend\b"),
    ("crown-copyright", 60, 0.8, "crown copyright", r"\bcrown copyright\b"),
    ("permission-reprint", 40, 0.6, "reprinted with|reproduced with|used with", r"\b(?:reprinted|reproduced|used) with (?:the )?(?:kind )?permission\b"),
    ("permission-verbatim", 50, 0.7, "verbatim copies", r"\bpermission is granted to make and distribute verbatim copies\b"),
    ("permission-free-use", 50, 0.7, "free to use", r"\b(?:feel )?free to use,? (?:copy,? )?(?:modify,? )?(?:and |or )(?:re)?distribute\b"),
    ("royalty-free", 40, 0.5, "royalty-free|royalty free", r"\broyalty[ -]free\b"),
    ("no-warranty", 20, 0.3, "no warranty", r"\b(?:there is|comes with) (?:absolutely )?no warranty\b"),
    ("no-liability", 20, 0.3, "liable for any", r"\bbe liable for any (?:claim|direct|damages)\b"),
    # other languages
    ("proprietary", 40, 0.6, "nachdruck", r"\bnachdruck,? auch auszugsweise\b"),
    ("proprietary", 40, 0.6, "vervielfältigung", r"\bvervielfältigung (?:und verbreitung )?(?:nur mit|ohne) \w+ genehmigung\b"),
    ("proprietary", 40, 0.6, "toute reproduction", r"\btoute reproduction,? (?:même partielle,? )?(?:est )?interdite\b"),
    ("proprietary", 40, 0.6, "reproducción", r"\bprohibida (?:la|su) reproducción (?:total o parcial)?"),
    ("public-domain", 40, 0.6, "gemeinfrei", r"\bgemeinfrei\w*"),
    ("public-domain", 40, 0.6, "domaine public", r"\b(?:dans le|du) domaine public\b"),
    ("public-domain", 40, 0.6, "dominio público", r"\b(?:de|en el) dominio público\b"),
    ("license-notice", 10, 0.2, "lizenziert unter", r"\blizenziert unter\b"),
    ("license-notice", 10, 0.2, "sous licence", r"\bsous licence\b"),
    ("license-notice", 10, 0.2, "bajo licencia|bajo la licencia", r"\bbajo (?:la )?licencia\b"),
    # notices in files
    ("license-file", 30, 0.4, "licen", r"\bsee (?:the )?(?:accompanying )?licen[sc]e(?:\.txt|\.md)? file\b|\bsee (?:the )?file licen[sc]e\b"),
    ("license-file", 30, 0.4, "copying", r"\bsee (?:the )?(?:file )?copying(?:\.txt)?\b"),
    ("license-text", 30, 0.4, "full licen", r"\bfull licen[sc]e (?:text|information)\b"),
    ("dual-license", 50, 0.7, "dual", r"\bdual[ -]licen[sc]ed\b"),
    ("reuse", 50, 0.7, "spdx-filecopyrighttext", r"\bspdx-filecopyrighttext:"),
    ("copyright", 20, 0.3, "©|&copy;", r"(?:©|&copy;) ?\w"),
    ("copyright", 15, 0.25, "copr.", r"\bcopr\. (?:19|20)\d\d"),
)
