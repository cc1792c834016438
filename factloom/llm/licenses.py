"""License scans: ordered signature rules over the words of a text, all in SQL functions.

A text's words, lower-cased and joined by single spaces, are scanned by regular expressions. Most
texts hold nothing of what the rules' patterns can't match without and are done after that; in the others a rule's pattern
runs only where its keyword is. Detections of all rules are sorted by place, and one
that lies within a detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words after A-Z are lower-cased, and the same words before.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, keyword, the license's name in words, and its identifier in words ('' if it has none of its own).
LICENSES = [
    ("mit", "mit", "mit(?: expat)?", "mit"),
    ("mit", "expat", "expat", ""),
    ("mit-0", "mit", "mit (?:no attribution|0)", "mit 0"),
    ("x11", "x11", "(?:mit )?x11", "x11"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache(?: software)?", ""),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[sc]e(?: version| v) ?1(?: 0)?", "gpl 1 0(?: only)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only)?"),
    ("gpl-2.0-or-later", "general public", "(?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version", "gpl 2 0 or later"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only)?"),
    ("gpl-3.0-or-later", "general public", "(?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?(?: of the licen[sc]e)? or(?: at your option)? any later version", "gpl 3 0 or later"),
    ("gpl", "general public", "(?:gnu )?general public", ""),
    ("gpl", "gpl", "(?:gnu )?gpl", ""),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", ""),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", ""),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", ""),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ""),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public licen[sc]e(?:(?: version| v)? ?2(?: 0)?)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public", ""),
    ("agpl", "agpl", "(?:gnu )?agpl", ""),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[sc]e(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation(?: licen[sc]e)?(?:(?: version| v)? ?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("bsd", "bsd", "bsd(?: style)?", ""),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd"),
    ("bsd-1-clause", "bsd", "(?:bsd 1 clause|1 clause bsd|one clause bsd)", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd 4 clause"),
    ("isc", "isc", "isc", "isc"),
    ("isc", "internet systems", "internet systems consortium", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng(?: version 2)?", "libpng(?: 2 0)?"),
    ("bsl-1.0", "boost", "boost software(?: licen[sc]e)?(?:(?: version)? 1 0)?", "bsl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public", ""),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public", ""),
    ("edl-1.0", "eclipse", "eclipse distribution(?: licen[sc]e)?(?:(?: version| v)? ?1 0)?", ""),
    ("cddl-1.0", "common development", "common development and distribution(?: licen[sc]e)?(?:(?: version)? 1 0)?", "cddl 1 0"),
    ("cddl-1.1", "common development", "common development and distribution licen[sc]e(?: version)? 1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public(?: licen[sc]e)?(?:(?: version)? 1 0)?", "cpl 1 0"),
    ("ipl-1.0", "ibm public", "ibm public(?: licen[sc]e)?(?:(?: version)? 1 0)?", "ipl 1 0"),
    ("artistic-1.0", "artistic", "artistic(?: licen[sc]e)? 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic(?: licen[sc]e)? 2 0", "artistic 2 0"),
    ("artistic", "artistic", "(?:perl )?artistic", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "what the fuck", "do what the fuck you want to public", ""),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "creative commons", "creative commons attribution", ""),
    ("cc-by-2.0", "creative commons", "creative commons attribution 2 0(?: generic)?", "cc by 2 0"),
    ("cc-by-3.0", "creative commons", "creative commons attribution 3 0(?: unported)?", "cc by 3 0"),
    ("cc-by-4.0", "creative commons", "creative commons attribution 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike", ""),
    ("cc-by-sa-3.0", "creative commons", "creative commons attribution share ?alike 3 0(?: unported)?", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative commons", "creative commons attribution share ?alike 4 0(?: international)?", "cc by sa 4 0"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", ""),
    ("cc-by-nc-4.0", "creative commons", "creative commons attribution non ?commercial 4 0(?: international)?", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?", "cc by nc nd 4 0"),
    ("cc-by-nd-4.0", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?", "cc by nd 4 0"),
    ("cc-pd", "creative commons", "creative commons public domain(?: dedication| mark)?(?: 1 0)?", ""),
    ("odbl-1.0", "open database", "open database(?: licen[sc]e)?(?: v?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution(?: licen[sc]e)?(?: v?1 0)?", "odc by 1 0"),
    ("pddl-1.0", "open data commons", "open data commons public domain dedication(?: and licen[sc]e)?(?: v?1 0)?", "pddl 1 0"),
    ("ofl-1.1", "open font", "(?:sil )?open font(?: licen[sc]e)?(?:(?: version)? 1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", "python software foundation(?: licen[sc]e)?(?:(?: version)? 2(?: 0)?)?", "psf 2 0"),
    ("php-3.01", "php", "php(?: licen[sc]e)?(?: version)? 3 01", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("curl", "curl", "curl", "curl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("ms-pl", "microsoft public", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", "ms rl"),
    ("eupl-1.2", "european union public", "european union public(?: licen[sc]e)?(?:(?: version| v)? ?1 [12])?", "eupl 1 2"),
    ("upl-1.0", "universal permissive", "universal permissive(?: licen[sc]e)?(?:(?: version| v)? ?1 0)?", "upl 1 0"),
    ("osl-3.0", "open software", "open software(?: licen[sc]e)?(?:(?: version| v)? ?3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free", "academic free(?: licen[sc]e)?(?:(?: version| v)? ?3 0)?", "afl 3 0"),
    ("blueoak-1.0.0", "blue oak", "blue oak model(?: licen[sc]e)?(?: 1 0 0)?", "blueoak 1 0 0"),
    ("sspl-1.0", "server side", "server side public(?: licen[sc]e)?(?:(?: version| v)? ?1)?", "sspl 1 0"),
    ("busl-1.1", "business source", "business source(?: licen[sc]e)?(?: 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", "elastic(?: licen[sc]e)? 2 0", "elastic 2 0"),
    ("json", "json", "json", "json"),
    ("beerware", "beerware", "beerware", "beerware"),
    ("openrail-m", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?", "openrail"),
    ("openrail-m", "open rail", "(?:creativeml |bigscience )?open rail(?: m)?", ""),
    ("llama-community", "llama", "llama [23](?: [0-9])? community", ""),
]

#: label, keyword, pattern: sentences and addresses that stand for a license.
PHRASES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the license"),
    ("gpl", "gnu org", "gnu org (?:licenses|copyleft)(?: old licenses)? gpl(?: [23] 0)?"),
    ("lgpl", "gnu org", "gnu org (?:licenses|copyleft)(?: old licenses)? lgpl(?: [23] [01])?"),
    ("agpl", "gnu org", "gnu org licenses agpl(?: 3 0)?"),
    ("gpl", "free software foundation", "(?:redistribute it and or modify it )?under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "opensource org licenses", "opensource org licenses mit"),
    ("bsd-2-clause", "opensource org licenses", "opensource org licenses bsd(?: 2 clause| license)?"),
    ("bsd-3-clause", "opensource org licenses", "opensource org licenses bsd 3 clause"),
    ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
    ("cc-by-4.0", "creativecommons org", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons org", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons org", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons org", "creativecommons org licenses by nd 4 0"),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:is |are |released |placed |dedicated |put )?(?:in|into|to) the public domain"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("wtfpl", "do what the fuck", "you just do what the fuck you want to"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "licen", "proprietary licen[sc]e"),
    ("commercial", "licen", "commercial licen[sc]e"),
    ("permissive-notice", "copyright notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("no-warranty", "warrant", "(?:provided )?as is without warrant(?:y|ies) of any kind"),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("other", "licen", "(?:licensed|released|distributed|available|published) under (?:the |an? )?[^ ]{1,40} licen[sc]e"),
    ("other", "licen", "(?:sous|bajo)(?: la| une| una)? licen[cs]i?[ae]"),
    ("other", "lizenz", "unter(?: der| einer)? lizenz"),
    ("apache-2.0", "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2.0", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "absolutely no warranty", "(?:this program )?comes with absolutely no warranty"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it"),
    ("agpl-3.0", "remotely through a computer network", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "distribute and or modify this document", "permission is granted to copy distribute and or modify this document"),
    ("bsd-4-clause", "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("ncsa", "the following disclaimers", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("bsl-1.0", "person or organization obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("isc", "author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("artistic-2.0", "bug fixes portability fixes", "you may apply bug fixes portability fixes and other modifications derived from the public domain"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("ofl-1.1", "reserved font name", "(?:with )?reserved font names?"),
    ("ofl-1.1", "font software", "the font software may be modified altered or added to"),
    ("cc0-1.0", "neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc-by", "give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "distribute your contributions under", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified material", "you may not distribute the modified material"),
    ("odbl-1.0", "this database is made available", "this database is made available under the open database license"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("postgresql", "written agreement", "without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl toolkit", "software developed by the openssl project for use in the openssl toolkit"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("psf-2.0", "psf is making python available", "psf is making python available to licensee on an as is basis"),
    ("sspl-1.0", "third parties as a service", "functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "non production use", "redistribute and make non production use of the licensed work"),
    ("commons-clause", "commons clause", "commons clause licen[sc]e condition"),
    ("openrail-m", "use based restrictions", "use based restrictions"),
    ("ms-pl", "risk of using it", "the software is licensed as is you bear the risk of using it"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: v?[12](?: [01])?)?"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade secret", "(?:contains|constitutes) trade secrets?"),
    ("no-warranty", "implied warrant", "without any express or implied warrant(?:y|ies)"),
    ("no-warranty", "fitness for a particular purpose", "merchantability(?: and| or)? fitness for a particular purpose"),
]

#: label, keyword, pattern: everyday forms without the words that the rules above look for. A plus sign isn't part of a word, so "GPLv2+" is gpl-2.0 here.
FORMS = [
    ("mit", " mit", "mit(?: expat| style)? licen[sc]ed"),
    ("mit", "mit or apache", "mit or apache"),
    ("apache-2.0", " apache", "apache(?: version| v)? ?2(?: 0)? licen[sc]ed"),
    ("apache", " apache", "apache(?: software)? licen[sc]ed"),
    ("apache-2.0", " apache", "apache (?:version 2|v2|2)(?: 0)"),
    ("apache-2.0", " apache", "apache v?2"),
    ("bsd", " bsd", "bsd(?: style)? licen[sc]ed"),
    ("0bsd", " 0bsd", "0bsd"),
    ("bsd-1-clause", " bsd", "(?:bsd 1|1) clause bsd|bsd 1 clause"),
    ("bsd-2-clause", " bsd", "(?:2|two) clause bsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", " bsd", "(?:3|three) clause bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", " bsd", "(?:4|four) clause bsd|bsd (?:4|four) clause"),
    ("gpl", " gpl", "(?:gnu )?gpl licen[sc]ed"),
    ("gpl-2.0", " gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only)?(?: licen[sc]ed)?"),
    ("gpl-3.0", " gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only)?(?: licen[sc]ed)?"),
    ("gpl-2.0-or-later", " gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    ("gpl-3.0-or-later", " gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    ("lgpl", " lgpl", "(?:gnu )?lgpl licen[sc]ed"),
    ("lgpl-2.1", " lgpl", "(?:gnu )?lgpl ?(?:version |v)?2 1(?: only| or later)?(?: licen[sc]ed)?"),
    ("lgpl-3.0", " lgpl", "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?(?: only| or later)?(?: licen[sc]ed)?"),
    ("agpl", " agpl", "(?:gnu )?agpl licen[sc]ed"),
    ("agpl-3.0", " agpl", "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?(?: only| or later)?(?: licen[sc]ed)?"),
    ("isc", " isc", "isc licen[sc]ed"),
    ("zlib", " zlib", "zlib licen[sc]ed"),
    ("bsl-1.0", " boost", "boost(?: software)? licen[sc]ed"),
    ("bsl-1.0", " bsl", "bsl 1 0"),
    ("mpl", " mpl", "mpl licen[sc]ed"),
    ("mpl", " mozilla", "mozilla(?: public)? licen[sc]ed"),
    ("mpl-1.1", " mpl", "mpl(?: version| v)? 1 1|mplv1 1"),
    ("mpl-2.0", " mpl", "mpl(?: version| v)? 2 0|mpl ?v2(?: 0)?"),
    ("epl-1.0", " epl", "epl 1 0"),
    ("epl-2.0", " epl", "epl 2 0"),
    ("cddl-1.0", " cddl", "cddl(?: version)? 1 0"),
    ("cddl-1.1", " cddl", "cddl(?: version)? 1 1"),
    ("eupl-1.2", " eupl", "eupl(?: v)? 1 [12]|eupl v1 [12]"),
    ("artistic-2.0", " artistic", "artistic 2 0"),
    ("ofl-1.1", " ofl", "(?:sil )?ofl(?: version)? 1 1"),
    ("odbl-1.0", " odbl", "odbl(?: v)? 1 0|odbl v1 0"),
    ("cc0-1.0", " cc0", "cc0(?: 1 0| licen[sc]ed)"),
    ("cc-by", " cc by", "cc by licen[sc]ed"),
    ("cc-by-2.0", " cc by", "cc by 2 0"),
    ("cc-by-3.0", " cc by", "cc by 3 0"),
    ("cc-by-4.0", " cc by", "cc by 4 0"),
    ("cc-by-sa", " cc by", "cc by sa licen[sc]ed"),
    ("cc-by-sa-3.0", " cc by", "cc by sa 3 0"),
    ("cc-by-sa-4.0", " cc by", "cc by sa 4 0"),
    ("cc-by-nc-4.0", " cc by", "cc by nc 4 0"),
    ("cc-by-nd-4.0", " cc by", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", " cc by", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", " cc by", "cc by nc nd 4 0"),
    ("unlicense", " unlicense", "(?:the )?unlicense"),
    ("other", "licen", "(?:dual(?:ly)?|multi|triple) licen[sc]ed"),
]

#: Rare words, or parts of words, that a text is asked for first where a rule's pattern needs one.
ANCHORS = ["licen", "lizenz", "spdx", "gnu", "gpl", "copyleft", "domain", "reserved", "permission", "copyright", "warrant", "creativecommons", "redistribution", "apache", "mozilla", "altered", "neither", "confidential", "foundation", "fuck", "advertising", "modif", "reproduced", "prohibited"]

VERB = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|redistributed|covered)"


class Rule(NamedTuple):
    rule: str
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def build_rules() -> list[Rule]:
    """Five forms of each license's name and identifier, the phrases and everyday forms; priorities 4 to 1."""
    out = []
    for label, keyword, name, identifier in LICENSES:
        tail = "(?: licen[sc]e)?" if "licen" not in name else ""
        if identifier:
            out.append(Rule(f"{label}/spdx", label, "spdx", f"spdx licen[sc]e identifier {identifier}", 4, 1.0))
            out.append(Rule(f"{label}/field", label, "licen", f"licen[sc]e(?: is)? {identifier}", 2, 0.7))
        out.append(Rule(f"{label}/notice", label, keyword, f"{VERB} under(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? {name}{tail}", 3, 0.95))
        out.append(Rule(f"{label}/name", label, keyword, f"{name} licen[sc]e" if tail else name, 2, 0.85))
        out.append(Rule(f"{label}/foreign", label, keyword, f"(?:licence|lizenz|licencia) {name}|{name} lizenz", 2, 0.8))
    for k, (label, keyword, pattern) in enumerate(PHRASES):
        weak = label in ("other", "copyright", "no-warranty", "permissive-notice")
        out.append(Rule(f"{label}/phrase-{k}", label, keyword, pattern, 1 if weak else 3, 0.4 if weak else 0.9))
    for k, (label, keyword, pattern) in enumerate(FORMS):
        out.append(Rule(f"{label}/form-{k}", label, keyword, pattern, 1 if label == "other" else 2, 0.4 if label == "other" else 0.8))
    return out


RULES = build_rules()


def gate(rules: list[Rule], text: str = "_low") -> str:
    """SQL that is true for any lower-cased text that matches a rule: an anchor that the pattern
    can't match without (one of two for foreign names), else (notices) a verb before 'under', a form,
    where its first word is, with any separators between its words, else all words of the keyword."""
    asked, forms = set(), {}
    for r in rules:
        bare, before = r.pattern.removeprefix(VERB), None
        while bare != before:  # optional parts and choices go
            bare, before = re.sub(r"\(\?:[^()]*\)\??", "", bare), bare
        words = [] if "|" in bare else [a for a in ANCHORS if a in bare][:1]
        if r.rule.endswith("/foreign"):
            asked |= {f"(contains({text}, '{w}'))" for w in ("licen", "lizenz")}
        elif not words and "/form-" in r.rule:
            forms.setdefault(r.keyword.split()[0], []).append(re.sub(r" (\??)", lambda m: f"(?:{NOT_WORDS}){m[1]}", r.pattern))
        elif not words and r.pattern.startswith(VERB):
            asked.add(f"(contains({text}, 'under') and {text} rlike r'{VERB}{NOT_WORDS}under')")
        else:
            asked.add("(" + " and ".join(f"contains({text}, '{w}')" for w in words or r.keyword.split()) + ")")
    asked |= {f"(contains({text}, '{word}') and {text} rlike r'{'|'.join(f)}')" for word, f in forms.items()}
    return " or ".join(sorted(asked, key=lambda a: (a.count("contains"), a))) or "false"


LEVELS = 4

DETECTION = "struct<start:int,end:int,rule:string,label:string,priority:int,confidence:double>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def base_places(words: Column) -> Column:
    """Array of struct(start, label): where base phrases stand in an array of words."""
    at = lambda i, back: F.get(words, i - back)
    label = lambda i: F.when(at(i, 0) == "license", F.when(at(i, 1).isin("mit", "apache"), at(i, 1)).when((at(i, 1) == "public") & (at(i, 2) == "general"), "gpl"))
    found = F.transform(F.sequence(F.lit(0), F.size(words)), lambda i: F.struct((i - F.when(label(i) == "gpl", 2).otherwise(1)).cast("bigint").alias("start"), label(i).alias("label")))
    return F.filter(found, lambda p: p["label"].isNotNull())


def detections(joined: Column, rules: list[Rule] = RULES) -> Column:
    """Kept detections, an array of DETECTION sorted by place, in `` word word word ``.

    start and end count words from 0, end exclusive.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(Rule._fields, r._replace(pattern=f" (?:{r.pattern})(?= )"), strict=True)]) for r in rules])

    def places(r: Column) -> Column:
        gaps, matches = F.split(joined, r["pattern"], -1), F.regexp_extract_all(joined, r["pattern"], F.lit(0))
        counts = F.zip_with(gaps, matches, lambda g, m: F.struct(_spaces(g).alias("gap"), _spaces(m).alias("size")))
        empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("found"))

        def step(s: Column, c: Column) -> Column:
            start = s["at"] + c["gap"]
            hit = F.struct(start.alias("start"), (start + c["size"]).alias("end"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"))
            return F.struct((start + F.coalesce(c["size"], F.lit(0))).alias("at"), F.when(c["size"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(hit))).alias("found"))

        return F.aggregate(counts, empty, step)["found"]

    hits = F.flatten(F.transform(F.filter(table, lambda r: F.contains(joined, r["keyword"])), places))
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("order"), (-h["priority"]).alias("rank"), h["rule"].alias("rule"), h.alias("hit"))))
    names = [f"m{k}" for k in range(1, LEVELS + 1)]
    start = F.struct(*[F.lit(-1).alias(n) for n in names], F.expr(f"cast(array() as array<{DETECTION}>)").alias("kept"))

    def step(s: Column, o: Column) -> Column:
        h = o["hit"]
        reach = F.greatest(*[F.when(h["priority"] <= k, s[n]).otherwise(-1) for k, n in enumerate(names, 1)], F.lit(-1))
        ends = [F.when(h["priority"] == k, F.greatest(s[n], h["end"])).otherwise(s[n]).alias(n) for k, n in enumerate(names, 1)]
        return F.struct(*ends, F.when(reach >= h["end"], s["kept"]).otherwise(F.concat(s["kept"], F.array(h))).alias("kept"))

    return F.aggregate(ordered, start, step)["kept"]


def scan_licenses(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Add n_words, base (array of struct(start, label)), detections and score.

    Null counts as empty text; columns of these names that are there are replaced, all others
    stay; equal rows get equal results. score is the highest confidence of what is found: 0
    to 1, at least 0.8 where a base phrase stands.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.drop("n_words", "base", "detections", "score")
    low = docs.withColumn("_low", F.lower(raw))
    gated = low.withColumn("_gate", F.coalesce(F.expr(gate(rules)), F.lit(False)))
    words = F.regexp_extract_all(ascii_lower(raw), F.lit(WORDS), F.lit(0))
    none_found, none_based = F.expr(f"cast(array() as array<{DETECTION}>)"), F.expr("cast(array() as array<struct<start:bigint,label:string>>)")
    joined = F.concat(F.lit(" "), F.array_join(F.col("_words"), " "), F.lit(" "))
    out = gated.withColumn("n_words", F.regexp_count(raw, F.lit(WORDS_ANY_CASE)).cast("bigint")).withColumn("_words", F.when(F.col("_gate"), words)).withColumn("_joined", F.when(F.col("_gate"), joined))
    out = out.withColumn("base", F.when(F.contains("_joined", F.lit(" license ")), base_places(F.col("_words"))).otherwise(none_based))
    out = out.withColumn("detections", F.when(F.col("_gate"), detections(F.col("_joined"), rules)).otherwise(none_found))
    found = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return out.withColumn("score", F.when(F.size("base") > 0, F.greatest(found, F.lit(0.8))).otherwise(found)).drop("_low", "_gate", "_words", "_joined")


def label_list(*arrays: Column) -> Column:
    """The distinct labels of arrays of structs, sorted and comma-joined."""
    labels = F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays])
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
