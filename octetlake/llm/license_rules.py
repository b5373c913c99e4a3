"""The signature rules of the license scan.

A rule is a regular expression over normalised text: lower-case words joined by single spaces, with
punctuation gone ("Apache License, Version 2.0." reads "apache license version 2 0"). Every match of a
rule holds its keyword, the literal that must occur before the expression is tried, and one of TRIGGERS
within a word (or 'cc' before 'by'), the cheap test that whole documents must pass first. A test expands
every expression and holds both promises against it.
"""

from __future__ import annotations

from typing import NamedTuple

#: Literals inside single words of the lower-cased raw text; a document with none has no detection.
TRIGGERS = ("licen", "copyright", "spdx", "gpl", "creative", "domain", "warrant", "redistribut", "copyleft", "cc0", "rights", "attribution")
#: 'cc' and 'by' as neighbouring words of the raw text.
CC_BY = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


class Rule(NamedTuple):
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float


#: (label, keyword, [names]) - hand-written names of each license, without the word license where it may vary.
NAMES: list[tuple[str, str, list[str]]] = [
    ("agpl-1.0", "affero", ["affero general public license(?: version| v)? 1(?: 0)?"]),
    ("agpl-3.0", "gpl", ["(?:gnu )?agpl ?v?3(?: 0)?", "agplv3"]),
    ("agpl-3.0", "affero", ["(?:gnu )?affero general public license(?: as published by the free software foundation(?: either)?)?(?: version| v)? ?3(?: 0)?", "affero gpl(?: version| v)? ?3"]),
    ("gpl-1.0", "gpl", ["(?:gnu )?gpl(?: version| v)? ?1(?: 0)?"]),
    ("gpl-2.0", "gpl", ["(?:gnu )?gpl(?: version| v)? ?2(?: 0)?", "gplv2"]),
    ("gpl-3.0", "gpl", ["(?:gnu )?gpl(?: version| v)? ?3(?: 0)?", "gplv3"]),
    ("gpl-1.0", "general public", ["(?:gnu )?general public license(?: version| v) ?1(?: 0)?"]),
    ("gpl-2.0", "general public", ["(?:gnu )?general public license(?: as published by the free software foundation either)?(?: version| v) ?2(?: 0)?"]),
    ("gpl-3.0", "general public", ["(?:gnu )?general public license(?: as published by the free software foundation either)?(?: version| v) ?3(?: 0)?"]),
    ("lgpl-2.0", "gpl", ["(?:gnu )?lgpl(?: version| v)? ?2(?: 0)?"]),
    ("lgpl-2.1", "gpl", ["(?:gnu )?lgpl(?: version| v)? ?2 1", "lgplv2 1"]),
    ("lgpl-3.0", "gpl", ["(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?", "lgplv3"]),
    ("lgpl-2.1", "lesser general", ["(?:gnu )?lesser general public license(?: version| v) ?2 1"]),
    ("lgpl-3.0", "lesser general", ["(?:gnu )?lesser general public license(?: version| v) ?3(?: 0)?"]),
    ("lgpl-2.0", "library general", ["(?:gnu )?library general public license(?: version 2(?: 0)?)?"]),
    ("gfdl", "free documentation", ["gnu free documentation license(?: version| v)?(?: 1 [123])?"]),
    ("apache-1.0", "apache", ["apache license(?: version| v)? 1 0"]),
    ("apache-1.1", "apache", ["apache(?: software)? license(?: version| v)? 1 1"]),
    ("apache-2.0", "apache", ["apache(?: software)? license(?: version| v)? ?2(?: 0)?", "apache 2(?: 0)? licen[cs]e"]),
    ("mit", "mit", ["mit licen[cs]e", "licensed under (?:the )?mit", "mit x11 licen[cs]e", "expat licen[cs]e mit"]),
    ("mit-0", "mit", ["mit no attribution(?: license)?", "mit 0 license"]),
    ("x11", "x11", ["x11 licen[cs]e", "mit x consortium license x11"]),
    ("expat", "expat", ["expat licen[cs]e"]),
    ("bsd-1-clause", "bsd", ["bsd 1 clause licen[cs]e", "one clause bsd licen[cs]e"]),
    ("bsd-2-clause", "bsd", ["(?:simplified|freebsd) bsd licen[cs]e", "bsd 2 clause licen[cs]e", "two clause bsd licen[cs]e", "2 clause bsd licen[cs]e"]),
    ("bsd-3-clause", "bsd", ["(?:new|revised|modified) bsd licen[cs]e", "bsd 3 clause licen[cs]e", "three clause bsd licen[cs]e", "3 clause bsd licen[cs]e"]),
    ("bsd-4-clause", "bsd", ["(?:original|old) bsd licen[cs]e", "bsd 4 clause licen[cs]e", "four clause bsd licen[cs]e"]),
    ("0bsd", "bsd", ["0bsd licen[cs]e", "zero clause bsd licen[cs]e", "bsd zero clause licen[cs]e"]),
    ("bsd", "bsd", ["bsd licen[cs]e", "bsd style licen[cs]e", "licensed under (?:the )?bsd"]),
    ("isc", "isc", ["isc licen[cs]e", "internet systems consortium isc licen[cs]e"]),
    ("mpl-1.0", "mozilla", ["mozilla public licen[cs]e(?: version| v)? 1 0"]),
    ("mpl-1.1", "mozilla", ["mozilla public licen[cs]e(?: version| v)? 1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public licen[cs]e(?: version| v)? 2 0"]),
    ("mpl", "mozilla", ["mozilla public licen[cs]e"]),
    ("epl-1.0", "eclipse", ["eclipse public licen[cs]e(?: version| v)? 1 0"]),
    ("epl-2.0", "eclipse", ["eclipse public licen[cs]e(?: version| v)? 2 0"]),
    ("epl", "eclipse", ["eclipse public licen[cs]e"]),
    ("edl-1.0", "eclipse", ["eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("cddl-1.0", "common development", ["common development and distribution licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("cddl-1.1", "common development", ["common development and distribution licen[cs]e(?: version| v)? 1 1"]),
    ("cpl-1.0", "common public", ["common public licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("cpal-1.0", "common public", ["common public attribution licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("artistic-1.0", "artistic", ["artistic licen[cs]e 1 0"]),
    ("artistic-2.0", "artistic", ["artistic licen[cs]e 2 0"]),
    ("artistic", "artistic", ["(?:perl )?artistic licen[cs]e"]),
    ("artistic", "perl itself", ["same terms as perl itself license"]),
    ("bsl-1.0", "boost", ["boost software licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("busl-1.1", "business source", ["business source licen[cs]e(?: version| v)?(?: 1 1)?"]),
    ("zlib", "zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"]),
    ("libpng", "libpng", ["libpng licen[cs]e(?: version 2)?"]),
    ("openssl", "openssl", ["openssl licen[cs]e", "openssl ssleay licen[cs]e"]),
    ("curl", "curl", ["curl licen[cs]e"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"]),
    ("python-2.0", "python", ["python software foundation licen[cs]e(?: version| v)?(?: 2)?", "python licen[cs]e", "psf licen[cs]e python"]),
    ("php-3.01", "php", ["php licen[cs]e(?: version| v)?(?: 3 01?)?"]),
    ("ruby", "ruby", ["ruby licen[cs]e", "same license as ruby"]),
    ("vim", "vim", ["vim licen[cs]e"]),
    ("tcl", "tcl", ["tcl tk licen[cs]e", "tcl licen[cs]e"]),
    ("w3c", "w3c", ["w3c software(?: notice and)? licen[cs]e", "w3c document licen[cs]e"]),
    ("wtfpl", "want to public", ["do what the fuck you want to public licen[cs]e(?: version| v)?(?: 2)?"]),
    ("unlicense", "unlicense", ["(?:the )?unlicense", "released under (?:the )?unlicense"]),
    ("beerware", "beer", ["beer ?ware licen[cs]e", "the beer ware license revision 42"]),
    ("ms-pl", "microsoft", ["microsoft public licen[cs]e"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal licen[cs]e"]),
    ("ofl-1.1", "open font", ["sil open font licen[cs]e(?: version| v)?(?: 1 1)?", "open font licen[cs]e(?: version| v)?(?: 1 1)?"]),
    ("odbl-1.0", "open database", ["open database licen[cs]e(?: version| v)?(?: 1 0)?", "open data commons open database license"]),
    ("odc-by-1.0", "open data commons", ["open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("pddl-1.0", "open data commons", ["open data commons public domain dedication and licen[cs]e"]),
    ("eupl-1.1", "european union", ["european union public licen[cs]e(?: version| v)? 1 1"]),
    ("eupl-1.2", "european union", ["european union public licen[cs]e(?: version| v)? 1 2"]),
    ("eupl", "european union", ["european union public licen[cs]e"]),
    ("cecill", "cecill", ["cecill(?: free software)? licen[cs]e(?: agreement)?(?: version| v)?(?: 2 [01])?", "cecill [bc] licen[cs]e"]),
    ("osl-3.0", "open software", ["open software licen[cs]e(?: version| v)?(?: 3 0)?"]),
    ("afl-3.0", "academic free", ["academic free licen[cs]e(?: version| v)?(?: 3 0)?"]),
    ("ecl-2.0", "educational community", ["educational community licen[cs]e(?: version| v)?(?: 2 0)?"]),
    ("upl-1.0", "universal permissive", ["universal permissive licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("qpl-1.0", "q public", ["q public licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("sleepycat", "sleepycat", ["sleepycat licen[cs]e"]),
    ("sspl-1.0", "server side public", ["server side public licen[cs]e(?: version| v)?(?: 1)?"]),
    ("elastic-2.0", "elastic", ["elastic licen[cs]e(?: version| v)?(?: 2 0)?"]),
    ("lppl-1.3c", "latex project", ["latex project public licen[cs]e(?: version| v)?(?: 1 3c?)?"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source licen[cs]e", "ncsa open source licen[cs]e"]),
    ("blueoak-1.0.0", "blue oak", ["blue oak model licen[cs]e(?: 1 0 0)?"]),
    ("mulan-psl-2.0", "mulan", ["mulan(?: permissive software licen[cs]e| psl license)(?: v2| version 2)?"]),
    ("openrail", "rail", ["(?:creativeml |bigscience )?open ?rail(?: m| s)? licen[cs]e"]),
    ("llama", "llama", ["llama [234](?: [0-9])? community licen[cs]e(?: agreement)?"]),
    ("gemma", "gemma", ["gemma terms of use licen[cs]e"]),
    ("json", "json", ["json licen[cs]e"]),
    ("fair", "fair", ["fair licen[cs]e"]),
    ("nasa-1.3", "nasa", ["nasa open source agreement license(?: 1 3)?"]),
    ("watcom-1.0", "watcom", ["sybase open watcom public licen[cs]e(?: 1 0)?"]),
    ("apsl-2.0", "apple public", ["apple public source licen[cs]e(?: version| v)?(?: 2 0)?"]),
    ("ipl-1.0", "ibm public", ["ibm public licen[cs]e(?: version| v)?(?: 1 0)?"]),
    ("rpl-1.5", "reciprocal public", ["reciprocal public licen[cs]e(?: version| v)?(?: 1 5)?"]),
    ("cern-ohl", "cern", ["cern open hardware licen[cs]e(?: version| v)?(?: [12](?: [0-2])?)?"]),
]

#: Creative Commons elements, as words, and as the words of a name.
_CC = {
    "by": ("by", "attribution"),
    "by-sa": ("by sa", "attribution share ?alike"),
    "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?"),
    "by-nc": ("by nc", "attribution non ?commercial"),
    "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Phrases of notices and full texts: (label, keyword, expression).
NOTICES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy .{0,400}?without warranty of any kind"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,300}?copyright notice"),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose .{0,200}?copyright notice"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org", "(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("gnu-gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gnu-lgpl", "lesser general public", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gnu-gpl-any", "gnu org", "(?:https? )?www gnu org licenses (?:gpl|lgpl|agpl)(?: [23] 0)?(?: html| txt)?"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", "boost org", "(?:https? )?www boost org license 1 0 txt"),
    ("mit", "opensource org", "(?:https? )?opensource org licenses mit(?: license)?(?: php)?"),
    ("bsd", "opensource org", "(?:https? )?opensource org licenses bsd(?: [23] clause)?(?: license)?"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "this (?:work|file|text|software|code) is (?:in the )?public domain"),
    ("public-domain", "public domain", "public domain dedication"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0-1.0", "creativecommons", "(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", "(?:https? )?creativecommons org publicdomain mark 1 0"),
    ("creative-commons", "creative commons", "creative commons licen[cs]e"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential license"),
    ("proprietary", "commercial license", "commercial license agreement"),
    ("proprietary", "end user", "end user licen[cs]e agreement"),
    ("no-warranty", "without warrant", "without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("no-warranty", "no warranty", "absolutely no warranty"),
    ("copyleft", "copyleft", "copyleft licen[cs]e"),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
]


def _rules() -> list[Rule]:
    out = [Rule(label, key, f"(?<= )(?:{rx})(?= )", 90 if len(rx) > 60 else 40, 0.99 if len(rx) > 60 else 0.8) for label, key, rx in NOTICES]
    for label in dict.fromkeys(label for label, _, _ in NAMES):
        out.append(Rule(label, "spdx", f"(?<= )spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?(?= )", 85, 1.0))
    for label, key, names in NAMES:
        for name in names:
            out.append(Rule(label, key, f"(?<= )(?:{name})(?: only| or later| or any later version)?(?= )", 70 if any(c.isdigit() for c in label) else 55, 0.95))
    for label, (short, long) in _CC.items():
        head = "(?<= )(?:licensed under )?(?:a |the )?"
        out.append(Rule(f"cc-{label}", "cc by", f"(?<= )cc {short}(?: licen[cs]e)?(?= )", 60 + len(short), 0.9))
        for owner in ("creative commons", "cc"):
            out.append(Rule(f"cc-{label}", f"{owner} attribution", f"{head}{owner} {long}(?: international| unported)?(?: licen[cs]e)?(?= )", 60 + len(short), 0.9))
        for v in _CC_VERSIONS:
            n = v.replace(".", " ")
            out.append(Rule(f"cc-{label}-{v}", "cc by", f"(?<= )cc {short} {n}(?: licen[cs]e)?(?= )", 75 + len(short), 0.97))
            for owner in ("creative commons", "cc"):
                out.append(Rule(f"cc-{label}-{v}", f"{owner} attribution", f"{head}{owner} {long} {n}(?: international| unported| generic)?(?: licen[cs]e)?(?= )", 75 + len(short), 0.97))
            out.append(Rule(f"cc-{label}-{v}", "creativecommons", f"(?<= )(?:https? )?creativecommons org licenses {short} {n}(?= )", 80 + len(short), 0.97))
    return out


RULES = _rules()
