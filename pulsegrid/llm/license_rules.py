"""The signatures of :mod:`pulsegrid.llm.licenses`: names of licenses, the forms in which they are met, and sentences.

Patterns are matched on normal words (``[a-z0-9]`` and non-ASCII characters, one space between two), so punctuation, case and line
breaks are no part of them: "CC BY-NC 4.0" is ``cc by nc 4 0``. Every rule names literals of which its matches hold at least one; a
rule without any of them in a text isn't tried on it.
"""

from __future__ import annotations

from dataclasses import dataclass

# Levels: a detection inside one of a smaller level is dropped.
TAG, SENTENCE, GRANT, NAME, HINT = range(5)
CONFIDENCE = {TAG: 1.0, SENTENCE: 0.95, GRANT: 0.9, NAME: 0.7, HINT: 0.3}


@dataclass(frozen=True)
class Rule:
    """A pattern of whole words; ``literals`` are parts of the normalised text, `` `` at their ends stands for a word's border."""

    name: str
    label: str
    level: int
    literals: tuple[str, ...]
    pattern: str


LICENSE = "(?:licen[cs]e|lizenz|licence|licencia)"
UNDER = ("(?:(?:licensed|licenced|released|distributed|available|published|provided|covered|governed|shared|redistributed|used|modified|made available)"
         "(?: [^ ]+){0,3} (?:under|by)(?: the)?(?: terms)?(?: of)?(?: the)?|unter der|unter|sous(?: la)? licence|sous|bajo(?: la)? licencia|bajo(?: la)?|under(?: the)?(?: terms of(?: the)?)?)")
#: Acronyms that mean other things too: without a version they count only before the word license.
AMBIGUOUS = "(?!(?:asl|mpl|epl|cpl|osl|afl|ofl|bsl|zpl|qpl|fdl|ftl|apsl|sspl) (?!licen[cs]e ))"
VERSION = "(?: {license})?(?: version| ver| ?v)? ?".replace("{license}", LICENSE)

#: Names of licenses that come in versions -> (literals, pattern of the name, versions).
VERSIONED: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "agpl": (("affero", "agpl"), "(?:gnu )?(?:affero (?:gnu )?(?:general public licen[cs]e|gpl)|agpl)", ("1.0", "3.0")),
    "lgpl": (("lesser general", "library general", "lgpl", "lesser gpl", "library gpl"), "(?:gnu )?(?:lesser|library) (?:general public licen[cs]e|gpl)|(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    "gpl": (("general public", " gpl", " gnu gpl"), "(?:gnu )?(?:general public licen[cs]e|gpl)", ("1.0", "2.0", "3.0")),
    "gfdl": (("free documentation", "fdl"), "(?:gnu )?(?:free documentation licen[cs]e|gfdl|fdl)", ("1.1", "1.2", "1.3")),
    "apache": ((" apache ", " asl "), "apache(?: software)?(?: license)?|asl", ("1.0", "1.1", "2.0")),
    "mpl": (("mozilla public", " mpl"), "mozilla public licen[cs]e|mpl", ("1.0", "1.1", "2.0")),
    "epl": (("eclipse public", " epl"), "eclipse public licen[cs]e|epl", ("1.0", "2.0")),
    "eupl": (("european union public", " eupl"), "european union public licen[cs]e|eupl", ("1.0", "1.1", "1.2")),
    "cddl": (("common development and distribution", " cddl"), "common development and distribution licen[cs]e|cddl", ("1.0", "1.1")),
    "cpl": (("common public", " cpl "), "common public licen[cs]e|cpl", ("1.0",)),
    "ipl": (("ibm public",), "ibm public licen[cs]e", ("1.0",)),
    "osl": (("open software licen", " osl "), "open software licen[cs]e|osl", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    "afl": (("academic free", " afl "), "academic free licen[cs]e|afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": (("artistic licen",), "(?:perl )?artistic licen[cs]e", ("1.0", "2.0")),
    "cecill": (("cecill",), "cecill(?: [bc])?", ("1.0", "1.1", "2.0", "2.1")),
    "lppl": (("latex project public", " lppl"), "latex project public licen[cs]e|lppl", ("1.0", "1.1", "1.2", "1.3")),
    "php": (("php licen",), "php licen[cs]e", ("3.0", "3.01")),
    "zpl": (("zope public", " zpl"), "zope public licen[cs]e|zpl", ("1.1", "2.0", "2.1")),
    "psf": (("python software foundation", " psf licen", "python licen"), "python(?: software foundation)? licen[cs]e|psf licen[cs]e", ("2.0",)),
    "ofl": (("sil open font", "open font licen", " ofl"), "(?:sil )?open font licen[cs]e|(?:sil )?ofl", ("1.0", "1.1")),
    "bsl": (("boost software", " bsl "), "boost software licen[cs]e|bsl", ("1.0",)),
    "busl": (("business source",), "business source licen[cs]e", ("1.0", "1.1")),
    "ecl": (("educational community",), "educational community licen[cs]e", ("1.0", "2.0")),
    "upl": (("universal permissive",), "universal permissive licen[cs]e", ("1.0",)),
    "cpal": (("common public attribution", " cpal"), "common public attribution licen[cs]e|cpal", ("1.0",)),
    "apsl": (("apple public source", " apsl"), "apple public source licen[cs]e|apsl", ("1.0", "1.1", "1.2", "2.0")),
    "rpl": (("reciprocal public", ), "reciprocal public licen[cs]e", ("1.1", "1.5")),
    "qpl": (("q public", " qpl"), "q public licen[cs]e|qpl", ("1.0",)),
    "sspl": (("server side public", " sspl"), "server side public licen[cs]e|sspl", ("1.0",)),
    "elastic": (("elastic licen",), "elastic licen[cs]e", ("1.0", "2.0")),
    "mulan-psl": (("mulan",), "mulan (?:psl|permissive software licen[cs]e)", ("1.0", "2.0")),
    "nasa": (("nasa open source",), "nasa open source agreement", ("1.3",)),
    "ogl": (("open government",), "open government licen[cs]e", ("1.0", "2.0", "3.0")),
    "odc-by": (("open data commons attribution", " odc by"), "open data commons attribution licen[cs]e|odc by", ("1.0",)),
    "odbl": (("open database", " odbl"), "(?:open data commons )?open database licen[cs]e|odbl", ("1.0",)),
    "pddl": (("public domain dedication and licen", " pddl"), "(?:open data commons )?public domain dedication and licen[cs]e|pddl", ("1.0",)),
    "cdla-permissive": (("cdla permissive", "data license agreement permissive"), "cdla permissive|community data license agreement permissive", ("1.0", "2.0")),
    "cdla-sharing": (("cdla sharing", "data license agreement sharing"), "cdla sharing|community data license agreement sharing", ("1.0",)),
    "openrail": (("openrail", "open rail"), "(?:creativeml |bigscience )?open ?rail(?: m)?", ("1.0",)),
    "blueoak": (("blue oak",), "blue oak model licen[cs]e", ("1.0.0",)),
    "polyform-nc": (("polyform noncommercial",), "polyform noncommercial licen[cs]e", ("1.0.0",)),
    "polyform-small": (("polyform small business",), "polyform small business licen[cs]e", ("1.0.0",)),
    "cern-ohl": (("cern open hardware", "cern ohl"), "cern (?:open hardware licen[cs]e|ohl)(?: [swp])?", ("1.1", "1.2", "2.0")),
    "tapr-ohl": (("tapr open hardware",), "tapr open hardware licen[cs]e", ("1.0",)),
    "hippocratic": (("hippocratic",), "hippocratic licen[cs]e", ("2.1", "3.0")),
    "simpl": (("simple public licen",), "simple public licen[cs]e", ("2.0",)),
    "vsl": (("vovida",), "vovida software licen[cs]e", ("1.0",)),
    "zend": (("zend licen",), "zend licen[cs]e", ("2.0",)),
    "catosl": (("computer associates trusted",), "computer associates trusted open source licen[cs]e", ("1.1",)),
    "lpl": (("lucent public",), "lucent public licen[cs]e", ("1.0", "1.02")),
    "spl": (("sun public",), "sun public licen[cs]e", ("1.0",)),
    "sgi-b": (("sgi free software",), "sgi free software licen[cs]e b", ("1.0", "1.1", "2.0")),
    "openldap": (("openldap public",), "openldap public licen[cs]e", ("2.7", "2.8")),
    "wtfpl": (("wtfpl", "what the fuck"), "wtfpl|do what the fuck you want to public licen[cs]e", ("1.0", "2.0")),
}

#: The parts of Creative Commons licenses (each in the versions below).
COMMONS = {"by": "by|attribution", "by-sa": "by sa|attribution share ?alike", "by-nd": "by nd|attribution no ?deriv(?:ative)?s(?: works)?",
           "by-nc": "by nc|attribution non ?commercial", "by-nc-sa": "by nc sa|attribution non ?commercial share ?alike",
           "by-nc-nd": "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Licenses without versions -> (literals, pattern of the name).
SINGLE: dict[str, tuple[tuple[str, ...], str]] = {
    "mit": ((" mit licen", " mit lizenz", "licence mit", "licencia mit", "under mit", "expat licen"), "(?:the )?(?:mit|expat) (?:licen[cs]e|lizenz)|(?:licence|licencia) mit|under mit"),
    "mit-0": (("mit no attribution", " mit 0 "), "mit no attribution|mit 0"),
    "bsd-2-clause": (("bsd",), "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    "bsd-3-clause": (("bsd",), "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    "bsd-4-clause": (("bsd",), "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?"),
    "0bsd": (("bsd", "0bsd"), "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
    "bsd": (("bsd licen", "bsd style"), "bsd(?: style)? licen[cs]e|bsd style"),
    "isc": (("isc licen",), "isc licen[cs]e"),
    "zlib": (("zlib",), "zlib(?: libpng)? licen[cs]e"),
    "libpng": (("libpng licen",), "libpng licen[cs]e"),
    "unlicense": (("unlicense",), "(?:the )?unlicense"),
    "cc0-1.0": ((" cc0", "creative commons zero", "cc zero"), "cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v1 0| 1 0)?|cc zero"),
    "public-domain": (("public domain", "gemeinfrei", "domaine public", "dominio"), "(?:dedicated to|released into|placed in|in) the public domain|public domain (?:dedication|mark|work)|gemeinfrei|domaine public|dominio p(?:ú|u)blico"),
    "ms-pl": (("microsoft public", " ms pl "), "microsoft public licen[cs]e|ms pl"),
    "ms-rl": (("microsoft reciprocal", " ms rl "), "microsoft reciprocal licen[cs]e|ms rl"),
    "ncsa": (("ncsa",), "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    "postgresql": (("postgresql licen",), "postgresql licen[cs]e"),
    "ruby": (("ruby licen", "ruby s licen"), "ruby(?: s)? licen[cs]e"),
    "vim": (("vim licen",), "vim licen[cs]e"),
    "w3c": (("w3c",), "w3c(?: software)?(?: notice)?(?: and)?(?: document)? licen[cs]e"),
    "x11": (("x11 licen", "x consortium licen"), "x11 licen[cs]e|x consortium licen[cs]e"),
    "curl": (("curl licen",), "curl licen[cs]e"),
    "openssl": (("openssl",), "openssl(?: and original ssleay)? licen[cs]e|openssl ssleay"),
    "sleepycat": (("sleepycat",), "sleepycat licen[cs]e"),
    "json": (("json licen",), "json licen[cs]e"),
    "tcl": (("tcl tk licen", "tcl licen"), "tcl(?: tk)? licen[cs]e"),
    "hpnd": (("historical permission",), "historical permission notice and disclaimer"),
    "ntp": (("ntp licen",), "ntp licen[cs]e"),
    "fair": (("fair licen",), "(?:the )?fair licen[cs]e"),
    "beerware": (("beerware", "beer ware"), "beer ?ware licen[cs]e|beer ?ware"),
    "icu": (("icu licen",), "icu licen[cs]e"),
    "unicode": (("unicode licen", "unicode inc licen"), "unicode(?: inc)? licen[cs]e(?: agreement)?"),
    "eclipse-distribution": (("eclipse distribution",), "eclipse distribution licen[cs]e"),
    "intel": (("intel open source",), "intel open source licen[cs]e"),
    "jabber": (("jabber open source",), "jabber open source licen[cs]e"),
    "miros": (("miros licen",), "miros licen[cs]e"),
    "nokia": (("nokia open source",), "nokia open source licen[cs]e"),
    "watcom": (("sybase open watcom",), "sybase open watcom public licen[cs]e"),
    "xnet": (("x net licen",), "x net licen[cs]e"),
    "sissl": (("sun industry standards",), "sun industry standards source licen[cs]e"),
    "freetype": (("freetype", " ftl "), "freetype(?: project)? licen[cs]e|ftl"),
    "imagemagick": (("imagemagick licen",), "imagemagick licen[cs]e"),
    "gpl-linking-exception": (("classpath exception", "linking exception", "runtime library exception"), "classpath exception|linking exception|(?:gcc )?runtime library exception"),
    "llvm-exception": (("llvm exception",), "(?:with )?llvm exceptions?"),
    "commons-clause": (("commons clause",), "commons clause(?: licen[cs]e)?(?: condition)?"),
    "proprietary": (("proprietary", "confidential and"), "proprietary (?:and confidential|licen[cs]e|software)|confidential and proprietary"),
    "shareware": (("shareware",), "shareware(?: licen[cs]e)?"),
    "freeware": (("freeware",), "freeware(?: licen[cs]e)?"),
}

#: Sentences of license texts and notices -> (label, literals, pattern).
SENTENCES: list[tuple[str, tuple[str, ...], str]] = [
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("permission notice shall be included",), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", ("permission to use copy modify and",), "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", ("redistribution and use in source and binary",), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", ("redistributions in binary form must",), "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", ("to endorse or promote products",), "(?:neither the name|names?) (?:[^ ]+ ){1,14}(?:may be used )?to endorse or promote products derived from this software"),
    ("bsd-4-clause", ("all advertising materials mentioning",), "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", ("except in compliance with the license",), "you may not use this file except in compliance with the license"),
    ("apache-2.0", ("as is basis without warranties",), "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", ("redistribute it and or modify it under",), "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", ("you should have received a copy",), "you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", ("copy and distribute verbatim",), "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-or-later", ("at your option any later",), "(?:either )?version \\d(?: \\d)? (?:of the license )?or at your option any later version"),
    ("lgpl", ("redistribute it and or modify it under",), "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", ("redistribute it and or modify it under",), "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gfdl", ("free documentation",), "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", ("this source code form is subject",), "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("mpl-1.1", ("the contents of this file are subject",), "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", ("accompanying materials are made available",), "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl-1.0", ("boost software license version",), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", ("provided as is without any express",), "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("unlicense", ("free and unencumbered",), "free and unencumbered software"),
    ("cc0-1.0", ("has waived all copyright",), "has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", ("the font software may be",), "the font software may be modified altered or added to"),
    ("wtfpl-2.0", ("you just do what",), "you just do what the fuck you want to"),
    ("beerware", ("buy me a beer",), "you can buy me a beer in return"),
    ("json", ("shall be used for good",), "the software shall be used for good not evil"),
    ("artistic-2.0", ("you may distribute verbatim copies",), "you may distribute verbatim copies of the source form of the standard version"),
    ("openssl", ("includes software developed by the openssl",), "this product includes software developed by the openssl project"),
    ("python", ("licensee agrees to be bound",), "by copying installing or otherwise using python licensee agrees to be bound"),
    ("postgresql", ("without a written agreement is hereby",), "without fee and without a written agreement is hereby granted"),
    ("unicode", ("data files and any associated documentation",), "obtaining a copy of the unicode data files and any associated documentation"),
    ("mulan-psl-2.0", ("mulan psl",), "you can use this software according to the terms and conditions of the mulan psl"),
    ("reserved", ("rechte vorbehalten",), "alle rechte vorbehalten"),
    ("reserved", ("droits r",), "tous droits r(?:é|e)serv(?:é|e)s"),
    ("reserved", ("derechos reservados",), "todos los derechos reservados"),
    ("reserved", ("rights reserved",), "(?:all|some|no) rights reserved"),
    ("proprietary", ("without the prior written",), "without (?:the )?prior written (?:permission|consent) of"),
    ("proprietary", ("may not be reproduced",), "(?:may not|must not) be reproduced(?: [^ ]+){0,6} without"),
    ("proprietary", ("unauthorized copying",), "unauthorized copying of this (?:file|document|software|work)"),
    ("noncommercial", ("for non commercial", "for noncommercial"), "for non ?commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", ("not for commercial",), "not for commercial (?:use|purposes)"),
    ("personal-use", ("personal use only",), "for personal use only"),
    ("research-only", ("research purposes only",), "for research purposes only"),
]

#: Weak signs -> (label, literals, pattern).
HINTS: list[tuple[str, tuple[str, ...], str]] = [
    ("copyright", ("copyright",), "(?:copyright )+(?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
    ("copyright", ("copyright",), "copyright (?:by|holders?|owners?|notice)"),
    ("unknown", ("licensed under",), "licensed under"),
    ("unknown", ("subject to the license", "terms of the license"), "(?:subject to|terms of) the license"),
    ("unknown", ("license agreement",), "license agreement"),
    ("unknown", ("see the license", "see license"), "see (?:the )?license(?: file)?"),
    ("unknown", ("lizenziert unter",), "lizenziert unter"),
    ("unknown", ("sous licence",), "sous licence"),
    ("unknown", ("bajo la licencia", "bajo licencia"), "bajo (?:la )?licencia"),
]


def _number(version: str) -> str:
    """A version as words; a trailing ``.0`` may be left out."""
    parts = version.split(".")
    if len(parts) == 2 and parts[1] == "0":
        return f"{parts[0]}(?: 0)?(?! \\d )"
    return " ".join(parts)


def _forms(label: str, literals: tuple[str, ...], name: str) -> list[Rule]:
    """A license by its tag, by a grant, and by name alone. The tag is the identifier as words."""
    words = " ".join(label.replace(".", " ").replace("-", " ").split())
    return [Rule(f"{label}/tag", label, TAG, ("license identifier " + words.split()[0],), f"spdx license identifier {words}(?: only| or later)?"),
            Rule(f"{label}/grant", label, GRANT, literals, f"{UNDER} (?:{name})(?: {LICENSE})?"),
            Rule(f"{label}/name", label, NAME, literals, f"(?:{name})")]


def rules() -> list[Rule]:
    """All rules, the stronger ones first: by level, then in the order of the tables (a versioned name before the bare one)."""
    out = [Rule(f"sentence/{k}", label, SENTENCE, literals, pattern) for k, (label, literals, pattern) in enumerate(SENTENCES)]
    for label, (literals, name, versions) in VERSIONED.items():
        for v in reversed(versions):
            out += _forms(f"{label}-{v}", literals, f"(?:{name}){VERSION}{_number(v)}")
        out += _forms(label, literals, f"{AMBIGUOUS}(?:{name})(?: licen[cs]e)?")
    for kind, name in COMMONS.items():
        named = f"(?:cc|creative commons) (?:{name})"
        literals = (" cc ", "creative commons")
        for v in reversed(COMMONS_VERSIONS):
            tail = f"(?: international| unported| generic)?(?: {LICENSE})?(?: version)? ?{_number(v)}(?: international| unported| generic)?"
            out += _forms(f"cc-{kind}-{v}", literals, named + tail)
            out.append(Rule(f"cc-{kind}-{v}/url", f"cc-{kind}-{v}", NAME, ("creativecommons org",),
                            f"creativecommons org licenses {kind.replace('-', ' ')} {v.replace('.', ' ')}"))
        out += _forms(f"cc-{kind}", literals, named)
    for label, (literals, name) in SINGLE.items():
        out += _forms(label, literals, name)
    out += [Rule(f"hint/{k}", label, HINT, literals, pattern) for k, (label, literals, pattern) in enumerate(HINTS)]
    return sorted(out, key=lambda r: r.level)
