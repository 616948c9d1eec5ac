"""Ordered signature rules for licence statements.

A rule matches the words of a text joined by single spaces, lower case, so "CC-BY-SA 4.0" is
"cc by sa 4 0". ``keyword`` must start one of those words before the pattern is tried, and is
part of every match. Priorities:
5 a licence with its version or full grant, 4 a licence by name, 3 a family, 2 a legal notice,
1 a vague mention.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: Phrases that count wherever their words stand; never suppressed.
BASE = [
    Rule("cc-by", 3, "cc by", "cc by", True),
    Rule("gpl", 3, "general public license", "general public license", True),
    Rule("reserved", 2, "all rights reserved", "all rights reserved", True),
]

LICEN = "licen[cs]e"
VER = "(?:version |ver |v ?)?"

#: label, priority, keyword, pattern
NAMED = [
    # Apache
    ("apache-2.0", 5, "apache", rf"(?:licen[cs]ed under )?(?:the )?apache (?:software )?{LICEN} {VER}2(?: 0)?"),
    ("apache-2.0", 5, "apache", rf"apache {VER}2(?: 0)? {LICEN}"),
    ("apache-2.0", 5, "apache org", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?"),
    ("apache-1.1", 5, "apache", rf"(?:the )?apache (?:software )?{LICEN} {VER}1 1"),
    ("apache-1.0", 5, "apache", rf"(?:the )?apache (?:software )?{LICEN} {VER}1 0"),
    ("apache", 3, "apache", rf"(?:the )?apache (?:software )?{LICEN}"),
    ("apache", 3, "apache", r"apache software foundation"),
    # MIT, X11, ISC
    ("mit", 5, "free of charge to any person", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", 5, "permission notice shall", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 4, "mit licen", rf"(?:released |licen[cs]ed |available |distributed )?(?:under |with )?(?:the )?mit {LICEN}"),
    ("mit", 4, "license mit", r"license mit"),
    ("mit", 4, "licence mit", r"licence mit"),
    ("mit", 4, "opensource org licenses mit", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("expat", 4, "expat", rf"(?:the )?expat {LICEN}"),
    ("x11", 4, "x11", rf"(?:the )?x11 {LICEN}"),
    ("mit-0", 5, "mit no attribution", rf"mit no attribution(?: {LICEN})?"),
    ("isc", 5, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 4, "isc licen", rf"(?:the )?isc {LICEN}"),
    # BSD
    ("bsd", 4, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 5, "neither the name", r"neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors"),
    ("bsd-4-clause", 5, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("bsd-0-clause", 5, "bsd", rf"(?:0|zero) clause bsd(?: {LICEN})?"),
    ("bsd-2-clause", 5, "bsd", rf"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: {LICEN})?"),
    ("bsd-3-clause", 5, "bsd", rf"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|new bsd|modified bsd|revised bsd)(?: {LICEN})?"),
    ("bsd-4-clause", 5, "bsd", rf"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)(?: {LICEN})?"),
    ("bsd", 3, "bsd", rf"(?:the )?bsd (?:style )?{LICEN}"),
    # GNU
    ("gpl", 4, "free software foundation", r"published by the free software foundation"),
    ("gpl", 4, "redistribute it and or modify", r"redistribute it and or modify it under the terms of"),
    ("lgpl", 4, "lesser general public", rf"(?:gnu )?lesser general public {LICEN}"),
    ("lgpl", 4, "library general public", rf"(?:gnu )?library general public {LICEN}"),
    ("agpl", 4, "affero", rf"(?:gnu )?affero general public {LICEN}"),
    ("gpl", 4, "gnu", rf"gnu (?:general public {LICEN}|gpl)"),
    ("gfdl", 4, "free documentation", rf"(?:gnu )?free documentation {LICEN}"),
    ("gpl", 3, "gpl", rf"gpl(?:ed| {LICEN})?"),
    ("lgpl", 3, "lgpl", rf"lgpl(?: {LICEN})?"),
    ("agpl", 3, "agpl", rf"agpl(?: {LICEN})?"),
    ("gpl-classpath-exception", 5, "classpath exception", r"(?:with )?(?:the )?classpath exception"),
    ("gcc-exception", 5, "runtime library exception", r"gcc runtime library exception(?: 3 1)?"),
    ("gpl-linking-exception", 5, "linking exception", r"(?:with )?(?:a )?(?:static )?linking exception"),
    # Mozilla, Eclipse, Sun and others with their own names
    ("mpl", 4, "mozilla public", rf"mozilla public {LICEN}"),
    ("epl", 4, "eclipse public", rf"eclipse public {LICEN}"),
    ("edl-1.0", 5, "eclipse distribution", rf"eclipse distribution {LICEN}(?: {VER}1 0)?"),
    ("cddl", 4, "common development and distribution", rf"common development and distribution {LICEN}"),
    ("cpl-1.0", 4, "common public", rf"common public {LICEN}(?: {VER}1 0)?"),
    ("ipl-1.0", 4, "ibm public", rf"ibm public {LICEN}(?: {VER}1 0)?"),
    ("npl", 4, "netscape public", rf"netscape public {LICEN}"),
    ("spl-1.0", 4, "sun public", rf"sun public {LICEN}(?: {VER}1 0)?"),
    ("osl", 4, "open software", rf"open software {LICEN}"),
    ("afl", 4, "academic free", rf"academic free {LICEN}"),
    ("artistic", 4, "artistic", rf"(?:the )?(?:perl )?artistic {LICEN}"),
    ("bsl-1.0", 5, "boost", rf"boost software {LICEN}(?: {VER}1 0)?"),
    ("zlib", 4, "zlib", rf"(?:the )?zlib(?: libpng)? {LICEN}"),
    ("libpng", 4, "libpng", rf"(?:the )?libpng {LICEN}"),
    ("php", 4, "php", rf"(?:the )?php {LICEN}(?: {VER}3(?: 0 ?1?)?)?"),
    ("psf-2.0", 4, "python software foundation", rf"python software foundation {LICEN}(?: {VER}2)?"),
    ("python", 3, "python", rf"python {LICEN}"),
    ("ruby", 4, "ruby", rf"ruby {LICEN}"),
    ("postgresql", 4, "postgresql", rf"postgresql {LICEN}"),
    ("openssl", 4, "openssl", rf"openssl {LICEN}"),
    ("ncsa", 4, "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LICEN}"),
    ("w3c", 4, "w3c", rf"w3c software(?: notice and)? {LICEN}"),
    ("unicode", 4, "unicode", rf"unicode(?: inc)? {LICEN}(?: agreement)?"),
    ("ofl", 4, "open font", rf"(?:sil )?open font {LICEN}"),
    ("ms-pl", 4, "microsoft public", rf"microsoft public {LICEN}"),
    ("ms-rl", 4, "microsoft reciprocal", rf"microsoft reciprocal {LICEN}"),
    ("eupl", 4, "european union public", rf"european union public {LICEN}"),
    ("cecill", 4, "cecill", r"(?:licence )?cecill"),
    ("cecill-b", 5, "cecill", r"(?:licence )?cecill b"),
    ("cecill-c", 5, "cecill", r"(?:licence )?cecill c"),
    ("wtfpl", 4, "wtfpl", r"wtfpl"),
    ("wtfpl", 4, "what the fuck you want", rf"do what the fuck you want to public {LICEN}"),
    ("beerware", 4, "beerware", rf"beerware(?: {LICEN})?"),
    ("beerware", 4, "beer ware", rf"beer ware(?: {LICEN})?"),
    ("unlicense", 4, "unlicense", r"(?:the )?unlicense"),
    ("unlicense", 5, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("odbl", 4, "open database", rf"open (?:data commons open )?database {LICEN}"),
    ("odc-by", 4, "open data commons attribution", rf"open data commons attribution {LICEN}"),
    ("pddl", 4, "public domain dedication", rf"public domain dedication and {LICEN}"),
    ("busl-1.1", 5, "business source", rf"business source {LICEN}(?: {VER}1 1)?"),
    ("sspl-1.0", 5, "server side public", rf"server side public {LICEN}(?: {VER}1)?"),
    ("elastic-2.0", 5, "elastic", rf"elastic {LICEN}(?: {VER}2(?: 0)?)?"),
    ("commons-clause", 5, "commons clause", r"commons clause(?: license condition)?"),
    ("polyform", 4, "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)(?: license)?"),
    ("llama", 4, "community license", r"[^ ]+(?: [0-9]+)* community license agreement"),
    ("openrail", 4, "openrail", r"(?:bigscience |bigcode |creativeml )?open ?rail(?: m| s)?(?: license)?"),
    # Creative Commons without a version
    ("cc0-1.0", 5, "cc0", rf"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: {LICEN})?"),
    ("cc0-1.0", 5, "creative commons zero", rf"creative commons zero(?: {VER}1 0)?"),
    ("cc-pdm", 4, "public domain mark", r"public domain mark(?: 1 0)?"),
    ("cc", 3, "creative commons", rf"creative commons(?: {LICEN})?"),
    ("cc", 3, "creativecommons org", r"creativecommons org(?: licenses)?"),
    # notices
    ("copyright", 2, "copyright", r"copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", 2, "copyright", r"copyright (?:notice|holder|holders|owner)"),
    ("copyright", 1, "copyright", r"copyright(?:ed)?"),
    ("reserved", 2, "rights reserved", r"(?:some|no) rights reserved"),
    ("reserved", 2, "tous droits", r"tous droits r[^ ]+serv[^ ]+s"),
    ("reserved", 2, "alle rechte", r"alle rechte vorbehalten"),
    ("reserved", 2, "todos los derechos", r"todos los derechos reservados"),
    ("proprietary", 4, "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", 3, "proprietary", rf"proprietary (?:software|information|{LICEN})"),
    ("no-reproduction", 3, "may be reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("no-redistribution", 3, "not be", r"(?:may|must) not be (?:copied|redistributed|reproduced)(?: or redistributed)?"),
    ("public-domain", 3, "public domain", r"(?:released into |in |placed in )?(?:the )?public domain"),
    ("no-warranty", 1, "without warranty", r"without warranty of any kind"),
    ("no-warranty", 1, "without any warranty", r"without any warranty"),
    ("no-warranty", 1, "as is basis", r"as is basis"),
    ("non-commercial", 2, "non commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", 2, "noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    ("licensed", 1, "licensed under", r"licensed under(?: the)?(?: terms of)?"),
    ("licensed", 1, "license agreement", r"(?:end user )?license agreement"),
    ("spdx", 3, "spdx license", r"spdx license identifier"),
]

#: The same for rarer licences, data and model terms, and notices in more languages and wordings.
RARER = [
    ("apl-1.0", 5, "adaptive public", rf"adaptive public {LICEN}(?: {VER}1 0)?"),
    ("apsl", 4, "apple public source", rf"apple public source {LICEN}"),
    ("catosl-1.1", 5, "computer associates", rf"computer associates trusted open source {LICEN}(?: {VER}1 1)?"),
    ("cpal-1.0", 5, "common public attribution", rf"common public attribution {LICEN}(?: {VER}1 0)?"),
    ("cua-opl-1.0", 5, "cua office", rf"cua office public {LICEN}(?: {VER}1 0)?"),
    ("ecl", 4, "educational community", rf"educational community {LICEN}(?: {VER}[12] 0)?"),
    ("efl", 4, "eiffel forum", rf"eiffel forum {LICEN}(?: {VER}[12](?: 0)?)?"),
    ("entessa", 4, "entessa", rf"entessa public {LICEN}"),
    ("fair", 4, "fair licen", rf"the fair {LICEN}"),
    ("frameworx-1.0", 5, "frameworx", rf"frameworx open {LICEN}(?: {VER}1 0)?"),
    ("hpnd", 4, "historical permission", r"historical permission notice and disclaimer"),
    ("intel", 4, "intel open source", rf"intel open source {LICEN}"),
    ("ipafont", 4, "ipa font", rf"ipa font {LICEN}(?: agreement)?(?: {VER}1 0)?"),
    ("lpl", 4, "lucent public", rf"lucent public {LICEN}(?: {VER}1 0 ?2?)?"),
    ("lppl", 4, "latex project", rf"latex project public {LICEN}(?: {VER}1 [0-3] ?[ac]?)?"),
    ("miros", 4, "miros", rf"(?:the )?miros {LICEN}"),
    ("motosoto", 4, "motosoto", rf"motosoto open source {LICEN}"),
    ("multics", 4, "multics", rf"multics {LICEN}"),
    ("mulan", 4, "mulan", rf"mulan (?:permissive|public) (?:software )?{LICEN}(?: {VER}[12])?"),
    ("naumen", 4, "naumen", rf"naumen public {LICEN}"),
    ("nasa", 4, "nasa open source", rf"nasa open source agreement(?: {VER}1 3)?"),
    ("nethack", 4, "nethack", rf"nethack general public {LICEN}"),
    ("nokia", 4, "nokia open source", rf"nokia open source {LICEN}"),
    ("nosl", 4, "non profit open", rf"non profit open software {LICEN}(?: {VER}3 0)?"),
    ("ntp", 4, "ntp licen", rf"(?:the )?ntp {LICEN}"),
    ("oclc", 4, "oclc", rf"oclc research public {LICEN}(?: {VER}2 0)?"),
    ("ogtsl", 4, "open group test", rf"open group test suite {LICEN}"),
    ("oldap", 4, "openldap", rf"openldap public {LICEN}(?: {VER}2 [0-8])?"),
    ("qpl", 4, "q public", rf"(?:the )?q public {LICEN}(?: {VER}1 0)?"),
    ("rpl", 4, "reciprocal public", rf"reciprocal public {LICEN}(?: {VER}1 [15])?"),
    ("rpsl", 4, "realnetworks public", rf"realnetworks public source {LICEN}(?: {VER}1 0)?"),
    ("rscpl", 4, "ricoh source", rf"ricoh source code public {LICEN}"),
    ("simpl-2.0", 5, "simple public", rf"simple public {LICEN}(?: {VER}2 0)?"),
    ("sissl", 4, "sun industry", rf"sun industry standards source {LICEN}"),
    ("sleepycat", 4, "sleepycat", rf"(?:the )?sleepycat {LICEN}"),
    ("upl-1.0", 5, "universal permissive", rf"universal permissive {LICEN}(?: {VER}1 0)?"),
    ("vsl-1.0", 5, "vovida", rf"vovida software {LICEN}(?: {VER}1 0)?"),
    ("vim", 4, "vim licen", rf"(?:the )?vim {LICEN}"),
    ("watcom-1.0", 5, "sybase open", rf"sybase open watcom public {LICEN}(?: {VER}1 0)?"),
    ("wxwindows", 4, "wxwindows", rf"wxwindows (?:library )?{LICEN}"),
    ("xnet", 4, "x net licen", rf"x net {LICEN}"),
    ("zpl", 4, "zope public", rf"zope public {LICEN}(?: {VER}[12] [01])?"),
    ("curl", 4, "curl licen", rf"(?:the )?curl {LICEN}"),
    ("ftl", 4, "freetype", rf"(?:the )?freetype(?: project)? {LICEN}"),
    ("ijg", 4, "independent jpeg", r"(?:work of the )?independent jpeg group"),
    ("info-zip", 4, "info zip", rf"info zip {LICEN}"),
    ("imagemagick", 4, "imagemagick", rf"imagemagick {LICEN}"),
    ("icu", 4, "icu licen", rf"icu {LICEN}"),
    ("bzip2", 4, "bzip2", rf"bzip2(?: libbzip2)? {LICEN}"),
    ("tcl", 4, "tcl tk", rf"tcl tk {LICEN}"),
    ("jasper", 4, "jasper", rf"jasper {LICEN}(?: {VER}2 0)?"),
    ("sqlite-blessing", 4, "may you do good", r"may you do good and not evil"),
    ("json", 5, "shall be used for good", r"the software shall be used for good not evil"),
    ("bitstream-vera", 4, "bitstream vera", r"bitstream vera(?: fonts)?(?: copyright)?"),
    ("ubuntu-font", 5, "ubuntu font", rf"ubuntu font {LICEN}(?: {VER}1 0)?"),
    ("free-art", 4, "free art", rf"free art {LICEN}(?: {VER}1 [23])?"),
    ("free-art", 4, "licence art libre", r"licence art libre(?: 1 [23])?"),
    ("opl", 4, "open publication", rf"open publication {LICEN}(?: {VER}(?:0 4|1 0))?"),
    ("ogl", 4, "open government", rf"open government {LICEN}(?: {VER}[123](?: 0)?)?"),
    ("ogl-rpg", 4, "open game", rf"open game {LICEN}(?: {VER}1 0a?)?"),
    ("dl-de", 4, "datenlizenz deutschland", r"datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?"),
    ("etalab", 4, "licence ouverte", r"licence ouverte(?: open licence)?(?: 2 0)?"),
    ("cdla-permissive", 4, "community data", rf"community data {LICEN} agreement permissive(?: {VER}[12] 0)?"),
    ("cdla-sharing", 4, "community data", rf"community data {LICEN} agreement sharing(?: {VER}1 0)?"),
    ("gemma", 4, "gemma terms", r"gemma terms of use"),
    ("responsible-ai", 4, "responsible ai", rf"responsible ai {LICEN}"),
    ("hippocratic", 4, "hippocratic", rf"hippocratic {LICEN}(?: {VER}[123] [01])?"),
    ("fsl", 4, "functional source", rf"functional source {LICEN}(?: {VER}1 [01])?"),
    ("prosperity", 4, "prosperity public", rf"prosperity public {LICEN}(?: {VER}[23] 0(?: 0)?)?"),
    ("parity", 4, "parity public", rf"parity public {LICEN}(?: {VER}[67] 0(?: 0)?)?"),
    ("blueoak-1.0.0", 5, "blue oak", rf"blue oak model {LICEN}(?: 1 0 0)?"),
    ("cern-ohl", 4, "cern open hardware", rf"cern open hardware {LICEN}(?: {VER}[12](?: 2)?)?(?: permissive| weakly reciprocal| strongly reciprocal)?"),
    ("solderpad", 4, "solderpad", rf"solderpad hardware {LICEN}(?: {VER}[02] [51]1?)?"),
    ("tapr-ohl", 4, "tapr open hardware", rf"tapr open hardware {LICEN}(?: {VER}1 0)?"),
    ("reserved", 2, "tutti i diritti", r"tutti i diritti (?:sono )?riservati"),
    ("reserved", 2, "todos os direitos", r"todos os direitos reservados"),
    ("reserved", 2, "alle rechten", r"alle rechten voorbehouden"),
    ("reserved", 2, "wszelkie prawa", r"wszelkie prawa zastrze[^ ]+one"),
    ("reserved", 2, "alla r", r"alla r[^ ]+ttigheter f[^ ]+rbeh[^ ]+llna"),
    ("trademark", 1, "registered trademark", r"(?:is a |are )?registered trademarks? of"),
    ("patent-grant", 2, "patent licen", rf"(?:royalty free |irrevocable |perpetual |worldwide )*patent {LICEN}"),
    ("dual-licensed", 3, "dual licen", rf"dual {LICEN}d(?: under)?"),
    ("attribution-required", 2, "attribution is required", r"attribution is required"),
    ("share-alike", 2, "share alike", r"under the same or (?:a )?similar license|share alike terms"),
    ("no-derivatives", 2, "derivative works", r"no derivative works"),
    ("fair-use", 1, "fair use", r"fair use(?: notice| rationale)?"),
]

CC_PARTS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: family: keyword, words of the name, versions
VERSIONED = {
    "gpl": ("general public", rf"(?:gnu )?general public {LICEN}", ("1.0", "2.0", "3.0")),
    "lgpl": ("lesser general", rf"(?:gnu )?lesser general public {LICEN}", ("2.0", "2.1", "3.0")),
    "agpl": ("affero general", rf"(?:gnu )?affero general public {LICEN}", ("1.0", "3.0")),
    "gfdl": ("free documentation", rf"(?:gnu )?free documentation {LICEN}", ("1.1", "1.2", "1.3")),
    "mpl": ("mozilla public", rf"mozilla public {LICEN}", ("1.0", "1.1", "2.0")),
    "epl": ("eclipse public", rf"eclipse public {LICEN}", ("1.0", "2.0")),
    "cddl": ("common development", rf"common development and distribution {LICEN}", ("1.0", "1.1")),
    "npl": ("netscape public", rf"netscape public {LICEN}", ("1.0", "1.1")),
    "osl": ("open software", rf"open software {LICEN}", ("1.0", "2.0", "2.1", "3.0")),
    "afl": ("academic free", rf"academic free {LICEN}", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "artistic": ("artistic", rf"artistic {LICEN}", ("1.0", "2.0")),
    "ofl": ("open font", rf"(?:sil )?open font {LICEN}", ("1.0", "1.1")),
    "eupl": ("european union", rf"european union public {LICEN}", ("1.0", "1.1", "1.2")),
    "cecill": ("cecill", r"cecill", ("1.0", "1.1", "2.0", "2.1")),
}
#: short names that stand with a version number
SHORT = {
    "gpl": ("1.0", "2.0", "3.0"),
    "lgpl": ("2.0", "2.1", "3.0"),
    "agpl": ("1.0", "3.0"),
    "gfdl": ("1.1", "1.2", "1.3"),
    "mpl": ("1.0", "1.1", "2.0"),
    "epl": ("1.0", "2.0"),
    "cddl": ("1.0", "1.1"),
    "osl": ("1.0", "2.0", "2.1", "3.0"),
    "afl": ("1.1", "1.2", "2.0", "2.1", "3.0"),
    "ofl": ("1.0", "1.1"),
    "eupl": ("1.0", "1.1", "1.2"),
}
LATER = ("gpl", "lgpl", "agpl", "gfdl")


def _spelled(version: str) -> str:
    """ "2.0" as it stands between words; a final ".0" may be missing."""
    major, minor = version.split(".")
    return f"{major}(?: 0)?(?! [0-9])" if minor == "0" else f"{major} {minor}"


def rules() -> list[Rule]:
    """All rules in order: base phrases, named ones, and those spelled out by version."""
    out = [*BASE, *(Rule(*r) for r in (*NAMED, *RARER))]
    for kind, words in CC_PARTS.items():
        short = kind.replace("-", " ")
        out.append(Rule(f"cc-{kind}", 4, f"cc {short}", f"cc {short}(?: {LICEN})?"))
        out.append(Rule(f"cc-{kind}", 4, "creative commons", rf"creative commons {words}(?: international| unported)?(?: {LICEN})?"))
        out.append(Rule(f"cc-{kind}", 4, "creativecommons org", f"creativecommons org licenses {short}"))
        for v in CC_VERSIONS:
            out.append(Rule(f"cc-{kind}-{v}", 5, f"cc {short}", f"cc {short} {_spelled(v)}(?: {LICEN})?"))
            out.append(Rule(f"cc-{kind}-{v}", 5, "creative commons", rf"creative commons {words} {VER}{_spelled(v)}(?: international| unported)?(?: {LICEN})?"))
            out.append(Rule(f"cc-{kind}-{v}", 5, "creativecommons org", f"creativecommons org licenses {short} {_spelled(v)}"))
    for family, (keyword, words, versions) in VERSIONED.items():
        for v in versions:
            out.append(Rule(f"{family}-{v}", 5, keyword, rf"{words} {VER}{_spelled(v)}"))
            if family in LATER:
                out.append(Rule(f"{family}-{v}-or-later", 5, keyword, rf"{words} {VER}{_spelled(v)} or (?:at your option )?(?:any )?later(?: version)?"))
                out.append(Rule(f"{family}-{v}-only", 5, keyword, rf"{words} {VER}{_spelled(v)} only"))
    for family, versions in SHORT.items():
        for v in versions:
            forms = [(f"{family} ", rf"{family} {VER}")]
            if family in LATER:
                forms += [(f"{family}v", f"{family}v"), (f"{family}{v[0]}", family)]
            for keyword, start in forms:
                out.append(Rule(f"{family}-{v}", 5, keyword, f"{start}{_spelled(v)}"))
                if family in LATER:
                    out.append(Rule(f"{family}-{v}-or-later", 5, keyword, f"{start}{_spelled(v)} or later"))
    return out
